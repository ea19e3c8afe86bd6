from pyspark.sql import functions as F

from reviewlens.functions import labels as L
from reviewlens.functions import payloads as P
from reviewlens.functions.labels import ASPECTS


def test_multipolarity(apply):
    cells = {
        None: (0, 0, 0, 0), "2": (0, 0, 0, 0), "": (0, 0, 0, 0), "nan": (0, 0, 0, 0),
        "-1": (1, 1, 0, 0), "1": (1, 0, 1, 0), "0": (1, 0, 0, 1),
        "[-1,1]": (1, 1, 1, 0), "-1, 1": (1, 1, 1, 0), "[-1,0,1]": (1, 1, 1, 1),
        "2,1": (1, 0, 1, 0), "-1,x": (1, 0, 0, 1), "5": (1, 0, 0, 1), "abc": (1, 0, 0, 1), "2.0": (1, 0, 0, 1),
    }
    got = apply(L.parse_multipolarity, list(cells))
    assert [tuple(r) for r in got] == list(cells.values())
    assert all(sum(r[1:]) == 0 for r in got if r["mention"] == 0)


def test_legacy(apply):
    got = apply(L.parse_legacy, ["-1", None, "0", "1", "2", "2.0"])
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (1, 0), (1, 1), (1, 2), (1, 2)]


def test_classes_and_names(apply):
    assert apply(L.label_to_class, ["-1", "0", "1", "2", "7", None]) == [0, 1, 2, 3, 0, 0]
    assert apply(L.decode_label, ["1", "0", "-1", "2", "9"]) == ["POS", "NEU", "NEG", "NOT_MENTIONED", "UNKNOWN"]
    assert apply(L.words_to_canonical, ["POS", "NEG", "NEU", "None", None]) == [1, -1, 0, 2, 2]


def test_sentiment_json(apply):
    got = apply(L.encode_sentiment, [{"a": 1, "b": 2, "c": None}], "map<string,int>")
    assert got == ['{"a":1,"c":null}']
    assert apply(L.decode_sentiment, ['{"a":-1}']) == [{"a": -1}]


def test_argmax(apply):
    got = apply(lambda c: L.argmax_matrix(c, 2), ["[[0.1,0.8,0.8],[1,0,0]]", "[[1,0]]", None])
    assert got == [[1, 0], None, None]


def test_wide_long_wide(spark):
    df = spark.createDataFrame([(1, "1", "2"), (2, None, "0")], "id int, a string, b string")
    long = L.to_long(df, ["id"], ["a", "b", "c"])
    assert sorted(map(tuple, long.na.fill("-").collect())) == [
        (1, "a", "1"), (1, "b", "2"), (1, "c", "2"), (2, "a", "-"), (2, "b", "0"), (2, "c", "2"),
    ]
    wide = L.to_wide(long, ["id"], ["a", "b"], "label").orderBy("id")
    assert [tuple(r) for r in wide.collect()] == [(1, "1", "2"), (2, None, "0")]


def test_heads(spark):
    df = spark.createDataFrame([([1.0, -1.0], [3.0, 1.0, 0.0, 0.0, 0.0, 9.0])], "m array<double>, s array<double>")
    single = df.select(L.logits_to_labels("m", "s", ["x", "y"]).alias("r")).first()["r"]
    assert [tuple(r) for r in single] == [("x", "-1"), ("y", "2")]
    multi = df.select(L.logits_to_labels("m", "s", ["x", "y"], multi=True).alias("r")).first()["r"]
    assert [tuple(r) for r in multi] == [("x", "[-1,1]"), ("y", "2")]


def test_replies(apply):
    a = ASPECTS[0]
    good = f'{{"{a}": "-1"}}'
    got = apply(lambda c: P.reply_labels(c, [a, "b"]), [good, f"x {good} y", "none", None])
    assert got == [{a: "-1", "b": "2"}, {a: "-1", "b": "2"}, None, None]
    words = apply(lambda c: P.reply_words(c, ["a", "b"]), ['{"a": "POS", "b": "maybe"}'])
    assert words == [{"a": "POS", "b": None}]


def test_page_fields(apply):
    html = '<title> Tên | Shop</title>{"priceShow":"1 ₫","image":"i.png","ratingScore":4.5}window.__INIT_STATE__ = {"productData":{"title":"T"}};'
    assert apply(P.page_title, [html, "x"]) == ["Tên", "Unknown Product"]
    assert apply(lambda c: P.page_field(c, P.PAGE_PRICE, "N/A"), [html, ""]) == ["1 ₫", "N/A"]
    assert apply(lambda c: P.page_field(c, P.PAGE_RATING), [html]) == ["4.5"]
    assert apply(lambda c: P.page_state(c, "$.productData.title"), [html]) == ["T"]


def test_prompt(spark):
    from reviewlens.functions.text import render_prompt

    df = spark.createDataFrame([("ok",)], "t string")
    got = df.select(render_prompt("<{review}> {aspects}", F.col("t"), ["a", "b"])).first()[0]
    assert got == '<ok> "a", "b"'
