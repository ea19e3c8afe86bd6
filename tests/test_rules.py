import random

import pytest
from pyspark.sql import functions as F

from reviewlens.functions.labels import ASPECTS
from reviewlens.functions.text import TYPO_REPLACEMENTS
from reviewlens.operators import relate, rules, validate
from reviewlens.operators.lexicon import AspectWords, Lexicon, keyword_positions, minimal

CL, HN, VC, XT = ASPECTS[0], ASPECTS[1], ASPECTS[4], ASPECTS[8]


def label(spark, engine, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.asDict() for r in engine(df, "t", **kw).orderBy("i").collect()]


def only(row, **_):
    return {a: row[a] for a in ASPECTS if row[a] != "2"}


def test_doc_polarity(apply):
    got = apply(rules.doc_polarity, ["Sản phẩm tốt, giao hàng nhanh", "bình thường", "tệ, chậm nhưng đẹp", None])
    assert got == ["POSITIVE", "NEUTRAL", "NEGATIVE", "NEUTRAL"]


def test_simple(spark):
    texts = ["Áo đẹp nhưng vải hơi mỏng", "Tốt", "Giày đẹp, ship nhanh", "Hàng giả, thất vọng", "", None]
    got = [only(r) for r in label(spark, rules.rules_simple, texts)]
    assert got == [{CL: "[-1,1]"}, {CL: "1"}, {CL: "1", HN: "1", VC: "1"}, {CL: "-1", XT: "-1"}, {}, {}]


def test_rating(spark):
    df = spark.createDataFrame([(2, "x"), (3, "đẹp"), (5, "kém, lỗi, đẹp"), (4, "xấu đẹp")], "r int, t string")
    rows = rules.rating_keyword_label(df, "t", "r").collect()
    assert [rows[0][a] for a in ASPECTS] == ["-1"] * 9
    assert [r[CL] for r in rows] == ["-1", "1", "-1", "1"]
    assert [r[VC] for r in rows] == ["-1", "0", "1", "1"]


def test_gated(spark):
    got = [only(r) for r in label(spark, rules.rules_mention_gated, ["vải ok", "hộp", "giá", "ok"])]
    assert got[0][CL] == "1" and got[1][ASPECTS[5]] == "-1" and got[2][ASPECTS[3]] == "0" and CL not in got[3]


SMALL = Lexicon(
    aspects={
        "x": AspectWords(nouns=("áo", "vả"), positive=("đẹp", "tốt"), negative=("mỏng", "kém")),
        "y": AspectWords(nouns=("ship",), positive=("nhanh",), negative=("chậm",)),
    },
    positive=("đẹp", "tốt", "nhanh"),
    negative=("mỏng", "kém", "chậm"),
    neutral=("tạm",),
    contrast=("nhưng", "dù"),
)


def test_context_v1(spark):
    far = "z" * 60
    texts = ["áo đẹp tạm nhưng", "áo kém tạm dù", "áo " + far + " đẹp", "áo đẹp mỏng", "đẹp quá", "đẹp" + "z" * 100, "áo tạm"]
    rows = label(spark, rules.rules_context_v1, texts, lexicon=SMALL)
    assert [r["x"] for r in rows] == ["[0,1]", "[-1,0]", "0", "[-1,1]", "1", "2", "0"]


def naive_context_v2(text):
    """Window by window, for comparison."""
    t = text
    for _ in range(2):
        t = t.lower().strip()
        for old, new in TYPO_REPLACEMENTS:
            t = t.replace(old, new)
    out = {}
    for aspect, w in SMALL.aspects.items():
        has = lambda s, words: any(k in s for k in words)
        spots = {i for k in w.nouns for i in range(len(t)) if t.startswith(k, i)}
        pos, neg = has(t, w.positive), has(t, w.negative)
        if not spots:
            if not pos and not neg:
                out[aspect] = "2"
                continue
            spots = {0}
        views = [t[max(0, i - 60) : i + 60] for i in spots]
        mixed = any(has(v, SMALL.contrast) and has(v, (*w.positive, *w.negative)) for v in views)
        out[aspect] = "[-1,1]" if mixed or (pos and neg) else "1" if pos else "-1" if neg else "0"
    return out


def test_context_v2_against_naive(spark):
    rnd = random.Random(7)
    parts = ["áo", "vả", "đẹp", "tốt", "mỏng", "kém", "ship", "nhanh", "chậm", "nhưng", "dù", "😀", "😀" * 20, "z" * 17, " ", "a b", ". ", "k ", "ab" * 9]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(4, 18))) for _ in range(1500)]
    # a window edge, one character either way, with astral characters in between
    for n in range(52, 60):
        texts += ["nhưng" + "😀" * n + "áo đẹp" + "z" * 20, "áo" + "😀" * n + "nhưng" + "z" * 99 + " đẹp", "đẹp nhưng" + "z" * n + "áo"]
    rows = label(spark, rules.rules_context_v2, texts, lexicon=SMALL, short=0)
    wrong = [(t, r["x"], r["y"]) for t, r in zip(texts, rows) if {"x": r["x"], "y": r["y"]} != naive_context_v2(t)]
    assert wrong == []
    assert {r["x"] for r in rows} == {"2", "1", "-1", "0", "[-1,1]"}


def test_context_v2_short(spark):
    rows = label(spark, rules.rules_context_v2, ["thích", "bad", "thích " + "z" * 20], lexicon=SMALL)
    assert [r["x"] for r in rows] == ["1", "-1", "2"]
    with pytest.raises(ValueError):
        rules.rules_context_v2(spark.range(1).selectExpr("'a' t"), "t", Lexicon(aspects={"x": AspectWords(nouns=("😀",))}))


def test_cascade(spark):
    df = spark.createDataFrame(
        [(0, "đẹp", f'{{"{VC}": -1}}'), (1, "đẹp", "?"), (2, " ", f'{{"{VC}": 1}}'), (3, "đẹp", "{}")], "i int, t string, reply string"
    )
    got = [only(r.asDict()) for r in rules.label_cascade(df, "t", "reply").orderBy("i").collect()]
    assert got == [{VC: "-1"}, {CL: "1"}, {}, {CL: "1"}]


def test_positions(apply):
    got = apply(lambda c: keyword_positions(F.col(c), ["aa", "b", "bc"]), ["aaab bc", "x", "baa", "", None, "\x01b", "😀b"])
    assert got == [[0, 1, 3, 5], [], [0, 1], [], None, [1], [1]]


def test_minimal():
    assert sorted(minimal(["đẹp", "đẹp lắm", "tốt"])) == ["tốt", "đẹp"]


def test_lexicon_table(spark):
    table = spark.createDataFrame(SMALL.rows(), "aspect string, role string, keyword string")
    back = Lexicon.from_table(table)
    assert {a: set(w.nouns) for a, w in back.aspects.items()} == {"x": {"áo", "vả"}, "y": {"ship"}}
    df = spark.createDataFrame([(1, "Áo đẹp 😀 ship"), (2, None)], "i int, t string")
    small = relate.lexicon_join(df, "t", ["i"], table)
    lower = df.select("i", F.lower(F.coalesce("t", F.lit(""))).alias("x"))
    large = relate.match_by_gram(lower, "x", ["i"], table)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    odd = spark.createDataFrame([("a", "n", k) for k in ("p", "hi", "ship", "ship now", "😀 s", "😀", "", "p", None)], "aspect string, role string, keyword string")
    found = [relate.lexicon_join(df, "t", ["i"], odd), relate.match_by_gram(lower, "x", ["i"], odd)]
    for rows in found:
        assert sorted(r["keyword"] for r in rows.collect()) == ["", "", "hi", "p", "p", "ship", "😀", "😀 s"]


def test_lexicon_of_any_size(spark, monkeypatch):
    """One answer on both sides of every size check."""
    df = spark.createDataFrame([(1, "x word17x word2999"), (2, "word5"), (2, "word5"), (3, None)], "i int, t string")
    big = spark.range(5000).select(F.lit("a").alias("aspect"), F.lit("n").alias("role"), F.concat(F.lit("word"), F.col("id")).alias("keyword"))
    want = [(1, f"word{k}") for k in (1, 17, 2, 29, 299, 2999)] + [(2, "word5")] * 2
    for limit in (relate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(relate, "BROADCAST_BYTES", limit)
        got = relate.lexicon_join(df, "t", ["i"], big)
        assert sorted((r["i"], r["keyword"]) for r in got.collect()) == sorted(want)
    assert relate.lexicon_join(df, "t", ["i"], big.limit(0)).count() == 0


def test_validation(spark):
    df = spark.createDataFrame(
        [(0, "vải mỏng", "2", "2"), (1, "vải mỏng", "[-1,1]", "2"), (2, "đẹp nhưng đắt", "1", "2"), (3, "đẹp", "-1", None)],
        ["i", "t", CL, VC],
    )
    issues = [r.asDict() for r in validate.validate_labels(df, ["i"], "t").collect()]
    by_row = {r["i"]: r for r in issues}
    assert set(by_row) == {0, 2, 3}
    assert (by_row[0]["severity"], by_row[0]["expected"], by_row[0]["actual"]) == ("high", "NEG", "NOT_MENTIONED")
    assert by_row[2]["type"] == "missing_multi_polarity" and by_row[2]["aspects"] == [CL, VC][:1]
    assert (by_row[3]["severity"], by_row[3]["actual"]) == ("medium", "NEG")


def test_trie_pattern_finds_what_contains_finds(spark, monkeypatch):
    from reviewlens.operators import lexicon

    rng = random.Random(11)
    words = sorted({"".join(rng.choice("ab.[|*đ\n") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    texts = ["".join(rng.choice("abc.[|*đ\n") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for chosen in (words, words[:9], ["b"], ["ab", "ac"], ["a.b", "a[b"]):
        monkeypatch.setattr(lexicon, "TRIE_FROM", 1)
        got = [r[0] for r in df.select(lexicon.contains_any(F.col("t"), chosen)).collect()]
        assert got == [any(k in t for k in chosen) for t in texts]
    assert df.select(lexicon.contains_any(F.col("t"), [""])).where("NOT `%s`" % df.select(lexicon.contains_any(F.col("t"), [""])).columns[0]).count() == 0


def test_gram_index_equals_plain_search(spark, monkeypatch):
    """Repeats, empty, null and short keywords, characters outside the basic plane, broadcast and shuffled."""
    rng = random.Random(12)
    letters = "abcđ😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, ""]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["", "", None, "A"]
    entries = [(f"a{i % 7}", "r", w) for i, w in enumerate(words)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table = spark.createDataFrame(entries, "aspect string, role string, keyword string")
    want = sorted((i, a, w) for i, t in enumerate(texts) for a, _, w in entries if w is not None and w in (t or "").lower())
    for bound in (32 << 20, 0):
        monkeypatch.setattr(relate, "BROADCAST_BYTES", bound)
        found = relate.lexicon_join(rows, "t", ["i"], table)
        assert sorted((r.i, r.aspect, r.keyword) for r in found.collect()) == want
    # the text is cut down to index grams before anything is exploded
    assert "getbit" in found._jdf.queryExecution().optimizedPlan().toString().lower()
    none = spark.createDataFrame([], table.schema)
    assert relate.match_by_gram(rows.withColumn("t", F.coalesce("t", F.lit(""))), "t", ["i"], none).count() == 0


def test_counts_of_repeated_entries_move_with_the_keyword(spark):
    """One entry per keyword with its counts gives the sums of all repeated entries; a long keyword is found by a long gram."""
    rows = spark.createDataFrame([(1, "abcdefgh ab"), (2, "xyabcdef"), (3, None)], "i int, t string")
    words = ["ab", "abcdefg", "bcdef", "", "h ab", "zz", None] * 30
    table = spark.createDataFrame([(str(i), "r", w) for i, w in enumerate(words)], "aspect string, role string, keyword string")
    plain = relate.lexicon_join(rows, "t", ["i"], table).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.length("keyword")).alias("m"))
    counts = table.groupBy("keyword").agg(F.count("*").alias("k"))
    many = counts.unionByName(spark.range(200).select(F.concat(F.lit("none"), F.col("id")).alias("keyword"), F.lit(1).cast("bigint").alias("k")))
    for lexicon in (counts, many):
        each = relate.lexicon_join(rows, "t", ["i"], lexicon, ["k"])
        summed = each.groupBy("i").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.length("keyword")).alias("m"))
        assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, plain.collect())) == [(1, 150, 540), (2, 90, 210), (3, 30, 0)]
        assert each.count() == 9


def test_arrays_are_not_worked_out_again_below_the_spread(spark):
    """Spark tests an exploded array for emptiness before the shuffle that spreads the rows, in one task."""
    rows = spark.createDataFrame([(1, "vải mỏng", "2")], ["i", "t", CL]).repartition(3)
    table = spark.createDataFrame([("a", "r", f"k{i}") for i in range(300)], "aspect string, role string, keyword string")
    frames = [validate.validate_labels(rows, ["i"], "t"), relate.lexicon_join(rows, "t", ["i"], table), relate.lexicon_join(rows, "t", ["i"], table.limit(3))]
    for df in frames:
        below = df._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[1].splitlines()[1]
        assert "Filter" not in below
