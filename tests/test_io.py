import random
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from reviewlens.functions.labels import ASPECTS
from reviewlens.operators import aggregate
from reviewlens.operators.learn import batch_predictor, scorer_udf
from reviewlens.sources import readers, writers


def workbook(path, grid, shared=True):
    """A minimal xlsx file; numbers stay numbers, texts are shared or inline strings."""
    texts, lines = [], []
    for r, row in enumerate(grid, 1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if v is None:
                continue
            if isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif shared:
                texts.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(texts) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in texts)}</sst>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "b.xlsx", [["reviewContent", "A"], ["tốt & đẹp", 1], ["x", "[-1,1]"]])
    workbook(tmp_path / "a.xlsx", [["A", "reviewContent"], [2.5, "y"], [None, "z"]], shared=False)
    df = readers.read_workbook(spark, str(tmp_path))
    got = sorted((r["_file"], r["_row"], r["reviewContent"], r["A"]) for r in df.collect())
    assert got == [
        ("a.xlsx", 1, "y", "2.5"), ("a.xlsx", 2, "z", None), ("b.xlsx", 1, "tốt & đẹp", "1"), ("b.xlsx", 2, "x", "[-1,1]"),
    ]
    assert df.rdd.getNumPartitions() == 2
    remote = readers.read_workbook_remote(spark, str(tmp_path), ["reviewContent", "A"], rows_per_batch=1)
    assert sorted((r["_file"], r["_row"], r["reviewContent"], r["A"]) for r in remote.collect()) == got


def test_header_search(spark, tmp_path):
    workbook(tmp_path / "h.xlsx", [["group", "reviewContent"], ["reviewContent", f" {ASPECTS[0]} "], ["ok", 1], ["tệ", -1]])
    cells = readers.read_workbook(spark, str(tmp_path / "h.xlsx"), header=False).withColumnRenamed("_row", "row")
    assert readers.header_row(cells.drop("_file"), "row", ASPECTS[0]).first()[0] == 1
    assert readers.header_row(cells.drop("_file"), "row", ASPECTS[0], preview=1).first()[0] == 0
    assert readers.header_row(cells.drop("_file"), "row", "nothing").first()[0] == 0
    below = readers.below_header(cells, "row", ASPECTS[0])
    assert [tuple(r) for r in below.orderBy("row").collect()] == [("ok", "1", 2), ("tệ", "-1", 3)]
    assert below.columns == ["reviewContent", ASPECTS[0], "row"]


def test_prediction_documents(spark, tmp_path):
    docs = [{"review_id": "1", "original_text": "x", "sentiment": {"a": 1}, "rating": 5, "processed_at": 1.5}, {"review_id": "2", "sentiment": {}}]
    (tmp_path / "p1.json").write_text(json.dumps(docs, indent=2))
    got = readers.read_prediction_documents(spark, str(tmp_path)).orderBy("review_id").collect()
    assert [(r["product_id"], r["review_id"], r["sentiment"]) for r in got] == [("p1", "1", {"a": 1}), ("p1", "2", {})]


def test_review_pages(spark):
    page = {"model": {"items": [{"reviewId": 5, "reviewContent": "a", "rating": 4, "images": ["u"]}, {"id": 6}, {"reviewId": 7}], "paging": {"totalResults": 3}}}
    df = spark.createDataFrame([("p", 1, json.dumps(page)), ("p", 2, json.dumps(page)), ("q", 1, "bad")], "product string, page int, payload string")
    got = readers.reviews_from_pages(df, "payload", ["product"], "page", 4).collect()
    assert [r["review_id"] for r in got] == ["5", "6", "7", "5"]
    assert tuple(got[1])[2:] == ("", 0, "", "", "", [], 0)


def test_search_pages(spark):
    items = [{"name": "n", "productUrl": "//x/pdp-i123456-s1.html"}, {"itemId": "9", "productUrl": "http://y", "ratingScore": "4.5", "review": "12"}, {}]
    df = spark.createDataFrame([(1, json.dumps({"mods": {"listItems": items}}))], "page int, payload string")
    got = readers.products_from_search(df, "payload", ["page"], 2).orderBy("position").collect()
    assert [(r["item_id"], r["url"], r["price"], r["rating"], r["reviews"]) for r in got] == [
        ("123456", "https://x/pdp-i123456-s1.html", "N/A", 0.0, 0), ("9", "http://y", "N/A", 4.5, 12),
    ]


def test_url_lines(spark):
    df = spark.createDataFrame([(' "http://a" ',), ("",), ("  ",), ("“http://b”",), ("chat",)], "value string")
    assert [r[0] for r in readers.url_list(df).collect()] == ["http://a", "“http://b”", "chat"]


def test_folder_and_groups(spark, tmp_path):
    out = str(tmp_path / "groups")
    df = spark.range(10).select("id", (F.col("id") % 2).alias("g"))
    writers.write_groups(df, out, "g", "csv", max_rows=2)
    back = readers.read_folder(spark, out, "*.csv", recursive=True)
    assert back.count() == 10
    per_file = spark.read.csv(out).groupBy("_metadata.file_path").count().collect()
    assert len(per_file) >= 6 and all(r["count"] <= 2 for r in per_file)
    assert sum(r["n"] for r in readers.file_counts(back).collect()) == 10
    writers.append_metrics(spark.createDataFrame([("m", 1, 0.5)], "model string, version long, best_f1 double"), str(tmp_path / "m"))
    writers.append_metrics(spark.createDataFrame([("m", 2, 0.6)], "model string, version long, best_f1 double"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    writers.write_report(aggregate.value_counts(df, "g"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_scorer_keeps_going(spark):
    def load(version):
        def score(texts):
            if any("boom" in t for t in texts):
                raise ValueError("boom")
            return [version + ":" + t for t in texts]

        return score

    df = spark.createDataFrame([("a",), ("boom",), ("",), (None,)], "t string").coalesce(1)
    got = [r[0] for r in df.select(scorer_udf(load, "v2")("t").alias("x")).collect()]
    assert got == ["v2:a", '{"error": "boom"}', "{}", "{}"]


def test_batch_predictor(spark):
    from pyspark.sql.types import DoubleType

    def load():
        return lambda batch: batch.sum(axis=1)

    total = batch_predictor(load, 3, DoubleType())
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.5, 0.5, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(total("v").alias("x")).collect()] == [6.0, 1.0]


def test_large_csv_over_many_splits(spark):
    """Line breaks, quotes and carriage returns in cells, records across splits, several files; the rows of the whole-file reader."""
    from reviewlens.plans.session import scratch_path
    from reviewlens.sources import readers

    rng = random.Random(5)
    cells = [None, "plain", 'say "yes"', "two\nlines", "\n\n", '"', 'a,b', "tab\tend ", 'x"\ny"', "long " * 300, "r\r\nn"]
    rows = [(i, rng.choice(cells), rng.choice(cells)) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(2)
    path = scratch_path(spark, "large-csv")
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records = readers.csv_records(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        got = readers.read_large_csv(spark, path, "i int, a string, b string").collect()
        assert records.count() == len(rows) + 2  # two files with a header each
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    key = lambda r: (r[0], str(r[1]), str(r[2]))
    assert sorted(map(tuple, got), key=key) == sorted(rows, key=key)


def test_csv_with_byte_order_mark(spark):
    from reviewlens.plans.session import scratch_path
    from reviewlens.sources import writers

    path = scratch_path(spark, "bom")
    writers.write_csv_bom(spark.createDataFrame([(1, "đẹp, tốt"), (2, None)], "i int, t string").coalesce(1), path)
    content = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).first()["content"])
    assert content.startswith(b"\xef\xbb\xbfi,t\n") and content.decode("utf-8-sig") == 'i,t\n1,"đẹp, tốt"\n2,\n'
