"""The registered queries: beside their SQL, beside the libraries on a whole table, and on awkward tables."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from check import TABLES, rows_of
from reviewlens.llm import chat, language, packing, pages, pii, queries, runs, shards, tokens, topk, urls

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cur = db.execute(queries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_tokens_of_a_whole_table(spark):
    """Counts and packed ids are the library's."""
    sf = "/root/testdata/sf0.01"
    library = tokens.Vocabulary(PATH)
    ids = {r.doc_id: library.encode(r.text or "") for r in queries.table(spark, sf, "documents").collect()}
    counted = queries.op10_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in counted} == {i: (len(x), len(x) > 2048) for i, x in ids.items()}
    whole = {i: np.array([*x, queries.END_ID], "<u4") for i, x in ids.items()}
    pieces = queries.op5_harmonic_packing(spark, sf).collect()
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(whole[r.doc_id])
    assert sum(r.length for r in pieces) == sum(map(len, whole.values()))


def plain_path(scores, penalty):
    """The value of the best path, word by word."""
    best = scores[0].astype(float)
    for s in scores[1:]:
        best = np.maximum(best, best.max() - penalty) + s
    return best.max()


def test_language_paths_are_best(spark):
    """Viterbi of the operator against plain dynamic programming, on texts of mixed languages."""
    docs = queries.table(spark, SMALL, "documents")
    model = language.learn(docs)
    texts = [r.text[:600] for r in docs.filter("text IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    mixed = [a + "\n" + b + "\n" + a[:90] for a, b in zip(texts, texts[7:])] + ["", "12 34", "日本語 and der"]
    for held, ends, points in language.chunks_of(mixed):
        w = language.words_of(points)
        last = np.searchsorted(w.start, ends)
        first = np.concatenate(([0], last[:-1]))
        path = language.label(model, w, first, last)
        scores = np.add.reduceat(model.scores[w.buckets], w.first, axis=0)
        allowed = model.allowed[w.script]
        known = allowed.any(1, keepdims=True)
        scores = np.where(allowed, scores, np.where(known, language.BARRED, 0)).astype(float)
        for a, b in zip(first, last):
            if a < b:
                s, p = scores[a:b], path[a:b]
                mine = s[np.arange(b - a), p].sum() - language.PENALTY * (np.diff(p) != 0).sum()
                assert abs(mine - plain_path(s, language.PENALTY)) < 1e-3 * max(1.0, abs(mine))


def test_top_k_of_repeated_ids(spark):
    """Rows of one query id are one query with the best of all; as candidates each counts."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(1, 2, 5 * 4096), (2, 1, 3 * 4096), (3, 1, 2 * 4096)]


def test_top_k_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_SLICE", 40)
    monkeypatch.setattr(topk, "QUERIES_PER_GROUP", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect())
    e = np.floor(x.astype(float) * 64).astype(int)
    want = [(q, n + 1, *row) for q in range(0, 500, 20) for n, row in enumerate(sorted(((i, int(e[i] @ e[q])) for i in range(500) if i != q), key=lambda r: (-r[1], r[0]))[:5])]
    assert got == sorted(want)


# Operators on documents with columns that carry the names of their own results and helpers, a repeated row, a null id, a
# very long text, and nothing at all.
CLASH = {
    "language": lambda df: language.identify(df, language.learn(df)),
    "tokens": lambda df: tokens.count_tokens(df, PATH, 5),
    "packing": lambda df: packing.pack(df, PATH, 2, 64),
    "pii": lambda df: pii.report(pii.find(df)),
    "runs": lambda df: runs.find_runs(df),
    "shards": lambda df: shards.shard(df, 3),
}
NAMES = ["lang_pred", "score", "n_tokens", "row", "size", "shard", "slot", "item", "chunk", "spans", "n_email", "found_email", "base_ip", "known", "start", "length", "ids", "n_runs", "name"]


@pytest.mark.parametrize("name", sorted(CLASH))
def test_documents_with_clashing_columns(spark, name):
    texts = [(1, None), (2, ""), (3, "the and of to in"), (3, "the and of to in"), (None, "no id at all"), (4, "word " * 60_000), (5, "mail a@b.com, 10.0.0.1"), (6, "\u0000 ￿ 😀")]
    plain = spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(2)
    clash = plain
    for n in NAMES:
        clash = clash.withColumn(n, F.lit(7))
    drop = ["sequence_id", "offset", "slot"]  # these depend on how tasks are cut
    one, two = (CLASH[name](df).drop(*drop) for df in (plain, clash))
    assert one.columns == two.columns
    assert sorted(map(str, one.drop("shard").collect())) == sorted(map(str, two.drop("shard").collect()))
    assert one.count() >= len(texts)
    assert CLASH[name](clash.limit(0)).count() == 0


def test_pages_and_urls_with_clashing_columns(spark):
    rows = [(1, "x://h/a/1", "<p>one</p>"), (1, "x://h/a/1", "<p>one</p>"), (None, None, None), (2, "x://h/" + "a/" * 500, "<div>" * 3000 + "deep"), (3, "", "<p>" + "long " * 50_000)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = plain
    for n in ("host", "path", "paths", "shape", "bad", "rule", "text", "below", "here", "seen", "n_chars"):
        clash = clash.withColumn(n, F.lit("x"))
    labels = spark.createDataFrame([(1, True), (None, True), (1, False)], "page_id long, bad boolean")
    for op in (pages.extract, lambda df: urls.judge(df, labels)):
        assert sorted(map(str, op(plain).collect())) == sorted(map(str, op(clash).collect()))
        assert op(plain).count() == len(rows) and op(clash.limit(0)).count() == 0


def test_chat_with_clashing_columns(spark):
    rows = [(1, 0, "user", "x" * 200_000), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, "t")]
    plain = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    clash = plain.withColumns({n: F.lit(1) for n in ("seq", "message", "kind", "parts", "formatted", "turns")})
    one, two = (chat.digest(chat.conversations(chat.fold(chat.log_of(df)))) for df in (plain, clash))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert {r.conv_id: r.n_turns for r in one.collect()} == {1: 3, None: 1}


def test_pipeline_stages_on_awkward_documents(spark):
    """Each stage on nulls in every column, empty and very long texts, repeated rows, ties, extra columns with names of the
    stages' own, and on no rows: no row gets lost that the stage does not drop by its rule."""
    import corpus_pipeline as c

    long = " ".join(f"the{i % 977} and" for i in range(40_000))
    texts = [(1, None, None), (2, "", "en"), (3, "the and of to in that", "en"), (3, "the and of to in that", "en"), (None, "the and of it", None), (4, long, "en"), (4, "another text of that number", "en"), (5, "mail a@b.com or 10.0.0.1 and the end", "en"), (6, "12 34", "en")]
    odd = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    for n in ("row", "spans", "score", "number", "n", "root", "key", "contaminated", "start", "ids"):
        odd = odd.withColumn(n, F.lit(3))
    many = {"language": {"12 34", "", None}, "near_duplicates": set(), "benchmark": set(), "personal_data": set(), "packing": set()}
    for name, stage in c.STAGES:
        out = stage(spark, odd, SMALL)
        rows = out.collect()
        assert stage(spark, odd.limit(0), SMALL).count() == 0
        if name == "packing":
            assert {r.doc_id for r in rows} == {i for i, _, _ in texts}
            continue
        assert out.columns == list(c.COLUMNS)
        want = sorted(str((i, t)) for i, t, _ in texts if t not in many[name])
        if name == "near_duplicates":
            want.remove(str((3, "the and of to in that")))
        got = sorted(str((r.doc_id, r.text)) for r in rows)
        if name == "personal_data":
            want = [w.replace("a@b.com", "[email]").replace("10.0.0.1", "[ip]") for w in want]
        assert got == sorted(want), name
