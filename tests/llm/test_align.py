"""Alignment of two tokenizers against plain loops over their tokens."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from reviewlens.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Rows in the order of ``texts``, by the definition."""
    p = align.Pair(A, B)
    linked, parts = [], []
    for t in texts:
        ids = p.a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        pieces = p.b.encode(t) if t else []
        want = (" " + (t or "")).encode()
        if b"".join(p.bytes_a[i] for i in ids) != want or b"".join(p.bytes_b[i] for i in pieces) != want:
            ids = pieces = []
        groups, x, y, at = [], [], [], [0, 0]
        ends_b = iter(pieces)
        for i in ids:
            x.append(i)
            at[0] += len(p.bytes_a[i])
            while at[1] < at[0]:
                j = next(ends_b)
                y.append(j)
                at[1] += len(p.bytes_b[j])
            if at[0] == at[1]:
                groups.append((x, y))
                x, y = [], []
        parts.append((ids, pieces, groups))
        linked.append(Counter((i, j) for x, y in groups for i in x for j in y))
    count = Counter(k for c in linked for k in c)
    highest = defaultdict(int)
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    out = []
    for (ids, pieces, groups), links in zip(parts, linked):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for k, n in links.items() if count[k] == highest[k[0]])
        total = sum(n * count[k] for k, n in links.items())
        out.append((len(ids), len(pieces), len(groups), sum(links.values()), best, total, hashlib.sha256(written.encode()).hexdigest() if ids else ""))
    return out


def rows_of(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def test_whole_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    got = queries.op12_spill_counted_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted((str(r.doc_id), *x) for r, x in zip(docs, plain([r.text for r in docs])))


TEXTS = [(1, None), (2, ""), (3, " "), (4, "Hello, world <|endoftext|> </s> ok"), (4, "Hello, world <|endoftext|> </s> ok"), (None, "é😀漢字 \u0000 ​ x"), (None, None), (5, "  two  spaces\n\n\tand tab"), (6, "日本語のテキスト" * 400), (7, "x" * 9000), (8, "the the the of"), (9, "the"), (10, "�‍ é ﬁ ½")]


@pytest.mark.parametrize(("fan", "records"), [(64, 3_000_000), (2, 1)])
def test_edges_and_levels(spark, fan, records):
    """Nulls, odd characters, large groups, repeated rows, clashing columns; many chunks and levels of merging."""
    df = spark.createDataFrame([(d, t, 5, "x", 1) for d, t in TEXTS], "doc_id long, text string, chunk int, part string, n_a int").repartition(3)
    order = [(r.doc_id, r.text) for r in df.collect()]
    got = rows_of(align.align(df, A, B, fan=fan, records=records, characters=20 if records == 1 else align.TEXT))
    assert got == sorted((str(d), *x) for (d, _), x in zip(order, plain([t for _, t in order])))
    assert sum(r[1] > 0 for r in got) >= 8


def test_large_groups_count_alike(monkeypatch):
    """Combining distinct ids gives what writing out every link gives."""
    p = align.Pair(A, B)
    tokens = p.tokens(["日本語のテキスト zu dem" * 3, "x" * 500, "plain words"])
    one = p.links(tokens, 0)
    monkeypatch.setattr(align, "EXPANDED", 1)
    two = p.links(tokens, 0)
    total = Counter()
    for k, n in zip(two[-2].tolist(), two[-1].tolist()):
        total[k] += n
    assert Counter(one[-2].tolist()) == total and one[4] == two[4]


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    assert align.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()[0].n_links == 0


def test_remembered_pre_tokens_give_the_library_s_tokens(monkeypatch):
    """Texts put together from pre-tokens have the rows, keys and counts of texts that go to the libraries whole; each pre-token is learned once."""
    p = align.Pair(A, B)
    assert p.straddling == ["\r", "  ", "²."]
    texts = [t or "" for _, t in TEXTS] + ["It's 'sfoo 5'sbar l'rest d'accord, end.\nNext\n\n one²3 m².", "x ", " x", "a \n b\r\nc", "tab\tbed 1,234.5%", "word " * 50 + "y" * 70]
    docs = queries_texts()
    for some in (texts, docs):
        got, want = p.aligned(some, 7), p.links(p.tokens(some), 7)
        assert [list(x) for x in got[:5]] == [list(x) for x in want[:5]]
        totals = [Counter(), Counter()]
        for (*_, keys, often), total in zip((got, want), totals):
            for k, n in zip(keys.tolist(), often.tolist() if often is not None else [1] * len(keys)):
                total[k] += n
        assert totals[0] == totals[1]
    monkeypatch.setattr(p, "tokens", None)  # the corpus' texts need no call of the libraries any more
    assert not p.fresh and [list(x) for x in p.aligned(docs, 7)[:5]] == [list(x) for x in got[:5]]


def queries_texts():
    import pyarrow.parquet as pq

    return [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() if t]
