"""Runs of words against the definition, tried with every period."""

import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlens.llm import queries, runs


def plain_runs(words, least, periods):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = p
        while i < len(words):
            if words[i] != words[i - p]:
                i += 1
                continue
            first = i
            while i < len(words) and words[i] == words[i - p]:
                i += 1
            if i - (first - p) >= 2 * p:
                found.setdefault((first - p, i - (first - p)), p)  # the smallest period comes first
    return sorted((s, n, p) for (s, n), p in found.items() if n >= max(least, periods * p))


some_words = st.lists(st.integers(0, 3), max_size=40).flatmap(lambda x: st.tuples(st.just(x), st.integers(0, 6), st.lists(st.integers(0, 3), max_size=10))).map(lambda t: t[0] + t[0][-7:] * t[1] + t[2])


@settings(max_examples=300, deadline=None)
@given(some_words, st.sampled_from([(2, 2), (6, 3), (24, 3), (9, 2)]))
def test_runs_of_any_words(ids, figures):
    least, periods = figures
    assert runs.runs_of(ids, least, periods) == plain_runs(ids, least, periods)
    words = [b"%d" % i for i in ids]
    texts = [words[:3], words, [b"x"] * 2, words]
    for w, spots in zip(texts, runs.stretches(texts, least, periods), strict=True):
        numbers = [int(x) if x != b"x" else 9 for x in w]
        by_stretch = {r for a, b in spots for r in runs.runs_of(numbers, least, periods, a, b)}
        assert sorted(by_stretch) == plain_runs(numbers, least, periods)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 24, 3)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in found)]
    lines = "".join("%d,%d,%d\n" % r for r in found)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_whole_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(tuple(r) for r in queries.op11_suffix_automaton_runs(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in docs.collect())
    assert any(r[1] for r in got)


def test_edges(spark):
    """Nulls, no words, other white space, ties, repeated rows, clashing columns, a long text, several texts a batch."""
    tied = "a b c d e f g h " * 3 + "x " + "i j k l m n o p " * 3
    texts = [(1, None), (2, ""), (3, " \n\x0b "), (4, "w " * 24), (5, "w " * 23), (5, "w " * 23), (61, tied), (61, tied), (None, "q r " * 30), (None, None), (7, "a b " * 12 + "\x85"), (8, "lo ng " * 50_000), (9, "x y " * 24)]
    df = spark.createDataFrame([(d, t, 1, [2], "n") for d, t in texts], "doc_id long, text string, n_runs int, runs array<int>, name string").repartition(2)
    rows = runs.find_runs(df, planted=True).collect()
    short = [(d, t) for d, t in texts if len(t or "") < 1000]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:8] for r in rows if r.doc_id != 8), key=key) == sorted((expected(d, t) for d, t in short), key=key)
    long = next(r for r in rows if r.doc_id == 8)
    assert [tuple(x) for x in long.runs] == [(0, 100_000, 2)] and long.collapsed == "lo ng"
    first = next(r for r in rows if r.doc_id == 61)
    assert (first.n_runs, first.start, first.period) == (2, 0, 8)


def test_empty_table(spark):
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
