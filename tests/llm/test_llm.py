"""The operators of the llm folder against brute force, and their edge cases."""

import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import chat, decontaminate, jaccard, language, packing, pages, pii, queries, tokens, topk, urls

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "Hello, WORLD's end <|endoftext|> ok", "é" * 3000 + " x", "naïve Ünï 12½ don't", "a b c", "x" * 9000, "Hello, WORLD's end <|endoftext|> ok"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


def ids_of(text):
    return tokens.vocabulary(PATH, "test").encode(text or "")


def test_token_counts(docs, spark):
    got = {r.doc_id: r for r in tokens.count_tokens(docs, PATH, 5).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(ids_of(t)), len((t or "").encode()))
        assert got[i].over_limit == (got[i].n_tokens > 5)
    assert tokens.count_tokens(docs.limit(0), PATH, 5).count() == 0


def test_packing_round_trip(docs):
    rows = [r for r in packing.pack(docs, PATH, 2, 256, keep_ids=True).collect() if r.doc_id is not None]
    for i, t in enumerate(TEXTS):
        mine = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == i)
        want = b"".join(x.to_bytes(4, "little") for x in [*ids_of(t), 2])
        assert b"".join(x for _, x in mine) == want and mine[0][0] == 0
    everything = packing.pack(docs, PATH, 2, 256).collect()
    for _, group in itertools.groupby(sorted(everything, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(docs.limit(0), PATH, 2).count() == 0


def test_packing_pads_little(spark):
    rows = packing.pack(queries.table(spark, "/root/testdata/sf0.001", "documents"), PATH, 2).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    used = sum(r.n for r in rows)
    padded = sum(r.n if r.n & (r.n - 1) == 0 else 4096 for r in rows)
    assert padded < 1.01 * used


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "one two Three four five six seven eight nine ten eleven"), (2, "hello world"), (3, None), (4, "--")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "x ONE-two, three four five six seven eight nine ten y"), (2, "Say: hello   world! hello world"), (3, "helloworld"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(texts, items, with_spans=True, max_bytes=40).collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) for i in (1, 2, 3, 4)] == [(12, 10, 1, True), (5, 4, 1, True), (1, 0, 0, False), (0, 0, 0, False)]
    assert "Say: hello   world! hello world"[got[2].spans[0].start : got[2].spans[0].end] == "hello   world! hello world"
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_chat_fold_and_round_trip(spark):
    log = [(1, 1, 1, "user", "append", "hi "), (1, 2, 1, None, "append", "there"), (1, 3, 2, "assistant", "append", "bad"), (1, 4, 2, None, "regenerate", None), (1, 5, 2, None, "append", "<|im_end|> <\\|x"), (1, 6, 1, None, "edit", "hey"), (2, 1, 1, None, "append", None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, role string, kind string, text string")
    folded = chat.fold(events)
    assert {(r.conv_id, r.message): r.text for r in folded.collect()} == {(1, 1): "hey", (1, 2): "<|im_end|> <\\|x", (2, 1): ""}
    turns = chat.conversations(folded).select("conv_id", chat.turns_of(F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: [(t.role, t.text, t.trained) for t in r.t] for r in turns} == {1: [("user", "hey", False), ("assistant", "<|im_end|> <\\|x", True)], 2: [("", "", False)]}
    assert chat.digest(chat.conversations(chat.fold(events.limit(0)))).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    luhn = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in hit.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_pii_base_and_redaction(spark):
    texts = [None, "", "4111 1111 1111 1111 x +1 (234) 555-1234 10.0.0.1 1.2.3.4.5 999.1.1.1 a@b.c_d@e.f", "é😀 j.d@x.de, 4111111111111112", "1" * 3000, "a@b" + ".c" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(pii.find(df)).collect():
        want = [f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in re.finditer(PATTERNS[k], texts[r.doc_id] or "") if passes(k, m.group())]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
    spans = F.array(F.struct(F.lit(2).alias("at"), F.lit(4).alias("stop"), F.lit("a").alias("kind")), F.struct(F.lit(3).alias("at"), F.lit(5).alias("stop"), F.lit("b").alias("kind")))
    assert spark.createDataFrame([("0123456",)], "t string").select(pii.redacted(F.col("t"), spans)).first()[0] == "01[a]56"
    assert pii.report(pii.find(df.limit(0))).count() == 0


def brute_groups(texts, words=4, percent=85):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("heavy", [2, 256])
def test_near_groups(spark, heavy):
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(base[:k] + [f"z{i}"] + base[k + 1 :])) for i, k in enumerate([0, 1, 2, 10, 30, 58, 59])]
    texts += [(20 + i, " ".join([*base, *(f"y{j}" for j in range(i))])) for i in range(14)] + [(40, None), (41, ""), (42, "One two"), (43, "one TWO"), (44, "two one"), (45, " ".join(base))]
    got = jaccard.near_groups(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), heavy=heavy).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(texts)


def test_near_groups_of_nothing(spark):
    assert jaccard.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("texts", [["a b c"], ["one two"], ["one"], ["one two", "ONE two", "a b c d e f g h", "a b c d e f g h", "a b c d e f g x", None, " "]])
def test_near_groups_of_short_texts(spark, texts):
    rows = list(enumerate(texts))
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows), "doc_id")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows)


def test_shingles_of_a_short_rest():
    long = "w " * (jaccard.CHUNK // 2)
    assert [(i, len(s)) for i, s in jaccard.sets_of([long, "one two"])] == [(0, 1), (1, 1)]


WORDS = [f"w{i}" for i in range(60)]


@pytest.mark.parametrize("back", [False, True])
def test_near_groups_of_repeated_ids(spark, back):
    one, other, third = " ".join(WORDS), " ".join(reversed(WORDS)), " ".join(WORDS[::7] * 2)
    rows = [(9, one), (5, one), (5, other), (7, other), (7, other), (8, third), (8, None), (3, " "), (3, third + " x")]
    df = spark.createDataFrame(rows[::-1] if back else rows, "doc_id long, text string").repartition(3)
    got = jaccard.near_groups(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (3, 3), (5, 5), (5, 5), (7, 5), (7, 5), (8, 3), (8, 3), (9, 5)]


def test_stage_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline as c

    one, other = " ".join(WORDS), " ".join(reversed(WORDS))
    rows = [(5, one, "a"), (5, other, "b"), (4, one, "c"), (4, one.upper(), "c"), (4, one, "d"), (6, other, "e"), (2, "", "f"), (2, " ", "f"), (2, "", "f"), (None, one, "g"), (None, one, "g"), (5, "short", "h")]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [(r.doc_id, r.text, r.source) for r in c.keep_one_of_each_group(spark, df, None).collect()]
    want = [(4, one.upper(), "c"), (5, other, "b"), (5, "short", "h"), (2, "", "f"), (2, " ", "f"), (None, one, "g"), (None, one, "g")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stage_drops_copies_of_five_words_and_80(spark):
    import corpus_pipeline as c

    rows = []
    for n in range(90, 106):
        words = [f"n{n}w{i}" for i in range(n)]
        copy = [*words[:30], "x", *words[31:60], "y", *words[61:]]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))]
    # two words changed: 10 shingles of five words, so n - 14 of n + 6 are common
    want = {i for n in range(90, 106) for i in (2 * n, 2 * n + 1)[: 1 if 100 * (n - 14) >= 80 * (n + 6) else 2]}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [r.doc_id for r in c.keep_one_of_each_group(spark, df, None).collect()]
    assert sorted(got) == sorted(want) and 2 * 96 + 1 not in want and 2 * 93 + 1 in want


def test_language(spark):
    d = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = queries.QUERIES["op1_language_spans"](spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows)
    model = language.learn(d)
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (3, "日本語"), (4, "The and of " * 20 + "der und die nicht " * 20)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(odd, model, with_spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2)] == ["und", "und"] and got[3].score == 0 and {s.lang for s in got[4].spans} == {"en", "de"}
    assert language.identify(odd, language.learn(d.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 1.0]), (20, [1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 20, 4096), (20, 1, 0, 4096), (20, 2, 1, 4096), (20, 3, 2, 4096)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.NET/en/1?x"), (2, "https://example.com/de/2#t"), (3, None), (4, "no scheme"), (5, "x://s.org/fr/"), (6, "x://notexample.net"), (7, "x://b.example.net/zz")]
    rows += [(100 + i, f"x://bad.com/spam/{i}") for i in range(30)] + [(200 + i, f"x://bad.com/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}ok/{i}") for i in range(30)]
    labels = spark.createDataFrame([(100 + i, True) for i in range(20)] + [(200 + i, False) for i in range(30)], "page_id long, bad boolean")
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 4)] == [("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/2", "example.com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow")]
    assert [(got[i].rule, got[i].verdict) for i in (5, 6, 7)] == [("org/fr/", "allow"), (None, "allow"), ("net/", "block")]
    assert len(got) == len(rows)


@pytest.mark.parametrize("below", ["", "a/b/c/d/e/"])
def test_a_bad_branch_among_many(spark, below):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"x://bad.com/{below}spam/{i}") for i in range(30)] + [(200 + i, f"x://bad.com/{below}{letters[i % 26]}ok/{i}") for i in range(30)]
    rows += [(300, f"x://bad.com/{below}spam/1/more/x"), (301, f"x://bad.com/{below}new/1"), (302, "x://other.com/spam/1")]
    labels = spark.createDataFrame([(i, True) for i in range(20)] + [(200 + i, False) for i in range(30)], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, {}).collect()}
    assert {i for i, v in got.items() if v == "block"} == {*range(30), 300}


def test_pages(spark):
    page = '<body class="side"><nav>m</nav><div class="ad-box">buy</div><article><h1>A &amp; B</h1><p>one <b>two<br>three<p>four<form>f</form><script>"</p>"</script>tail</article><div id="comments"><article>c</article></div><footer>f</footer>'
    plain = "<body><div>Same notice</div><p>text {}</p></body>"
    rows = [(1, "x://h/1", page), (2, None, None), (3, "x://h/3", "")] + [(10 + i, "x://k/", plain.format(i)) for i in range(8)]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B\none two three\nfour\ntail" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text) == ("", "") and got[10].text == "text 0"  # the notice that every page repeats goes


@pytest.mark.parametrize("tag", ["aside", "footer", "nav"])
def test_a_teaser_does_not_claim_the_page(tag):
    html = f"<body><div><p>the body</p></div><{tag}><article><p>a teaser</p></article></{tag}></body>"
    assert pages.main_text(html, None) == "the body"
    both = f"<body><{tag}><article>a teaser</article></{tag}><form><article>the body</article></form><div>more</div></body>"
    assert pages.main_text(both, None) == "the body"


def test_a_teaser_in_a_branch_of_that_name():
    html = '<div class="sidebar"><article>teaser</article></div><div>the body of the page</div>'
    assert pages.main_text(html, None) == "the body of the page"
    layout = '<div class="with-sidebar layout"><article>the body of the page</article></div><div>small</div>'
    assert pages.main_text(layout, None) == "the body of the page"


def plain_style_tree(rows):
    """host -> unimportant paths, and the page texts, with plain loops."""
    import math

    nodes = {}
    for host, html in rows:
        blocks = pages.claimed(html)
        said = {}
        for e, t in blocks:
            said.setdefault(e.path, []).append(t)
        page = "\n".join(t for _, t in blocks)
        for path, texts in said.items():
            nodes.setdefault((host, path), set()).add(("\n".join(texts), len(texts), page))

    def entropy(values):
        n = len(values)
        counts = [values.count(v) for v in set(values)]
        return -sum(c / n * math.log(c / n) for c in counts) / math.log(n) if n > 1 else 1.0

    low = {k for k, v in nodes.items() if len(v) >= pages.LEAST_PAGES and pages.CONTENT_WEIGHT * entropy([x[0] for x in v]) + (1 - pages.CONTENT_WEIGHT) * entropy([x[1] for x in v]) < pages.LOW}
    return ["\n".join(t for e, t in pages.claimed(html) if (host, e.path) not in low) for host, html in rows], low


def test_style_tree_is_that_of_plain_loops(spark):
    """The whole table, and a host whose articles all end with one line: it goes, however often an article is copied."""
    table = queries.table(spark, "/root/testdata/sf0.01", "pages").select("url", "html")
    made = [("x://made/1", f'<article><p>story {i % 9}</p><div class="end">Read on tomorrow</div></article>') for i in range(40)]
    df = table.union(spark.createDataFrame(made, "url string, html string")).withColumn("page_id", F.monotonically_increasing_id())
    rows = df.withColumn("host", urls.split_url(F.col("url"))[0]).collect()
    want, low = plain_style_tree([(r.host, r.html or "") for r in rows])
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert [got[r.page_id] for r in rows] == want
    assert {"story 0", "story 8"} <= set(want) and any("end" in path for _, path in low)


def test_a_line_of_all_articles_goes_but_copies_stay(spark):
    same = [(i, "x://copies/", "<article><p>one and the same story</p></article>") for i in range(30)]
    got = {r.text for r in pages.extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()}
    assert got == {"one and the same story"}


def plain_templates(rows):
    """(host, shape) that the tree rejects; rows: host, shape, bad (None without label)."""
    shapes = {}
    for host, shape, bad in rows:
        c = shapes.setdefault((host, shape), [0, 0])
        if bad is not None:
            c[0] += 1
            c[1] += bool(bad)
    seg = {k: k[1].split("/")[1:] for k in shapes}
    below = dict.fromkeys(shapes, "")
    deepest = max((len(seg[k]) for k, c in shapes.items() if c[0]), default=0)
    seen, bad = sum(c[0] for c in shapes.values()), sum(c[1] for c in shapes.values())
    everywhere = bad / seen if seen else 0.0

    def add(table, key, c):
        t = table.setdefault(key, [0, 0])
        t[0] += c[0]
        t[1] += c[1]

    for level in reversed(range(deepest)):
        at = {k: (tuple(seg[k][:level]), seg[k][level] if level < len(seg[k]) else "") for k in shapes}
        own, pool = {}, {}
        for k, c in shapes.items():
            if c[0]:
                add(own, (k[0], *at[k], below[k]), c)
                add(pool, (k[0], at[k][0], below[k]), c)
        far = set()
        for (host, head, here, b), c in own.items():
            p = pool[host, head, b]
            share = p[1] / p[0]
            if 0 < p[1] < p[0] and abs(c[1] - c[0] * share) > urls.Z * (c[0] * share * (1 - share)) ** 0.5:
                far.add((host, head, here, b))
        below = {k: f"={at[k][1]}/{below[k]}" if (k[0], *at[k], below[k]) in far else "~/" + below[k] if below[k] else "" for k in shapes}
    nodes, hosts = {}, {}
    for k, c in shapes.items():
        add(nodes, (k[0], below[k]), c)
        add(hosts, k[0], c)
    w = urls.WEIGHT
    prior = {h: (c[1] + w * everywhere) / (c[0] + w) for h, c in hosts.items()}
    return {k for k in shapes for c in [nodes[k[0], below[k]]] if (c[1] + w * prior[k[0]]) / (c[0] + w) >= urls.PURITY}


@pytest.mark.parametrize("made", [False, True])
def test_templates_are_those_of_plain_loops(spark, made):
    if made:
        rows = [("h", "/".join(["", *parts]), bad) for i in range(400) for parts, bad in [((["a", "b", "c"][i % 3], "x" * (i % 4), ["new", "old"][i % 2], f"{{n}}{i % 5}")[: 1 + i % 4], None if i % 7 == 0 else (i % 3 == 0) ^ (i % 11 == 0))]]
        rows += [("deep", "/" * 1500 + "z", True), ("deep", "/" * 1500 + "y", False), ("", "", None)]
        df = spark.createDataFrame(rows, "host string, shape string, bad boolean")
    else:
        table = queries.table(spark, "/root/testdata/sf0.01", "pages")
        host, path = urls.split_url(F.col("url"))
        labels = urls.labels_of_pages(table, queries.table(spark, "/root/testdata/sf0.01", "labels"))
        df = table.select("page_id", host.alias("host"), urls.shape_of(path).alias("shape")).join(labels.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left").select("host", "shape", "bad")
    want = plain_templates([tuple(r) for r in df.collect()])
    assert {tuple(r) for r in urls.rejected(df).collect()} == want and (want or not made)


def test_chat_ties(spark):
    """Events of one sequence number: deltas, then edits (the last stays), then regenerations."""
    log = [(1, 5, 1, "user", "append", "X"), (1, 5, 1, None, "edit", "Y"), (2, 5, 1, None, "edit", "a"), (2, 5, 1, None, "edit", "b"), (2, 5, 1, None, "edit", "b"), (3, 5, 1, None, "append", "gone"), (3, 5, 1, None, "regenerate", None), (3, 6, 1, "u", "append", "new"), (3, 6, 1, "v", "append", "new")]
    log += [(4, None, 1, "user", "append", "first "), (4, 1, 1, None, None, "then"), (4, 1, 1, None, None, "then")]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, role string, kind string, text string")
    got = {r.conv_id: (r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {1: ("user", "Y"), 2: (None, "b"), 3: ("v", "newnew"), 4: ("user", "first thenthen")}


def test_benchmark_parts(spark, docs):
    """Many small parts give what one part gives; a worker builds an automaton once per part."""
    items = queries.table(spark, "/root/testdata/sf0.001", "benchmark")
    texts = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(docs.select("doc_id", "text"))
    one = decontaminate.decontaminate(texts, items, with_spans=True)
    few = decontaminate.decontaminate(texts, items, with_spans=True, max_bytes=20_000)
    assert sorted(one.collect(), key=str) == sorted(few.collect(), key=str) and one.filter("contaminated").count() > 0
    _, parts = decontaminate.windows_by_part(items.select(F.col("item_id").cast("string").alias("item"), "text"), 10, 20_000)
    assert parts > 2
    windows = spark.sparkContext.broadcast([(b" a ", "1"), (b" b c ", "2"), (b" a ", "3")])
    before = decontaminate.BUILT[0]
    assert decontaminate.automaton_of("k", windows) is decontaminate.automaton_of("k", windows) and decontaminate.BUILT[0] == before + 1
    nameless = spark.createDataFrame([(None, "one two"), (None, "three")], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame([(1, "One, two. three")], "doc_id long, text string"), nameless).collect()[0]
    assert (got.n_hit, got.n_items, got.items_sha256) == (3, 1, hashlib.sha256(b"null").hexdigest())


def test_pii_adds_what_the_base_patterns_miss(spark):
    """Obfuscated addresses and unformatted numbers behind words that announce them are added, numbers of orders and
    versions and broken cards are not."""
    import random

    rng = random.Random(3)

    def card():
        body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        return next(body + str(d) for d in range(10) if passes("card", body + str(d)))

    def number(n):
        return "".join(str(rng.randrange(1, 10)) for _ in range(n))

    corpus = []
    for i in range(300):
        corpus.append((i, f"words before u{i}@mail.example.com and 10.{i % 200}.3.4 or {card()} then +1 ({number(3)}) {number(3)}-{number(4)} order {number(11)} version {number(2)}.{number(2)}.{number(3)}"))
    hidden = [f"please contact: jo{i}(at)mail.example(dot)com today" for i in range(20)] + [f"host 10[.]1[.]{i}[.]7 is up" for i in range(20)]
    hidden += [f"my credit card {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} here" for c in (card() for _ in range(20))] + [f"call {number(10)} now" for _ in range(20)]
    clean = [f"order {number(11)} shipped" for _ in range(20)] + [f"version {number(3)}.{number(3)}.{number(4)} out" for _ in range(20)] + [f"invoice key {number(16)} paid" for _ in range(20)]
    rows = corpus + [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000 + i, t) for i, t in enumerate(clean)]
    out = {r.doc_id: r for r in pii.report(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    caught = sum(out[1000 + i].n_added > 0 for i in range(len(hidden)))
    wrong = sum(out[2000 + i].n_added > 0 for i in range(len(clean)))
    print("caught", caught, "of", len(hidden), "wrong", wrong, "of", len(clean))
    assert caught >= 0.9 * len(hidden) and wrong <= 0.05 * len(clean)
    for i in range(len(hidden)):  # base spans are what they were
        assert (out[1000 + i].n_email, out[1000 + i].n_ip) == (0, 0)


def plain_pipeline(rows, items, labels_kept, redacted, tokens_of):
    """doc_ids and texts after each stage."""
    docs = [r for r in rows if labels_kept(r)]
    groups = brute_groups([(r.doc_id, r.text) for r in docs], 5, 80)
    docs = [r for r in docs if groups[r.doc_id][1] == r.doc_id]
    windows = {tuple(w[i : i + 10]) for t in items for w in [words_of_item(t)] if w for i in range(max(1, len(w) - 9))}

    def dirty(t):
        w = words_of_item(t)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    docs = [r for r in docs if not dirty(r.text)]
    texts = {r.doc_id: redacted[r.doc_id] if r.doc_id in redacted else r.text for r in docs}
    return texts, {i: len(tokens_of(t)) + 1 for i, t in texts.items()}


def words_of_item(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_pipeline_runs_whole(spark):
    """run() on the smallest tables against plain loops: near copies by five words and 80, benchmark windows, base patterns and
    token counts; languages are those of the stage itself."""
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    kept = {r.doc_id for r in c.keep_known_languages(spark, docs, sf).collect()}
    rows = docs.collect()
    assert len(kept) > 0.95 * sum(bool(re.search(r"\w", r.text or "")) for r in rows)

    def redact(t):
        spans = sorted((m.start(), m.end(), k) for k in pii.KINDS for m in re.finditer(PATTERNS[k], t) if passes(k, m.group()))
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [t[at:a], f"[{k}]"]
                at = b
            else:
                at = max(at, b)
        return "".join(out) + t[at:]

    items = [r.text for r in queries.table(spark, sf, "benchmark").collect()]
    texts, tokens_of = plain_pipeline(rows, items, lambda r: r.doc_id in kept, {r.doc_id: redact(r.text) for r in rows if r.text}, ids_of)
    pieces = c.run(spark, sf).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == tokens_of
    assert sum(r.length for r in pieces) == sum(tokens_of.values())


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = docs
    for name, stage in c.STAGES[:-1]:
        before = {r.doc_id for r in kept.collect()}
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns, name
        after = {r.doc_id for r in kept.collect()}
        assert after <= before
        if name == "near_duplicates":
            assert after == {i for i, (n, root) in brute_groups([(i, rows[i].text) for i in before], 5, 80).items() if i == root}


def test_workers_stay_small(spark):
    """Arrow batches go by bytes, not by 10,000 rows of any length, and a step without vocabulary drops those of other steps."""
    import pyarrow as pa

    from reviewlens.llm import common, tokens

    df = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 400) AS text", "'en' AS lang")
    language.identify(df, language.Model([], np.zeros((language.BUCKETS, 0), np.float32), np.zeros((len(language.SCRIPTS) + 1, 0), bool)))
    sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").collect()
    assert sum(r.n for r in sizes) > 13_000_000 and max(r.n for r in sizes) < 5_000_000
    tokens.vocabulary(public_tokenizers.path(queries.VOCABULARY), "ids")
    assert list(common.lean(iter)([1])) == [1] and tokens.vocabulary.cache_info().currsize == 0
