"""Label codecs, rule engines and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import labels as L
from reviewlens.functions import payloads as P
from reviewlens.functions.labels import ASPECTS
from reviewlens.operators import relate, rules, validate
from reviewlens.operators import lexicon as lx
from reviewlens.operators.lexicon import AspectWords, Lexicon
from reviewlens.plans.q_text import counted, strip, typo_sql
from reviewlens.plans.registry import query
from reviewlens.plans.views import (
    CELLS_SQL,
    LABELLED_WIDE,
    REVIEWS,
    SCORED,
    Tables,
    sql_list,
    sql_text,
)

# ------------------------------------------------------------------------- codecs

INT_OF = "CASE WHEN isfinite(try_cast({x} AS DOUBLE)) THEN CAST(trunc(try_cast({x} AS DOUBLE)) AS BIGINT) END"

MULTIPOLARITY = f"""WITH {CELLS_SQL},
a AS (SELECT review_id, {strip("replace(replace(coalesce(cell, '2'), '[', ''), ']', '')")} AS x FROM cells),
b AS (SELECT review_id, x, x IN ('2', 'nan', '') AS absent, contains(x, ',') AS many,
       list_transform(string_split(x, ','), lambda s: trim(s)) AS parts, {INT_OF.format(x='x')} AS v FROM a),
c AS (SELECT *, len(list_filter(parts, lambda s: NOT regexp_full_match(s, '[+-]?[0-9]+'))) = 0 AS ints FROM b)
SELECT review_id, CASE WHEN absent THEN 0 ELSE 1 END AS mention,
  CASE WHEN absent THEN 0 WHEN many THEN CAST(ints AND list_contains(parts, '-1') AS INTEGER) ELSE CAST(coalesce(v = -1, false) AS INTEGER) END AS neg,
  CASE WHEN absent THEN 0 WHEN many THEN CAST(ints AND list_contains(parts, '1') AS INTEGER) ELSE CAST(coalesce(v = 1, false) AS INTEGER) END AS pos,
  CASE WHEN absent THEN 0 WHEN many THEN CAST(NOT ints OR list_contains(parts, '0') AS INTEGER) ELSE CAST(NOT coalesce(v IN (-1, 1), false) AS INTEGER) END AS neu
FROM c"""


@query("parse_multipolarity", MULTIPOLARITY)
def parse_multipolarity(t):
    return t.cells().select("review_id", L.parse_multipolarity("cell").alias("m")).select("review_id", "m.*")


@query(
    "parse_legacy",
    f"WITH {CELLS_SQL}, v AS (SELECT review_id, coalesce({INT_OF.format(x='trim(cell)')}, -1) AS s FROM cells) "
    "SELECT review_id, CAST(s <> -1 AS INTEGER) AS mention, CASE WHEN s = -1 THEN 0 ELSE s END AS sentiment FROM v",
)
def parse_legacy(t):
    return t.cells().select("review_id", L.parse_legacy("cell").alias("m")).select("review_id", "m.*")


@query(
    "label_to_class",
    f"WITH {CELLS_SQL}, v AS (SELECT review_id, {INT_OF.format(x='trim(cell)')} AS s FROM cells) "
    "SELECT review_id, CASE s WHEN -1 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS class FROM v",
)
def label_to_class(t):
    return t.cells().select("review_id", L.label_to_class("cell").alias("class"))


@query(
    "decode_label",
    f"WITH {CELLS_SQL}, v AS (SELECT review_id, cell, {INT_OF.format(x='trim(cell)')} AS s FROM cells) SELECT review_id, "
    "CASE s WHEN 1 THEN 'POS' WHEN 0 THEN 'NEU' WHEN -1 THEN 'NEG' WHEN 2 THEN 'NOT_MENTIONED' ELSE 'UNKNOWN' END AS word, "
    "CASE s WHEN 1 THEN 'POSITIVE' WHEN 0 THEN 'NEUTRAL' WHEN -1 THEN 'NEGATIVE' WHEN 2 THEN 'N/A' ELSE cell END AS name FROM v",
)
def decode_label(t):
    return t.cells().select(
        "review_id",
        L.decode_label("cell").alias("word"),
        L.decode_label("cell", L.LABEL_NAME, F.col("cell")).alias("name"),
    )


UNPIVOTED = " UNION ALL ".join(
    f"SELECT review_id, {sql_text(a)} AS aspect, coalesce(\"{a}\", '2') AS label FROM labelled_wide" for a in ASPECTS
)


@query("aspects_long", f"WITH {LABELLED_WIDE} {UNPIVOTED}")
def aspects_long(t):
    return L.to_long(t.labelled_wide().na.fill("2", ASPECTS), ["review_id"], ASPECTS)


SENTIMENT_MAP = f"""{SCORED}, maps AS (
  SELECT review_id, aspect AS a, truth AS v, aspect || '_pred' AS b, pred AS w FROM scored)"""


def sentiment_maps(t: Tables):
    return t.scored().select(
        "review_id", F.create_map("aspect", "truth", F.concat("aspect", F.lit("_pred")), "pred").alias("labels")
    )


@query(
    "encode_sentiment",
    f"""WITH {SENTIMENT_MAP} SELECT review_id, '{{' || array_to_string(list_filter([
  CASE WHEN v <> 2 THEN '"' || a || '":' || CAST(v AS VARCHAR) END,
  CASE WHEN w <> 2 THEN '"' || b || '":' || CAST(w AS VARCHAR) END], lambda x: x IS NOT NULL), ',') || '}}' AS json FROM maps""",
)
def encode_sentiment(t):
    return sentiment_maps(t).select("review_id", L.encode_sentiment("labels").alias("json"))


@query(
    "decode_sentiment",
    f"WITH {SENTIMENT_MAP} SELECT review_id, a AS aspect, v AS label FROM maps WHERE v <> 2 UNION ALL SELECT review_id, b, w FROM maps WHERE w <> 2",
)
def decode_sentiment(t):
    encoded = sentiment_maps(t).select("review_id", L.encode_sentiment("labels").alias("json"))
    return encoded.select("review_id", F.explode(L.decode_sentiment("json")).alias("aspect", "label"))


@query(
    "argmax_matrix",
    """WITH m AS (SELECT vec_id, unnest(range(16)) AS i, embedding AS e FROM embeddings),
r AS (SELECT vec_id, i, list_transform(e[i * 4 + 1:i * 4 + 4], lambda x: round(CAST(x AS DOUBLE), 4)) AS v FROM m)
SELECT vec_id, string_agg(CAST(list_position(v, list_max(v)) - 1 AS VARCHAR), ',' ORDER BY i) AS classes FROM r GROUP BY vec_id""",
)
def argmax_matrix(t):
    """All 64 numbers as sixteen rows of four, through JSON and back."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    matrix = F.array(*[F.slice(e, i * 4 + 1, 4) for i in range(16)])
    encoded = t.embeddings.select("vec_id", L.encode_matrix(matrix).alias("json"))
    return encoded.select("vec_id", F.array_join(L.argmax_matrix("json", 16), ",").alias("classes"))


# All 64 numbers of a vector: one mention and three sentiments for each of sixteen aspects.
SIXTEEN = [*ASPECTS, *(f"Khía cạnh {i}" for i in range(10, 17))]


def logits(t: Tables):
    e = F.transform("embedding", lambda x: x.cast("double") * 10)
    return t.embeddings.select("vec_id", F.slice(e, 1, 16).alias("m"), F.slice(e, 17, 48).alias("s"))


LOGITS = f"""lg AS (SELECT vec_id, i, {sql_list(SIXTEEN)}[i + 1] AS aspect,
  1.0 / (1.0 + exp(-(CAST(embedding[i + 1] AS DOUBLE) * 10))) AS pm,
  list_transform(embedding[17 + 3 * i:19 + 3 * i], lambda x: CAST(x AS DOUBLE) * 10) AS s
  FROM (SELECT vec_id, embedding, unnest(range(16)) AS i FROM embeddings))"""


@query(
    "logits_to_labels",
    f"""WITH {LOGITS} SELECT vec_id, aspect, CASE WHEN pm <= 0.5 THEN '2'
  ELSE ['-1', '1', '0'][list_position(s, list_max(s))] END AS label FROM lg""",
)
def logits_to_labels(t):
    labels = L.logits_to_labels("m", "s", SIXTEEN)
    return logits(t).select("vec_id", F.explode(labels).alias("r")).select("vec_id", "r.*")


@query(
    "logits_to_multi_labels",
    f"""WITH {LOGITS}, h AS (SELECT vec_id, aspect, pm, list_filter([
    CASE WHEN 1.0 / (1.0 + exp(-s[1])) > 0.6 THEN '-1' END, CASE WHEN 1.0 / (1.0 + exp(-s[3])) > 0.6 THEN '0' END,
    CASE WHEN 1.0 / (1.0 + exp(-s[2])) > 0.6 THEN '1' END], lambda x: x IS NOT NULL) AS hits FROM lg)
SELECT vec_id, aspect, CASE WHEN pm <= 0.6 THEN '2' WHEN len(hits) = 0 THEN '0' WHEN len(hits) = 1 THEN hits[1]
  ELSE '[' || array_to_string(hits, ',') || ']' END AS label FROM h""",
)
def logits_to_multi_labels(t):
    labels = L.logits_to_labels("m", "s", SIXTEEN, threshold=0.6, multi=True)
    return logits(t).select("vec_id", F.explode(labels).alias("r")).select("vec_id", "r.*")


# -------------------------------------------------------------------- model replies

REPLIES = [
    '{"Chất lượng sản phẩm": 1, "Vận chuyển": "-1", "Đóng gói": "[-1,1]"}',
    'Kết quả:\n{"Chất lượng sản phẩm": -1,\n "Đúng mô tả": 0} xong',
    "không rõ",
    "",
    None,
    '{"Tính xác thực": 2}',
    "{bad json}",
]
REPLY_SQL = f"{sql_list(REPLIES)}[(rating + review_id) % {len(REPLIES)} + 1]"


def with_reply(df):
    choices = F.array(*[F.lit(r) for r in REPLIES])
    return df.withColumn("reply", F.element_at(choices, ((F.col("rating") + F.col("review_id")) % len(REPLIES) + 1).cast("int")))


# what each reply says, worked out by hand: aspect -> label
READ = {
    0: {"Chất lượng sản phẩm": "1", "Vận chuyển": "-1", "Đóng gói": "[-1,1]"},
    1: {"Chất lượng sản phẩm": "-1", "Đúng mô tả": "0"},
    5: {"Tính xác thực": "2"},
}


def reply_case(aspect: str, otherwise: str) -> str:
    which = f"(rating + review_id) % {len(REPLIES)}"
    whens = " ".join(f"WHEN {which} = {i} THEN {sql_text(m.get(aspect, '2'))}" for i, m in READ.items())
    return f"CASE {whens} ELSE {otherwise} END"


@query(
    "parse_reply",
    f"WITH {REVIEWS} " + " UNION ALL ".join(
        f"SELECT review_id, {sql_text(a)} AS aspect, {reply_case(a, 'NULL')} AS label FROM reviews "
        f"WHERE (rating + review_id) % {len(REPLIES)} IN ({', '.join(map(str, READ))})"
        for a in ASPECTS
    ),
)
def parse_reply(t):
    parsed = with_reply(t.reviews()).select("review_id", P.reply_labels("reply", ASPECTS).alias("m"))
    return parsed.select("review_id", F.explode("m").alias("aspect", "label"))


# ----------------------------------------------------------------------- rule engines


def wide(df):
    return df.select("review_id", *ASPECTS)


@query(
    "doc_polarity",
    f"""WITH {REVIEWS}, c AS (SELECT product_id, {counted("lower(coalesce(content, ''))", lx.DOC_POSITIVE)} AS p,
  {counted("lower(coalesce(content, ''))", lx.DOC_NEGATIVE)} AS n FROM reviews WHERE content IS NOT NULL AND content <> '')
SELECT product_id, CASE WHEN p > n THEN 'POSITIVE' WHEN n > p THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS polarity, count(*) AS n
FROM c GROUP BY ALL""",
)
def doc_polarity(t):
    scored = t.reviews().where("content IS NOT NULL AND content <> ''").select("product_id", rules.doc_polarity("content").alias("polarity"))
    return scored.groupBy("product_id", "polarity").agg(F.count("*").alias("n"))


def low_sql(value: str = "content") -> str:
    return f"lower(coalesce({value}, ''))"


def any_of(value: str, keywords) -> str:
    return f"(len(list_filter({sql_list(keywords)}, lambda k: contains({value}, k))) > 0)"


def rating_sql() -> str:
    prior = "CASE WHEN rating <= 2 THEN '-1' WHEN rating = 3 THEN '0' ELSE '1' END"
    out = []
    for a in ASPECTS:
        w = lx.RATING.aspects.get(a)
        if w is None:
            out.append(f'{prior} AS "{a}"')
        else:
            lead = f"({counted('x', w.positive)} - {counted('x', w.negative)})"
            out.append(f"CASE WHEN {lead} > 0 THEN '1' WHEN {lead} < 0 THEN '-1' ELSE {prior} END AS \"{a}\"")
    return f"WITH {REVIEWS}, l AS (SELECT *, {low_sql()} AS x FROM reviews) SELECT review_id, {', '.join(out)} FROM l"


@query("rating_keyword_label", rating_sql())
def rating_keyword_label(t):
    return wide(rules.rating_keyword_label(t.reviews(), "content", "rating"))


def simple_labels(value: str, lexicon: Lexicon) -> dict[str, str]:
    out = {}
    first = next(iter(lexicon.aspects))
    for a, w in lexicon.aspects.items():
        p, n = any_of(value, w.positive), any_of(value, w.negative)
        general = ""
        if a == first:
            general = f" WHEN {any_of(value, lexicon.positive)} THEN '1' WHEN {any_of(value, lexicon.negative)} THEN '-1'"
        out[a] = f"CASE WHEN {p} AND {n} THEN '[-1,1]' WHEN {p} THEN '1' WHEN {n} THEN '-1'{general} ELSE '2' END"
    return out


def columns(labels: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{a}"' for a, e in labels.items())


SIMPLE_LABELLED = f"""{REVIEWS}, l AS (SELECT *, {low_sql()} AS x FROM reviews),
labelled AS (SELECT review_id, product_id, rating, content, {columns(simple_labels('x', lx.SIMPLE))} FROM l)"""


@query("rules_simple", f"WITH {SIMPLE_LABELLED} SELECT review_id, {', '.join(chr(34) + a + chr(34) for a in ASPECTS)} FROM labelled")
def rules_simple(t):
    return wide(rules.rules_simple(t.reviews(), "content"))


def gated_labels(value: str) -> dict[str, str]:
    out = {}
    for a, w in lx.GATED.aspects.items():
        p, n = counted(value, w.positive), counted(value, w.negative)
        out[a] = (
            f"CASE WHEN NOT {any_of(value, w.nouns)} THEN '2' WHEN {p} > 0 AND {n} > 0 THEN '[-1,1]' "
            f"WHEN {p} > {n} THEN '1' WHEN {n} > {p} THEN '-1' ELSE '0' END"
        )
    return out


@query("rules_mention_gated", f"WITH {REVIEWS}, l AS (SELECT *, {low_sql()} AS x FROM reviews) SELECT review_id, {columns(gated_labels('x'))} FROM l")
def rules_mention_gated(t):
    return wide(rules.rules_mention_gated(t.reviews(), "content"))


# Lexicons of the context engines are parameters; this one takes the mention-gated words of all nine aspects and
# adds syllables of the corpus, so that long texts exercise the windows too.
SYLLABLES = {
    "Chất lượng sản phẩm": (("thle", "quar"), ("rhea",), ("whou",)),
    "Vận chuyển": (("erand", "ionen"), ("bleed",), ("ndnd",)),
    "Đóng gói": (("ouver",), ("stst",), ("menté",)),
    "Dịch vụ & Thái độ Shop": (("geit",), ("cióna",), ("ichau",)),
}


def context_lexicon(contrast: list[str]) -> Lexicon:
    aspects = {}
    for a, w in lx.GATED.aspects.items():
        nouns, positive, negative = SYLLABLES.get(a, ((), (), ()))
        aspects[a] = AspectWords(nouns=w.nouns + nouns, positive=w.positive + positive, negative=w.negative + negative)
    return Lexicon(
        aspects=aspects,
        positive=(*lx.SIMPLE.positive, "nhanh", "rhea", "erre"),
        negative=(*lx.SIMPLE.negative, "kém", "chậm", "mỏng", "whou", "ndnd"),
        neutral=("tạm", "bình thường", "cũng được", "oron"),
        contrast=(*contrast, "with"),
    )


CONTEXT = context_lexicon(lx.CONTEXT_V1_CONTRAST)
CONTEXT_V2 = context_lexicon(lx.CONTEXT_V2_CONTRAST)
CONTEXT_ASPECTS = list(CONTEXT.aspects)


def context_v1_sql() -> str:
    windows, labels = [], {}
    for i, (a, w) in enumerate(CONTEXT.aspects.items()):
        hits = f"list_filter({sql_list(w.nouns)}, lambda k: contains(x, k))"
        around = (
            f"list_transform({hits}, lambda k: substr(x, greatest(instr(x, k) - 1 - 50, 0) + 1, "
            "instr(x, k) - 1 + length(k) + 50 - greatest(instr(x, k) - 1 - 50, 0)))"
        )
        windows.append(f"{around} AS w{i}")

        def total(keywords, i=i):
            per_window = f"len(list_filter({sql_list(keywords)}, lambda k: contains(c, k)))"
            return f"coalesce(list_sum(list_transform(w{i}, lambda c: {per_window})), 0)"

        p, n, u = total(CONTEXT.positive), total(CONTEXT.negative), total(CONTEXT.neutral)
        labels[a] = (
            f"CASE WHEN len(w{i}) = 0 THEN '2' WHEN {p} > 0 AND {n} > 0 THEN '[-1,1]' "
            f"WHEN {p} > 0 AND {u} > 0 AND {n} = 0 THEN CASE WHEN turn THEN '[0,1]' ELSE '1' END "
            f"WHEN {n} > 0 AND {u} > 0 AND {p} = 0 THEN CASE WHEN turn THEN '[-1,0]' ELSE '-1' END "
            f"WHEN {p} > {n} THEN '1' WHEN {n} > {p} THEN '-1' ELSE '0' END"
        )
    first = CONTEXT_ASPECTS[0]
    all_open = " AND ".join(f"\"{a}\" = '2'" for a in CONTEXT_ASPECTS)
    p, n = any_of("x", CONTEXT.positive), any_of("x", CONTEXT.negative)
    rest = ", ".join(f'"{a}"' for a in CONTEXT_ASPECTS[1:])
    return f"""WITH {REVIEWS}, l AS (SELECT review_id, coalesce(content, '') AS content, {low_sql()} AS x FROM reviews),
w AS (SELECT review_id, content, x, {any_of('x', CONTEXT.contrast)} AS turn, {', '.join(windows)} FROM l),
d AS (SELECT review_id, content, x, {columns(labels)} FROM w)
SELECT review_id, CASE WHEN {all_open} AND length(content) < 100 AND ({p} OR {n})
  THEN CASE WHEN {p} AND {n} THEN '[-1,1]' WHEN {p} THEN '1' ELSE '-1' END ELSE "{first}" END AS "{first}", {rest} FROM d"""


@query("rules_context_v1", context_v1_sql())
def rules_context_v1(t):
    return rules.rules_context_v1(t.reviews(), "content", CONTEXT).select("review_id", *CONTEXT_ASPECTS)


def context_v2_sql() -> str:
    """The engine as first described: every window's sentiment, then the decision table."""
    mentions, sentiments, labels = [], [], {}
    for i, (a, w) in enumerate(CONTEXT_V2.aspects.items()):
        # positions from the lengths of the pieces between hits; no noun overlaps itself
        at = (
            f"list_transform(range(1, len(string_split(x, k))), lambda i: "
            "CAST(list_sum(list_transform(string_split(x, k)[1:i], lambda s: length(s))) + (i - 1) * length(k) AS BIGINT))"
        )
        found = f"flatten(list_transform(list_filter({sql_list(w.nouns)}, lambda k: contains(x, k)), lambda k: {at}))"
        p, n = any_of("x", w.positive), any_of("x", w.negative)
        mentions.append(f"CASE WHEN len({found}) > 0 THEN {found} WHEN {p} OR {n} THEN [CAST(0 AS BIGINT)] ELSE [] END AS m{i}")
        window = "substr(x, greatest(q - 60, 0) + 1, q + 60 - greatest(q - 60, 0))"
        cp, cn, ct = any_of("c", w.positive), any_of("c", w.negative), any_of("c", CONTEXT_V2.contrast)
        verdict = (
            f"CASE WHEN {cp} AND {cn} THEN 'mixed' WHEN {ct} AND ({cp} OR {cn}) THEN 'mixed' "
            f"WHEN {cp} THEN 'positive' WHEN {cn} THEN 'negative' ELSE 'neutral' END"
        )
        sentiments.append(f"list_distinct(list_transform(list_transform(m{i}, lambda q: {window}), lambda c: {verdict})) AS s{i}")
        has_p = f"(list_contains(s{i}, 'positive') OR {p})"
        has_n = f"(list_contains(s{i}, 'negative') OR {n})"
        labels[a] = (
            f"CASE WHEN len(m{i}) = 0 THEN '2' WHEN list_contains(s{i}, 'mixed') OR ({has_p} AND {has_n}) THEN '[-1,1]' "
            f"WHEN {has_p} THEN '1' WHEN {has_n} THEN '-1' ELSE '0' END"
        )
    first = CONTEXT_ASPECTS[0]
    all_open = " AND ".join(f"\"{a}\" = '2'" for a in CONTEXT_ASPECTS)
    guess = f"CASE WHEN {any_of('lower(raw)', lx.SHORT_POSITIVE)} THEN '1' WHEN {any_of('lower(raw)', lx.SHORT_NEGATIVE)} THEN '-1' ELSE \"{first}\" END"
    rest = ", ".join(f'"{a}"' for a in CONTEXT_ASPECTS[1:])
    return f"""WITH {REVIEWS}, l AS (SELECT review_id, coalesce(content, '') AS raw, {typo_sql("coalesce(content, '')")} AS x FROM reviews),
m AS (SELECT review_id, raw, x, {', '.join(mentions)} FROM l),
s AS (SELECT *, {', '.join(sentiments)} FROM m),
d AS (SELECT review_id, raw, {columns(labels)} FROM s)
SELECT review_id, CASE WHEN {all_open} AND length({strip('raw')}) < 15 THEN {guess} ELSE "{first}" END AS "{first}", {rest} FROM d"""


@query("rules_context_v2", context_v2_sql())
def rules_context_v2(t):
    return rules.rules_context_v2(t.reviews(), "content", CONTEXT_V2).select("review_id", *CONTEXT_ASPECTS)


def cascade_sql() -> str:
    out = [
        f"CASE WHEN {strip(chr(99) + 'ontent')} = '' OR content IS NULL THEN '2' ELSE {reply_case(a, chr(34) + a + chr(34))} END AS \"{a}\""
        for a in ASPECTS
    ]
    return f"WITH {SIMPLE_LABELLED} SELECT review_id, {', '.join(out)} FROM labelled"


@query("label_cascade", cascade_sql())
def label_cascade(t):
    return wide(rules.label_cascade(with_reply(t.reviews()), "content", "reply"))


LIMIT = 500
IN_LIMIT = f"review_id IN (SELECT review_id FROM labelled ORDER BY review_id LIMIT {LIMIT})"
LIMITED = ", ".join(f"CASE WHEN {IN_LIMIT} THEN \"{a}\" ELSE '2' END AS \"{a}\"" for a in ASPECTS)


@query("label_with_limit", f"WITH {SIMPLE_LABELLED} SELECT review_id, {LIMITED} FROM labelled")
def label_with_limit(t):
    """Every row comes out; the first 500 in order are labelled."""
    return wide(rules.label_with_limit(t.reviews(), "content", "review_id", LIMIT))


@query(
    "label_head",
    f"WITH {SIMPLE_LABELLED} SELECT review_id, {', '.join(chr(34) + a + chr(34) for a in ASPECTS)} FROM labelled ORDER BY review_id LIMIT {LIMIT}",
)
def label_head(t):
    """The head-limit form of the labeller: the limit is the feature."""
    return wide(rules.label_with_limit(t.reviews(), "content", "review_id", LIMIT, keep_rest=False))


LEXICON_VALUES = ", ".join(f"({sql_text(a)}, {sql_text(r)}, {sql_text(k)})" for a, r, k in CONTEXT.rows())


def lexicon_table(t: Tables, rows=None):
    return t.spark.createDataFrame(rows or CONTEXT.rows(), "aspect string, role string, keyword string")


LEXICON_JOIN = f"""WITH {REVIEWS}, lex(aspect, role, keyword) AS (VALUES {LEXICON_VALUES})
SELECT review_id, aspect, role, keyword FROM reviews JOIN lex ON contains({low_sql()}, keyword)"""


@query("lexicon_join", LEXICON_JOIN)
def lexicon_join(t):
    return relate.lexicon_join(t.reviews(), "content", ["review_id"], lexicon_table(t))


BENCHMARK_WORDS = """words AS (SELECT CAST(item_id AS VARCHAR) AS aspect, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS keyword FROM benchmark),
lex AS (SELECT aspect, 'word' AS role, keyword FROM words UNION ALL SELECT aspect, 'ending', right(keyword, 2) FROM words UNION ALL SELECT aspect, 'letter', left(keyword, 1) FROM words
  UNION ALL SELECT 'all', 'empty', '')"""


@query(
    "lexicon_join_large",
    f"""WITH {REVIEWS}, {BENCHMARK_WORDS},
k AS MATERIALIZED (SELECT keyword, count(*) AS n, count(*) FILTER (role = 'word') AS words FROM lex GROUP BY keyword)
SELECT review_id, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(words) AS BIGINT) AS words, CAST(sum(n * length(keyword)) AS BIGINT) AS letters
FROM reviews JOIN k ON contains({low_sql()}, keyword) GROUP BY review_id""",
)
def lexicon_join_large(t):
    """All words of the benchmark items, the last two letters and the first letter of each, and an empty
    keyword: thousands of entries, many of them repeated, found through the gram index and counted per review."""
    words = t.benchmark.select(F.col("item_id").cast("string").alias("aspect"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    kinds = {"word": F.col("w"), "ending": F.right("w", F.lit(2)), "letter": F.left("w", F.lit(1))}
    entries = t.spark.createDataFrame([("all", "empty", "")], "aspect string, role string, keyword string")
    for role, keyword in kinds.items():
        entries = entries.unionByName(words.select("aspect", F.lit(role).alias("role"), keyword.alias("keyword")))
    each = entries.groupBy("keyword").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "word").alias("n_words"))
    found = relate.lexicon_join(t.reviews(), "content", ["review_id"], each, ["n", "n_words"])
    return found.groupBy("review_id").agg(F.sum("n").alias("entries"), F.sum("n_words").alias("words"), F.sum(F.col("n") * F.length("keyword")).alias("letters"))


# -------------------------------------------------------------------------- validation


def keyword_issue_sql() -> str:
    parts = []
    for a, w in lx.VALIDATION.aspects.items():
        v = INT_OF.format(x=f'"{a}"')
        decoded = f"CASE {v} WHEN 1 THEN 'POS' WHEN 0 THEN 'NEU' WHEN -1 THEN 'NEG' WHEN 2 THEN 'NOT_MENTIONED' ELSE 'UNKNOWN' END"
        for keywords, test, severity, expected in (
            (w.negative, "> 0", "high", "NEG"),
            (w.positive, "< 0", "medium", "POS"),
        ):
            parts.append(
                f"SELECT file, review_id, 'keyword_mismatch' AS type, '{severity}' AS severity, {sql_text(a)} AS aspect, "
                f"CAST(NULL AS VARCHAR) AS aspects, k AS keyword, '{expected}' AS expected, {decoded} AS actual, "
                f"substr(coalesce(content, ''), 1, 100) AS review, CAST(NULL AS VARCHAR) AS suggestion "
                f"FROM labelled_wide, (SELECT unnest({sql_list(keywords)}) AS k) "
                f"WHERE contains({low_sql()}, k) AND NOT contains(coalesce(\"{a}\", ''), '[') AND {v} {test}"
            )
    return " UNION ALL ".join(parts)


MENTIONED = "list_filter([" + ", ".join(
    f"CASE WHEN coalesce(try_cast(\"{a}\" AS DOUBLE) <> 2, true) THEN {sql_text(a)} END" for a in ASPECTS
) + "], lambda a: a IS NOT NULL)"
ANY_MIXED = " OR ".join(f"contains(coalesce(\"{a}\", ''), '[')" for a in ASPECTS)
CONTRAST_ISSUES = f"""SELECT file, review_id, 'missing_multi_polarity' AS type, 'medium' AS severity, CAST(NULL AS VARCHAR) AS aspect,
  array_to_string({MENTIONED}, '|') AS aspects, CAST(NULL AS VARCHAR) AS keyword, CAST(NULL AS VARCHAR) AS expected,
  CAST(NULL AS VARCHAR) AS actual, substr(coalesce(content, ''), 1, 150) AS review, {sql_text(validate.SUGGESTION)} AS suggestion
FROM labelled_wide WHERE {any_of(low_sql(), lx.VALIDATION.contrast)} AND NOT ({ANY_MIXED}) AND len({MENTIONED}) > 0"""


def issues(t: Tables, checks=("keyword", "contrast")):
    return validate.validate_labels(t.labelled_wide(), ["file", "review_id"], "content", checks=checks)


def flat(df):
    return df.withColumn("aspects", F.array_join("aspects", "|"))


@query("validate_keywords", f"WITH {LABELLED_WIDE} {keyword_issue_sql()}")
def validate_keywords(t):
    return flat(issues(t, ["keyword"]))


@query("validate_multipolarity", f"WITH {LABELLED_WIDE} {CONTRAST_ISSUES}")
def validate_multipolarity(t):
    return flat(issues(t, ["contrast"]))


ALL_ISSUES = f"{LABELLED_WIDE}, issues AS ({keyword_issue_sql()} UNION ALL {CONTRAST_ISSUES})"


@query("validate_all", f"WITH {ALL_ISSUES} SELECT * FROM issues")
def validate_all(t):
    return flat(issues(t))


@query(
    "validation_report",
    f"""WITH {ALL_ISSUES} SELECT (SELECT count(DISTINCT file) FROM labelled_wide) AS total_files,
  (SELECT count(*) FROM labelled_wide) AS total_samples, count(*) AS total_issues,
  round(count(*) / (SELECT count(*) FROM labelled_wide) * 100, 2) AS issue_rate_percent,
  count(DISTINCT (file, review_id)) AS samples_with_issues FROM issues""",
)
def validation_report(t):
    return validate.report_of_samples(t.labelled_wide(), "file", "content")


@query(
    "validation_breakdown",
    f"""WITH {ALL_ISSUES} SELECT 'type' AS dimension, type AS value, count(*) AS issues FROM issues GROUP BY ALL
UNION ALL SELECT 'severity', severity, count(*) FROM issues GROUP BY ALL
UNION ALL SELECT 'aspect', aspect, count(*) FROM issues WHERE aspect IS NOT NULL GROUP BY ALL""",
)
def validation_breakdown(t):
    return validate.validation_breakdown(issues(t))

