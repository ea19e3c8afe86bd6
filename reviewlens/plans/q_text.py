"""Text and URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import text as T
from reviewlens.functions.labels import ASPECTS
from reviewlens.operators import project
from reviewlens.operators.lexicon import DOC_NEGATIVE, DOC_POSITIVE, context_window, count_contained, keyword_positions
from reviewlens.plans.registry import query
from reviewlens.plans.session import spread
from reviewlens.plans.views import REVIEWS, SHORT_REVIEWS, sql_list, sql_text

WS_CLASS = f"[{T.WS}]"
TRIM_WS = sql_text(T.WHITESPACE)


def rx(value: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({value}, {sql_text(pattern)}, {sql_text(replacement)}, 'g')"


def strip(value: str) -> str:
    return f"trim({value}, {TRIM_WS})"


def over_reviews(expr: str, name: str, table: str = "reviews") -> str:
    return f"WITH {REVIEWS} SELECT review_id, {expr} AS {name} FROM {table}"


@query("clean_basic", over_reviews(f"coalesce({strip('lower(' + rx(rx('content', T.TAG, ''), f'[^{T.WORD}{T.WS}]', ' ') + ')')}, '')", "cleaned"))
def clean_basic(t):
    return t.reviews().select("review_id", T.clean_basic("content").alias("cleaned"))


@query("clean_stream", over_reviews(f"coalesce({strip(rx(rx('lower(content)', T.TAG, ''), WS_CLASS + '+', ' '))}, '')", "cleaned"))
def clean_stream(t):
    return t.reviews().select("review_id", T.clean_stream("content").alias("cleaned"))


@query("clean_pages", f"SELECT page_id, coalesce({strip(rx(rx('lower(html)', T.TAG, ''), WS_CLASS + '+', ' '))}, '') AS cleaned FROM pages")
def clean_pages(t):
    return spread(t.pages).select("page_id", T.clean_stream("html").alias("cleaned"))


# The sixteen pictograph ranges, written out.
EMOJI_RANGES = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}"
    r"\x{24C2}-\x{1F251}\x{1F926}-\x{1F937}\x{10000}-\x{10FFFF}\x{200D}\x{2640}-\x{2642}\x{2600}-\x{2B55}"
    r"\x{23CF}\x{23E9}\x{231A}\x{3030}\x{FE0F}"
)


@query("strip_emoji", over_reviews(rx("content", f"[{EMOJI_RANGES}]+", " "), "cleaned"))
def strip_emoji(t):
    return t.reviews().select("review_id", T.strip_emoji("content").alias("cleaned"))


def no_repeats(value: str) -> str:
    """Adjacent equal characters to one (line feeds excepted); ``value`` is a column name."""
    return (
        f"array_to_string(list_filter(string_split({value}, ''), "
        f"lambda c, i: i = 1 OR c = chr(10) OR c <> string_split({value}, '')[i - 1]), '')"
    )


COLLAPSED = """
  SELECT review_id, array_to_string(list_filter(l, lambda c, i: i = 1 OR c = chr(10) OR c <> l[i - 1]), '') AS x
  FROM (SELECT review_id, string_split({src}, '') AS l FROM {table})"""


@query("collapse_repeats", f"WITH {REVIEWS} SELECT review_id, x AS cleaned FROM ({COLLAPSED.format(src='content', table='reviews')})")
def collapse_repeats(t):
    return t.reviews().select("review_id", T.collapse_repeats("content").alias("cleaned"))


def spaced(value: str) -> str:
    both = rx(value, f"([{T.WORD}]){WS_CLASS}*([{T.PUNCT}]){WS_CLASS}*([{T.WORD}])", r"\1 \2 \3")
    return rx(both, f"([{T.WORD}]){WS_CLASS}*([{T.PUNCT}])", r"\1 \2")


@query("punct_spacing", over_reviews(spaced("content"), "cleaned"))
def punct_spacing(t):
    return t.reviews().select("review_id", T.punct_spacing("content").alias("cleaned"))


def one_mark(value: str) -> str:
    return rx(value, f"([{T.PUNCT}])([{T.PUNCT}])+", r"\1")


@query("punct_collapse", over_reviews(one_mark("content"), "cleaned"))
def punct_collapse(t):
    return t.reviews().select("review_id", T.punct_collapse("content").alias("cleaned"))


def outer(value: str) -> str:
    return f"trim({strip(value)}, {sql_text(T.PUNCTUATION + T.ASCII_WHITESPACE)})"


@query("strip_outer", over_reviews(outer("content"), "cleaned"))
def strip_outer(t):
    return t.reviews().select("review_id", T.strip_outer("content").alias("cleaned"))


ABBREV_KEYS, ABBREV_VALUES = sql_list(T.ABBREVIATIONS), sql_list(T.ABBREVIATIONS.values())


def expanded(value: str) -> str:
    words = f"list_filter(regexp_split_to_array({strip(value)}, {sql_text(WS_CLASS + '+')}), lambda w: w <> '')"
    return (
        f"CASE WHEN {value} IS NOT NULL THEN coalesce(array_to_string(list_transform({words}, "
        f"lambda w: coalesce({ABBREV_VALUES}[list_position({ABBREV_KEYS}, lower(w))], w)), ' '), '') END"
    )


@query("expand_abbrev", over_reviews(expanded("content"), "cleaned"))
def expand_abbrev(t):
    return t.reviews().select("review_id", T.expand_abbrev("content").alias("cleaned"))


NORMALISED = f"""WITH {REVIEWS},
a AS (SELECT review_id, {rx('lower(content)', f'[{EMOJI_RANGES}]+', ' ')} AS x FROM reviews),
b AS ({COLLAPSED.format(src='x', table='a')}),
c AS (SELECT review_id, {rx(outer(one_mark(spaced('x'))), WS_CLASS + '+', ' ')} AS x FROM b)
SELECT review_id, {expanded('x')} AS cleaned FROM c"""


@query("normalise_full", NORMALISED)
def normalise_full(t):
    return t.reviews().select("review_id", T.normalise_full("content").alias("cleaned"))


def typo_sql(value: str) -> str:
    for _ in range(2):
        value = strip(f"lower({value})")
        for old, new in T.TYPO_REPLACEMENTS:
            value = f"replace({value}, {sql_text(old)}, {sql_text(new)})"
    return value


@query("normalise_typos", over_reviews(typo_sql("content"), "cleaned"))
def normalise_typos(t):
    return t.reviews().select("review_id", T.normalise_typos("content").alias("cleaned"))


def signature_sql(value: str) -> str:
    return rx(f"lower(coalesce({value}, ''))", f"[^{T.WORD}]", "")


@query("dedup_signature", over_reviews(signature_sql("content"), "sig"))
def dedup_signature(t):
    return t.reviews().select("review_id", T.signature("content").alias("sig"))


def counted(value: str, keywords) -> str:
    return f"CAST(len(list_filter({sql_list(keywords)}, lambda k: contains({value}, k))) AS BIGINT)"


@query(
    "keyword_counts",
    f"WITH {REVIEWS} SELECT review_id, {counted('lower(content)', DOC_POSITIVE)} AS n_positive, "
    f"{counted('lower(content)', DOC_NEGATIVE)} AS n_negative FROM reviews WHERE content IS NOT NULL",
)
def keyword_counts(t):
    low = F.lower("content")
    return t.reviews().where("content IS NOT NULL").select(
        "review_id",
        count_contained(low, DOC_POSITIVE).cast("bigint").alias("n_positive"),
        count_contained(low, DOC_NEGATIVE).cast("bigint").alias("n_negative"),
    )


POSITION_WORDS = ["tion", "ion", "ea", "đẹp", "giao", "ch", "aa"]
LEN = "len(content)"


@query(
    "keyword_positions",
    f"""WITH {SHORT_REVIEWS}, hits AS (
  SELECT review_id, k, unnest(range(CAST(length(content) AS BIGINT))) AS p, content
  FROM short_reviews, (SELECT unnest({sql_list(POSITION_WORDS)}) AS k) WHERE contains(content, k)
), docs AS (
  SELECT doc_id, k, string_split(text, k) AS parts FROM documents,
       (SELECT unnest({sql_list([w for w in POSITION_WORDS if w != "aa"])}) AS k) WHERE contains(text, k)
), pairs AS (
  SELECT doc_id, parts, unnest(range(1, len(parts) - 1)) AS i FROM (SELECT doc_id, string_split(text, 'a') AS parts FROM documents WHERE contains(text, 'aa'))
), doc_hits AS (
  SELECT doc_id, list_sum(list_transform(parts[1:i], lambda s: length(s))) + (i - 1) * length(k) AS p
  FROM (SELECT doc_id, k, parts, unnest(range(1, len(parts))) AS i FROM docs)
  UNION ALL SELECT doc_id, list_sum(list_transform(parts[1:i], lambda s: length(s))) + i - 1 FROM pairs WHERE parts[i + 1] = ''
)
SELECT review_id, count(DISTINCT p) AS n, CAST(sum(DISTINCT p) AS BIGINT) AS total, CAST(max(p) AS BIGINT) AS last
FROM hits WHERE substr(content, p + 1, length(k)) = k GROUP BY review_id
UNION ALL
SELECT doc_id * 2, count(DISTINCT p), CAST(sum(DISTINCT p) AS BIGINT), CAST(max(p) AS BIGINT) FROM doc_hits GROUP BY doc_id""",
)
def positions(t):
    """Where any of the keywords starts: number, sum and last of the positions."""
    docs = spread(t.documents).select((F.col("doc_id") * 2).alias("review_id"), F.col("text").alias("content"))

    def found(df, keywords):
        p = keyword_positions(F.col("content"), keywords)
        return df.where("content IS NOT NULL").select("review_id", p.alias("p"))

    def sums(df):
        total = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x)
        return df.select(
            "review_id",
            F.size("p").cast("bigint").alias("n"),
            total.alias("total"),
            F.array_max("p").cast("bigint").alias("last"),
        )

    both = found(t.short_reviews().select("review_id", "content"), POSITION_WORDS).unionByName(found(docs, POSITION_WORDS))
    return sums(both).where("last IS NOT NULL")


@query(
    "keyword_context",
    f"""WITH {REVIEWS}, hit AS (
  SELECT review_id, content, instr(content, 'giao') - 1 AS p, instr(content, 'tion') - 1 AS q FROM reviews WHERE content IS NOT NULL)
SELECT review_id,
  CASE WHEN p >= 0 THEN substr(content, greatest(p - 60, 0) + 1, p + 60 - greatest(p - 60, 0)) END AS near_giao,
  CASE WHEN q >= 0 THEN substr(content, greatest(q - 50, 0) + 1, q + 4 + 50 - greatest(q - 50, 0)) END AS near_tion
FROM hit""",
)
def keyword_context(t):
    c = F.col("content")
    p, q = F.instr(c, "giao") - 1, F.instr(c, "tion") - 1
    return t.reviews().where(c.isNotNull()).select(
        "review_id",
        F.when(p >= 0, context_window(c, p, 60, 60)).alias("near_giao"),
        F.when(q >= 0, context_window(c, q, 50, len("tion") + 50)).alias("near_tion"),
    )


# ----------------------------------------------------------------- filters on text


@query("drop_empty", f"WITH {REVIEWS} SELECT review_id, content FROM reviews WHERE content IS NOT NULL AND content <> ''")
def drop_empty(t):
    return project.drop_empty(t.reviews(), "content").select("review_id", "content")


JUNK = "(NOT contains(content, ' ') AND length(content) > 25)"


@query("junk_filter", f"WITH {REVIEWS} SELECT review_id, content FROM reviews WHERE content IS NOT NULL AND NOT {JUNK}")
def junk_filter(t):
    return t.reviews().where(F.col("content").isNotNull() & ~T.is_junk("content")).select("review_id", "content")


@query(
    "junk_stats",
    f"WITH {REVIEWS} SELECT count(*) AS rows_before, count(*) FILTER ({JUNK}) AS rows_removed, "
    f"count(*) FILTER (NOT {JUNK}) AS rows_after FROM reviews WHERE content IS NOT NULL",
)
def junk_stats(t):
    junk = T.is_junk("content")
    return t.reviews().where("content IS NOT NULL").agg(
        F.count("*").alias("rows_before"), F.count_if(junk).alias("rows_removed"), F.count_if(~junk).alias("rows_after")
    )


@query("junk_samples", f"WITH {REVIEWS} SELECT review_id, content FROM reviews WHERE {JUNK} ORDER BY review_id LIMIT 5")
def junk_samples(t):
    """The report's five samples of removed rows."""
    return t.reviews().where(T.is_junk("content")).orderBy("review_id").limit(5).select("review_id", "content")


LINE = "replace(coalesce(content, ''), chr(10), ' ')"


@query("truncate_text", over_reviews(f"CASE WHEN length({LINE}) > 100 THEN substr({LINE}, 1, 97) || '...' ELSE {LINE} END", "preview"))
def truncate_text(t):
    return t.reviews().select("review_id", T.truncate_text("content").alias("preview"))


TEMPLATE = 'Label this review: "{review}"\nAspects: {aspects}\nAnswer with one JSON object of 1, 0, -1, 2 or "[-1,1]".'


@query(
    "render_prompt",
    over_reviews(
        "'Label this review: \"' || coalesce(content, '') || '\"' || chr(10) || 'Aspects: ' || "
        + sql_text(", ".join(f'"{a}"' for a in ASPECTS))
        + " || chr(10) || 'Answer with one JSON object of 1, 0, -1, 2 or \"[-1,1]\".'",
        "prompt",
    ),
)
def render_prompt(t):
    return t.reviews().select("review_id", T.render_prompt(TEMPLATE, "content", ASPECTS).alias("prompt"))


# ------------------------------------------------------------------------------ URLs

URL_FORMS = [
    "url",
    "'https://shop.example/products/pdp-i' || {n} || '-s' || {m} || '.html'",
    "url || '-i' || {n} || '.html'",
    "url || '-i' || {n}",
    "url || '-i' || {n} || '?x=1'",
    "'https://shop.example/p?itemId=' || {n} || '&a=2'",
    "'https://shop.example/i' || {n} || '?b'",
    "'https://shop.example/i' || {n}",
    "'https://shop.example/products/a-b-' || {n} || '.html'",
    "'//shop.example/' || {n} || '-x'",
    "'  \"' || url || '\"  '",
    "''",
]
N_FORMS = len(URL_FORMS)
URLS = "urls AS (SELECT page_id, CASE page_id % {k} {whens} END AS u FROM pages)".format(
    k=N_FORMS,
    whens=" ".join(
        f"WHEN {i} THEN " + form.replace("{n}", "CAST(1000000 + page_id * 37 AS VARCHAR)").replace("{m}", "CAST(5000000 + page_id * 11 AS VARCHAR)")
        for i, form in enumerate(URL_FORMS)
    ),
)


def urls(t):
    """page_id, u: addresses in every known layout, from the pages table."""
    n, m = (F.col("page_id") * 37 + 1000000).cast("string"), (F.col("page_id") * 11 + 5000000).cast("string")
    shop = "https://shop.example"
    forms = [
        F.col("url"),
        F.concat(F.lit(f"{shop}/products/pdp-i"), n, F.lit("-s"), m, F.lit(".html")),
        F.concat(F.col("url"), F.lit("-i"), n, F.lit(".html")),
        F.concat(F.col("url"), F.lit("-i"), n),
        F.concat(F.col("url"), F.lit("-i"), n, F.lit("?x=1")),
        F.concat(F.lit(f"{shop}/p?itemId="), n, F.lit("&a=2")),
        F.concat(F.lit(f"{shop}/i"), n, F.lit("?b")),
        F.concat(F.lit(f"{shop}/i"), n),
        F.concat(F.lit(f"{shop}/products/a-b-"), n, F.lit(".html")),
        F.concat(F.lit("//shop.example/"), n, F.lit("-x")),
        F.concat(F.lit('  "'), F.col("url"), F.lit('"  ')),
        F.lit(""),
    ]
    return t.pages.select("page_id", F.element_at(F.array(*forms), (F.col("page_id") % N_FORMS + 1).cast("int")).alias("u"))


def first_match(patterns, missing: str) -> str:
    tries = ", ".join(f"nullif(regexp_extract(u, {sql_text(p)}, 1), '')" for p in patterns)
    return f"coalesce({tries}, {missing})"


@query(
    "url_item_id",
    f"WITH {URLS} SELECT page_id, {first_match([*T.ITEM_ID_CRAWL, T.ANY_LONG_NUMBER], 'NULL')} AS crawl_id, "
    f"{first_match([*T.ITEM_ID_SEARCH, T.ANY_LONG_NUMBER], sql_text(''))} AS search_id, "
    f"{first_match(T.ITEM_ID_BROWSER, 'NULL')} AS browser_id, {first_match(T.ITEM_ID_SIMPLE, 'NULL')} AS simple_id FROM urls",
)
def url_item_id(t):
    return urls(t).select(
        "page_id",
        T.item_id("u").alias("crawl_id"),
        T.item_id("u", T.ITEM_ID_SEARCH, missing="").alias("search_id"),
        T.item_id("u", T.ITEM_ID_BROWSER, any_long_number=False).alias("browser_id"),
        T.item_id("u", T.ITEM_ID_SIMPLE, any_long_number=False).alias("simple_id"),
    )


@query("url_sku_id", f"WITH {URLS} SELECT page_id, nullif(regexp_extract(u, '-s([0-9]+)', 1), '') AS sku FROM urls")
def url_sku_id(t):
    return urls(t).select("page_id", T.sku_id("u").alias("sku"))


@query(
    "url_clean",
    f"WITH {URLS} SELECT page_id, trim(trim({strip('u')}, '\"'), '''') AS clean, "
    "CASE WHEN u LIKE '//%' THEN 'https:' || u ELSE u END AS absolute FROM urls",
)
def url_clean(t):
    return urls(t).select("page_id", T.clean_url("u").alias("clean"), T.with_scheme("u").alias("absolute"))


@query(
    "epoch_ms_to_ts",
    "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at FROM events",
)
def epoch_ms_to_ts(t):
    """Milliseconds as text, every seventh one unreadable."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(ms)
    return t.events.select("event_id", F.date_format(T.epoch_ms_to_ts(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))
