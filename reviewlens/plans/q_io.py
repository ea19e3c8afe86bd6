"""Source, sink, payload and message queries.

Queries that need files write them first, from a whole table, into the scratch folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import payloads as P
from reviewlens.operators import project
from reviewlens.plans.q_text import URLS, strip, urls
from reviewlens.plans.registry import query
from reviewlens.plans.session import scratch_path
from reviewlens.plans.views import REVIEWS, Tables, sql_text
from reviewlens.sources import readers, writers

# -------------------------------------------------------------------------- sources


@query("src_csv", f"WITH {REVIEWS} SELECT review_id, product_id, rating, nullif(content, '') AS content FROM reviews")
def src_csv(t):
    """Reviews through CSV and back; text with quotes and line breaks, empty text as null."""
    path = scratch_path(t.spark, "csv")
    df = t.reviews()
    # spaces at the ends belong to the text
    quoted = df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
    quoted.option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    back = readers.read_large_csv(t.spark, path, "review_id bigint, product_id string, rating int, content string")
    return back.withColumn("content", F.nullif("content", F.lit("")))


@query("csv_bom", f"WITH {REVIEWS} SELECT review_id, product_id, rating, nullif(content, '') AS content, 1 AS marks FROM reviews")
def csv_bom(t):
    """The review buffer as CSV with a byte order mark, and back; every file has its mark."""
    path = scratch_path(t.spark, "csv-bom")
    writers.write_csv_bom(t.reviews().select("review_id", "product_id", "rating", "content"), path)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    marks = files.agg(F.min((F.hex(F.substring("content", 1, 3)) == "EFBBBF").cast("int"))).scalar()
    back = readers.read_large_csv(t.spark, path, "review_id bigint, product_id string, rating int, content string")
    return back.withColumn("content", F.nullif("content", F.lit(""))).withColumn("marks", marks)


@query("sink_roundtrip", f"WITH {REVIEWS} SELECT review_id, product_id, rating, content FROM reviews")
def sink_roundtrip(t):
    """Labelled table export, one folder per group of products, and back."""
    path = scratch_path(t.spark, "labelled")
    writers.write_labelled(t.reviews().withColumn("bucket", writers.product_bucket("product_id", 16)), path, file="bucket")
    schema = "review_id bigint, product_id string, rating int, content string, bucket int"
    return t.spark.read.schema(schema).parquet(path).drop("bucket")


@query(
    "src_multi_file_counts",
    "SELECT event_type || '.csv' AS file, count(*) AS n FROM events WHERE event_type NOT LIKE 'e%' GROUP BY ALL",
)
def src_multi_file_counts(t):
    """A folder with one sub-folder per event type, read recursively, one prefix left out."""
    path = scratch_path(t.spark, "files")
    t.events.select("event_id", "event_type").write.partitionBy("event_type").option("header", True).csv(path)
    df = readers.read_folder(
        t.spark, path, "*.csv", "csv", recursive=True, header="true", inferSchema="false"
    ).withColumn("file", F.concat(F.regexp_extract(F.col("_metadata.file_path"), r"event_type=([^/]+)/", 1), F.lit(".csv")))
    return readers.file_counts(df.where(~F.startswith(F.col("file"), F.lit("e"))))


@query(
    "src_json_docs",
    """SELECT CAST(user_id % 97 AS VARCHAR) AS product_id, CAST(event_id AS VARCHAR) AS review_id, event_type AS aspect,
  CAST(event_id % 3 - 1 AS INTEGER) AS label FROM events""",
)
def src_json_docs(t):
    """Prediction documents per product written as JSON, read with the document schema."""
    path = scratch_path(t.spark, "predictions")
    docs = t.events.select(
        (F.col("user_id") % 97).cast("string").alias("product_id"),
        F.col("event_id").cast("string").alias("review_id"),
        F.create_map("event_type", (F.col("event_id") % 3 - 1).cast("int")).alias("sentiment"),
    )
    writers.gathered(docs, "product_id").write.partitionBy("product_id").json(path)
    back = readers.read_prediction_lines(t.spark, path)
    return back.select("product_id", "review_id", F.explode("sentiment").alias("aspect", "label"))


@query("src_url_list", f"WITH {URLS} SELECT trim(trim({strip('u')}, '\"'), '''') AS url FROM urls WHERE {strip('u')} <> ''")
def src_url_list(t):
    """Addresses written as text lines and read back as a URL list."""
    path = scratch_path(t.spark, "urls")
    urls(t).select(F.col("u").alias("value")).write.text(path)
    return readers.url_list(t.spark.read.text(path))


@query(
    "flatten_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k", event_type AS "kind.name", value AS "kind.value" FROM events""",
)
def flatten_json(t):
    nested = t.events.select(
        "event_id",
        F.from_json("props", "k bigint").alias("props"),
        F.struct(F.col("event_type").alias("name"), "value").alias("kind"),
    )
    return project.flatten(nested)


TITLE = r"<title>([^|<]+)"


@query(
    "html_fields",
    f"""SELECT page_id, {strip(f"coalesce(nullif(regexp_extract(html, {sql_text(TITLE)}, 1), ''), 'Unknown Product')")} AS title,
  coalesce(nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), ''), '') AS lang,
  len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS links FROM pages""",
)
def html_fields(t):
    return t.pages.select(
        "page_id",
        P.page_title("html").alias("title"),
        P.page_field("html", r'lang="([a-z]+)"', "").alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), F.lit(1))).cast("bigint").alias("links"),
    )


# API pages: each event type's events of one user form one landed page.
def landed(t: Tables):
    item = F.struct(
        F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("event_id").cast("string")).alias("reviewId"),
        F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("reviewContent"),
        F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 5).cast("int")).alias("rating"),
    )
    # a landed page is bounded: 32 consecutive events
    pages = t.events.groupBy(F.floor(F.col("event_id") / 32).cast("bigint").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", item.alias("item")))).alias("l")
    )
    items = F.transform("l", lambda x: x["item"])
    return pages.select(
        "page", (F.col("page") % 7).alias("product"), F.to_json(F.struct(F.struct(items.alias("items")).alias("model"))).alias("payload")
    )


@query(
    "review_payload",
    """WITH i AS (SELECT event_id // 32 % 7 AS product, event_id,
  row_number() OVER (PARTITION BY event_id // 32 % 7 ORDER BY event_id) AS k FROM events)
SELECT product, CASE WHEN event_id % 4 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS review_id,
  CASE WHEN event_id % 3 <> 0 THEN event_type ELSE '' END AS content, CAST(event_id % 5 AS INTEGER) AS rating, 0 AS likes
FROM i JOIN events USING (event_id) WHERE k <= 100""",
)
def review_payload(t):
    """At most 100 reviews per product out of landed API pages; the limit is the feature."""
    r = readers.reviews_from_pages(landed(t), "payload", ["product"], "page", 100)
    return r.select("product", "review_id", F.col("reviewContent").alias("content"), "rating", F.col("likeCount").alias("likes"))


@query(
    "search_payload",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS place FROM part)
SELECT p_partkey // 20 AS page, CAST(place AS INTEGER) AS position, CASE WHEN p_partkey % 6 = 0 THEN 'Unknown' ELSE p_name END AS name,
  CASE WHEN p_partkey % 4 = 0 THEN 'N/A' ELSE CAST(p_partkey AS VARCHAR) || ' ₫' END AS price,
  'https://shop.example/products/p-i' || p_partkey || '.html' AS url, CAST(p_partkey AS VARCHAR) AS item_id
FROM p WHERE place < 15""",
)
def search_payload(t):
    """Search pages of twenty parts each, the first fifteen of a page kept."""
    k = F.col("p_partkey")
    item = F.struct(
        F.when(k % 6 != 0, F.col("p_name")).alias("name"),
        F.when(k % 4 != 0, F.concat(k.cast("string"), F.lit(" ₫"))).alias("priceShow"),
        F.concat(F.lit("//shop.example/products/p-i"), k.cast("string"), F.lit(".html")).alias("productUrl"),
        F.when(k % 2 == 0, k.cast("string")).alias("itemId"),
    )
    pages = t.part.groupBy(F.floor(k / 20).cast("bigint").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("l")
    )
    payload = F.to_json(F.struct(F.struct(F.transform("l", lambda x: x["item"]).alias("listItems")).alias("mods")))
    landed_pages = pages.select("page", payload.alias("payload"))
    return readers.products_from_search(landed_pages, "payload", ["page"], 15).select("page", "position", "name", "price", "url", "item_id")


@query(
    "html_products",
    """SELECT event_id // 16 AS page, CAST(event_id AS VARCHAR) AS item_id, 'n' || user_id AS name, '$' || (event_id % 97) AS price,
  'https://x/' || event_id AS url FROM events""",
)
def html_products(t):
    """Product tuples out of pages with sixteen embedded product objects each."""
    e = F.col("event_id").cast("string")
    one = F.concat(
        F.lit('{"itemId":"'), e, F.lit('","z":1,"name":"n'), F.col("user_id").cast("string"), F.lit('","priceShow":"$'),
        (F.col("event_id") % 97).cast("string"), F.lit('","productUrl":"//x/'), e, F.lit('"}'),
    )
    pages = t.events.groupBy(F.floor(F.col("event_id") / 16).cast("bigint").alias("page")).agg(
        F.concat(F.lit("<div>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", one.alias("h")))), lambda x: x["h"]), ""), F.lit("</div>")).alias("html")
    )
    return pages.select("page", F.explode(P.page_products("html")).alias("p")).select("page", "p.*")


# ------------------------------------------------------------------------- projections


@query("resolve_content", f"WITH {REVIEWS} SELECT review_id, coalesce(content, '') AS plain, CAST(review_id AS VARCHAR) AS fallback FROM reviews")
def resolve_content(t):
    r = t.reviews().select("review_id", "content", "rating")
    by_name = project.resolve_content(r, output="plain")
    return project.resolve_content(by_name, ["missing"], output="fallback").select("review_id", "plain", "fallback")


# Three message layouts by event, and unreadable ones.
def messages(t: Tables):
    i = F.col("event_id")
    text = F.concat(F.col("event_type"), F.lit(" giao hàng nhanh"))
    v1 = F.to_json(F.struct(F.col("user_id").cast("string").alias("product_id"), text.alias("review_content"), (i % 5).cast("int").alias("rating"), i.cast("string").alias("review_id")))
    v2 = F.to_json(F.struct(i.alias("review_id"), text.alias("reviewContent"), F.col("user_id").cast("string").alias("Product_ID"), F.lit("Fashion").alias("Product_Category")))
    v3 = F.to_json(F.struct(i.cast("string").alias("review_id"), F.when(i % 8 != 2, F.col("user_id").cast("string")).alias("item_id"), text.alias("content")))
    value = F.when(i % 10 == 9, F.when(i % 20 == 9, "").otherwise("{broken")).when(i % 4 == 0, v1).when(i % 4 == 1, v2).otherwise(v3)
    return t.events.select("event_id", "ts", "user_id", value.alias("value"))


READABLE = "event_id % 10 <> 9"


@query(
    "harmonise_messages",
    f"""SELECT event_id, CASE WHEN event_id % 4 >= 2 AND event_id % 8 = 2 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS product_id,
  event_type || ' giao hàng nhanh' AS review_content, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 5 AS INTEGER) ELSE 0 END AS rating,
  CAST(event_id AS VARCHAR) AS review_id FROM events WHERE {READABLE}""",
)
def harmonise_messages(t):
    good, _ = project.split_dead_letters(messages(t), "value")
    decoded = good.withColumn("m", project.decode_message("value"))
    return decoded.select("event_id", *project.harmonise(F.col("m"))[:4])


@query(
    "dead_letter",
    "SELECT event_id, CASE WHEN event_id % 20 = 9 THEN 'empty' ELSE 'not JSON' END AS error FROM events WHERE event_id % 10 = 9",
)
def dead_letter(t):
    _, dead = project.split_dead_letters(messages(t), "value")
    return dead.select("event_id", "error")


@query(
    "encode_message",
    f"WITH {REVIEWS} SELECT product_id AS key, product_id, review_id, rating, content AS review_content FROM reviews",
)
def encode_message(t):
    """Reviews as (key, value) messages, the value parsed again."""
    fields = ["product_id", F.col("content").alias("review_content"), "rating", F.col("review_id").cast("string").alias("review_id")]
    sent = project.encode_message(t.reviews(), "product_id", fields)
    m = project.decode_message("value")
    return sent.select("key", m.alias("m")).select(
        "key",
        F.col("m")["product_id"].alias("product_id"),
        F.col("m")["review_id"].cast("bigint").alias("review_id"),
        F.col("m")["rating"].cast("int").alias("rating"),
        F.col("m")["review_content"].alias("review_content"),
    )


@query(
    "surrogate_id",
    f"""WITH {REVIEWS} SELECT review_id AS seq, CASE WHEN review_id % 3 = 0 THEN CAST(review_id AS VARCHAR)
  ELSE concat_ws('_', product_id, md5(CAST(review_id AS VARCHAR) || chr(31) || coalesce(content, ''))) END AS id FROM reviews""",
)
def surrogate_id(t):
    """Ids kept or made, over all reviews."""
    r = t.reviews()
    own = F.when(F.col("review_id") % 3 == 0, F.col("review_id").cast("string")).otherwise(F.lit(""))
    return r.select(F.col("review_id").alias("seq"), project.surrogate_id(own, F.col("product_id"), F.col("review_id"), F.col("content")).alias("id"))

