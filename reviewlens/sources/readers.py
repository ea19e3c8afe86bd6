"""Batch readers."""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.functions.payloads import review_fields, review_items, search_fields, search_items
from reviewlens.functions.text import clean_url, strip_ws
from reviewlens.operators.sampling import cut_groups
from reviewlens.sources.workbook import WorkbookSource, read_rows


def read_workbook(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """xlsx file, folder or glob on a mounted file system; adds ``_file`` and ``_row``."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").option("path", path).option("header", str(header).lower()).load()


def read_workbook_remote(spark: SparkSession, path: str, columns: Sequence[str], rows_per_batch: int = 10_000) -> DataFrame:
    """The same from any file system Spark reads (object stores, HDFS), for known columns.

    Spark lists and distributes the files; a task holds one file's bytes and passes its rows
    on in batches.
    """
    wanted = list(columns)
    schema = ", ".join([*(f"`{c}` string" for c in wanted), "_file string", "_row bigint"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for location, content in zip(files["path"], files["content"]):
                rows = read_rows(io.BytesIO(content))
                at = {name: i for i, name in enumerate(next(rows, [])) if name is not None}
                numbered = enumerate(rows, 1)
                while part := list(itertools.islice(numbered, rows_per_batch)):
                    yield pd.DataFrame(
                        [
                            (*(r[at[w]] if w in at and at[w] < len(r) else None for w in wanted), location.rsplit("/", 1)[-1], n)
                            for n, r in part
                        ],
                        columns=[*wanted, "_file", "_row"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(run, schema)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """Header CSV with quoted line breaks; without a schema every column is text. Each file is read by one task: for
    large files use :func:`read_large_csv`."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path if isinstance(path, str) else list(path))


def csv_records(spark: SparkSession, path: str | Sequence[str], quote: str = '"') -> DataFrame:
    """(file, record, text) of the records of large CSV files whose cells may hold line breaks.

    The files are read as lines, in as many splits as their size asks for. A line break ends a record if the
    quotes before it are even in number. So each split counts its quotes, the sums of the splits before it say
    whether it begins inside a cell, and the same way the splits' record ends number the records. A record that crosses
    splits is put together at the end. Only one row of sums per split is gathered by file.
    """
    lines = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    block = ["file", "split"]
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value"
    ).withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit(""))))
    before = W.partitionBy(*block).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    odd = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    # whether a line starts a record depends on the split's own beginning: count both cases
    sums = odd.groupBy(*block).agg(F.sum("quotes").alias("quotes"), F.count_if(F.col("odd") == 0).alias("even_starts"), F.count_if(F.col("odd") == 1).alias("odd_starts"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    starts = sums.withColumn("inside", inside).withColumn("starts", F.when(F.col("inside") == 0, F.col("even_starts")).otherwise(F.col("odd_starts")))
    offsets = starts.select(*block, "inside", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("offset"))
    placed = odd.join(offsets, block)
    begins = (F.col("odd") == F.col("inside")).cast("bigint")
    number = F.col("offset") + F.sum(begins).over(W.partitionBy(*block).orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    numbered = placed.select("file", "split", "line", "value", number.alias("record"))
    whole = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["value"]), "\n")
    return whole.select("file", (F.col("record") - 1).alias("record"), F.regexp_replace(text, r"\r\z", "").alias("text"))


def read_large_csv(spark: SparkSession, path: str | Sequence[str], schema: str, **options: str) -> DataFrame:
    """Header CSV with quoted line breaks, one large file read by many tasks. Columns are taken by place. The rows are those
    of :func:`read_csv`; blank lines between records are left out."""
    records = csv_records(spark, path).where((F.col("record") > 0) & (F.col("text") != ""))
    parsed = F.from_csv("text", schema, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", **options})
    return records.select(parsed.alias("r")).select("r.*")


def read_folder(
    spark: SparkSession, path: str, pattern: str, fmt: str = "csv", recursive: bool = False, exclude_prefix: str | None = None, **options: str
) -> DataFrame:
    """All files of a folder matching ``pattern``, with their name in ``file``."""
    r = spark.read.format(fmt).options(**options).option("pathGlobFilter", pattern)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    df = r.load(path).withColumn("file", F.col("_metadata.file_name"))
    return df.where(~F.startswith(F.col("file"), F.lit(exclude_prefix))) if exclude_prefix else df


def file_counts(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows per file, sorted by name."""
    return df.groupBy(file).agg(F.count("*").alias("n")).orderBy(file)


PREDICTION = (
    "review_id string, original_text string, cleaned_text string, sentiment map<string,int>, "
    "rating int, processed_at double"
)


def read_prediction_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per product; the file name is the product. Such a file is read by one
    task, so big products are better kept as JSON lines or in the prediction store."""
    df = spark.read.schema(PREDICTION).option("multiLine", True).json(path)
    return df.withColumn("product_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json\z", ""))


def read_prediction_lines(spark: SparkSession, path: str, product: str = "product_id") -> DataFrame:
    """JSON lines in one folder per product (``product_id=...``), which large products need."""
    df = spark.read.schema(PREDICTION).option("recursiveFileLookup", True).json(path)
    return df.withColumn("product_id", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), f"{product}=([^/]+)/", 1)))


def header_row(cells: DataFrame, row: str, marker: str, preview: int | None = None, file: str | None = None) -> DataFrame:
    """Index of the first row holding ``marker`` (trimmed), per file; 0 when there is none.

    ``preview`` looks at the first rows only.
    """
    names = [c for c in cells.columns if c not in (row, file)]
    hit = F.array_contains(F.array(*[strip_ws(F.col(f"`{c}`")) for c in names]), marker)
    if preview is not None:
        hit = hit & (F.col(row) < preview)
    keys = [file] if file else []
    return cells.groupBy(*keys).agg(F.coalesce(F.min(F.when(hit, F.col(row))), F.lit(0)).alias("header_row"))


def below_header(cells: DataFrame, row: str, marker: str, preview: int | None = None) -> DataFrame:
    """Re-read one sheet below its header row: names from that row, trimmed; rows after it.

    Blank header cells get positional names. The header is a single row, fetched to name
    the columns; the data stays where it is.
    """
    names = [c for c in cells.columns if c != row and not c.startswith("_file")]
    at = header_row(cells.select(row, *names), row, marker, preview).first()["header_row"]
    head = cells.where(F.col(row) == at).select(*names).first()
    renamed = [
        F.col(f"`{c}`").alias((head[c] or "").strip() or f"unnamed_{i}") for i, c in enumerate(names)
    ]
    return cells.where(F.col(row) > at).select(*renamed, F.col(row))


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Non-blank lines, trimmed and without straight quotes around them."""
    return lines.where(strip_ws(column) != "").select(clean_url(column).alias("url"))


def random_rows(spark: SparkSession, table: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """A random sample of ``n`` rows (top-k over random keys, no full sort)."""
    return table.orderBy(F.rand(seed)).limit(n)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """Table over JDBC in ``parts`` ranges of a numeric column (the driver jar is the user's)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options)
        .load()
    )


# ------------------------------------------------------------------- landed payloads


def reviews_from_pages(
    pages: DataFrame, payload: str, keys: Sequence[str], page: str | None = None, limit: int | None = None, project: bool = True
) -> DataFrame:
    """Reviews of landed API pages: exploded items, the first ``limit`` per key in page and
    item order. ``project`` gives the eight review fields, else the raw item."""
    items = pages.select(*keys, *([page] if page else []), F.posexplode(review_items(payload)).alias("pos", "item"))
    if limit is not None:
        order = [F.col(c) for c in ([page] if page else []) + ["pos"]]
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        items = cut_groups(items, keys, [*([page] if page else []), "pos"], order, limit)
        items = items.withColumn("rank", rank).where(F.col("rank") <= limit)
    fields: list[Column] = review_fields(F.col("item")) if project else [F.col("item.*")]
    return items.select(*keys, *fields)


def products_from_search(pages: DataFrame, payload: str, keys: Sequence[str], limit: int) -> DataFrame:
    """Products of landed search pages, at most ``limit`` per page."""
    items = pages.select(*keys, F.posexplode(search_items(payload, limit)).alias("position", "item"))
    return items.select(*keys, "position", *search_fields(F.col("item")))
