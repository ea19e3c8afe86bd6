"""Column choice, defaults, messages and dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Content column candidates, in order.
CONTENT_REVIEW_FIRST = ["reviewContent", "content", "review", "text", "comment"]
CONTENT_PLAIN_FIRST = ["content", "reviewContent", "review", "text", "comment"]
CONTENT_TRAINING = ["ReviewText", "Review"]


def resolve_content(
    df: DataFrame,
    candidates: Sequence[str] = CONTENT_REVIEW_FIRST,
    first_column_fallback: bool = True,
    output: str = "reviewContent",
) -> DataFrame:
    """Put the first existing candidate column (null as '') into ``output``."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        if not first_column_fallback:
            raise ValueError(f"no content column among {df.columns}")
        found = df.columns[0]
    return df.withColumn(output, F.coalesce(F.col(f"`{found}`").cast("string"), F.lit("")))


def existing_aspects(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected aspects the table has; none at all is an error."""
    found = [a for a in expected if a in df.columns]
    if not found:
        raise ValueError(f"no aspect column among {df.columns}")
    return found


def with_aspects(df: DataFrame, aspects: Sequence[str], default: str = "2") -> DataFrame:
    """Add absent aspect columns."""
    return df.withColumns({a: F.lit(default) for a in aspects if a not in df.columns})


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_empty(df: DataFrame, content: str) -> DataFrame:
    """Without null and exactly empty content; white space stays."""
    return df.where(F.col(content).isNotNull() & (F.col(content) != ""))


def training_pairs(df: DataFrame, text: str, label: str) -> DataFrame:
    """(content, label) of rows with both present and the label mentioned."""
    ok = F.col(text).isNotNull() & F.col(label).isNotNull() & (F.col(label) != "2")
    return df.where(ok).select(F.col(text).alias("content"), F.col(label).alias("label"))


def surrogate_id(existing: Column, product: Column, *parts: Column) -> Column:
    """The id if there is one, else product and the md5 of ``parts`` (same row, same id); null parts are
    empty, parts are kept apart by a control character."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    made = F.concat_ws("_", product, F.md5(F.concat_ws("\x1f", *texts)))
    return F.coalesce(F.nullif(existing.cast("string"), F.lit("")), made)


def flatten_json(schema: T.StructType, prefix: str = "") -> list[Column]:
    """Dotted columns for every leaf of a nested schema."""
    out: list[Column] = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            out += flatten_json(f.dataType, path)
        else:
            quoted = ".".join(f"`{p}`" for p in path.split("."))
            out.append(F.col(quoted).alias(path))
    return out


def flatten(df: DataFrame) -> DataFrame:
    return df.select(*flatten_json(df.schema))


# --------------------------------------------------------------------------- messages


def decode_message(value: Column | str) -> Column:
    """Message JSON of any layout to a map of its fields. (Names differ by case only, so a
    struct would be ambiguous.) Unreadable JSON gives null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.from_json(v, "map<string,string>")


def harmonise(m: Column) -> list[Column]:
    """Common fields of a decoded message, with defaults."""

    def first(*names: str) -> list[Column]:
        return [F.element_at(m, n) for n in names]

    return [
        F.coalesce(*first("product_id", "Product_ID", "item_id"), F.lit("unknown")).alias("product_id"),
        F.coalesce(*first("review_content", "reviewContent", "content"), F.lit("")).alias("review_content"),
        F.coalesce(F.element_at(m, "rating").try_cast("int"), F.lit(0)).alias("rating"),
        F.coalesce(F.element_at(m, "review_id"), F.lit("")).alias("review_id"),
        F.element_at(m, "timestamp").try_cast("double").alias("timestamp"),
    ]


def encode_message(df: DataFrame, key: str | None, fields: Sequence[Column | str]) -> DataFrame:
    """(key, value) rows for a topic: value is the JSON of ``fields``."""
    k = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return df.select(k.alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def stamp(df: DataFrame, column: str = "processed_at") -> DataFrame:
    """Add the processing time, in seconds since 1970."""
    return df.withColumn(column, F.unix_micros(F.current_timestamp()) / 1e6)


def split_dead_letters(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(readable, dead): rows whose value is a JSON object, and the rest with a reason."""
    good = decode_message(value).isNotNull()
    reason = F.when(F.col(value).isNull() | (F.trim(value) == ""), "empty").otherwise("not JSON")
    return df.where(good), df.where(~good).withColumn("error", reason)
