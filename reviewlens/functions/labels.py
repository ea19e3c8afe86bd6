"""Label codecs.

Conventions (the same integers mean different things, so convert at the edges):

canonical   1 positive, 0 neutral, -1 negative, 2 not mentioned; text such as
            ``[-1,1]`` marks several polarities at once
legacy      -1 not mentioned, 0 negative, 1 positive, 2 neutral
class       0..3 for the canonical labels -1, 0, 1, 2
head        0 negative, 1 positive, 2 neutral, beside a separate mention flag
words       POS / NEG / NEU / null
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import strip_ws

# The nine aspects in canonical order.
ASPECTS: list[str] = [
    "Chất lượng sản phẩm",
    "Hiệu năng & Trải nghiệm",
    "Đúng mô tả",
    "Giá cả & Khuyến mãi",
    "Vận chuyển",
    "Đóng gói",
    "Dịch vụ & Thái độ Shop",
    "Bảo hành & Đổi trả",
    "Tính xác thực",
]

MULTI = "[-1,1]"
NOT_MENTIONED = "2"

# Label names.
LABEL_WORD = {1: "POS", 0: "NEU", -1: "NEG", 2: "NOT_MENTIONED"}
LABEL_NAME = {1: "POSITIVE", 0: "NEUTRAL", -1: "NEGATIVE", 2: "N/A"}
HEAD_TO_CANONICAL = {0: -1, 1: 1, 2: 0}
WORD_TO_CANONICAL = {"POS": 1, "NEG": -1, "NEU": 0}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column, table: Mapping, default: Column | None = None) -> Column:
    """CASE over a small fixed table; stays in generated code."""
    items = list(table.items())
    out = F.when(c == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(c == F.lit(k), F.lit(v))
    return out if default is None else F.coalesce(out, default)


def to_int(c: Column | str) -> Column:
    """Number or numeric text to int, cutting decimals; anything else gives null."""
    return _col(c).cast("string").try_cast("double").try_cast("int")


# ------------------------------------------------------------- multi-polarity cells


def parse_multipolarity(cell: Column | str) -> Column:
    """Cell text to ``struct(mention, neg, pos, neu)``.

    Null, ``2``, empty and ``nan`` are "not mentioned". A list takes every known label
    and turns neutral when one part is no integer. A single number is cut to int; what
    is left unknown (also ``2.0``) counts as mentioned and neutral.
    """
    text = strip_ws(F.regexp_replace(F.coalesce(_col(cell).cast("string"), F.lit("2")), r"[\[\]]", ""))
    absent = text.isin("2", "nan", "")
    parts = F.transform(F.split(text, ","), strip_ws)
    is_list = F.contains(text, F.lit(","))
    all_ints = F.forall(parts, lambda p: p.rlike(r"^[+-]?\d+\z"))
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    single = to_int(text)

    def flag(value: int) -> Column:
        from_list = all_ints & F.coalesce(F.array_contains(numbers, F.lit(value)), F.lit(False))
        from_single = F.coalesce(single == value, F.lit(False))
        if value == 0:  # the neutral slot also takes everything unreadable
            from_list = ~all_ints | from_list
            from_single = from_single | ~F.coalesce(single.isin(-1, 1), F.lit(False))
        return F.when(absent, 0).when(is_list, from_list.cast("int")).otherwise(from_single.cast("int"))

    return F.struct(
        F.when(absent, 0).otherwise(1).alias("mention"),
        flag(-1).alias("neg"),
        flag(1).alias("pos"),
        flag(0).alias("neu"),
    )


def parse_legacy(cell: Column | str) -> Column:
    """Legacy cell to ``struct(mention, sentiment)``; null counts as -1."""
    v = F.coalesce(to_int(cell), F.lit(-1))
    return F.struct(
        (v != -1).cast("int").alias("mention"),
        F.when(v == -1, 0).otherwise(v).alias("sentiment"),
    )


def label_to_class(label: Column | str) -> Column:
    """Canonical label to class index 0..3; unknown labels go to class 0."""
    v = to_int(label)
    return F.when(v.between(-1, 2), v + 1).otherwise(0)


def decode_label(label: Column | str, names: Mapping[int, str] = LABEL_WORD, unknown: Column | str = "UNKNOWN") -> Column:
    """Canonical label to its name; ``unknown`` may be a column, e.g. the raw text."""
    fallback = F.lit(unknown) if isinstance(unknown, str) else unknown
    return lookup(to_int(label), names, fallback)


def words_to_canonical(word: Column | str) -> Column:
    """POS / NEG / NEU to 1 / -1 / 0; everything else is not mentioned (2)."""
    return lookup(_col(word), WORD_TO_CANONICAL, F.lit(2))


# ------------------------------------------------------------------ maps and JSON


def encode_sentiment(labels: Column | str) -> Column:
    """Map aspect -> int to JSON without the aspects labelled 2; null values stay."""
    kept = F.map_filter(_col(labels), lambda _, v: F.coalesce(v != 2, F.lit(True)))
    return F.to_json(kept, {"ignoreNullFields": "false"})


def decode_sentiment(json: Column | str) -> Column:
    return F.from_json(_col(json), "map<string,int>")


def encode_matrix(matrix: Column | str, digits: int = 4) -> Column:
    """Probability matrix to JSON with rounded numbers."""
    return F.to_json(F.transform(_col(matrix), lambda r: F.transform(r, lambda x: F.round(x, digits))))


def argmax(row: Column) -> Column:
    """Zero-based index of the first largest value."""
    return F.array_position(row, F.array_max(row)) - 1


def argmax_matrix(json: Column | str, n_aspects: int) -> Column:
    """JSON matrix to one class index per aspect; a wrong number of rows gives null."""
    m = F.from_json(_col(json), "array<array<double>>")
    return F.when(F.size(m) == n_aspects, F.transform(m, argmax))


# ---------------------------------------------------------------------- model heads


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logits_to_labels(
    mention: Column | str,
    sentiment: Column | str,
    aspects: Sequence[str],
    threshold: float = 0.5,
    multi: bool = False,
) -> Column:
    """Two logit arrays (n and 3n long) to an array of ``struct(aspect, label)``.

    Single: arg-max of the three logits, remapped to canonical. Multi: every class whose
    probability passes the threshold, as ``[-1,1]``-style text, neutral if none does.
    """
    m, s = _col(mention), _col(sentiment)
    out = []
    for i, aspect in enumerate(aspects):
        triple = F.slice(s, 3 * i + 1, 3)
        if multi:
            # listed by value: -1 (slot 1), 0 (slot 3), 1 (slot 2)
            hits = F.filter(
                F.array(
                    *[
                        F.when(sigmoid(F.get(triple, slot)) > threshold, F.lit(name))
                        for slot, name in [(0, "-1"), (2, "0"), (1, "1")]
                    ]
                ),
                lambda x: x.isNotNull(),
            )
            label = (
                F.when(F.size(hits) == 0, "0")
                .when(F.size(hits) == 1, F.get(hits, 0))
                .otherwise(F.concat(F.lit("["), F.array_join(hits, ","), F.lit("]")))
            )
        else:
            label = lookup(argmax(triple), HEAD_TO_CANONICAL, F.lit(0)).cast("string")
        mentioned = sigmoid(F.get(m, i)) > threshold
        out.append(
            F.struct(
                F.lit(aspect).alias("aspect"),
                F.when(mentioned, label).otherwise(NOT_MENTIONED).alias("label"),
            )
        )
    return F.array(*out)


# -------------------------------------------------------------------- wide and long


def to_long(df: DataFrame, ids: Sequence[str], aspects: Sequence[str]) -> DataFrame:
    """One row per (ids, aspect); absent aspect columns read as not mentioned."""
    present = [a for a in aspects if a in df.columns]
    absent = [a for a in aspects if a not in df.columns]
    full = df.select(
        *ids,
        *[F.col(f"`{a}`").cast("string").alias(a) for a in present],
        *[F.lit(NOT_MENTIONED).alias(a) for a in absent],
    )
    return full.unpivot(list(ids), [F.col(f"`{a}`") for a in aspects], "aspect", "label")


def to_wide(df: DataFrame, keys: Sequence[str], aspects: Sequence[str], value: str) -> DataFrame:
    """Pivot (keys, aspect, value) to one column per aspect; the list of aspects is given,
    so no extra job looks for the distinct values."""
    return df.groupBy(*keys).pivot("aspect", list(aspects)).agg(F.first(value, ignorenulls=True))
