"""Joins: predictions with truth, products re-attached, lexicon matches, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def join_pred_truth(pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions beside truth by id (positions mean nothing after a shuffle)."""
    return pred.join(truth, list(keys), "inner")


def reattach(scored: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Bring product columns back to rows that were scored on text alone."""
    return scored.join(source.select(key, *columns), key, "left")


FEW = 128  # entries up to which each is looked for in every text
GRAM = 5  # characters of the longest index gram
BITS = 1 << 18  # of the filter over index grams
SAMPLE = 2_000  # texts whose grams are counted to tell rare ones; decides about speed only
BROADCAST_BYTES = 32 << 20


def lexicon_join(df: DataFrame, text: str, ids: Sequence[str], lexicon: DataFrame, values: Sequence[str] = ("aspect", "role")) -> DataFrame:
    """Every (row, lexicon entry) whose keyword occurs in the lower-cased text: one output row for each row of
    ``df`` and each entry, repeated entries included, with the entry's ``values`` and its keyword. An empty keyword occurs in
    every text, a null one in none.

    A handful of entries becomes an array literal filtered per row: no join at all. More of them are found
    through an index of their grams; the rows are the same. Where entries are only counted, give one entry per keyword
    with its counts as ``values``: the rows then grow with the keywords found and not with their repeats.
    """
    entries = lexicon.select(*values, "keyword")
    prepared = df.select(*ids, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__rl_t"))
    rows = entries.take(FEW + 1)
    if len(rows) > FEW:
        return match_by_gram(prepared, "__rl_t", ids, entries)
    kind = T.ArrayType(entries.schema)
    known = F.array(*[F.struct(*(F.lit(r[c]).alias(c) for c in entries.columns)) for r in rows]).cast(kind)
    found = F.filter(known, lambda e: F.contains(F.col("__rl_t"), e["keyword"]))
    return exploded(prepared.select(*ids, found.alias("e")), "e").select(*ids, "e.*")


def exploded(df: DataFrame, array: str) -> DataFrame:
    """A row per element of an array column. Spark would test a plain explode for emptiness far below, before the rows are
    spread over the tasks, and work the array out twice for it; the outer form is left where it is."""
    return df.withColumn(array, F.explode_outer(array)).where(F.col(array).isNotNull())


def grams(text: Column, n: int) -> Column:
    """All parts of ``n`` characters, in order: whole characters at a time, with those that follow."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS)).cast("int")


def parts(df: DataFrame, text: str, lengths: Sequence[int]) -> DataFrame:
    """``df`` with its ``parts``: those parts of the text that have one of ``lengths`` (at most ``GRAM``), each once. The text is
    walked once, for the ``GRAM`` characters or what is left that begin at each place; of the few distinct ones the beginnings
    are taken, and of these again."""
    begun = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{GRAM}}}))."), F.lit(1)))
    out, shortest = df.withColumn(f"__rl_{GRAM}", begun), min([n for n in lengths if n], default=GRAM)
    for n in range(GRAM - 1, shortest - 1, -1):
        out = out.withColumn(f"__rl_{n}", F.array_distinct(F.transform(f"__rl_{n + 1}", lambda g: F.left(g, F.lit(n)))))  # noqa: B023
    # the end of a text has been taken at each length: those of just the length are kept
    each = [F.filter(f"__rl_{n}", lambda g: F.length(g) == n) for n in lengths if n]  # noqa: B023
    each += [F.array(F.lit(""))] if 0 in lengths else []
    return out.select(*df.columns, F.concat(F.array().cast("array<string>"), *each).alias("parts"))


def gram_index(texts: Column, sample: DataFrame, entries: DataFrame) -> DataFrame:
    """The distinct keywords of ``entries``, each with the ``gram`` it is found by: of its parts of ``GRAM`` characters (of a
    shorter keyword, all of it) the one that fewest of the sampled texts hold. An empty keyword has the empty gram."""
    words = entries.select("keyword").where("keyword <> ''").distinct()
    each = words.select("keyword", F.explode(F.array_distinct(F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(grams(F.col("keyword"), GRAM)))).alias("gram"))
    known = sample.select(F.explode(F.array_distinct(grams(texts, GRAM))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    rated = each.join(known, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("keyword").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    blank = entries.select("keyword").where("keyword = ''").distinct().withColumn("gram", F.lit(""))
    return rarest.unionByName(blank)


def gram_filter(index: DataFrame) -> Column:
    """A set of bits, one or more of them on for the index's grams, as an array of at most ``BITS`` / 64 numbers."""
    on = [0] * (BITS // 64)
    for (s,) in index.select(slot(F.col("gram"))).distinct().collect():  # at most BITS numbers
        on[s // 64] |= 1 << (s % 64)
    numbers = ",".join(str(x - (1 << 64) if x >> 63 else x) for x in on)
    return F.split(F.lit(numbers), ",").cast("array<bigint>")  # one literal, worked out once


def match_by_gram(df: DataFrame, text: str, ids: Sequence[str], entries: DataFrame) -> DataFrame:
    """Index form of :func:`lexicon_join` for lexicons of any size.

    A text's distinct grams are cut down to those that may be in the index before anything is moved; what is
    left meets the index by equality, and the whole keyword is then looked for, once however many entries have it. Each
    keyword has one gram, so none is found twice; its entries are joined to what was found. Index and entries are broadcast
    if their measured size allows it; otherwise both sides are shuffled.
    """
    t = F.col(text)
    index = gram_index(t, df.select(text).limit(SAMPLE), entries).persist()
    lengths = sorted(r[0] for r in index.select(F.length("gram")).distinct().collect())
    bits = gram_filter(index)
    each = exploded(parts(df.select(*ids, text), text, lengths), "parts").withColumnRenamed("parts", "gram")
    place = slot(F.col("gram"))
    met = each.where(F.getbit(F.get(bits, F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))) == 1)
    # a keyword that is its own gram has been found already
    found = met.join(sized(index, 150), "gram").where((F.col("keyword") == F.col("gram")) | F.contains(t, F.col("keyword"))).select(*ids, "keyword")
    return found.join(sized(entries, 150), "keyword").select(*ids, *entries.columns)


def sized(table: DataFrame, other_bytes: int) -> DataFrame:
    """``table``, which has a keyword and at most ``other_bytes`` besides in a row, with the hint for its measured size."""
    size = table.agg(F.sum(F.length("keyword") * 4 + other_bytes)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("merge")


def completeness(expected: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Expected against processed rows per key: complete, partial or missing."""
    e = expected.groupBy(key).agg(F.count("*").alias("expected"))
    p = processed.groupBy(key).agg(F.count("*").alias("processed"))
    both = e.join(p, key, "full").na.fill(0, ["expected", "processed"])
    status = (
        F.when(F.col("processed") >= F.col("expected"), "complete")
        .when(F.col("processed") > 0, "partial")
        .otherwise("missing")
    )
    return both.withColumn("status", status)
