"""URL filter by path-template trees, one per host, with DataFrame functions only.

1. Runs of digits and long hexadecimal runs of a path become wildcards, and equal (host, shape) are counted,
   with their labelled and their bad urls: from here on the work depends on the shapes, not on the urls.
2. From the deepest level that has labels up, sibling branches whose share of bad urls does not differ from their
   pool by more than chance (|z| <= ``Z``), and those without labels, are merged as ``~``; so is the end of a path.
   Neither the number of siblings nor the depth decides: every branch that differs stays by itself. A level at which
   no node has two branches and mixed labels merges without a look, so the turns follow the branching, not the depth.
3. A template is rejected if its smoothed share of bad labelled urls reaches ``PURITY``. It is smoothed towards
   its host's share, and that towards the share of all.

Stated rules come first: a rule is host suffix and path prefix; the longest that fits decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import saved

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
Z, PURITY, WEIGHT = 1.96, 0.5, 5.0
STEPS = 8  # joins after which a table is written and read again
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. A null url, or one without ``://``, has empty ones."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, null if none; ``rules`` is a short list, it becomes part of the plan."""

    def fits(rule: str) -> Column:
        domain, _, rest = rule.partition("/")
        return ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")

    ordered = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(F.lit(None).cast("string"), *(F.when(fits(r), F.lit(r)) for r in ordered))


def shape_of(path: Column) -> Column:
    """The path with its variable parts as wildcards."""
    hexes = F.regexp_replace(path, "(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "{h}")
    return F.regexp_replace(hexes, "[0-9]+", "{n}")


def segments_of(shape: Column) -> Column:
    parts = F.split(shape, "/", -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def at_level(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` with their branch at a level: ``head`` above it, ``here`` (empty behind the path's end)."""
    parts = segments_of(F.col("shape"))
    return rows.withColumns({"head": F.slice(parts, 1, level), "here": F.coalesce(F.get(parts, F.lit(level)), F.lit(""))})


def kept_apart(rows: DataFrame, far: DataFrame, level: int) -> DataFrame:
    """``rows`` with ``below``, the template from ``level`` down: branches of ``far`` by name, others as ``~``; a
    template of merged branches alone is empty."""
    joined = at_level(rows, level).join(far.withColumn("far", F.lit(True)), ["host", "head", "here", "below"], "left")
    merged = F.when(F.col("below") == "", "").otherwise(F.concat(F.lit("~/"), F.col("below")))
    below = F.when(F.col("far"), F.concat(F.lit("="), F.col("here"), F.lit("/"), F.col("below"))).otherwise(merged)
    return joined.withColumn("below", below).drop("head", "here", "far")


def far_branches(rows: DataFrame, level: int) -> DataFrame:
    """(host, head, here, below) of the branches whose share differs from that of their pool; only sums are joined."""
    sums = (F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    own = at_level(rows, level).groupBy("host", "head", "below", "here").agg(*sums)
    pool = own.groupBy("host", "head", "below").agg(*sums).filter("bad > 0 AND bad < seen")
    both = own.join(pool.withColumnsRenamed({"seen": "all_seen", "bad": "all_bad"}), ["host", "head", "below"])
    share = F.col("all_bad") / F.col("all_seen")
    far = F.abs(F.col("bad") - F.col("seen") * share) > Z * F.sqrt(F.col("seen") * share * (F.lit(1.0) - share))
    return both.filter(far).select("host", "head", "here", "below")


def branching_levels(known: DataFrame) -> list[int]:
    """The levels, deepest first, at which labelled paths part and have labels of both kinds. At all others no branch
    can differ from its pool. One number per level comes to the driver."""
    parts = segments_of(F.col("shape"))
    rows = known.select("host", "seen", "bad", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts))).alias("level"))
    head, here = F.xxhash64(F.slice("parts", F.lit(1), F.col("level"))), F.xxhash64(F.coalesce(F.get("parts", F.col("level")), F.lit("")))
    nodes = rows.groupBy("host", "level", head.alias("head")).agg(F.min(here).alias("low"), F.max(here).alias("high"), F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    found = nodes.filter("low <> high AND bad > 0 AND bad < seen").select("level").distinct().collect()
    return sorted((r["level"] for r in found), reverse=True)


def all_merged(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` with that many levels more merged into their template."""
    return rows.withColumn("below", F.when(F.col("below") == "", "").otherwise(F.concat(F.lit("~/" * levels), F.col("below")))) if levels else rows


def rejected(urls: DataFrame) -> DataFrame:
    """(host, shape) of all rejected templates. ``urls``: host, shape, bad (null where there is no label).

    Branches are looked for among labelled shapes, a branching level a turn.
    """
    counted = urls.groupBy("host", "shape").agg(F.count("bad").alias("seen"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    shapes = saved(counted, "url-shapes")
    total = shapes.filter("seen > 0").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).first()
    everywhere = total["bad"] / total["seen"] if total["seen"] else 0.0
    tree = shapes.withColumn("below", F.lit(""))
    known = tree.filter("seen > 0")
    above = None  # the level looked at before
    for turn, level in enumerate([*branching_levels(known), -1], 1):
        passed = above - level - 1 if above is not None else 0
        known, tree, above = all_merged(known, passed), all_merged(tree, passed), level
        if level < 0:
            break
        far = saved(far_branches(known, level), "url-branches")
        if far.isEmpty() and turn % STEPS:
            known, tree = all_merged(known, 1), all_merged(tree, 1)
            continue
        known, tree = saved(kept_apart(known, far, level), "url-labelled"), kept_apart(tree, far, level)
        if turn % STEPS == 0:
            tree = saved(tree, "url-tree")
    sums = (F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    nodes = saved(tree.groupBy("host", "below").agg(*sums), "url-templates")
    prior = (F.col("bad") + WEIGHT * everywhere) / (F.col("seen") + WEIGHT)
    hosts = nodes.groupBy("host").agg(*sums).select("host", prior.alias("prior"))
    purity = (F.col("bad") + WEIGHT * F.col("prior")) / (F.col("seen") + WEIGHT)
    bad = nodes.join(hosts, "host").filter(purity >= PURITY).select("host", "below")
    return tree.join(bad, ["host", "below"], "left_semi").select("host", "shape")


def judge(urls: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``urls``: page_id, host, path, rule, verdict.

    ``labels`` (page_id, bad) holds the known urls by their ids; ids may be missing, null or repeated (then
    one bad label makes the url bad). Without any label everything that no rule blocks is allowed. Null
    urls have empty host and path and are judged like any other. Repeated rows are judged each.
    """
    host, path = split_url(F.col(url))
    known = labels.groupBy(F.col("page_id").alias("known_id")).agg(F.max("bad").alias("bad"))
    split = urls.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("shape", shape_of(F.col("path")))
    labelled = split.join(known, F.col("page_id") == F.col("known_id"), "left").select("host", "shape", "bad")
    bad = saved(rejected(labelled), "url-rejected").withColumn("reject", F.lit(True))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    verdict = reduce(lambda a, kv: F.when(F.col("rule") == kv[0], F.lit(kv[1])).otherwise(a), rules.items(), F.when(F.col("reject"), "block").otherwise("allow"))
    return split.join(bad, ["host", "shape"], "left").withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of documents (doc_id, quality, toxic) as labels of the pages whose url carries the document's
    number: bad is low quality or toxic."""
    _, path = split_url(F.col("url"))
    number = F.regexp_extract(path, "/([0-9]{1,18})(?![0-9])", 1)
    numbered = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    return numbered.join(labels, "doc_id").select("page_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
