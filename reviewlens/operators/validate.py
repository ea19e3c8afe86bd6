"""Label checks: keyword against label, and contrast words without a mixed label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.labels import ASPECTS, decode_label, to_int
from reviewlens.operators.lexicon import VALIDATION, Lexicon, contains_any
from reviewlens.operators.relate import exploded

SUGGESTION = "Review contains contrast words but no multi-polarity labels"

ISSUE = (
    "struct<type:string,severity:string,aspect:string,aspects:array<string>,keyword:string,"
    "expected:string,actual:string,review:string,suggestion:string>"
)


def _issue(**fields: Column) -> Column:
    order = ["type", "severity", "aspect", "aspects", "keyword", "expected", "actual", "review", "suggestion"]
    null = {"aspects": F.lit(None).cast("array<string>")}
    return F.struct(
        *[fields.get(n, null.get(n, F.lit(None).cast("string"))).alias(n) for n in order]
    ).cast(ISSUE)


def keyword_issues(text: Column, lower: Column, aspect: str, label: Column, rules: Lexicon) -> Column:
    """Array of issues of one aspect. Mixed and unreadable labels are skipped; 2 ("not
    mentioned") is above zero, so a negative keyword beside it is reported."""
    words = rules.aspects[aspect]
    value = F.when(~F.contains(F.coalesce(label, F.lit("")), F.lit("[")), to_int(label))

    def found(keywords: Sequence[str], wrong: Column, severity: str, expected: str) -> Column:
        hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(lower, k))
        issues = F.transform(
            hits,
            lambda k: _issue(
                type=F.lit("keyword_mismatch"),
                severity=F.lit(severity),
                aspect=F.lit(aspect),
                keyword=k,
                expected=F.lit(expected),
                actual=decode_label(value),
                review=F.substring(text, 1, 100),
            ),
        )
        return F.when(F.coalesce(wrong, F.lit(False)), issues).otherwise(F.array().cast(f"array<{ISSUE}>"))

    return F.concat(
        found(words.negative, value > 0, "high", "NEG"), found(words.positive, value < 0, "medium", "POS")
    )


def contrast_issues(text: Column, lower: Column, labels: dict[str, Column], contrast: Sequence[str]) -> Column:
    """One issue when a contrast word occurs, no label is mixed and an aspect is mentioned."""
    mixed = F.lit(False)
    for label in labels.values():
        mixed = mixed | F.contains(F.coalesce(label, F.lit("")), F.lit("["))
    mentioned = F.filter(
        F.array(
            *[
                F.when(F.coalesce(c.try_cast("double") != 2, F.lit(True)), F.lit(a))
                for a, c in labels.items()
            ]
        ),
        lambda a: a.isNotNull(),
    )
    issue = _issue(
        type=F.lit("missing_multi_polarity"),
        severity=F.lit("medium"),
        aspects=mentioned,
        review=F.substring(text, 1, 150),
        suggestion=F.lit(SUGGESTION),
    )
    fires = contains_any(lower, contrast) & ~mixed & (F.size(mentioned) > 0)
    return F.when(fires, F.array(issue)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def validate_labels(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    aspects: Sequence[str] = ASPECTS,
    rules: Lexicon = VALIDATION,
    checks: Sequence[str] = ("keyword", "contrast"),
) -> DataFrame:
    """One row per issue, with ``ids`` (for example file and row_idx) in front.

    A narrow transformation: the rule lists are literals, so there is no join and no shuffle.
    """
    return exploded(with_issues(df, text, aspects, rules, checks).select(*ids, "rl_issues"), "rl_issues").select(*ids, "rl_issues.*")


def with_issues(
    df: DataFrame, text: str, aspects: Sequence[str] = ASPECTS, rules: Lexicon = VALIDATION, checks: Sequence[str] = ("keyword", "contrast")
) -> DataFrame:
    """``df`` with the array of its issues in ``rl_issues``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lower = F.col("__rl_lower")
    labels = {a: F.col(f"`{a}`").cast("string") for a in aspects if a in df.columns}
    parts = []
    if "keyword" in checks:
        parts += [keyword_issues(t, lower, a, labels[a], rules) for a in aspects if a in labels and a in rules.aspects]
    if "contrast" in checks:
        parts.append(contrast_issues(t, lower, labels, rules.contrast))
    return df.withColumn("__rl_lower", F.lower(t)).withColumn("rl_issues", F.concat(*parts)).drop("__rl_lower")


def report_of_samples(samples: DataFrame, file: str, text: str, **rules) -> DataFrame:
    """:func:`validation_report` straight from the samples, each (file, row) once: they are read in one pass, issues are counted
    before anything is exploded, and only the distinct file names are shuffled."""
    counted = with_issues(samples.select("*"), text, **rules).select(F.col(file).alias("file"), F.size("rl_issues").alias("n"))
    total = counted.agg(
        F.count_distinct("file").alias("total_files"), F.count("*").alias("total_samples"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_issues"), F.count_if(F.col("n") > 0).alias("samples_with_issues"),
    )
    rate = F.when(F.col("total_samples") > 0, F.col("total_issues") / F.col("total_samples") * 100).otherwise(0.0)
    return total.select("total_files", "total_samples", "total_issues", F.round(rate, 2).alias("issue_rate_percent"), "samples_with_issues")


def validation_report(samples: DataFrame, issues: DataFrame, file: str, row: str) -> DataFrame:
    """One row: files, samples, issues, rate in percent, distinct samples with issues."""
    zero = F.lit(0).cast("bigint")
    per_file = samples.groupBy(file).agg(F.count("*").alias("n")).select(
        F.lit(1).alias("files"), F.col("n").alias("samples"), zero.alias("issues"), zero.alias("hit")
    )
    per_sample = issues.groupBy(file, row).agg(F.count("*").alias("n")).select(
        zero.alias("files"), zero.alias("samples"), F.col("n").alias("issues"), F.lit(1).alias("hit")
    )
    total = {
        name: F.coalesce(F.sum(part), zero)
        for name, part in (
            ("total_files", "files"),
            ("total_samples", "samples"),
            ("total_issues", "issues"),
            ("samples_with_issues", "hit"),
        )
    }
    rate = F.when(F.col("total_samples") > 0, F.col("total_issues") / F.col("total_samples") * 100).otherwise(0.0)
    return (
        per_file.unionByName(per_sample)
        .agg(*[c.alias(n) for n, c in total.items()])
        .select(
            "total_files",
            "total_samples",
            "total_issues",
            F.round(rate, 2).alias("issue_rate_percent"),
            "samples_with_issues",
        )
    )


def validation_breakdown(issues: DataFrame) -> DataFrame:
    """Issue counts by type, by severity and by aspect (only issues that name one)."""
    counted = issues.groupBy("type", "severity", "aspect").agg(F.count("*").alias("n"))
    dims = [
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("type", "severity", "aspect")
    ]
    return (
        counted.select(F.explode(F.array(*dims)).alias("d"), "n")
        .select("d.dimension", "d.value", "n")
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.sum("n").alias("issues"))
    )
