"""Rule-based labelling: text (and rating) to one canonical label per aspect.

Every engine takes a DataFrame and adds one STRING column per aspect. Flags are computed
in their own projection before the decision table reads them, so a keyword scan runs once
per row however often its result is used, and the whole chain is one code-generated stage
with no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.labels import ASPECTS, MULTI, NOT_MENTIONED
from reviewlens.functions.payloads import reply_map
from reviewlens.functions.text import is_blank, normalise_typos, strip_ws
from reviewlens.operators.lexicon import (
    DOC_NEGATIVE,
    DOC_POSITIVE,
    GATED,
    RATING,
    SHORT_NEGATIVE,
    SHORT_POSITIVE,
    SIMPLE,
    Lexicon,
    contains_any,
    context_window,
    count_contained,
)

_TEXT = "__rl_text"  # lower-cased or normalised text while an engine runs


def _lowered(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(_TEXT, F.lower(F.coalesce(F.col(text), F.lit(""))))


def _finish(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__rl_")])


def _all_absent(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.col(f"`{n}`") == NOT_MENTIONED)
    return out


def doc_polarity(
    text: Column | str, positive: Sequence[str] = DOC_POSITIVE, negative: Sequence[str] = DOC_NEGATIVE
) -> Column:
    """POSITIVE / NEGATIVE / NEUTRAL by the larger number of distinct keywords."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    lead = count_contained(t, positive) - count_contained(t, negative)
    return F.when(lead > 0, "POSITIVE").when(lead < 0, "NEGATIVE").otherwise("NEUTRAL")


def rating_keyword_label(
    df: DataFrame, text: str, rating: str, aspects: Sequence[str] = ASPECTS, lexicon: Lexicon = RATING
) -> DataFrame:
    """The rating sets the label of every aspect; a keyword majority overrides it."""
    stars = F.coalesce(F.col(rating), F.lit(0))
    prior = F.when(stars <= 2, "-1").when(stars == 3, "0").otherwise("1")
    labels: dict[str, Column] = {}
    for a in aspects:
        words = lexicon.aspects.get(a)
        if words is None:
            labels[a] = prior
            continue
        lead = count_contained(F.col(_TEXT), words.positive) - count_contained(F.col(_TEXT), words.negative)
        labels[a] = F.when(lead > 0, "1").when(lead < 0, "-1").otherwise(prior)
    return _finish(_lowered(df, text).withColumns(labels))


def rules_simple(df: DataFrame, text: str, lexicon: Lexicon = SIMPLE) -> DataFrame:
    """Any positive and any negative word of an aspect decide; general words fill the
    first aspect when it is still open. Blank text gives 2 everywhere."""
    t = F.col(_TEXT)
    flags, labels = {}, {}
    first = next(iter(lexicon.aspects))
    for i, (a, w) in enumerate(lexicon.aspects.items()):
        flags[f"__rl_p{i}"] = contains_any(t, w.positive)
        flags[f"__rl_n{i}"] = contains_any(t, w.negative)
        pos, neg = F.col(f"__rl_p{i}"), F.col(f"__rl_n{i}")
        label = F.when(pos & neg, MULTI).when(pos, "1").when(neg, "-1")
        if a == first:
            label = label.when(contains_any(t, lexicon.positive), "1").when(
                contains_any(t, lexicon.negative), "-1"
            )
        labels[a] = label.otherwise(NOT_MENTIONED)
    return _finish(_lowered(df, text).withColumns(flags).withColumns(labels))


def rules_mention_gated(df: DataFrame, text: str, lexicon: Lexicon = GATED) -> DataFrame:
    """An aspect needs one of its keywords; then both polarities give ``[-1,1]``, one gives
    its sign, none gives 0. (A contrast pass could only repeat the first outcome.)"""
    t = F.col(_TEXT)
    flags, labels = {}, {}
    for i, (a, w) in enumerate(lexicon.aspects.items()):
        flags[f"__rl_m{i}"] = contains_any(t, w.nouns)
        flags[f"__rl_p{i}"] = contains_any(t, w.positive)
        flags[f"__rl_n{i}"] = contains_any(t, w.negative)
        pos, neg = F.col(f"__rl_p{i}"), F.col(f"__rl_n{i}")
        labels[a] = (
            F.when(~F.col(f"__rl_m{i}"), NOT_MENTIONED)
            .when(pos & neg, MULTI)
            .when(pos, "1")
            .when(neg, "-1")
            .otherwise("0")
        )
    return _finish(_lowered(df, text).withColumns(flags).withColumns(labels))


def rules_context_v1(
    df: DataFrame, text: str, lexicon: Lexicon, window: int = 50, short: int = 100
) -> DataFrame:
    """Sentiment words around the first hit of each aspect keyword.

    Only whether any window holds a positive, negative or neutral word matters, so the
    windows of an aspect are joined into one text and searched once.
    """
    t = F.col(_TEXT)
    sep = "\x01"
    windows, flags, labels = {}, {}, {}
    for i, (a, w) in enumerate(lexicon.aspects.items()):
        keywords = F.array(*[F.lit(k) for k in dict.fromkeys(w.nouns)])
        hits = F.filter(
            F.transform(keywords, lambda k: F.struct((F.instr(t, k) - 1).alias("at"), F.length(k).alias("n"))),
            lambda h: h["at"] >= 0,
        )
        around = F.transform(
            hits,
            lambda h: F.substring(
                t,
                F.greatest(h["at"] - window, F.lit(0)) + 1,
                h["at"] + h["n"] + window - F.greatest(h["at"] - window, F.lit(0)),
            ),
        )
        windows[f"__rl_w{i}"] = F.when(contains_any(t, w.nouns), F.array_join(around, sep))
        ctx = F.col(f"__rl_w{i}")
        flags[f"__rl_p{i}"] = contains_any(ctx, lexicon.positive)
        flags[f"__rl_n{i}"] = contains_any(ctx, lexicon.negative)
        flags[f"__rl_u{i}"] = contains_any(ctx, lexicon.neutral)
        pos, neg, neu = (F.col(f"__rl_{x}{i}") for x in "pnu")
        turn = neu & F.col("__rl_contrast")
        labels[a] = (
            F.when(ctx.isNull(), NOT_MENTIONED)
            .when(pos & neg, MULTI)
            .when(pos & turn, "[0,1]")
            .when(neg & turn, "[-1,0]")
            .when(pos, "1")
            .when(neg, "-1")
            .otherwise("0")
        )
    flags["__rl_contrast"] = contains_any(t, lexicon.contrast)
    out = _lowered(df, text).withColumns(windows).withColumns(flags).withColumns(labels)

    first = next(iter(lexicon.aspects))
    any_pos, any_neg = contains_any(t, lexicon.positive), contains_any(t, lexicon.negative)
    open_and_short = _all_absent(list(lexicon.aspects)) & (
        F.length(F.coalesce(F.col(text), F.lit(""))) < short
    )
    whole = F.when(any_pos & any_neg, MULTI).when(any_pos, "1").when(any_neg, "-1")
    out = out.withColumn(
        first, F.coalesce(F.when(open_and_short, whole), F.col(f"`{first}`"))
    )
    return _finish(out)


_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _near(keywords: Sequence[str], window: int) -> str:
    """Zero-width test: a whole keyword lies within ``window`` characters either side."""
    by_length: dict[int, list[str]] = {}
    for k in dict.fromkeys(keywords):
        by_length.setdefault(len(k), []).append(re.escape(k))
    tests = []
    for n, group in sorted(by_length.items()):
        words = "|".join(group)
        if n <= window:
            tests.append(f"(?=.{{0,{window - n}}}(?:{words}))")
        if n <= 2 * window:  # starts before the position, may reach across it
            tests.append(f"(?<=(?=(?:{words})).{{{max(1, n - window)},{window}}})")
    return f"(?:{'|'.join(tests)})"


def rules_context_v2(
    df: DataFrame,
    text: str,
    lexicon: Lexicon,
    window: int = 60,
    short: int = 15,
    short_positive: Sequence[str] = SHORT_POSITIVE,
    short_negative: Sequence[str] = SHORT_NEGATIVE,
) -> DataFrame:
    """Sentiment in windows around every mention, contrast words making it mixed.

    A window is part of the text, so sentiment words anywhere already fix the outcome
    except for one case: one polarity only, and a mention whose window also holds a
    contrast word. That case is one look-around pattern, tried only on such rows; no
    position lists are built, so the cost stays linear in the text.
    """
    for k in (k for _, _, k in lexicon.rows()):
        if any(ord(ch) > 0xFFFF for ch in k):
            raise ValueError(f"keyword outside the basic plane: {k!r}")
    t, bmp = F.col(_TEXT), F.col("__rl_bmp")
    flags, labels = {"__rl_c": contains_any(t, lexicon.contrast)}, {}
    for i, (a, w) in enumerate(lexicon.aspects.items()):
        flags[f"__rl_m{i}"] = contains_any(t, w.nouns)
        flags[f"__rl_p{i}"] = contains_any(t, w.positive)
        flags[f"__rl_n{i}"] = contains_any(t, w.negative)
        mention, pos, neg = (F.col(f"__rl_{x}{i}") for x in "mpn")
        sentiment = [*w.positive, *w.negative]
        mixed = F.lit(False)
        if lexicon.contrast and sentiment:
            head = F.substring(t, 1, window)
            at_start = contains_any(head, lexicon.contrast) & contains_any(head, sentiment)
            mixed = at_start
            if w.nouns:
                nouns = "|".join(map(re.escape, dict.fromkeys(w.nouns)))
                pattern = f"(?s)(?=(?:{nouns})){_near(lexicon.contrast, window)}{_near(sentiment, window)}"
                mixed = F.when(mention, bmp.rlike(pattern)).otherwise(at_start)
        labels[a] = (
            F.when(~mention & ~pos & ~neg, NOT_MENTIONED)
            .when(pos & neg, MULTI)
            .when(F.col("__rl_c") & (pos | neg) & mixed, MULTI)
            .when(pos, "1")
            .when(neg, "-1")
            .otherwise("0")
        )
    # Java's look-behind counts UTF-16 units; one stand-in per astral character restores
    # the character count.
    out = (
        df.withColumn(_TEXT, normalise_typos(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("__rl_bmp", F.regexp_replace(t, _ASTRAL, "\ufffe"))
        .withColumns(flags)
        .withColumns(labels)
    )
    first = next(iter(lexicon.aspects))
    raw = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(raw)
    is_short = F.length(strip_ws(raw)) < short
    guess = F.when(contains_any(low, short_positive), "1").when(contains_any(low, short_negative), "-1")
    out = out.withColumn(
        first,
        F.coalesce(F.when(is_short & _all_absent(list(lexicon.aspects)), guess), F.col(f"`{first}`")),
    )
    return _finish(out)


def label_cascade(
    df: DataFrame,
    text: str,
    reply: str,
    rules: Callable[[DataFrame, str], DataFrame] = rules_simple,
    aspects: Sequence[str] = ASPECTS,
) -> DataFrame:
    """Blank text gives 2; else the labels in the model's reply; else the rules."""
    parsed = F.col("__rl_reply")
    labelled = rules(df, text).withColumn("__rl_reply", reply_map(reply))
    usable = F.coalesce(F.size(parsed) > 0, F.lit(False))
    labels = {
        a: F.when(is_blank(text), NOT_MENTIONED)
        .when(usable, F.coalesce(F.element_at(parsed, a), F.lit(NOT_MENTIONED)))
        .otherwise(F.col(f"`{a}`"))
        for a in aspects
    }
    return _finish(labelled.withColumns(labels))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (a distributed top-k, no global sort)."""
    return df.orderBy(order).limit(n)


def label_with_limit(
    df: DataFrame,
    text: str,
    order: str,
    limit: int,
    rules: Callable[[DataFrame, str], DataFrame] = rules_simple,
    aspects: Sequence[str] = ASPECTS,
    keep_rest: bool = True,
) -> DataFrame:
    """Label the first ``limit`` rows only; the others stay unlabelled (2) or are left out.

    The cut is the ``limit``-th order value, found by a top-k and compared with each row, so
    nothing is shuffled but that one value. ``order`` must be unique and not null.
    """
    cut = first_rows(df.select(order).where(F.col(order).isNotNull()), order, limit).agg(F.max(order)).scalar()
    if not keep_rest:
        return rules(df.where(F.col(order) <= cut), text)
    chosen = F.coalesce(F.col(order) <= cut, F.lit(False))
    scoped = df.withColumn("rl_chosen", chosen).withColumn("rl_scope", F.when(F.col("rl_chosen"), F.col(text)))
    labels = {a: F.when(F.col("rl_chosen"), F.col(f"`{a}`")).otherwise(NOT_MENTIONED) for a in aspects}
    return rules(scoped, "rl_scope").withColumns(labels).drop("rl_scope", "rl_chosen")


def keyword_window(text: Column, position: Column, window: int = 60) -> Column:
    """The context the window rules look at."""
    return context_window(text, position, window, window)
