"""Personal data in texts: fixed patterns, and boosted trees over candidate spans, in DataFrame functions.

``BASE`` patterns with their checks always count. Beside them, generators of high recall (``LOOSE``) propose
spans that may overlap: addresses written with "(at)", numbers without a plus, dotted groups and long digit
runs. Gradient-boosted trees score every candidate by its format (digits, separators, groups, check digit) and context
(the characters and words around it).

They are fitted to the corpus itself, by examples that the base patterns do not find (:func:`examples`): every base span is
written anew in the loose formats. As such it is a positive, cards and phones only behind a word that announces them; behind
a word for orders, versions and keys, or with a broken check digit, it is a negative. So are the corpus'
own candidates that no base span covers and no word announces. On examples kept out of fitting the smallest score with
enough precision is found for each kind; candidates above it are added. A candidate that a base span covers is never added.

Training takes a sample of bounded size (``max_training``); everything else covers all rows. The fitted trees become one Column
expression, so scoring stays inside the row: no Python, no explode and no shuffle on the main path.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import saved, text_of

KINDS = ("email", "ip", "card", "phone")

# The stated patterns. Repetitions are possessive, and a match begins at the start of its run of characters
# or where the last match ended: the same matches, found in linear time and without deep recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ ._-]{0,2}+[0-9]){12,18}+",
    "phone": r"(?:(?<![0-9+(])|\G)\+?\(?[0-9](?:[ ()./-]{0,3}+[0-9]){6,14}+",
}
# A text without the first of these has no match of the pattern.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": "[0-9]", "card": "[0-9][0-9 ._-]{8}", "phone": "[0-9][0-9 ()./-]{4}"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
AROUND = 24  # characters of context
CUES = {
    "email": r"(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|credit|payment",
    "phone": r"(?i)tel|phone|call|fax|mobile",
}
OTHERWISE = r"(?i)key|token|secret|password|isbn|order|version|invoice|sku"
ANNOUNCED = {"email": "contact: ", "ip": "host ", "card": "credit card ", "phone": "call "}
UNRELATED = ("order ", "version ", "invoice key ")
FORMAT = ("valid", "n_length", "n_digits", "n_letters", "n_gaps", "n_dots", "n_at", "n_distinct", "plus", "first_digit", "longest_run")
CONTEXT = ("glued_before", "glued_after", "at_end", "cue", "other_cue")
FEATURES = (*(f"is_{k}" for k in KINDS), *FORMAT, *CONTEXT)
SPAN = "array<struct<at:int,stop:int,hit:string,before:string,after:string>>"


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and not overlapping: places in code points and what stands around.

    The text between the matches has the lengths that places are counted from, so no search by position
    is needed.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(hits.alias("hit"), F.slice(between, 1, F.size(hits)).alias("before"), F.slice(between, 2, F.size(hits)).alias("after"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(held: Column, row: Column) -> Column:
        begin = held["at"] + F.length(row["before"])
        stop = begin + F.length(row["hit"])
        found = F.struct(
            begin.alias("at"), stop.alias("stop"), row["hit"].alias("hit"), F.right(row["before"], F.lit(AROUND)).alias("before"), F.left(row["after"], F.lit(AROUND)).alias("after")
        )
        return F.struct(stop.alias("at"), F.array_append(held["out"], found).alias("out"))

    return F.aggregate(rows, start, step, lambda held: held["out"])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(hit))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def valid(kind: str, hit: Column) -> Column:
    """What a number of this kind keeps in every format."""
    if kind == "card":
        return F.coalesce(luhn(digits(hit)), F.lit(False))
    if kind == "ip":
        return F.forall(F.split(hit, "[^0-9]+"), lambda x: F.coalesce(x.try_cast("int"), F.lit(999)) <= 255)
    return F.length(digits(hit)).between(8, 15) if kind == "phone" else F.lit(True)


def rewritten(kind: str, hit: Column) -> Column:
    """A base span in loose formats."""
    number = digits(hit)
    if kind == "email":
        name, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
        return F.array(F.concat(name, F.lit("(at)"), F.replace(host, F.lit("."), F.lit("(dot)"))), F.concat(name, F.lit(" [at] "), host))
    if kind == "ip":
        return F.array(F.replace(hit, F.lit("."), F.lit("[.]")), F.replace(hit, F.lit("."), F.lit("(.)")))
    if kind == "card":
        return F.array(F.regexp_replace(number, "(.{4})(?=.)", "$1."), F.regexp_replace(number, "(.{4})(?=.)", "$1_"))
    bare = F.regexp_replace(hit, r"^\+", "")
    return F.array(number, bare, F.regexp_replace(bare, "[ ()-]+", "."))


def broken(kind: str, hit: Column) -> Column:
    """A rewritten span whose check fails: another last digit, a part that is too large."""
    if kind == "card":
        last = F.right(hit, F.lit(1)).cast("int")
        return F.concat(F.left(hit, F.length(hit) - 1), F.pmod(last + 1, F.lit(10)).cast("string"))
    return F.concat(F.lit("9"), hit, F.lit("99"))


def examples(kind: str, m: Column) -> Column:
    """(candidate features, label) of what a base span ``m`` teaches."""
    plain = kind in ("email", "ip")

    def one(hit: Column, before: Column, label: float) -> Column:
        c = F.struct(m["at"].alias("at"), m["stop"].alias("stop"), hit.alias("hit"), before.alias("before"), m["after"].alias("after"))
        return F.struct(features(kind, c, None).alias("c"), F.lit(label).alias("label"))

    def of_hit(hit: Column) -> Column:
        rows = [one(hit, F.concat(m["before"], F.lit(ANNOUNCED[kind])), 1.0)]
        rows += [one(hit, m["before"], 1.0)] if plain else []
        rows += [one(hit, F.concat(m["before"], F.lit(w)), 0.0) for w in UNRELATED] if not plain else []
        rows += [one(broken(kind, hit), F.concat(m["before"], F.lit(ANNOUNCED[kind])), 0.0)] if kind in ("card", "ip") else []
        return F.array(*rows)

    return F.flatten(F.transform(rewritten(kind, m["hit"]), of_hit))


def features(kind: str, c: Column, base: Column | None) -> Column:
    """What the trees see of a candidate, and whether a base span of its kind overlaps it."""
    number = digits(c["hit"])
    longest = F.array_max(F.transform(F.split(c["hit"], "[^0-9]+"), lambda r: F.length(r)))
    values = {
        **{f"is_{k}": F.lit(float(k == kind)) for k in KINDS},
        "valid": valid(kind, c["hit"]),
        "n_length": F.length(c["hit"]),
        "n_digits": F.length(number),
        "n_letters": F.length(F.regexp_replace(c["hit"], "[^A-Za-z]", "")),
        "n_gaps": F.length(F.regexp_replace(c["hit"], r"[^ ()\[\]/_-]", "")),
        "n_dots": F.length(F.regexp_replace(c["hit"], "[^.]", "")),
        "n_at": F.length(F.regexp_replace(c["hit"], "[^@]", "")),
        "n_distinct": F.size(F.array_distinct(F.split(number, ""))),
        "plus": c["hit"].startswith("+"),
        "first_digit": F.coalesce(F.left(number, F.lit(1)).try_cast("int"), F.lit(-1)),
        "longest_run": longest,
        "glued_before": c["before"].rlike(r"[\p{L}\p{N}=_@.-]$"),
        "glued_after": c["after"].rlike(r"^[\p{L}\p{N}=_@-]"),
        "at_end": c["after"] == "",
        "cue": c["before"].rlike(CUES[kind]),
        "other_cue": c["before"].rlike(OTHERWISE),
    }
    overlaps = F.lit(False) if base is None else F.exists(base, lambda b: (b["at"] < c["stop"]) & (c["at"] < b["stop"]))
    return F.struct(c["at"].alias("at"), c["stop"].alias("stop"), overlaps.alias("known"), *(values[f].cast("double").alias(f) for f in FEATURES))


def propose(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Per row: the id, the columns of ``keep``, base_<kind> spans that pass their checks and loose_<kind> candidates with features."""
    out = docs.select(F.col(doc_id).alias("doc_id"), *keep, text_of(text).alias("text"))
    empty = F.array().cast(SPAN)
    for k in KINDS:
        needed = F.col("text").contains("@") if k == "email" else F.col("text").contains("+") if k == "phone" else F.col("text").rlike(NEEDS[k])
        out = out.withColumn(f"found_{k}", F.when(needed, located(F.col("text"), BASE[k])).otherwise(empty))
        out = out.withColumn(f"loose_{k}", F.when(F.col("text").rlike(NEEDS[k]), located(F.col("text"), LOOSE[k])).otherwise(empty))
    out = out.drop("text")
    for k in KINDS:
        out = out.withColumn(f"found_{k}", F.filter(f"found_{k}", lambda m: passes(k, m["hit"])))
    taught = [F.flatten(F.transform(f"found_{k}", partial(examples, k))) for k in KINDS]
    out = out.withColumn("examples", F.concat(*taught))
    for k in KINDS:
        out = out.withColumn(f"base_{k}", F.transform(f"found_{k}", lambda m: F.struct(m["at"], m["stop"]))).drop(f"found_{k}")
    for k in KINDS:
        out = out.withColumn(f"loose_{k}", F.transform(f"loose_{k}", lambda c: features(k, c, F.col(f"base_{k}"))))
    return out


def tree_column(node, value) -> Column:
    """A fitted tree as nested conditions; ``value(i)`` is feature i."""
    if node.subtreeDepth() == 0:
        return F.lit(node.prediction())
    split = node.split()
    return F.when(value(split.featureIndex()) <= F.lit(split.threshold()), tree_column(node.leftChild(), value)).otherwise(tree_column(node.rightChild(), value))


def score(model: GBTClassificationModel, candidate: Column) -> Column:
    """The probability that the trees give a candidate."""
    trees = zip(model.treeWeights, model._java_obj.trees(), strict=True)
    margin = reduce(lambda a, b: a + b, (F.lit(w) * tree_column(t.rootNode(), lambda i: candidate[FEATURES[i]]) for w, t in trees))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def candidates_of(proposed: DataFrame) -> DataFrame:
    """The examples of base spans, and the corpus' candidates that no base span covers and no word announces."""
    every = F.concat(*(F.col(f"loose_{k}") for k in KINDS))
    others = F.transform(F.filter(every, lambda c: ~c["known"] & (c["cue"] == 0)), lambda c: F.struct(c.alias("c"), F.lit(0.0).alias("label")))
    rows = proposed.select("doc_id", F.explode(F.concat("examples", others)).alias("e"))
    return rows.select("doc_id", "e.c", "e.label", "e.c.*")


def held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id", "c"), F.lit(5)) == 0


def fit(proposed: DataFrame, max_training: int, seed: int = 7) -> GBTClassificationModel | None:
    """Trees fitted to at most about ``max_training`` candidates, taken by a hash of id and place; None
    where the candidates are all of one class, as in an empty table."""
    rows = candidates_of(proposed).filter(~held_out())
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    rate = min(1.0, max_training / sum(counts.values()))
    taken = rows.filter(F.pmod(F.xxhash64("doc_id", "c", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20))))
    points = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(taken.select("label", *FEATURES)).select("label", "x")
    return GBTClassifier(featuresCol="x", labelCol="label", maxDepth=3, maxIter=8, maxBins=32, stepSize=0.3, seed=seed).fit(points)


def thresholds(proposed: DataFrame, model: GBTClassificationModel, precision: float) -> dict[str, float]:
    """Per kind the smallest score, in hundredths, above which enough of the held-out candidates are known;
    above 1 where there is none, so that nothing of that kind is added."""
    rows = candidates_of(proposed).filter(held_out()).withColumn("score", F.floor(score(model, F.col("c")) * 100).cast("int"))
    kind = F.coalesce(*(F.when(F.col(f"is_{k}") == 1, F.lit(k)) for k in KINDS))
    counted = rows.groupBy(kind.alias("kind"), "score").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    out = {}
    for k in KINDS:
        good = total = 0
        best = 2.0
        for r in sorted((r for r in counted if r["kind"] == k), key=lambda r: -r["score"]):
            good, total = good + r["good"], total + r["n"]
            if good >= precision * total:
                best = r["score"] / 100
        out[k] = best
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = 0.98, max_training: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns of ``keep``, base_<kind> and added_<kind>, arrays of (at, stop) in code
    points, stop exclusive, in order of place.

    Null text is empty. Repeated rows are searched each. An added span never overlaps a base span of its
    kind; spans of different kinds may overlap. Without any candidate nothing is fitted and nothing added.
    """
    proposed = saved(propose(docs, doc_id, text, keep), "pii-candidates")
    model = fit(proposed, max_training)
    limits = thresholds(proposed, model, precision) if model else {}
    place = lambda c: F.struct(c["at"], c["stop"])
    added = [
        F.transform(F.filter(f"loose_{k}", lambda c: ~c["known"] & (score(model, c) >= limits[k])), place) if limits.get(k, 2.0) <= 1 else F.array().cast("array<struct<at:int,stop:int>>")
        for k in KINDS
    ]
    return proposed.select("doc_id", *keep, *(f"base_{k}" for k in KINDS), *(a.alias(f"added_{k}") for a, k in zip(added, KINDS, strict=True)))


def written(spans: dict[str, Column]) -> Column:
    return F.array_join(F.concat(*(F.transform(spans[k], lambda s: F.concat_ws(":", F.lit(k), s["at"], s["stop"])) for k in KINDS)), ",")


def merged_with_added(kind: str) -> Column:
    return F.array_sort(F.concat(f"base_{kind}", f"added_{kind}"))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base spans per kind, the digest of the base spans, all spans, and how many were added."""
    return found.select(
        "doc_id",
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(written({k: F.col(f"base_{k}") for k in KINDS}), 256).alias("base_sha256"),
        written({k: merged_with_added(k) for k in KINDS}).alias("spans"),
        sum((F.size(f"added_{k}") for k in KINDS[1:]), F.size("added_email")).cast("long").alias("n_added"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every (at, stop, kind) span, in order of place, put as its kind in brackets; a span
    that begins inside an earlier one extends it."""
    start = F.array().cast("array<struct<at:int,stop:int,kind:string>>")

    def join(held: Column, s: Column) -> Column:
        last = F.element_at(held, -1)
        longer = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(last["at"].alias("at"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind"))))
        return F.when((F.size(held) > 0) & (F.get(held, F.size(held) - 1)["stop"] > s["at"]), longer).otherwise(F.array_append(held, s))

    whole = F.aggregate(F.array_sort(spans), start, join)
    ends = F.concat(F.array(F.lit(0)), F.transform(whole, lambda s: s["stop"]))
    before = F.transform(whole, lambda s, i: F.concat(F.substr(text, F.get(ends, i) + 1, s["at"] - F.get(ends, i)), F.lit("["), s["kind"], F.lit("]")))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(before, ""), F.substr(text, F.element_at(ends, -1) + 1, F.length(text))))
