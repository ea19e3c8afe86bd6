"""Exact set-similarity join of documents on word shingles, and its components.

Two sets link when their Jaccard similarity is at least ``percent`` / 100. A linked pair of a size level differs in at most
D elements, so if the sets are cut by hash into more than D segments, they agree on a whole segment. The
index has a list for every (level, segment, content); a list's key holds the place of its segment and the
size level, so all lists that position or size rules out are skipped without being read. Segments hold
several shingles, so passages that many documents share make few long lists. There are some segments more than D + 1, so
linked sets share several lists: a set that can share ``room`` of them with any set that it links to leaves its longest
``room`` - 1 lists (:func:`shortened`), which are those that a common passage makes, and still meets all of these.

Set relations save the rest. Equal sets are one. In rounds, for as long as these find links, every set that shares a list with
another component is compared with one member of such a list, so the work of a round grows with the sets and
not with their pairs; groups of near copies come together here, and a list within one component needs no
further look. In the lists that are left, what each set differs from the list's leader by settles many
pairs: the triangle inequality of set differences proves or excludes a link without a look at either set.
Before any two sets are brought together their sizes and sketches are: every element flips one bit of a set's
sketch, so two sketches never differ in more bits than their sets do in elements. Only pairs that are in different
components, and that all bounds leave open, are compared at last. No pair that may link is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import beside, carried, field_of, handed_back, lean, mixed, removed, saved, strings, text_of
from reviewlens.plans.session import size_batches

WORDS, PERCENT = 4, 85  # unless the caller says otherwise
CHUNK = 1 << 20  # bytes of text worked on at once
PIECE = 1 << 17  # bytes of text hashed at once, up to the end of a word
FLUSH = 1 << 21  # list entries that a task holds before it sends them on
RANGE = 1 << 19  # entries that one task of the index receives, about
SKETCH = tuple(f"s{i}" for i in range(8))  # columns of 64 bits
HEAVY = 64  # entries of one list in one task beyond which the task keeps them together
# Fixed conversion: A-Z to a-z, white space to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 9 <= b <= 13 else b for b in range(256))
STEP = 0x9E3779B97F4A7C15
U = np.uint64
LOW = np.uint32((1 << 31) - 1)
EVEN = U((1 << 64) - 2)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse, modulo 2 ** 64."""
    out = []
    for base in (STEP, pow(STEP, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * U(STEP))


def word_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of folded text that ends in a space; memory follows ``PIECE``, not the text."""
    starts, hashes, at = [], [], 0
    while at < len(line):
        end = line.find(b" ", at + PIECE) + 1 or len(line)
        raw = np.frombuffer(line, np.uint8, end - at, at)
        inside = raw != 0x20
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        start, stop = edges[::2], edges[1::2]
        up, down = powers(1 << max(len(raw).bit_length(), 18))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], dtype=np.uint64)))
        starts.append(start + at)
        hashes.append(mixed((total[stop] - total[start]) * down[start]))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def sets_of(texts: list[str], words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each text that has words, and its distinct shingles' hashes in order."""
    held, parts, size = [], [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass").translate(FOLD) + b" "
        held.append(i)
        parts.append(raw)
        size += len(raw)
        if size < CHUNK and i < len(texts) - 1:
            continue
        start, h = word_hashes(b"".join(parts))
        last = np.searchsorted(start, np.cumsum([len(p) for p in parts]))
        grams = h.copy()
        for j in range(1, min(words, len(h))):
            grams[: len(h) - j] = mixed(grams[: len(h) - j] * U(STEP) + h[j:])
        for i_text, a, b in zip(held, [0, *last[:-1].tolist()], last.tolist(), strict=True):
            if b - a >= words:
                yield i_text, np.unique(grams[a : b - words + 1])
            elif b > a:
                yield i_text, np.frombuffer(hashlib.md5(h[a:b].tobytes()).digest()[:8], np.uint64)
        held, parts, size = [], [], 0


@lru_cache(maxsize=2)
def levels(percent: int) -> np.ndarray:
    """Smallest size of each level; sizes that can link are of the same or of neighbouring levels."""
    out = [1, 2]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
    return np.array(out)


def differences(level: np.ndarray, percent: int) -> np.ndarray:
    """The most elements in which a pair differs whose smaller set is of this level."""
    return (levels(percent)[level + 1] - 1) * (100 - percent) // percent


@dataclass
class Cut:
    """Sets cut into the segments of one level each: the level, the most differences of a linked pair (0: only equal sets
    link, no lists), the number of segments, and the filled segments by owner, place and first shingle."""

    level: np.ndarray
    most: np.ndarray
    segments: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    first: np.ndarray
    filled: np.ndarray


def cuts_of(sets: list[np.ndarray], percent: int) -> Iterator[Cut]:
    """Every set at its own level and at the one below, where it can be the larger of a pair."""
    sizes = np.array([len(s) for s in sets])
    high = np.concatenate(sets) >> U(32)
    own_level = np.searchsorted(levels(percent), sizes, side="right") - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    for shift in (0, 1):
        level = own_level - shift
        most = np.where(level >= 0, differences(np.maximum(level, 0), percent), 0)
        if not most.any():
            continue
        segments = np.where(most > 0, most + 6 + most // 16, 1)
        place = (high * segments[owner].astype(np.uint64)) >> U(32)  # in order within a set
        first = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(place.astype(np.int64)) != 0))))
        yield Cut(level, most, segments, owner[first], place[first], first, np.bincount(owner[first], minlength=len(sets)))


def rooms(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """How many lists each set shares at least with any set that it links to, at its levels of even and of odd number."""
    out = np.zeros((2, len(sets)), np.int64)
    for c in cuts_of(sets, percent) if sets else ():
        # differences spoil at most ``most`` segments; a set with too few filled ones has lists for its empty ones too
        room = np.where(c.most > 0, np.where(c.filled > c.most, c.filled, c.segments) - c.most, 0)
        np.put(out, (c.level & 1) * len(sets) + np.arange(len(sets)), np.where(c.most > 0, room, out[c.level & 1, np.arange(len(sets))]))
    return out


def list_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lists that each set goes to, their last bit that of the level, and the number of the set."""
    flat = mixed(np.concatenate(sets))
    keys, owners = [], []
    for c in cuts_of(sets, percent):
        content = np.add.reduceat(flat, c.first)
        tag = mixed((c.level[c.owner].astype(np.uint64) + U(1)) * U(STEP) ^ (c.place << U(32)))
        kept = c.most[c.owner] > 0
        odd = (c.level & 1).astype(np.uint64)
        keys.append((mixed(content + tag) & EVEN | odd[c.owner])[kept])
        owners.append(c.owner[kept])
        # A set with too few filled segments may agree with another such set on empty ones alone.
        for i in np.flatnonzero((c.most > 0) & (c.filled <= c.most)):
            empty = np.setdiff1d(np.arange(c.segments[i], dtype=np.uint64), c.place[c.owner == i])
            tag = mixed((c.level[i : i + 1].astype(np.uint64) + U(1)) * U(STEP) ^ (empty << U(32)))
            keys.append(mixed(tag + U(1)) & EVEN | odd[i])
            owners.append(np.full(len(empty), i))
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def number_of(shingles: np.ndarray) -> int:
    """The number of a set, from its elements alone; like the elements' own hashes, of 64 bits."""
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def measured(docs: DataFrame, words: int, percent: int, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """doc_id, the columns of ``keep``, n, the number of the set (null where it is empty) and its rooms of every row.
    ``text`` may be a field of a column of ``keep``."""
    sent, where = beside(keep, text)
    docs = docs.select("doc_id", *keep, *sent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, number = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            room = np.zeros((2, batch.num_rows), np.int64)
            some, who = [], []

            def measure() -> None:
                room[:, who] = rooms(some, percent)
                some.clear(), who.clear()

            for i, s in sets_of(strings(field_of(batch, where)), words):
                n[i], number[i] = len(s), number_of(s)
                some.append(s), who.append(i)
                if sum(map(len, some)) > CHUNK // 4:
                    measure()
            measure()
            columns = [batch["doc_id"], *(batch[c] for c in keep), pa.array(n), pa.array(number, pa.int64()), *map(pa.array, room)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "n", "number", "room_0", "room_1"])

    return docs.mapInArrow(lean(run), f"{carried(docs, keep)}, n bigint, number bigint, room_0 bigint, room_1 bigint")


def index_entries(docs: DataFrame, ranges: int, heavy: int, words: int, percent: int) -> DataFrame:
    """List entries packed by range of keys: part, keys, owner (place in ids, top bit: stands for a list kept
    by its task), ids, which are numbers of sets. A list that is long within a task is a part of its own, and only its smallest
    set goes to the common index, so no task receives an unbounded list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, owners, ids, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.concatenate([np.zeros(0, np.uint64), *keys])
            if not len(key):  # no set, or only sets that are too small for lists
                keys.clear(), owners.clear(), ids.clear()
                return
            doc, owner = np.array(ids, np.int64), np.concatenate(owners).astype(np.uint32)
            order = np.lexsort((doc[owner], key))
            key, owner = key[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            length = np.diff(np.concatenate((first, [len(key)])))
            rows = []
            keep = np.ones(len(key), bool)
            for a, n in zip(first[length > heavy].tolist(), length[length > heavy].tolist(), strict=True):
                rows.append((-1 - int(key[a] >> U(1)), key[a : a + n].tobytes(), np.arange(n, dtype=np.uint32).tobytes(), doc[owner[a : a + n]].tobytes()))
                keep[a + 1 : a + n] = False
                owner[a] |= np.uint32(1 << 31)
            key, owner = key[keep], owner[keep]
            part = ((key >> U(32)) * U(ranges)) >> U(32)
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                used, place = np.unique(owner[a:b] & LOW, return_inverse=True)  # a row carries its own sets only
                rows.append((int(part[a]), key[a:b].tobytes(), (place.astype(np.uint32) | owner[a:b] & ~LOW).tobytes(), doc[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], ["part", "keys", "owner", "ids"])
            keys.clear(), owners.clear(), ids.clear()

        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            some, who = [], []
            for i, s in sets_of(strings(batch["text"]), words):
                number = number_of(s)
                if number not in seen and doc_ids[i] is not None:
                    seen.add(number)
                    some.append(s)
                    who.append(number)
                    size += len(s)
                if some and sum(map(len, some)) > CHUNK // 4 or size > FLUSH:
                    k, o = list_keys(some, percent)
                    keys.append(k), owners.append(o + len(ids)), ids.extend(who)
                    some, who = [], []
                    if size > FLUSH:
                        yield from flush()
                        size = 0
            if some:
                k, o = list_keys(some, percent)
                keys.append(k), owners.append(o + len(ids)), ids.extend(who)
        yield from flush()

    return docs.mapInArrow(lean(run), "part bigint, keys binary, owner binary, ids binary")


def lists_of(entries: DataFrame) -> DataFrame:
    """(key, doc, weight) of the lists that hold two documents or more; of lists of a level that hold the same ones, one,
    which weighs as many as they are."""

    def found(table: pa.Table) -> pa.Table:
        key, doc, flag = [], [], []
        for k, o, ids in zip(*(table[c].to_pylist() for c in ("keys", "owner", "ids")), strict=True):
            o = np.frombuffer(o, np.uint32)
            key.append(np.frombuffer(k, np.uint64))
            doc.append(np.frombuffer(ids, np.int64)[o & LOW])
            flag.append(o >> np.uint32(31))
        key, doc, flag = np.concatenate(key), np.concatenate(doc), np.concatenate(flag)
        order = np.argsort(key, kind="stable")
        key, doc, flag = key[order], doc[order], flag[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.concatenate((first, [len(key)])))
        members = np.add.reduceat(mixed(doc.astype(np.uint64) * U(STEP) + U(1)), first)
        flagged = np.add.reduceat(flag, first) > 0
        members[flagged] ^= key[first][flagged]
        _, one, alike = np.unique(np.stack([members, length.astype(np.uint64), key[first] & U(1)]), axis=1, return_index=True, return_counts=True)
        weight = np.zeros(len(first), np.int64)
        weight[one] = alike
        keep = np.repeat((weight > 0) & ((length > 1) | flagged), length)
        return pa.table({"key": pa.array(key[keep].view(np.int64)), "doc": pa.array(doc[keep]), "weight": pa.array(np.repeat(weight, length)[keep])})

    def run(table: pa.Table) -> pa.Table:
        out = found(table)
        handed_back()
        return out

    return entries.groupBy("part").applyInArrow(run, "key bigint, doc bigint, weight bigint")


def shortened(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, doc) of ``lists`` without the longest lists of each set, as many as it can spare at each of its two levels.

    Linked sets share lists of a total weight of at least either one's room. Lists are left from the longest
    on (ties: by key), by every set in the same order, so of a pair's common lists the shortest stays in both.
    """
    room = sizes.filter("number IS NOT NULL").groupBy(F.col("number").alias("doc")).agg(F.first("room_0").alias("room_0"), F.first("room_1").alias("room_1"))
    length = lists.groupBy("key").agg(F.count("*").alias("length"))
    odd = F.col("key").bitwiseAND(F.lit(1))
    rows = lists.join(length, "key").join(room, "doc").withColumn("odd", odd)
    spent = F.sum("weight").over(Window.partitionBy("doc", "odd").orderBy(F.desc("length"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("spent", spent).filter(F.col("spent") >= F.when(F.col("odd") == 0, F.col("room_0")).otherwise(F.col("room_1")))
    return kept.select("key", "doc")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits that are set where an odd number of elements falls, as signed 64-bit words."""
    odd = np.bincount((hashes & U(64 * len(SKETCH) - 1)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_by_id(docs: DataFrame, needed: DataFrame, owners: DataFrame, words: int) -> DataFrame:
    """(id, set, n, sketch) of the sets of ``needed`` (doc), each from the whole text of the smallest doc_id of ``owners``
    (doc_id, number) that has it."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(number_of(s), s.tobytes(), len(s), sketch(s)) for _, s in sets_of(strings(batch["text"]), words)]
            bits = np.array([r[3] for r in rows], np.int64).reshape(-1, len(SKETCH))
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), *map(pa.array, bits.T)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "set", "n", *SKETCH])

    wanted = needed.select("doc").distinct()
    first = owners.groupBy("number").agg(F.min("doc_id").alias("doc_id")).join(wanted.withColumnRenamed("doc", "number"), "number", "left_semi")
    chosen = docs.join(first, "doc_id", "left_semi")
    found = chosen.mapInArrow(lean(sets), "id bigint, set binary, n bigint" + "".join(f", {c} bigint" for c in SKETCH))
    return found.join(wanted.withColumnRenamed("doc", "id"), "id", "left_semi").dropDuplicates(["id"])


def close(a: Column, b: Column, percent: int, *distances: Column) -> Column:
    """Whether two sets, as rows with ``n`` and the sketch, may link: a link allows a pair to differ in at most
    (100 - percent) * (n_a + n_b) / (100 + percent) elements, and sizes, sketches and ``distances`` never
    differ in more than the sets do."""
    flipped = sum((F.bit_count(a[c].bitwiseXOR(b[c])) for c in SKETCH[1:]), F.bit_count(a[SKETCH[0]].bitwiseXOR(b[SKETCH[0]])))
    most = (100 - percent) * (a["n"] + b["n"])
    return (100 + percent) * F.greatest(F.abs(a["n"] - b["n"]), flipped, *distances) <= most


def plausible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave open; sets themselves are not moved for that."""
    facts = known.select("id", F.struct("n", *SKETCH).alias("f"))
    both = pairs.join(facts.toDF("a", "f_a"), "a").join(facts.toDF("b", "f_b"), "b")
    return saved(both.filter(close(F.col("f_a"), F.col("f_b"), percent)).select("a", "b"), "jaccard-plausible")


def compared(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (a, b) with the sizes of both sets and of their intersection. Only sets of such pairs are moved, and
    of each pair its own two."""

    def overlap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros((3, batch.num_rows), np.int64)
            for i, (x, y) in enumerate(zip(batch["set_a"], batch["set_b"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                n[:, i] = len(x), len(y), int((y[at] == x).sum())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *map(pa.array, n)], ["a", "b", "n_a", "n_b", "common"])

    open_ones = plausible(pairs, known, percent)
    ends = open_ones.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    both = ends.join(known.select("id", "set"), "id").groupBy("a", "b").agg(F.min_by("set", F.col("id") == F.col("b")).alias("set_a"), F.max_by("set", F.col("id") == F.col("b")).alias("set_b"))
    out = saved(both.mapInArrow(lean(overlap), "a bigint, b bigint, n_a bigint, n_b bigint, common bigint"), "jaccard-compared")
    removed(open_ones)
    return out


def linked(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))


def starred(edges: DataFrame) -> bool:
    """Whether every larger end u of the edges has one smaller neighbour v, and that has no smaller one."""
    many = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return not many.union(chained).agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """u, v, written: the smallest node v that each node u of an edge (a, b) reaches; a smallest node itself has no row.

    Alternates two star operations until only stars are left: every node's larger neighbours, then its
    smaller ones, are tied to the smallest node near it. Each round is written, so no lineage grows.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not starred(now):
        before = now
        both = now.union(now.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        now = saved(small.union(least.select("u", "least")).distinct(), "edges")
        removed(before)
    return now


def merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """``root`` (node, root) after new links (a, b): only the roots that the links tie together are looked at,
    so a turn costs what it adds and not what was known before."""
    at_a = root.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    at_b = root.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    ends = links.join(at_a, "a", "left").join(at_b, "b", "left")
    tied = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = root.join(tied.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = saved(moved.union(tied), "jaccard-root")
    removed(tied, *([root] if hasattr(root, "saved_at") else []))
    return out


def set_groups(docs: DataFrame, words: int, percent: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, n and number, and (doc_id, number, root) of every doc_id and set of it: sets have the same
    root if links tie them together. ``docs``: doc_id (bigint), text (not null). Bounds the session's Arrow batches."""
    size_batches(docs.sparkSession)
    sizes = saved(measured(docs, words, percent), "jaccard-sizes")
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, rows * 23 * (100 - percent) // (10 * percent) // RANGE)  # a set has about 2 * (100 - percent) / percent entries an element
    owners = saved(sizes.filter("number IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "number").distinct(), "jaccard-owners")
    every = saved(lists_of(index_entries(docs, ranges, heavy, words, percent)).distinct(), "jaccard-lists")
    lists = saved(divided(shortened(every, sizes).withColumn("root", F.col("doc"))), "jaccard-open")
    removed(every)
    known = saved(sets_by_id(docs, lists, owners, words), "jaccard-sets")
    root = docs.sparkSession.createDataFrame([], "node bigint, root bigint")

    def narrowed(root: DataFrame, lists: DataFrame) -> DataFrame:
        out = saved(divided(rooted(lists.drop("root"), root)), "jaccard-open")
        removed(lists)
        return out

    turn, productive = 0, True
    while productive:
        found = compared(partners(lists, turn), known, percent)
        links = found.filter(linked(percent)).select("a", "b")
        productive = links.count() * 20 > lists.select("doc").distinct().count()  # else the last step is cheaper than rounds
        root = merged(root, links)
        lists = narrowed(root, lists)
        removed(found)
        turn += 1
    leads = lists.groupBy("key").agg(F.min("doc").alias("lead"))
    led = saved(lists.join(leads, "key").filter("doc <> lead"), "jaccard-led")
    stars = compared(led.select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct(), known, percent)
    root = merged(root, stars.filter(linked(percent)).select("a", "b"))
    rest = open_pairs(divided(rooted(led.drop("root"), root)), stars, known, percent)
    last = compared(rest.filter("NOT sure").select("a", "b"), known, percent)
    root = merged(root, rest.filter("sure").select("a", "b").union(last.filter(linked(percent)).select("a", "b")))
    placed = owners.join(root.withColumnRenamed("node", "number"), "number", "left")
    out = saved(placed.select("doc_id", "number", F.coalesce("root", "number").alias("root")), "jaccard-placed")
    removed(lists, led, known, stars, rest, last, owners, root)
    return sizes, out


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set is its distinct shingles of ``words`` words; of fewer words the whole sequence; without
    words (null text too) it is empty and linked with nothing. Repeated rows of a doc_id are one document
    that has the links of all its texts, and get a row each. A null doc_id takes no part and has no
    component. An empty table gives no rows.
    """
    few = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    sizes, placed = set_groups(few, words, percent, heavy)
    first = placed.groupBy("root").agg(F.min("doc_id").alias("first"))
    named = saved(placed.join(first, "root").select("doc_id", "first").distinct(), "jaccard-named")
    # A doc_id with several texts ties their groups together.
    least = named.groupBy("doc_id").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least <> most").select("doc_id", "least")
    tied = components(named.join(least, "doc_id").select(F.col("first").alias("a"), F.col("least").alias("b")))
    top = named.join(tied.toDF("first", "top"), "first", "left").select("doc_id", F.coalesce("top", "first").alias("component")).distinct()
    moved = top.filter("doc_id <> component")
    return sizes.join(moved, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int, percent: int, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` (doc_id bigint, text and others) without near copies: of the rows whose texts links tie together
    the one with the smallest doc_id stays, of several of these one, by the order of their values. Texts count,
    not ids: rows that share a doc_id but not a text are different rows. Without words only rows of equal doc_id and
    text are copies. Rows without doc_id all stay."""
    few = docs.select("doc_id", text_of("text").alias("text"))
    _, placed = set_groups(few, words, percent, heavy)
    chosen = placed.groupBy("root").agg(F.min(F.struct("doc_id", "number")).alias("first")).select("first.*")
    near = docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = measured(near.select("doc_id", F.struct(*docs.columns).alias("row")), words, percent, ("row",), "row.text")
    worded = rows.join(chosen, ["doc_id", "number"], "left_semi").groupBy("doc_id", "number").agg(F.min("row").alias("row"))
    # Rows without words: none of their characters is anything but white space.
    empty = docs.filter(~text_of("text").rlike("[^\\x20\\x09-\\x0D]") & F.col("doc_id").isNotNull())
    bare = empty.groupBy("doc_id", text_of("text").alias("text")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return worded.select("row.*").union(bare.select("row.*")).union(docs.filter("doc_id IS NULL"))


def rooted(lists: DataFrame, root: DataFrame) -> DataFrame:
    """Each row with the component of its set, itself where it has none yet."""
    return lists.join(root.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))


def divided(lists: DataFrame) -> DataFrame:
    """The rows (key, doc, root) of lists that hold more than one component."""
    split = lists.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return lists.join(split, "key", "left_semi")


def partners(lists: DataFrame, turn: int) -> DataFrame:
    """One pair for every document of a divided list: with the member that comes first by a hash of this
    turn, or by number in the first turn, in one of the lists where that is of another component."""
    place = F.xxhash64("doc", F.lit(turn)) if turn else F.col("doc")
    first = lists.groupBy("key").agg(F.min_by(F.struct("doc", "root"), place).alias("first"))
    other = lists.join(first, "key").filter("root <> first.root").select("doc", F.col("first.doc").alias("other"))
    chosen = other.groupBy("doc").agg(F.min_by("other", F.xxhash64("other", F.lit(turn)) if turn else F.col("other")).alias("other"))
    return chosen.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


FIRST_KEYS = 24  # of a set's lists, by key, that tell whether a pair has met in an earlier list


def open_pairs(led: DataFrame, stars: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sure) of a divided list that are in different components and that neither sizes, sketches nor their
    distances to the list's leader rule out; ``sure`` where the distances prove the link.

    Sets that share many lists meet in the first of them only: a row carries the first of its set's lists, and a
    pair is passed over where these have an earlier list in common. In the first list that they share they have
    none, so every pair is met at least once.
    """
    far = stars.select(F.col("a").alias("lead"), F.col("b").alias("doc"), (F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("d"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("key"))
    firsts = led.select("doc", "key").distinct().withColumn("place", place).filter(F.col("place") <= FIRST_KEYS).groupBy("doc").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    facts = known.select(F.col("id").alias("doc"), "n", *SKETCH)
    members = saved(led.join(far, ["lead", "doc"], "left").join(facts, "doc").join(firsts, "doc").select("key", F.struct("doc", "root", "d", "keys", "n", *SKETCH).alias("m")), "jaccard-members")
    both = members.toDF("key", "a").join(members.toDF("key", "b"), "key")
    a, b = F.col("a"), F.col("b")
    # a distance that was not measured excludes and proves nothing
    apart = F.coalesce(F.abs(a["d"] - b["d"]), F.lit(0))
    met = F.coalesce(F.array_min(F.array_intersect(a["keys"], b["keys"])) < F.col("key"), F.lit(False))
    open_ones = both.filter((a["doc"] < b["doc"]) & (a["root"] != b["root"]) & close(a, b, percent, apart) & ~met)
    sure = F.coalesce((100 + percent) * (a["d"] + b["d"]) <= (100 - percent) * (a["n"] + b["n"]), F.lit(False))
    out = open_ones.select(a["doc"].alias("a"), b["doc"].alias("b"), sure.alias("sure")).groupBy("a", "b").agg(F.max("sure").alias("sure"))
    out = saved(out, "jaccard-pairs")
    removed(members)
    return out


SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM s WHERE len(s) > 0),
c AS MATERIALIZED (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN c USING (g) JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)
"""
SQL = SQL.strip().replace("WITH w AS", "WITH RECURSIVE w AS", 1) + """,
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a WHERE r.root < l.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id FROM s JOIN (SELECT node, min(root) AS m FROM r GROUP BY node) ON node = doc_id
"""
