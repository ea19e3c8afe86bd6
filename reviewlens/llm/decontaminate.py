"""Finding benchmark text in documents with one Aho-Corasick automaton.

Texts are normalised to words: A-Z lower-cased, every other ASCII character but digits and letters becomes
a gap, gaps are one space. All windows of the benchmark items go into one automaton, framed by spaces so
that they match whole words only; a document is normalised and scanned once. A hit's place in the
normalised text gives the words it covers, and the words' places in the original text are read off when
spans are asked for.

The windows are made and parted by hash with Spark and written to the shared folder, so that a part holds about
``max_bytes`` at most. Part after part goes to the workers, each of which builds its automaton once, and is scanned over
the documents; between parts the rows, with their hits so far, are written. Neither the driver nor a worker ever holds
more than one part. A benchmark below ``max_bytes`` of windows is one part: one scan, nothing is written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import carried, lean, saved, strings, text_of

# Bytes outside a-z, 0-9 and non-ASCII are gaps; A-Z become a-z. UTF-8 never has an ASCII byte inside a
# longer character, so working on bytes is working on characters.
GAP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(GAP).split(b" ") if text else []


def normalised(text: str) -> bytes:
    """The words of a text with one space before, between and after them; only a space if there are none."""
    return b" " + b"".join(w + b" " for w in words_of(text) if w)


def windows_of(text: str, size: int) -> list[bytes]:
    """Every run of ``size`` words; of fewer words the whole; of none nothing."""
    words = [w for w in words_of(text) if w]
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def windows_by_part(items: DataFrame, size: int, max_bytes: int) -> tuple[DataFrame, int]:
    """(part, window, item) of the different windows of each item, written, and the number of parts. ``items``: item
    (text), text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), strings(batch["text"]), strict=True):
                found = list(set(windows_of(text, size)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], ["window", "item"])

    windows = saved(items.mapInArrow(run, "window binary, item string").distinct(), "benchmark-windows")
    total = windows.agg(F.sum(F.length("window") + F.length("item"))).first()[0] or 0
    parts = -(-total // max_bytes)
    return windows.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(max(parts, 1)))), parts


BUILT = [0]  # automata that this worker has built


@lru_cache(maxsize=1)
def automaton_of(key: str, windows: Broadcast) -> ahocorasick.Automaton | None:
    """The automaton of a part, built once per worker; ``key`` names the part. None for a part without windows."""
    BUILT[0] += 1
    owners: dict[bytes, list[str]] = {}
    for w, item in windows.value:
        owners.setdefault(w, []).append(item)
    out = ahocorasick.Automaton()
    for w, who in owners.items():
        out.add_word(w.decode("latin-1"), (len(w), who))
    out.make_automaton()
    return out if owners else None


def original_places(text: str) -> list[tuple[int, int]]:
    """Start and end of every word in the original text, in code points."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    first = (raw & 0xC0) != 0x80
    inside = np.frombuffer(raw.tobytes().translate(GAP), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    point = np.concatenate(([0], np.cumsum(first)))
    return [(int(point[a]), int(point[b])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def find_hits(automaton: ahocorasick.Automaton, line: bytes) -> tuple[np.ndarray, set[str]] | None:
    """Which words of a normalised text are hit, and the items found; None without a hit."""
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return None
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    change = np.zeros(len(gaps) + 1, np.int32)  # +1 where a hit begins, -1 after it ends
    ends = np.array([end for end, _ in found])
    lengths = np.array([length for _, (length, _) in found])
    np.add.at(change, np.searchsorted(gaps, ends - lengths + 1), 1)
    np.add.at(change, np.searchsorted(gaps, ends), -1)
    return np.cumsum(change)[: len(gaps) - 1] > 0, {item for _, (_, owners) in found for item in owners}


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, max_bytes: int = 16 << 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", with_spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns of ``keep``, n_words, n_hit, n_items, items_sha256, contaminated; with
    ``with_spans`` also the hit stretches of the original text as (start, end) code points, end exclusive.

    A word is hit if it lies in any occurrence of a window: ``size`` consecutive words of an item, or all
    words of a shorter item. Null texts have no words, items without words no windows. An item that stands in
    the table twice counts once; items without id count as one, whose id is written ``null``. Repeated documents are judged
    each. With an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), text_of(item_text).alias("text"))
    windows, parts = windows_by_part(named, size, max_bytes)
    few = docs.select(F.col(doc_id).alias("doc_id"), *keep, text_of(text).alias("text"))
    state = few.select("*", F.lit(None).cast("binary").alias("__hit"), F.lit(None).cast("array<string>").alias("__found"))
    for part in range(parts):
        rows = [(bytes(r["window"]), r["item"]) for r in windows.filter(F.col("part") == part).select("window", "item").collect()]  # max_bytes, about
        shared = spark.sparkContext.broadcast(rows)
        if part == parts - 1:
            return summed_up(state, shared, few, keep, with_spans)
        if rows:
            state = saved(scanned(state, shared), "benchmark-hits")
    return summed_up(state, spark.sparkContext.broadcast([]), few, keep, with_spans)


def with_hits(batch: pa.RecordBatch, automaton: ahocorasick.Automaton | None, lines: list[bytes]) -> tuple[list, list]:
    """The hits of a batch, a byte for each word, and the items found, with those of one part more."""
    hits, items = batch["__hit"].to_pylist(), batch["__found"].to_pylist()
    for i, line in enumerate(lines) if automaton else ():
        if got := find_hits(automaton, line):
            before = np.frombuffer(hits[i], bool) if hits[i] else False
            hits[i] = (got[0] | before).tobytes()
            items[i] = list({*got[1], *(items[i] or ())})
    return hits, items


def scanned(state: DataFrame, windows: Broadcast) -> DataFrame:
    """``state`` with the hits of one part added: ``__hit`` and ``__found``."""
    key = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(key, windows)
        for batch in batches:
            hits, items = with_hits(batch, automaton, [normalised(t) for t in strings(batch["text"])])
            columns = [pa.array(hits, pa.binary()) if c == "__hit" else pa.array(items, pa.list_(pa.string())) if c == "__found" else batch[c] for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return state.mapInArrow(lean(run), state.schema)


def summed_up(state: DataFrame, windows: Broadcast, few: DataFrame, keep: tuple[str, ...], with_spans: bool) -> DataFrame:
    """The result's columns out of the hits of all parts; the last part is scanned on the way."""
    key = uuid.uuid4().hex
    schema = f"{carried(few, keep)}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean" + ", spans array<struct<start:int,end:int>>" * with_spans
    names = ["doc_id", *keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *["spans"] * with_spans]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(key, windows)
        for batch in batches:
            texts = strings(batch["text"])
            lines = [normalised(t) for t in texts]
            n_words = [line.count(b" ") - 1 for line in lines]
            hits, items = with_hits(batch, automaton, lines)
            hit = [np.frombuffer(h, bool) if h else None for h in hits]
            found = [f or [] for f in items]
            n_hit = [0 if h is None else int(h.sum()) for h in hit]
            digest = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() if s else none for s in found]
            columns = [batch["doc_id"], *(batch[c] for c in keep), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(digest), pa.array([n > 0 for n in n_hit], pa.bool_())]
            if with_spans:
                columns.append(pa.array([[] if h is None else stretches(t, h) for t, h in zip(texts, hit, strict=True)], span))
            yield pa.RecordBatch.from_arrays(columns, names)

    return state.mapInArrow(lean(run), schema)


def stretches(text: str, hit: np.ndarray) -> list[dict]:
    """Neighbouring hit words as one stretch of the original text."""
    places = original_places(text)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2], strict=True)]


# Word lists are compared as text joined by spaces; the digits of item_id sort as strings.
SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT r, k, i, item_id FROM dw JOIN bw USING (k, win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
