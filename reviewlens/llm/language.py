"""Language identification with spans for mixed texts.

A word's script leaves the languages that were seen in that script; each gives the word the sum of its
letter-trigram log probabilities. A Viterbi path over the words, which pays ``PENALTY`` for each change of
language, labels spans. The language with most letters is the text's; its share of all letters is the score.

Learning counts trigrams on a sample of labelled texts of bounded size; each trigram falls into one of
``BUCKETS``, so a model is languages x ``BUCKETS`` numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import beside, carried, field_of, lean, strings
from reviewlens.plans.session import size_batches

BUCKETS = 1 << 16
PENALTY = 12.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.001  # of a language's letters, from which on it is a candidate in a script
CHUNK = 1 << 20  # code points worked on at once
BARRED = np.float32(-1e4)
UNKNOWN = "und"
# First code point of each block group; letters of a group are one script. Fixed values of Unicode.
SCRIPTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2C00, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0x10000, 0x20000)
SAME = {0x1E00: 0x0, 0x1F00: 0x370, 0xF900: 0x3400, 0x20000: 0x3400, 0xFB50: 0x600}


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: number of its script (0: no letter), and its lower case where that is one character."""
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.searchsorted(SCRIPTS, np.arange(0x110000), side="right").astype(np.uint8)
    for block, to in SAME.items():
        script[script == SCRIPTS.index(block) + 1] = SCRIPTS.index(to) + 1
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x2000):
        if len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    return np.where(letters, script, 0).astype(np.uint8), lower


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Words:
    """The words of some code points: trigram buckets of all letters, and per word its place and script."""

    buckets: np.ndarray
    first: np.ndarray  # index of each word's first letter among the letters
    start: np.ndarray
    stop: np.ndarray
    script: np.ndarray


def words_of(points: np.ndarray) -> Words:
    scripts, lower = letter_tables()
    kind = scripts[points]
    inside = kind > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, stop = edges[::2], edges[1::2]
    low = np.zeros(len(points) + 2, np.uint32)
    low[1:-1] = np.where(inside, lower[points], 0)
    at = np.flatnonzero(inside)
    mix = low[at] * np.uint32(0x9E3779B1) ^ low[at + 1] * np.uint32(0x85EBCA77) ^ low[at + 2] * np.uint32(0xC2B2AE3D)
    mix ^= mix >> np.uint32(15)
    buckets = (mix * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    first = np.concatenate(([0], np.cumsum(stop - start)[:-1])).astype(np.int64) if len(start) else np.zeros(0, np.int64)
    return Words(buckets, first, start, stop, kind[start])


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages


def chunks_of(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts run together, a gap after each: their numbers, their ends, the code points."""
    held, parts, size = [], [], 0
    for i, t in enumerate(texts):
        held.append(i)
        parts.append(points_of(t + "\n"))
        size += len(parts[-1])
        if size >= CHUNK or i == len(texts) - 1:
            yield held, np.cumsum([len(p) for p in parts]), np.concatenate(parts)
            held, parts, size = [], [], 0


def learn(rows: DataFrame, max_training: int = 2000) -> Model:
    """A model from labelled rows (doc_id, text, lang).

    At most about ``max_training`` texts of each language are read, chosen by a hash of doc_id; null
    languages and null texts teach nothing. Without any labelled row the model has no language.
    """
    labelled = rows.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    whole = 1 << 20
    rate = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(whole * min(1.0, max_training / n))))), F.col("lang"))
    taken = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < rate).select("lang", "text")
    number = {k: i for i, k in enumerate(languages)}
    n_scripts = len(SCRIPTS) + 1

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), BUCKETS + n_scripts), np.int64)
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lang, t in zip(langs, strings(batch["text"]), strict=True):
                w = words_of(points_of(t))
                seen[number[lang], :BUCKETS] += np.bincount(w.buckets, minlength=BUCKETS)
                seen[number[lang], BUCKETS:] += np.bincount(w.script, (w.stop - w.start).astype(float), n_scripts).astype(np.int64)
        lang, slot = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(seen[lang, slot])], ["lang", "slot", "n"])

    got = taken.mapInArrow(count, "lang int, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((len(languages), BUCKETS + n_scripts))
    seen[got["lang"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    grams, scripts = seen[:, :BUCKETS], seen[:, BUCKETS:]
    scores = np.log((grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).T.astype(np.float32)
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)) & (scripts > 0)
    return Model(languages, np.ascontiguousarray(scores), allowed.T.copy())


def paths(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best language of every word under the switching penalty; ``starts`` and ``lengths`` are the
    texts' stretches of ``scores``. All texts take a step at a time together, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    back = np.zeros(scores.shape, np.int16)
    out = np.zeros(len(scores), np.int16)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    best = scores[starts].astype(np.float64)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, int(lengths[0])):
        n = active[t]
        b = best[:n]
        top = b.argmax(1)
        switch = (b[np.arange(n), top] - PENALTY)[:, None]
        back[starts[:n] + t] = np.where(switch > b, top[:, None], own)
        best[:n] = np.maximum(b, switch) + scores[starts[:n] + t]
    now = best.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        out[at] = now[:n]
        now[:n] = back[at, now[:n]] if t else now[:n]
    return out


def label(model: Model, w: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A language for every word; texts are the stretches ``first`` to ``last`` of the words.

    Where no stretch of words gains as much as half a switch by leaving the text's best single language,
    that language is the whole path, and no path is searched.
    """
    scores = np.add.reduceat(model.scores[w.buckets], w.first, axis=0)
    allowed = model.allowed[w.script]
    scores = np.where(allowed | ~allowed.any(1, keepdims=True), np.where(allowed.any(1, keepdims=True), scores, 0), BARRED)
    out = np.zeros(len(scores), np.int16)
    hard = []
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if a == b:
            continue
        s = scores[a:b].astype(np.float64)
        best = int(s.sum(0).argmax())
        run = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(run, axis=0), 0)
        gain = max(float((run[1:] - low[:-1]).max(initial=0)), float(run[0].max()))
        out[a:b] = best
        if gain > PENALTY / 2:
            hard.append(i)
    if hard:
        pick = np.array(hard)
        found = paths(scores, first[pick], (last - first)[pick])
        for i in hard:
            out[first[i] : last[i]] = found[first[i] : last[i]]
    return out


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", with_spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns of ``keep``, lang_pred, score and n_spans; with ``with_spans`` also the spans
    (start, stop, lang) in code points.

    A null text, or one without a letter, is ``und`` with score 0, as is every text under a model without
    languages. Words of a script that no language was seen in count as letters of none. Equal languages go
    to the first in order of name. Repeated rows are labelled each; texts are read whole. ``text`` may be a
    field of a column of ``keep``. Bounds the session's Arrow batches (:func:`size_batches`).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size_batches(docs.sparkSession)
    sent, where = beside(keep, text)
    few = docs.select(F.col(doc_id).alias("doc_id"), *keep, *sent)
    schema = f"{carried(few, keep)}, lang_pred string, score double, n_spans bigint" + ", spans array<struct<start:int,stop:int,lang:string>>" * with_spans
    names = ["doc_id", *keep, "lang_pred", "score", "n_spans", *["spans"] * with_spans]
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        k = len(m.languages)
        for batch in batches:
            n = batch.num_rows
            pred, score, spans, n_spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)], np.zeros(n, np.int64)
            for held, ends, points in chunks_of(strings(field_of(batch, where))) if k else ():
                w = words_of(points)
                if not len(w.start):
                    continue
                last = np.searchsorted(w.start, ends)
                first = np.concatenate(([0], last[:-1]))
                path = label(m, w, first, last)
                size = (w.stop - w.start) * m.allowed[w.script, path]
                for i, a, b, began in zip(held, first.tolist(), last.tolist(), [0, *ends[:-1].tolist()], strict=True):
                    if a == b:
                        continue
                    letters = np.bincount(path[a:b], size[a:b].astype(float), k)
                    top = int(letters.argmax())
                    pred[i], score[i] = m.languages[top], letters[top] / float((w.stop[a:b] - w.start[a:b]).sum())
                    turn = np.flatnonzero(np.diff(path[a:b])) + 1
                    n_spans[i] = len(turn) + 1
                    if with_spans:
                        cuts = [a, *(turn + a).tolist(), b]
                        spans[i] = [{"start": int(w.start[c]) - began, "stop": int(w.stop[d - 1]) - began, "lang": m.languages[path[c]]} for c, d in zip(cuts, cuts[1:], strict=False)]
            columns = [batch["doc_id"], *(batch[c] for c in keep), pa.array(pred, pa.string()), pa.array(score), pa.array(n_spans)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span)][: len(names)], names)

    return few.mapInArrow(lean(run), schema)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
