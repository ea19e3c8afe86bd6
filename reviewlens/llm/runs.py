"""Periodic runs of words, by a suffix automaton whose paths are recoloured word by word.

A run is a stretch with smallest period q that no neighbouring word extends. Appending word i *accesses* the automaton's state of
the first i words: every state on the path of suffix links to the root gets i as its last occurrence. The
path falls into segments that had the same last occurrence j before. If the distance p = i - j is within
a segment's longest length, the last p words occur p words earlier as well: a square of period p, which is
then extended to its run. As j is the *last* occurrence, p is the smallest period, and in a run of at
least two periods every word after these finds its period this way, so no run is missed.

The link-cut access keeps the segments of equal colour on heavy paths of the suffix-link tree, one stack
of (longest length, colour) per heavy path: recolouring replaces the top of O(log n) stacks, and what it
takes off was put there before. The cost does not depend on how deep the tree is.

Only stretches are looked at that can hold a run: in a run of at least ``least`` words and ``periods``
periods, every window of ``gram`` words occurs twice in the text. Windows are hashed in whole batches; a
shared hash only adds a stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import mixed, strings, text_of

LEAST, PERIODS = 24, 3
CHUNK = 200_000  # words hashed at once; a longer text is hashed alone


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest length and suffix link of every state, and the state of each prefix."""
    step: list[dict[int, int]] = [{}]
    length, link, prefix = [0], [-1], []
    last = 0
    for c in ids:
        new = len(length)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link.append(q)
            else:
                split = new + 1
                length.append(length[p] + 1)
                step.append(step[q].copy())
                link.append(split)
                link.append(link[q])
                link[q] = split
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = split
                    p = link[p]
        last = new
        prefix.append(new)
    return length, link, prefix


def heavy_paths(length: list[int], link: list[int]) -> list[int]:
    """The top state of each state's heavy path."""
    order = np.argsort(np.array(length), kind="stable").tolist()  # a link leads to a shorter state
    weight = [1] * len(length)
    for v in reversed(order[1:]):
        weight[link[v]] += weight[v]
    heavy = [-1] * len(length)
    for v in order[1:]:
        u = link[v]
        if heavy[u] < 0 or weight[v] > weight[heavy[u]]:
            heavy[u] = v
    top = [0] * len(length)
    for v in order[1:]:
        u = link[v]
        top[v] = top[u] if heavy[u] == v else v
    return top


def squares(ids: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of squares, at least one in every run of two periods, for each of its words after these."""
    length, link, prefix = automaton(ids)
    top = heavy_paths(length, link)
    stacks: list[list[tuple[int, int]]] = [[] for _ in length]  # by top state, shortest segment last
    for i, v in enumerate(prefix):
        while v > 0:
            head, reach = top[v], length[v]
            stack = stacks[head]
            while stack:
                longest, j = stack[-1]
                if i - j <= longest and i - j <= reach:
                    yield i, i - j
                if longest <= reach:
                    stack.pop()
                if longest >= reach:
                    break
            stack.append((reach, i))
            v = link[head]


def runs_of(ids: list[int], least: int = LEAST, periods: int = PERIODS, at: int = 0, stop: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs within ids[at:stop], by start and period; extended over all ids."""
    done: dict[int, int] = {}
    found, n = [], len(ids)
    for end, p in squares(ids[at:stop]):
        end += at
        if end <= done.get(p, -1):
            continue
        stop_at, start = end + 1, end
        while stop_at < n and ids[stop_at] == ids[stop_at - p]:
            stop_at += 1
        start = end - 2 * p + 1
        while start > 0 and ids[start - 1] == ids[start - 1 + p]:
            start -= 1
        done[p] = stop_at - 1
        if stop_at - start >= max(least, periods * p):
            found.append((start, stop_at - start, p))
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def gram_of(least: int, periods: int) -> int:
    """A run's windows of so many words overlap its copies without a gap: 2 q + gram - 1 <= length for all q."""
    gram = 1
    while gram * 2 <= min(max(least, periods * q) - 2 * q for q in range(1, least // periods + 2)) + 1:
        gram *= 2
    return gram


def stretches(words: list[list[bytes]], least: int, periods: int) -> list[list[tuple[int, int]]]:
    """Of each text the stretches (at, stop) of words that can hold a run."""
    gram = gram_of(least, periods)
    sizes = np.array([len(w) for w in words])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int]]] = [[] for _ in words]
    total = int(bounds[-1])
    if total < least:
        return out
    h = np.fromiter((hash(x) for w in words for x in w), np.int64, total).view(np.uint64)
    width = 1
    while width < gram:
        h = mixed(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
    doc = np.repeat(np.arange(len(words)), sizes)
    inside = doc[: len(h)] == doc[gram - 1 :]
    h = mixed(h + doc[: len(h)].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    place = np.flatnonzero(inside)
    order = place[np.argsort(h[place], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h) + 2, np.int8)  # one place in front and one behind
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    edge = np.diff(again)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first + gram - 1 >= least
    for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
        while a < b:  # windows of two texts can be neighbours
            d = int(doc[a])
            stop = min(b, int(bounds[d + 1]))
            out[d].append((a - int(bounds[d]), min(stop + gram - 1, int(bounds[d + 1])) - int(bounds[d])))
            a = stop
    return out


def repeated(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The words of one text in ten are made periodic; which, and how, its id decides."""
    n = len(words)
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def report(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    best = None
    for start, length, period in found:
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    kept = words
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            drop[start + period] += 1
            drop[start + length] -= 1
        kept = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    text = b" ".join(kept)
    of_best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *of_best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in found], text.decode())


def find_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS, planted: bool = False, doc_id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs; start, length, period and exponent_milli of the run with
    the most periods (ties: smallest start, then period; four nulls without a run); runs_sha256,
    collapsed_sha256; with ``whole`` also the runs themselves and the collapsed text.

    Words are what stands between ASCII white space; a null or empty text has none, so no run, and its digests are those of
    the empty text. Repeated rows are judged each. ``planted`` makes the words of some texts periodic first, by the
    doc_id (a null one never). A text of any length is judged whole, in one task, in memory of its size. An empty table
    gives no rows. No shuffle; columns other than the two named are not read.
    """
    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("name"), text_of(text).alias("text"))
    kind = dict(few.dtypes)["doc_id"]
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"][: 9 if whole else 7]
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    types = [*[pa.int64()] * 5, pa.string(), pa.string(), run_type, pa.string()]
    schema = f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string" + ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" * whole

    def judged(words: list[list[bytes]]) -> Iterator[tuple]:
        for w, spots in zip(words, stretches(words, least, periods), strict=True):
            found: set = set()
            if spots:
                number: dict[bytes, int] = {}
                ids = [number.setdefault(x, len(number)) for x in w]
                for at, stop in spots:
                    found.update(runs_of(ids, least, periods, at, stop))
            yield report(w, sorted(found, key=lambda r: (r[0], r[2])))[: len(names)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, rows = [], 0, []
            for name, t in zip(batch["name"].to_pylist(), strings(batch["text"]), strict=True):
                words = t.encode().split()  # bytes split at ASCII white space only
                words = repeated(words, name) if planted else words
                if held and size + len(words) > CHUNK:
                    rows.extend(judged(held))
                    held, size = [], 0
                held.append(words)
                size += len(words)
            rows.extend(judged(held))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *names])

    return few.mapInArrow(run, schema)
