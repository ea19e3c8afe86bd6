"""Alignment of two tokenizers' tokens, with corpus-wide counts of the id pairs it links.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut a text into groups; within a group every A
token is linked with every B token. A pair of ids is counted once for each document that holds it linked.

Counting spills. A task gathers the (pair, document) records of a chunk of documents, sorts them with the
A side as the major key, parts them by ``RADICES`` values of that side, and writes one zstd run per part: its
pairs with their number of documents, and beside them the documents of each pair. Runs of a part are then
merged with a heap, ``FAN`` at a time, in as many levels as it takes: merging sums documents per pair, so
what moves is one entry per distinct pair of a run and not one per document, and a pair that every document
holds is no larger than others. In the last run of a part all pairs of an A id are neighbours, which yields
its highest count. Counts then go back the way the runs came, each run taking those of its own pairs, and
each chunk sums them up for its documents.

No task sees more than a chunk, ``FAN`` runs of one part, or one part's distinct pairs (bounded by the two vocabularies).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import MEMORIES, saved
from reviewlens.llm.tokens import byte_of_mark

RADICES = 64  # parts, a power of two
FAN = 64  # runs merged at once
RECORDS = 3_000_000  # links of a chunk; a document that has more is a chunk of its own
TEXT = 1 << 21  # characters tokenized at once
EXPANDED = 1024  # links of a group that are written out one by one; of larger groups distinct ids are combined
DOC_BITS = 24  # documents of a chunk
CHUNKS = 1 << 24  # chunk numbers are task number * CHUNKS + count within the task


# Fixed value: the splitting rule of byte-level vocabularies.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Characters on whose kind (letter, number, white space) all versions of Unicode agree.
AGREED = regex.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ǃΑ-ΡΣ-ωА-я‐-―‘-‟…ぁ-ゖァ-ヺ一-龥가-힣]*+")
REMEMBERED = 250_000  # words; beyond this the memory starts anew
LONG = 64  # characters; longer words are not remembered
JOINED = regex.compile(r"'(?:s|t|re|ve|m|ll|d)\p{L}")  # where the rule cuts between two letters
KINDS = [regex.compile(k) for k in (r"\s", r"\p{L}", r"\p{N}")]


def kind_of(c: str) -> int:
    return next((i for i, k in enumerate(KINDS) if k.match(c)), len(KINDS))


def straddling(pieces: list[str]) -> list[str]:
    """Strings that a text must hold if a B piece reaches over the edge of an A pre-token, but for edges between two letters: white
    space other than the space, and neighbours of two kinds, or two spaces, inside a piece."""
    out = set()
    for p in pieces:
        for i, (x, y) in enumerate(zip(p, p[1:])):
            odd = [c for c in (x, y) if c != " " and kind_of(c) == 0]
            if odd:
                out.update(odd)
            elif x + y == "  " or kind_of(x) != kind_of(y) and (i or x != " "):
                out.add(x + y)
    return sorted(out)


class Pair:
    """Both tokenizers, opened once per Python worker.

    Where no B piece can reach over the edge of an A pre-token, both sides end there, so a pre-token always has the same
    ids, groups and links; they are worked out once and remembered, and a text's are those of its pre-tokens one after another.
    That is done only in texts of characters that are split here as the library splits them for certain, and without
    any string of :func:`straddling`; other texts go to the libraries whole.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            raw = json.load(f)
        split = raw["pre_tokenizer"]
        # only these rules are known here
        self.known_rules = split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not raw["normalizer"]
        ordinary = [i for i in range(self.b.get_piece_size()) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.straddling = straddling([self.b.id_to_piece(i).replace("▁", " ") for i in ordinary])
        self.known_rules = self.known_rules and "\n" not in self.straddling
        self.head = self.b.encode("\n")  # B puts a space before all; behind a line feed, which joins no piece, a pre-token is as it is
        self.forget()
        byte_of, count = byte_of_mark(), self.a.get_vocab_size()
        self.marks = {b: c for c, b in byte_of.items()}
        entry = [self.a.id_to_token(i) or "" for i in range(count)]
        self.bytes_a = [bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode() for t in entry]
        self.bytes_b = [self._bytes_of_piece(i) for i in range(self.b.get_piece_size())]
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.bits_a, self.bits_b = (max(len(x) - 1, 1).bit_length() for x in (self.bytes_a, self.bytes_b))
        if self.bits_a + self.bits_b + DOC_BITS > 63:
            raise ValueError("the vocabularies are too large for one 64-bit key")
        # A ids with their bits reversed: the leading bits, which make the parts, then mix frequent and rare ids
        self.turned = np.array([int(f"{i:0{self.bits_a}b}"[::-1], 2) for i in range(count)], np.int64)
        names_a, names_b = [str(i) for i in range(count)], [str(i) for i in range(len(self.bytes_b))]
        self.names = [*(f"{x}," for x in names_a), *(f"{x}|" for x in names_a), *(f"{x}," for x in names_b), *(f"{x};" for x in names_b), *names_b]

    def _bytes_of_piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.words: dict[str, list[int] | None] = {}  # numbers of a word's pre-tokens; None: its text goes whole
        self.numbers: dict[str, int] = {}
        self.fresh: list[str] = []  # pre-tokens that have a number and no facts yet
        self.groups: list[str] = []  # of a pre-token, as they are digested
        self.facts = np.zeros((6, 0), np.int64)  # n_a, n_b, n_groups (0: its bytes differ), n_links, first and number of its pairs
        self.pairs = self.times = np.zeros(0, np.int64)

    def numbers_of(self, word: str) -> list[int] | None:
        """Numbers of the pre-tokens of a space and the word."""
        if not word or len(word) > LONG or word[0].isspace() or not AGREED.fullmatch(word):
            return None
        out = []
        for p in SPLIT.findall(" " + word):
            if p not in self.numbers:
                self.numbers[p] = len(self.numbers)
                self.fresh.append(p)
            out.append(self.numbers[p])
        return out

    def pre_tokens(self, text: str) -> list[int] | None:
        """Numbers of the pre-tokens of a space and the text; None if it has to go whole. Every space before a word begins a
        pre-token, whatever stands before it."""
        if not self.known_rules or any(s in text for s in self.straddling) or "'" in text and JOINED.search(text):
            return None
        words = text.split(" ")
        try:
            return list(chain.from_iterable(map(self.words.__getitem__, words)))
        except KeyError:
            for w in words:
                if w not in self.words:
                    self.words[w] = self.numbers_of(w)
        except TypeError:
            return None
        found = list(map(self.words.__getitem__, words))
        return None if None in found else list(chain.from_iterable(found))

    def learn(self) -> None:
        """The facts of fresh pre-tokens."""
        if not self.fresh:
            return
        tokens = []
        for p, b in zip(self.fresh, self.b.encode(["\n" + p for p in self.fresh], num_threads=1), strict=True):
            head, b = b[: len(self.head)], b[len(self.head) :]
            a = [t.id for t in self.a.model.tokenize("".join(map(self.marks.__getitem__, p.encode())))]
            same = head == self.head and b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b)) == p.encode()
            tokens.append((a, b) if same else ([], []))
        *counted, written, keys, often = self._grouped(tokens, 0)
        owner = keys & ((1 << DOC_BITS) - 1)
        order = np.argsort(owner, kind="stable")
        many = np.bincount(owner, minlength=len(tokens))
        first = len(self.pairs) + np.cumsum(many) - many
        self.facts = np.concatenate([self.facts, np.stack([*counted, first, many])], axis=1)
        self.pairs = np.concatenate([self.pairs, keys[order] >> DOC_BITS])
        self.times = np.concatenate([self.times, np.ones(len(keys), np.int64) if often is None else often[order]])
        self.groups += written
        self.fresh = []

    def aligned(self, texts: list[str], first: int):
        """What :meth:`links` gives for the tokens of ``texts``."""
        if len(self.words) > REMEMBERED:
            self.forget()
        found = [self.pre_tokens(t) if t else [] for t in texts]
        self.learn()
        sizes = np.array([len(f or ()) for f in found], np.int64)
        units = np.fromiter(chain.from_iterable(f or () for f in found), np.int64, int(sizes.sum()))
        whole = np.array([f is None for f in found], bool)
        whole[np.repeat(np.arange(len(texts)), sizes)[self.facts[2, units] == 0]] = True
        units, sizes = units[~np.repeat(whole, sizes)], np.where(whole, 0, sizes)
        stop = np.cumsum(sizes)
        sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(self.facts[:4, units], axis=1)], axis=1)
        counted = sums[:, stop] - sums[:, stop - sizes]
        digests = ["" if w or not f else hashlib.sha256(";".join(map(self.groups.__getitem__, f)).encode()).hexdigest() for f, w in zip(found, whole.tolist(), strict=True)]
        start, many = self.facts[4:, units]
        at = np.arange(int(many.sum())) + np.repeat(start - (np.cumsum(many) - many), many)
        keys = (self.pairs[at] << DOC_BITS) | np.repeat(np.repeat(np.arange(len(texts)) + first, sizes), many)
        often = self.times[at]
        rest = np.flatnonzero(whole)
        if len(rest):
            *more, shas, new, times = self.links(self.tokens([texts[i] for i in rest.tolist()]), 0)
            counted[:, rest] = more
            for i, sha in zip(rest.tolist(), shas, strict=True):
                digests[i] = sha
            low = (1 << DOC_BITS) - 1
            keys = np.concatenate([keys, new & ~low | rest[new & low] + first])
            often = np.concatenate([often, np.ones(len(new), np.int64) if times is None else times])
        return *counted, digests, keys, None if (often == 1).all() else often

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """A and B ids of each text; none where the bytes of either differ from a space and the text."""
        spaced = [" " + t for t in texts]
        out = []
        for t, s, ids, b in zip(texts, spaced, (self.a.encode(s, add_special_tokens=False).ids for s in spaced), self.b.encode(texts, num_threads=1), strict=True):
            want = s.encode()
            same = t and b"".join(map(self.bytes_a.__getitem__, ids)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
            out.append((ids, b) if same else ([], []))
        return out

    def links(self, tokens: list[tuple[list[int], list[int]]], first: int):
        """Per text (n_a, n_b, n_groups, n_links, groups_sha256), and its links as sorted-by-nothing arrays of keys
        (A turned, B, document number from ``first`` on) with how often each occurs (None: once each)."""
        *counted, written, keys, counts = self._grouped(tokens, first)
        return *counted, [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written], keys, counts

    def _grouped(self, tokens: list[tuple[list[int], list[int]]], first: int):
        """As :meth:`links`, with the groups as they are digested."""
        n_a = np.array([len(a) for a, _ in tokens], np.int64)
        n_b = np.array([len(b) for _, b in tokens], np.int64)
        a = np.fromiter(chain.from_iterable(x for x, _ in tokens), np.int64, int(n_a.sum()))
        b = np.fromiter(chain.from_iterable(x for _, x in tokens), np.int64, int(n_b.sum()))
        zeros = np.zeros(len(tokens), np.int64)
        if not len(a):
            return n_a, n_b, zeros, zeros, [""] * len(tokens), a, None
        # texts end with both sides, so ends run on over all of them
        end_a, end_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        cuts = end_a[end_b[np.searchsorted(end_b, end_a)] == end_a]
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        many_a, many_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        at_a, at_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        doc = np.repeat(np.arange(len(tokens)), n_a)
        of_group = doc[at_a]
        links = many_a * many_b
        n_groups = np.bincount(of_group, minlength=len(tokens))
        n_links = np.zeros(len(tokens), np.int64)
        np.add.at(n_links, of_group, links)
        few = links <= EXPANDED
        ours = np.flatnonzero(few[group_a])
        times = many_b[group_a[ours]]
        within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        partner = b[np.repeat(at_b[group_a[ours]], times) + within]
        keys = ((np.repeat(self.turned[a[ours]], times) << self.bits_b | partner) << DOC_BITS) | np.repeat(doc[ours] + first, times)
        counts = None
        if not few.all():
            more, often = [keys], [np.ones(len(keys), np.int64)]
            for g in np.flatnonzero(~few).tolist():
                ids_a, t_a = np.unique(self.turned[a[at_a[g] : at_a[g] + many_a[g]]], return_counts=True)
                ids_b, t_b = np.unique(b[at_b[g] : at_b[g] + many_b[g]], return_counts=True)
                more.append(((np.add.outer(ids_a << self.bits_b, ids_b) << DOC_BITS) | (of_group[g] + first)).ravel())
                often.append(np.multiply.outer(t_a, t_b).ravel())
            keys, counts = np.concatenate(more), np.concatenate(often)
        return n_a, n_b, n_groups, n_links, self._written(a, b, n_a, n_b, (group_a, group_b), (many_a, many_b), (at_a, at_b)), keys, counts

    def _written(self, a, b, n_a, n_b, group, many, at) -> list[str]:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        last_a = np.zeros(len(a), bool)
        last_a[at[0] + many[0] - 1] = True
        last_b = np.zeros(len(b), np.int64)
        last_b[at[1] + many[1] - 1] = 1
        last_b[(np.cumsum(n_b) - 1)[n_b > 0]] = 2
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + at[1][group[0]]] = a + last_a * size_a
        written[np.arange(len(b)) + (at[0] + many[0])[group[1]]] = b + 2 * size_a + last_b * size_b
        out, stop, names = [], np.cumsum(n_a + n_b).tolist(), self.names.__getitem__
        for start, end in zip([0, *stop[:-1]], stop):
            out.append("".join(map(names, written[start:end].tolist())))
        return out


@lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


MEMORIES.append(pair_of)


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    planes = [np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays]
    return zstandard.compress(b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *planes]))


def unpacked(blob: bytes, arrays: int) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, arrays)
    out, at = [], 8 * arrays
    for n in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).ravel())
        at += 8 * n
    return out


def run_of(keys: np.ndarray, docs: np.ndarray) -> bytes:
    """A sorted run: pairs, and the number of documents of each."""
    return packed(np.diff(keys, prepend=0), docs)


def pairs_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, docs = unpacked(blob, 2)
    return np.cumsum(steps), docs


def runs_of_chunk(keys: list[np.ndarray], counts: list[np.ndarray | None], shift: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, run of pairs, documents of the pairs with their links) of one chunk."""
    if any(c is not None for c in counts):
        often = np.concatenate([np.ones(len(k), np.int64) if c is None else c for k, c in zip(keys, counts, strict=True)])
        joined = np.concatenate(keys)
        order = np.argsort(joined, kind="stable")
        joined, often = joined[order], often[order]
        first = np.flatnonzero(np.diff(joined, prepend=-1))
        links = np.add.reduceat(often, first) if len(first) else often
    else:
        joined = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.diff(joined, prepend=-1))
        links = np.diff(first, append=len(joined))
    records = joined[first]
    pairs, docs = records >> DOC_BITS, records & ((1 << DOC_BITS) - 1)
    start = np.flatnonzero(np.diff(pairs, prepend=-1))
    many = np.diff(start, append=len(pairs))
    distinct = pairs[start]
    edge = np.searchsorted(distinct >> shift, np.arange(RADICES + 1))
    ends = np.append(start, len(pairs))
    step = np.diff(docs, prepend=0)
    step[start] = docs[start]  # documents of a pair are written as steps from one to the next
    for r in range(RADICES):
        lo, hi = edge[r], edge[r + 1]
        if lo < hi:
            inside = slice(ends[lo], ends[hi])
            yield r, run_of(distinct[lo:hi], many[lo:hi]), packed(many[lo:hi], step[inside], links[inside])


DOC_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def spilled(few: DataFrame, path_a: str, path_b: str, records: int, characters: int) -> DataFrame:
    """Rows of documents (``place`` within their chunk) and rows of runs (``part``), by chunk."""
    kind = dict(few.dtypes)["doc_id"]
    schema = f"chunk bigint, place int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, part int, pairs binary, lists binary"
    names = ["chunk", "place", "doc_id", *DOC_COLUMNS, "part", "pairs", "lists"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair_of(path_a, path_b)
        shift = p.bits_a + p.bits_b - (RADICES.bit_length() - 1)
        chunk = TaskContext.get().partitionId() * CHUNKS
        keys, counts, links, place, id_type = [], [], 0, 0, None

        def rows(n: int, doc_ids: pa.Array | None, given: dict) -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), id_type, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary(), pa.binary()]
            filled = {"chunk": [chunk] * n} | given
            columns = [pa.array(filled[c], t) if c in filled else pa.nulls(n, t) for c, t in zip(names, types, strict=True)]
            if doc_ids is not None:
                columns[2] = doc_ids
            return pa.RecordBatch.from_arrays(columns, names)

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts, links, place, chunk
            if links:
                for part, pairs, lists in runs_of_chunk(keys, counts, shift):
                    yield rows(1, None, {"part": [part], "pairs": [pairs], "lists": [lists]})
            keys, counts, links, place, chunk = [], [], 0, 0, chunk + 1

        for batch in batches:
            id_type = batch["doc_id"].type
            texts = batch["text"].to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= characters):
                    size += len(texts[stop] or "")
                    stop += 1
                *numbers, new, often = p.aligned([t or "" for t in texts[at:stop]], place)
                given = dict(zip(DOC_COLUMNS, numbers, strict=True))
                yield rows(stop - at, batch["doc_id"][at:stop], given | {"place": range(place, place + stop - at)})
                keys.append(new)
                counts.append(often)
                links += len(new)
                place += stop - at
                at = stop
                if links > records or place > (1 << DOC_BITS) - 1_000_000:
                    yield from closed()
        if id_type is not None:
            yield from closed()

    return few.mapInArrow(run, schema)


def merged(table: pa.Table) -> pa.Table:
    """One run out of several of a part: a heap over their heads, documents summed per pair."""
    runs = [zip(*(x.tolist() for x in pairs_of(blob))) for blob in table["pairs"].to_pylist()]
    keys, docs, last = [], [], -1
    for key, n in heapq.merge(*runs):
        if key == last:
            docs[-1] += n
        else:
            keys.append(key)
            docs.append(n)
            last = key
    run = run_of(np.array(keys, np.int64), np.array(docs, np.int64))
    return pa.table({"part": table["part"][:1], "node": table["parent"][:1], "pairs": pa.array([run], pa.binary())})


def judged(bits_b: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a part's last run the answer to each pair: twice its count, plus one if no pair of its A id has more."""
    for batch in batches:
        out = []
        for blob in batch["pairs"].to_pylist():
            keys, docs = pairs_of(blob)
            start = np.flatnonzero(np.diff(keys >> bits_b, prepend=-1))
            most = np.repeat(np.maximum.reduceat(docs, start), np.diff(start, append=len(keys)))
            out.append(packed(2 * docs + (docs == most)))
        yield pa.RecordBatch.from_arrays([batch["part"], batch["node"], batch["pairs"], pa.array(out, pa.binary())], ["part", "node", "pairs", "answers"])


def handed_down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers to a run's pairs out of those of the run it was merged into."""
    for batch in batches:
        out = []
        for mine, theirs, answers in zip(*(batch[c].to_pylist() for c in ("pairs", "above", "answers"))):
            out.append(packed(unpacked(answers, 1)[0][np.searchsorted(pairs_of(theirs)[0], pairs_of(mine)[0])]))
        yield pa.RecordBatch.from_arrays([batch["part"], batch["node"], batch["pairs"], pa.array(out, pa.binary())], ["part", "node", "pairs", "answers"])


def answered(runs: DataFrame, bits_b: int, nodes: int, fan: int) -> DataFrame:
    """``runs`` (part, node, pairs) with ``answers``; ``nodes`` is the number of different nodes."""
    levels = [runs]
    while nodes > 1:
        above = -(-nodes // fan)
        levels[-1] = levels[-1].withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(above)))
        up = levels[-1].groupBy("part", "parent").applyInArrow(merged, "part int, node bigint, pairs binary")
        levels.append(saved(up, "merged-runs"))
        nodes = above
    schema = "part int, node bigint, pairs binary, answers binary"
    answers = levels.pop().select("part", "node", "pairs").mapInArrow(partial(judged, bits_b), schema)
    for level in reversed(levels):
        above = answers.select("part", F.col("node").alias("parent"), F.col("pairs").alias("above"), "answers")
        # no broadcast: a level's runs have no bound
        answers = level.join(above.hint("shuffle_hash"), ["part", "parent"]).mapInArrow(handed_down, schema)
    return answers.select("part", "node", "answers")


def summed(given: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one chunk with the sums of their links' answers."""
    docs = given.filter(pc.is_valid(given["place"]))
    size = max(docs["place"].to_pylist(), default=-1) + 1
    best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
    of_part = dict(zip(answers["part"].to_pylist(), answers["answers"].to_pylist(), strict=True))
    lists = given.filter(pc.is_valid(given["part"])).select(["part", "lists"])
    for part, blob in zip(*(c.to_pylist() for c in lists.columns)):
        many, step, links = unpacked(blob, 3)
        answer = np.repeat(unpacked(of_part[part], 1)[0], many)
        start = np.cumsum(many) - many
        run = np.cumsum(step)
        doc = run - np.repeat(run[start] - step[start], many)
        np.add.at(best, doc, links * (answer & 1))
        np.add.at(total, doc, links * (answer >> 1))
    place = np.array(docs["place"].to_pylist(), np.int64)
    out = docs.select(["doc_id", *DOC_COLUMNS[:4]])
    out = out.append_column("n_best", pa.array(best[place], pa.int64())).append_column("count_sum", pa.array(total[place], pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", fan: int = FAN, records: int = RECORDS, characters: int = TEXT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links; n_best, how many links have a pair whose
    count is the highest of their A id; count_sum, the counts summed over the links; groups_sha256.

    A document is a row: repeated rows count as documents of their own, and rows without doc_id like others.
    Null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: zeros and
    an empty digest. Texts are tokenized whole, each in one task. An empty table gives no rows. Columns other than the two
    named are not read.
    """
    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = saved(spilled(few, path_a, path_b, records, characters), "token-runs")
    runs = rows.filter("part is not null").select("part", F.col("chunk").alias("node"), "pairs")
    nodes = runs.agg(F.count_distinct("node")).first()[0]
    answers = answered(runs, pair_of(path_a, path_b).bits_b, nodes, fan)
    # a part without runs is no answer; a chunk without runs has documents only
    given = rows.select("chunk", "place", "doc_id", *DOC_COLUMNS, "part", "lists")
    by_chunk = answers.withColumnRenamed("node", "chunk").groupBy("chunk")
    return given.groupBy("chunk").cogroup(by_chunk).applyInArrow(summed, f"doc_id {dict(few.dtypes)['doc_id']}, {RESULT}")
