"""Token counts by a public vocabulary, with whole-token shortcut.

The vocabulary's tokenizer splits a normalised text into pre-tokens and merges characters inside each of
them. Which vocabulary strings come out as one token when they stand alone is proved once, by encoding
every one of them (:func:`whole_tokens`). A pre-token of that set counts one without any merging; the
others are merged by the tokenizer, each distinct one once per batch of new words.

The words between white space are looked up whole, since no pre-token spans white space: a word seen before
costs one lookup, a new one is split into its pre-tokens. That is done only where splitting here is certain
to equal the library's: in texts of the letters in ``PLAIN`` and without special strings. Every other text
goes to the library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import MEMORIES, strings, text_of

# Characters of lower-cased words on which Unicode versions and composition agree: no control characters,
# combining marks, or characters that decompose to others.
PLAIN = regex.compile("[\x21-\x7e\xa1-įı-ǃα-ω" "а-я‐-―‘-‟…ぁ-ゖァ-ヺ一-龥가-힣]*+")
# White space to Python only, and capitals whose lower case depends on their neighbours.
ODD = "\x1c\x1d\x1e\x1fΣİ"
# Words remembered in a Python worker; beyond this the memory starts anew.
REMEMBERED = 250_000


class Vocabulary:
    """A ``tokenizers`` file, opened once per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        split = raw["pre_tokenizer"]["pretokenizers"][0]
        steps = [n["type"] for n in raw["normalizer"]["normalizers"]]
        if (split["type"], split["invert"], steps) != ("Split", True, ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"the word shortcut does not know the splitting rules of {path}")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.odd = [*ODD, *(t["content"] for t in raw["added_tokens"])]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.vocab = raw["model"]["vocab"]
        self.suffix = raw["model"]["end_of_word_suffix"] or ""
        self.marks = {b: c for c, b in byte_of_mark().items()}
        self.remembered: dict = {}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pre_tokens(self, word: str) -> list[str]:
        return [word] if word.isalpha() else self.split.findall(word)

    def merged(self, pre_token: str) -> list[int]:
        """The ids of one pre-token."""
        if not pre_token.isascii():  # ASCII letters stand for themselves
            pre_token = "".join(map(self.marks.__getitem__, pre_token.encode()))
        return [t.id for t in self.model.tokenize(pre_token)]

    def look_up(self, text: str, of_word: Callable[[str], object]) -> list | None:
        """``of_word`` of each word of the text, remembered; None where only the library can split it."""
        if any(c in text for c in self.odd):
            return None
        words = text.lower().split()
        try:
            found = list(map(self.remembered.__getitem__, words))
        except KeyError:
            if len(self.remembered) > REMEMBERED:
                self.remembered.clear()
            for w in {w for w in words if w not in self.remembered}:
                self.remembered[w] = of_word(w) if w.isascii() and w.isprintable() or PLAIN.fullmatch(w) else None
            found = list(map(self.remembered.__getitem__, words))
        return None if None in found else found


@lru_cache(maxsize=4)
def vocabulary(path: str, use: str) -> Vocabulary:
    """One per ``use``, because each remembers something else of a word."""
    return Vocabulary(path)


MEMORIES.append(vocabulary)


def byte_of_mark() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible character: printable ones as they are, the
    others as the characters from 256 on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> list[str]:
    """All strings that are one pre-token and encode alone as one token. At most as many as the vocabulary
    has entries, which bounds what is sent to the executors."""
    v, byte_of = vocabulary(path, "whole"), byte_of_mark()
    found = []
    for piece, i in v.vocab.items():
        if piece.endswith(v.suffix) and len(piece) > len(v.suffix):
            try:
                word = bytes(byte_of.get(c, 0) for c in piece.removesuffix(v.suffix)).decode()
            except UnicodeDecodeError:
                continue
            if PLAIN.fullmatch(word) and v.split.findall(word) == [word]:
                found.append((word, i))
    encoded = v.tokenizer.encode_batch([w for w, _ in found], add_special_tokens=False)
    return [w for (w, i), e in zip(found, encoded, strict=True) if e.ids == [i]]


def count_tokens(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null text counts as empty (0 tokens). Repeated rows are counted each. Texts are read whole, whatever
    their length. No shuffle; the columns other than the two named are not read.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(path))
    few = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"))
    kinds = dict(few.dtypes)
    schema = f"doc_id {kinds['doc_id']}, n_bytes bigint, n_tokens bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, "counts")
        ones = frozenset(whole.value)

        def tokens_of(word: str) -> int:
            return sum(1 if p in ones else len(v.merged(p)) for p in v.pre_tokens(word))

        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(strings(batch["text"])):
                found = v.look_up(t, tokens_of)
                counts[i] = len(v.encode(t)) if found is None else sum(found)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return few.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit).cast(T.LongType()))
