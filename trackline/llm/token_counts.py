"""Exact token counts of a word-level BPE by a whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come back as one token are proved whole.
A pre-token that is a proved string costs one token and no merging. Only other pre-tokens are merged, each
distinct one once per run of texts, by the library itself.

Null and empty texts have no tokens; repeated rows count alike; a very long text is split whole, in a run of its own. An
empty table gives no rows. Only doc_id and text are read, so columns of other names cannot clash.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAX_CACHED = 300_000  # merged pre-tokens kept by a worker; beyond it they are forgotten and merged anew

# The pre-token pattern of the vocabulary file.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Characters on which this module's and the library's tables cannot differ, and which NFC leaves alone.
PLAIN = regex.compile(r"[\t-\r\x20-\x7e\xa0-ɏ]*+")


class WholeTokens:
    """Counts tokens as the tokenizer in ``path`` does, without added begin or end tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.whole = self._prove()
        self.merged: dict[str, int] = {}

    def _prove(self) -> frozenset[str]:
        """The pre-tokens that encode alone as one token, found by encoding each vocabulary string alone."""
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        names = [t.removesuffix(suffix) for t in self.tokenizer.get_vocab(with_added_tokens=False) if t.endswith(suffix)]
        texts = {ByteLevel().decode([t]) for t in names}
        texts = [t for t in texts if t and PLAIN.fullmatch(t) and PRE_TOKEN.findall(t.lower()) == [t]]
        encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return frozenset(t for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1)

    def _split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of added tokens written out in the text."""
        parts, extra = [text], 0
        if self.added is not None and "<" in text:
            parts = self.added.split(text)
            extra = len(parts) - 1
        words: list[str] = []
        for part in parts:
            if part.isascii() or PLAIN.fullmatch(part):
                words += PRE_TOKEN.findall(part.lower())
            else:
                words += [part[a:b] for part in (self.tokenizer.normalizer.normalize_str(part),) for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return words, extra

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self._split(t) if t else ((), 0) for t in texts]
        if len(self.merged) > MAX_CACHED:
            self.merged.clear()
        rest = set().union(*(words for words, _ in split)) - self.whole - self.merged.keys()
        if rest:
            rest = list(rest)
            for word, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
                self.merged[word] = len(e.ids)
        whole, merged = self.whole, self.merged
        return [extra + sum(1 if w in whole else merged[w] for w in words) for words, extra in split]


@lru_cache(maxsize=2)
def counter(path: str) -> WholeTokens:
    return WholeTokens(path)


def tokens(text: Column, path: str) -> Column:
    """Number of tokens of each whole text; a null or empty text has none."""

    @F.arrow_udf("long")
    def count(values: pa.Array) -> pa.Array:
        model, out = counter(path), []
        sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
        run = (np.cumsum(sizes) - 1).clip(0) // 2_000_000
        edges = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(values)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out += model.count(values.slice(a, b - a).to_pylist())
        return pa.array(out, pa.int64())

    return count(text)


def report(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per input row. Repeated rows count alike; columns of other names are left out."""
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        tokens(F.col("text"), path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
