"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one valid encoding; ``PrefixEncoder`` stores the last token of each. The next
prefix's last token is the longest vocabulary entry that ends there and may follow the last token of the prefix before
it, where "may follow" means that encoding the two tokens' bytes gives just these two tokens. So appending bytes never
changes what is stored for shorter prefixes, and an edit is re-encoded from its own position on. The encoding of a prefix
is read by going back from its last token.

A corpus holds few distinct pieces: ``TokenizerModel`` cuts texts into chunks and pieces by the tokenizer's own rule and
keeps the ids of those it has seen, so the dynamic program runs once per distinct piece and worker.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer vocabularies; a parameter of every function here, this is its default.
TOKENIZER_DIR = os.environ.get("CITELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the splitting rule of the tokenizer, a public format.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the characters that the rule's \s stands for.
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A blank with the run after it, a run, or blanks: no piece reaches over the end of one of these.
CHUNK = rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+?(?= [^{BLANK}])|[{BLANK}]"


class PrefixEncoder:
    """Encodes bytes incrementally; see the module's text. ``ranks``: token bytes -> id, ids in merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._by_length: dict[bytes, list[int]] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Ids by the merge rule itself; used only on the bytes of two tokens, to learn whether one may follow the other."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            known = self._merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self._pairs[(left, right)] = known
        return known

    def _self_valid(self, token: int) -> bool:
        """Whether a vocabulary entry's own bytes encode to it."""
        known = self._pairs.get((token, -1))
        if known is None:
            known = self._pairs[(token, -1)] = self._merge(self.tokens[token]) == [token]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """``last[i]``: the last token of data[: i + 1], continued to the end of ``data`` from the entries given."""
        ranks, longest = self.ranks, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is None or not self._self_valid(token):
                    continue
                if start == 0 or self.may_follow(last[start - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def edit(self, data: bytes, last: list[int], changed_from: int) -> list[int]:
        """The table of ``data``, of which the bytes before ``changed_from`` are those that ``last`` was made for."""
        return self.extend(data, last[:changed_from])

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """The ids of the prefix that ends at ``end`` (the whole without it)."""
        at, out = len(last) if end is None else end, []
        while at > 0:
            token = last[at - 1]
            out.append(token)
            at -= len(self.tokens[token])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self.read(self.extend(data, []))


class TokenizerModel:
    """Texts to ids. Special tokens are ordinary text; null and empty texts have no ids."""

    #: Chunks are forgotten beyond this number: it bounds memory, not results.
    MOST_CHUNKS = 400_000

    def __init__(self, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
        with open(os.path.join(folder, vocabulary), "rb") as f:
            self.encoder = PrefixEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})
        self._chunks: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._piece, self._chunk = regex.compile(PIECE), re.compile(CHUNK)
        self.width = np.uint16 if len(self.encoder.ranks) < 1 << 16 else np.uint32

    def piece(self, piece: str) -> bytes:
        """The ids of one piece, as packed integers."""
        ids = self._pieces.get(piece)
        if ids is None:
            ids = np.array(self._long(piece.encode("utf-8", "replace")), self.width).tobytes()
            if len(piece) <= 40:
                if len(self._pieces) >= self.MOST_CHUNKS:
                    self._pieces.clear()
                self._pieces[piece] = ids
        return ids

    def _long(self, data: bytes) -> list[int]:
        return self.encoder.encode(data)

    def split(self, text: str) -> list[str]:
        """The pieces of a text by the tokenizer's rule."""
        return self._piece.findall(text)

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks, seen = self._chunk.findall(text), self._chunks
        try:
            return b"".join([seen[c] for c in chunks])
        except KeyError:
            pass
        out = []
        for c in chunks:
            ids = seen.get(c)
            if ids is None:
                ids = b"".join([self.piece(p) for p in self._piece.findall(c)])
                if len(c) <= 40:
                    if len(seen) >= self.MOST_CHUNKS:
                        seen.clear()
                    seen[c] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), self.width).tolist()


@lru_cache(maxsize=2)
def model(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> TokenizerModel:
    """One model per worker and vocabulary."""
    return TokenizerModel(folder, vocabulary)


def _encode(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(folder, vocabulary)
        for batch in batches:
            packed = [m.packed(t.as_py()) for t in batch.column(1)]
            size = np.dtype(m.width).itemsize
            ends = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // size for p in packed], out=ends[1:])
            ids = np.frombuffer(b"".join(packed), m.width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])

    return run


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every row; empty and null texts have an empty list. Rows with the same key are encoded each.

    One narrow pass without a shuffle: each task reads its part of the texts and writes their ids.
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text")).mapInArrow(
        _encode(folder, vocabulary), "doc_id long, ids array<int>"
    )
