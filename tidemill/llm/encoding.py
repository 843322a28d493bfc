"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

A batch of texts is cut into pieces by the vocabulary's pattern; each piece that is new to the worker is laid out as a chain
of byte symbols, and an index maps every adjacent pair to all of its positions. The ranks that occur are applied in
ascending order (a heap of the active ones): a rank's positions are merged from left to right, and only the lists of the
pairs beside them are updated. The ids of a piece are kept for further texts in a table of bounded size.

Defined results: null, empty texts have no ids (an empty list, not null); special tokens written out in a text are ordinary
text; lone surrogates are encoded as a question mark; repeated rows are each encoded; ids are those of the
vocabulary file, whose path is a parameter.
"""

from __future__ import annotations

import base64
import heapq

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_batches

# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEPT_PIECES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern, self.ranks = pattern, ranks
        self._prepare()

    def __getstate__(self) -> tuple:
        return self.pattern, self.ranks

    def __setstate__(self, state: tuple) -> None:
        self.pattern, self.ranks = state
        self._prepare()

    def _prepare(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.merged[a, b] = rank
        self.kept: dict[str, list[int]] = {}

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece, by merging all pieces together through one index of pairs."""
        sym: list[int] = []
        start = []
        for p in pieces:
            start.append(len(sym))
            sym += [self.single[b] for b in p.encode("utf-8", "replace")]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s, e in zip(start, start[1:] + [n]):
            if e > s:
                after[e - 1], before[s] = -1, -1
        where: dict[int, list[int]] = {}
        merged = self.merged
        for i in range(n):
            j = after[i]
            if j >= 0:
                r = merged.get((sym[i], sym[j]))
                if r is not None:
                    where.setdefault(r, []).append(i)
        heap = list(where)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            at = where.pop(rank)
            at.sort()
            for i in at:
                a = sym[i]
                if a < 0 or (j := after[i]) < 0 or merged.get((a, sym[j])) != rank:
                    continue  # the pair is no longer there
                k, h = after[j], before[i]
                sym[i], sym[j], after[i] = rank, -1, k
                if k >= 0:
                    before[k] = i
                    r = merged.get((rank, sym[k]))
                    if r is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(heap, r)
                if h >= 0:
                    r = merged.get((sym[h], rank))
                    if r is not None:
                        if r in where:
                            where[r].append(h)
                        else:
                            where[r] = [h]
                            heapq.heappush(heap, r)
        return [[x for x in sym[s:e] if x >= 0] for s, e in zip(start, start[1:] + [n])]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_PIECES:
            self.kept = {}
        kept = self.kept
        new = list(dict.fromkeys(p for pieces in cut for p in pieces if p not in kept))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            kept.update(zip(part, self.encode_pieces(part)))
        out = []
        for pieces in cut:
            ids: list[int] = []
            for p in pieces:
                ids += kept[p]
            out.append(ids)
        return out


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, batch: int = 512) -> DataFrame:
    """(doc, ids): every row's ids; the vocabulary is read on the driver and broadcast (its size is fixed)."""
    encoder = df.sparkSession.sparkContext.broadcast(PairEncoder(read_ranks(vocabulary)))

    def fn(ids: list, texts: list) -> dict[str, list]:
        out: list[list[int]] = []
        for k in range(0, len(texts), batch):
            out += encoder.value.encode_batch(texts[k : k + batch])
        return {"doc_key": ids, "ids": out}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, [key, text], fn, f"doc_key {kind}, ids array<int>").select(F.col("doc_key").alias(key), "ids")
