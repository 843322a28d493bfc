"""Terms of character n-grams with their documents and summed TF-IDF weights, without a row per document and term.

Each document's n-grams are counted where the document is read, in Arrow batches: n-grams are packed into 64 bits, BITS of each
character, and sorted together with the number of the document. Only counts per task and term are shuffled, for the vocabularies
and, once these are broadcast (they are capped), for the weights. Rows that share a key are one document and are put together first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemill.functions import text as T
from tidemill.operators import tfidf as X

BITS, CHUNK, MOST_HELD, ROWS = 12, 1 << 19, 1 << 21, 50_000
_SPACE = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", T.SPACE) + "]")
BLANK = 32


class Chunk:
    """Characters of several documents, numbered by an alphabet of their own; in_words: each word padded by one blank."""

    def __init__(self, docs: list[list[str]], in_words: bool):
        lengths = np.array([len(t) for d in docs for t in d], np.int64)
        code = np.frombuffer("".join(t for d in docs for t in d).encode("utf-32-le"), "<u4")
        self.n_docs = len(docs)
        text = np.repeat(np.arange(len(lengths)), lengths)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])[text]
        self.present = np.zeros(0x110000, bool)
        self.present[code] = self.present[BLANK] = True
        self.chars = np.flatnonzero(self.present)
        number = np.zeros(0x110000, np.uint64)
        number[self.chars] = np.arange(1, len(self.chars) + 1, dtype=np.uint64)
        self.number, self.bits = number, int(len(self.chars)).bit_length()
        self.blank = number[BLANK]
        if in_words:
            spaces = np.zeros(0x110000, bool)
            spaces[[c for c in self.chars.tolist() if _SPACE.match(chr(c))]] = True
            at = np.flatnonzero(~spaces[code])
            begins = np.ones(len(at), bool)
            begins[1:] = (np.diff(at) > 1) | (np.diff(text[at]) > 0)
            word = np.cumsum(begins) - 1
            sizes = np.bincount(word) + 2 if len(at) else np.zeros(0, np.int64)
            self.ids = np.full(int(sizes.sum()), self.blank)
            self.ids[np.arange(len(at)) + 2 * word + 1] = number[code[at]]
            self.doc, ends = np.repeat(doc[at[begins]], sizes), np.repeat(np.cumsum(sizes), sizes)
        else:
            self.ids, self.doc, ends = number[code], doc, np.repeat(np.cumsum(lengths), lengths)
        self.left = ends - np.arange(len(self.ids))
        self.doc, self.last = self.doc.astype(np.uint64), (1, self.ids)

    def packed(self, n: int) -> np.ndarray:
        """The n characters from each place on, packed, from what was packed last; those past the end are left out."""
        done, out = self.last if self.last[0] <= n else (1, self.ids)
        for k in range(done, n):
            longer = out << np.uint64(self.bits)
            longer[: len(out) - k] |= self.ids[k:]
            out = longer
        self.last = n, out
        return out

    def counts(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For blocks of documents: the different n-grams, how many documents each has, and those documents with their counts."""
        at = np.flatnonzero(self.left >= n)
        gram = self.packed(n)
        spare = np.uint64(min(64 - n * self.bits, 32))
        step = 1 << int(spare)
        for first in range(0, self.n_docs, step):
            if self.n_docs <= step:
                key = (gram << spare | self.doc)[at]
            else:
                x, y = np.searchsorted(self.doc[at], np.array([first, first + step], np.uint64))
                key = gram[at[x:y]] << spare | self.doc[at[x:y]] - np.uint64(first)
            if not len(key):
                continue
            key.sort()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            tf, key = np.diff(np.append(starts, len(key))), key[starts]
            grams = key >> spare
            begins = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            yield grams[begins], np.diff(np.append(begins, len(grams))), (key & np.uint64(step - 1)).astype(np.int64) + first, tf

    def codes(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Rows of characters of packed n-grams."""
        return self.chars[digits(grams, n, self.bits) - 1]

    def times(self, grams: np.ndarray, n: int, sizes: tuple[int, ...]) -> np.ndarray:
        """How often each n-gram counts in a range of sizes: a whole word counts at every size from its length on."""
        c = self.codes(grams, n)
        whole = (c[:, 0] == BLANK) & (c[:, -1] == BLANK)
        return np.where(whole, sum(k >= n for k in sizes), int(n in sizes))

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Packed n-grams of rows of characters; 0 where one of them is not in the alphabet."""
        ids = self.number[codes]
        return np.where((ids > 0).all(axis=1), packed_rows(ids, self.bits), np.uint64(0))


class Wide(Chunk):
    """One document of so many different characters that n-grams have no room in 64 bits: their places among the document's are taken instead."""

    def rows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.left >= n)
        ids = np.stack([self.ids[at + k] for k in range(n)], axis=1)
        kinds, tf = np.unique(ids, axis=0, return_counts=True)
        return self.chars[kinds.astype(np.int64) - 1], tf

    def counts(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        kinds, tf = self.rows(n)
        if len(tf):
            yield np.arange(1, len(tf) + 1, dtype=np.uint64), np.ones(len(tf), np.int64), np.zeros(len(tf), np.int64), tf

    def codes(self, grams: np.ndarray, n: int) -> np.ndarray:
        return self.rows(n)[0][grams.astype(np.int64) - 1]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        place = {s: k for k, s in enumerate(strings(self.rows(codes.shape[1])[0]), 1)}
        return np.array([place.get(s, 0) for s in strings(codes)], np.uint64)


def digits(grams: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The numbers of the characters of packed n-grams."""
    return np.stack([grams >> np.uint64(bits * (n - 1 - k)) & np.uint64((1 << bits) - 1) for k in range(n)], axis=1).astype(np.int64)


def packed_rows(ids: np.ndarray, bits: int) -> np.ndarray:
    out = ids[:, 0].copy()
    for k in range(1, ids.shape[1]):
        out = out << np.uint64(bits) | ids[:, k]
    return out


def strings(codes: np.ndarray) -> list[str]:
    n = codes.shape[1]
    s = np.ascontiguousarray(codes, "<u4").tobytes().decode("utf-32-le")
    return [s[k : k + n] for k in range(0, len(s), n)]


def chunks(batches: Iterator[pa.RecordBatch], in_words: bool) -> Iterator[Chunk]:
    """Documents (arrays of texts) by CHUNK characters, and of few enough different characters for BITS bits."""

    def divided(docs: list[list[str]]) -> Iterator[Chunk]:
        c = Chunk(docs, in_words)
        if c.bits <= BITS:
            yield c
        elif len(docs) > 1:
            yield from divided(docs[: len(docs) // 2])
            yield from divided(docs[len(docs) // 2 :])
        else:
            yield Wide(docs, in_words)

    held: list[list[str]] = []
    size = 0
    for batch in batches:
        for doc in batch.column(0).to_pylist():
            held.append([t.decode("utf-8", "replace") for t in doc])
            size += sum(map(len, held[-1]))
            if size >= CHUNK:
                yield from divided(held)
                held, size = [], 0
    if held:
        yield from divided(held)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], *(np.add.reduceat(v[order], at) for v in values)


def documents(df: DataFrame, key: str, c: Column) -> DataFrame:
    """One row per document: the texts of its rows as UTF-8."""
    rows = df.select(F.col(key).alias("k"), c.cast("binary").alias("t"))
    again = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("k2"))
    one = F.array("t").alias("texts")
    if again.isEmpty():
        return rows.select(one)
    same = F.col("k").eqNullSafe(F.col("k2"))
    return rows.join(again, same, "left_anti").select(one).unionByName(rows.join(again, same, "left_semi").groupBy("k").agg(F.collect_list("t").alias("texts")).select("texts"))


def gram_counts(docs: DataFrame, sizes: list[int], in_words: bool) -> DataFrame:
    """Of each n-gram the documents and the occurrences, by task: (term, df, total)."""
    struct = StructType.fromDDL("term string, df bigint, total bigint")
    arrow = to_arrow_schema(struct)

    def told(n: int, held: list[tuple[np.ndarray, ...]], chars: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams, df, total = summed(*(np.concatenate(x) for x in zip(*held)))
        for k in range(0, len(grams), ROWS):
            g = grams[k : k + ROWS]
            codes = chars[digits(g, n, BITS)]
            yield pa.RecordBatch.from_arrays([pa.array(strings(codes)), pa.array(df[k : k + ROWS]), pa.array(total[k : k + ROWS])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chars = np.zeros(0x110000, np.uint64), np.zeros(0, np.int64)  # the task's alphabet
        held: dict[int, list] = {n: [] for n in sizes}
        waiting = dict.fromkeys(sizes, 0)
        for c in chunks(batches, in_words):
            if isinstance(c, Wide):
                for n in sizes:
                    for grams, df, _, tf in c.counts(n):
                        yield pa.RecordBatch.from_arrays([pa.array(strings(c.codes(grams, n))), pa.array(df), pa.array(tf)], schema=arrow)
                continue
            new = c.chars[number[c.chars] == 0]
            if len(chars) + len(new) >= 1 << BITS:
                for n in sizes:
                    if held[n]:
                        yield from told(n, held[n], np.append(0, chars))
                        held[n], waiting[n] = [], 0
                number[:], chars, new = 0, chars[:0], c.chars
            chars = np.append(chars, new)
            number[new] = np.arange(len(chars) - len(new) + 1, len(chars) + 1, dtype=np.uint64)
            for n in sizes:
                for grams, df, _, tf in c.counts(n):
                    total = np.add.reduceat(tf, np.cumsum(df) - df)
                    held[n].append((packed_rows(number[c.codes(grams, n)], BITS), df, total))
                    waiting[n] += len(grams)
                if waiting[n] > MOST_HELD:
                    held[n] = [summed(*(np.concatenate(x) for x in zip(*held[n])))]
                    if len(held[n][0][0]) > MOST_HELD // 2:
                        yield from told(n, held[n], np.append(0, chars))
                        held[n] = []
                    waiting[n] = sum(len(x[0]) for x in held[n])
        for n in sizes:
            if held[n]:
                yield from told(n, held[n], np.append(0, chars))

    return docs.mapInArrow(run, struct)


def vocabularies(df: DataFrame, docs: DataFrame, ranges: dict[str, tuple[int, ...]], lengths: list[int], in_words: bool, cap: int, min_df: int, max_df: float) -> dict[str, list[tuple[str, float]]]:
    """Terms and idf of each range; as in tfidf.vocabulary."""
    n_docs = df.count()
    counts = gram_counts(docs, lengths, in_words).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    counts = counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).persist()
    out = {}
    for name, sizes in ranges.items():
        long = F.length("term")
        times = F.when(long.isin(*sizes), 1).otherwise(0)
        if in_words:
            whole = F.col("term").startswith(" ") & F.col("term").endswith(" ")
            times = F.when(whole, sum(((F.lit(k) >= long).cast("int") for k in sizes), F.lit(0))).otherwise(times)
        v = counts.withColumn("total", F.col("total") * times).where("total > 0").orderBy(F.desc("total"), "term").limit(cap)
        idf = F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
        # One partition, so that the tasks' first terms meet in a task and not on the driver.
        out[name] = [(r["term"], r["idf"]) for r in v.select("term", idf.alias("idf")).repartition(1).collect()]
    counts.unpersist()
    return out


def term_weights(df: DataFrame, key: str, c: Column, ranges: dict[str, tuple[int, ...]], cap: int, in_words: bool, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(ngram_range, term, n_documents, weight): the terms of each range's vocabulary, their documents and the sum of their TF-IDF.

    in_words: n-grams inside words padded by one blank, of which one shorter than n counts as it is; otherwise across words.
    """
    every = {n for sizes in ranges.values() for n in sizes}
    if max(every) > 64 // BITS:
        raise ValueError(f"n-grams of over {64 // BITS} characters")
    lengths = sorted(every | (set(range(3, max(every))) if in_words else set()))
    docs = documents(df, key, c)
    found = vocabularies(df, docs, ranges, lengths, in_words, cap, min_df, max_df)
    tables = {}
    for name, terms in found.items():
        for n in lengths:
            mine = [(t, idf) for t, idf in terms if len(t) == n]
            if mine:
                codes = np.frombuffer("".join(t for t, _ in mine).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.int64)
                tables[name, n] = codes, np.array([x for _, x in mine])
    shared = df.sparkSession.sparkContext.broadcast(tables)
    struct = StructType.fromDDL("ngram_range string, term string, n_documents bigint, weight double")
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: (np.zeros(len(idf), np.int64), np.zeros(len(idf))) for k, (_, idf) in shared.value.items()}
        for chunk in chunks(batches, in_words):
            norms = {name: np.zeros(chunk.n_docs) for name in ranges}
            held = []
            known = {}
            for k, (codes, _) in shared.value.items():
                p = chunk.pack(codes)
                order = np.argsort(p)
                known[k] = p[order], order
            for n in lengths:
                for grams, docs_of, doc, tf in chunk.counts(n):
                    log = 1.0 + np.log(tf)
                    for name, sizes in ranges.items():
                        if (name, n) not in known:
                            continue
                        p, order = known[name, n]
                        at = np.minimum(np.searchsorted(p, grams), len(p) - 1)
                        hit = p[at] == grams
                        if not hit.any():
                            continue
                        which = np.repeat(np.where(hit, order[at], -1), docs_of)
                        some = np.flatnonzero(which >= 0)
                        which = which[some]
                        w = log[some]
                        if in_words:
                            w = w + np.log(np.repeat(np.where(hit, chunk.times(grams, n, sizes), 1), docs_of)[some])
                        w = w * shared.value[name, n][1][which]
                        norms[name] += np.bincount(doc[some], w * w, chunk.n_docs)
                        held.append((name, n, which.astype(np.int32), doc[some].astype(np.int32), w))
            for name, n, which, doc, w in held:
                count, weight = sums[name, n]
                count += np.bincount(which, minlength=len(count))
                weight += np.bincount(which, w / np.sqrt(norms[name])[doc], len(weight))
        for (name, n), (count, weight) in sums.items():
            at = np.flatnonzero(count)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(strings(shared.value[name, n][0][at])), pa.array(count[at]), pa.array(weight[at])], schema=arrow)

    return docs.mapInArrow(run, struct).groupBy("ngram_range", "term").agg(F.sum("n_documents").alias("n_documents"), F.sum("weight").alias("weight"))
