"""Problem 6: records of evaluation splits that occur, exactly or nearly, in train records.

Equal word sequences are collapsed into classes first. All suffixes of the classes' texts, one from every word, form a suffix
array that is partitioned by a hash of their first SEED words; what a task sees of a suffix are hashes of its first words and
four bits of each of the words around it, never texts. The longer text of a pair is tiled with segments, so many that one more
than the allowed edits are there. Segments are grouped in pairs and those in fours: as the edits are fewer than the segments,
some four have at most three edits, of its pairs one has at most one, and of that pair one segment has none. So one segment
is the beginning of a suffix of the shorter text, beside which its neighbour is found but for one edit and the other two but
for three in all. Segments are looked up in the sorted suffixes across splits; hits that lengths, places and the words beside
them allow become pairs of classes and are verified by a bit-parallel edit distance, first over one byte a word, then over words. No pair within the bound is
lost, however short its shared runs and however many texts share them.

Where a text is divided changes the cost only: segments grow to more words where a bounded sample (SAMPLE_TEXTS texts) has many
texts with the same words, and suffixes that begin with very frequent words are dealt to several partitions.

Defined results: null and empty texts, and texts under `least_words` words, are in no pair; records without a split, or of
another split, neither; repeated rows of the split index count once, records delivered again each count; ties are ordered by
record; empty tables give no pairs. A ValueError is raised if `most_edits` leaves segments of under SEED words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemill.llm.common import bounded_sample, cut, h32, map_batches, words, written
from tidemill.llm.groups import split_name

SEED, LONGEST, NEAR = 3, 8, 4
AFTER, BEFORE, SHIFT = 16, 16, 3
WORD_BITS = 4
SAMPLE_TEXTS = 8192
LEVEL_BITS = 22
PART_ENTRIES = 2_000_000
BATCH_WORDS = 600_000
CHUNK = 1 << 18
FEW, CELL, MOST_CELLS = 32, 8, 16
MOST_BROADCAST = 200_000
_A, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def distance(a: list[str] | bytes, b: list[str] | bytes) -> int:
    """Edits (insert, delete, replace) between two sequences of words or of bytes, bit-parallel over the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for w in b:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return score


def may_be_close(a: list[bytes], b: list[bytes], most_edits: float, rows: int = 1024) -> np.ndarray:
    """Whether each pair of byte sequences may be within the bound: each edit makes up for one byte of each side that the other one lacks."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), rows):
        counts, sizes = [], []
        for side in (a[k : k + rows], b[k : k + rows]):
            n = np.array([len(v) for v in side], np.int64)
            at = np.repeat(np.arange(len(n)) << 8, n) | np.frombuffer(b"".join(side), np.uint8)
            counts.append(np.bincount(at, minlength=len(n) << 8).astype(np.int32).reshape(len(n), 256))
            sizes.append(n)
        lacking = np.maximum(counts[0] - counts[1], 0).sum(axis=1)
        out[k : k + rows] = np.maximum(lacking, lacking - sizes[0] + sizes[1]) <= most_edits * np.maximum(*sizes)
    return out


def covered(a: list[str], b: list[str], run: int = NEAR) -> tuple[float, float]:
    """Share of the words of each text that lie in runs of `run` words of the other one, overlapping runs merged."""
    ga, gb = [list(zip(*(t[k:] for k in range(run)))) for t in (a, b)]
    out = []
    for grams, other, n in ((ga, set(gb), len(a)), (gb, set(ga), len(b))):
        to = total = 0
        for i, g in enumerate(grams):
            if g in other:
                total += i + run - max(i, to)
                to = i + run
        out.append(total / n if n else 0.0)
    return out[0], out[1]


def pick(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """rows semi or anti join ids; by broadcast only after the ids are counted, else by a shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, key, how)


def classes(records: DataFrame, splits: DataFrame, key: str, text: str, split: str, least_words: int) -> tuple[DataFrame, DataFrame]:
    """members: class, record, split; texts: one row per class with its words, whether it has train and other records."""
    named = splits.select(F.col(key).alias("_key"), split_name(F.col(split)).alias("_split")).where(F.col("_split").isin("train", "validation", "test")).distinct()
    rows = records.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(named, "_key")

    def fn(ids: list, texts: list, sides: list) -> dict[str, list]:
        tokens = [words(t) for t in texts]
        keep = [i for i, t in enumerate(tokens) if len(t) >= least_words]
        bodies = [" ".join(tokens[i]) for i in keep]
        marks = [bytes(h32(w) & 255 for w in tokens[i]) for i in keep]
        return {"marks": marks, "record_key": [ids[i] for i in keep], "split": [sides[i] for i in keep], "n_words": [len(tokens[i]) for i in keep], "class": [hashlib.md5(b.encode("utf-8", "surrogatepass")).digest() for b in bodies], "body": bodies}

    kind = records.schema[key].dataType.simpleString()
    rows = written(map_batches(rows, ["_key", "_text", "_split"], fn, f"record_key {kind}, split string, n_words int, class binary, body string, marks binary").withColumn("id", F.monotonically_increasing_id()))
    members = rows.select("class", "record_key", "split", "id")
    by_class = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("n"), F.max(F.col("split") == "train").alias("t"), F.max(F.col("split") != "train").alias("o"))
    several = cut(by_class.where("n > 1"))
    # Only the classes of several records are joined: every other record is its own class.
    small = several.count() <= MOST_BROADCAST
    joined = members.join(F.broadcast(several) if small else several, "class", "left")
    narrow = cut(joined.select(F.coalesce("class_id", "id").alias("class_id"), "id", "record_key", "split"))
    copies = narrow.where("class_id <> id").select("id")
    mixed = several.where("t and o").select(F.col("class_id").alias("id"), F.lit(True).alias("mixed"))
    texts = pick(rows.select("id", "body", "n_words", "split", "marks"), copies, "id", "left_anti")
    texts = texts.join(F.broadcast(mixed) if small else mixed, "id", "left")
    both = F.coalesce("mixed", F.lit(False))
    texts = texts.select("id", "body", "n_words", "marks", (both | (F.col("split") == "train")).alias("has_train"), (both | (F.col("split") != "train")).alias("has_other"))
    return narrow.select("class_id", F.col("record_key").alias(key), "split"), texts


class Batch:
    """The words of several texts in one array, with hashes of the runs from each word."""

    def __init__(self, bodies: list[str]):
        tokens = [b.split(" ") for b in bodies]
        self.n = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        ids = np.fromiter(map(h32, chain.from_iterable(tokens)), dtype=np.uint64, count=int(self.start[-1]))
        self.words = _mixed(ids + np.uint64(1))
        self.text = np.repeat(np.arange(len(tokens)), self.n)
        self.pos = np.arange(len(ids)) - self.start[self.text]
        self.left = self.n[self.text] - self.pos  # words from here to the end of the text

    def ahead(self, values: np.ndarray, k: int) -> np.ndarray:
        """The value k words further on (or back, if k < 0); 0 beyond the text."""
        out = np.zeros_like(values)
        if k >= 0:
            out[: len(values) - k] = values[k:]
            out[self.left <= k] = 0
        else:
            out[-k:] = values[:k]
            out[self.pos < -k] = 0
        return out

    def hashes(self, longest: int) -> list[np.ndarray]:
        """Hashes of the SEED to `longest` words from each word; of fewer where the text ends."""
        out, h = [], np.zeros_like(self.words)
        with np.errstate(over="ignore"):
            for k in range(longest):
                h = h * _A + self.ahead(self.words, k)
                if k + 1 >= SEED:
                    out.append(_mixed(h))
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words from which SEED words follow; of each, a 32-bit hash of those, and WORD_BITS bits of each of the words after and before them."""
        at = np.flatnonzero(self.left >= SEED)
        small = np.uint64(1) + (self.words >> np.uint64(20)) % np.uint64((1 << WORD_BITS) - 1)
        after, before = np.zeros_like(small), np.zeros_like(small)
        for k in range(AFTER):
            after |= self.ahead(small, SEED + k) << np.uint64(WORD_BITS * k)
        for k in range(BEFORE):
            before |= self.ahead(small, -1 - k) << np.uint64(WORD_BITS * k)
        return at, (self.hashes(SEED)[0] >> np.uint64(32)).astype(np.uint32)[at], after[at], before[at]


class Frequent:
    """How many texts of a sample hold a run of words, as a hashed table of levels, and the share of suffixes with a beginning."""

    def __init__(self, sample: list[str], longest: int = LONGEST):
        self.longest = longest
        self.level = np.zeros(1 << LEVEL_BITS, np.uint8)
        self.share = np.zeros(1 << 16, np.float32)
        if sample:
            b = Batch(sample)
            for k, h in enumerate(b.hashes(longest)):
                h = h[b.left >= SEED + k]
                kinds, counts = np.unique(h, return_counts=True)
                at, many = kinds[counts > 1], counts[counts > 1]
                np.maximum.at(self.level, (at >> np.uint64(64 - LEVEL_BITS)).astype(np.int64), np.minimum(8 * np.log2(many), 255).astype(np.uint8))
                if not k and len(h):
                    often = counts > 20
                    np.maximum.at(self.share, (kinds[often] >> np.uint64(48)).astype(np.int64), (counts[often] / len(h)).astype(np.float32))

    def costs(self, b: Batch) -> np.ndarray:
        """Of each length from SEED on and each word, how often the run is expected; runs past the end of the text cost too much."""
        value = np.append(0.0, 2 ** (np.arange(1, 256) / 8)).astype(np.float32)
        out = np.empty((self.longest - SEED + 1, len(b.words)), np.float32)
        for k, h in enumerate(b.hashes(self.longest)):
            out[k] = value[self.level[(h >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]] + 0.5 / (k + 1)
            out[k][b.left < SEED + k] = 1e9
        return out


def segment_count(n: int, most_edits: float) -> int:
    """Segments of a text of n words: over the edits, and even."""
    return int(n * most_edits) + 2 - int(n * most_edits) % 2


def pieces(n: int, most_edits: float, most_words: int = 192) -> list[tuple[int, int, int]]:
    """A text of n words as (first word, words, segments) of pieces to divide by themselves: one, unless it is long."""
    half, k = segment_count(n, most_edits) // 2, max(1, n // most_words)
    ends = [half * i // k for i in range(k + 1)]
    at = [n * e // half for e in ends]
    return [(at[i], at[i + 1] - at[i], 2 * (ends[i + 1] - ends[i])) for i in range(k)]


def tilings(costs: np.ndarray, starts: np.ndarray, n: int, count: int) -> np.ndarray:
    """Lengths of `count` neighbouring segments of SEED words or more, for each of several pieces of n words: those with the least sum of costs."""
    spare = n - SEED * count
    if spare < 0:
        raise ValueError(f"{n} words cannot be divided into {count} segments of {SEED}")
    more = min(len(costs), spare + 1)
    best = np.full((len(starts), spare + 1), np.float32(1e12))
    best[:, 0] = 0
    choice = np.zeros((count, len(starts), spare + 1), np.int8)
    at = starts[:, None] + np.arange(spare + 1)[None, :]
    for j in range(count):
        new = np.full_like(best, np.float32(1e12))
        here = np.minimum(at + SEED * j, costs.shape[1] - 1)
        for x in range(more):
            value = best[:, : spare + 1 - x] + costs[x][here[:, : spare + 1 - x]]
            better = value < new[:, x:]
            new[:, x:][better] = value[better]
            choice[j][:, x:][better] = x
        best = new
    # Words past the last segment stay free where segments of the longest kind cannot take them.
    left = best.argmin(axis=1)
    out = np.empty((len(starts), count), np.int64)
    rows = np.arange(len(starts))
    for j in range(count - 1, -1, -1):
        out[:, j] = SEED + choice[j][rows, left]
        left = left - choice[j][rows, left]
    return out


def segments(b: Batch, frequent: Frequent, most_edits: float) -> np.ndarray:
    """Of each word, 0 or the segment that begins there.

    Its length (4 bits), whether its neighbour has NEAR words or more, whether it comes before, and whether the pair is alone
    (a bit each); the words of its four after it and before it (4 bits each, at most 15).
    """
    codes = np.zeros(len(b.words), np.uint16)
    if not len(codes):
        return codes
    costs, alike = frequent.costs(b), {}
    for n, start in zip(b.n.tolist(), b.start.tolist()):
        for first, size, count in pieces(n, most_edits):
            alike.setdefault((size, count), []).append(start + first)
    for (size, count), starts in alike.items():
        for k in range(0, len(starts), 512):
            at = np.array(starts[k : k + 512], np.int64)
            lengths = tilings(costs, at, size, count)
            ends = np.cumsum(lengths, axis=1)
            j = np.arange(count)
            first = j // 4 * 4
            last = np.minimum(first + 4, count) - 1
            after, before = ends[:, last] - ends, ends - lengths - (ends - lengths)[:, first]
            partner = lengths[:, j ^ 1]
            code = np.minimum(lengths, LONGEST) | (partner >= NEAR) << 4 | (j & 1 > 0) << 5 | (last - first < 2) << 6 | np.minimum(after, 15) << 8 | np.minimum(before, 15) << 12
            codes[at[:, None] + ends - lengths] = code
    return codes


PLANES = ((4, np.uint32), (-(-AFTER * WORD_BITS // 8), np.uint64), (-(-BEFORE * WORD_BITS // 8), np.uint64), (2, np.uint16), (1, np.uint8), (3, np.uint32), (4, np.uint32))


def planes(v: np.ndarray, k: int) -> bytes:
    """The k lowest bytes of the values, byte by byte, so that equal bytes stand together."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1)[:, :k].T).tobytes()


def values(blob: bytes, k: int, kind: type) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(k, -1)
    v = np.zeros((raw.shape[1], np.dtype(kind).itemsize), np.uint8)
    v[:, :k] = raw.T
    return v.view(kind)[:, 0]


def pack(*columns: np.ndarray) -> bytes:
    """The entries of a partition (key, words after and before, segment, whether only that, owner, place), sorted by key."""
    order = np.argsort(columns[0], kind="stable")
    return pa.compress(b"".join(planes(v.astype(kind)[order], k) for v, (k, kind) in zip(columns, PLANES)), codec="zstd", asbytes=True)


def unpack(blob: bytes, m: int) -> list[np.ndarray]:
    out, at = [], 0
    blob = pa.decompress(blob, m * sum(k for k, _ in PLANES), codec="zstd", asbytes=True)
    for k, kind in PLANES:
        out.append(values(blob[at : at + k * m], k, kind))
        at += k * m
    return out


def suffixes(texts: DataFrame, frequent: Frequent, most_edits: float, parts: int) -> DataFrame:
    """Rows of (part, number of entries, entries, classes): the suffixes of a batch of texts that a partition of the suffix array gets."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    struct = StructType.fromDDL("part int, m int, entries binary, ids binary, sizes binary, sides binary")
    arrow = to_arrow_schema(struct)

    def rows(ids: list, bodies: list, sides: list) -> Iterator[pa.RecordBatch]:
        f = shared.value
        b = Batch(bodies)
        at, key, after, before = b.entries()
        code = segments(b, f, most_edits)[at]
        ids, sides = np.array(ids, np.int64), np.array(sides, np.uint8)
        salts = np.maximum(np.ceil(2 * parts * f.share[key >> np.uint32(16)]).astype(np.int64), 1)
        salt = np.where(salts > 1, (_mixed(ids.view(np.uint64) + np.uint64(7)) >> np.uint64(1)).astype(np.int64)[b.text[at]] % salts, 0)
        only = np.zeros(len(at), bool)
        again = np.flatnonzero((salts > 1) & (code > 0))  # segments meet the suffixes of every salt
        if len(again):
            which = np.repeat(again, salts[again])
            turn = np.arange(len(which)) - np.repeat(np.cumsum(salts[again]) - salts[again], salts[again])
            keep = turn != salt[which]
            which, turn = which[keep], turn[keep]
            only = np.concatenate([only, np.ones(len(which), bool)])
            at, key, after, before, code, salts = (np.concatenate([v, v[which]]) for v in (at, key, after, before, code, salts))
            salt = np.concatenate([salt, turn])
        part = (key.astype(np.int64) * parts) >> 32  # ranges of keys, so that the first bytes of a partition's keys are alike
        part = np.where(salts > 1, (part + salt * (parts // 7 + 1)) % parts, part)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1)) if parts <= len(part) else None
        used = np.unique(part)
        out: dict[str, list] = {x.name: [] for x in arrow}
        for p in used.tolist():
            mine = order[edges[p] : edges[p + 1]] if edges is not None else np.flatnonzero(part == p)
            owners, owner = np.unique(b.text[at[mine]], return_inverse=True)
            for c, v in zip(out, (p, len(mine), pack(key[mine], after[mine], before[mine], code[mine], only[mine], owner, b.pos[at[mine]]), planes(ids[owners], 8), planes(b.n[owners], 4), sides[owners].tobytes())):
                out[c].append(v)
        for k in range(0, len(used), 64):
            yield pa.RecordBatch.from_pydict({x.name: pa.array(out[x.name][k : k + 64], x.type) for x in arrow}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        bodies: list = []
        sides: list = []
        held = 0
        for batch in batches:
            for i, body, n, t, o in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i), bodies.append(body), sides.append(2 * bool(t) + bool(o))
                held += n
                if held >= BATCH_WORDS:
                    yield from rows(ids, bodies, sides)
                    ids, bodies, sides, held = [], [], [], 0
        if ids:
            yield from rows(ids, bodies, sides)

    return texts.select("id", "body", "n_words", "has_train", "has_other").mapInArrow(run, struct)


def _one_edit() -> np.ndarray:
    """For up to NEAR words beside a segment: whether equal words in place, one further and one nearer (NEAR bits each) allow one edit."""
    out = np.zeros((NEAR + 1, 1 << (3 * NEAR)), bool)
    for p in range(NEAR + 1):
        for bits in range(1 << (3 * NEAR)):
            same, further, nearer = ([bits >> (d * NEAR + i) & 1 for i in range(NEAR)] for d in range(3))
            k = next((i for i in range(p) if not same[i]), p)
            out[p, bits] = k >= p or all(same[k + 1 : p]) or all(further[k:p]) or all(nearer[k + 1 : p])
    return out


ONE_EDIT = _one_edit()
# Which of NEAR words (a bit each) are 0, of all their bits.
EQUAL = sum(((np.arange(1 << WORD_BITS * NEAR) >> WORD_BITS * k & (1 << WORD_BITS) - 1) == 0).astype(np.int64) << k for k in range(NEAR))


def alone(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the first `size` words of x, how many equal no word of y up to SHIFT places away: never more than `beside` finds."""
    lowest = np.uint64(sum(1 << WORD_BITS * k for k in range(64 // WORD_BITS)))
    differ = lowest & ((np.uint64(1) << (np.uint64(WORD_BITS) * size.astype(np.uint64))) - np.uint64(1))
    for d in range(-SHIFT, SHIFT + 1):
        v = x ^ (y >> np.uint64(WORD_BITS * d) if d >= 0 else y << np.uint64(-WORD_BITS * d))
        v |= v >> np.uint64(1)
        differ &= v | v >> np.uint64(2)
    return np.bitwise_count(differ).astype(np.int64)


def beside(x: np.ndarray, y: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Least edits between the first `size` (at most `most`) words of x and any beginning of y, up to SHIFT: WORD_BITS bits a word, from the lowest on."""
    width, large = 2 * SHIFT + 1, np.int8(SHIFT + 1)
    word_of = lambda v, k: v >> np.uint64(WORD_BITS * k) & np.uint64((1 << WORD_BITS) - 1)
    row = [np.full(len(x), abs(d - SHIFT) if d >= SHIFT else large, np.int8) for d in range(width)]
    out = np.where(size == 0, np.int8(0), large)
    words_y = [word_of(y, k) for k in range(most + SHIFT)]
    for i in range(1, most + 1):
        word, new = word_of(x, i - 1), []
        for d in range(width):
            j = i + d - SHIFT  # x's first i words against y's first j
            if j < 0:
                new.append(np.full(len(x), large, np.int8))
                continue
            value = np.full(len(x), np.int8(i), np.int8) if j == 0 else row[d] + (word != words_y[j - 1]).astype(np.int8)
            if d + 1 < width:
                value = np.minimum(value, row[d + 1] + np.int8(1))
            if d and j:
                value = np.minimum(value, new[d - 1] + np.int8(1))
            new.append(np.minimum(value, large))
        row = new
        least = np.minimum.reduce(row)
        out = np.where(size == i, least, out)
    return out


class Part:
    """One partition of the suffix array: its entries sorted by key, and the classes that they belong to."""

    def __init__(self, most_edits: float):
        self.most_edits = most_edits
        self.columns: list[list[np.ndarray]] = []
        self.classes: list[tuple] = []
        self.known = 0

    def add(self, m: int, entries: bytes, ids: bytes, sizes: bytes, sides: bytes) -> None:
        columns = unpack(entries, m)
        columns[5] = columns[5].astype(np.int64) + self.known
        self.columns.append(columns)
        self.classes.append((values(ids, 8, np.int64), values(sizes, 4, np.int64), np.frombuffer(sides, np.uint8)))
        self.known += len(self.classes[-1][0])

    def pairs(self) -> Iterator[np.ndarray]:
        """Pairs (train class, other class), without repetition within what is yielded."""
        if not self.columns:
            return
        key, after, before, code, only, owner, pos = (np.concatenate(c) for c in zip(*self.columns))
        ids, n, sides = (np.concatenate(c) for c in zip(*self.classes))
        self.columns, self.classes = [], []
        key = key.astype(np.uint64)
        for k in range(LONGEST - SEED):  # the words from the fourth to the eighth order suffixes that begin alike
            key = key << np.uint64(WORD_BITS) | (after >> np.uint64(WORD_BITS * k) & np.uint64((1 << WORD_BITS) - 1))
        table = (key, after, before, code.astype(np.int64), owner, pos.astype(np.int64), n.astype(np.int64), ids)
        order = np.argsort(key, kind="stable")
        side = sides[owner[order]]
        for mine, other in ((2, 1), (1, 2)):  # segments of train texts in suffixes of others, and the other way round
            for i, j in self._hits(order[(code[order] > 0) & (side & mine > 0)], order[(only[order] == 0) & (side & other > 0)], *table[:-1]):
                a, b = ids[owner[i]], ids[owner[j]]
                yield np.unique(np.column_stack([a, b] if mine == 2 else [b, a]), axis=0)

    def _hits(self, t: np.ndarray, s: np.ndarray, key: np.ndarray, after: np.ndarray, before: np.ndarray, code: np.ndarray, owner: np.ndarray, pos: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Segments t and suffixes s that begin with them, as far as lengths, places and the words beside them allow."""
        keys = key[s]
        rest = (np.uint64(1) << (np.uint64(WORD_BITS) * (LONGEST - (code[t] & 15)).astype(np.uint64))) - np.uint64(1)
        first = np.searchsorted(keys, key[t] & ~rest)
        count = np.searchsorted(keys, key[t] | rest, side="right") - first
        t, first, count, rest = t[count > 0], first[count > 0], count[count > 0], rest[count > 0]
        na = n[owner[t]]
        edits = (na * self.most_edits).astype(np.int64)
        many = (count > FEW) & (edits <= MOST_CELLS * CELL)
        searches = [(s, t[~many], first[~many], count[~many], edits[~many])]
        for r in np.unique(rest[many]):
            mine = np.flatnonzero(many & (rest == r))
            searches.append(self._placed(s, keys & ~r, t[mine], first[mine], count[mine], edits[mine], pos, n, owner))
        for s_, t_, first_, count_, edits_ in searches:
            n_s, pos_s, total = n[owner[s_]], pos[s_], np.cumsum(count_)
            for begin in range(0, int(total[-1]) if len(total) else 0, CHUNK):
                end = min(begin + CHUNK, int(total[-1]))
                x, y = np.searchsorted(total, (begin, end - 1), side="right")
                runs = np.minimum(total[x : y + 1], end) - np.maximum(total[x : y + 1] - count_[x : y + 1], begin)
                which = np.repeat(np.arange(x, y + 1), runs)
                at = np.arange(begin, end) + (first_ - (total - count_))[which]
                shift = pos[t_][which] - pos_s[at]
                longer = n[owner[t_]][which] - n_s[at]
                ok = np.flatnonzero((longer >= 0) & (np.abs(shift) + np.abs(longer - shift) <= edits_[which]))
                i, j = t_[which[ok]], s_[at[ok]]
                ok = owner[i] != owner[j]
                i, j = i[ok], j[ok]
                for test in (self._neighbour, self._near_four, self._four):
                    ok = test(i, j, after, before, code)
                    i, j = i[ok], j[ok]
                if len(i):
                    yield i, j

    @staticmethod
    def _placed(s: np.ndarray, prefix: np.ndarray, t: np.ndarray, first: np.ndarray, count: np.ndarray, edits: np.ndarray, pos: np.ndarray, n: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """The search of segments t of one length, which many suffixes begin with, narrowed to those whose places the edits allow.

        The suffixes of the runs are ordered by run, cell of CELL words from the beginning, and words to the end; a segment looks
        at a range of each cell within its edits. Returns suffixes, segments (once for each cell), ranges and edits.
        """
        inside = np.zeros(len(s) + 1, np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, first + count, -1)
        member = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        top = np.int64(0xFFFF)
        run = np.cumsum(np.append(0, prefix[member][1:] != prefix[member][:-1]))
        here = s[member]
        place = run << 32 | np.minimum(pos[here] // CELL, top) << 16 | np.minimum(n[owner[here]] - pos[here], top)
        order = np.argsort(place)
        place = place[order]
        # |shift| + |longer - shift| <= edits and longer >= 0 leave shifts from -edits / 2 to edits, and as many words more to the end.
        low, high = np.maximum(pos[t] - edits, 0) // CELL, (pos[t] + edits // 2) // CELL
        cells = high - low + 1
        which = np.repeat(np.arange(len(t)), cells)
        cell = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
        most, least = pos[t][which] - cell * CELL, pos[t][which] - cell * CELL - (CELL - 1)  # shifts of the cell
        spare = edits[which] - np.maximum(np.maximum(least, -most), 0)
        to_end = (n[owner[t]] - pos[t])[which]
        base = run[np.searchsorted(member, first)][which] << 32 | np.minimum(cell, top) << 16
        begin = np.searchsorted(place, base | np.clip(to_end - spare, 0, top))
        end = np.searchsorted(place, base | np.clip(to_end + np.minimum(spare, most), 0, top), side="right")
        some = np.flatnonzero((end > begin) & (to_end + np.minimum(spare, most) >= 0))
        return here[order], t[which[some]], begin[some], (end - begin)[some], edits[which[some]]

    @staticmethod
    def _neighbour(i: np.ndarray, j: np.ndarray, after: np.ndarray, before: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether at most one edit lies in the neighbouring segment, of which up to NEAR words are looked at."""
        c = code[i]
        size, back = c & 15, c & 32 > 0
        move = np.uint64(WORD_BITS) * (size - SEED).astype(np.uint64)
        mine, other = (np.where(back, before[v], after[v] >> move) for v in (i, j))
        near = np.minimum(SEED + (c >> 4 & 1), np.where(back, BEFORE, AFTER + SEED - size) - 1)
        bits = np.zeros(len(i), np.int64)
        for d, v in enumerate((mine ^ other, mine ^ (other >> np.uint64(WORD_BITS)), mine ^ (other << np.uint64(WORD_BITS)))):
            bits |= EQUAL[(v & np.uint64(len(EQUAL) - 1)).astype(np.int64)] << (d * NEAR)
        return ONE_EDIT[near, bits]

    @staticmethod
    def _near_four(i: np.ndarray, j: np.ndarray, after: np.ndarray, before: np.ndarray, code: np.ndarray) -> np.ndarray:
        """A bound of what _four finds, in a few operations: words that no word of the other text up to SHIFT places away equals."""
        c = code[i]
        move = np.uint64(WORD_BITS) * ((c & 15) - SEED).astype(np.uint64)
        ahead = alone(after[i] >> move, after[j] >> move, np.minimum(c >> 8 & 15, AFTER - SHIFT + SEED - (c & 15)))
        back = alone(before[i], before[j], np.minimum(c >> 12, BEFORE - SHIFT))
        return ahead + back <= np.where(c & 64 > 0, 1, SHIFT)

    @staticmethod
    def _four(i: np.ndarray, j: np.ndarray, after: np.ndarray, before: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether at most three edits lie in the four segments (or one in a pair that is alone), as far as the words beside are known."""
        c = code[i]
        move = np.uint64(WORD_BITS) * ((c & 15) - SEED).astype(np.uint64)
        ahead = beside(after[i] >> move, after[j] >> move, np.minimum(c >> 8 & 15, AFTER - SHIFT + SEED - (c & 15)), AFTER - SHIFT)
        back = beside(before[i], before[j], np.minimum(c >> 12, BEFORE - SHIFT), BEFORE - SHIFT)
        return ahead + back <= np.where(c & 64 > 0, 1, SHIFT)


def candidates(texts: DataFrame, most_edits: float) -> DataFrame:
    """Pairs (train class, other class), once each, in which a segment of the longer text and its neighbour are found in the shorter one."""
    session = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).collect()[0]["words"]
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_ENTRIES))
    frequent = Frequent([r["body"] for r in bounded_sample(texts, "id", ["id", "body"], SAMPLE_TEXTS)])
    struct = StructType.fromDDL("a_id bigint, b_id bigint")
    arrow = to_arrow_schema(struct)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Part] = {}
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, Part(most_edits)).add(*row)
        while held:
            for found in held.popitem()[1].pairs():
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=arrow)

    array = suffixes(texts, frequent, most_edits, parts).repartitionById(parts, "part")
    return array.mapInArrow(search, struct).distinct()


def beside_each_other(pairs: DataFrame, texts: DataFrame, what: str) -> DataFrame:
    """pairs (a_id, b_id) with a column of both classes."""
    ids = pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct()
    some = cut(pick(texts.select("id", what), ids, "id", "left_semi"))
    for x in ("a", "b"):
        pairs = pairs.join(some.select(F.col("id").alias(f"{x}_id"), F.col(what).alias(f"{x}_{what}")), f"{x}_id")
    return pairs


def near_pairs(records: DataFrame, splits: DataFrame, key: str = "record_id", text: str = "generated_text", split: str = "split", least_words: int = 35, most_edits: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (train class, other class) within the edit bound, with edits and coverage; and the members of classes."""
    for n in range(least_words, least_words + 64):
        if n < SEED * segment_count(n, most_edits):
            raise ValueError(f"{most_edits} of {n} words edited leave segments of under {SEED} words")
    members, texts = classes(records, splits, key, text, split, least_words)
    pairs = cut(candidates(texts, most_edits))
    pairs = beside_each_other(pairs, texts, "marks")

    def close(a_id: list, b_id: list, a: list, b: list) -> dict[str, list]:
        ok = [k for k in np.flatnonzero(may_be_close(a, b, most_edits)).tolist() if distance(a[k], b[k]) <= most_edits * max(len(a[k]), len(b[k]))]
        return {"a_id": [a_id[k] for k in ok], "b_id": [b_id[k] for k in ok]}

    pairs = cut(map_batches(pairs, ["a_id", "b_id", "a_marks", "b_marks"], close, "a_id bigint, b_id bigint"))
    joined = beside_each_other(pairs, texts, "body")

    def fn(a_id: list, b_id: list, a_body: list, b_body: list) -> dict[str, list]:
        out: dict[str, list] = {"a_id": [], "b_id": [], "edits": [], "longer": [], "a_covered": [], "b_covered": []}
        for x, y, s, t in zip(a_id, b_id, a_body, b_body):
            u, v = s.split(" "), t.split(" ")
            longer = max(len(u), len(v))
            e = distance(u, v)
            if e <= most_edits * longer:
                for c, value in zip(out, (x, y, e, longer, *covered(u, v))):
                    out[c].append(value)
        return out

    near = map_batches(joined, ["a_id", "b_id", "a_body", "b_body"], fn, "a_id bigint, b_id bigint, edits int, longer int, a_covered double, b_covered double")
    same = texts.where("has_train and has_other").select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(0).alias("edits"), F.col("n_words").alias("longer"), F.lit(1.0).alias("a_covered"), F.lit(1.0).alias("b_covered"))
    return near.unionByName(same), members


def cross_split_pairs(records: DataFrame, splits: DataFrame, key: str = "record_id", **options) -> DataFrame:
    """Pairs of one train record and one other record: the classes' pairs, expanded to all their members."""
    pairs, members = near_pairs(records, splits, key, **options)
    a = members.where("split = 'train'").select(F.col("class_id").alias("a_id"), F.col(key).alias("a_key"))
    b = members.where("split <> 'train'").select(F.col("class_id").alias("b_id"), F.col(key).alias("b_key"), F.col("split").alias("other_split"))
    return pairs.join(a, "a_id").join(b, "b_id").select(F.least("a_key", "b_key").alias(f"{key}_a"), F.greatest("a_key", "b_key").alias(f"{key}_b"), F.col("b_key").alias("other_key"), "other_split", "edits", "longer", F.col("a_covered").alias("train_covered"), F.col("b_covered").alias("other_covered"))


def overlapping_records(records: DataFrame, splits: DataFrame, key: str = "record_id", **options) -> DataFrame:
    """Each validation or test record with its number of pairs and of equal ones, and the largest share of it that a train record has.

    The members of classes are counted, never expanded into pairs.
    """
    pairs, members = near_pairs(records, splits, key, **options)
    trained = members.where("split = 'train'").groupBy(F.col("class_id").alias("a_id")).agg(F.count("*").alias("_n"))
    by = pairs.join(trained, "a_id").groupBy(F.col("b_id").alias("class_id")).agg(F.sum("_n").alias("n_pairs"), F.sum(F.when(F.col("edits") == 0, F.col("_n")).otherwise(0)).alias("n_equal_pairs"), F.max("b_covered").alias("covered"))
    return members.where("split <> 'train'").join(by, "class_id").select(key, "split", "n_pairs", "n_equal_pairs", "covered")
