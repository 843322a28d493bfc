"""Problem 8: evaluation passages inside corpus documents.

Q-gram lemma filtering: the q-grams of the normalised items are hashed once and broadcast (the items are a stated query set:
`most_items` of them at most are taken at a time, larger sets go through in blocks). Each document's q-grams are looked up,
and the hits are counted per item and diagonal band, in bands of 2 * STEP characters that overlap by half, so that replaced
words of other lengths stay in one band. A window of `least_words` words with a tenth of them replaced keeps at least
(q-grams of the window) - (those that the longest replaceable words cover) of its q-grams; bands with fewer are dropped.
What is left is verified by aligning words in a band around the diagonal: a run must begin and end with equal words, hold
at least `least_words` words of the item, and have at most one edit in ten words. An edit is a replaced word; with
`most_shift` over 0 the band is that wide to either side, and a dropped, added, joined or divided word counts as an edit, too.

Defined results: null, empty and blank texts or items match nothing; items under `least_words` words neither; repeated
documents and items are each reported; an empty table gives no rows; texts are processed whole, whatever their length.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, clean, cut, map_batches

Q, STEP = 9, 24
FILTER_BITS = 22
TAG = re.compile(r"<(?:!--.*?--|/?[a-zA-Z][^<>]{0,200})>", re.S)
WRONG = re.compile("[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3}")
HYPHEN = re.compile(r"(?<=[a-z])-\r?\n(?=[a-z])")
_B = np.uint64(0x9E3779B97F4A7C15)


def _mend(m: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return m.group(0).encode(codec).decode("utf-8")
        except UnicodeError:
            continue
    return m.group(0)


def normal_words(text: str) -> list[str]:
    """Words aside from case, punctuation, spacing, line breaks, quote marks, entities, markup and wrong decoding."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = clean(WRONG.sub(_mend, text))
    if "<" in text:
        text = TAG.sub(" ", text)
    return WORD.findall(text.lower().replace("_", " "))


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each q-gram of a text of character codes."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        one = codes.astype(np.uint64) + np.uint64(1)
        two = one[:-1] * _B + one[1:]
        four = two[:-2] * (_B * _B) + two[2:]
        eight = four[:-4] * (_B * _B * _B * _B) + four[4:]
        h = eight[:n] * _B + one[Q - 1 :]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def codes_of(tokens: list[str]) -> np.ndarray:
    return np.frombuffer(" ".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class ItemIndex:
    """The q-grams of the items, sorted by hash, with the count that a matching band must reach."""

    def __init__(self, items: list[tuple], least_words: int, most_shift: int = 0):
        self.least, self.shift, self.ids, self.words, bounds = least_words, most_shift, [], [], []
        hashes, owners, places = [], [], []
        for key, text in items:
            ws = normal_words(text or "")
            if len(ws) < least_words:
                continue
            lens = np.array([len(w) for w in ws])
            lost = least_words // 10
            need = []
            for i in range(len(ws) - least_words + 1):
                w = lens[i : i + least_words]
                gone = np.sort(w)[::-1][:lost] + Q
                need.append(int(w.sum()) + least_words - 1 - Q + 1 - int(gone.sum()))
            bounds.append(max(6, min(need)))
            h = gram_hashes(codes_of(ws))
            hashes.append(h), owners.append(np.full(len(h), len(self.ids), np.int32)), places.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(key), self.words.append(ws)
        self.bounds = np.array(bounds, dtype=np.int64)
        self.least_hits = int(self.bounds.min()) if bounds else 0
        if not self.ids:
            self.keys = np.zeros(0, np.uint64)
            return
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.owner, self.place = np.concatenate(owners)[order], np.concatenate(places)[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.steps = int(self.place.max()) // STEP + 1

    def candidates(self, codes: np.ndarray) -> list[int]:
        """Items with a diagonal band that reaches their bound."""
        if not len(self.keys):
            return []
        h = gram_hashes(codes)
        hit = np.flatnonzero(self.maybe[h >> np.uint64(64 - FILTER_BITS)])
        if len(hit) < self.least_hits:
            return []
        at = np.searchsorted(self.keys, h[hit])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == h[hit]
        hit, slot = hit[same], at[same]
        if len(hit) < self.least_hits:
            return []
        n = self.count[slot]
        where = np.repeat(hit, n)
        flat = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        band = (where - self.place[flat]) // STEP + self.steps
        width = int(len(h)) // STEP + self.steps + 2
        owner = self.owner[flat].astype(np.int64)
        # A band is two steps wide and overlaps the next one by half: hits of a step count for both bands that hold it.
        if width * len(self.ids) <= 8_000_000:
            counts = np.bincount(owner * width + band, minlength=width * len(self.ids)).reshape(len(self.ids), width)
            most = (counts[:, :-1] + counts[:, 1:]).max(axis=1)
            return np.flatnonzero(most >= self.bounds).tolist()
        key, counts = np.unique(owner * width + band, return_counts=True)
        after = np.append((np.diff(key) == 1) * counts[1:], 0)
        return np.unique((key // width)[counts + after >= self.bounds[key // width]]).tolist()

    def verify(self, tokens: list[str], item: int, positions: dict[str, list[int]]) -> bool:
        """A run of the item's words in the document, within the edits: first along one diagonal of words, then in a band."""
        ws = self.words[item]
        diagonals: dict[int, list[int]] = {}
        for j, w in enumerate(ws):
            for i in positions.get(w, ()):
                diagonals.setdefault(i - j, []).append(j)
        for js in diagonals.values():
            if len(js) < self.least - self.least // 10:
                continue
            a = np.array(js)
            # From match x to match y: a[y] - a[x] + 1 words of the item, of which y - x + 1 are equal.
            length = a[None, :] - a[:, None] + 1
            same = np.arange(len(a))[None, :] - np.arange(len(a))[:, None] + 1
            if ((length >= self.least) & (same > 0) & ((length - same) * 10 <= length)).any():
                return True
        return bool(self.shift) and self._banded(diagonals, len(ws))

    def _banded(self, diagonals: dict[int, list[int]], n: int) -> bool:
        """Chains of equal words whose diagonals lie within a band; between two of them, the edits are the longer gap."""
        for d in diagonals:
            band = [(j, j + e) for e in range(d, d + self.shift + 1) for j in diagonals.get(e, ())]
            if len({j for j, _ in band}) < self.least - self.least // 10 - 1:
                continue
            band.sort()
            most = n // 10
            for s, (j0, i0) in enumerate(band):
                if n - j0 < self.least:
                    break
                edits = {s: 0}
                for t in range(s + 1, len(band)):
                    j, i = band[t]
                    if i <= i0 or j <= j0:
                        continue
                    best = min((e + max(j - band[u][0], i - band[u][1]) - 1 for u, e in edits.items() if band[u][0] < j and band[u][1] < i and j - band[u][0] <= most + 1), default=most + 1)
                    if best <= most:
                        edits[t] = best
                        length = j - j0 + 1
                        if length >= self.least and best * 10 <= length:
                            return True
        return False

    def leaks(self, text: str | None) -> list[int]:
        if not text:
            return []
        tokens = normal_words(HYPHEN.sub("", text)) if "-\n" in text or "-\r" in text else normal_words(text)
        if len(tokens) < self.least:
            return []
        found = self.candidates(codes_of(tokens))
        if not found:
            return []
        positions: dict[str, list[int]] = {}
        for i, w in enumerate(tokens):
            positions.setdefault(w, []).append(i)
        return sorted(k for k in found if self.verify(tokens, k, positions))


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", least_words: int = 20, most_items: int = 20_000, most_shift: int = 0) -> DataFrame:
    """(doc, item): documents that hold a passage of an item.

    More than `most_items` items go through in blocks, one scan each; a block's results are written, and its index is given up,
    before the next block is read, so that the driver and the workers hold one block at a time.
    """
    spark, out = documents.sparkSession, None
    rows = items.where(F.col(item_text).isNotNull()).select(item_key, item_text)
    n = rows.count()
    parts = max(1, -(-n // most_items))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(parts)) == k)
        index = spark.sparkContext.broadcast(ItemIndex(sorted((r[0], r[1]) for r in part.collect()), least_words, most_shift))

        def fn(ids: list, texts: list, index=index) -> dict[str, list]:
            found: dict[str, list] = {"doc_key": [], "item_key": []}
            for i, t in zip(ids, texts):
                for j in index.value.leaks(t):
                    found["doc_key"].append(i), found["item_key"].append(index.value.ids[j])
            return found

        block = map_batches(documents.where(F.col(text).isNotNull()), [key, text], fn, f"doc_key {kind(documents, key)}, item_key {kind(items, item_key)}")
        if parts > 1:
            block = cut(block)
            index.unpersist()
        out = block if out is None else out.unionByName(block)
    return out.select(F.col("doc_key").alias(key), F.col("item_key").alias(item_key))
