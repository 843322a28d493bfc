"""Problem 3: a reading level for each English prose text.

Sentences of the graded passages train regularised word and character models (one logistic model per level over hashed
words and character trigrams, with sentence length, word length and syllables as dense features). A document's mean sentence
distribution, weighted by words, goes through a small calibration fitted on out-of-fold predictions of whole passages.

Defined results: null, empty and short texts (under `least_words` words), texts that aren't English and texts that aren't
prose have no level (null); refusals have none either; ties go to the middle level; an empty table gives no rows; if there
are no graded passages, a ValueError is raised. The graded passages are read whole: they define the scale and are few
(at most `most_passages` are accepted, else a ValueError is raised, so the driver's memory is bounded).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, HashedLogit, clean, h32, language, map_batches
from tidemill.llm.shapes import PROSE, describe, majority
from tidemill.llm.truncation import FIRST_PERSON

LEVELS = ("basic", "intermediate", "advanced")
BITS = 16
SENTENCE = re.compile(r"[^.!?。！？\n]+")
VOWEL_RUN = re.compile("[aeiouyàâäéèêëîïôöûü]+")
N_DENSE = 9


def sentences(text: str) -> list[tuple[list[str], int]]:
    """The words of each sentence, in lower case, and its commas; pieces without words are left out."""
    return [(w, s.count(",")) for s in SENTENCE.findall(clean(text).lower()) if (w := WORD.findall(s))]


def word_features(w: str) -> list[int]:
    """Hashed features of a word: itself, its character trigrams, its ending."""
    if w.isdigit():
        return [h32("#") & ((1 << BITS) - 1)]
    p = f"<{w}>"
    return [h32(x) & ((1 << BITS) - 1) for x in (f"w {w}", *(p[i : i + 3] for i in range(len(p) - 2)), f"s {w[-4:]}")]


def shapes_of(sums: np.ndarray, n: np.ndarray, commas: np.ndarray) -> np.ndarray:
    """Dense features of sentences. sums: letters, syllables, words of 9 letters or more, of 3 or less, of 12 or more."""
    return np.column_stack([np.minimum(n, 60) / 20.0, sums[:, 0] / n / 5.0, sums[:, 1:] / n[:, None], np.minimum(commas, 8) / 3.0, n >= 30, (n >= 30) & (commas >= 3)]).astype(float)


def measures(w: str) -> tuple:
    return (len(w), syllables(w), len(w) >= 9, len(w) <= 3, len(w) >= 12)


def syllables(w: str) -> int:
    return max(1, len(VOWEL_RUN.findall(w.rstrip("e"))))


class LevelModel:
    def __init__(self, passages: list[tuple[str, str]]):
        rows, dense, y, doc = [], [], [], []
        for i, (level, text) in enumerate(passages):
            for ws, commas in sentences(text):
                rows.append(np.array([f for w in ws for f in word_features(w)], dtype=np.int64))
                dense.append(shapes_of(np.array([measures(w) for w in ws], dtype=float).sum(0)[None, :], np.array([len(ws)]), np.array([commas]))[0])
                y.append(LEVELS.index(level)), doc.append(i)
        if not rows:
            raise ValueError("no graded passages to learn the levels from")
        dense, y, doc = np.array(dense), np.array(y), np.array(doc)
        weight = np.array([len(r) for r in rows], dtype=float)
        levels = np.array([LEVELS.index(level) for level, _ in passages])
        # Out-of-fold distributions of whole passages, for the calibration.
        folds, means = 4, np.zeros((len(passages), 3))
        for k in range(folds):
            test = doc % folds == k
            if test.any() and (~test).any():
                models = self._fit([rows[i] for i in np.flatnonzero(~test)], dense[~test], y[~test])
                p = self._sentence(models, [rows[i] for i in np.flatnonzero(test)], dense[test])
                for i in np.unique(doc[test]):
                    at = doc[test] == i
                    means[i] = np.average(p[at], axis=0, weights=weight[test][at])
        self.calibration = self._calibrate(means, levels)
        self.accuracy = float((np.argmax(self.posterior(means), axis=1) == levels).mean())
        self.models = self._fit(rows, dense, y)
        self._table: list[tuple] = []
        self._words: dict[str, int] = {}

    @staticmethod
    def _fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> list[HashedLogit]:
        return [HashedLogit(BITS, N_DENSE, l2=1e-3).fit(rows, dense, (y == k).astype(float), epochs=10) for k in range(3)]

    @staticmethod
    def _sentence(models: list[HashedLogit], rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        p = np.stack([m.scores(rows, dense) for m in models], axis=1) + 1e-6
        return p / p.sum(1, keepdims=True)

    @staticmethod
    def _calibrate(means: np.ndarray, levels: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
        w, b, x = np.eye(3) * 4.0, np.zeros(3), means
        for _ in range(rounds):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(3)[levels]) / len(x)
            w -= 1.0 * (x.T @ g + 1e-3 * w)
            b -= 1.0 * g.sum(0)
        return w, b

    def posterior(self, means: np.ndarray) -> np.ndarray:
        w, b = self.calibration
        z = means @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def _row(self, w: str) -> int:
        f = word_features(w)
        k = len(self._table)
        self._table.append((len(f), *(float(m.w[f].sum()) for m in self.models), *measures(w)))
        self._words[w] = k
        return k

    def means(self, texts: list[str]) -> np.ndarray:
        """The mean sentence distribution of each text: the same sums as _sentence, from parts kept per word.

        The table of words starts anew when it holds 200,000 of them, so its size is bounded.
        """
        if len(self._table) > 200_000:
            self._table, self._words = [], {}
        kept, ids, lens, commas, docs = self._words, [], [], [], []
        for i, t in enumerate(texts):
            for ws, c in sentences(t):
                ids += [kept[w] if w in kept else self._row(w) for w in ws]
                lens.append(len(ws)), commas.append(c), docs.append(i)
        out = np.zeros((len(texts), 3))
        if not lens:
            return out
        n = np.array(lens)
        sums = np.add.reduceat(np.array(self._table)[ids], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
        z = sums[:, 1:4] / np.sqrt(sums[:, :1]) + shapes_of(sums[:, 4:], n, np.array(commas)) @ np.stack([m.v for m in self.models], axis=1) + np.array([m.b for m in self.models])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30))) + 1e-6
        p /= p.sum(1, keepdims=True)
        total = np.bincount(docs, sums[:, 0], len(texts))
        for k in range(3):
            out[:, k] = np.bincount(docs, p[:, k] * sums[:, 0], len(texts)) / np.maximum(total, 1)
        return out


def fit_levels(graded: DataFrame, level: str = "reading_level", text: str = "passage_text", most_passages: int = 20_000) -> LevelModel:
    rows = graded.where(F.col(level).isin(*LEVELS) & F.col(text).isNotNull()).select(level, text).limit(most_passages + 1).collect()
    if len(rows) > most_passages:
        raise ValueError(f"more than {most_passages} graded passages")
    return LevelModel(sorted((r[0], r[1]) for r in rows))


def judge(model: LevelModel, texts: list[str | None], least_words: int) -> list[tuple[str | None, list[float] | None]]:
    out, at = [(None, None)] * len(texts), []
    for i, t in enumerate(texts):
        if not t or len(t) < 2 * least_words:
            continue
        _, votes, tokens = describe(t)
        if len(tokens) < least_words or majority(votes) != PROSE:
            continue
        lang, _ = language(t, tokens)
        if lang not in ("en", "") or not lang and not t.isascii():
            continue
        if len(tokens) < 45 and sum(w in FIRST_PERSON for w in tokens) > 0.15 * len(tokens):
            continue
        at.append(i)
    for start in range(0, len(at), 1000):
        part = at[start : start + 1000]
        for i, p in zip(part, model.posterior(model.means([texts[i] for i in part]))):
            best = int(np.argmax(p + np.array([0, 1e-9, 0])))
            out[i] = (LEVELS[best], p.tolist())
    return out


def reading_levels(df: DataFrame, model: LevelModel, key: str = "record_id", text: str = "generated_text", least_words: int = 30, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each record with its level and the three calibrated probabilities (null where it has no level)."""
    broadcast = df.sparkSession.sparkContext.broadcast(model)

    def fn(ids: list, texts: list, *more: list) -> dict[str, list]:
        rows = judge(broadcast.value, texts, least_words)
        out = {"record_key": ids, "reading_level": [r[0] for r in rows]}
        for k, level in enumerate(LEVELS):
            out[f"p_{level}"] = [r[1][k] if r[1] else None for r in rows]
        return out | {f"carry_{c}": v for c, v in zip(carry, more)}

    kind = lambda c: df.schema[c].dataType.simpleString()
    schema = f"record_key {kind(key)}, reading_level string, p_basic double, p_intermediate double, p_advanced double"
    schema += "".join(f", carry_{c} {kind(c)}" for c in carry)
    out = map_batches(df, [key, text, *carry], fn, schema)
    return out.select(F.col("record_key").alias(key), "reading_level", "p_basic", "p_intermediate", "p_advanced", *[F.col(f"carry_{c}").alias(c) for c in carry])


def level_profile(levels: DataFrame, *by: str) -> DataFrame:
    """How the texts of each group are spread over the levels, and their mean difficulty (0 basic to 2 advanced)."""
    n = F.count("reading_level")
    return levels.groupBy(*by).agg(
        F.count("*").alias("n_records"), n.alias("n_levelled"),
        *[F.count_if(F.col("reading_level") == level).alias(f"n_{level}") for level in LEVELS],
        F.round(F.avg(F.col("p_intermediate") + 2 * F.col("p_advanced")), 4).alias("mean_difficulty"),
    )
