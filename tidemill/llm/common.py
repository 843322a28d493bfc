"""Shared pieces of the training-data operators: words, languages, hashing, a linear model, checkpoints."""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.base import shared_folder, table, texts  # noqa: F401 - for the queries

INVISIBLE = re.compile("[­͏؜᠋-᠎​-‏‪-‮⁠-⁤⁦-⁩︀-️﻿]")
WORD = re.compile(r"[^\W_]+")

# Marks and tokens that stand for no answer.
NOTHING = re.compile(
    r"^(?:[^\w]{0,6}|(?:[<\[(]{1,2}\|?/?(?:pad|eos|bos|s|unk|end|endoftext|end_of_text|im_end|im_start|empty|blank|null|none|no output|no answer|no response|no text|nothing)\|?[>\])]{1,2}\s*)++|[\"'(\[]?(?:null|none|nil|nan|n\s*/?\s*a|undefined|empty|no (?:answer|output|response|reply|text))[\"')\].]?)$",
    re.I,
)
NOTHING_SQL = "(?iU)" + NOTHING.pattern

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and of to in is was were be been it its that which who this these those for with by on at from as had have has not but or nor his her their our your he she they we you him them us me my there every each any some no both many most few several while after before until since because although so when would must may might could can if then than into near under over why what how i am are do does did will".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht ist war wurde mit von zu im in auf an aus bei nach vor für über unter durch ohne während wegen trotz weil dass sich er sie es ihr wir ich als auch noch später hinter vielen jede mit".split(),
    "fr": "le la les l un une des du de d et ou mais ne pas est était avec dans en sur sous par pour sans que qui ce cette ces il elle ils elles nous vous au aux à son sa ses leur plus après avant pendant malgré parce car bien derrière puis tandis".split(),
    "es": "el la los las un una unos unas y o pero no es era con en de del al por para sin que se su sus lo le les como más después antes durante detrás porque pues aunque mientras luego hace muchos".split(),
    "it": "il lo la i gli le un una uno e o ma non è era con in di del della dei delle dell al alla da dal per senza che si suo sua più dopo prima durante dietro perché mentre anche poi molti fa nel nella sul sulla".split(),
    "pt": "o a os as um uma e ou mas não é era com em de do da dos das no na por para sem que se seu sua mais depois antes durante atrás porque enquanto".split(),
    "nl": "de het een en of maar niet is was met van te in op aan uit bij na voor over onder door zonder tijdens wegens omdat dat zich hij zij ze wij ik als ook nog".split(),
}
_WEIGHTS: dict = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_words):
        _WEIGHTS.setdefault(_w, {})[_lang] = 0.0
for _w, _by in _WEIGHTS.items():
    for _lang in _by:
        _by[_lang] = 1.0 / len(_by)
_WEIGHTS = {w: tuple(by.items()) for w, by in _WEIGHTS.items()}
ENGLISH = frozenset(FUNCTION_WORDS["en"])
COMMON = frozenset(_WEIGHTS)

_HAN, _KANA, _HANGUL = re.compile("[㐀-鿿]"), re.compile("[぀-ヿ]"), re.compile("[가-힯]")
_CYRILLIC, _GREEK, _ARABIC = re.compile("[Ѐ-ӿ]"), re.compile("[Ͱ-Ͽ]"), re.compile("[؀-ۿ]")


def clean(text: str) -> str:
    """NFC without invisible characters; plain ASCII text is returned as it is."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", INVISIBLE.sub("", text))


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower case, after invisible characters are removed; none of null."""
    return WORD.findall(clean(text).lower()) if text else []


def language_scores(text: str, tokens: list[str]) -> dict[str, float]:
    """The share of a text's words (of its letters, for other scripts) that speak for each language; none where nothing does."""
    if not text.isascii():
        letters = max(1, sum(map(str.isalpha, text)))
        for lang, pattern in (("ja", _KANA), ("ko", _HANGUL), ("zh", _HAN), ("ru", _CYRILLIC), ("el", _GREEK), ("ar", _ARABIC)):
            n = len(pattern.findall(text))
            if n > 0.4 * letters or lang == "ja" and n > 0.1 * letters:
                return {lang: n / letters}
    scores: dict[str, float] = {}
    for by in filter(None, map(_WEIGHTS.get, tokens)):
        for lang, w in by:
            scores[lang] = scores.get(lang, 0.0) + w
    return {lang: v / len(tokens) for lang, v in scores.items()}


def language(text: str, tokens: list[str]) -> tuple[str, float]:
    """Main language of a text and the share of its words that speak for it; ("", 0) where nothing does."""
    scores = language_scores(text, tokens)
    if not scores:
        return "", 0.0
    lang = max(scores, key=lambda k: (scores[k], k == "en", k))
    return lang, scores[lang]


def copied(answer: list[str], prefix: list[str], have: frozenset[str]) -> tuple[float, float]:
    """Share of the answer's words in long runs that are also runs of the prefix; the longest one's share of the prefix."""
    if len(answer) < 5 or len(prefix) < 5:
        return 0.0, 0.0
    if sum(map(have.__contains__, answer)) < 0.7 * min(len(answer), len(prefix)):
        return 0.0, 0.0
    where: dict[str, list[int]] = {}
    for j, w in enumerate(prefix):
        where.setdefault(w, []).append(j)
    best, before, ends = 0, {}, [0] * len(answer)
    for i, w in enumerate(answer):
        now = {}
        for j in where.get(w, ()):
            now[j] = k = before.get(j - 1, 0) + 1
            if k > ends[i]:
                ends[i] = k
        best = max(best, ends[i])
        before = now
    covered, to = 0, len(answer)
    for i in range(len(answer) - 1, -1, -1):
        if ends[i] >= 6 or ends[i] == best:
            covered += max(0, min(to, i + 1) - max(0, i + 1 - ends[i]))
            to = min(to, i + 1 - ends[i])
    return covered / len(answer), best / len(prefix)


class _Hashes(dict):
    """Stable 32-bit hashes, kept for short repeated strings; the memory it takes is bounded."""

    def __missing__(self, s: str) -> int:
        v = zlib.crc32(s.encode("utf-8", "surrogatepass"))
        if len(self) < 200_000:
            self[s] = v
        return v


h32 = _Hashes().__getitem__


class HashedLogit:
    """Logistic regression over hashed binary features and dense ones, fitted with Adagrad on the driver's bounded sample."""

    def __init__(self, bits: int, dense: int, l2: float = 1e-5):
        self.bits, self.l2 = bits, l2
        self.w, self.v, self.b = np.zeros(1 << bits), np.zeros(dense), 0.0

    def fit(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, epochs: int = 12, rate: float = 0.3, seed: int = 7) -> HashedLogit:
        rng, n = np.random.default_rng(seed), len(y)
        weight = np.ones(n) if weight is None else weight
        gw, gv, gb = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(n), max(1, n // 64)):
                idx = np.concatenate([rows[i] for i in part]) if len(part) else np.zeros(0, np.int64)
                lens = np.array([len(rows[i]) for i in part])
                at = np.repeat(np.arange(len(part)), lens)
                scale = 1.0 / np.sqrt(np.maximum(lens, 1))
                z = np.bincount(at, self.w[idx], len(part)) * scale + dense[part] @ self.v + self.b
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part]
                d = np.bincount(idx, (g * scale)[at], len(self.w)) if len(idx) else np.zeros_like(self.w)
                hot = np.flatnonzero(d)
                d = d[hot] + self.l2 * self.w[hot]
                gw[hot] += d * d
                self.w[hot] -= rate * d / np.sqrt(gw[hot])
                dv = g @ dense[part] + self.l2 * self.v
                gv += dv * dv
                self.v -= rate * dv / np.sqrt(gv)
                gb += g.sum() ** 2
                self.b -= rate * g.sum() / np.sqrt(gb)
        return self

    def scores(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        lens = np.array([len(r) for r in rows], dtype=np.int64)
        idx = np.concatenate(rows) if len(rows) and lens.sum() else np.zeros(0, np.int64)
        at = np.repeat(np.arange(len(rows)), lens)
        z = np.bincount(at, self.w[idx], len(rows)) / np.sqrt(np.maximum(lens, 1)) + dense @ self.v + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on held-out rows; in the gap between neighbouring scores, as near to a half as that allows."""
    if not len(p) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    k = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[-1])
    high, low = float(p[order][k]), float(p[order][k + 1]) if k + 1 < len(p) else 0.0
    return min(max(0.5, low + 0.1 * (high - low)), high - 0.1 * (high - low))


def map_batches(df: DataFrame, columns: list[str], fn: Callable[..., dict[str, list]], schema: str, init: Callable[[], object] | None = None) -> DataFrame:
    """fn over Arrow batches of the given columns only, in Python lists; extra columns never reach Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (init(),) if init else ()
        for batch in batches:
            if batch.num_rows:
                out = fn(*state, *(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in arrow}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    return df.select(*columns).mapInArrow(run, struct)


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder, so that lost executors cost no recomputation."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a compressed table in the checkpoint folder: smaller than a checkpoint where rows hold texts."""
    spark = df.sparkSession
    with_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Tables of a session go when it ends: until then, frames that read them may be used (checkpoints have Spark's own cleaner)."""
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))


MOST_BROADCAST = 100_000


def attach(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """rows left join few (one row per key): few is cut and counted first, and broadcast only if it has at most MOST_BROADCAST rows."""
    few = cut(few)
    return rows.join(F.broadcast(few) if few.count() <= MOST_BROADCAST else few, on, "left")


def bounded_sample(df: DataFrame, key: str, columns: list[str], rows: int) -> list:
    """At most `rows` rows in the order of a hash of the key: the same whatever the partitioning, spread over all rows.

    Rows are thinned by the same hash before they are ordered, so that what the tasks send to the driver is bounded too.
    """
    steps = 1 << 20
    place = F.pmod(F.xxhash64(key), F.lit(steps))
    n = df.count()
    if n > 4 * rows:
        part = df.where(place < max(1, 4 * rows * steps // n))
        out = part.select(*columns).orderBy(place, F.xxhash64(key), key).limit(rows).collect()
        if len(out) == rows:
            return out
    return df.select(*columns).orderBy(place, F.xxhash64(key), key).limit(rows).collect()
