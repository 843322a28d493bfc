"""TF-IDF as long tables (doc, term, weight): sublinear tf, smooth idf, L2 norm; word and character n-grams.

Term counts are aggregated per document before anything is joined; the vocabulary, which is capped, is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as T


def word_terms(c: Column) -> Column:
    """Lower-case words of two or more characters."""
    return word_ngrams(c, (1,))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that it names several times and that is to be evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def word_ngrams(c: Column, sizes: tuple[int, ...] = (1, 2), lower: bool = True) -> Column:
    """Runs of one or more such words, joined by blanks; with lower=False in their own case."""
    words = F.regexp_extract_all(F.lower(c) if lower else c, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if tuple(sizes) == (1,):
        return words
    return once(words, lambda w: F.concat(*[w if n == 1 else T.ngrams(w, n) for n in sizes], F.array().cast("array<string>")))


def one_blank(c: Column, lower: bool = True) -> Column:
    """Runs of blanks being one blank."""
    return F.regexp_replace(F.lower(c) if lower else c, f"[{T.SPACE}][{T.SPACE}]+", " ")


def chars(c: Column, sizes: tuple[int, ...], lower: bool = True) -> Column:
    """Character n-grams across word borders, runs of blanks being one blank."""
    none = F.array().cast("array<string>")

    def of(t: Column, n: int) -> Column:
        return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i: F.substring(t, i, F.lit(n)))).otherwise(none)

    return once(one_blank(c, lower), lambda t: F.concat(*[of(t, n) for n in sizes], none))


def char_wb(tokens: Column, sizes: tuple[int, ...]) -> Column:
    """Character n-grams inside words padded by one blank; a word shorter than n counts once, as it is."""
    def of(w: Column, n: int) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        grams = F.transform(F.sequence(F.lit(0), F.length(padded) - n), lambda i: F.substring(padded, i + 1, F.lit(n)))
        return F.when(F.length(padded) <= n, F.array(padded)).otherwise(grams)

    def all_of(n: int) -> Column:
        return F.flatten(F.transform(tokens, lambda w: of(w, n)))

    parts = [all_of(n) for n in sizes]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, cap: int, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """Terms within the document frequencies, the `cap` most frequent (ties by term), with their idf."""
    v = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    v = v.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).orderBy(F.desc("total"), "term").limit(cap)
    return v.select("term", "df", (F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


# The usual limits of the vocabularies and the ranges of n-gram sizes.
WORD_TERMS, CHAR_TERMS = 50_000, 30_000
WORD_SIZES, CHAR_SIZES = (1, 2), (3, 4, 5)
CHAR_RANGES = {"2-2": (2,), "3-3": (3,), "4-4": (4,), "2-4": (2, 3, 4), "3-5": (3, 4, 5)}


def weights(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    raw = counts.join(F.broadcast(vocab.select("term", "idf")), "term").select(key, "term", ((1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("tfidf"))


def tfidf(df: DataFrame, key: str, terms: Column, cap: int, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    counts = term_counts(df, key, terms)
    return weights(counts, vocabulary(counts, df.count(), cap, min_df, max_df), key)


class Vectorizer:
    """A vocabulary fitted on one corpus, applied to others, and kept as a table."""

    def __init__(self, vocab: DataFrame):
        self.vocab = vocab

    @classmethod
    def fit(cls, df: DataFrame, key: str, terms: Column, cap: int, min_df: int = 2, max_df: float = 0.95) -> Vectorizer:
        return cls(vocabulary(term_counts(df, key, terms), df.count(), cap, min_df, max_df))

    def transform(self, df: DataFrame, key: str, terms: Column) -> DataFrame:
        return weights(term_counts(df, key, terms), self.vocab, key)

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Vectorizer:
        return cls(spark.read.parquet(path))
