"""Corpus statistics: one pass with partial aggregation each; quantiles are exact, over counts of few distinct lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as T


def with_lengths(df: DataFrame, generated: str = "generated_text", prefix: str = "human_prefix") -> DataFrame:
    """The twelve length columns of a pair of texts."""
    g, p = T.text(generated), T.text(prefix)
    out = {}
    for name, f in (("char", T.char_count), ("word", T.word_count), ("sentence", T.sentence_count), ("paragraph", T.paragraph_count)):
        out[f"gen_{name}s"], out[f"prefix_{name}s"] = f(g), f(p)
    df = df.withColumns(out)
    return df.withColumns({f"response_{n}s": F.col(f"gen_{n}s") + F.col(f"prefix_{n}s") for n in ("char", "word", "sentence", "paragraph")})


LENGTHS = [f"{side}_{n}s" for n in ("char", "word", "sentence", "paragraph") for side in ("gen", "prefix", "response")]


def describe(df: DataFrame, columns: list[str], quartiles: bool = True) -> DataFrame:
    """One row per column: mean, median, min, max, sample deviation and quartiles, rounded to two places; 0 if empty."""
    z = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0))
    sums, parts = [], []
    for c in columns:  # the exact counts of a column's values are built once for all its quantiles
        x = F.col(c)
        sums += [F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}_q"), F.avg(x).alias(f"{c}_m"), F.min(x).alias(f"{c}_a"), F.max(x).alias(f"{c}_z"), F.stddev_samp(x).alias(f"{c}_s")]
        q = lambda k, c=c: F.col(f"{c}_q")[k]
        fields = [F.lit(c).alias("metric"), z(F.col(f"{c}_m")).alias("mean"), z(q(1)).alias("median"), F.coalesce(f"{c}_a", F.lit(0)).cast("bigint").alias("min"), F.coalesce(f"{c}_z", F.lit(0)).cast("bigint").alias("max"), z(F.col(f"{c}_s")).alias("std")]
        if quartiles:
            fields += [z(q(0)).alias("q1"), z(q(2)).alias("q3"), z(q(2) - q(0)).alias("iqr")]
        parts.append(F.struct(*fields))
    return df.agg(*sums).select(F.inline(F.array(*parts)))


def token_counts(df: DataFrame, c: Column, *by: str) -> DataFrame:
    """Counts of tokens, per group; aggregated before the shuffle."""
    return df.select(*by, F.explode(T.tokens(c)).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def label_statistics(df: DataFrame, label: str, generated: str) -> DataFrame:
    g = T.text(generated)
    counts = token_counts(df, g, label).groupBy(label).agg(F.count("*").alias("vocabulary_size"), F.sum("n").alias("total_tokens"), F.sum(F.length("token") * F.col("n")).alias("token_chars"))
    docs = df.groupBy(label).agg(F.count("*").alias("total_samples"), F.sum(T.char_count(g)).alias("chars"), F.sum(T.sentence_count(g)).alias("sentences"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tokens = zero("total_tokens")
    return docs.join(counts, docs[label].eqNullSafe(counts[label]), "left").select(
        docs[label], "total_samples", F.round(F.col("chars") / F.col("total_samples"), 2).alias("avg_response_chars"), zero("vocabulary_size").alias("vocabulary_size"), tokens.alias("total_tokens"),
        F.round(T.per(zero("vocabulary_size"), tokens), 6).alias("type_token_ratio"), F.round(T.per(F.col("chars"), F.col("sentences")), 2).alias("avg_sentence_chars"), F.round(T.per(zero("token_chars"), tokens), 2).alias("avg_word_chars"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in df.columns]
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def duplicates(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """What repeats: rows less distinct values of each key, null being a value; each key is one aggregation by its hash."""
    out = None
    for name, columns in keys.items():
        part = df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.lit(name).alias("what"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
        out = part if out is None else out.unionByName(part)
    return out


def imbalance(df: DataFrame, label: str) -> DataFrame:
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.round(F.max("n") / F.min("n"), 4), F.lit(0.0)).alias("imbalance_ratio"))


def correlations(df: DataFrame, columns: list[str], places: int = 4) -> DataFrame:
    pairs = {(a, b): f"c{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j}
    sums = df.agg(*[F.round(F.corr(a, b), places).alias(n) for (a, b), n in pairs.items()])
    parts = [F.struct(F.lit(a).alias("metric"), *[F.col(pairs[(a, b) if (a, b) in pairs else (b, a)]).alias(b) for b in columns]) for a in columns]
    return sums.select(F.inline(F.array(*parts)))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin of equal width; values outside fall into bin 0 or bins + 1."""
    return df.groupBy(F.width_bucket(value.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
