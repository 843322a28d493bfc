"""Vocabulary and n-gram counts. Counts are aggregated per partition before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as T


def counted(df: DataFrame, items: Column) -> DataFrame:
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def ngram_counts(df: DataFrame, c: Column, n: int) -> DataFrame:
    docs = df.select(T.tokens(c).alias("tokens"))
    return counted(docs, T.ngrams(F.col("tokens"), n) if n > 1 else F.col("tokens"))


def char_counts(df: DataFrame, c: Column) -> DataFrame:
    return counted(df, F.filter(F.split(c, ""), lambda x: F.length(x) > 0))


def ranked(counts: DataFrame, total: DataFrame, k: int, most: bool = True, less: int = 0) -> DataFrame:
    """The k most or least frequent items (ties by item), with their share of all tokens less `less`, in percent."""
    top = counts.orderBy(F.desc("n") if most else F.asc("n"), "item").limit(k)
    return top.crossJoin(F.broadcast(total)).select("item", "n", F.round(F.col("n") * 100.0 / (F.col("total_tokens") - less), 4).alias("percentage"))


def overview(df: DataFrame, c: Column) -> DataFrame:
    counts = ngram_counts(df, c, 1)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.count("*").alias("vocabulary_size")).withColumn("type_token_ratio", F.round(T.per(F.col("vocabulary_size"), F.col("total_tokens")), 6))
