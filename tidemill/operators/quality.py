"""Ordered quality filters with reasons, validation, and duplicates by normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import text as T


def quality_reason(c: Column, language: Column, confidence: Column, shortest: int = 150, longest: int = 6000, allowed: tuple[str, ...] = ("en",), least_confidence: float = 0.95) -> Column:
    """The first check that a text fails, but for duplicates; null if it passes all of them."""
    s = T.strip(T.text(c))
    n = F.length(s)
    wrong = ~F.coalesce(language.isin(*allowed), F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < least_confidence)
    return F.when(n == 0, "empty").when(n < shortest, "too_short").when(n > longest, "too_long").when(~T.is_valid_unicode(s), "invalid_unicode").when(wrong, "language_mismatch")


def first_of_equal(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Adds `is_first`: whether the row is the first, in the given order, of those with an equal key.

    The first row of each key is found by a partial aggregation on the key's hash, and joined back by its order columns, so
    a key that a third of all rows share is not gathered in one task.
    """
    keyed = df.withColumn("_key", F.md5(key))
    first = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first")).select(F.col("_first.*")).withColumn("_yes", F.lit(True))
    return keyed.drop("_key").join(first, order, "left").withColumn("is_first", F.coalesce("_yes", F.lit(False))).drop("_yes")


def checked(df: DataFrame, reason: Column, key: Column, order: list[str]) -> DataFrame:
    """All rows with `reject_reason`; duplicates are told among the rows that pass every other check."""
    rows = df.withColumn("reject_reason", reason)
    passed = first_of_equal(rows.where("reject_reason is null"), key, order)
    passed = passed.withColumn("reject_reason", F.when(~F.col("is_first"), "duplicate")).drop("is_first")
    return passed.unionByName(rows.where("reject_reason is not null"))


def validation_reason(c: Column, shortest: int = 5, longest: int = 10000) -> Column:
    n = F.length(T.text(c))
    return (
        F.when(T.is_blank(T.text(c)), "Missing/empty text content")
        .when(n < shortest, F.format_string(f"Length below min threshold (%d < {shortest})", n))
        .when(n > longest, F.format_string(f"Length exceeds max threshold (%d > {longest})", n))
    )


def validate(df: DataFrame, c: str, shortest: int = 5, longest: int = 10000) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): removed rows have their reason and their original length."""
    rows = df.withColumn("reason", validation_reason(F.col(c), shortest, longest))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").withColumn("original_length", T.char_count(T.text(c)))


def row_number(df: DataFrame, partition: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
