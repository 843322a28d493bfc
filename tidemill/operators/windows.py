"""Token windows, chunks, quotas, sampling, splits and folds.

A seeded order is the order of md5(seed|id), the same in every engine. Splits and folds need the position of a row in its
stratum; it is counted over hash buckets (one window per stratum and bucket, and the buckets' sizes in front of it), so no
stratum is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int | str, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def token_windows(df: DataFrame, tokens: str, lengths: tuple[int, ...] = (64, 128, 256), overlap: int = 32, least: int = 300) -> DataFrame:
    """Every full window of each length, at strides of length - overlap; documents under `least` tokens have none."""
    rows = df.where(F.size(tokens) >= least).withColumn("window_length", F.explode(F.array(*[F.lit(n) for n in lengths])))
    rows = rows.withColumn("start", F.explode(F.expr(f"sequence(0, size({tokens}) - window_length, greatest(1, window_length - {overlap}))")))
    return rows.withColumn("window_text", F.array_join(F.slice(F.col(tokens), F.col("start") + 1, F.col("window_length")), " "))


def chunks(df: DataFrame, tokens: str, size: int = 250, overlap: int = 50) -> DataFrame:
    """Chunks of words; short texts whole; a tail only from half a chunk on. Other columns are carried along."""
    starts = F.when(F.size(tokens) <= size, F.array(F.lit(0))).otherwise(F.expr(f"filter(sequence(0, size({tokens}) - 1, {size - overlap}), s -> least({size}, size({tokens}) - s) >= {size // 2})"))
    rows = df.where(F.size(tokens) > 0).select("*", F.posexplode(starts).alias("chunk_index", "start"))
    return rows.withColumn("chunk_text", F.array_join(F.slice(F.col(tokens), F.col("start") + 1, F.lit(size)), " ")).withColumn("chunk_words", F.least(F.lit(size), F.size(tokens) - F.col("start")))


def capped(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """At most `most` rows per group, the first ones in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def proportional_quotas(sizes: list[int], target: int) -> list[int]:
    """Floor of each share, no more than there is; what is missing goes to the tables in order, as far as they have more."""
    total = sum(sizes)
    if total <= target:
        return list(sizes)
    quotas = [min(n, target * n // total) for n in sizes]
    left = target - sum(quotas)
    while left > 0:
        for i, n in enumerate(sizes):
            if left > 0 and quotas[i] < n:
                quotas[i] += 1
                left -= 1
    return quotas


def sequential_targets(sizes: list[int], target: int) -> list[int]:
    """Each table in turn gets ceil(remaining / tables left), or all that it has."""
    out, left = [], target
    for i, n in enumerate(sizes):
        share = -(-left // (len(sizes) - i)) if left > 0 else 0
        out.append(min(n, share))
        left -= out[-1]
    return out


def positions(df: DataFrame, by: list[str], order: Column, buckets: int = 64) -> DataFrame:
    """Adds `position` (0-based, in the seeded order) and `stratum_size` to each row, without gathering a stratum.

    order: a hexadecimal hash; rows are cut into ranges by its first two digits, ranked inside a range, and the sizes of the
    ranges before it (at most `buckets` per stratum) are added.
    """
    width = 256 // buckets
    rows = df.withColumn("_order", order).withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 2), 16, 10).cast("int") / width).cast("int"))
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("stratum_size", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_order")))
    same = None
    for c in [*by, "_bucket"]:
        e = ranked[c].eqNullSafe(sizes[c])
        same = e if same is None else same & e
    out = ranked.join(sizes, same)
    return out.select(*[ranked[c] for c in df.columns], (F.col("_before") + F.col("_rank") - 1).alias("position"), "stratum_size")


def stratified_split(df: DataFrame, key: str, label: str, ratios: Mapping[str, float], seed: int = 42) -> DataFrame:
    """Splits by position in the label's seeded order: the first share of each label is train, and so on."""
    rows = positions(df.select(key, label), [label], seeded(seed, key))
    place = F.col("position") / F.col("stratum_size")
    names, edge, expr = list(ratios), 0.0, None
    for name in names[:-1]:
        edge = round(edge + ratios[name], 10)
        expr = F.when(place < edge, name) if expr is None else expr.when(place < edge, name)
    return rows.select(key, label, expr.otherwise(names[-1]).alias("split"))


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    return positions(df.select(key, label), [label], seeded(seed, key)).select(key, label, (F.col("position") % k).alias("fold"))


def quota_sample(df: DataFrame, by: str, key: str, quotas: Mapping[str, int], seed: int = 42) -> DataFrame:
    """The first rows of each group in its seeded order, as many as its quota."""
    table = df.sparkSession.createDataFrame(sorted(quotas.items()), f"{by} string, quota bigint")
    rows = positions(df, [by], seeded(seed, key)).drop("stratum_size")
    return rows.join(F.broadcast(table), by).where(F.col("position") < F.col("quota")).drop("position", "quota")
