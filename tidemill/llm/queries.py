"""The queries of the nine problems, each over its whole tables with production parameters.

Most of them cannot be stated in SQL that DuckDB would run: they train models, merge token pairs, build suffix arrays or walk a
graph. They are tested against brute force, round trips and held-out accuracy in tests/llm; SQL stands beside the length
histograms of problem 5 and the split names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import answers, encoding, groups, leakage, overlap, readability, residue, shapes, truncation
from tidemill.llm.common import table, texts


ANSWER = ("record_id", "dataset_name", "human_prefix", "generated_text", "completion_length", "max_new_tokens", "model_label")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return answers.defects(texts(spark, sf, "merged_records", *ANSWER)).where("defect is not null").select("record_id", "defect")


def p1_defect_rates(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "merged_records")
    found = answers.defects(texts(spark, sf, "merged_records", *ANSWER)).select("record_id", "defect")
    by = df.select("record_id", "model_label").join(found, "record_id")
    return by.groupBy("model_label").agg(F.count("*").alias("n_records"), *[F.count_if(F.col("defect") == d).alias(f"n_{d}") for d in answers.LABELS])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.text_types(texts(spark, sf, "merged_records", "record_id", "generated_text")).where(F.col("kind").isin("list", "table", "junk")).select("record_id", "kind")


def p2_statistics(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "merged_records")
    rows = shapes.text_types(texts(spark, sf, "merged_records", "record_id", "generated_text")).join(df.select("record_id", "dataset_name"), "record_id")
    means = [F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("n_words", "mean_word_length", "symbol_ratio", "terminal_share", "common_share", "words_per_line")]
    return rows.groupBy("dataset_name").agg(F.count("*").alias("n_records"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (*shapes.KINDS, "empty")], *means)


def _levels(spark: SparkSession, sf: str, *carry: str) -> DataFrame:
    model = readability.fit_levels(table(spark, sf, "graded_passages"))
    return readability.reading_levels(texts(spark, sf, "merged_records", "record_id", "generated_text", *carry), model, carry=carry)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).where(F.col("reading_level").isin("basic", "advanced")).select("record_id", "reading_level")


def p3_profile(spark: SparkSession, sf: str) -> DataFrame:
    """By label and by the model's name, of whose spellings the letters and digits count."""
    levels = _levels(spark, sf, "model_label", "model_name").withColumn("model_name", F.regexp_replace(F.lower("model_name"), "[^a-z0-9]+", ""))
    return readability.level_profile(levels, "model_label", "model_name")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.leaking(*[table(spark, sf, t) for t in ("merged_records", "split_index", "prefix_records", "documents")]).select("record_id")


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every record's split, in the ratios of the active configuration, balanced by its stratify column."""
    config = table(spark, sf, "merge_config").where("is_active").orderBy("config_id").limit(1).collect()
    c = config[0].asDict() if config else {"stratify_column": "model_label", "train_ratio": 0.7, "val_ratio": 0.15, "test_ratio": 0.15, "random_seed": 42}
    records = table(spark, sf, "merged_records")
    by = groups.prefix_groups(table(spark, sf, "prefix_records"), table(spark, sf, "documents"))
    rows = groups.grouped(records.select("record_id", "prefix_id", F.col(c["stratify_column"]).alias("label")), by, "record_id", "prefix_id")
    ratios = {"train": c["train_ratio"], "validation": c["val_ratio"], "test": c["test_ratio"]}
    return groups.stratified_splits(rows, "record_id", "label", ratios, c["random_seed"]).select("record_id", "split")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(texts(spark, sf, "merged_records", *ANSWER)).where("is_cut").select("record_id")


def p5_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """The histograms of problem 5: values, and values that end openly, per dataset, column, measure and length."""
    return truncation.lengths(texts(spark, sf, "merged_records", "dataset_name", "generated_text", "human_prefix"), "dataset_name", ("generated_text", "human_prefix"))


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "merged_records")
    rows = truncation.truncated(texts(spark, sf, "merged_records", *ANSWER)).select("record_id", "is_cut").join(df.select("record_id", "model_label", "dataset_name"), "record_id")
    return rows.groupBy("model_label", "dataset_name").agg(F.count("*").alias("n_records"), F.count_if("is_cut").alias("n_cut"), F.round(F.count_if("is_cut") / F.count("*"), 6).alias("cut_rate"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf, "merged_records"), table(spark, sf, "split_index"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("record_id_a", "record_id_b")


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs, and records of validation and test that have one, per split and dataset, with the records' mean coverage."""
    names = table(spark, sf, "merged_records").select("record_id", "dataset_name")
    rows = overlap.overlapping_records(table(spark, sf, "merged_records"), table(spark, sf, "split_index")).join(names, "record_id")
    return rows.groupBy("split", "dataset_name").agg(F.count("*").alias("n_records"), F.sum("n_pairs").alias("n_pairs"), F.sum("n_equal_pairs").alias("n_equal_pairs"), F.round(F.avg("covered"), 4).alias("avg_covered"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encoded(texts(spark, sf, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(texts(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_items"), most_shift=2)


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each leaked item is in."""
    found = p8_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, sf, "eval_items").select("item_id", "task", "held_out_split").join(F.broadcast(found), "item_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(texts(spark, sf, "documents", "doc_id", "text", "source")).select("doc_id", "kind")


def p9_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by kind, and by what told it: a recurring message, a phrase or a slot."""
    return residue.residue(texts(spark, sf, "documents", "doc_id", "text", "source")).groupBy("kind", "route").agg(F.count("*").alias("n_documents"))


def p4_split_names(spark: SparkSession, sf: str) -> DataFrame:
    """The split index with its names undone: one row per record."""
    return table(spark, sf, "split_index").select("record_id", groups.split_name(F.col("split")).alias("split")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_defect_rates, p2_found, p2_statistics, p3_found, p3_profile, p4_found, p4_splits, p4_split_names, p5_found, p5_lengths, p5_rates, p6_found, p6_counts, p7_ids, p8_found, p8_items, p9_found, p9_counts)}


def _lengths_sql() -> str:
    blanks = " || ".join(f"chr({ord(c)})" for c in truncation.BLANKS)
    quoted = lambda pattern: pattern.replace("'", "''")
    mark, signature, open_ = (quoted(p) for p in (truncation.MARK, truncation.SIGNATURE, truncation.OPEN))
    values = " UNION ALL ".join(f"SELECT coalesce(dataset_name, '') AS source, '{c}' AS \"column\", {c} AS v FROM merged_records WHERE length({c}) > 0" for c in ("generated_text", "human_prefix"))
    bare = f"SELECT source, \"column\", v, rtrim(v, {blanks}) AS a FROM ({values})"
    cut_ = f"SELECT source, \"column\", v, CASE WHEN regexp_matches(right(a, 64), '(?i){mark}') THEN rtrim(regexp_replace(a, '(?i){mark}', ''), {blanks}) ELSE a END AS b FROM ({bare})"
    rows = f"SELECT source, \"column\", v, regexp_matches(b, '{open_}') AND NOT regexp_matches(right(b, 90), '{signature}') AS is_open FROM ({cut_})"
    parts = " UNION ALL ".join(f"SELECT source, \"column\", '{m}' AS measure, CAST({f}(v) AS INTEGER) AS length, is_open FROM r" for m, f in (("chars", "length"), ("bytes", "strlen")))
    return f"WITH r AS ({rows}) SELECT source, \"column\", measure, length, count(*) AS n, count(*) FILTER (is_open) AS n_open FROM ({parts}) GROUP BY ALL"


def oracle_sql() -> dict[str, str]:
    return {
        "p5_lengths": _lengths_sql(),
        "p4_split_names": "SELECT DISTINCT record_id, CASE WHEN trim(lower(split)) IN ('val', 'valid', 'dev') THEN 'validation' ELSE trim(lower(split)) END AS split FROM split_index",
    }
