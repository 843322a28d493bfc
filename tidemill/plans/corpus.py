"""Queries over the merged records: summaries, lengths, labels, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.functions.text import SPACE, TOKEN
from tidemill.operators import stats
from tidemill.plans.base import query, table, texts


def s_text(c: str) -> str:
    return f"coalesce({c}, '')"


def s_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def s_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN}'))"


def s_sentences(x: str) -> str:
    return f"CASE WHEN length({s_strip(x)}) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all({x}, '[.!?]+'))) END"


def s_paragraphs(x: str) -> str:
    return f"len(list_filter(str_split({x}, chr(10) || chr(10)), lambda p: length({s_strip('p')}) > 0))"


def s_lengths() -> str:
    g, p = s_text("generated_text"), s_text("human_prefix")
    cols = []
    for n, f in (("char", lambda x: f"length({x})"), ("word", s_words), ("sentence", s_sentences), ("paragraph", s_paragraphs)):
        cols += [f"CAST({f(g)} AS BIGINT) AS gen_{n}s", f"CAST({f(p)} AS BIGINT) AS prefix_{n}s"]
    inner = "SELECT *, " + ", ".join(cols) + " FROM merged_records"
    return "SELECT *, " + ", ".join(f"gen_{n}s + prefix_{n}s AS response_{n}s" for n in ("char", "word", "sentence", "paragraph")) + f" FROM ({inner})"


def s_describe(source: str, columns: list[str], quartiles: bool = True) -> str:
    out = []
    for c in columns:
        q = f", round(quantile_cont({c}, 0.25), 2) AS q1, round(quantile_cont({c}, 0.75), 2) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 2) AS iqr" if quartiles else ""
        out.append(f"SELECT '{c}' AS metric, round(avg({c}), 2) AS mean, round(quantile_cont({c}, 0.5), 2) AS median, CAST(min({c}) AS BIGINT) AS min, CAST(max({c}) AS BIGINT) AS max, round(stddev_samp({c}), 2) AS std{q} FROM l")
    return f"WITH l AS ({source}) " + " UNION ALL ".join(out)


MERGED = "merged_records"


@query(f"""
WITH m AS (SELECT model_label, {s_text('generated_text')} AS t FROM merged_records),
w AS (SELECT model_label, unnest(regexp_extract_all(t, '{TOKEN}')) AS w FROM m),
v AS (SELECT model_label, count(DISTINCT w) AS vocabulary_size, count(*) AS total_tokens, sum(length(w)) AS wc FROM w GROUP BY 1),
d AS (SELECT model_label, count(*) AS total_samples, sum(length(t)) AS chars, sum({s_sentences('t')}) AS sentences FROM m GROUP BY 1)
SELECT d.model_label, total_samples, round(chars / total_samples, 2) AS avg_response_chars, coalesce(vocabulary_size, 0) AS vocabulary_size, coalesce(total_tokens, 0) AS total_tokens,
coalesce(round(vocabulary_size / total_tokens, 6), 0) AS type_token_ratio, CASE WHEN sentences > 0 THEN round(chars / sentences, 2) ELSE 0 END AS avg_sentence_chars, coalesce(round(wc / total_tokens, 2), 0) AS avg_word_chars
FROM d LEFT JOIN v ON d.model_label IS NOT DISTINCT FROM v.model_label""")
def corpus_label_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.label_statistics(texts(spark, sf, MERGED, "model_label", "generated_text"), "model_label", "generated_text")


@query(s_describe(s_lengths(), stats.LENGTHS))
def text_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.describe(stats.with_lengths(texts(spark, sf, MERGED, "generated_text", "human_prefix", "prompt_length", "completion_length")), stats.LENGTHS)


CHAR_STATS = ["prefix_chars", "gen_chars", "response_chars", "prefix_words", "gen_words", "response_words", "prompt_length", "completion_length"]


@query(s_describe(s_lengths(), CHAR_STATS, False))
def merge_char_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.describe(stats.with_lengths(texts(spark, sf, MERGED, "generated_text", "human_prefix", "prompt_length", "completion_length")), CHAR_STATS, quartiles=False)


@query("SELECT model_label, count(*) AS n FROM merged_records GROUP BY 1 ORDER BY n DESC, 1")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, MERGED).groupBy("model_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_label")


@query("SELECT dataset_name, prefix_length, count(*) AS n FROM prefix_records GROUP BY 1, 2")
def prefix_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "prefix_records").groupBy("dataset_name", "prefix_length").agg(F.count("*").alias("n"))


@query("SELECT round(max(n) / min(n), 4) AS imbalance_ratio FROM (SELECT count(*) AS n FROM merged_records WHERE model_label IS NOT NULL GROUP BY model_label)")
def imbalance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return stats.imbalance(table(spark, sf, MERGED), "model_label")


ALL_MERGED = "record_id prefix_id dataset_name category human_prefix generated_text model_name temperature top_p max_new_tokens prompt_length completion_length generation_time generation_timestamp model_label ingested_at".split()
WITHOUT_ID = ", ".join(c for c in ALL_MERGED if c not in ("record_id", "ingested_at"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM merged_records" for c in ALL_MERGED))
def null_report(spark: SparkSession, sf: str) -> DataFrame:
    return stats.null_counts(table(spark, sf, MERGED).select(*ALL_MERGED))


@query(f"""SELECT 'prefix_id' AS what, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM merged_records GROUP BY prefix_id)
UNION ALL SELECT 'generated_text', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM merged_records GROUP BY generated_text)
UNION ALL SELECT 'delivery', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM merged_records GROUP BY {WITHOUT_ID})""")
def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return stats.duplicates(table(spark, sf, MERGED), {"prefix_id": ["prefix_id"], "generated_text": ["generated_text"], "delivery": WITHOUT_ID.split(", ")})


@query("""WITH c AS (SELECT model_label, count(*) AS n FROM merged_records GROUP BY 1)
SELECT 'total_rows' AS metric, CAST(sum(n) AS VARCHAR) AS value FROM c UNION ALL SELECT 'n_classes', CAST(count(*) AS VARCHAR) FROM c
UNION ALL SELECT 'class_' || coalesce(model_label, 'null'), CAST(n AS VARCHAR) FROM c""")
def summary_long(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, MERGED).groupBy("model_label").agg(F.count("*").alias("n"))
    totals = c.agg(F.array(F.struct(F.lit("total_rows").alias("metric"), F.sum("n").cast("string").alias("value")), F.struct(F.lit("n_classes").alias("metric"), F.count("*").cast("string").alias("value"))).alias("r")).select(F.inline("r"))
    return totals.unionByName(c.select(F.concat(F.lit("class_"), F.coalesce("model_label", F.lit("null"))).alias("metric"), F.col("n").cast("string").alias("value")))


CORR = ["gen_chars", "prefix_chars", "response_chars", "gen_words", "prefix_words", "response_words", "gen_sentences", "gen_paragraphs"]


@query(f"WITH l AS ({s_lengths()}) " + " UNION ALL ".join(f"SELECT '{a}' AS metric, " + ", ".join(f"round(corr({a}, {b}), 4) AS {b}" for b in CORR) + " FROM l" for a in CORR))
def length_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return stats.correlations(stats.with_lengths(texts(spark, sf, MERGED, "generated_text", "human_prefix", "prompt_length", "completion_length")), CORR)


@query(f"""WITH d AS (SELECT source, text, {s_words(s_text('text'))} AS w FROM documents), u AS (SELECT source, count(*) - count(DISTINCT coalesce(text, chr(1))) AS dup FROM d GROUP BY 1)
SELECT d.source, count(*) AS n_documents, count(*) FILTER (WHERE text IS NULL) AS n_null, count(*) FILTER (WHERE text IS NOT NULL AND length({s_strip('text')}) = 0) AS n_empty, any_value(dup) AS n_duplicate,
count(*) FILTER (WHERE w < 10) AS n_short, count(*) FILTER (WHERE w > 300) AS n_long FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source GROUP BY 1""")
def doc_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "text")
    w = T.word_count(T.text("text"))
    # Equal texts of a source are counted first, so a text that is there very often is one row after partial aggregation.
    texts = d.groupBy("source", "text").agg(F.count("*").alias("n"))
    n = F.col("n")
    when = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return texts.groupBy("source").agg(
        F.sum(n).alias("n_documents"), when(F.col("text").isNull()).alias("n_null"), when(F.col("text").isNotNull() & T.is_blank(T.text("text"))).alias("n_empty"), F.sum(n - 1).alias("n_duplicate"), when(w < 10).alias("n_short"), when(w > 300).alias("n_long"),
    )


@query(f"SELECT CAST(CASE WHEN l < 0 THEN 0 WHEN l >= 1500 THEN 31 ELSE floor(l / 50) + 1 END AS BIGINT) AS bin, count(*) AS n FROM (SELECT length({s_text('generated_text')}) AS l FROM merged_records) GROUP BY 1")
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(table(spark, sf, MERGED), T.char_count(T.text("generated_text")), 0, 1500, 30)


@query(f"SELECT model_label, quantile_cont(l, 0.25) AS q1, quantile_cont(l, 0.5) AS median, quantile_cont(l, 0.75) AS q3 FROM (SELECT model_label, length({s_text('generated_text')}) AS l FROM merged_records) GROUP BY 1")
def length_quartiles_by_label(spark: SparkSession, sf: str) -> DataFrame:
    q = F.percentile(T.char_count(T.text("generated_text")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return table(spark, sf, MERGED).groupBy("model_label").agg(q.alias("q")).select("model_label", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


@query(f"""SELECT lang, round(avg(w), 4) AS avg_words, quantile_cont(w, 0.5) AS median_words, min(w) AS min_words, max(w) AS max_words, round(avg(u), 4) AS avg_unique_words
FROM (SELECT lang, {s_words(s_text('text'))} AS w, len(list_distinct(regexp_extract_all({s_text('text')}, '{TOKEN}'))) AS u FROM documents) GROUP BY 1""")
def document_word_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", T.tokens(T.text("text")).alias("tokens"))
    w, u = F.size("tokens").cast("bigint"), F.size(F.array_distinct("tokens"))
    return d.groupBy("lang").agg(F.round(F.avg(w), 4).alias("avg_words"), F.percentile(w, F.lit(0.5)).alias("median_words"), F.min(w).alias("min_words"), F.max(w).alias("max_words"), F.round(F.avg(u), 4).alias("avg_unique_words"))


@query("""SELECT count(DISTINCT prefix_id) AS n_prefixes, count(DISTINCT dataset_name) AS n_datasets, count(DISTINCT model_name) AS n_model_names, count(DISTINCT category) AS n_categories FROM merged_records""")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = {"n_prefixes": "prefix_id", "n_datasets": "dataset_name", "n_model_names": "model_name", "n_categories": "category"}
    return table(spark, sf, MERGED).agg(*[F.count_distinct(c).alias(n) for n, c in names.items()])


@query("""SELECT model_label, count(*) AS n_records, count(*) FILTER (WHERE generation_time >= 0) AS n_timed, round(coalesce(sum(generation_time) FILTER (WHERE generation_time >= 0), 0), 4) AS total_seconds,
round(coalesce(avg(generation_time) FILTER (WHERE generation_time >= 0), 0), 6) AS avg_seconds, round(CASE WHEN sum(generation_time) FILTER (WHERE generation_time >= 0) > 0 THEN count(*) FILTER (WHERE generation_time >= 0) / sum(generation_time) FILTER (WHERE generation_time >= 0) ELSE 0 END, 6) AS records_per_second
FROM merged_records GROUP BY 1""")
def throughput_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("generation_time") >= 0, F.col("generation_time"))
    total = F.coalesce(F.sum(t), F.lit(0.0))
    return table(spark, sf, MERGED).groupBy("model_label").agg(F.count("*").alias("n_records"), F.count(t).alias("n_timed"), F.round(total, 4).alias("total_seconds"), F.round(F.coalesce(F.avg(t), F.lit(0.0)), 6).alias("avg_seconds"), F.round(T.per(F.count(t), total), 6).alias("records_per_second"))


@query("""SELECT model_label, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'validation') AS validation, count(*) FILTER (WHERE s = 'test') AS test
FROM merged_records JOIN (SELECT DISTINCT record_id, CASE WHEN trim(lower(split)) = 'val' THEN 'validation' ELSE trim(lower(split)) END AS s FROM split_index) USING (record_id) GROUP BY 1""")
def split_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.lower(F.trim("split"))
    s = table(spark, sf, "split_index").select("record_id", F.when(name == "val", "validation").otherwise(name).alias("split")).distinct()
    return table(spark, sf, MERGED).select("record_id", "model_label").join(s, "record_id").groupBy("model_label").pivot("split", ["train", "validation", "test"]).count().na.fill(0)


@query("SELECT source, dataset_name, n FROM (SELECT 'documents' AS source, lower(trim(replace(source, '-', '_'))) AS dataset_name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'prefix_records', dataset_name, count(*) FROM prefix_records GROUP BY 2 UNION ALL SELECT 'merged_records', dataset_name, count(*) FROM merged_records GROUP BY 2)")
def dataset_union_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.lower(F.trim(F.replace("source", F.lit("-"), F.lit("_")))).alias("dataset_name"))]
    parts += [table(spark, sf, t).select(F.lit(t).alias("source"), "dataset_name") for t in ("prefix_records", MERGED)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source", "dataset_name").agg(F.count("*").alias("n"))


@query("SELECT dataset_name FROM merged_records INTERSECT SELECT lower(trim(source)) FROM documents")
def dataset_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, MERGED).select("dataset_name").intersect(table(spark, sf, "documents").select(F.lower(F.trim("source")).alias("dataset_name")))


@query("SELECT DISTINCT prefix_id FROM merged_records WHERE model_label = 'llama3' UNION SELECT DISTINCT prefix_id FROM merged_records WHERE model_label = 'gemma2'")
def completed_union(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that either of two runs completed."""
    m = table(spark, sf, MERGED)
    return m.where("model_label = 'llama3'").select("prefix_id").union(m.where("model_label = 'gemma2'").select("prefix_id")).distinct()


@query("SELECT dataset_name, count(*) FILTER (WHERE category IS NULL) AS n_null, count(*) FILTER (WHERE lower(category) LIKE '%news%') AS n_news FROM merged_records WHERE dataset_name <> 'calibration' GROUP BY 1")
def category_predicates(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, MERGED).where("dataset_name <> 'calibration'")
    return m.groupBy("dataset_name").agg(F.count_if(F.col("category").isNull()).alias("n_null"), F.count_if(F.col("category").ilike("%news%")).alias("n_news"))
