"""Queries of windows, chunks, sampling, splits, joins by key, and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.functions.text import TOKEN
from tidemill.operators import generation as G
from tidemill.operators import windows as W
from tidemill.plans.base import query, table, texts
from tidemill.plans.corpus import MERGED, s_text

S_TOK = f"regexp_extract_all({s_text('text')}, '{TOKEN}')"
S_WINDOWS = f"""WITH t AS (SELECT doc_id, {S_TOK} AS w FROM documents), l AS (SELECT unnest([64, 128, 256]) AS window_length),
x AS (SELECT doc_id, w, window_length, unnest(range(0, len(w) - window_length + 1, greatest(1, window_length - 32))) AS start FROM t, l WHERE len(w) >= 300)
SELECT doc_id, CAST(window_length AS BIGINT) AS window_length, CAST(start AS BIGINT) AS start, md5(array_to_string(w[start + 1 : start + window_length], ' ')) AS window_md5 FROM x"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents", "doc_id", "text").select("doc_id", T.tokens(T.text("text")).alias("tokens"))
    return W.token_windows(d, "tokens").select("doc_id", F.col("window_length").cast("bigint").alias("window_length"), F.col("start").cast("bigint").alias("start"), F.md5("window_text").alias("window_md5"))


@query(S_WINDOWS)
def prefix_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf)


@query(f"SELECT * FROM ({S_WINDOWS}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY window_length, start) <= 10")
def prefix_windows_capped(spark: SparkSession, sf: str) -> DataFrame:
    return W.capped(_windows(spark, sf), ["doc_id"], ["window_length", "start"], 10)


@query(f"""WITH t AS (SELECT doc_id, lang, {S_TOK} AS w FROM documents), x AS (SELECT doc_id, lang, w, unnest(CASE WHEN len(w) <= 250 THEN [0] ELSE list_filter(range(0, len(w), 200), lambda s: least(250, len(w) - s) >= 125) END) AS start FROM t WHERE len(w) > 0)
SELECT doc_id, lang, CAST(start AS BIGINT) AS start, CAST(least(250, len(w) - start) AS BIGINT) AS chunk_words, md5(array_to_string(w[start + 1 : start + 250], ' ')) AS chunk_md5 FROM x""")
def word_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents", "doc_id", "lang", "text").select("doc_id", "lang", T.tokens(T.text("text")).alias("tokens"))
    return W.chunks(d, "tokens").select("doc_id", "lang", F.col("start").cast("bigint").alias("start"), F.col("chunk_words").cast("bigint").alias("chunk_words"), F.md5("chunk_text").alias("chunk_md5"))


@query("SELECT doc_id, format('{}_{}_{:08d}', lower(trim(source)), coalesce(source_split, 'none'), row_number() OVER (PARTITION BY lower(trim(source)), coalesce(source_split, 'none') ORDER BY doc_id) - 1) AS positional_id FROM documents")
def positional_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lower(F.trim("source")).alias("s"), F.coalesce("source_split", F.lit("none")).alias("p"))
    n = W.positions(d, ["s", "p"], F.lpad(F.lower(F.hex("doc_id")), 16, "0"), buckets=64)
    return n.select("doc_id", F.format_string("%s_%s_%08d", "s", "p", F.col("position")).alias("positional_id"))


QUOTA = 500


@query(f"""WITH s AS (SELECT dataset_name, count(*) AS n FROM prefix_records GROUP BY 1), q AS (SELECT dataset_name, n, sum(n) OVER () AS total, least(n, {QUOTA} * n // sum(n) OVER ()) AS base FROM s)
SELECT dataset_name, CAST(n AS BIGINT) AS available, CAST(CASE WHEN total <= {QUOTA} THEN n ELSE base + CASE WHEN row_number() OVER (ORDER BY dataset_name) <= {QUOTA} - sum(base) OVER () THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM q""")
def proportional_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas of the datasets; what flooring leaves goes to them in the order of their names."""
    sizes = sorted((r[0], r[1]) for r in table(spark, sf, "prefix_records").groupBy("dataset_name").count().collect())
    quotas = W.proportional_quotas([n for _, n in sizes], QUOTA)
    return spark.createDataFrame([(d, n, q) for (d, n), q in zip(sizes, quotas)], "dataset_name string, available bigint, quota bigint")


S_QUOTA = f"""WITH s AS (SELECT dataset_name, count(*) AS n FROM prefix_records GROUP BY 1), q0 AS (SELECT dataset_name, n, sum(n) OVER () AS total, least(n, {QUOTA} * n // sum(n) OVER ()) AS base FROM s),
q AS (SELECT dataset_name, CASE WHEN total <= {QUOTA} THEN n ELSE base + CASE WHEN row_number() OVER (ORDER BY dataset_name) <= {QUOTA} - sum(base) OVER () THEN 1 ELSE 0 END END AS quota FROM q0)"""


@query(S_QUOTA + " SELECT dataset_name, prefix_id, extraction_timestamp FROM (SELECT p.*, row_number() OVER (PARTITION BY dataset_name ORDER BY md5(concat_ws('|', '42', prefix_id, extraction_timestamp))) AS rn FROM prefix_records p) JOIN q USING (dataset_name) WHERE rn <= quota")
def proportional_sample(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "prefix_records").select("dataset_name", "prefix_id", "extraction_timestamp")
    sizes = sorted((r[0], r[1]) for r in p.groupBy("dataset_name").count().collect())
    quotas = dict(zip([d for d, _ in sizes], W.proportional_quotas([n for _, n in sizes], QUOTA)))
    rows = W.positions(p, ["dataset_name"], W.seeded(42, "prefix_id", "extraction_timestamp"))
    q = spark.createDataFrame(sorted(quotas.items()), "dataset_name string, quota bigint")
    return rows.join(F.broadcast(q), "dataset_name").where(F.col("position") < F.col("quota")).select("dataset_name", "prefix_id", "extraction_timestamp")


@query("""WITH RECURSIVE s AS (SELECT dataset_name, count(*) AS n, row_number() OVER (ORDER BY dataset_name) AS i, count(*) OVER () AS k FROM prefix_records GROUP BY 1),
r AS (SELECT i, dataset_name, n, least(n, CAST(ceil(500.0 / k) AS BIGINT)) AS target, 500 - least(n, CAST(ceil(500.0 / k) AS BIGINT)) AS rest FROM s WHERE i = 1
UNION ALL SELECT s.i, s.dataset_name, s.n, least(s.n, CAST(ceil(r.rest / (s.k - r.i)) AS BIGINT)), r.rest - least(s.n, CAST(ceil(r.rest / (s.k - r.i)) AS BIGINT)) FROM s JOIN r ON s.i = r.i + 1)
SELECT dataset_name, CAST(target AS BIGINT) AS target FROM r""")
def dynamic_quota(spark: SparkSession, sf: str) -> DataFrame:
    sizes = sorted((r[0], r[1]) for r in table(spark, sf, "prefix_records").groupBy("dataset_name").count().collect())
    return spark.createDataFrame([(d, t) for (d, _), t in zip(sizes, W.sequential_targets([n for _, n in sizes], QUOTA))], "dataset_name string, target bigint")


@query("SELECT record_id FROM merged_records ORDER BY md5(concat_ws('|', '42', CAST(record_id AS VARCHAR))) LIMIT 50")
def shuffle_head(spark: SparkSession, sf: str) -> DataFrame:
    """The head of the seeded shuffle: the limit is the feature."""
    return table(spark, sf, MERGED).select("record_id").orderBy(W.seeded(42, "record_id")).limit(50)


def s_split(edges: dict[str, float], last: str) -> str:
    case = " ".join(f"WHEN p < {e} THEN '{n}'" for n, e in edges.items())
    return f"SELECT record_id, model_label, CASE {case} ELSE '{last}' END AS split FROM (SELECT record_id, model_label, (row_number() OVER (PARTITION BY model_label ORDER BY md5(concat_ws('|', '42', CAST(record_id AS VARCHAR)))) - 1) / count(*) OVER (PARTITION BY model_label) AS p FROM merged_records)"


@query(s_split({"train": 0.7, "validation": 0.85}, "test"))
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return W.stratified_split(table(spark, sf, MERGED), "record_id", "model_label", {"train": 0.7, "validation": 0.15, "test": 0.15})


@query(s_split({"train": 0.7, "validation": 0.8}, "test"))
def split_70_10_20(spark: SparkSession, sf: str) -> DataFrame:
    return W.stratified_split(table(spark, sf, MERGED), "record_id", "model_label", {"train": 0.7, "validation": 0.1, "test": 0.2})


@query("SELECT record_id, model_label, (row_number() OVER (PARTITION BY model_label ORDER BY md5(concat_ws('|', '42', CAST(record_id AS VARCHAR)))) - 1) % 5 AS fold FROM merged_records")
def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return W.folds(table(spark, sf, MERGED), "record_id", "model_label", 5)


@query(f"WITH s AS ({s_split({'train': 0.7, 'validation': 0.85}, 'test')}) SELECT l.prefix_id, n.split FROM (SELECT DISTINCT prefix_id FROM merged_records) l, (SELECT unnest(['train', 'validation', 'test']) AS split) n EXCEPT SELECT m.prefix_id, s.split FROM s JOIN merged_records m USING (record_id)")
def split_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Prefixes that a split has no record of; the product is with a list of three names."""
    m = table(spark, sf, MERGED)
    s = W.stratified_split(m, "record_id", "model_label", {"train": 0.7, "validation": 0.15, "test": 0.15})
    names = m.select("prefix_id").distinct().select("prefix_id", F.explode(F.array(F.lit("train"), F.lit("validation"), F.lit("test"))).alias("split"))
    have = m.select("record_id", "prefix_id").join(s, "record_id").select("prefix_id", "split").distinct()
    return names.join(have, ["prefix_id", "split"], "left_anti")


@query("SELECT s, count(*) AS n FROM (SELECT lower(trim(split)) AS s FROM split_index SEMI JOIN merged_records USING (record_id)) GROUP BY 1")
def split_semi(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "split_index").join(table(spark, sf, MERGED).select("record_id"), "record_id", "left_semi")
    return s.groupBy(F.lower(F.trim("split")).alias("s")).agg(F.count("*").alias("n"))


@query("SELECT prefix_id, dataset_name FROM (SELECT DISTINCT prefix_id, dataset_name FROM prefix_records) p WHERE NOT EXISTS (SELECT 1 FROM merged_records m WHERE m.prefix_id = p.prefix_id AND m.model_label = 'phi3')")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Prefixes that one model has not completed yet."""
    done = table(spark, sf, MERGED).where("model_label = 'phi3'").select("prefix_id")
    return G.pending(table(spark, sf, "prefix_records").select("prefix_id", "dataset_name").distinct(), done, "prefix_id")


@query(f"SELECT prefix_id FROM (SELECT DISTINCT prefix_id FROM prefix_records) p WHERE prefix_id NOT IN (SELECT prefix_id FROM merged_records WHERE model_label = 'phi3' AND prefix_id IS NOT NULL) ORDER BY prefix_id LIMIT greatest(0, 10)")
def resume_next_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The next ten of them: the limit is the feature."""
    done = table(spark, sf, MERGED).where("model_label = 'phi3'").select("prefix_id")
    return G.pending(table(spark, sf, "prefix_records").select("prefix_id").distinct(), done, "prefix_id").orderBy("prefix_id").limit(10)


S_P = s_text("human_prefix")


@query(f"""SELECT record_id, {S_P} AS raw, {S_P} AS completion, 'Instruction: Continue the following text naturally.' || chr(10) || 'Text: ' || {S_P} || chr(10) || 'Completion:' AS instruction,
'Instruction: Continue the following text naturally.' || chr(10) || 'Text: ' || {S_P} || chr(10) || 'Completion:' AS chat, {S_P} AS other,
'<user>Continue writing the following text naturally, maintaining the tone, style, and vocabulary:' || chr(10) || chr(10) || {S_P} || '</user>' AS templated FROM merged_records""")
def prompt_format(spark: SparkSession, sf: str) -> DataFrame:
    p = T.text("human_prefix")
    """Every mode; chat without a template is instruction, an unknown one raw."""
    modes = [G.prompt(p, mode).alias(mode) for mode in ("raw", "completion", "instruction", "chat", "other")]
    return table(spark, sf, MERGED).select("record_id", *modes, G.prompt(p, "chat", G.TEMPLATES | {"chat": "<user>{message}</user>"}).alias("templated"))


@query("""WITH p AS (SELECT DISTINCT prefix_id FROM prefix_records), m AS (SELECT DISTINCT model_label FROM merged_records), d AS (SELECT prefix_id, model_label, count(*) AS n FROM merged_records GROUP BY 1, 2)
SELECT model_label, count(*) AS n_prefixes, count(n) AS n_completed FROM p CROSS JOIN m LEFT JOIN d USING (prefix_id, model_label) GROUP BY 1""")
def prefix_model_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Every prefix for every model (a fixed, short list, carried by an explode), with what is done."""
    m = table(spark, sf, MERGED)
    models = sorted(r[0] for r in m.select("model_label").where("model_label is not null").distinct().collect())
    every = table(spark, sf, "prefix_records").select("prefix_id").distinct().select("prefix_id", F.explode(F.array(*[F.lit(x) for x in models])).alias("model_label"))
    done = m.groupBy("prefix_id", "model_label").agg(F.count("*").alias("n"))
    return every.join(done, ["prefix_id", "model_label"], "left").groupBy("model_label").agg(F.count("*").alias("n_prefixes"), F.count("n").alias("n_completed"))


@query("SELECT record_id, dense_rank() OVER (ORDER BY model_label) - 1 AS label_id FROM merged_records WHERE model_label IS NOT NULL")
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by their place in sorted order: the labels are few, the mapping is broadcast."""
    m = table(spark, sf, MERGED).where("model_label is not null").select("record_id", "model_label")
    ids = m.select("model_label").distinct().withColumn("label_id", F.row_number().over(Window.orderBy("model_label")).cast("bigint") - 1)
    return m.join(F.broadcast(ids), "model_label").select("record_id", "label_id")


@query("SELECT DISTINCT model_label, CASE model_label WHEN 'llama3' THEN 'Llama 3' WHEN 'gemma2' THEN 'Gemma 2' WHEN 'qwen_tiny' THEN 'Qwen' ELSE upper(substr(model_label, 1, 1)) || lower(substr(model_label, 2)) END AS display_name FROM merged_records")
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("llama3", "Llama 3", "gemma2", "Gemma 2", "qwen_tiny", "Qwen")])
    return table(spark, sf, MERGED).select("model_label", F.coalesce(names[F.col("model_label")], F.initcap(F.replace("model_label", F.lit("_"), F.lit(" ")))).alias("display_name")).distinct()


@query("SELECT CAST((row_number() OVER (PARTITION BY model_label ORDER BY lpad(lower(to_hex(record_id)), 16, '0')) - 1) // 256 AS BIGINT) AS batch, model_label, record_id FROM merged_records")
def batch_assign(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.positions(table(spark, sf, MERGED).select("model_label", "record_id"), ["model_label"], F.lpad(F.lower(F.hex("record_id")), 16, "0"))
    return rows.select(F.floor(F.col("position") / 256).cast("bigint").alias("batch"), "model_label", "record_id")


@query("""WITH b AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)
SELECT hour, n, CAST(sum(n) OVER (ORDER BY hour) AS BIGINT) AS cumulative, CAST(sum(n) OVER () - sum(n) OVER (ORDER BY hour) AS BIGINT) AS remaining, round(sum(n) OVER (ORDER BY hour) / (epoch(hour) - epoch(min(hour) OVER ()) + 3600), 6) AS per_second FROM b""")
def running_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals over hours (aggregated first: the window sees one row per hour)."""
    b = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    w, every = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    c = F.sum("n").over(w)
    seconds = F.unix_timestamp("hour") - F.unix_timestamp(F.min("hour").over(every)) + 3600
    return b.select("hour", "n", c.alias("cumulative"), (F.sum("n").over(every) - c).alias("remaining"), F.round(c / seconds, 6).alias("per_second"))


@query("""SELECT m.record_id, p.prefix_lang, p.prefix_length FROM merged_records m JOIN (SELECT prefix_id, arg_min(prefix_lang, extraction_timestamp) AS prefix_lang, arg_min(prefix_length, extraction_timestamp) AS prefix_length FROM (SELECT prefix_id, coalesce(prefix_lang, '') AS prefix_lang, prefix_length, extraction_timestamp FROM prefix_records) GROUP BY 1) p USING (prefix_id)""")
def pair_prefix_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Each record with its prefix as it was first extracted."""
    p = table(spark, sf, "prefix_records").groupBy("prefix_id").agg(F.min_by(F.struct(F.coalesce("prefix_lang", F.lit("")).alias("prefix_lang"), "prefix_length"), "extraction_timestamp").alias("p"))
    return table(spark, sf, MERGED).select("record_id", "prefix_id").join(p, "prefix_id").select("record_id", "p.prefix_lang", "p.prefix_length")
