"""Queries of sources, sinks, generation and streams. They write below a folder of their own in the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import python as P
from tidemill.functions import text as T
from tidemill.operators import generation as G
from tidemill.plans.base import query, shared_folder, table
from tidemill.plans.corpus import MERGED, s_strip, s_text
from tidemill.plans.preparation import s_normal
from tidemill.sources import io
from tidemill.streaming import streams


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"


GENERATED_SQL = "prefix_id, dataset_name, category, human_prefix, generated_text, model_name, temperature, top_p, max_new_tokens, prompt_length, completion_length, generation_time, generation_timestamp AS timestamp"


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, MERGED).withColumnRenamed("generation_timestamp", "timestamp")


@query(f"SELECT model_label, count(*) AS n, count(DISTINCT prefix_id) AS prefixes FROM (SELECT {GENERATED_SQL}, model_label FROM merged_records WHERE model_label IS NOT NULL) GROUP BY 1")
def folder_labels(spark: SparkSession, sf: str) -> DataFrame:
    """One folder per model, written with the fixed schema and read again with the folder's name as label."""
    path = scratch(spark)
    m = _generated(spark, sf).where("model_label is not null")
    for label in sorted(r[0] for r in m.select("model_label").distinct().collect()):  # a folder each: models are few
        io.append(m.where(F.col("model_label") == label), f"{path}/{label}/generated.parquet", io.GENERATED)
    df = io.read_labelled(spark, path.removeprefix("file://"))
    return df.groupBy("model_label").agg(F.count("*").alias("n"), F.count_distinct("prefix_id").alias("prefixes"))


@query("SELECT record_id, md5(generated_text) AS text_md5, category FROM merged_records")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as CSV and read again: line breaks, quotes, blanks, nulls and empty texts survive."""
    path = scratch(spark)
    io.write_csv(table(spark, sf, MERGED).select("record_id", "generated_text", "category"), path)
    return io.read_csv(spark, path, "record_id bigint, generated_text string, category string").select("record_id", F.md5("generated_text").alias("text_md5"), "category")


@query("SELECT 2 * count(*) AS n, count(DISTINCT record_id) AS n_ids FROM merged_records")
def append_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to one output, neither of which reads what is there."""
    path = scratch(spark)
    m = table(spark, sf, MERGED).select("record_id", "prefix_id", "generated_text")
    for _ in range(2):
        io.append(m, path, rows_per_file=100_000)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("n_ids"))


@query("SELECT model_label, count(*) AS n FROM merged_records GROUP BY 1")
def json_report(spark: SparkSession, sf: str) -> DataFrame:
    """A nested report written as JSON, parsed again into rows."""
    path = scratch(spark)
    counts = table(spark, sf, MERGED).groupBy("model_label").agg(F.count("*").alias("n"))
    io.write_json(counts.agg(F.collect_list(F.struct("model_label", "n")).alias("classes")), path)
    return spark.read.schema("classes array<struct<model_label: string, n: bigint>>").json(path).select(F.inline("classes"))


@query("SELECT format('prefix_{:04d}', i) AS prefix_id, 'mock' AS dataset_name, 'test' AS category, format('This is mock prefix number {}.', i) AS prefix_text FROM range(15) t(i)")
def mock_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return io.mock_prefixes(spark)


@query(f"SELECT prefix_id, count(*) AS n, any_value(text_length) AS prompt_length FROM (SELECT prefix_id, length('Instruction: Continue the following text naturally.' || chr(10) || 'Text: ' || {s_text('prefix_text')} || chr(10) || 'Completion:') AS text_length FROM prefix_records QUALIFY row_number() OVER (PARTITION BY prefix_id ORDER BY extraction_timestamp DESC NULLS LAST, prefix_text) = 1) GROUP BY 1")
def resume_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Half of all prefixes, then the rest, then nothing, by a generator that gives the prompt back: each prefix once, with the length of its prompt."""
    path = scratch(spark)
    p = table(spark, sf, "prefix_records").select("prefix_id", T.text("prefix_text").alias("prefix_text"), F.coalesce("extraction_timestamp", F.lit("")).alias("at"))
    p = p.groupBy("prefix_id").agg(F.max_by("prefix_text", F.struct("at", F.hash("prefix_text"))).alias("prefix_text"))
    half = p.where(F.pmod(F.xxhash64("prefix_id"), F.lit(2)) == 0)
    with P.using("generate", lambda prompts: prompts):
        for rows in (half, p, p):
            G.run_resumable(rows, path, mode="instruction")
    return spark.read.parquet(path).groupBy("prefix_id").agg(F.count("*").alias("n"), F.max(F.length("generated_text")).alias("prompt_length"))


@query("SELECT prefix_id, arg_max(extraction_timestamp, extraction_timestamp) AS extraction_timestamp FROM prefix_records GROUP BY 1")
def latest_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The newest state of each key of a status table."""
    p = table(spark, sf, "prefix_records").select("prefix_id", "extraction_timestamp", "dataset_name")
    return G.latest_status(p, "prefix_id", "extraction_timestamp").select("prefix_id", "extraction_timestamp")


@query(f"SELECT count(*) AS n_rows, count(DISTINCT k) AS n_keys FROM (SELECT DISTINCT {s_normal('lower(' + s_text('text') + ')')} AS k FROM documents)")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """A streaming run over the documents that keeps the first row of each normalised text."""
    path = scratch(spark)
    d = table(spark, sf, "documents").select("doc_id", "text")
    io.append(d, f"{path}/in")
    streams.run(streams.deduplicated(streams.read_stream(spark, f"{path}/in", d.schema), "text"), f"{path}/out", f"{path}/state")
    out = spark.read.parquet(f"{path}/out")
    return out.agg(F.count("*").alias("n_rows"), F.count_distinct(streams.duplicate_key(F.col("text"))).alias("n_keys"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {s_normal('lower(' + s_text('text') + ')')}")
def stream_dedup_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same over two runs: the second starts where the first ended and adds only what is new."""
    path = scratch(spark)
    d = table(spark, sf, "documents").select("doc_id", "text")
    for part in ("doc_id % 2 = 0 OR doc_id % 2 = 1", "doc_id IS NOT NULL"):  # the second run brings every row again
        io.append(d.where(part), f"{path}/in")
        streams.deduplicate_into(streams.read_stream(spark, f"{path}/in", d.schema), "text", "doc_id", f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("doc_id")


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: tumbling windows over the events, as the stream's final state."""
    path = scratch(spark)
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    io.append(e, f"{path}/in")
    stream = streams.read_stream(spark, f"{path}/in", e.schema)
    streams.run_complete(streams.windowed_totals(stream, "ts", "value"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(f"SELECT record_id FROM merged_records WHERE length({s_strip(s_text('human_prefix'))}) > 0")
def inference_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Records that may go to a model; null and blank inputs are turned away."""
    return table(spark, sf, MERGED).where(~T.is_blank(T.text("human_prefix"))).select("record_id")


@query()
def stored_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes of the merged records, from file metadata alone."""
    return io.stored_size(spark, f"{sf}/merged_records.parquet")
