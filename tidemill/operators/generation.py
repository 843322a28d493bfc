"""Prompts, resumable generation, checkpoints."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemill.functions import python as P
from tidemill.sources import io

log = logging.getLogger(__name__)

# The prompt templates.
TEMPLATES = {
    "raw": "{prefix}",
    "completion": "{prefix}",
    "instruction": "Instruction: Continue the following text naturally.\nText: {prefix}\nCompletion:",
}
CHAT_MESSAGE = "Continue writing the following text naturally, maintaining the tone, style, and vocabulary:\n\n{prefix}"


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with its named slots filled in."""
    c = F.lit(template)
    for name, value in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), value)
    return c


def prompt(prefix: Column, mode: str = "raw", templates: dict[str, str] = TEMPLATES) -> Column:
    """The prompt of a prefix; an unknown mode is raw, chat without a chat template (with a {message} slot) is instruction."""
    mode = mode.lower()
    if mode == "chat" and "chat" in templates:
        return fill(templates["chat"], {"message": fill(CHAT_MESSAGE, {"prefix": prefix})})
    mode = "instruction" if mode == "chat" else mode if mode in templates else "raw"
    return prefix if mode == "raw" else fill(templates[mode], {"prefix": prefix})


def pending(prefixes: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What no earlier run has completed."""
    return prefixes.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


class Failures(AccumulatorParam):
    """How many prompts failed, and the error of one of them; a batch that is tried again counts again."""

    def __init__(self, spark: SparkSession):
        self.total = spark.sparkContext.accumulator((0, ""), self)

    def zero(self, value: tuple) -> tuple:
        return 0, ""

    def addInPlace(self, a: tuple, b: tuple) -> tuple:  # noqa: N802 - Spark's name
        return a[0] + b[0], a[1] or b[1]


def generate(prompts: DataFrame, key: str, prompt_column: str, hook: str = "generate", failures: Failures | None = None) -> DataFrame:
    """Completions by the registered generator, batch by batch. The rows of a failed batch have no text but its error."""
    f, total = P.HOOKS[hook], failures.total if failures else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield pd.DataFrame({key: b[key], "generated_text": f(b[prompt_column]), "error": None})
            except Exception as e:  # noqa: BLE001 - told in the rows
                error = f"{type(e).__name__}: {e}"[:500]
                if total is not None:
                    total.add((len(b), error))
                yield pd.DataFrame({key: b[key], "generated_text": None, "error": error})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt_column).mapInPandas(run, f"{key} {kind}, generated_text string, error string")


def run_resumable(prefixes: DataFrame, path: str, key: str = "prefix_id", prefix: str = "prefix_text", mode: str = "raw", most: int | None = None) -> int:
    """Generate what the output at `path` lacks, up to `most` rows in all, and append it. Returns the rows of the output.

    The output itself is the checkpoint: rows and progress are committed together, so nothing is generated twice. Failed rows
    are counted as they pass, logged and left for the next run.
    """
    spark = prefixes.sparkSession
    done = io.read_if_there(spark, path, StructType([prefixes.schema[key], StructField("generated_text", StringType())]))
    have, rest = (0, prefixes) if done is None else (done.count(), pending(prefixes, done, key))
    if most is not None:
        rest = rest.orderBy(key).limit(max(0, most - have))
    failures = Failures(spark)
    out = generate(rest.withColumn("_prompt", prompt(F.col(prefix), mode)), key, "_prompt", failures=failures)
    out.where("error is null").drop("error").write.mode("append").parquet(path)
    if failures.total.value[0]:
        log.warning("%s prompts failed, one of them with %s", *failures.total.value)
    return spark.read.parquet(path).count()


def latest_status(status: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key of a status table."""
    others = [c for c in status.columns if c != key]
    return status.groupBy(key).agg(F.max_by(F.struct(*others), at).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in others])
