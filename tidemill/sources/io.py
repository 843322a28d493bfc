"""Sources and sinks: schemas, discovery of datasets, readers, writers, JSON and CSV reports, configuration."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def fields(spec: str) -> StructType:
    """A schema from `name kind` pairs, without a session."""
    kinds = {"string": StringType(), "double": DoubleType(), "bigint": LongType()}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split() for x in spec.split(","))])


GENERATED = fields(
    "prefix_id string, dataset_name string, category string, human_prefix string, generated_text string, model_name string, temperature double, top_p double, max_new_tokens bigint, prompt_length bigint, completion_length bigint, generation_time double, timestamp string"
)
DOCUMENT = fields("text string, document_id string, source_split string")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, in whatever file system it lies. Other failures are raised, not taken for an answer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_if_there(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table at a path, which may hold no file yet; none if there is no such path."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else None


def with_id(df: DataFrame, name: str = "id") -> DataFrame:
    """An id column, made only where the input has none: unique, not consecutive, without a shuffle."""
    return df if name in df.columns else df.select(F.monotonically_increasing_id().alias(name), "*")


def same_schema(frames: dict[str, DataFrame]) -> None:
    """All inputs must have the same column names and types, in whatever order; a ValueError says which differs from the first."""
    first = None
    for name, df in frames.items():
        kinds = sorted(df.dtypes)
        if first is None:
            first = (name, kinds)
        elif kinds != first[1]:
            raise ValueError(f"the columns of {name} differ from those of {first[0]}: {sorted(set(kinds) ^ set(first[1]))}")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns, in its order and types."""
    require_columns(df, schema.names)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def reorder(df: DataFrame, first: list[str]) -> DataFrame:
    """The canonical columns first, others after them."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def append(df: DataFrame, path: str, schema: StructType | None = None, codec: str = "zstd", rows_per_file: int = 0) -> None:
    """Append without reading or rewriting what is there."""
    w = (conform(df, schema) if schema else df).write.mode("append").option("compression", codec)
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path)


def first_text(record: Column, keys: tuple[str, ...] = ("text", "body", "content", "article", "document")) -> Column:
    """The text of a JSON record: the first of the keys that holds any. A list gives its parts in order, joined by blank
    lines; a list of objects their first such key; an object its own."""
    out = None
    for k in keys:
        path = f"$.{k}"
        value = F.get_json_object(record, path)
        kind = F.substring(F.ltrim(value), 1, 1)
        strings = F.from_json(value, "array<string>")
        parts = F.transform(strings, lambda x: F.coalesce(*[F.get_json_object(x, f"$.{j}") for j in keys], F.when(~F.ltrim(x).startswith("{"), x)))
        joined = F.array_join(F.filter(parts, lambda x: F.length(F.trim(x)) > 0), "\n\n")
        inner = F.coalesce(*[F.get_json_object(value, f"$.{j}") for j in keys])
        t = F.when((kind == "[") & F.rtrim(value).endswith("]") & (F.length(joined) > 0), joined).when((kind == "{") & inner.isNotNull(), inner).otherwise(value)
        from tidemill.functions.text import strip

        t = strip(t)
        t = F.when(F.length(t) > 0, t)
        out = t if out is None else F.coalesce(out, t)
    return out


def discover(root: str, file: str = "generated.parquet") -> list[tuple[str, str]]:
    """(label, path) of each sub-folder with the file, by name."""
    return [(d, p) for d in sorted(os.listdir(root)) if os.path.exists(p := os.path.join(root, d, file))]


def read_labelled(spark: SparkSession, root: str, file: str = "generated.parquet") -> DataFrame:
    """All datasets below a folder, each with its folder's name as `model_label`."""
    found = discover(root, file)
    if not found:
        raise FileNotFoundError(f"no {file} below {root}")
    same_schema({label: spark.read.parquet(p) for label, p in found})  # footers only
    df = spark.read.parquet(*[p for _, p in found])
    return df.withColumn("model_label", F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{file.replace('.', chr(92) + '.')}(?:/|$)", 1))


def validate_folders(spark: SparkSession, root: str, expected: list[str], file: str = "generated.parquet") -> DataFrame:
    """One row per sub-folder: whether its file is there, readable, not empty and has the columns; nulls and duplicates."""
    from functools import reduce

    parts = []
    schema = "dataset_name string, is_valid boolean, total_records bigint, missing_columns array<string>, null_counts map<string,bigint>, duplicate_texts bigint, error_message string"
    for d in sorted(os.listdir(root)):
        path = os.path.join(root, d, file)
        if not os.path.isdir(os.path.join(root, d)):
            continue
        try:
            df = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001 - reported
            parts.append(spark.createDataFrame([(d, False, 0, [], {}, 0, str(e).split("\n")[0][:200])], schema))
            continue
        missing = [c for c in expected if c not in df.columns]
        have = [c for c in expected if c in df.columns]
        nulls = F.create_map(*[x for c in have for x in (F.lit(c), F.count_if(F.col(c).isNull()))]) if have else F.create_map().cast("map<string,bigint>")
        dup = F.count("*") - F.count_distinct(F.coalesce(F.col("generated_text"), F.lit("\x01"))) if "generated_text" in df.columns else F.lit(0)
        parts.append(df.agg(F.lit(d).alias("dataset_name"), ((F.count("*") > 0) & F.lit(not missing)).alias("is_valid"), F.count("*").alias("total_records"), F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"), nulls.alias("null_counts"), dup.cast("bigint").alias("duplicate_texts"), F.lit(None).cast("string").alias("error_message")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def export(df: DataFrame, path: str) -> None:
    """Parquet, and CSV that survives line breaks and quotes."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    write_csv(df, f"{path}/csv")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in which line breaks, quotes, backslashes, outer blanks, nulls and empty texts survive."""
    df.write.mode("overwrite").options(header=True, escape='"', quoteAll=True, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.options(header=True, multiLine=True, escape='"', nullValue="\\N", emptyValue="")
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def mock_prefixes(spark: SparkSession, n: int = 15) -> DataFrame:
    return spark.range(n).select(F.format_string("prefix_%04d", "id").alias("prefix_id"), F.lit("mock").alias("dataset_name"), F.lit("test").alias("category"), F.format_string("This is mock prefix number %d.", "id").alias("prefix_text"))


def artefacts(spark: SparkSession, root: str) -> DataFrame:
    """Files and megabytes per first-level folder, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    section = F.element_at(F.split(F.replace("path", F.lit(os.path.abspath(root)), F.lit("\x00")), "\x00/?"), -1)
    return files.groupBy(F.split(section, "/")[0].alias("section")).agg(F.count("*").alias("n_files"), F.round(F.sum("length") / 1e6, 3).alias("megabytes"))


def load_config(path: str, defaults: dict | None = None) -> dict:
    import yaml

    with open(path) as f:
        data = yaml.safe_load(f)
    if not isinstance(data, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return (defaults or {}) | data


def first_readable(*readers) -> DataFrame:
    """The first of several readers (functions without arguments) that works; the last error if none does."""
    error: Exception | None = None
    for r in readers:
        try:
            return r()
        except Exception as e:  # noqa: BLE001 - the next one is tried
            error = e
    raise error or ValueError("no readers")


def read_existing(spark: SparkSession, paths: list[str], columns: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The given columns of those of the paths that can be read, and the paths that cannot."""
    out, missing = None, []
    for p in paths:
        try:
            part = require_columns(spark.read.parquet(p), columns).select(*columns)
        except Exception:  # noqa: BLE001 - reported
            missing.append(p)
            continue
        out = part if out is None else out.unionByName(part)
    return out, missing


def stored_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of a table, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def parquet_to_csv(spark: SparkSession, tables: dict[str, str], root: str) -> None:
    for name, path in tables.items():
        write_csv(spark.read.parquet(path), f"{root}/{name}")
