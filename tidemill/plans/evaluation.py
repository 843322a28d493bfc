"""Evaluation queries, over predictions derived from the merged records by a fixed rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import evaluation as E
from tidemill.operators.quality import row_number
from tidemill.plans.base import query, table
from tidemill.plans.corpus import MERGED, s_text

LABELS = ["gemma2", "llama3", "mistral", "phi3", "qwen_tiny"]
S_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
S_PRED = f"(SELECT record_id, dataset_name, model_label AS y, CASE WHEN l % 3 = 0 THEN {S_LIST}[l % 5 + 1] ELSE model_label END AS p, l FROM (SELECT *, length({s_text('generated_text')}) AS l FROM merged_records) WHERE model_label IS NOT NULL)"
S_METRICS = f"""c AS (SELECT y, p, count(*) AS n FROM {S_PRED} GROUP BY 1, 2), t AS (SELECT y AS label, sum(n) AS support, coalesce(sum(n) FILTER (WHERE y = p), 0) AS hits FROM c GROUP BY 1), q AS (SELECT p AS label, sum(n) AS predicted FROM c GROUP BY 1),
m AS (SELECT label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, CASE WHEN coalesce(predicted, 0) > 0 THEN coalesce(hits, 0) / predicted ELSE 0 END AS precision, CASE WHEN coalesce(support, 0) > 0 THEN coalesce(hits, 0) / support ELSE 0 END AS recall FROM t FULL JOIN q USING (label)),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """y, p: the label, and a wrong one where the length says so."""
    n = T.char_count(T.text("generated_text"))
    other = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (n % 5 + 1).cast("int"))
    return table(spark, sf, MERGED).where("model_label is not null").select("record_id", "dataset_name", F.col("model_label").alias("y"), F.when(n % 3 == 0, other).otherwise(F.col("model_label")).alias("p"), n.alias("l"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    by = {c: ((F.col("l") * (i + 7)) % 101).cast("double") + F.when(F.col("p") == c, 60.0).otherwise(0.0) for i, c in enumerate(LABELS)}
    return E.scores(predictions(spark, sf), "y", by)


S_SCORES = f"(SELECT label, score, count(*) FILTER (WHERE y = label) AS pos, count(*) FILTER (WHERE y <> label) AS neg FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS label, y, CAST((l * {i + 7}) % 101 AS DOUBLE) + CASE WHEN p = '{c}' THEN 60 ELSE 0 END AS score FROM {S_PRED}" for i, c in enumerate(LABELS)) + ") GROUP BY 1, 2)"


@query(f"SELECT y, p, count(*) AS n FROM {S_PRED} GROUP BY 1, 2")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(predictions(spark, sf), "y", "p")


@query(f"SELECT y, p, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM (SELECT y, p, count(*) AS n FROM {S_PRED} GROUP BY 1, 2)")
def confusion_norm(spark: SparkSession, sf: str) -> DataFrame:
    return E.normalized(E.confusion(predictions(spark, sf), "y", "p"), "y")


@query(f"""WITH {S_METRICS}, a AS (SELECT label, support, precision, recall, f1 FROM f UNION ALL SELECT 'macro', sum(support), avg(precision), avg(recall), avg(f1) FROM f
UNION ALL SELECT 'weighted', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM f UNION ALL SELECT 'accuracy', sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support) FROM f)
SELECT label, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM a""")
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.class_metrics(E.confusion(predictions(spark, sf), "y", "p"), "y", "p")


@query(f"""WITH s AS {S_SCORES}, b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s), a AS (SELECT label, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY 1)
SELECT label, round(auc, 6) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 6) FROM a""")
def auc_ovr(spark: SparkSession, sf: str) -> DataFrame:
    return E.auc(_scores(spark, sf))


@query(f"SELECT label, score, round(sum(neg) OVER (PARTITION BY label ORDER BY score DESC) / sum(neg) OVER (PARTITION BY label), 6) AS fpr, round(sum(pos) OVER (PARTITION BY label ORDER BY score DESC) / sum(pos) OVER (PARTITION BY label), 6) AS tpr FROM {S_SCORES}")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return E.roc(_scores(spark, sf))


@query(f"SELECT y, p, count(*) AS n FROM {S_PRED} WHERE y <> p GROUP BY 1, 2")
def error_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(predictions(spark, sf).where("y <> p"), "y", "p")


# The models that are compared: one for each dataset of the records, with its accuracy as a score and its mean length as a cost.
S_MODELS = f"(SELECT dataset_name AS model_name, CASE WHEN dataset_name ILIKE '%a%' THEN 'Fingerprint' ELSE 'Traditional' END AS dataset, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS f1, round(avg(l), 4) AS seconds, count(*) AS n FROM {S_PRED} GROUP BY 1)"


def models(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).groupBy(F.col("dataset_name").alias("model_name")).agg(F.round(F.avg(F.when(F.col("y") == F.col("p"), 1.0).otherwise(0.0)), 6).alias("f1"), F.round(F.avg("l"), 4).alias("seconds"), F.count("*").alias("n"))
    return p.withColumn("dataset", F.when(F.col("model_name").ilike("%a%"), "Fingerprint").otherwise("Traditional"))


@query(f"SELECT model_name, f1, row_number() OVER (ORDER BY f1 DESC, model_name) AS rank FROM {S_MODELS}")
def model_rank(spark: SparkSession, sf: str) -> DataFrame:
    return row_number(models(spark, sf).select("model_name", "f1"), [], [F.desc("f1"), F.asc("model_name")])


@query(f"""WITH m AS {S_MODELS}, s AS (SELECT model_name, round(0.7 * CASE WHEN max(f1) OVER () > min(f1) OVER () THEN (f1 - min(f1) OVER ()) / (max(f1) OVER () - min(f1) OVER ()) ELSE 1 END + 0.3 * CASE WHEN max(seconds) OVER () > min(seconds) OVER () THEN 1 - (seconds - min(seconds) OVER ()) / (max(seconds) OVER () - min(seconds) OVER ()) ELSE 1 END, 6) AS score FROM m)
SELECT model_name, score, row_number() OVER (ORDER BY score DESC, model_name) AS rank FROM s""")
def composite_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = E.composite(models(spark, sf), {"f1": 0.7, "seconds": 0.3}, lower=("seconds",), fill={"f1": 0.0, "seconds": 9999.0})
    return row_number(c.select("model_name", "score"), [], [F.desc("score"), F.asc("model_name")])


@query(f"SELECT model_name, round(f1 / sqrt(greatest(seconds, 1e-6)), 6) AS efficiency FROM {S_MODELS} WHERE f1 IS NOT NULL AND seconds IS NOT NULL ORDER BY efficiency DESC, model_name LIMIT 5")
def efficiency_top5(spark: SparkSession, sf: str) -> DataFrame:
    e = models(spark, sf).dropna(subset=["f1", "seconds"]).select("model_name", F.round(F.col("f1") / F.sqrt(F.greatest(F.col("seconds"), F.lit(1e-6))), 6).alias("efficiency"))
    return e.orderBy(F.desc("efficiency"), "model_name").limit(5)


@query(f"SELECT model_name, first(f1) FILTER (WHERE dataset = 'Fingerprint') AS \"Fingerprint\", first(f1) FILTER (WHERE dataset = 'Traditional') AS \"Traditional\" FROM {S_MODELS} GROUP BY 1")
def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return models(spark, sf).groupBy("model_name").pivot("dataset", ["Fingerprint", "Traditional"]).agg(F.first("f1"))


@query(f"SELECT dataset, round(avg(f1), 6) AS mean_f1, max(f1) AS max_f1, count(*) AS n FROM {S_MODELS} GROUP BY 1")
def featureset_perf(spark: SparkSession, sf: str) -> DataFrame:
    return models(spark, sf).groupBy("dataset").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.max("f1").alias("max_f1"), F.count("*").alias("n"))


@query(f"SELECT model_name, CASE WHEN f1 >= 0.75 THEN 'excellent' WHEN f1 >= 0.72 THEN 'good' WHEN f1 >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM {S_MODELS}")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("f1")
    return models(spark, sf).select("model_name", F.when(f >= 0.75, "excellent").when(f >= 0.72, "good").when(f >= 0.5, "fair").otherwise("poor").alias("band"))


@query(f"WITH m AS {S_MODELS} SELECT model_name, 'f1' AS variable, f1 AS value FROM m UNION ALL SELECT model_name, 'seconds', seconds FROM m")
def metric_melt(spark: SparkSession, sf: str) -> DataFrame:
    return models(spark, sf).unpivot("model_name", ["f1", "seconds"], "variable", "value")


@query(f"WITH m AS {S_MODELS}, a AS (SELECT avg(f1) AS base FROM m) SELECT model_name, round(f1 - base, 6) AS delta, CASE WHEN f1 - base > 0.01 THEN 'better' WHEN f1 - base < -0.01 THEN 'worse' ELSE 'equal' END AS verdict FROM m, a")
def score_deltas(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("f1") - F.avg("f1").over(Window.partitionBy())
    return models(spark, sf).select("model_name", F.round(d, 6).alias("delta"), F.when(d > 0.01, "better").when(d < -0.01, "worse").otherwise("equal").alias("verdict"))


@query(f"SELECT dataset, count(*) AS n, round(avg(f1), 6) AS mean_f1, max(f1) AS best_f1, arg_max(model_name, f1) AS winner FROM {S_MODELS} GROUP BY 1")
def pipeline_winner(spark: SparkSession, sf: str) -> DataFrame:
    return models(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.max("f1").alias("best_f1"), F.max_by("model_name", "f1").alias("winner"))


@query(f"SELECT model_name, f1 FROM {S_MODELS} UNION ALL SELECT 'mean of all', round(avg(f1), 6) FROM {S_MODELS}")
def summary_row(spark: SparkSession, sf: str) -> DataFrame:
    m = models(spark, sf).select("model_name", "f1")
    return m.unionByName(m.agg(F.lit("mean of all").alias("model_name"), F.round(F.avg("f1"), 6).alias("f1")))


@query(f"SELECT initcap(replace(model_name, '_', ' ')) || ' / ' || dataset AS label, f1 FROM (SELECT model_name, dataset, f1 FROM {S_MODELS})".replace("initcap(replace(model_name, '_', ' '))", "array_to_string(list_transform(str_split(replace(model_name, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"))
def comparison_labels(spark: SparkSession, sf: str) -> DataFrame:
    return models(spark, sf).select(F.concat_ws(" / ", F.initcap(F.replace("model_name", F.lit("_"), F.lit(" "))), "dataset").alias("label"), "f1")


S_SOFT = "exp(l % 7) / (exp(l % 7) + exp(l % 5) + exp(l % 3))"


@query(f"SELECT record_id, round({S_SOFT} * 100, 4) AS p_first, round(greatest(exp(l % 7), exp(l % 5), exp(l % 3)) / (exp(l % 7) + exp(l % 5) + exp(l % 3)) * 100, 4) AS confidence FROM {S_PRED}")
def softmax_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Scores to probabilities in percent, and the confidence: the largest."""
    raw = F.array(*[(F.col("l") % k).cast("double") for k in (7, 5, 3)])
    df = predictions(spark, sf).select("record_id", F.transform(raw, F.exp).alias("e"))
    p = F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b) * 100)
    return df.select("record_id", p.alias("p")).select("record_id", F.round(F.col("p")[0], 4).alias("p_first"), F.round(F.array_max("p"), 4).alias("confidence"))


@query("SELECT record_id, " + ", ".join(f"CAST(y = '{c}' AS INT) AS is_{c}" for c in LABELS) + f" FROM {S_PRED}")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select("record_id", *[(F.col("y") == c).cast("int").alias(f"is_{c}") for c in LABELS])
