"""Model queries: rows only, as fitted models have no SQL. Fitted on the train rows, reported on the test rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import models as M
from tidemill.operators import stylometry as S
from tidemill.operators import windows as W
from tidemill.plans.base import query, table, texts
from tidemill.plans.corpus import MERGED

STYLE = ["avg_word_length", "avg_sentence_length", "type_token_ratio", "hapax_ratio", "uppercase_ratio", "digit_ratio", "whitespace_ratio", "punctuation_ratio", "comma", "period", "lexical_density", "short_word_ratio", "word_count"]


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, MERGED)
    features = M.assemble(S.style23(texts(spark, sf, MERGED, "record_id", "generated_text"), "record_id", "generated_text"), STYLE).select("record_id", "features")
    splits = W.stratified_split(m.where("model_label is not null"), "record_id", "model_label", {"train": 0.7, "validation": 0.15, "test": 0.15})
    rows = features.join(splits, "record_id")
    return M.index_labels(rows, "model_label").transform(rows).join(W.folds(m, "record_id", "model_label", 5).select("record_id", "fold"), "record_id")


def _fitted(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = _rows(spark, sf).cache()
    c = M.Classifier(name, "stylometric").fit(rows.where("split = 'train'"))
    if name in ("svm", "boosting"):
        c.calibrate(rows.where("split = 'validation'"))
    out = c.predict(rows.where("split = 'test'"))
    return out.groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


@query()
def fit_lr(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "logistic")


@query()
def fit_ovr_svc(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "svm")


@query()
def fit_rf(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "forest")


@query()
def fit_gbt(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "boosting")


@query()
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The most important features of a forest."""
    rows = _rows(spark, sf)
    c = M.Classifier("forest").fit(rows.where("split = 'train'"))
    pairs = sorted(zip(STYLE, map(float, c.model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))[:10]
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(pairs)], "rank int, feature string, importance double")


@query()
def stacking_oof(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).cache()
    out, _ = M.stacked(rows.where("split = 'train'"), rows.where("split = 'test'"), ["logistic", "forest"], folds=2)
    return out.groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


@query()
def tune_grid(spark: SparkSession, sf: str) -> DataFrame:
    best = M.tune(_rows(spark, sf).where("split = 'train'").select("label", "features").cache())
    return spark.createDataFrame([(r, float(f)) for r, f in best], "reg_param double, f1 double")


@query()
def predict_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Label, confidence and probabilities of every record with text; blank ones are rejected."""
    rows = _rows(spark, sf).cache()
    m = M.index_labels(rows.select("model_label"), "model_label")
    c = M.Classifier("logistic").fit(rows.where("split = 'train'"))
    ok = table(spark, sf, MERGED).where(F.length(F.trim("generated_text")) > 0).select("record_id")
    p = c.predict(rows.join(ok, "record_id", "left_semi"))
    names = F.array(*[F.lit(x) for x in m.labels])
    probs = F.transform(vector_to_array("probability"), lambda x: F.round(x * 100, 2))
    return p.select("record_id", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted_model"), F.array_max(probs).alias("confidence"), F.map_from_arrays(names, probs).alias("probabilities"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))


@query()
def pca95(spark: SparkSession, sf: str) -> DataFrame:
    """The components that explain 95 percent of the variance."""
    pipe, n = M.pca_share(_vectors(spark, sf), "v", 0.95)
    shares = [float(x) for x in pipe.stages[1].explainedVariance][:n]
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(shares)], "component int, explained double")


@query()
def svd_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Two projections of the vectors, each weighted by a quarter, in one vector."""
    v = _vectors(spark, sf)
    svd, _ = M.truncated_svd(v, "vec_id", "v", 16)
    pipe, _ = M.pca_share(v, "v", 0.95)
    pca = pipe.transform(v).select("vec_id", vector_to_array("pca").alias("pca"))
    fused = M.fuse({"svd": svd, "pca": pca}, "vec_id")
    return fused.select("vec_id", F.size(vector_to_array("features")).alias("dims"), F.round(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy"))


@query()
def open_set(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors far from three quarters of them, which the distance is fitted on."""
    v = table(spark, sf, "embeddings")
    d = M.mahalanobis(v, "vec_id", "embedding", fitted_on=v.where(F.pmod(F.xxhash64("vec_id"), F.lit(4)) > 0))
    return d.select("vec_id", F.round("distance", 4).alias("distance"), "is_unknown")
