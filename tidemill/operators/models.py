"""Model training: vectors, projections, classifiers, stacking, tuning, open-set detection.

Classifiers are fitted on the rows that they are given, which the queries choose to be train rows; projections and distances are
fitted on the rows that they describe, or on `fitted_on` where that is given.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, MaxAbsScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def index_labels(df: DataFrame, label: str) -> Model:
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return df.join(F.broadcast(counts.crossJoin(total).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))), label)


def pca_share(df: DataFrame, column: str, share: float = 0.95, most: int | None = None) -> tuple[Model, int]:
    """A centred PCA, and the least number of components that explains the share.

    most: components to compute, all if none; a ValueError is raised if they do not explain the share.
    """
    if most is None:
        most = len(df.select(column).where(F.col(column).isNotNull()).head()[0])
    pipe = Pipeline(stages=[StandardScaler(inputCol=column, outputCol="_c", withMean=True, withStd=False), PCA(k=most, inputCol="_c", outputCol="pca")]).fit(df)
    total, n = 0.0, 0
    for v in pipe.stages[1].explainedVariance:
        n += 1
        total += v
        if total >= share - 1e-9:
            return pipe, n
    raise ValueError(f"{n} components explain {total:.4f} of the variance, not {share}")


def moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and sum of outer products of an array column: one matrix a partition, in Arrow batches, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, None, None
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten(), dtype=float).reshape(b.num_rows, -1)
                n += len(x)
                total = x.sum(0) + (0 if total is None else total)
                outer = x.T @ x + (0 if outer is None else outer)
        if n:
            d = len(total)
            i = np.concatenate([np.repeat(np.arange(d), d), np.full(d + 1, -1)]).astype(np.int32)
            j = np.concatenate([np.tile(np.arange(d), d), np.arange(d), [-1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([outer.ravel(), total, [float(n)]]))], ["i", "j", "v"])

    parts = df.select(F.col(column).cast("array<double>").alias("v")).where(F.col("v").isNotNull()).mapInArrow(run, "i int, j int, v double")
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # as many as the dimensions squared
    d = 1 + max((r["j"] for r in rows), default=-1)
    n, total, outer = 0, np.zeros(d), np.zeros((d, d))
    for r in rows:
        if r["i"] >= 0:
            outer[r["i"], r["j"]] = r["v"]
        elif r["j"] >= 0:
            total[r["j"]] = r["v"]
        else:
            n = int(r["v"])
    return n, total, outer


def dots(column: str, directions: np.ndarray) -> F.Column:
    """The products of an array column with each column of a matrix."""
    return F.array(*[F.aggregate(F.zip_with(column, F.array(*[F.lit(float(x)) for x in directions[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for j in range(directions.shape[1])])


def truncated_svd(df: DataFrame, key: str, column: str, k: int, fitted_on: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """Rows projected on the first k right singular vectors, and the singular values."""
    rows = df.select(key, vector_to_array(column).alias("v"))
    _, _, outer = moments((fitted_on or df).select(vector_to_array(column).alias("v")), "v")
    values, vectors = np.linalg.eigh(outer)
    order = np.argsort(-values)[:k]
    vectors = vectors[:, order] * np.where(np.abs(vectors[:, order]).max(0) == vectors[:, order].max(0), 1.0, -1.0)  # the largest part is positive
    return rows.select(key, dots("v", vectors).alias("svd")), [float(x) for x in np.sqrt(np.maximum(values[order], 0.0))]


def fuse(blocks: dict[str, DataFrame], key: str, weight: float = 0.25) -> DataFrame:
    """Array blocks joined by key, each times the weight, in one vector."""
    out = None
    for name, df in blocks.items():
        part = df.select(key, F.transform(df.columns[1], lambda x: x * weight).alias(name))
        out = part if out is None else out.join(part, key)
    return out.select(key, array_to_vector(F.concat(*blocks)).alias("features"))


def sigmoids(raw: F.Column) -> F.Column:
    """Margins of one-against-rest classifiers as shares: a sigmoid each, to a sum of one."""
    s = F.transform(raw, lambda x: 1.0 / (1.0 + F.exp(-x)))
    return F.transform(s, lambda x: x / F.aggregate(s, F.lit(0.0), lambda a, b: a + b))


ESTIMATORS: dict[str, Callable[..., Estimator]] = {}


def register_estimator(name: str, make: Callable[..., Estimator]) -> None:
    """Add or replace a classifier; make(seed, **params) gives an estimator over `features`, `label` and `weight`."""
    ESTIMATORS[name] = make


def estimator(name: str, seed: int = 42, **params) -> Estimator:
    """The classifiers by name: logistic, svm, forest, boosting, and those that are registered."""
    if name in ESTIMATORS:
        return ESTIMATORS[name](seed=seed, **params)
    made: dict[str, Callable[[], Estimator]] = {
        "logistic": lambda: LogisticRegression(family="multinomial", maxIter=params.get("maxIter", 20), regParam=params.get("regParam", 0.001), weightCol="weight"),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=params.get("maxIter", 10), regParam=0.001), weightCol="weight"),
        "forest": lambda: RandomForestClassifier(numTrees=params.get("numTrees", 20), maxDepth=params.get("maxDepth", 8), featureSubsetStrategy="sqrt", weightCol="weight", seed=seed),
        "boosting": lambda: OneVsRest(classifier=GBTClassifier(maxIter=params.get("maxIter", 5), maxDepth=3, seed=seed), weightCol="weight"),
    }
    return made[name]()


@dataclass
class Classifier:
    """A named classifier with its feature set, fitting time and predictions."""

    name: str
    feature_set: str = ""
    params: dict = field(default_factory=dict)
    model: Model | None = None
    calibration: Model | None = None
    train_seconds: float = 0.0

    def fit(self, train: DataFrame) -> Classifier:
        start = time.time()
        self.model = estimator(self.name, **self.params).fit(class_weights(train))
        self.train_seconds = time.time() - start
        return self

    def calibrate(self, held_out: DataFrame) -> Classifier:
        """A logistic model over the margins of rows that the classifier has not seen: its shares become probabilities."""
        margins = self.model.transform(held_out).select("label", F.col("rawPrediction").alias("margins"))
        self.calibration = LogisticRegression(featuresCol="margins", family="multinomial", maxIter=30, probabilityCol="probability", rawPredictionCol="_raw", predictionCol="_prediction").fit(margins)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """With `probability`, whatever the classifier: calibrated if it is, else shares of sigmoids of its margins."""
        out = self.model.transform(df)
        if self.calibration is not None:
            out = self.calibration.transform(out.drop("probability").withColumn("margins", F.col("rawPrediction"))).drop("margins", "_raw", "prediction").withColumnRenamed("_prediction", "prediction")
        if "probability" not in out.columns:
            out = out.withColumn("probability", array_to_vector(sigmoids(vector_to_array("rawPrediction"))))
        return out

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def accuracy(predictions: DataFrame, metric: str = "accuracy") -> float:
    return MulticlassClassificationEvaluator(metricName=metric).evaluate(predictions)


def stacked(train: DataFrame, test: DataFrame, bases: list[str], folds: int = 3, fold: str = "fold", key: str = "record_id") -> tuple[DataFrame, Model]:
    """Out-of-fold probabilities of the bases as inputs of a logistic model; train has a fold column."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, vector_to_array("probability").alias(name))

    inner = None
    outer = None
    for b in bases:
        oof = None
        for k in range(folds):
            m = Classifier(b).fit(train.where(F.col(fold) % folds != k))
            part = shares(m.predict(train.where(F.col(fold) % folds == k)), b)
            oof = part if oof is None else oof.unionByName(part)
        last = shares(Classifier(b).fit(train).predict(test), b)
        inner = oof if inner is None else inner.join(oof, key)
        outer = last if outer is None else outer.join(last, key)
    vec = array_to_vector(F.concat(*bases))
    meta_train = inner.select(key, vec.alias("features")).join(train.select(key, "label"), key)
    model = Classifier("logistic").fit(meta_train)
    return model.predict(outer.select(key, vec.alias("features")).join(test.select(key, "label"), key)), model.model


def optimise(objective: Callable[[dict[str, float]], float], space: dict[str, tuple[float, float]], trials: int = 10, seed: int = 42) -> tuple[dict[str, float], float]:
    """The best of an objective's values over log-uniform points of a space, the later half around the best one so far."""
    rng, best = random.Random(seed), None
    for k in range(trials):
        if best is None or k < trials // 2:
            point = {n: 10 ** rng.uniform(a, b) for n, (a, b) in space.items()}
        else:
            point = {n: 10 ** min(b, max(a, rng.gauss(np.log10(best[0][n]), (b - a) / 8))) for n, (a, b) in space.items()}
        value = objective(point)
        if best is None or value > best[1]:
            best = (point, value)
    return best


def tune(train: DataFrame, regs: tuple[float, ...] = (0.001, 0.1), folds: int = 2) -> list[tuple[float, float]]:
    """A grid over the regularisation of the logistic model, by folds; best first."""
    lr = LogisticRegression(maxIter=10)
    cv = CrossValidator(estimator=lr, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(regs)).build(), evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, parallelism=2, seed=42).fit(train)
    return sorted(zip(regs, cv.avgMetrics), key=lambda x: -x[1])


def mahalanobis(df: DataFrame, key: str, column: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """Squared distances from the mean under the covariance of `fitted_on`, and whether they are beyond its 95th percentile."""
    known = fitted_on or df
    n, total, outer = moments(known, column)
    mean = total / max(1, n)
    cov = (outer - n * np.outer(mean, mean)) / max(1, n - 1)
    chol = np.linalg.cholesky(np.linalg.pinv(cov) + 1e-9 * np.eye(len(mean)))

    def distances(rows: DataFrame) -> DataFrame:
        centred = rows.select(key, F.zip_with(column, F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a.cast("double") - b).alias("c"))
        return centred.select(key, F.aggregate(dots("c", chol), F.lit(0.0), lambda a, x: a + x * x).alias("distance"))

    limit = distances(known).agg(F.percentile_approx("distance", 0.95, 10000)).collect()[0][0]
    d = distances(df)
    return d.withColumn("is_unknown", F.col("distance") > F.lit(limit))


def scaled_by_max(train: DataFrame, df: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """Each feature over its largest absolute value in the train rows."""
    return MaxAbsScaler(inputCol=column, outputCol=out).fit(train).transform(df)


def random_search(train: DataFrame, test: DataFrame, space: dict[str, tuple[float, float]], trials: int = 4, seed: int = 42) -> list[dict]:
    """Logistic models at random points of the space (log-uniform), the best F1 first."""
    rng, out = random.Random(seed), []
    for _ in range(trials):
        params = {k: 10 ** rng.uniform(a, b) for k, (a, b) in space.items()}
        c = Classifier("logistic", params={"regParam": params.get("regParam", 0.001), "maxIter": 10}).fit(train)
        out.append(params | {"f1": accuracy(c.predict(test), "f1"), "train_seconds": c.train_seconds})
    return sorted(out, key=lambda r: -r["f1"])


def save_matrix(df: DataFrame, path: str, key: str, features: str, label: str | None = None) -> None:
    """Feature vectors (sparse or dense) with their keys and labels."""
    df.select(key, features, *([label] if label else [])).write.mode("overwrite").parquet(path)


def load_classifier(path: str, name: str = "", feature_set: str = "") -> Classifier:
    from pyspark.ml.util import DefaultParamsReader

    return Classifier(name, feature_set, model=DefaultParamsReader.loadParamsInstance(path, None))


def embed(df: DataFrame, key: str, text: str, hook: str = "embedding") -> DataFrame:
    """Vectors by the registered hook, of length one."""
    from tidemill.functions import python as P

    rows = df.select(key, P.hook(hook, F.coalesce(F.col(text), F.lit(""))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.withColumn("n", norm).select(key, F.when(F.col("n") > 0, F.transform("v", lambda x: (x / F.col("n")).cast("float"))).otherwise(F.col("v")).alias("embedding"))
