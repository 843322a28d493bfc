"""Windows, quotas, quality, evaluation, generation, sources, streams, models."""

import os

import pytest
from pyspark.sql import functions as F

from tidemill.functions import python as P
from tidemill.functions import text as T
from tidemill.operators import evaluation as E
from tidemill.operators import generation as G
from tidemill.operators import quality as Q
from tidemill.operators import stats
from tidemill.operators import tfidf as X
from tidemill.operators import windows as W
from tidemill.sources import io
from tidemill.streaming import streams


def doc(spark, *sizes):
    return spark.createDataFrame([(i, [f"w{k}" for k in range(n)]) for i, n in enumerate(sizes)], "i int, w array<string>")


def test_token_windows(spark):
    rows = W.token_windows(doc(spark, 300, 299), "w").collect()
    by = {}
    for r in rows:
        by.setdefault(r["window_length"], []).append(r["start"])
    assert {k: sorted(v) for k, v in by.items()} == {64: list(range(0, 225, 32)), 128: [0, 96], 256: [0]}
    assert all(r["i"] == 0 for r in rows)


def test_chunks(spark):
    rows = W.chunks(doc(spark, 250, 400, 524, 525, 0), "w").collect()
    by = {}
    for r in rows:
        by.setdefault(r["i"], []).append((r["start"], r["chunk_words"]))
    assert {k: sorted(v) for k, v in by.items()} == {0: [(0, 250)], 1: [(0, 250), (200, 200)], 2: [(0, 250), (200, 250)], 3: [(0, 250), (200, 250), (400, 125)]}


@pytest.mark.parametrize("sizes,target,expected", [([5, 10, 100], 50, [3, 4, 43]), ([3, 3, 3], 7, [3, 2, 2]), ([1, 1000], 500, [1, 499]), ([2, 2], 9, [2, 2])])
def test_proportional_quotas(sizes, target, expected):
    assert W.proportional_quotas(sizes, target) == expected


def test_sequential_targets():
    assert W.sequential_targets([10, 100, 100], 90) == [10, 40, 40]


def test_positions_match_a_window(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("g"))
    rows = W.positions(df, ["g"], W.seeded(1, "id")).collect()
    for g in "012":
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine))) and {r["stratum_size"] for r in mine} == {len(mine)}


def test_split_is_stratified_and_whole(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("usual").alias("g"))
    s = W.stratified_split(df, "id", "g", {"train": 0.7, "validation": 0.15, "test": 0.15})
    counts = {(r["g"], r["split"]): r["count"] for r in s.groupBy("g", "split").count().collect()}
    assert counts == {("rare", "train"): 140, ("rare", "validation"): 30, ("rare", "test"): 30, ("usual", "train"): 1260, ("usual", "validation"): 270, ("usual", "test"): 270}


def test_quality_order(spark):
    long = "word " * 40
    rows = [(1, " ", "en"), (2, "x" * 148 + "�", "en"), (3, "y" * 6001, "en"), (4, long + "�", "en"), (5, long, "de"), (6, long, "en"), (7, "  " + long.upper(), "en"), (8, None, "en"), (9, "z" * 200, None)]
    df = spark.createDataFrame(rows, "i int, t string, l string")
    out = Q.checked(df, Q.quality_reason(F.col("t"), F.col("l"), F.lit(1.0)), T.fingerprint_key(T.text("t")), ["i"])
    assert {r["i"]: r["reject_reason"] for r in out.collect()} == {1: "empty", 2: "too_short", 3: "too_long", 4: "invalid_unicode", 5: "language_mismatch", 6: None, 7: "duplicate", 8: "empty", 9: "language_mismatch"}


def test_validation_reasons(spark):
    df = spark.createDataFrame([(1, None), (2, "   "), (3, "four"), (4, "x" * 10001), (5, "fine text")], "i int, t string")
    kept, removed = Q.validate(df, "t")
    assert [r["i"] for r in kept.collect()] == [5]
    assert {r["i"]: r["reason"] for r in removed.collect()} == {1: "Missing/empty text content", 2: "Missing/empty text content", 3: "Length below min threshold (4 < 5)", 4: "Length exceeds max threshold (10001 > 10000)"}


def test_imbalance(spark):
    df = spark.createDataFrame([(c,) for c, n in (("a", 1256), ("b", 1000), ("c", 984)) for _ in range(n)], "y string")
    assert stats.imbalance(df, "y").collect()[0][0] == 1.2764
    assert stats.imbalance(df.limit(0), "y").collect()[0][0] == 0.0


def test_class_metrics_by_hand(spark):
    counts = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("b", "c", 2)], "y string, p string, n bigint")
    rows = {r["label"]: r for r in E.class_metrics(counts, "y", "p").collect()}
    assert rows["a"]["precision"] == 1.0 and rows["a"]["recall"] == 0.75
    assert rows["c"]["precision"] == 0.0 and rows["c"]["support"] == 0
    assert rows["accuracy"]["f1"] == 0.625


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("b", 0.5), ("b", 0.1)], "y string, s double")
    rows = {r["label"]: r["auc"] for r in E.auc(E.scores(df, "y", {"a": F.col("s")})).collect()}
    assert rows["a"] == 0.875


def test_minmax_constant(spark):
    assert [r[0] for r in spark.createDataFrame([(5.0,), (5.0,)], "x double").select(E.minmax(F.col("x"))).collect()] == [1.0, 1.0]


def test_prompts(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    got = [df.select(G.prompt(F.col("t"), m)).collect()[0][0] for m in ("raw", "completion", "chat", "unknown")]
    assert got == ["abc", "abc", "Instruction: Continue the following text naturally.\nText: abc\nCompletion:", "abc"]
    chat = df.select(G.prompt(F.col("t"), "Chat", {"chat": "<user>{message}<assistant>"})).collect()[0][0]
    assert chat.startswith("<user>Continue writing") and chat.endswith(":\n\nabc<assistant>")


def test_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    p = io.mock_prefixes(spark)
    assert G.run_resumable(p, path, most=10) == 10
    assert G.run_resumable(p, path, most=12) == 12
    assert spark.read.parquet(path).select("prefix_id").distinct().count() == 12


def test_failed_batches_stay_pending(spark, tmp_path, caplog):
    old, path = P.HOOKS["generate"], str(tmp_path / "out")

    def broken(s):
        raise RuntimeError("no model")

    try:
        P.register("generate", broken)
        assert G.run_resumable(io.mock_prefixes(spark), path) == 0
        assert "15 prompts failed, one of them with RuntimeError: no model" in caplog.text
    finally:
        P.register("generate", old)
    assert G.run_resumable(io.mock_prefixes(spark), path) == 15


def test_polymorphic_text(spark):
    records = ['{"text": "a"}', '{"text": "", "body": "b"}', '{"text": ["x", "y"]}', '{"content": [{"text": "p"}, {"body": "q"}]}', '{"article": {"text": "in"}}', "{}", '{"text": "[ ] item"}']
    df = spark.createDataFrame([(r,) for r in records], "r string")
    assert [x[0] for x in df.select(io.first_text(F.col("r"))).collect()] == ["a", "b", "x\n\ny", "p\n\nq", "in", None, "[ ] item"]


def test_folders(spark, tmp_path):
    for name in ("m2", "m1"):
        io.mock_prefixes(spark, 3).withColumn("generated_text", F.lit("same")).write.parquet(str(tmp_path / name / "generated.parquet"))
    os.makedirs(tmp_path / "empty")
    df = io.read_labelled(spark, str(tmp_path))
    assert {r[0]: r[1] for r in df.groupBy("model_label").count().collect()} == {"m1": 3, "m2": 3}
    report = {r["dataset_name"]: r for r in io.validate_folders(spark, str(tmp_path), ["prefix_id", "generated_text", "category"]).collect()}
    assert report["m1"]["is_valid"] and report["m1"]["duplicate_texts"] == 2 and not report["empty"]["is_valid"]
    assert io.validate_folders(spark, str(tmp_path), ["nothing"]).where("is_valid").count() == 0
    assert {r["section"] for r in io.artefacts(spark, str(tmp_path)).collect()} >= {"m1", "m2"}


def test_schema_and_order(spark):
    df = io.mock_prefixes(spark, 2)
    with pytest.raises(ValueError, match="missing columns"):
        io.conform(df, io.GENERATED)
    assert io.reorder(df, ["category"]).columns[0] == "category"


def test_export_survives_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb, c')], "i int, t string")
    io.export(df, str(tmp_path / "x"))
    assert io.read_csv(spark, str(tmp_path / "x/csv"), "i int, t string").collect() == df.collect()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert io.load_config(str(tmp_path / "c.yaml"), {"b": 2}) == {"a": 1, "b": 2}
    (tmp_path / "d.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        io.load_config(str(tmp_path / "d.yaml"))


def test_failed_reads_are_raised(spark, tmp_path):
    """Only a missing output counts as none: one that cannot be read must not be generated or appended again."""
    path = tmp_path / "out"
    path.mkdir()
    (path / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|read"):
        G.run_resumable(io.mock_prefixes(spark), str(path))
    assert io.read_if_there(spark, str(tmp_path / "none"), io.DOCUMENT) is None
    (tmp_path / "empty").mkdir()
    assert io.read_if_there(spark, str(tmp_path / "empty"), io.DOCUMENT).count() == 0


def test_inputs_must_agree(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, t string"), spark.createDataFrame([("x", 1)], "t string, i int")
    io.same_schema({"a": a, "b": b})
    with pytest.raises(ValueError, match="c differ"):
        io.same_schema({"a": a, "c": a.withColumn("i", F.lit("1"))})
    assert io.with_id(a, "i") is a and io.with_id(a).columns == ["id", "i", "t"]


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ["a\r\nb", 'say "no"', "back\\slash", "  blanks  ", "", None, "x,y;z", "\\N", "\n"]
    io.write_csv(spark.createDataFrame(list(enumerate(texts)), "i int, t string").where("t is null or t <> '\\\\N'"), str(tmp_path / "c"))
    got = {r["i"]: r["t"] for r in io.read_csv(spark, str(tmp_path / "c"), "i int, t string").collect()}
    assert got == {i: t for i, t in enumerate(texts) if t != "\\N"}


def test_ngrams(spark):
    df = spark.createDataFrame([("Red  red Blue", )], "t string")
    one = lambda c: df.select(c).collect()[0][0]
    assert one(X.word_ngrams(F.col("t"))) == ["red", "red", "blue", "red red", "red blue"]
    assert one(X.word_ngrams(F.col("t"), (2,), lower=False)) == ["Red red", "red Blue"]
    assert one(X.chars(F.substring("t", 1, 6), (3,))) == ["red", "ed ", "d r"]


def test_moments_and_projections(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from tidemill.operators import models as M

    x = np.random.default_rng(3).normal(size=(60, 4)) @ np.diag([4.0, 2.0, 1.0, 0.5])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, v array<double>").repartition(5)
    n, total, outer = M.moments(df, "v")
    assert n == 60 and np.allclose(total, x.sum(0)) and np.allclose(outer, x.T @ x)
    out, values = M.truncated_svd(df.select("i", array_to_vector("v").alias("v")), "i", "v", 2)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:2])
    assert np.allclose(sum(r["svd"][0] ** 2 for r in out.collect()), values[0] ** 2)
    d = {r["i"]: r for r in M.mahalanobis(df, "i", "v").collect()}
    c = x - x.mean(0)
    assert np.allclose([d[i]["distance"] for i in range(60)], np.einsum("ij,jk,ik->i", c, np.linalg.inv(np.cov(x.T)), c), rtol=1e-4)
    assert sum(r["is_unknown"] for r in d.values()) in (2, 3)


def test_calibration_plug_ins_and_objectives(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.functions import vector_to_array

    from tidemill.operators import models as M

    df = spark.range(240).select(F.col("id").alias("record_id"), (F.col("id") % 3).cast("double").alias("label"), ((F.col("id") % 3) * 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    rows = M.assemble(df, ["a", "b"])
    c = M.Classifier("svm").fit(rows.where("record_id % 2 = 0"))
    plain = c.predict(rows).select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda x, y: x + y).alias("s")).agg(F.min("s"), F.max("s")).collect()[0]
    assert abs(plain[0] - 1) < 1e-6 and abs(plain[1] - 1) < 1e-6
    out = c.calibrate(rows.where("record_id % 4 = 1")).predict(rows)
    assert M.accuracy(out) > 0.9 and "probability" in out.columns
    M.register_estimator("bayes", lambda seed, **params: NaiveBayes(weightCol="weight"))
    assert M.accuracy(M.Classifier("bayes").fit(rows).predict(rows)) > 0.3
    best, value = M.optimise(lambda p: -abs(p["x"] - 0.01), {"x": (-4, 0)}, trials=40)
    assert abs(best["x"] - 0.01) < 0.01 and value <= 0


def test_stream_duplicates_over_runs(spark, tmp_path):
    schema = "i int, t string"
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([(1, "A  b"), (2, "a B "), (3, "c")], [(4, "C"), (5, "d"), (6, None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        s = streams.read_stream(spark, src, spark.createDataFrame([], schema).schema)
        streams.deduplicate_into(s, "t", "i", out, state)
    assert sorted(r[0] for r in spark.read.parquet(out).select("i").collect()) == [1, 3, 5, 6]


def test_models_beat_chance(spark):
    from tidemill.operators import models as M

    df = spark.range(300).select(F.col("id").alias("record_id"), (F.col("id") % 3).cast("double").alias("label"), ((F.col("id") % 3) * 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    rows = M.assemble(df, ["a", "b"]).withColumn("fold", F.col("record_id") % 2)
    train, test = rows.where("record_id % 4 <> 0"), rows.where("record_id % 4 = 0")
    for name in ("logistic", "forest"):
        assert M.accuracy(M.Classifier(name).fit(train).predict(test)) > 0.8
    assert M.accuracy(M.stacked(train, test, ["logistic", "forest"], folds=2)[0]) > 0.8


def test_centred_pca_share(spark):
    from pyspark.ml.functions import array_to_vector

    from tidemill.operators import models as M

    df = spark.range(200).select(array_to_vector(F.array(F.rand(1) * 10, F.rand(2), F.rand(3) * 0.01)).alias("v"))
    _, n = M.pca_share(df, "v", 0.95)
    assert n == 1
    with pytest.raises(ValueError):
        M.pca_share(df, "v", 0.9999999, most=1)


def test_readers_and_sizes(spark, tmp_path):
    a = str(tmp_path / "a")
    io.mock_prefixes(spark, 4).write.parquet(a)
    df, missing = io.read_existing(spark, [a, str(tmp_path / "none"), a], ["prefix_id"])
    assert df.count() == 8 and missing == [str(tmp_path / "none")]
    assert io.first_readable(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: spark.read.parquet(a)).count() == 4
    size = io.stored_size(spark, a).collect()[0]
    assert size["n_files"] >= 1 and size["n_bytes"] > 100
    io.parquet_to_csv(spark, {"p": a}, str(tmp_path / "csv"))
    assert io.read_csv(spark, str(tmp_path / "csv/p")).count() == 4


def test_vectorizer_and_models_are_kept(spark, tmp_path):
    from tidemill.operators import models as M
    from tidemill.operators import tfidf as X

    df = spark.createDataFrame([(1, "red blue"), (2, "red green"), (3, "blue green")], "i int, t string")
    v = X.Vectorizer.fit(df, "i", X.word_terms(T.text("t")), 10)
    v.save(str(tmp_path / "v"))
    new = spark.createDataFrame([(9, "red unseen")], "i int, t string")
    assert [tuple(r) for r in X.Vectorizer.load(spark, str(tmp_path / "v")).transform(new, "i", X.word_terms(T.text("t"))).collect()] == [(9, "red", 1.0)]
    rows = M.assemble(spark.range(60).select("id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 + F.rand(1) / 2).alias("a")), ["a"])
    c = M.Classifier("logistic").fit(rows)
    c.save(str(tmp_path / "m"))
    assert M.accuracy(M.load_classifier(str(tmp_path / "m")).predict(rows)) == 1.0
    assert M.scaled_by_max(rows, rows, "features").count() == 60
    assert M.random_search(rows, rows, {"regParam": (-4, -1)}, trials=2)[0]["f1"] > 0.9
    e = M.embed(spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string"), "i", "t").collect()
    assert abs(sum(x * x for x in e[0]["embedding"]) - 1) < 1e-5 and set(e[1]["embedding"]) == {0.0}
