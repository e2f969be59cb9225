"""Continued boosting, gates and stored artifacts; small settings."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tickforge.operators import models as M
from tickforge.sources.artifacts import Artifacts

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """A target that depends on a and, in later rows, on b; some features are missing."""
    r = spark.range(4000).select(
        "id", F.timestamp_seconds(F.col("id") * 3600).alias("time"), F.rand(1).alias("a"), F.rand(2).alias("b"),
        F.when(F.col("id") % 7 > 0, F.rand(3)).alias("c"), F.when(F.col("id") % 2 == 0, "UP").otherwise("DOWN").alias("regime"))
    late = F.col("id") >= 2000
    return r.withColumn("target", (F.col("a") + F.when(late, F.col("b") * 2).otherwise(0) > F.when(late, 1.5).otherwise(0.5)).cast("double")).cache()


def test_warm_start_keeps_the_saved_trees(spark, rows, tmp_path):
    base = M.gbt(X, max_iter=3, max_depth=3).fit(rows.where("id < 2000"))
    late = rows.where("id >= 2000")
    more = M.warm_start(base, late, X, rounds=6, max_depth=3, lineage=2)
    assert len(more.trees) == 6 and [t.toDebugString for t in more.base.stages[-1].trees] == [t.toDebugString for t in base.stages[-1].trees]
    old = M.p_win(base, late).select("id", F.col("p").alias("p0"))
    # no added tree: the saved model's own probabilities
    assert M.ContinuedGBT(base).score(late).join(old, "id").where("abs(p - p0) > 1e-9").count() == 0
    losses = [M.log_loss(M.ContinuedGBT(base, more.trees[:k]).score(late)).first().loss for k in (0, 2, 4, 6)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.9 * losses[0]
    more.save(str(tmp_path / "m"))
    again = M.ContinuedGBT.load(str(tmp_path / "m"))
    both = again.score(late).select("id", F.col("p").alias("p0")).join(more.score(late), "id")
    assert both.where("abs(p - p0) > 1e-12").count() == 0
    further = M.warm_start(again, late, X, rounds=1, max_depth=3)
    assert len(further.trees) == 7 and M.log_loss(further.score(late)).first().loss < losses[-1]
    other = M.warm_start(base, late, ["a", "b"], rounds=2, max_depth=2)
    assert other.trees == [] and other.base is not base


def test_specialists_and_oof(rows):
    oof = M.specialist_oof(rows, X, ["UP", "DOWN", "FLAT"], ["id"], min_train=1000, min_test=100, max_iter=2, max_depth=3, seeds=[1, 2])
    got = oof.groupBy("regime").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.regime for r in got} == {"UP", "DOWN"} and all(190 <= r.n <= 210 and r.lo >= 3590 for r in got)
    assert M.specialist_oof(rows, X, ["UP"], ["id"], min_train=5000, max_iter=1).count() == 0
    scored = M.oof_ensemble(M.time_chunks(rows, 6), X, ["id"], seeds=[1], max_iter=2, max_depth=3)
    assert scored.count() == scored.select("id").distinct().count() and scored.agg(F.min("id")).first()[0] == 1332


def test_oof_reads_its_features_once(spark, rows):
    """As the mean of pipelines fitted fold by fold; the features are computed once, not once a pass of a fit."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double", useArrow=False)
    def counted(x):
        seen.add(1)
        return x

    chunked = M.time_chunks(rows, 4).checkpoint()
    options = {"max_iter": 2, "max_depth": 3}
    got = M.oof_ensemble(chunked.withColumn("a", counted("a")), X, ["id"], n_chunks=4, seeds=[1, 2], **options).select("id", "p").collect()
    assert seen.value == chunked.count()
    want = {}
    for _, train, test in M.walk_forward(4):
        models = [M.gbt(X, seed=s, **options).fit(chunked.filter(train)) for s in (1, 2)]
        want |= {r.id: r.p for r in M.mean_p(models, chunked.filter(test)).select("id", "p").collect()}
    assert len(got) == len(want) and all(abs(want[r.id] - r.p) < 1e-9 for r in got)


def test_gates(spark, rows):
    moves = M.time_chunks(rows.withColumn("regime_label", (F.col("a") > 0.7).cast("int")).withColumn("regime_dir", F.col("target")), 5)
    metrics, models = M.big_move_model(moves, X, seeds=[1, 2], min_moves=50, max_iter=2, max_depth=3)
    m = metrics.first()
    assert m.informative and m.passed and m.auc > 0.9 and m.dir_acc > 0.5 and set(models) == {"move", "direction"} and m.n == 4000
    metrics, models = M.big_move_model(moves.withColumn("regime_label", F.lit(1)), X)
    assert not metrics.first().informative and metrics.first().auc is None and models == {}
    noise = M.big_move_model(moves.withColumn("regime_label", (F.rand(9) > 0.7).cast("int")), X, seeds=[1], min_moves=10**6, max_iter=1)
    assert not noise[0].first().passed and noise[1] == {}
    gate = M.direction_gates(spark.createDataFrame([(0.6, 0.6, 0.5), (0.6, 0.51, 0.5), (0.5, 0.9, 0.5), (None, 0.9, 0.5)], "acc double, acc_price double, base_up double"))
    assert [r.deploy for r in gate.collect()] == [True, False, False, False]


def test_artifacts(spark, rows, tmp_path):
    store = Artifacts(spark, str(tmp_path / "store"))
    assert store.current("curves") is None
    first = store.save_table("curves", spark.createDataFrame([(1.0,)], "x double"))
    second = store.save_table("curves", spark.createDataFrame([(2.0,)], "x double"))
    assert store.table("curves").first().x == 2.0 and store.versions("curves") == [first, second]
    store.roll_back("curves", first)
    assert store.table("curves").first().x == 1.0 and store.current("curves") == first
    with pytest.raises(Exception):  # a version whose parts fail to be written is never named
        store.save_table("curves", spark.createDataFrame([(3.0,)], "x double").select(F.raise_error(F.lit("torn")).alias("x")))
    assert store.table("curves").first().x == 1.0 and store.versions("curves") == [first, second]
    model = M.gbt(X, max_iter=1, max_depth=2).fit(rows)
    store.save_model("gbt", model)
    assert M.p_win(store.model("gbt", PipelineModel.load), rows).count() == 4000
    store.save_value("weights", {"p": 0.5, "names": ["a"]})
    assert store.value("weights") == {"p": 0.5, "names": ["a"]}
    with pytest.raises(KeyError):
        store.roll_back("weights", "no such version")
