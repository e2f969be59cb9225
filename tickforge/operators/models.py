"""Model training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tickforge.constants import SEEDS
from tickforge.operators.series import exact_quantiles, ranked_counts
from tickforge.session import checkpointed


def time_chunks(df: DataFrame, n_chunks: int = 6, keys: Sequence[str] = (), bucket_secs: int = 7 * 86400) -> DataFrame:
    """chunk: which of n_chunks equal runs of distinct times a row is in (the rest of a division gets n_chunks)."""
    keys = list(keys)
    us = df.select(*keys, "time").distinct().withColumn("_us", F.unix_micros("time"))
    ranked = ranked_counts(us, keys, "_us", float(bucket_secs * 1_000_000))
    size = F.floor(F.col("total") / n_chunks)
    chunk = F.least(F.floor(F.col("below") / F.greatest(size, F.lit(1))), F.lit(n_chunks)).cast("int")
    ids = ranked.select(*keys, F.timestamp_micros("_us").alias("time"), chunk.alias("chunk"))
    return df.join(ids, [*keys, "time"])


def walk_forward(n_chunks: int = 6) -> list[tuple[int, Column, Column]]:
    """(fold, train rows, test rows) as conditions on chunk: train on all earlier chunks."""
    return [(i, F.col("chunk") < i, F.col("chunk") == i) for i in range(2, n_chunks)]


def inputs(features: Sequence[str]) -> list:
    """Stages that make the vector `_x` of the features; a missing feature counts as 0, in training and in scoring, and no row is left out."""
    filled = ", ".join(f"nanvl(coalesce(cast(`{c}` AS double), 0D), 0D) AS `_f_{c}`" for c in features)
    return [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"), VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_x")]


def booster(label: str = "target", weight: str | None = None, seed: int = 42, max_iter: int = 20, max_depth: int = 5) -> GBTClassifier:
    """Boosted trees over the vector `_x`."""
    options = {"weightCol": weight} if weight else {}
    return GBTClassifier(featuresCol="_x", labelCol=label, seed=seed, maxIter=max_iter, maxDepth=max_depth, subsamplingRate=0.85, featureSubsetStrategy="0.85", **options)


def gbt(features: Sequence[str], label: str = "target", weight: str | None = None, seed: int = 42, max_iter: int = 20, max_depth: int = 5) -> Pipeline:
    """Boosted trees over the features."""
    return Pipeline(stages=[*inputs(features), booster(label, weight, seed, max_iter, max_depth)])


def fit_all(jobs: Sequence[Callable], parallelism: int = 4) -> list:
    """Results of independent fits, some at a time: each is a chain of small Spark jobs that alone leaves a cluster idle."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(job) for job in jobs])


def mean_p(models: Sequence[PipelineModel], df: DataFrame, out: str = "p") -> DataFrame:
    """df with the mean probability of the models, scored side by side on each row."""
    names = [f"_p{i}" for i in range(len(models))]
    for name, model in zip(names, models):
        df = p_win(model, df, name)
    return df.withColumn(out, sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def p_win(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("_x", "rawPrediction", "probability", "prediction", *[c for c in scored.columns if c.startswith("_f_")])


def oof_ensemble(df: DataFrame, features: Sequence[str], key: Sequence[str], label: str = "target", weight: str | None = None,
                 n_chunks: int = 6, seeds: Sequence[int] = tuple(SEEDS), parallelism: int = 4, **options) -> DataFrame:
    """Out-of-fold probabilities: mean over the seeds, walk-forward in time. df has chunk; rows without a label are left out."""
    df = df.where(F.col(label).isNotNull())
    for stage in inputs(features):
        df = stage.transform(df)
    # fits read their rows many times: the vectors are made once, rows carry nothing else
    df = checkpointed(df.select(*dict.fromkeys([*key, label, "chunk", *([weight] if weight else []), "_x"])))
    folds = walk_forward(n_chunks)
    jobs = [lambda t=train, s=seed: booster(label, weight, s, **options).fit(df.filter(t)) for _, train, _ in folds for seed in seeds]
    models = fit_all(jobs, parallelism)
    both = None
    for i, (_, _, test) in enumerate(folds):
        part, names = df.filter(test), [f"_p{k}" for k in range(len(seeds))]
        for name, model in zip(names, models[i * len(seeds):(i + 1) * len(seeds)]):
            part = model.transform(part).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        part = part.withColumn("p", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).select(*key, label, "p")
        both = part if both is None else both.unionByName(part)
    return both


def specialists(df: DataFrame, features: Sequence[str], regimes: Sequence[str], label: str = "target", weight: str | None = None,
                seeds: Sequence[int] = tuple(SEEDS), parallelism: int = 4, **options) -> dict[str, list[PipelineModel]]:
    """One ensemble per regime that has labelled rows of both classes. Each fit is a distributed job over its regime's rows."""
    known = df.where(F.col(label).isNotNull())
    both = {r.regime for r in known.groupBy("regime").agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a < b").collect()}
    todo = [r for r in regimes if r in both]
    jobs = [lambda r=r, s=s: gbt(features, label, weight, s, **options).fit(known.filter(F.col("regime") == r)) for r in todo for s in seeds]
    models = fit_all(jobs, parallelism)
    return {r: models[i * len(seeds):(i + 1) * len(seeds)] for i, r in enumerate(todo)}


def specialist_oof(df: DataFrame, features: Sequence[str], regimes: Sequence[str], key: Sequence[str], label: str = "target", weight: str | None = None,
                   share: float = 0.9, min_train: int = 20_000, min_test: int = 5_000, **options) -> DataFrame:
    """Out-of-fold probabilities of the specialists: fitted on the earliest `share` of their regime's rows, scored on the rest.

    Regimes with at most min_train rows before the cut or min_test after it have none. Rows (regime, key, label, p).
    """
    rows = df.where(F.col(label).isNotNull() & F.col("regime").isin(list(regimes))).withColumn("_us", F.unix_micros("time"))
    cuts = exact_quantiles(rows, ["regime"], "_us", [share], 7 * 86400e6, "_cut").select("regime", F.get("_cut", F.lit(0)).alias("_at"))
    rows = checkpointed(rows.join(cuts, "regime").withColumn("_late", F.col("_us") >= F.col("_at")))
    sizes = {r.regime: r for r in rows.groupBy("regime").agg(F.count_if(~F.col("_late")).alias("a"), F.count_if("_late").alias("b")).collect()}
    able = [r for r in regimes if r in sizes and sizes[r].a > min_train and sizes[r].b > min_test]
    models = specialists(rows.where("not _late"), features, able, label, weight, **options)
    return routed_scoring(rows.where(F.col("_late") & F.col("regime").isin(list(models) or [""])), models, ["regime", *key, label])


def routed_scoring(df: DataFrame, models: dict[str, list[PipelineModel]], key: Sequence[str], default: float = 0.5) -> DataFrame:
    """Rows scored by their regime's ensemble; a regime without models gets the default."""
    both = df.filter(~F.col("regime").isin(list(models) or [""]) | F.col("regime").isNull()).select(*key, F.lit(default).alias("p"))
    for regime, ensemble in models.items():
        both = both.unionByName(mean_p(ensemble, df.filter(F.col("regime") == regime)).select(*key, "p"))
    return both


class ContinuedGBT:
    """A saved boosted ensemble and the trees fitted after it on its margins."""

    def __init__(self, base: PipelineModel, trees: Sequence[DecisionTreeRegressionModel] = (), step: float = 0.1):
        self.base, self.trees, self.step = base, list(trees), step

    def margins(self, df: DataFrame) -> DataFrame:
        """df with the vector `_x` and the margin `_m`, half the log odds."""
        out = self.base.transform(df).withColumn("_m", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")
        for tree in self.trees:
            out = tree.transform(out).withColumn("_m", F.col("_m") + self.step * F.col("prediction")).drop("prediction")
        return out

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        scored = self.margins(df).withColumn(out, 1.0 / (1.0 + F.exp(-2.0 * F.col("_m"))))
        return scored.select(*df.columns, out)

    def save(self, path: str) -> None:
        """Writes the parts; the file that names them comes last."""
        self.base.write().overwrite().save(f"{path}/base")
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree{i}")
        SparkSession.active().createDataFrame([(len(self.trees), self.step)], "trees int, step double").coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")

    @classmethod
    def load(cls, path: str) -> "ContinuedGBT":
        parts = SparkSession.active().read.parquet(f"{path}/parts").first()
        return cls(PipelineModel.load(f"{path}/base"), [DecisionTreeRegressionModel.load(f"{path}/tree{i}") for i in range(parts.trees)], parts.step)


def warm_start(model: PipelineModel | ContinuedGBT, df: DataFrame, features: Sequence[str], label: str = "target", weight: str | None = None,
               rounds: int = 20, max_depth: int = 5, seed: int = 42, lineage: int = 5) -> ContinuedGBT:
    """Boosting continued on the rows of df from a saved ensemble, whose trees stay as they are.

    Each round fits a regression tree to the gradient of the logistic loss at the present margins, as the first trees were.
    A model of other features cannot be continued: the result is then a new ensemble, fitted on df alone.
    """
    own = model if isinstance(model, ContinuedGBT) else ContinuedGBT(model)
    known = df.where(F.col(label).isNotNull())
    inputs = own.base.stages[-2].getInputCols()
    if inputs != [f"_f_{c}" for c in features]:
        return ContinuedGBT(gbt(features, label, weight, seed, rounds, max_depth).fit(known))
    keep = ["_x", "_y", "_m", *([weight] if weight else [])]
    rows = checkpointed(own.margins(known).withColumn("_y", 2.0 * F.col(label) - 1.0).select(*keep))
    trees, options = [], {"weightCol": weight} if weight else {}
    for i in range(rounds):
        graded = rows.withColumn("_r", 4.0 * F.col("_y") / (1.0 + F.exp(2.0 * F.col("_y") * F.col("_m"))))
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_r", maxDepth=max_depth, seed=seed + i, **options).fit(graded)
        rows = tree.transform(rows).withColumn("_m", F.col("_m") + own.step * F.col("prediction")).select(*keep)
        if i % lineage == lineage - 1:
            rows = checkpointed(rows)
        trees.append(tree)
    return ContinuedGBT(own.base, [*own.trees, *trees], own.step)


def log_loss(df: DataFrame, p: str = "p", y: str = "target") -> DataFrame:
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-12)), F.lit(1e-12))
    return df.agg(F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("loss"), F.count(F.lit(1)).alias("n"))


def direction_gates(metrics: DataFrame) -> DataFrame:
    """Adds deploy: whether an evaluated direction model beats noise, and the majority on price, well enough to replace the old one."""
    price = F.col("acc_price") > F.greatest("base_up", 1 - F.col("base_up")) + 0.02
    return metrics.withColumns({"gate_acc": F.coalesce(F.col("acc") > 0.53, F.lit(False)), "gate_price": F.coalesce(price, F.lit(False))}).withColumn(
        "deploy", F.col("gate_acc") & F.col("gate_price"))


def base_rate_gate(df: DataFrame, label: str, low: float = 0.05, high: float = 0.60) -> DataFrame:
    """One row: n, base_rate, informative."""
    return df.agg(F.count(label).alias("n"), F.avg(label).alias("base_rate")).withColumn(
        "informative", F.coalesce((F.col("base_rate") >= low) & (F.col("base_rate") <= high), F.lit(False)))


def big_move_model(rows: DataFrame, features: Sequence[str], label: str = "regime_label", side: str = "regime_dir", weight: str | None = None,
                   seeds: Sequence[int] = tuple(SEEDS), min_auc: float = 0.60, min_moves: int = 500, **options) -> tuple[DataFrame, dict[str, list[PipelineModel]]]:
    """(metrics, models): a model of large moves tested on the last fifth of the times, and a head for their direction.

    rows has chunk (time_chunks with 5). Nothing is fitted where the base rate says too little; the move ensemble is handed out only above
    min_auc, the head only where the test rows hold more than min_moves moves. Metrics are one row; unknown ones are null.
    """
    rows = checkpointed(rows.where(F.col(label).isNotNull()))
    train, test = rows.where("chunk < 4"), rows.where("chunk >= 4")
    gate = base_rate_gate(rows, label).first()
    out = {"n": gate.n, "base_rate": gate.base_rate, "informative": gate.informative, "acc": None, "auc": None, "moves": 0, "dir_acc": None, "passed": False}
    models: dict[str, list[PipelineModel]] = {}
    if gate.informative:
        jobs = [lambda s=s: gbt(features, label, weight, s, **options).fit(train) for s in seeds]
        moved = train.where(F.col(label) == 1)
        sides = moved.agg(F.min(side).alias("a"), F.max(side).alias("b")).first()
        heads = [lambda s=s: gbt(features, side, weight, s, **options).fit(moved) for s in seeds] if sides.a is not None and sides.a < sides.b else []
        fitted = fit_all([*jobs, *heads])
        scored = checkpointed(mean_p(fitted[:len(seeds)], test))
        out["acc"] = eval_metrics(scored, "p", label).first().acc
        out["auc"] = auc(scored, "p", label).first().auc
        out["passed"] = out["auc"] is not None and out["auc"] > min_auc
        real = test.where(F.col(label) == 1)
        out["moves"] = real.count()
        if heads and out["moves"] > min_moves:
            out["dir_acc"] = eval_metrics(mean_p(fitted[len(seeds):], real), "p", side).first().acc
            models["direction"] = fitted[len(seeds):]
        if out["passed"]:
            models["move"] = fitted[:len(seeds)]
    schema = "n bigint, base_rate double, informative boolean, acc double, auc double, moves bigint, dir_acc double, passed boolean"
    return rows.sparkSession.createDataFrame([tuple(out.values())], schema), models


def eval_metrics(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Accuracy, and how often calls up and calls down are right."""
    up, yy = F.col(p) >= 0.5, F.col(y)
    return df.agg(
        F.avg((up.cast("int") == yy.cast("int")).cast("double")).alias("acc"), F.avg(F.when(up, yy)).alias("p_up"),
        F.avg(F.when(~up, 1 - yy)).alias("p_dn"), F.count(F.lit(1)).alias("n"))


def price_metrics(df: DataFrame, p: str = "p", fwd: str = "fwd_return") -> DataFrame:
    """Does P(up) call the price direction, against always betting the majority?"""
    rose = F.col(fwd) > 0
    known = df.filter(F.col(fwd).isNotNull())
    out = known.agg(F.avg(((F.col(p) >= 0.5) == rose).cast("double")).alias("acc_price"), F.avg(rose.cast("double")).alias("base_up"))
    return out.withColumn("majority", F.greatest(F.col("base_up"), 1 - F.col("base_up")))


def auc(df: DataFrame, p: str = "p", y: str = "y", width: float = 1e-3) -> DataFrame:
    """Rank-sum AUC with average ties; equal scores are merged before ranking."""
    ranked = ranked_counts(df.filter(F.col(y).isNotNull()), [], p, width, {"pos": F.count_if(F.col(y) == 1)})
    mean_rank = F.col("below") + (F.col("n") + 1) / 2.0
    sums = ranked.agg(F.sum(mean_rank * F.col("pos")).alias("r"), F.sum("pos").alias("n1"), F.sum(F.col("n") - F.col("pos")).alias("n0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return sums.select(F.try_divide(F.col("r") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"), "n1", "n0")
