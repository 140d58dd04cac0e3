"""Training sets, estimators, metrics and tuning on Spark ML.

Splits are by time; folds expand.  Metrics come from grouped counts, so a
prediction table of any size reduces to a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import div, snap
from tidemark.plans.quantile import cumulative, exact_quantiles, sliced
from tidemark.plans.series import Series, positions, with_stats
from tidemark.sources.storage import stage

c = F.col

CLASSIFIERS = {
    "random_forest": lambda seed: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed),
    "gbt": lambda seed: GBTClassifier(maxIter=10, maxDepth=3, seed=seed),
    "logistic": lambda seed: LogisticRegression(maxIter=50, regParam=0.01),
    "linear_svc": lambda seed: LinearSVC(maxIter=30, regParam=0.01),
}
REGRESSORS = {
    "linear": lambda seed: LinearRegression(regParam=0.01),
    "random_forest": lambda seed: RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed),
    "gbt": lambda seed: GBTRegressor(maxIter=10, maxDepth=3, seed=seed),
}


def split_time(df: DataFrame, share: float = 0.8, time: str = "date") -> tuple[DataFrame, DataFrame]:
    """Chronological split at the exact time quantile (a scalar subquery)."""
    days = df.withColumn("_t", F.unix_date(c(time)))
    cut = exact_quantiles(days.withColumn("_k", F.lit(1)), "_t", [share], ["_k"]).select(F.floor(c("q")[0])).scalar()
    marked = days.withColumn("_train", c("_t") <= cut).drop("_t")
    return marked.filter("_train").drop("_train"), marked.filter("NOT _train").drop("_train")


def mark_stratified(df: DataFrame, keys: Sequence[str], label: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``_train``: of each label's rows exactly ``share`` of them, rounded, in the order of a seeded hash.

    Places are counted by ranges of the hash, so a label of most rows is many tasks.
    NULL is a label of its own.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[c(k).cast("string") for k in keys]), 256)
    placed = positions(df.withColumn("_h", digest), Series((label,), ("_h", *keys)), F.substring("_h", 1, 3))
    counted = with_stats(placed, {"_of": F.count(F.lit(1))}, Series((label,), ("_h",)))
    return counted.withColumn("_train", c("_pos") < F.floor(c("_of") * share + 0.5)).drop("_h", "_pos", "_of")


def split_stratified(df: DataFrame, keys: Sequence[str], label: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with the same shares of each label, to the row."""
    marked = stage(mark_stratified(df, keys, label, share, seed), "split")
    return marked.filter("_train").drop("_train"), marked.filter("NOT _train").drop("_train")


def fill_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value for missing categories (ties: the smallest)."""
    for x in columns:
        counts = df.filter(c(x).isNotNull()).groupBy(x).count()
        mode = counts.agg(F.min_by(x, F.struct(-c("count"), c(x)))).scalar()
        df = df.withColumn(x, F.coalesce(c(x), mode))
    return df


def preparation(features: Sequence[str], categories: Sequence[str] = ()) -> list:
    """Mean imputation, label encoding, assembly and standard scaling stages."""
    numeric = [f"{x}_imp" for x in features]
    coded = [f"{x}_idx" for x in categories]
    stages = [Imputer(inputCols=list(features), outputCols=numeric, strategy="mean")]
    if categories:
        stages.append(StringIndexer(
            inputCols=list(categories), outputCols=coded, handleInvalid="keep", stringOrderType="alphabetAsc"
        ))
    stages.append(VectorAssembler(inputCols=numeric + coded, outputCol="raw_features", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return stages


def model_prepare(train: DataFrame, test: DataFrame, features: Sequence[str], categories: Sequence[str] = ()):
    """Statistics are fitted on the training part only."""
    fitted = Pipeline(stages=preparation(features, categories)).fit(train)
    return fitted.transform(train), fitted.transform(test), fitted


def training_set(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, categories: Sequence[str] = (),
    share: float = 0.8, seed: int = 42,
) -> DataFrame:
    """``keys, part, label`` and the prepared features: ready for any estimator.

    A missing label is the most frequent one. Rows are split by label to the row.
    With the statistics of the training part alone, missing features become the
    mean, categories their place in alphabetical order (one further place for those
    unseen or missing), and all are scaled to mean 0 and deviation 1; a constant
    stays at 0.
    """
    whole = stage(mark_stratified(fill_modes(df.select(*dict.fromkeys([*keys, *features, *categories, label])), [label]), keys, label, share, seed), "training")
    train = whole.filter("_train")
    for x in categories:
        seen = train.select(c(x).alias("_value")).filter(c("_value").isNotNull()).distinct()
        codes = seen.withColumn("_code", F.row_number().over(Window.orderBy("_value")) - 1)
        unseen = seen.agg(F.count(F.lit(1))).scalar()
        whole = whole.join(codes, c(x) == c("_value"), "left").withColumn(f"_c_{x}", F.coalesce("_code", unseen).cast("double")).drop("_value", "_code")
    if categories:
        whole = stage(whole, "coded")
    columns = {**{x: c(x).cast("double") for x in features}, **{f"{x}_code": c(f"_c_{x}") for x in categories}}
    n = F.count(F.lit(1))
    moments = whole.filter("_train").agg(F.struct(*[
        F.struct(F.avg(v).alias("m"), F.sqrt(F.var_pop(v) * F.count(v) / n).alias("s")).alias(x) for x, v in columns.items()])).scalar()
    ready = whole.withColumn("_m", moments)
    part = F.when(c("_train"), "train").otherwise("test").alias("part")
    return ready.select(*keys, part, label, *[
        ((F.coalesce(v, c(f"_m.{x}.m")) - c(f"_m.{x}.m")) / F.when(c(f"_m.{x}.s") == 0, 1.0).otherwise(c(f"_m.{x}.s"))).alias(f"x_{x}")
        for x, v in columns.items()])


def model_train(
    train: DataFrame, features: Sequence[str], label: str, name: str = "random_forest", seed: int = 42,
    categories: Sequence[str] = (), regression: bool = False,
) -> PipelineModel:
    registry = REGRESSORS if regression else CLASSIFIERS
    if name not in registry:
        raise ValueError(f"unknown estimator {name}")
    estimator = registry[name](seed).setLabelCol(label).setFeaturesCol("features")
    return Pipeline(stages=[*preparation(features, categories), estimator]).fit(train)


def model_score(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predictions, with the positive class's probability where there is one."""
    out = model.transform(rows)
    score = (
        vector_to_array("probability")[1] if "probability" in out.columns
        else vector_to_array("rawPrediction")[1] if "rawPrediction" in out.columns
        else c("prediction")
    )
    return out.select(*keep, "prediction", score.alias("score"))


def model_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction", score: str | None = "score") -> DataFrame:
    """Accuracy, weighted precision/recall/F1, and for two classes AUC and log loss.

    Counts by (label, prediction) give the first four.  AUC is a rank sum over
    distinct scores, accumulated slice by slice.
    """
    keys = [c(label).cast("double").alias("l"), c(prediction).cast("double").alias("p")]
    if score is not None:
        keys.append(c(score).alias("s"))
    # the only pass over the predictions; everything below reads this grouping
    grouped = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = grouped.groupBy("l", "p").agg(F.sum("n").alias("n"))
    by_label = counts.groupBy(c("l").alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(c("l") == c("p"), c("n")).otherwise(0)).alias("hit"))
    by_pred = counts.groupBy(c("p").alias("k")).agg(F.sum("n").alias("called"))
    per = by_label.join(by_pred, "k", "left").withColumns({
        "precision": F.coalesce(div(c("hit"), c("called")), F.lit(0.0)), "recall": F.coalesce(div(c("hit"), c("support")), F.lit(0.0)),
    })
    per = per.withColumn("f1", F.coalesce(
        div(c("precision") * c("recall") * 2, c("precision") + c("recall")), F.lit(0.0)))
    w = F.sum("support")
    base = per.agg(
        div(F.sum("hit"), w).alias("accuracy"), div(F.sum(c("precision") * c("support")), w).alias("precision"),
        div(F.sum(c("recall") * c("support")), w).alias("recall"), div(F.sum(c("f1") * c("support")), w).alias("f1"),
        w.alias("rows"), F.count(F.lit(1)).alias("classes"),
    )
    if score is None:
        return base
    values = grouped.withColumn("_k", F.lit(1)).groupBy("_k", "s").agg(
        F.sum(c("n") * c("l")).alias("pos"), F.sum(c("n") * (1 - c("l"))).alias("neg"))
    cum = cumulative(values, ["_k"], "s", ["pos", "neg"])
    below = c("neg_upto") - c("neg")
    auc = cum.agg(
        div(F.sum(c("pos") * (below + c("neg") / 2)), F.sum("pos") * F.sum("neg"))
    ).scalar()
    eps = 1e-15
    prob = F.greatest(F.lit(eps), F.least(c("s"), F.lit(1 - eps)))
    entropy = F.when(c("l") == 1, F.log(prob)).otherwise(F.log(1 - prob))
    loss = grouped.agg(-div(F.sum(entropy * c("n")), F.sum("n"))).scalar()
    two = c("classes") == 2
    return base.withColumns({"roc_auc": F.when(two, auc), "log_loss": F.when(two, loss)})


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, e = c(label), c(label) - c(prediction)
    return scored.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        (1 - div(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.count(F.lit(1)).alias("rows"),
    )


def model_regress(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, names: Sequence[str] = tuple(REGRESSORS), seed: int = 42) -> DataFrame:
    parts = []
    for name in names:
        model = model_train(train, features, label, name, seed, regression=True)
        scored = model.transform(test).select(c(label).alias("label"), "prediction")
        parts.append(regression_metrics(scored).withColumn("model", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def model_compare(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, names: Sequence[str] = tuple(CLASSIFIERS), seed: int = 42) -> DataFrame:
    """Leaderboard by accuracy; each estimator's metrics are one row."""
    parts = []
    for name in names:
        model = model_train(train, features, label, name, seed)
        scored = model_score(model, test, [label]).withColumnRenamed(label, "label")
        parts.append(model_metrics(scored, score=None).withColumn("model", F.lit(name)))
    board = reduce(lambda a, b: a.unionByName(b), parts)
    return board.orderBy(c("accuracy").desc(), "model")


def model_importance(model: PipelineModel, features: Sequence[str], rows: DataFrame) -> DataFrame:
    """Tree importances by name, ranked (as many rows as features)."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    pairs = sorted(zip(features, weights), key=lambda x: (-x[1], x[0]))
    spark = rows.sparkSession
    return spark.createDataFrame(
        [(n, float(w), i + 1) for i, (n, w) in enumerate(pairs)], "feature string, importance double, rank int"
    )


def time_folds(df: DataFrame, folds: int = 5, time: str = "date"):
    """Expanding-window folds cut at exact time quantiles."""
    days = df.withColumn("_t", F.unix_date(c(time))).withColumn("_k", F.lit(1))
    probs = [(i + 1) / (folds + 1) for i in range(folds + 1)]
    cuts = exact_quantiles(days, "_t", probs, ["_k"]).first()["q"]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield days.filter(c("_t") <= lo).drop("_t", "_k"), days.filter((c("_t") > lo) & (c("_t") <= hi)).drop("_t", "_k")


def model_tune(df: DataFrame, features: Sequence[str], label: str, grid: Sequence[dict], name: str = "logistic", folds: int = 5, seed: int = 42, most: int | None = None) -> DataFrame:
    """Mean fold accuracy of every setting; a grid of more than ``most`` is refused, not cut."""
    grid = list(grid)
    if most is not None and len(grid) > most:
        raise ValueError(f"{len(grid)} settings, at most {most} allowed")
    parts = []
    for k, (train, test) in enumerate(time_folds(df, folds)):
        fitted = Pipeline(stages=preparation(features)).fit(train)
        a, b = fitted.transform(train).persist(), fitted.transform(test)
        for j, params in enumerate(grid):
            est = CLASSIFIERS[name](seed).setLabelCol(label).setFeaturesCol("features")
            scored = est.copy({est.getParam(p): v for p, v in params.items()}).fit(a).transform(b)
            acc = scored.agg(F.avg((c(label) == c("prediction")).cast("int")).alias("accuracy"))
            parts.append(acc.select(F.lit(j).alias("setting"), F.lit(str(params)).alias("params"), F.lit(k).alias("fold"), "accuracy"))
        a.unpersist()
    allfolds = reduce(lambda x, y: x.unionByName(y), parts)
    return allfolds.groupBy("setting", "params").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("std_accuracy")
    ).orderBy(c("mean_accuracy").desc(), "setting")


def pareto_front(trials: DataFrame, first: str, second: str) -> DataFrame:
    """Trials no other trial beats on both objectives (larger is better).

    The best ``second`` per ``first`` value must exceed that of every better
    ``first``: a running maximum, taken across slices of ``first`` and then
    inside each, so neither pairs nor one global order are needed.
    """
    best = trials.groupBy(first).agg(F.max(second).alias("_best")).filter(c(first).isNotNull())
    rows = sliced(best, [], first)
    higher = Window.orderBy(c("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_slice").agg(F.max("_best").alias("_top")).select(
        "_slice", F.max("_top").over(higher).alias("_above")
    )
    inside = Window.partitionBy("_slice").orderBy(c(first).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.greatest(F.max("_best").over(inside), c("_above"))
    keep = rows.join(tops, "_slice").withColumn("_ahead", ahead).filter(
        c("_ahead").isNull() | (c("_best") > c("_ahead"))
    ).select(first, "_best")
    return trials.join(keep, first).filter(c(second) == c("_best")).drop("_best")
