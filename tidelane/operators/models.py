"""Models on prediction frames (symbol, h, y and feature columns) with Spark ML, and chronological evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators import ensembles

KINDS = ("ridge", "random_forest", "boosted")
#: 300 trees or rounds each; a forest's trees are as deep as Spark ML allows.
ESTIMATORS = {
    "ridge": lambda regParam=0.1: LinearRegression(labelCol="y", featuresCol="x", elasticNetParam=0.0, regParam=regParam),
    "random_forest": lambda: RandomForestRegressor(labelCol="y", featuresCol="x", numTrees=300, maxDepth=30, featureSubsetStrategy="0.3", seed=1),
    "boosted": lambda maxDepth=4: GBTRegressor(labelCol="y", featuresCol="x", maxIter=300, maxDepth=maxDepth, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=1),
}
#: Choices made on validation rows only. ``alpha`` weighs the sum of squares, so Spark's ``regParam`` is alpha by the number of rows.
GRIDS = {"ridge": [{"alpha": 1.0}, {"alpha": 10.0}, {"alpha": 100.0}], "random_forest": [{}], "boosted": [{"maxDepth": 3}, {"maxDepth": 5}]}
#: Fits that run at a time; each is a chain of small jobs.
AT_ONCE = 8
#: Rows up to which each ensemble of trees is grown inside one task, all of a query's side by side; larger tables are fitted by Spark ML.
IN_TASK = 1_000_000


def pipeline(kind: str, columns: list[str], **params) -> Pipeline:
    """Median imputation and scaling fitted on the training rows, then the estimator."""
    filled = [f"{c}_" for c in columns]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), ESTIMATORS[kind](**params)])


def fit(kind: str, columns: list[str], rows: DataFrame, params: dict):
    """The pipeline fitted with one entry of ``GRIDS``."""
    given = {"regParam": params["alpha"] / rows.count()} if "alpha" in params else params
    return pipeline(kind, columns, **given).fit(rows)


def _at_once(work, jobs: list) -> list:
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(work, jobs, chunksize=1)


@dataclass
class Job:
    """A fit of one entry of ``GRIDS`` on the rows ``train``, and the rows ``test`` (others than those) to score."""

    kind: str
    params: dict
    columns: list[str]
    train: Column
    test: Column


def scores(table: DataFrame, jobs: list[Job]) -> DataFrame:
    """job (its place), symbol, h, y and prediction of each job's test rows."""
    shown = ["job", "symbol", "h", "y", "prediction"]
    inside = [i for i, j in enumerate(jobs) if j.kind != "ridge"] if table.count() <= IN_TASK else []

    def apart(i: int) -> DataFrame:
        j = jobs[i]
        return fit(j.kind, j.columns, table.where(j.train), j.params).transform(table.where(j.test)).select(F.lit(i).alias("job"), *shown[1:])

    parts = _at_once(apart, [i for i in range(len(jobs)) if i not in inside])
    if inside:
        plans = {i: (ensembles.plan(ESTIMATORS[jobs[i].kind](**jobs[i].params)), jobs[i].columns) for i in inside}
        columns = sorted({c for i in inside for c in jobs[i].columns})

        def grown(pdf: pd.DataFrame) -> pd.DataFrame:
            plan, own = plans[int(pdf["job"].iloc[0])]
            pdf = pdf.sort_values(["symbol", "h", "y", *columns])
            train, test = pdf[~pdf["scored"]], pdf[pdf["scored"]]
            if len(train) and len(test):
                told = ensembles.predict(plan, train[own].to_numpy(float), train["y"].to_numpy(float), test[own].to_numpy(float))
            else:
                told = [float("nan")] * len(test)
            return test[["job", "symbol", "h", "y"]].assign(prediction=told)

        roles = [F.when(jobs[i].train, F.struct(F.lit(i).alias("job"), F.lit(False).alias("scored"))).when(jobs[i].test, F.struct(F.lit(i).alias("job"), F.lit(True).alias("scored"))) for i in inside]
        dealt = table.withColumn("role", F.explode(F.array_compact(F.array(*roles)))).select("role.*", "symbol", "h", "y", *columns)
        kinds = {f.name: f.dataType.simpleString() for f in table.schema}
        parts.append(dealt.repartitionByRange(len(inside), "job").groupBy("job").applyInPandas(grown, f"job int, symbol {kinds['symbol']}, h {kinds['h']}, y double, prediction double"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.persist()


def errors(scored: DataFrame, *by: str) -> dict:
    """(job, by): (rows, root mean squared error)."""
    found = scored.groupBy("job", *by).agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("e")).collect()
    return {tuple(r)[:-2]: (r.n, r.e) for r in found}


def least(jobs: list[Job], found: dict, kind: str, of: range) -> int:
    """The job of the kind with the least error; ties go to the first."""
    return min((i for i in of if jobs[i].kind == kind), key=lambda i: (found[i,][1], i))


def spans(table: DataFrame, purge: int = 6, shares: tuple[float, float] = (0.7, 0.15)) -> tuple[Column, Column, Column]:
    """Conditions of chronological train, validation and test rows by time, the rows whose labels reach the next part left out."""
    lo, hi = table.agg(F.min("h"), F.max("h")).first()
    a, b = lo + int((hi - lo) * shares[0]), lo + int((hi - lo) * sum(shares))
    return F.col("h") < a - purge, (F.col("h") >= a) & (F.col("h") < b - purge), F.col("h") >= b


def split(table: DataFrame, purge: int = 6, shares: tuple[float, float] = (0.7, 0.15)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``spans``."""
    train, validation, test = spans(table, purge, shares)
    return table.where(train), table.where(validation), table.where(test)


def _rmse(scored: DataFrame) -> float:
    return RegressionEvaluator(labelCol="y", predictionCol="prediction", metricName="rmse").evaluate(scored)


def select(table: DataFrame, columns: list[str], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """model, its parameters, validation and test error and whether it is the choice (least validation error, then name); the choice is fitted again on train and validation before the test."""
    table = table.persist()
    train, validation, test = spans(table)
    jobs = [Job(k, p, columns, train, validation) for k in kinds for p in GRIDS[k]]
    found = errors(scores(table, jobs))
    chosen = {k: least(jobs, found, k, range(len(jobs))) for k in kinds}
    best = min(kinds, key=lambda k: (found[chosen[k],][1], k))
    final = errors(scores(table, [Job(best, jobs[chosen[best]].params, columns, train | validation, test)]))[0,][1]
    return table.sparkSession.createDataFrame([(k, str(jobs[i].params), found[i,][1], final if k == best else None, k == best) for k, i in chosen.items()], "model string, params string, validation_rmse double, test_rmse double, chosen boolean")


def _half_width(scored: DataFrame, alpha: float) -> float | None:
    """Split-conformal half width: the ceil((n + 1)(1 - alpha))-th smallest absolute residual; null below 20 rows."""
    n = scored.count()
    k = math.ceil((n + 1) * (1 - alpha))
    if n < 20 or k > n:
        return None
    return scored.selectExpr(f"percentile_disc({(k - 0.5) / n}D) WITHIN GROUP (ORDER BY abs(y - prediction)) AS q").first().q


def half_widths(scored: DataFrame, alpha: float) -> dict[int, float]:
    """``_half_width`` of each job at once; jobs for which it is null are absent."""
    off = F.abs(F.col("y") - F.col("prediction"))
    ranked = scored.select("job", off.alias("q"), F.row_number().over(Window.partitionBy("job").orderBy(off)).alias("k"), F.count("*").over(Window.partitionBy("job")).alias("n"))
    return {r.job: r.q for r in ranked.where((F.col("n") >= 20) & (F.col("k") == F.ceil((F.col("n") + 1) * F.lit(1 - alpha)))).select("job", "q").collect()}


def _baselines(rows: DataFrame, window: int = 24) -> dict[str, float]:
    """Constant forecasts: zero, the mean and the mean of the last ``window`` targets."""
    last = rows.orderBy(F.desc("h"), "symbol").limit(window)
    return {"zero": 0.0, "mean": rows.agg(F.avg("y")).first()[0], "trailing_mean": last.agg(F.avg("y")).first()[0]}


def walk_forward(table: DataFrame, columns: list[str], kinds: tuple[str, ...] = KINDS, folds: int = 3, purge: int = 6, alpha: float = 0.1) -> DataFrame:
    """Out-of-sample predictions of expanding folds: symbol, h, y, model, params, prediction, lo, hi, fold.

    A fold's validation block is as long as its test block and ends ``purge`` hours before it; training ends ``purge``
    hours before validation. Parameters are chosen on validation, the residuals there give the conformal band (1 - alpha),
    and the model is fitted again on both before the test. Three constant forecasts are rated beside the models.
    """
    table = table.persist()
    lo, hi = table.agg(F.min("h"), F.max("h")).first()
    first = lo + (hi - lo) // 2
    width = (hi - first) // folds + 1

    jobs, again, bounds = [], [], []
    for k in range(folds):
        a = first + k * width
        bounds.append((F.col("h") < a - width - purge, (F.col("h") >= a - width) & (F.col("h") < a - purge), (F.col("h") >= a) & (F.col("h") < a + width)))
        jobs += [Job(m, p, columns, *bounds[k][:2]) for m in kinds for p in GRIDS[m]]
    held = scores(table, jobs)
    found, size = errors(held), len(jobs) // folds
    chosen = [(k, m, least(jobs, found, m, range(k * size, (k + 1) * size))) for k in range(folds) for m in kinds]
    again = [Job(m, jobs[i].params, columns, bounds[k][0] | bounds[k][1], bounds[k][2]) for k, m, i in chosen]

    def constants(k: int) -> list[DataFrame]:
        train, validation, test = bounds[k]
        before, after = _baselines(table.where(train)), _baselines(table.where(train | validation))
        return [shown(table.where(test).withColumn("prediction", F.lit(after[m])), m, {}, table.where(validation).withColumn("prediction", F.lit(before[m])), k) for m in before]

    def shown(tested: DataFrame, model: str, params: dict, seen: DataFrame, k: int) -> DataFrame:
        q = F.lit(_half_width(seen, alpha)).cast("double")
        return tested.select("symbol", "h", "y", F.lit(model).alias("model"), F.lit(str(params)).alias("params"), "prediction", (F.col("prediction") - q).alias("lo"), (F.col("prediction") + q).alias("hi"), F.lit(k).alias("fold"))

    tested = scores(table, again)
    parts = [part for fold in _at_once(constants, list(range(folds))) for part in fold]
    widths = half_widths(held, alpha)
    of_job = lambda values: F.array(*map(F.lit, values))[F.col("job")]
    q = of_job([widths.get(i) for _, _, i in chosen]).cast("double")
    out = tested.select("symbol", "h", "y", of_job([j.kind for j in again]).alias("model"), of_job([str(j.params) for j in again]).alias("params"), "prediction", (F.col("prediction") - q).alias("lo"), (F.col("prediction") + q).alias("hi"), of_job([k for k, _, _ in chosen]).alias("fold"))
    for part in parts:
        out = out.unionByName(part)
    return out


def gain_importance(table: DataFrame, columns: list[str], kind: str = "boosted", top: int = 2) -> DataFrame:
    """feature, gain (share of the fitted trees' gains, from the training rows) and rank of the ``top`` features; ties go by name."""
    gains = pipeline(kind, columns).fit(split(table)[0]).stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(columns, gains, strict=True), key=lambda x: (-x[1], x[0]))[:top]
    return table.sparkSession.createDataFrame([(c, g, i + 1) for i, (c, g) in enumerate(ranked)], "feature string, gain double, rank int")


def per_asset(table: DataFrame, columns: list[str], kind: str = "boosted") -> DataFrame:
    """symbol, test rows, and test errors of a model fitted on the symbol's own rows and of one fitted on all symbols' with their number as a feature."""
    symbols = sorted(r.symbol for r in table.select("symbol").distinct().collect())
    number = F.create_map(*[F.lit(x) for i, s in enumerate(symbols) for x in (s, float(i))])
    table = table.withColumn("symbol_id", number[F.col("symbol")]).persist()
    train, _, test = spans(table)
    own = [Job(kind, {}, columns, train & (F.col("symbol") == s), test & (F.col("symbol") == s)) for s in symbols]
    found = errors(scores(table, [*own, Job(kind, {}, [*columns, "symbol_id"], train, test)]), "symbol")
    rows = [(s, *found.get((i, s), (0, None)), found.get((len(own), s), (0, None))[1]) for i, s in enumerate(symbols)]
    return table.sparkSession.createDataFrame(rows, "symbol string, n_test long, rmse_own double, rmse_global double")


def permutation_importance(table: DataFrame, columns: list[str], kind: str = "ridge", seed: int = 3) -> DataFrame:
    """feature and how much the test error grows when the feature's values are shuffled among rows (by hash order)."""
    train, _, test = split(table)
    fitted = pipeline(kind, columns).fit(train)
    base = _rmse(fitted.transform(test))
    rows = []
    for c in columns:
        numbered = test.selectExpr("*", "row_number() OVER (PARTITION BY symbol ORDER BY h) AS i")
        shuffled = test.selectExpr("symbol", f"`{c}` AS other", f"row_number() OVER (PARTITION BY symbol ORDER BY xxhash64(h, {seed})) AS i")
        rows.append((c, _rmse(fitted.transform(numbered.join(shuffled, ["symbol", "i"]).withColumn(c, F.col("other")))) - base))
    return table.sparkSession.createDataFrame(rows, "feature string, rmse_increase double")


def ablation(table: DataFrame, groups: dict[str, list[str]], kind: str = "ridge") -> DataFrame:
    """variant, test error and its difference from all groups, on the same test rows, leaving one group out at a time."""
    train, _, test = split(table)
    every = [c for g in groups.values() for c in g]
    variants = {"all": every} | {f"without_{g}": [c for c in every if c not in cols] for g, cols in groups.items()}
    errors = {v: _rmse(pipeline(kind, cols).fit(train).transform(test)) for v, cols in variants.items()}
    return table.sparkSession.createDataFrame([(v, e, e - errors["all"]) for v, e in errors.items()], "variant string, rmse double, delta double")
