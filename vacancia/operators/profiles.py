"""Models from sums per profile: rows with the same fold and features are one row.

With squared error, splits, fits and r2 depend on the rows of a profile only through their number and the sums
of their label and of its square: what varies within a profile is the same on both sides of any split. So the
rows are read once, and the many passes of training read profiles. Bags are still drawn row by row: each row
has a Poisson count per tree, from a hash of its key, and a tree learns from the sums of these counts and of the
labels times them. Where features hardly repeat there are about as many profiles as rows, and training costs
what it would on rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from math import exp, factorial

from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame, functions as F

_BITS = 53
# Chances of at most 0, 1, 2... draws when as many rows are drawn, with replacement, as there are.
_CUTS = [int(sum(exp(-1) / factorial(j) for j in range(n + 1)) * 2 ** _BITS) for n in range(16)]
_TREES_AT_ONCE = 4


def _draws(hashed: Column) -> Column:
    out = F
    for n, cut in enumerate(_CUTS):
        out = out.when(hashed < cut, n)
    return out.otherwise(len(_CUTS))


def profiles(data: DataFrame, by, label: str = "label", row: str = "row", trees: int = 0, seed: int = 42) -> DataFrame:
    """(by..., n, y, yy, mean) and per tree w<i>, s<i>: rows, sums of label and its square, bag counts, their labels.

    `row` tells rows apart; one tree alone takes each row once, as Spark's forests do.
    """
    rows = data.select(*by, F.col(label).cast("double").alias("y"), *[
        F.shiftrightunsigned(F.xxhash64(row, F.lit(seed), F.lit(i)), 64 - _BITS).alias(f"c{i}") for i in range(trees)])
    # Each hash and each count is worked out once, in a projection of its own.
    rows = rows.select(*by, "y", *[(_draws(F.col(f"c{i}")) if trees > 1 else F.lit(1)).alias(f"c{i}")
                                   for i in range(trees)])
    sums = [F.count("*").cast("double").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy")]
    for i in range(trees):
        sums += [F.sum(f"c{i}").cast("double").alias(f"w{i}"), F.sum(F.col(f"c{i}") * F.col("y")).alias(f"s{i}")]
    return rows.groupBy(*by).agg(*sums).withColumn("mean", F.col("y") / F.col("n"))


def least_squares(estimator) -> bool:
    """Whether the sums of products say all about the fit: squared error, an intercept, no penalty, no weights."""
    return (isinstance(estimator, LinearRegression) and estimator.getRegParam() == 0
            and estimator.getFitIntercept() and estimator.getLoss() == "squaredError"
            and not estimator.isDefined("weightCol") and estimator.getFeaturesCol() == "features")


def trees_of(estimator) -> int:
    """How many bags the profiles need for an estimator."""
    return estimator.getNumTrees() if isinstance(estimator, RandomForestRegressor) else 0


def from_sums(estimator) -> bool:
    """Whether profiles say all that an estimator learns from: squared error, all rows and all features."""
    if least_squares(estimator):
        return True
    if (not isinstance(estimator, (RandomForestRegressor, GBTRegressor)) or estimator.getImpurity() != "variance"
            or estimator.isDefined("weightCol") or estimator.getFeaturesCol() != "features"
            or estimator.getSubsamplingRate() != 1 or estimator.getMinWeightFractionPerNode() != 0
            or estimator.getFeatureSubsetStrategy() != "all"):
        return False
    if isinstance(estimator, GBTRegressor):
        return (estimator.getLossType() == "squared" and estimator.getMinInstancesPerNode() == 1
                and not estimator.isDefined("validationIndicatorCol"))
    return estimator.getBootstrap()


def holds_sums(table: DataFrame | None, estimator) -> bool:
    """Whether a table of profiles, if there is one, has what an estimator learns from."""
    bags = trees_of(estimator)
    return table is not None and from_sums(estimator) and (not bags or f"w{bags - 1}" in table.columns)


def fit(estimator, table: DataFrame):
    """The estimator fitted on profiles, as on their rows."""
    if isinstance(estimator, RandomForestRegressor):
        return _forest(estimator, table)
    return estimator.copy({estimator.weightCol: "n", estimator.labelCol: "mean"}).fit(table)


def _forest(estimator, table: DataFrame) -> RandomForestRegressionModel:
    count, leaf = estimator.getNumTrees(), estimator.getMinInstancesPerNode()
    totals = table.agg(*[F.sum(f"w{i}") for i in range(count)]).first()
    if not all(totals):
        raise ValueError("no rows to fit")

    def grow(i: int):
        weight = F.col(f"w{i}")
        rows = table.where(weight > 0).select("features", weight.alias("weight"),
                                              (F.col(f"s{i}") / weight).alias("label"))
        # The least number of rows in a node counts rows of the bag, so it is a share of their number.
        deep = estimator.getMaxDepth() if totals[i] >= 2 * leaf else 0
        return DecisionTreeRegressor(
            weightCol="weight", maxDepth=deep, maxBins=estimator.getMaxBins(), minInfoGain=estimator.getMinInfoGain(),
            maxMemoryInMB=estimator.getMaxMemoryInMB(), seed=estimator.getSeed(),
            minWeightFractionPerNode=min((leaf - 0.5) / totals[i], 0.49)).fit(rows)

    with ThreadPoolExecutor(_TREES_AT_ONCE) as pool:
        trees = list(pool.map(grow, range(count)))
    # Python has no way to put trees together, the class has.
    name = "org.apache.spark.ml.regression."
    kind = getattr(table.sparkSession._jvm, f"{name}DecisionTreeRegressionModel")
    array = JavaWrapper._new_java_array([t._java_obj for t in trees], kind)
    forest = RandomForestRegressionModel(
        JavaWrapper._new_java_obj(f"{name}RandomForestRegressionModel", array, trees[0].numFeatures))
    forest = estimator._copyValues(forest)  # the number of trees among them, as `fit` does
    forest._transfer_params_to_java()
    return forest


def r2(model, table: DataFrame) -> float:
    """r2 of a model on the rows that the profiles stand for."""
    n, mean, p = F.col("n"), F.col("mean"), F.col("prediction")
    within = F.greatest(F.col("yy") - F.col("y") * mean, F.lit(0.0))
    row = model.transform(table).agg(F.sum(n).alias("n"), F.sum("y").alias("y"), F.sum("yy").alias("yy"),
                                     F.sum(n * (p - mean) * (p - mean) + within).alias("error")).first()
    if not row["n"]:
        return float("nan")
    square, error = row["yy"] / row["n"], row["error"] / row["n"]
    variance = square - (row["y"] / row["n"]) ** 2
    if variance <= 1e-14 * square:
        return float(error <= 1e-14 * square)
    return 1.0 - error / variance
