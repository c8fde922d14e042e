"""Per-role pay models on Spark ML.

The prepared rows are written once, partitioned by role, so each role's model
reads its own files only and fits on all executors. Only metrics, skill names
and importances (a few numbers per role) come to the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import StatisticsError, fmean, pstdev

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as V
from ..functions.pay import in_pay_range
from ..functions.rules import (cost_tier, degree_default, encode_label, first_col,
                               role_category, years_from_title)
from ..sources.schema import MODEL_REGISTRY
from ..sources.workspace import materialize
from .profiles import fit, from_sums, holds_sums, least_squares, profiles, r2, trees_of
from .quantiles import median, positions

BASE_FEATURES = ("is_remote", "education_encoded", "col_tier", "years_experience")
_MODEL_COLUMNS = ("role_category", "average_salary", "is_remote", "education_level", "col_tier",
                  "years_experience_required", "skills")


# --- preparation ------------------------------------------------------------

def resolve_experience(df: DataFrame, title: str = "title",
                       column: str = "years_experience_required") -> DataFrame:
    """Years from the title, else the column, else the median over all rows,
    else 2. Without the column: title or 2."""
    low = df.withColumn("_title", F.lower(title))  # in a projection of its own: once, not once per word
    from_title = years_from_title("_title", lowered=True)
    if column not in df.columns:
        return low.withColumn(column, F.coalesce(from_title, F.lit(V.DEFAULT_YEARS))).drop("_title")
    known = low.withColumn(column, F.coalesce(from_title, F.col(column).cast("double"))).drop("_title")
    return known.withColumn(column, F.coalesce(column, median(known, column).scalar(),
                                               F.lit(V.DEFAULT_YEARS)))


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_remote": F.coalesce(F.col("is_remote").cast("int"), F.lit(0)),
        "education_level": F.coalesce("education_level", F.lit(V.NO_DEGREE)),
        "role_category": F.coalesce("role_category", F.lit(V.OTHER_ROLE)),
        "col_tier": F.coalesce(F.col("col_tier").cast("int"), F.lit(0))})


def prepare_training(df: DataFrame, bounds=V.PAY_RANGE) -> DataFrame:
    """Rows with plausible pay, all features present. One lazy plan."""
    def missing(name: str) -> Column:
        return F.lit(None).cast("string") if name is None else F.col(name)

    new = {}
    if "role_category" not in df.columns:
        new["role_category"] = role_category(missing(first_col(df, ["title"])))
    if "education_level" not in df.columns:
        new["education_level"] = degree_default(missing(first_col(df, V.TEXT_ALIASES)))
    if "col_tier" not in df.columns:
        new["col_tier"] = cost_tier(missing(first_col(df, ["location"])))
    rows = df.withColumns(new) if new else df
    rows = rows.where(in_pay_range("average_salary", bounds))
    return fill_defaults(resolve_experience(rows))


def skill_flag(df: DataFrame, name: str) -> Column:
    """1.0 where a row has the skill; from the array or a skill_ column."""
    if "skills" in df.columns:
        return F.coalesce(F.array_contains("skills", name), F.lit(False)).cast("double")
    if f"skill_{name}" in df.columns:
        return F.coalesce(F.col(f"`skill_{name}`").cast("double"), F.lit(0.0))
    return F.lit(0.0)


def feature_columns(df: DataFrame, skills) -> dict[str, Column]:
    """Feature name -> column, in the order of the feature vector."""
    base = {"is_remote": F.coalesce(F.col("is_remote").cast("double"), F.lit(0.0)),
            "education_encoded": encode_label("education_level").cast("double"),
            "col_tier": F.coalesce(F.col("col_tier").cast("double"), F.lit(0.0)),
            "years_experience": F.coalesce(F.col("years_experience_required").cast("double"),
                                           F.lit(0.0))}
    return base | {f"skill_{s}": skill_flag(df, s) for s in skills}


def build_features(df: DataFrame, skills, keep=(), only=None) -> DataFrame:
    """`features` vector next to the kept columns; `only` names the features to take."""
    columns = feature_columns(df, skills)
    columns = {n: c for n, c in columns.items() if only is None or n in only}
    names = [f"f{i}" for i in range(len(columns))]
    wide = df.select(*keep, *[c.alias(n) for n, c in zip(names, columns.values())])
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


# --- folds --------------------------------------------------------------------

def shuffled_folds(key: str, folds: int = 5, seed: int = 42) -> Column:
    """Fold by keyed hash: no sort, no shuffle, stable under re-runs."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")


def contiguous_folds(df: DataFrame, by: str, order: str, folds: int = 5) -> DataFrame:
    """Fold 0..folds-1 by position in the order of each group, sizes equal to within one row.

    Positions come from sorted ranges and their counts: no group is sorted in one
    task and nothing is joined on the group alone. Rows without group or order are in
    fold 0 and do not count. The rows are stored when this is called.
    """
    known = F.col(by).isNotNull() & F.col(order).isNotNull()
    rows = positions(df.where(known), [by], order)
    least, larger = F.floor(F.col("total") / folds), F.col("total") % folds
    border = larger * (least + 1)  # the first folds have one row more
    fold = F.when(F.col("position") < border, F.floor(F.col("position") / (least + 1))).otherwise(
        larger + F.floor((F.col("position") - border) / least))
    return (rows.withColumn("fold", fold.cast("int")).drop("position", "total")
            .unionByName(df.where(~known).withColumn("fold", F.lit(0))))


# --- models -------------------------------------------------------------------

@dataclass(frozen=True)
class ModelSizes:
    """Sizes of the models tried for each role."""

    forest_trees: int = 100
    forest_depth: int = 15
    forest_leaf: int = 2
    boosting_rounds: int = 100
    boosting_depth: int = 5
    boosting_rate: float = 0.1
    skill_trees: int = 50
    skill_depth: int = 10
    seed: int = 42


def estimators(sizes: ModelSizes = ModelSizes(), label: str = "label") -> dict:
    return {
        "Linear Regression": LinearRegression(labelCol=label),
        "Random Forest": RandomForestRegressor(
            labelCol=label, numTrees=sizes.forest_trees, maxDepth=sizes.forest_depth,
            minInstancesPerNode=sizes.forest_leaf, featureSubsetStrategy="all", seed=sizes.seed),
        "Gradient Boosting": GBTRegressor(
            labelCol=label, maxIter=sizes.boosting_rounds, maxDepth=sizes.boosting_depth,
            stepSize=sizes.boosting_rate, featureSubsetStrategy="all", seed=sizes.seed),
    }


def score(predicted: DataFrame, label: str = "label") -> dict[str, float]:
    """r2, mae and rmse from one aggregate."""
    y, error = F.col(label), F.col(label) - F.col("prediction")
    row = predicted.agg(F.count("*").alias("n"), F.var_pop(y).alias("var"),
                        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae")).first()
    if not row["n"]:
        return {"r2": float("nan"), "mae": float("nan"), "rmse": float("nan"), "n": 0}
    r2 = 1.0 - row["mse"] / row["var"] if row["var"] else float(row["mse"] == 0)
    return {"r2": r2, "mae": row["mae"], "rmse": row["mse"] ** 0.5, "n": row["n"]}


def gram_sums(data: DataFrame, label: str = "label") -> dict[int, np.ndarray]:
    """Fold -> matrix of the sums of products of (1, features, label), from one aggregate over rows or profiles.

    (features + 2) squared numbers per fold come to the driver.
    """
    if "yy" not in data.columns:
        y = F.col(label).cast("double")
        data = data.withColumns({"n": F.lit(1.0), "y": y, "yy": y * y})
    width = data.schema["features"].metadata["ml_attr"]["num_attrs"]
    rows = data.select("fold", "n", "y", "yy", vector_to_array("features").alias("v"))
    rows = rows.select("fold", "n", "y", "yy", F.lit(1.0).alias("z0"),
                       *[F.get("v", i).alias(f"z{i + 1}") for i in range(width)])
    pairs = [(i, j) for i in range(width + 2) for j in range(i, width + 2)]

    def product(i: int, j: int) -> Column:
        if i > width:
            return F.col("yy")
        return F.col(f"z{i}") * (F.col("y") if j > width else F.col(f"z{j}") * F.col("n"))

    sums = rows.groupBy("fold").agg(*[F.sum(product(i, j)).alias(f"s{i}_{j}") for i, j in pairs])
    out = {}
    for row in sums.collect():
        gram = np.zeros((width + 2, width + 2))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"s{i}_{j}"]
        out[row["fold"]] = gram
    return out


def gram_fit(gram: np.ndarray) -> np.ndarray:
    """Intercept and coefficients of least squares; 0 for a constant feature, the shortest among equal fits."""
    n, sums, squares = gram[0, 0], gram[0, 1:], np.diag(gram)[1:]
    if not n:
        raise ValueError("no rows to fit")
    centered = gram[1:, 1:] - np.outer(sums, sums) / n
    spread = np.sqrt(np.maximum(np.diag(centered), 0))[:-1]
    varies = spread ** 2 > 1e-12 * squares[:-1]
    coefficients = np.zeros(len(spread))
    if varies.any():
        scale = spread[varies]
        matrix = centered[:-1, :-1][np.ix_(varies, varies)] / np.outer(scale, scale)
        solved = np.linalg.lstsq(matrix, centered[:-1, -1][varies] / scale, rcond=1e-10)[0]
        coefficients[varies] = solved / scale
    return np.concatenate(([(sums[-1] - coefficients @ sums[:-1]) / n], coefficients))


def gram_r2(gram: np.ndarray, fit: np.ndarray) -> float:
    """r2 of a fit on the rows that the sums stand for."""
    n, weights = gram[0, 0], np.concatenate((fit, [-1.0]))
    if not n:
        return float("nan")
    error = max(weights @ gram @ weights, 0.0) / n
    variance = gram[-1, -1] / n - (gram[0, -1] / n) ** 2
    if variance <= 1e-14 * gram[-1, -1] / n:
        return float(error <= 1e-14 * gram[-1, -1] / n)
    return float(1.0 - error / variance)


def gram_scores(grams: dict[int, np.ndarray], folds: int) -> list[tuple[float, float]]:
    """(test r2, train r2) per fold; what trains a fold's fit is the total less its part."""
    if not grams:
        raise ValueError("no rows to fit")
    total, out = sum(grams.values()), []
    for k in range(folds):
        part = grams.get(k, np.zeros_like(total))
        fit = gram_fit(total - part)
        out.append((gram_r2(part, fit), gram_r2(total - part, fit)))
    return out


def cross_validate(estimator, data: DataFrame, folds: int = 5, parallelism: int = 4,
                   train_scores: bool = False, table: DataFrame | None = None) -> dict:
    """Mean and population std of the test r2 over the `fold` column.

    A plain linear regression is validated from sums of products alone, trees from the
    profiles of the rows where `table` has them (see `profile_table`).
    """
    from_table = holds_sums(table, estimator)

    def run(k: int):
        if from_table:
            fitted = fit(estimator, table.where(F.col("fold") != k))
            return (r2(fitted, table.where(F.col("fold") == k)),
                    r2(fitted, table.where(F.col("fold") != k)) if train_scores else None)
        fitted = estimator.fit(data.where(F.col("fold") != k))
        test = score(fitted.transform(data.where(F.col("fold") == k)))["r2"]
        train = (score(fitted.transform(data.where(F.col("fold") != k)))["r2"]
                 if train_scores else None)
        return test, train

    if least_squares(estimator):
        results = gram_scores(gram_sums(table if from_table else data, estimator.getLabelCol()), folds)
    else:
        with ThreadPoolExecutor(parallelism) as pool:
            results = list(pool.map(run, range(folds)))
    tests = [t for t, _ in results if t == t]
    out = {"mean_r2": fmean(tests), "std_r2": pstdev(tests)}
    if train_scores:
        out["train_r2"] = fmean(t for _, t in results)
    return out


def select_top_skills(df: DataFrame, skills, n: int | None = 10, sizes: ModelSizes = ModelSizes(),
                      key: str = "seq") -> list[str]:
    """Skills with the highest importance in a forest on skills alone; without n all, best first.

    The forest learns from the profiles of skills; `key` draws the rows of its trees.
    """
    skills = list(skills)
    if not skills:
        return []
    names = [f"f{i}" for i in range(len(skills))]
    row = F.col(key) if key in df.columns else F.monotonically_increasing_id()
    # Flags are looked up per profile, not per row.
    by = ["skills"] if "skills" in df.columns else [c for s in skills if (c := f"skill_{s}") in df.columns]
    table = profiles(df.withColumn("row", row), [f"`{c}`" for c in by], "average_salary", trees=sizes.skill_trees,
                     seed=sizes.seed)
    table = table.withColumns({f: skill_flag(table, s) for f, s in zip(names, skills)}).drop(*by)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(table).drop(*names)
    data = materialize(data, "profiles").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        forest = fit(RandomForestRegressor(numTrees=sizes.skill_trees, maxDepth=sizes.skill_depth,
                                           featureSubsetStrategy="all", seed=sizes.seed), data)
    finally:
        data.unpersist()
    weights = forest.featureImportances.toArray()
    return [s for _, s in sorted(zip(-weights, skills))][:n]


def role_data(prepared: DataFrame, role: str, skills, key: str, folds: int, seed: int,
              shuffled: bool = False, only=None):
    """label, fold, row (the key) and features of one role; folds by position unless they are to be shuffled.

    Rows that have a fold keep it.
    """
    rows = prepared.where(F.col("role_category") == role).withColumns(
        {"label": F.col("average_salary"), "row": F.col(key)})
    if shuffled:
        rows = rows.withColumn("fold", shuffled_folds(key, folds, seed))
    elif "fold" not in prepared.columns:
        rows = contiguous_folds(rows, "role_category", key, folds)
    return build_features(rows, skills, keep=["label", "fold", "row"], only=only)


# Up to so many rows a forest learns from them: all its trees grow in the same jobs. From profiles each
# tree has jobs of its own, which cost the same whatever the number of rows.
_FOREST_ROWS, _FOREST_TASKS = 100_000, 4


def reads_rows(estimator, rows: int | None = None) -> bool:
    """Whether a model is trained on rows, not on profiles; without a number of rows, as if there were many."""
    few = rows is not None and rows <= _FOREST_ROWS and trees_of(estimator) > 1
    return few or not from_sums(estimator)


def profile_table(data: DataFrame, models: dict, seed: int = 42, rows: int | None = None) -> DataFrame | None:
    """The profiles of the rows, stored, where a model learns from them; the caller unpersists them."""
    learners = [e for e in models.values() if not reads_rows(e, rows)]
    if not learners or "row" not in data.columns:
        return None
    table = profiles(data, ["fold", "features"], learners[0].getLabelCol(), trees=max(map(trees_of, learners)), seed=seed)
    return materialize(table, "profiles").persist(StorageLevel.MEMORY_AND_DISK)


# What bad data raises; anything else, a lost executor for one, stops the training.
_DATA_PROBLEMS = (ValueError, ZeroDivisionError, StatisticsError, IllegalArgumentException)


def train_best(data: DataFrame, models: dict, folds: int = 5, parallelism: int = 4, rows: int | None = None):
    """The model with the best mean r2, refit on all rows, with its metrics.

    A model the data do not fit has null scores and its problem as message; if
    that is so for all, it is an error. With the number of `rows`, a forest may learn from
    the rows (see `reads_rows`).
    """
    scores, table = [], profile_table(data, models, rows=rows)
    try:
        for name, estimator in models.items():
            try:
                cv = cross_validate(estimator, data, folds, parallelism, table=table)
                scores.append((name, cv["mean_r2"], cv["std_r2"], None))
            except _DATA_PROBLEMS as problem:
                scores.append((name, None, None, str(problem)[:500]))
        known = [s for s in scores if s[1] is not None]
        if not known:
            raise ValueError("no model could be trained: " + "; ".join(f"{s[0]}: {s[3]}" for s in scores))
        best = max(known, key=lambda s: s[1])[0]
        chosen = models[best]
        fitted = fit(chosen, table) if holds_sums(table, chosen) else chosen.fit(data)
    finally:
        if table is not None:
            table.unpersist()
    return best, fitted, score(fitted.transform(data)), scores


def _keep_rows(data: DataFrame, models: dict, rows: int | None = None) -> DataFrame:
    """The rows kept, if a model reads them again and again; few rows in an order of their own, on which bags depend."""
    if not any(reads_rows(e, rows) for e in models.values()):
        return data
    if any(reads_rows(e, rows) and from_sums(e) for e in models.values()):
        data = data.repartition(_FOREST_TASKS, "row").sortWithinPartitions("row")
    return data.persist(StorageLevel.MEMORY_AND_DISK)


def prepared_table(df: DataFrame, key: str | None = None) -> DataFrame:
    """Prepared rows, stored by role; with `key` only it and the columns that models read.

    Features, pay and skills are those columns: the others would be shuffled and stored for nothing.
    """
    rows = prepare_training(df)
    if key:
        rows = rows.select(*[c for c in rows.columns if c in (key, *_MODEL_COLUMNS) or c.startswith("skill_")])
    return materialize(rows, "training", ["role_category"])


def trainable_roles(prepared: DataFrame, min_rows: int = 15, min_total: int = 20) -> list[str]:
    """Roles with enough rows, without the catch-all."""
    counts = prepared.groupBy("role_category").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    if total < min_total:
        raise ValueError(f"only {total} rows with pay, need {min_total}")
    kept = counts.where((F.col("role_category") != V.OTHER_ROLE) & (F.col("count") >= min_rows))
    return sorted(r[0] for r in kept.select("role_category").collect())


def _each_role(run, roles, at_once: int) -> list:
    """(role, result of run(role), None) or, where its data do not do, (role, None, the problem)."""
    def safe(role):
        try:
            return role, run(role), None
        except _DATA_PROBLEMS as problem:
            return role, None, str(problem)[:500]

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(safe, roles))


def train_per_role(prepared: DataFrame, path: str, skills=tuple(V.SKILL_PATTERNS), key="seq",
                   n_skills: int = 10, sizes: ModelSizes = ModelSizes(), folds: int = 5,
                   parallelism: int = 4, min_rows: int = 15, roles_at_once: int = 2,
                   models=None, only=None) -> DataFrame:
    """Train, compare and store a model per role; the registry table results.

    `prepared` should be a stored table (see `prepared_table`). A role whose
    data do not do has a registry row with the problem as its status and no
    path. Fits of a few roles and folds are submitted at the same time, so
    small roles do not leave executors idle; the folds of all roles are laid out
    in one go and stored by role. `models` (name -> estimator of
    label and features) replaces the three built-in ones, `only` names the
    features to use.
    """
    spark = prepared.sparkSession
    roles = trainable_roles(prepared, min_rows)
    placed = materialize(contiguous_folds(prepared.where(F.col("role_category").isin(roles)).drop("fold"),
                                          "role_category", key, folds), "folds", ["role_category"])

    def train(role: str):
        rows = prepared.where(F.col("role_category") == role)
        ranked = select_top_skills(rows, skills, None, sizes, key)
        top = ranked[:n_skills]
        tried, number = models or estimators(sizes), rows.count()
        data = _keep_rows(role_data(placed, role, top, key, folds, sizes.seed, only=only), tried, number)
        try:
            best, fitted, scored, cv = train_best(data, tried, folds, parallelism, number)
        finally:
            data.unpersist()
        target = f"{path}/{role.replace(' ', '_')}"
        PipelineModel([fitted]).write().overwrite().save(target)
        names = [n for n in feature_columns(prepared, top) if only is None or n in only]
        return (role, best, scored["r2"], scored["mae"], scored["rmse"], scored["n"], top, ranked, names,
                [c[:3] for c in cv], target, "trained")

    records = [result or (role, *[None] * 10, problem) for role, result, problem in
               _each_role(train, roles, roles_at_once)]
    registry = spark.createDataFrame(records, MODEL_REGISTRY)
    registry.coalesce(1).write.mode("overwrite").parquet(f"{path}/registry")
    return load_registry(spark, path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_REGISTRY).parquet(f"{path}/registry")


def load_models(spark: SparkSession, path: str) -> dict[str, tuple]:
    """role -> (registry row, model)."""
    return {row["role"]: (row, PipelineModel.load(row["path"]))
            for row in load_registry(spark, path).where(F.col("path").isNotNull()).collect()}


def predict_batch(df: DataFrame, models: dict[str, tuple], keep=("seq",)) -> DataFrame:
    """Predicted pay with bounds of one mean error; null without a model.

    Rows of each role are scored by their model in one pass over the role's
    rows; give a table stored by role and no row is read twice.
    """
    def result(rows, value, row):
        def info(name, kind):
            return F.lit(row[name] if row else None).cast(kind)
        mae = info("mae", "double")
        return rows.select(*keep, "role_category", value.alias("predicted_salary"),
                           (value - mae).alias("lower_bound"), (value + mae).alias("upper_bound"),
                           info("model_name", "string").alias("model_name"),
                           info("r2", "double").alias("r2"))

    rest = df.where(~F.coalesce(F.col("role_category").isin(*models), F.lit(False))
                    if models else F.lit(True))
    out = result(rest, F.lit(None).cast("double"), None)
    for role, (row, model) in models.items():
        rows = df.where(F.col("role_category") == role)
        data = build_features(rows, row["top_skills"], [*keep, "role_category"], row["feature_names"])
        out = out.unionByName(result(model.transform(data), F.col("prediction"), row))
    return out


def feature_importance(spark: SparkSession, models: dict[str, tuple]) -> DataFrame:
    """(role, feature, importance): tree importance or absolute coefficient."""
    rows = []
    for role, (row, model) in models.items():
        fitted = model.stages[-1]
        weights = (abs(fitted.coefficients.toArray()) if hasattr(fitted, "coefficients")
                   else fitted.featureImportances.toArray())
        rows += [(role, f, float(w)) for f, w in zip(row["feature_names"], weights)]
    return spark.createDataFrame(rows, "role string, feature string, importance double").orderBy(
        "role", F.desc("importance"), "feature")


def model_report(registry: DataFrame, n_skills: int = 5) -> DataFrame:
    """One line per role and model tried, the chosen one marked."""
    return registry.select(
        "role", "r2", "mae", "rmse", F.slice("top_skills", 1, n_skills).alias("top_skills"),
        F.size("feature_names").alias("n_features"), "model_name",
        F.inline("cv_scores")).withColumn("chosen", F.col("model") == F.col("model_name"))


def top_skills(registry: DataFrame, role: str, n: int = 5) -> DataFrame:
    """The strongest skills of a role's model, best first."""
    rows = registry.where(F.col("role") == role)
    return rows.select(F.posexplode(F.slice("top_skills", 1, n)).alias("position", "skill"))


def all_skills(registry: DataFrame, role: str) -> DataFrame:
    """Every skill of a role's model, best first."""
    rows = registry.where(F.col("role") == role)
    return rows.select(F.posexplode("all_skills").alias("position", "skill"))


def compare_models(prepared: DataFrame, skills=tuple(V.SKILL_PATTERNS), key="seq",
                   n_skills: int = 10, sizes: ModelSizes = ModelSizes(), folds: int = 5,
                   parallelism: int = 4, min_rows: int = 20, log_target: bool = False,
                   cap_years: float | None = None, roles_at_once: int = 2,
                   models=None, only=None) -> DataFrame:
    """Test and train r2 of every model and role over shuffled folds.

    `log_target` learns log(1 + pay); `cap_years` limits the experience. A role
    whose data do not do has one row with the problem as its status.
    """
    rows = prepared
    if cap_years is not None:
        rows = rows.withColumn("years_experience_required",
                               F.least("years_experience_required", F.lit(cap_years)))

    def compare(role: str):
        top = select_top_skills(rows.where(F.col("role_category") == role), skills, n_skills, sizes, key)
        data = role_data(rows, role, top, key, folds, sizes.seed, shuffled=True, only=only)
        if log_target:
            data = data.withColumn("label", F.log1p("label"))
        tried = models or estimators(sizes)
        data = _keep_rows(data, tried)
        table = profile_table(data, tried, sizes.seed)
        try:
            out = []
            for name, estimator in tried.items():
                cv = cross_validate(estimator, data, folds, parallelism, train_scores=True, table=table)
                out.append((role, name, cv["mean_r2"], cv["std_r2"], cv["train_r2"], "trained"))
            return out
        finally:
            data.unpersist()
            if table is not None:
                table.unpersist()

    results = _each_role(compare, trainable_roles(rows, min_rows), roles_at_once)
    return rows.sparkSession.createDataFrame(
        [line for role, part, problem in results
         for line in part or [(role, None, None, None, None, problem)]],
        "role string, model string, mean_r2 double, std_r2 double, train_r2 double, status string")
