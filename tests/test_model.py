"""Pay models on planted data."""

import inspect
import random

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from catalog import CASES, trends
from vacancia.functions import fixed_values as V, rules
from vacancia.operators import model, profiles
from vacancia.operators.quantiles import value_weights
from vacancia.plans.enrich import add_categories

SIZES = model.ModelSizes(forest_trees=3, forest_depth=3, boosting_rounds=2, boosting_depth=2,
                         skill_trees=5, skill_depth=3)


@pytest.fixture(scope="module")
def prepared(spark):
    pick = random.Random(5)
    data = []
    for i in range(360):
        role = ["Data Analyst", "Data Engineer", "Other"][i % 3]
        skills = pick.sample(["SQL", "Python", "Git"], pick.randrange(4))
        years = float(pick.randrange(10))
        pay = 50000.0 + 4000 * years + 20000 * ("SQL" in skills) + 1000 * pick.random()
        data.append((i, role, "plain title", skills, years, "PhD", bool(i % 2), 1, pay))
    data += [(900, "AI Engineer", "t", [], 1.0, None, None, 0, 60000.0),
             (901, "Data Analyst", "t", [], 1.0, None, None, 0, 10.0),
             (902, None, "Senior t", ["SQL"], None, None, None, None, 70000.0)]
    df = spark.createDataFrame(data, """seq long, role_category string, title string,
        skills array<string>, years_experience_required double, education_level string,
        is_remote boolean, col_tier int, average_salary double""")
    return model.prepared_table(df)


def test_preparation(prepared):
    assert prepared.where("seq = 901").count() == 0
    row = prepared.where("seq = 902").first()
    assert (row.role_category, row.education_level, row.is_remote, row.col_tier,
            row.years_experience_required) == ("Other", "No education", 0, 0, 5.0)
    assert model.trainable_roles(prepared) == ["Data Analyst", "Data Engineer"]
    with pytest.raises(ValueError):
        model.trainable_roles(prepared.limit(10))


def test_experience_falls_back_to_median_and_two(spark):
    df = spark.createDataFrame([("t", 4), ("Senior t", 9), ("t", None), ("t", 6)], "title string, n int")
    filled = model.resolve_experience(df, column="n").select("n").collect()
    assert sorted(r.n for r in filled) == [4.0, 5.0, 5.0, 6.0]
    none = model.resolve_experience(df.where("n is null"), column="n")
    assert none.first().n == 2.0
    assert model.resolve_experience(df.select("title")).select(
        "years_experience_required").distinct().count() == 2


def test_top_skill_is_the_planted_one(prepared):
    rows = prepared.where("role_category = 'Data Analyst'")
    assert model.select_top_skills(rows, ["Git", "Python", "SQL", "R"], 2, SIZES)[0] == "SQL"


def test_linear_model_recovers_the_plan(prepared):
    data = model.role_data(prepared, "Data Engineer", ["SQL"], "seq", 5, 42)
    best, fitted, fit, cv = model.train_best(data, model.estimators(SIZES))
    assert best == "Linear Regression" and fit["r2"] > 0.99 and len(cv) == 3
    years, sql = fitted.coefficients[3], fitted.coefficients[4]
    assert abs(years - 4000) < 100 and abs(sql - 20000) < 500


def test_a_failing_model_is_left_out(prepared):
    class Broken:
        def fit(self, data):
            raise ValueError("no")
    data = model.role_data(prepared, "Data Engineer", ["SQL"], "seq", 5, 42)
    linear = model.estimators(SIZES)["Linear Regression"]
    best, *_ = model.train_best(data, {"Broken": Broken(), "Linear": linear})
    assert best == "Linear"
    with pytest.raises(ValueError):
        model.train_best(data, {"Broken": Broken()})


def test_other_failures_stop_the_training(prepared):
    class Lost:
        def fit(self, data):
            raise RuntimeError("executor lost")
    data = model.role_data(prepared, "Data Engineer", ["SQL"], "seq", 5, 42)
    with pytest.raises(RuntimeError):
        model.train_best(data, {"Lost": Lost(), "Linear": model.estimators(SIZES)["Linear Regression"]})


def test_a_role_that_cannot_be_trained_is_recorded(prepared, tmp_path):
    class Broken:
        def fit(self, data):
            raise ValueError("no")
    registry = model.train_per_role(prepared, str(tmp_path), [], sizes=SIZES, models={"Broken": Broken()})
    assert all(r.path is None and "no" in r.status for r in registry.collect())
    assert model.load_models(prepared.sparkSession, str(tmp_path)) == {}


def test_train_save_load_predict(spark, prepared, tmp_path):
    path = str(tmp_path)
    registry = model.train_per_role(prepared, path, ["SQL", "Git", "Python"], n_skills=2, sizes=SIZES)
    assert sorted(r.role for r in registry.collect()) == ["Data Analyst", "Data Engineer"]
    models = model.load_models(spark, path)
    out = model.predict_batch(prepared, models)
    assert out.count() == prepared.count()
    known = out.where(F.col("predicted_salary").isNotNull())
    assert known.count() == 240
    assert known.where("lower_bound <= predicted_salary and predicted_salary <= upper_bound").count() == 240
    weights = model.feature_importance(spark, models).where("role = 'Data Analyst'").collect()
    assert len(weights) == 6 and weights[0].feature == "skill_SQL"
    report = model.model_report(registry)
    assert report.count() == 6 and report.where("chosen").count() == 2
    assert model.top_skills(registry, "Data Analyst", 1).first().skill == "SQL"


def test_folds(prepared):
    folds = model.contiguous_folds(prepared, "role_category", "seq", 5)
    assert folds.count() == prepared.count()
    sizes = folds.where("role_category = 'Other'").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [25, 24, 24, 24, 24]
    ends = folds.where("role_category = 'Other'").groupBy("fold").agg(
        F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("fold").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))
    a = [r[0] for r in prepared.orderBy("seq").select(model.shuffled_folds("seq")).collect()]
    assert set(a) == set(range(5))


def test_compare_models(prepared):
    out = model.compare_models(prepared, ["SQL"], n_skills=1, sizes=SIZES, log_target=True, cap_years=5.0)
    assert out.count() == 6 and out.where("train_r2 > 0.5").count() > 0


def test_linear_scores_from_sums_equal_those_of_the_fits(prepared):
    data = model.role_data(prepared, "Data Engineer", ["SQL", "Git", "R"], "seq", 5, 42)
    linear = model.estimators(SIZES)["Linear Regression"]
    got = model.gram_scores(model.gram_sums(data), 5)
    for k, (test, train) in enumerate(got):
        fitted = linear.fit(data.where(F.col("fold") != k))
        assert abs(test - model.score(fitted.transform(data.where(F.col("fold") == k)))["r2"]) < 1e-9
        assert abs(train - model.score(fitted.transform(data.where(F.col("fold") != k)))["r2"]) < 1e-9
    assert model.least_squares(linear) and not model.least_squares(linear.copy({linear.regParam: 0.1}))


def test_fits_from_sums_without_spread():
    rows = np.array([[1.0, 3, 5, 7], [1, 3, 6, 7], [1, 3, 7, 7]])
    gram = rows.T @ rows
    assert np.allclose(model.gram_fit(gram), [7, 0, 0]) and model.gram_r2(gram, model.gram_fit(gram)) == 1.0
    with pytest.raises(ValueError):
        model.gram_fit(np.zeros((3, 3)))
    with pytest.raises(ValueError):
        model.gram_scores({}, 5)
    doubled = np.array([[1.0, x, 2 * x, 3 * x + 1] for x in range(5)])
    fit = model.gram_fit(doubled.T @ doubled)
    assert np.allclose(doubled[:, :3] @ fit, doubled[:, 3])


def test_titles_are_lower_cased_once(spark):
    """Long ladders of words read a column that is in lower case, and no filter works them out again."""
    df = spark.createDataFrame([("Senior x", 4.0, "Austin, TX", "Full_Time", 1.0), ("t", None, None, None, 2.0)],
                               "title string, n double, location string, job_type string, v double")
    for rows in (model.resolve_experience(df, column="n"), add_categories(df).drop("state", "job_type_norm")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("lower(title") == 1 and plan.lower().count("lower(location") <= 1
    weights = value_weights(df.withColumn("v", rules.years_from_title("title")), "v")
    assert weights.collect() == [(5.0, 1)]
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert not any("CASE" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter"))


def test_prepared_rows_keep_what_models_read(spark, prepared):
    wide = prepared.withColumn("description", F.lit("long"))
    narrow = model.prepared_table(wide, "seq")
    assert set(narrow.columns) == set(prepared.columns) - {"title"}
    both = [{r.seq: r.asDict() for r in rows.drop("title", "description").collect()}
            for rows in (narrow, model.prepared_table(wide))]
    assert both[0] == both[1] and len(both[0]) == 362


def _planted(spark, parts):
    rows = spark.range(2000).repartition(parts).selectExpr(
        "id as seq", "array_compact(array(if(id % 2 = 0, 'SQL', null), if(id % 3 = 0, 'Git', null), if(id % 5 < 2, 'R', null))) as skills",
        "'Data Analyst' as role_category", "cast(id % 7 as double) as years_experience_required", "'PhD' as education_level",
        "id % 11 = 0 as is_remote", "1 as col_tier", "cast(pmod(hash(id), 5) as int) as fold",
        "50000 + 3000 * (id % 7) + if(id % 2 = 0 and id % 7 > 3, 9000, 0) + pmod(hash(id * 31), 1000) as average_salary")
    return model.role_data(rows, "Data Analyst", ["SQL", "Git"], "seq", 5, 42), rows


def test_boosting_and_lines_from_profiles_equal_those_from_rows(spark):
    data, _ = _planted(spark, 3)
    tried = model.estimators(model.ModelSizes(boosting_rounds=4, boosting_depth=3, forest_trees=4, forest_depth=4))
    table = model.profile_table(data, tried)
    assert table.count() < 500 and table.agg(F.sum("n")).first()[0] == 2000
    for name in ("Linear Regression", "Gradient Boosting"):
        by_rows, by_sums = tried[name].fit(data), profiles.fit(tried[name], table)
        both = by_rows.transform(data).select("row", F.col("prediction").alias("p")).join(
            by_sums.transform(data).select("row", "prediction"), "row")
        assert both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-4
        assert abs(profiles.r2(by_sums, table) - model.score(by_rows.transform(data))["r2"]) < 1e-9
    by_rows = model.cross_validate(tried["Gradient Boosting"], data, train_scores=True)
    by_sums = model.cross_validate(tried["Gradient Boosting"], data, train_scores=True, table=table)
    assert all(abs(by_rows[k] - by_sums[k]) < 1e-9 for k in by_rows)


def test_a_forest_is_the_same_however_rows_are_partitioned(spark, tmp_path):
    """Bags are drawn by key, row by row, so neither tasks nor their order matter."""
    forest = model.estimators(model.ModelSizes(forest_trees=4, forest_depth=4))["Random Forest"]
    fitted = []
    for parts in (1, 7):
        data, rows = _planted(spark, parts)
        table = model.profile_table(data, {"Random Forest": forest})
        fitted.append((profiles.fit(forest, table), model.select_top_skills(rows, ["SQL", "Git", "R"], None, SIZES)))
    (a, first), (b, second) = fitted
    assert first == second and first[0] == "SQL"
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray())
    assert a.getNumTrees == 4 and len({t.toDebugString.split("\n", 1)[1] for t in a.trees}) > 1
    r2 = profiles.r2(a, table)
    assert abs(r2 - model.score(a.transform(data))["r2"]) < 1e-9
    assert abs(r2 - model.score(forest.fit(data).transform(data))["r2"]) < 0.02
    a.write().overwrite().save(str(tmp_path))
    again = RandomForestRegressionModel.load(str(tmp_path))
    assert again.getNumTrees == 4 and abs(profiles.r2(again, table) - r2) < 1e-12


def test_a_forest_on_few_rows_is_the_same_however_they_are_partitioned(spark):
    """Few rows are dealt out by key, and all trees of the forest grow together from them."""
    tried = {"Random Forest": model.estimators(model.ModelSizes(forest_trees=4, forest_depth=4))["Random Forest"]}
    assert model.reads_rows(tried["Random Forest"], 2000) and not model.reads_rows(tried["Random Forest"])
    assert not model.reads_rows(tried["Random Forest"], 200_000)
    fitted = []
    for parts in (1, 7):
        data, _ = _planted(spark, parts)
        data = model._keep_rows(data, tried, 2000)
        assert model.profile_table(data, tried, rows=2000) is None
        fitted.append(model.train_best(data, tried, rows=2000))
    (_, a, metrics, cv), (_, b, *_) = fitted
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray())
    _, _, by_profiles, by_profiles_cv = model.train_best(data, tried)
    assert abs(metrics["r2"] - by_profiles["r2"]) < 0.02 and abs(cv[0][1] - by_profiles_cv[0][1]) < 0.02
    # Other models still learn from profiles, which then hold no bags.
    table = model.profile_table(data, tried | {"Linear": model.estimators()["Linear Regression"]}, rows=2000)
    assert profiles.holds_sums(table, model.estimators()["Gradient Boosting"])
    assert not profiles.holds_sums(table, tried["Random Forest"])


def test_registered_training_has_the_full_sizes(spark, monkeypatch):
    asked = inspect.signature(model.train_per_role)

    def trained(*args, **named):
        call = asked.bind(*args, **named)
        call.apply_defaults()
        assert call.arguments["sizes"] == model.ModelSizes() and call.arguments["models"] is None
        assert call.arguments["n_skills"] == 10 and call.arguments["folds"] == 5
        assert call.arguments["skills"] == tuple(V.SKILL_PATTERNS) and call.arguments["only"] is None
        sizes = call.arguments["sizes"]
        assert (sizes.forest_trees, sizes.boosting_rounds, sizes.skill_trees) == (100, 100, 50)
        raise InterruptedError

    monkeypatch.setattr(model, "train_per_role", trained)
    for name in ("M4_train_best", "M5_train_per_role"):
        with pytest.raises(InterruptedError):
            CASES[name].run(spark, "/root/testdata/sf0.001")


def test_bags_are_poisson(spark):
    data = spark.range(100_000).selectExpr("id as row", "1 as g", "1.0 as label")
    one = profiles.profiles(data.withColumn("g", F.col("row")), ["g"], trees=3)
    counts = {r[0]: r[1] for r in one.groupBy("w1").count().collect()}
    for n, chance in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert abs(counts[n] / 100_000 - chance) < 0.006
    assert abs(one.stat.corr("w0", "w1")) < 0.02


def test_what_profiles_do_not_say_is_learned_from_rows():
    tried = model.estimators(SIZES)
    assert all(map(profiles.from_sums, tried.values()))
    forest, boosted = tried["Random Forest"], tried["Gradient Boosting"]
    assert not profiles.from_sums(forest.copy({forest.subsamplingRate: 0.5}))
    assert not profiles.from_sums(forest.copy({forest.featureSubsetStrategy: "onethird"}))
    assert not profiles.from_sums(boosted.copy({boosted.lossType: "absolute"}))
    assert not profiles.from_sums(boosted.copy({boosted.minInstancesPerNode: 2})) and not profiles.from_sums(object())


def test_folds_of_the_query_sort_key_and_role_alone(prepared, monkeypatch):
    """W11 stores its rows in order, so it must not carry the other columns along."""
    seen, folds = [], model.contiguous_folds
    monkeypatch.setattr(trends, "silver", lambda spark, sf: prepared)
    monkeypatch.setattr(model, "contiguous_folds", lambda df, *by: seen.append(df.columns) or folds(df, *by))
    out = CASES["W11_contiguous_folds"].run(prepared.sparkSession, "")
    assert seen == [["seq", "role_category"]] and out.count() == prepared.count()
