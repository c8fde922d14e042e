"""Pay models. Forests have no SQL form; preparation and features do."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vacancia.operators import model
from vacancia.sources.workspace import new_path

from .jobs import SKILLS, case, on_silver, silver, skill, title_years

# Small models, for comparisons; what is trained per role and stored has the full sizes of `ModelSizes()`.
SIZES = model.ModelSizes(forest_trees=10, forest_depth=6, boosting_rounds=4, boosting_depth=3,
                         skill_trees=10, skill_depth=5)
_SKILLS = ("Python", "SQL", "AWS")

_PREPARED = f""", known as (select *, coalesce({title_years()}, cast(years_experience_required as double)) as known
 from silver where average_salary between 30000 and 500000),
prepared as (select *, coalesce(known, (select median(known) from known), 2e0) as years,
 cast(coalesce(is_remote, false) as int) as remote, coalesce(education_level, 'No education') as degree from known)"""


@case("M1_prepare_training", on_silver(f"""{_PREPARED} select seq, role_category, degree as education_level,
 years as years_experience_required, remote as is_remote, col_tier, round(average_salary, 4) as average_salary
 from prepared"""))
def _(spark, sf):
    return model.prepare_training(silver(spark, sf)).select(
        "seq", "role_category", "education_level", "years_experience_required", "is_remote",
        "col_tier", F.round("average_salary", 4).alias("average_salary"))


@case("M2_build_features", on_silver(f"""{_PREPARED} select seq, cast(remote as double) as f0,
 case degree when 'Bachelor''s' then 0e0 when 'Master''s' then 1e0 when 'PhD' then 3e0 else 2e0 end as f1,
 cast(col_tier as double) as f2, years as f3, """ + ", ".join(
    f"cast(cast({skill(s)} as int) as double) as f{i + 4}" for i, s in enumerate(_SKILLS)) + " from prepared"))
def _(spark, sf):
    rows = model.prepare_training(silver(spark, sf))
    data = model.build_features(rows, _SKILLS, keep=["seq"])
    values = data.select("seq", vector_to_array("features").alias("v"))
    return values.select("seq", *[F.get("v", i).alias(f"f{i}") for i in range(4 + len(_SKILLS))])


def _prepared(spark, sf):
    """Prepared rows, written once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _STORED[key] = model.prepared_table(silver(spark, sf), "seq")
    return _STORED[key]


def _trained(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PATHS:
        path = new_path(spark, "models")
        model.train_per_role(_prepared(spark, sf), path, roles_at_once=6)
        _PATHS[key] = path
    return _PATHS[key]


_STORED: dict = {}
_PATHS: dict = {}


@case("M3_select_top_skills")
def _(spark, sf):
    rows = _prepared(spark, sf)
    out = []
    for role in model.trainable_roles(rows):
        top = model.select_top_skills(rows.where(F.col("role_category") == role), SKILLS, 10, SIZES)
        out += [(role, i, s) for i, s in enumerate(top)]
    return spark.createDataFrame(out, "role string, position int, skill string")


@case("M4_train_best")
def _(spark, sf):
    rows = model.load_registry(spark, _trained(spark, sf))
    tried = rows.select("role", "model_name", "r2", F.inline("cv_scores"))
    chosen = F.col("model") == F.col("model_name")
    return tried.select("role", "model", "mean_r2", "std_r2", chosen.alias("chosen"),
                        F.when(chosen, F.col("r2")).alias("r2"))


@case("M5_train_per_role")
def _(spark, sf):
    return model.load_registry(spark, _trained(spark, sf)).select(
        "role", "model_name", "r2", "mae", "rmse", "n_rows")


@case("S7_model_save_load")
def _(spark, sf):
    models = model.load_models(spark, _trained(spark, sf))
    return spark.createDataFrame(
        [(role, row["model_name"], type(m.stages[-1]).__name__) for role, (row, m) in models.items()],
        "role string, model_name string, kind string")


@case("M6_predict_batch")
def _(spark, sf):
    models = model.load_models(spark, _trained(spark, sf))
    return model.predict_batch(_prepared(spark, sf), models)


@case("M7_feature_importance")
def _(spark, sf):
    return model.feature_importance(spark, model.load_models(spark, _trained(spark, sf)))


@case("M8_model_report")
def _(spark, sf):
    report = model.model_report(model.load_registry(spark, _trained(spark, sf)))
    return report.withColumn("top_skills", F.concat_ws("|", "top_skills"))


@case("M8_top_skills")
def _(spark, sf):
    return model.top_skills(model.load_registry(spark, _trained(spark, sf)), "Data Scientist")


@case("M9_compare_models")
def _(spark, sf):
    return model.compare_models(_prepared(spark, sf), n_skills=5, sizes=SIZES, roles_at_once=6)


@case("M9_log_target_capped_years")
def _(spark, sf):
    return model.compare_models(_prepared(spark, sf), n_skills=5, sizes=SIZES, log_target=True,
                                cap_years=25.0, roles_at_once=6)


@case("M8_all_skills")
def _(spark, sf):
    return model.all_skills(model.load_registry(spark, _trained(spark, sf)), "Data Scientist")


# The same jobs with a linear model of pay on years alone, which SQL can fit too.
_ONE = {"skills": (), "only": ("years_experience",), "roles_at_once": 6}
_LINES = f"""{_PREPARED},
roles as (select role_category as role from prepared where role_category <> 'Other'
 group by role_category having count(*) >= {{0}}),
points as (select role, seq, years, average_salary as pay, {{1}} as fold from prepared join roles on role = role_category),
fits as (select role, k, coalesce(regr_slope(pay, years) filter (fold <> k), 0) as slope,
 coalesce(regr_intercept(pay, years) filter (fold <> k), avg(pay) filter (fold <> k)) as start
 from points, (select unnest(range(6)) as k) group by role, k),
scores as (select role, k,
 1 - avg((pay - slope * years - start) ** 2) filter (fold = k) / var_pop(pay) filter (fold = k) as test,
 1 - avg((pay - slope * years - start) ** 2) filter (fold <> k) / var_pop(pay) filter (fold <> k) as train,
 avg(abs(pay - slope * years - start)) filter (fold <> k) as mae,
 sqrt(avg((pay - slope * years - start) ** 2) filter (fold <> k)) as rmse, count(*) as n
 from points join fits using (role) group by role, k)"""
# Fold 5 does not exist: the line of k = 5 is fitted on all rows.
_BY_PLACE = _LINES.format(15, "ntile(5) over (partition by role order by seq) - 1")
_BY_HASH = _LINES.format(20, "cast('0x' || substr(md5('42-' || seq), 1, 8) as bigint) % 5")


def _lines(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "lines")
    if key not in _PATHS:
        path = new_path(spark, "lines")
        model.train_per_role(_prepared(spark, sf), path, models=_linear(), **_ONE)
        _PATHS[key] = path
    return _PATHS[key]


def _linear():
    return {"Linear Regression": model.estimators()["Linear Regression"]}


@case("M4_linear_fold_scores", on_silver(f"""{_BY_PLACE}
select role, 'Linear Regression' as model, round(avg(test) filter (k < 5), 6) as mean_r2,
 round(stddev_pop(test) filter (k < 5), 6) as std_r2 from scores group by role"""))
def _(spark, sf):
    rows = model.load_registry(spark, _lines(spark, sf)).select("role", F.inline("cv_scores"))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_r2", "std_r2")})


@case("M5_linear_per_role", on_silver(f"""{_BY_PLACE}
select role, 'Linear Regression' as model_name, round(train, 6) as r2, round(mae, 4) as mae, round(rmse, 4) as rmse,
 n as n_rows from scores where k = 5"""))
def _(spark, sf):
    return model.load_registry(spark, _lines(spark, sf)).select(
        "role", "model_name", F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"),
        F.round("rmse", 4).alias("rmse"), "n_rows")


@case("M6_linear_predictions", on_silver(f"""{_BY_PLACE}
select p.seq, role_category, round(slope * p.years + start, 3) as predicted_salary,
 round(slope * p.years + start - mae, 3) as lower_bound, round(slope * p.years + start + mae, 3) as upper_bound
from prepared p left join (select * from fits join scores using (role, k) where k = 5) f on f.role = role_category"""))
def _(spark, sf):
    out = model.predict_batch(_prepared(spark, sf), model.load_models(spark, _lines(spark, sf)))
    return out.select("seq", "role_category", *[F.round(c, 3).alias(c) for c in (
        "predicted_salary", "lower_bound", "upper_bound")])


@case("M7_linear_importance", on_silver(f"""{_BY_PLACE}
select role, 'years_experience' as feature, round(abs(slope), 4) as importance from fits where k = 5"""))
def _(spark, sf):
    rows = model.feature_importance(spark, model.load_models(spark, _lines(spark, sf)))
    return rows.withColumn("importance", F.round("importance", 4))


@case("S7_linear_save_load", on_silver(f"""{_BY_PLACE}
select role, 'Linear Regression' as model_name, 'LinearRegressionModel' as kind, round(slope, 4) as slope,
 round(start, 3) as start from fits where k = 5"""))
def _(spark, sf):
    models = model.load_models(spark, _lines(spark, sf))
    return spark.createDataFrame(
        [(role, row["model_name"], type(m.stages[-1]).__name__, round(float(m.stages[-1].coefficients[0]), 4),
          round(float(m.stages[-1].intercept), 3)) for role, (row, m) in models.items()],
        "role string, model_name string, kind string, slope double, start double")


@case("M8_linear_report", on_silver(f"""{_BY_PLACE}
select role, 'Linear Regression' as model, true as chosen, 1 as n_features, round(any_value(train) filter (k = 5), 6) as r2,
 round(avg(test) filter (k < 5), 6) as mean_r2 from scores group by role"""))
def _(spark, sf):
    report = model.model_report(model.load_registry(spark, _lines(spark, sf)))
    return report.select("role", "model", "chosen", "n_features", F.round("r2", 6).alias("r2"),
                         F.round("mean_r2", 6).alias("mean_r2"))


@case("M9_linear_compare", on_silver(f"""{_BY_HASH}
select role, 'Linear Regression' as model, round(avg(test) filter (k < 5), 6) as mean_r2,
 round(stddev_pop(test) filter (k < 5), 6) as std_r2, round(avg(train) filter (k < 5), 6) as train_r2, 'trained' as status
from scores group by role"""))
def _(spark, sf):
    rows = model.compare_models(_prepared(spark, sf), models=_linear(), **_ONE)
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_r2", "std_r2", "train_r2")})
