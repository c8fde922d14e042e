"""Filters, metrics, statistics and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.functions.pay import in_pay_range
from vacancia.operators import compare, filters, metrics, stats
from vacancia.operators.filters import FilterSpec

from .jobs import (FLAGGED, LAST, SILVER, SKILLS, case, jobs, on_jobs, on_silver, quoted, silver,
                   table, unpivot_skills)

_SPEC = FilterSpec(state="CA", job_type="fulltime", remote_only=False, education="Master's",
                   experience="Mid-Level (3-5 yrs)", role="All")
_SPEC_SQL = """(state = 'CA' and job_type_norm = 'fulltime' and education_level = 'Master''s'
 and years_experience_required between 3 and 5)"""
_REMOTE = FilterSpec(remote_only=True, experience="Entry Level (0-2 yrs)")
_REMOTE_SQL = "(is_remote and years_experience_required <= 2)"


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@case("F1_apply_filters", on_silver(f"select seq, state, education_level from silver where {_SPEC_SQL}"))
def _(spark, sf):
    return filters.apply_filters(silver(spark, sf), _SPEC).select(
        "seq", "state", "education_level")


@case("F1_remote_role", on_silver("""select seq, title from silver where is_remote and state = 'TX'
 and role_category = 'Data Analyst'"""))
def _(spark, sf):
    spec = FilterSpec(state="TX", remote_only=True, role="Data Analyst")
    return filters.apply_filters(silver(spark, sf), spec).select("seq", "title")


@case("F2_experience_bands", on_silver("""select 'New Grad (0 yrs)' as band, seq from silver
  where years_experience_required = 0 union all
 select 'Entry Level (0-2 yrs)', seq from silver where years_experience_required <= 2 union all
 select 'Mid-Level (3-5 yrs)', seq from silver where years_experience_required between 3 and 5"""))
def _(spark, sf):
    rows = silver(spark, sf)
    hits = F.array_compact(F.array(*[
        F.when(filters.experience_band("years_experience_required", b), F.lit(b))
        for b in filters.EXPERIENCE_BANDS]))
    return rows.select(F.explode(hits).alias("band"), "seq")


@case("F3_pay_range", on_silver("""select seq, round(average_salary, 4) as average_salary from silver
 where average_salary between 100000 and 150000"""))
def _(spark, sf):
    rows = silver(spark, sf).where(in_pay_range("average_salary", (100000.0, 150000.0)))
    return _round(rows.select("seq", "average_salary"), 4, "average_salary")


_LAST_DAY = "(select max(date_posted) from jobs)"


def _as_of(spark, sf):
    return table(spark, sf, "orders").agg(F.max("o_orderdate")).scalar()


@case("F4_recency", on_jobs(f"""select seq, 30 as days from jobs where date_posted >= {_LAST_DAY} - interval 30 days
 union all select seq, 14 from jobs where date_posted >= {_LAST_DAY} - interval 14 days
  and date_posted < {_LAST_DAY} - interval 7 days"""))
def _(spark, sf):
    rows, now = silver(spark, sf), _as_of(spark, sf)
    return filters.recent_rows(rows, "date_posted", now, 30).select("seq", F.lit(30).alias("days")).union(
        filters.recent_rows(rows, "date_posted", now, 14, skip=7).select("seq", F.lit(14)))


@case("F5_drop_missing", on_jobs("select seq from jobs where title is not null and is_remote is not null"))
def _(spark, sf):
    return filters.drop_missing(jobs(spark, sf), ["title", "is_remote"]).select("seq")


@case("F6_exclude_value", on_silver("select seq, role_category from silver where role_category <> 'Other'"))
def _(spark, sf):
    return filters.exclude_value(silver(spark, sf), "role_category", "Other").select(
        "seq", "role_category")


def _top(column: str, k: int, source: str = "jobs") -> str:
    return f"""(select {column}, count(*) as count from {source} where {column} is not null
 group by {column} order by count desc, {column} limit {k})"""


_IN_TOP = on_jobs(f"select seq, title from jobs where title in (select title from {_top('title', 3)})")


@case("F7_in_top", _IN_TOP)
def _(spark, sf):
    return filters.in_top(jobs(spark, sf), "title", 3).select("seq", "title")


@case("J5_semi_join", _IN_TOP)
def _(spark, sf):
    rows = jobs(spark, sf)
    top = F.broadcast(metrics.top_counts(rows, "title", 3).select("title"))
    return rows.join(top, "title", "left_semi").select("seq", "title")


@case("F8_min_support", on_jobs("""select company, count(*) as count from jobs group by company
 having count(*) >= 15"""))
def _(spark, sf):
    counts = metrics.value_counts(jobs(spark, sf), "company")
    return filters.min_support(counts, "count", 15)


@case("F9_options", on_silver("select distinct state from silver where state is not null"))
def _(spark, sf):
    return filters.options(silver(spark, sf), "state")


@case("U3_distinct", on_silver("""select distinct role_category, state from silver"""))
def _(spark, sf):
    return silver(spark, sf).select("role_category", "state").distinct()


@case("A1_summary_stats", on_silver("""select count(*) as total_jobs, count(distinct company) as unique_companies,
 round(avg(average_salary), 4) as avg_salary, round(median(average_salary), 4) as median_salary,
 count(average_salary) as jobs_with_salary, count(*) filter (is_remote) as remote_jobs from silver"""))
def _(spark, sf):
    return _round(metrics.summary_stats(silver(spark, sf)), 4, "avg_salary", "median_salary")


@case("A2_kpis", on_silver(f"""select count(*) filter ({_REMOTE_SQL}) as jobs,
 round(100e0 * count(*) filter ({_REMOTE_SQL}) / count(*), 6) as pct_of_total,
 count(distinct company) filter ({_REMOTE_SQL}) as unique_companies,
 round(avg(average_salary) filter ({_REMOTE_SQL}), 4) as avg_salary, 100e0 as remote_pct from silver"""))
def _(spark, sf):
    out = metrics.kpis(silver(spark, sf), _REMOTE)
    return _round(_round(out, 4, "avg_salary"), 6, "pct_of_total")


_JUNIOR_SQL = "(years_experience_required <= 2)"


@case("A2_kpis_by_experience", on_silver(f"""select count(*) filter ({_JUNIOR_SQL}) as jobs,
 round(100e0 * count(*) filter ({_JUNIOR_SQL}) / count(*), 6) as pct_of_total,
 count(distinct company) filter ({_JUNIOR_SQL}) as unique_companies,
 round(avg(average_salary) filter ({_JUNIOR_SQL}), 4) as avg_salary,
 round(100e0 * count(*) filter ({_JUNIOR_SQL} and is_remote) / count(*) filter ({_JUNIOR_SQL}), 6) as remote_pct
 from silver"""))
def _(spark, sf):
    out = metrics.kpis(silver(spark, sf), FilterSpec(experience="Entry Level (0-2 yrs)"))
    return _round(_round(out, 4, "avg_salary"), 6, "pct_of_total", "remote_pct")


for _name, _column, _k in (("location", "location", 10), ("company", "company", 10),
                           ("title", "title", 15)):
    @case(f"A3_top_{_name}_share", on_jobs(f"""select {_column}, count,
 round(count * 100e0 / (select count(*) from jobs), 2) as share from {_top(_column, _k)}"""))
    def _(spark, sf, column=_column, k=_k):
        return metrics.top_share(jobs(spark, sf), column, k)


@case("A4_top_companies", on_jobs(f"select * from {_top('company', 5)}"))
def _(spark, sf):
    return metrics.top_counts(jobs(spark, sf), "company", 5)


@case("O1_top_k", "select o_custkey, count(*) as count from orders group by o_custkey "
      "order by count desc, o_custkey limit 20")
def _(spark, sf):
    return metrics.top_counts(table(spark, sf, "orders"), "o_custkey", 20)


@case("A5_mean_pay_by_role", on_silver("""select role_category, round(avg(average_salary), 4) as mean from silver
 where average_salary between 30000 and 500000 group by role_category"""))
def _(spark, sf):
    rows = silver(spark, sf).where(in_pay_range("average_salary"))
    return _round(metrics.group_mean(rows, "role_category", "average_salary"), 4, "mean")


@case("O2_sorted_means", """select o_orderpriority, round(avg(o_totalprice), 4) as mean from orders
 group by o_orderpriority order by mean desc""")
def _(spark, sf):
    return _round(metrics.group_mean(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"),
                  4, "mean")


@case("A6_week_role_counts", on_silver("""select cast(date_trunc('week', date_posted) as date) as week, role_category,
 count(*) as count from silver group by 1, 2"""))
def _(spark, sf):
    return metrics.period_counts(silver(spark, sf), "role_category", period="week")


@case("A6_day_title_counts", on_jobs("""select cast(date_posted as date) as day, title, count(*) as count from jobs
 where title is not null group by 1, 2"""))
def _(spark, sf):
    return metrics.period_counts(jobs(spark, sf), "title")


@case("A7_daily_counts", "select cast(ts as date) as day, count(*) as count from events group by 1")
def _(spark, sf):
    return metrics.daily_counts(table(spark, sf, "events"), "ts")


_VOLUME = on_jobs("""select day, count, avg(count) over () as mean from (select cast(date_posted as date) as day,
 count(*) as count from jobs group by 1 order by day desc limit 7)""")


@case("A8_recent_daily_volume", _VOLUME)
def _(spark, sf):
    return metrics.recent_daily_volume(jobs(spark, sf))


@case("O5_last_days", "select cast(ts as date) as day, count(*) as count from events group by 1 "
      "order by day desc limit 7")
def _(spark, sf):
    return metrics.recent_daily_volume(table(spark, sf, "events"), 7, "ts").drop("mean")


def _flags(spark, sf):
    return metrics.skill_flags(silver(spark, sf), SKILLS)


def _q(name: str) -> str:
    return f'"{name}"'


_SHARES = unpivot_skills("flagged", lambda n: f"""cast(count(*) filter ({_q(n)}) as bigint) as jobs,
 100e0 * count(*) filter ({_q(n)}) / count(*) as share""")


@case("A9_skill_share_from_text", f"""with {FLAGGED} select skill, jobs, round(share, 6) as share
 from ({_SHARES}) order by share desc, skill limit 10""")
def _(spark, sf):
    flags = metrics.skill_flag_columns(jobs(spark, sf, text=True))
    return _round(metrics.skill_share(flags, SKILLS, 10), 6, "share")


@case("A9_skill_share", f"""with {FLAGGED} select skill, jobs, round(share, 6) as share
 from ({_SHARES}) order by share desc, skill limit 15""")
def _(spark, sf):
    return _round(metrics.skill_share(_flags(spark, sf), SKILLS, 15), 6, "share")


@case("A10_state_stats", on_silver(f"""select state, count(*) as count, round(avg(average_salary), 4) as mean,
 round(stddev_samp(average_salary), 4) as std from (select average_salary, {LAST} as state from silver)
 where state is not null and average_salary between 30000 and 500000
 group by state order by count desc, state limit 5"""))
def _(spark, sf):
    from vacancia.functions.rules import state_raw
    rows = silver(spark, sf).where(in_pay_range("average_salary")).withColumn(
        "state", state_raw("location"))
    return _round(stats.group_stats(rows, "state", "average_salary", 5), 4, "mean", "std")


def _profile(source: str, by: str, value: str) -> str:
    return f"""select {by}, count({value}) as n, round(min({value}), 4) as min, round(max({value}), 4) as max,
 round(avg({value}), 4) as mean, round(median({value}), 4) as median, round(stddev_samp({value}), 4) as std,
 round(stddev_samp({value}) / avg({value}) * 100, 6) as cv_pct
 from {source} where {value} is not null group by {by}"""


def _rounded_profile(df):
    return _round(_round(df, 4, "min", "max", "mean", "median", "std"), 6, "cv_pct")


@case("A11_pay_profile", on_silver(_profile("silver", "role_category", "average_salary")))
def _(spark, sf):
    return _rounded_profile(stats.profile(silver(spark, sf), "average_salary", ["role_category"]))


@case("A11_price_profile", _profile("orders", "o_orderpriority", "o_totalprice"))
def _(spark, sf):
    return _rounded_profile(stats.profile(table(spark, sf, "orders"), "o_totalprice",
                                          ["o_orderpriority"]))


@case("A12_describe", """select count(*) as count, round(avg(l_extendedprice), 4) as mean,
 round(stddev_samp(l_extendedprice), 4) as std, min(l_extendedprice) as min, max(l_extendedprice) as max,
 round(quantile_cont(l_extendedprice, 0.25), 4) as p25, round(quantile_cont(l_extendedprice, 0.5), 4) as p50,
 round(quantile_cont(l_extendedprice, 0.75), 4) as p75 from lineitem""")
def _(spark, sf):
    out = stats.describe(table(spark, sf, "lineitem"), "l_extendedprice")
    return _round(out, 4, "mean", "std", "p25", "p50", "p75")


def _points(by: str, value: str, source: str) -> str:
    return (f"select {by}, " + ", ".join(
        f"round(quantile_cont({value}, {p / 100}), 6) as p{p}" for p in (10, 25, 50, 75, 90)) +
        f" from {source} where {value} is not null group by {by}")


def _rounded_points(df):
    return _round(df, 6, "p10", "p25", "p50", "p75", "p90")


@case("A13_pay_percentiles", on_silver(_points("role_category", "average_salary", "silver")))
def _(spark, sf):
    return _rounded_points(stats.percentiles(silver(spark, sf), "average_salary", ["role_category"]))


@case("A13_price_percentiles", _points("l_returnflag", "l_extendedprice", "lineitem"))
def _(spark, sf):
    return _rounded_points(stats.percentiles(table(spark, sf, "lineitem"), "l_extendedprice",
                                             ["l_returnflag"]))


@case("A14_iqr_outliers", """with q as (select event_type, quantile_cont(value, 0.25) as q1,
 quantile_cont(value, 0.75) as q3 from events group by 1)
select event_type, count(value) as n, count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as outliers,
 round(100e0 * count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) / count(value), 6) as outlier_pct
from events join q using (event_type) group by 1""")
def _(spark, sf):
    return _round(stats.iqr_outliers(table(spark, sf, "events"), "value", ["event_type"]),
                  6, "outlier_pct")


@case("A15_skewness", """select event_type, round(skewness(value), 6) as skewness from events group by 1""")
def _(spark, sf):
    return _round(stats.skewness_by(table(spark, sf, "events"), "value", ["event_type"]), 6, "skewness")


@case("A16_pay_correlations", on_silver("""select role_category,
 round(corr(average_salary, years_experience_required), 6) as corr_years_experience_required,
 round(corr(average_salary, cast(is_remote as int)), 6) as corr_is_remote from silver group by 1"""))
def _(spark, sf):
    rows = silver(spark, sf).withColumn("is_remote", F.col("is_remote").cast("int"))
    others = ["years_experience_required", "is_remote"]
    out = stats.correlations(rows, "average_salary", others, ["role_category"])
    return _round(out, 6, *[f"corr_{o}" for o in others])


@case("A16_item_correlations", """select l_linestatus, round(corr(l_extendedprice, l_quantity), 6) as corr_l_quantity,
 round(corr(l_extendedprice, l_discount), 6) as corr_l_discount from lineitem group by 1""")
def _(spark, sf):
    others = ["l_quantity", "l_discount"]
    out = stats.correlations(table(spark, sf, "lineitem"), "l_extendedprice", others, ["l_linestatus"])
    return _round(out, 6, *[f"corr_{o}" for o in others])


_CORRS = unpivot_skills("flagged", lambda n: f"corr(average_salary, cast({_q(n)} as int)) as corr")


@case("A17_skill_correlations", f"""with {FLAGGED} select skill, round(corr, 6) as corr from ({_CORRS})
 where corr is not null and not isnan(corr) order by abs(corr) desc, skill limit 5""")
def _(spark, sf):
    return _round(stats.flag_correlations(_flags(spark, sf), "average_salary", SKILLS), 6, "corr")


@case("A18_null_audit", on_silver("""select count(*) filter (average_salary < 90000) as below_range,
 count(*) filter (average_salary > 150000) as above_range,
 count(years_experience_required) as with_experience,
 count(*) filter (years_experience_required is null) as missing_experience,
 round(avg(case when education_level = 'No education' then 1e0 else 0e0 end), 6) as share_no_degree,
 round(avg(case when is_remote then 1e0 else 0e0 end) * 100, 6) as remote_pct
from (select * replace (coalesce(education_level, 'No education') as education_level) from silver)"""))
def _(spark, sf):
    rows = silver(spark, sf).fillna("No education", ["education_level"])
    return _round(stats.null_audit(rows, bounds=(90000, 150000)), 6, "share_no_degree", "remote_pct")


@case("A19_degree_distribution", on_silver(
    "select education_level, count(*) as count from silver group by 1"))
def _(spark, sf):
    return metrics.value_counts(silver(spark, sf), "education_level", missing=True)


def _bins(source: str, value: str, bins: int, extra: str = "") -> str:
    return f"""select cast(b.bin as integer) as bin, round(lo + b.bin * w, 4) as bin_start, count(x) as count{extra} from
 (select unnest(range({bins})) as bin) b
 cross join (select min({value}) as lo, (max({value}) - min({value})) / {bins} as w from {source}) e
 left join (select {value} as x from {source} where {value} is not null) r
  on b.bin = least(cast(floor((x - lo) / w) as bigint), {bins - 1}) group by b.bin, lo, w"""


@case("A20_pay_histogram", on_silver(_bins("silver", "average_salary", 30)))
def _(spark, sf):
    return _round(stats.histogram(silver(spark, sf), "average_salary", 30), 4, "bin_start")


@case("A20_price_histogram", _bins("orders", "o_totalprice", 20))
def _(spark, sf):
    return _round(stats.histogram(table(spark, sf, "orders"), "o_totalprice", 20), 4, "bin_start")


@case("A21_distinct_counts", on_jobs("""select count(distinct title) as title_distinct,
 count(distinct company) as company_distinct, count(distinct location) as location_distinct from jobs"""))
def _(spark, sf):
    return metrics.distinct_counts(jobs(spark, sf), ["title", "company", "location"])


@case("A22_window_volume", on_jobs(f"""select count(*) as jobs, count(distinct title) as unique_titles,
 count(*) / 30e0 as jobs_per_day from jobs where date_posted >= {_LAST_DAY} - interval 30 days"""))
def _(spark, sf):
    return metrics.window_volume(silver(spark, sf), _as_of(spark, sf))


_SETS = {"A": _SPEC_SQL.replace("and education_level = 'Master''s'", "").replace(
    "and job_type_norm = 'fulltime'", ""), "B": _REMOTE_SQL}
_SET_A = FilterSpec(state="CA", experience="Mid-Level (3-5 yrs)")


def _measure(metric: str, text: str, digits: int = 4) -> str:
    a, b = (text.replace("#", s) for s in _SETS.values())
    return (f"select {quoted(metric)} as metric, round({a}, {digits}) as a, round({b}, {digits}) as b,"
            f" round({b} - {a}, {digits}) as delta from silver")


@case("A23_compare_kpis", on_silver(" union all ".join([
    _measure("total_jobs", "cast(count(*) filter (#) as double)"),
    _measure("unique_companies", "cast(count(distinct company) filter (#) as double)"),
    _measure("avg_salary", "avg(average_salary) filter (#)"),
    _measure("remote_pct", "(100e0 * count(*) filter (# and is_remote) / count(*) filter (#))")])))
def _(spark, sf):
    out = compare.compare_kpis(silver(spark, sf), _SET_A, _REMOTE)
    return _round(out, 4, "a", "b", "delta")


@case("A23_compare_companies", on_silver(" union all ".join(
    f"""(select '{s}' as set, company, count(*) as count from silver where {p}
 group by company order by count desc, company limit 5)""" for s, p in _SETS.items())))
def _(spark, sf):
    return compare.compare_top(silver(spark, sf), _SET_A, _REMOTE)


@case("A23_compare_skills", f"with {FLAGGED} " + " union all ".join(
    f"""(select '{s}' as set, skill, round(share, 6) as share from (""" + unpivot_skills(
        f"flagged where {p}", lambda n: f"100e0 * count(*) filter ({_q(n)}) / count(*) as share") +
    ") order by share desc, skill limit 10)" for s, p in _SETS.items()))
def _(spark, sf):
    return _round(compare.compare_skills(_flags(spark, sf), SKILLS, _SET_A, _REMOTE), 6, "share")


@case("A23_compare_histogram", f"with {SILVER}, " + ", ".join(
    f"set_{s} as (select average_salary from silver where {p})" for s, p in _SETS.items()) +
    " " + " union all ".join(_bins(f"set_{s}", "average_salary", 20, f", '{s}' as set")
                             for s in _SETS))
def _(spark, sf):
    out = compare.compare_histogram(silver(spark, sf), _SET_A, _REMOTE)
    return _round(out, 4, "bin_start")
