"""Trends, windows and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.operators import forecast, metrics, model, trends
from vacancia.operators.summaries import Summaries
from vacancia.sources.workspace import materialize, new_path

from .analyze import _as_of, _flags, _q, _round, _top
from .jobs import CASES, FLAGGED, SILVER, SKILLS, case, jobs, on_jobs, on_silver, silver, table, unpivot_skills

_WEEKLY = """weekly as (select cast(date_trunc('week', date_posted) as date) as week, role_category,
 count(*) as count from silver where role_category <> 'Other' group by 1, 2),
dense as (select w.week, r.role_category, coalesce(c.count, 0) as count
 from (select distinct week from weekly) w cross join (select distinct role_category from weekly) r
 left join weekly c on c.week = w.week and c.role_category = r.role_category)"""


@case("J3_densify", f"with {SILVER}, {_WEEKLY} select * from dense")
def _(spark, sf):
    rows = silver(spark, sf).where("role_category <> 'Other'")
    return trends.densify(metrics.period_counts(rows, "role_category", period="week"),
                          "week", "role_category")


@case("W1_share_within_group", """select o_orderpriority, o_orderstatus, count(*) as count,
 round(100e0 * count(*) / sum(count(*)) over (partition by o_orderpriority), 6) as percentage
 from orders group by 1, 2""")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("count"))
    return _round(trends.share_within(counts, "o_orderpriority"), 6, "percentage")


@case("W2_weekly_role_mix", f"""with {SILVER}, {_WEEKLY} select week, role_category, count,
 round(case when sum(count) over (partition by week) > 0
  then 100e0 * count / sum(count) over (partition by week) else 0e0 end, 6) as percentage from dense""")
def _(spark, sf):
    return _round(trends.weekly_role_mix(silver(spark, sf)), 6, "percentage")


_DAILY_TYPES = """select cast(ts as date) as day, event_type, count(*) as count from events group by 1, 2"""


@case("W3_cumulative_per_key", f"""select day, event_type, count, cast(sum(count) over
 (partition by event_type order by day) as bigint) as cum_count from ({_DAILY_TYPES})""")
def _(spark, sf):
    counts = metrics.period_counts(table(spark, sf, "events"), "event_type", "ts")
    return trends.cumulative(counts, "day", by=["event_type"])


@case("W4_cumulative_total", """select day, count, cast(sum(count) over (order by day) as bigint) as cum_count
 from (select cast(ts as date) as day, count(*) as count from events group by 1)""")
def _(spark, sf):
    return trends.cumulative(metrics.daily_counts(table(spark, sf, "events"), "ts"), "day")


def _mix(key: str, posted: str, source: str) -> str:
    return f"""c as (select cast({posted} as date) as day, {key}, count(*) as count from {source}
 where {key} is not null group by 1, 2),
t as (select day, sum(sum(count)) over (order by day) as cum_total from c group by day),
r as (select day, {key}, count, cast(sum(count) over (partition by {key} order by day) as bigint) as cum_count from c)
select day, {key}, count, cum_count, cast(cum_total as bigint) as cum_total,
 round(100e0 * cum_count / cum_total, 6) as percentage from r join t using (day)"""


@case("W5_cumulative_mix", f"with {SILVER}, recent as (select * from silver where date_posted >= "
      "timestamp '1998-01-01'), " + _mix("education_level", "date_posted", "recent"))
def _(spark, sf):
    start = F.lit("1998-01-01").cast("timestamp_ntz")
    return _round(trends.cumulative_mix(silver(spark, sf), start=start), 6, "percentage")


_EVENT_MIX = "with " + _mix("event_type", "ts", "events")


@case("W5_event_mix", _EVENT_MIX)
def _(spark, sf):
    return _round(trends.cumulative_mix(table(spark, sf, "events"), "event_type", "ts"),
                  6, "percentage")


@case("J1_inner_join_on_day", _EVENT_MIX.replace("select day, event_type, count, cum_count",
                                                 "select day, event_type, cum_count").replace(
    "round(100e0 * cum_count / cum_total, 6) as percentage", "count"))
def _(spark, sf):
    events = table(spark, sf, "events")
    counts = metrics.period_counts(events, "event_type", "ts")
    totals = trends.cumulative(metrics.daily_counts(events, "ts"), "day", name="cum_total")
    return trends.cumulative(counts, "day", by=["event_type"]).join(
        totals.select("day", "cum_total"), "day")


_LAST = "(select max(date_posted) from jobs)"
_WEEKS = (f"date_posted >= {_LAST} - interval 7 days",
          f"date_posted >= {_LAST} - interval 14 days and date_posted < {_LAST} - interval 7 days")
_WOW = f"with {FLAGGED}, s as (" + unpivot_skills("flagged", lambda n: f"""
 100e0 * count(*) filter ({_q(n)} and {_WEEKS[0]}) / nullif(count(*) filter ({_WEEKS[0]}), 0) as cur,
 100e0 * count(*) filter ({_q(n)} and {_WEEKS[1]}) / nullif(count(*) filter ({_WEEKS[1]}), 0) as prev""") + """),
c as (select skill, round(cur, 6) as current_pct, round(prev, 6) as previous_pct,
 round(cur - prev, 6) as change from s where cur is not null and prev is not null and (cur > 1 or prev > 1))"""


def _changes(spark, sf):
    return _round(trends.wow_change(_flags(spark, sf), SKILLS, _as_of(spark, sf)), 6,
                  "current_pct", "previous_pct", "change")


@case("W6_wow_change", f"{_WOW} select * from c")
def _(spark, sf):
    return _changes(spark, sf)


@case("W6_top_rising", f"{_WOW} select * from c order by change desc, skill limit 5")
def _(spark, sf):
    return trends.trending(_changes(spark, sf))


@case("W6_top_falling", f"{_WOW} select * from c order by change, skill limit 5")
def _(spark, sf):
    return trends.trending(_changes(spark, sf), rising=False)


_SHARE = """select c.day, title, c.count, total, round(100e0 * c.count / total, 2) as percentage
 from (select cast(date_posted as date) as day, title, count(*) as count from jobs group by 1, 2) c
 left join (select cast(date_posted as date) as day, count(*) as total from jobs group by 1) t on c.day = t.day
 where title in (select title from """


@case("W7_daily_share", on_jobs(f"{_SHARE}{_top('title', 8)})"))
def _(spark, sf):
    return trends.daily_share(jobs(spark, sf))


@case("J2_left_join_on_day", on_jobs(f"{_SHARE}{_top('title', 3)})"))
def _(spark, sf):
    return trends.daily_share(jobs(spark, sf), k=3)


@case("W8_growth_metrics", on_jobs(f"""select t.title, round(100e0 * count(r.title) / m.n, 2) as share,
 round(100e0 * count(r.title) / m.n / 7, 2) as per_day from {_top('title', 8)} t
 left join (select title from jobs where date_posted >= {_LAST} - interval 7 days) r on t.title = r.title
 cross join (select count(*) as n from jobs where date_posted >= {_LAST} - interval 7 days) m
 group by t.title, m.n"""))
def _(spark, sf):
    return trends.growth_metrics(silver(spark, sf), _as_of(spark, sf))


_HISTORY = f"""past as (select title, day, cast(sum(n) over w as bigint) as cumulative,
 cast(datediff('day', min(day) over (partition by title), day) as bigint) as elapsed
 from (select title, cast(date_posted as date) as day, count(*) as n from jobs
  where title in (select title from {_top('title', 5)}) group by 1, 2)
 window w as (partition by title order by day)),
line as (select title, regr_slope(cumulative, elapsed) as slope, regr_intercept(cumulative, elapsed) as icept,
 regr_r2(cumulative, elapsed) as r2, count(*) as days, max(elapsed) as last_elapsed, max(day) as last_day,
 max(cumulative) as current_total from past group by title having count(*) >= 5)"""


@case("W9_elapsed_days", on_jobs("""select title, day,
 cast(datediff('day', min(day) over (partition by title), day) as integer) as elapsed
 from (select distinct title, cast(date_posted as date) as day from jobs where title is not null)"""))
def _(spark, sf):
    days = metrics.period_counts(jobs(spark, sf), "title").drop("count")
    return trends.elapsed_days(days, "title")


_FORECAST = f"""with {{}}, {_HISTORY},
ahead as (select title, last_day + cast(s as integer) as day, icept + slope * (last_elapsed + s) as y
 from line cross join (select unnest(range(1, 31)) as s))
select title, day, round(cast(cumulative as double), 4) as cumulative, cast(null as double) as lower,
 cast(null as double) as upper, 'Historical' as type from past join line using (title)
union all select title, day, round(y, 4), round(y * 0.9, 4), round(y * 1.1, 4), 'Predicted' from ahead"""


def _forecast_sql() -> str:
    from .jobs import JOBS
    return _FORECAST.format(JOBS)


def _forecast(spark, sf):
    return _round(forecast.forecast(jobs(spark, sf)), 4, "cumulative", "lower", "upper")


@case("W10_forecast", _forecast_sql())
def _(spark, sf):
    return _forecast(spark, sf)


@case("U2_tagged_union", f"select type, count(*) as rows from ({_forecast_sql()}) group by type")
def _(spark, sf):
    return _forecast(spark, sf).groupBy("type").agg(F.count("*").alias("rows"))


@case("W10_forecast_summary", _forecast_sql().split("ahead as")[0].rstrip().rstrip(",") + """
select title, current_total, cast(trunc(icept + slope * (last_elapsed + 30)) as bigint) as predicted,
 cast(trunc(icept + slope * (last_elapsed + 30)) as bigint) - current_total as growth,
 round(100e0 * (cast(trunc(icept + slope * (last_elapsed + 30)) as bigint) - current_total) / current_total, 6) as growth_pct,
 round(r2, 6) as r2, days from line""")
def _(spark, sf):
    return _round(forecast.forecast_summary(jobs(spark, sf)), 6, "growth_pct", "r2")


@case("W11_contiguous_folds", on_silver("""select seq, role_category,
 cast(ntile(5) over (partition by role_category order by seq) - 1 as integer) as fold from silver"""))
def _(spark, sf):
    # The rows are stored in their order: only the columns asked for.
    rows = silver(spark, sf).select("seq", "role_category")
    return model.contiguous_folds(rows, "role_category", "seq").select("seq", "role_category", "fold")


@case("W11_shuffled_folds", on_silver("""select seq,
 cast(cast('0x' || substr(md5('42-' || seq), 1, 8) as bigint) % 5 as integer) as fold from silver"""))
def _(spark, sf):
    return silver(spark, sf).select("seq", model.shuffled_folds("seq").alias("fold"))


_KEPT: dict = {}
_BORDER = "timestamp_ntz '1995-01-01'"


def _summaries(spark, sf):
    """Summaries of all postings, kept in two batches: the early years, then the rest and rows without a date."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        kept = Summaries(spark, new_path(spark, "summaries"))
        rows = materialize(silver(spark, sf).select(
            "date_posted", *kept.dimensions, "company", kept.value), "postings")
        early = F.coalesce(F.expr(f"date_posted < {_BORDER}"), F.lit(False))
        for number, part in enumerate((early, ~early)):
            kept.add(rows.where(part), number)
        _KEPT[key] = kept
    return _KEPT[key]


@case("W2_role_mix_of_summaries", CASES["W2_weekly_role_mix"].sql)
def _(spark, sf):
    return _round(trends.role_mix_of(_summaries(spark, sf).period_counts("role_category", "week")), 6, "percentage")


@case("W5_mix_of_summaries", CASES["W5_cumulative_mix"].sql)
def _(spark, sf):
    counts = _summaries(spark, sf).period_counts("education_level").where("day >= date '1998-01-01'")
    return _round(trends.cumulative_mix_of(counts), 6, "percentage")


@case("W7_daily_share_of_summaries", CASES["W7_daily_share"].sql)
def _(spark, sf):
    return trends.daily_share_of(_summaries(spark, sf).period_counts("title", missing=True))


@case("A6_week_counts_of_summaries", CASES["A6_week_role_counts"].sql)
def _(spark, sf):
    return _summaries(spark, sf).period_counts("role_category", "week")


@case("A7_daily_counts_of_summaries", on_silver("""select cast(date_posted as date) as day, count(*) as count
 from silver where date_posted is not null group by 1"""))
def _(spark, sf):
    return _summaries(spark, sf).daily_counts()


@case("A5_mean_pay_of_summaries", on_silver("""select role_category, round(avg(average_salary), 4) as mean from silver
 where role_category is not null group by role_category"""))
def _(spark, sf):
    return _round(_summaries(spark, sf).group_mean("role_category"), 4, "mean")


@case("A21_distinct_of_sketches")
def _(spark, sf):
    return _summaries(spark, sf).distinct_counts()


@case("A13_percentiles_of_sketches")
def _(spark, sf):
    return _summaries(spark, sf).percentiles("role_category")
