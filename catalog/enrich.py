"""Scalar enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.functions import fixed_values as V
from vacancia.functions import pay, rules, text as T
from vacancia.operators import matching
from vacancia.operators.model import fill_defaults, resolve_experience
from vacancia.plans.enrich import add_pay, add_skills, lower_once

from .jobs import (DEFAULT, FACTOR, FLAGS, LAST, ROLE, SKILLS, STATE, STRICT, TIER, TYPE, YEARS, case,
                   jobs, on_jobs, on_silver, silver, skill, skill_list, table,
                   title_years)


@case("P1_annualize", on_jobs(f"""select seq, round(min_amount * {FACTOR}, 4) as annual_min,
 round(max_amount * {FACTOR}, 4) as annual_max from jobs"""))
def _(spark, sf):
    low, high = pay.annualize("min_amount", "max_amount", "pay_interval")
    return jobs(spark, sf).select("seq", F.round(low, 4).alias("annual_min"),
                                  F.round(high, 4).alias("annual_max"))


@case("P2_average_salary", on_jobs(f"""select seq,
 round((min_amount * {FACTOR} + max_amount * {FACTOR}) / 2, 4) as average_salary from jobs"""))
def _(spark, sf):
    return add_pay(jobs(spark, sf), "pay_interval").select(
        "seq", F.round("average_salary", 4).alias("average_salary"))


@case("P3_keyword_flags", on_jobs("select seq, " + ", ".join(
    f'cast({skill(n)} as int) as "skill_{n}"' for n in SKILLS) + " from jobs"))
def _(spark, sf):
    rows = add_skills(jobs(spark, sf, text=True).select("seq", "description"), flags=True)
    return rows.drop("description")


@case("P3_keyword_list", on_jobs(
    f"select seq, array_to_string({skill_list()}, '|') as skills from jobs"))
def _(spark, sf):
    return add_skills(jobs(spark, sf, text=True)).select(
        "seq", F.concat_ws("|", "skills").alias("skills"))


@case("P3_documents", "with d as (select doc_id, lower(text) as low from documents) "
      f"select doc_id, array_to_string({skill_list('low')}, '|') as skills from d")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.lower("text").alias("low"))
    return docs.select("doc_id", F.concat_ws("|", T.keyword_list("low", V.SKILL_PATTERNS))
                       .alias("skills"))


@case("P4_extract_years", on_jobs(f"select seq, {YEARS} as years from jobs"))
def _(spark, sf):
    rows = lower_once(jobs(spark, sf, text=True), "description", "low")
    return rows.select("seq", rules.extract_years("low", lowered=True).alias("years"))


@case("P5_degree_strict", on_jobs(f"select seq, {STRICT} as degree from jobs"))
def _(spark, sf):
    rows = lower_once(jobs(spark, sf, text=True), "description", "low")
    return rows.select("seq", rules.degree_strict("low", lowered=True).alias("degree"))


@case("P6_degree_default", on_jobs(
    f"select seq, case when description is not null then {DEFAULT} end as degree from jobs"))
def _(spark, sf):
    rows = lower_once(jobs(spark, sf, text=True), "description", "low")
    return rows.select("seq", rules.degree_default("low", lowered=True).alias("degree"))


@case("P7_degree_source", on_jobs(f"select seq, {STRICT} as education_level from jobs"))
def _(spark, sf):
    rows = jobs(spark, sf, text=True).withColumnRenamed("description", "job_description")
    source = rules.first_col(rows, V.TEXT_ALIASES)
    return rows.select("seq", rules.degree_strict(source).alias("education_level"))


@case("P8_role_category", on_jobs(f"select seq, {ROLE} as role_category from jobs"))
def _(spark, sf):
    return jobs(spark, sf).select("seq", rules.role_category("title").alias("role_category"))


@case("P9_job_type_norm", on_jobs(f"select seq, {TYPE} as job_type_norm from jobs"))
def _(spark, sf):
    return jobs(spark, sf).select("seq", rules.job_type_norm("job_type").alias("job_type_norm"))


@case("P10_state_code", on_jobs(f"select seq, {STATE} as state from jobs"))
def _(spark, sf):
    return jobs(spark, sf).select("seq", rules.state_code("location").alias("state"))


@case("P11_state_raw", on_jobs(f"select seq, {LAST} as state from jobs"))
def _(spark, sf):
    return jobs(spark, sf).select("seq", rules.state_raw("location").alias("state"))


@case("P12_cost_tier", on_jobs(f"select seq, {TIER} as col_tier from jobs"))
def _(spark, sf):
    return jobs(spark, sf).select("seq", rules.cost_tier("location").alias("col_tier"))


@case("P13_years_from_title", on_jobs(f"select seq, {title_years()} as years from jobs"))
def _(spark, sf):
    return jobs(spark, sf).select("seq", rules.years_from_title("title").alias("years"))


@case("P14_resolve_experience", on_silver(f"""
, paid_rows as (select *, coalesce({title_years()}, cast(years_experience_required as double)) as known
 from silver where average_salary between 30000 and 500000)
select seq, coalesce(known, (select quantile_cont(known, 0.5) from paid_rows), 2.0e0) as years
from paid_rows"""))
def _(spark, sf):
    rows = silver(spark, sf).where(pay.in_pay_range("average_salary"))
    return resolve_experience(rows).select(
        "seq", F.col("years_experience_required").alias("years"))


@case("P15_fill_defaults", on_silver("""select seq, cast(coalesce(is_remote, false) as int) as is_remote,
 coalesce(education_level, 'No education') as education_level, role_category, col_tier from silver"""))
def _(spark, sf):
    return fill_defaults(silver(spark, sf)).select(
        "seq", "is_remote", "education_level", "role_category", "col_tier")


@case("P16_encode_label", on_silver("""select seq, case education_level when 'Bachelor''s' then 0
 when 'Master''s' then 1 when 'PhD' then 3 else 2 end as code from silver"""))
def _(spark, sf):
    return silver(spark, sf).select(
        "seq", rules.encode_label("education_level").alias("code"))


@case("P17_safe_casts", """with t as (select o_orderkey as seq,
 case when o_orderkey % 5 = 0 then 'soon' else cast(o_orderdate as string) end as posted,
 case when o_orderkey % 4 = 0 then 'n/a' else cast(o_totalprice as string) end as price from orders)
select seq, cast(try_cast(posted as timestamp) as date) as day, try_cast(price as double) as price from t""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.expr("case when o_orderkey % 5 = 0 then 'soon' else cast(o_orderdate as string) end").alias("posted"),
        F.expr("case when o_orderkey % 4 = 0 then 'n/a' else cast(o_totalprice as string) end").alias("price"))
    return rows.select("seq", F.to_date(pay.to_time("posted")).alias("day"),
                       pay.to_number("price").alias("price"))


@case("P18_clip_and_log", on_silver("""select seq, least(years_experience_required, 4) as capped,
 round(ln(1 + average_salary), 8) as log_pay from silver""".replace(
    "least(years_experience_required, 4)",
    "case when years_experience_required is not null then least(years_experience_required, 4) end")))
def _(spark, sf):
    return silver(spark, sf).select(
        "seq", pay.clip_upper("years_experience_required", 4).alias("capped"),
        F.round(F.log1p("average_salary"), 8).alias("log_pay"))


@case("P19_truncate", on_jobs("select seq, substring(coalesce(description, ''), 1, 200) as snippet from jobs"))
def _(spark, sf):
    return jobs(spark, sf, text=True).select("seq", T.truncate("description").alias("snippet"))


@case("P20_flags_to_list", on_jobs(
    f"select seq, array_to_string(({skill_list()})[1:2], '|') as skills from jobs"))
def _(spark, sf):
    rows = add_skills(jobs(spark, sf, text=True).select("seq", "description"), flags=True)
    return rows.select("seq", F.concat_ws("|", rules.flags_to_list(rows, limit=2)).alias("skills"))


@case("P21_prefix_columns", on_jobs("select seq, " + ", ".join(
    f'cast({skill(n)} as int) as "{n}"' for n in SKILLS) + " from jobs"))
def _(spark, sf):
    rows = add_skills(jobs(spark, sf, text=True).select("seq", "description"), flags=True)
    return rows.select("seq", *[F.col(f"`{c}`").alias(n)
                                for c, n in rules.prefixed(rows, "skill_").items()])


@case("P22_percent", """select o_custkey, round(100e0 * sum(case when o_totalprice > 250000 then 1 else 0 end)
 / count(*), 2) as pct from orders group by o_custkey""")
def _(spark, sf):
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_totalprice") > 250000).alias("part"), F.count("*").alias("whole"))
    return sums.select("o_custkey", pay.percent("part", "whole", 2).alias("pct"))


# One reply per order: fenced, plain or broken JSON with two items.
_REPLY = """case o_orderkey % 4
 when 0 then concat('Here it is: ```json\n[{"id": "', cast(o_orderkey as string),
  '", "match_percentage": 55.5, "matched_skills": ["Python", "SQL"], "explanation": "fits"}, ',
  '{"match_percentage": 3}]\n``` done')
 when 1 then concat('```\n[{"id": "', cast(o_orderkey as string), '"}]\n```')
 when 2 then concat('[{"id": "none", "match_percentage": 1}, {"id": "', cast(o_orderkey as string),
  '", "missing_skills": ["R"]}]')
 else concat('[{"id": "', cast(o_orderkey as string), '", ') end"""


@case("P23_parse_reply", """with t as (select o_orderkey as k, o_orderkey % 4 as m from orders)
select cast(k as string) as id, case m when 0 then 55.5e0 else 0e0 end as match_percentage,
 case m when 0 then 'Python|SQL' else '' end as matched,
 case m when 2 then 'R' else '' end as missing, case m when 0 then 'fits' else '' end as explanation
from t where m < 3
union all select 'none', 1e0, '', '', '' from t where m = 2""")
def _(spark, sf):
    replies = table(spark, sf, "orders").select(F.expr(_REPLY).alias("reply"))
    items = replies.select(F.explode(T.parse_reply("reply")).alias("i")).where("i.id is not null")
    none = F.array().cast("array<string>")
    return items.select(
        "i.id", F.coalesce("i.match_percentage", F.lit(0.0)).alias("match_percentage"),
        F.concat_ws("|", F.coalesce("i.matched_skills", none)).alias("matched"),
        F.concat_ws("|", F.coalesce("i.missing_skills", none)).alias("missing"),
        F.coalesce("i.explanation", F.lit("")).alias("explanation"))


@case("J4_reply_lookup", """with t as (select o_orderkey as k, o_orderkey % 4 as m from orders)
select cast(k as string) as id, case m when 0 then 55.5e0 else 0e0 end as match_percentage, c_name as company
from t join orders on k = o_orderkey join customer on o_custkey = c_custkey where m < 3""")
def _(spark, sf):
    replies = table(spark, sf, "orders").select(F.expr(_REPLY).alias("reply"))
    postings = jobs(spark, sf).select(F.col("seq").alias("id"), "company")
    return matching.reply_matches(replies, "reply", postings).select(
        "id", "match_percentage", "company")
