"""Sampling and candidate matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.operators import matching
from vacancia.plans.enrich import add_skills

from .jobs import (
    SILVER, SKILLS, STRICT, YEARS, case, jobs, on_jobs, on_silver, quoted, silver, skill, skill_list, table)


@case("O4_seeded_sample", on_jobs("""select seq, title from jobs
 order by md5(concat('42-', cast(seq as varchar))), seq limit 10"""))
def _(spark, sf):
    return matching.sample_rows(jobs(spark, sf).select("seq", "title"), 10, "seq")


@case("O3_best_paid", on_silver("""select seq, round(average_salary, 4) as average_salary from silver
 order by silver.average_salary desc nulls last, seq limit 5"""))
def _(spark, sf):
    rows = matching.top_rows(silver(spark, sf), "average_salary", "seq", 5)
    return rows.select("seq", F.round("average_salary", 4).alias("average_salary"))


@case("R5_posting_digest", on_jobs(f"""select seq, coalesce(title, 'Unknown') as title,
 coalesce(company, 'Unknown') as company, coalesce(location, 'Unknown') as location,
 array_to_string(({skill_list()})[1:10], '|') as required_skills,
 substring(coalesce(description, ''), 1, 200) as snippet from jobs"""))
def _(spark, sf):
    digest = matching.posting_digest(add_skills(jobs(spark, sf, text=True)))
    return digest.withColumn("required_skills", F.concat_ws("|", "required_skills"))


# A candidate text: a document followed by a line about the person.
_ABOUT = """concat(text, ' ', case doc_id % 4 when 0 then 'Python, SQL, Spark and R in use. 6 years of experience. Ph.D.'
 when 1 then 'Tableau, Power BI, SQL. Bachelor of science, 2 years experience.'
 when 2 then 'AWS, Docker, Kubernetes, git, masters degree.' else 'I write.' end)"""
_HOME = "case doc_id % 5 when 0 then 'CA' when 1 then 'TX' when 2 then 'OH' when 3 then 'NY' end"
_PEOPLE = f"""people as (select doc_id, {_ABOUT} as description from documents),
candidates as (select doc_id as candidate_id, {skill_list()} as technical_skills,
 cast({YEARS} as double) as years_experience, {STRICT} as education, {_HOME} as home from people)"""


def _candidates(spark, sf):
    people = table(spark, sf, "documents").select("doc_id", F.expr(_ABOUT).alias("about"))
    return matching.candidate_profiles(people, "about", "doc_id")


@case("R4_candidate_profiles", f"""with {_PEOPLE} select candidate_id,
 array_to_string(technical_skills, '|') as technical_skills, years_experience, education from candidates""")
def _(spark, sf):
    rows = _candidates(spark, sf)
    return rows.withColumn("technical_skills", F.concat_ws("|", "technical_skills"))


@case("R4_conversation_skills", f"""with t as (select conv_id, turn, lower(text) as low
 from conversations) select conv_id, turn, array_to_string({skill_list('low')}, '|') as skills from t""")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("key"),
        "text")
    out = matching.candidate_profiles(rows, "text", "key")
    return out.select("candidate_id.conv_id", "candidate_id.turn",
                      F.concat_ws("|", "technical_skills").alias("skills"))


def _rank(column: str) -> str:
    return f"(case {column} when 'PhD' then 3 when 'Master''s' then 2 when 'Bachelor''s' then 1 else 0 end)"


def _score(skills: str, years: str, degree: str, state: str) -> str:
    return f"""round(100 * (
 0.6e0 * case when len(skills) > 0 then len(list_filter(skills, lambda x: list_contains({skills}, x))) / len(skills) else 0e0 end
 + 0.2e0 * case when coalesce(years_experience_required, 0) <= 0 then 1e0
   else least(1e0, coalesce({years}, 0e0) / years_experience_required) end
 + 0.1e0 * case when {_rank(degree)} >= {_rank('education_level')} then 1e0 else 0e0 end
 + 0.1e0 * case when coalesce(is_remote, false) or coalesce(state = {state}, false) then 1e0 else 0e0 end), 1)
 as match_percentage, array_to_string(list_filter(skills, lambda x: list_contains({skills}, x)), '|') as matched_skills,
 array_to_string(list_filter(skills, lambda x: not list_contains({skills}, x)), '|') as missing_skills"""


_ME = matching.Candidate(("Python", "SQL", "AWS", "Tableau"), 3.0, "Master's", "TX")
_SKILLED = f"{SILVER}, skilled as (select *, {skill_list()} as skills from silver)"
_MINE = f"""with {_SKILLED}, scored as (select seq,
 {_score("['Python', 'SQL', 'AWS', 'Tableau']", "3e0", "'Master''s'", "'TX'")} from skilled)"""


def _mine(spark, sf):
    return matching.score_postings(silver(spark, sf), _ME)


def _texts(df):
    return df.withColumns({c: F.concat_ws("|", c) for c in ("matched_skills", "missing_skills")})


@case("R1_match_score", f"{_MINE} select seq, match_percentage, matched_skills, missing_skills from scored")
def _(spark, sf):
    return _texts(_mine(spark, sf).select("seq", "match_percentage", "matched_skills", "missing_skills"))


@case("U4_array_difference", f"{_MINE} select seq, matched_skills, missing_skills from scored")
def _(spark, sf):
    return _texts(_mine(spark, sf).select("seq", "matched_skills", "missing_skills"))


@case("R2_match_summary", f"""{_MINE} select round(avg(match_percentage), 4) as avg_match,
 count(*) filter (match_percentage >= 70) as good, count(*) as total, max(match_percentage) as best from scored""")
def _(spark, sf):
    out = matching.match_summary(_mine(spark, sf))
    return out.withColumn("avg_match", F.round("avg_match", 4))


@case("R3_skill_gap", f"""{_MINE} select skill, count(*) as count from
 (select unnest(string_split(missing_skills, '|')) as skill from scored where missing_skills <> '')
 group by skill order by count desc, skill limit 10""")
def _(spark, sf):
    return matching.skill_gap(_mine(spark, sf))


# All rows with all rows; skills as bits, so that one machine gets through them.
def _mask(text: str) -> str:
    return " + ".join(f"(case when {skill(n, text)} then {1 << i} else 0 end)" for i, n in enumerate(SKILLS))


def _names(bits: str) -> str:
    return ("array_to_string(list_filter([" + ", ".join(
        f"case when ({bits}) & {1 << i} > 0 then {quoted(n)} end" for i, n in enumerate(SKILLS))
        + "], lambda x: x is not null), '|')")


_PAIRS = f"""with {SILVER}, people as (select doc_id, {_ABOUT} as description from documents),
candidates as materialized (select doc_id as candidate_id, cast({_mask('lower(description)')} as bigint) as has,
 coalesce(cast({YEARS} as double), 0e0) as years, {_rank(f"({STRICT})")} as degree, {_HOME} as home from people),
wanted as materialized (select seq, title, company, location, round(average_salary, 4) as average_salary,
 cast({_mask('lower(description)')} as bigint) as needs, years_experience_required as need,
 {_rank('education_level')} as level, coalesce(is_remote, false) as remote, state from silver),
scored as (select candidate_id, seq, has, round(100 * (0.6e0 * bit_count(has & needs) / bit_count(needs)
 + 0.2e0 * case when coalesce(need, 0) <= 0 then 1e0 else least(1e0, years / need) end
 + 0.1e0 * case when degree >= level then 1e0 else 0e0 end
 + 0.1e0 * case when remote or coalesce(state = home, false) then 1e0 else 0e0 end), 1) as match_percentage
 from candidates join wanted on has & needs > 0),
top as (select candidate_id, has, unnest(arg_min(struct_pack(seq, match_percentage),
 struct_pack(a := -match_percentage, b := seq), 5), recursive := true) from scored group by 1, 2),
pairs as (select candidate_id, seq, title, company, location, average_salary, match_percentage,
 {_names('has & needs')} as matched_skills, {_names('needs & ~has')} as missing_skills from top join wanted using (seq))"""


def _pairs(spark, sf):
    people = _candidates(spark, sf).withColumn("doc_id", F.col("candidate_id")).withColumn("state", F.expr(_HOME))
    return matching.match_candidates(people, silver(spark, sf))


@case("J7_match_candidates", f"{_PAIRS} select * from pairs")
def _(spark, sf):
    return _texts(_pairs(spark, sf).withColumn("average_salary", F.round("average_salary", 4)))


@case("O3_best_matches", f"""{_PAIRS} select candidate_id, seq, match_percentage from pairs
 qualify row_number() over (partition by candidate_id order by match_percentage desc, seq) <= 3""")
def _(spark, sf):
    return matching.best_matches(_pairs(spark, sf), 3).select("candidate_id", "seq", "match_percentage")
