"""The postings view over the given tables, in Spark and as SQL text.

One posting per order: company from `customer`, prose from `documents`, link
from `pages`. Every document and every page is used, since the key wraps around
at the size of the table.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacancia.functions import fixed_values as V
from vacancia.operators.filters import MONTH
from vacancia.plans.enrich import enrich
from vacancia.sources.readers import path_exists
from vacancia.sources.workspace import new_path
from vacancia.sources.writers import write_table


class Case(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None):
    def add(run):
        assert name not in CASES, name
        CASES[name] = Case(run, sql)
        return run
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_PAY = """case when o_orderkey % 7 = 0 then null when o_orderkey % 4 = 1 then ({0} + o_totalprice * 0.3) / 2080
  when o_orderkey % 4 = 2 then ({0} + o_totalprice * 0.3) / 12
  when o_orderkey % 4 = 3 then ({0} + o_totalprice * 0.3) / 52 else {0} + o_totalprice * 0.3 end"""

# Column -> expression, the same text in both engines.
COLUMNS = {
    "id": "case when o_orderkey % 17 = 0 then null else concat('job-', cast(o_orderkey as string)) end",
    "seq": "o_orderkey",
    "title": """case o_custkey % 16 when 0 then 'Senior Data Scientist' when 1 then 'Research Scientist II'
  when 2 then 'Machine Learning Engineer' when 3 then 'Principal ML Engineer' when 4 then 'AI Engineer'
  when 5 then 'Data Engineer III' when 6 then 'Analytics Engineer' when 7 then 'Data Analyst'
  when 8 then 'Junior Business Intelligence Analyst' when 9 then 'Software Engineer I'
  when 10 then 'Lead Developer' when 11 then 'Director of Data' when 12 then 'Data Engineering Intern'
  when 13 then 'Product Manager' when 14 then '  data   SCIENTIST ' else null end""",
    "company": "c_name",
    "location": """case (o_custkey + o_orderkey) % 10 when 0 then 'San Francisco, CA' when 1 then 'New York, NY'
  when 2 then 'Austin, TX' when 3 then 'Chicago, IL' when 4 then 'Remote' when 5 then 'Smalltown, OH'
  when 6 then 'London, UK' when 7 then 'Washington, DC' when 8 then 'Denver, CO' else null end""",
    "date_posted": "o_orderdate",
    "min_amount": _PAY.format(40000),
    "max_amount": _PAY.format(60000),
    "pay_interval": """case o_orderkey % 4 when 1 then 'hourly' when 2 then 'monthly' when 3 then 'weekly'
  else 'yearly' end""",
    "is_remote": "case when o_orderkey % 11 = 0 then null else o_orderkey % 4 = 0 end",
    "job_type": """case o_orderkey % 7 when 0 then 'fulltime' when 1 then 'Full_Time' when 2 then 'part-time'
  when 3 then 'contract' when 4 then 'internship' when 5 then 'temporary' else null end""",
    "site": "case o_orderkey % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end",
}
_LINK = "url"
_TEXT = """concat(text, ' ', case o_orderkey % 9
  when 0 then '5+ years of experience with Python, SQL and Spark. Masters degree preferred.'
  when 1 then 'Minimum of 3 years in R and statistics; Ph.D. required.'
  when 2 then '2-4 years building pipelines on AWS, Docker and Kubernetes.'
  when 3 then 'Junior role: Tableau, Power BI, SQL. Bachelor degree.'
  when 4 then 'Deep learning with PyTorch or TensorFlow, machine learning, NLP.'
  when 5 then 'HTML and CSS skills.'
  when 6 then '3-5 years experience, pandas, numpy, scikit-learn, A/B testing.'
  when 7 then 'Google Cloud, BigQuery, git.' else '' end)"""


_TEXTS_PER_TASK = 25_000


def jobs(spark: SparkSession, sf: str, text: bool = False, link: bool = False) -> DataFrame:
    """The view. Text and link cost a join each and are joined on request, the texts last.

    The documents are never broadcast: their size grows with the data, and the
    sort-merge join spreads the texts over all tasks.
    """
    rows = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if link:
        pages = table(spark, sf, "pages")
        size = pages.agg(F.count("*")).scalar()
        rows = rows.withColumn("_page", F.col("o_orderkey") % size).join(
            pages.select("page_id", "url"), F.col("_page") == F.col("page_id"))
    if text:
        docs = table(spark, sf, "documents")
        size = docs.agg(F.count("*")).scalar()
        plain = docs.select("doc_id", "text")
        # As many tasks as the texts need: Spark would count the rows without them.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                    table(spark, sf, "orders").count() // _TEXTS_PER_TASK)
        rows = (rows.withColumn("_doc", F.col("o_orderkey") % size).repartition(tasks, "_doc")
                .join(plain.hint("merge"), F.col("_doc") == F.col("doc_id")))
    columns = COLUMNS | ({"description": _TEXT} if text else {}) | ({"job_url": _LINK} if link else {})
    return rows.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """The processed postings as a plan over the view."""
    return enrich(jobs(spark, sf, text=True), "pay_interval")


_SILVER: dict[tuple[str, str], str] = {}


def silver(spark: SparkSession, sf: str) -> DataFrame:
    """The processed postings as a stored table, without the texts.

    Texts are searched once, when the table is written (the query
    `E1_silver_table` shows that cost); every analysis reads the columns it
    needs, as a dashboard reads the output of the refresh job.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SILVER or not path_exists(spark, _SILVER[key]):
        write_silver(spark, sf)
    return spark.read.parquet(_SILVER[key])


def write_silver(spark: SparkSession, sf: str) -> str:
    rows = enriched(spark, sf).drop("description").withColumn(MONTH, F.date_format("date_posted", "yyyy-MM"))
    path = write_table(rows, new_path(spark, "silver"), [MONTH])
    _SILVER[(spark.sparkContext.applicationId, sf)] = path
    return path


SKILLS = list(V.SKILL_PATTERNS)


# --- SQL side -------------------------------------------------------------

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def ladder(branches, otherwise="null") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in branches) + f" else {otherwise} end"


# Orders and customers are joined first, as a step of its own: DuckDB 2.0 fails
# with an internal error on the four-table join in one step.
JOBS = ("placed as materialized (select *, o_orderkey % (select count(*) from documents) as doc_key,"
        " o_orderkey % (select count(*) from pages) as page_key"
        " from orders join customer on o_custkey = c_custkey),\n"
        "jobs as (select " + ",\n ".join(f"{e} as {n}" for n, e in COLUMNS.items()) +
        f",\n {_TEXT} as description, url as job_url\n"
        "from placed join documents on doc_id = doc_key join pages on page_id = page_key)")

FACTOR = "case pay_interval when 'hourly' then 2080 when 'monthly' then 12 when 'weekly' then 52 else 1 end"
ROLE = ladder([(has("lower(title)", w), quoted(r)) for r, w in V.ROLE_RULES], "'Other'")
# DuckDB's \b, \s and \d know ASCII alone, so its patterns name the Unicode classes.
_IN_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_BEFORE, _AFTER = f"(?:^|[^{_IN_WORD}])", f"(?:$|[^{_IN_WORD}])"
BLANK = r"[\t-\r \x{85}\p{Z}]"


def re2(pattern: str) -> str:
    """A pattern of plain alternatives for DuckDB."""
    out = []
    for p in pattern.split("|"):
        if p.startswith(r"\b"):
            p = (f"[{_IN_WORD}]" if p[2] == " " else _BEFORE) + p[2:]
        if p.endswith(r"\b"):
            p = p[:-2] + _AFTER
        out.append(p.replace(r"\s", BLANK).replace(r"\d", r"\p{Nd}"))
    return "|".join(out)


def _whole(words: str, dotted: str = "") -> str:
    """Whole words; forms that end in a dot count where a letter follows, as their boundary says."""
    ends = f"(?:{words}){_AFTER}" + (f"|(?:{dotted})[{_IN_WORD}]" if dotted else "")
    return f"{_BEFORE}(?:{ends})"


_PHD = _whole(r"ph\.?d|doctorate|doctoral")
_DEGREES_STRICT = (
    ("PhD", _PHD), ("Master's", "graduate level"),
    ("Master's", _whole("masters*|msc|ms|graduate|grad", r"m\.sc\.|m\.s\.")),
    ("Bachelor's", _whole("bachelors*|bsc|bs", r"b\.sc\.|b\.s\.")))
_DEGREES_DEFAULT = (
    ("PhD", _PHD), ("Master's", _whole("postgraduate|advanced degree|advanced education")),
    ("Master's", _whole("masters*|msc|ms", r"m\.sc\.|m\.s\.")))
STRICT = ladder([(f"regexp_matches(lower(description), {quoted(p)})", quoted(d)) for d, p in _DEGREES_STRICT])
DEFAULT = ladder([(f"regexp_matches(lower(description), {quoted(p)})", quoted(d)) for d, p in _DEGREES_DEFAULT],
                 "'Bachelor''s'")
YEARS = "coalesce(" + ", ".join(
    f"try_cast(nullif(regexp_extract(lower(description), {quoted(re2(p))}, 1), '') as bigint)"
    for p in V.YEARS_PATTERNS) + (
    f", case when regexp_matches(lower(description), {quoted(V.ENTRY_LEVEL_PATTERN)}) then 0 end)")
TYPE = ladder([(has("lower(trim(job_type))", w), quoted(t)) for t, w in V.JOB_TYPE_RULES])
LAST = "case when contains(location, ', ') then string_split(location, ', ')[-1] end"
STATE = f"case when regexp_matches(trim({LAST}), '^[A-Za-z][A-Za-z]$') then upper(trim({LAST})) end"
TIER = ladder([(has("lower(location)", w), str(t)) for t, w in V.COST_TIERS], "0")


def title_years(column: str = "lower(title)") -> str:
    branches = []
    for years, words, ends in V.TITLE_YEARS:
        test = [has(column, words)] + [f"ends_with({column}, {quoted(e)})" for e in ends]
        branches.append(("(" + " or ".join(test) + ")", f"{years}e0"))
    return ladder(branches)


def skill(name: str, text: str = "lower(description)") -> str:
    return f"coalesce(regexp_matches({text}, {quoted(re2(V.SKILL_PATTERNS[name]))}), false)"


def skill_list(text: str = "lower(description)") -> str:
    items = ", ".join(f"case when {skill(n, text)} then {quoted(n)} end" for n in SKILLS)
    return f"list_filter([{items}], lambda x: x is not null)"


FLAGS = ", ".join(f'{skill(n)} as "{n}"' for n in SKILLS)

SILVER = JOBS + f""",
paid as (select *, min_amount * {FACTOR} as annual_min_salary, max_amount * {FACTOR} as annual_max_salary
 from jobs),
silver as (select *, (annual_min_salary + annual_max_salary) / 2 as average_salary,
 {ROLE} as role_category, {STRICT} as education_level, {YEARS} as years_experience_required,
 {TYPE} as job_type_norm, {STATE} as state, {TIER} as col_tier from paid)"""

FLAGGED = SILVER + f""",
flagged as materialized (select *, {FLAGS} from silver)"""


def on_jobs(body: str) -> str:
    return f"with {JOBS}\n{body}"


def on_silver(body: str) -> str:
    return f"with {SILVER}\n{body}"


def unpivot_skills(source: str, value) -> str:
    """One SELECT per skill over a CTE: value(name) gives the select list."""
    return " union all ".join(f"select {quoted(n)} as skill, {value(n)} from {source}" for n in SKILLS)
