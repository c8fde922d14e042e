"""Sources, sinks, keys, dedupe, merge and incremental ingest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vacancia.functions import fixed_values as V
from vacancia.functions import text as T
from vacancia.functions.rules import first_col, first_value
from vacancia.operators import dedupe, ingest, keys, merge
from vacancia.plans.enrich import process_all
from vacancia.plans.refresh import refresh, refresh_increment
from vacancia.sources import readers, writers
from vacancia.sources.schema import RAW_POSTINGS
from vacancia.sources.workspace import new_path

from .jobs import (FACTOR, JOBS, ROLE, YEARS, case, jobs, on_jobs, silver, skill_list, table,
                   write_silver)

_CSV_COLUMNS = ["seq", "id", "title", "company", "location", "min_amount", "is_remote",
                "date_posted"]
_CSV_SCHEMA = StructType(RAW_POSTINGS.fields + [StructField("seq", LongType())])
# Titles keep their outer blanks; missing titles are written as the token N/A.
_CSV_SQL = on_jobs(f"select {', '.join(_CSV_COLUMNS)} from jobs")


def _stored_csv(spark, sf) -> str:
    rows = jobs(spark, sf).select(*_CSV_COLUMNS).fillna("N/A", ["title"])
    return writers.write_csv(rows, new_path(spark, "postings") + ".csv")


@case("S1_csv_scan", _CSV_SQL)
def _(spark, sf):
    return readers.read_postings(spark, _stored_csv(spark, sf), _CSV_SCHEMA)


@case("S1_csv_long_text", """select cast(doc_id as varchar) as id, md5(text) as text_hash,
 cast(length(text) as bigint) as n from documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"),
                                                F.col("text").alias("description"))
    path = writers.write_csv(docs, new_path(spark, "documents") + ".csv")
    return readers.read_postings(spark, path).select(
        "id", F.md5("description").alias("text_hash"),
        F.length("description").cast("bigint").alias("n"))


@case("S2_object_path_scan", _CSV_SQL)
def _(spark, sf):
    path = _stored_csv(spark, sf)
    return readers.read_postings(spark, path if "://" in path else f"file://{path}", _CSV_SCHEMA)


@case("S3_fallback_scan", _CSV_SQL)
def _(spark, sf):
    path = _stored_csv(spark, sf)
    return readers.read_first_available(spark, [f"{path}.absent", path], _CSV_SCHEMA)


_STAMP = datetime(2026, 1, 1)


@case("S4_union_sources", """select 'jobs' as search_term, 'here' as search_location, 'order ' || o_orderkey as id,
  cast(null as varchar) as job_url, cast(null as bigint) as size from orders
 union all select 'pages', 'there', 'page ' || page_id, url, null from pages
 union all select 'texts', 'there', 'doc ' || doc_id, null, length(text) from documents""")
def _(spark, sf):
    def label(kind, column):
        return F.concat(F.lit(f"{kind} "), F.col(column).cast("string")).alias("id")
    parts = [
        (("jobs", "here"), table(spark, sf, "orders").select(label("order", "o_orderkey"))),
        (("pages", "there"), table(spark, sf, "pages").select(
            label("page", "page_id"), F.col("url").alias("job_url"))),
        (("texts", "there"), table(spark, sf, "documents").select(
            label("doc", "doc_id"), F.length("text").cast("bigint").alias("size")))]
    return merge.union_sources(parts, _STAMP).select(
        "search_term", "search_location", "id", "job_url", "size")


_SITES = ["alpha", "beta", "gamma"]  # the sites a collection asks


@case("S4_missing_sources", on_jobs("""select distinct c.location as search_term, o.site as search_location
 from (select distinct location from jobs where location is not null) c,
  (select distinct site from jobs) o
 where not exists (select 1 from jobs j where j.location = c.location and j.site = o.site
  and j.title = 'Data Analyst' and j.is_remote)"""))
def _(spark, sf):
    rows = jobs(spark, sf).withColumns({"search_term": F.col("location"),
                                        "search_location": F.col("site")})
    expected = (rows.where("location is not null").select("search_term").distinct()
                .withColumn("search_location", F.explode(F.array(*map(F.lit, _SITES)))))
    return merge.missing_sources(expected, rows.where("title = 'Data Analyst' and is_remote"))


@case("S4_collected_parts", on_jobs("""select site, location as place, count(*) as rows,
 count(distinct title) as titles from jobs where location is not null group by site, location"""))
def _(spark, sf):
    base = new_path(spark, "parts")
    rows = jobs(spark, sf).where("location is not null").withColumn("place", F.col("location"))
    writers.write_table(rows.select("site", "place", "title"), base, ["site", "place"])
    parts = readers.read_collected(spark, base).where(F.col("source_file").contains("place="))
    return parts.groupBy("site", "place").agg(F.count("*").alias("rows"),
                                              F.count_distinct("title").alias("titles"))


@case("S5_table_sink", on_jobs("""select seq, company, strftime(date_posted, '%Y-%m') as posted_month from jobs"""))
def _(spark, sf):
    rows = jobs(spark, sf).select("seq", "company",
                                  F.date_format("date_posted", "yyyy-MM").alias("posted_month"))
    path = writers.write_table(rows, new_path(spark, "table"), ["posted_month"])
    return readers.read_table(spark, path, rows.schema)


@case("S6_versioned_snapshot", on_jobs("select seq, title, 2 as version from jobs"))
def _(spark, sf):
    base = new_path(spark, "snapshots")
    rows = jobs(spark, sf).select("seq", "title")
    for version, at in ((1, datetime(2026, 1, 1, 9, 30)), (2, datetime(2026, 1, 2, 9, 30))):
        root = writers.write_snapshot(rows.withColumn("version", F.lit(version)), base, at, "jobs/")
    return readers.read_snapshot(spark, root)


@case("N1_alias_column", on_jobs("""select seq, company as first_present,
 coalesce(title, location, company) as first_filled from jobs"""))
def _(spark, sf):
    rows = jobs(spark, sf).withColumnRenamed("company", "company_name")
    return rows.select("seq", F.col(first_col(rows, V.COMPANY_ALIASES)).alias("first_present"),
                       first_value(rows, ["job_title", "title", "location", "company_name"])
                       .alias("first_filled"))


@case("N2_norm_text", on_jobs(r"""select seq, nullif(regexp_replace(trim(lower(title)), '\s+', ' ', 'g'), '') as title,
 nullif(regexp_replace(trim(lower(location)), '\s+', ' ', 'g'), '') as location from jobs"""))
def _(spark, sf):
    return jobs(spark, sf).select("seq", T.norm_text("title").alias("title"),
                                  T.norm_text("location").alias("location"))


@case("N2_norm_documents", r"""select doc_id,
 md5(trim(regexp_replace(lower(text), '[\t-\r\x{1c}-\x{1f} \x{85}\p{Z}]+', ' ', 'g'))) as key_hash
from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(F.coalesce(T.norm_text("text"), F.lit(""))).alias("key_hash"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_URL = f"""concat(regexp_extract(url, '^([a-z]+)://', 1), '://', lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)),
 case when {_PATH} in ('', '/') then '/' else rtrim(url_decode({_PATH}), '/') end)"""


@case("N3_norm_url", f"select page_id, {_URL} as link from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.norm_url("url").alias("link"))


_NORM = r"""nullif(regexp_replace(trim(lower({0})), '\s+', ' ', 'g'), '') as norm_{0}"""
NORMED = f"""normed as (select *, {_NORM.format('title')}, {_NORM.format('company')}, {_NORM.format('location')},
 {_URL.replace('url', 'job_url').replace('job_url_decode', 'url_decode')} as norm_link from feed)"""


@case("N4_add_norm_columns", f"""with {JOBS}, feed as (select * from jobs), {NORMED}
select seq, norm_title, norm_company, norm_location, norm_link from normed""")
def _(spark, sf):
    return keys.add_norm_columns(jobs(spark, sf, link=True)).select("seq", *keys.NORM_COLUMNS)


# New rows repeat every posting: a third under its id, a third under another id
# with a re-typed title and a tracking link, a third under a new title.
_NEW = {
    "id": "case seq % 3 when 0 then id else concat('new-', cast(seq as string)) end",
    "title": """case seq % 3 when 1 then ' ' || upper(title) || '  '
 when 2 then 'Remote ' || title else title end""",
    "job_url": "case when seq % 3 = 1 then job_url || '?ref=feed' else job_url end",
}
_FEED_COLUMNS = ["id", "seq", "title", "company", "location", "job_url"]
_FEED = f"""feed as (select 0 as src, {', '.join(_FEED_COLUMNS)} from jobs union all
 select 1 as src, {', '.join(f"{_NEW[c]} as {c}" if c in _NEW else c for c in _FEED_COLUMNS)} from jobs)"""


def _sides(spark, sf):
    old = jobs(spark, sf, link=True).select(*_FEED_COLUMNS)
    new = old.select(*[F.expr(_NEW[c]).alias(c) if c in _NEW else F.col(c) for c in _FEED_COLUMNS])
    return old, new


def _feed(spark, sf):
    old, new = _sides(spark, sf)
    return old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))


def _first(keys: str, source: str, name: str) -> str:
    return (f"{name} as (select * from {source} qualify row_number() over"
            f" (partition by {keys} order by src, seq) = 1)")


_COMPOSITE = "norm_title, norm_company, norm_location, norm_link"
_FEEDS = f"with {JOBS}, {_FEED}, {NORMED}"
_MERGED = f"{_FEEDS}, {_first('id', 'normed', 'by_id')}, {_first(_COMPOSITE, 'by_id', 'merged')}"


@case("N5_dedupe_by_id", f"{_FEEDS}, {_first('id', 'feed', 'kept')} select src, seq, id, title from kept")
def _(spark, sf):
    return dedupe.dedupe_first(_feed(spark, sf), ["id"], ["src", "seq"]).select(
        "src", "seq", "id", "title")


@case("N5_dedupe_keep_null_ids", f"""{_FEEDS}, {_first('id', 'feed', 'kept')}
 select src, seq, id from kept where id is not null union all
 select src, seq, id from feed where id is null""")
def _(spark, sf):
    return dedupe.dedupe_first(_feed(spark, sf), ["id"], ["src", "seq"], null_keys="keep").select(
        "src", "seq", "id")


@case("N6_dedupe_by_composite",
      f"{_FEEDS}, {_first(_COMPOSITE, 'normed', 'kept')} select src, seq, title from kept")
def _(spark, sf):
    rows = keys.add_norm_columns(_feed(spark, sf))
    return dedupe.dedupe_first(rows, keys.NORM_COLUMNS, ["src", "seq"]).select("src", "seq", "title")


@case("N7_dedupe_raw_keys", on_jobs("""select seq, title, company, location from jobs
 qualify row_number() over (partition by title, company, location order by seq) = 1"""))
def _(spark, sf):
    return dedupe.dedupe_first(jobs(spark, sf), ["title", "company", "location"], ["seq"]).select(
        "seq", "title", "company", "location")


@case("N8_merge_new", f"{_MERGED} select {', '.join(_FEED_COLUMNS)} from merged")
def _(spark, sf):
    return merge.merge_new(*_sides(spark, sf))


@case("N8_fresh_rows", f"{_MERGED} select {', '.join(_FEED_COLUMNS)} from merged where src = 1")
def _(spark, sf):
    old, new = _sides(spark, sf)
    return merge.fresh_rows(merge.merge_new(old, old.limit(0)), new)


# The same feed without any id: only the composite key tells rows apart.
_BARE = f"""with {JOBS}, {_FEED.replace('feed as', 'named as')}, feed as (select * replace (cast(null as varchar) as id)
 from named), {NORMED}, {_first(_COMPOSITE, 'normed', 'merged')}"""


def _bare_sides(spark, sf):
    """An id column without a value (of the data, so no constant of the plan)."""
    return [side.withColumn("id", F.expr("case when seq < 0 then id end")) for side in _sides(spark, sf)]


@case("N8_fresh_rows_without_ids", f"{_BARE} select {', '.join(_FEED_COLUMNS)} from merged where src = 1")
def _(spark, sf):
    old, new = _bare_sides(spark, sf)
    return merge.fresh_rows(merge.merge_new(old, old.limit(0)), new)


@case("N9_report_without_ids", f"""{_BARE}, n as (select (select count(*) from feed) as total,
 (select count(*) from merged) as kept, (select count(*) from jobs) as existing)
select 0 as removed_by_id, total - kept as removed_by_composite, kept, total as total_before,
 greatest(0, kept - existing) as added from n""")
def _(spark, sf):
    old, new = (side.drop("id") for side in _sides(spark, sf))
    return merge.merge_report(old, new)


@case("N9_merge_report", f"""{_MERGED}, n as (select (select count(*) from feed) as total,
 (select count(*) from by_id) as ids, (select count(*) from merged) as kept,
 (select count(*) from jobs) as existing)
select total - ids as removed_by_id, ids - kept as removed_by_composite, kept, total as total_before,
 greatest(0, kept - existing) as added from n""")
def _(spark, sf):
    return merge.merge_report(*_sides(spark, sf))


_AGED = f"""aged as (select *, {{0}} as age_window, {ROLE} as role_category from jobs
 where not (site = 'gamma' and lower(location) in ('united states', 'remote') and location is not null))"""


def _windows(windows) -> str:
    last = "(select max(date_posted) from jobs)"
    parts = [f"when date_posted >= {last} - interval {old} hours and date_posted "
             + (f"< {last} - interval {new} hours" if new else f"<= {last}") + f" then {i}"
             for i, (new, old) in enumerate(windows)]
    return "case " + " ".join(parts) + " end"


def _recent(windows, cap: int) -> str:
    return f"""with {JOBS}, {_AGED.format(_windows(windows))}
select seq, role_category, location, site, age_window from aged where age_window is not null
qualify row_number() over (partition by role_category, location, site, age_window
 order by date_posted desc, seq) <= {cap}"""


def _stratified(spark, sf, windows, results):
    rows = silver(spark, sf)
    rows = rows.where(ingest.not_broad("site", "location", "gamma"))
    as_of = jobs(spark, sf).agg(F.max("date_posted")).scalar()
    strata = ["role_category", "location", "site"]
    return ingest.stratified_recent(rows, strata, as_of, results, windows=windows).select(
        "seq", *strata, "age_window")


@case("N10_stratified_recent", _recent(V.AGE_WINDOWS, 2))
def _(spark, sf):
    return _stratified(spark, sf, V.AGE_WINDOWS, 8)


@case("N10_recent_window", _recent(V.RECENT_WINDOW, 3))
def _(spark, sf):
    return _stratified(spark, sf, V.RECENT_WINDOW, 3)


_STRATA = ["title", "location", "site"]


def _pages(low: int, high: int, size: int) -> str:
    return on_jobs(f"""select seq, title, location, site from jobs qualify row_number() over
 (partition by title, location, site order by date_posted desc nulls last, seq)
 between {low * size + 1} and {high * size}""")


@case("N12_backfill_page", _pages(1, 2, 3))
def _(spark, sf):
    state = ingest.BackfillState().advance()
    return ingest.backfill_page(jobs(spark, sf), state, 3, _STRATA).select("seq", *_STRATA)


@case("N12_resumed_backfill", on_jobs("select seq, title, location, site from jobs"))
def _(spark, sf):
    state, out = new_path(spark, "state"), new_path(spark, "pages")

    def store(page, number):
        page.select("seq", *_STRATA).write.mode("overwrite").parquet(f"{out}/page={number}")

    rows = jobs(spark, sf)
    most = rows.groupBy(*_STRATA).count().agg(F.max("count")).first()[0]
    size = max(1, -(-most // 4))  # about four pages
    ingest.run_backfill(spark, rows, state, size, _STRATA, store, windows=2)
    ingest.run_backfill(spark, rows, state, size, _STRATA, store)  # a later run, to the end
    return spark.read.parquet(out).drop("page")


@case("N13_content_hash_skip", """select md5(text) as content_hash, min(doc_id) as first_row, count(*) as copies
 from documents where text is not null and md5(text) not in
 (select md5(d.text) from documents d join labels l on d.doc_id = l.doc_id) group by md5(text)""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    done = docs.join(table(spark, sf, "labels"), "doc_id").select(
        ingest.content_hash("text").alias("content_hash"))
    return ingest.new_content(docs, done)


@case("J6_anti_join", """select seq, id from (select o_orderkey as seq, concat('job-', o_orderkey) as id,
 o_custkey from orders) where o_custkey not in (select c_custkey from customer where c_acctbal > 0)""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.expr("concat('job-', o_orderkey)").alias("id"),
        F.col("o_custkey").alias("c_custkey"))
    known = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    return orders.join(known, "c_custkey", "left_anti").select("seq", "id")


@case("U1_union_by_name", on_jobs("""select seq, title, null as url from jobs
 union all select page_id, null, url from pages"""))
def _(spark, sf):
    return merge.union_all([
        jobs(spark, sf).select("seq", "title"),
        table(spark, sf, "pages").select(F.col("page_id").alias("seq"), "url")])


_PROCESSED = """firsts as (select * from jobs qualify row_number() over
 (partition by title, company, location order by seq) = 1)"""
_PROCESSED_SELECT = f"""select seq, {ROLE} as role_category, {YEARS} as years_experience_required,
 round((min_amount * {FACTOR} + max_amount * {FACTOR}) / 2, 4) as average_salary,
 array_to_string({skill_list()}, '|') as skills"""


def _processed(rows, *more):
    return rows.select(*more, "seq", "role_category", "years_experience_required",
                       F.round("average_salary", 4).alias("average_salary"),
                       F.concat_ws("|", "skills").alias("skills"))


@case("E1_silver_table", f"with {JOBS} {_PROCESSED_SELECT} from jobs")
def _(spark, sf):
    return _processed(spark.read.parquet(write_silver(spark, sf)))


@case("E1_process_all", f"with {JOBS}, {_PROCESSED} {_PROCESSED_SELECT} from firsts")
def _(spark, sf):
    return _processed(process_all(jobs(spark, sf, text=True), period="pay_interval"))


@case("E1_refresh", f"""with {JOBS}, feed as (select *, 0 as src from jobs), {NORMED},
 {_first('id', 'normed', 'by_id')}, {_first(_COMPOSITE, 'by_id', 'merged')},
 {_PROCESSED.replace('from jobs', 'from merged')} {_PROCESSED_SELECT} from firsts""")
def _(spark, sf):
    new = jobs(spark, sf, text=True, link=True)
    out = new_path(spark, "refresh")
    _, processed = refresh(spark, [f"{out}/none"], new, out, _STAMP, period="pay_interval")
    return _processed(spark.read.parquet(processed))


_WHOLE_FEED = f"""feed as (select 0 as src, * from jobs union all by name select 1 as src,
 * replace ({', '.join(f'{e} as {c}' for c, e in _NEW.items())}) from jobs)"""


@case("E1_refresh_increment", f"""with {JOBS}, {_WHOLE_FEED}, {NORMED},
 {_first('id', 'normed', 'by_id')}, {_first(_COMPOSITE, 'by_id', 'merged')},
 {_first('title, company, location', 'merged', 'firsts')}
 {_PROCESSED_SELECT}, cast(src as integer) as batch from firsts""")
def _(spark, sf):
    old = jobs(spark, sf, text=True, link=True)
    new = old.withColumns({c: F.expr(e) for c, e in _NEW.items()})
    base = new_path(spark, "increments")
    for number, rows in enumerate((old, new, new)):  # the last batch brings nothing
        refresh_increment(spark, base, rows, number, period="pay_interval")
    parts = spark.read.parquet(f"{base}/processed")
    return _processed(parts, "batch")
