"""Readers, writers, the refresh job and streaming."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType

from vacancia.operators import dedupe, merge, metrics
from vacancia.operators.summaries import Summaries
from vacancia.plans.refresh import refresh, refresh_increment
from vacancia.sources import readers, workspace, writers
from vacancia.sources.schema import RAW_POSTINGS
from vacancia.streaming import jobs as S

HEADER = "id,title,company,description,min_amount,is_remote,date_posted,extra\n"


def test_csv_postings(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(HEADER + '1,"a, ""b""",NaN,"two\nlines",12.5,True,2025-01-02 03:04:05,x\n'
                    "2,NA,N/A,null,n/a,maybe,2025-99-01,\n", encoding="utf-8")
    df = readers.read_postings(spark, str(path))
    assert dict(df.dtypes)["min_amount"] == "double" and dict(df.dtypes)["extra"] == "string"
    first, second = df.orderBy("id").collect()
    assert first[1:4] == ('a, "b"', None, "two\nlines")
    assert first[4:7] == (12.5, True, datetime(2025, 1, 2, 3, 4, 5))
    assert second[1:] == (None,) * 7


def test_csv_round_trip_and_fallback(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    df = spark.createDataFrame([("1", ' "q" ,\n', None)], "id string, title string, company string")
    writers.write_csv(df, path)
    got = readers.read_first_available(spark, [str(tmp_path / "no"), path])
    assert got.collect() == [("1", ' "q" ,\n', None)]
    assert readers.read_first_available(spark, [str(tmp_path / "no")]).schema == RAW_POSTINGS


def test_snapshots_and_overwrite_guard(spark, tmp_path):
    for n, at in ((1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 2))):
        root = writers.write_snapshot(spark.range(n), str(tmp_path), at, "jobs/")
    assert readers.read_snapshot(spark, root).count() == 2
    assert readers.read_snapshot(spark, root, "20260101_000000").count() == 1
    path = writers.write_table(spark.range(5), str(tmp_path / "t"))
    with pytest.raises(ValueError):
        writers.write_table(spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == 5


def test_shared_folder_follows_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    folder = workspace.shared_folder(spark)
    assert folder == (before or folder) == workspace.shared_folder(spark)
    assert workspace.new_path(spark, "a") != workspace.new_path(spark, "a")


def postings(spark, n, shift=0):
    return spark.range(shift, shift + n).select(
        F.col("id").alias("seq"), F.concat(F.lit("j"), F.col("id") % 7).alias("id"),
        F.concat(F.lit("Title "), F.col("id") % 5).alias("title"), F.lit("Firm").alias("company"),
        F.lit("Here, TX").alias("location"), F.lit("https://x.com/1").alias("job_url"),
        F.lit("5 years experience, SQL").alias("description"), F.lit(1.0).alias("min_amount"),
        F.lit(3.0).alias("max_amount"), F.lit("weekly").alias("interval"),
        F.lit(datetime(2025, 1, 2)).cast("timestamp_ntz").alias("date_posted"))


def test_refresh_twice(spark, tmp_path):
    out = str(tmp_path)
    raw, processed = refresh(spark, [], postings(spark, 20), out, datetime(2026, 1, 1))
    for day, quick in ((2, False), (3, True)):
        again, _ = refresh(spark, [f"{raw}/snapshot=20260101_000000"], postings(spark, 20, 100),
                           out, datetime(2026, 1, day), merged_before=quick)
    assert readers.read_snapshot(spark, raw, "20260101_000000").count() == 5
    for stamp in ("20260102_000000", "20260103_000000"):  # nothing new
        assert readers.read_snapshot(spark, again, stamp).count() == 5
    row = spark.read.parquet(processed).where("title = 'Title 0'").first()
    assert (row.average_salary, row.skills, row.years_experience_required, row.state) == (
        104.0, ["SQL"], 5, "TX")


def test_refresh_fails_where_a_source_gave_nothing(spark, tmp_path):
    new = postings(spark, 5).withColumns({"search_term": F.lit("a"), "search_location": F.lit("x")})
    pairs = spark.createDataFrame([("a", "x"), ("b", "x")], "search_term string, search_location string")
    with pytest.raises(ValueError, match=r"\(b, x\)"):
        refresh(spark, [], new, str(tmp_path), datetime(2026, 1, 1), expected=pairs)
    assert not list(tmp_path.iterdir())
    raw, _ = refresh(spark, [], new, str(tmp_path), datetime(2026, 1, 1), expected=pairs.limit(1))
    assert readers.read_snapshot(spark, raw, "20260101_000000").count() == 5


def left_behind(spark, run):
    """Folders that stay where intermediate tables go, and whether shuffle files are cleaned up outside."""
    key, folder = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", workspace.shared_folder(spark)
    before, setting = set(os.listdir(folder)), spark.conf.get(key, None)
    run()
    assert spark.conf.get(key, None) == setting
    return set(os.listdir(folder)) - before


def test_refresh_in_parts_leaves_no_intermediate_table(spark, tmp_path, monkeypatch):
    new = postings(spark, 60).withColumn("title", F.concat(F.lit("Title "), F.col("seq") % 6))
    new = new.withColumn("id", F.col("seq").cast("string")).withColumn("job_url", F.concat("job_url", "id"))
    monkeypatch.setattr(dedupe.pick_parts, "__defaults__", (2, 3))  # 6 rows, 2 of them a part
    paths = []
    assert not left_behind(spark, lambda: paths.extend(refresh(spark, [], new, str(tmp_path), datetime(2026, 1, 1))))
    assert [r.seq for r in spark.read.parquet(paths[1]).orderBy("seq").collect()] == [0, 1, 2, 3, 4, 5]
    files = [f for p in paths for _, _, names in os.walk(p) for f in names if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)


def test_increments_leave_no_intermediate_table(spark, tmp_path):
    for number in (0, 1):
        assert not left_behind(spark, lambda: refresh_increment(spark, str(tmp_path), postings(spark, 20), number))
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 5


def test_parts_are_picked_once_each(spark):
    df, chosen = spark.range(100).withColumnRenamed("id", "seq"), spark.range(10, 60).withColumnRenamed("id", "seq")
    parts = [[r.seq for r in p.collect()] for p in dedupe.pick_parts(df, chosen, "seq", rows=5, most=3)]
    assert len(parts) == 3 and all(parts)
    assert sorted(sum(parts, [])) == list(range(10, 60))


def test_increments_equal_one_refresh(spark, tmp_path):
    base, (first, second) = str(tmp_path / "i"), (postings(spark, 3), postings(spark, 20, 2))
    whole = first.unionByName(second.where("seq > 2"))
    _, processed = refresh(spark, [], whole, str(tmp_path / "w"), datetime(2026, 1, 1))
    summaries = Summaries(spark, str(tmp_path / "summaries"))
    for number, rows in ((0, first), (1, second), (1, second), (2, second)):  # batch 1 is replayed
        refresh_increment(spark, base, rows, number, summaries=summaries)
    stored = spark.read.parquet(processed)
    assert sorted(map(str, summaries.period_counts("title").collect())) == sorted(
        map(str, metrics.period_counts(stored, "title").collect()))
    columns = ["seq", "title", "average_salary", "skills", "years_experience_required", "posted_month"]
    got, want = (sorted(map(str, spark.read.parquet(p).select(*columns).collect()))
                 for p in (f"{base}/processed", processed))
    assert got == want
    keys = spark.read.parquet(f"{base}/keys/keys")  # all that a later batch reads
    assert spark.read.parquet(f"{base}/raw").count() == keys.where("kind = 'key'").count()
    assert set(keys.columns) == {"kind", "digest", "named", "batch", "bucket"}


def test_ingest_replay_gives_the_same_table(spark, tmp_path):
    inbox, table, marks = (str(tmp_path / n) for n in ("in", "table", "marks"))
    postings(spark, 3).coalesce(1).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema

    def run(checkpoint):
        S.incremental_ingest(S.read_stream(spark, inbox, schema), table, checkpoint).awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(table).collect())

    assert run(marks) == [0, 1, 2]
    postings(spark, 4, 2).coalesce(1).write.mode("append").parquet(inbox)
    later = run(marks)
    assert later == [0, 1, 2, 3, 4]
    assert run(marks) == later            # nothing arrived
    assert run(marks + "-lost") == later  # all batches replayed into their own folders


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    inbox, table, marks = (str(tmp_path / n) for n in ("in", "table", "marks"))
    schema = StructType([StructField("k", LongType())])

    def arrive(keys, day):
        rows = spark.createDataFrame([(k,) for k in keys], schema)
        rows = rows.withColumn("at", F.lit(datetime(2025, 1, day)).cast("timestamp_ntz"))
        rows.coalesce(1).write.mode("append").parquet(inbox)
        stream = S.read_stream(spark, inbox, rows.schema)
        stream = S.dedupe_stream(stream, ["k"], "at", "1 day")
        S.write_stream(stream, table, marks).awaitTermination()
        return sorted(r.k for r in spark.read.schema(stream.schema).parquet(table).collect())

    assert arrive([1, 1, 2], 10) == [1, 2]
    assert arrive([2, 3], 10) == [1, 2, 3]
    assert arrive([4], 20) == [1, 2, 3, 4]
    assert arrive([5], 1) == [1, 2, 3, 4]  # older than the watermark


def _long(spark, path, rows):
    spark.createDataFrame(rows, "seq long, id string, title string, company string, location string, job_url string"
                          ).write.parquet(f"{path}/rows")
    spark.range(0, 40).select(F.col("id").alias("doc"), F.lit("python, 3 years").alias("description")).write.parquet(
        f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts").hint("merge")
    return spark.read.parquet(f"{path}/rows").join(texts, F.col("seq") % 40 == F.col("doc")).drop("doc")


def test_texts_are_joined_to_the_rows_that_stay(spark, tmp_path):
    """Neither a merge nor processing sorts or shuffles a text: both pick rows below the join that brings it."""
    rows = [(i, f"i{i % 150}", f"t{i % 7}", None, "x" if i % 3 else None, f"https://a.b/{i % 90}") for i in range(200)]
    new = _long(spark, tmp_path, rows)
    merged = merge.merge_by_keys(new.limit(0), new)
    assert sorted(merged.collect()) == sorted(merge.merge_new(new.limit(0), new).collect())
    firsts = dedupe.dedupe_by_keys(new, ["title", "company", "location"], "seq")
    assert sorted(firsts.collect(), key=str) == sorted(
        dedupe.dedupe_first(new, ["title", "company", "location"], ["seq"]).collect(), key=str)
    for plan in (merged, firsts):
        lines = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert (next(i for i, line in enumerate(lines) if "Join Inner" in line)
                < next(i for i, line in enumerate(lines) if "Join LeftSemi" in line))
        assert not any("Window" in line for line in lines)


def test_rows_an_order_does_not_tell_apart_are_merged_whole(spark):
    rows = [(1, "a", "t", None, None, None), (1, "b", "t", None, None, None), (None, "c", "u", None, None, None)]
    df = spark.createDataFrame(rows, "seq long, id string, title string, company string, location string, job_url string")
    assert merge.merge_by_keys(df.limit(0), df).count() == merge.merge_new(df.limit(0), df).count() == 2
    assert dedupe.dedupe_by_keys(df, ["title"], "seq").count() == 2
