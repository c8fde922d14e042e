"""Structured Streaming over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.sources.workspace import new_path
from vacancia.streaming import jobs as S

from .ingest import _BARE, _bare_sides, _FEED_COLUMNS, _FEEDS, _COMPOSITE, _first, _sides
from .jobs import case, table


@case("X1_incremental_ingest", f"""{_FEEDS}, {_first('id', 'normed', 'by_id')},
 {_first(_COMPOSITE, 'by_id', 'merged')} select {', '.join(_FEED_COLUMNS)} from merged""")
def _(spark, sf):
    return _arrivals(spark, *_sides(spark, sf))


def _arrivals(spark, old, new):
    """Two arrivals of as many files as the rows come in, each one batch: the old postings, then the new ones."""
    inbox, out, marks = (new_path(spark, n) for n in ("inbox", "postings", "marks"))
    for part in (old, new):
        part.write.mode("append").parquet(inbox)
        stream = S.read_stream(spark, inbox, old.schema, files_per_trigger=10_000)
        S.incremental_ingest(stream, out, marks).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@case("X1_ingest_without_ids", f"{_BARE} select {', '.join(_FEED_COLUMNS)} from merged")
def _(spark, sf):
    return _arrivals(spark, *_bare_sides(spark, sf))


@case("X2_streaming_dedupe", """select event_id, user_id, event_type from events""")
def _(spark, sf):
    # Every event arrives twice; the copy is within the delay and is dropped.
    inbox, out, marks = (new_path(spark, n) for n in ("events", "unique", "marks"))
    events = table(spark, sf, "events")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    twice.write.parquet(inbox)
    stream = S.dedupe_stream(S.read_stream(spark, inbox, events.schema), ["event_id"], "ts",
                             "40 days")
    S.write_stream(stream, out, marks).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("event_id", "user_id", "event_type")


@case("X3_weekly_counts", """select cast(date_trunc('week', ts) as date) as week, event_type,
 count(*) as count from events group by 1, 2""")
def _(spark, sf):
    out, marks = new_path(spark, "weekly"), new_path(spark, "marks")
    schema = table(spark, sf, "events").schema
    stream = S.read_stream(spark, sf, schema, glob="events.parquet")
    S.write_result(S.weekly_counts(stream, "event_type", "ts"), out, marks).awaitTermination()
    return S.read_result(spark, out)
