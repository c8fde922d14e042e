"""Dedupe, merge, ingest, quantiles, matching: against brute force."""

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacancia.functions import fixed_values as V
from vacancia.operators import (compare, dedupe, filters, ingest, matching, merge, metrics,
                                quantiles, stats, trends)
from vacancia.operators.filters import FilterSpec


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def feed(spark):
    """900 rows, a third of them with one id and one title."""
    pick = random.Random(7)
    data = []
    for i in range(900):
        hot = i % 3 == 0
        data.append((i, "hot" if hot else pick.choice([None, f"id{pick.randrange(200)}"]),
                     "Data Analyst" if hot else f"Title {pick.randrange(40)}",
                     f"Firm {pick.randrange(5)}", pick.choice(["Here", " here ", None]),
                     f"https://X.com/{pick.randrange(30)}/?q={i}"))
    return spark.createDataFrame(data, "seq long, id string, title string, company string, "
                                       "location string, job_url string")


def first_by(data, key):
    seen = {}
    for r in data:
        seen.setdefault(key(r), r)
    return list(seen.values())


def test_dedupe_first_keeps_the_first_of_each_key(feed):
    data = sorted(feed.collect(), key=lambda r: r.seq)
    kept = dedupe.dedupe_first(feed, ["id"], ["seq"])
    assert rows(kept, "seq") == sorted((r.seq,) for r in first_by(data, lambda r: r.id))
    assert rows(dedupe.dedupe_first(kept, ["id"], ["seq"]), "seq") == rows(kept, "seq")


def test_dedupe_keep_null_keys(feed):
    kept = dedupe.dedupe_first(feed, ["id"], ["seq"], null_keys="keep")
    nulls = feed.where("id is null").count()
    assert kept.where("id is null").count() == nulls > 1
    with pytest.raises(ValueError):
        dedupe.dedupe_first(feed, ["id"], ["seq"], null_keys="drop")


def test_top_n_beyond_the_limit_before_the_shuffle(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold"))
    got = dedupe.top_n_per_group(df, ["k"], [F.col("id").desc()], 1200)
    ids = {k: sorted((i for i in range(5000) if (i % 3 == 0) == (k == "hot")), reverse=True)[:1200]
           for k in ("hot", "cold")}
    assert rows(got, "id") == sorted((i,) for part in ids.values() for i in part)


def test_hot_keys_are_cut_before_the_shuffle(feed):
    plan = dedupe.dedupe_first(feed, ["id"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def brute_merge(existing, new):
    def text(v):
        return " ".join(v.split()).lower() or None if v is not None else None

    def link(v):
        return v.split("?")[0].lower().rstrip("/")

    stacked = existing + new
    by_id = first_by(stacked, lambda r: r.id) if any(r.id for r in stacked) else stacked
    return by_id, first_by(by_id, lambda r: (text(r.title), text(r.company), text(r.location),
                                             link(r.job_url)))


def test_merge_and_report(feed):
    old, new = feed.where("seq < 500"), feed.where("seq >= 450")
    a, b = (sorted(x.collect(), key=lambda r: r.seq) for x in (old, new))
    by_id, merged = brute_merge(a, b)
    assert rows(merge.merge_new(old, new), "seq") == sorted((r.seq,) for r in merged)
    report = merge.merge_report(old, new).first().asDict()
    assert report == {"total_before": len(a) + len(b), "removed_by_id": len(a) + len(b) - len(by_id),
                      "removed_by_composite": len(by_id) - len(merged), "kept": len(merged),
                      "added": max(0, len(merged) - len(a))}


def test_merge_is_idempotent_and_fresh_rows_agree(feed):
    old, new = feed.where("seq < 500"), feed.where("seq >= 450")
    clean = merge.merge_new(old, old.limit(0))
    assert rows(merge.merge_new(clean, clean), "seq") == rows(clean, "seq")
    new = new.withColumn("seq", F.col("seq") + 10000)
    added = merge.merge_new(clean, new).where("seq >= 10000")
    assert rows(merge.fresh_rows(clean, new), "seq") == rows(added, "seq") != []
    assert rows(merge.fresh_rows(clean, clean), "seq") == []


def test_merge_without_any_id_keeps_rows_apart(feed):
    bare = feed.withColumn("id", F.lit(None).cast("string"))
    _, merged = brute_merge(sorted(bare.collect(), key=lambda r: r.seq), [])
    assert rows(merge.merge_new(bare, bare.limit(0)), "seq") == sorted((r.seq,) for r in merged)


@pytest.mark.parametrize("null_keys", ["collapse", "keep"])
def test_fresh_rows_without_ids(feed, null_keys):
    """No id at all, no id column, and ids on one side only."""
    def agree(old, new, some=True):
        clean = merge.merge_new(old, old.limit(0), null_keys=null_keys)
        added = merge.merge_new(clean, new, null_keys=null_keys).where("seq >= 10000")
        got = merge.fresh_rows(clean, new, null_keys=null_keys)
        assert got.columns == new.columns and rows(got, "seq") == rows(added, "seq")
        assert bool(rows(got, "seq")) == some
        assert merge.merge_report(old, new).first().total_before == old.count() + new.count()

    old = feed.where("seq < 500")
    new = feed.where("seq >= 450").withColumns({
        "seq": F.col("seq") + 10000, "company": F.expr("if(seq % 2 = 0, company || ' two', company)")})
    bare = [x.withColumn("id", F.lit(None).cast("string")) for x in (old, new)]
    agree(*bare)
    agree(old.drop("id"), new.drop("id"))
    agree(old, bare[1], some=null_keys == "keep")  # null ids equal the null ids of the old table


def test_missing_sources(spark):
    expected = spark.createDataFrame([("a", "x"), ("b", "x")], "search_term string, search_location string")
    part = spark.createDataFrame([(1,)], "n int")
    got = merge.union_sources([(("a", "x"), part), (("c", "y"), part.withColumnRenamed("n", "m"))],
                              datetime(2026, 1, 1))
    assert sorted(got.columns) == ["m", "n", "scraped_date", "search_location", "search_term"]
    assert rows(merge.missing_sources(expected, got), "search_term") == [("b",)]


def test_backfill_pages_and_state(spark, feed, tmp_path):
    path, seen = str(tmp_path / "state"), []

    def process(page, number):
        if number == 2 and len(seen) == 2:
            seen.append("failed")
            raise RuntimeError("source down")
        seen.append(sorted(r.seq for r in page.collect()))

    df = feed.withColumn("date_posted", F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz"))
    run = dict(page_size=20, strata=["company"], process=process)
    with pytest.raises(RuntimeError):
        ingest.run_backfill(spark, df, path, windows=3, **run)
    assert ingest.load_state(spark, path) == ingest.BackfillState((0, 1), 2)
    ingest.run_backfill(spark, df, path, **run)
    state = ingest.load_state(spark, path)
    pages = [p for p in seen if p != "failed"]
    assert state.done and state.completed_windows == tuple(range(len(pages))) and all(pages)
    assert sorted(s for p in pages for s in p) == list(range(900))
    assert ingest.run_backfill(spark, df, path, **run) == state and len(seen) == len(pages) + 1


def test_age_windows(spark):
    now = datetime(2025, 6, 30)
    hours = [0, 1, 168, 169, 336, 504, 720, 721]
    df = spark.createDataFrame([(h, now - timedelta(hours=h)) for h in hours],
                               "h int, at timestamp_ntz")
    got = df.select(ingest.age_window("at", F.lit(now).cast("timestamp_ntz"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 1, 2, 3, None]


def test_new_content(spark):
    docs = spark.createDataFrame([(i, f"text {i % 4}" if i % 2 else "hot") for i in range(100)]
                                 + [(100, None)], "doc_id long, text string")
    done = docs.where("doc_id = 1").select(ingest.content_hash("text").alias("content_hash"))
    got = ingest.new_content(docs, done)
    assert rows(got, "first_row", "copies") == [(0, 50), (3, 25)]


@pytest.mark.parametrize("parts", [1, 2, 64])
def test_exact_percentiles(spark, parts):
    pick = random.Random(3)
    data = [("a", float(pick.choice([5, pick.gauss(0, 100)]))) for _ in range(1001)]
    data += [("b", 7.0)] * 500 + [("b", float(i)) for i in range(8)] + [("c", 1.5)]
    data += [("a", None), (None, 3.0), ("a", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.p for r in quantiles.exact_percentiles(df, "v", probs, ["k"], parts).collect()}
    assert set(got) == {"a", "b", "c"}
    for key, points in got.items():
        want = np.quantile([v for k, v in data if k == key and v is not None and v == v], probs)
        assert np.allclose(points, want, rtol=1e-12, atol=1e-9)
    whole = quantiles.exact_percentiles(df, "v", probs, parts=parts).first()[0]
    assert np.allclose(whole, np.quantile([v for _, v in data if v is not None and v == v], probs))
    assert quantiles.median(df.where("k = 'none'"), "v").first()[0] is None


def test_a_hot_group_is_spread_over_ranges(spark):
    """Nine of ten rows, all distinct, are one group: no range holds much more than its share, and ranks are right."""
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
                               ((F.col("id") * 7919) % n).cast("double").alias("v"))
    table = quantiles.ranges(quantiles.value_weights(df, "v", ["k"]), ["k"], ["v"], 20)
    assert table.groupBy("_part").count().agg(F.max("count")).first()[0] < 3 * n / 20
    placed = quantiles.positions(df, ["k"], "v", 20)
    want = placed.groupBy("k").agg(F.count("*").alias("n"), F.max("total").alias("t"), F.min("position").alias("a"),
                                   F.max("position").alias("b"), F.count_distinct("position").alias("d")).collect()
    assert len(want) == 8 and all((r.t, r.a, r.b, r.d) == (r.n, 0, r.n - 1, r.n) for r in want)
    hot = placed.where("k = 'hot'").orderBy("position").select("v").collect()
    assert all(a.v < b.v for a, b in zip(hot, hot[1:]))
    got = {r.k: r.p for r in quantiles.exact_percentiles(df, "v", [0.1, 0.5, 0.99], ["k"], 20).collect()}
    assert np.allclose(got["hot"], np.quantile([r.v for r in hot], [0.1, 0.5, 0.99]))


def test_stats_on_constant_and_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 4.0), ("b", 2.0, 1.0)],
                               "k string, v double, w double")
    assert rows(stats.skewness_by(df, "v", ["k"]), "k", "skewness") == [("a", 0.0), ("b", None)]
    assert rows(stats.correlations(df, "v", ["w"], ["k"]), "corr_w") == [(None,), (None,)]
    one = stats.histogram(df.where("k = 'a'"), "v", 4)
    assert rows(one, "bin", "count") == [(0, 3), (1, 0), (2, 0), (3, 0)]
    assert sum(r["count"] for r in stats.histogram(df, "w", 3).collect()) == 4


@pytest.fixture(scope="module")
def posts(spark):
    pick = random.Random(11)
    roles = ["Data Analyst", "Data Engineer", "Other"]
    data = [(i, datetime(2025, 1, 1) + timedelta(days=pick.randrange(40)), pick.choice(roles),
             pick.choice(["PhD", "Master's", None]), f"firm {pick.randrange(9)}",
             pick.choice([True, False, None]), pick.choice(["CA", "NY", None]),
             pick.choice([None, 0, 2, 3, 5, 9]), float(pick.randrange(1, 9)) * 1000,
             pick.sample(["Python", "SQL", "R"], pick.randrange(4))) for i in range(400)]
    return spark.createDataFrame(data, """seq long, date_posted timestamp_ntz, role_category string,
        education_level string, company string, is_remote boolean, state string,
        years_experience_required int, average_salary double, skills array<string>""")


def test_weekly_shares_add_up(posts):
    mix = trends.weekly_role_mix(posts)
    sums = mix.groupBy("week").agg(F.sum("percentage").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-9 or r.s == 0 for r in sums)
    assert mix.count() == mix.select("week").distinct().count() * 2


def test_cumulative_counts_never_fall_and_dense_form(posts):
    for dense in (False, True):
        mix = trends.cumulative_mix(posts, dense=dense).orderBy("education_level", "day").collect()
        for a, b in zip(mix, mix[1:]):
            assert a.education_level != b.education_level or a.cum_count <= b.cum_count
    assert len(mix) == 2 * len({r.day for r in mix})


def test_wow_change_is_empty_without_a_previous_week(posts):
    flags = metrics.skill_flags(posts, ["Python", "SQL"])
    late = F.lit(datetime(2025, 3, 1)).cast("timestamp_ntz")
    assert trends.wow_change(flags, ["Python", "SQL"], late).count() == 0


def test_compare_of_equal_sets_has_no_delta(posts):
    spec = FilterSpec(state="CA", experience="Entry Level (0-2 yrs)")
    out = compare.compare_kpis(posts, spec, spec).collect()
    assert [r.delta for r in out] == [0.0] * 4
    assert out[0].a == filters.apply_filters(posts, spec).count()


def test_filters_drop_missing_values(posts):
    every = posts.collect()
    for spec, test in (
            (FilterSpec(), lambda r: True),
            (FilterSpec(remote_only=True), lambda r: r.is_remote),
            (FilterSpec(experience="Mid-Level (3-5 yrs)"),
             lambda r: r.years_experience_required in (3, 5)),
            (FilterSpec(education="PhD", state="NY", role="Other"),
             lambda r: (r.education_level, r.state, r.role_category) == ("PhD", "NY", "Other"))):
        assert filters.apply_filters(posts, spec).count() == sum(bool(test(r)) for r in every)


def test_match_parts(posts):
    me = matching.Candidate(("Python",), 2.0, "Master's", "CA")
    scored = matching.score_postings(posts, me).collect()
    for r in scored:
        assert sorted(r.matched_skills + r.missing_skills) == sorted(r.skills)
        assert 0 <= r.match_percentage <= 100
        skill = len(r.matched_skills) / len(r.skills) if r.skills else 0
        need = r.years_experience_required or 0
        want = 60 * skill + 20 * (min(1, 2 / need) if need else 1)
        want += 10 * (V.DEGREE_RANKS.get(r.education_level, 0) <= 2)
        want += 10 * bool(r.is_remote or r.state == "CA")
        assert abs(r.match_percentage - want) <= 0.051


def test_sample_is_repeatable_and_seeded(posts):
    a, b = (rows(matching.sample_rows(posts, 10, "seq"), "seq") for _ in range(2))
    assert a == b and len(a) == 10
    assert rows(matching.sample_rows(posts, 10, "seq", seed=1), "seq") != a
    assert matching.sample_rows(posts.limit(3), 10, "seq").count() == 3


def test_percentiles_of_a_hot_group(spark):
    """One group with nine tenths of the rows, without broadcasts: no task gets the group."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"),
                                       (F.col("id") * 7919 % 20011).cast("double").alias("x"))
        rows = df.collect()
        got = {r.g: r for r in stats.percentiles(df, "x", ["g"], (10, 50, 90)).collect()}
        for g in "ab":
            values = sorted(r.x for r in rows if r.g == g)
            for p in (10, 50, 90):
                at = (len(values) - 1) * p / 100
                low = int(at)
                want = values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])
                assert abs(got[g][f"p{p}"] - want) < 1e-6
        joined = quantiles.join_group_table(df, df.groupBy("g").agg(F.max("x").alias("top")), ["g"], "x")
        sizes = joined.where("g = 'a'").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 18000 * 0.6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_matches_equal_scoring_all_rows(spark):
    """Nulls, equal scores, places, more candidates of one profile than postings, and weights that round together."""
    draw = random.Random(4)
    names = ["a", "b", "c", "d", "e"]
    jobs = [(i, f"t{i}", draw.sample(names, draw.randint(0, 4)), draw.choice([None, 0.0, 3.0, 7.0, 19.0, 20.0, 21.0]),
             draw.choice([None, "PhD", "Master's", "Bachelor's"]), draw.choice([None, True, False]),
             draw.choice([None, "CA", "TX"])) for i in range(400)]
    people = [(i, draw.sample(names, draw.randint(0, 5)), draw.choice([None, 2.0, 18.9, 40.0]),
               draw.choice([None, "PhD", "Master's"]), draw.choice([None, "CA", "OH"])) for i in range(60)]
    people += [(100 + i, ["b", "a"], 5.0, "PhD", "TX") for i in range(30)]
    postings = spark.createDataFrame(jobs, "seq long, title string, skills array<string>, years_experience_required double,"
                                           " education_level string, is_remote boolean, state string")
    candidates = spark.createDataFrame(people, "candidate_id long, technical_skills array<string>, years_experience double,"
                                               " education string, state string")
    rank = {None: 0, "Bachelor's": 1, "Master's": 2, "PhD": 3}
    for weights in (matching.MatchWeights(), matching.MatchWeights(0.9, 0.05, 0.03, 0.02)):
        want = set()
        for c, has, years, degree, home in people:
            scores = []
            for seq, title, needs, need, level, remote, state in jobs:
                both = [s for s in needs if s in has]
                if both:
                    parts = (1.0 if not need else min(1.0, (years or 0.0) / need), float(rank[degree] >= rank[level]),
                             float(bool(remote) or (state is not None and state == home)))
                    score = (weights.skills * (len(both) / len(needs)) + weights.experience * parts[0]
                             + weights.degree * parts[1] + weights.place * parts[2]) * 100
                    rounded = float(Decimal(repr(score)).quantize(Decimal("0.1"), ROUND_HALF_UP))
                    scores.append((-rounded, seq, title, tuple(both)))
            want |= {(c, *s) for s in sorted(scores)[:4]}
        got = matching.match_candidates(candidates, postings, 4, weights=weights).collect()
        assert {(r.candidate_id, -r.match_percentage, r.seq, r.title, tuple(r.matched_skills)) for r in got} == want
        assert len(got) == len(want) and all(not set(r.missing_skills) & set(r.matched_skills) for r in got)
    assert matching.match_candidates(candidates, postings.limit(0)).collect() == []


def test_recent_rows_read_their_months_alone(spark, tmp_path):
    """The bound on the month comes from a scalar that is only known at run time, and changes no row."""
    rows = spark.range(0, 900).select((F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))).alias("date_posted"),
                                      F.col("id").alias("seq"))
    rows.withColumn(filters.MONTH, F.date_format("date_posted", "yyyy-MM")).write.partitionBy(filters.MONTH).parquet(
        str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    as_of = rows.agg(F.max("date_posted")).scalar()
    for days, skip in ((7, 0), (14, 7), (31, 1), (60, 30)):
        got = filters.recent_rows(stored, "date_posted", as_of, days, skip)
        want = filters.recent_rows(rows, "date_posted", as_of, days, skip)
        assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect()) != []
        got.write.format("noop").mode("overwrite").save()
        plan = got._jdf.queryExecution().executedPlan().toString()
        bounds = plan[plan.index("PartitionFilters"):]
        assert "posted_month" in bounds[:300] and "ubquery" in bounds[:600]
