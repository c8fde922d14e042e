"""The one-pass search says what the regexes say, whatever stands next to a word."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacancia.functions import fixed_values as V, rules as R, search, text as T
from vacancia.plans.enrich import add_text_features, lower_once

_PIECES = ["python", "sql", "r", " r", "ml", "html", "power bi", "k8s", "git", "digit", "ph.d", "phd", "m.s.", "m.sc.a",
           "masters", "master's", "undergraduate level", "bachelor", "bs", "b.s.x", "entry level", "entry\nlevel", "5 years",
           "3+ years of experience", "2-4 years", "minimum of 7 years", "٣ years experience", "experience", "0-2 years",
           "new grad", "a/b test", "é", "ß", "́", " ", "\x85", "\x1c", "‍", "日本", "_", "1", "-", ".", "'", "\n", " ",
           "\t", "İ", "", "data viz"]


def _texts(n):
    pick = random.Random(3)
    texts = ["".join(pick.choices(_PIECES, k=pick.randint(0, 9))) for _ in range(n)]
    return texts + _PIECES + [None, "r", "r ", " r", "ml", "x" * 3_000_000 + " python", "python" + "y" * 1_100_000]


@pytest.mark.parametrize("batch", [7, 10_000])
def test_search_agrees_with_regexes(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(list(enumerate(_texts(3000))), "seq long, description string")
        new = add_text_features(df).select("seq", "skills", "years_experience_required", "education_level").collect()
        old = lower_once(df, "description").select(
            "seq", T.keyword_list("_low", V.SKILL_PATTERNS).alias("skills"),
            R.extract_years("_low", lowered=True).alias("years_experience_required"),
            R.degree_strict("_low", lowered=True).alias("education_level")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(new, key=lambda r: r.seq) == sorted(old, key=lambda r: r.seq)
    assert {s for r in old for s in r.skills} >= {"Python", "R", "SQL", "Git", "Machine Learning"}


def test_words_are_searched_once(spark):
    """One search for all words: no plain search per word is left in the plan."""
    df = spark.createDataFrame([("python",)], "description string")
    plan = add_text_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "tensorflow)" not in plan


def test_more_words_than_a_number_has_bits(spark):
    patterns = {f"w{i}": rf"\bword{i}\b" for i in range(150)} | {"Upper": "[A-Z]+x"}
    df = spark.createDataFrame([("word7 word149 xword8 word90é",)], "description string")
    assert add_text_features(df, patterns=patterns).select("skills").first()[0] == ["w7", "w149"]


def test_no_text_and_no_rows(spark):
    df = spark.createDataFrame([(None,), ("",)], "description string")
    assert [r.skills for r in add_text_features(df).collect()] == [[], []]
    assert add_text_features(df.where(F.lit(False))).count() == 0


def test_nothing_is_left_open_beside_latin_letters(spark):
    """Letters and quotes outside ASCII decide a boundary, and years and degrees need no regex either."""
    texts = ["für rüber", "“python”–sql… master’s", "PYTHON École: SQL", "DOCKER İ RK8S", "Bachelors’ 5 YEARS EXPERIENCE",
             "3-5 years", "minimum of 4 years", "1-2-3 years", "5+ years experience 2 years experience", "minimum 7+ years",
             "x 12 year of experience", "9 years, minimum 2 years", "é5 years experience", "5 years experience",
             "99999999999999999999 years experience 4-6 years", "6  + years experience", "7 + years experience", "-3 years",
             "4-٣ years", "masterss", "bachelorss'", "master`x", "years experience", "8 yearsexperience",
             "3 years of experience", "3 years offexperience", "+ years experience", "minimum of4 years", "ofminimum 4 years"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, description string").repartition(3)
    new = add_text_features(df).select("seq", "skills", "years_experience_required", "education_level").collect()
    old = lower_once(df, "description").select(
        "seq", T.keyword_list("_low", V.SKILL_PATTERNS).alias("skills"),
        R.extract_years("_low", lowered=True).alias("years_experience_required"),
        R.degree_strict("_low", lowered=True).alias("education_level")).collect()
    assert sorted(new, key=lambda r: r.seq) == sorted(old, key=lambda r: r.seq)
    words = [search.plain(p) for p in search.TextSearch([*V.SKILL_PATTERNS.values(), V.YEARS_STATED]).words]
    _, open_, years = search.find(pa.array(texts[:12]), words)
    assert not open_.any() and search.OPEN not in years


def test_years_agree_with_regexes(spark):
    pick = random.Random(5)
    parts = ["1", "25", "0", "+", "-", " ", "  ", "\n", "year", "years", "of", "experience", "minimum", "é", " ", "٣",
             "x", " years of experience", "minimum of ", "-5 years ", "9" * 17]
    texts = ["".join(pick.choices(parts, k=pick.randint(2, 12))) for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, description string")
    both = lower_once(add_text_features(df), "description").select(
        "description", "years_experience_required", R.extract_years("_low", lowered=True).alias("expected"))
    assert not both.where(~F.col("expected").eqNullSafe(F.col("years_experience_required"))).take(3)
    assert both.where("expected is not null").count() > 1000
