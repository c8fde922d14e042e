"""Rule expressions against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from vacancia.functions import fixed_values as V
from vacancia.functions import pay, rules, text as T


def values(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x")).alias("y")).collect()]


CASES = {
    "cost_tier": (rules.cost_tier, [
        ("San Francisco, CA", 2), ("New York, NY", 2), ("Austin, TX", 1), ("Chicago, IL", 1),
        ("Remote", 0), ("Smalltown, OH", 0), ("London, UK", 0), ("Washington, DC", 0), (None, 0)]),
    "degree_default": (rules.degree_default, [
        ("Must have an advanced degree in Engineering.", "Master's"),
        ("Postgraduate qualification preferred.", "Master's"),
        ("Masters degree in CS.", "Master's"), ("No degree required.", "Bachelor's"),
        ("Ph.D. wanted", "PhD"), (None, None)]),
    "degree_strict": (rules.degree_strict, [
        ("doctoral work", "PhD"), ("Graduate level thinking", "Master's"),
        ("a recent graduate", "Master's"), ("skills in MS Office", "Master's"),
        ("BSc in maths", "Bachelor's"), ("bachelor’s degree", "Bachelor's"),
        ("undergraduates", None), ("phone", None), (None, None)]),
    "role_category": (rules.role_category, [
        ("Senior Data Scientist", "Data Scientist"), ("ML Engineer", "Machine Learning Engineer"),
        ("AI Engineer", "AI Engineer"), ("ETL Lead", "Data Engineer"),
        ("Analytics Engineer", "Data Engineer"), ("Web Analytics", "Data Analyst"),
        ("Java Developer", "Software Engineer"), ("data   scientist", "Other"),
        ("Chef", "Other"), (None, "Other")]),
    "job_type_norm": (rules.job_type_norm, [
        ("Internal", "internship"), (" Part_Time ", "part-time"), ("temporary", "contract"),
        ("CONTRACT", "contract"), ("Full_Time", "fulltime"), ("ft", "fulltime"),
        ("ftx", None), (None, None)]),
    "state_code": (rules.state_code, [
        ("Austin, TX", "TX"), ("Austin, tx ", "TX"), ("Paris, France", None), ("A, B, NY", "NY"),
        ("Remote", None), ("X, 12", None), (None, None)]),
    "state_raw": (rules.state_raw, [("Paris, France", "France"), ("Remote", None), (None, None)]),
    "extract_years": (rules.extract_years, [
        ("5+ years of experience", 5), ("3-5 years experience", 5), ("2-4 years building", 2),
        ("minimum of 3 years", 3), ("Entry-level role", 0), ("new grad", 0), ("0-2 years", 0),
        ("10 Years Experience, minimum 2 years", 10), ("many years", None), (None, None)]),
    "years_from_title": (rules.years_from_title, [
        ("Director of Data", 15.0), ("VP of Data", 10.0), ("Head of Data", 10.0),
        ("Staff Engineer", 8.0), ("Team Lead", 6.0), ("Engineer Sr", 5.0), ("Engineer (Sr)", 5.0),
        ("Engineer III", 5.0), ("Engineer IV", 5.0), ("Engineer II", 3.0), ("Mid-Level Dev", 3.0),
        ("Engineer I", 1.0), ("Jr. Dev", 1.0), ("Dev jr", 1.0), ("Intern", 0.0),
        ("Developer", None), (None, None)]),
    "norm_text": (T.norm_text, [
        ("  Data \t\n  SCIENTIST ", "data scientist"), (" x y ", "x y"), ("   ", None),
        ("", None), (None, None)]),
    "norm_url": (T.norm_url, [
        ("HTTP://Www.X.com/A%20b/?q=1#f", "http://www.x.com/A b"), ("https://x.com", "https://x.com/"),
        ("https://x.com/", "https://x.com/"), ("https://x.com/a//", "https://x.com/a"),
        ("//X.com/a+b", "https://x.com/a+b"), ("www.x.com/a", "https://www.x.com/a"),
        ("https://x.com/100%/a%20b", "https://x.com/100%/a b"),
        ("https://[Bad/A", "https://[bad/a"), (None, None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    function, cases = CASES[name]
    assert values(spark, function, [c for c, _ in cases]) == [e for _, e in cases]


def test_every_ladder_word_hits_its_rung(spark):
    for rule, ladder in ((rules.cost_tier, V.COST_TIERS),
                         (rules.role_category, V.ROLE_RULES),
                         (rules.job_type_norm, V.JOB_TYPE_RULES)):
        words = [(w, value) for value, ws in ladder for w in ws]
        got = values(spark, rule, [f"x{w}" if w.startswith(" ") else w for w, _ in words])
        order = [value for value, _ in ladder]
        # an earlier rung may claim the word, a later one never does
        assert all(order.index(g) <= order.index(v) for g, (_, v) in zip(got, words))


def test_strict_words(spark):
    df = spark.createDataFrame([("Director of Data",), ("Data Engineer",)], "x string")
    got = [r[0] for r in df.select(rules.years_from_title("x", strict_words=True)).collect()]
    assert got == [10.0, None]


SKILL_TEXTS = {
    "HTML and CSS": ["Machine Learning"], "R.": [], "your team": [], "uses R and": ["R"],
    "uses r": ["R"], "R 4": ["R"], "Python3": [], "c-python, SQL!": ["Python", "SQL"],
    "mysql": [], "Amazon Web Services": ["AWS"], "k8s/Docker": ["Docker", "Kubernetes"],
    "digital github git": ["Git"], "A/B tests; statistical": ["A/B Testing", "Statistics"],
    "": [],
}


def test_skills(spark):
    got = values(spark, lambda x: T.keyword_list(F.lower(x), V.SKILL_PATTERNS), list(SKILL_TEXTS))
    assert got == list(SKILL_TEXTS.values())


def test_skill_flags_equal_plain_regex(spark):
    """The cheap tests in front of a pattern change no result."""
    texts = [f"{a}{s}{b}" for s in ("python", "r", "sql", "ml", "aws", "git", "spark", "b r", "k8s")
             for a in ("", " ", "x", "x ", "-", "_") for b in ("", " ", "s", ".", "_", " z")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    flags = T.keyword_flags("t", V.SKILL_PATTERNS)
    wrong = [F.count_if(flags[n] != F.col("t").rlike(p)).alias(n)
             for n, p in V.SKILL_PATTERNS.items()]
    assert sum(df.agg(*wrong).first()) == 0
    assert df.agg(*[F.count_if(f) for f in flags.values()]).first() != (0,) * len(flags)


def test_null_text_has_no_flags(spark):
    df = spark.createDataFrame([(None,)], "t string")
    flags = T.keyword_flags("t", V.SKILL_PATTERNS)
    assert not any(df.select(*flags.values()).first())


def test_annualize(spark):
    rows = [(10.0, 20.0, "hourly"), (1.0, 2.0, "weekly"), (1.0, 2.0, "monthly"),
            (5.0, 6.0, "yearly"), (5.0, 6.0, None), (None, 6.0, "hourly"), (5.0, None, "weekly")]
    df = spark.createDataFrame(rows, "a double, b double, p string")
    got = [tuple(r) for r in df.select(*pay.annualize("a", "b", "p")).collect()]
    assert got == [(20800, 41600), (52, 104), (12, 24), (5, 6), (5, 6), (None, None), (None, None)]


def test_encode_label_is_alphabetical(spark):
    got = values(spark, rules.encode_label, ["Bachelor's", "Master's", "No education", "PhD", "?", None])
    assert got == [0, 1, 2, 3, 2, 2]


def test_clip_percent_and_casts(spark):
    df = spark.createDataFrame([(30.0, 0, "x", "2025-01-32"), (None, 4, "2.5", "2025-01-31")],
                               "a double, n int, s string, d string")
    got = df.select(pay.clip_upper("a", 25), pay.percent(F.lit(1), "n"), pay.to_number("s"),
                    pay.to_time("d").cast("string")).collect()
    assert [tuple(r) for r in got] == [(25.0, 0.0, None, None), (None, 25.0, 2.5, "2025-01-31 00:00:00")]


def test_week_starts_on_monday(spark):
    got = values(spark, lambda x: pay.week_start(x).cast("string"),
                 ["2025-11-02", "2025-11-03", "2025-11-09"])
    assert got == ["2025-10-27", "2025-11-03", "2025-11-03"]


@pytest.mark.parametrize("reply, ids", [
    ('```json\n[{"id": 1}, {"match_percentage": 3}]\n``` tail', ["1", None]),
    ('```\n[{"id": "a"}]\n```', ["a"]), ('[{"id": "a"}]', ["a"]), ('{"id": "a"}', []),
    ("[{", []), ("no json", []), ("[]", [])])
def test_parse_reply(spark, reply, ids):
    df = spark.createDataFrame([(reply,)], "t string")
    got = df.select(F.explode(T.parse_reply("t")).alias("i")).select("i.id").collect()
    assert [r[0] for r in got] == ids


def test_patterns_know_unicode(spark):
    """A no-break space is white space, an accented letter is part of its word."""
    texts = ["5 years\u00a0experience", "git\u00e9 pythoné", "é git, python", "un bac\u00a0master\u2019s", "bs\u00e9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(
        rules.extract_years("t").alias("y"), T.keyword_list("t", V.SKILL_PATTERNS).alias("s"),
        rules.degree_strict("t").alias("d")).collect()
    assert [r.y for r in got] == [5, None, None, None, None]
    assert [r.s for r in got] == [[], [], ["Python", "Git"], [], []]
    assert [r.d for r in got] == [None, None, None, "Master's", None]


def test_foreign_patterns_are_not_gated(spark):
    df = spark.createDataFrame([("il faut 7 ans, doctorat",)], "t string")
    got = df.select(rules.extract_years("t", (r"(\d+) ans",)).alias("y"),
                    rules.degree_strict("t", (("PhD", r"\bdoctorat\b"),)).alias("d")).first()
    assert (got.y, got.d) == (7, "PhD")
