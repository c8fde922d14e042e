"""Word lists, patterns and constants that decide results.

They are data, not logic: every rule function takes them as a parameter, so a
caller can pass another table of the same shape.
"""

# Pay periods and the factor that turns them into a year.
# A period that is not listed is taken as already annual.
PERIODS_PER_YEAR = {"hourly": 2080, "monthly": 12, "weekly": 52}

# Plausible annual pay, both ends included.
PAY_RANGE = (30000.0, 500000.0)

# Skill name -> pattern, matched on lower-cased text.
SKILL_PATTERNS = {
    "Python": r"\bpython\b",
    "R": r"\b r\b|\br\s",
    "SQL": r"\bsql\b",
    "Machine Learning": r"machine learning|ml\b",
    "Deep Learning": r"deep learning|neural network",
    "NLP": r"\bnlp\b|natural language",
    "TensorFlow": r"tensorflow",
    "PyTorch": r"pytorch",
    "Scikit-learn": r"scikit-learn|sklearn",
    "Pandas": r"\bpandas\b",
    "NumPy": r"numpy",
    "Tableau": r"tableau",
    "Power BI": r"power bi|powerbi",
    "AWS": r"\baws\b|amazon web services",
    "Azure": r"\bazure\b",
    "GCP": r"\bgcp\b|google cloud",
    "Spark": r"\bspark\b",
    "Hadoop": r"hadoop",
    "Docker": r"docker",
    "Kubernetes": r"kubernetes|k8s",
    "Git": r"\bgit\b",
    "A/B Testing": r"a/b test|ab test",
    "Statistics": r"statistics|statistical",
    "Data Visualization": r"data visualization|data viz",
}

# Years of experience stated in a text, tried in this order, and
# the phrases that mean zero years.
YEARS_PATTERNS = (
    r"(\d+)\+?\s*years?\s*(?:of\s*)?experience",
    r"(\d+)-(\d+)\s*years",
    r"minimum\s*(?:of\s*)?(\d+)\s*years?",
)
YEARS_GATE = "year"  # a text without it matches none of these patterns
# What any match of these patterns holds: a number before "year".
YEARS_STATED = "#year"
ENTRY_LEVEL_PATTERN = r"entry.level|junior|new grad|0-2 years"

# Degree patterns on lower-cased text, highest degree first.
DEGREE_STRICT = (
    ("PhD", r"\b(ph\.?d|doctorate|doctoral)\b"),
    ("Master's", r"graduate level"),
    ("Master's", r"\b(master['’`s]*|m\.sc\.|msc\b|m\.s\.|ms\b|graduate|grad)\b"),
    ("Bachelor's", r"\b(bachelor['’`s]*|b\.sc\.|bsc\b|b\.s\.|bs\b)\b"),
)
DEGREE_DEFAULT = (
    ("PhD", r"\b(ph\.?d|doctorate|doctoral)\b"),
    ("Master's", r"\b(postgraduate|advanced degree|advanced education)\b"),
    ("Master's", r"\b(master[''`s]*|masters|m\.sc\.|msc\b|m\.s\.|ms\b)\b"),
)
# A text that holds none of these words cannot match the degree's patterns.
DEGREE_WORDS = {
    "PhD": ("ph", "doctora"),
    "Master's": ("master", "m.s", "ms", "grad", "advanced"),
    "Bachelor's": ("bachelor", "b.s", "bs"),
}
# The strict patterns as plain alternatives, and alternatives that leave it to the pattern. A quote ends the
# word before it, so only an "s" matters after "master" and "bachelor".
DEGREE_FORMS = {
    r"\b(ph\.?d|doctorate|doctoral)\b": (r"\bphd\b|\bph\.d\b|\bdoctorate\b|\bdoctoral\b", None),
    r"graduate level": (r"graduate level", None),
    r"\b(master['’`s]*|m\.sc\.|msc\b|m\.s\.|ms\b|graduate|grad)\b":
        (r"\bmaster\b|\bmasters\b|\bm\.sc\.\b|\bmsc\b|\bm\.s\.\b|\bms\b|\bgraduate\b|\bgrad\b", r"\bmasterss"),
    r"\b(bachelor['’`s]*|b\.sc\.|bsc\b|b\.s\.|bs\b)\b":
        (r"\bbachelor\b|\bbachelors\b|\bb\.sc\.\b|\bbsc\b|\bb\.s\.\b|\bbs\b", r"\bbachelorss"),
}
DEGREE_FALLBACK = "Bachelor's"
NO_DEGREE = "No education"
# Label codes follow the alphabet, not the rank of the degree.
DEGREE_CODES = {"Bachelor's": 0, "Master's": 1, "No education": 2, "PhD": 3}
DEGREE_RANKS = {"No education": 0, "Bachelor's": 1, "Master's": 2, "PhD": 3}

# Role ladder, substrings of the lower-cased title, first hit wins.
ROLE_RULES = (
    ("Data Scientist", ("data scientist", "research scientist")),
    ("Machine Learning Engineer",
     ("machine learning", "ml engineer", "applied scientist", "deep learning")),
    ("AI Engineer", ("ai engineer", "artificial intelligence")),
    ("Data Engineer",
     ("data engineer", "etl", "analytics engineer", "analytics specialist")),
    ("Data Analyst",
     ("data analyst", "analyst", "analytics", "business intelligence")),
    ("Software Engineer", ("software engineer", "developer")),
)
OTHER_ROLE = "Other"

# Canonical job types and the substrings that mean them.
JOB_TYPE_RULES = (
    ("internship", ("intern",)),
    ("part-time", ("part",)),
    ("contract", ("contract", "temp")),
    ("fulltime", ("full",)),
)
JOB_TYPE_EXACT = {"ft": "fulltime"}

# Cost-of-living tiers, substrings of the lower-cased location.
COST_TIERS = (
    (2, ("san francisco", "bay area", "new york", "nyc", "seattle", "boston",
         "los angeles", "washington dc", "d.c.", "silicon valley", "california",
         " ca", " ny", " wa", " ma")),
    (1, ("austin", "chicago", "denver", "atlanta", "philadelphia", "phoenix",
         "dallas", "houston", "miami", "texas", " tx", "colorado", " co",
         "illinois", " il", "georgia", " ga", "florida", " fl")),
)

# Years of experience a title stands for:
# (years, substrings, endings), first hit wins.
TITLE_YEARS = (
    (15.0, ("chief", "cto", "cio", "cdo", "ciso", "svp", "evp"), ()),
    (10.0, ("vice president", " vp", "vp ", "director", "head of"), ()),
    (8.0, ("principal", "staff", "distinguished", "architect", "fellow"), ()),
    (6.0, ("manager", "lead", "supervisor"), ()),
    (5.0, ("senior", "expert", "advanced", "sr.", "sr ", "(sr)",
           " iv", " v ", " vi ", " iii"), (" sr",)),
    (3.0, ("intermediate", "mid-level", "mid level", "middle", " ii"), ()),
    (1.0, ("junior", "jr.", "jr ", "associate", "(jr)", " i "), (" jr", " i")),
    (0.0, ("entry", "intern", "trainee", "apprentice", "graduate", "fresh",
           "new grad"), ()),
)
DEFAULT_YEARS = 2.0

# Alias lists, first present column wins.
TITLE_ALIASES = ("title", "job_title")
COMPANY_ALIASES = ("company", "company_name")
LOCATION_ALIASES = ("location",)
LINK_ALIASES = ("link", "job_url", "job_url_direct")
TEXT_ALIASES = ("requirements", "description", "job_description",
                "full_description", "posting_text")

# Age windows in hours (newest, oldest) of a balanced collection,
# and the locations one site cannot serve.
AGE_WINDOWS = ((0, 168), (168, 336), (336, 504), (504, 720))
RECENT_WINDOW = ((0, 48),)
BROAD_LOCATIONS = ("united states", "remote")

# Text that a CSV reader takes as missing.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
               "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
               "None", "n/a", "nan", "null")
