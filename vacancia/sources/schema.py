"""Table schemas. Every field is nullable."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)


def _fields(kind, names: str):
    return [StructField(n, kind) for n in names.split()]


_TEXT, _NUMBER, _TIME = StringType(), DoubleType(), TimestampNTZType()

# CSV text that does not parse as its type becomes null.
RAW_POSTINGS = StructType(
    _fields(_TEXT, "id title company location job_url description")
    + _fields(_NUMBER, "min_amount max_amount") + _fields(_TEXT, "interval")
    + _fields(BooleanType(), "is_remote") + _fields(_TEXT, "job_type")
    + _fields(_TIME, "date_posted") + _fields(_TEXT, "search_term search_location")
    + _fields(_TIME, "scraped_date"))

CANDIDATES = StructType(
    _fields(_TEXT, "candidate_id") + _fields(ArrayType(_TEXT), "technical_skills")
    + _fields(_NUMBER, "years_experience") + _fields(_TEXT, "education")
    + _fields(ArrayType(_TEXT), "key_projects"))

MODEL_REGISTRY = StructType(
    _fields(_TEXT, "role model_name") + _fields(_NUMBER, "r2 mae rmse")
    + _fields(LongType(), "n_rows") + _fields(ArrayType(_TEXT), "top_skills all_skills feature_names")
    + _fields(ArrayType(StructType(_fields(_TEXT, "model") + _fields(_NUMBER, "mean_r2 std_r2"))),
              "cv_scores")
    + _fields(_TEXT, "path status"))
