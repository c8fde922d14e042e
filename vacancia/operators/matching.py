"""Sampling, candidate profiles, match scores and skill gaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import SKILL_PATTERNS
from ..functions.rules import degree_rank, degree_strict, extract_years
from ..functions.text import col, keyword_list, parse_reply, truncate
from ..sources.workspace import materialize
from .dedupe import top_n_per_group


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the same for the same seed: smallest keyed hashes, no shuffle."""
    draw = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return df.orderBy(draw, key).limit(n)


def top_rows(df: DataFrame, value: str, key, k: int = 5) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(value), key).limit(k)


def posting_digest(df: DataFrame, skills: str = "skills", limit: int = 10) -> DataFrame:
    """Short form of a posting: at most `limit` skills and a text snippet."""
    def known(c):
        return F.coalesce(F.col(c), F.lit("Unknown")).alias(c)
    return df.select("seq", known("title"), known("company"), known("location"),
                     F.slice(skills, 1, limit).alias("required_skills"),
                     truncate("description").alias("snippet"))


def candidate_profiles(df: DataFrame, text: str, key: str, patterns=SKILL_PATTERNS) -> DataFrame:
    """Skills, years and degree named in plain texts."""
    low = df.withColumn("_low", F.lower(text))
    return low.select(F.col(key).alias("candidate_id"),
                      keyword_list("_low", patterns).alias("technical_skills"),
                      extract_years("_low", lowered=True).cast("double").alias("years_experience"),
                      degree_strict("_low", lowered=True).alias("education"))


@dataclass(frozen=True)
class MatchWeights:
    """Weights of the four parts of a score; they should add up to 1."""

    skills: float = 0.6
    experience: float = 0.2
    degree: float = 0.1
    place: float = 0.1


def match_parts(candidate: dict[str, Column], posting: dict[str, Column]) -> dict[str, Column]:
    """What a match is worth beside skills: experience, degree and place, each from 0 to 1."""
    need = posting["years"]
    has = F.coalesce(candidate["years"], F.lit(0.0))
    return {
        "experience": F.when(F.coalesce(need, F.lit(0)) <= 0, 1.0).otherwise(
            F.least(F.lit(1.0), has / F.nullif(need, F.lit(0)))),
        "degree": F.when(degree_rank(candidate["degree"]) >= degree_rank(posting["degree"]), 1.0).otherwise(0.0),
        "place": F.when(F.coalesce(posting["remote"], F.lit(False)) |
                        F.coalesce(posting["state"] == candidate["state"], F.lit(False)), 1.0).otherwise(0.0)}


def match_score(skills: Column, parts: dict[str, Column], weights: MatchWeights) -> Column:
    """Score 0..100 from the share of required skills and the other parts."""
    score = (weights.skills * skills + weights.experience * parts["experience"] +
             weights.degree * parts["degree"] + weights.place * parts["place"])
    return F.round(score * 100, 1)


def match_columns(candidate: dict[str, Column], posting: dict[str, Column],
                  weights: MatchWeights = MatchWeights()) -> dict[str, Column]:
    """Score 0..100 with the matched and the missing skills."""
    required = posting["skills"]
    matched = F.array_intersect(required, candidate["skills"])
    skills = F.when(F.size(required) > 0, F.size(matched) / F.size(required)).otherwise(0.0)
    return {"match_percentage": match_score(skills, match_parts(candidate, posting), weights),
            "matched_skills": matched, "missing_skills": F.array_except(required, candidate["skills"])}


@dataclass(frozen=True)
class Candidate:
    """One candidate, as constants of a plan."""

    skills: tuple[str, ...]
    years: float | None = None
    degree: str | None = None
    state: str | None = None

    def columns(self) -> dict[str, Column]:
        return {"skills": F.array(*map(F.lit, self.skills)).cast("array<string>"),
                "years": F.lit(self.years).cast("double"),
                "degree": F.lit(self.degree).cast("string"),
                "state": F.lit(self.state).cast("string")}


def _posting(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + c) for k, c in {
        "skills": "skills", "years": "years_experience_required", "degree": "education_level",
        "remote": "is_remote", "state": "state"}.items()}


def score_postings(postings: DataFrame, candidate: Candidate,
                   weights: MatchWeights = MatchWeights()) -> DataFrame:
    """Every posting scored against one candidate: a projection, no join."""
    return postings.withColumns(match_columns(candidate.columns(), _posting(), weights))


_PROFILE = ["skills", "years_experience_required", "education_level", "is_remote", "state"]
_REST = ["years_experience", "education", "person_state"]
_PARTS = ["experience", "degree", "place"]


def match_candidates(candidates: DataFrame, postings: DataFrame, k: int = 5, key: str = "seq",
                     weights: MatchWeights = MatchWeights()) -> DataFrame:
    """The k best postings of each candidate among all that share a skill with them.

    A threshold join over lists of postings. A list holds the postings that require
    one set of skills, for candidates alike in experience, degree and place, best
    first; it needs no more than its k best (and what rounding may lift to them), and postings
    of equal parts no more than their k first. For a candidate, the share of their skills moves
    a list up or down as a whole, so its first posting bounds all others: only the k lists
    with the best first postings are read, since k postings are at least as good as
    the first of any other list. Lists depend on distinct profiles, not on rows:
    candidates and postings are never paired. Ties go to the smaller key. A
    candidate who shares no skill with any posting gets no row. Candidates and lists
    are stored when this is called, since texts are usually searched for the former.
    """
    shown = [c for c in ("title", "company", "location", "average_salary") if c in postings.columns]
    people = candidates.withColumn(
        "person_state", F.col("state") if "state" in candidates.columns else F.lit(None).cast("string"))
    people = people.select("candidate_id", "technical_skills", *_REST, _fingerprint(["technical_skills", *_REST]).alias(
        "person"), _fingerprint(_REST).alias("rest"))
    people = materialize(people, "candidates")
    persons = people.drop("candidate_id").dropDuplicates(["person"])
    lists = materialize(_best_lists(persons, postings.select(
        F.struct(F.col(key), *shown).alias("posting"), *_PROFILE, _fingerprint(_PROFILE).alias("profile")), k, weights), "lists")

    sets = lists.select("skills").distinct().select("skills", F.explode(F.array_distinct("skills")).alias("skill"))
    held = persons.select("technical_skills").distinct().select(
        "technical_skills", F.explode(F.array_distinct("technical_skills")).alias("skill"))
    # Two sets meet on every common skill and are kept on the first one, so no pair comes twice.
    overlaps = held.join(sets, "skill").withColumn(
        "matched_skills", F.array_intersect("skills", "technical_skills")).where(
        F.col("skill") == F.element_at(F.array_compact("matched_skills"), 1)).drop("skill").withColumn(
        "share", F.size("matched_skills") / F.size("skills"))

    def score(entry: Column) -> Column:
        return match_score(F.col("share"), {p: entry[p] for p in _PARTS}, weights)
    heads = (persons.select("person", "technical_skills", "rest").join(overlaps, "technical_skills")
             .join(lists, ["rest", "skills"])
             .withColumn("head", F.array_min(F.transform("entries", lambda e: F.struct(
                 (-score(e)).alias("minus"), e["postings"][0].alias("posting"))))))
    read = top_n_per_group(heads, ["person"], [F.col("head.minus"), F.col("head.posting")], k)
    entries = read.withColumn("entry", F.explode("entries")).withColumn(
        "match_percentage", score(F.col("entry"))).withColumn("posting", F.explode("entry.postings"))
    best = top_n_per_group(entries, ["person"], [F.col("match_percentage").desc(), F.col("posting")], k).select(
        "person", "posting.*", "match_percentage", "matched_skills",
        F.array_except("skills", "technical_skills").alias("missing_skills"))
    return people.select("candidate_id", "person").join(best, "person").select(
        "candidate_id", key, *shown, "match_percentage", "matched_skills", "missing_skills")


def _best_lists(persons: DataFrame, jobs: DataFrame, k: int, weights: MatchWeights) -> DataFrame:
    """rest, skills, entries: per kind of person and required set, the best postings beside skills.

    An entry has the parts of a score and the k first postings (by key) with these parts.
    """
    firsts = top_n_per_group(jobs, ["profile"], [F.col("posting")], k)
    profiles = firsts.groupBy("profile").agg(*(F.first(c).alias(c) for c in _PROFILE),
                                             F.collect_list("posting").alias("postings"))
    kinds = persons.select("rest", *_REST, F.explode(F.array_distinct("technical_skills")).alias("skill")).distinct()
    sets = profiles.select("skills").distinct().select("skills", F.explode(F.array_distinct("skills")).alias("skill"))
    met = kinds.join(sets, "skill").drop("skill").dropDuplicates(["rest", "skills"])
    person = {"years": F.col("years_experience"), "degree": F.col("education"), "state": F.col("person_state")}

    def first(postings: Column) -> Column:
        return F.slice(F.array_sort(postings), 1, k)
    entries = (met.join(profiles, "skills").withColumns(match_parts(person, _posting()))
               .groupBy("rest", "skills", *_PARTS).agg(
                   first(F.flatten(F.collect_list("postings"))).alias("postings"))
               .withColumn("worth", weights.experience * F.col("experience") + weights.degree * F.col("degree")
                           + weights.place * F.col("place")))
    lists = entries.groupBy("rest", "skills").agg(
        F.sort_array(F.collect_list(F.struct("worth", *_PARTS, "postings")), asc=False).alias("entries"))
    # The worth of the k-th posting; rounding to a tenth of a percent may lift what is less than that below.
    worths = F.slice(F.flatten(F.transform("entries", lambda e: F.array_repeat(e["worth"], F.size(e["postings"])))), 1, k)
    least = F.when(F.size(worths) < k, float("-inf")).otherwise(F.array_min(worths)) - 0.0011
    return lists.withColumn("least", least).select(
        "rest", "skills", F.filter("entries", lambda e: e["worth"] >= F.col("least")).alias("entries"))


def _fingerprint(columns) -> Column:
    """The fields as one text; equal for equal profiles, nulls included."""
    return F.to_json(F.struct(*columns))


def best_matches(matches: DataFrame, k: int = 5, key: str = "seq") -> DataFrame:
    """The k best postings of each candidate."""
    return top_n_per_group(matches, ["candidate_id"],
                           [F.col("match_percentage").desc(), F.col(key)], k)


def match_summary(matches: DataFrame, good: float = 70.0) -> DataFrame:
    score = F.col("match_percentage")
    return matches.agg(F.avg(score).alias("avg_match"), F.count_if(score >= good).alias("good"),
                       F.count("*").alias("total"), F.max(score).alias("best"))


def skill_gap(matches: DataFrame, k: int = 10) -> DataFrame:
    """Skills missing most often."""
    gaps = matches.select(F.explode("missing_skills").alias("skill"))
    return gaps.groupBy("skill").agg(F.count("*").alias("count")).orderBy(
        F.desc("count"), "skill").limit(k)


def reply_matches(replies: DataFrame, reply: str, postings: DataFrame, key: str = "id") -> DataFrame:
    """Items of structured replies joined to their postings.

    Items without id and items of unknown postings are dropped; missing
    fields get their defaults.
    """
    item = F.explode(parse_reply(reply)).alias("item")
    rows = replies.select(item).where(F.col("item.id").isNotNull())
    empty = F.array().cast("array<string>")
    rows = rows.select(
        F.col("item.id").alias(key),
        F.coalesce("item.match_percentage", F.lit(0.0)).alias("match_percentage"),
        F.coalesce("item.matched_skills", empty).alias("matched_skills"),
        F.coalesce("item.missing_skills", empty).alias("missing_skills"),
        F.coalesce("item.explanation", F.lit("")).alias("explanation"))
    known = postings.withColumn(key, col(key).cast("string"))
    return rows.join(known, key)
