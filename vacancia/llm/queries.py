"""The registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacancia.sources.workspace import new_path

from . import (
    archives, bpe, conversations, fingerprints, language, licenses, manifest, near, packing, pseudonyms, sharding,
    token_counts, topk)
from .tables import read

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text."""
    return licenses.scan(read(spark, sf_dir, "documents"))


PSEUDONYM_KEY = "public example key"  # a parameter: whoever runs this on real data brings their own


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with its personal data replaced by format-preserving pseudonyms."""
    return pseudonyms.pseudonymize(read(spark, sf_dir, "documents"), PSEUDONYM_KEY).select(
        "doc_id", "text", "n_values")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text and its edited text as bottom-k sketches."""
    marks = fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))
    return marks.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text("sketch").alias("fingerprint"),
        fingerprints.as_text("edited_sketch").alias("edited_fingerprint"),
        "near_edited", "near_next")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal texts, its links and its group."""
    return near.near_duplicates(read(spark, sf_dir, "documents")).drop("node", "root")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by the byte network."""
    documents = read(spark, sf_dir, "documents")
    model = language.fit(documents)
    return language.predict(documents.select("doc_id", "text"), model).select(
        "doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, by distinct pre-tokens."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every hundredth vector among all others."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again, as digests."""
    encoded = bpe.encode(read(spark, sf_dir, "documents"), WORD_VOCABULARY)
    both = bpe.decode(encoded.withColumn("ids_sha256", F.sha2("token_ids", 256)), WORD_VOCABULARY)
    return both.select("doc_id", "n_tokens", "ids_sha256",
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), BYTE_VOCABULARY, end_id=1)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by jump consistent hashing of doc_id."""
    documents = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"))
    return sharding.shard(documents, 16).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"),
        "grown_shard")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the planted damage: its faults and its cheapest repair."""
    rows = conversations.damaged(read(spark, sf_dir, "conversations"))
    return conversations.repair(rows).withColumnRenamed("conv", "conv_id")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of the manifest, with its proof, checked against the rows as they may have become."""
    return manifest.manifest(read(spark, sf_dir, "documents"),
                             tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in legacy archives, converted to WARC archives and read back."""
    old, new = new_path(spark, "arc"), new_path(spark, "warc")
    archives.write_arc(read(spark, sf_dir, "pages"), old)
    archives.convert(spark, old, new)
    return archives.read_warc(spark, new).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (
    op1_licenses, op2_pseudonyms, op3_fingerprints, op4_near_duplicates, op5_language, op6_token_counts, op7_top_k, op8_bpe, op9_packing, op10_sharding,
    op11_conversation_repair, op12_manifest, op13_warc)}
SQL: dict[str, str] = {
    "op4_near_duplicates": r"""
with recursive c as (select coalesce(text, '') as body, min(doc_id) as class_id, count(*) as copies
  from documents group by 1),
w as (select class_id, regexp_extract_all(lower(body), '(?:[0-9a-z]|[^\x00-\x7F])+') as ws from c),
s as (select distinct class_id, unnest(case when len(ws) >= 5
    then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from w),
n as (select class_id, count(*) as n from s group by 1),
p as (select a.class_id as x, b.class_id as y, count(*) as shared from s a join s b
  on a.shingle = b.shingle and a.class_id <> b.class_id group by 1, 2),
l as (select x, y from p join n nx on nx.class_id = x join n ny on ny.class_id = y
  where shared >= 0.8 * (nx.n + ny.n - shared) - 1e-9),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
k as (select x, count(*) as links from l group by 1),
g as (select x, min(y) as low from r group by 1)
select d.doc_id, c.class_id, copies, coalesce(links, 0) as links,
 least(c.class_id, coalesce(low, c.class_id)) as group_id
from documents d join c on coalesce(d.text, '') = body left join k on k.x = class_id left join g on g.x = class_id""",
    "op7_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) q
           from embeddings where embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (select a.vec_id query_id, b.vec_id,
             cast(list_inner_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 10""",
}
