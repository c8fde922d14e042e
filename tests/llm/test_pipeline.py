"""The pipeline: each stage against its own rule, and as a whole."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vacancia.llm import language, near, pseudonyms
from vacancia.llm.tables import read

SF = "/root/testdata/sf0.001"


def test_stages_do_their_work(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        results.append(docs)
    known, single, hidden, packed = results
    assert known.columns == single.columns == hidden.columns == columns
    assert known.count() == before  # all test documents are in a known language
    groups = near.near_duplicates(known).select("group_id").distinct().collect()
    assert {r.doc_id for r in single.collect()} == {r.group_id for r in groups}
    was = {r.doc_id: r for r in single.collect()}
    for r in hidden.collect():
        assert r.n_chars == len(r.text)
        assert ("@" in r.text) == ("@" in was[r.doc_id].text)
    again = pseudonyms.pseudonymize(single, corpus_pipeline.PSEUDONYM_KEY).collect()
    assert {r.doc_id: r.text for r in again} == {r.doc_id: r.text for r in hidden.collect()}
    assert {r.doc_id for r in packed.collect()} == set(was)


def test_rejected_documents_go(spark):
    docs = read(spark, SF, "documents")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "12 34 !!", "en", "s", 8), (None, "", None, None, None)],
                                docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(odd), SF)
    assert kept.count() == docs.count() and kept.columns == docs.columns


def test_texts_in_no_learned_language_go_and_short_clean_ones_stay(spark):
    docs = read(spark, SF, "documents")
    clean = [r.text for r in docs.where("length(text) > 400").orderBy("doc_id").limit(60).collect()]
    rng = np.random.default_rng(4)
    odd = [language.in_no_language(t[:1000].lower(), kind, rng).decode("utf-8", "replace")
           for t in clean for kind in range(3)]
    odd += [base64.b64encode(rng.bytes(600)).decode() for _ in range(20)]
    short = [t[:n] for t in clean for n in (20, 60, 150)]
    rows = ([(20_000 + i, t, None, "odd", len(t)) for i, t in enumerate(odd)]
            + [(30_000 + i, t, None, "short", len(t)) for i, t in enumerate(short)])
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    n = {r["source"]: r["count"] for r in kept.groupBy("source").count().collect()}
    print(f"odd texts kept: {n.get('odd', 0)} of {len(odd)}")
    assert n["short"] == len(short) and n.get("odd", 0) <= 0.1 * len(odd)
    assert kept.where("doc_id < 20000").count() == docs.count()


def test_nothing_to_learn_from_is_an_error(spark):
    docs = read(spark, SF, "documents").withColumn("lang", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="to learn from"):
        corpus_pipeline.identify_language(spark, docs, SF)
    assert corpus_pipeline.identify_language(spark, docs.limit(0), SF).count() == 0


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0
