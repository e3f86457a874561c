"""The pipeline's stages against plain versions, and the contract of its functions."""

import collections
import zlib

import numpy as np

import corpus_pipeline as P
from lumenframe.llm import mixing, toxicity
from lumenframe.llm.common import DOCUMENT_COLUMNS, table

from .test_jaccard import brute as components_brute
from .test_packing import check_packed
from .test_suffixes import brute as repeats_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit_toxicity(docs, table(spark, SF, "labels"), "toxic", 4, 2)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert tuple(out.columns) == DOCUMENT_COLUMNS
        after = out.collect()
        before = docs.collect()
        if name == "toxicity":
            scores = {i: float(model.score(np.array([model.evidence(r["text"])]))[0]) for i, r in rows.items()}
            assert {r["doc_id"] for r in after} == {i for i, s in scores.items() if s < toxicity.THRESHOLD} and len(after) < len(before)
        elif name == "near_copies":
            assert {r["doc_id"] for r in after} == {i for i, _, c in components_brute([(r["doc_id"], r["text"]) for r in before]) if i == c}
        elif name == "repeated_passages":
            kept = {i: n - gone for i, n, gone, *_ in repeats_brute([(r["doc_id"], r["text"]) for r in before])}
            assert {r["doc_id"] for r in after} == set(kept)
            assert all(kept[r["doc_id"]] - 6 <= len(r["text"].encode()) <= kept[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in after)
        elif name == "source_mix":
            counts = collections.Counter(r["doc_id"] for r in after)
            known = {r["doc_id"] for r in before}
            assert set(counts) <= known and len(counts) < len(known)
            again = mixing.mix_sources(docs, "source", ["doc_id"], temperature=mixing.TEMPERATURE, seed=mixing.SEED)
            assert counts == collections.Counter(r["doc_id"] for r in again.collect())
        else:
            check_packed(after, before)
            assert all(r["ids"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in after)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)


def test_run_applies_all_stages(spark):
    rows = P.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict()) and P.ORACLE_SQL is None
    assert len(P.STAGES) == 5


#: None of these is toxic but rows that don't count, so that all documents pass the first stage.
LABELS = [(0, 0, 0), (1, 0, 0), (2, 1, 0), (8, 1, 0), (11, 0, 0), (None, 1, 1), (9, None, None), (0, 1, 0), (777, 0, 1), (10, 0, 0), (6, 1, 0), (-5, 0, 0)]


def test_odd_documents_pass_all_stages(spark, nasty, clashing, no_documents, tmp_path):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for name, docs in (("odd", nasty), ("more", clashing), ("none", no_documents)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    odd, more = (P.run(spark, str(tmp_path / name)).collect() for name in ("odd", "more"))
    assert odd and list(odd[0].asDict()) == list(more[0].asDict()) and P.run(spark, str(tmp_path / "none")).count() == 0
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, odd)) == sorted(map(key, more))
    for stage in (s for _, s in P.STAGES[:-1]):
        out = stage(spark, clashing, str(tmp_path / "odd"))
        assert tuple(out.columns) == DOCUMENT_COLUMNS and out.count() and stage(spark, no_documents, str(tmp_path / "none")).count() == 0
    assert {r["doc_id"] for r in P.drop_near_copies(spark, nasty, "").collect()} >= {3, 4, 5, None} and 1 not in {r["doc_id"] for r in P.drop_near_copies(spark, nasty, "").collect()}
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.drop_repeated_passages(spark, nasty, "").collect()}
    assert cut[3] == (None, None) and cut[4] == ("", 0) and cut[1] == ("", 0)
