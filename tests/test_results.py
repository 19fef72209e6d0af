"""Scoring, lists, provenance, manifests, and the stream of claims."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import compare, reports
from claimloom.sources import decode
from claimloom.sources.schemas import CLAIMS, FACTS
from claimloom.streaming.claims import judge


def test_score(spark):
    expected = spark.createDataFrame([("a", "Ohio"), ("b", "Paris"), ("c", "Rome")], "question_id string, expected_answer string")
    results = spark.createDataFrame([("a", "1. Which?\nOhio"), ("b", "London")], "question_id string, combined_answer string")
    subs = spark.createDataFrame([("a", 1, "Wapakoneta", "RESOLVED"), ("a", 2, "Ohio", "RESOLVED"), ("b", 1, "London", "UNRESOLVED_NO_EVIDENCE")], "question_id string, sub_question_id int, answer string, stop_reason string")
    got = {r["question_id"]: r for r in reports.score(results, subs, expected).collect()}
    assert (got["a"]["exact_match"], got["a"]["contains_expected"], got["a"]["last_matches"], got["a"]["resolved"], got["a"]["failure_category"]) == (False, True, True, True, None)
    assert got["b"]["failure_category"] == "unresolved_no_evidence" and got["c"]["failure_category"] == "pipeline_unresolved"
    assert got["a"]["all_stop_reasons"] == ["RESOLVED", "RESOLVED"]


def test_lines_and_lists(spark):
    row = spark.createDataFrame([("x\n\n It was born in Ohio. ", "born_in", "nowhere", "src")], "a string, r string, o string, s string")
    assert row.select(reports.source_line(F.col("a"), F.col("r"), F.col("o"), F.col("s")).alias("x")).first()["x"] == "It was born in Ohio."
    ev = spark.createDataFrame([("e", k, "s", "r", str(k), label) for k, label in enumerate(["SUPPORTED", "NO_EVIDENCE", "SUPPORTED"])], "execution_id string, ord long, subject string, relation string, object string, label string")
    lists = reports.verdict_lists(ev, ["execution_id"]).first()
    assert ([t["object"] for t in lists["keep"]], lists["fix"], [t["object"] for t in lists["remove"]]) == (["0", "2"], [], ["1"])


def test_interrupted_and_same(spark):
    rows = spark.createDataFrame([("a", None), ("b", None), ("c", "completed")], "id string, terminal_state string")
    out = {r["id"]: r["terminal_state"] for r in reports.mark_interrupted(rows, rows.where("id <> 'b'")).collect()}
    assert out == {"a": "interrupted", "b": None, "c": "completed"}
    assert reports.same_rows(rows, rows) and not reports.same_rows(rows, rows.unionAll(rows))


def test_provenance(spark):
    schema = "fact_id string, fact_kind string, source_id string, page string, section string, evidence string, derivation_rule string, parent_fact_ids array<string>"
    facts = spark.createDataFrame([("f1", "direct", "s1", "3", None, "said", None, None), ("f2", "direct", "s9", None, None, " ", None, None), ("f3", "derived", None, None, None, None, "sum", ["f1", "f8"]), ("f3", "odd", None, None, None, None, None, [])], schema)
    sources = spark.createDataFrame([("s1",)], "source_id string")
    errors = sorted((r["fact_id"], r["error"]) for r in reports.provenance_errors(facts, sources).collect())
    assert errors == [
        ("f2", "direct fact missing evidence paraphrase"),
        ("f2", "direct fact missing page/section/locator reference"),
        ("f2", "unknown source_id s9"),
        ("f3", "derived fact missing derivation_rule"),
        ("f3", "derived fact missing parent_fact_ids"),
        ("f3", "duplicate fact_id"),
        ("f3", "fact_kind must be direct or derived"),
        ("f3", "parent fact f8 does not exist"),
    ]


@pytest.mark.parametrize("wrap", [lambda s: s, lambda s: {"sources": s}])
def test_files(spark, tmp_path, wrap):
    (tmp_path / "m.json").write_text(json.dumps(wrap([{"source_id": "s1", "title": "T"}, {"source_id": "s2"}])))
    assert [r["source_id"] for r in decode.read_manifest(spark, f"file://{tmp_path}/m.json").collect()] == ["s1", "s2"]
    payload = {"title": "t", "domain": "d", "root_entity": "A", "trusted_context": "x", "expected_graph_facts": [["A", "r", "B"], {"subject": "B", "relation": "q", "object": "C"}, ["bad"]], "questions": [{"id": "q1", "hop_count": 1, "question": "?", "expected_answer": "B"}, {"id": "q2", "hop_count": 2, "question": "?"}]}
    (tmp_path / "b.json").write_text(json.dumps(payload))
    b = decode.read_benchmark(spark, f"file://{tmp_path}/b.json").withColumn("benchmark_id", F.lit("b"))
    assert [tuple(r)[1:] for r in decode.benchmark_facts(b).orderBy("ord").collect()] == [(0, "A", "r", "B"), (1, "B", "q", "C")]
    row = decode.benchmark_catalog(b).first()
    assert row["question_count"] == 2 and row["hops"] == {1: 1, 2: 1}
    assert decode.benchmark_questions(b, hop=2).columns == ["benchmark_id", "id", "hop_count", "question"]
    assert decode.legacy_triples(spark.createDataFrame([('x {"triples": [{"subject": "a", "relation": "r", "object": "o"}]} y',)], "text string")).first()["object"] == "o"


def test_stream(spark, tmp_path):
    facts = spark.createDataFrame([("e", 0, "A", "likes", "x", None)], FACTS)
    claims = spark.createDataFrame([("e", 1, 0, k, "A", "likes", o, None) for k, o in enumerate("xy")], CLAIMS)
    claims.write.parquet(f"{tmp_path}/in")
    judge(spark.readStream.schema(CLAIMS).parquet(f"{tmp_path}/in"), facts, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r["ord"]: r["label"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["ord"]: r["label"] for r in compare.compare(claims, facts).collect()} == {0: "SUPPORTED", 1: "CONTRADICTED"}
