"""The store and the log: writers at the same time, snapshots, runs that die, few files read."""

import threading

import pytest
from pyspark.sql import functions as F

from claimloom.sources import versions as V
from claimloom.sources.store import Store
from claimloom.sources.versions import RowLog, Versions

CLAIMS = "execution_id string, example_id string, sub_question_id int, iteration int, subject string, relation string, object string, label string"


def facts(spark, execution, names):
    return spark.createDataFrame([(execution, k, n, "r", "o") for k, n in enumerate(names)], "execution_id string, ord long, subject string, relation string, object string")


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    stores = [Store(spark, f"file://{tmp_path}", buckets=1) for _ in range(4)]
    work = [threading.Thread(target=lambda k=k, s=s: s.upsert_facts(facts(spark, "e", [f"w{k}", "shared"]))) for k, s in enumerate(stores)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert sorted(r["subject"] for r in stores[0].facts("e").collect()) == ["shared", "w0", "w1", "w2", "w3"]
    assert stores[0]._versions("facts").latest()[0] == 4
    assert stores[0].vacuum() >= 3 and stores[0].facts("e").count() == 5


def test_a_writer_that_comes_second_merges_again(spark, tmp_path, monkeypatch):
    first, second = (Store(spark, f"file://{tmp_path}", buckets=1) for _ in range(2))
    take, met = Versions._take, []

    def slow(self, version, entries):
        if not met:
            met.append(version)
            second.upsert_facts(facts(spark, "e", ["b"]))
        return take(self, version, entries)

    monkeypatch.setattr(Versions, "_take", slow)
    first.upsert_facts(facts(spark, "e", ["a"]))
    assert sorted(r["subject"] for r in first.facts("e").collect()) == ["a", "b"]


def test_readers_keep_their_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=2)
    store.upsert_facts(facts(spark, "e", ["a"]))
    held = store.facts("e")
    store.upsert_facts(facts(spark, "e", ["b"]))
    store.delete("e")
    assert [r["subject"] for r in held.collect()] == ["a"] and store.facts("e").isEmpty()


def test_claims_of_an_example_open_its_executions_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=64)
    rows = [(f"e{k}", f"x{k % 10}", 1, 0, "s", "r", f"o{k}", "CONTRADICTED") for k in range(40)]
    store.write_claims(spark.createDataFrame(rows, CLAIMS).withColumn("ord", F.lit(0)))
    want = sorted(r[6] for r in rows if r[1] == "x3")
    few = store.claims_of_example("x3")
    assert sorted(r["object"] for r in few.collect()) == want
    opened = len(few.inputFiles())
    more = [(f"f{k}", f"y{k}", 1, 0, "s", "r", "o", "SUPPORTED") for k in range(200)]
    store.write_claims(spark.createDataFrame(more, CLAIMS).withColumn("ord", F.lit(0)))
    store.compact()
    assert sorted(r["object"] for r in store.claims_of_example("x3").collect()) == want
    assert opened <= 4 and len(store.claims_of_example("x3").inputFiles()) == opened and len(store.all_claims().inputFiles()) > 30
    assert store.bad_claims("e3").count() == 1 and store.bad_claims("f3").count() == 0
    store.delete("e3")
    assert sorted(r["object"] for r in store.claims_of_example("x3").collect()) == [o for o in want if o != "o3"]


def test_log_after_a_death(spark, tmp_path):
    log = RowLog(spark, f"file://{tmp_path}", "id string, error string, n int")
    assert log.last().isEmpty() and log.compact() == 0
    row = lambda *r: spark.createDataFrame(list(r), "id string, error string, n int")
    log.append(row(("a", None, 1), ("b", "late", 1)))
    log.versions.write(row(("c", "lost", 9)))  # never committed
    log.append(row(("b", None, 2)))
    again = RowLog(spark, f"file://{tmp_path}", "id string, error string, n int")
    assert sorted(tuple(r) for r in again.last().collect()) == [("a", None, 1), ("b", None, 2)]
    before = again.versions.latest()[1]
    again.compact()
    again.append(row(("a", None, 3)))
    assert sorted(tuple(r) for r in again.last().collect()) == [("a", None, 3), ("b", None, 2)]
    assert sorted(tuple(r) for r in again.last(before).collect()) == [("a", None, 1), ("b", None, 2)]
    assert again.rows().count() == 3


def test_append_during_compaction_stays(spark, tmp_path, monkeypatch):
    log = RowLog(spark, f"file://{tmp_path}", "id string, n int")
    for k in range(2):
        log.append(spark.createDataFrame([("a", k)], "id string, n int"))
    write, met = Versions.write, []

    def slow(self, rows, by=None):
        name = write(self, rows, by)
        if not met:
            met.append(name)
            log.append(spark.createDataFrame([("a", 7), ("b", 1)], "id string, n int"))
        return name

    monkeypatch.setattr(Versions, "write", slow)
    log.compact()
    assert sorted(tuple(r) for r in log.last().collect()) == [("a", 7), ("b", 1)]


def test_too_many_conflicts_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Versions, "_take", lambda *a: False)
    with pytest.raises(V.Conflict):
        Versions(spark, f"file://{tmp_path}").commit(lambda entries: entries, attempts=2)
