"""Paths, merging, the stop ladder, reports, the store, and the loop over a batch."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import iteration, merge, paths, reports
from claimloom.operators.compare import compare, compare_for_targets
from claimloom.plans import iterate
from claimloom.sources.schemas import FACTS
from claimloom.sources.store import Store

CHAIN = ["Mission Alpha", "Rocket Beta", "Stage Gamma", "Company Delta", "City Epsilon", "State Zeta", "Country Eta", "Union Theta", "Treaty Iota", "Council Kappa", "Terminal Lambda"]
EDGES = [(a, f"step_{k}", b) for k, (a, b) in enumerate(zip(CHAIN, CHAIN[1:]))]
NOISE = [("Rocket Beta", "also", "Stage Other"), ("Stage Gamma", "step_back", "Rocket Beta"), ("Elsewhere", "near", "Terminal Lambda"), ("Mission Alpha", "photo_of", "Moon")]


def facts_of(spark, triples, execution="e"):
    return spark.createDataFrame([(execution, k, *t, None) for k, t in enumerate(triples)], FACTS)


def resolve(spark, triples, root, terminal):
    claims = spark.createDataFrame([(1, "e", root, *terminal)], "search int, execution_id string, root string, subject string, relation string, object string")
    return paths.evidence_paths(claims, facts_of(spark, triples)).first()


@pytest.mark.parametrize("depth", [1, 2, 5, 10])
def test_depths(spark, depth):
    row = resolve(spark, EDGES + NOISE, "mission alpha", EDGES[depth - 1])
    assert row["complete"] and row["path_length"] == depth
    assert [e["object"] for e in row["evidence_path"]] == CHAIN[1 : depth + 1]


def test_failures(spark):
    assert resolve(spark, EDGES[:1] + EDGES[2:], "Mission Alpha", EDGES[4])["failure_reason"] == "missing_intermediate_edge"
    assert resolve(spark, EDGES, "Mission Alpha", ("X", "y", "Z"))["failure_reason"] == "terminal_claim_not_a_trusted_fact"
    assert resolve(spark, EDGES, None, EDGES[3])["failure_reason"] == "missing_start_entity"
    twins = EDGES + [("Mission Alpha", "step_0", "Rocket Twin"), ("Rocket Twin", "step_1", "Stage Gamma")]
    row = resolve(spark, twins, "Mission Alpha", EDGES[2])
    assert row["failure_reason"] == "ambiguous_branch" and row["ambiguity"] == "sibling_branch_ambiguity" and not row["complete"]
    assert resolve(spark, EDGES + [("Stage Gamma", "back_to", "Mission Alpha")], "Mission Alpha", ("Stage Gamma", "back_to", "Mission Alpha"))["failure_reason"] == "cycle_detected"


def test_roots(spark):
    facts = facts_of(spark, EDGES)
    rows = [(1, "e", "Which city is behind Mission Alpha and Rocket Beta?", *EDGES[3], None), (2, "e", "Where is the city?", *EDGES[3], None), (3, "e", "What of Planet Nine?", *EDGES[3], None), (4, "e", "What CKD stage has Patient Case 7?", *EDGES[3], None)]
    asked = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[5], r[6]) for r in rows], "search int, execution_id string, question string, subject string, object string, primary_subject string")
    got = {r["search"]: r["root"] for r in paths.roots(asked, facts).collect()}
    assert got[1] == "Mission Alpha" and got[3] == "Planet Nine" and got[4] == "Patient Case 7" and got[2] == "Mission Alpha"


def test_components_and_metrics(spark):
    facts = facts_of(spark, EDGES[:3] + [("P", "q", "R"), ("P", "q", "r")])
    assert paths.components(facts).select("component").distinct().count() == 2
    row = paths.graph_metrics(facts).first()
    assert (row["nodes"], row["edges"], row["duplicates"], row["components"], row["sources"], row["sinks"]) == (6, 5, 1, 2, 2, 2)
    assert (row["isolated"], row["fan_out"]) == (0, 1)
    loops = facts_of(spark, [("A", "is", "A"), ("B", "to", "C"), ("B", "to", "D"), ("D", "to", "E")])
    assert tuple(paths.graph_metrics(loops).select("isolated", "fan_out", "components").first()) == (1, 2, 2)
    far = paths.root_metrics(loops, spark.createDataFrame([("e", "B")], "execution_id string, root string")).first()
    assert (far["fan_out"], far["reached"], far["hops"], far["branches"]) == (2, 3, 2, 0) and abs(far["mean_hops"] - 4 / 3) < 1e-9


def test_paths_through_a_lattice_are_counted_not_listed(spark):
    steps = [(f"n{k}{a}", "to", f"n{k + 1}{b}") for k in range(7) for a in "abcdef" for b in "abcdef"]
    graph = facts_of(spark, [("start", "to", f"n0{a}") for a in "abcdef"] + steps + [(f"n7{a}", "to", "goal") for a in "abcdef"] + [("start", "to", "side"), ("side", "to", "end"), ("SIDE", "To", "end")])
    pairs = spark.createDataFrame([(1, "e", "start", "goal"), (2, "e", "start", "end"), (3, "e", "goal", "start"), (4, "e", "start", "start")], "search int, execution_id string, start string, goal string")
    rows = {r["search"]: r for r in paths.shortest_paths(pairs, paths.edges(graph)).collect()}
    assert set(rows) == {1, 2} and (rows[1]["n_paths"], rows[1]["length"], rows[1]["path"]) == (6**8, 9, None)
    assert (rows[2]["n_paths"], rows[2]["nodes"]) == (1, ["start", "side", "end"])


def test_merge(spark):
    base = facts_of(spark, [("The Host", "runs", "db"), ("host", "runs", "DB")])
    new = facts_of(spark, [("Host", "was_runs", "db"), ("Rack", "in", "hall"), ("the rack", "in", "Hall"), ("Rack", "in", "room")])
    whole, added = merge.merge(base, new)
    assert [(r["subject"], r["object"]) for r in added.orderBy("ord").collect()] == [("Rack", "hall"), ("Rack", "room")]
    assert whole.count() == 4
    last = merge.upsert(base.withColumn("evidence", F.lit("a")), facts_of(spark, [("The Host", "runs", "db")]).withColumn("evidence", F.lit("b")), ["execution_id", "subject", "relation", "object"])
    assert {r["subject"]: r["evidence"] for r in last.collect()} == {"The Host": "b", "host": "a"}


LADDER = [
    (dict(answer="cannot determine", previous_answer="cannot determine", claims=0, iteration=1), ("UNRESOLVED_NO_EVIDENCE", "repeated_abstention")),
    (dict(answer="cannot determine", previous_answer="Ohio", claims=0, iteration=1), ("UNRESOLVED_NO_EVIDENCE", "abstention_after_revision")),
    (dict(answer="cannot determine", claims=0, enriched=True, max_iterations=1), ("UNRESOLVED_NO_EVIDENCE", "abstention_after_enrichment")),
    (dict(answer="cannot determine", claims=0, derived=True, max_iterations=1), ("UNRESOLVED_NO_EVIDENCE", "abstention_after_derivation")),
    (dict(answer="cannot determine", claims=0), ("GENERATION_FAILED", "initial_abstention")),
    (dict(claims=0, iteration=1), ("NO_CLAIMS_EXTRACTED", None)),
    (dict(claims=0), (None, None)),
    (dict(supported=1, path_complete=False, max_iterations=1), ("UNRESOLVED_TARGET_NOT_SATISFIED", "incomplete_evidence_path")),
    (dict(supported=1, path_complete=False), (None, "incomplete_evidence_path")),
    (dict(supported=1), ("RESOLVED", None)),
    (dict(supported=1, satisfied=False, irrelevant=1, max_iterations=1), ("UNRESOLVED_TARGET_NOT_SATISFIED", None)),
    (dict(supported=1, satisfied=False, irrelevant=1), (None, None)),
    (dict(contradicted=1, previous_answer="an  answer ", iteration=1), ("STALLED", None)),
    (dict(contradicted=1, previous_answer="x", previous_signature="s", iteration=1), ("STALLED", None)),
    (dict(no_evidence=1, max_iterations=1), ("UNRESOLVED_NO_EVIDENCE", None)),
    (dict(contradicted=1, irrelevant=1, satisfied=False, max_iterations=1), ("UNRESOLVED_TARGET_NOT_SATISFIED", None)),
    (dict(contradicted=1, max_iterations=1), ("MAX_ITERATIONS", None)),
    (dict(contradicted=1), (None, None)),
]


def test_stop_ladder(spark):
    schema = "k int, iteration int, max_iterations int, answer string, previous_answer string, signature string, previous_signature string, supported int, contradicted int, no_evidence int, claims int, satisfied boolean, irrelevant int, enriched boolean, derived boolean, path_complete boolean"
    base = dict(iteration=0, max_iterations=3, answer="an answer", previous_answer=None, signature="s", previous_signature=None, supported=0, contradicted=0, no_evidence=0, claims=1, satisfied=True, irrelevant=0, enriched=False, derived=False, path_complete=None)
    rows = spark.createDataFrame([(k, *(base | case).values()) for k, (case, _) in enumerate(LADDER)], schema)
    got = {r["k"]: (r["stop_reason"], r["sub_reason"]) for r in iteration.stop_decision(rows).collect()}
    assert got == {k: want for k, (_, want) in enumerate(LADDER)}


def test_streaks_and_neighbours(spark):
    rows = spark.createDataFrame([("q", k, a, s, a == "t") for k, (a, s) in enumerate([("a", "1"), ("t", "2"), ("t", "2"), ("b", "3"), ("t", "4")])], "id string, iteration int, answer string, signature string, hit boolean")
    assert [r["streak"] for r in iteration.streaks(rows, ["id"], "iteration", F.col("hit")).orderBy("iteration").collect()] == [0, 1, 2, 0, 1]
    assert [r["stalled"] for r in iteration.with_previous(rows, ["id"]).orderBy("iteration").collect()] == [False, False, True, False, False]
    row = iteration.first_and_last(rows, ["id"], ["answer"]).first()
    assert (row["first_answer"], row["last_answer"], row["revision_count"]) == ("a", "t", 4)


def test_resume_and_selection(spark):
    asked = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, ord int")
    prior = spark.createDataFrame([("a", 0, None, 1), ("b", 1, "timeout", None), ("b", 2, "timeout", 3)], "id string, ord int, error string, attempt_number int")
    got = {r["id"]: (r["skip"], r["attempt"]) for r in reports.resume(asked, prior, retry_errors=True).collect()}
    assert got == {"a": (True, 2), "b": (False, 4), "c": (False, 1)}
    assert [r["id"] for r in reports.select_questions(asked, ["c", "a"], limit=1).collect()] == ["c"]
    with pytest.raises(ValueError):
        reports.select_questions(asked, ["x"])


def test_validation(spark):
    edge = "struct<subject:string,relation:string,object:string>"
    schema = f"id string, hop_count int, question string, expected_answer string, expected_path array<{edge}>, required_entities array<string>, required_relations array<string>"
    good = ("q1", 2, "?", CHAIN[2], EDGES[:2], CHAIN[:3], ["step_0", "step_1"])
    bad = ("q2", 3, "?", "Nowhere", [EDGES[0], EDGES[2]], CHAIN[:3], ["step_0"])
    facts = facts_of(spark, EDGES)
    assert reports.validate(spark.createDataFrame([good], schema), facts, CHAIN[0]).isEmpty()
    errors = {r["error"] for r in reports.validate(spark.createDataFrame([good, bad], schema), facts, CHAIN[0]).collect()}
    assert {"path length 2 != hop_count 3", "expected_path is not contiguous", "expected answer is not path terminus", "required_entities does not match path", "required_relations does not match path", "expected answer is absent from graph"} == errors


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=2)
    store.upsert_facts(facts_of(spark, EDGES[:3], "one").unionByName(facts_of(spark, EDGES[:2], "two")))
    store.upsert_facts(facts_of(spark, EDGES[:1], "one").withColumn("evidence", F.lit("seen")))
    assert [r["evidence"] for r in store.facts("one").collect()] == ["seen", None, None] and store.facts("two").count() == 2
    claims = spark.createDataFrame([("one", 1, k, "a", "r", "o", label) for k, label in enumerate(["SUPPORTED", "CONTRADICTED"])], "execution_id string, sub_question_id int, iteration int, subject string, relation string, object string, label string")
    store.write_claims(claims)
    assert store.bad_claims("one").count() == 1 and store.claims("one").first()["stage"] == "answer_0"
    assert store.summary("one") == {"entities": 6, "facts": 3, "claims": 2, "labels": {"SUPPORTED": 1, "CONTRADICTED": 1}}
    assert store.delete("one") == 6 and store.facts("one").isEmpty() and store.facts("two").count() == 2


def test_loop(spark):
    """One question is right at once, one after a revision, one never."""
    facts = facts_of(spark, [("Mission Alpha", "launched_from", "Pad 39A"), ("Mission Alpha", "launched_by", "Rocket Beta")])
    asked = spark.createDataFrame([("e", 1, "Where was Mission Alpha launched from?"), ("e", 2, "What rocket launched Mission Alpha?"), ("e", 3, "What color is Mission Alpha?")], "execution_id string, sub_question_id int, question string")
    contexts = spark.createDataFrame([("e", "Mission Alpha was launched from Pad 39A by Rocket Beta.")], "execution_id string, context string")
    answers = spark.createDataFrame([("e", 1, "Pad 39A"), ("e", 2, "Rocket Gamma"), ("e", 3, "red")], "execution_id string, sub_question_id int, answer string")
    relation = F.when(F.col("sub_question_id") == 1, "launched_from").when(F.col("sub_question_id") == 2, "launched_by").otherwise("has_color")

    def extract(rows):
        return rows.select("execution_id", "sub_question_id", "iteration", F.lit(0).cast("long").alias("ord"), F.lit("Mission Alpha").alias("subject"), relation.alias("relation"), F.col("answer").alias("object"), F.col("answer").alias("source_sentence"))

    def revise(rows):
        said = F.when(F.col("sub_question_id") == 2, "Rocket Beta").otherwise(F.col("answer"))
        return rows.select("execution_id", "sub_question_id", said.alias("answer"), "payload")

    results, history = iterate.run(asked, contexts, facts, answers, extract, revise)
    got = {r["sub_question_id"]: (r["stop_reason"], r["iteration"], r["answer"]) for r in results.collect()}
    assert got == {1: ("RESOLVED", 0, "Pad 39A"), 2: ("RESOLVED", 1, "Rocket Beta"), 3: ("STALLED", 1, "red")}
    assert history.count() == 5
    assert json.loads("[]") == []


CASE = "Patient A has CKD stage 3b. The A1c was 8.2%. The patient is allergic to penicillin."


def _order_matters(spark, first, second):
    """Two questions, first the one and then the other; both are answered with a claim about the stage, which only the context states."""
    asked = spark.createDataFrame([("e", first, "What stage of kidney disease does Patient A have?"), ("e", second, "Is it known what Patient A has?")], "execution_id string, sub_question_id int, question string")
    contexts = spark.createDataFrame([("e", CASE)], "execution_id string, context string")
    facts = facts_of(spark, [("Patient A", "lives_in", "Ohio")])
    return asked, contexts, facts


def test_questions_see_what_earlier_ones_derived(spark):
    labels = {}
    for first, second in ((1, 2), (2, 1)):
        asked, contexts, facts = _order_matters(spark, first, second)
        _, grown = iterate.grow(asked, contexts, facts)
        derived = [(r["relation"], r["object"], r["since"]) for r in grown.where("since is not null").collect()]
        assert [d[2] for d in derived] == [first]
        claims = grown.where("since is not null").select("execution_id", F.lit(second).alias("sub_question_id"), F.lit(0).alias("iteration"), F.lit(0).cast("long").alias("ord"), "subject", "relation", "object", F.lit(None).cast("string").alias("source_sentence"))
        labels[first] = compare(claims, grown).first()["label"]
    assert labels == {1: "SUPPORTED", 2: "NO_EVIDENCE"}


def test_rounds_go_over_what_can_answer(spark, monkeypatch):
    """Questions are understood once for all rounds and in several tasks; facts of other relations are looked through neither for named patients nor for claims about other subjects."""
    from claimloom.operators import compare as compared
    from claimloom.operators import questions

    asked, contexts, facts = _order_matters(spark, 1, 2)
    orders = spark.range(300).select(F.lit("e").alias("execution_id"), (F.col("id") + 10).alias("ord"), F.concat(F.lit("Order#"), "id").alias("subject"), F.lit("placed_by").alias("relation"), F.lit("Patient A").alias("object"), F.lit(None).cast("string").alias("evidence"))
    facts, asked = facts.unionByName(orders).coalesce(1), asked.coalesce(1)
    tasks, answers, looked = [], [], []
    understood, answered, lookup = questions.with_intent, questions.answering, compared.lookup
    monkeypatch.setattr(questions, "with_intent", lambda q, *a, **k: (tasks.append(q.rdd.getNumPartitions()), understood(q, *a, **k))[1])
    monkeypatch.setattr(questions, "usual_subjects", lambda *a: pytest.fail("all questions name their patient"))
    monkeypatch.setattr(questions, "answering", lambda f, *a: (answers.append(f.count()), answered(f, *a))[1])
    monkeypatch.setattr(compared, "lookup", lambda rows, f, *a, **k: (looked.append(f.count()), lookup(rows, f, *a, **k))[1])
    _, grown = iterate.grow(asked, contexts, facts)
    assert grown.count() == 302 and grown.where("since = 1").count() == 1
    assert tasks == [4] and answers == [0, 1]
    claims = spark.createDataFrame([("e", 2, 0, 0, "Patient A", "has_ckd_stage", "stage 3a", None)], "execution_id string, sub_question_id int, iteration int, ord long, subject string, relation string, object string, source_sentence string")
    compare(claims, grown).collect()
    assert looked == [2] * 3


def _visible(facts, at):
    """The facts that a question sees, as a table without `since`."""
    return facts.where(F.coalesce("since", F.lit(0)) <= at).drop("since")


def test_as_of_lookups_are_those_over_what_is_there(spark):
    """Every operator with `since` gives what it gives on the facts that are there alone."""
    import random

    from claimloom.operators import align as A
    from claimloom.operators import paths, questions

    r = random.Random(2)
    names = ["a", "b", "c", "d"]
    rows = [("e", k, r.choice(names), r.choice(["located_in", "not_located_in", "born_in", "launched_by"]), r.choice(names + ["Saturn V rocket"]), None, None if k < 6 else k - 4) for k in range(16)]
    facts = spark.createDataFrame(rows, "execution_id string, ord long, subject string, relation string, object string, evidence string, since int").cache()
    claims = spark.createDataFrame([("e", q, 0, k, r.choice(names), r.choice(["located_in", "born_in", "launched_by"]), r.choice(names + ["Saturn V rocket"]), None) for q in (1, 5, 9, 20) for k in range(12)], "execution_id string, sub_question_id int, iteration int, ord long, subject string, relation string, object string, source_sentence string").cache()
    targets = spark.createDataFrame([("e", q, f"Where is {r.choice(names)} located?") for q in (1, 5, 9, 20)], "execution_id string, sub_question_id int, question string").cache()
    ends = spark.createDataFrame([("e", q, "c", "a", "located_in", "d", f"what links {r.choice(names)} to {r.choice(names)}?", None) for q in (1, 5, 9, 20)], "execution_id string, search int, root string, subject string, relation string, object string, question string, primary_subject string").cache()
    whole = {
        "compare": lambda c, f, t, p: compare(c, f),
        "align": lambda c, f, t, p: A.align(c, f),
        "targets": lambda c, f, t, p: questions.targets(t, f),
        "frames": lambda c, f, t, p: compare_for_targets(c, f, questions.targets(t, f)),
        "roots": lambda c, f, t, p: paths.roots(p, f),
        "paths": lambda c, f, t, p: paths.evidence_paths(p, f),
    }
    for name, run in whole.items():
        got = sorted(str(x.asDict(True)) for x in run(claims, facts, targets, ends).collect())
        want = []
        for q in (1, 5, 9, 20):
            want += [str(x.asDict(True)) for x in run(claims.where(F.col("sub_question_id") == q), _visible(facts, q), targets.where(F.col("sub_question_id") == q), ends.where(F.col("search") == q)).collect()]
        assert got == sorted(want), name


def test_answers_are_found_without_pairing_an_execution(spark):
    """20,000 facts and 500 questions of one execution: only answers become rows."""
    from claimloom.operators.asof import answering

    facts = spark.range(20_000).select(F.lit("e").alias("execution_id"), F.col("id").alias("ord"), F.lit("s").alias("subject"), F.when(F.col("id") % 2000 == 0, "situated_in").otherwise(F.concat(F.lit("r"), "id")).alias("relation"), F.lit("o").alias("object"))
    targets = spark.range(500).select(F.lit("e").alias("execution_id"), F.col("id").cast("int").alias("sub_question_id"), F.lit("location_containment").alias("intent"))
    out = answering(facts, targets)
    assert out.count() == 10 * 500
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_components_write_a_few_times_the_nodes(spark, monkeypatch):
    stars = [(f"n{k:02d} leaf {i}", "in", f"n{k:02d}") for k in range(20) for i in range(30)] + [(f"n{k:02d}", "in", f"n{k + 1:02d}") for k in range(19)]
    facts, written = facts_of(spark, stars), []
    plain = paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: (rows := plain(df), written.append(rows.count()))[0])
    got = paths.components(facts).collect()
    assert len(got) == 620 and {r["component"] for r in got} == {"n00"}
    assert sum(written) < 2 * 620  # rounds over all edges wrote several times that


def test_component_figures_need_no_labels_of_leaves(spark, monkeypatch):
    facts, written = facts_of(spark, [(f"n{k:02d} leaf {i}", "in", f"n{k:02d}") for k in range(20) for i in range(30)] * 2), []
    plain = paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: (rows := plain(df), written.append(rows.count()))[0])
    row = paths.graph_metrics(facts).first()
    assert (row["edges"], row["duplicates"], row["relations"], row["components"]) == (1200, 600, 1, 20)
    assert written[0] == 600  # different edges, before that all of them


def test_passes_share_what_claims_do_not_change(spark, monkeypatch):
    """Two passes: names, frames and hops of the facts are made once, and later lookups read their normalized triples."""
    from claimloom.operators import compare as C

    made = []
    for module, name in ((C, "fact_frames"), (merge, "entities")):
        monkeypatch.setattr(module, name, lambda *a, __f=getattr(module, name), __n=name, **k: (made.append(__n), __f(*a, **k))[1])
    facts = facts_of(spark, [("Mission Alpha", "Launched-From", "Pad 39A"), ("Mission Alpha", "launched_by", "Rocket Beta")])
    asked = spark.createDataFrame([("e", 1, "Where was Mission Alpha launched from?"), ("e", 2, "What rocket launched Mission Alpha?")], "execution_id string, sub_question_id int, question string")
    contexts = spark.createDataFrame([("e", "Nothing else.")], "execution_id string, context string")
    answers = spark.createDataFrame([("e", 1, "Pad 39A"), ("e", 2, "Rocket Gamma")], "execution_id string, sub_question_id int, answer string")
    relation = F.when(F.col("sub_question_id") == 1, "launched_from").otherwise("launched_by")
    extract = lambda rows: rows.select("execution_id", "sub_question_id", "iteration", F.lit(0).cast("long").alias("ord"), F.lit("Mission Alpha").alias("subject"), relation.alias("relation"), F.col("answer").alias("object"), F.col("answer").alias("source_sentence"))
    revise = lambda rows: rows.select("execution_id", "sub_question_id", F.lit("Rocket Beta").alias("answer"))
    results, _ = iterate.run(asked, contexts, facts, answers, extract, revise, max_iterations=2)
    assert {r["sub_question_id"]: (r["stop_reason"], r["iteration"]) for r in results.collect()} == {1: ("RESOLVED", 0), 2: ("RESOLVED", 1)}
    assert sorted(made) == ["entities", "fact_frames"]
