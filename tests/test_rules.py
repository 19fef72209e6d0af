"""Every rule for test sets is broken by a case of its own, and by no other that it shouldn't be."""

import copy

import pytest

from claimloom.operators import rules

CHAIN = ["Alpha", "Bravo", "Charlie", "Delta", "Echo"]
EDGES = [(a, f"leads_{k}", b) for k, (a, b) in enumerate(zip(CHAIN, CHAIN[1:], strict=False))]
QUESTIONS = "set_id string, ord long, " + ", ".join(f"{c} {t}" for c, t in (rules.REQUIRED | rules.OPTIONAL).items())
SETS = "set_id string, " + ", ".join(f"{c} {t}" for c, t in rules.SETS.items())
FACTS = "set_id string, ord long, subject string, relation string, object string"
CONTEXT = "Alpha leads to Bravo. Bravo leads to Charlie. Charlie leads to Delta. Delta leads to Echo."
GOOD = {
    "id": "good",
    "hop_count": 2,
    "question": "Where does Alpha end up after two steps?",
    "expected_answer": "Charlie",
    "expected_path": EDGES[:2],
    "required_entities": ["Charlie", "Alpha", "Bravo"],
    "required_relations": ["leads_1", "leads_0"],
    "question_anchor_entities": ["Alpha"],
    "reasoning_anchor_entities": ["Alpha"],
    "graph_root_entity": "Alpha",
    "hop_semantics": rules.LABEL,
    "anchor_detection": {"anchor_detected_from_question": True, "anchor_detection_method": "alias_match", "detected_entities": ["Alpha"], "matched_aliases": ["Alpha"]},
    "shortcut_audit": {
        "manual_reviewed": None,
        "generator_checked": True,
        "human_review_status": "pending",
        "expected_path_length": 2,
        "shortest_distance_from_graph_root": 2,
        "shortest_distance_from_question_anchor": 2,
        "shortest_anchor_distance": 2,
        "direct_final_subject_mentioned": False,
        "expected_answer_mentioned": False,
        "late_chain_entity_mentioned": False,
        "one_hop_parent_mentioned": False,
        "shortcut_entities": [],
        "ambiguous_discourse_markers": [],
        "locality": {"sentence": "Bravo leads to Charlie.", "answer_in_one_sentence": True, "warning": False, "status": "PASS"},
    },
}
D, A = "anchor_detection.", "shortcut_audit."
#: What is changed, and the rules that this breaks.
CASES = [
    ({}, set()),
    ({"question": None}, {"missing_fields"}),
    ({"id": "good"}, {"duplicate_id"}),
    ({"hop_count": 3}, {"path_length", "anchor_distance", "audit_path_length"}),
    ({"expected_path": []}, {"path_length", "path_empty"}),
    ({"expected_path": [EDGES[0], ("Bravo", "other", "Charlie")], "required_relations": ["leads_0", "other"]}, {"edge_absent"}),
    ({"expected_path": [EDGES[0], EDGES[2]], "expected_answer": "Delta", "required_entities": CHAIN[:4], "required_relations": ["leads_0", "leads_2"], A + "locality.sentence": "Charlie leads to Delta."}, {"not_contiguous", "anchor_distance", "audit_root_distance", "audit_question_distance", "audit_anchor_distance"}),
    ({"expected_answer": "Bravo", A + "locality.sentence": "Alpha leads to Bravo."}, {"answer_not_terminus", "anchor_distance", "audit_root_distance", "audit_question_distance", "audit_anchor_distance"}),
    ({"required_entities": ["Alpha"]}, {"required_entities"}),
    ({"required_relations": ["leads_0"]}, {"required_relations"}),
    ({"expected_answer": "Nobody", A + "locality": {"sentence": "", "answer_in_one_sentence": False, "warning": False, "status": "PASS"}}, {"answer_not_terminus", "answer_absent", "anchor_distance", "audit_root_distance", "audit_question_distance", "audit_anchor_distance"}),
    ({"question_anchor_entities": [], "reasoning_anchor_entities": []}, {"anchors_missing", "detection_entities", "detection_aliases", "anchor_distance", "audit_question_distance", "audit_anchor_distance"}),
    ({"question": "Where does Echo end up, and Alpha?", "question_anchor_entities": ["Echo"], "reasoning_anchor_entities": ["Echo"], D + "detected_entities": ["Echo"], D + "matched_aliases": ["Echo"]}, {"start_is_no_anchor", "anchor_distance", "audit_question_distance", "audit_anchor_distance"}),
    ({"reasoning_anchor_entities": ["Bravo"]}, {"anchor_alias_differs"}),
    ({"graph_root_entity": "Bravo"}, {"graph_root"}),
    ({"question": "Where do we end up after two steps?"}, {"anchor_undetected", "detection_aliases"}),
    ({"anchor_detection": None}, {"detection_missing"}),
    ({D + "anchor_detected_from_question": False}, {"detection_not_from_question"}),
    ({D + "anchor_detection_method": "guess"}, {"detection_method"}),
    ({D + "detected_entities": ["Bravo"]}, {"detection_entities"}),
    ({D + "matched_aliases": []}, {"detection_aliases"}),
    ({"hop_semantics": "other"}, {"hop_label"}),
    ({"question": "Where does Alpha end up after Bravo?"}, {"final_subject_mentioned", "shortcut_mentioned", "audit_final_subject", "audit_parent", "audit_shortcuts"}),
    ({"question": "Does Alpha lead on to Charlie?"}, {"answer_mentioned", "shortcut_mentioned", "audit_answer", "audit_late_entity", "audit_shortcuts"}),
    ({"question": "Where does Alpha end up after those steps?"}, {"discourse_markers", "audit_markers"}),
    ({"shortcut_audit": None}, {"audit_missing"}),
    ({A + "manual_reviewed": False}, {"audit_manual_reviewed"}),
    ({A + "generator_checked": False}, {"audit_generator_unchecked"}),
    ({A + "human_review_status": "perhaps"}, {"audit_review_status"}),
    ({A + "expected_path_length": 5}, {"audit_path_length"}),
    ({A + "shortest_distance_from_graph_root": 5}, {"audit_root_distance"}),
    ({A + "shortest_distance_from_question_anchor": 5}, {"audit_question_distance"}),
    ({A + "shortest_anchor_distance": 5}, {"audit_anchor_distance"}),
    ({A + "direct_final_subject_mentioned": True}, {"audit_final_subject", "audit_reports_final_subject"}),
    ({A + "expected_answer_mentioned": True}, {"audit_answer"}),
    ({A + "late_chain_entity_mentioned": True}, {"audit_late_entity"}),
    ({A + "one_hop_parent_mentioned": True}, {"audit_parent"}),
    ({A + "shortcut_entities": ["Bravo"]}, {"audit_shortcuts"}),
    ({A + "ambiguous_discourse_markers": ["that"]}, {"audit_markers"}),
    ({A + "locality.warning": True}, {"audit_locality"}),
]


def changed(k, changes):
    row = copy.deepcopy(GOOD) | {"id": f"q{k}" if k else "good"}
    for name, value in changes.items():
        *path, last = name.split(".")
        at = row
        for part in path:
            at = at[part]
        at[last] = value
    return ["s", k, *[row[c] for c in (*rules.REQUIRED, *rules.OPTIONAL)]]


def values(row):
    return tuple(tuple(v.values()) if isinstance(v, dict) and "locality" not in v else (*list(v.values())[:-1], tuple(v["locality"].values())) if isinstance(v, dict) else v for v in row)


@pytest.fixture(scope="module")
def frames(spark):
    sets = spark.createDataFrame([("s", "Alpha", CONTEXT, True, 4, 5, "Alpha", 1)], SETS)
    facts = spark.createDataFrame([("s", k, *e) for k, e in enumerate(EDGES)], FACTS)
    return sets, facts


def test_question_rules(spark, frames):
    sets, facts = frames
    rows = [values(changed(k, changes)) for k, (changes, _) in enumerate(CASES)]
    got = {k: set() for k in range(len(CASES))}
    for r in rules.validate(sets, spark.createDataFrame(rows, QUESTIONS), facts).where("scope = 'question'").collect():
        got[r["ord"]].add(r["rule"])
    wrong = {k: (CASES[k][0], got[k] ^ CASES[k][1]) for k in got if got[k] != CASES[k][1]}
    assert not wrong
    # what no case breaks: paths that return, and paths that start elsewhere in sets without hop semantics
    assert {r[0] for r in rules.QUESTION_RULES} - set().union(*got.values()) == {"path_starts_elsewhere", "repeated_nodes", "duplicate_edges"}


def test_paths_that_return_and_sets_without_hop_semantics(spark, frames):
    sets, facts = frames
    facts = facts.unionByName(spark.createDataFrame([("s", 9, "Bravo", "back", "Alpha")], FACTS))
    path = [EDGES[0], ("Bravo", "back", "Alpha"), EDGES[0], EDGES[1]]
    row = values(changed(0, {"expected_path": path, "hop_count": 4, "required_relations": ["leads_0", "back", "leads_1"]}))
    got = {r["rule"] for r in rules.validate(sets, spark.createDataFrame([row], QUESTIONS), facts).where("scope = 'question'").collect()}
    assert {"repeated_nodes", "duplicate_edges"} <= got
    plain = spark.createDataFrame([("s", "Bravo", CONTEXT, False, 4, 5, None, None)], SETS)
    few = spark.createDataFrame([values(changed(0, {}))], QUESTIONS).drop(*rules.OPTIONAL)
    assert [r["rule"] for r in rules.validate(plain, few, facts).where("scope = 'question'").collect()] == ["path_starts_elsewhere"]


def test_set_and_fact_rules(spark, frames):
    _, facts = frames
    sets = [("s", "Alpha", CONTEXT, True, 4, 5, "Alpha", 1), ("t", "Alpha", "The Expected_Path is here", True, 9, 9, "Bravo", 9), ("u", "Alpha", " ", True, None, None, None, None)]
    sets = spark.createDataFrame(sets, SETS)
    rows = [values(changed(k, {"id": f"i{k}", "hop_count": 1 + k // 2})) for k in range(4)]
    rows[3] = (*rows[3][:6], [EDGES[2]], *rows[3][7:])
    facts = facts.unionByName(spark.createDataFrame([("t", 0, "Alpha", "r", "Alpha"), ("t", 1, "Alpha", "r", "Alpha"), ("t", 2, None, "r", "Bravo")], FACTS))
    got = {}
    for r in rules.validate(sets, spark.createDataFrame(rows, QUESTIONS), facts, per_hop=2, hops=2, builder=True).where("scope = 'set'").collect():
        got.setdefault(r["set_id"], set()).add(r["rule"])
    small = {"few_entities", "few_facts", "relation_types", "relations_not_reused", "root_out_degree"}
    assert got["s"] == small
    assert got["t"] == small - {"relations_not_reused"} | {"question_count", "hop_distribution", "malformed_edges", "duplicate_triples", "context_has_scoring", "few_long_branches", "isolated_entities", "edge_count_declared", "node_count_declared", "root_declared", "components_declared"}
    assert got["u"] == small | {"question_count", "hop_distribution", "context_empty", "few_long_branches", "edge_count_declared", "node_count_declared", "several_components"}

    told = "set_id string, ord long, " + ", ".join(f"{c} {t}" for c, t in rules.FACTS.items())
    rows = [
        ("s", 0, "f0", None, "m", "1", None, "so", None, None),
        ("s", 1, "f0", "guess", None, None, None, None, None, None),
        ("s", 2, "f2", "direct", None, None, "", " ", None, None),
        ("s", 3, "f3", "direct", "x", None, "2", "so", None, None),
        ("s", 4, "f4", "derived", None, None, None, None, "rule", ["f0", "f9"]),
        ("s", 5, "f5", "derived", None, None, None, None, None, []),
        ("t", 0, None, None, "x", "1", None, "so", None, None),
    ]
    evidence = rules.fact_evidence(spark.createDataFrame(rows, told), spark.createDataFrame([("s", "m")], "set_id string, source_id string"))
    got = {}
    for r in rules.broken(evidence, rules.FACT_RULES, rules.KEY).collect():
        got.setdefault((r["set_id"], r["ord"]), set()).add(r["rule"])
    assert got == {
        ("s", 1): {"fact_duplicate_id", "fact_kind", "fact_parents_missing", "fact_rule_missing"},
        ("s", 2): {"fact_source_missing", "fact_locator_missing", "fact_evidence_missing"},
        ("s", 3): {"fact_source_unknown"},
        ("s", 4): {"fact_parent_unknown"},
        ("s", 5): {"fact_parents_missing", "fact_rule_missing"},
    }


def test_no_questions_and_no_facts(spark, frames):
    sets, facts = frames
    none = spark.createDataFrame([], QUESTIONS)
    assert {r["scope"] for r in rules.validate(sets, none, facts).collect()} == {"set"}
    assert rules.validate(sets.where("false"), none, facts.where("false"), provenance=True).count() == 0


def test_many_questions_are_not_broadcast(spark, frames, monkeypatch):
    """Their files are small, so Spark would send them to every executor by way of the driver."""
    from claimloom.sources import shared

    sets, facts = frames
    asked = spark.createDataFrame([values(changed(0, {}))], QUESTIONS)

    def plan():
        return rules.question_evidence(sets, asked, facts)._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin [set_id#" in plan()
    monkeypatch.setattr(shared, "BROADCAST", 0)
    after = plan()
    assert "BroadcastHashJoin [set_id#" not in after and "SortMergeJoin [set_id#" in after


def test_many_nodes_are_not_broadcast(spark, monkeypatch):
    from claimloom.operators import paths
    from claimloom.sources import shared

    monkeypatch.setattr(shared, "BROADCAST", 0)
    facts = spark.createDataFrame([("e", k, a, "leads", b) for k, (a, b) in enumerate([*zip(CHAIN, CHAIN[1:], strict=False), ("Zulu", "Yankee")])], FACTS.replace("set_id", "execution_id"))
    found = paths.components(facts)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.node, r.component) for r in found.collect()} == {(n.lower(), "alpha") for n in CHAIN} | {("yankee", "yankee"), ("zulu", "yankee")}
