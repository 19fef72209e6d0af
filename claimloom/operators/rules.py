"""Rules for test sets, as data: (name, where it applies, SQL predicate that is true where the rule is broken).

Each scope (questions, facts, whole sets) is one frame of evidence, made by equi-joins and groupings on the set and the question, and one projection
that evaluates all its rules as an array of names, which is exploded once. Many sets are judged together; callers may pass rules of their own.

A question is known by set_id and ord. Results: rows without fields that are required break `missing_fields` alone, those without a path
no rule about paths; a predicate that is null isn't broken; distances over `most` count as none; an empty table gives no rows for its scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import normalize
from claimloom.operators.aliases import discourse, expanded, mentioned
from claimloom.operators.paths import MAX_DEPTH, contiguous, distances, graph_metrics, path_nodes
from claimloom.operators.reports import locality
from claimloom.sources.shared import beside, cut

KEY = ["set_id", "ord"]

_EDGE = "struct<subject:string,relation:string,object:string>"
_LOCALITY = "struct<sentence:string,answer_in_one_sentence:boolean,warning:boolean,status:string>"
#: Columns of questions; those after the required ones may be missing, and count as null.
REQUIRED = {"id": "string", "hop_count": "int", "question": "string", "expected_answer": "string", "expected_path": f"array<{_EDGE}>", "required_entities": "array<string>", "required_relations": "array<string>"}
OPTIONAL = {
    "question_anchor_entities": "array<string>",
    "reasoning_anchor_entities": "array<string>",
    "graph_root_entity": "string",
    "hop_semantics": "string",
    "anchor_detection": "struct<anchor_detected_from_question:boolean,anchor_detection_method:string,detected_entities:array<string>,matched_aliases:array<string>>",
    "shortcut_audit": "struct<manual_reviewed:boolean,generator_checked:boolean,human_review_status:string,expected_path_length:int,shortest_distance_from_graph_root:int,"
    "shortest_distance_from_question_anchor:int,shortest_anchor_distance:int,direct_final_subject_mentioned:boolean,expected_answer_mentioned:boolean,late_chain_entity_mentioned:boolean,"
    f"one_hop_parent_mentioned:boolean,shortcut_entities:array<string>,ambiguous_discourse_markers:array<string>,locality:{_LOCALITY}>",
}
SETS = {"root_entity": "string", "trusted_context": "string", "enforce_hops": "boolean", "edge_count_designed": "long", "node_count": "long", "root_node": "string", "connected_components_designed": "long"}
FACTS = {"fact_id": "string", "fact_kind": "string", "source_id": "string", "page": "string", "section": "string", "evidence": "string", "derivation_rule": "string", "parent_fact_ids": "array<string>"}

#: Where question rules apply; each holds only where the one before does.
LEVELS = {"row": "true", "fields": "NOT missing", "path": "NOT missing AND size(expected_path) > 0", "hops": "NOT missing AND size(expected_path) > 0 AND enforce_hops", "audit": "NOT missing AND size(expected_path) > 0 AND enforce_hops AND shortcut_audit IS NOT NULL"}

LABEL = "designed_root_to_answer_graph_depth"
_AUDIT = "shortcut_audit"

QUESTION_RULES = (
    ("missing_fields", "row", "missing"),
    ("duplicate_id", "fields", "repeated"),
    ("path_length", "fields", "size(expected_path) <> hop_count"),
    ("path_empty", "fields", "size(expected_path) = 0"),
    ("path_starts_elsewhere", "path", "NOT enforce_hops AND start IS DISTINCT FROM root_entity"),
    ("edge_absent", "path", "edge_absent"),
    ("not_contiguous", "path", "NOT contiguous"),
    ("answer_not_terminus", "path", "expected_answer <> terminus"),
    ("required_entities", "path", "array_sort(array_distinct(required_entities)) <> array_sort(path_entities)"),
    ("required_relations", "path", "array_sort(array_distinct(required_relations)) <> array_sort(array_distinct(transform(expected_path, e -> e.relation)))"),
    ("answer_absent", "path", "NOT answer_known"),
    ("anchors_missing", "hops", "size(anchors) = 0"),
    ("start_is_no_anchor", "hops", "size(anchors) > 0 AND NOT array_contains(anchor_labels, start_label)"),
    ("anchor_alias_differs", "hops", "reasoning_anchor_entities IS NOT NULL AND reasoning_anchor_entities <> anchors"),
    ("graph_root", "hops", "graph_root_entity IS DISTINCT FROM root_entity"),
    ("anchor_undetected", "hops", "size(array_except(anchor_labels, detected_labels)) > 0"),
    ("detection_missing", "hops", "anchor_detection IS NULL"),
    ("detection_not_from_question", "hops", "anchor_detection IS NOT NULL AND anchor_detection.anchor_detected_from_question IS DISTINCT FROM true"),
    ("detection_method", "hops", "anchor_detection IS NOT NULL AND anchor_detection.anchor_detection_method IS DISTINCT FROM 'alias_match'"),
    ("detection_entities", "hops", "anchor_detection IS NOT NULL AND anchor_detection.detected_entities IS DISTINCT FROM anchors"),
    ("detection_aliases", "hops", "anchor_detection IS NOT NULL AND array_sort(coalesce(anchor_detection.matched_aliases, array())) <> anchor_aliases"),
    ("hop_label", "hops", f"hop_semantics IS DISTINCT FROM '{LABEL}'"),
    ("repeated_nodes", "hops", "size(all_nodes) <> size(array_distinct(all_nodes))"),
    ("duplicate_edges", "hops", "size(expected_path) <> size(array_distinct(expected_path))"),
    ("anchor_distance", "hops", "anchor_distance IS DISTINCT FROM hop_count"),
    ("final_subject_mentioned", "hops", "hop_count > 1 AND final_subject_mentioned"),
    ("answer_mentioned", "hops", "hop_count > 1 AND answer_mentioned"),
    ("shortcut_mentioned", "hops", "size(shortcuts) > 0"),
    ("discourse_markers", "hops", "size(markers) > 0"),
    ("audit_missing", "hops", "shortcut_audit IS NULL"),
    ("audit_manual_reviewed", "audit", f"{_AUDIT}.manual_reviewed IS NOT NULL"),
    ("audit_generator_unchecked", "audit", f"{_AUDIT}.generator_checked IS DISTINCT FROM true"),
    ("audit_review_status", "audit", f"coalesce({_AUDIT}.human_review_status, '') NOT IN ('pending', 'reviewed', 'not_reviewed')"),
    ("audit_path_length", "audit", f"{_AUDIT}.expected_path_length <> hop_count"),
    ("audit_root_distance", "audit", f"{_AUDIT}.shortest_distance_from_graph_root IS NOT NULL AND {_AUDIT}.shortest_distance_from_graph_root IS DISTINCT FROM root_distance"),
    ("audit_question_distance", "audit", f"{_AUDIT}.shortest_distance_from_question_anchor IS DISTINCT FROM anchor_distance"),
    ("audit_anchor_distance", "audit", f"{_AUDIT}.shortest_anchor_distance IS NOT NULL AND {_AUDIT}.shortest_anchor_distance IS DISTINCT FROM anchor_distance"),
    ("audit_final_subject", "audit", f"{_AUDIT}.direct_final_subject_mentioned IS DISTINCT FROM final_subject_mentioned"),
    ("audit_answer", "audit", f"{_AUDIT}.expected_answer_mentioned IS DISTINCT FROM answer_mentioned"),
    ("audit_late_entity", "audit", f"{_AUDIT}.late_chain_entity_mentioned IS DISTINCT FROM exists(shortcuts, s -> s <> final_subject)"),
    ("audit_parent", "audit", f"{_AUDIT}.one_hop_parent_mentioned IS DISTINCT FROM (final_subject_mentioned AND NOT array_contains(anchor_labels, final_label))"),
    ("audit_shortcuts", "audit", f"array_sort(coalesce({_AUDIT}.shortcut_entities, array())) <> shortcuts"),
    ("audit_markers", "audit", f"array_sort(coalesce({_AUDIT}.ambiguous_discourse_markers, array())) <> markers"),
    ("audit_locality", "audit", f"{_AUDIT}.locality IS DISTINCT FROM locality"),
    ("audit_reports_final_subject", "audit", f"hop_count > 1 AND {_AUDIT}.direct_final_subject_mentioned"),
)

FACT_RULES = (
    ("fact_duplicate_id", "true", "repeated"),
    ("fact_kind", "true", "kind NOT IN ('direct', 'derived')"),
    ("fact_source_missing", "direct", "coalesce(source_id, '') = ''"),
    ("fact_source_unknown", "direct", "coalesce(source_id, '') <> '' AND source_unknown"),
    ("fact_locator_missing", "direct", "coalesce(page, section, '') = ''"),
    ("fact_evidence_missing", "direct", "trim(coalesce(evidence, '')) = ''"),
    ("fact_parents_missing", "NOT direct", "coalesce(size(parent_fact_ids), 0) < 1"),
    ("fact_rule_missing", "NOT direct", "trim(coalesce(derivation_rule, '')) = ''"),
    ("fact_parent_unknown", "NOT direct", "parent_unknown"),
)

SET_RULES = (
    ("question_count", "true", "n_questions <> hops * per_hop"),
    ("hop_distribution", "true", "hops_right <> hops OR hops_all <> hops"),
    ("malformed_edges", "true", "malformed > 0"),
    ("duplicate_triples", "true", "duplicates > 0"),
    ("context_empty", "true", "trim(coalesce(trusted_context, '')) = ''"),
    ("context_has_scoring", "true", "lower(trusted_context) LIKE '%expected\\_path%' OR lower(trusted_context) LIKE '%expected\\_answer%'"),
    ("few_long_branches", "true", "long_branches < 2"),
    ("isolated_entities", "true", "isolated > 0"),
    ("edge_count_declared", "true", "edge_count_designed IS DISTINCT FROM edges"),
    ("node_count_declared", "true", "node_count IS DISTINCT FROM nodes"),
    ("root_declared", "true", "root_node IS NOT NULL AND root_node IS DISTINCT FROM root_entity"),
    ("components_declared", "true", "connected_components_designed IS NOT NULL AND connected_components_designed <> components"),
)

#: What a builder asks of its own sets beside the rules above; the numbers are fixed values.
BUILDER_SET_RULES = (
    ("few_entities", "true", "nodes < 45"),
    ("few_facts", "true", "edges < 55"),
    ("relation_types", "true", "relations NOT BETWEEN 15 AND 30"),
    ("relations_not_reused", "true", "relations_reused <= relations div 2"),
    ("root_out_degree", "true", "root_out_degree NOT BETWEEN 6 AND 12"),
    ("several_components", "true", "components <> 1"),
)
BUILDER_QUESTION_RULES = (
    ("builder_path_start", "path", "start IS DISTINCT FROM root_entity"),
    ("builder_anchor_alias", "fields", "question_anchor_entities IS DISTINCT FROM reasoning_anchor_entities"),
    ("builder_review_pending", "fields", "shortcut_audit.human_review_status IS DISTINCT FROM 'pending'"),
)


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def broken(evidence: DataFrame, rules, keys: list[str], levels: dict[str, str] | None = None) -> DataFrame:
    """keys, rule: a row for each rule that a row of evidence breaks."""
    tests = [F.expr(f"CASE WHEN ({(levels or {}).get(level, level)}) AND ({predicate}) THEN '{name}' END") for name, level, predicate in rules]
    return evidence.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("rule"))


def question_evidence(sets: DataFrame, questions: DataFrame, facts: DataFrame, aliases: DataFrame | None = None, most: int = MAX_DEPTH) -> DataFrame:
    """A row for each question of a known set: its columns and what QUESTION_RULES ask."""
    c = F.col
    sets, asked = _with(sets, SETS), _with(questions, REQUIRED | OPTIONAL).select(*KEY, *REQUIRED, *OPTIONAL)
    asked = asked.join(sets.select("set_id", "root_entity", "trusted_context", F.coalesce("enforce_hops", F.lit(False)).alias("enforce_hops")), "set_id")
    asked = asked.repartition(*KEY)  # short rows, of which a file has many for one task
    path, last = c("expected_path"), F.try_element_at("expected_path", F.lit(-1))
    missing = c("id").isNull()
    for name in [*REQUIRED][1:]:
        missing |= c(name).isNull()
    anchors = F.coalesce("question_anchor_entities", F.array().cast("array<string>"))
    asked = asked.withColumns({
        "missing": missing,
        "anchors": anchors,
        "anchor_labels": F.array_distinct(F.transform(anchors, normalize)),
        "start": F.get(path, F.lit(0))["subject"],
        "start_label": normalize(F.get(path, F.lit(0))["subject"]),
        "terminus": last["object"],
        "final_subject": last["subject"],
        "final_label": normalize(last["subject"]),
        "all_nodes": path_nodes(path),
        "path_entities": F.array_distinct(F.flatten(F.transform(path, lambda e: F.array(e["subject"], e["object"])))),
        "contiguous": contiguous(path),
        "markers": discourse(F.coalesce("question", F.lit(""))),
    })
    asked = cut(asked)
    n, n_sets = asked.agg(F.count(F.lit(1)), F.count_distinct("set_id")).first()
    # what is found out of questions stands by KEY, so that their long rows are shuffled once
    first = asked.where("id is not null").groupBy("set_id", "id").agg(F.min("ord").alias("ord")).select(*KEY, F.lit(True).alias("first")).distinct()
    known = cut(facts.select("set_id", "subject", "relation", "object").distinct())
    steps = asked.select(*KEY, F.explode("expected_path").alias("e")).select(*KEY, "e.*")
    absent = steps.join(beside(known), ["set_id", "subject", "relation", "object"], "left_anti").select(*KEY).distinct().withColumn("edge_absent", F.lit(True))
    nodes = cut(known.select("set_id", F.explode(F.array("subject", "object")).alias("entity")).where("entity is not null").distinct())
    n_nodes = nodes.count()
    answered = asked.select(*KEY, c("expected_answer").alias("entity")).join(beside(nodes, n_nodes), ["set_id", "entity"], "left_semi").select(*KEY).distinct().withColumn("answer_known", F.lit(True))

    # names in the questions' texts: the graphs' own, and those of answers and paths
    names = nodes.select("entity").unionAll(asked.select("expected_answer")).unionAll(asked.select(F.explode("path_entities"))).distinct()
    found = mentioned(asked.select(F.struct(*KEY, c("expected_answer").alias("answer")).alias("q"), "question"), expanded(names, aliases), "q", "question").select("q.*", "entity", "aliases")
    found = cut(found.join(beside(nodes.withColumn("in_graph", F.lit(True)), n_nodes), ["set_id", "entity"], "left"))
    # one search a set and answer, against the edges, tells how far all its names are
    answers = asked.select("set_id", c("expected_answer").alias("answer")).where("answer is not null").distinct().withColumn("node", normalize("answer"))
    against = known.select("set_id", normalize("object").alias("u"), normalize("subject").alias("v"))
    far = cut(distances(answers, against, ("set_id",), most, ("answer",)))
    asks = asked.select(*KEY, c("expected_answer").alias("answer"), F.array_append(F.transform("anchors", lambda a: F.struct(F.lit("anchor").alias("role"), a.alias("entity"))), F.struct(F.lit("root").alias("role"), c("root_entity").alias("entity"))).alias("x"))
    asks = asks.select(*KEY, "answer", F.explode("x").alias("x")).select(*KEY, "answer", "x.*")
    asks = asks.unionByName(found.where("in_graph").select(*KEY, "answer", F.lit("found").alias("role"), "entity"))
    depths = asks.withColumn("node", normalize("entity")).join(beside(far), ["set_id", "answer", "node"])
    depths = depths.groupBy(*KEY).agg(
        F.min(F.when(c("role") == "anchor", c("depth"))).alias("anchor_distance"),
        F.min(F.when(c("role") == "root", c("depth"))).alias("root_distance"),
        F.collect_set(F.when(c("role") == "found", F.struct("entity", "node", "depth"))).alias("near"),
    )
    seen = found.groupBy(*KEY).agg(F.collect_set(F.struct("entity", normalize("entity").alias("label"), "in_graph", "aliases")).alias("seen"))
    contexts = asked.select("set_id", c("trusted_context").alias("context")).distinct()
    local = locality(asked.select(*KEY, "question", c("expected_answer").alias("answer")), beside(contexts, n_sets), KEY, on=["set_id"])
    local = local.select(*KEY, F.struct("sentence", "answer_in_one_sentence", "warning", "status").alias("locality"))

    x = asked
    for part in (first, absent, answered, depths, seen, local):
        x = x.join(beside(part, n), KEY, "left")
    x = x.withColumns({"repeated": c("id").isNotNull() & c("ord").isNotNull() & c("first").isNull(), "edge_absent": F.coalesce("edge_absent", F.lit(False)), "answer_known": F.coalesce("answer_known", F.lit(False))})
    return x.withColumns({
        "detected_labels": F.expr("transform(filter(coalesce(seen, array()), s -> s.in_graph), s -> s.label)"),
        "anchor_aliases": F.expr("array_sort(flatten(transform(filter(coalesce(seen, array()), s -> array_contains(anchors, s.entity)), s -> s.aliases)))"),
        "final_subject_mentioned": F.expr("exists(coalesce(seen, array()), s -> s.entity = final_subject)"),
        "answer_mentioned": F.expr("exists(coalesce(seen, array()), s -> s.entity = expected_answer)"),
        "shortcuts": F.expr("array_sort(transform(filter(coalesce(near, array()), n -> n.depth < hop_count AND NOT array_contains(anchor_labels, n.node)), n -> n.entity))"),
    })


def fact_evidence(facts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A row for each fact. sources: set_id, source_id; sets without any have no unknown ones."""
    rows = _with(facts, FACTS).select("set_id", "ord", *FACTS)
    rows = rows.withColumn("kind", F.expr("coalesce(nullif(fact_kind, ''), 'direct')")).withColumn("direct", F.col("kind") == "direct")
    ids = rows.where("fact_id <> ''").groupBy("set_id", "fact_id").agg(F.min("ord").alias("first_ord"))
    parents = rows.where("kind = 'derived'").select(*KEY, F.explode("parent_fact_ids").alias("fact_id"))
    lost = parents.join(ids, ["set_id", "fact_id"], "left_anti").select(*KEY).distinct().withColumn("parent_unknown", F.lit(True))
    out = rows.join(ids, ["set_id", "fact_id"], "left").join(lost, KEY, "left").withColumn("repeated", F.col("ord") > F.col("first_ord"))
    if sources is None:
        return out.withColumn("source_unknown", F.lit(False))
    listed = sources.select("set_id").distinct().withColumn("has_sources", F.lit(True))
    out = out.join(sources.select("set_id", "source_id").distinct().withColumn("listed", F.lit(True)), ["set_id", "source_id"], "left").join(listed, "set_id", "left")
    return out.withColumn("source_unknown", F.col("has_sources") & F.col("listed").isNull())


def set_evidence(sets: DataFrame, questions: DataFrame, facts: DataFrame, per_hop: int = 5, hops: int = 10) -> DataFrame:
    """A row for each set, with figures of its graph and its questions."""
    c = F.col
    asked = _with(questions, REQUIRED)
    by_hop = asked.groupBy("set_id", "hop_count").agg(F.count(F.lit(1)).alias("n"))
    by_hop = by_hop.groupBy("set_id").agg(F.sum("n").alias("n_questions"), F.count_if((c("n") == per_hop) & c("hop_count").between(1, hops)).alias("hops_right"), F.count(F.lit(1)).alias("hops_all"))
    long = asked.where(c("hop_count") == hops).groupBy("set_id").agg(F.countDistinct(F.get("expected_path", F.lit(0))).alias("long_branches"))
    bad = facts.groupBy("set_id").agg(F.count_if(c("subject").isNull() | c("relation").isNull() | c("object").isNull()).alias("malformed"))
    used = facts.groupBy("set_id", "relation").agg(F.count(F.lit(1)).alias("n")).groupBy("set_id").agg(F.count_if(c("n") > 1).alias("relations_reused"))
    out_degree = facts.join(sets.select("set_id", c("root_entity").alias("subject")), ["set_id", "subject"]).groupBy("set_id").agg(F.countDistinct("object").alias("root_out_degree"))
    figures = graph_metrics(facts.where("subject is not null and object is not null"), ("set_id",))
    x = _with(sets, SETS)
    for part in (by_hop, long, bad, used, out_degree, figures):
        x = x.join(part, "set_id", "left")
    x = x.fillna(0, ["n_questions", "hops_right", "hops_all", "long_branches", "malformed", "relations_reused", "root_out_degree", *[f for f in figures.columns if f != "set_id"]])
    return x.withColumns({"hops": F.lit(hops), "per_hop": F.lit(per_hop)})


def validate(sets: DataFrame, questions: DataFrame, facts: DataFrame, aliases: DataFrame | None = None, sources: DataFrame | None = None, provenance: bool = False, builder: bool = False, per_hop: int = 5, hops: int = 10) -> DataFrame:
    """set_id, scope, ord (null for whole sets), rule: every rule that is broken. aliases: entity, alias, ord."""
    on_questions = QUESTION_RULES + (BUILDER_QUESTION_RULES if builder else ())
    on_sets = SET_RULES + (BUILDER_SET_RULES if builder else ())
    ord_ = F.col("ord").cast("long").alias("ord")
    out = broken(question_evidence(sets, questions, facts, aliases), on_questions, KEY, LEVELS).select("set_id", F.lit("question").alias("scope"), ord_, "rule")
    whole = broken(set_evidence(sets, questions, facts, per_hop, hops), on_sets, ["set_id"])
    out = out.unionByName(whole.select("set_id", F.lit("set").alias("scope"), F.lit(None).cast("long").alias("ord"), "rule"))
    if provenance:
        out = out.unionByName(broken(fact_evidence(facts, sources), FACT_RULES, KEY).select("set_id", F.lit("fact").alias("scope"), ord_, "rule"))
    return out
