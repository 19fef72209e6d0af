"""Figures over benchmark results: by hop and overall, failures, attempts, telemetry, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import contains_expected, content_tokens, exact_match, flat_sentences, normalize, normalize_entity, normalize_relation, strip
from claimloom.operators.paths import contiguous, path_nodes


def failure_category(error: Column, resolved: Column, contains: Column, stop: Column) -> Column:
    e, s = F.lower(F.coalesce(error, F.lit(""))), F.lower(F.coalesce(stop, F.lit("")))
    return (
        F.when((e != "") & F.contains(e, F.lit("projection")), "projection_failure")
        .when((e != "") & e.rlike("timeout|exceeded"), "model_timeout")
        .when((e != "") & F.contains(e, F.lit("neo4j")), "neo4j_persistence_or_readback")
        .when((e != "") & F.contains(e, F.lit("context")) & e.rlike("large|limit"), "prompt_or_context_too_large")
        .when(e != "", "pipeline_error")
        .when(resolved, F.lit(None).cast("string"))
        .when(contains, "answer_matched_textually_but_pipeline_unresolved")
        .when(F.contains(s, F.lit("target_not_satisfied")), "target_not_satisfied")
        .when(F.contains(s, F.lit("no_evidence")), "unresolved_no_evidence")
        .when(F.contains(s, F.lit("no_claims")), "no_claims_extracted")
        .when(F.contains(s, F.lit("max_iterations")), "contradiction_or_uncertainty_remained")
        .otherwise("pipeline_unresolved")
    )


def _figures() -> list[Column]:
    no_error = F.coalesce("error", F.lit("")) == ""
    return [
        F.count(F.lit(1)).alias("questions"),
        F.count_if(no_error).alias("completed"),
        F.count_if("exact_match").alias("exact_match"),
        F.count_if("contains_expected").alias("contains_expected"),
        F.count_if("resolved").alias("pipeline_resolved"),
        F.count_if(F.col("resolved") & F.col("contains_expected")).alias("resolved_and_matched"),
        F.count_if(~F.col("resolved") & F.col("contains_expected") & no_error).alias("unresolved_but_contained"),
        F.coalesce(F.avg("iterations"), F.lit(0.0)).alias("average_iterations"),
        F.coalesce(F.avg("runtime_seconds"), F.lit(0.0)).alias("average_runtime_seconds"),
    ]


def summary_by_hop(results: DataFrame) -> DataFrame:
    return results.groupBy("hop_count").agg(*_figures())


def summary(results: DataFrame) -> DataFrame:
    """One row, zeros where there are no results."""
    g = results.agg(*_figures())
    n = F.greatest("questions", F.lit(1))
    return g.withColumns({"errored": F.col("questions") - F.col("completed"), "exact_match_accuracy": F.col("exact_match") / n, "contains_expected_accuracy": F.col("contains_expected") / n})


def summary_rollup(results: DataFrame) -> DataFrame:
    """By hop and overall (hop_count null) in one pass."""
    return results.rollup("hop_count").agg(*_figures())


def failure_histogram(results: DataFrame, keys: list[str] | None = None, order: str = "ord") -> DataFrame:
    """keys, failure_category, n, place: by frequency, the first seen first among equals."""
    from pyspark.sql import Window

    k = keys or []
    g = results.where("failure_category is not null").groupBy(*k, "failure_category").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("n"), "__first"))).drop("__first")


def resume(questions: DataFrame, prior: DataFrame, resuming: bool = True, retry_errors: bool = False, rerun_completed: bool = False, key: str = "id", order: str = "ord") -> DataFrame:
    """Questions with what an earlier run means for them: skip, attempt, resumed, prior (the last row of that id)."""
    rest = [c for c in prior.columns if c != key]
    last = prior.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("prior"))
    rows = questions.join(last, key, "left")
    had = F.col("prior").isNotNull()
    failed = F.coalesce(F.coalesce("prior.error", F.lit("")) != "", F.lit(False))
    skip = had & F.lit(resuming and not rerun_completed) & ~(F.lit(retry_errors) & failed)
    return rows.withColumns({"skip": skip, "attempt": F.when(had, F.greatest(F.coalesce("prior.attempt_number", F.lit(1)), F.lit(1)) + 1).otherwise(1), "resumed": had & F.lit(resuming)})


def select_questions(questions: DataFrame, ids: list[str] | None = None, start_at: str | None = None, limit: int | None = None, order: str = "ord") -> DataFrame:
    """Questions in the order asked for; from one id on; so many. Unknown ids are an error."""
    if ids is not None:
        spark = questions.sparkSession
        asked = spark.createDataFrame(list(enumerate(ids)), "at int, id string")
        missing = asked.join(questions, "id", "left_anti").limit(5).collect()
        if missing:
            raise ValueError(f"unknown question ids: {[r['id'] for r in missing]}")
        questions = questions.join(F.broadcast(asked), "id")
        order = "at"
    if start_at is not None:
        first = questions.where(F.col("id") == start_at).agg(F.min(order)).first()[0]
        if first is None:
            raise ValueError(f"unknown question id: {start_at}")
        questions = questions.where(F.col(order) >= first)
    questions = questions.orderBy(order)
    return questions if limit is None else questions.limit(limit)


def telemetry(calls: DataFrame, keys: list[str], window_tokens: int | None) -> DataFrame:
    """keys, calls, figures of the largest prompt (the first of several), and whether it came near the window."""
    big = F.max_by(F.struct("stage", "prompt_characters", F.ceil(F.col("prompt_characters") / 4).alias("tokens")), F.struct("prompt_characters", -F.col("call_index"))).alias("b")
    g = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), big)
    near = F.col("b.tokens") >= int((window_tokens or 0) * 0.8) if window_tokens else F.lit(False)
    return g.select(*keys, "calls", F.col("b.prompt_characters").alias("max_prompt_characters"), F.col("b.tokens").alias("approx_max_prompt_tokens"), F.col("b.stage").alias("largest_prompt_stage"), near.alias("approached_context_limit"))


def run_type(provider: str, selected: int, total: int, done: int) -> str:
    if provider == "mock":
        return "mock_plumbing"
    return "full_real" if selected == total == done else "partial_real"


def locality(questions: DataFrame, contexts: DataFrame, keys: list[str], warn_at: int = 5, on: list[str] | None = None) -> DataFrame:
    """keys, sentence, overlap, warning, status: the sentence of the context that has the answer and most of the question's words, the earliest of several. on: those of the keys that a context has, if it is not each question's own."""
    on = on or keys
    sentences = contexts.select(*on, F.posexplode(flat_sentences("context")).alias("at", "sentence"))
    rows = questions.join(sentences, on, "left").withColumn("answer_norm", normalize_entity("answer"))
    has = (F.col("answer_norm") != "") & F.contains(normalize_entity("sentence"), F.col("answer_norm"))
    overlap = F.size(F.array_intersect(content_tokens("question"), content_tokens("sentence")))
    best = F.max_by(F.struct("sentence", "overlap"), F.when(has, F.struct("overlap", -F.col("at"))))  # sentences without the answer are no candidates
    rows = rows.withColumn("overlap", overlap).groupBy(*keys).agg(best.alias("b"))
    warning = F.coalesce(F.col("b.overlap") >= warn_at, F.lit(False))
    return rows.select(*keys, F.coalesce("b.sentence", F.lit("")).alias("sentence"), F.col("b").isNotNull().alias("answer_in_one_sentence"), warning.alias("warning"), F.when(warning, "WARNING").otherwise("PASS").alias("status"))


def validate(questions: DataFrame, facts: DataFrame, root: str, per_hop: int | None = None, hops: int = 10) -> DataFrame:
    """Rows (id, error) for every rule that a question set breaks; id is null for rules about the whole set.

    questions: id, hop_count, question, expected_answer, expected_path (array of structs subject, relation, object), required_entities, required_relations.
    """
    path = F.col("expected_path")
    nodes = F.array_distinct(path_nodes(path))
    relations = F.array_distinct(F.transform(path, lambda e: e["relation"]))

    def differ(a: Column, b: Column) -> Column:
        return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)

    size = F.size(path)
    end = F.try_element_at(path, F.lit(-1))["object"]
    checks = [
        (size != F.col("hop_count"), F.format_string("path length %d != hop_count %d", size, F.col("hop_count").cast("int"))),
        (size == 0, F.lit("expected_path is empty")),
        ((size > 0) & (F.get(path, F.lit(0))["subject"] != root), F.lit(f"path does not start at root '{root}'")),
        ((size > 0) & ~contiguous(path), F.lit("expected_path is not contiguous")),
        ((size > 0) & (F.col("expected_answer") != end), F.lit("expected answer is not path terminus")),
        ((size > 0) & differ(F.col("required_entities"), nodes), F.lit("required_entities does not match path")),
        ((size > 0) & differ(F.col("required_relations"), relations), F.lit("required_relations does not match path")),
        ((size > 0) & (F.size(path_nodes(path)) != F.size(nodes)), F.lit("expected_path has repeated nodes")),
        ((size > 0) & (size != F.size(F.array_distinct(path))), F.lit("expected_path has duplicate edges")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), text) for bad, text in checks]), lambda e: e.isNotNull())
    out = questions.select("id", F.explode(found).alias("error"))
    steps = questions.select("id", F.explode(path).alias("e")).select("id", "e.*")
    known = facts.select("subject", "relation", "object").distinct()
    out = out.unionByName(steps.join(known, ["subject", "relation", "object"], "left_anti").select("id").distinct().withColumn("error", F.lit("path contains edge absent from graph")))
    names = facts.select(F.explode(F.array("subject", "object")).alias("expected_answer")).distinct()
    out = out.unionByName(questions.join(names, "expected_answer", "left_anti").select("id", F.lit("expected answer is absent from graph").alias("error")))
    out = out.unionByName(questions.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate question id").alias("error")))
    whole = F.lit(None).cast("string").alias("id")
    twice = facts.groupBy("subject", "relation", "object").count().where("count > 1").limit(1)
    out = out.unionByName(twice.select(whole, F.lit("expected_graph_facts contains duplicate triples").alias("error")))
    if per_hop is not None:
        want = questions.sparkSession.range(1, hops + 1).select(F.col("id").cast("int").alias("hop"))
        have = questions.groupBy(F.col("hop_count").cast("int").alias("hop")).agg(F.count(F.lit(1)).alias("n"))
        off = want.join(have, "hop", "full").where(F.coalesce("n", F.lit(0)) != per_hop)
        out = out.unionByName(off.select(whole, F.format_string(f"hop %d has %d questions, expected {per_hop}", "hop", F.coalesce("n", F.lit(0))).alias("error")))
    return out


def shortcuts(mentioned: DataFrame, far: DataFrame, questions: DataFrame, key: str = "id") -> DataFrame:
    """key, anchors, shortcut_entities: of the entities a question mentions, those at the designed distance from its answer, and others that are nearer.

    mentioned: key, entity. far: key, entity, depth (to the answer). questions: key, hop_count.
    """
    rows = mentioned.join(far, [key, "entity"], "left").join(questions.select(key, "hop_count"), key)
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("depth") == F.col("hop_count"), F.col("entity")))).alias("anchors"), F.array_sort(F.collect_set(F.when(F.col("depth") < F.col("hop_count"), F.col("entity")))).alias("shortcut_entities"))


# single results and documents


def score(results: DataFrame, sub_results: DataFrame, expected: DataFrame, key: str = "question_id") -> DataFrame:
    """key, expected_answer, predicted_answer, last_answer, exact_match, contains_expected, last_matches, resolved, final_stop_reason, all_stop_reasons, failure_category.

    results: key, combined_answer. sub_results: key, sub_question_id, answer, stop_reason. The combined answer is what is scored; last_matches tells whether the last sub-question's
    own answer contains the expected one, which is how the command line scores.
    """
    stops = F.array_sort(F.collect_list(F.struct("sub_question_id", "stop_reason")))
    per = sub_results.groupBy(key).agg(F.transform(stops, lambda x: x["stop_reason"]).alias("all_stop_reasons"), F.max_by("stop_reason", "sub_question_id").alias("final_stop_reason"), F.max_by("answer", "sub_question_id").alias("last_answer"), F.every(F.col("stop_reason") == "RESOLVED").alias("resolved"))
    rows = expected.join(results, key, "left").join(per, key, "left").withColumn("predicted_answer", F.coalesce("combined_answer", F.lit("")))
    rows = rows.withColumns({
        "exact_match": exact_match("predicted_answer", "expected_answer"),
        "contains_expected": contains_expected("predicted_answer", "expected_answer"),
        "last_matches": contains_expected(F.coalesce("last_answer", F.lit("")), "expected_answer"),
        "resolved": F.coalesce("resolved", F.lit(False)),
    })
    category = failure_category(F.lit(None).cast("string"), F.col("resolved"), F.col("contains_expected"), F.col("final_stop_reason"))
    return rows.withColumn("failure_category", category).select(key, "expected_answer", "predicted_answer", "last_answer", "exact_match", "contains_expected", "last_matches", "resolved", "final_stop_reason", "all_stop_reasons", "failure_category")


def source_line(answer: Column, relation: Column, obj: Column, source_sentence: Column) -> Column:
    """The first line of an answer with a triple's object or its relation in words, else its source sentence."""
    lines = F.filter(F.transform(F.split(answer, "\r?\n"), strip), lambda x: x != "")
    hit = F.filter(lines, lambda x: F.contains(F.lower(x), F.lower(obj)) | F.contains(F.lower(x), F.replace(relation, F.lit("_"), F.lit(" "))))
    return F.coalesce(F.get(hit, F.lit(0)), source_sentence)


def claims_differ(a: Column, b: Column) -> Column:
    """Two triples (structs) that aren't the same once normalized."""
    return (normalize(a["subject"]) != normalize(b["subject"])) | (normalize_relation(a["relation"]) != normalize_relation(b["relation"])) | (normalize(a["object"]) != normalize(b["object"]))


def verdict_lists(evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, keep, fix, remove: triples in order, by label."""
    triple = F.struct("ord", "subject", "relation", "object")
    lists = {"keep": "SUPPORTED", "fix": "CONTRADICTED", "remove": "NO_EVIDENCE"}
    return evaluations.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("label") == label, triple))).alias(name) for name, label in lists.items()])


def mark_interrupted(rows: DataFrame, executed: DataFrame, key: str = "id") -> DataFrame:
    """Rows of this run without a terminal_state are interrupted; earlier rows stay as they are."""
    mine = executed.select(key).distinct().withColumn("__ran", F.lit(True))
    state = F.when(F.col("__ran") & F.col("terminal_state").isNull(), "interrupted").otherwise(F.col("terminal_state"))
    return rows.join(mine, key, "left").withColumn("terminal_state", state).drop("__ran")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def provenance_errors(facts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Rows (fact_id, error). facts: fact_id, fact_kind, source_id, page, section, evidence, derivation_rule, parent_fact_ids. sources: source_id of the manifest."""
    c = F.col
    direct = F.coalesce("fact_kind", F.lit("direct")) == "direct"
    blank = lambda x: F.coalesce(strip(x), F.lit("")) == ""
    checks = [
        (~F.coalesce("fact_kind", F.lit("direct")).isin("direct", "derived"), "fact_kind must be direct or derived"),
        (direct & blank("source_id"), "direct fact missing source_id"),
        (direct & blank("page") & blank("section"), "direct fact missing page/section/locator reference"),
        (direct & blank("evidence"), "direct fact missing evidence paraphrase"),
        (~direct & (F.coalesce(F.size("parent_fact_ids"), F.lit(0)) < 1), "derived fact missing parent_fact_ids"),
        (~direct & blank("derivation_rule"), "derived fact missing derivation_rule"),
    ]
    found = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda e: e.isNotNull())
    out = facts.select("fact_id", F.explode(found).alias("error"))
    out = out.unionByName(facts.groupBy("fact_id").count().where("count > 1 and fact_id is not null").select("fact_id", F.lit("duplicate fact_id").alias("error")))
    parents = facts.where(~direct).select("fact_id", F.explode("parent_fact_ids").alias("parent"))
    lost = parents.join(facts.select(c("fact_id").alias("parent")), "parent", "left_anti")
    out = out.unionByName(lost.select("fact_id", F.concat(F.lit("parent fact "), "parent", F.lit(" does not exist")).alias("error")))
    if sources is not None:
        unknown = facts.where(direct & ~blank("source_id")).join(sources.select("source_id"), "source_id", "left_anti")
        out = out.unionByName(unknown.select("fact_id", F.concat(F.lit("unknown source_id "), "source_id").alias("error")))
    return out


def write_documents(results: DataFrame, folder: str, name: str = "name") -> None:
    """One JSON document for each result, in a directory of its name."""
    results.write.mode("overwrite").partitionBy(name).json(folder)


def markdown(figures: DataFrame, title: str) -> str:
    """A small summary table as Markdown, a row for each hop; more than 1,000 rows are no summary and an error."""
    rows = figures.orderBy(F.asc_nulls_last(figures.columns[0])).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a summary of more than 1,000 rows")
    lines = [f"# {title}", "", "| " + " | ".join(figures.columns) + " |", "|" + "---|" * len(figures.columns)]
    return "\n".join([*lines, *("| " + " | ".join("all" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)]) + "\n"
