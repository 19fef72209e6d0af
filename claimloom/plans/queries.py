"""Queries over whole test tables, one for each group of operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import registry as R
from claimloom.functions import text as T
from claimloom.functions import values as V
from claimloom.operators import align as A
from claimloom.operators import compare as C
from claimloom.operators import merge as M
from claimloom.operators import paths as P
from claimloom.sources import testgraph as G

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.facts(spark, sf_dir).withColumns({"execution_id": F.lit("all"), "evidence": F.lit(None).cast("string")})


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.claims(spark, sf_dir).withColumn("execution_id", F.lit("all"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LADDER = f"""{G.GRAPH_SQL},
exact AS (SELECT s, r, o, arg_max(ord, ord) AS e_ord FROM f GROUP BY ALL),
related AS (SELECT s, r, arg_min(object, ord) AS q_object, min(ord) AS q_ord FROM f GROUP BY ALL),
opposed AS (SELECT s, o, regexp_matches(r, '^(does_not|not|never|without|no)_') AS neg, arg_min(object, ord) AS p_object, min(ord) AS p_ord FROM f GROUP BY ALL),
labelled AS (
  SELECT c.*, e_ord, q_object, q_ord, p_object, p_ord,
    CASE WHEN e_ord IS NOT NULL THEN 'SUPPORTED' WHEN q_ord IS NOT NULL OR p_ord IS NOT NULL THEN 'CONTRADICTED' ELSE 'NO_EVIDENCE' END AS label
  FROM c LEFT JOIN exact USING (s, r, o) LEFT JOIN related USING (s, r)
  LEFT JOIN opposed p ON c.s = p.s AND c.o = p.o AND p.neg = NOT regexp_matches(c.r, '^(does_not|not|never|without|no)_')
)
"""


@query(_LADDER + "SELECT label, count(*)::BIGINT AS n FROM labelled GROUP BY label")
def compare_label_histogram(spark, sf_dir):
    return C.compare(_claims(spark, sf_dir), _facts(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    _LADDER
    + """SELECT ord, subject, relation, object, label, CASE WHEN e_ord IS NULL THEN coalesce(q_object, p_object) END AS conflicting_object,
    CASE WHEN e_ord IS NULL THEN coalesce(q_ord, p_ord, -1) ELSE -1 END AS conflicting_ord, coalesce(e_ord, -1) AS matched_ord FROM labelled"""
)
def compare_claims(spark, sf_dir):
    out = C.compare(_claims(spark, sf_dir), _facts(spark, sf_dir))
    return out.select("ord", "subject", "relation", "object", "label", "conflicting_object", F.coalesce("conflicting_fact.ord", F.lit(-1)).alias("conflicting_ord"), F.coalesce("matched_fact.ord", F.lit(-1)).alias("matched_ord"))


@query(
    _LADDER
    + """SELECT ord, object AS claimed, q_object AS trusted, 'Claim object ''' || object || ''' conflicts with KGc fact ''' || q_object || ''' for relation ''' || relation || '''.' AS reason
    FROM labelled WHERE e_ord IS NULL AND q_ord IS NOT NULL"""
)
def compare_conflicts(spark, sf_dir):
    out = C.compare(_claims(spark, sf_dir), _facts(spark, sf_dir)).where("label = 'CONTRADICTED'").where(F.contains("reason", F.lit("for relation '")))
    return out.select("ord", F.col("object").alias("claimed"), F.col("conflicting_object").alias("trusted"), "reason")


@query(_LADDER + "SELECT ord, relation, p_object AS trusted FROM labelled WHERE e_ord IS NULL AND q_ord IS NULL AND p_ord IS NOT NULL")
def compare_polarity(spark, sf_dir):
    out = C.compare(_claims(spark, sf_dir), _facts(spark, sf_dir)).where(F.contains("reason", F.lit("polarity mismatch")))
    return out.select("ord", "relation", F.col("conflicting_object").alias("trusted"))


@query(f"WITH p AS (SELECT p_partkey AS ord, {G.norm('p_name')} AS s, {G.norm('p_type')} AS o, p_brand FROM part) SELECT s, o, max(ord) AS last_ord, arg_max(p_brand, ord) AS brand FROM p GROUP BY s, o")
def exact_last_wins(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("subject"), F.lit("is_of").alias("relation"), F.col("p_type").alias("object"), F.col("p_brand").alias("evidence"), F.lit("all").alias("execution_id"))
    claims = part.select("execution_id", "subject", "relation", "object").distinct().withColumn("ord", F.lit(0).cast("long"))
    out = C.compare(claims, part)
    return out.groupBy(T.normalize("subject").alias("s"), T.normalize("object").alias("o")).agg(F.max("matched_fact.ord").alias("last_ord"), F.max_by("matched_fact.evidence", "matched_fact.ord").alias("brand"))


@query(
    f"""{G.GRAPH_SQL},
    by_object AS (SELECT r, o, min(subject) AS subject, min(relation) AS relation FROM f GROUP BY r, o HAVING count(*) = 1),
    by_polarity AS (SELECT o, regexp_matches(r, '^(does_not|not|never|without|no)_') AS neg, min(subject) AS subject, min(relation) AS relation FROM f GROUP BY ALL HAVING count(*) = 1),
    hit AS (SELECT DISTINCT s, r, o, true AS hit FROM f),
    j AS (SELECT c.ord, c.subject, c.relation, hit, coalesce(a.subject, b.subject) AS s2, CASE WHEN a.subject IS NOT NULL THEN a.relation ELSE b.relation END AS r2
      FROM c LEFT JOIN hit USING (s, r, o) LEFT JOIN by_object a ON a.r = c.r AND a.o = c.o LEFT JOIN by_polarity b ON b.o = c.o AND b.neg = regexp_matches(c.r, '^(does_not|not|never|without|no)_'))
    SELECT ord, CASE WHEN hit IS NULL AND s2 IS NOT NULL THEN s2 ELSE subject END AS subject, CASE WHEN hit IS NULL AND s2 IS NOT NULL THEN r2 ELSE relation END AS relation,
      hit IS NULL AND s2 IS NOT NULL AND (s2 <> subject OR r2 <> relation) AS moved FROM j"""
)
def align_unique_object(spark, sf_dir):
    out = A.align(_claims(spark, sf_dir), _facts(spark, sf_dir))
    return out.select("ord", "subject", "relation", F.col("aligned_from").isNotNull().alias("moved"))


@query(f"{G.GRAPH_SQL} SELECT c.ord, c.subject, c.object FROM c SEMI JOIN f USING (s, r, o)")
def terminal_semi_join(spark, sf_dir):
    keys = ["s", "r", "o"]
    return C.with_norms(_claims(spark, sf_dir)).join(C.with_norms(_facts(spark, sf_dir)).select(*keys), keys, "left_semi").select("ord", "subject", "object")


@query(f"{G.GRAPH_SQL} SELECT c.ord, c.subject, c.object FROM c ANTI JOIN f ON c.s = f.s")
def unsupported_anti_join(spark, sf_dir):
    return C.with_norms(_claims(spark, sf_dir)).join(C.with_norms(_facts(spark, sf_dir)).select("s"), "s", "left_anti").select("ord", "subject", "object")


@query(f"SELECT doc_id, md5({G.norm('text')}) AS hash, length({G.norm('text')})::BIGINT AS n FROM documents")
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize("text")).alias("hash"), F.length(T.normalize("text")).cast("long").alias("n"))


@query(f"SELECT o_orderkey, {G.norm_relation('x')} AS relation FROM (SELECT o_orderkey, ' Was--' || o_orderpriority || ' / ' || o_orderstatus || '  BY ' AS x FROM orders)")
def normalize_relation(spark, sf_dir):
    raw = F.concat(F.lit(" Was--"), "o_orderpriority", F.lit(" / "), "o_orderstatus", F.lit("  BY "))
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_relation(raw).alias("relation"))


_ANSWER = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""SELECT a.c_custkey, trim(a.c_name) = trim(b.c_name) AS exact_match, {_ANSWER.format("b.c_name")} <> '' AND contains(' ' || {_ANSWER.format("'Answer: ' || upper(a.c_name) || '.'")} || ' ', ' ' || {_ANSWER.format("b.c_name")} || ' ') AS contains_expected
    FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey - a.c_custkey % 2"""
)
def answer_match(spark, sf_dir):
    a = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("a"), (F.col("c_custkey") - F.col("c_custkey") % 2).alias("k"))
    b = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("b"))
    answer = F.concat(F.lit("Answer: "), F.upper("a"), F.lit("."))
    return a.join(b, "k").select("c_custkey", T.exact_match("a", "b").alias("exact_match"), T.contains_expected(answer, "b").alias("contains_expected"))


@query(
    """SELECT o_orderkey, month(o_orderdate)::INT AS start_month, day(o_orderdate)::INT AS start_day, month(o_orderdate)::INT AS end_month, least(day(o_orderdate) + 3, 28)::INT AS end_day, year(o_orderdate)::INT AS year,
    true AS same_as_words FROM orders"""
)
def date_interval_parse(spark, sf_dir):
    day, last = F.dayofmonth("o_orderdate"), F.least(F.dayofmonth("o_orderdate") + 3, F.lit(28))
    month, year = F.date_format("o_orderdate", "MMMM"), F.year("o_orderdate")
    short = F.format_string("%s %d-%d, %d", month, day, last, year)
    words = F.format_string("between %s %d and %d, %d", month, day, last, year)
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", V.date_interval(short).alias("i"), V.same_interval(short, words).alias("same_as_words"))
    return rows.select("o_orderkey", "i.*", "same_as_words")


@query(
    r"""WITH s AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentence FROM documents)
    SELECT doc_id, count(*)::BIGINT AS n_sentences FROM s GROUP BY doc_id"""
)
def sentence_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences("text")).cast("long").alias("n_sentences")).where("n_sentences > 0")


@query(
    r"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains(['a','an','and','are','as','at','by','did','during','for','from','had','how','in','into','of','on','or','the','to','was','were','what','when','which','who','with'], x))))::BIGINT AS n_tokens FROM documents"""
)
def content_token_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(T.content_tokens("text")).cast("long").alias("n_tokens"))


@query("SELECT n_regionkey AS search, n_nationkey AS nation, CASE WHEN n_regionkey = r_regionkey THEN 1 END AS depth FROM nation CROSS JOIN (SELECT r_regionkey FROM region) WHERE n_regionkey = r_regionkey")
def nation_depths(spark, sf_dir):
    graph = P.edges(_facts(spark, sf_dir))
    starts = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("search"), F.col("n_nationkey").alias("nation"), F.lit("all").alias("execution_id"), T.normalize("n_name").alias("node"))
    regions = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("search"), T.normalize("r_name").alias("node"))
    far = P.distances(starts, graph, search=("search", "nation"))
    return far.join(regions, ["search", "node"]).select("search", "nation", "depth")


_WALK = f"""WITH RECURSIVE facts AS ({G.FACTS_SQL}), hops AS (SELECT DISTINCT {G.norm("subject")} AS u, {G.norm("object")} AS v FROM facts),
walk AS (SELECT c_custkey AS search, {G.norm("c_name")} AS node, 0 AS depth FROM customer UNION ALL SELECT search, v, depth + 1 FROM walk JOIN hops ON u = node WHERE depth < 9)
"""


@query(_WALK + "SELECT search, node, min(depth)::INT AS depth FROM walk GROUP BY search, node")
def shortest_distance(spark, sf_dir):
    starts = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("search"), F.lit("all").alias("execution_id"), T.normalize("c_name").alias("node"))
    return P.distances(starts, P.edges(_facts(spark, sf_dir)), search=("search",)).select("search", "node", "depth")


@query(
    f"""WITH o AS (SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT o_orderkey AS search, 3 AS path_length, true AS complete, NULL::VARCHAR AS failure_reason, 'Order#' || o_orderkey || '>' || c_name || '>' || n_name || '>' || r_name AS nodes FROM o WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT o_orderkey, 0, false, 'terminal_claim_not_a_trusted_fact', '' FROM o WHERE o_orderkey % 7 = 0"""
)
def evidence_path(spark, sf_dir):
    t = lambda n: _table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    relation = F.when(F.col("o_orderkey") % 7 == 0, "borders").otherwise("part_of")
    claims = rows.select(F.col("o_orderkey").alias("search"), F.lit("all").alias("execution_id"), F.concat(F.lit("Order#"), "o_orderkey").alias("root"), F.col("n_name").alias("subject"), relation.alias("relation"), F.col("r_name").alias("object"))
    out = P.evidence_paths(claims, _facts(spark, sf_dir))
    nodes = F.when(F.size("evidence_path") > 0, F.array_join(P.path_nodes(F.col("evidence_path")), ">")).otherwise("")
    return out.select("search", "path_length", "complete", "failure_reason", nodes.alias("nodes"))


@query(
    """SELECT o_custkey AS search, count(DISTINCT o_orderkey)::BIGINT AS n_paths, 2 AS length FROM orders GROUP BY o_custkey"""
)
def ambiguous_paths(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    graph = orders.select(F.lit("all").alias("execution_id"), F.concat(F.lit("cust "), "o_custkey").alias("subject"), F.lit("placed").alias("relation"), F.concat(F.lit("order "), "o_orderkey").alias("object"), F.col("o_orderkey").alias("ord"))
    graph = graph.unionAll(orders.select(F.lit("all"), F.concat(F.lit("order "), "o_orderkey"), F.lit("reached"), F.concat(F.lit("dock "), "o_custkey"), F.col("o_orderkey")))
    pairs = orders.select(F.col("o_custkey").alias("search")).distinct().select("search", F.lit("all").alias("execution_id"), F.concat(F.lit("cust "), "search").alias("start"), F.concat(F.lit("dock "), "search").alias("goal"))
    return P.shortest_paths(pairs, P.edges(graph)).select("search", "n_paths", "length")


@query(
    f"""WITH facts AS ({G.FACTS_SQL}), e AS (SELECT {G.norm("subject")} AS u, relation, {G.norm("object")} AS v FROM facts),
    n AS (SELECT DISTINCT u AS node, v AS hub FROM e WHERE relation = 'part_of'), c AS (SELECT DISTINCT e.u AS node, n.hub FROM e JOIN n ON e.v = n.node WHERE relation = 'located_in'),
    o AS (SELECT DISTINCT e.u AS node, c.hub FROM e JOIN c ON e.v = c.node WHERE relation = 'placed_by'), p AS (SELECT DISTINCT u AS node, v AS hub FROM e WHERE relation = 'made_by'),
    members AS (SELECT * FROM n UNION SELECT hub, hub FROM n UNION SELECT * FROM c UNION SELECT * FROM o UNION SELECT * FROM p UNION SELECT hub, hub FROM p),
    least AS (SELECT hub, min(node) AS component FROM members GROUP BY hub)
    SELECT node, component FROM members JOIN least USING (hub)"""
)
def connected_components(spark, sf_dir):
    return P.components(_facts(spark, sf_dir)).select("node", "component")


@query(
    f"""WITH facts AS ({G.FACTS_SQL}), e AS (SELECT {G.norm("subject")} AS u, {G.norm_relation("relation")} AS r, {G.norm("object")} AS v FROM facts), n AS (SELECT u AS node FROM e UNION SELECT v FROM e)
    SELECT (SELECT count(*) FROM n)::BIGINT AS nodes, count(*)::BIGINT AS edges, count(DISTINCT r)::BIGINT AS relations, (count(*) - count(DISTINCT (u, r, v)))::BIGINT AS duplicates,
      (SELECT count(*) FROM n WHERE node NOT IN (SELECT v FROM e))::BIGINT AS sources, (SELECT count(*) FROM n WHERE node NOT IN (SELECT u FROM e))::BIGINT AS sinks,
      (SELECT count(*) FROM n WHERE node NOT IN (SELECT u FROM e WHERE u <> v UNION SELECT v FROM e WHERE u <> v))::BIGINT AS isolated, (SELECT max(k) FROM (SELECT count(DISTINCT v) AS k FROM e GROUP BY u))::BIGINT AS fan_out,
      count(DISTINCT v) FILTER (r IN ('part_of', 'made_by'))::BIGINT AS components FROM e"""
)
def graph_metrics(spark, sf_dir):
    return P.graph_metrics(_facts(spark, sf_dir)).drop("execution_id")


@query(
    """WITH n AS (SELECT n_regionkey AS k, n_nationkey FROM nation), c AS (SELECT k, c_custkey AS key FROM customer JOIN n ON c_nationkey = n_nationkey), s AS (SELECT k FROM supplier JOIN n ON s_nationkey = n_nationkey),
    o AS (SELECT k FROM orders JOIN c ON o_custkey = key), x AS (SELECT k, 1 AS d FROM n UNION ALL SELECT k, 2 FROM c UNION ALL SELECT k, 2 FROM s UNION ALL SELECT k, 3 FROM o)
    SELECT r_name AS root, count(*) FILTER (d = 1)::BIGINT AS fan_out, count(*)::BIGINT AS reached, max(d)::INT AS hops, avg(d)::DOUBLE AS mean_hops, 0::BIGINT AS branches FROM x JOIN region ON k = r_regionkey GROUP BY r_name"""
)
def root_metrics(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    back = facts.select("execution_id", "ord", F.col("object").alias("subject"), "relation", F.col("subject").alias("object"))
    return P.root_metrics(back, _table(spark, sf_dir, "region").select(F.lit("all").alias("execution_id"), F.col("r_name").alias("root"))).drop("execution_id")


# ordered sequences: events as iterations, their types as answers


def _iterations(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("sub_question_id"), "event_id", "ts", F.col("event_type").alias("answer"), F.concat(F.col("event_type"), F.lit("|"), F.round(F.col("value") / 50).cast("int").cast("string")).alias("signature"), "value")


def _numbered(df):
    return df.withColumn("iteration", F.row_number().over(Window.partitionBy("sub_question_id").orderBy("ts", "event_id")) - 1)


_EVENTS = "SELECT user_id AS sub_question_id, event_id, ts, event_type AS answer, event_type || '|' || round(value / 50)::INT AS signature, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iteration FROM events"


@query(f"WITH e AS ({_EVENTS}) SELECT event_id, coalesce(answer = lag(answer) OVER w OR signature = lag(signature) OVER w, false) AS stalled FROM e WINDOW w AS (PARTITION BY sub_question_id ORDER BY iteration)")
def stall_detection(spark, sf_dir):
    from claimloom.operators import iteration

    return iteration.with_previous(_numbered(_iterations(spark, sf_dir)), ["sub_question_id"]).select("event_id", "stalled")


@query(
    f"""WITH e AS ({_EVENTS}), g AS (SELECT *, sum(CASE WHEN answer = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY sub_question_id ORDER BY iteration) AS part FROM e)
    SELECT event_id, (sum(CASE WHEN answer = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY sub_question_id, part ORDER BY iteration))::BIGINT AS streak FROM g"""
)
def timeout_streaks(spark, sf_dir):
    from claimloom.operators import iteration

    return iteration.streaks(_numbered(_iterations(spark, sf_dir)), ["sub_question_id"], "iteration", F.col("answer") == "error").select("event_id", "streak")


@query(f"WITH e AS ({_EVENTS}) SELECT sub_question_id, arg_min(answer, iteration) AS first_answer, arg_max(answer, iteration) AS last_answer, (count(*) - 1)::BIGINT AS revision_count FROM e GROUP BY sub_question_id")
def first_last_iteration(spark, sf_dir):
    from claimloom.operators import iteration

    return iteration.first_and_last(_numbered(_iterations(spark, sf_dir)), ["sub_question_id"], ["answer"])


@query(f"WITH e AS ({_EVENTS}) SELECT event_id, coalesce(sum(length(answer)) OVER (PARTITION BY sub_question_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS size_before FROM e")
def running_kgc_size(spark, sf_dir):
    from claimloom.operators import iteration

    rows = _numbered(_iterations(spark, sf_dir)).withColumn("added", F.length("answer"))
    return iteration.running_total(rows, ["sub_question_id"], "iteration", "added").select("event_id", F.col("size_before").cast("long").alias("size_before"))


def _results(spark, sf_dir):
    from claimloom.operators import reports

    e = _table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("ord"),
        (1 + F.col("user_id") % 10).cast("int").alias("hop_count"),
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "model timeout").otherwise("broken")).alias("error"),
        (F.col("event_type") == "purchase").alias("exact_match"),
        F.col("event_type").isin("purchase", "click").alias("contains_expected"),
        ((F.col("event_type") != "error") & (F.col("event_id") % 2 == 0)).alias("resolved"),
        (F.col("event_id") % 4).alias("iterations"),
        F.col("value").alias("runtime_seconds"),
        F.when(F.col("event_id") % 5 == 0, "UNRESOLVED_NO_EVIDENCE").otherwise("MAX_ITERATIONS").alias("stop"),
    )
    return rows.withColumn("failure_category", reports.failure_category(F.col("error"), F.col("resolved"), F.col("contains_expected"), F.col("stop")))


_RESULTS = """WITH r AS (SELECT event_id AS ord, (1 + user_id % 10)::INT AS hop_count, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'model timeout' ELSE 'broken' END END AS error,
  event_type = 'purchase' AS exact_match, event_type IN ('purchase', 'click') AS contains_expected, event_type <> 'error' AND event_id % 2 = 0 AS resolved, event_id % 4 AS iterations, value AS runtime_seconds,
  CASE WHEN event_id % 5 = 0 THEN 'UNRESOLVED_NO_EVIDENCE' ELSE 'MAX_ITERATIONS' END AS stop FROM events),
results AS (SELECT *, CASE WHEN error LIKE '%timeout%' THEN 'model_timeout' WHEN error IS NOT NULL THEN 'pipeline_error' WHEN resolved THEN NULL WHEN contains_expected THEN 'answer_matched_textually_but_pipeline_unresolved'
  WHEN stop = 'UNRESOLVED_NO_EVIDENCE' THEN 'unresolved_no_evidence' ELSE 'contradiction_or_uncertainty_remained' END AS failure_category FROM r)
"""
_FIGURES = """count(*)::BIGINT AS questions, count(*) FILTER (error IS NULL)::BIGINT AS completed, count(*) FILTER (exact_match)::BIGINT AS exact_match, count(*) FILTER (contains_expected)::BIGINT AS contains_expected,
  count(*) FILTER (resolved)::BIGINT AS pipeline_resolved, count(*) FILTER (resolved AND contains_expected)::BIGINT AS resolved_and_matched, count(*) FILTER (NOT resolved AND contains_expected AND error IS NULL)::BIGINT AS unresolved_but_contained,
  round(avg(iterations), 6) AS average_iterations, round(avg(runtime_seconds), 6) AS average_runtime_seconds"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("average_iterations", "average_runtime_seconds")})


@query(_RESULTS + f"SELECT hop_count, {_FIGURES} FROM results GROUP BY hop_count")
def bench_summary_by_hop(spark, sf_dir):
    from claimloom.operators import reports

    return _rounded(reports.summary_by_hop(_results(spark, sf_dir)))


@query(_RESULTS + f"SELECT coalesce(hop_count, -1) AS hop_count, {_FIGURES} FROM results GROUP BY ROLLUP (hop_count)")
def bench_summary_rollup(spark, sf_dir):
    from claimloom.operators import reports

    return _rounded(reports.summary_rollup(_results(spark, sf_dir))).withColumn("hop_count", F.coalesce("hop_count", F.lit(-1)))


@query(_RESULTS + "SELECT hop_count, failure_category, n, (row_number() OVER (PARTITION BY hop_count ORDER BY n DESC, first))::INT AS place FROM (SELECT hop_count, failure_category, count(*)::BIGINT AS n, min(ord) AS first FROM results WHERE failure_category IS NOT NULL GROUP BY hop_count, failure_category)")
def failure_histogram(spark, sf_dir):
    from claimloom.operators import reports

    return reports.failure_histogram(_results(spark, sf_dir), ["hop_count"])


@query(
    _LADDER
    + f"""SELECT a.c_custkey, string_agg(l.label || '|' || l.s || '|' || l.r || '|' || l.o, ';' ORDER BY l.label || '|' || l.s || '|' || l.r || '|' || l.o) AS signature
    FROM labelled l JOIN orders ON o_orderkey = l.ord JOIN customer a ON a.c_custkey = o_custkey GROUP BY a.c_custkey"""
)
def evaluation_signature(spark, sf_dir):
    from claimloom.operators import iteration

    owner = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("c_custkey"))
    return C.compare(_claims(spark, sf_dir), _facts(spark, sf_dir)).join(owner, "ord").groupBy("c_custkey").agg(iteration.signature().alias("signature"))


@query(
    _LADDER
    + """SELECT o_custkey AS c_custkey, count(*) FILTER (label = 'SUPPORTED' AND r IN ('placed_by', 'built_by')) = 0 AND count(*) FILTER (label = 'SUPPORTED') > 0 AS irrelevant_only, count(*) FILTER (label = 'SUPPORTED')::BIGINT AS irrelevant, false AS satisfied
    FROM labelled JOIN orders ON o_orderkey = ord GROUP BY o_custkey"""
)
def target_satisfaction(spark, sf_dir):
    from claimloom.operators import iteration

    owner = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("c_custkey"))
    judged = C.compare(_claims(spark, sf_dir), _facts(spark, sf_dir)).join(owner, "ord").withColumn("intent", F.lit("leader"))
    out = iteration.satisfaction(judged, ["c_custkey"])
    own = judged.groupBy("c_custkey").agg(((F.count_if((F.col("label") == "SUPPORTED") & T.normalize_relation("relation").isin("placed_by", "built_by")) == 0) & (F.count_if(F.col("label") == "SUPPORTED") > 0)).alias("irrelevant_only"))
    return out.join(own, "c_custkey").select("c_custkey", "irrelevant_only", "irrelevant", "satisfied")


@query(
    f"""WITH facts AS ({G.FACTS_SQL}), new AS (SELECT ord, regexp_replace('The ' || lower(subject), '^The ', CASE WHEN ord % 2 = 0 THEN 'the ' ELSE '' END) AS subject, relation, CASE WHEN ord % 3 = 0 THEN object || ' annex' ELSE upper(object) END AS object FROM facts),
    k AS (SELECT trim(regexp_replace({G.norm("subject")}, '^the ', '')) AS ks, {G.norm_relation("relation")} AS kr, {G.norm("object")} AS ko FROM facts),
    n AS (SELECT *, trim(regexp_replace({G.norm("subject")}, '^the ', '')) AS ks, {G.norm_relation("relation")} AS kr, {G.norm("object")} AS ko FROM new),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY ks, kr, ko ORDER BY ord) AS rn FROM n ANTI JOIN k USING (ks, kr, ko))
    SELECT ord, subject, relation, object FROM fresh WHERE rn = 1"""
)
def working_merge(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    new = facts.withColumn("subject", F.concat(F.when(F.col("ord") % 2 == 0, "the ").otherwise(""), F.lower("subject")))
    new = new.withColumn("object", F.when(F.col("ord") % 3 == 0, F.concat("object", F.lit(" annex"))).otherwise(F.upper("object")))
    return M.merge(facts, new)[1].select("ord", "subject", "relation", "object")


@query(
    """WITH p AS (SELECT p_partkey AS ord, 'Part#' || p_partkey % 97 AS subject, p_brand AS relation, p_size AS object, p_name AS evidence FROM part)
    SELECT subject, relation, arg_max(object, ord) AS object, arg_max(evidence, ord) AS evidence, max(ord) AS ord FROM p GROUP BY subject, relation"""
)
def fact_upsert(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("Part#"), F.col("p_partkey") % 97).alias("subject"), F.col("p_brand").alias("relation"), F.col("p_size").alias("object"), F.col("p_name").alias("evidence"))
    half = rows.agg(F.max("ord")).first()[0] // 2
    return M.upsert(rows.where(F.col("ord") <= half), rows.where(F.col("ord") > half), ["subject", "relation"])


@query(
    f"""WITH facts AS ({G.FACTS_SQL}), t AS (SELECT r_regionkey AS sub_question_id, r_name FROM region),
    x AS (SELECT sub_question_id, ord, subject, relation, CASE WHEN {G.norm("subject")} = {G.norm("r_name")} THEN 2 ELSE 0 END AS score FROM facts, t WHERE relation IN ('located_in', 'part_of'))
    SELECT sub_question_id, arg_min(ord, (-score, ord)) AS ord FROM x GROUP BY sub_question_id"""
)
def focused_top1(spark, sf_dir):
    regions = _table(spark, sf_dir, "region").select(F.lit("all").alias("execution_id"), F.col("r_regionkey").alias("sub_question_id"), F.lit("where?").alias("question"), F.lit("location_containment").alias("intent"), F.col("r_name").alias("primary_subject"), F.lit(None).cast("string").alias("canonical_relation"))
    return M.focused(_facts(spark, sf_dir), regions).select("sub_question_id", "ord")


@query(
    f"""WITH facts AS ({G.FACTS_SQL}), c AS (SELECT subject, count(*) AS n, min(ord) AS first FROM facts GROUP BY subject) SELECT subject, n::BIGINT AS n FROM c ORDER BY n DESC, first LIMIT 1"""
)
def subject_mode(spark, sf_dir):
    counts = _facts(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("at"))
    return counts.agg(F.max_by("subject", F.struct("n", -F.col("at"))).alias("subject"), F.max("n").alias("n"))


@query(_LADDER + "SELECT year AS execution_id, label, count(*)::BIGINT AS n, count(DISTINCT s)::BIGINT AS subjects FROM labelled GROUP BY year, label")
def execution_summary(spark, sf_dir):
    out = C.compare(_claims(spark, sf_dir), _facts(spark, sf_dir))
    return out.groupBy(F.col("year").alias("execution_id"), "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(T.normalize("subject")).alias("subjects"))


@query(_LADDER + "SELECT year, ord, label FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY ord) AS rn FROM labelled WHERE label IN ('CONTRADICTED', 'NO_EVIDENCE', 'NOT_ENOUGH_INFO')) WHERE rn <= 200")
def bad_claims_topn(spark, sf_dir):
    out = C.compare(_claims(spark, sf_dir), _facts(spark, sf_dir)).where(F.col("label").isin("CONTRADICTED", "NO_EVIDENCE", "NOT_ENOUGH_INFO"))
    rn = F.row_number().over(Window.partitionBy("year").orderBy("ord"))
    return out.select("year", "ord", "label", rn.alias("rn")).where("rn <= 200").drop("rn")


@query(
    """WITH prior AS (SELECT o_orderkey % 5000 AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_custkey, o_orderkey) AS cust FROM orders GROUP BY 1)
    SELECT c_custkey AS id, status IS NOT NULL AND status <> 'F' AS skip, CASE WHEN status IS NULL THEN 1 ELSE greatest(cust % 4, 1) + 1 END::BIGINT AS attempt FROM customer LEFT JOIN prior ON id = c_custkey"""
)
def resume_partition(spark, sf_dir):
    from claimloom.operators import reports

    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    prior = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).alias("id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", "failed").alias("error"), (F.col("o_custkey") % 4).alias("attempt_number"))
    return reports.resume(asked, prior, retry_errors=True).select("id", "skip", F.col("attempt").cast("long").alias("attempt"))


@query(
    r"""WITH s AS (SELECT item_id, unnest(list_filter(string_split_regex(regexp_replace(replace(b.text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentence FROM benchmark b)
    SELECT item_id, max(length(trim(sentence)))::BIGINT AS longest, count(*)::BIGINT AS n FROM s GROUP BY item_id"""
)
def benchmark_sentences(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.flat_sentences("text")).alias("s"))
    return rows.groupBy("item_id").agg(F.max(F.length("s")).cast("long").alias("longest"), F.count(F.lit(1)).alias("n"))


@query()
def locality_audit(spark, sf_dir):
    """Each benchmark item's longest word as an answer, looked for in the item itself."""
    from claimloom.operators import reports

    items = _table(spark, sf_dir, "benchmark").withColumn("answer", F.get(F.array_sort(F.split("text", r"\s+"), lambda a, b: F.length(b) - F.length(a)), F.lit(0)))
    return reports.locality(items.select("item_id", F.col("text").alias("question"), "answer"), items.select("item_id", F.col("text").alias("context")), ["item_id"])


@query(
    """SELECT count(*) FILTER (json_type(props) = 'OBJECT')::BIGINT AS objects, count(*)::BIGINT AS n FROM events"""
)
def anomaly_histogram(spark, sf_dir):
    from claimloom.sources import decode

    rows = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("item"))
    reasons = decode.coerce_triples(rows).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return reasons.agg(F.coalesce(F.sum(F.when(F.col("reason") == "dictionary_missing_triple_keys", F.col("n"))), F.lit(0)).alias("objects"), F.sum("n").alias("n"))


@query(
    """SELECT event_id, user_id::VARCHAR AS subject, 'did' AS relation, CASE WHEN event_id % 3 = 0 OR event_id % 7 <> 0 THEN event_type END AS object, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN 'missing_third_element' END AS reason,
    CASE WHEN event_id % 3 = 0 THEN 'positional_array' ELSE 'alias_subj_to_subject,alias_predicate_to_relation' END AS normalizations FROM events"""
)
def coerce_triples(spark, sf_dir):
    from claimloom.sources import decode

    e = _table(spark, sf_dir, "events")
    obj = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    shapes = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(F.col("user_id").cast("string"), F.lit("did"), "event_type"))).otherwise(F.to_json(F.struct(F.col("user_id").alias("subj"), F.lit("did").alias("predicate"), obj.alias("object"))))
    rows = e.select("event_id", F.parse_json(shapes).alias("item"))
    return decode.coerce_triples(rows).select("event_id", "subject", "relation", "object", "reason", F.array_join("normalizations", ",").alias("normalizations"))


@query(
    """SELECT n_nationkey, a || n_name || b AS question, intent FROM nation, (VALUES ('Which region contains the nation of ', '?', 'location_containment'), ('Who led ', '?', 'leader'), ('What is the capital of ', '?', 'capital_city'),
    ('When was ', ' founded?', 'occurrence_date'), ('In which town was the leader of ', ' born?', 'birthplace'), ('Why is ', ' blue?', 'general')) AS f(a, b, intent)"""
)
def question_intent(spark, sf_dir):
    """Questions made of the nations' names."""
    from claimloom.operators import questions

    nation = _table(spark, sf_dir, "nation")
    forms = F.array(*[F.concat(F.lit(a), "n_name", F.lit(b)) for a, b in (("Which region contains the nation of ", "?"), ("Who led ", "?"), ("What is the capital of ", "?"), ("When was ", " founded?"), ("In which town was the leader of ", " born?"), ("Why is ", " blue?"))])
    return questions.with_intent(nation.select("n_nationkey", F.explode(forms).alias("question")))


@query()
def value_equivalence(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    return part.select("p_partkey", V.same_dose(F.concat(size, F.lit(" mg daily")), F.concat(F.lit("dose of "), size, F.lit("MG"))).alias("dose"), V.same_lab_value(F.concat(size, F.lit("%")), F.concat(F.lit("A1C "), size)).alias("lab"), V.same_names("p_name", F.replace("p_name", F.lit(" "), F.lit(" and "))).alias("names"), V.same_president(F.concat(F.lit("President "), "p_brand"), "p_brand").alias("president"))


@query(
    """WITH c AS (SELECT c_custkey::VARCHAR AS execution_id, 'Patient Case ' || c_custkey AS subject, c_mktsegment AS seg, c_custkey % 9 + 4 AS lab FROM customer)
    SELECT execution_id, 0 AS sub_question_id, 0::BIGINT AS ord, subject, 'diagnosed_with' AS relation, 'condition ' || seg || ' disease' AS object, subject || ' has condition ' || seg || ' disease' AS evidence FROM c
    UNION ALL SELECT execution_id, 1, 0, subject, 'has_a1c', lab || '%', 'A1C is ' || lab || '%' FROM c
    UNION ALL SELECT execution_id, 2, 0, subject, 'active_medication', 'Drug' || execution_id, 'Drug' || execution_id || ' 10 mg daily remains active' FROM c
    UNION ALL SELECT execution_id, 2, 1, subject, 'daily_dose', '10 mg daily', 'Drug' || execution_id || ' 10 mg daily remains active' FROM c"""
)
def derive_facts(spark, sf_dir):
    """One chart for each customer, read for three intents."""
    from claimloom.operators import derive

    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("execution_id"), F.format_string("Patient Case %d has condition %s disease. A1C is %d%%. CKD stage 3. Drug%d 10 mg daily remains active.", "c_custkey", "c_mktsegment", (F.col("c_custkey") % 9 + 4).cast("int"), "c_custkey").alias("context"))
    intents = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for k, i in enumerate(("diagnosis", "lab_measurement", "active_medication_with_dose"))])).alias("x")
    targets = c.select("execution_id", intents).select("execution_id", F.col("x.k").alias("sub_question_id"), F.lit("?").alias("question"), F.col("x.i").alias("intent"), F.lit(None).cast("string").alias("primary_subject"), F.lit(None).cast("string").alias("canonical_relation"))
    return derive.bootstrap(targets, c)


_LADDER_INPUT = """WITH f AS (SELECT range AS id, range % 3 AS iteration, (range // 3) % 2 AS a, (range // 6) % 3 AS p, (range // 18) % 3 AS g, (range // 54) % 3 AS supported, (range // 162) % 2 AS contradicted, (range // 324) % 2 AS no_evidence, (range // 648) % 2 AS irrelevant, (range // 1296) % 3 AS path FROM (SELECT event_id AS range FROM events)),
i AS (SELECT *, a = 1 AS quiet, p > 0 AS again, p = 2 AS quiet_before, iteration = 2 AS last, supported + contradicted + no_evidence AS claims, irrelevant = 0 AS satisfied, (p = 1 AND a = 0) OR (p = 2 AND a = 1) OR (p > 0 AND g = 0) AS same FROM f),
c AS (SELECT *, claims > 0 AND contradicted = 0 AND no_evidence = 0 AS clean FROM i)
"""


@query(
    _LADDER_INPUT
    + """SELECT id, CASE WHEN claims = 0 AND quiet THEN CASE WHEN quiet_before OR iteration > 0 THEN 'UNRESOLVED_NO_EVIDENCE' WHEN NOT again THEN 'GENERATION_FAILED' END WHEN claims = 0 THEN CASE WHEN iteration > 0 THEN 'NO_CLAIMS_EXTRACTED' END
    WHEN clean AND satisfied AND path = 2 THEN CASE WHEN last THEN 'UNRESOLVED_TARGET_NOT_SATISFIED' END WHEN clean AND satisfied THEN 'RESOLVED' WHEN clean THEN CASE WHEN last THEN 'UNRESOLVED_TARGET_NOT_SATISFIED' END
    WHEN same THEN 'STALLED' WHEN last AND contradicted = 0 AND no_evidence > 0 THEN 'UNRESOLVED_NO_EVIDENCE' WHEN last AND irrelevant > 0 THEN 'UNRESOLVED_TARGET_NOT_SATISFIED' WHEN last THEN 'MAX_ITERATIONS' END AS stop_reason,
    CASE WHEN claims = 0 AND quiet AND quiet_before THEN 'repeated_abstention' WHEN claims = 0 AND quiet AND iteration > 0 THEN 'abstention_after_revision' WHEN claims = 0 AND quiet AND NOT again THEN 'initial_abstention' WHEN clean AND satisfied AND path = 2 THEN 'incomplete_evidence_path' END AS sub_reason FROM c"""
)
def stop_ladder(spark, sf_dir):
    """The ladder's inputs from the events' numbers, which go through all their combinations."""
    from claimloom.operators import iteration

    flags = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    at, rest = [], F.col("id")
    for n in (3, 2, 3, 3, 3, 2, 2, 2, 3):
        at.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    answers = F.array(F.lit("Ohio"), F.lit("cannot determine"))
    rows = flags.select(
        "id",
        at[0].alias("iteration"),
        F.lit(3).alias("max_iterations"),
        F.get(answers, at[1]).alias("answer"),
        F.get(F.array(F.lit(None).cast("string"), F.lit("Ohio"), F.lit("cannot determine")), at[2]).alias("previous_answer"),
        F.lit("s").alias("signature"),
        F.when(at[2] > 0, F.get(F.array(F.lit("s"), F.lit("t"), F.lit(None).cast("string")), at[3])).alias("previous_signature"),
        at[4].alias("supported"),
        at[5].alias("contradicted"),
        at[6].alias("no_evidence"),
        (at[4] + at[5] + at[6]).alias("claims"),
        (at[7] == 0).alias("satisfied"),
        at[7].alias("irrelevant"),
        F.lit(False).alias("enriched"),
        F.lit(False).alias("derived"),
        F.get(F.array(F.lit(None).cast("boolean"), F.lit(True), F.lit(False)), at[8]).alias("path_complete"),
    )
    return iteration.stop_decision(rows).select("id", "stop_reason", "sub_reason")


@query(
    """WITH c AS (SELECT c_custkey AS k, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    sets AS (SELECT r_name, count(k) AS n FROM (SELECT DISTINCT r_name FROM region JOIN nation ON n_regionkey = r_regionkey) LEFT JOIN c USING (r_name) GROUP BY r_name),
    broken AS (SELECT unnest([CASE WHEN k % 3 = 0 THEN 'edge_absent' END, CASE WHEN k % 3 = 0 THEN 'required_relations' END, CASE WHEN k % 5 = 0 THEN 'required_entities' END, CASE WHEN k % 7 = 0 THEN 'path_length' END,
        CASE WHEN k % 7 = 0 THEN 'anchor_distance' END, CASE WHEN k % 11 = 0 THEN 'discourse_markers' END, CASE WHEN k % 13 = 0 THEN 'final_subject_mentioned' END, CASE WHEN k % 13 = 0 THEN 'shortcut_mentioned' END,
        CASE WHEN k % 17 = 0 THEN 'graph_root' END, CASE WHEN k % 19 = 0 AND row_number() OVER (PARTITION BY r_name, k % 19 ORDER BY k) > 1 THEN 'duplicate_id' END, 'detection_missing', 'audit_missing']) AS rule FROM c
    UNION ALL SELECT unnest([CASE WHEN n <> 50 THEN 'question_count' END, 'hop_distribution', 'few_long_branches', 'node_count_declared']) FROM sets)
    SELECT rule, count(*)::BIGINT AS n FROM broken WHERE rule IS NOT NULL GROUP BY rule"""
)
def validation_rules(spark, sf_dir):
    """A set for each region, a question for each customer (of which part of the world?); faults by the customer's key."""
    from claimloom.operators import rules

    customer, nation, region = (_table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("set_id"), F.col("c_custkey").cast("long").alias("ord"), "c_name", "n_name", "r_name")
    lies = places.select(F.col("r_name").alias("set_id"), (-F.col("n_nationkey") - 1).cast("long").alias("ord"), F.col("n_name").alias("subject"), F.lit("part_of").alias("relation"), F.col("r_name").alias("object"))
    facts = c.select("set_id", "ord", F.col("c_name").alias("subject"), F.lit("located_in").alias("relation"), F.col("n_name").alias("object")).unionAll(lies)

    def fault(every, then, otherwise):
        return F.when(F.col("ord") % every == 0, then).otherwise(otherwise)

    def edge(a, relation, b):
        return F.struct(F.col(a).alias("subject"), relation.alias("relation"), F.col(b).alias("object"))

    questions = c.select(
        "set_id",
        "ord",
        fault(19, F.lit("q0"), F.concat(F.lit("q"), "ord")).alias("id"),
        fault(7, F.lit(3), F.lit(2)).alias("hop_count"),
        F.concat(F.lit("Which part of the world does "), "c_name", F.lit(" come from"), fault(13, F.concat(F.lit(" by way of "), "n_name"), F.lit("")), fault(11, F.lit(" in those days?"), F.lit("?"))).alias("question"),
        F.col("r_name").alias("expected_answer"),
        F.array(edge("c_name", F.lit("located_in"), "n_name"), edge("n_name", fault(3, F.lit("inside"), F.lit("part_of")), "r_name")).alias("expected_path"),
        fault(5, F.array("c_name"), F.array("r_name", "c_name", "n_name")).alias("required_entities"),
        F.array(F.lit("part_of"), F.lit("located_in")).alias("required_relations"),
        F.array("c_name").alias("question_anchor_entities"),
        F.array("c_name").alias("reasoning_anchor_entities"),
        fault(17, F.lit("nowhere"), F.col("r_name")).alias("graph_root_entity"),
        F.lit(rules.LABEL).alias("hop_semantics"),
    )
    size = facts.groupBy("set_id").agg(F.count(F.lit(1)).alias("edge_count_designed"))
    sets = size.select("set_id", F.col("set_id").alias("root_entity"), F.lit("Places and who lives there.").alias("trusted_context"), F.lit(True).alias("enforce_hops"), "edge_count_designed", F.col("edge_count_designed").alias("node_count"))
    return rules.validate(sets, questions, facts).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey::INT AS sub_question_id, CASE n_nationkey % 3 WHEN 2 THEN 'STALLED' ELSE 'RESOLVED' END AS stop_reason, CASE n_nationkey % 3 WHEN 0 THEN 0 ELSE 1 END AS iteration FROM nation")
def iterate_batch(spark, sf_dir):
    """Every nation's region, asked with a model that is right, right after a correction, or never."""
    from claimloom.plans import iterate

    facts = _facts(spark, sf_dir).where("relation = 'part_of'").select("execution_id", "ord", "subject", "relation", "object", "evidence")
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("all").alias("execution_id"), F.col("n_nationkey").cast("int").alias("sub_question_id"), "n_name", "r_name")
    asked = n.select("execution_id", "sub_question_id", F.concat(F.lit("Which region contains the nation of "), "n_name", F.lit("?")).alias("question"))
    answers = n.select("execution_id", "sub_question_id", F.when(F.col("sub_question_id") % 3 == 0, F.col("r_name")).otherwise("Atlantis").alias("answer"))
    contexts = n.select("execution_id").distinct().withColumn("context", F.lit("Nations are parts of regions."))

    def extract(rows):
        own = ["execution_id", "sub_question_id"]
        return rows.join(n.select(*own, "n_name"), own).select(*own, "iteration", F.lit(0).cast("long").alias("ord"), F.col("n_name").alias("subject"), F.lit("part_of").alias("relation"), F.col("answer").alias("object"), F.col("answer").alias("source_sentence"))

    def revise(rows):
        own = ["execution_id", "sub_question_id"]
        return rows.join(n.select(*own, "r_name"), own).select(*own, F.when(F.col("sub_question_id") % 3 == 1, F.col("r_name")).otherwise(F.col("answer")).alias("answer"))

    results, _ = iterate.run(asked, contexts, facts, answers, extract, revise, with_paths=False)
    return results.select("sub_question_id", "stop_reason", "iteration")


@query(
    f"""WITH e AS ({_EVENTS}) SELECT sub_question_id, arg_min(event_id % 5, iteration)::BIGINT AS supported_before, arg_min(event_id % 3, iteration)::BIGINT AS contradicted_before, arg_min(event_id % 2, iteration)::BIGINT AS no_evidence_before,
    CASE WHEN count(*) > 1 THEN arg_max(event_id % 5, iteration) END::BIGINT AS supported_after, CASE WHEN count(*) > 1 THEN arg_max(event_id % 3, iteration) END::BIGINT AS contradicted_after, CASE WHEN count(*) > 1 THEN arg_max(event_id % 2, iteration) END::BIGINT AS no_evidence_after
    FROM e GROUP BY sub_question_id"""
)
def before_after_metrics(spark, sf_dir):
    from claimloom.operators import iteration

    rows = _numbered(_iterations(spark, sf_dir))
    counts = {n: (F.col("event_id") % k).cast("long") for n, k in (("supported", 5), ("contradicted", 3), ("no_evidence", 2))}
    return iteration.before_after(rows.withColumns(counts), ["sub_question_id"])


@query(
    """WITH x AS (SELECT user_id % 7 AS execution_id, event_type, count(*) AS n, sum(event_id % 5) AS s FROM events GROUP BY ALL), t AS (SELECT execution_id, sum(n)::BIGINT AS questions, sum(s)::BIGINT AS supported FROM x GROUP BY execution_id)
    SELECT execution_id::BIGINT AS execution_id, questions, supported, event_type AS stop_reason, n::BIGINT AS n FROM x JOIN t USING (execution_id)"""
)
def stop_reason_rollup(spark, sf_dir):
    from claimloom.operators import iteration

    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("long").alias("execution_id"), F.col("event_type").alias("stop_reason"), (F.col("event_id") % 5).cast("long").alias("supported"))
    out = iteration.rollup(rows, ["execution_id"], ("supported",))
    return out.select("execution_id", "questions", "supported", F.explode("stop_reasons").alias("stop_reason", "n"))


def _asked_about_customers(spark, sf_dir):
    """An execution for each customer: where it is, as a fact; a claim about it, and the question's target. By the key: every third claim names another nation, every third is of another relation."""
    t = lambda n: _table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("execution_id"), (F.col("c_custkey") % 3).alias("k"), "c_name", "n_name", "c_mktsegment")
    facts = rows.select("execution_id", F.lit(0).cast("long").alias("ord"), F.col("c_name").alias("subject"), F.lit("located_in").alias("relation"), F.col("n_name").alias("object"), F.lit(None).cast("string").alias("evidence"))
    facts = facts.unionAll(rows.select("execution_id", F.lit(1).cast("long"), "c_name", F.lit("trades_in"), "c_mktsegment", F.lit(None).cast("string")))
    own = ["execution_id", F.lit(1).alias("sub_question_id")]
    relation = F.when(F.col("k") == 0, "situated_in").when(F.col("k") == 1, "located_in").otherwise("painted_by")
    claims = rows.select(*own, F.lit(0).alias("iteration"), F.lit(0).cast("long").alias("ord"), F.col("c_name").alias("subject"), relation.alias("relation"), F.when(F.col("k") == 1, "Atlantis").otherwise(F.col("n_name")).alias("object"), F.lit(None).cast("string").alias("source_sentence"))
    targets = rows.select(*own, F.concat(F.lit("Where is "), "c_name", F.lit("?")).alias("question"), F.lit("location_containment").alias("intent"), F.col("c_name").alias("primary_subject"), F.lit("located_in").alias("canonical_relation"))
    return claims, facts, targets


@query(
    """SELECT c_custkey::VARCHAR AS execution_id, CASE c_custkey % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'CONTRADICTED' ELSE 'NO_EVIDENCE' END AS label,
    CASE c_custkey % 3 WHEN 0 THEN 0 ELSE -1 END::BIGINT AS matched_ord, CASE c_custkey % 3 WHEN 1 THEN n_name END AS conflicting_object,
    CASE c_custkey % 3 WHEN 0 THEN 'Claim matches KGc fact after relation-family normalization.' WHEN 1 THEN 'Claim object ''Atlantis'' conflicts with KGc fact ''' || n_name || ''' for relation family ''location_containment''.' ELSE 'KGc has no matching fact for this claim in the question-scoped frame.' END AS reason
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def frame_compare(spark, sf_dir):
    """Claims compared within the frame of their question: relations of one family count as one."""
    out = C.compare_for_targets(*_asked_about_customers(spark, sf_dir))
    return out.select("execution_id", "label", F.coalesce("matched_fact.ord", F.lit(-1)).alias("matched_ord"), "conflicting_object", "reason")


@query("SELECT c_custkey::VARCHAR AS execution_id, c_name AS root FROM customer JOIN nation ON c_nationkey = n_nationkey")
def question_roots(spark, sf_dir):
    """The entity each question starts from: the one it mentions that is farthest from the claim's subject."""
    t = lambda n: _table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("execution_id", F.col("c_custkey").cast("string"))
    facts = rows.select("execution_id", F.posexplode(F.array(F.struct(F.col("c_name").alias("s"), F.lit("located_in").alias("r"), F.col("n_name").alias("o")), F.struct(F.col("n_name").alias("s"), F.lit("part_of").alias("r"), F.col("r_name").alias("o")))).alias("ord", "f")).select("execution_id", F.col("ord").cast("long").alias("ord"), F.col("f.s").alias("subject"), F.col("f.r").alias("relation"), F.col("f.o").alias("object"))
    asked = rows.select("execution_id", F.lit(1).alias("search"), F.concat(F.lit("what lies beyond "), F.lower("n_name"), F.lit(" for "), F.lower("c_name"), F.lit("?")).alias("question"), F.col("n_name").alias("subject"), F.col("r_name").alias("object"), F.lit(None).cast("string").alias("primary_subject"))
    return P.roots(asked, facts).select("execution_id", "root")


@query(
    """SELECT c_custkey::VARCHAR AS execution_id, (c_custkey % 2 + 1)::INT AS since, (2 - c_custkey % 2)::INT AS asked_at, CASE c_custkey % 2 WHEN 0 THEN 'SUPPORTED' ELSE 'NO_EVIDENCE' END AS label, count(o_orderkey)::BIGINT + 1 - c_custkey % 2 AS facts_seen
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def sequential_questions(spark, sf_dir):
    """An execution for each customer with its orders as facts, and two questions: for one a fact is derived from the context, and the other is answered with it. By the key one is asked first or the other, and that decides whether the claim finds the fact."""
    from claimloom.operators import asof
    from claimloom.plans import iterate
    from claimloom.sources.shared import beside, spread

    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("execution_id"), (F.col("c_custkey") % 2).cast("int").alias("k"), "c_custkey", "c_name")
    n = c.count()
    orders = _table(spark, sf_dir, "orders").join(beside(c, n), F.col("o_custkey") == F.col("c_custkey"))
    facts = orders.select("execution_id", F.col("o_orderkey").cast("long").alias("ord"), F.concat(F.lit("Order#"), "o_orderkey").alias("subject"), F.lit("placed_by").alias("relation"), F.col("c_name").alias("object"), F.lit(None).cast("string").alias("evidence"))
    patient, stage = F.concat(F.lit("Patient C"), "execution_id"), F.concat(F.lit("stage "), (1 + F.col("c_custkey") % 4).cast("string"))
    derives, leans = F.col("k") + 1, F.lit(2) - F.col("k")
    asked = c.select("execution_id", derives.alias("sub_question_id"), F.concat(F.lit("What stage of kidney disease does "), patient, F.lit(" have?")).alias("question"))
    asked = asked.unionByName(c.select("execution_id", leans.alias("sub_question_id"), F.concat(F.lit("Is it known what "), patient, F.lit(" has?")).alias("question")))
    contexts = c.select("execution_id", F.concat(patient, F.lit(" has CKD "), stage, F.lit(".")).alias("context"))
    _, grown = iterate.grow(asked, contexts, facts)
    claims = spread(c).select("execution_id", leans.alias("sub_question_id"), F.lit(0).alias("iteration"), F.lit(0).cast("long").alias("ord"), patient.alias("subject"), F.lit("has_ckd_stage").alias("relation"), stage.alias("object"), F.lit(None).cast("string").alias("source_sentence"))
    judged = C.compare(claims, grown).select("execution_id", F.col("sub_question_id").alias("asked_at"), "label")
    known = grown.groupBy("execution_id", "since").agg(F.count(F.lit(1)).alias("n"))  # counted before they meet the questions
    seen = known.join(beside(claims.select("execution_id", "sub_question_id"), n), "execution_id").groupBy("execution_id").agg(F.coalesce(F.sum(F.when(asof.there(known, "sub_question_id"), F.col("n"))), F.lit(0)).alias("facts_seen"), F.max("since").alias("since"))
    return judged.join(seen, "execution_id").select("execution_id", "since", "asked_at", "label", "facts_seen")


@query(
    """SELECT c_custkey::VARCHAR AS execution_id, CASE WHEN c_custkey % 3 = 2 THEN 'STALLED' WHEN c_custkey % 4 = 3 THEN 'UNRESOLVED_TARGET_NOT_SATISFIED' ELSE 'RESOLVED' END AS stop_reason,
    CASE WHEN c_custkey % 3 <> 2 AND c_custkey % 4 = 3 THEN 'incomplete_evidence_path' END AS sub_reason, CASE WHEN c_custkey % 3 = 2 THEN 1 WHEN c_custkey % 4 = 3 THEN 2 ELSE c_custkey % 3 END::INT AS iteration FROM customer"""
)
def iterate_with_paths(spark, sf_dir):
    """The region of every customer's nation, asked in an execution each, with evidence paths from the customer on: a model that is right, right after a correction, or never, and for every fourth customer no fact says where it is, so the path has a gap."""
    from claimloom.plans import iterate

    t = lambda n: _table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("c_custkey").cast("string").alias("execution_id"), F.lit(1).alias("sub_question_id"), "c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
    orders = t("orders").join(rows.select("execution_id", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))

    def fact(df, at, subject, relation, obj):
        return df.select("execution_id", F.lit(at).cast("long").alias("ord") if isinstance(at, int) else at.cast("long").alias("ord"), subject.alias("subject"), F.lit(relation).alias("relation"), F.col(obj).alias("object"), F.lit(None).cast("string").alias("evidence"))

    facts = fact(rows, 0, F.col("c_name"), "trades_in", "c_mktsegment").unionAll(fact(rows.where("c_custkey % 4 <> 3"), 1, F.col("c_name"), "located_in", "n_name")).unionAll(fact(rows, 2, F.col("n_name"), "part_of", "r_name"))
    facts = facts.unionAll(fact(orders, F.col("o_orderkey") + 3, F.concat(F.lit("Order#"), "o_orderkey"), "placed_by", "c_name"))
    own = ["execution_id", "sub_question_id"]
    asked = rows.select(*own, F.concat(F.lit("Which region contains the nation of "), "c_name", F.lit("?")).alias("question"))
    answers = rows.select(*own, F.when(F.col("c_custkey") % 3 == 0, F.col("r_name")).otherwise("Atlantis").alias("answer"))
    contexts = rows.select("execution_id", F.lit("Nations are parts of regions.").alias("context"))

    def extract(asked):
        return asked.select(*own, "iteration", "answer").join(rows.select(*own, "n_name"), own).select(*own, "iteration", F.lit(0).cast("long").alias("ord"), F.col("n_name").alias("subject"), F.lit("part_of").alias("relation"), F.col("answer").alias("object"), F.col("answer").alias("source_sentence"))

    def revise(ask):
        return ask.select(*own, "answer").join(rows.select(*own, "c_custkey", "r_name"), own).select(*own, F.when(F.col("c_custkey") % 3 == 1, F.col("r_name")).otherwise(F.col("answer")).alias("answer"))

    results, _ = iterate.run(asked, contexts, facts, answers, extract, revise)
    return results.select("execution_id", "stop_reason", "sub_reason", "iteration")


_TOKENS = r"regexp_extract_all(lower({}), '[a-z0-9]+|[\p{{L}}\p{{N}}]')"
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(
    rf"""WITH b AS (SELECT item_id, {_WORDS.format("text")} AS t FROM benchmark), e AS (SELECT 'item ' || item_id AS entity, array_to_string(t[1:k], ' ') AS key, k AS n FROM (SELECT item_id, t, unnest([3, 4, 5]) AS k FROM b) WHERE len(t) >= k
    UNION SELECT c_name, array_to_string({_WORDS.format("c_name")}, ' '), len({_WORDS.format("c_name")}) FROM customer UNION SELECT p_name, array_to_string({_WORDS.format("p_name")}, ' '), len({_WORDS.format("p_name")}) FROM part),
    d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents), g AS (SELECT doc_id, n, i, array_to_string(t[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM e) WHERE len(t) >= n))
    SELECT doc_id, entity, count(*)::BIGINT AS n_places, min(i - 1)::INT AS first_at, count(DISTINCT key)::INT AS n_aliases FROM g JOIN e USING (key, n) GROUP BY ALL"""
)
def alias_mentions(spark, sf_dir):
    """Customers, parts and benchmark items (by their first three, four and five words) in all documents."""
    from claimloom.operators import aliases

    items = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("entity"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("t"))
    starts = items.select("entity", "t", F.explode(F.array(*[F.lit(k) for k in (3, 4, 5)])).alias("k")).where("size(t) >= k").select("entity", F.array_join(F.slice("t", F.lit(1), F.col("k")), " ").alias("alias"), F.col("k").alias("ord"))
    named = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("entity")).union(_table(spark, sf_dir, "part").select("p_name")).distinct()
    names = aliases.expanded(named).unionByName(aliases.expanded(items.select("entity"), starts).where("alias <> entity"))
    found = aliases.mentioned(_table(spark, sf_dir, "documents"), names, "doc_id")
    return found.select("doc_id", "entity", "n_places", "first_at", F.size("aliases").alias("n_aliases"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 AND event_type = 'error' THEN 2 ELSE 1 END::INT AS attempt_number, NULL::VARCHAR AS error FROM events")
def checkpoint_resume(spark, sf_dir):
    """A run over all events that dies: it appended every second one, errors among them, and left a part that it never committed. The next run takes what is missing or failed; the log is compacted."""
    from claimloom.operators import reports
    from claimloom.sources.shared import fresh
    from claimloom.sources.versions import RowLog

    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    log = RowLog(spark, fresh(spark, "log"), "id long, error string, attempt_number int")
    log.append(events.where("id % 2 = 0").select("id", F.when(F.col("event_type") == "error", "timeout").alias("error"), F.lit(1).alias("attempt_number")))
    log.versions.write(events.select("id", F.lit("lost").alias("error"), F.lit(9).alias("attempt_number")))
    asked = reports.resume(events, log.last().withColumn("ord", F.lit(0)), retry_errors=True)
    log.append(asked.where("not skip").select("id", F.lit(None).cast("string").alias("error"), F.col("attempt").alias("attempt_number")))
    log.compact()
    return log.last().select("id", "error", "attempt_number")


@query(
    """SELECT c_custkey::VARCHAR AS execution_id, c_name AS subject, 'located_in' AS relation, n_name AS object, CASE WHEN c_custkey % 2 = 0 THEN 'seen again' ELSE '' END AS evidence, 0::BIGINT AS created_order FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT o_custkey::VARCHAR, 'Order#' || o_orderkey, 'placed_by', c_name, '', o_orderkey::BIGINT FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 5 <> 0"""
)
def fact_store(spark, sf_dir):
    """Facts of all customers and orders written by three upserts: the second replaces evidence, the third adds orders; every fifth customer's orders are written under an execution that is then deleted."""
    from claimloom.sources.shared import fresh
    from claimloom.sources.store import Store

    store = Store(spark, fresh(spark, "store"), buckets=8)
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    located = c.select("c_custkey", F.col("c_custkey").cast("string").alias("execution_id"), F.col("c_name").alias("subject"), F.lit("located_in").alias("relation"), F.col("n_name").alias("object"), F.lit(0).cast("long").alias("created_order"))
    orders = _table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    placed = orders.select(F.when(F.col("o_custkey") % 5 == 0, "dropped").otherwise(F.col("o_custkey").cast("string")).alias("execution_id"), F.concat(F.lit("Order#"), "o_orderkey").alias("subject"), F.lit("placed_by").alias("relation"), F.col("c_name").alias("object"), F.col("o_orderkey").cast("long").alias("created_order"))
    store.upsert_facts(located)
    store.upsert_facts(located.where("c_custkey % 2 = 0").withColumn("evidence", F.lit("seen again")))
    store.upsert_facts(placed)
    store.delete("dropped")
    return store.all_facts().select("execution_id", "subject", "relation", "object", "evidence", "created_order")


@query("""SELECT conv_id, turn, '{"meta":{"API_Key":"[REDACTED]","turn":"' || turn || '"},"parts":[{"password_hint":"[REDACTED]","role":"' || role || '"}],"counts":{"tokens_used":"[REDACTED]","letters":{"n":' || length(text) || '}}}' AS line FROM conversations""")
def redacted_events(spark, sf_dir):
    """All turns of conversations as events whose data has secret keys in a map, in structs of an array, and in a map of structs."""
    from claimloom.sources import logs

    entry = lambda n: F.struct(n.cast("int").alias("n"))
    data = F.struct(
        F.create_map(F.lit("API_Key"), F.col("text"), F.lit("turn"), F.col("turn").cast("string")).alias("meta"),
        F.array(F.struct(F.col("text").alias("password_hint"), "role")).alias("parts"),
        F.create_map(F.lit("tokens_used"), entry(F.lit(1)), F.lit("letters"), entry(F.char_length("text"))).alias("counts"),
    )
    events = _table(spark, sf_dir, "conversations").select("conv_id", "turn", data.alias("data"))
    return logs.redacted(events, "data").select("conv_id", "turn", F.to_json("data").alias("line"))
