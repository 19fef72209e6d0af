"""Claims against facts: SUPPORTED, CONTRADICTED or NO_EVIDENCE.

Without a question, a claim is looked up by its normalized triple (of equal facts the last counts), then by subject and
relation (the first fact conflicts), then for the same triple with the opposite polarity, then for an engine that drives the
same stage. With a question, claims and facts are first rewritten for its intent (frames), then compared by typed values.

All lookups are equi-joins on (keys, normalized columns) against facts reduced to one row a key; only typed comparison has a
residual condition, and its join keeps the equality on keys and on the relation's class. Executions never mix: `keys` are part of every join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import registry as R
from claimloom.functions import values as V
from claimloom.functions.text import evidence_or_triple, is_negated, norm, normalize, normalize_relation, normalize_subject, strip
from claimloom.operators.asof import SINCE, answering, lookup, there
from claimloom.sources.schemas import CONTRADICTED, NO_EVIDENCE, SUPPORTED
from claimloom.sources.shared import beside, cut

#: Fixed value: what a rewritten claim's source sentence begins with.
ALIGNED = "Aligned from:"


def with_norms(df: DataFrame) -> DataFrame:
    """Adds s, r, o: the normalized triple."""
    return df.withColumns({"s": norm(df, "subject"), "r": norm(df, "relation"), "o": norm(df, "object")})


def _negated(r: Column | str) -> Column:
    """Of an already normalized relation."""
    return (F.col(r) if isinstance(r, str) else r).rlike("^(does_not|not|never|without|no)_")


def fact_struct(df: DataFrame) -> Column:
    evidence = F.col("evidence") if "evidence" in df.columns else F.lit(None).cast("string")
    return F.struct(F.col("ord").cast("long").alias("ord"), "subject", "relation", "object", evidence.alias("evidence"))


def _evidence(f: Column) -> Column:
    return evidence_or_triple(f["evidence"], f["subject"], f["relation"], f["object"])


def is_engine(obj: Column | str) -> Column:
    return normalize(obj).rlike("engine|motor")


def is_first_stage_pair(claim_subject: Column | str, fact_subject: Column | str) -> Column:
    """The claim's "first stage" is the fact's stage or rocket."""
    a, b = normalize(claim_subject), normalize(fact_subject)
    first = (a == "first stage") | F.contains(a, F.lit(" first stage"))
    return (a == b) | (first & b.rlike("first stage|s ic|sic stage|saturn v"))


def compare(claims: DataFrame, facts: DataFrame, keys: tuple[str, ...] = ("execution_id",), at: str = "sub_question_id") -> DataFrame:
    """Claims with label, reason, evidence, conflicting_object, conflicting_fact and matched_fact; one row for each claim. at: the claims' number, for facts with `since`."""
    keys = list(keys)
    c = with_norms(claims)
    f = near = with_norms(facts).withColumn("fact", fact_struct(facts))
    if SINCE in facts.columns:  # as-of lookups sort what they look through, so facts about no claim's subject stay out; written, since there are three lookups
        subjects = beside(c.select(*keys, "s").distinct(), claims.count())
        about = cut(facts.withColumn("s", norm(facts, "subject")).join(subjects, [*keys, "s"], "left_semi").select(*facts.columns))
        near = with_norms(about).withColumn("fact", fact_struct(about))
    out = lookup(c, near, [*keys, "s", "r", "o"], at, exact=F.max_by("fact", "ord"))
    out = lookup(out, near, [*keys, "s", "r"], at, related=F.min_by("fact", "ord"))
    # a triple's relations of either polarity; the claim's own relation would have matched before
    out = lookup(out.withColumn("neg", ~_negated("r")), near.withColumn("neg", _negated("r")), [*keys, "s", "o", "neg"], at, opposed=F.min_by("fact", "ord"))
    out = _engine_conflicts(out, c, f, keys, claims.columns, at)
    e, q, p, g = (F.col(n) for n in ("exact", "related", "opposed", "engine"))
    other = F.coalesce(q, p, g)
    same_words = strip("relation") == strip(e["relation"])
    aligned = F.coalesce(F.col("source_sentence").startswith(ALIGNED), F.lit(False)) if "source_sentence" in claims.columns else F.lit(False)

    def conflict(f: Column, what: str) -> Column:
        return F.concat(F.lit("Claim object '"), "object", F.lit("' conflicts with KGc fact '"), f["object"], F.lit(f"' for {what} '"), "relation", F.lit("'."))

    reason = (
        F.when(e.isNotNull() & aligned, "Claim aligned to matching KGc fact using canonical KGc subject/relation.")
        .when(e.isNotNull() & same_words, "Claim matches a KGc fact.")
        .when(e.isNotNull(), "Claim matches KGc fact after relation normalization.")
        .when(q.isNotNull(), conflict(q, "relation"))
        .when(p.isNotNull(), F.concat(F.lit("Claim relation '"), "relation", F.lit("' conflicts with KGc relation '"), p["relation"], F.lit("' for the same subject and object (negation polarity mismatch).")))
        .when(g.isNotNull(), conflict(g, "engine power relation"))
        .otherwise("KGc has no matching fact for this claim.")
    )
    return out.select(
        *claims.columns,
        F.when(e.isNotNull(), SUPPORTED).when(other.isNotNull(), CONTRADICTED).otherwise(NO_EVIDENCE).alias("label"),
        reason.alias("reason"),
        F.coalesce(_evidence(e), _evidence(other), F.lit("No supporting KGc fact found.")).alias("evidence"),
        F.when(e.isNull(), other["object"]).alias("conflicting_object"),
        F.when(e.isNull(), other).alias("conflicting_fact"),
        e.alias("matched_fact"),
    )


def _engine_conflicts(out: DataFrame, c: DataFrame, f: DataFrame, keys: list[str], columns: list[str], at: str) -> DataFrame:
    """Adds engine: the first fact by which another engine drives the claim's stage, for claims that nothing else was found for. Only claims about engines meet facts about engines.

    c: the claims with their norms, before any lookup, so that lookups aren't done a second time to find those about engines.
    """
    power = list(R.ENGINE_POWER)
    left = c.where(F.col("r").isin(power) & is_engine("object")).select(*columns, "o").withColumn("__claim", F.struct(*columns))
    right = f.where(F.col("r").isin(power)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("subject").alias("__subject"), F.col("o").alias("__o"), F.col("ord").alias("__ord"), F.col("fact").alias("__fact"), *([F.col(SINCE).alias("__since")] if SINCE in f.columns else []))
    on = there(f, at, "__since")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    met = left.join(right, on & is_first_stage_pair("subject", "__subject") & (F.col("o") != F.col("__o")))
    best = met.groupBy("__claim").agg(F.min_by("__fact", "__ord").alias("engine"))
    out = out.withColumn("__claim", F.struct(*columns)).join(best, "__claim", "left")
    return out.withColumn("engine", F.when(F.col("exact").isNull() & F.col("related").isNull() & F.col("opposed").isNull(), F.col("engine")))


# frames: claims and facts as one intent sees them


def canonical_subject(subject: Column, primary: Column, question: Column) -> Column:
    """Subjects that only point to the question's own become that."""
    p, s, q = normalize_subject(primary), normalize_subject(subject), normalize(question)
    points = (
        s.isin(list(R.WEAK_SUBJECTS))
        | ((s == "mission") & F.contains(q, F.lit("apollo")))
        | (s.endswith(" mission") & F.contains(s, F.lit("apollo")))
        | F.startswith(p, s)
        | F.startswith(s, p)
    )
    return F.when((F.coalesce(primary, F.lit("")) != "") & points, primary).otherwise(subject)


def canonical_for(relation: Column, intent: Column, canonical: Column) -> Column:
    usable = ~R.composite(intent) & (F.coalesce(canonical, F.lit("")) != "") & R.in_family(relation, intent)
    return F.when(usable, canonical).otherwise(relation)


#: Subjects who take part in a mission, and words of its context.
PARTICIPANTS = "armstrong|aldrin|collins|crew|astronaut|and "
MISSION_EVIDENCE, MISSION_QUESTION = "lunar|moon|material|collect|apollo", "lunar|apollo|material"


def claim_frames(claims: DataFrame) -> DataFrame:
    """Claims joined with their target: adds frame_subject, frame_relation, alias."""
    subject = canonical_subject(F.col("subject"), F.col("primary_subject"), F.col("question"))
    return claims.withColumns({"frame_subject": subject, "frame_relation": canonical_for(F.col("relation"), F.col("intent"), F.col("canonical_relation")), "alias": normalize_subject("subject") != normalize_subject(subject)})


def fact_frames(facts: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("execution_id",), target_keys: tuple[str, ...] = ("execution_id", "sub_question_id"), at: str = "sub_question_id") -> DataFrame:
    """A row for each target and fact that answers it, and another where a participant's share of a mission stands for the mission's.

    target keys, frame_ord, frame_subject, frame_relation, raw relation and object, projected, alias, fact. Of frames with equal normalized triples the first stays.
    """
    joined = answering(facts.withColumn("fact", fact_struct(facts)), targets, keys, at)
    relation = canonical_for(F.col("relation"), F.col("intent"), F.col("canonical_relation"))
    subject = canonical_subject(F.col("subject"), F.col("primary_subject"), F.col("question"))
    evidence = F.col("evidence") if "evidence" in facts.columns else F.lit("")
    takes_part = (
        (F.col("intent") == "collection_amount")
        & normalize("subject").rlike(PARTICIPANTS)
        & (normalize(F.coalesce(evidence, F.lit(""))).rlike(MISSION_EVIDENCE) | normalize("question").rlike(MISSION_QUESTION))
        & (F.coalesce("primary_subject", F.lit("")) != "")
    )
    views = F.filter(
        F.array(
            F.struct(subject.alias("subject"), F.lit(False).alias("projected"), F.lit(True).alias("on")),
            F.struct(F.col("primary_subject").alias("subject"), F.lit(True).alias("projected"), takes_part.alias("on")),
        ),
        lambda v: v["on"],
    )
    rows = joined.withColumns({"frame_relation": relation, "view": F.explode(views)}).withColumns({"frame_subject": F.col("view.subject"), "projected": F.col("view.projected"), "frame_ord": F.col("ord") * 2 + F.col("view.projected").cast("int")})
    same = [*target_keys, normalize("frame_subject").alias("fs"), normalize_relation("frame_relation").alias("fr"), normalize("object").alias("fo")]
    alias = ~F.col("projected") & (normalize_subject("subject") != normalize_subject("frame_subject"))
    whole = F.struct("frame_ord", "frame_subject", "frame_relation", F.col("relation").alias("raw_relation"), F.col("object").alias("frame_object"), "projected", alias.alias("fact_alias"), "fact")
    return rows.groupBy(*same).agg(F.min_by(whole, "frame_ord").alias("frame")).select(*target_keys, "frame.*")


def subjects_compatible(left: Column, right: Column, primary: Column, question: Column) -> Column:
    a, b, p, q = normalize_subject(left), normalize_subject(right), normalize_subject(F.coalesce(primary, F.lit(""))), normalize(question)
    weak = list(R.WEAK_SUBJECTS)

    def in_frame(s: Column) -> Column:
        has = p != ""
        return (
            (has & (F.startswith(s, p) | F.startswith(p, s)))
            | (has & V.same_patient(s, p))
            | (F.contains(q, F.lit("apollo 11")) & F.contains(s, F.lit("apollo 11")))
            | ((s == "mission") & ((has & F.contains(p, F.lit("apollo"))) | (F.contains(q, F.lit("apollo")) & F.contains(q, F.lit("mission")))))
            | (s.endswith(" mission") & F.contains(s, F.lit("apollo")) & F.contains(q, F.lit("mission")))
        )

    pointed = (p != "") & ((a.isin(weak) & (b == p)) | (b.isin(weak) & (a == p)))
    return (a == b) | V.same_patient(a, b) | pointed | (a.isin(weak) & b.isin(weak)) | (in_frame(a) & in_frame(b))


def _comparison_intent(intent: Column, claim_relation: Column) -> Column:
    return F.when(R.composite(intent), F.coalesce(R.slot_of(claim_relation), intent)).otherwise(intent)


def objects_compatible(left: Column, right: Column, intent: Column, claim_relation: Column) -> Column:
    """Equality first, then values by their type, names and phrases by containment, then amounts, dates, crews and presidents."""
    i = _comparison_intent(intent, claim_relation)
    a, b = normalize(left), normalize(right)
    within = F.contains(a, b) | F.contains(b, a)
    x, y = V.amount_core(left), V.amount_core(right)
    same_amount = (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    typed = (
        F.when(i.isin("lab_measurement", "renal_measurement"), V.same_lab_value(left, right))
        .when(i == "disease_stage", V.same_stage(left, right))
        .when(i == "medication_dose", V.same_dose(left, right))
        .when(within, F.lit(True))
        .when(i == "collection_amount", same_amount)
        .when(i == "occurrence_date", V.same_dates(left, right))
        .when(i == "crew_members", V.same_names(left, right))
        .when(i == "president_at_time", V.same_president(left, right))
        .otherwise(F.lit(False))
    )
    return (a == b) | typed


def objects_conflict(left: Column, right: Column, intent: Column, claim_relation: Column) -> Column:
    return ~objects_compatible(left, right, intent, claim_relation) & _stated(left, right, intent, claim_relation)


def _stated(left: Column, right: Column, intent: Column, claim_relation: Column) -> Column:
    """Whether two objects that aren't compatible conflict: both say something."""
    i = _comparison_intent(intent, claim_relation)
    a, b = normalize(left), normalize(right)
    return F.when(i.isin(list(R.FAMILIES)), (a != "") & (b != "")).otherwise(a != b)


def compare_for_targets(claims: DataFrame, facts: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("execution_id",), target_keys: tuple[str, ...] = ("execution_id", "sub_question_id"), frames: DataFrame | None = None) -> DataFrame:
    """Like compare(), for claims of questions with a target. Match and conflict are found in one join: the first compatible frame, else the first that conflicts.

    frames: what fact_frames() gives for facts and targets, if it is there already; it doesn't depend on claims.
    """
    tk = list(target_keys)
    c = claim_frames(claims.join(targets, tk)).withColumn("__claim", F.struct(*claims.columns))
    frames = (fact_frames(facts, targets, keys, target_keys) if frames is None else frames).select(*[F.col(k).alias(f"__{k}") for k in tk], "frame_ord", "frame_subject", "raw_relation", "frame_object", "projected", "fact_alias", "fact", F.col("frame_relation").alias("fact_relation"))
    on = F.lit(True)
    for k in tk:
        on = on & (F.col(k) == F.col(f"__{k}"))
    relation, intent = F.col("relation"), F.col("intent")
    met = R.same_family(relation, F.col("raw_relation"), intent) & subjects_compatible(F.col("claim_subject"), F.col("frame_subject"), F.col("primary_subject"), F.col("question"))
    pairs = c.withColumnRenamed("frame_subject", "claim_subject").drop("frame_relation").join(frames, on & met)
    fits = objects_compatible(F.col("object"), F.col("frame_object"), intent, relation)
    stated = _stated(F.col("object"), F.col("frame_object"), intent, relation)
    frame = F.struct("frame_object", "projected", "fact_alias", "fact")
    # exploded, so that a pair is judged once, however often filters and aggregates use it
    judged = F.explode(F.array(F.struct(fits.alias("fits"), stated.alias("stated")))).alias("j")
    pairs = pairs.select("__claim", "frame_ord", frame.alias("frame"), judged).select("__claim", "frame_ord", "frame", "j.fits", (~F.col("j.fits") & F.col("j.stated")).alias("clash")).where("fits or clash")
    best = pairs.groupBy("__claim").agg(F.expr("min_by(frame, frame_ord) filter (where fits)").alias("hit"), F.expr("min_by(frame, frame_ord) filter (where clash)").alias("miss"))
    out = c.join(best, "__claim", "left")
    hit, miss = F.col("hit"), F.when(F.col("hit").isNull(), F.col("miss"))
    reason = (
        F.when(hit["projected"], "Claim matches projected question-scoped evaluation view of trusted fact.")
        .when(hit.isNotNull() & (hit["fact_alias"] | F.col("alias")), "Claim matches KGc fact after question-scoped subject canonicalization.")
        .when(hit.isNotNull() & (normalize_relation("relation") != normalize_relation(hit["fact"]["relation"])), "Claim matches KGc fact after relation-family normalization.")
        .when(hit.isNotNull(), "Claim matches KGc fact in question-scoped evaluation frame.")
        .when(miss.isNotNull(), F.concat(F.lit("Claim object '"), "object", F.lit("' conflicts with KGc fact '"), miss["frame_object"], F.lit("' for relation family '"), "intent", F.lit("'.")))
        .otherwise("KGc has no matching fact for this claim in the question-scoped frame.")
    )
    return out.select(
        *claims.columns,
        F.when(hit.isNotNull(), SUPPORTED).when(miss.isNotNull(), CONTRADICTED).otherwise(NO_EVIDENCE).alias("label"),
        reason.alias("reason"),
        F.coalesce(_evidence(hit["fact"]), _evidence(miss["fact"]), F.lit("No supporting KGc fact found.")).alias("evidence"),
        miss["frame_object"].alias("conflicting_object"),
        miss["fact"].alias("conflicting_fact"),
        hit["fact"].alias("matched_fact"),
    )


def same_polarity_facts(claim_relation: Column | str, fact_relation: Column | str) -> Column:
    return is_negated(claim_relation) == is_negated(fact_relation)
