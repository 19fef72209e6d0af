"""What a question sees of its execution's facts.

Facts may carry `since`, the number of the sub-question from which on they are there (null: all along), and then a question sees those up to
its own number. Lookups become as-of joins: a grouped index has a row for each span of numbers over which its value stays the same, and a question meets one span. So
all questions of all executions are looked up together, though each sees the facts that those before it added.
Numbers (`ord`) of facts ascend with `since`.

Facts that answer a question are found by its intent's relations, one row each, so an execution's facts and questions aren't paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import registry as R
from claimloom.functions.text import norm

SINCE = "since"


def there(facts: DataFrame, at: str, since: str = SINCE) -> Column:
    """Whether a fact is there at the question's number; true for facts that are there all along."""
    return F.coalesce(F.col(since), F.lit(0)) <= F.col(at) if SINCE in facts.columns else F.lit(True)


def spans(facts: DataFrame, by: list[str], **found: Column) -> DataFrame:
    """by, what aggregates of the facts with equal `by` give from __since on until before __until (null: ever after)."""
    w = Window.partitionBy(*by).orderBy("__since")
    rows = facts.withColumn("__since", F.coalesce(F.col(SINCE), F.lit(0)))
    rows = rows.select(*by, "__since", *[c.over(w).alias(n) for n, c in found.items()]).dropDuplicates([*by, "__since"])
    return rows.withColumn("__until", F.lead("__since").over(w))


def lookup(rows: DataFrame, facts: DataFrame, by: list[str], at: str, **found: Column) -> DataFrame:
    """rows with aggregates of the facts that share `by` with them, null where there are none; of the facts that are there at the row's `at`, if facts have `since`."""
    if SINCE not in facts.columns:
        return rows.join(facts.groupBy(*by).agg(*[c.alias(n) for n, c in found.items()]), by, "left")
    index = spans(facts, by, **found).withColumnsRenamed({b: f"__by_{b}" for b in by})
    on = (F.col("__since") <= F.col(at)) & (F.col("__until").isNull() | (F.col(at) < F.col("__until")))
    for b in by:
        on = on & (F.col(b) == F.col(f"__by_{b}"))
    return rows.join(index, on, "left").drop("__since", "__until", *[f"__by_{b}" for b in by])


def answering(facts: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("execution_id",), at: str = "sub_question_id") -> DataFrame:
    """Each target with each fact that answers it and is there; a target whose intent has no family is answered by every fact.

    facts and targets share no columns but keys; targets have intent. Families are joined by relation, so only answers become rows; facts of no family stay out before the join.
    """
    k = list(keys)
    known = F.col("intent").isin(list(R.FAMILIES))
    asked = targets.where(known).withColumn("__relation", F.explode(R.members(F.col("intent"))))
    hits = facts.withColumn("__relation", norm(facts, "relation")).where(F.col("__relation").isin(list(R.ANSWERS))).join(asked, [*k, "__relation"]).drop("__relation")
    rest = facts.join(targets.where(~known), k)
    return hits.unionByName(rest).where(there(facts, at))


def often(facts: DataFrame, keys: tuple[str, ...], subject: Column, top: int) -> DataFrame:
    """keys, candidate, n (its facts), first_at: the `top` subjects with most facts that are there all along, and those that facts added later are about, a row for each span of numbers (__since, __until) if facts have `since`.

    The `top` subjects with most facts at a question's number are among them, the first of equals. So an execution gives a few rows, and one for each later fact. subject: null where a fact doesn't count.
    """
    k = list(keys)
    rows = facts.withColumn("candidate", subject).where("candidate is not null")
    counts = {"n": F.count(F.lit(1)), "first_at": F.min("ord")}
    base = (rows.where(F.col(SINCE).isNull()) if SINCE in facts.columns else rows).groupBy(*k, "candidate").agg(*[c.alias(n) for n, c in counts.items()])
    w = Window.partitionBy(*k).orderBy(F.desc("n"), "first_at")
    best = base.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= top).drop("__rn")
    if SINCE not in facts.columns:
        return best
    best = best.withColumns({"__since": F.lit(0), "__until": F.lit(None).cast("int")})
    later = rows.where(F.col(SINCE).isNotNull()).select(*k, "candidate").distinct()
    return best.unionByName(spans(rows.join(later, [*k, "candidate"], "left_semi"), [*k, "candidate"], **counts).where("__since > 0"))


def usual_subjects(questions: DataFrame, subjects: DataFrame, keys: tuple[str, ...], at: str) -> DataFrame:
    """questions with candidate, n, first_at of the subjects, which often() gives, as far as they are there."""
    rows = questions.join(subjects, list(keys))
    if "__since" not in subjects.columns:
        return rows
    return rows.where((F.col("__since") <= F.col(at)) & (F.col("__until").isNull() | (F.col(at) < F.col("__until")))).drop("__since", "__until")
