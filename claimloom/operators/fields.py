"""Answers of the form "Label: value. Label: value.", dealt out to the questions they answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from claimloom.functions import values as V
from claimloom.functions.text import normalize, strip

#: Words of labels, and words of the questions that they answer.
CUES = (
    (("diagnosis",), ("diagnosis", "diagnosed")),
    (("a1c",), ("a1c", "hba1c", "hemoglobin")),
    (("kidney", "ckd", "egfr"), ("ckd", "egfr", "kidney", "stage")),
    (("stopped", "discontinued", "medication stopped"), ("discontinu", "stopped", "why")),
    (("tolerated", "current", "active"), ("active", "tolerat", "dose")),
    (("discussed", "not started"), ("discussed", "not been started", "not started")),
    (("allergy", "antibiotic"), ("allerg", "reaction")),
)


def labeled_fields(answer: Column | str) -> Column:
    """array<struct<label, value>> of an answer."""
    text = strip(answer)
    parts = F.split(text, r"\.\s+(?=[A-Za-z][^:]{0,80}:)")
    parts = F.when(F.size(parts) == 1, F.filter(F.split(text, r"\.\s+"), lambda p: F.contains(p, F.lit(":")))).otherwise(parts)
    pairs = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit(":"))), lambda p: F.struct(strip(F.substring_index(p, ":", 1)).alias("label"), F.regexp_replace(strip(F.regexp_replace(p, r"(?s)^[^:]*:", "")), r"\.+$", "").alias("value")))
    return F.filter(pairs, lambda x: (x["label"] != "") & (x["value"] != ""))


def label_score(label: Column, question: Column) -> Column:
    """How well a (normalized) label answers a (normalized) question."""
    total = F.lit(0)
    for label_words, question_words in CUES:
        both = label.rlike("|".join(label_words)) & question.rlike("|".join(question_words))
        more = sum((F.contains(question, F.lit(w)).cast("int") for w in label_words), F.lit(2))
        total = total + F.when(both, more).otherwise(0)
    return total


def _assign(scores: list, kidney: list, roles: list) -> list[int] | None:
    """Each question, in order, takes the best field that is left, the first of several; a kidney field serves each role once. None if a question gets none."""
    used, served, out = set(), set(), []
    for row, role in zip(scores, roles, strict=True):
        best, place = 0, None
        for k, score in enumerate(row):
            taken = (k, role) in served if kidney[k] else k in used
            if score > best and not taken:
                best, place = score, k
        if place is None:
            return None
        out.append(place)
        used.add(place)
        if kidney[place] and role in ("stage", "egfr"):
            served.add((place, role))
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def assign(scores: pd.Series, kidney: pd.Series, roles: pd.Series) -> pd.Series:
    """One answer a row: scores (questions x fields), which fields are about kidneys, the questions' roles. Greedy, so Python."""
    return pd.Series([_assign([list(r) for r in s], list(k), list(r)) for s, k, r in zip(scores, kidney, roles, strict=True)])


def project(answers: DataFrame, questions: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """keys, sub_question_id, value: by position where there are as many fields as questions, else by words; null where neither works."""
    asked = questions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sub_question_id", normalize("question").alias("q")))).alias("asked"))
    rows = answers.join(asked, keys).withColumn("fields", labeled_fields(answer))
    labels = F.transform("fields", lambda f: normalize(f["label"]))
    rows = rows.withColumns({
        "scores": F.transform("asked", lambda a: F.transform(labels, lambda x: label_score(x, a["q"]))),
        "kidney": F.transform(labels, lambda x: x.rlike("kidney|ckd|egfr")),
        # a role a kidney field serves: the text says which, whatever else it asks
        "roles": F.transform("asked", lambda a: F.when(F.contains(a["q"], F.lit("egfr")) & ~F.contains(a["q"], F.lit("stage")), "egfr").when(a["q"].rlike("stage|ckd") & ~F.contains(a["q"], F.lit("egfr")), "stage").otherwise("both")),
    })
    even = F.size("fields") == F.size("asked")
    rows = rows.withColumn("places", F.when(even, F.sequence(F.lit(0), F.size("asked") - 1)).otherwise(assign("scores", "kidney", "roles"))).withColumn("even", even)
    rows = rows.select(*keys, "fields", "places", "even", "roles", F.posexplode("asked").alias("at", "a"))
    value = F.get("fields", F.get("places", F.col("at")))["value"]
    role = F.get("roles", F.col("at"))
    narrowed = F.when(~F.col("even") & (role == "egfr"), F.coalesce(V.egfr(value), value)).when(~F.col("even") & (role == "stage"), F.coalesce(F.concat(F.lit("CKD "), V.ckd_stage(value)), value)).otherwise(value)
    return rows.select(*keys, F.col("a.sub_question_id").alias("sub_question_id"), narrowed.alias("value"))


def grounded(fragment: Column | str, source: Column | str) -> Column:
    """The fragment, or each of its words, is in the source."""
    f, s = normalize(fragment), normalize(source)
    words = F.filter(F.split(f, r"\s+"), lambda w: w != "")
    return (f != "") & (F.contains(s, f) | F.forall(words, lambda w: F.contains(s, w)))
