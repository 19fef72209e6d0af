"""Rules on text, typed values, question intents, decoding and derivation."""

import re

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import values as V
from claimloom.operators import derive, fields, questions
from claimloom.sources import decode
from claimloom.sources.schemas import FACTS


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("x")).first()["x"]


def test_normalizers(spark):
    texts = ["  The  Host C ", "a & b", "S-IC stage!", "Café_du  Monde", "", "x\t\ny", "was_Launched-By ", "is a", "__no__op__"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize("t").alias("n"), T.normalize_relation("t").alias("r")).collect()
    for row in rows:
        n = re.sub(r"[^\w\s-]", "", re.sub(r"\s+", " ", row["t"].lower().strip())).strip()
        r = re.sub(r"_+", "_", re.sub(r"[^\w_]", "", re.sub(r"[\s-]+", "_", row["t"].lower().strip()))).strip("_")
        r = re.sub(r"^(is|was|were|be|being|been)_", "", r).strip("_")
        assert (row["n"], row["r"]) == (n, r)


@pytest.mark.parametrize(
    "text,interval",
    [
        ("March 3-9, 1984", (3, 3, 3, 9, 1984)),
        ("between March 3 and March 9, 1984", (3, 3, 3, 9, 1984)),
        ("between March 3 and 9, 1984", (3, 3, 3, 9, 1984)),
        ("in 1984 from March 3 to 9", (3, 3, 3, 9, 1984)),
        ("May 30 through June 4, 2001", (5, 30, 6, 4, 2001)),
        ("may 30-june 14, 1992", (5, 30, 6, 14, 1992)),
        ("Smarch 16-24", None),
    ],
)
def test_date_intervals(spark, text, interval):
    got = one(spark, V.date_interval("t"), t=text)
    assert (tuple(got) if got else None) == interval


@pytest.mark.parametrize(
    "text,name,value",
    [
        ("CKD Stage 3B, eGFR 44 mL/min/1.73 m2", "ckd_stage", "stage 3b"),
        ("CKD Stage 3B, eGFR 44 mL/min/1.73 m2", "egfr", "44 mL/min/1.73 m²"),
        ("Hemoglobin A1C is 7.2%", "a1c", "7.2%"),
        ("Atorvastatin 20 mg once daily", "dose", "20 mg daily"),
        ("Lisinopril was discontinued because of persistent cough.", "stopped_med", "Lisinopril"),
        ("Lisinopril was discontinued because of persistent cough.", "stop_reason", "persistent cough"),
        ("Atorvastatin 20 mg daily", "active_med", "Atorvastatin"),
        ("Penicillin causing hives.", "allergen", "Penicillin"),
        ("Penicillin causing hives.", "reaction", "hives"),
        ("nothing here", "dose", None),
    ],
)
def test_slots(spark, text, name, value):
    assert one(spark, V.slot_value("t", name), t=text) == value


def test_amounts(spark):
    assert one(spark, V.amount_phrase("t"), t="They brought 47.5 pounds (21.5 kg) of lunar material during the stay") == "47.5 pounds (21.5 kg) of lunar material"
    assert one(spark, V.same_lab_value("a", "b"), a="7.20 %", b="7.2%") is False


@pytest.mark.parametrize("text,abstains", [("There is no information in the context.", True), ("I cannot   determine that", True), ("It did not launch.", False), ("", False)])
def test_abstention(spark, text, abstains):
    assert one(spark, T.is_abstention("t"), t=text) is abstains


INTENTS = [
    ("Which state contains the town where Ada Quill was born?", "location_containment"),
    ("In which town was the Meridian 4 crew member Ada Quill born?", "birthplace"),
    ("Which company built the first stage of the rocket that launched Meridian 4?", "manufacturer"),
    ("What is the capital of the state where he was born?", "capital_city"),
    ("When was the Meridian 4 mission?", "occurrence_date"),
    ("Who were the astronauts on the Meridian 4 mission?", "crew_members"),
    ("Where was Meridian 4 launched from?", "launch_site"),
    ("Which river runs beside the capital?", "general"),
    ("What CKD stage and eGFR does the patient have?", "kidney_status"),
    ("Which medication was discontinued, and why?", "discontinued_medication_with_reason"),
    ("Which active medication is tolerated and at what dose?", "active_medication_with_dose"),
    ("What allergy is recorded and what reaction does it cause?", "allergy_with_reaction"),
    ("What is the diagnosis?", "diagnosis"),
    ("What dates was it, what crew flew, and where did it launch?", "compound"),
    ("Who led the agency?", "leader"),
    ("What color is it?", "general"),
]


def test_intents(spark):
    rows = questions.with_intent(spark.createDataFrame([(q,) for q, _ in INTENTS], "question string")).collect()
    assert {r["question"]: r["intent"] for r in rows} == dict(INTENTS)


ITEMS = [
    ('{"subject": "A", "relation": "r", "object": "o", "evidence": " e "}', None, []),
    ('{"subj": "A", "predicate": "r", "value": 7}', None, ["alias_subj_to_subject", "alias_predicate_to_relation", "alias_value_to_object"]),
    ('["A", "r", "o"]', None, ["positional_array"]),
    ('["A", "r"]', "malformed_array_too_short", []),
    ('["A", "r", "o", "e", "x"]', "malformed_array_extra_positional_fields", []),
    ('{"subject": "A", "relation": "r", "object": null}', "null_object", []),
    ('{"subject": "A", "relation": "r", "object": ""}', "empty_object", []),
    ('{"subject": "A", "relation": "r"}', "missing_third_element", []),
    ('{"subject": "A", "relation": "r", "object": {"x": 1}}', "object_unsupported_nested_value", []),
    ('{"subject": "A", "relation": "r", "object": "r"}', "object_copied_from_relation", []),
    ('{"subject": null, "relation": "r", "object": "o"}', "subject_null", []),
    ('{"subject": "A", "relation": true, "object": "o"}', "relation_unsupported_bool", []),
    ('{"subject": "None", "relation": "r", "object": "o"}', "subject_null_string", []),
    ('{"x": 1}', "dictionary_missing_triple_keys", []),
    ('"text"', "unsupported_triple_item_type", []),
]


def test_coercion(spark):
    df = spark.createDataFrame([(k, i[0]) for k, i in enumerate(ITEMS)], "k int, j string").withColumn("item", F.parse_json("j"))
    rows = {r["k"]: r for r in decode.coerce_triples(df).drop("item").collect()}
    for k, (_, reason, norms) in enumerate(ITEMS):
        assert rows[k]["reason"] == reason, ITEMS[k]
        if reason is None:
            assert rows[k]["normalizations"] == norms
    assert rows[0]["evidence"] == "e" and rows[1]["object"] == "7"


def test_responses(spark):
    texts = [
        (0, 'Sure:\n{"triples": [{"subject": "A", "relation": "r", "object": "o"}, {"subject": "A"}'),
        (1, "```\nSubject,Relation,Object,Evidence\nA,r,\"o, p\",e\n\n```"),
        (2, "subject,relation,object,evidence\nA,,o,"),
        (3, "nothing"),
        (4, '{"triples": [{"subject": "A", "relation": "r", "object": null}]}'),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    rows = decode.triples(df).drop("item").collect()
    good = sorted((r["id"], r["subject"], r["relation"], r["object"]) for r in rows if r["batch_error"] is None and r["reason"] is None)
    assert good == [(0, "A", "r", "o"), (1, "A", "r", "o, p")]
    assert {r["id"] for r in rows if r["batch_error"]} == {2, 3}
    assert [r["id"] for r in decode.rejected_batches(decode.json_triples(df.where("id = 4")), ["id"]).collect()] == [4]


def test_numbered(spark):
    df = spark.createDataFrame([(0, '{"questions": [{"id": 2, "question": "b?"}, {"id": 1, "question": " a? "}]}'), (1, '{"questions": [{"id": 1, "question": "a"}, {"id": 3, "question": "b"}]}')], "k int, text string")
    rows = decode.numbered(df, "questions", "question").collect()
    assert sorted((r["id"], r["question"]) for r in rows if r["batch_error"] is None) == [(1, "a?"), (2, "b?")]
    assert [r["k"] for r in rows if r["batch_error"]] == [1]


CHART = "Patient Case K-52 has type 2 diabetes mellitus. The latest hemoglobin A1C is 6.9%. CKD stage 3b with current eGFR 51 mL/min/1.73 m2. Lisinopril was discontinued after repeated trials caused persistent cough. Atorvastatin 20 mg daily remains active and tolerated. The allergy list records latex causing wheezing. Dapagliflozin was discussed as a future treatment option."


@pytest.mark.parametrize(
    "intent,expected",
    [
        ("diagnosis", {("diagnosed_with", "type 2 diabetes mellitus")}),
        ("lab_measurement", {("has_a1c", "6.9%")}),
        ("kidney_status", {("has_ckd_stage", "stage 3b"), ("has_egfr", "51 mL/min/1.73 m²")}),
        ("discontinued_medication_with_reason", {("discontinued_medication", "Lisinopril"), ("discontinued_because", "persistent cough")}),
        ("active_medication_with_dose", {("active_medication", "Atorvastatin"), ("daily_dose", "20 mg daily")}),
        ("allergy_with_reaction", {("allergic_to", "latex"), ("causes_reaction", "wheezing")}),
        ("discussed_not_started", {("discussed_not_started", "Dapagliflozin")}),
    ],
)
def test_bootstrap(spark, intent, expected):
    targets = spark.createDataFrame([("e", 1, "?", intent, "Patient Case K-52", None)], "execution_id string, sub_question_id int, question string, intent string, primary_subject string, canonical_relation string")
    rows = derive.bootstrap(targets, spark.createDataFrame([("e", CHART)], "execution_id string, context string")).collect()
    assert {(r["relation"], r["object"]) for r in rows} == expected and {r["subject"] for r in rows} == {"Patient Case K-52"}


def test_presidents(spark):
    targets = spark.createDataFrame([("e", 1, "Who was president at the time?", "president_at_time", "Apollo 11", None)], "execution_id string, sub_question_id int, question string, intent string, primary_subject string, canonical_relation string")
    none = spark.createDataFrame([], FACTS)
    context = "The national goal was set by President Kennedy in May 1961. On the lunar surface they spoke by telephone with President Nixon."
    rows = derive.derive(targets, spark.createDataFrame([("e", context)], "execution_id string, context string"), none).where("accepted").collect()
    assert [r["object"] for r in rows] == ["Nixon"]
    both = context + " President Johnson watched the moonwalk."
    assert derive.derive(targets, spark.createDataFrame([("e", both)], "execution_id string, context string"), none).where("accepted").isEmpty()


def test_labeled_fields(spark):
    answer = "Diagnosis: type 2 diabetes. Kidney disease: CKD stage 3b, eGFR 51 mL/min. Allergy: latex causing wheezing."
    asked = [(1, "What is the diagnosis?"), (2, "What CKD stage?"), (3, "What is the eGFR?"), (4, "Which allergy and reaction?")]
    answers = spark.createDataFrame([("e", answer)], "execution_id string, answer string")
    df = spark.createDataFrame([("e", *a) for a in asked], "execution_id string, sub_question_id int, question string")
    got = {r["sub_question_id"]: r["value"] for r in fields.project(answers, df, ["execution_id"]).collect()}
    assert got == {1: "type 2 diabetes", 2: "CKD stage 3b", 3: "51 mL/min", 4: "latex causing wheezing"}


def test_bootstrap_reads_contexts_once(spark):
    from claimloom.operators import derive

    context = "Patient Case 1 has condition X disease. A1C is 7%. Alpha 10 mg daily remains active. The allergy list records Beta causing rash."
    contexts = spark.createDataFrame([("e", context)], "execution_id string, context string")
    rows = [("e", k, i, None) for k, i in enumerate(("diagnosis", "lab_measurement", "active_medication_with_dose", "allergy", "general"))]
    targets = spark.createDataFrame(rows, "execution_id string, sub_question_id int, intent string, primary_subject string")
    found = derive.bootstrap(targets, contexts)
    got = {(r["sub_question_id"], r["ord"]): (r["relation"], r["object"]) for r in found.collect()}
    assert got == {(0, 0): ("diagnosed_with", "condition X disease"), (1, 0): ("has_a1c", "7%"), (2, 0): ("active_medication", "Alpha"), (2, 1): ("daily_dose", "10 mg daily"), (3, 0): ("allergic_to", "Beta")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_carried_norms_are_the_normalizers(spark):
    """Relations that are in their normal form already take a shorter way to the same."""
    names = ["located_in", "is_part_of", "was", "is_", "Located In", "a__b", "_a", "a_", "a\n", "a-b", "x2_3", "been_is_a", "isolated_at", "é_in", "", " ", None]
    df = spark.createDataFrame([(f"The {n}#!", n, n) for n in names], "subject string, relation string, object string")
    rows = T.normed(df).withColumns({"s": T.normalize("subject"), "r": T.normalize_relation("relation"), "o": T.normalize("object")}).collect()
    assert [(x["__s"], x["__r"], x["__o"]) for x in rows] == [(x["s"], x["r"], x["o"]) for x in rows]
