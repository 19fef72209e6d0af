"""Question intents and the relations that answer them.

Relations are compared after normalize_relation(), which drops one leading auxiliary; members that begin with one ("was_...") are
listed as they are defined and can't be met by a normalized relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import normalize_relation

#: Relations of each intent.
FAMILIES: dict[str, tuple[str, ...]] = {
    "occurrence_date": ("date_range", "dates", "dates_of_mission", "mission_dates", "occurred_between", "occurred_during", "occurred_from"),
    "crew_members": ("crew", "crew_members", "crewed_by", "was_crewed_by", "was_crewmember_on"),
    "launch_site": ("launch_location", "launch_site", "launched_at", "launched_from", "was_launched_from"),
    "launch_vehicle": ("launch_rocket", "launch_vehicle", "launched_by", "launched_with"),
    "president_at_time": ("president_at_time", "president_during", "was_president_at_time"),
    "collection_amount": ("amount_collected", "collected", "collected_lunar_material", "lunar_material_collected"),
    "birthplace": ("birth_city", "birth_place", "birth_town", "birthplace", "born_at", "born_in", "place_of_birth"),
    "manufacturer": ("builder", "built_by", "constructed_by", "made_by", "manufactured_by", "manufacturer", "produced_by"),
    "leader": ("commanded_by", "governed_by", "headed_by", "leader", "led_by", "ruled_by"),
    "headquarters": ("based_in", "headquartered_in", "headquarters", "headquarters_in"),
    "location_containment": ("contains", "in_country", "in_region", "in_state", "located_in", "part_of", "situated_in", "within"),
    "capital_city": ("capital", "capital_city", "capital_in", "capital_of", "has_capital", "has_capital_in"),
    "diagnosis": ("condition", "diagnosed_with", "diagnosis", "has_condition", "has_diagnosis"),
    "lab_measurement": ("a1c", "a1c_value", "has_a1c", "hemoglobin_a1c", "lab_value", "measured_value"),
    "disease_stage": ("ckd_stage", "disease_stage", "has_ckd_stage", "has_stage", "renal_stage", "stage"),
    "renal_measurement": ("egfr", "egfr_value", "has_egfr", "kidney_function_measurement", "renal_measurement"),
    "medication_discontinued": ("discontinued", "discontinued_medication", "medication_discontinued", "stopped", "stopped_medication"),
    "discontinuation_reason": ("adverse_effect", "discontinuation_reason", "discontinued_because", "intolerance_reason", "stopped_because"),
    "active_medication": ("active_medication", "currently_taking", "medication_tolerated", "taking", "tolerated"),
    "medication_dose": ("daily_dose", "dose", "has_dose", "prescribed_dose"),
    "discussed_not_started": ("considered", "discussed", "discussed_not_started", "future_option", "planned_not_started"),
    "allergy": ("allergic_to", "allergy", "has_allergy", "medication_allergy"),
    "allergic_reaction": ("allergic_reaction", "allergy_reaction", "causes_reaction", "reaction"),
}

#: Intents with several attributes, and their slots in order: intent, relation, extractor.
SLOTS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "kidney_status": (("disease_stage", "has_ckd_stage", "ckd_stage"), ("renal_measurement", "has_egfr", "egfr")),
    "discontinued_medication_with_reason": (("medication_discontinued", "discontinued_medication", "stopped_med"), ("discontinuation_reason", "discontinued_because", "stop_reason")),
    "active_medication_with_dose": (("active_medication", "active_medication", "active_med"), ("medication_dose", "daily_dose", "dose")),
    "allergy_with_reaction": (("allergy", "allergic_to", "allergen"), ("allergic_reaction", "causes_reaction", "reaction")),
}
FAMILIES |= {intent: tuple(r for slot, _, _ in slots for r in FAMILIES[slot]) for intent, slots in SLOTS.items()}

#: The relation that stands for an intent.
CANONICAL = {
    "occurrence_date": "occurred_during",
    "crew_members": "crewed_by",
    "launch_site": "launched_from",
    "launch_vehicle": "launched_by",
    "president_at_time": "president_at_time",
    "collection_amount": "collected",
    "birthplace": "born_in",
    "manufacturer": "built_by",
    "leader": "led_by",
    "headquarters": "headquartered_in",
    "location_containment": "located_in",
    "capital_city": "capital",
    "diagnosis": "diagnosed_with",
    "lab_measurement": "has_a1c",
    "disease_stage": "has_ckd_stage",
    "renal_measurement": "has_egfr",
    "medication_discontinued": "discontinued_medication",
    "discontinuation_reason": "discontinued_because",
    "active_medication": "active_medication",
    "medication_dose": "daily_dose",
    "discussed_not_started": "discussed_not_started",
    "allergy": "allergic_to",
    "allergic_reaction": "causes_reaction",
} | {intent: slots[0][1] for intent, slots in SLOTS.items()}

#: The slots that composite intents are made of.
SLOT_INTENTS = tuple(dict.fromkeys(slot for slots in SLOTS.values() for slot, _, _ in slots))

#: Relations near a presidency that don't state it; out of every family.
PRESIDENT_PROXIES = ("fulfilled_goal_set_by", "goal_set_by", "held_title", "national_goal_set_by", "spoke_with")

#: All relations that answer some intent, or from which a president is derived.
ANSWERS = tuple(sorted({r for found in FAMILIES.values() for r in found} | set(PRESIDENT_PROXIES)))

_STATUS = {"medication_discontinued", "active_medication", "discussed_not_started"}


def _others(own: str) -> tuple[str, ...]:
    return tuple(sorted(r for status in _STATUS - {own} for r in FAMILIES[status]))


#: Medication statuses exclude each other.
EXCLUDED = {status: _others(status) for status in sorted(_STATUS)}
EXCLUDED |= {"discontinued_medication_with_reason": EXCLUDED["medication_discontinued"], "active_medication_with_dose": EXCLUDED["active_medication"]}

#: Relations by which an engine drives something.
ENGINE_POWER = ("equipped_with", "powered", "powered_by", "powered_with", "used", "uses", "uses_engine")

#: Subjects that only point back to the question's own.
WEAK_SUBJECTS = ("chart", "the chart", "patient", "the patient", "context", "record")


def composite(intent: Column) -> Column:
    return intent.isin(list(SLOTS))


def _by_intent(table: dict[str, tuple[str, ...]], intent: Column, relation: Column) -> Column:
    """Whether the normalized relation is listed under the intent; one array lookup, whatever the number of intents."""
    listed = F.array(*[F.lit(f"{i}|{r}") for i, members in table.items() for r in members])
    return F.array_contains(listed, F.concat(intent, F.lit("|"), relation))


def _known(intent: Column) -> Column:
    return intent.isin(list(FAMILIES))


def in_family(relation: Column, intent: Column) -> Column:
    """relation (as it is) answers the intent; for an intent without a family everything does."""
    rel = normalize_relation(relation)
    return ~_known(intent) | (_by_intent(FAMILIES, intent, rel) & ~rel.isin(list(PRESIDENT_PROXIES)) & ~_by_intent(EXCLUDED, intent, rel))


def members(intent: Column) -> Column:
    """The normalized relations that answer an intent, null for one without a family: those for which in_family() holds."""
    answers = {i: [r for r in dict.fromkeys(found) if r not in PRESIDENT_PROXIES and r not in EXCLUDED.get(i, ())] for i, found in FAMILIES.items()}
    table = F.create_map(*[x for i, found in answers.items() for x in (F.lit(i), F.array(*[F.lit(r) for r in found]))])
    return F.try_element_at(table, intent)


def slot_of(relation: Column) -> Column:
    """The slot of a relation, null if none."""
    rel = normalize_relation(relation)
    out = F.lit(None).cast("string")
    for slot in reversed(SLOT_INTENTS):
        out = F.when(rel.isin(list(FAMILIES[slot])), F.lit(slot)).otherwise(out)
    return out


def same_family(left: Column, right: Column, intent: Column) -> Column:
    """Both relations answer the intent: composite intents go by slot, unknown ones by equality."""
    a, b = normalize_relation(left), normalize_relation(right)
    plain = _by_intent(FAMILIES, intent, a) & _by_intent(FAMILIES, intent, b) & ~_by_intent(EXCLUDED, intent, a) & ~_by_intent(EXCLUDED, intent, b)
    return F.when(composite(intent), F.coalesce(slot_of(left) == slot_of(right), F.lit(False))).when(_known(intent), plain).otherwise(a == b)


def canonical_relation(intent: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, relation in CANONICAL.items():
        out = F.when(intent == name, F.lit(relation)).otherwise(out)
    return out


def intents_table(spark: SparkSession) -> DataFrame:
    """intent, relation, canonical, excluded: the registry as a dimension table."""
    rows = [(i, r, CANONICAL[i], False) for i, members in FAMILIES.items() for r in members] + [(i, r, CANONICAL[i], True) for i, members in EXCLUDED.items() for r in members]
    return spark.createDataFrame(rows, "intent string, relation string, canonical string, excluded boolean")
