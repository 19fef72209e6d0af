"""Model output and benchmark files as typed rows; what can't be read goes to quarantine with a reason.

JSON is parsed into VARIANT values, so each item keeps whatever shape it has until it is coerced. Only closing the brackets of a
truncated text needs a small function in Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimloom.functions.text import strip, without_fences

#: Other names for a triple's fields, in the order in which they are looked for.
ALIASES = {"subject": ("subject", "subj", "s"), "relation": ("relation", "predicate", "pred", "p", "relationship"), "object": ("object", "obj", "object_value", "o", "value")}
FACT_HEADER, CLAIM_HEADER = ("subject", "relation", "object", "evidence"), ("subject", "relation", "object", "source_sentence")


def _closed(text: str) -> str:
    """The text with the brackets closed that are still open at its end; brackets within strings don't count."""
    open_, quoted, skip = [], False, False
    for ch in text:
        if skip:
            skip = False
        elif quoted:
            quoted, skip = ch != '"', ch == "\\"
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            open_.append("}" if ch == "{" else "]")
        elif open_ and ch == open_[-1]:
            open_.pop()
    return text + "".join(reversed(open_))


@F.pandas_udf(StringType())
def close_brackets(texts: pd.Series) -> pd.Series:
    return texts.map(_closed, na_action="ignore")


def json_object(c: Column | str) -> Column:
    """The JSON object in a text, as VARIANT: from the first brace to the end, else to the last brace, else with brackets closed. Null if there is none."""
    text = without_fences(c)
    whole = F.nullif(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(""))
    inner = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    found = F.coalesce(F.try_parse_json(whole), F.try_parse_json(inner), F.try_parse_json(close_brackets(whole)))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def _field(item: Column, names: tuple[str, ...]) -> tuple[Column, Column]:
    """The first of the names that is present (as JSON text, which keeps a null apart from nothing), and that name."""
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    keys = F.coalesce(F.json_object_keys(F.to_json(item)), F.array().cast("array<string>"))
    for n in reversed(names):
        there = F.array_contains(keys, n)
        name = F.when(there, F.lit(n)).otherwise(name)
        value = F.when(there, F.coalesce(F.to_json(F.try_variant_get(item, f"$.{n}", "variant")), F.lit("null"))).otherwise(value)
    return value, name


def _text(raw: Column, name: str) -> tuple[Column, Column]:
    """A value's text, and why it isn't one. raw: JSON text, null for nothing."""
    kind = F.when(raw.isNull() | (raw == "null"), "null").when(raw.isin("true", "false"), "bool").when(raw.startswith('"'), "string").when(raw.startswith("["), "list").when(raw.startswith("{"), "dict").otherwise("number")
    plain = F.when(kind == "string", strip(F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))).when(kind == "number", raw)
    dump = plain.rlike(r"(?s)^(\[.*\]|\{.*\})$") & plain.rlike("['\":,]")
    why = (
        F.when(kind == "null", f"{name}_null")
        .when(kind == "bool", f"{name}_unsupported_bool")
        .when(kind.isin("list", "dict"), F.concat(F.lit(f"{name}_unsupported_"), kind))
        .when(F.coalesce(plain, F.lit("")) == "", f"{name}_empty")
        .when((kind == "string") & (plain == "None"), f"{name}_null_string")
        .when((kind == "string") & dump, f"{name}_container_repr")
    )
    return plain, why


def coerce_triples(items: DataFrame, item: str = "item", kind: str = "fact") -> DataFrame:
    """Adds subject, relation, object, evidence, source_sentence, normalizations, reason to rows with a VARIANT item; reason is null for good ones."""
    v = F.col(item)
    shape = F.schema_of_variant(v)
    is_list, is_dict = shape.startswith("ARRAY"), shape.startswith("OBJECT")
    rows = items.withColumns({"__list": is_list, "__dict": is_dict})
    n = F.coalesce(F.json_array_length(F.when(F.col("__list"), F.to_json(v))), F.lit(0))
    cols, names = {}, {}
    for k, (field, aliases) in enumerate(ALIASES.items()):
        value, name = _field(F.when(F.col("__dict"), v), aliases)
        at = F.when(F.col("__list") & (n > k), F.coalesce(F.to_json(F.try_variant_get(v, f"$[{k}]", "variant")), F.lit("null")))
        cols[f"__{field}"], names[field] = F.coalesce(value, at), name
    rows = rows.withColumns(cols | {f"__{f}_key": c for f, c in names.items()} | {"__n": n})
    rows = rows.withColumns({f: _text(F.col(f"__{f}"), f)[0] for f in ALIASES} | {f"__{f}_why": _text(F.col(f"__{f}"), f)[1] for f in ALIASES})
    c = F.col
    no_key = c("__dict") & c("__subject_key").isNull() & c("__relation_key").isNull() & c("__object_key").isNull()
    object_why = (
        F.when(c("__dict") & c("__object_key").isNull(), "missing_third_element")
        .when(c("__object_why") == "object_null", "null_object")
        .when(c("__object_why") == "object_empty", "empty_object")
        .when(c("__object_why").startswith("object_unsupported"), "object_unsupported_nested_value")
        .otherwise(c("__object_why"))
    )
    reason = F.coalesce(
        F.when(c("__list") & (c("__n") < 3), "malformed_array_too_short"),
        F.when(c("__list") & (c("__n") > 4), "malformed_array_extra_positional_fields"),
        F.when(~F.coalesce(c("__list") | c("__dict"), F.lit(False)), "unsupported_triple_item_type"),
        F.when(no_key, "dictionary_missing_triple_keys"),
        object_why,
        c("__relation_why"),
        c("__subject_why"),
        F.when(c("object") == c("relation"), "object_copied_from_relation"),
        F.when((c("subject") == c("object")) & (F.lower("relation") == F.lower("subject")), "subject_relation_object_position_swap"),
    )
    renamed = [F.when(c(f"__{f}_key") != f, F.concat(F.lit("alias_"), c(f"__{f}_key"), F.lit(f"_to_{f}"))) for f in ALIASES]
    fourth = F.when(c("__list") & (c("__n") == 4), F.try_variant_get(v, "$[3]", "string"))
    own = {f: F.nullif(strip(F.coalesce(F.when(c("__dict"), F.try_variant_get(v, f"$.{f}", "string")), fourth if f == ("evidence" if kind == "fact" else "source_sentence") else F.lit(None))), F.lit("")) for f in ("evidence", "source_sentence")}
    rows = rows.withColumns({"reason": reason, "normalizations": F.array_compact(F.array(F.when(c("__list"), "positional_array"), *renamed))} | own)
    return rows.drop(*[x for x in rows.columns if x.startswith("__")])


def json_triples(responses: DataFrame, text: str = "text", kind: str = "fact") -> DataFrame:
    """A row for each item of the "triples" of a response, good or not, with its ord; and for a response without any usable item a row without triple whose batch_error says why."""
    rows = responses.withColumn("__v", json_object(text)).withColumn("__items", F.try_variant_get("__v", "$.triples", "array<variant>"))
    fault = F.when(F.col("__v").isNull(), "No JSON object found.").when(F.col("__items").isNull(), "JSON must contain a 'triples' list.")
    rows = rows.withColumn("__fault", fault)
    keys = responses.columns
    bad = rows.where("__fault is not null").select(*keys, F.col("__fault").alias("batch_error"))
    items = rows.where("__fault is null").select(*keys, F.posexplode("__items").alias("ord", "item"))
    good = coerce_triples(items, kind=kind)
    return good.unionByName(bad, allowMissingColumns=True)


def rejected_batches(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """keys of responses all of whose items were rejected."""
    return decoded.where("batch_error is null").groupBy(*keys).agg(F.count_if(F.col("reason").isNull()).alias("good")).where("good = 0").drop("good")


def csv_rows(responses: DataFrame, header: tuple[str, ...] = FACT_HEADER, text: str = "text") -> DataFrame:
    """A row for each line below the exact header (case aside), blank ones left out: ord and the header's fields; batch_error where a response breaks a rule.

    One bad line rejects its whole response, as do a missing header and no lines at all.
    """
    keys = responses.columns
    lines = F.filter(F.split(without_fences(text), "\r?\n"), lambda x: strip(x) != "")
    schema = ", ".join(f"{h} string" for h in header)
    rows = responses.withColumn("__lines", lines).withColumn("__ok", F.coalesce(strip(F.lower(F.get("__lines", F.lit(0)))) == ",".join(header), F.lit(False)))
    body = rows.where("__ok").select(*keys, F.posexplode(F.slice("__lines", F.lit(2), F.greatest(F.size("__lines") - 1, F.lit(0)))).alias("ord", "line")).select(*keys, "ord", F.from_csv("line", schema).alias("r"))
    body = body.select(*keys, "ord", *[F.coalesce(strip(F.col(f"r.{h}")), F.lit("")).alias(h) for h in header])
    body = body.where(" or ".join(f"{h} <> ''" for h in header))
    missing = " or ".join(f"{h} = ''" for h in header[:3])
    faulty = body.groupBy(*keys).agg(F.min(F.when(F.expr(missing), F.col("ord"))).alias("bad"))
    good = body.join(faulty.where("bad is null").drop("bad"), keys, "left_semi") if keys else body
    errors = rows.join(faulty, keys, "left").select(
        *keys,
        F.when(F.size("__lines") == 0, "Empty CSV response.")
        .when(~F.col("__ok"), F.lit(f"CSV must start with header row: {','.join(header)}"))
        .when(F.col("bad").isNotNull(), F.format_string("CSV row %d: subject, relation, and object are required.", (F.col("bad") + 2).cast("int")))
        .when(F.size("__lines") < 2, "CSV contains no data rows.")
        .alias("batch_error"),
    )
    return good.unionByName(errors.where("batch_error is not null"), allowMissingColumns=True)


def looks_like_csv(text: Column | str, header: tuple[str, ...]) -> Column:
    return F.coalesce(strip(F.lower(F.get(F.split(without_fences(text), "\r?\n"), F.lit(0)))) == ",".join(header), F.lit(False))


def triples(responses: DataFrame, kind: str = "fact", text: str = "text") -> DataFrame:
    """Facts or claims of responses in either format: CSV where the first line is its header, else JSON."""
    header = FACT_HEADER if kind == "fact" else CLAIM_HEADER
    is_csv = looks_like_csv(text, header)
    return csv_rows(responses.where(is_csv), header, text).unionByName(json_triples(responses.where(~is_csv), text, kind), allowMissingColumns=True)


def numbered(responses: DataFrame, field: str, value: str, text: str = "text") -> DataFrame:
    """Sub-questions or projected answers: a row for each {"id": n, value: ...} of a list whose ids are 1 to n, each once; batch_error otherwise."""
    keys = responses.columns
    item = F.from_json(F.to_json(F.try_variant_get(json_object(text), f"$.{field}", "variant")), f"array<struct<id:string,{value}:string>>")
    rows = responses.withColumn("__items", F.array_sort(item, lambda a, b: F.coalesce(a["id"].try_cast("int") - b["id"].try_cast("int"), F.lit(0))))
    ids = F.transform("__items", lambda x: x["id"].try_cast("int"))
    fault = (
        F.when(F.coalesce(F.size("__items"), F.lit(0)) < 1, F.lit(f"'{field}' must be a non-empty list."))
        .when(F.exists("__items", lambda x: F.coalesce(strip(x[value]), F.lit("")) == ""), F.lit(f"an item has no {value}"))
        .when(~F.coalesce(ids == F.sequence(F.lit(1), F.size("__items")), F.lit(False)), "ids must be unique and run from 1")
    )
    rows = rows.withColumn("batch_error", fault)
    good = rows.where("batch_error is null").select(*keys, F.explode("__items").alias("x")).select(*keys, F.col("x.id").cast("int").alias("id"), strip(F.col(f"x.{value}")).alias(value))
    return good.unionByName(rows.where("batch_error is not null").select(*keys, "batch_error"), allowMissingColumns=True)


# files


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, question string, context string, initial_answer string").option("multiLine", True).json(path)


BENCHMARK = (
    "title string, domain string, root_entity string, trusted_context string, expected_graph_facts array<variant>, "
    "questions array<struct<id:string,hop_count:int,question:string,expected_answer:string,expected_path:array<array<string>>,required_entities:array<string>,required_relations:array<string>>>"
)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK).option("multiLine", True).json(path)


def benchmark_catalog(benchmarks: DataFrame, key: str = "benchmark_id") -> DataFrame:
    """key, title, domain, question_count, hops (map of hop to questions)."""
    per_hop = benchmarks.select(key, F.explode("questions").alias("q")).groupBy(key, F.col("q.hop_count").alias("hop")).agg(F.count(F.lit(1)).alias("n"))
    hops = per_hop.groupBy(key).agg(F.sum("n").alias("question_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("hop", "n")))).alias("hops"))
    return benchmarks.select(key, "title", "domain").join(hops, key)


def benchmark_questions(benchmarks: DataFrame, key: str = "benchmark_id", hop: int | None = None) -> DataFrame:
    """key, id, hop_count, question: nothing that scores an answer."""
    rows = benchmarks.select(key, F.explode("questions").alias("q")).select(key, "q.id", "q.hop_count", "q.question")
    return rows if hop is None else rows.where(F.col("hop_count") == hop)


def benchmark_facts(benchmarks: DataFrame, key: str = "benchmark_id") -> DataFrame:
    """key, ord, subject, relation, object of facts given as arrays of three or as objects; others are left out."""
    rows = benchmarks.select(key, F.posexplode("expected_graph_facts").alias("ord", "f"))
    part = lambda k, name: F.coalesce(F.try_variant_get("f", f"$[{k}]", "string"), F.try_variant_get("f", f"$.{name}", "string"))
    return rows.select(key, F.col("ord").cast("long").alias("ord"), *[part(k, n).alias(n) for k, n in enumerate(("subject", "relation", "object"))]).dropna(subset=["subject", "relation", "object"])


def prior_results(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Rows of an earlier run; the last of each id, nothing for a line that can't be read."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("__at", F.monotonically_increasing_id()).where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c not in (key, "__at", "_bad")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "__at").alias("r")).select(key, "r.*")


def legacy_triples(responses: DataFrame, text: str = "text") -> DataFrame:
    """Triples of the older format, from the first brace to the last, taken as they are; a missing field fails the job."""
    schema = "struct<triples:array<struct<subject:string,relation:string,object:string>>>"
    body = F.from_json(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0), schema, {"mode": "FAILFAST"})
    rows = responses.select(*responses.columns, F.posexplode(body["triples"]).alias("ord", "t"))
    need = lambda n: F.coalesce(F.col(f"t.{n}"), F.raise_error(F.lit(f"triple without {n}")).cast("string"))
    return rows.select(*responses.columns, "ord", *[need(n).alias(n) for n in ("subject", "relation", "object")])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a manifest, which is a list or an object with one."""
    source = "source_id string, title string, organization string, publication_date string, url string, local_extracted_file string, sha256 string, retrieval_date string, notes string"
    whole = spark.read.text(path, wholetext=True)
    fields = ",".join(":".join(f.split()) for f in source.split(", "))
    v = F.try_parse_json("value")
    listed = F.coalesce(F.try_variant_get(v, "$.sources", "variant"), v)
    rows = whole.select(F.explode(F.from_json(F.to_json(listed), f"array<struct<{fields}>>")).alias("s"))
    return rows.select("s.*")


def read_template(spark: SparkSession, path: str) -> str:
    """A prompt template, as it is."""
    return spark.read.text(path, wholetext=True).first()[0]
