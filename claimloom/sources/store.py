"""Facts and claims of executions as Parquet tables, dealt out by a hash of the execution.

An execution's rows are in one bucket, so a read of one execution opens that bucket's files alone, and any number of executions makes no
more buckets. Facts are upserted (the last write of a key wins), claims are appended. Writers may work at the same time: each write is a new version of its table
(see versions.py), and a writer whose buckets another one has changed meanwhile merges again. Readers keep the version they began with.

Claims are also listed by example: `examples` has the executions of each example, bucketed by a hash of the example, so claims of an example are read from its
executions' buckets, however many others there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import rendered
from claimloom.sources.versions import Versions

FACTS = "execution_id string, subject string, relation string, object string, provenance string, stage string, evidence string, created_order long, sub_question_id int, evidence_spans array<string>, extraction_scope string"
CLAIMS = "execution_id string, example_id string, sub_question_id int, iteration int, stage string, ord long, subject string, relation string, object string, label string, reason string, conflicting_fact string"
FACT_KEY = ["execution_id", "subject", "relation", "object", "provenance", "stage", "extraction_scope"]
EXAMPLES = "example_id string, execution_id string"
BAD = ("CONTRADICTED", "NO_EVIDENCE", "NOT_ENOUGH_INFO")


class Store:
    """enabled=False makes every write and read do nothing, unless required."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, enabled: bool = True):
        self.spark, self.folder, self.buckets, self.enabled = spark, folder.rstrip("/"), buckets, enabled

    def guard(self, required: bool = False) -> bool:
        if not self.enabled and required:
            raise RuntimeError("the store is disabled")
        return self.enabled

    def _bucket(self, key: str = "execution_id"):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _versions(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.folder}/{name}")

    def _buckets_of(self, values: list[str]) -> set[str]:
        """The buckets of some executions or examples."""
        rows = self.spark.createDataFrame([(v,) for v in values], "v string")
        return {str(r[0]) for r in rows.select(self._bucket("v")).distinct().collect()}

    def _read(self, name: str, schema: str, buckets: set[str] | None = None) -> DataFrame:
        """The rows of the newest version, of some buckets alone if they are given."""
        table = self._versions(name)
        return table.read(schema, [e for e in table.latest()[1] if buckets is None or e[0] in buckets])

    def _mine(self, name: str, schema: str, execution_id: str) -> DataFrame:
        return self._read(name, schema, self._buckets_of([execution_id])).where(F.col("execution_id") == execution_id)

    def all_facts(self) -> DataFrame:
        return self._read("facts", FACTS)

    def all_claims(self) -> DataFrame:
        return self._read("claims", CLAIMS)

    def _fit(self, df: DataFrame, schema: str) -> DataFrame:
        fields = [part.strip().split(" ", 1) for part in schema.split(", ")]
        return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])

    def write_claims(self, claims: DataFrame, required: bool = False) -> None:
        """Append; a missing stage is answer_<iteration>, a conflicting fact is written out."""
        if not self.guard(required):
            return
        if "conflicting_fact" in claims.columns and claims.schema["conflicting_fact"].dataType.typeName() == "struct":
            c = F.col("conflicting_fact")
            claims = claims.withColumn("conflicting_fact", F.when(c.isNotNull(), rendered(c["subject"], c["relation"], c["object"])))
        rows = self._fit(claims, CLAIMS)
        rows = rows.withColumn("stage", F.coalesce("stage", F.concat(F.lit("answer_"), F.col("iteration").cast("string"))))
        self._append("claims", rows.withColumn("bucket", self._bucket()))
        # an execution of an example is listed once a write; readers take each once
        listed = rows.where("example_id is not null").select("example_id", "execution_id").distinct()
        self._append("examples", listed.withColumn("bucket", self._bucket("example_id")))

    def _append(self, name: str, rows: DataFrame) -> None:
        table = self._versions(name)
        new = table.parts(table.write(rows, "bucket"), "bucket")
        table.commit(lambda entries: [*entries, *new] if new else None)

    def upsert_facts(self, facts: DataFrame, order: str = "ord", required: bool = False) -> None:
        """Write facts; of rows with equal keys the last one stays. Only the buckets of these executions are written anew. created_order is the place among an execution's facts, unless given."""
        from pyspark.sql import Window

        from claimloom.operators.merge import upsert
        from claimloom.sources.shared import cut

        if not self.guard(required):
            return
        if "created_order" not in facts.columns:
            facts = facts.withColumn("created_order", F.row_number().over(Window.partitionBy("execution_id").orderBy(order)) - 1)
        new = self._fit(facts, FACTS).withColumns({"evidence": F.coalesce("evidence", F.lit("")), "provenance": F.coalesce("provenance", F.lit("trusted_context")), "stage": F.coalesce("stage", F.lit("context"))}).withColumn("bucket", self._bucket())
        new = cut(new)
        table, touched = self._versions("facts"), {str(r[0]) for r in new.select("bucket").distinct().collect()}
        merged = {}  # what was merged with, and the parts that came of it

        def change(entries):
            old = [e for e in entries if e[0] in touched]
            if merged.get("with") != old:  # another writer changed these buckets, or nothing was merged yet
                rows = upsert(table.read(FACTS, old).withColumn("bucket", self._bucket()), new, FACT_KEY, "created_order")
                merged.update({"with": old, "parts": table.parts(table.write(rows, "bucket"), "bucket")})
            return [*(e for e in entries if e[0] not in touched), *merged["parts"]] if touched else None

        table.commit(change)

    def facts(self, execution_id: str) -> DataFrame:
        """In the order in which they were made; evidence that is empty is null."""
        rows = self._mine("facts", FACTS, execution_id)
        return rows.withColumn("evidence", F.nullif("evidence", F.lit(""))).orderBy("created_order", "subject", "relation", "object")

    def claims(self, execution_id: str, limit: int = 200) -> DataFrame:
        rows = self._mine("claims", CLAIMS, execution_id)
        return rows.orderBy(F.asc_nulls_last("sub_question_id"), F.asc_nulls_last("iteration"), "ord").limit(limit)

    def claims_of_example(self, example_id: str, limit: int = 200) -> DataFrame:
        listed = self._read("examples", EXAMPLES, self._buckets_of([example_id])).where(F.col("example_id") == example_id)
        executions = listed.select("execution_id").distinct()
        buckets = {str(r[0]) for r in executions.select(self._bucket()).distinct().collect()}
        rows = self._read("claims", CLAIMS, buckets).where(F.col("example_id") == example_id)
        return rows.orderBy("execution_id", F.asc_nulls_last("sub_question_id"), F.asc_nulls_last("iteration"), "ord").limit(limit)

    def bad_claims(self, execution_id: str, limit: int = 200) -> DataFrame:
        rows = self._mine("claims", CLAIMS, execution_id).where(F.col("label").isin(*BAD))
        return rows.orderBy(F.asc_nulls_last("sub_question_id"), F.asc_nulls_last("iteration"), "ord").limit(limit)

    def summary(self, execution_id: str) -> dict:
        """entities, facts, claims, labels (label to number)."""
        facts, claims = self._mine("facts", FACTS, execution_id), self._mine("claims", CLAIMS, execution_id)
        names = facts.select(F.explode(F.array("subject", "object")).alias("n")).unionAll(claims.select(F.explode(F.array("subject", "object"))))
        labels = {r["label"]: r["count"] for r in claims.groupBy("label").count().collect()}
        return {"entities": names.distinct().count(), "facts": facts.count(), "claims": sum(labels.values()), "labels": labels}

    def delete(self, execution_id: str) -> int:
        """Remove an execution; returns how many names it had. Files of older versions stay until vacuum()."""
        gone, touched = self.summary(execution_id)["entities"], self._buckets_of([execution_id])
        for name, schema, key in (("facts", FACTS, "execution_id"), ("claims", CLAIMS, "execution_id"), ("examples", EXAMPLES, "example_id")):
            self._rewrite(name, schema, key, touched if key == "execution_id" else None, F.col("execution_id") != execution_id)
        return gone

    def _rewrite(self, name: str, schema: str, key: str, buckets: set[str] | None, kept) -> None:
        table = self._versions(name)
        done = {}

        def change(entries):
            old = [e for e in entries if buckets is None or e[0] in buckets]
            if not old:
                return None
            if done.get("of") != old:
                rows = table.read(schema, old).where(kept).withColumn("bucket", self._bucket(key))
                done.update({"of": old, "parts": table.parts(table.write(rows, "bucket"), "bucket")})
            return [*(e for e in entries if e not in old), *done["parts"]]

        table.commit(change)

    def compact(self) -> None:
        """Put the files that appends left in each bucket together."""
        for name, schema, key in (("claims", CLAIMS, "execution_id"), ("examples", EXAMPLES, "example_id")):
            self._rewrite(name, schema, key, None, F.lit(True))

    def delete_all(self) -> None:
        """Remove every execution."""
        for name in ("facts", "claims", "examples"):
            self._versions(name).commit(lambda entries: [] if entries else None)

    def vacuum(self) -> int:
        """Delete files that the newest versions don't have; returns how many folders. Only when nobody reads or writes."""
        return sum(self._versions(name).vacuum() for name in ("facts", "claims", "examples"))
