"""The thin queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import alignment, decontaminate, langid, minhash, neighbours, packing, phrases, pieces, quality, secrets, substrings, toxicity, warc
from claimloom.llm.base import keep, small_batches, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_chunks(warc.write(table(spark, sf_dir, "pages"), warc.new_folder(spark))).where("last")
    response = F.col("record_type") == "response"
    # a response's figures are those of the payload that was read back; a revisit has none, and states its response's
    return records.select(
        F.col("record_id").alias("page_id"),
        F.when(response, F.col("n_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.samples(spark))
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.fit(docs, labels, {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return toxicity.predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(~langid.held_out()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, language_model(docs)).withColumn("held_out", langid.held_out())


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.trim(table(spark, sf_dir, "documents"), batches=4).drop("kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return alignment.rate(keep(found.withColumn("groups_sha256", digest).drop("groups"), "aligned"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = table(spark, sf_dir, "documents").select("doc_id", pieces.encode("text", path).alias("ids"))
    decoded = encoded.withColumn("decoded", pieces.decode("ids", path))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_warc_round_trip, op3_secret_scan, op4_decontaminate, op5_packing, op6_toxicity, op7_language_id, op8_nearest_neighbours, op9_site_quality, op10_substring_dedup, op11_token_alignment, op12_sentencepiece, op13_collocations)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Where SQL can say it; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op1_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
twoway AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT reach.node, twoway.b FROM reach JOIN twoway ON twoway.a = reach.other),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON node = doc_id""",
    "op2_warc_round_trip": """WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, octet_length(encode(p.body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (k // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (body)""",
    "op4_decontaminate": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, spot.n, k FROM spot JOIN win ON spot.t = win.t AND spot.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 34], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
rep AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(k, k + 35)) AS p FROM win SEMI JOIN rep USING (t)) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) AS a ANTI JOIN (SELECT doc_id, unnest(g) AS p FROM gone) AS b USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_collocations": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS t, count(*)::HUGEINT AS a FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(t, ' ') AS w FROM f WHERE m > 1),
cut AS (SELECT c.*, k, l.a AS l, r.a AS r, (2000000 * c.a) // (l.a + r.a) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c
  JOIN f AS l ON l.lang = c.lang AND l.t = array_to_string(c.w[1:k], ' ') JOIN f AS r ON r.lang = c.lang AND r.t = array_to_string(c.w[k + 1:c.m], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY score, k) = 1),
inner_runs AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS t, max(a) AS longer FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY ALL),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.t) AS rank FROM best LEFT JOIN inner_runs USING (lang, t) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank::BIGINT AS rank, t AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang) USING (lang) WHERE rank <= 2000""",
}
