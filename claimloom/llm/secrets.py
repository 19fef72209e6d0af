"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

DataFrame and SQL functions only. A scan is one pass over the texts without any shuffle: the models are
a table of A * A numbers (A: size of the alphabet), so they go into the plan as a literal.

Defined results: a null or empty text has no spans; a text of any length is scanned whole; positions are
code points, the end exclusive; repeated rows are scanned each for itself; spans that begin together are in the order of
KINDS; further columns stay as they are, whatever their names (a column of the result's name is replaced); an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns: kind, Java pattern, group that has to be long enough, its least length.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Runs that cannot reach the least length need not be looked at one by one: same matches as BASE after dropping.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
KINDS = ("assign", "access", "hex", "markov")

#: The models' alphabet; everything else counts as the character "~".
ALPHABET = "~abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: What the models judge: runs of such characters, if a scan isn't told otherwise of at least so many.
CANDIDATE = r"[A-Za-z0-9+/_=-]"
CANDIDATE_LENGTH = 20
#: Mean log-likelihood ratio for each character (in nats) from which a run counts as random.
THRESHOLD = 0.35

#: Parts of ordinary identifiers; the labelled samples are combinations of them.
PARTS = (
    "get set user name index value count table query string number account order price total list item first last next previous create delete update "
    "insert select group filter window field column record buffer stream reader writer session config option default handler manager service client server "
    "request response message event listener factory builder parser format version control process thread worker queue cache memory storage file path folder "
    "image button label title header footer content document page section paragraph sentence word letter character language country region city street address "
    "customer product supplier payment invoice shipping delivery warehouse stock balance credit debit interest amount currency exchange market report summary "
    "calculate validate convert transform generate initialize connect disconnect open close read write send receive start stop pause resume begin finish "
    "international organisation responsibility understanding communication development environment information government community university application "
    "zeitung verwaltung gesellschaft entwicklung verantwortung bibliothek geschwindigkeit wissenschaft bonjour aujourd maintenant toujours gouvernement "
    "desarrollo conocimiento universidad gobierno ciudad trabajo siempre nunca palabra"
).split()


def samples(spark: SparkSession, n: int = 20_000) -> DataFrame:
    """n labelled samples of each class, made by rule: (sample string, random boolean)."""
    parts = F.array(*[F.lit(p) for p in PARTS])

    def pick(k: int) -> Column:
        return F.get(parts, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))).cast("int"))

    ids = spark.range(n, numPartitions=1)
    style = F.pmod(F.col("id"), F.lit(6))
    words = [pick(k) for k in range(4)]
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *words))
        .when(style == 1, F.concat(words[0], *[F.initcap(w) for w in words[1:]]))
        .when(style == 2, F.concat_ws("-", *words))
        .when(style == 3, F.upper(F.concat_ws("_", *words)))
        .when(style == 4, F.concat_ws("/", *words))
        .otherwise(F.concat(F.concat(*words), F.pmod(F.col("id"), F.lit(1000)).cast("string")))
    )
    digest = F.sha2(F.concat(F.lit("claimloom"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    drawn = F.when(style < 2, F.regexp_replace(base64, "[+/=]", "")).when(style < 4, base64).when(style == 4, digest).otherwise(F.upper(F.regexp_replace(base64, "[+/=]", "")))
    return ids.select(ordinary.alias("sample"), F.lit(False).alias("random")).unionAll(ids.select(drawn.alias("sample"), F.lit(True).alias("random")))


def _codes(s: Column) -> Column:
    """A string's characters as places in the alphabet, from 0."""
    return F.transform(F.split(s, "(?!^)(?=.)"), lambda c: F.greatest(F.instr(F.lit(ALPHABET), c) - 1, F.lit(0)))


def train(labelled: DataFrame, sample: str = "sample", random: str = "random", smoothing: float = 0.5, samples_at_most: int = 1_000_000) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for each pair of characters, A * A numbers.

    Counts character pairs of the labelled rows by a grouped sum; only the A * A * 2 sums reach the driver. Rows with a
    null sample or label are left out. At most samples_at_most rows are fitted on; further ones are not read.
    """
    size = len(ALPHABET)
    rows = labelled.select(F.col(sample).alias("s"), F.col(random).cast("boolean").alias("r")).where("s is not null and r is not null and length(s) > 1").limit(samples_at_most)
    pairs = rows.select("r", _codes(F.col("s")).alias("c")).select("r", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * size + b)).alias("pair"))
    counts = {False: [smoothing] * size * size, True: [smoothing] * size * size}
    for row in pairs.groupBy("r", "pair").count().collect():
        counts[row["r"]][row["pair"]] += row["count"]
    import math

    def log_p(c: list[float]) -> list[float]:
        return [math.log(c[a * size + b] / sum(c[a * size : (a + 1) * size])) for a in range(size) for b in range(size)]

    return [x - y for x, y in zip(log_p(counts[True]), log_p(counts[False]), strict=True)]


SPAN = "array<struct<start:int,kind:string,end:int,s:string>>"
#: How many array elements a fold takes at once: it appends to an array of that length, so a text's matches cost in proportion to their number.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_blocks(items: Column) -> Column:
    """The same elements as an array of arrays of BLOCK elements."""
    last = F.greatest(F.ceil(F.size(items) / BLOCK), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _fold(items: Column, start: Column, step, kind: str) -> Column:
    """step(state, item) gives the new state and an array of what the item adds; all that is added, in blocks (array<array<..>>, kind: type of the inner one)."""
    none = F.array().cast(kind)

    def one(acc: Column, item: Column) -> Column:
        state, added = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["added"], added).alias("added"))

    def block(acc: Column, items: Column) -> Column:
        return F.aggregate(items, F.struct(acc["state"].alias("state"), none.alias("added")), one, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["added"], F.array(x["added"])).alias("added")))

    return F.aggregate(_let(items, _in_blocks), F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("added")), block)["added"]


def _matches(text: Column, pattern: str, group: int, least: int, kind: str, strings: bool = False) -> Column:
    """array<struct<start, kind, end, s>> of a pattern's matches, leftmost first; s is the match, if strings. What lies between the matches gives their places."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.zip_with(found, judged, lambda w, j: F.struct(F.char_length(w).alias("w"), F.char_length(j).alias("j"), (w if strings else F.lit(None).cast("string")).alias("s")))
    items = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), pairs, lambda g, m: F.struct(g.alias("g"), m["w"].alias("w"), m["j"].alias("j"), m["s"].alias("s")))

    def step(at: Column, m: Column):
        start = at + m["g"]
        end = start + m["w"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["s"].alias("s")))
        return end, F.when(m["j"] >= least, span).otherwise(F.array().cast(SPAN))

    return F.flatten(_fold(items, F.lit(0), step, SPAN))


def _outside(runs: Column, base: Column, least: int) -> Column:
    """The runs that don't lie wholly inside a span of base, and the parts of runs outside such spans, if they are `least` characters long.

    Sorted together by start: upto is where the spans so far end, at where what is open of the last run begins.
    """
    def events(spans: Column, k: int, start=lambda x: x["start"]) -> Column:
        return F.transform(spans, lambda x: F.struct(start(x).alias("start"), F.lit(k).alias("k"), x.alias("span")))

    end = events(F.array(F.lit(None).cast(SPAN[6:-1])), 2, lambda x: F.lit(2**31 - 1))
    both = F.concat(events(base, 0), events(runs, 1), end)
    none = F.array().cast(SPAN)

    def step(state: Column, x: Column):
        span, run, at, upto = x["span"], state["run"], state["at"], state["upto"]
        to = F.least(x["start"], run["end"])
        part = F.struct(at.alias("start"), run["kind"].alias("kind"), to.alias("end"), F.substring(run["s"], at - run["start"] + 1, to - at).alias("s"))
        cut = F.when(run.isNotNull() & (to - at >= least) & ((at > run["start"]) | (to < run["end"])), F.array(part)).otherwise(none)
        whole = F.when((x["k"] == 1) & (span["end"] > upto), F.array(span)).otherwise(none)
        after = F.struct(
            F.when(x["k"] == 0, F.greatest(upto, span["end"])).otherwise(upto).alias("upto"),
            F.when(x["k"] == 1, F.greatest(upto, x["start"])).otherwise(F.greatest(at, span["end"])).alias("at"),
            F.when(x["k"] == 1, span).otherwise(run).alias("run"),
        )
        return after, F.concat(cut, whole)

    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("at"), F.lit(None).cast(SPAN[6:-1]).alias("run"))
    return F.flatten(_fold(F.array_sort(both), start, step, SPAN))


def scan(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD, out: str = "spans", least: int = CANDIDATE_LENGTH) -> DataFrame:
    """Adds array<struct<kind, start, end>> of all spans, by start, then as KINDS lists the kinds.

    The models judge every run of `least` characters or more that doesn't lie wholly inside a span of the fixed patterns,
    and, of runs that such spans overlap, each part outside them.
    Work grows with a text's length and the number of its matches (times its logarithm, for the sorting).
    """
    none = F.array().cast(SPAN)
    t = F.coalesce(F.col(text), F.lit(""))
    columns, names = docs.columns, {}
    for name in ("assign", "access", "hex", "base", "run", "free", "markov"):
        names[name] = "__" + name
        while names[name] in columns:
            names[name] += "_"
    for kind, pattern, group, length in BASE:
        fast = FAST.get(kind, pattern)
        docs = docs.withColumn(names[kind], F.when(t.rlike(fast), _matches(t, fast, group, length, kind)).otherwise(none))
    docs = docs.withColumn(names["base"], F.concat(*[F.col(names[kind]) for kind, *_ in BASE]))
    size = len(ALPHABET)
    table = F.lit(model)
    candidate = f"{CANDIDATE}{{{least},}}"
    docs = docs.withColumn(names["run"], F.when(t.rlike(candidate), _matches(t, candidate, 0, 0, "markov", strings=True)).otherwise(none))

    def ratio(s: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            return F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.get(table, acc["last"] * size + c)).otherwise(0.0)).alias("sum"))

        return F.aggregate(_codes(s), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step)["sum"] / F.greatest(F.char_length(s) - 1, F.lit(1))

    run, base = F.col(names["run"]), F.col(names["base"])
    docs = docs.withColumn(names["free"], F.when((F.size(run) == 0) | (F.size(base) == 0), run).otherwise(_outside(run, base, least)))
    docs = docs.withColumn(names["markov"], F.filter(names["free"], lambda r: ratio(r["s"]) >= threshold))
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    ranked = F.transform(F.concat(base, F.col(names["markov"])), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return docs.withColumn(out, spans).drop(*[n for n in names.values() if n != out])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], text: str = "text", mark: str = "[secret]", threshold: float = THRESHOLD, least: int = CANDIDATE_LENGTH) -> DataFrame:
    """The same rows with each stretch of spans replaced by the mark; texts without spans, nulls included, stay as they are."""
    spans = "__spans"
    while spans in docs.columns:
        spans += "_"
    found = scan(docs, model, text, threshold, spans, least)
    kept = "array<struct<at:int,to:int>>"
    end = F.struct(F.char_length(text).alias("start"), F.char_length(text).alias("end"))
    spots = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.array(end))

    def step(at: Column, s: Column):
        gap = F.array(F.struct(at.alias("at"), s["start"].alias("to")))
        return F.greatest(at, s["end"]), F.when(s["start"] < at, F.array().cast(kept)).otherwise(gap)

    def pieces(block: Column) -> Column:
        """A block's kept stretches, cut out of the part of the text that they are in."""
        low, high = F.get(block, F.lit(0))["at"], F.element_at(block, -1)["to"]
        part = F.struct(low.alias("low"), F.substring(F.col(text), low + 1, high - low).alias("part"))
        return _let(part, lambda p: F.transform(block, lambda k: F.substring(p["part"], k["at"] - p["low"] + 1, k["to"] - k["at"])))

    gaps = F.filter(_fold(spots, F.lit(0), step, kept), lambda block: F.size(block) > 0)
    whole = F.array_join(F.flatten(F.transform(gaps, pieces)), mark)
    return found.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop(spans)
