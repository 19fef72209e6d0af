"""Entities in text, by all the names they go by.

Texts and names become tokens: runs of ASCII letters and digits in lower case, and other letters one by one, which no name has, so a name can't reach across them.
What lies between tokens doesn't matter. A name is looked up only where its first token stands and only in the lengths that names with
that first token have; stretches of text that a broadcast filter of the names lets through are equi-joined with them on the tokens, so work grows with the text, and what is
shuffled with what is found in it, not with texts times names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.shared import beside, cut

TOKEN = r"[a-z0-9]+|[\p{L}\p{N}]"
#: Tokens of a text that one row holds at most.
STRETCH = 1000
#: First tokens of names are broadcast up to so many; more are joined by a shuffle.
FIRST = 100_000
#: Places of the filter that names are marked in: 64 a row.
FILTER = 2**26


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(TOKEN), F.lit(0))


def expanded(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """entity, alias, key (the alias's tokens), n: each entity's own label and its aliases, equal ones once, the label first, then the first in order; names without a token left out.

    entities: entity. aliases: entity, alias, ord.
    """
    rows = entities.select("entity", F.col("entity").alias("alias"), F.lit(-1).cast("long").alias("ord")).where("entity is not null").distinct()
    if aliases is not None:
        rows = rows.unionByName(aliases.select("entity", "alias", F.col("ord").cast("long").alias("ord")).join(rows.select("entity"), "entity", "left_semi"))
    words = F.filter(tokens("alias"), lambda t: t.rlike("^[a-z0-9]+$"))  # a pattern of the ASCII words, whatever is between them
    rows = rows.withColumn("words", words).where("size(words) > 0")
    rows = rows.select("entity", "alias", "ord", F.array_join("words", " ").alias("key"), F.size("words").alias("n"))
    return rows.groupBy("entity", "key", "n").agg(F.min_by("alias", F.struct("ord", "alias")).alias("alias"))


def occurrences(texts: DataFrame, names: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """id, entity, alias, at (the first token's number, from 0), n: every place where a name stands, overlapping ones too.

    names: what expanded() gives. Rows with null or empty texts give none; ids that repeat are told apart by nothing.
    """
    names = cut(names)
    lengths = names.select(F.substring_index("key", " ", 1).alias("first"), "n").groupBy("first").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    n_first, most, n_names = names.agg(F.count_distinct(F.substring_index("key", " ", 1)), F.max("n"), F.count(F.lit(1))).first()
    most = most or 1
    if n_first <= FIRST:  # else every token of every text is shuffled
        lengths = F.broadcast(lengths)
    found = texts.select(id, tokens(text).alias("t")).where("size(t) > 0")
    # a text's tokens in stretches, so that no row holds more, each with as many of the next one's as a name may need
    parts = F.transform(F.sequence(F.lit(0), F.size("t") - 1, F.lit(STRETCH)), lambda i: F.struct(i.alias("base"), F.slice("t", i + 1, F.lit(STRETCH + most - 1)).alias("t")))
    parts = found.select(id, F.explode(parts).alias("p")).select(id, "p.*")
    ahead = F.transform(F.slice("t", F.lit(1), F.lit(STRETCH)), lambda x, i: F.struct(x.alias("first"), F.slice("t", i + 1, F.lit(most)).alias("ahead")))
    places = parts.select(id, "base", F.posexplode(ahead).alias("i", "p")).select(id, (F.col("base") + F.col("i")).alias("at"), "p.*")
    tried = places.join(lengths, "first").select(id, "at", "ahead", F.explode("lengths").alias("n")).where(F.size("ahead") >= F.col("n"))
    tried = tried.select(id, "at", "n", F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("key"))
    size = 64  # places are about 16 times the names, so few stretches that are no names go on
    while size < min(16 * n_names, FILTER):
        size *= 2
    place = F.pmod(F.xxhash64("key"), F.lit(size))
    word, bit = F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")
    marks = names.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("marks"))
    likely = tried.select("*", word, bit).join(F.broadcast(marks), "word").where(F.col("marks").bitwiseAND(F.col("bit")) != 0).drop("word", "bit", "marks")
    return likely.join(beside(names, n_names), ["key", "n"]).select(id, "entity", "alias", "at", "n")


def mentioned(texts: DataFrame, names: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """id, entity, aliases (those that stand in the text, sorted), n_places, first_at."""
    rows = occurrences(texts, names, id, text)
    return rows.groupBy(id, "entity").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.count(F.lit(1)).alias("n_places"), F.min("at").alias("first_at"))


def longest(found: DataFrame, id: str = "id") -> DataFrame:
    """Those occurrences that remain if a text is read from the left and at each place the longest name is taken, which then covers its tokens; of equally long ones the first entity.

    A sweep over each text's places in order, which keeps where the last name taken ends.
    """
    first = found.groupBy(id, "at").agg(F.min(F.struct((-F.col("n")).alias("n"), "entity", "alias")).alias("m")).select(id, "at", (-F.col("m.n")).alias("n"), F.struct("m.entity", "m.alias").alias("m"))
    places = F.array_sort(F.collect_list(F.struct("at", "n", "m")))
    kept = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,n:int,m:struct<entity:string,alias:string>>>").alias("kept")),
        lambda s, p: F.when(p["at"] >= s["end"], F.struct((p["at"] + p["n"]).alias("end"), F.array_append(s["kept"], p).alias("kept"))).otherwise(s),
    )
    return first.groupBy(id).agg(places.alias("places")).select(id, F.explode(kept["kept"]).alias("p")).select(id, "p.m.*", "p.at", "p.n")


#: Words and phrases that make a question lean on text before it.
LEANING_WORDS = (
    "that", "those", "this", "same", "former", "latter", "earlier", "later",
    "previous",
)
LEANING_PHRASES = (
    "those inspections", "that failed", "the same technical", "that hospital", "those organisations", "those machines", "that digital body", "that acute-trust",
    "that appointment", "those exclusions", "those late", "the listed", "listed trust", "listed hospital", "listed london", "the component",
    "the missing diversion", "the same technical sequence",
)


def discourse(text: Column | str, markers: tuple[str, ...] = LEANING_PHRASES + LEANING_WORDS) -> Column:
    """The markers that stand in the text as whole phrases, sorted, each once."""
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.array_compact(F.array(*[F.when(lowered.rlike(r"(?<![a-z0-9])\Q" + m + r"\E(?![a-z0-9])"), F.lit(m)) for m in sorted(set(markers))]))
