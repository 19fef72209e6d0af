"""Text rules as Column -> Column functions: everything stays in generated code, no UDFs.

The three normalizers differ on purpose: names keep hyphens and underscores, relations become snake case without one
leading auxiliary verb, answers keep ASCII letters and digits only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chain(c: Column | str, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, _col(c))


def strip(c: Column | str) -> Column:
    """Without white space at both ends (trim() only knows blanks)."""
    return _chain(c, (r"(?U)^\s+|\s+$", ""))


def squeeze(c: Column | str) -> Column:
    """Stripped, with one blank for each run of white space; the case stays."""
    return strip(_chain(c, (r"(?U)\s+", " ")))


def normalize(c: Column | str) -> Column:
    """Names: lower case, runs of white space to a blank, then everything but word characters, blanks and hyphens goes."""
    return strip(_chain(squeeze(F.lower(_col(c))), (r"(?U)[^\w\s-]", "")))


def normalize_relation(c: Column | str) -> Column:
    """Relations: snake case, without one leading auxiliary."""
    return _chain(
        strip(F.lower(_col(c))),
        (r"(?U)[\s-]+", "_"),
        (r"(?U)[^\w_]", ""),
        (r"_+", "_"),
        (r"^_+|_+$", ""),
        (r"^(is|was|were|be|being|been)_", ""),
        (r"_+", "_"),
        (r"^_+|_+$", ""),
    )


def normalize_subject(c: Column | str) -> Column:
    """Names for finding duplicates: normalize() without a leading "the "."""
    return unled(normalize(c))


def unled(c: Column) -> Column:
    """A normalized name without a leading "the "."""
    return strip(_chain(c, (r"^the ", "")))


#: Columns in which facts may carry their normalized triple.
NORMS = {"subject": "__s", "relation": "__r", "object": "__o"}


def norm(df: DataFrame, part: str) -> Column:
    """A triple's normalized subject, relation or object: read, if the rows carry it, else made."""
    return F.col(NORMS[part]) if NORMS[part] in df.columns else normalize_relation(part) if part == "relation" else normalize(part)


def carried(df: DataFrame, *parts: str) -> list[str]:
    """The columns of NORMS that the rows carry, for selections."""
    return [NORMS[p] for p in parts or NORMS if NORMS[p] in df.columns]


def normed(df: DataFrame) -> DataFrame:
    """The rows with their normalized triple, which is nine regular expressions a name: to be written where many steps look through the same facts.

    What is in its normal form already takes one.
    """
    plain = r"^(?!(?:is|was|were|be|being|been)_)[a-z0-9]+(?:_[a-z0-9]+)*\z"
    return df.withColumns({NORMS["subject"]: normalize("subject"), NORMS["relation"]: F.when(F.col("relation").rlike(plain), F.col("relation")).otherwise(normalize_relation("relation")), NORMS["object"]: normalize("object")})


def normalize_entity(c: Column | str) -> Column:
    """Labels of benchmark graphs: case and white space only, punctuation stays."""
    return squeeze(F.lower(_col(c)))


def normalize_answer(c: Column | str) -> Column:
    """Answers for scoring: ASCII letters and digits, one blank between."""
    return F.trim(_chain(F.lower(_col(c)), (r"[^a-z0-9]+", " ")))


def exact_match(answer: Column | str, expected: Column | str) -> Column:
    return strip(answer) == strip(expected)


def contains_expected(answer: Column | str, expected: Column | str) -> Column:
    """The expected answer's tokens stand in a row in the answer; an empty one is nowhere."""
    want = normalize_answer(expected)
    return (want != "") & F.contains(F.concat(F.lit(" "), normalize_answer(answer), F.lit(" ")), F.concat(F.lit(" "), want, F.lit(" ")))


def is_negated(relation: Column | str) -> Column:
    return normalize_relation(relation).rlike(r"^(does_not|not|never|without|no)_")


def same_polarity(a: Column | str, b: Column | str) -> Column:
    return is_negated(a) == is_negated(b)


def rendered(subject: Column | str, relation: Column | str, obj: Column | str) -> Column:
    return F.concat(_col(subject), F.lit(" -- "), _col(relation), F.lit(" --> "), _col(obj))


def evidence_or_triple(evidence: Column | str, subject: Column | str, relation: Column | str, obj: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(evidence), F.lit("")), rendered(subject, relation, obj))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match, or when the group took no part."""
    return F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit(""))


def sentences(c: Column | str) -> Column:
    """Split after . ! ? and white space; stripped, without empty ones."""
    return F.filter(F.transform(F.split(_col(c), r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def flat_sentences(c: Column | str) -> Column:
    """The same, with line ends read as blanks."""
    return sentences(F.translate(_col(c), "\n", " "))


#: Words without content.
STOPWORDS = "a an and are as at by did during for from had how in into of on or the to was were what when which who with".split()


def content_tokens(c: Column | str, stopwords: tuple[str, ...] | list[str] = STOPWORDS) -> Column:
    """Distinct tokens of ASCII letters and digits, over two characters, no stopwords."""
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(list(stopwords))))


def alias_pattern(alias: str) -> str:
    """A pattern for a whole phrase whatever the punctuation between its words; one that never matches for an alias without words."""
    import re

    words = re.findall(r"[a-z0-9]+", alias.lower())
    return r"(?i)(?<![a-z0-9])" + r"[\W_]+".join(words) + r"(?![a-z0-9])" if words else r"(?!)"


def alias_pattern_column(alias: Column | str) -> Column:
    words = F.regexp_extract_all(F.lower(_col(alias)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?i)(?<![a-z0-9])"), F.array_join(words, r"[\W_]+"), F.lit(r"(?![a-z0-9])"))).otherwise(F.lit("(?!)"))


def mentions(text: Column | str, entity: Column | str) -> Column:
    return F.contains(normalize_entity(text), normalize_entity(entity))


def question_names(question: Column | str) -> Column:
    """Capitalised names of two words or more that no question word, article or preposition leads."""
    lead = "what which where when who whom whose how the a an in on at from of to".split()
    found = F.regexp_extract_all(_col(question), F.lit(r"\b([A-Z][A-Za-z0-9]+(?:\s+(?:[A-Z][A-Za-z0-9]+|\d+))+)\b"), F.lit(1))
    return F.filter(found, lambda n: ~F.lower(F.get(F.split(n, r"\s+"), F.lit(0))).isin(lead))


def slug(c: Column | str, most: int = 120) -> Column:
    """Safe in file names."""
    return F.left(_chain(strip(_col(c)), (r"[^A-Za-z0-9._-]+", "_")), F.lit(most))


def result_name(example_id: Column | str, model: Column | str | None = None) -> Column:
    """<id>[_<model>].json"""
    tail = F.lit("") if model is None else F.when(_col(model).isNull(), F.lit("")).otherwise(F.concat(F.lit("_"), F.translate(_col(model), ":/", "__")))
    return F.concat(_col(example_id), tail, F.lit(".json"))


def preview(c: Column | str, most: int = 1200) -> Column:
    text = strip(c)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def without_fences(c: Column | str) -> Column:
    """A text that begins with ``` loses the lines that do."""
    text = strip(c)
    lines = F.filter(F.split(text, "\n"), lambda s: ~strip(s).startswith("```"))
    return F.when(text.startswith("```"), strip(F.array_join(lines, "\n"))).otherwise(text)


def values_align(a: Column | str, b: Column | str) -> Column:
    """Equal, or one within the other; both non-empty."""
    x, y = normalize(a), normalize(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def any_phrase(c: Column | str, phrases: list[str] | tuple[str, ...]) -> Column:
    """Any of the phrases in the text, lower case and with one blank for each run of white space."""
    text = squeeze(F.lower(_col(c)))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


#: Phrases of answers that say nothing.
ABSTENTIONS = (
    "there is no information",
    "no information in the",
    "no information is provided",
    "no evidence found",
    "no evidence available",
    "no evidence states",
    "the provided facts do not contain",
    "the provided kgc facts do not",
    "provided kgc facts do not",
    "kgc does not contain information",
    "does not contain information stating",
    "does not contain information about",
    "not enough information",
    "cannot determine",
    "can't determine",
    "cannot be determined",
    "unable to determine",
    "unable to answer",
    "insufficient information",
    "insufficient evidence",
    "not supported by the provided",
    "the context does not state",
    "the context does not say",
    "not specified in the context",
    "do not have enough information",
    "i do not have enough information",
)


def is_abstention(answer: Column | str) -> Column:
    return any_phrase(answer, ABSTENTIONS)


#: Phrases about the graph or the context, as opposed to the subject.
META = (
    "does not contain information",
    "does not state",
    "does not say",
    "no information",
    "cannot determine",
    "provided facts",
    "provided kgc",
    "knowledge graph",
    "insufficient evidence",
)


def is_factual_negation(answer: Column | str) -> Column:
    return ~any_phrase(answer, META) & squeeze(F.lower(_col(answer))).rlike(r"\b(?:did not|does not|do not|was not|were not|is not|are not)\s+[a-z]")
