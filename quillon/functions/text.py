"""Text functions on columns. All are built-in expressions but nfkc, which Spark lacks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as Unicode defines it.
SPACE = r"(?U)\s+"


@F.pandas_udf(StringType())
def _nfkc(texts):
    import pandas as pd

    return pd.Series([None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts], dtype=object)


def nfkc(text: Column) -> Column:
    """Compatibility composition; null stays null."""
    return _nfkc(text)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm(text: Column, compose: bool = False) -> Column:
    """Lower case, letters, digits and spaces only, trimmed; with compose after NFKC."""
    base = nfkc(text) if compose else text
    return F.regexp_replace(F.regexp_replace(F.lower(base), r"(?U)[^\p{L}\p{N}\s]", ""), r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space; an empty or null text has none."""
    t = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    return F.when(t != "", F.split(t, SPACE)).otherwise(F.array().cast(ArrayType(StringType())))


def speech_tokens(text: Column) -> Column:
    """Upper-case tokens of a transcript without punctuation; possessive 'S and apostrophes dropped."""
    t = F.regexp_replace(F.upper(text), r"(?U)[^\w\s']", " ")
    return F.filter(F.transform(F.split(t, SPACE), lambda x: F.regexp_replace(F.regexp_replace(x, "'S$", ""), "'", "")), lambda x: x != "")


def transcript(text: Column) -> Column:
    """Lower case, punctuation but apostrophes to spaces, spaces collapsed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s']", " "), SPACE, " "), r"(?U)^\s+|\s+$", "")


def strip_spaces(text: Column) -> Column:
    """All white space removed, for languages without word spaces."""
    return F.regexp_replace(text, SPACE, "")


def content_form(text: Column) -> Column:
    """NFKC with white space collapsed and trimmed; punctuation kept."""
    return F.trim(F.regexp_replace(nfkc(text), SPACE, " "))


def phrase(text: Column) -> Column:
    return F.lower(F.trim(text))


def sentences(text: Column) -> Column:
    """Pieces after closing marks followed by white space."""
    return F.split(text, r"(?U)(?<=[.!?。！？])\s+")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a space; a shorter non-empty list is one gram."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) > 0, many).otherwise(F.array().cast(ArrayType(StringType())))


def quote_literal(text: Column) -> Column:
    """A regular expression that matches the text as it is."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def scrub(text: Column, golds: Column, mark: str = " ", longest_first: bool = True) -> Column:
    """The text with every gold removed, whatever its case, and spaces collapsed; distinct golds, longest first."""
    g = F.array_distinct(F.filter(golds, lambda x: x.isNotNull() & (F.trim(x) != "")))
    if longest_first:
        g = F.transform(F.array_sort(F.transform(g, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("g")))), lambda s: s["g"])
    done = F.aggregate(g, text, lambda t, x: F.regexp_replace(t, F.concat(F.lit("(?i)"), quote_literal(x)), F.lit(mark)))
    return F.trim(F.regexp_replace(done, SPACE, " "))


def options(prompt: Column) -> Column:
    """Texts of lettered options, written (A) text or A. text."""
    return F.transform(F.regexp_extract_all(prompt, F.lit(r"\(([A-H])\)\s*((?:(?!\([A-H]\)).)+)"), F.lit(2)), lambda x: F.trim(x))


def pseudo_questions(text: Column, k: int) -> Column:
    """Lines without bullets and numbers, blank ones dropped, each once, at most k."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)、])\s*", "")))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: x != "")), 1, k)


def dialogue(roles: Column, texts: Column) -> Column:
    """role: text, one a line."""
    return F.array_join(F.zip_with(roles, texts, lambda r, t: F.concat_ws(": ", r, t)), "\n")


def strip_speaker(reply: Column) -> Column:
    """A reply without a leading speaker tag."""
    return F.regexp_replace(reply, r"^\s*<[Ss]peaker\d*>\s*:\s*", "")


def entry_id(source: Column, key: Column, value: Column) -> Column:
    """source:first 12 digits of SHA-1 over key|value."""
    return F.concat(source, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", key, value)), 1, 12))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def natural_key(item: Column) -> Column:
    """Sort key of ids by their trailing number, then by the id."""
    return F.struct(F.coalesce(F.regexp_extract(item, r"(\d+)$", 1).try_cast("bigint"), F.lit(-1)).alias("n"), item.alias("id"))


def plural_match(words: Column, word: Column) -> Column:
    """Whether an upper-case word stands among upper-case words, in the singular or plural on either side."""
    return F.exists(words, lambda t: (t == word) | (t == F.concat(word, F.lit("S"))) | (F.concat(t, F.lit("S")) == word))


def class_by_prefix(text: Column, rules: dict[str, str], other: str | None = None) -> Column:
    """The class of the longest prefix a text begins with."""
    out = F.lit(None).cast("string")
    for prefix in sorted(rules, key=lambda p: (len(p), p)):
        out = F.when(text.startswith(prefix), rules[prefix]).otherwise(out)
    return F.coalesce(out, F.lit(other).cast("string"))
