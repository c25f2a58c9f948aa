"""Text expressions: normal forms, sentences, tokens. All are built-in functions of one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as tokens, and suffixes that are cut where four characters stay, the first that fits.
STOP_WORDS = "a an the of and or to in for with on at by is are be was were as that this these those from into per which who whom what when where how must should may can will shall not no if then than there their its it's it".split()
SUFFIXES = "ational ations ation ments ment ings ing ives ive ies ical ally als al ors or ers er ed es s".split()
STEM = f"^(.{{4,}}?)({'|'.join(SUFFIXES)})$"
KEY_STOP_WORDS = "a an the is are was were of in to and or for that this it its be by with as at on not no if from".split()


def normalize(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences of the normal form: it is cut after . ! ? before a space."""
    return F.split(F.regexp_replace(normalize(text), "([.!?]) ", "$1\u0001"), "\u0001")


def line_key(text: Column) -> Column:
    """A line with spaces and tabs as one space, none at the ends, and # for each number: equal for lines that differ in page numbers only."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[ \t]+", " ")), "[0-9]+", "#")


def stem(word: Column) -> Column:
    return F.regexp_replace(word, STEM, "$1")


def plain_tokens(text: Column) -> Column:
    """Lower-case words of two and more characters, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def tokens(text: Column) -> Column:
    """Stemmed lower-case tokens of two and more characters, without stop words."""
    return F.transform(plain_tokens(text), stem)


def key_tokens(text: Column) -> Column:
    """Distinct lower-case words of four and more letters, without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]{4,}"), F.lit(0)), lambda w: ~w.isin(KEY_STOP_WORDS)))
