"""Text functions as column expressions. Lengths and offsets are in Unicode code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
GAP = r"[ \t\n\x0B\f\r]+"
#: A sentence's end: terminators, closing marks, then white space or the end of the text.
SENTENCE_END = r"""([.!?。！？]+["'”’)]*(?:[ \t\n\x0B\f\r]+|$))"""
#: Fixed patterns: a paragraph that introduces a list, and one that carries on another.
INTRODUCTION = r"(?i)\b(?:following|below)\b.{0,100}\b(?:methods|models|tasks|approaches|settings|variants|steps)\b|:[ \t\n\x0B\f\r]*$"
CONTINUATION = r"(?i)^(?:where\b|such that\b|which\b|and\b|or\b|with\b|respectively\b)"
_BLANKS = " \t\n\x0b\x0c\r"


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """All words in order, case folded."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0)), F.lit(0.0))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def blank_before(text: Column) -> Column:
    return F.length(text) - F.length(F.ltrim(text, F.lit(_BLANKS)))


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, GAP, " "))


def normal_words(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def nfkc(text: Column) -> Column:
    """Unicode compatibility form. No built-in function has it: a vectorised one, given only what is not ASCII."""
    def form(values):
        return values.str.normalize("NFKC")

    import pandas as pd

    form.__annotations__ = {"values": pd.Series, "return": pd.Series}
    form = F.pandas_udf(form, "string")
    other = F.when(~text.rlike("^[\\x00-\\x7F]*$"), text)
    return F.coalesce(form(other), text)


def normal_title(title: Column) -> Column:
    return collapsed(folded(title))


def slug(title: Column) -> Column:
    kept = F.regexp_replace(folded(title), r"[^\p{L}\p{N}_ \t\n\x0B\f\r-]", "")
    return F.regexp_replace(stripped(kept), r"[ \t\n\x0B\f\r]", "-")


def heading_path(heading: Column) -> Column:
    """``A ::: B`` as its parts."""
    return F.filter(F.transform(F.split(heading, ":::"), stripped), lambda x: x != "")


def sentence_pieces(text: Column) -> Column:
    """The text cut behind each sentence end."""
    return F.split(F.regexp_replace(F.translate(text, "\x01", " "), SENTENCE_END, "$1\x01"), "\x01")
