"""Header normalisation, similarity and note-line clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import BLANK_CHARS, trim_blanks

# Word tokens that mark a header as an identifier column.
IDENTIFIER_TOKENS = ("id", "no", "num", "number", "code")


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def word_tokens(c: Column) -> Column:
    """Lower-case words of a header, split at case changes and at anything that is not a letter or digit."""
    spaced = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def is_identifier_header(c: Column) -> Column:
    return F.arrays_overlap(word_tokens(c), F.array(*[F.lit(t) for t in IDENTIFIER_TOKENS]))


def similarity(a: Column, b: Column) -> Column:
    """Edit similarity in 0..1; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def note_line(c: Column) -> Column:
    """One line of a note list without its leading bullet or number."""
    return trim_blanks(F.regexp_replace(c, rf"^[-*\d.){BLANK_CHARS}]+", ""))


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", "-"))
