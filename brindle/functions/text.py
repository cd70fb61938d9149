"""Text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no terms.
STOPWORDS = ("the", "a", "an", "is", "are", "of", "to", "and", "or", "in", "on", "for", "with", "by", "as", "at", "from", "that", "this")

#: Characters stripped from supplied terms.
PUNCTUATION = " \t\r\n.,!?;:()[]{}<>\"'`“”‘’/\\|+-=*&#%@^~"

#: White space: ASCII's, the separators of information, and Unicode's.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included (``trim`` takes spaces only); linear in the text."""
    return F.btrim(text, F.lit(SPACES))


def extract_terms(text: Column) -> Column:
    """Distinct terms in order of first occurrence: ASCII words of two characters or more that aren't stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS)))


def normalise_terms(terms: Column) -> Column:
    """Supplied terms: lower case, stripped of spaces and punctuation, distinct, without empty ones."""
    clean = F.transform(F.array_compact(terms), lambda t: F.btrim(F.lower(strip(t)), F.lit(PUNCTUATION)))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def snippet(text: Column, size: int = 160) -> Column:
    flat = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) > size, F.concat(F.left(flat, F.lit(size)), F.lit("..."))).otherwise(flat)
