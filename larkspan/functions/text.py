"""Words of texts and tags for the inverted index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that the index leaves out
STOPWORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be", "been", "being")
#: from the first letter or digit between blanks to the last
WORD = r"[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?"


def words(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case words without punctuation at their ends, in order, without stopwords."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*stopwords))


def tag(value: Column) -> Column:
    """A whole tag in lower case without blanks around it."""
    return F.trim(F.lower(value))
