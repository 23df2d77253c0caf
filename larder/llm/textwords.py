"""Words of a text as native columns: ASCII lower case, runs of ASCII digits and letters and of any non-ASCII character."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: everything that separates words once A-Z are lower case
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A small table is broadcast up to this many rows (of a few hundred bytes at most); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def split_words(text: str | Column) -> Column:
    """Array of a text's words. Separators at either end leave an empty string there, which no word equals."""
    return F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS)


def count_words(words: str) -> Column:
    """Number of words in ``split_words``' array, without the empty strings at its ends."""
    size = F.size(words)
    return (size - (F.get(words, F.lit(0)) == "").cast("int")
            - ((size > 1) & (F.get(words, size - 1) == "")).cast("int")).cast("long")


def shingle_at(words: str, position: str | Column, width: int) -> Column:
    """64-bit digest of ``width`` words from ``position`` on; null where the text ends before that."""
    at = F.col(position) if isinstance(position, str) else position
    last = F.get(words, at + (width - 1))
    return F.when(last.isNotNull(), F.xxhash64(*(F.get(words, at + k) for k in range(width))))


def join_small(large: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a stored table, broadcast only if counting shows it to be small."""
    return large.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on)
