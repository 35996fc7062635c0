"""Tokenizer and feature-hashing expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexlab.functions.exprs import bound, col, hex8_to_long

# Word tokens: maximal runs of Unicode letters, digits and underscore.
# The class syntax means the same in Java regex and RE2.
WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def word_tokens(text: str | Column) -> Column:
    """lower-cased word tokens of the whole text, empty pieces removed."""
    return F.array_remove(F.split(F.lower(col(text)), WORD_SPLIT), "")


def truncate(tokens: str | Column, max_length: int | None) -> Column:
    """First ``max_length`` tokens (``None`` keeps all)."""
    return col(tokens) if max_length is None else F.slice(col(tokens), 1, max_length)


def char_ngrams(text: str | Column, n: int = 3) -> Column:
    """Character n-grams of the lower-cased text with runs of non-word
    characters folded to one space.

    The text is split into characters once; grams come from zipping the
    character array with its shifted slices, so the cost is linear in the
    text length (no per-gram substring scans).
    """
    s = F.regexp_replace(F.lower(col(text)), WORD_SPLIT, " ")

    def joined(chars: Column) -> Column:
        grams = chars
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(chars, k + 1, F.size(chars)), lambda x, y: F.concat(x, y))
        return F.array_compact(grams)

    return bound(F.split(F.concat(F.lit(" "), s, F.lit(" ")), "(?!$)"), joined)


def token_index(t: Column, num_features: int) -> Column:
    """Stable feature index of one token: md5 prefix modulo num_features (any
    SQL engine can recompute it)."""
    return (hex8_to_long(F.md5(t)) % F.lit(num_features)).cast("int")


def token_indices(tokens: str | Column, num_features: int) -> Column:
    return F.transform(col(tokens), lambda t: token_index(t, num_features))
