"""Tokens, stop words and stems as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the stop words and the suffix rules decide every result.
TOKEN = "([a-z0-9]+(?:'[a-z]+)?)"
STOPWORDS = (
    "a an the of to in on at by for with as is are was were be been being and or but this that these those "
    "it its i you your we they he she do does did doing can could will would shall should may might must "
    "have has had if so than then"
).split()
SUFFIXES = (("ies", "y"), ("ing", ""), ("ied", "y"), ("ed", ""), ("es", ""), ("s", ""), ("ly", ""))
#: What a suffix rule must leave, before its replacement is added.
LEAST_STEM = 3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: an expression that a lambda refers to is else computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def tokens(text: Column) -> Column:
    """Lower-cased ASCII tokens, in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def without_stopwords(words: Column) -> Column:
    return F.filter(words, lambda t: ~t.isin(STOPWORDS))


def stem(token: Column) -> Column:
    """The first suffix rule that applies and leaves a stem long enough; else the token."""
    rules = F
    for suffix, instead in SUFFIXES:
        fits = token.endswith(suffix) & (F.length(token) >= LEAST_STEM + len(suffix) - len(instead))
        rules = rules.when(fits, F.concat(F.left(token, F.length(token) - len(suffix)), F.lit(instead)))
    return rules.otherwise(token)


def stemmed(word: str) -> str:
    """stem() of one word, in Python."""
    for suffix, instead in SUFFIXES:
        if word.endswith(suffix) and len(word) >= LEAST_STEM + len(suffix) - len(instead):
            return word[: len(word) - len(suffix)] + instead
    return word


def stems(words: Column) -> Column:
    return F.transform(words, stem)


def content_terms(text: Column) -> Column:
    """Stems of the tokens that aren't stop words: what retrieval and grounding compare."""
    return stems(without_stopwords(tokens(text)))
