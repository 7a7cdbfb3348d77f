"""The phrase ladder: exact substring, ordered tokens with bounded gaps, the same on stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.text import stems, tokens, without_stopwords

MAX_GAP = 2


def exact(pattern: Column, text: Column) -> Column:
    """The trimmed, lower-cased pattern is a substring of the lower-cased text."""
    return exact_in(pattern, F.lower(text))


def exact_in(pattern: Column, lowered: Column) -> Column:
    """exact() in a text that is lower-cased already."""
    needle = F.lower(F.regexp_replace(pattern, r"^\s+|\s+$", ""))
    return (needle != "") & F.contains(lowered, needle)


def in_order(wanted: Column, words: Column, max_gap: int = MAX_GAP) -> Column:
    """wanted follow each other in words with at most max_gap others between neighbours.

    Greedy: each token is matched where it is next seen, without going back. Atomic groups of a regular
    expression over the space-joined words say just that; tokens hold no character that needs escaping."""
    return in_order_of_line(wanted, spaced(words), max_gap)


def spaced(words: Column) -> Column:
    """The words between single spaces, with one before and one after: what in_order_of_line() searches."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def in_order_of_line(wanted: Column, line: Column, max_gap: int = MAX_GAP) -> Column:
    """in_order() of the words of a line that is made once for many patterns."""
    step = lambda t: F.concat(F.lit(f"(?>(?: [^ ]+){{0,{max_gap}}}? "), t, F.lit("(?= ))"))
    rest = F.array_join(F.transform(F.slice(wanted, 2, 1 << 20), step), "")
    pattern = F.concat(F.lit(" "), F.try_element_at(wanted, F.lit(1)), F.lit("(?= )"), rest)
    return F.when(F.size(wanted) > 0, F.rlike(line, pattern)).otherwise(False)


def rung(pattern: Column, text: Column, words: Column, word_stems: Column, max_gap: int = MAX_GAP) -> Column:
    """exact, subsequence, stemmed_subsequence, or null where the pattern doesn't match.

    words and word_stems are the text's tokens and their stems, made once for all patterns. Stop words
    are dropped of the pattern only, so those of the text use up the gap."""
    wanted = tokens(pattern)
    return (
        F.when(exact(pattern, text), "exact")
        .when(in_order(wanted, words, max_gap), "subsequence")
        .when(in_order(stems(without_stopwords(wanted)), word_stems, max_gap), "stemmed_subsequence")
    )


def matches(patterns: Column, text: Column, words: Column, word_stems: Column, max_gap: int = MAX_GAP) -> Column:
    """Array of (pattern, rung) of the patterns that match, in their order."""
    each = F.transform(patterns, lambda p: F.struct(p.alias("pattern"), rung(p, text, words, word_stems, max_gap).alias("rung")))
    return F.filter(each, lambda m: m["rung"].isNotNull())
