"""Substring dedup: prefix-partitioned suffix trees over words; deep internal nodes are the repeats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm._repeats import AT_ONCE, MOST_RUNS, Groups, Units, removed, repeated_windows, suffixes, with_hits, with_uid
from assay.llm._state import read
from assay.llm._text import Words, parts

#: Words of a window, and the least of the prefix that a group of suffixes shares.
WINDOW, PREFIX = 35, 14


@dataclass(frozen=True)
class Trees:
    """Suffix trees as tables of their internal nodes: depth in words, parent (-1: a root), weight (suffixes below).

    leaves: suffixes (runs' windows, numbered in turn) under nodes of full depth, and of: the node of each.
    many: whether different words come before a node's suffixes, as far as their runs show; a node whose
    suffixes all have one word before them is no maximal repeat, as the node of one word more to the left has
    as many."""

    depth: np.ndarray
    parent: np.ndarray
    weight: np.ndarray
    leaves: np.ndarray
    of: np.ndarray
    many: np.ndarray


def subtrees(tokens: np.ndarray, first: np.ndarray, size: np.ndarray, prefix: np.ndarray, weight: np.ndarray, depth: int) -> Trees:
    """The suffix trees, one for each prefix, of the suffixes that start in the windows of runs, built from the roots down to a depth in words.

    A node's leaves are neighbours. Where all of them agree on the next word the node's edge goes on; where
    they don't, it branches: it is a node, and its children part by that word. Children with one leaf that
    stands for one suffix are cut. What gets to full depth ends there in a node."""
    run, start = suffixes(first, size)
    groups = Groups(prefix[run], weight[run])
    # The node above each suffix that is left, and the nodes' columns.
    above, nodes, count = np.full(len(groups.order), -1), [], 0
    for at in range(depth + 1):
        begin, ends = groups.new.copy(), at == depth
        if not ends and not groups.sort(tokens[start[groups.order] + at]):
            continue
        group = np.cumsum(begin) - 1
        some = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
        some[group[groups.new & (ends | ~begin)]] = True
        head = np.flatnonzero(begin)[some]
        below = np.bincount(group, groups.weight[groups.order], len(some)).astype(np.int64)[some]
        nodes.append((np.full(len(head), at), above[head], below))
        number = count - 1 + np.cumsum(some)
        inside = some[group]
        above[inside] = number[group[inside]]
        count += len(head)
        if not ends:
            above = above[groups.leave()]
    depths, parents, weights = (np.concatenate(x).astype(np.int64) for x in zip(*nodes, strict=True))
    return Trees(depths, parents, weights, groups.order, above, _many(tokens, first, run, start, groups, above, count))


def _many(tokens: np.ndarray, first: np.ndarray, run: np.ndarray, start: np.ndarray, groups: Groups, of: np.ndarray, count: int) -> np.ndarray:
    """Of each node of full depth, whether its suffixes have different words before them. What comes before a run isn't known, and counts as different."""
    out = np.zeros(count, bool)
    at, leaves = start[groups.order], groups.order
    unknown = at == first[run[leaves]]
    left = tokens[np.maximum(at - 1, 0)]
    same = np.zeros(len(leaves), bool)
    same[1:] = of[1:] == of[:-1]
    out[of[unknown]] = True
    out[of[1:][same[1:] & (left[1:] != left[:-1])]] = True
    return out


def tree_order(window: int):
    """The Order by suffix trees: the windows that are leaves under a node as deep as a window repeat.

    Neighbouring ones make a series, whose first window has a node with different words before it: a series
    with its words is a maximal repeat, or several that overlap."""

    def order(tokens: np.ndarray, first: np.ndarray, size: np.ndarray, context: np.ndarray, weight: np.ndarray) -> np.ndarray:
        repeats = np.zeros(int(size.sum()), bool)
        repeats[subtrees(tokens, first, size, context, weight, window).leaves] = True
        return repeats

    return order


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, at_once: int = AT_ONCE, most_runs: int = MOST_RUNS) -> DataFrame:
    """docs with n_words, n_removed and kept (the words that stay, joined by one space).

    Removed is each word that some window of `window` words covers whose words start at another place too,
    in any text. One row out for each row in, extra columns kept (ours replace equal names). A null text has
    no words and kept is empty; texts of fewer words stay; equal rows are copies of each other.

    Suffixes are dealt out by a prefix of `prefix` words: that of the suffix at a window's minimiser, which
    the windows around it share. A prefix of more than most_runs different surroundings gets longer, to both
    sides, until fewer share it; a task then builds the trees of the suffixes of each prefix."""
    units = Units(True, window, min(prefix, window))
    docs = docs.drop("n_words", "n_removed", "kept")
    known, names = with_uid(docs), [*docs.columns, "n_words", "n_removed", "kept"]
    hits = repeated_windows(known, units, tree_order(window), at_once, most_runs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in parts(b.column("text")):
                words = Words(off, data)
                out = removed(units, words.first, b.column("__hits").slice(i, j - i))
                gone, kept = np.bincount(words.row, out, minlength=j - i).astype(np.int64), _kept(words, data, off, ~out)
                own = [b.column(c).slice(i, j - i) for c in names[:-3]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words.count), pa.array(gone), pa.array(kept, pa.string())], names)

    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return with_hits(known, hits).mapInArrow(cut, T.StructType([*docs.schema.fields, *more]))


def _kept(words: Words, data: np.ndarray, off: np.ndarray, stays: np.ndarray) -> list[bytes]:
    """The words that stay of each row, joined by one space: the byte after a word becomes the space."""
    start, end, row = words.start[stays], words.end[stays], words.row[stays]
    step = np.bincount(start, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    take = np.cumsum(step[:-1]) > 0
    out = data.copy()
    inner = end[:-1][row[:-1] == row[1:]] if len(row) else end
    out[inner], take[inner] = 32, True
    return [out[s:e][take[s:e]].tobytes() for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS pos, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, pos, hash(list_slice(w, pos, pos + 34)) AS a, md5(array_to_string(list_slice(w, pos, pos + 34), ' ')) AS b FROM p),
r AS (SELECT doc_id, pos FROM h JOIN (SELECT a, b FROM h GROUP BY a, b HAVING count(*) > 1) USING (a, b)),
g AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, range(35) AS t(k)),
l AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN l ON w.doc_id = l.doc_id
"""
