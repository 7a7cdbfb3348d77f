"""Suffix-array dedup: depth-limited radix sort of suffixes by most significant digits; equal groups are the repeated windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm._repeats import AT_ONCE, MOST_RUNS, Groups, Units, removed, repeated_windows, suffixes, with_hits, with_uid
from assay.llm._state import read
from assay.llm._text import parts

#: Bytes of a window, and of its minimiser's context.
WINDOW, CONTEXT = 400, 120
#: Bytes of a digit.
DIGIT = 8


def radix_order(window: int):
    """The Order of depth-limited radix passes: suffixes are sorted by digit after digit of their leading
    bytes, the most significant first, through a window's bytes; only groups that disagree are sorted again,
    and suffixes that get alone leave. What is left are groups of equal windows."""

    def order(data: np.ndarray, first: np.ndarray, size: np.ndarray, context: np.ndarray, weight: np.ndarray) -> np.ndarray:
        run, start = suffixes(first, size)
        digits = np.zeros(len(data), np.uint64)
        for k in range(DIGIT):
            digits[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * (DIGIT - 1 - k))
        groups = Groups(context[run], weight[run])
        for at in range(0, window, DIGIT):
            # The last digit ends with the window; it may begin with bytes of the one before.
            if window >= DIGIT:
                digit = digits[start[groups.order] + min(at, window - DIGIT)]
            else:
                digit = digits[start[groups.order]] >> np.uint64(8 * (DIGIT - window))
            if groups.sort(digit):
                groups.leave()
        repeats = np.zeros(len(run), bool)
        repeats[groups.order] = True
        return repeats

    return order


def remove_repeats(docs: DataFrame, window: int = WINDOW, context: int = CONTEXT, at_once: int = AT_ONCE, most_runs: int = MOST_RUNS) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary: what stays of the UTF-8 text).

    Removed is each byte that some window of `window` bytes covers which starts at another place too,
    in any text. One row out for each row in, extra columns kept (ours replace equal names). A null
    text has no bytes and kept is empty; texts shorter than a window stay; equal rows are copies of
    each other. Cuts may split a character, so kept is binary."""
    units = Units(False, window, min(context, window))
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    known, names = with_uid(docs), [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept"]
    hits = repeated_windows(known, units, radix_order(window), at_once, most_runs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in parts(b.column("text")):
                out = removed(units, off, b.column("__hits").slice(i, j - i))
                gone, pieces, kept = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), []
                for d, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    lost = out[s:e]
                    gone[d] = lost.sum()
                    pieces[d] = np.count_nonzero(np.diff(lost.astype(np.int8), prepend=0) == 1)
                    kept.append((data[s:e][~lost] if gone[d] else data[s:e]).tobytes())
                own = [b.column(c).slice(i, j - i) for c in names[:-4]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(off)), pa.array(gone), pa.array(pieces), pa.array(kept, pa.binary())], names)

    more = [T.StructField(c, T.LongType()) for c in names[-4:-1]] + [T.StructField("kept", T.BinaryType())]
    return with_hits(known, hits).mapInArrow(cut, T.StructType([*docs.schema.fields, *more]))


def op7_radix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, length(x) // 2 AS n, regexp_extract_all(x, '.{1,800}') AS k FROM d),
p AS (SELECT doc_id, unnest(range(0, n - 399)) AS pos, k FROM b WHERE n >= 400),
w AS (SELECT doc_id, pos, substr(k[pos // 400 + 1], 2 * (pos % 400) + 1, 800) || coalesce(substr(k[pos // 400 + 2], 1, 2 * (pos % 400)), '') AS w FROM p),
h AS (SELECT doc_id, pos, hash(w) AS h1, hash(w || 'x') AS h2 FROM w),
r AS (SELECT doc_id, pos FROM h JOIN (SELECT h1, h2 FROM h GROUP BY h1, h2 HAVING count(*) > 1) USING (h1, h2)),
s AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER o <= 400 THEN 0 ELSE 1 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM s),
i AS (SELECT doc_id, min(pos) AS a, max(pos) + 400 AS z FROM g GROUP BY doc_id, run),
l AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM i GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda j: substr(x, 2 * coalesce(z[j], 0) + 1, 2 * (coalesce(a[j + 1], n) - coalesce(z[j], 0)))), '') END)) AS kept_sha256
FROM b LEFT JOIN l ON b.doc_id = l.doc_id
"""
