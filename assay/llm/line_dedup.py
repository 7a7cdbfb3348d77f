"""Line deduplication by levelled sorted runs of line hashes, compacted as they pile up."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm._state import drop, keep, read, shared_dir
from assay.llm._text import FOLDED, SPACE, Lines, mixed, parts, prefix, quick_prefix, quick_spans, spans, sums

#: Keys of fewer code points stay; keys in fewer documents stay.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches by descending id; a level of so many runs is compacted into one of the next.
BATCHES, FANOUT = 4, 2

_SECOND = mixed(FOLDED)
_NO_ID = -(2**63)


def _keys(off: np.ndarray, data: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions in the row and 128-bit hashes of the lines with long keys."""
    lines = Lines(off, data)
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, lines.start), np.searchsorted(solid, lines.end)
    has = np.flatnonzero(b > a)
    start, end = solid[a[has]], solid[b[has] - 1] + 1
    long = sums((data & 0xC0) != 0x80, start, end) >= least_chars
    has, start, end = has[long], start[long], end[long]
    row = lines.row[has]
    return row, has - lines.first[row], spans(prefix(FOLDED[data]), start, end), quick_spans(quick_prefix(_SECOND[data]), start, end)


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """id, t (hash of the text), pos, k1, k2 of each line whose key has at least least_chars code points.

    A key is the line without ASCII white space at its ends, A-Z lower-cased. Documents without an id
    count as one, before all others."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("t"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in parts(b.column("text"), most_rows=4096):
                row, pos, k1, k2 = _keys(off, data, least_chars)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("t").take(at), pa.array(pos.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["id", "t", "pos", "k1", "k2"])

    return rows.mapInArrow(find, "id long, t long, pos int, k1 long, k2 long")


#: A scan of one file a bucket then says that it is sorted.
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Run:
    """A stored run: k1, k2, n (documents it has been seen in, up to a bound), last (the largest id), in buckets
    of the keys, one sorted file each, so that merges neither shuffle nor sort it."""

    def __init__(self, rows: DataFrame) -> None:
        self.spark, self.name = rows.sparkSession, f"line_run_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        before = self.spark.conf.get(_SORTED, "false")
        self.spark.conf.set(_SORTED, "true")
        try:
            # The rows are dealt by the keys into as many parts, so each bucket is written by one task.
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            rows.write.bucketBy(buckets, "k1", "k2").sortBy("k1", "k2").option("path", self.path).saveAsTable(self.name)
        finally:
            self.spark.conf.set(_SORTED, before)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The rows without their buckets, for joins whose other side has hot keys that Spark must be free to split."""
        return self.spark.read.schema(self.rows().schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.files())
        self.spark.sql(f"DROP TABLE {self.name}")


class LineRuns:
    """Levels of sorted runs. add() takes batches in descending order of id."""

    def __init__(self, least_docs: int = LEAST_DOCS, fanout: int = FANOUT) -> None:
        self.least_docs, self.fanout, self.levels = least_docs, fanout, [[]]

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _upto(self, n: Column) -> Column:
        return F.least(n, F.lit(self.least_docs).cast("long")).alias("n")

    def add(self, lines: DataFrame) -> None:
        """Add a batch: keys that a run has in enough documents already are left out by a sorted anti-join."""
        new = lines.select("k1", "k2", "id").distinct().groupBy("k1", "k2").agg(self._upto(F.count(F.lit(1))), F.max("id").alias("last"))
        for run in self.runs():
            new = new.join(run.rows().where(F.col("n") >= self.least_docs).hint("merge"), ["k1", "k2"], "left_anti")
        self.levels[0].append(Run(new))
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                self.levels[depth] = []
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._compact(level))

    def _compact(self, runs: list[Run]) -> Run:
        """One run of several, merged in order."""
        rows = runs[0].rows()
        for run in runs[1:]:
            other = run.rows().withColumnsRenamed({"n": "n2", "last": "last2"}).hint("merge")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            rows = rows.join(other, ["k1", "k2"], "full_outer").select("k1", "k2", self._upto(n), F.greatest("last", "last2").alias("last"))
        out = Run(rows)
        for run in runs:
            run.drop()
        return out

    def frequent(self) -> DataFrame:
        """k1, k2, last of the keys that are in at least least_docs documents."""
        runs = self.runs()
        return (runs[0] if len(runs) == 1 else self._compact(runs)).files().where(F.col("n") >= self.least_docs).select("k1", "k2", "last")


def repeated_lines(lines: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """id, t, drop (positions) of the documents that lose lines."""
    cuts = sorted(set(lines.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01)), reverse=True)
    store, above = LineRuns(least_docs), None
    for cut in [*cuts, None]:
        part = lines if above is None else lines.where(F.col("id") < above)
        store.add(part if cut is None else part.where(F.col("id") >= cut))
        above = cut
    gone = lines.join(store.frequent(), ["k1", "k2"]).where(F.col("id") != F.col("last"))
    return gone.groupBy("id", "t").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs without repeated lines, with n_lines (before) and n_dropped.

    A key of at least least_chars code points in at least least_docs documents loses all its lines but
    those in the largest doc_id that holds it. One row out for each row in; a null or empty text has one
    empty line and stays as it is; rows of equal id count as one document. Extra columns are kept, but
    for ones named n_lines or n_dropped, which ours replace."""
    docs = docs.drop("n_lines", "n_dropped")
    gone = repeated_lines(keep(line_keys(docs, least_chars), "lines"), least_docs, batches)
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__t": F.xxhash64("text")})
    own = own.join(gone.withColumnsRenamed({"id": "__id", "t": "__t", "drop": "__drop"}), ["__id", "__t"], "left").drop("__id", "__t")
    # Only rows that lose lines are cut into them; what stays is looked up by position.
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    more = {"n_lines": F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(1)).cast("long"), "n_dropped": F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long")}
    return own.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), *(v.alias(k) for k, v in more.items()))


def op6_line_runs(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that loses lines and has no word left goes.

    Null, empty and blank texts have no key and stay as they are; repeated rows stay; an empty table gives an
    empty one. Columns named n_lines or n_dropped are the documents' own."""
    safe = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("n_lines", "n_dropped")})
    out = dedup_lines(safe).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*(F.col(f"__own_{c}").alias(c) if c in ("n_lines", "n_dropped") else F.col(c) for c in docs.columns))
