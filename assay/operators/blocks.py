"""Scores of many queries against many documents, in blocks of documents: a pair of query and document never leaves its task.

Documents are dealt into blocks by a hash of their id, one row each with the list of its terms, and each block meets all queries, as
lists of numbered terms. A task adds up one query's scores over one block in an array, in short whole numbers that are never too low, scores
exactly the few documents that may reach the query's bound, and sends on only those that can be among its best."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.text import STOPWORDS, TOKEN, stemmed
from assay.operators.kept import kept

#: Documents of a block, at most about so many; of few documents, least ones of a block, so that all cores have some.
DOCS, FEW = 12_288, 1024
#: Terms of a row of factors.
FACTORS = 65_536
#: Greatest sum of short weights; how many of the greatest weight it holds. Terms whose postings are held as whole rows, at most.
UNITS, ROOM, WHOLE = 65_535, 40, 2000
#: Words that a task remembers; bytes of texts that it cuts at a time.
WORDS, LETTERS = 500_000, 1 << 23
#: Blocks from which on a sixteenth of them gives bounds first. Share of different documents up to which like ones are joined.
PILOT, SAME = 8, 0.9


def listed(rows: DataFrame) -> DataFrame:
    """row, doc_id, length, tids, tfs: one row for each `row` of the table row, doc_id, length, tid, which has one row for each word."""
    return _regrouped(rows.groupBy("row", "doc_id", "length", "tid").agg(F.count(F.lit(1)).cast("int").alias("tf")), ["row", "doc_id", "length"])


class _Codes(dict):
    """Of each word met: its stem's number, -1 where that isn't asked for, -2 for a stop word."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        text = word.decode()
        code = self[word] = -2 if text in STOPWORDS else self.terms.get(stemmed(text), -1)
        return code


#: The words that a worker has met, by the terms' name: of the last terms only.
_met: dict[str, _Codes] = {}
#: What no token has, as spaces.
_SPACED = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
_cut = re.compile(TOKEN.encode()).findall


def words_of(text: bytes) -> list[bytes]:
    """tokens() of text in lower case."""
    return _cut(text) if b"'" in text else text.translate(_SPACED).split()


def in_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about LETTERS bytes of text: of long texts, fewer at a time."""
    share = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // LETTERS
    heads = np.flatnonzero(np.append(True, share[1:] != share[:-1])).tolist() if batch.num_rows else []
    for a, b in zip(heads, [*heads[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _worded(terms: Broadcast[dict[str, int]], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _met:
            _met.clear()
            _met[name] = _Codes(terms.value)
        code, empty = _met[name].__getitem__, terms.value[""]
        for batch in batches:
            for piece in in_pieces(batch):
                words = [words_of(text) for text in piece.column("text").cast(pa.binary()).to_pylist()]
                n = piece.num_rows
                doc = np.repeat(np.arange(n), [len(x) for x in words])
                codes = np.fromiter(map(code, chain.from_iterable(words)), np.int64, len(doc))
                length = np.bincount(doc[codes != -2], minlength=n)
                # The empty word stands for its document.
                doc, codes = np.append(doc[codes >= 0], np.arange(n)), np.append(codes[codes >= 0], np.full(n, empty))
                span = codes.max() + 1
                key, times = np.unique(doc * span + codes, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(n + 1) * span), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % span, times))
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("doc_id"), pa.array(length), *lists], ["row", "doc_id", "length", "tids", "tfs"])

    return lists


def listed_texts(texts: DataFrame, terms: Broadcast[dict[str, int]]) -> DataFrame:
    """row, doc_id, length, tids, tfs of texts (row, doc_id, text, in lower case), each by the terms' numbers; those of the empty word stand for the document.

    Words are cut and counted where their text is read, each different word stemmed once, and none is a row of its own."""
    return texts.select("row", "doc_id", "text").mapInArrow(_worded(terms, uuid.uuid4().hex), "row long, doc_id string, length long, tids array<int>, tfs array<int>")


def _regrouped(rows: DataFrame, by: list[str]) -> DataFrame:
    lists = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("tid", "tf"))).alias("l"))
    return lists.select(*by, F.col("l.tid").alias("tids"), F.col("l.tf").alias("tfs"))


def merged(lists: DataFrame) -> DataFrame:
    """Lists of documents of one id and length as one."""
    rows = lists.select("doc_id", "length", F.explode(F.arrays_zip("tids", "tfs")).alias("t")).select("doc_id", "length", "t.tids", "t.tfs")
    return _regrouped(rows.groupBy("doc_id", "length", F.col("tids").alias("tid")).agg(F.sum("tfs").cast("int").alias("tf")), ["doc_id", "length"])


def _best(scores: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Documents that score and can be among the k best: within slack of the k-th score, of each equal score the first k."""
    bound = 0.0
    if k <= len(scores):
        top = []
        for _ in range(k):
            i = scores.argmax()
            top.append((i, scores[i]))
            scores[i] = -1.0
        for i, score in top:
            scores[i] = score
        bound = top[-1][1] - slack
    found = np.flatnonzero(scores >= bound) if bound > 0 else np.flatnonzero(scores > 0)
    if len(found) > k:
        found = found[np.lexsort((found, -scores[found]))]
        own, place = scores[found], np.arange(len(found))
        start = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), place, 0))
        found = found[place - start < k]
    return found


#: Weights of postings by how often a term is there and its document's length.
Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _units(weight: np.ndarray) -> tuple[float, np.ndarray]:
    """A unit, and the weights in it, rounded up: sums of them are never too low, and short enough to be added fast."""
    unit = max(float(weight.max(initial=0.0)) * ROOM / UNITS, 1e-9)
    return unit, np.ceil(weight / unit).astype(np.uint16)


class _Block:
    """Documents of a block, each with its terms, and the postings of each term."""

    def __init__(self, rows: pa.Table, k: int, slack: float, weigh: Weigh | None) -> None:
        of = pc.is_valid(rows.column("ids"))
        docs, factors = rows.filter(of), rows.filter(pc.invert(of))
        del rows
        # Documents are numbered in the order of their least doc_id as text; at: where each stands.
        names = pc.list_element(docs.column("ids").combine_chunks(), 0)
        self.at = pc.array_sort_indices(names, null_placement="at_start").to_numpy()
        self.k, self.slack, self.ids, self.n = k, slack, docs.column("ids").combine_chunks(), docs.num_rows
        number = np.empty(self.n, np.int64)
        number[self.at] = np.arange(self.n)
        size = pc.list_value_length(docs.column("tids")).to_numpy()
        tid = pc.list_flatten(docs.column("tids")).to_numpy()
        self.ends = np.append(0, np.cumsum(size))
        if weigh:
            tfs, length, self.own = pc.list_flatten(docs.column("tfs")).to_numpy(), docs.column("length").to_numpy(), np.empty(len(tid))
            for a in range(0, self.n, 1024):  # fewer at a time, as arithmetic takes some times their memory
                some = slice(*self.ends[[a, min(a + 1024, self.n)]])
                self.own[some] = weigh(tfs[some], np.repeat(length[a : a + 1024], size[a : a + 1024]))
            del tfs
        else:
            self.own = pc.list_flatten(docs.column("values")).to_numpy()
        del docs
        order = np.argsort(tid, kind="stable").astype(np.int32)
        key = tid[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        self.known, count = key[head], np.diff(np.append(head, len(key)))
        del tid, key
        # By document: the terms, as numbers in known, ascending, and their weights.
        self.terms = np.empty(len(order), np.int32)
        self.terms[order] = np.repeat(np.arange(len(head), dtype=np.int32), count)
        if factors.num_rows and len(head):
            at, factor = (pc.list_flatten(factors.column(c)).to_numpy() for c in ("tids", "values"))
            by = np.argsort(at)
            self.own = self.own * factor[by][np.searchsorted(at, self.known, sorter=by)][self.terms]
        # By term: the places in the above, the documents and their weights in units.
        self.first, self.places, self.doc = np.append(head, len(order)).tolist(), order, np.repeat(number, size)[order]
        self.unit, short = _units(self.own)
        self.short = short[order]
        self.most = np.maximum.reduceat(self.short, head).astype(np.int64) if len(head) else np.zeros(0, int)
        # Terms of many documents are added as whole rows.
        self.whole, self.rows = max(self.n / 32, np.partition(count, -WHOLE)[-WHOLE] + 1 if len(count) > WHOLE else 0), {}
        self.sums = np.zeros(self.n, np.uint16)

    def _plain(self, terms: list[int], bound: float) -> tuple[np.ndarray, np.ndarray]:
        """All scores, where the units don't do."""
        scores = np.zeros(self.n)
        for t in terms:
            a, b = self.first[t], self.first[t + 1]
            scores[self.doc[a:b]] += self.own[self.places[a:b]]
        best = _best(scores, self.k, self.slack)
        best = best[scores[best] >= bound]
        return best, scores[best]

    def _kth(self) -> int:
        """The k-th greatest of the sums, 0 if there are fewer that score."""
        sums, k = self.sums, self.k
        if k > self.n:
            return 0
        if k > 16:
            return int(np.partition(sums, -k)[-k])
        top = []
        for _ in range(k):
            i = sums.argmax()
            top.append((i, sums[i]))
            sums[i] = 0
        for i, x in top:
            sums[i] = x
        return int(top[-1][1])

    def best(self, terms: list[int], units: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among a query's best, and their scores. terms: ascending, repeated as often as they are asked for; units: the most that they may add up to."""
        if units > UNITS:
            return self._plain(terms, bound)
        sums, rows, doc, short, first = self.sums, self.rows, self.doc, self.short, self.first
        sums.fill(0)
        for t in terms:
            row = rows.get(t)
            if row is not None:
                np.add(sums, row, sums)
                continue
            a, b = first[t], first[t + 1]
            if b - a < self.whole:
                sums[doc[a:b]] += short[a:b]
                continue
            row = rows[t] = np.zeros(self.n, np.uint16)
            row[doc[a:b]] = short[a:b]
            np.add(sums, row, sums)
        # A sum of units is over its score by less than a unit a term; one unit more for the arithmetic.
        least = int(bound / self.unit) - 1 if bound > 0 else self._kth() - len(terms) - 1 - int(self.slack / self.unit)
        if sums.max() < max(least, 1):
            return _NONE
        found = (sums >= max(least, 1)).nonzero()[0]
        if len(found) > 64:
            return self._plain(terms, bound)
        asked, scores = np.array(terms), np.empty(len(found))
        for n, d in enumerate(self.at[found].tolist()):
            own = self.terms[self.ends[d] : self.ends[d + 1]]
            at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            scores[n] = self.own[self.ends[d] + at[own[at] == asked]].sum()
        best = _best(scores, self.k, self.slack) if len(found) > self.k else np.arange(len(found))
        best = best[scores[best] >= bound]
        return found[best], scores[best]

    def found(self, asked: pa.Table) -> pa.RecordBatch | None:
        """Rows of the queries' best. asked: nos, sizes, tids, values (the bounds) of some queries a row."""
        nos, size, tids, bounds = (pc.list_flatten(asked.column(c)).to_numpy() for c in ("nos", "sizes", "tids", "values"))
        if not self.n or not len(self.known) or not len(tids):
            return None
        at = np.minimum(np.searchsorted(self.known, tids), len(self.known) - 1)
        here = self.known[at] == tids
        ends = np.append(0, np.cumsum(size))
        units = np.append(0, np.cumsum(np.where(here, self.most[at], 0)))[ends]
        units, ends, at = np.diff(units), np.append(0, np.cumsum(here))[ends].tolist(), at[here].tolist()
        queries, docs, scores = [], [], []
        for q in np.flatnonzero((units > 0) & (units >= np.floor(bounds / self.unit) - 1)).tolist():
            best, score = self.best(at[ends[q] : ends[q + 1]], int(units[q]), float(bounds[q]))
            if len(best):
                queries.append(np.full(len(best), nos[q]))
                docs.append(best)
                scores.append(score)
        if not docs:
            return None
        ids = self.ids.take(pa.array(self.at[np.concatenate(docs)]))
        n = pc.list_value_length(ids).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.concatenate(queries), n)), ids.flatten(), pa.array(np.repeat(np.concatenate(scores), n))], ["no", "doc_id", "score"])


_NONE = (np.zeros(0, int), np.zeros(0))


def _scorer(k: int, slack: float, weigh: Weigh | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, a part's documents and factors before its queries, of which only a batch is held."""
        part, held, block = None, [], None
        _met.clear()  # a worker that cut words needs them no more
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = batch.column("part").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            heads = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])).tolist()
            for a, b in zip(heads, [*heads[1:], len(mark)], strict=True):
                piece = batch.slice(a, b - a)
                if part != mark[a] // 2:
                    part, held, block = mark[a] // 2, [], None
                if mark[a] % 2 == 0:
                    held.append(piece)
                    continue
                if block is None and held:
                    table, held = pa.Table.from_batches(held), []
                    block = _Block(table, k, slack, weigh)
                    del table
                    pa.default_memory_pool().release_unused()
                if block is not None and (found := block.found(pa.Table.from_batches([piece]))) is not None:
                    yield found

    return score


#: Columns of documents beside their ids: equal ones have equal scores.
OWN = ["tids", "tfs", "length", "weights"]


def _distinct(docs: DataFrame, k: int) -> DataFrame:
    """Documents of the same weights have the same scores, so they are one row, with the k least ids, which alone can be among the best."""
    rows = docs.groupBy(OWN).agg(F.slice(F.sort_array(F.collect_list(F.struct("doc_id"))), 1, k).alias("l"))
    return rows.select(F.col("l.doc_id").alias("ids"), *OWN)


def _in_parts(docs: DataFrame, queries: DataFrame, factors: DataFrame | None, blocks: int, score: Callable) -> DataFrame:
    """no, doc_id, score of each query's best in each of so many blocks. docs: block (from 0), ids, OWN. queries: no, tids, bound (0: none known).

    A part is a block and a share of the queries: of few blocks, each is several tasks'."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-3 * cores // blocks)) if blocks < cores else 1
    lines = queries.groupBy(F.shiftright("no", 6).alias("line")).agg(F.sort_array(F.collect_list(F.struct("no", "tids", "bound"))).alias("l"))
    tile = F.pmod(F.xxhash64("line"), F.lit(tiles)).cast("int")
    every = lambda first, last, step: F.explode(F.sequence(first, last, F.lit(step)))
    columns = {"ids": "array<string>", "nos": "array<bigint>", "sizes": "array<int>", "tids": "array<int>", "tfs": "array<int>", "length": "bigint", "values": "array<double>"}
    row = lambda table, part, kind, **given: table.select(part.alias("part"), F.lit(kind).alias("kind"), *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
    lines = row(lines, every(tile, tile + (blocks - 1) * tiles, tiles), 1, nos=F.col("l.no"), sizes=F.transform("l", lambda x: F.size(x["tids"])), tids=F.flatten("l.tids"), values=F.col("l.bound"))
    of = F.col("block") * tiles
    rows = row(docs, every(of, of + tiles - 1, 1), 0, ids=F.col("ids"), tids=F.col("tids"), tfs=F.col("tfs"), length=F.col("length"), values=F.col("weights")).unionByName(lines)
    if factors is not None:
        lists = factors.groupBy(F.floor(F.col("tid") / FACTORS)).agg(F.collect_list(F.struct("tid", "factor")).alias("l"))
        rows = rows.unionByName(row(lists, every(F.lit(0), F.lit(blocks * tiles - 1), 1), 0, tids=F.col("l.tid"), values=F.col("l.factor")))
    # So many partitions that few hold two parts; by number, as little is moved for the work to be done, and small ones would be joined to one task's.
    return rows.repartition(3 * blocks * tiles, "part").sortWithinPartitions("part", "kind").mapInArrow(score, "no long, doc_id string, score double")


def best_in_blocks(values: DataFrame, asked: DataFrame, n_docs: int, k: int, digits: int, factors: DataFrame | None = None, weigh: Weigh | None = None) -> DataFrame:
    """query_id, doc_id, score of the documents that can be among the k best of each query after rounding to so many digits.

    values: tid (a term's number), doc_id, weight; or, which moves the least, a row for each doc_id: doc_id, length, tids (ascending), tfs, of which weigh()
    makes weights in the blocks. asked: query_id, tid, times. factors: tid, factor of each term, by which weights are multiplied there. Documents of equal scores go by doc_id as text. Queries of the same terms are one, as are documents of the
    same weights where there are many. Every query is sent to every block, as its numbers only, and is met with the bound that its k-th best score in a sixteenth
    of the blocks gives; a block's documents are sent once. Memory of a task is that of a block and of a batch of queries."""
    cores = values.sparkSession.sparkContext.defaultParallelism
    if "tids" not in values.columns:
        rows = values.groupBy("doc_id", "tid").agg(F.sum("weight").alias("weight")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("tid", "weight"))).alias("l"))
        values = rows.select("doc_id", F.lit(None).cast("long").alias("length"), F.col("l.tid").alias("tids"), F.lit(None).cast("array<int>").alias("tfs"), F.col("l.weight").alias("weights"))
    else:
        values = values.withColumn("weights", F.lit(None).cast("array<double>"))
    values = values.where(F.size("tids") > 0)
    lists = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("tid", F.col("times").cast("int").alias("times")))).alias("l"))
    lists = lists.select("query_id", F.flatten(F.transform("l", lambda x: F.array_repeat(x["tid"], x["times"]))).alias("tids"))
    same = lists.groupBy("tids").agg(F.collect_list(F.struct("query_id")).alias("l"))
    queries = kept(same.select(F.monotonically_increasing_id().alias("no"), "tids", F.col("l.query_id").alias("query_ids")), "blocks-queries")
    blocks = max(1, -(-n_docs // DOCS), min(3 * cores, -(-n_docs // FEW)))
    if values.select(F.xxhash64(*OWN)).distinct().count() <= SAME * n_docs:
        docs = kept(_distinct(values, k), "blocks-documents")
    else:  # Few to be spared: scored one by one.
        docs = values.select(F.array("doc_id").alias("ids"), *OWN)
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).cast("int"))
    # Two units of the last digit, so that rounding loses nothing.
    slack = 2 * 10.0**-digits
    none, score = queries.select("no", "tids", F.lit(0.0).alias("bound")), _scorer(k, slack, weigh)
    if blocks < PILOT:
        found = _in_parts(docs, none, factors, blocks, score)
    else:
        some = -(-blocks // 16)
        pilot = kept(_in_parts(docs.where(F.col("block") < some), none, factors, some, score), "blocks-pilot")
        bound = pilot.groupBy("no").agg((F.get(F.sort_array(F.collect_list("score"), asc=False), k - 1) - slack).alias("bound"))
        known = queries.select("no", "tids").join(bound, "no", "left").withColumn("bound", F.greatest(F.coalesce("bound", F.lit(0.0)), F.lit(0.0)))
        rest = docs.where(F.col("block") >= some).withColumn("block", F.col("block") - some)
        found = pilot.unionByName(_in_parts(rest, known, factors, blocks - some, score))
    return found.join(queries.select("no", "query_ids"), "no").select(F.explode("query_ids").alias("query_id"), "doc_id", "score")
