"""A stored BM25 index: terms of each document and postings of each term written once, and searched without the texts.

Terms are dealt into buckets, which are folders, so a search reads the folders of its terms only; within them rows are
sorted by term, so row groups are skipped by their statistics. A block has up to BLOCK postings of a term; documents
whose weights are alike share blocks, so that many blocks of a common term stay below what a query's best documents have
and are left out before their postings are unpacked."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions.grounding import rounded
from assay.functions.text import STOPWORDS, stemmed
from assay.operators.blocks import WORDS, best_in_blocks, in_pieces, words_of
from assay.operators.kept import dropped, kept
from assay.operators.retrieval import BROADCAST_ROWS, BROADCAST_TERMS, block_values, idf, if_small, lower_texts, numbered, query_terms

#: Folders of terms, shares of a folder that are made in a task of their own, postings of a block.
BUCKETS, SHARES, BLOCK = 64, 16, 128
#: Blocks of a term that are ordered together.
TOGETHER = 64
#: Terms of a query, those that may add most, whose scores give the bound for all other postings.
SEEDS = 4
#: Postings that the queries meet, counted before, from which on they share them.
MANY = 5_000_000


#: Tables of an index and their columns; an index of no terms has no files to tell them.
SCHEMAS = {
    "terms": "term string, df long, factor double, most double, bucket int",
    "blocks": "term string, most double, docs array<long>, weights array<double>, bucket int",
    "documents": "doc long, doc_id string, length long, terms array<string>, tfs array<int>",
    "stats": "n_docs long, avg_length double, repeated boolean",
}


@dataclass
class Index:
    """terms: bucket, term, df, factor (inverse document frequency), most. blocks: bucket, term, most, docs, weights, these and most without the
    factor. documents: doc, doc_id, length and how often each term is there; documents of one id have one number. stats: one row, n_docs, avg_length, and
    whether an id is repeated. Weights are those of the parameters that the index was made with."""

    terms: DataFrame
    blocks: DataFrame
    documents: DataFrame
    stats: DataFrame


def _bucket(term):  # noqa: ANN001, ANN202
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class _Stems(dict):
    """Of each word met the number of its stem, -1 for a stop word."""

    def __init__(self) -> None:
        super().__init__()
        self.numbers: dict[str, int] = {}

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        code = self[word] = -1 if text in STOPWORDS else self.numbers.setdefault(stemmed(text), len(self.numbers))
        return code


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, doc_id, length, terms, tfs of texts."""
    stems = _Stems()
    for batch in batches:
        for piece in in_pieces(batch):
            if len(stems) >= WORDS:
                stems = _Stems()
            words = [words_of(text) for text in piece.column("text").cast(pa.binary()).to_pylist()]
            n, doc = len(words), np.repeat(np.arange(len(words)), [len(x) for x in words])
            codes = np.fromiter(map(stems.__getitem__, chain.from_iterable(words)), np.int64, len(doc))
            doc, codes = doc[codes >= 0], codes[codes >= 0]
            span = len(stems.numbers) + 1
            key, times = np.unique(doc * span + codes, return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(n + 1) * span), pa.int32())
            known, at = np.unique(key % span, return_inverse=True)
            names = list(stems.numbers)
            terms = pa.array([names[t] for t in known.tolist()], pa.string()).take(pa.array(at))
            lists = [pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("doc_id"), pa.array(np.bincount(doc, minlength=n)), *lists], ["doc", "doc_id", "length", "terms", "tfs"])


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, docs, tfs, lengths of the documents of a batch."""
    for batch in batches:
        size = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        terms = pc.list_flatten(batch.column("terms")).dictionary_encode()
        if not len(terms):
            continue
        codes = terms.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        ends = pa.array(np.append(0, np.cumsum(np.bincount(codes, minlength=len(terms.dictionary)))), pa.int32())
        docs, lengths = (np.repeat(batch.column(c).to_numpy(), size)[order] for c in ("doc", "length"))
        tfs = pc.list_flatten(batch.column("tfs")).to_numpy()[order]
        lists = (pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((docs, pa.int64()), (tfs, pa.int32()), (lengths, pa.int32())))
        yield pa.RecordBatch.from_arrays([terms.dictionary, *lists], ["term", "docs", "tfs", "lengths"])


def _in_blocks(weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows that come by term. What is held of a term is ordered when the next term begins, or when it is enough for TOGETHER blocks."""

    def cut(rows: pa.Table) -> pa.RecordBatch:
        term = rows.column("term").combine_chunks().dictionary_encode()
        run = np.repeat(term.indices.to_numpy(), pc.list_value_length(rows.column("docs")).to_numpy())
        docs, tfs, lengths = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("docs", "tfs", "lengths"))
        weight = weigh(tfs, lengths)
        order = np.lexsort((docs, -weight, run))
        run, weight = run[order], weight[order]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        place = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
        heads = np.flatnonzero(place % block == 0)
        ends = pa.array(np.append(heads, len(run)), pa.int32())
        lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (docs[order], weight))
        return pa.RecordBatch.from_arrays([term.dictionary.take(pa.array(run[heads])), pa.array(weight[heads]), *lists], ["term", "most", "docs", "weights"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last term
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("term")[-1]
            start = pc.index(batch.column("term"), last).as_py()
            if start or held and held[0].column("term")[0] != last:
                ready = [*held, batch.slice(0, start)]
                held = []
                if sum(x.num_rows for x in ready):
                    yield cut(pa.Table.from_batches(ready))
            held.append(batch.slice(start))
            if sum(len(pc.list_flatten(x.column("docs"))) for x in held) >= TOGETHER * block:
                yield cut(pa.Table.from_batches(held))
                held = []
        if held:
            yield cut(pa.Table.from_batches(held))

    return blocks


def write_index(kb: DataFrame, path: str, config: dict) -> Index:
    """Reads the texts of kb (doc_id, title, text) once and writes the index to path.

    A document's terms are counted where its text is read; postings move once, in one row for each term of a batch of documents, to their term's blocks."""
    spark, k1, b = kb.sparkSession, config["bm25_k1"], config["bm25_b"]
    at = lambda name: f"{path}/{name}"
    read = lambda name: spark.read.schema(SCHEMAS[name]).parquet(at(name))
    lower_texts(kb).mapInArrow(_counted, SCHEMAS["documents"]).write.option("compression", "zstd").parquet(at("documents"))
    counted = read("documents")
    n_docs, avg_length = counted.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    repeated = bool(counted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())
    if repeated:  # Those of one id and length are one document, whose words add up; those of one id have one number.
        rows = counted.select("doc", "doc_id", "length", F.posexplode_outer(F.arrays_zip("terms", "tfs")).alias("at", "t")).groupBy("doc_id", "length", F.col("t.terms").alias("term"))
        rows = rows.agg(F.sum("t.tfs").cast("int").alias("tf"), F.min("doc").alias("doc")).groupBy("doc_id", "length")
        rows = rows.agg(F.min("doc").alias("doc"), F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))).alias("l"))
        least = F.min("doc").over(Window.partitionBy("doc_id"))
        merged = kept(rows.select(least.alias("doc"), "doc_id", "length", F.col("l.term").alias("terms"), F.col("l.tf").alias("tfs")), "index-merged")
        merged.write.mode("overwrite").option("compression", "zstd").parquet(at("documents"))
        dropped(merged)
    spark.createDataFrame([(n_docs, avg_length, repeated)], SCHEMAS["stats"]).write.parquet(at("stats"))
    weigh = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * (length / avg_length if avg_length > 0 else 0.0)))
    chunks = read("documents").mapInArrow(_by_term, "term string, docs array<long>, tfs array<int>, lengths array<int>")
    parts = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = chunks.repartition(parts, F.pmod(F.xxhash64("term"), F.lit(BUCKETS * SHARES))).sortWithinPartitions("term")
    blocks = chunks.mapInArrow(_in_blocks(weigh, BLOCK), "term string, most double, docs array<long>, weights array<double>").withColumn("bucket", _bucket("term"))
    blocks.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(at("blocks"))
    terms = read("blocks").groupBy("bucket", "term").agg(F.sum(F.size("docs")).alias("df"), F.max("most").alias("most"))
    terms = terms.withColumn("factor", idf(F.lit(n_docs), F.col("df"))).withColumn("most", F.col("most") * F.col("factor"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(at("terms"))
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()))


def _asked_only(terms: Broadcast[dict[str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, length, tids, tfs of documents, of the terms that are asked for only."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            words = pc.list_flatten(batch.column("terms")).dictionary_encode()
            known = np.fromiter((terms.value.get(t, -1) for t in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            tid = known[words.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
            doc, tfs = np.repeat(np.arange(batch.num_rows), size), pc.list_flatten(batch.column("tfs")).to_numpy()
            of = tid >= 0
            tid, doc, tfs = tid[of], doc[of], tfs[of]
            order = np.lexsort((tid, doc))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows))), pa.int32())
            both = (pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int32())) for x in (tid, tfs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("length"), *both], ["doc_id", "length", "tids", "tfs"])

    return lists


def search(index: Index, queries: DataFrame, config: dict, shift: float = 0.0) -> DataFrame:
    """query_id, rank, doc_id, score of the top_k documents of each query, as bm25_topk() gives them.

    The bound of a query is what top_k documents reach by its SEEDS terms that may add most (two units of the last digit
    less, for rounding). A block is unpacked only if its greatest weight and the most that all other terms may add reach it: then a
    document that can be among the best keeps all its postings, and others only lose score. Queries that together meet MANY postings
    reach nearly all blocks: then the documents' own lists of terms are read, once for all queries (best_in_blocks()). Texts aren't read."""
    k, digits = config["top_k"], config["score_precision"]
    asked = kept(query_terms(queries).withColumn("bucket", _bucket("term")), "search-asked")
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    send = F.broadcast if few else lambda table: table
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    own = lambda table: table.where(F.col("bucket").isin(buckets))
    counts = own(index.terms).select("bucket", "term", "df", "factor", "most")
    met = counts.join(send(asked), ["bucket", "term"]).agg(F.sum("df")).first()[0] or 0
    every = _by_documents(index, asked, counts, config) if met >= MANY else None
    if every is None:
        found = _reaching(own(index.blocks), counts.drop("df").join(send(asked), ["bucket", "term"]), k, digits, send)
        # Only documents whose rounded scores can be among the best are named.
        order = Window.partitionBy("query_id").orderBy(F.desc(rounded(F.col("score"), digits, shift)))
        found = kept(found.withColumn("r", F.rank().over(order)).where(F.col("r") <= k).drop("r"), "search-found")
        names = index.documents.select("doc", "doc_id")
        names = names.distinct() if index.stats.first().repeated else names
        every = names.join(if_small(found), "doc").select("query_id", "doc_id", "score")
    least = F.broadcast(index.documents.select("doc_id").orderBy("doc_id").limit(k))  # k rows
    fill = queries.select("query_id").join(least).withColumn("score", F.lit(0.0))
    every = every.unionByName(fill).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    every = every.withColumn("score", rounded(F.col("score"), digits, shift))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _by_documents(index: Index, asked: DataFrame, counts: DataFrame, config: dict) -> DataFrame | None:
    """query_id, doc_id, score by the documents' lists; none if the terms are too many to be known in each task."""
    # Terms that nobody asks for go before they are numbered.
    known = numbered(counts.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi"), "search-terms").select("term", "tid")
    if known.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return None
    n_docs, avg_length, repeated = index.stats.first()
    numbers = asked.sparkSession.sparkContext.broadcast({r.term: r.tid for r in known.collect()})  # BROADCAST_TERMS at most
    lists = kept(index.documents.select("doc_id", "length", "terms", "tfs").mapInArrow(_asked_only(numbers), "doc_id string, length long, tids array<int>, tfs array<int>"), "search-lists")
    values, weigh = block_values(lists, repeated, avg_length, config)
    factors = counts.join(F.broadcast(known), "term").select("tid", "factor")
    return best_in_blocks(values, asked.join(F.broadcast(known), "term").select("query_id", "tid", "times"), n_docs, config["top_k"], config["score_precision"], factors, weigh)


def _reaching(blocks: DataFrame, parts: DataFrame, k: int, digits: int, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, doc, score by the blocks that can reach their query's bound. parts: bucket, term, factor, most, query_id, times."""
    parts = parts.withColumn("gain", F.col("most") * F.col("times")).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "term")))
    parts = kept(parts.withColumn("rest", F.sum("gain").over(Window.partitionBy("query_id")) - F.col("gain")).withColumn("times", F.col("times") * F.col("factor")).drop("most", "factor", "gain"), "search-parts")
    unpacked = lambda rows: rows.select("query_id", "times", F.explode(F.arrays_zip("docs", "weights")).alias("p"))
    scored = lambda rows: unpacked(rows).groupBy("query_id", F.col("p.docs").alias("doc")).agg(F.sum(F.col("p.weights") * F.col("times")).alias("score"))
    first = scored(blocks.join(send(parts.where(F.col("n") <= SEEDS)), ["bucket", "term"]))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    bound = first.withColumn("m", F.row_number().over(best)).where(F.col("m") == k).select("query_id", (F.col("score") - 2 * 10.0**-digits).alias("bound"))
    wanted = kept(parts.join(bound, "query_id", "left"), "search-wanted")
    able = blocks.join(send(wanted), ["bucket", "term"]).where(F.col("bound").isNull() | (F.col("most") * F.col("times") + F.col("rest") >= F.col("bound")))
    return scored(able)
