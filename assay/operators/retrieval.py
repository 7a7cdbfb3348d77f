"""BM25 retrieval: corpus statistics, scores, and the top passages of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.grounding import rounded
from assay.functions.text import content_terms, stem, tokens, without_stopwords
from assay.operators.blocks import Weigh, best_in_blocks, listed, listed_texts, merged
from assay.operators.kept import kept
from assay.operators.ordered import with_running

#: A side of a join is broadcast only if it has at most so many rows.
BROADCAST_ROWS = 200_000


def if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if a count shows it to be small; else it is shuffled."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def spread(table: DataFrame) -> DataFrame:
    """The table, dealt out where it comes in fewer parts than there are cores (a small file); a large one isn't shuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def whole_text() -> Column:
    """What is searched of a document."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))


def lower_texts(kb: DataFrame) -> DataFrame:
    """row, doc_id, text of each document: a number, and its title and text in lower case."""
    return spread(kb.select("doc_id", "title", "text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lower(whole_text()).alias("text"))


def document_terms(kb: DataFrame) -> DataFrame:
    """doc_id, length and content words of each document's title and text; stems are made of exploded rows, in generated code."""
    kb = spread(kb.select("doc_id", "title", "text"))
    words = without_stopwords(tokens(whole_text()))
    return kb.select("doc_id", words.alias("words")).withColumn("length", F.size("words").cast("long"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: n_docs and avg_length (0 for no documents)."""
    return documents.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times: how often each content term is asked for."""
    return queries.select("query_id", F.explode(content_terms(F.col("user_question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def postings(documents: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """doc_id, length, term, tf; of the terms of vocabulary only, if given: others can't score."""
    rows = documents.select("doc_id", "length", F.explode("words").alias("word")).select("doc_id", "length", stem(F.col("word")).alias("term"))
    if vocabulary is not None:
        rows = rows.join(if_small(vocabulary.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, length: Column, avg_length: Column, k1: float, b: float) -> Column:
    norm = F.when(avg_length > 0, length / avg_length).otherwise(0.0)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm))


#: Postings that the queries meet, counted before, from which on documents are pruned in blocks: below, joins cost less.
PRUNE_FROM = 5_000_000
#: Terms that are broadcast at most.
BROADCAST_TERMS = 500_000


def numbered(counts: DataFrame, name: str) -> DataFrame:
    """term, df, tid: the terms with numbers, to be broadcast if they are few."""
    return if_small(with_running(counts.select("term", "df"), ["term"], "df", name).select("term", "df", F.col("pos").cast("int").alias("tid")), BROADCAST_TERMS)


def _scores(weighed: DataFrame, some: DataFrame) -> DataFrame:
    """query_id, doc_id, score by the query terms `some` (query_id, tid, times)."""
    return weighed.join(some, "tid").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("times")).alias("score"))


def block_values(lists: DataFrame, repeated: bool, avg_length: float, config: dict) -> tuple[DataFrame, Weigh | None]:
    """What best_in_blocks() takes as values, and its weigh(), of lists (doc_id, length, tids, tfs). repeated: a doc_id may have several."""
    k1, b = config["bm25_k1"], config["bm25_b"]
    if repeated:  # Documents of one id add up, whatever their lengths.
        rows = lists.select("doc_id", "length", F.explode(F.arrays_zip("tids", "tfs")).alias("t"))
        return rows.select("doc_id", F.col("t.tids").alias("tid"), bm25_weight(F.col("t.tfs"), F.col("length"), F.lit(avg_length), k1, b).alias("weight")), None
    return lists, lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * (length / avg_length if avg_length > 0 else 0.0)))


def bm25_topk(kb: DataFrame, queries: DataFrame, config: dict, shift: float = 0.0) -> DataFrame:
    """query_id, rank, doc_id, score of the top_k documents of each query.

    Scores are rounded first and ranked then, ties by doc_id as text. Documents that score 0 fill up:
    as no score is negative, they can only be among the top_k least ids, so those are added to the
    documents that share a term, and no product of queries and documents is formed. Texts are read once
    and stay out of every shuffle, as do their words: a task makes one row of a document's terms. Join texts to the result. Where
    queries meet very many postings, scores are formed in blocks of documents, which send on only those that can be among the best
    (best_in_blocks()); the result is the same."""
    k, k1, b, digits = config["top_k"], config["bm25_k1"], config["bm25_b"], config["score_precision"]
    asked = kept(query_terms(queries), "bm25-asked")
    # The empty word stands for its document, so that documents without any of the terms count, too.
    terms = asked.select("term").distinct().unionByName(asked.sparkSession.range(1).select(F.lit("").alias("term")))
    # No table of terms that is broadcast below has more rows than these.
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    send = F.broadcast if few else lambda table: table
    known = numbered(terms.withColumn("df", F.lit(0)), "bm25-terms").select("term", "tid")
    if few:
        numbers = kb.sparkSession.sparkContext.broadcast({r.term: r.tid for r in known.collect()})  # BROADCAST_TERMS at most
        lists = listed_texts(lower_texts(kb), numbers)
    else:
        documents = document_terms(kb).select(F.monotonically_increasing_id().alias("row"), "doc_id", "length", F.array_append("words", F.lit("")).alias("words"))
        rows = documents.select("row", "doc_id", "length", F.explode("words").alias("word")).select("row", "doc_id", "length", stem(F.col("word")).alias("term"))
        lists = listed(rows.join(known, "term"))
    lists = kept(lists, "bm25-postings")
    n_docs, avg_length = lists.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    repeated = lists.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeated:
        lists = kept(merged(lists), "bm25-merged")
    counts = kept(lists.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df")), "bm25-counts")
    counts = counts.join(send(known.where("term <> ''")), "tid").select("tid", "df")
    asked = asked.join(send(known), "term").select("query_id", "tid", "times")
    rarity = idf(F.lit(n_docs), F.col("df"))
    weight = lambda tf: bm25_weight(tf, F.col("length"), F.lit(avg_length), k1, b)
    met = asked.join(send(counts), "tid").agg(F.sum("df")).first()[0] or 0
    if met < PRUNE_FROM:
        posted = lists.select("doc_id", "length", F.explode(F.arrays_zip("tids", "tfs")).alias("t")).select("doc_id", "length", F.col("t.tids").alias("tid"), F.col("t.tfs").alias("tf"))
        weighed = posted.join(send(counts), "tid").select("tid", "doc_id", (rarity * weight(F.col("tf"))).alias("weight"))
        scores = _scores(weighed, if_small(asked))
    else:
        values, weigh = block_values(lists.select("doc_id", "length", *(F.slice(c, 2, F.size("tids")).alias(c) for c in ("tids", "tfs"))), bool(repeated), avg_length, config)
        scores = best_in_blocks(values, asked, n_docs, k, digits, counts.select("tid", rarity.alias("factor")), weigh)
    first = F.broadcast(kb.select("doc_id").orderBy("doc_id").limit(k))  # k rows
    fill = queries.select("query_id").join(first).withColumn("score", F.lit(0.0))
    scored = scores.unionByName(fill).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    scored = scored.withColumn("score", rounded(F.col("score"), digits, shift))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def passages(top: DataFrame, kb: DataFrame, queries: DataFrame, most_queries: int = 20_000) -> DataFrame:
    """query_id, retrieved: the ranked passages with title and text, only now joined.

    top has top_k rows for each query, so a count of the queries tells whether it may be broadcast; else its own rows are counted, and where they
    are too many, only texts that it names are shuffled, found by their ids where those are few enough to be broadcast."""
    texts = kb.select("doc_id", "title", "text")
    small = queries.limit(most_queries + 1).count() <= most_queries
    if not small:
        top = kept(top, "retrieved-ids")
        small = top.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if not small:
        texts = texts.join(if_small(top.select("doc_id").distinct(), BROADCAST_TERMS), "doc_id", "left_semi")
    ranked = (F.broadcast(top) if small else top).join(texts, "doc_id")
    row = F.struct("rank", "doc_id", "score", "title", "text")
    bare = lambda p: F.struct(p["doc_id"].alias("doc_id"), p["score"].alias("score"), p["title"].alias("title"), p["text"].alias("text"))
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(row)), bare).alias("retrieved"))
