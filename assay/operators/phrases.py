"""Many phrases against many texts: candidates by an equi-join on each phrase's rarest word, then the ladder on candidates only.

A phrase whose tokens must follow each other is only in texts that hold its rarest token; on stems, likewise. An exact phrase is a
substring, so its first and last word may be parts of longer ones: the words that hold its longest run of letters and digits are
looked up in the texts' vocabulary by three-character grams, and only the vocabulary, not the texts, is searched for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.matching import MAX_GAP, exact, exact_in, in_order_of_line, spaced
from assay.functions.text import stems, tokens, without_stopwords
from assay.operators.kept import kept
from assay.operators.retrieval import if_small, spread

#: Characters of a gram; phrases without any letter or digit that are compared with a text at once.
GRAM, BLOCK = 3, 500


def _runs(text: Column) -> Column:
    """Runs of ASCII letters and digits: what a substring of such characters lies within."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def _grams(word: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - size + 1, F.lit(1))), lambda i: F.substring(word, i, size)))


def _rarest(wanted: DataFrame, posted: DataFrame) -> DataFrame:
    """pattern_id, text_id: texts that hold the rarest word of a pattern. wanted: pattern_id, word; posted: word, text_id. A word that no text holds is the rarest of all."""
    counts = posted.join(if_small(wanted.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    least = wanted.join(counts, "word", "left").groupBy("pattern_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r"))
    # Postings are many and stay where they are; the words of few phrases go to them.
    rarest = if_small(least.where("r.n > 0").select("pattern_id", F.col("r.word").alias("word")))
    return posted.join(rarest, "word").select("pattern_id", "text_id")


def _containing(patterns: DataFrame, posted: DataFrame) -> DataFrame:
    """pattern_id, text_id: texts with a run that contains the longest run of a pattern. posted: word (a run), text_id."""
    longest = F.transform(_runs(F.col("pattern")), lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))
    part = patterns.select("pattern_id", F.array_min(longest)["r"].alias("part")).where("part IS NOT NULL")
    size = F.least(F.length("part"), F.lit(GRAM))
    parts = kept(part.select("part").distinct().select("part", size.alias("size")), "phrase-parts")
    words = posted.select("word").distinct()
    # Grams of each size that a part has; a part is looked up by its rarest one.
    grams = words.join(F.broadcast(parts.select("size").distinct())).select("word", F.explode(_grams(F.col("word"), F.col("size"))).alias("gram")).where(F.length("word") > 0)  # GRAM sizes
    wanted = parts.select("part", F.explode(_grams(F.col("part"), F.col("size"))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = wanted.join(counts, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("part", F.col("g.gram").alias("gram"))
    found = grams.join(best, "gram").where(F.contains("word", F.col("part"))).select("part", "word").distinct()
    return posted.join(if_small(part.join(found, "part").select("pattern_id", "word")), "word").select("pattern_id", "text_id")


def phrase_matches(patterns: DataFrame, texts: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """pattern_id, text_id, rung of every phrase and text that match: exact, subsequence or stemmed_subsequence.

    patterns: pattern_id, pattern. texts: text_id, text; ids are distinct. Null or blank phrases and null texts match nothing; equal phrases
    are joined once each. The rung is that of functions.matching.rung(); no product of phrases and texts is formed, but for
    phrases without any ASCII letter or digit, which are compared with each text in blocks."""
    patterns, texts = patterns.where("pattern IS NOT NULL"), spread(texts.where("text IS NOT NULL"))
    lists = texts.select("text_id", F.array_distinct(tokens(F.col("text"))).alias("t"), F.array_distinct(_runs(F.col("text"))).alias("r"))
    held = kept(lists.withColumn("s", F.array_distinct(stems(F.col("t")))), "phrase-texts")
    posted = lambda words: held.select("text_id", F.explode(words).alias("word"))
    wanted = lambda words: patterns.select("pattern_id", F.explode(F.array_distinct(words)).alias("word"))
    of = tokens(F.col("pattern"))
    # What a pair is a candidate for: 1 tokens, 2 stems, 4 a substring; it can't match otherwise.
    kinds = (_rarest(wanted(of), posted("t")), _rarest(wanted(stems(without_stopwords(of))), posted("s")), _containing(patterns, posted("r")))
    near = reduce(DataFrame.unionByName, (table.withColumn("kind", F.lit(1 << k)) for k, table in enumerate(kinds)))
    # A text meets all its phrases in one row, so that it is moved and taken apart once.
    near = near.join(if_small(patterns), "pattern_id").repartition("text_id").groupBy("text_id", "pattern_id", "pattern").agg(F.bit_or("kind").alias("kind"))
    near = near.groupBy("text_id").agg(F.collect_list(F.struct("pattern_id", "pattern", "kind")).alias("near"))
    words = near.join(texts, "text_id").withColumn("w", tokens(F.col("text")))
    lines = words.select("text_id", "near", F.lower("text").alias("text"), spaced(F.col("w")).alias("line"), spaced(stems(F.col("w"))).alias("stems"))
    pairs = lines.select("text_id", "text", "line", "stems", F.explode("near").alias("p"))
    for_ = lambda kind: F.col("p.kind").bitwiseAND(kind) != 0
    # A search for each word is cheaper than the regular expression, which few pairs get to.
    all_of = lambda of, line: F.forall(of, lambda t: F.contains(F.col(line), F.concat(F.lit(" "), t, F.lit(" "))))
    placed = lambda of, line: all_of(of, line) & in_order_of_line(of, F.col(line), max_gap)
    asked = tokens(F.col("p.pattern"))
    step = F.when(for_(4) & exact_in(F.col("p.pattern"), F.col("text")), "exact").when(for_(1) & placed(asked, "line"), "subsequence")
    step = step.when(for_(2) & placed(stems(without_stopwords(asked)), "stems"), "stemmed_subsequence")
    found = pairs.select("p.pattern_id", "text_id", step.alias("rung")).where("rung IS NOT NULL")
    bare = patterns.where((F.size(_runs(F.col("pattern"))) == 0) & (F.trim("pattern") != ""))
    blocks = bare.groupBy(F.pmod(F.xxhash64("pattern_id"), F.lit(max(1, -(-bare.count() // BLOCK)))).alias("b")).agg(F.collect_list(F.struct("pattern_id", "pattern")).alias("block")).select("block")
    hits = blocks.crossJoin(texts).select("text_id", F.explode(F.filter("block", lambda p: exact(p["pattern"], F.col("text")))).alias("p"))
    return found.unionByName(hits.select("p.pattern_id", "text_id", F.lit("exact").alias("rung")))
