"""Each operator as a query over the test tables, with the SQL that DuckDB must agree with.

The tables hold no questions with constraints, so inputs are derived: documents are the knowledge base,
benchmark items or first user turns the questions, assistant turns the answers of variants turn_<n>."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions.grounding import unsupported_numbers, with_evidence, with_grounding
from assay.functions.matching import exact, in_order, matches, rung
from assay.functions.text import LEAST_STEM, STOPWORDS, SUFFIXES, content_terms, stem, stems, tokens, without_stopwords
from assay.operators import validate
from assay.operators.aggregate import contributions, recommendation, tag_counts, tradeoffs, verdicts
from assay.operators.batches import judge_in_batches, prompt_batches
from assay.operators.checks import dealt, long_answers, score_answers
from assay.operators.index import open_index, search, write_index
from assay.operators.kept import kept, kept_alone, shared_folder
from assay.operators.judge import build_prompt, cached_calls, prompt_hash_column, review_entry_issues, stub_payload, stub_reviews, stub_winner, wide_reviews
from assay.operators.phrases import phrase_matches
from assay.operators.retrieval import bm25_topk, corpus_stats, document_frequency, document_terms, passages, postings, query_terms
from assay.operators.taxonomy import MARKERS, failure_tags, has_marker, severity
from assay.plans.config import defaults
from assay.plans.pipeline import report_lines
from assay.plans.stored import read_records, stored_differences
from assay.sources.artifacts import broken_lines, file_hashes, read_call_log
from assay.sources.inputs import read_array, text_field, typed_records
from assay.sources.sinks import write_array, write_pieces

#: Moves values off rounding ties, where engines differ.
SHIFT = 1e-9
CONFIG = defaults()


class Tables:
    """Engine inputs of one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.read = spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def kb(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), "text")

    def _queries(self, rows: DataFrame) -> DataFrame:
        """rows: id, user_question."""
        level = F.when(F.col("id") % 5 == 0, "low").when(F.col("id") % 5 == 1, "medium").when(F.col("id") % 5 == 2, "high").when(F.col("id") % 5 == 3, "critical").otherwise("severe")
        some = lambda a, b: F.filter(F.array(F.array_join(F.slice("_t", a, b), " ")), lambda x: x != "")
        none = F.array().cast("array<string>")
        out = rows.withColumn("_t", tokens(F.col("user_question")))
        return out.select(
            F.col("id").cast("string").alias("query_id"), F.col("id").alias("q_ord"), "user_question", level.alias("risk_level"),
            F.when(F.col("id") % 3 == 0, none).when(F.col("id") % 10 == 1, F.array(F.col("id").cast("string"), (F.col("id") + 100000000).cast("string"))).otherwise(F.array(F.col("id").cast("string"))).alias("expected_doc_ids"),
            F.when(F.col("id") % 4 == 3, none).otherwise(some(1, 2)).alias("must_include_any"), some(3, 2).alias("must_not_claim"),
        )

    def questions(self) -> DataFrame:
        return self._queries(self.read("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("user_question")))

    def chats(self) -> DataFrame:
        """Conversations as queries: the first user turn asks."""
        first = self.read("conversations").where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("m"))
        return self._queries(first.select(F.col("conv_id").alias("id"), F.col("m.text").alias("user_question")))

    def answers(self) -> DataFrame:
        rows = self.read("conversations").where("role = 'assistant'")
        return rows.select(F.col("conv_id").cast("string").alias("query_id"), F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("variant"), F.col("text").alias("answer"), F.col("conv_id").alias("a_ord"), F.col("turn").alias("v_pos"))

    def top(self) -> DataFrame:
        """Ranks of retrieval, kept before texts are joined: so what they were made of is gone before texts move."""
        return kept_alone(lambda: bm25_topk(self.kb(), self.chats(), CONFIG["retrieval"], SHIFT), "retrieved-top")

    def retrieval(self) -> DataFrame:
        return passages(self.top(), self.kb(), self.chats())

    def scores(self) -> DataFrame:
        return score_answers(self.chats(), self.answers(), self.retrieval(), CONFIG, SHIFT)

    def reviews(self) -> DataFrame:
        """Reviews of all answers but those of queries that 7 divides; scores by labels where there are any."""
        labels = self.read("labels").select(F.col("doc_id").cast("string").alias("query_id"), "quality", "toxic")
        rows = self.answers().where(F.col("a_ord") % 7 != 0).join(labels, "query_id", "left")
        winner = F.concat(F.lit("turn_"), (F.col("a_ord") % 3 + 1).cast("string"))
        score = (1 + 4 * F.coalesce("quality", F.lit(0))).cast("int")
        return rows.select("query_id", "variant", score.alias("faithfulness"), (1 + (F.col("v_pos") + F.col("a_ord")) % 5).cast("int").alias("clarity"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("overclaim"), winner.alias("winner"))

    def light_scores(self) -> DataFrame:
        """Scores as the later stages read them, made without retrieval: hit and grounding follow from lengths and ids."""
        rows = self.answers().join(self.chats(), "query_id")
        found = lambda c: F.size(matches(F.col(c), F.col("answer"), F.col("w"), F.col("s")))
        rows = rows.withColumn("w", tokens(F.col("answer"))).withColumn("s", stems(F.col("w")))
        numeric = F.when(F.length("answer") % 6 == 0, F.array(F.lit("unsupported_numeric"))).otherwise(F.array(F.lit("none")))
        return rows.select(
            "query_id", "variant", (F.length("answer") % 4 != 0).alias("retrieval_hit"), ((F.size("must_include_any") == 0) | (found("must_include_any") > 0)).alias("must_include_pass"),
            (found("must_not_claim") == 0).alias("must_not_claim_pass"), (F.length("answer") % 101 / 100.0).alias("grounding_score"), numeric.alias("risk_flags"),
        )

    def evidence(self) -> DataFrame:
        """Evidence of the prompts: none beside light scores."""
        return self.spark.createDataFrame([], "query_id string, retrieved array<struct<doc_id:string,score:double,title:string,text:string>>")

    def tags(self) -> DataFrame:
        return failure_tags(self.light_scores(), self.chats(), self.answers(), self.reviews(), CONFIG)

    def verdicts(self) -> DataFrame:
        return verdicts(self.light_scores(), self.chats(), self.reviews(), self.tags(), CONFIG, SHIFT)


class Evaluated(Tables):
    """The same inputs with real retrieval and scores for the later stages; scores are computed once and kept."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark, sf_dir)
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = kept_alone(make, name)
        return self._kept[name]

    def retrieval(self) -> DataFrame:
        return self._kept["evaluated-retrieval"] if "evaluated-retrieval" in self._kept else super().retrieval()

    def light_scores(self) -> DataFrame:
        return self._once("evaluated-scores", self.scores)

    def evidence(self) -> DataFrame:
        """Texts are kept only where prompts need them beside the scores."""
        return self._once("evaluated-retrieval", super().retrieval)


# ---- SQL pieces ------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+(?:''[a-z]+)?')"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def _sql_tokens(text: str) -> str:
    return f"coalesce({_TOK.format(text)}, [])"


def _sql_stem(t: str) -> str:
    rules = " ".join(f"WHEN {t} LIKE '%{suffix}' AND length({t}) >= {LEAST_STEM + len(suffix) - len(to)} THEN left({t}, length({t}) - {len(suffix)}) || '{to}'" for suffix, to in SUFFIXES)
    return f"CASE {rules} ELSE {t} END"


def _sql_terms(text: str) -> str:
    return f"list_transform(list_filter({_sql_tokens(text)}, lambda t: t NOT IN {_STOP}), lambda t: {_sql_stem('t')})"


_KB = "kb AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, text FROM documents)"
_LEVEL = "CASE id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'severe' END"


def _sql_queries(rows: str, name: str) -> str:
    return f"""{name}_t AS (SELECT id, user_question, {_sql_tokens('user_question')} AS t FROM ({rows})),
{name} AS (SELECT CAST(id AS VARCHAR) AS query_id, id AS q_ord, user_question, {_LEVEL} AS risk_level,
  CASE WHEN id % 3 = 0 THEN [] WHEN id % 10 = 1 THEN [CAST(id AS VARCHAR), CAST(id + 100000000 AS VARCHAR)] ELSE [CAST(id AS VARCHAR)] END AS expected_doc_ids,
  CASE WHEN id % 4 = 3 OR len(t) = 0 THEN [] ELSE [array_to_string(t[1:2], ' ')] END AS must_include_any,
  CASE WHEN len(t) < 3 THEN [] ELSE [array_to_string(t[3:4], ' ')] END AS must_not_claim FROM {name}_t)"""


_QUESTIONS = _sql_queries("SELECT item_id AS id, text AS user_question FROM benchmark", "questions")
_CHATS = _sql_queries("SELECT conv_id AS id, arg_min(text, turn) AS user_question FROM conversations WHERE role = 'user' GROUP BY conv_id", "chats")
_ANSWERS = "answers AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, 'turn_' || turn AS variant, text AS answer, conv_id AS a_ord, turn AS v_pos FROM conversations WHERE role = 'assistant')"
_SEVERITY = "CASE risk_level WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 4 END"


def _sql_bm25(queries: str) -> str:
    return f"""terms AS (SELECT doc_id, {_sql_terms("coalesce(title, '') || ' ' || coalesce(text, '')")} AS w FROM kb),
stats AS (SELECT count(*) AS n, coalesce(avg(len(w)), 0.0) AS al FROM terms),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_sql_terms('user_question')}) AS term FROM {queries}) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, sum(qf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))) AS s
  FROM post JOIN qt USING (term) JOIN dfs USING (term), stats GROUP BY ALL),
scored AS (SELECT q.query_id, k.doc_id, round(coalesce(s, 0.0::DOUBLE) + 1e-9::DOUBLE, 4) AS score FROM (SELECT query_id FROM {queries}) q CROSS JOIN (SELECT doc_id FROM kb) k LEFT JOIN hits h ON h.query_id = q.query_id AND h.doc_id = k.doc_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 2)"""


def _sql_needle(p: str) -> str:
    return f"lower(trim({p}))"


def _sql_order(p: str, words: str) -> str:
    """Two tokens at most: going back makes no difference to them."""
    return f"""CASE WHEN len({p}) = 0 THEN false WHEN len({p}) = 1 THEN list_contains({words}, {p}[1])
  ELSE len(list_filter(range(1, len({words}) + 1), lambda i: {words}[i] = {p}[1] AND list_contains({words}[i + 1:i + 3], {p}[2]))) > 0 END"""


def _sql_rung(p: str, text: str, words: str, word_stems: str) -> str:
    return f"""CASE WHEN {_sql_needle(p)} <> '' AND contains(lower({text}), {_sql_needle(p)}) THEN 'exact'
  WHEN {_sql_order(_sql_tokens(p), words)} THEN 'subsequence'
  WHEN {_sql_order(_sql_terms(p), word_stems)} THEN 'stemmed_subsequence' END"""


_PAIRS = f"""{_CHATS}, {_ANSWERS},
pairs AS (SELECT a.*, c.user_question, c.risk_level, c.expected_doc_ids, c.must_include_any, c.must_not_claim, {_sql_tokens('answer')} AS w, list_transform({_sql_tokens('answer')}, lambda t: {_sql_stem('t')}) AS s,
  must_include_any[1] AS pi, must_not_claim[1] AS pn FROM answers a JOIN chats c USING (query_id)),
runged AS (SELECT *, CASE WHEN pi IS NOT NULL THEN {_sql_rung('pi', 'answer', 'w', 's')} END AS ri, CASE WHEN pn IS NOT NULL THEN {_sql_rung('pn', 'answer', 'w', 's')} END AS rn FROM pairs)"""
_LIGHT = f"""{_PAIRS},
scores AS (SELECT query_id, variant, length(answer) % 4 <> 0 AS retrieval_hit, len(must_include_any) = 0 OR ri IS NOT NULL AS must_include_pass, rn IS NULL AS must_not_claim_pass,
  (length(answer) % 101) / 100.0::DOUBLE AS grounding_score, length(answer) % 6 = 0 AS numeric, risk_level, answer, a_ord FROM runged)"""
_REVIEWS = """reviews AS (SELECT a.query_id, a.variant, CAST(1 + 4 * coalesce(l.quality, 0) AS INT) AS faithfulness, CAST(1 + (v_pos + a_ord) % 5 AS INT) AS clarity, coalesce(l.toxic = 1, false) AS overclaim, 'turn_' || (a_ord % 3 + 1) AS winner
  FROM answers a LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = a.query_id WHERE a_ord % 7 <> 0)"""
_MARKED = "regexp_matches(answer, '(?i)\\b(" + "|".join(MARKERS) + ")\\b')"
_TAGS = f"""tagged AS (SELECT s.query_id, s.variant, list_filter([
  CASE WHEN NOT must_not_claim_pass OR numeric OR coalesce(r.overclaim, false) THEN 'unsupported_claim' END, CASE WHEN NOT must_include_pass THEN 'missed_key_fact' END,
  CASE WHEN NOT must_not_claim_pass AND {_SEVERITY} >= 3 THEN 'policy_violation' END, CASE WHEN NOT retrieval_hit THEN 'retrieval_miss' END,
  CASE WHEN {_MARKED} AND (NOT must_not_claim_pass OR grounding_score < 0.3) THEN 'overconfident_tone' END, CASE WHEN NOT retrieval_hit AND grounding_score < 0.3 THEN 'irrelevant_answer' END], lambda x: x IS NOT NULL) AS tags
  FROM scores s LEFT JOIN reviews r USING (query_id, variant))"""
_CONTRIB = f"""contrib AS (SELECT s.*, r.faithfulness, r.clarity, r.winner, NOT must_not_claim_pass AND {_SEVERITY} >= 3 AS gated,
  retrieval_hit::INT * 0.1::DOUBLE + must_include_pass::INT * 0.2::DOUBLE + must_not_claim_pass::INT * 0.25::DOUBLE + grounding_score * 0.2::DOUBLE
  + coalesce((r.faithfulness - 1) / 4.0::DOUBLE, 0.0) * 0.15::DOUBLE + coalesce((r.clarity - 1) / 4.0::DOUBLE, 0.0) * 0.05::DOUBLE + coalesce((r.winner = s.variant)::INT, 0) * 0.05::DOUBLE AS contribution
  FROM scores s LEFT JOIN reviews r USING (query_id, variant))"""
_VERDICTS = """verdicts AS (SELECT variant, bool_or(gated) AS disqualified, round(avg(contribution) + 1e-9::DOUBLE, 4) AS composite_score, round(avg(clarity) + 1e-9::DOUBLE, 2) AS mean_clarity,
  round(avg(faithfulness) + 1e-9::DOUBLE, 2) AS mean_faithfulness, count(*) FILTER (WHERE winner = variant) AS judge_wins FROM contrib GROUP BY variant)"""
_DECIDE = f"{_LIGHT}, {_REVIEWS}, {_CONTRIB}, {_VERDICTS}"
_EVIDENCE = f"""{_KB}, {_CHATS}, {_ANSWERS}, {_sql_bm25('chats')},
ev AS (SELECT query_id, string_agg(coalesce(title, '') || ' ' || coalesce(text, ''), ' ' ORDER BY rank) AS evidence, list(doc_id) AS ids FROM top JOIN kb USING (doc_id) GROUP BY query_id),
base AS (SELECT a.query_id, a.variant, answer, a_ord, evidence, ids, {_sql_tokens('answer')} AS w, {_sql_terms('answer')} AS c FROM answers a JOIN ev USING (query_id)),
evt AS (SELECT query_id, list_distinct({_sql_terms('evidence')}) AS et, lower(evidence) AS le FROM ev),
parts AS (SELECT b.*, le, CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda t: list_contains(et, t))) / len(c)::DOUBLE ELSE 0.0 END AS p,
  len(w) >= 4 AND len(list_filter(range(1, len(w) - 2), lambda i: contains(le, array_to_string(w[i:i + 3], ' ')))) > 0 AS q,
  list_sort(list_distinct(list_filter(regexp_extract_all(answer, '[0-9][0-9,]*(?:\\.[0-9]+)?%?'), lambda x: NOT contains(le, x)))) AS lost FROM base b JOIN evt USING (query_id)),
grounded AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.85::DOUBLE * p + CASE WHEN q THEN 0.15::DOUBLE ELSE 0.0 END - CASE WHEN len(lost) > 0 THEN 0.25::DOUBLE ELSE 0.0 END)) + 1e-9::DOUBLE, 4) AS score FROM parts)"""

# ---- queries ---------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_sql_tokens('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(t: Tables) -> DataFrame:
    return t.read("documents").select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT term, {_sql_stem('term')} AS stem FROM (SELECT unnest({_sql_tokens('text')}) AS term FROM documents)")
def stem_vocab(t: Tables) -> DataFrame:
    words = t.read("documents").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", stem(F.col("term")).alias("stem"))


@query(f"SELECT doc_id, len({_sql_tokens('text')}) AS n_tokens, len(list_filter({_sql_tokens('text')}, lambda t: t NOT IN {_STOP})) AS n_content FROM documents")
def stopword_filter(t: Tables) -> DataFrame:
    rows = t.read("documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(without_stopwords(F.col("w"))).cast("long").alias("n_content"))


@query(f"SELECT item_id, array_to_string({_sql_terms('text')}, ' ') AS terms FROM benchmark")
def normalized_questions(t: Tables) -> DataFrame:
    return t.read("benchmark").select("item_id", F.array_join(content_terms(F.col("text")), " ").alias("terms"))


@query(f"WITH {_KB}, {_QUESTIONS}, {_sql_bm25('questions')} SELECT query_id, rank, doc_id, score FROM top")
def bm25_topk_questions(t: Tables) -> DataFrame:
    return bm25_topk(t.kb(), t.questions(), CONFIG["retrieval"], SHIFT).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query(f"WITH {_KB}, {_QUESTIONS}, {_sql_bm25('questions')} SELECT term, df FROM dfs WHERE term IN (SELECT term FROM qt)")
def bm25_doc_freq(t: Tables) -> DataFrame:
    return document_frequency(postings(document_terms(t.kb()), query_terms(t.questions())))


@query(f"WITH {_KB}, {_QUESTIONS}, {_sql_bm25('questions')} SELECT term, df FROM dfs")
def bm25_corpus_doc_freq(t: Tables) -> DataFrame:
    """Document frequency of every term of the corpus; bm25_doc_freq has those that a question asks for."""
    return document_frequency(postings(document_terms(t.kb())))


@query(f"WITH {_KB}, {_QUESTIONS}, {_sql_bm25('questions')} SELECT n AS n_docs, round(al, 6) AS avg_length FROM stats")
def bm25_corpus_stats(t: Tables) -> DataFrame:
    return corpus_stats(document_terms(t.kb())).select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query(f"WITH {_KB}, {_CHATS}, {_sql_bm25('chats')}, r AS (SELECT query_id, list(doc_id) AS ids FROM top GROUP BY query_id) SELECT query_id, len(expected_doc_ids) = 0 OR list_has_any(expected_doc_ids, ids) AS retrieval_hit FROM chats JOIN r USING (query_id)")
def retrieval_hit(t: Tables) -> DataFrame:
    from assay.operators.checks import retrieval_hit as hit

    # No text moves: ids are all that is compared.
    found = t.top().groupBy("query_id").agg(F.collect_list(F.struct("doc_id")).alias("retrieved"))
    rows = t.chats().join(found, "query_id")
    return rows.select("query_id", hit(F.col("expected_doc_ids"), F.col("retrieved")).alias("retrieval_hit"))


@query(f"WITH {_KB}, {_CHATS}, {_sql_bm25('chats')} SELECT query_id, string_agg(doc_id || ':' || length(text), ',' ORDER BY rank) AS passages FROM top JOIN kb USING (doc_id) GROUP BY query_id")
def retrieved_passages(t: Tables) -> DataFrame:
    say = F.transform("retrieved", lambda p: F.concat(p["doc_id"], F.lit(":"), F.length(p["text"]).cast("string")))
    return t.retrieval().select("query_id", F.array_join(say, ",").alias("passages"))


def _phrases(t: Tables) -> DataFrame:
    rows = t.answers().join(t.chats().select("query_id", "must_not_claim"), "query_id")
    rows = rows.select("query_id", "variant", "answer", F.explode("must_not_claim").alias("pattern"))
    return rows.withColumn("w", tokens(F.col("answer"))).withColumn("s", stems(F.col("w")))


_PHRASES = f"WITH {_PAIRS} SELECT query_id, variant, {{}} FROM runged WHERE pn IS NOT NULL"


@query(_PHRASES.format(f"contains(lower(answer), {_sql_needle('pn')}) AS matched"))
def exact_match(t: Tables) -> DataFrame:
    return _phrases(t).select("query_id", "variant", exact(F.col("pattern"), F.col("answer")).alias("matched"))


@query(_PHRASES.format(f"{_sql_order(_sql_tokens('pn'), 'w')} AS matched"))
def subsequence_match(t: Tables) -> DataFrame:
    return _phrases(t).select("query_id", "variant", in_order(tokens(F.col("pattern")), F.col("w")).alias("matched"))


@query(_PHRASES.format("rn AS rung"))
def match_ladder(t: Tables) -> DataFrame:
    return _phrases(t).select("query_id", "variant", rung(F.col("pattern"), F.col("answer"), F.col("w"), F.col("s")).alias("rung"))


_TOP_OF_BOTH = "SELECT '{0}' AS kind, query_id, rank, doc_id, score FROM (WITH " + _KB + ", {1}, {2} SELECT * FROM top)"


@query(_TOP_OF_BOTH.format("chats", _CHATS, _sql_bm25("chats")) + " UNION ALL " + _TOP_OF_BOTH.format("questions", _QUESTIONS, _sql_bm25("questions")))
def bm25_stored_index(t: Tables) -> DataFrame:
    """Two searches of one stored index: texts are read once, when it is written."""
    path = f"{shared_folder(t.spark)}/bm25-index-{uuid.uuid4().hex}"
    write_index(t.kb(), path, CONFIG["retrieval"])
    ranked = lambda kind, queries: kept_alone(lambda: search(open_index(t.spark, path), queries, CONFIG["retrieval"], SHIFT), f"found-{kind}")
    found = {"chats": ranked("chats", t.chats()), "questions": ranked("questions", t.questions())}
    both = found["chats"].withColumn("kind", F.lit("chats")).unionByName(found["questions"].withColumn("kind", F.lit("questions")))
    return both.select("kind", "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def _sql_greedy(p: str, words: str) -> str:
    """Any number of tokens: from each place of the first one, each next token where it is next seen among three words, without going back."""
    step = " ".join(f"WHEN {words}[a + {d}] = {p}[k] THEN a + {d}" for d in (1, 2, 3))
    return f"""CASE WHEN len({p}) = 0 OR NOT list_has_all({words}, {p}) THEN false
  ELSE len(list_filter(range(1, len({words}) + 1), lambda i: {words}[i] = {p}[1] AND list_reduce(list_prepend(i, range(2, len({p}) + 1)), lambda a, k: CASE WHEN a = 0 THEN 0 {step} ELSE 0 END) > 0)) > 0 END"""


_ITEM_PHRASES = f"""items AS (SELECT item_id, {_sql_tokens('text')} AS t, text FROM benchmark),
phrases AS (SELECT item_id || ':' || kind AS pattern_id, pattern FROM (
  SELECT item_id, 'three' AS kind, array_to_string(t[2:4], ' ') AS pattern FROM items WHERE len(t) >= 6 UNION ALL
  SELECT item_id, 'gap', t[1] || ' ' || t[3] || ' ' || t[5] || ' ' || t[6] FROM items WHERE len(t) >= 6 UNION ALL
  SELECT item_id, 'stem', t[2] || 's ' || t[4] || 'ing ' || t[5] || 'ed' FROM items WHERE len(t) >= 6 UNION ALL
  SELECT item_id, 'part', substr(text, 8, 13) FROM items UNION ALL
  SELECT item_id, 'word', t[len(t)] || t[1] FROM items WHERE len(t) >= 6))"""


@query(f"""WITH {_ITEM_PHRASES}, x AS (SELECT doc_id, text, {_sql_tokens('text')} AS w, list_transform({_sql_tokens('text')}, lambda t: {_sql_stem('t')}) AS s FROM documents),
p AS (SELECT *, {_sql_tokens('pattern')} AS pt, {_sql_terms('pattern')} AS ps FROM phrases),
r AS (SELECT pattern_id, doc_id, CASE WHEN {_sql_needle('pattern')} <> '' AND contains(lower(text), {_sql_needle('pattern')}) THEN 'exact'
  WHEN {_sql_greedy('pt', 'w')} THEN 'subsequence' WHEN {_sql_greedy('ps', 's')} THEN 'stemmed_subsequence' END AS rung FROM p, x)
SELECT pattern_id, doc_id AS text_id, rung FROM r WHERE rung IS NOT NULL""")
def phrases_in_documents(t: Tables) -> DataFrame:
    """Phrases of three and more tokens of each benchmark item, with gaps and other endings, and pieces of its text, in all documents."""
    item = t.read("benchmark").select("item_id", "text", tokens(F.col("text")).alias("t"))
    at = lambda k: F.get("t", k - 1)
    joined = lambda *parts: F.concat_ws(" ", *parts)
    kinds = {
        "three": joined(at(2), at(3), at(4)), "gap": joined(at(1), at(3), at(5), at(6)), "stem": joined(F.concat(at(2), F.lit("s")), F.concat(at(4), F.lit("ing")), F.concat(at(5), F.lit("ed"))),
        "part": F.substring("text", 8, 13), "word": F.concat(F.element_at("t", -1), at(1)),
    }
    rows = item.select("item_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.when((F.size("t") >= 6) | F.lit(k == "part"), v).alias("pattern")) for k, v in kinds.items()))).alias("p"))
    patterns = rows.where("p.pattern IS NOT NULL").select(F.concat(F.col("item_id").cast("string"), F.lit(":"), "p.kind").alias("pattern_id"), "p.pattern")
    return phrase_matches(patterns, t.read("documents").select(F.col("doc_id").alias("text_id"), "text"))


@query(f"WITH {_EVIDENCE} SELECT query_id, variant, q AS quote, round(p + 1e-9::DOUBLE, 4) AS precision, score AS grounding_score, array_to_string(lost, ',') AS unsupported FROM grounded")
def grounding_score(t: Tables) -> DataFrame:
    ev = with_evidence(t.retrieval()).drop("retrieved")
    rows = dealt(t.answers()).join(ev, "query_id").withColumn("words", tokens(F.col("answer")))
    return with_grounding(rows, CONFIG["grounding"], SHIFT).select("query_id", "variant", "quote", "precision", "grounding_score", F.array_join("unsupported", ",").alias("unsupported"))


@query("WITH b AS (SELECT page_id, html, lower(url) AS url FROM pages) SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '[0-9][0-9,]*(?:\\.[0-9]+)?%?'), lambda x: NOT contains(url, x)))), ' ') AS numbers FROM b")
def numbers_not_in_evidence(t: Tables) -> DataFrame:
    """Numbers of a page that its address doesn't bear out: the number check where there are numbers."""
    return t.read("pages").select("page_id", F.array_join(unsupported_numbers(F.col("html"), F.lower("url")), " ").alias("numbers"))


_SCORED = f"""WITH {_EVIDENCE}, ph AS (SELECT query_id, variant, len(expected_doc_ids) = 0 AS free, expected_doc_ids, must_include_any, must_not_claim, pi, pn, ri, rn FROM (
  SELECT *, CASE WHEN pi IS NOT NULL THEN {_sql_rung('pi', 'answer', 'w', 's')} END AS ri, CASE WHEN pn IS NOT NULL THEN {_sql_rung('pn', 'answer', 'w', 's')} END AS rn FROM (
  SELECT a.query_id, a.variant, answer, expected_doc_ids, must_include_any, must_not_claim, {_sql_tokens('answer')} AS w, list_transform({_sql_tokens('answer')}, lambda t: {_sql_stem('t')}) AS s, must_include_any[1] AS pi, must_not_claim[1] AS pn FROM answers a JOIN chats USING (query_id)))),
f AS (SELECT g.*, free OR list_has_any(expected_doc_ids, ids) AS hit, len(must_include_any) = 0 OR ri IS NOT NULL AS inc, rn IS NULL AS clean, pi, pn, ri, rn, len(must_include_any) AS ni, len(must_not_claim) AS nn FROM grounded g JOIN ph USING (query_id, variant))
SELECT query_id, variant, hit AS retrieval_hit, inc AS must_include_pass, clean AS must_not_claim_pass, score AS grounding_score,
  coalesce(nullif(concat_ws(',', CASE WHEN NOT hit THEN 'retrieval_miss' END, CASE WHEN NOT inc THEN 'missing_required_phrase' END, CASE WHEN NOT clean THEN 'must_not_claim_violation' END,
    CASE WHEN len(lost) > 0 THEN 'unsupported_numeric' END, CASE WHEN score < 0.3 THEN 'low_grounding' END), ''), 'none') AS risk_flags FROM f"""


@query(_SCORED)
def automated_scores(t: Tables) -> DataFrame:
    """All rule checks of every answer; the notes are covered by tests."""
    return t.scores().withColumn("risk_flags", F.array_join("risk_flags", ",")).drop("notes")


_SAID = "CASE WHEN {r} IS NOT NULL THEN '{found} ''' || {p} || ''' (via ' || {r} || ')' WHEN {n} = 0 THEN 'n/a (no constraints)' ELSE '{none}' END"
_LOST = "CASE WHEN len(lost) = 0 THEN 'none' ELSE '[''' || array_to_string(lost, ''', ''') || ''']' END"


@query(
    _SCORED[: _SCORED.rindex("SELECT query_id")]
    + f"SELECT query_id, variant, 'must_include: ' || {_SAID.format(r='ri', p='pi', n='ni', found='matched', none='no match')} || '; must_not_claim: ' || {_SAID.format(r='rn', p='pn', n='nn', found='VIOLATED', none='clean')}"
    + f" || '; grounding: precision=' || CAST(round(p + 1e-9::DOUBLE, 4) AS VARCHAR) || ', quote_span=' || CASE WHEN q THEN 'True' ELSE 'False' END || ', unsupported_numbers=' || {_LOST} AS notes FROM f"
)
def answer_notes(t: Tables) -> DataFrame:
    """The notes of all rule checks."""
    return t.scores().select("query_id", "variant", "notes")


@query(f"WITH {_LIGHT}, best AS (SELECT query_id, variant AS winner FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY must_not_claim_pass DESC, must_include_pass DESC, grounding_score DESC, variant) = 1) SELECT a.query_id, winner FROM (SELECT DISTINCT query_id FROM answers) a JOIN best USING (query_id)")
def judge_stub_winner(t: Tables) -> DataFrame:
    return stub_winner(t.answers().join(t.chats(), "query_id", "left_semi"), t.light_scores())


@query(f"WITH {_LIGHT} SELECT query_id, variant, CAST(round_even(1 + grounding_score * 4, 0) AS INT) AS faithfulness, 3 AS clarity, NOT must_not_claim_pass OR numeric AS overclaim FROM scores")
def judge_stub_reviews(t: Tables) -> DataFrame:
    return stub_reviews(t.answers().join(t.chats(), "query_id", "left_semi"), t.light_scores(), CONFIG["judge"]).drop("winner")


@query(f"WITH {_LIGHT}, {_REVIEWS}, {_TAGS} SELECT query_id, variant, array_to_string(tags, ',') AS tags FROM tagged")
def failure_tags_of_answers(t: Tables) -> DataFrame:
    return t.tags().withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {_LIGHT}, {_REVIEWS}, {_TAGS} SELECT variant, tag, count(*) AS n FROM (SELECT variant, unnest(tags) AS tag FROM tagged) GROUP BY ALL")
def failure_tag_counts(t: Tables) -> DataFrame:
    return tag_counts(t.tags())


@query(f"SELECT conv_id, turn, {_MARKED.replace('answer', 'text')} AS marked FROM conversations")
def confidence_markers(t: Tables) -> DataFrame:
    return t.read("conversations").select("conv_id", "turn", has_marker(F.col("text")).alias("marked"))


@query(f"WITH {_QUESTIONS} SELECT query_id, risk_level, {_SEVERITY} AS severity FROM questions")
def severity_lookup(t: Tables) -> DataFrame:
    return t.questions().select("query_id", "risk_level", severity(F.col("risk_level"), CONFIG["risk"]).alias("severity"))


@query(f"WITH {_DECIDE} SELECT query_id, variant, gated, round(contribution + 1e-9::DOUBLE, 6) AS contribution FROM contrib")
def safety_gate(t: Tables) -> DataFrame:
    rows = contributions(t.light_scores(), t.chats(), t.reviews(), CONFIG)
    return rows.select("query_id", "variant", "gated", F.round(F.col("contribution") + SHIFT, 6).alias("contribution"))


@query(f"WITH {_DECIDE} SELECT * FROM verdicts")
def composite_score(t: Tables) -> DataFrame:
    return t.verdicts().drop("reasons", "failure_tag_counts")


@query(f"""WITH {_DECIDE} SELECT variant, string_agg('must_not_claim violation on ' || query_id || ' (risk ' || risk_level || ')', '; ' ORDER BY a_ord) AS reasons FROM contrib WHERE gated GROUP BY variant""")
def disqualifying_reasons(t: Tables) -> DataFrame:
    return t.verdicts().where("disqualified").select("variant", F.array_join("reasons", "; ").alias("reasons"))


def _some_pass(verdict: DataFrame) -> DataFrame:
    """Verdicts with the first half of the variants let through the gate, so that there is something to rank."""
    return verdict.withColumn("disqualified", F.col("disqualified") & (F.substring("variant", 6, 9).cast("int") > 3))


_SOME = "passed AS (SELECT * REPLACE (disqualified AND CAST(substr(variant, 6) AS INT) > 3 AS disqualified) FROM verdicts)"
_PICK = """ranked AS (SELECT variant, composite_score, row_number() OVER (ORDER BY composite_score DESC, variant) AS r FROM passed WHERE NOT disqualified),
decided AS (SELECT count(*) AS n_candidates, max(variant) FILTER (WHERE r = 1) AS top, max(variant) FILTER (WHERE r = 2) AS runner_up,
  round(max(composite_score) FILTER (WHERE r = 1) - max(composite_score) FILTER (WHERE r = 2) + 1e-9::DOUBLE, 4) AS margin FROM ranked),
chosen AS (SELECT CASE WHEN n_candidates = 1 OR margin >= 0.02 THEN top END AS selected_variant, margin, n_candidates, runner_up FROM decided)"""


@query(f"WITH {_DECIDE}, {_SOME}, {_PICK} SELECT * FROM chosen")
def recommend(t: Tables) -> DataFrame:
    return recommendation(_some_pass(t.verdicts()), CONFIG, SHIFT)


@query(f"""WITH {_DECIDE}, {_SOME}, {_PICK}, target AS (SELECT coalesce(selected_variant, (SELECT min(variant) FROM passed WHERE NOT disqualified)) AS target FROM chosen)
SELECT s.variant, t.target, s.mean_clarity, v.mean_clarity AS target_clarity FROM passed s, target t JOIN passed v ON v.variant = t.target WHERE s.disqualified AND s.mean_clarity > v.mean_clarity""")
def clarity_tradeoffs(t: Tables) -> DataFrame:
    verdict = _some_pass(t.verdicts())
    return tradeoffs(verdict, recommendation(verdict, CONFIG, SHIFT))


@query(f"WITH {_KB}, {_QUESTIONS} SELECT query_id AS location, 'unknown doc_id ' || doc_id AS message FROM (SELECT query_id, unnest(expected_doc_ids) AS doc_id FROM questions) WHERE doc_id NOT IN (SELECT doc_id FROM kb)")
def dangling_doc_ids(t: Tables) -> DataFrame:
    return validate.dangling_doc_ids(t.questions(), t.kb()).select("location", "message")


@query(f"WITH {_QUESTIONS}, {_ANSWERS} SELECT DISTINCT query_id AS location FROM answers WHERE query_id NOT IN (SELECT query_id FROM questions)")
def dangling_query_ids(t: Tables) -> DataFrame:
    return validate.dangling_query_ids(t.answers(), t.questions()).select("location")


@query(f"WITH {_CHATS}, {_ANSWERS} SELECT query_id AS location, 'WARNING' AS severity FROM chats WHERE query_id NOT IN (SELECT query_id FROM answers)")
def missing_answers(t: Tables) -> DataFrame:
    return validate.missing_answers(t.chats(), t.answers()).select("location", "severity")


@query(f"WITH {_ANSWERS} SELECT q.query_id AS location, 'lacks variant ' || v.variant AS message FROM (SELECT DISTINCT query_id FROM answers) q CROSS JOIN (SELECT DISTINCT variant FROM answers) v WHERE (q.query_id, v.variant) NOT IN (SELECT (query_id, variant) FROM answers)")
def inconsistent_variants(t: Tables) -> DataFrame:
    return validate.inconsistent_variants(t.answers()).select("location", "message")


@query(f"WITH {_ANSWERS} SELECT variant, min(a_ord) AS a_ord, arg_min(v_pos, a_ord) AS v_pos FROM answers GROUP BY variant")
def variant_order(t: Tables) -> DataFrame:
    return validate.first_seen_variants(t.answers()).select("variant", "v_ord.a_ord", "v_ord.v_pos")


@query("SELECT user_id, event_id, first_seen FROM (SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS first_seen FROM events) WHERE event_id > first_seen")
def duplicate_ids(t: Tables) -> DataFrame:
    """Every event but a user's first, as a repeated id."""
    return validate.duplicate_ids(t.read("events").select("user_id", "event_id"), "user_id", "event_id")


@query(f"WITH {_CHATS}, {_ANSWERS} SELECT query_id || '/' || variant AS location FROM answers WHERE query_id NOT IN (SELECT query_id FROM chats) OR a_ord % 5 = 0")
def unprocessed_answers(t: Tables) -> DataFrame:
    """Answers that a run without every fifth query would have left out."""
    done = t.answers().join(t.chats(), "query_id", "left_semi").where(F.col("a_ord") % 5 != 0)
    return validate.unprocessed_answers(t.answers(), done).select("location")


@query(f"WITH {_CHATS} SELECT query_id AS location, CASE WHEN q_ord % 4 = 0 THEN 'MISSING_RETRIEVAL' ELSE 'WRONG_RETRIEVAL_COUNT' END AS code FROM chats WHERE q_ord % 4 IN (0, 1)")
def retrieval_count_check(t: Tables) -> DataFrame:
    """Retrieval that lost every fourth query and a passage of the next one."""
    rows = t.chats().where(F.col("q_ord") % 4 != 0).select("query_id", F.when(F.col("q_ord") % 4 == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("retrieved"))
    return validate.retrieval_counts(t.chats(), rows, t.kb(), 2).select("location", "code")


_HEAD = "provider=openai|model=gpt-4o-mini|temperature=0|max_tokens=4096|rubric=v1|prompt="


_YES = "CASE WHEN {0} THEN 'yes' ELSE 'no' END"


@query(f"""WITH {_LIGHT}, l AS (SELECT query_id, string_agg('<answer variant=' || variant || '>' || chr(10) || coalesce(answer, '') || chr(10) || '</answer>' || chr(10) || '<rules>expected source found: ' || {_YES.format('retrieval_hit')}
  || '; required point made: ' || {_YES.format('must_include_pass')} || '; no banned claim: ' || {_YES.format('must_not_claim_pass')} || '; support ' || CAST(grounding_score AS VARCHAR)
  || '; flags ' || CASE WHEN numeric THEN 'unsupported_numeric' ELSE 'none' END || '</rules>', chr(10) ORDER BY variant) AS body FROM scores GROUP BY query_id)
SELECT query_id, sha256('{_HEAD}' || '<item query=' || query_id || '>' || chr(10) || user_question || chr(10) || '<source>none</source>' || chr(10) || body || chr(10) || '</item>') AS prompt_hash
FROM chats JOIN l USING (query_id)""")
def prompt_hash(t: Tables) -> DataFrame:
    """The hash of each query's block as a prompt of its own."""
    answers = t.answers().join(t.chats(), "query_id", "left_semi")
    blocks = build_prompt(t.chats(), answers, t.evidence(), t.light_scores())
    return blocks.select("query_id", prompt_hash_column(F.col("block"), CONFIG["judge"]).alias("prompt_hash"))


@query("WITH l AS (SELECT event_id AS line, CASE WHEN event_id % 3 = 0 THEN 'cache' ELSE 'live' END AS backend, event_id % 5 <> 0 AS parsed_ok, sha256(CAST(user_id AS VARCHAR)) AS prompt_hash FROM events) SELECT prompt_hash, 'c' || max(line) AS call_id FROM l WHERE backend = 'live' AND parsed_ok GROUP BY prompt_hash")
def call_log_cache_lookup(t: Tables) -> DataFrame:
    """Events as a call log: of each prompt the newest live call that parsed."""
    log = t.read("events").select(F.col("event_id").alias("line"), F.when(F.col("event_id") % 3 == 0, "cache").otherwise("live").alias("backend"), (F.col("event_id") % 5 != 0).alias("parsed_ok"), F.sha2(F.col("user_id").cast("string"), 256).alias("prompt_hash"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("call_id"), F.col("props").alias("response_raw"))
    return cached_calls(log, log.select("prompt_hash")).select("prompt_hash", "call_id")


@query("SELECT 'clarity must be whole numbers from 1 to 5' AS problem, count(*) AS n FROM conversations WHERE role = 'assistant' AND turn = 1 AND conv_id % 4 = 1 HAVING count(*) > 0 UNION ALL SELECT 'no valid review', count(DISTINCT conv_id) FROM conversations WHERE role = 'assistant' AND turn = 1 AND conv_id % 4 IN (0, 1) HAVING count(*) > 0")
def review_validation(t: Tables) -> DataFrame:
    """A payload that leaves out every fourth query and scores the next one true."""
    answers = t.answers().where("variant = 'turn_1'")
    queries = answers.select("query_id").distinct()
    number = F.col("query_id").cast("long") % 4
    entry = F.concat(F.lit('{"query_id":"'), F.col("query_id"), F.lit('","winner":"turn_1","faithfulness":{"turn_1":3},"clarity":{"turn_1":'), F.when(number == 1, "true").otherwise("4"), F.lit('},"overclaim_flags":{"turn_1":false},"justification":"fits"}'))
    entries = answers.where(number != 0).select(F.col("a_ord").alias("pos"), entry.alias("entry"))
    return review_entry_issues(entries, queries, answers, 1, 5).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ANSWERS}, q AS (SELECT DISTINCT query_id, a_ord % 4 AS k FROM answers)
SELECT 'clarity must be whole numbers from 1 to 5' AS problem, count(*) AS n FROM q WHERE k = 1 HAVING count(*) > 0
UNION ALL SELECT 'faithfulness must have the variants as keys', count(*) FROM q WHERE k = 2 HAVING count(*) > 0
UNION ALL SELECT 'no valid review', count(*) FROM q WHERE k < 3 HAVING count(*) > 0""")
def review_validation_all(t: Tables) -> DataFrame:
    """A review of every answered query over all its variants: every fourth is left out, the next one scores true, the next one lacks a variant."""
    answers = t.answers()
    rows = answers.groupBy("query_id").agg(F.min("a_ord").alias("pos"), F.array_sort(F.collect_set("variant")).alias("v")).withColumn("k", F.col("pos") % 4)
    of = lambda keys, value: F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit(value))))
    some = F.when(F.col("k") == 2, F.slice("v", 1, F.size("v") - 1)).otherwise(F.col("v"))
    entry = F.concat(
        F.lit('{"query_id":"'), "query_id", F.lit('","winner":"'), F.get("v", 0), F.lit('","faithfulness":'), of(some, 3), F.lit(',"clarity":'), F.when(F.col("k") == 1, of(F.col("v"), True)).otherwise(of(F.col("v"), 4)),
        F.lit(',"overclaim_flags":'), of(F.col("v"), False), F.lit(',"justification":"fits"}'),
    )
    entries = rows.where("k <> 0").select("pos", entry.alias("entry"))
    return review_entry_issues(entries, answers.select("query_id").distinct(), answers, 1, 5).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# ---- sources and sinks: small files made of the tables, and read again -----------------------------


def _file(t: Tables, lines: DataFrame, name: str, head: str = "", between: str = "\n", tail: str = "\n") -> str:
    """A text file of one column, in the order of pos, in the folder that all executors share."""
    path = f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    write_pieces(lines, path, ["pos"], F.col("value"), head, between, tail)
    return path


@query("""WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, CASE WHEN item_id % 10 = 5 THEN item_id - 5 ELSE item_id END AS id, item_id % 7 = 0 AS blank FROM benchmark),
g AS (SELECT *, min(idx) OVER (PARTITION BY id) AS first_idx FROM b WHERE NOT blank)
SELECT 'SCHEMA_INVALID' AS code, CAST(idx AS VARCHAR) AS idx, 'text' AS field FROM b WHERE blank UNION ALL SELECT 'DUPLICATE_ID', CAST(idx AS VARCHAR), 'doc_id' FROM g WHERE idx > first_idx""")
def array_input_issues(t: Tables) -> DataFrame:
    """Benchmark items as a JSON array with blank texts and repeated ids: what a typed scan of the array finds."""
    items = t.read("benchmark").select("item_id", F.when(F.col("item_id") % 10 == 5, F.col("item_id") - 5).otherwise(F.col("item_id")).cast("string").alias("doc_id"), F.when(F.col("item_id") % 7 == 0, " ").otherwise(F.col("text")).alias("text"))
    path = _file(t, items.select(F.col("item_id").alias("pos"), F.to_json(F.struct("item_id", "doc_id", "text")).alias("value")), "items", "[", ", ", "]")
    rows, bad = read_array(t.spark, path, whole_bytes=-1)
    _, found = typed_records(rows, path, "doc_id", {"doc_id": text_field("doc_id"), "text": text_field("text")})
    return bad.unionByName(found).select("code", F.regexp_extract("location", r"\[(\d+)\]", 1).alias("idx"), F.regexp_extract("location", r"\.([a-z_]+)$", 1).alias("field"))


@query("""WITH e AS (SELECT event_id % 9 = 4 AS broken, CASE WHEN event_id % 3 = 0 THEN 'cache' ELSE 'live' END AS backend FROM events)
SELECT CASE WHEN broken THEN 'broken' ELSE backend END AS backend, count(*) AS n FROM e GROUP BY ALL""")
def call_log_scan(t: Tables) -> DataFrame:
    """Events as a call log of JSON lines, some of which are cut off: the calls that are read, and the broken lines."""
    whole = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "cache").otherwise("live").alias("backend"), F.col("event_id").cast("string").alias("call_id")))
    lines = t.read("events").select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 9 == 4, F.substring(whole, 1, 8)).otherwise(whole).alias("value"))
    path = _file(t, lines, "calls")
    read = read_call_log(t.spark, path).groupBy("backend").agg(F.count(F.lit(1)).alias("n"))
    return read.unionByName(broken_lines(t.spark, path).groupBy(F.lit("broken").alias("backend")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT row_number() OVER (ORDER BY event_id) AS line, event_id % 9 = 4 AS broken FROM events QUALIFY broken")
def broken_call_log_lines(t: Tables) -> DataFrame:
    """Numbers of the lines of an events' log that are cut off, read split by split."""
    whole = F.to_json(F.struct(F.col("event_id").cast("string").alias("call_id"), "props"))
    lines = t.read("events").select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 9 == 4, F.substring(whole, 1, 8)).otherwise(whole).alias("value"))
    return broken_lines(t.spark, _file(t, lines, "log")).select("line", F.lit(True).alias("broken"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, text FROM documents")
def document_array_scan(t: Tables) -> DataFrame:
    """All documents as one JSON array, written in order by tasks and read again between its elements, with the places of the elements."""
    rows = t.read("documents").select(F.col("doc_id").alias("pos"), F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"}).alias("value"))
    read, _ = read_array(t.spark, _file(t, rows, "documents", "[\n", ",\n", "\n]"), whole_bytes=-1)
    field = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind)
    return read.select(field("doc_id", "long").alias("doc_id"), F.col("idx").cast("long").alias("idx"), field("text", "string").alias("text"))


@query("SELECT sha256(string_agg(CAST(item_id AS VARCHAR) || chr(10), '' ORDER BY item_id)) AS sha256 FROM benchmark")
def file_hash(t: Tables) -> DataFrame:
    path = _file(t, t.read("benchmark").select(F.col("item_id").alias("pos"), F.col("item_id").cast("string").alias("value")), "ids")
    return file_hashes(t.spark, [path]).select("sha256")


@query(f"WITH {_ANSWERS} SELECT query_id, variant, answer FROM answers")
def answers_by_variant(t: Tables) -> DataFrame:
    """Maps of answers, one row for each variant again."""
    maps = t.answers().groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("variant", "answer"))).alias("answers"))
    return long_answers(maps)


_STORED = f"""{_LIGHT}, kept AS (SELECT query_id, variant, a_ord, CASE WHEN a_ord % 11 = 0 THEN 0.5 ELSE grounding_score END AS stored, grounding_score AS own FROM scores)"""


@query(f"""WITH {_STORED} SELECT 'stored' AS side, query_id, variant FROM kept WHERE a_ord % 13 <> 0 AND stored <> own UNION ALL SELECT 'computed', query_id, variant FROM kept WHERE a_ord % 13 = 0 OR stored <> own""")
def reproduced_scores(t: Tables) -> DataFrame:
    """Scores against a stored table in which every thirteenth query is lost and every eleventh has another grounding score."""
    scores, number = t.light_scores(), F.col("query_id").cast("long")
    stored = scores.where(number % 13 != 0).withColumn("grounding_score", F.when(number % 11 == 0, 0.5).otherwise(F.col("grounding_score")))
    found = validate.differences(stored, scores)
    field = lambda name: F.get_json_object("message", f"$.{name}").alias(name)
    return found.select(F.col("location").alias("side"), field("query_id"), field("variant"))


@query(f"""WITH {_STORED}, n AS (SELECT *, a_ord % 17 = 0 AS broken FROM kept)
SELECT 'SCHEMA_INVALID' AS code, count(*) AS n FROM n WHERE broken HAVING count(*) > 0 UNION ALL SELECT 'UNPROCESSED_ANSWER', count(*) FROM n WHERE broken HAVING count(*) > 0
UNION ALL SELECT 'NOT_REPRODUCIBLE', count(*) FILTER (WHERE broken) + 2 * count(*) FILTER (WHERE NOT broken AND stored <> own) AS n FROM n HAVING n > 0""")
def stored_artifact_issues(t: Tables) -> DataFrame:
    """Scores written as an artifact, some without a field and some changed: what its scan, the coverage check and a second computation find."""
    scores, number = t.light_scores(), F.col("query_id").cast("long")
    path = f"{shared_folder(t.spark)}/scores-{uuid.uuid4().hex}.json"
    written = scores.withColumns({"grounding_score": F.when(number % 11 == 0, 0.5).otherwise(F.col("grounding_score")), "retrieval_hit": F.when(number % 17 != 0, F.col("retrieval_hit"))})
    write_array(written, path, ["query_id", "variant"])
    records, _ = read_records(t.spark, path, "automated_scores")
    found = stored_differences(t.spark, path, "automated_scores", scores).unionByName(validate.unprocessed_answers(t.answers().join(t.chats(), "query_id", "left_semi"), records))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_BLOCKS = f"""{_LIGHT}, l AS (SELECT query_id, string_agg('<answer variant=' || variant || '>' || chr(10) || coalesce(answer, '') || chr(10) || '</answer>' || chr(10) || '<rules>expected source found: ' || {_YES.format('retrieval_hit')}
  || '; required point made: ' || {_YES.format('must_include_pass')} || '; no banned claim: ' || {_YES.format('must_not_claim_pass')} || '; support ' || CAST(grounding_score AS VARCHAR)
  || '; flags ' || CASE WHEN numeric THEN 'unsupported_numeric' ELSE 'none' END || '</rules>', chr(10) ORDER BY variant) AS body FROM scores GROUP BY query_id),
blocks AS (SELECT query_id, q_ord, '<item query=' || query_id || '>' || chr(10) || user_question || chr(10) || '<source>none</source>' || chr(10) || body || chr(10) || '</item>' AS block FROM chats JOIN l USING (query_id)),
placed AS (SELECT *, coalesce(sum((length(block) + 3) // 4) OVER (ORDER BY q_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000 AS batch FROM blocks)"""


def _blocks(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    answers, scores = t.answers().join(t.chats(), "query_id", "left_semi"), t.light_scores()
    return answers, scores, build_prompt(t.chats(), answers, t.evidence(), scores)


@query(f"WITH {_BLOCKS} SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, sha256('{_HEAD}' || string_agg(block, chr(10) ORDER BY q_ord)) AS prompt_hash FROM placed GROUP BY batch")
def judge_prompt_batches(t: Tables) -> DataFrame:
    """All questions in prompts of about 2000 tokens."""
    return prompt_batches(_blocks(t)[2], CONFIG["judge"], 2000)[0].select("batch", "n", "prompt_hash")


@query(f"""WITH {_BLOCKS}, best AS (SELECT query_id, variant AS winner FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY must_not_claim_pass DESC, must_include_pass DESC, grounding_score DESC, variant) = 1)
SELECT query_id, winner, CASE WHEN batch % 3 = 0 THEN 'cache' ELSE 'stub' END AS backend FROM placed JOIN best USING (query_id)""")
def judge_batches_replayed(t: Tables) -> DataFrame:
    """Reviews in batches, where the log has an answer to every third prompt, and one with a lost review to the next.

    Answers, scores and prompts are made once, for the log and for the reviews."""
    answers, scores = kept(t.answers().join(t.chats(), "query_id", "left_semi"), "replayed-answers"), kept(t.light_scores(), "replayed-scores")
    prompts, members = prompt_batches(build_prompt(t.chats(), answers, t.evidence(), scores), CONFIG["judge"], 2000)
    some = prompts.where("batch % 3 < 2").select("batch", "prompt_hash")
    made = stub_payload(t.spark, answers, scores, CONFIG["judge"]).join(members, "query_id").join(some, "batch")
    first = F.min("query_id").over(Window.partitionBy("batch"))
    made = made.withColumn("least", first).where("batch % 3 = 0 OR query_id <> least")
    review = F.struct("query_id", "winner", "faithfulness", "clarity", "overclaim_flags", "justification")
    log = made.groupBy("batch", "prompt_hash").agg(F.to_json(F.struct(F.collect_list(review).alias("reviews"))).alias("response_raw"))
    log = log.select(F.col("batch").alias("line"), F.lit("live").alias("backend"), F.lit(True).alias("parsed_ok"), "prompt_hash", F.concat(F.lit("c"), F.col("batch").cast("string")).alias("call_id"), "response_raw")
    return judge_in_batches(t.chats(), answers, t.evidence(), scores, CONFIG, log, None, 2000, (prompts, members)).reviews.select("query_id", "winner", "backend")


@query(f"""WITH {_LIGHT}, {_REVIEWS}, {_TAGS}, b AS (SELECT query_id, string_agg('- **' || variant || '**: ' || coalesce(answer, '') || chr(10) || '  - grounding ' || CAST(grounding_score AS VARCHAR) || '; flags ' || CASE WHEN numeric THEN 'unsupported_numeric' ELSE 'none' END
  || '; tags ' || CASE WHEN len(tags) = 0 THEN 'none' ELSE array_to_string(tags, ', ') END || chr(10) || '  - light', chr(10) ORDER BY variant) AS body FROM scores JOIN tagged USING (query_id, variant) GROUP BY query_id),
w AS (SELECT query_id, 'Judge: ' || any_value(winner) || '. by labels' AS judge FROM reviews GROUP BY query_id)
SELECT query_id, concat_ws(chr(10) || chr(10), '## ' || query_id || ' (' || risk_level || ')', user_question, 'Evidence: none', coalesce(body, 'No answers.'), judge) AS section FROM chats LEFT JOIN b USING (query_id) LEFT JOIN w USING (query_id)""")
def report_sections(t: Tables) -> DataFrame:
    """The review report's section of every question, with its answers, tags and review."""
    reviews = wide_reviews(t.reviews()).withColumn("justification", F.lit("by labels"))
    scores = t.light_scores().withColumn("notes", F.lit("light"))
    run = SimpleNamespace(inputs=SimpleNamespace(queries=t.chats(), answers=t.answers()), scores=scores, tags=t.tags(), retrieval=t.evidence(), reviews=reviews)
    return report_lines(run).select("query_id", "section")


@query(f"WITH {_CHATS}, {_ANSWERS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chats) AS queries, (SELECT count(DISTINCT variant) FROM answers) AS variants")
def run_counts(t: Tables) -> DataFrame:
    """What a manifest counts."""
    one = lambda table, name: table.agg(F.count(F.lit(1)).alias(name))
    return one(t.kb(), "documents").join(one(t.chats(), "queries")).join(one(t.answers().select("variant").distinct(), "variants"))  # one row each


# ---- the later stages over real scores ---------------------------------------------------------------

_REAL = (
    _SCORED.removeprefix("WITH ").rsplit("\nSELECT", 1)[0]
    + f""",
auto AS ({_SCORED[_SCORED.rindex("SELECT query_id"):]}),
scores AS (SELECT auto.*, contains(risk_flags, 'unsupported_numeric') AS numeric, risk_level, answer, a_ord FROM auto JOIN chats USING (query_id) JOIN answers USING (query_id, variant))"""
)
_SHOWN = """(SELECT string_agg('<source id=' || doc_id || '>' || chr(10) || concat_ws(chr(10), title, text) || chr(10) || '</source>', chr(10) ORDER BY rank) FROM top JOIN kb USING (doc_id) WHERE top.query_id = chats.query_id)"""


def _over_real_scores(f: Callable[[Tables], DataFrame]) -> None:
    """Registers evaluated_<name>: the same operator and SQL, over real retrieval and scores in place of light ones."""
    name = f"evaluated_{f.__name__}"
    QUERIES[name] = lambda spark, sf_dir: f(Evaluated(spark, sf_dir))
    flags = "replace(risk_flags, ',', ' ')"
    SQL[name] = SQL[f.__name__].replace(_LIGHT, _REAL).replace("CASE WHEN numeric THEN 'unsupported_numeric' ELSE 'none' END", flags).replace("'<source>none</source>'", _SHOWN)


for _f in (composite_score, recommend, clarity_tradeoffs, safety_gate, failure_tags_of_answers, failure_tag_counts, judge_stub_winner, judge_stub_reviews, prompt_hash):
    _over_real_scores(_f)
