"""Quality rules: a linear-chain CRF marks each line content or boilerplate; the share of words in content lines decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm._labelled import labelled_texts
from assay.llm._state import read
from assay.llm._text import FOLDED, SPACE, Lines, Words, covered, mixed, parts, prefix, quick_prefix, quick_spans, spans, sums

#: Bounds of what is fitted on the driver: labelled documents of each class, of which those of up to so many lines are learnt from.
SAMPLE_PER_CLASS, SAMPLE_LINES = 600, 2000
#: Documents with a smaller share of words in content lines are dropped.
CONTENT_SHARE = 0.5
#: Base rules: fewer words fail; more per cent of words in repeated 8-word windows fail.
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEAT_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SHARES = np.array([0.01, 0.05, 0.15, 0.4])
_SIZES = np.array([1, 3, 6, 13, 40])
#: Each line has one value of each of these; the CRF has a weight for each value.
_VALUES = (6, 5, 5, 5, 5, 5, 5, 2, 2, 2)
_BASE = np.concatenate(([0], np.cumsum(_VALUES)))[:-1]
FEATURES = sum(_VALUES)
#: The feature that says whether a line is its document's first.
_FIRST = 9


def line_features(off: np.ndarray, data: np.ndarray, lines: Lines, words: Words, dup: np.ndarray | None = None) -> np.ndarray:
    """Lines by len(_VALUES): indices of the features that hold for each line. dup: of repeated(), if known."""
    s, e = lines.start, lines.end
    part = lambda flags, of: np.searchsorted(_SHARES, flags / np.maximum(of, 1), "right")
    ink = sums(~SPACE[data], s, e)
    letters = sums(_LETTER[data], s, e)
    begins = np.zeros(len(data), bool)
    begins[words.start] = True
    n = sums(begins, s, e)
    h = quick_spans(quick_prefix(FOLDED[data]), words.start, words.end)
    again = np.zeros(len(data), bool)
    if len(h) > 1:
        again[words.start[1:][(h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])]] = True
    last = np.zeros(len(s), np.uint8)
    last[e > s] = data[e[e > s] - 1]
    if dup is None:
        _, dup = repeated(data, lines, n)
    return np.stack(
        [
            np.searchsorted(_SIZES, n, "right"),
            part(sums(_SYMBOL[data], s, e), ink),
            part(sums(data == ord("!"), s, e), ink),
            part(sums(data == ord("|"), s, e), n),
            part(sums(_UPPER[data], s, e), letters),
            part(sums(_DIGIT[data], s, e), ink),
            part(sums(again, s, e), n),
            np.isin(last, list(b".?!:;,")).astype(int),
            dup.astype(int),
            (np.arange(len(s)) == lines.first[:-1][lines.row]).astype(int),  # _FIRST
        ],
        axis=1,
    ) + _BASE


def repeated(data: np.ndarray, lines: Lines, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line, and whether it has a word and equals an earlier line of its row."""
    h = spans(prefix(_LINE[data]), lines.start, lines.end)
    _, first, inverse = np.unique(h ^ mixed(lines.row.astype(np.uint64)), return_index=True, return_inverse=True)
    return h, (n_words > 0) & (first[inverse] < np.arange(len(h)))


_LINE = np.random.default_rng(3).integers(0, 2**31, 256, dtype=np.uint64)


def _steps(count: np.ndarray) -> Iterator[np.ndarray]:
    """For each position in a chain, the chains that are so long, longest first."""
    order = np.argsort(-count, kind="stable")
    sorted_count = -count[order]
    for t in range(int(count.max(initial=0))):
        yield order[: np.searchsorted(sorted_count, -t, "left")]


def viterbi(emit: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    """Best states of all chains; emit: rows by 2, chain d has the rows first[d] to first[d+1]."""
    count, back, state = np.diff(first), np.zeros(emit.shape, np.int8), np.zeros(len(emit), np.int8)
    best = np.zeros((len(count), 2))
    steps = list(_steps(count))
    for t, d in enumerate(steps):
        at = first[d] + t
        if t == 0:
            best[d] = model["start"] + emit[at]
        else:
            via = best[d][:, :, None] + model["trans"][None]
            back[at] = via.argmax(1)
            best[d] = via.max(1) + emit[at]
    now = best.argmax(1).astype(np.int8)
    for t in range(len(steps) - 1, -1, -1):
        d = steps[t]
        at = first[d] + t
        state[at] = now[d]
        now[d] = back[at, now[d]]
    return state


def joined_chains(features: list[np.ndarray], labels: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Chains and their lines' states to learn from: each document with its label on all lines, and for each
    two of different labels one put into the middle of the other, so that states change where the lines do."""
    chains, states = list(features), [np.full(len(f), y) for f, y in zip(features, labels, strict=True)]
    kinds = [[f for f, y in zip(features, labels, strict=True) if y == q] for q in (0, 1)]
    for i in range(max(map(len, kinds))):
        pair = [kinds[q][i % len(kinds[q])] for q in (0, 1)]
        for outer, inner in ((0, 1), (1, 0)):
            half = (len(pair[outer]) + 1) // 2
            chain = np.concatenate((pair[outer][:half], pair[inner], pair[outer][half:]))
            chain[1:, _FIRST] = _BASE[_FIRST]
            chains.append(chain)
            states.append(np.repeat([outer, inner, outer], [half, len(pair[inner]), len(pair[outer]) - half]))
    return chains, states


def fit(features: list[np.ndarray], states: list[np.ndarray], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> dict:
    """Maximum conditional likelihood of the states of chains of lines, by forward-backward and Adam."""
    first = np.concatenate(([0], np.cumsum([len(f) for f in features])))
    x, y = np.concatenate(features), np.concatenate(states)
    steps = list(_steps(np.diff(first)))
    n, rows = len(y), np.arange(len(y))
    size = FEATURES * 2
    p, m1, m2 = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    seen = np.zeros(size + 6)
    for k in range(x.shape[1]):
        seen[:size] += np.bincount(x[:, k] * 2 + y, minlength=size)
    inner = np.setdiff1d(rows, first[1:] - 1)
    seen[size : size + 4] = np.bincount(y[inner] * 2 + y[inner + 1], minlength=4)
    seen[size + 4 :] = np.bincount(y[first[:-1]], minlength=2)
    for r in range(1, rounds + 1):
        w, trans, start = p[:size].reshape(-1, 2), p[size : size + 4].reshape(2, 2), p[size + 4 :]
        emit = w[x].sum(1)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        for t, d in enumerate(steps):
            at = first[d] + t
            a[at] = emit[at] + (start if t == 0 else np.logaddexp.reduce(a[at - 1][:, :, None] + trans[None], axis=1))
        for t in range(len(steps) - 2, -1, -1):
            at = first[steps[t + 1]] + t
            b[at] = np.logaddexp.reduce(trans[None] + (emit[at + 1] + b[at + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(a + b, axis=1)
        one = np.exp(a + b - z[:, None])
        two = np.exp(a[inner][:, :, None] + trans[None] + (emit[inner + 1] + b[inner + 1])[:, None, :] - z[inner][:, None, None])
        want = np.zeros(size + 6)
        for k in range(x.shape[1]):
            for c in (0, 1):
                want[:size].reshape(-1, 2)[:, c] += np.bincount(x[:, k], one[:, c], minlength=FEATURES)
        want[size : size + 4] = two.sum(0).ravel()
        want[size + 4 :] = one[first[:-1]].sum(0)
        g = (seen - want) / n - decay * p
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p = p + rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return {"emit": p[:size].reshape(-1, 2), "trans": p[size : size + 4].reshape(2, 2), "start": p[size + 4 :]}


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_lines: int = SAMPLE_LINES) -> dict | None:
    """Weak supervision: the lines of documents of quality 1 are content, those of quality 0 boilerplate, alone
    and in chains of both (joined_chains()).

    Learns from all lines of at most per_class documents of each class, the same ones in every run; of those,
    documents of more than most_lines lines are not in the sample. None where a class has no row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in parts(b.column("text")):
                lines = Lines(off, data)
                f = line_features(off, data, lines, Words(off, data)).astype(np.int16)
                blobs = [f[s:e].tobytes() for s, e in zip(lines.first[:-1], lines.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("quality").slice(i, j - i), pa.array(blobs, pa.binary())], ["doc_id", "quality", "lines"])

    short = F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) < most_lines
    got = labelled_texts(docs, labels, per_class).where(short).mapInArrow(rows, "doc_id long, quality int, lines binary").collect()
    if len({r.quality for r in got}) < 2:
        return None
    got.sort(key=lambda r: r.doc_id)
    return fit(*joined_chains([np.frombuffer(r.lines, np.int16).reshape(-1, len(_VALUES)) for r in got], [r.quality for r in got]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words")


def content_lines(off: np.ndarray, data: np.ndarray, lines: Lines, words: Words, model: dict, dup: np.ndarray | None = None) -> np.ndarray:
    """Which lines the best states of each document's chain mark as content."""
    return viterbi(model["emit"][line_features(off, data, lines, words, dup)].sum(1), lines.first, model) == 1


def measure(off: np.ndarray, data: np.ndarray, model: dict | None) -> list[np.ndarray]:
    """COUNTS of each row; without a model every line is content."""
    words, lines = Words(off, data), Lines(off, data)
    s, e, n = off[:-1], off[1:], len(off) - 1
    begins = np.zeros(len(data), bool)
    begins[words.start] = True
    line_words = sums(begins, lines.start, lines.end)
    _, dup = repeated(data, lines, line_words)
    m = len(words.start) - REPEAT_WINDOW + 1
    again = np.zeros(len(words.start), bool)
    if m > 0:
        at = np.flatnonzero(words.row[:m] == words.row[REPEAT_WINDOW - 1 :])
        w = spans(prefix(words.hashes(data)), at, at + REPEAT_WINDOW) ^ mixed(words.row[at].astype(np.uint64))
        _, inverse, count = np.unique(w, return_inverse=True, return_counts=True)
        hit = at[count[inverse] > 1]
        again = covered(len(words.start), hit, hit + REPEAT_WINDOW)
    if model is None:
        content = words.count
    else:
        content = np.bincount(lines.row, line_words * content_lines(off, data, lines, words, model, dup), minlength=n)
    solid = ~SPACE[data] & ((data & 0xC0) != 0x80)
    repeat = sums(again, words.first[:-1], words.first[1:])
    return [words.count, sums(solid, s, e), sums(_SYMBOL[data], s, e), np.bincount(lines.row, dup, minlength=n), repeat, content]


def line_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, content_share: float = CONTENT_SHARE) -> DataFrame:
    """docs with COUNTS, base_failed, content_share and kept.

    One row out for each row in, repeated rows too, extra columns kept (of equal names, ours replace them). A
    null text counts as empty: one line without words, base_failed; so does a text of white space. Without
    labels of both classes every line is content. Ties of the best states go to boilerplate."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    docs = docs.drop(*COUNTS, "base_failed", "content_share", "kept")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((len(COUNTS), b.num_rows), np.int64)
            for i, j, off, data in parts(b.column("text")):
                for k, x in enumerate(measure(off, data, model.value)):
                    out[k, i:j] = x
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out)], [*b.schema.names, *COUNTS])

    counted = docs.mapInArrow(count, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    share = F.when(F.col("n_words") > 0, F.col("n_content_words") / F.col("n_words")).otherwise(0.0)
    return counted.withColumn("base_failed", failed).withColumn("content_share", share).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= content_share))


def op1_line_crf(spark, sf_dir: str) -> DataFrame:
    out = line_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "content_share", "kept")
