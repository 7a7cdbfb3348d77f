"""Quality classifier: nearest-neighbour voting over broadcast latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm._labelled import labelled_texts
from assay.llm._state import read
from assay.llm._text import FOLDED, SPACE, Words, parts, prefix, spans

#: Bounds of what is fitted and broadcast: labelled rows of each class, latent dimensions, voters.
SAMPLE_PER_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8.0

_CLASSES = 14
_CLASS = np.full(256, 10, np.int32)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[SPACE] = 4
_CLASS[10] = 5
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 6
_CLASS[ord("!")], _CLASS[ord("|")] = 7, 8
for _c in b"#$%&*<>":
    _CLASS[_c] = 9
_CLASS[0xC0:], _CLASS[0x80:0xA0], _CLASS[0xA0:0xC0] = 11, 12, 13
_TRIGRAMS = _CLASSES**3
#: After the trigrams: words equal to the word 1, 2 or 3 before, words in a repeated 8-word window, other words, word lengths.
_EXTRA = 5 + 16
TERMS = _TRIGRAMS + _EXTRA


def term_matrix(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Rows by TERMS: square roots of relative frequencies of character-class trigrams and word events."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    out = np.zeros((n, TERMS), np.float32)
    if len(data) > 2:
        c = _CLASS[data]
        code, same = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], row[:-2] == row[2:]
        flat = np.bincount(row[:-2][same] * _TRIGRAMS + code[same], minlength=n * _TRIGRAMS)
        out[:, :_TRIGRAMS] = flat.reshape(n, _TRIGRAMS)
    words = Words(off, data)
    if len(words.start):
        h, r = words.hashes(data, FOLDED), words.row
        event = np.full(len(h), 4)
        p, m = prefix(h), len(h) - 7
        if m > 0:
            at = np.arange(m)
            w = spans(p, at, at + 8)[r[:m] == r[7:]]
            at = at[r[:m] == r[7:]]
            _, inverse, count = np.unique(w ^ (r[at].astype(np.uint64) << np.uint64(40)), return_inverse=True, return_counts=True)
            event[at[count[inverse] > 1]] = 3
        for back in (3, 2, 1):
            event[back:][(h[back:] == h[:-back]) & (r[back:] == r[:-back])] = back - 1
        size = 5 + np.minimum(words.end - words.start, 16) - 1
        for e in (event, size):
            out[:, _TRIGRAMS:] += np.bincount(r * _EXTRA + e, minlength=n * _EXTRA).reshape(n, _EXTRA)
    for block in (slice(0, _TRIGRAMS), slice(_TRIGRAMS, _TRIGRAMS + 5), slice(_TRIGRAMS + 5, TERMS)):
        total = out[:, block].sum(1, keepdims=True)
        out[:, block] = np.sqrt(out[:, block] / np.maximum(total, 1))
    return out


def fit(labelled: np.ndarray, label: np.ndarray, dimensions: int = DIMENSIONS) -> dict:
    """Latent-semantic model of term rows: term weights, right singular vectors, unit rows, labels."""
    used = (labelled > 0).sum(0)
    weight = np.log((1 + len(labelled)) / (1 + used)).astype(np.float32) * (used > 1) + 0.1 * (used > 1)
    x = labelled * weight
    rng = np.random.default_rng(7)
    q = x @ rng.standard_normal((x.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x @ (x.T @ np.linalg.qr(q)[0]))
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    to = (vt[:dimensions].T * weight[:, None]).astype(np.float32)
    return {"to": to, "rows": _unit(labelled @ to), "label": label.astype(np.float32)}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(model: dict, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled rows, by exact cosine."""
    near = _unit(terms @ model["to"]) @ model["rows"].T
    k = min(neighbours, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    sim = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64)
    w = sim**SHARPNESS
    return (w * model["label"][top]).sum(1) / np.maximum(w.sum(1), 1e-300)


def held_out(doc_id: str = "doc_id"):
    """The fold that labels may not be learnt from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict | None:
    """Fit on at most per_class labelled rows of each class that aren't held out, the same ones in every run.

    A document with several labels counts with its lowest, one with several texts with that of the least
    hash; null ids or labels are left out. None where a class has no row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in parts(b.column("text")):
                x = term_matrix(off, data).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("quality").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "terms"])

    got = labelled_texts(docs, labels.where(~held_out()), per_class).mapInArrow(rows, "doc_id long, quality int, terms binary").collect()
    if len({r.quality for r in got}) < 2:
        return None
    got.sort(key=lambda r: r.doc_id)
    return fit(np.stack([np.frombuffer(r.terms, np.float16) for r in got]).astype(np.float32), np.array([r.quality for r in got]))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 where score >= 0.5).

    One row out for each row in, extra columns kept. Null texts and texts without a word score 0;
    if either class has no labelled row, all others score 0.5. Columns of docs named score or
    predicted are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    docs = docs.drop("score", "predicted")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for i, j, off, data in parts(b.column("text")):
                out[i:j] = 0.5 if model.value is None else vote(model.value, term_matrix(off, data))
                out[i:j][Words(off, data).count == 0] = 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(out, 0, 1)), pa.array((out >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op8_quality_knn(spark, sf_dir: str) -> DataFrame:
    out = quality_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1, repeated rows as often as they come.

    Null texts and texts without a word score 0 and go; without labels of both classes all others stay. An empty
    table gives an empty one. Of all columns, score and predicted of the documents' own too, only the given ones return."""
    safe = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("score", "predicted")})
    scored = quality_scores(safe, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(F.col("predicted") == 1)
    return scored.select(*(F.col(f"__own_{c}").alias(c) if c in ("score", "predicted") else F.col(c) for c in docs.columns))
