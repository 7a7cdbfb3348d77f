"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm._state import keep, read
from assay.llm._text import FOLDED, SPACE, Words, parts, prefix, spans

#: Word errors allowed for each word of an item; items of fewer words are not looked for. Items of 6 words or fewer are looked for as they are.
ERROR_RATE, LEAST_WORDS = 0.15, 1
#: Items that are looked for at once, and broadcast.
BLOCK = 20_000

_GAP = SPACE.copy()
_GAP[[c for c in range(33, 128) if not chr(c).isalnum()]] = True
_BITS = 22
MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end_word", T.IntegerType())]))


def tokens(off: np.ndarray, data: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words are runs of ASCII letters, digits and all other than ASCII; case is folded for A-Z and U+00C0 to U+00DE."""
    folded = data.copy()
    if len(data):
        folded[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 0x20
    words = Words(off, data, _GAP)
    return words, words.hashes(folded, FOLDED)


class Items:
    """Items cut in pieces, one more than errors are allowed, with a table of piece hashes for each length."""

    def __init__(self, ids: list[int | None], texts: list[str | None], rate: float = ERROR_RATE, least_words: int = LEAST_WORDS) -> None:
        self.ids, self.budget, self.length, self.masks = ids, [0] * len(ids), [0] * len(ids), [{} for _ in ids]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, _, off, data in parts(pa.array(texts, pa.string())):
            words, h = tokens(off, data)
            for d in range(len(off) - 1):
                item, k = h[words.first[d] : words.first[d + 1]], i + d
                n = len(item)
                if n < least_words:
                    continue
                self.budget[k], self.length[k] = int(n * rate), n
                for at, x in enumerate(item.tolist()):
                    self.masks[k][x] = self.masks[k].get(x, 0) | 1 << at
                cut = [n * p // (self.budget[k] + 1) for p in range(self.budget[k] + 2)]
                sums = prefix(item)
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    pieces.setdefault(b - a, []).append((int(spans(sums, np.array([a]), np.array([b]))[0]), k, a))
        self.pieces = {}
        for size, rows in pieces.items():
            key = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[(key & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            self.pieces[size] = key[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order], seen

    def distance(self, k: int, text: list[int]) -> tuple[int, int]:
        """Least edit distance in words of item k to any substring of text, and the index after its first best end (Myers)."""
        m, masks = self.length[k], self.masks[k]
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, end = full, 0, m, m, 0
        for at, x in enumerate(text):
            eq = masks.get(x, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (full & ~(xh | pv)), pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
            if score < best:
                best, end = score, at + 1
        return best, end

    def matches(self, off: np.ndarray, data: np.ndarray) -> dict[int, list[dict]]:
        """By row, the items that it holds within their budgets."""
        words, h = tokens(off, data)
        sums, row = prefix(h), words.row
        near: dict[tuple[int, int], list[int]] = {}
        for size, (key, item, offset, seen) in self.pieces.items():
            m = len(h) - size + 1
            if m <= 0:
                continue
            at = np.flatnonzero(row[:m] == row[size - 1 :])
            w = spans(sums, at, at + size)
            some = seen[(w & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
            at, w = at[some], w[some]
            lo, hi = np.searchsorted(key, w, "left"), np.searchsorted(key, w, "right")
            for a, s, e in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for p in range(s, e):
                    near.setdefault((int(row[a]), int(item[p])), []).append(a - int(offset[p]))
        out: dict[int, list[dict]] = {}
        for (d, k), starts in sorted(near.items()):
            first, last, slack = int(words.first[d]), int(words.first[d + 1]), self.budget[k]
            best, end, upto = slack + 1, 0, -1
            starts = sorted(set(starts))
            for p, s in enumerate(starts):
                upto = upto if upto >= 0 else max(first, s - slack)
                if p + 1 == len(starts) or starts[p + 1] - slack > s + self.length[k] + slack:
                    got, at = self.distance(k, h[upto : min(last, s + self.length[k] + slack)].tolist())
                    if got < best:
                        best, end = got, upto + at - first
                    upto = -1
            if best <= slack:
                out.setdefault(d, []).append({"item_id": self.ids[k], "distance": best, "end_word": end})
        return out


_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end_word", pa.int32())]))


def _block(spark, items: DataFrame, block: int, blocks: int, rate: float, least_words: int):
    """Broadcast of one block of items, about BLOCK of them."""
    rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
    rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text or ""))
    return spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], rate, least_words))


def _searched(docs: DataFrame, held) -> DataFrame:
    """docs with matches of one block."""
    names = [*docs.columns, "matches"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for i, _, off, data in parts(b.column("text")):
                for d, got in held.value.matches(off, data).items():
                    found[i + d] = got
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _KIND)], names)

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField("matches", MATCHES)]))


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least_words: int = LEAST_WORDS, block_items: int | None = None) -> DataFrame:
    """docs with matches, an array of (item_id, distance, end_word) of the items that a text holds.

    An item is held where some run of the text's words is within int(rate * words) word edits of it;
    end_word is the first best end. Items of fewer than least_words words, null ones too, match
    nothing; null and empty texts hold nothing. One row out for each row in; extra columns stay, but
    for one named matches. Items are a stated query set, looked for in blocks of about block_items (BLOCK): of several, each
    is a job of its own whose items leave memory when its matches are written, so a worker holds one block,
    however many there are; only documents with matches are written and joined to the rest."""
    spark, docs = docs.sparkSession, docs.drop("matches")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = max(1, -(-items.count() // (block_items or BLOCK)))
    if blocks == 1:
        return _searched(docs, _block(spark, items, 0, 1, rate, least_words))
    # Equal rows hold the same items and are searched once where a task meets them.
    known = docs.withColumns({"__u": F.xxhash64("doc_id", "text"), "__v": F.xxhash64("text", F.lit(1), "doc_id")})
    found = []
    for block in range(blocks):
        held = _block(spark, items, block, blocks, rate, least_words)
        some = _searched(known.select("__u", "__v", "text"), held).where(F.size("matches") > 0)
        found.append(keep(some.select("__u", "__v", "matches").dropDuplicates(["__u", "__v"]), "benchmark-matches"))
        held.destroy()
    every = reduce(DataFrame.unionByName, found).groupBy("__u", "__v").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    out = known.join(every, ["__u", "__v"], "left").withColumn("matches", F.coalesce("matches", F.array().cast(MATCHES)))
    return out.select(*docs.columns, "matches")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row for each document and item that it holds."""
    found = find_items(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.end_word")


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, repeated rows as often as they come.

    Null and empty texts hold nothing and stay; without items all stay; an empty table gives an empty one. A
    column named matches is the documents' own."""
    safe = docs.withColumnsRenamed({"matches": "__own_matches"})
    found = find_items(safe, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("matches") == 0)
    return found.select(*(F.col("__own_matches").alias(c) if c == "matches" else F.col(c) for c in docs.columns))
