"""Order-preserving packing: dynamic programming over cuts at document and sentence ends.

Documents follow each other as they are read, and a sequence is a window of this stream. A window costs its
padding, and its end costs a truncation penalty: nothing at a document's end, something at a sentence's, more
within a sentence (offered only where a sentence is long). The cheapest way to a cut is the cheapest cut at
most one length before it, by cost and place: a sliding minimum, kept by a monotone queue. Windows of a
power of two need no padding and are looked at beside it. Tasks pack what they read, in bounded blocks.

Tokens are made once for each different piece of text: a byte-level BPE whose words take one leading space can't
see across a space, so texts are cut there and short pieces are looked up by two hashes (128 bits)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm._state import read
from assay.llm._text import BYTE, mixed, parts, quick_prefix, quick_spans

LENGTH, END = 1024, 0
#: Penalties in tokens of padding: a cut at the end of a sentence, and within one.
SENTENCE, WITHIN = 4, 16
#: A window of a power of two isn't padded from here on.
LEAST_POWER = 128
#: Sentences of more tokens than this may be cut within, at every so many tokens.
LONG, EVERY = 32, 16
#: Tokens that are packed at once; the last windows of such a block are packed again with the next.
BLOCK = 1 << 20
#: Pieces of text whose tokens a worker remembers, and bytes of pieces that are tokenised in one text.
REMEMBERED, AT_ONCE = 1_500_000, 1 << 15

#: Longer pieces aren't remembered: the hashes' weak strings are longer.
HASHED = 255
_OTHER = np.random.default_rng(11).integers(0, 2**31, 256, dtype=np.uint64)
_CUT = np.zeros(256, bool)  # bytes before which a space or line break may be cut off: no white space, and none of Unicode's
_CUT[33:] = True
_CUT[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


def pieces(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces of text that are tokenised alone as they are within their text, and each row's first piece (one more than rows)."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[:-2] = (data[:-1] == 32) & _CUT[data[1:]]
        line = np.flatnonzero((data[1:-1] == 10) & (data[:-2] > 32) & (data[:-2] < 127) & _CUT[data[2:]]) + 1
        cut[line] = cut[line + 1] = True
    has = off[:-1] < off[1:]
    cut[off[:-1][has]] = True
    # A space that ends a row is followed by another row's text.
    last = off[1:][has] - 1
    last = last[(last > off[:-1][has]) & ((data[last] == 32) | (data[last] == 10))]
    cut[last] = False
    cut[n] = False
    start = np.flatnonzero(cut)
    return start, np.searchsorted(start, off)


class Encoder:
    """Tokens of texts by a tokenizer file; one for each worker and file, which remembers pieces."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.line = self._ids(["\n"])[0]
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def forget(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of pieces, each one's first, and how many it has. Plain pieces (no white space but a leading space, and no bytes
        that begin Unicode's) are joined by line breaks, which they don't hold, and their tokens parted again."""
        bad = np.concatenate(([0], np.cumsum(~_CUT[data])))
        led = (data[start] == 32) & (end - start > 1)
        plain = bad[end] == bad[start + led]
        count, made = np.zeros(len(start), np.int64), [np.zeros(0, np.uint32)]
        at = np.flatnonzero(plain)
        for group in np.split(at, np.flatnonzero(np.diff(np.cumsum(end[at] - start[at]) // AT_ONCE)) + 1) if len(at) else ():
            size = end[group] - start[group]
            # Each piece and a break after it, but for the last one's.
            last = np.cumsum(size + 1)
            take = np.repeat(start[group] - last + size + 1, size + 1) + np.arange(int(last[-1]))
            text = data[np.minimum(take, len(data) - 1)]
            text[last - 1] = 10
            ids = self._ids([text[:-1].tobytes().decode()])[0]
            stop = np.append(np.flatnonzero(ids == self.line[0]), len(ids))
            count[group] = np.diff(stop, prepend=-1) - 1
            made.append(np.delete(ids, stop[:-1]))
        at = np.flatnonzero(~plain)
        alone = self._ids([data[s:e].tobytes().decode() for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        count[at] = [len(x) for x in alone]
        order = np.concatenate((np.flatnonzero(plain), at))
        first = np.zeros(len(start), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate((*made, *alone)), first, count

    def __call__(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all rows, the first token of each row (one more than rows), and tokens after which a sentence may end."""
        start, row = pieces(off, data)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
        end = np.append(start[1:], len(data))
        key, check = (quick_spans(quick_prefix(values[data]), start, end) for values in (BYTE, _OTHER))
        long = np.flatnonzero(end - start > HASHED)
        key[long] = mixed(mixed(key[long]) + np.arange(len(long), dtype=np.uint64))
        every, one, of = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.key, every), max(0, len(self.key) - 1))
        known = (self.key[at] == every) & (self.check[at] == check[one]) if len(self.key) else np.zeros(len(every), bool)
        first, count = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        first[known], count[known] = self.first[at[known]], self.count[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            made, first[new], count[new] = self._fresh(data, start[one[new]], end[one[new]])
            first[new] += len(self.flat)
            self.flat = np.concatenate((self.flat, made))
        n = count[of]
        last = np.cumsum(n)
        ids = self.flat[np.repeat(first[of] - last + n, n) + np.arange(int(last[-1]))]
        if len(new):
            add = new[(end - start)[one[new]] <= HASHED]
            if len(self.key):
                add = add[self.key[at[add]] != every[add]]
            # Both are sorted, so new keys are put between the known ones.
            place = np.searchsorted(self.key, every[add])
            self.key, self.check = np.insert(self.key, place, every[add]), np.insert(self.check, place, check[one[add]])
            self.first, self.count = np.insert(self.first, place, first[add]), np.insert(self.count, place, count[add])
            if len(self.key) > REMEMBERED:
                self.forget()
        stop = _STOP[data[end - 1]]
        # Of a full stop and the line break after it, the break.
        stop[:-1] &= ~((data[start[1:]] == 10) & (end[1:] - start[1:] == 1))
        return ids, np.concatenate(([0], last))[row], last[stop]


def candidates(end: np.ndarray, sentence: np.ndarray, final: bool, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, from 0 to its end, and their penalties. end: of documents; sentence: ends of sentences."""
    place = np.union1d(np.concatenate(([0], sentence)), end)
    price = np.full(len(place), SENTENCE, np.int64)
    price[np.isin(place, end)] = 0
    gap = np.diff(place)
    far = np.flatnonzero(gap > min(LONG, length))
    step = min(EVERY, length)
    more = [np.arange(place[i] + step, place[i + 1], step) for i in far.tolist()]
    if final:
        more.append(np.arange(max(1, end[-1] - length + step), end[-1], step))
    more = np.setdiff1d(np.concatenate((*more, np.zeros(0, np.int64))), place)
    both = np.concatenate((place, more))
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate((price, np.full(len(more), WITHIN, np.int64)))[order]


def best_cuts(place: np.ndarray, price: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices of the cuts of the cheapest windows from the first place to the last, both included.

    Cost of a cut: least over the cuts i at most `length` before it of cost i + price i + padding. Padding is
    length less the window's size, so the least is that of cost + price + place over a sliding range, which a
    monotone queue has at its front; windows of a power of two are compared one by one."""
    m = len(place)
    power = 1 << np.arange((LEAST_POWER - 1).bit_length(), length.bit_length())
    want = place[:, None] - power[None, :]
    at = np.minimum(np.searchsorted(place, want), m - 1)
    hit, which = np.nonzero(place[at] == want)
    pointer, source = np.searchsorted(hit, np.arange(m + 1)).tolist(), at[hit, which].tolist()
    where, toll = place.tolist(), price.tolist()
    key, back = [0] * m, [0] * m  # key: cost + price + place
    queue, head = [0], 0
    key[0] = where[0]
    for j in range(1, m):
        p = where[j]
        low = p - length
        while where[queue[head]] < low:
            head += 1
        i = queue[head]
        best = key[i] + length - p
        for s in range(pointer[j], pointer[j + 1]):
            k = source[s]
            c = key[k] - where[k]
            if c < best:
                best, i = c, k
        back[j] = i
        k = best + toll[j] + p
        key[j] = k
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts = [m - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


PIECE = [T.StructField(n, T.LongType()) for n in ("start", "length")] + [T.StructField("ids", T.BinaryType())] + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]


class _Stream:
    """Documents that wait to be packed: id, tokens, where they start in their documents, and ends of sentences."""

    def __init__(self, length: int) -> None:
        self.length, self.number = length, TaskContext.get().partitionId() << 33
        self.docs: list[tuple[object, np.ndarray, int, int, np.ndarray]] = []
        self.size = 0

    def add(self, doc: object, ids: np.ndarray, sentence: np.ndarray) -> None:
        self.docs.append((doc, ids, 0, len(ids), sentence))
        self.size += len(ids)

    def pack(self, final: bool) -> tuple[list, list[np.ndarray]]:
        """Documents and columns (start, size, number of sequence, offset, doc_tokens, ids) of the pieces of all windows but the last two, unless this is the end."""
        end = np.cumsum([len(d[1]) for d in self.docs])
        sentence = np.concatenate([d[4] + e - len(d[1]) for d, e in zip(self.docs, end.tolist(), strict=True)])
        place, price = candidates(end, sentence, final, self.length)
        window = place[best_cuts(place, price, self.length)]
        if not final:
            window = window[:-2]
        done = int(window[-1])
        ids = np.concatenate([d[1] for d in self.docs])
        edge = np.union1d(window, end[end < done])
        a, b = edge[:-1], edge[1:]
        doc, seq = np.searchsorted(end, a, "right"), np.searchsorted(window, a, "right") - 1
        begin = np.array([e - len(d[1]) - d[2] for d, e in zip(self.docs, end.tolist(), strict=True)], np.int64)
        whole = np.array([d[3] for d in self.docs], np.int64)
        out = [a - begin[doc], b - a, self.number + seq, a - window[seq], whole[doc]]
        blobs = [ids[s:e].astype("<u4", copy=False).tobytes() for s, e in zip(a.tolist(), b.tolist(), strict=True)]
        names = [self.docs[d][0] for d in doc.tolist()]
        self.number += len(window) - 1
        k = int(np.searchsorted(end, done, "right"))
        rest = self.docs[k:]
        if rest and (gone := done - (int(end[k]) - len(rest[0][1]))):
            d = rest[0]
            left = d[4] - gone
            rest[0] = (d[0], d[1][gone:], d[2] + gone, d[3], left[left > 0])
        self.docs, self.size = rest, self.size - done
        return names, [*out, blobs]


def packed(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of docs (doc_id, text; other columns are left out) in sequences of at most `length` tokens: doc_id, start, length, ids
    (little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset.

    A document's tokens are those of its whole text by the tokenizer file `path`, without special ones, and END. Each token
    is in one piece; the pieces of a document follow each other, in a sequence or in neighbouring ones. A null or empty
    text is END alone. Rows that repeat, and null ids, are documents of their own; an empty table gives an empty one. Order is that of the
    table as a task reads it; each task packs what it reads, block by block of BLOCK tokens (or one document), so cuts are the best ones of
    a block, and a task may end with a padded window. `path` must be readable where tasks run."""
    kind = docs.schema["doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stream = Encoder.of(path), _Stream(length)

        def out(final: bool) -> pa.RecordBatch:
            doc, (start, size, number, offset, whole, blobs) = stream.pack(final)
            of = pa.array(doc, T_ARROW[kind.dataType.simpleString()])
            return pa.RecordBatch.from_arrays([of, pa.array(start), pa.array(size), pa.array(blobs, pa.binary()), pa.array(whole), pa.array(number), pa.array(offset)], ["doc_id", *(f.name for f in PIECE)])

        for b in batches:
            names = b.column("doc_id").to_pylist()
            for i, j, off, data in parts(b.column("text"), 1 << 22, 4096):
                ids, first, stop = encode(off, data)
                of = np.searchsorted(stop, first)
                for d in range(j - i):
                    s, e = int(first[d]), int(first[d + 1])
                    inner = stop[np.searchsorted(stop, s, "right") : of[d + 1]] - s
                    stream.add(names[i + d], np.append(ids[s:e], np.uint32(END)), inner)
                    if stream.size >= BLOCK:
                        yield out(False)
        if stream.docs:
            yield out(True)

    return docs.select("doc_id", "text").mapInArrow(pack, T.StructType([kind, *PIECE]))


T_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def op11_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = packed(read(spark, sf_dir, "documents"), str(tokenizer))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
