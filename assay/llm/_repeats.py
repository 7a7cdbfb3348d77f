"""Windows of a fixed number of tokens that start at two places or more, over all documents.

Equal windows have equal minimisers at the same place: the context (a shorter run of tokens) within them
whose hash is least. So windows are dealt out by their context, in runs of neighbours that share one. What
is found once with its context repeats nowhere and leaves. Of equal runs one goes on, with the weight two;
its tokens are cut out of its document, and a task orders the suffixes that start in the runs of one context
by the method of the operator that calls (radix passes, a suffix tree), through a window's tokens. Which of
them repeat is then told to all equal runs by a join.

Where a context has too many different runs for one task, it gets longer until what shares it fits: the
windows of its runs are parted by their distance from the minimiser, and the nearer these distances are, the
more tokens all windows of a part share. Parts are dealt out, leave, combine and learn of repeats as runs do,
so only hashes of large contexts move, and all that is ordered is ordered by its own tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm._state import drop, keep
from assay.llm._text import BYTE, Words, mixed, parts, prefix, quick_prefix, quick_spans, runs, sliding_argmin, spans

#: Bytes of tokens that a task orders at once, and different runs of one context beyond which it gets longer.
AT_ONCE, MOST_RUNS = 4 << 20, 20_000
#: Into how many parts a run's possible distances from the minimiser are cut each time.
FAN = 8

#: Whether the suffixes of runs repeat: of tokens, first token, number of windows, context and weight of each run, one flag for each window.
Order = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Units:
    """Tokens are bytes or words; window and context are counted in them."""

    words: bool
    window: int
    context: int

    def tokens(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, words as their hashes, and the index of each row's first."""
        if not self.words:
            return data, off
        words = Words(off, data)
        return words.hashes(data), words.first


class Runs:
    """Runs of neighbouring windows with one minimiser: first and last window, row, and hashes of the minimiser and of all tokens."""

    def __init__(self, units: Units, off: np.ndarray, data: np.ndarray) -> None:
        tokens, self.first = units.tokens(off, data)
        values = tokens if units.words else BYTE[tokens]
        n, c, w = len(values), units.context, units.window
        row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        if n < w:
            self.lo = self.hi = self.row = np.zeros(0, np.int64)
            self.context = self.span = np.zeros(0, np.uint64)
            return
        at = np.arange(n - c + 1)
        h = quick_spans(quick_prefix(values), at, at + c)
        least = sliding_argmin(h, w - c + 1)
        whole = np.flatnonzero(row[: n - w + 1] == row[w - 1 :])
        m, r = least[whole], row[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (m[1:] != m[:-1]) | (r[1:] != r[:-1])
        begin = np.flatnonzero(new)
        self.lo, self.hi, self.row = whole[begin], whole[np.append(begin[1:], len(whole)) - 1] if len(whole) else begin, r[begin]
        self.context = h[m[begin]]
        self.span = spans(prefix(values), self.lo, self.hi + w)


def with_uid(docs: DataFrame) -> DataFrame:
    """docs with __u, __v: 128 bits of hashes of id and text. Equal rows share them, being copies of each other."""
    return docs.withColumns({"__u": F.xxhash64("doc_id", "text"), "__v": F.xxhash64("text", F.lit(1), "doc_id")})


RUNS = "context long, span long, u long, v long, at int, size int"


def runs_of(docs: DataFrame, units: Units) -> DataFrame:
    """RUNS: context, hash of the tokens, document, first window in it and number of windows, of each run of docs (of with_uid())."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, off, data in parts(b.column("text")):
                got = Runs(units, off, data)
                of = pa.array(got.row + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(got.context.view(np.int64)), pa.array(got.span.view(np.int64)), b.column("u").take(of), b.column("v").take(of),
                        pa.array((got.lo - got.first[got.row]).astype(np.int32)), pa.array((got.hi - got.lo + 1).astype(np.int32)),
                    ],
                    ["context", "span", "u", "v", "at", "size"],
                )

    return docs.select(F.col("__u").alias("u"), F.col("__v").alias("v"), "text").mapInArrow(find, RUNS)


def _wanted(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """__u, __v, text and runs (the other columns of kinds) of the documents that kinds are to be cut from, of equal rows once; kinds: u, v and more."""
    by = kinds.groupBy(F.col("u").alias("__u"), F.col("v").alias("__v")).agg(F.collect_list(F.struct(*(c for c in kinds.columns if c not in ("u", "v")))).alias("runs"))
    both = docs.select("__u", "__v", "text").join(by, ["__u", "__v"])
    return both.groupBy("__u", "__v").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))


def _cut(b: pa.RecordBatch, units: Units) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of _wanted(): the wanted runs, the slice's tokens, each run's first token and number of windows."""
    for i, j, off, data in parts(b.column("text")):
        wanted = b.column("runs").slice(i, j - i)
        tokens, first = units.tokens(off, data)
        flat = pa.RecordBatch.from_struct_array(pc.list_flatten(wanted))
        yield flat, tokens, flat.column("at").to_numpy() + first[pc.list_parent_indices(wanted).to_numpy()], flat.column("size").to_numpy()


CUT = "context long, span long, weight int, size int, tokens binary"


def _cut_runs(wanted: DataFrame, units: Units) -> DataFrame:
    """CUT: the tokens of each wanted run (a word's hash has eight bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for flat, tokens, start, size in _cut(b, units):
                blobs = [tokens[s:e].tobytes() for s, e in zip(start.tolist(), (start + size + units.window - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(flat.column(c) for c in ("context", "span", "weight", "size")), pa.array(blobs, pa.binary())], ["context", "span", "weight", "size", "tokens"])

    return wanted.mapInArrow(cut, CUT)


FOUND = "context long, span long, hits array<int>"


def _found(context: np.ndarray, span: np.ndarray, size: np.ndarray, repeats: np.ndarray) -> pa.RecordBatch:
    """FOUND: of each run with repeated windows, the first and last of each series of them, in turn."""
    end = np.cumsum(size)
    # A gap after each run, so that no series goes on into the next.
    apart = np.zeros(int(end[-1] if len(end) else 0) + len(size), bool)
    apart[np.arange(len(repeats)) + np.repeat(np.arange(len(size)), size)] = repeats
    a, b = runs(apart)
    first = end - size + np.arange(len(size))
    of = np.searchsorted(first, a, "right") - 1
    pairs = np.stack((a - first[of], b - 1 - first[of]), axis=1).astype(np.int32).ravel()
    some, count = np.unique(of, return_counts=True)
    hits = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * count))).astype(np.int32)), pa.array(pairs))
    return pa.RecordBatch.from_arrays([pa.array(context[some]), pa.array(span[some]), hits], ["context", "span", "hits"])


def _whole_contexts(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.Table]:
    """Rows that come sorted by context, in tables of about at_once bytes (or one context) that end where a context does."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= at_once:
            got = pa.Table.from_batches(held)
            context = got.column("context").to_numpy()
            cut = int(np.searchsorted(context, context[-1], "left"))
            if cut:
                yield got.slice(0, cut)
            held = got.slice(cut).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held) if cut else 0
    if held:
        yield pa.Table.from_batches(held)


def _ordered(cut: DataFrame, units: Units, order: Order, at_once: int) -> DataFrame:
    """FOUND of CUT, context by context."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _whole_contexts(batches, at_once):
            off, data = _blobs(got.column("tokens"))
            tokens, first = (data.view(np.uint64), off // 8) if units.words else (data, off)
            context, span, size, weight = (got.column(c).to_numpy() for c in ("context", "span", "size", "weight"))
            yield _found(context, span, size, order(tokens, first[:-1], size.astype(np.int64), context, weight.astype(np.int64)))

    return cut.repartition("context").sortWithinPartitions("context").mapInArrow(find, FOUND)


def _blobs(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    one = col.combine_chunks()
    one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
    off = np.frombuffer(one.buffers()[1], np.int64 if pa.types.is_large_binary(one.type) else np.int32)[one.offset : one.offset + len(one) + 1].astype(np.int64)
    data = np.frombuffer(one.buffers()[2], np.uint8)[off[0] : off[-1]] if len(one) else np.zeros(0, np.uint8)
    return off - off[0], data.copy()


PARTS = "context long, span long, up_context long, up_span long, shift int, weight int, u long, v long, at int, off int, size int"


def _parts_of(wanted: DataFrame, units: Units, step: int) -> DataFrame:
    """PARTS of the runs of _wanted(), whose windows are parted by step distances from the minimiser.

    context: hash of the tokens that all windows at a part's distances share; off: distance of the part's
    first window; shift: that window within the run (up_context, up_span), which wanted has by its own off."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for flat, tokens, start, size in _cut(b, units):
                rows = pc.list_parent_indices(b.column("runs")).slice(at, len(flat))
                at += len(flat)
                values = tokens if units.words else BYTE[tokens]
                off = flat.column("off").to_numpy().astype(np.int64)
                if len(off) and off[0] < 0:
                    off = _minimisers(values, units, start, flat.column("context").to_numpy().view(np.uint64))
                run, part = _numbered((off - size + 1) // step, off // step)
                d, last = np.minimum(off[run], part * step + step - 1), np.maximum(off[run] - size[run] + 1, part * step)
                least, minimum = start[run] + off[run] - d, start[run] + off[run]
                sums = prefix(values)
                far = np.minimum(part * step + step - 1, units.window - units.context)
                context = spans(sums, minimum - part * step, minimum - far + units.window) ^ mixed((part * FAN + step).astype(np.uint64))
                span = spans(sums, least, least + d - last + units.window)
                of, shift = pa.array(run), off[run] - d
                own = {c: flat.column(c).take(of) for c in ("context", "span", "weight")}
                home = {c: b.column(f"__{c}").take(rows.take(of)) for c in ("u", "v")}
                places = [shift, flat.column("at").to_numpy()[run] + shift, d, d - last + 1]
                shift, at_, d, n = (pa.array(x.astype(np.int32)) for x in places)
                hashes = [pa.array(x.view(np.int64)) for x in (context, span)]
                yield pa.RecordBatch.from_arrays([*hashes, own["context"], own["span"], shift, own["weight"], home["u"], home["v"], at_, d, n], [c.split()[0] for c in PARTS.split(", ")])

    return wanted.mapInArrow(find, PARTS)


def _minimisers(values: np.ndarray, units: Units, start: np.ndarray, context: np.ndarray) -> np.ndarray:
    """How far the minimiser of each run is from its first token: it is the first place with the context's hash."""
    at = np.arange(len(values) - units.context + 1)
    h = quick_spans(quick_prefix(values), at, at + units.context)
    out = np.zeros(len(start), np.int64)
    for s in range(0, len(start), 1 << 12):
        some = start[s : s + (1 << 12), None] + np.arange(units.window - units.context + 1)
        out[s : s + (1 << 12)] = np.argmax(h[some] == context[s : s + (1 << 12), None], axis=1)
    return out


def _numbered(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and number of all numbers from low to high of each pair."""
    count = high - low + 1
    of = np.repeat(np.arange(len(low)), count)
    return of, low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


#: Keys of more rows than this, and than this part of all rows, are joined by broadcast: there are HOT_PART of them at most.
HOT_ROWS, HOT_PART = 5_000, 10_000


def _hot_apart(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with keys (on, n, more columns; n: how many rows a key has). Hot keys are few, so they are
    broadcast, and their rows aren't shuffled to one task each."""
    limit = max(HOT_ROWS, (keys.agg(F.sum("n")).first()[0] or 0) // HOT_PART)
    hot = F.broadcast(keys.where(F.col("n") > limit).drop("n"))
    rest = rows.join(hot.select(on), on, "left_anti").join(keys.where(F.col("n") <= limit).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)


def _shared(every: DataFrame, weight: Column) -> DataFrame:
    """The rows of every whose context more than one run has, by weight."""
    twice = keep(every.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("__w")).where("__w > 1").select("context", "n"), "repeat-contexts")
    out = keep(_hot_apart(every, twice, ["context"]), "repeat-shared")
    drop(every)
    drop(twice)
    return out


def repeated_windows(docs: DataFrame, units: Units, order: Order, at_once: int = AT_ONCE, most_runs: int = MOST_RUNS) -> DataFrame:
    """__u, __v, __hits of the documents (of with_uid()) with repeated windows: first and last window of series of them, in turn."""
    every, weight, off, step = keep(runs_of(docs, units), "repeat-runs"), F.lit(1), F.lit(-1), units.window - units.context + 1
    levels, ready = [], None
    while True:
        shared = _shared(every, weight)
        one = F.min(F.struct("u", "v", "at", off.alias("off"))).alias("one")
        alike = shared.groupBy("context", "span", "size").agg(F.count(F.lit(1)).alias("n"), F.least(F.sum(weight), F.lit(2)).cast("int").alias("weight"), one)
        alike = keep(alike.select("context", "span", "size", "n", "weight", "one.*"), "repeat-kinds")
        levels.append((shared, alike))
        kinds = alike.drop("n")
        # A part of one window shares all of its tokens with its context, so there it is the only kind.
        large = keep(kinds.groupBy("context").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > most_runs).select("context"), "repeat-large")
        last = step == 1 or not large.limit(1).count()
        fits = kinds if last else kinds.join(large, "context", "left_anti")
        ready = fits if ready is None else ready.unionByName(fits)
        if last:
            break
        step = max(FAN**k for k in range(10) if FAN**k < step)
        every = keep(_parts_of(_wanted(docs, kinds.join(large, "context", "left_semi")), units, step), "repeat-parts")
        weight, off = F.col("weight"), F.col("off")
    found = _ordered(_cut_runs(_wanted(docs, ready.drop("off")), units), units, order, at_once)
    if len(levels) > 1:
        found = keep(found, "repeat-ordered")
    known = found
    # From the smallest parts up: what repeats in a part is told to all runs that have it.
    for shared, alike in reversed(levels[1:]):
        here = keep(known.join(alike.select("context", "span", "n"), ["context", "span"]), "repeat-found")
        above = _hot_apart(shared, here, ["context", "span"]).select(F.col("up_context").alias("context"), F.col("up_span").alias("span"), F.transform("hits", lambda x: x + F.col("shift")).alias("hits"))
        known = found.unionByName(keep(above.groupBy("context", "span").agg(F.flatten(F.collect_list("hits")).alias("hits")), "repeat-above"))
    shared, alike = levels[0]
    here = keep(known.join(alike.select("context", "span", "n"), ["context", "span"]), "repeat-found")
    absolute = _hot_apart(shared, here, ["context", "span"]).select("u", "v", F.transform("hits", lambda x: x + F.col("at")).alias("hits"))
    by = absolute.groupBy(F.col("u").alias("__u"), F.col("v").alias("__v")).agg(F.flatten(F.collect_list("hits")).alias("__hits"))
    hits = keep(by, "repeat-hits")
    for table in (here, *(t for level in levels for t in level)):
        drop(table)
    return hits


def with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs (of with_uid()) with __hits, an array that may be empty."""
    out = docs.join(hits, ["__u", "__v"], "left")
    return out.withColumn("__hits", F.coalesce("__hits", F.array().cast("array<int>"))).drop("__u", "__v")


def removed(units: Units, first: np.ndarray, hits: pa.ListArray) -> np.ndarray:
    """Which tokens the windows of hits cover; first: of each row."""
    flat, of = pc.list_flatten(hits).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(hits).to_numpy()
    at = flat + first[of]
    n = int(first[-1])
    step = np.bincount(at[::2], minlength=n + 1) - np.bincount(at[1::2] + units.window, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


class Groups:
    """Suffixes in an order in which those that agree so far are neighbours; sort() refines it by one more digit."""

    def __init__(self, key: np.ndarray, weight: np.ndarray) -> None:
        self.weight = weight
        self.order = np.argsort(key, kind="stable")
        near = key[self.order]
        self.new = np.ones(len(key), bool)
        self.new[1:] = near[1:] != near[:-1]
        self.leave()

    def sort(self, digit: np.ndarray) -> bool:
        """Splits groups by a digit of each suffix in the present order. False where all agree already."""
        apart = np.zeros(len(digit), bool)
        apart[1:] = ~self.new[1:] & (digit[1:] != digit[:-1])
        if not apart.any():
            return False
        group = np.cumsum(self.new) - 1
        some = np.zeros(int(group[-1]) + 1, bool)
        some[group[apart]] = True
        at = np.flatnonzero(some[group])
        by = at[np.lexsort((digit[at], group[at]))]
        self.order[at] = self.order[by]
        digit = digit[by]
        split = np.zeros(len(at), bool)
        split[1:] = digit[1:] != digit[:-1]
        self.new[at] |= split
        return True

    def leave(self) -> np.ndarray:
        """Suffixes that are alone and stand for one go. Which ones stay."""
        first = np.flatnonzero(self.new)
        count = np.diff(np.append(first, len(self.order)))
        stay = np.repeat(np.add.reduceat(self.weight[self.order], first) > 1, count) if len(first) else np.zeros(0, bool)
        self.order, self.new = self.order[stay], self.new[stay]
        return stay


def suffixes(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and first token of each window."""
    run = np.repeat(np.arange(len(size)), size)
    return run, first[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
