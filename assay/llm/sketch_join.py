"""N-gram Jaccard join by parity sketches.

Each shingle flips one bit of a wide parity sketch of its document, so the Hamming distance of two
sketches is at most the symmetric difference of the sets. Two sets of sizes n1, n2 with Jaccard
similarity t or more differ in at most D = (n1 + n2) (1 - t) / (1 + t) shingles. In each size band
the sketch is cut in D + 1 + S pieces: at least 1 + S of them are equal, so documents meet on the
hash of an equal piece. Empty pieces say little: a document with at most S of them needn't offer
them, as one of the equal pieces then isn't empty. The spare S grows with D, as the empty pieces do, so
that long documents needn't either. A document that shares fewer of the pieces it offers than that
leaves, such as one that only has a common passage with others, links with nothing.

Equal sets are one node. Groups that share a piece are joined to one member each (a star); pairs of
the rest are looked at only where verified links don't connect them yet, so a group of copies costs
its size and not its square."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm._components import components
from assay.llm._state import drop, keep, read
from assay.llm._text import FOLDED, Words, mixed, parts, prefix, spans

SHINGLE = 5
#: Similarity as hundredths, compared in integers.
PERCENT = 80
#: Pieces beyond those that the pigeonhole needs: so many, and one for each so many differences. A set
#: in the band above its own has 2.9 shingles for each difference or more, so 9 % of its pieces or fewer are empty.
SPARE, SPARE_EVERY = 12, 8
#: Fewest bits of the short sketch that goes with a candidate; rows of a group compared at once; members verified at once.
SHORT_BITS, BLOCK, VERIFY = 512, 2048, 256
#: Piece hashes that a map task gathers before it hands them out; bytes of them that a task groups at once.
FLUSH, BUCKET_BYTES = 1 << 20, 24 << 20
#: Hashes of wanted texts, of eight bytes, that are broadcast so that other texts aren't shuffled; more are joined by shuffle.
BROADCAST_TEXTS = 4_000_000


def shingles(off: np.ndarray, data: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles, by row; a text of fewer words has its whole sequence as one."""
    words = Words(off, data)
    h = words.hashes(data, FOLDED)
    sums, m = prefix(h), len(h) - size + 1
    at = np.flatnonzero(words.row[:m] == words.row[size - 1 :]) if m > 0 else np.zeros(0, np.int64)
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    row = np.concatenate((words.row[at], few))
    x = np.concatenate((spans(sums, at, at + size), spans(sums, words.first[few], words.first[few + 1])))
    order = np.lexsort((x, row))
    row, x = row[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1])
    return row[new], x[new]


def nodes_of(row: np.ndarray, x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and 63-bit identities of the sets."""
    first = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(first)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(x + np.uint64(1)))))
    return n, (mixed(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def short_sketches(row: np.ndarray, x: np.ndarray, rows: int) -> list[bytes]:
    """Parity sketches, each of the power of two of bits that isn't less than the set's size."""
    n = np.bincount(row, minlength=rows)
    bits = np.maximum(SHORT_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    end = np.cumsum(bits)
    at = (end - bits)[row] + (x & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    flat = np.packbits((np.bincount(at, minlength=int(end[-1]) if rows else 0) & 1).astype(np.uint8))
    return [flat[s:e].tobytes() for s, e in zip(((end - bits) // 8).tolist(), (end // 8).tolist(), strict=True)]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as uint64, folded to `size` bytes: what the set's sketch of so many bits is."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def _edges(percent: int) -> np.ndarray:
    """Least sizes of the bands: a set links only within its own and the neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def _layout(row: np.ndarray, wide: np.ndarray, rows: int, up: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In the band that is up above a set's own: band, spare pieces, first piece of each row, piece of each shingle, shingles in each piece."""
    n = np.bincount(row, minlength=rows)
    edges = _edges(percent)
    band = np.searchsorted(edges, n, "right") + up
    budget = 2 * (edges[band] - 1) * (100 - percent) // (100 + percent)
    spare = SPARE + budget // SPARE_EVERY
    count = np.where(n > 0, budget + 1 + spare, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    piece = first[row] + ((wide >> np.uint64(32)) * count[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    return band, spare, first, piece, np.bincount(piece, minlength=int(first[-1]))


def _wide(x: np.ndarray) -> np.ndarray:
    return mixed(x ^ np.uint64(0x5851F42D4C957F2D))


def _empty(first: np.ndarray, held: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(held == 0)))
    return total[first[1:]] - total[first[:-1]]


def offered(row: np.ndarray, x: np.ndarray, rows: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """How many offered pieces a set shares at least with any set that it links with, and how many it has at most."""
    layouts = [_layout(row, _wide(x), rows, up, percent) for up in (0, 1)]
    need = np.maximum(1, np.min([1 + spare - _empty(first, held) for _, spare, first, _, held in layouts], axis=0))
    return need, np.sum([np.diff(first) for _, _, first, _, _ in layouts], axis=0)


def pieces(row: np.ndarray, x: np.ndarray, rows: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the sketch pieces that each document offers, in its own band and the next."""
    out_row, out_key = [], []
    wide = _wide(x)
    for up in (0, 1):
        band, spare, first, piece, held = _layout(row, wide, rows, up, percent)
        order = np.argsort(piece, kind="stable")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide[order])))
        end = np.cumsum(held)
        value = sums[end] - sums[end - held]
        of = np.repeat(np.arange(rows), np.diff(first))
        place = np.arange(len(held)) - first[of]
        offer = (held > 0) | (_empty(first, held) > spare)[of]
        salt = mixed((band[of].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
        key = mixed(value + salt + held.astype(np.uint64))
        out_row.append(of[offer])
        out_key.append(key[offer])
    return np.concatenate(out_row), np.concatenate(out_key)


def shingle_nodes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, node (null without words), need and pieces (of offered()), sketch of each row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in parts(b.column("text")):
                row, x = shingles(off, data)
                n, node = nodes_of(row, x, j - i)
                sketch = short_sketches(row, x, j - i)
                need, most = offered(row, x, j - i, percent)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("t").slice(i, j - i), pa.array(n), pa.array(node, mask=n == 0), pa.array(need), pa.array(most), pa.array(sketch, pa.binary())],
                    ["doc_id", "t", "n_shingles", "node", "need", "pieces", "sketch"],
                )

    return rows.mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, n_shingles long, node long, need long, pieces long, sketch binary")


def _dealt(docs: DataFrame, buckets: int, percent: int) -> DataFrame:
    """bucket, keys, nodes: piece keys and node ids packed by bucket; a node's pieces once for each batch."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            key, node = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
            place = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            key, node, place = key[order], node[order], place[order]
            cut = np.flatnonzero(np.diff(place, prepend=-1))
            ends = [*cut[1:].tolist(), len(key)]
            blobs = [[v[s:e].tobytes() for s, e in zip(cut.tolist(), ends, strict=True)] for v in (key, node)]
            return pa.RecordBatch.from_arrays([pa.array(place[cut].astype(np.int32)), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], ["bucket", "keys", "nodes"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            seen = np.zeros(0, np.int64)
            for i, j, off, data in parts(b.column("text")):
                row, x = shingles(off, data)
                _, node = nodes_of(row, x, j - i)
                fresh = np.zeros(j - i, bool)
                fresh[np.unique(node, return_index=True)[1]] = True
                fresh &= ~np.isin(node, seen)
                seen = np.concatenate((seen, node[fresh]))
                on = fresh[row]
                r, key = pieces(row[on], x[on], j - i, percent)
                if len(key):
                    held.append((key, node[r]))
                    size += len(key)
                if size >= FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(find, "bucket int, keys binary, nodes binary")


def _shared(dealt: DataFrame) -> DataFrame:
    """sig, node, keys: for each distinct set of nodes that meet on pieces, its members and on how many."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []
        for b in batches:
            keys += [np.frombuffer(x, np.uint64) for x in b.column("keys").to_pylist()]
            nodes += [np.frombuffer(x, np.int64) for x in b.column("nodes").to_pylist()]
        key, node = np.concatenate(keys), np.concatenate(nodes)
        del keys, nodes
        order = np.argsort(key)
        key, node = key[order], node[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        key, node = key[same], node[same]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(node.astype(np.uint64)))))
        sig = mixed(total[first + size] - total[first] + size.astype(np.uint64)).view(np.int64)
        _, once, times = np.unique(sig, return_index=True, return_counts=True)
        once, times = once[size[once] > 1], times[size[once] > 1]
        at = np.repeat(first[once] - np.concatenate(([0], np.cumsum(size[once])[:-1])), size[once]) + np.arange(size[once].sum()) if len(once) else np.zeros(0, np.int64)
        for s in range(0, len(at), 1 << 18):
            e = s + (1 << 18)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sig[once], size[once])[s:e]), pa.array(node[at[s:e]]), pa.array(np.repeat(times, size[once])[s:e])], ["sig", "node", "keys"])

    return dealt.groupBy("bucket").applyInArrow(find, "sig long, node long, keys long").groupBy("sig", "node").agg(F.sum("keys").alias("keys"))


def _enough(groups: DataFrame, need: DataFrame) -> DataFrame:
    """sig, node, keys, hub: groups without the nodes that share too few pieces to link with anything, if two
    or more are left. hub is the member that shares most pieces. need: node, need."""
    able = groups.groupBy("node").agg(F.sum("keys").alias("all")).join(need, "node").where("all >= need").select("node", "all")
    rest = groups.join(able, "node")
    several = rest.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.max(F.struct("all", "node")).alias("h")).where("x <> y").select("sig", F.col("h.node").alias("hub"))
    return rest.drop("all").join(several, "sig")


def _apart(groups: DataFrame, root: DataFrame) -> DataFrame:
    """hub, node, root: of the groups whose members have different roots, all that meet one hub, once.

    Two members of a group both meet its hub, so all pairs of a group are pairs of its hub's."""
    rows = groups.select("sig", "node", "hub").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rows.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("sig")
    return rows.join(several, "sig", "left_semi").select("hub", "node", "root").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact sizes of intersection and union of their shingle sets."""
    order = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / VERIFY).cast("long")))
    counted = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a").select("a", "b", order.alias("part"))
    rows = counted.select("a", "part", F.col("b").alias("node")).unionByName(counted.select("a", "part", F.col("a").alias("node")).distinct())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, a, held = None, None, []
        for b in batches:
            a, node = b.column("a")[0].as_py(), b.column("node").to_numpy()
            for i, j, off, data in parts(b.column("text")):
                row, x = shingles(off, data)
                first = np.searchsorted(row, np.arange(j - i + 1))
                for d in range(j - i):
                    s = x[first[d] : first[d + 1]]
                    if node[i + d] == a:
                        center = s
                    else:
                        held.append((int(node[i + d]), s))
        found = []
        for other, s in held:
            both = int(np.isin(s, center, assume_unique=True).sum()) if center is not None else 0
            if 100 * both >= percent * (len(s) + len(center) - both):
                found.append(other)
        yield pa.RecordBatch.from_arrays([pa.array([a] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

    return rows.join(texts, "node").groupBy("a", "part").applyInArrow(check, "a long, b long")


def _near(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet one hub, of different roots, whose sizes and short sketches allow a link.

    groups: hub, node, root, n, sketch. A large group is cut in blocks, and each pair of blocks is a task's."""
    sized = groups.join(groups.groupBy("hub").agg(F.count(F.lit(1)).alias("size")), "hub")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.greatest(blocks, F.lit(1)).cast("long")).cast("int")
    rows = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1)))
    rows = rows.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "n", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        node, root, n = (got.column(c).to_numpy() for c in ("node", "root", "n"))
        sketch = got.column("sketch").to_pylist()
        least = min(map(len, sketch))
        sketch = np.stack([folded(x, least) for x in sketch])
        order = np.argsort(node)
        node, root, n, sketch = node[order], root[order], n[order], sketch[order]
        for s in range(0, len(node), 64):
            e = min(s + 64, len(node))
            budget = (n[s:e, None] + n[None, :]) * (100 - percent) // (100 + percent)
            ok = (root[s:e, None] != root[None, :]) & (node[s:e, None] < node[None, :]) & (np.abs(n[s:e, None] - n[None, :]) <= budget)
            a, b = np.nonzero(ok)
            far = np.bitwise_count(sketch[s + a] ^ sketch[b]).sum(1)
            a, b = a[far <= budget[a, b]], b[far <= budget[a, b]]
            yield pa.RecordBatch.from_arrays([pa.array(node[s + a]), pa.array(node[b])], ["a", "b"])

    return rows.groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, text of the nodes of pairs. nodes: node, doc_id, t.

    Only their texts go into the shuffle where the hashes of all of them are few enough to be broadcast."""
    wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "doc_id", "t")
    wanted = keep(wanted, "sketch-wanted")
    own = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    if wanted.count() <= BROADCAST_TEXTS:
        own = own.join(F.broadcast(wanted.select("t").distinct()), "t", "left_semi")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.t") == F.col("m.t"))
    texts = keep(own.alias("d").join(wanted.alias("m"), same).select("m.node", "d.text").dropDuplicates(["node"]), "sketch-texts")
    drop(wanted)
    return texts


def similar_components(docs: DataFrame, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """doc_id, t, n_shingles, component_id, root (of the component; null without words) of each row of docs (doc_id, text).

    Documents link where their sets of distinct 5-word shingles (A-Z lower-cased) have a Jaccard
    similarity of percent / 100 or more; component_id is the least doc_id that links reach. Without
    words a row is alone and has its own id. Equal rows link as equal texts do; a null doc_id is never
    the least unless it is alone. An empty table gives an empty one."""
    info = keep(shingle_nodes(docs, percent), "shingle-nodes")
    if buckets is None:
        entries = info.agg(F.sum("pieces")).first()[0] or 0
        buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-16 * entries // BUCKET_BYTES))
    met = keep(_shared(_dealt(docs, buckets, percent)), "sketch-met")
    need = info.where("node IS NOT NULL").groupBy("node").agg(F.first("need").alias("need"))
    groups = keep(_enough(met, need), "sketch-groups")
    drop(met)
    node = info.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("at"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    node = keep(node.select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.t").alias("t"), "n", "sketch").join(groups.select("node").distinct(), "node", "left_semi"), "sketch-nodes")

    # A star for each group, around the member that meets others most often.
    light = node.select("node", "n", "sketch")
    stars = keep(_possible(groups.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), light, percent), "sketch-stars")
    texts = _texts(docs, node, stars)
    links = keep(_verified(stars, texts, percent), "sketch-links")
    drop(texts)
    drop(stars)
    root = keep(components(links), "sketch-roots")

    # What the stars leave apart: pairs of a group whose members have different roots.
    pairs = keep(_near(_apart(groups, root).join(light, "node"), percent), "sketch-pairs")
    drop(groups)
    if pairs.limit(1).count():
        texts = _texts(docs, node, pairs)
        links = links.unionByName(keep(_verified(pairs, texts, percent), "sketch-more"))
        drop(texts)
        root = keep(components(links), "sketch-roots")
    drop(pairs)
    drop(node)

    rooted = info.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", "t", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "root")


def _possible(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and short sketches allow a link: the Hamming distance bounds the symmetric difference from below."""
    x, y = light.alias("x"), light.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    budget = F.floor((F.col("x.n") + F.col("y.n")) * (100 - percent) / (100 + percent))
    both = both.where(F.abs(F.col("x.n") - F.col("y.n")) <= budget).select("a", "b", budget.alias("budget"), F.col("x.sketch").alias("p"), F.col("y.sketch").alias("q"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("p", "q", "budget")), strict=True)
            ok = pa.array([bool(np.bitwise_count(folded(p, least) ^ folded(q, least)).sum() <= budget) for p, q, budget in rows if (least := min(len(p), len(q)))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    return both.mapInArrow(close, "a long, b long")


def op3_sketch_join(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_components(docs).select("doc_id", "n_shingles", "component_id")


OP3_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(list_slice(w, i, i + 4)))) WHEN len(w) > 0 THEN [hash(w)] ELSE CAST([] AS UBIGINT[]) END AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM s),
g AS (SELECT n, s, row_number() OVER () AS g FROM (SELECT DISTINCT n, s FROM c WHERE n > 0)),
t AS (SELECT g, n, unnest(s) AS x FROM g),
i AS (SELECT a.g AS a, b.g AS b FROM t a JOIN t b ON a.x = b.x AND a.g < b.g AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
d AS (SELECT c.doc_id, c.n, g.g FROM c LEFT JOIN g ON c.n = g.n AND c.s = g.s),
e AS (SELECT a, b FROM i UNION ALL SELECT b, a FROM i),
r AS (WITH RECURSIVE r(x, y) AS (SELECT g, g FROM g UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x, y FROM r),
m AS (SELECT r.x AS g, min(d.doc_id) AS component_id FROM r JOIN d ON d.g = r.y GROUP BY r.x)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id FROM d LEFT JOIN m ON d.g = m.g
"""


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with its least id; of rows of one id and text the one whose other columns come first as JSON.

    Rows without words, null texts too, are alone: each different one stays. An empty table gives an empty one."""
    keyed = docs.withColumn("__t", F.xxhash64("text"))
    found = similar_components(docs.select("doc_id", "text"))
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("at"))
    alone = found.where("n_shingles = 0").select("doc_id", "t")
    stay = first.select("at.doc_id", "at.t").unionByName(alone).distinct().alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.__t") == F.col("s.t"))
    kept = keyed.alias("d").join(stay, same, "left_semi")
    rest = F.to_json(F.struct(F.lit(1), *(c for c in docs.columns if c not in ("doc_id", "text"))))
    return kept.groupBy("doc_id", "__t").agg(F.min_by(F.struct(*docs.columns), rest).alias("row")).select("row.*")
