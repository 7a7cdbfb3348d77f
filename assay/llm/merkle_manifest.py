"""Merkle manifest of a dataset: a node store on disk, level by level, and proofs by coordinate.

Leaves are numbered in sorted runs: rows are sorted by range, written, and a small table of each run's counts gives
every row its place in its tree. A node's coordinate is (tree, level, place). A pass reads one level in blocks of
2**LEVELS places that follow each other, folds each block upwards and writes its nodes to Parquet partitioned by
level; the next pass reads the highest of these levels only. Proofs are merge joins of the store's levels with the
leaves on the block's coordinate; the upper passes' part of a path is joined to a block and not to each of its leaves."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm._state import drop, keep, read, shared_dir

#: Levels that one pass folds; a block has 2**LEVELS nodes at most, of 64 bytes.
LEVELS = 10
#: Fields of a leaf in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<d:string,left:boolean>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` of null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**instead: Column) -> Column:
    """Digest of a row's FIELDS; `instead` gives other values of some."""
    return digest(*(field(instead.get(c, F.col(c))) for c in FIELDS))


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    up = lambda d, s: F.sha2(F.when(s["left"], F.concat(s["d"], d)).otherwise(F.concat(d, F.coalesce(s["d"], F.lit("")))), 256)
    return F.aggregate(path, start, up)


def proof_digest(path: Column) -> Column:
    """Digest of the siblings that are there, from the leaf's level upwards."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.coalesce(s["d"], F.lit(""))), ""), 256)


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """rows with pos, the place in its tree by `order`, and n, the tree's size. Sorted by range, so that a tree of any size is many tasks'.

    Nothing but a count for each run and tree is gathered; both tables meet by a join that adaptive execution may broadcast."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    runs = keep(runs.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)), name)
    counts = runs.groupBy("run", tree).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(tree).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("run", tree, "first", before.alias("before"), F.sum("c").over(Window.partitionBy(tree)).alias("n"))
    return runs.join(counts, ["run", tree]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("run", "at", "first", "before")


def _pairs(nodes: Column) -> Column:
    """The level above some nodes that follow each other."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) + 1, 1) - 1), lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _blocks(nodes: DataFrame) -> DataFrame:
    """tree, block, n, l0, l1, ...: the nodes (tree, pos, n, d) of each block and the levels folded from them; null above the root."""
    rows = nodes.withColumn("block", F.shiftright("pos", LEVELS)).groupBy("tree", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "d"))).alias("x"))
    rows = rows.withColumn("l0", F.transform("x", lambda s: s["d"])).withColumn("steps", _steps(F.col("n"))).drop("x")
    for k in range(LEVELS):
        rows = rows.withColumn(f"l{k + 1}", F.when(F.col("steps") > k, _pairs(F.col(f"l{k}"))))
    return rows.drop("steps")


def _steps(n: Column) -> Column:
    """Levels above a node within its pass, of a tree of n nodes at the pass's lowest level."""
    return F.least(F.lit(LEVELS), F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0))


@dataclass
class Store:
    """Node store of one pass: tree, block, n, nodes (digests in order of place), level (the Parquet partition)."""

    nodes: DataFrame
    above: Store | None = None

    def drop(self) -> None:
        drop(self.nodes)
        if self.above:
            self.above.drop()

    def lowest(self) -> DataFrame:
        """tree, pos, n, d of the nodes that the pass ends with."""
        top = self.nodes.where(F.col("level") == F.least(F.lit(LEVELS), _steps(F.col("n"))))
        return top.select("tree", F.col("block").alias("pos"), F.shiftright(F.col("n") + (1 << LEVELS) - 1, LEVELS).alias("n"), F.get("nodes", 0).alias("d"))

    def roots(self) -> DataFrame:
        """tree, d."""
        return self.above.roots().unionByName(self.lowest().where("n = 1").select("tree", "d")) if self.above else self.lowest().select("tree", "d")

    def paths(self) -> DataFrame:
        """tree, block, n, levels (digests of each level of the block), up (the path from the block's own root on)."""
        rows = self.nodes.groupBy("tree", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("level", "nodes"))).alias("x"))
        rows = rows.withColumn("levels", F.transform("x", lambda s: s["nodes"])).drop("x")
        if not self.above:
            return rows.withColumn("up", F.array().cast(f"array<{STEP}>"))
        above = _exploded(self.above.paths()).select("tree", F.col("pos").alias("block"), F.col("path").alias("up"))
        return rows.join(above, ["tree", "block"], "left").withColumn("up", F.coalesce("up", F.array().cast(f"array<{STEP}>")))


def path_of(i: Column) -> Column:
    """Path of the i-th node of a row of Store.paths(): sibling and whether it stands left, for each level up to the root."""
    side = F.sequence(F.lit(0), F.size("levels") - 2)
    bit = lambda k: F.call_function("shiftright", i, k)
    own = F.transform(side, lambda k: F.struct(F.get(F.get(F.col("levels"), k), bit(k).bitwiseXOR(F.lit(1))).alias("d"), (bit(k) % 2 == 1).alias("left")))
    return F.concat(F.when(F.size("levels") > 1, own).otherwise(F.array().cast(f"array<{STEP}>")), F.col("up"))


def _exploded(paths: DataFrame) -> DataFrame:
    """tree, pos, path of each lowest node."""
    rows = paths.withColumn("i", F.explode(F.sequence(F.lit(0), F.size(F.get("levels", 0)) - 1)))
    return rows.select("tree", (F.col("block") * (1 << LEVELS) + F.col("i")).alias("pos"), path_of(F.col("i")).alias("path"))


def build(nodes: DataFrame, name: str) -> Store:
    """Store of the trees over nodes: tree, pos, n, d. As many passes as the largest tree has multiples of LEVELS levels."""
    spark = nodes.sparkSession
    wide = _blocks(nodes)
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"l{k}").alias("nodes")) for k in range(LEVELS + 1)))
    long = wide.select("tree", "block", "n", F.explode(F.filter(levels, lambda s: s["nodes"].isNotNull())).alias("s")).select("tree", "block", "n", "s.nodes", "s.level")
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    long.write.partitionBy("level").parquet(path)
    store = Store(spark.read.schema(long.schema).parquet(path))
    rest = store.lowest().where("n > 1")
    return Store(store.nodes, build(rest, f"{name}-above")) if rest.limit(1).count() else store


@dataclass
class Manifest:
    """leaves: tree (a key of lang), pos, n, leaf, changed (a leaf to check, or null), doc_id. subroots: tree, subroot, up (its path to the root), root."""

    leaves: DataFrame
    store: Store
    subroots: DataFrame

    def proofs(self) -> DataFrame:
        """tree, pos, doc_id, leaf, changed, subroot, root, path: siblings from the leaf's level to the root, left to right.

        The leaves of a block are one row until the end, so paths are no part of a shuffle."""
        own = self.leaves.groupBy("tree", F.shiftright("pos", LEVELS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "changed"))).alias("own"))
        rows = own.join(self.store.paths(), ["tree", "block"]).withColumn("s", F.explode("own"))
        rows = rows.select("tree", "s.*", path_of((F.col("s.pos") % (1 << LEVELS)).cast("int")).alias("path"))
        tops = self.subroots.select("tree", "subroot", F.col("up").alias("over"), "root")
        return rows.join(tops, "tree").withColumn("path", F.concat("path", "over")).drop("over")


def manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """Merkle manifest of docs (doc_id, source, lang, n_chars, text; other columns don't count).

    Leaves of a lang (null is a lang of its own, before all others) ascend by doc_id, null first, rows of one id by
    their digest. Nodes are paired to the root of each lang (one without a neighbour is hashed alone), and these
    roots, by lang as UTF-8 bytes, likewise to one root. A lone leaf is its own root. Null fields count as `-`, an empty text as
    `0:`; repeated rows are leaves of their own. An empty table has no leaf and no root. `changed` is a
    leaf to be checked beside each row's own (null: none).
    The table of subroots has a row for each lang; it is joined by its size."""
    tree = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang")))
    hashed = keep(docs.select("doc_id", tree.alias("tree"), leaf().alias("leaf"), (F.lit(None).cast("string") if changed is None else changed).alias("changed")), "merkle-leaves")
    leaves = keep(numbered(hashed, "tree", ["doc_id", "leaf"], "merkle-runs"), "merkle-places")
    drop(hashed)
    store = build(leaves.select("tree", "pos", "n", F.col("leaf").alias("d")), "merkle-store")
    roots = keep(store.roots().select(F.lit("").alias("all"), "tree", "d"), "merkle-roots")
    placed = numbered(roots, "all", ["tree"], "merkle-root-runs").select(F.col("all").alias("tree"), "pos", "n", "d", F.col("tree").alias("lang"))
    placed = keep(placed, "merkle-root-places")
    top = build(placed.drop("lang"), "merkle-top")
    up = _exploded(top.paths()).join(placed.select("tree", "pos", F.col("lang").alias("of"), F.col("d").alias("subroot")), ["tree", "pos"]).join(top.roots().select("tree", F.col("d").alias("root")), "tree")
    return Manifest(leaves, store, keep(up.select(F.col("of").alias("tree"), "subroot", F.col("path").alias("up"), "root"), "merkle-subroots"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Every leaf with its proof; rows whose id's CRC-32 seven divides are checked with n_chars one higher."""
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest(docs, F.when(tampered, leaf(n_chars=F.col("n_chars") + 1)))
    rows = made.proofs().withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.col("path"), F.coalesce("changed", "leaf"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR) END"


_SQL_LEAF = "sha256({} || {} || {} || {} || {})"
_SQL_UP = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
_SQL_STEP = "CASE WHEN (pos >> level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(pos >> level, 1) + 1], '')"
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT doc_id, lang, {_SQL_LEAF.format(*map(_sql_field, FIELDS))} AS leaf,
  CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1])), 4294967295) % 7 = 0
  THEN {_SQL_LEAF.format(*(_sql_field('n_chars + 1' if f == 'n_chars' else f) for f in FIELDS))} END AS changed FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS r FROM d),
v AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang UNION ALL SELECT lang, level + 1, {_SQL_UP} FROM v WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM v WHERE len(nodes) = 1),
w AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM s UNION ALL SELECT level + 1, {_SQL_UP} FROM w WHERE len(nodes) > 1),
u AS (SELECT s.lang, any_value(subroot) AS subroot, coalesce(list({_SQL_STEP} ORDER BY level) FILTER (WHERE len(nodes) > 1), []) AS up, max(nodes[1]) FILTER (WHERE len(nodes) = 1) AS root FROM s, w GROUP BY s.lang),
b AS (SELECT r, any_value(p.lang) AS lang, coalesce(list({_SQL_STEP} ORDER BY level) FILTER (WHERE len(nodes) > 1), []) AS own FROM p JOIN v ON p.lang IS NOT DISTINCT FROM v.lang GROUP BY r),
a AS (SELECT p.doc_id, p.leaf, p.changed, subroot, root, list_concat(own, up) AS path FROM p JOIN b USING (r) JOIN u ON b.lang IS NOT DISTINCT FROM u.lang),
f AS (SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), path), lambda x, y: CASE WHEN y[1] = 'L' THEN sha256(y[2:] || x) ELSE sha256(x || y[2:]) END) AS folded_root FROM a)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
