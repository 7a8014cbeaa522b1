"""Merkle manifest of a dataset, with every leaf's authentication path.

A row's leaf is the SHA-256 of its fields. Per group (such as a source) the leaves in ascending id order make a tree of runs of
ARITY nodes; the groups' roots in ascending order make the tree above them.

1. Leaves are range-partitioned by group and id, staged, and numbered by prefix sums over a row per file and group, so a group with
   a third of all rows is many tasks' work.
2. A group's leaves are cut into aligned blocks of ARITY ** LEVELS. A task makes a block's root; the block roots are the leaves of
   the next tier, until each group has one node. The groups' roots go through the same tiers.
3. From the top down each block gets the path of its root, which all its leaves share. A task then traverses the block leaf by
   leaf: for each level it holds the current run, and a treehash stack makes the next run from one leaf ahead per step, so paths
   take memory that grows with the logarithm of the block. The shared upper path follows each leaf's own.

Defined cases: null fields count as `-`, unlike empty ones; a null group comes before all others; rows with a null id come first, and rows
that repeat an id are ordered by their leaves; a group of one row has its leaf as root, and the only group's root is the root of
all; other columns do nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, staged, table

ARITY = 16
#: Levels of a tree that a block has.
LEVELS = 2
BLOCK = ARITY**LEVELS
PATH = "path array<struct<at int, run array<binary>>>, subroot binary, root binary"


def parent(run: Sequence[bytes]) -> bytes:
    """The digest, as hex text, of a run of digests as hex text."""
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


def height(total: int) -> int:
    """Levels from the leaves of a tree, or of a block of it, to the node above them all."""
    return LEVELS if total > BLOCK else next(h for h in range(LEVELS + 1) if ARITY**h >= total)


class Treehash:
    """Makes the nodes of one level from leaves in order. It holds an open run of each level below and nothing else."""

    def __init__(self, level: int) -> None:
        self.open: list[list[bytes]] = [[] for _ in range(level)]
        self.nodes: list[bytes] = []

    def push(self, node: bytes, level: int = 0) -> None:
        while level < len(self.open):
            self.open[level].append(node)
            if len(self.open[level]) < ARITY:
                return
            node, self.open[level] = parent(self.open[level]), []
            level += 1
        self.nodes.append(node)

    def close(self) -> None:
        """After the last leaf: open runs, even of one node, become nodes."""
        for level, run in enumerate(self.open):
            if run:
                self.open[level] = []
                self.push(parent(run), level + 1)


class Traversal:
    """Authentication paths of a block's leaves, one after the other."""

    def __init__(self, leaves: Sequence[bytes], levels: int) -> None:
        self.leaves, self.at = leaves, 0
        self.spans = [ARITY ** (h + 1) for h in range(levels)]
        self.runs: list[list[bytes]] = []
        for h, span in enumerate(self.spans):
            first = Treehash(h)
            for leaf in leaves[:span]:
                first.push(leaf)
            if span >= len(leaves):
                first.close()
            self.runs.append(first.nodes)
        self.ahead = [Treehash(h) for h in range(levels)]

    def path(self) -> list[tuple[int, list[bytes]]]:
        """Of the current leaf: its place in a run and the run, level by level."""
        return [(self.at // (span // ARITY) % ARITY, run) for span, run in zip(self.spans, self.runs, strict=True)]

    def advance(self) -> None:
        """To the next leaf. Each level's stack takes the leaf one run ahead, so that the next run is ready when this one ends."""
        for h, span in enumerate(self.spans):
            ahead = self.at + span
            if ahead < len(self.leaves):
                self.ahead[h].push(self.leaves[ahead])
                if ahead == len(self.leaves) - 1:
                    self.ahead[h].close()
            if (self.at + 1) % span == 0:
                self.runs[h], self.ahead[h] = self.ahead[h].nodes, Treehash(h)
        self.at += 1


def siblings(path: Sequence[tuple[int, Sequence[bytes]]]) -> bytes:
    return b"".join(node for at, run in path for k, node in enumerate(run) if k != at)


def fold(node: bytes, path: Sequence[tuple[int, Sequence[bytes]]]) -> bytes:
    """The root that a node and its path give."""
    for at, run in path:
        node = parent([*run[:at], node, *run[at + 1 :]])
    return node


def _hex(digests: pa.ChunkedArray) -> list[bytes | None]:
    return [None if x is None else x.hex().encode() for x in digests.to_pylist()]


def _raw(digest: bytes) -> bytes:
    return bytes.fromhex(digest.decode())


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    """SHA-256, as 32 bytes, of a row's fields."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with a column tree, not null) with rank, from 0 in that order within the tree, and total, the tree's rows."""
    by = ["tree", *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    held = staged(placed, "merkle-leaves")
    parts = held.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", (before - F.col("first")).alias("base"), F.sum("n").over(tree).alias("total"))
    return held.join(parts, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("base")).drop("part", "at", "base")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"rank div {BLOCK}"))


def block_roots(nodes: DataFrame) -> DataFrame:
    """A node per block (tree, rank, total, node): the leaves of the next tier."""

    def of(block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        total = block["total"][0].as_py()
        made = Treehash(height(total))
        for leaf in _hex(block["node"]):
            made.push(leaf)
        made.close()
        return pa.table({"tree": block["tree"][:1], "rank": block["block"][:1], "total": pa.array([-(-total // BLOCK)], pa.int64()), "node": [_raw(made.nodes[0])]})

    return _blocks(nodes.select("tree", "rank", "total", "node")).groupBy("tree", "block").applyInArrow(of, "tree string, rank long, total long, node binary")


def tiers(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tiers of nodes, the lowest first, and of each the trees whose root it has made (tree, node)."""
    levels, roots = [], []
    while True:
        levels.append(nodes)
        up = staged(block_roots(nodes), "merkle-nodes")
        roots.append(up.where("total = 1").select("tree", "node"))
        nodes = up.where("total > 1")
        if nodes.isEmpty():
            return levels, roots


def _upper(row: dict) -> list[tuple[int, list[bytes]]]:
    return [(step["at"], [x.hex().encode() for x in step["run"]]) for step in row["path"]]


def paths(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The path of each node: tree, rank, name, path, subroot, root. parents: the same of each block (tree, block, path, subroot, root)."""

    def of(block: pa.Table, above: pa.Table) -> pa.Table:
        block, shared = block.sort_by("rank"), above.to_pylist()[0]
        upper, walk, found = _upper(shared), Traversal(_hex(block["node"]), height(block["total"][0].as_py())), []
        for _ in range(len(block)):
            found.append([{"at": at, "run": list(map(_raw, run))} for at, run in [*walk.path(), *upper]])
            walk.advance()
        kind = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.binary()))]))
        return pa.table({"tree": block["tree"], "rank": block["rank"], "name": block["name"], "path": pa.array(found, kind), "subroot": pa.array([shared["subroot"]] * len(block), pa.binary()), "root": pa.array([shared["root"]] * len(block), pa.binary())})

    return _blocks(nodes.select("tree", "rank", "total", "node", "name")).groupBy("tree", "block").cogroup(parents.groupBy("tree", "block")).applyInArrow(of, f"tree string, rank long, name string, {PATH}")


def proofs(leaves: DataFrame, parents: DataFrame, with_paths: bool = False) -> DataFrame:
    """Each leaf's id, digests and proof. leaves: tree, rank, total, id, node, other (a digest to be folded in its place, or null)."""
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", path array<array<string>>" * with_paths

    def of(block: pa.Table, above: pa.Table) -> pa.Table:
        block, shared = block.sort_by("rank"), above.to_pylist()[0]
        upper, nodes = _upper(shared), _hex(block["node"])
        rest = siblings(upper)
        walk, proof, folded, levels = Traversal(nodes, height(block["total"][0].as_py())), [], [], []
        for node, other in zip(nodes, _hex(block["other"]), strict=True):
            own = walk.path()
            proof.append(hashlib.sha256(siblings(own) + rest).hexdigest())
            folded.append(fold(other or node, [*own, *upper]).decode())
            if with_paths:
                levels.append([[x.decode() for k, x in enumerate(run) if k != at] for at, run in [*own, *upper]])
            walk.advance()
        n = len(block)
        out = {"id": block["id"], "leaf": [x.decode() for x in nodes], "subroot": [shared["subroot"].hex()] * n, "root": [shared["root"].hex()] * n, "proof_sha256": proof, "folded_root": folded}
        return pa.table(out | ({"path": pa.array(levels, pa.list_(pa.list_(pa.string())))} if with_paths else {}))

    return _blocks(leaves.select("tree", "rank", "total", "id", "node", "other")).groupBy("tree", "block").cogroup(parents.groupBy("tree", "block")).applyInArrow(of, schema)


def _parents(levels: list[DataFrame], roots: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the blocks of the lowest tier. tops: tree, path, root of each tree's root."""
    above = None
    for k in reversed(range(len(levels))):
        ended = roots[k].join(tops, "tree").select("tree", F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"), "root")
        above = ended if above is None else ended.unionByName(above)
        if k:
            own = paths(levels[k].withColumn("name", F.lit(None).cast("string")), above)
            above = staged(own.select("tree", F.col("rank").alias("block"), "path", "subroot", "root"), "merkle-paths")
    return above


def manifest(rows: DataFrame, fields: list[Column], id_: Column, group: Column, other: list[Column] | None = None, where: Column | None = None, with_paths: bool = False) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256 (of the path's siblings, bottom to top and left to right), folded_root and, if asked for, path: the
    siblings level by level. Where `where` holds, folded_root is made from the leaf of the fields `other` instead, so it tells whether they differ."""
    tree = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))
    changed = F.when(where, digest(other)) if where is not None else F.lit(None).cast("binary")
    leaves = numbered(rows.select(tree.alias("tree"), id_.cast("long").alias("id"), digest(fields).alias("node"), changed.alias("other")), ["id", "node", "other"])
    levels, roots = tiers(leaves)
    groups = roots[0]
    for more in roots[1:]:
        groups = groups.unionByName(more)
    above = numbered(groups.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"])
    upper, top = tiers(above)
    root = top[-1].select("tree", F.array().cast("array<struct<at int, run array<binary>>>").alias("path"), F.col("node").alias("root"))
    named = staged(paths(above, _parents(upper, top, root)), "merkle-groups")
    return proofs(leaves, _parents(levels, roots, named.select(F.col("name").alias("tree"), "path", "root")), with_paths)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    found = manifest(docs, [*first, F.col("text")], F.col("doc_id"), F.col("source"), [*first, ascii_lower(F.col("text"))], tampered)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 is bits of the decimal id in turn; trees grow level by level, and folds go up one step of a path at a time.
OP11_SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, concat_ws('',
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * length(doc_id::VARCHAR)), lambda k: CASE WHEN k % 8 = 0 THEN ascii((doc_id::VARCHAR)[k // 8 + 1]) ELSE 0 END::BIGINT)),
      lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295) AS crc
  FROM documents),
leaves AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS other, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS rank FROM raw),
lower_nodes AS (
  SELECT tree, 0 AS level, rank AS i, leaf AS node FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM lower_nodes) WHERE n > 1 GROUP BY tree, level, i // 16),
subroots AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank FROM (SELECT * FROM lower_nodes QUALIFY level = max(level) OVER (PARTITION BY tree))),
upper_nodes AS (
  SELECT 0 AS level, rank AS i, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM upper_nodes) WHERE n > 1 GROUP BY level, i // 16),
root AS (SELECT node AS root FROM upper_nodes ORDER BY level DESC LIMIT 1),
lower_runs AS (SELECT tree, level, i // 16 AS run, list(node ORDER BY i) AS nodes FROM (SELECT *, count(*) OVER (PARTITION BY tree, level) AS n FROM lower_nodes) WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, i // 16 AS run, list(node ORDER BY i) AS nodes FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM upper_nodes) WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT doc_id, level AS step, (rank // (16 ** level)::BIGINT) % 16 AS place, nodes FROM leaves JOIN lower_runs USING (tree) WHERE run = rank // (16 ** (level + 1))::BIGINT
  UNION ALL
  SELECT doc_id, 1000 + level, (s.rank // (16 ** level)::BIGINT) % 16, nodes FROM leaves l JOIN subroots s USING (tree) CROSS JOIN upper_runs WHERE run = s.rank // (16 ** (level + 1))::BIGINT),
ordered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS step, list_slice(nodes, 1, place) AS before, list_slice(nodes, place + 2, len(nodes)) AS after FROM steps),
folds AS (
  SELECT doc_id, 0 AS step, coalesce(other, leaf) AS node FROM leaves
  UNION ALL
  SELECT doc_id, o.step, sha256(array_to_string(o.before, '') || f.node || array_to_string(o.after, '')) FROM folds f JOIN ordered o USING (doc_id) WHERE o.step = f.step + 1),
proofs AS (SELECT doc_id, string_agg(array_to_string(before, '') || array_to_string(after, ''), '' ORDER BY step) AS proof FROM ordered GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = root.root AS verified
FROM leaves l JOIN subroots s USING (tree) CROSS JOIN root LEFT JOIN proofs p ON p.doc_id = l.doc_id
JOIN (SELECT * FROM folds QUALIFY step = max(step) OVER (PARTITION BY doc_id)) f ON f.doc_id = l.doc_id
"""
