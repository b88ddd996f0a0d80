"""Merkle manifest of a table in a van Emde Boas layout.

Rows are the leaves of one ternary tree per group, in the order of their keys; the groups' roots are the leaves of a top tree. A tree is
cut into aligned blocks of ``HEIGHT`` levels: of height six, leaves 729 b to 729 b + 728 form block b, whose root is leaf b of the next level of
blocks, and so on to one root. A block is stored as one binary value in which its own levels are split recursively at half height, the top part
first and then the parts below it from left to right; ``address`` computes where a node lies, so construction and the
retrieval of siblings need no pointers and touch few lines of memory whatever their size.

A group of any size is spread over its blocks, never one task. Leaves are placed by a range partitioning on (group, key).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import slices, small_side
from cadenza.session import materialize

ARITY = 3
HEIGHT = 6  # levels of edges in a block: 729 leaves, 1093 nodes
DIGEST = 32


def nodes(levels: int) -> int:
    """Nodes of a full tree with so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Place of the nodes ``index`` at ``depth`` (0: the root) in the layout of a full tree of ``levels`` levels."""
    index = np.asarray(index, np.int64)
    base = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth -= top
        part, index = np.divmod(index, ARITY**depth)
        base = base + nodes(top) + part * nodes(levels - top)
        levels -= top
    return base


@cache
def _addresses(levels: int) -> list[np.ndarray]:
    return [address(d, np.arange(ARITY**d), levels) for d in range(levels)]


def levels_above(n: int, height: int) -> int:
    """Steps from n nodes to one, at most a block's height."""
    k = 0
    while n > 1 and k < height:
        n, k = -(-n // ARITY), k + 1
    return k


def sha(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def build(leaves: Sequence[bytes], steps: int) -> bytes:
    """The layout of a block: ``steps`` levels of edges above its leaves; places without a node are zero."""
    places = _addresses(steps + 1)
    out = bytearray(DIGEST * nodes(steps + 1))
    row = [d.hex() for d in leaves]
    for depth in range(steps, -1, -1):
        for p, h in zip(places[depth].tolist(), row):
            out[DIGEST * p : DIGEST * p + DIGEST] = bytes.fromhex(h)
        row = [sha(*row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
    return bytes(out)


def node(tree: bytes, steps: int, depth: int, i: int) -> bytes:
    p = int(_addresses(steps + 1)[depth][i])
    return tree[DIGEST * p : DIGEST * p + DIGEST]


def siblings(tree: bytes, steps: int, n: int) -> list[list[tuple[str, str]]]:
    """For each of the n leaves of a block, from the leaf up: the digests left and right of the node in its run, joined."""
    widths = [n]
    for _ in range(steps):
        widths.append(-(-widths[-1] // ARITY))
    per_level = []
    for up in range(steps):
        w, depth = widths[up], steps - up
        row = [tree[DIGEST * p : DIGEST * p + DIGEST].hex() for p in _addresses(steps + 1)[depth][:w].tolist()]
        per_level.append([("".join(row[i - i % ARITY : i]), "".join(row[i + 1 : i - i % ARITY + ARITY])) for i in range(w)])
    return [[per_level[up][i // ARITY**up] for up in range(steps)] for i in range(n)]


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its path give."""
    for left, right in path:
        leaf = sha(left, leaf, right)
    return leaf


_STEP = pa.struct([("l", pa.string()), ("r", pa.string())])
_PATH = "array<struct<l:string,r:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of the values: ``-`` for null, else UTF-8 byte count, colon, value."""

    def one(c: Column) -> Column:
        v = c.cast("string")
        return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))

    return F.sha2(F.concat(*[one(c) for c in columns]).cast("binary"), 256)


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_pos``, gapless from 0 in each group by ``order``, and (group, ``_n``) counts.

    Rows are dealt by ranges of (group, order) and numbered where they lie; what goes round is one count per range and group.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 200_000))
    dealt = materialize(rows.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    counts = materialize(dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_c")))
    # one row per range and group, and a range has few groups unless groups are small
    before = F.sum("_c").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    start = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part", group).orderBy(*keys[1:])) - 1
    j = dealt.withColumn("_own", own)
    j = j.join(small_side(start), (j["_part"] == F.col("_p")) & j[group].eqNullSafe(F.col("_g")))
    out = j.withColumn("_pos", (F.col("_start") + F.col("_own")).cast("long")).select(*rows.columns, "_pos")
    return out, counts.groupBy(group).agg(F.sum("_c").cast("long").alias("_n"))


@dataclass(frozen=True)
class Forest:
    """Levels of blocks of one tree per group, leaves first: (group, block, steps, n, tree and, at the leaves, rows)."""

    levels: list[DataFrame]
    roots: DataFrame  # (group, root)
    leaves: int  # most leaves of a block


def _blocks(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            steps, trees, roots = [], [], []
            for of, rows in zip(b.column("_n").to_pylist(), b.column("rows").to_pylist()):
                k = levels_above(of, height)
                t = build([r["digest"] for r in rows], k)
                steps.append(k)
                trees.append(t)
                roots.append(node(t, k, 0, 0))
            more = {"steps": pa.array(steps, pa.int32()), "tree": pa.array(trees, pa.binary()), "root": pa.array(roots, pa.binary())}
            yield pa.RecordBatch.from_arrays([*b.columns, *more.values()], [*b.schema.names, *more])

    return run


def forest(leaves: DataFrame, counts: DataFrame, group: str, payload: Sequence[str] = (), height: int = HEIGHT) -> Forest:
    """Trees over (group, ``_pos``, digest); ``payload`` columns stay beside their leaf in the blocks of the first level."""
    kind = leaves.schema[group].dataType.simpleString()
    levels, most = [], ARITY**height
    counts = materialize(counts)
    while True:
        one = F.struct("_pos", "digest", *payload)
        g = leaves.groupBy(group, F.floor(F.col("_pos") / most).cast("long").alias("_block")).agg(F.sort_array(F.collect_list(one)).alias("rows"))
        c = small_side(counts.select(F.col(group).alias("_g"), "_n"))
        j = g.join(c, g[group].eqNullSafe(F.col("_g"))).select(g[group].alias("_g"), "_block", "_n", "rows")
        inner = g.schema["rows"].dataType.simpleString()
        made = j.mapInArrow(_blocks(height), f"_g {kind}, _block long, _n long, rows {inner}, steps int, tree binary, root binary")
        levels.append(materialize(made))
        if counts.filter(F.col("_n") > most).isEmpty():
            break
        # blocks of groups that are not one block yet are the leaves of the next level
        up = levels[-1].filter(F.col("_n") > most)
        leaves = up.select(F.col("_g").alias(group), F.col("_block").alias("_pos"), F.col("root").alias("digest"))
        counts = materialize(counts.filter(F.col("_n") > most).select(group, F.ceil(F.col("_n") / most).cast("long").alias("_n")))
        payload = ()
    tops = [t.filter(F.col("_n") <= most).select(F.col("_g").alias(group), "root") for t in levels]
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return Forest(levels, roots, most)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the path of their root -> their leaves with whole paths; the other columns of a leaf follow."""
    for b in slices(batches, 8):
        at, leaf, paths, rows, repeat = [], [], [], [], []
        given = b.column("path").to_pylist()
        for i, (steps, tree, block) in enumerate(zip(b.column("steps").to_pylist(), b.column("tree").to_pylist(), b.column("rows").to_pylist())):
            above = [(s["l"], s["r"]) for s in given[i]]
            for r, own in zip(block, siblings(tree, steps, len(block))):
                at.append(r["_pos"])
                leaf.append(r["digest"])
                paths.append([{"l": x, "r": y} for x, y in (*own, *above)])
                rows.append(r)
                repeat.append(i)
        take = pa.array(repeat, pa.int32())
        rest = [b.column("rows").type.value_type.field(i) for i in range(b.column("rows").type.value_type.num_fields)][2:]
        cols = {"_g": b.column("_g").take(take), "_pos": pa.array(at, pa.int64()), "digest": pa.array(leaf, pa.binary()), "path": pa.array(paths, pa.list_(_STEP))}
        cols |= {f.name: pa.array([r[f.name] for r in rows], f.type) for f in rest}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _leaf_columns(level: DataFrame) -> str:
    row = level.schema["rows"].dataType.elementType
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in row.fields[2:])
    return f"_g {level.schema['_g'].dataType.simpleString()}, _pos long, digest binary, path {_PATH}{more}"


def _with_paths(f: Forest, above: DataFrame) -> DataFrame:
    """Blocks of the first level with the path from their root to the end of ``above`` (group ``_g``, path) and its other columns.

    Top down: the paths of a level's blocks come from the blocks above them, one row per block.
    """
    extra = [c for c in above.columns if c not in ("_g", "path")]
    known = None
    for i in range(len(f.levels) - 1, -1, -1):
        level = f.levels[i]
        ends = level.filter(F.col("_n") <= f.leaves)
        a = small_side(above.select(F.col("_g").alias("_ag"), "path", *extra))
        here = ends.join(a, ends["_g"].eqNullSafe(F.col("_ag"))).drop("_ag")
        if known is not None:
            b = level.filter(F.col("_n") > f.leaves)
            k = known.select(F.col("_g").alias("_kg"), F.col("_pos").alias("_kp"), "path")
            k = k.join(small_side(above.select(F.col("_g").alias("_ag"), *extra)), F.col("_kg").eqNullSafe(F.col("_ag"))).drop("_ag")
            here = here.unionByName(b.join(k, (b["_block"] == F.col("_kp")) & b["_g"].eqNullSafe(F.col("_kg"))).select(*here.columns))
        if i == 0:
            return here
        known = materialize(here.drop(*extra).mapInArrow(_walk, _leaf_columns(level)).select("_g", "_pos", "path"))
    raise AssertionError


@dataclass(frozen=True)
class Manifest:
    """Blocks of the groups' trees and of the tree over their roots."""

    groups: Forest
    top: Forest
    top_leaves: DataFrame  # (_sub, _pos): groups in the order of the top tree

    def root(self) -> str | None:
        """Hex root of the whole table; None when it has no rows."""
        r = self.top.roots.first()
        return None if r is None else bytes(r["root"]).hex()


def manifest(leaves: DataFrame, *, group: str, order: Sequence[str], digest: str = "digest", payload: Sequence[str] = (), height: int = HEIGHT) -> Manifest:
    """Trees over rows of (group, order columns, binary digest).

    Within a group rows ascend by ``order`` (nulls first), then by digest; groups ascend bytewise, null first. Rows that are equal in all of
    these are leaves of their own. An empty table has no root.
    """
    rows = materialize(leaves.select(F.col(group).alias("_grp"), F.col(digest).alias("digest"), *[F.col(c) for c in dict.fromkeys([*order, *payload])]))
    at, counts = placed(rows, "_grp", [*order, "digest"])
    groups = forest(at, counts, "_grp", payload, height)
    subs = materialize(groups.roots.select(F.lit(0).alias("_all"), F.col("_grp").alias("_sub"), F.col("root").alias("digest")))
    up, n = placed(subs, "_all", ["_sub"])
    up = materialize(up)
    return Manifest(groups, forest(up.select("_all", "_pos", "digest"), n, "_all", height=height), up.select("_sub", "_pos"))


def proofs(m: Manifest) -> DataFrame:
    """Blocks of the groups' trees with the path of their root up to the whole root, and the group's root (``subroot``, binary)."""
    spark = m.top_leaves.sparkSession
    start = spark.createDataFrame([(0, [])], f"_g int, path {_PATH}")
    top = _with_paths(m.top, start).mapInArrow(_walk, _leaf_columns(m.top.levels[0]))
    named = top.join(m.top_leaves, "_pos").select(F.col("_sub").alias("_g"), "path", F.col("digest").alias("subroot"))
    return _with_paths(m.groups, materialize(named))


def paths(m: Manifest) -> DataFrame:
    """(_g, _pos, digest, path, payload ...): every leaf with the siblings on its way to the root, from the leaf up."""
    blocks = proofs(m)
    return blocks.mapInArrow(_walk, _leaf_columns(blocks))


def _checked(root: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8):
            keys, leaf, sub, proof, folded = [], [], [], [], []
            given = b.column("path").to_pylist()
            for i, (steps, tree, rows, s) in enumerate(zip(*(b.column(c).to_pylist() for c in ("steps", "tree", "rows", "subroot")))):
                above = [(x["l"], x["r"]) for x in given[i]]
                tail, s = "".join(x + y for x, y in above), s.hex()
                for r, own in zip(rows, siblings(tree, steps, len(rows))):
                    mine = r["digest"].hex()
                    keys.append(r[key])
                    leaf.append(mine)
                    sub.append(s)
                    proof.append(sha(*(x + y for x, y in own), tail))
                    shown = mine if r["_shown"] is None else r["_shown"].hex()
                    folded.append(fold(fold(shown, own), above))
            out = [pa.array(keys, b.column("rows").type.value_type.field(key).type), *map(pa.array, (leaf, sub)), pa.array([root] * len(leaf), pa.string()), *map(pa.array, (proof, folded)), pa.array([x == root for x in folded], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, ["_key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def verify(df: DataFrame, *, key: str = "doc_id", group: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), shown: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row; other columns are not read.

    The manifest is made of the rows as they are. ``shown`` gives columns as a reader got them: ``folded_root`` is computed from such a
    leaf and the manifest's siblings, ``verified`` says whether it is the root. Null keys come first; rows with one key
    stand by their digests, equal rows are leaves of their own. An empty table gives an empty table.
    """
    cols = [F.col(c) for c in fields]
    seen = [(shown or {}).get(c, F.col(c)) for c in fields]
    leaf, other = leaf_digest(cols), leaf_digest(seen)
    rows = df.select(F.col(key).alias("_key"), F.col(group).alias("_group"), F.unhex(leaf).alias("_leaf"), F.unhex(other).alias("_other"))
    rows = rows.withColumn("_shown", F.when(F.col("_other") != F.col("_leaf"), F.col("_other")))
    m = manifest(rows, group="_group", order=["_key"], digest="_leaf", payload=["_key", "_shown"], height=height)
    root = m.root()
    kind = df.schema[key].dataType.simpleString()
    if root is None:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    out = proofs(m).mapInArrow(_checked(root, "_key"), f"_key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("_key", key)
