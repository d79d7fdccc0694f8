"""Merkle manifests: a tree of hashes over each part of a dataset, a tree over the parts' roots, and a proof for every row.

Leaves are cut into aligned blocks of 256. A block's authentication paths come one after the other from a fractal
traversal: a stack of existing subtrees, of two levels each, answers for the current leaf while below each of them the
desired one, next in line, grows by two steps of treehash a leaf. So a traversal holds a few dozen nodes of a block, never
its whole tree. The roots of the blocks are the leaves of the next level, where the same runs again, until one block holds
every tree; what stands above a block is then appended to the paths of its rows, level by level, by joins on (tree, block).

A node without a sibling is hashed alone. Rows of one tree ascend by their order columns (nulls first, then by the leaf's
digest, so that repeated rows have places of their own and equal results in any run). A null tree key is a tree like any
other. Empty tables give empty manifests; extra columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_BITS = 8  # levels of a block
SUBTREE = 2  # levels of a subtree of the traversal
DIGEST = 32
ALONE, LEFT, RIGHT = 0, 1, 2  # where the sibling stands at a level


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest (hex) of a row's values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


# --- the traversal of a block ----------------------------------------------------------------------------------------


def _parent(left: bytes | None, right: bytes | None) -> bytes | None:
    """Nodes are their digests in hex; None stands for a place behind the last leaf."""
    return None if left is None else hashlib.sha256(left + right if right else left).hexdigest().encode()


class Growing:
    """The subtree over one node of level `high`, grown by treehash from its leaves; nodes of levels low to high are kept."""

    def __init__(self, leaf_at: Callable[[int], bytes | None], node: int, low: int, high: int) -> None:
        self.leaf_at, self.low, self.high = leaf_at, low, high
        self.next, self.end = node << high, (node + 1) << high
        self.nodes: dict[tuple[int, int], bytes | None] = {}
        self._stack: list[tuple[int, int, bytes | None]] = []

    def step(self) -> bool:
        """One leaf read or one pair of nodes hashed; False once the subtree is whole."""
        stack = self._stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            level, index, right = stack.pop()
            left = stack.pop()[2]
            level, index, digest = level + 1, index >> 1, _parent(left, right)
        elif self.next < self.end:
            level, index, digest = 0, self.next, self.leaf_at(self.next)
            self.next += 1
        else:
            return False
        if self.low <= level <= self.high:
            self.nodes[level, index] = digest
        if level < self.high:
            stack.append((level, index, digest))
        return True

    def whole(self) -> Growing:
        while self.step():
            pass
        return self


def traversal(leaves: list[bytes], height: int, subtree: int = SUBTREE) -> Iterator[list[bytes | None]]:
    """For each leaf its siblings from the bottom up (None: no sibling), and at last [root]. Leaves and nodes are digests in hex."""
    at = lambda i: leaves[i] if i < len(leaves) else None
    bounds = [(low, min(low + subtree, height)) for low in range(0, height, subtree)]
    existing = [Growing(at, 0, low, high).whole() for low, high in bounds]
    desired = [Growing(at, 1, low, high) for low, high in bounds[:-1]]
    root = existing[-1].nodes[height, 0] if existing else leaves[0]
    for i in range(len(leaves)):
        yield [tree.nodes[level, (i >> level) ^ 1] for tree in existing for level in range(tree.low, tree.high)]
        for k, tree in enumerate(desired):
            tree.step()
            tree.step()
            if (i + 1) % (1 << tree.high) == 0:  # the current leaf leaves the existing subtree; the desired one is whole by now
                existing[k] = tree
                desired[k] = Growing(at, (tree.end >> tree.high), tree.low, tree.high)
    yield [root]


# --- levels of blocks -------------------------------------------------------------------------------------------------

_PROOF = "path binary, steps array<byte>, root binary"


def _traversed(nodes: DataFrame) -> DataFrame:
    """Adds path (the siblings, joined), steps (where each stands) and root (of the block) to rows of (tree, block, idx, total, leaf)."""
    kinds = {"path": pa.binary(), "steps": pa.list_(pa.int8()), "root": pa.binary()}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        leaves = [d.hex().encode() for d in table.column("leaf").to_pylist()]
        total, first = table.column("total")[0].as_py(), table.column("idx")[0].as_py()
        height = BLOCK_BITS if total > 1 << BLOCK_BITS else (total - 1).bit_length()
        paths, steps, root = [], [], b""
        for i, siblings in enumerate(traversal(leaves, height)):
            if i == len(leaves):
                root = bytes.fromhex(siblings[0].decode())
                break
            paths.append(bytes.fromhex(b"".join(s for s in siblings if s).decode()))
            steps.append([ALONE if s is None else RIGHT if (first + i) >> level & 1 == 0 else LEFT for level, s in enumerate(siblings)])
        for name, values in (("path", paths), ("steps", steps), ("root", [root] * len(leaves))):
            table = table.append_column(name, pa.array(values, kinds[name]))
        return table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.groupBy("tree", "block").applyInArrow(run, f"{schema}, {_PROOF}")


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx (the place within the tree, from 0) and total (leaves of the tree), from sorted ranges and their sizes."""
    keys, place = ["tree", *order, "leaf"], F.monotonically_increasing_id()
    ranged = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = common.stored(ranged.withColumns({"part": F.shiftright(place, 33), "place": place.bitwiseAND((1 << 33) - 1)}), "merkle-ranges")
    spans = ranged.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))  # a row for each range, and one more for each tree
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("tree").alias("own"), F.col("part").alias("own_part"), (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total"))
    met = ranged.join(spans, F.col("tree").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part")))
    return met.withColumn("idx", F.col("place") + F.col("shift")).drop("part", "place", "own", "own_part", "shift")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The traversed blocks of (tree, idx, total, leaf, ...) and of the levels of block roots above, until a block holds any tree."""
    levels: list[DataFrame] = []
    while True:
        rows = common.stored(_traversed(nodes.withColumn("block", F.shiftright("idx", BLOCK_BITS))), f"merkle-{len(levels)}")
        levels.append(rows)
        if (rows.agg(F.max("total")).first()[0] or 0) <= 1 << BLOCK_BITS:
            return levels
        above = rows.where(F.col("idx") % (1 << BLOCK_BITS) == 0)
        nodes = above.select("tree", F.col("block").alias("idx"), (F.shiftright(F.col("total") - 1, BLOCK_BITS) + 1).alias("total"), F.col("root").alias("leaf"))


def _raised(rows: DataFrame, above: DataFrame, key: str, at: str | None) -> DataFrame:
    """Appends the proof of what stands above a row: that of its block (key tree, at block) or of its tree."""
    upper = above.select(F.col(key).alias("up_key"), *([F.col("idx").alias("up_idx")] if at else []), F.col("path").alias("up_path"), F.col("steps").alias("up_steps"), F.col("root").alias("up_root"), *(c for c in above.columns if c == "subroot"))
    cond = F.col("tree").eqNullSafe(F.col("up_key"))
    met = rows.join(upper, cond & (F.col(at) == F.col("up_idx")) if at else cond)
    out = met.withColumns({"path": F.concat("path", "up_path"), "steps": F.concat("steps", "up_steps")} | ({} if at else {"subroot": F.col("root")}))
    return out.withColumn("root", F.col("up_root")).drop("up_key", "up_idx", "up_path", "up_steps", "up_root")


def manifest(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes: tree (any type), leaf (binary digest), the order columns and what is to be kept.

    Adds path (binary: the siblings from the bottom up, 32 bytes each), steps (for each level 0 no sibling, 1 it stands left,
    2 it stands right), subroot (of the tree) and root (of all trees, in the order of their keys).
    """
    levels = _levels(_placed(nodes, order))
    trees = levels[-1].where("idx = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    forest = _levels(_placed(trees, ["name"]))
    for k in range(len(forest) - 1, 0, -1):
        forest[k - 1] = _raised(forest[k - 1], forest[k], "tree", "block")
    # At the top a tree has at most one block of rows, so that no tree's rows meet in one task.
    levels[-1] = _raised(levels[-1], forest[0].drop("tree"), "name", None)
    for k in range(len(levels) - 1, 0, -1):
        levels[k - 1] = _raised(levels[k - 1], levels[k], "tree", "block")
    return levels[0].drop("block", "idx", "total")


def folded(start: Column, path: Column, steps: Column) -> Column:
    """The root (hex) that a leaf (hex) leads to by its proof."""
    def up(state: Column, step: Column) -> Column:
        sibling = _hex(F.substring(path, state["at"] * DIGEST + 1, F.lit(DIGEST)))
        both = F.when(step == LEFT, F.concat(sibling, state["digest"])).when(step == RIGHT, F.concat(state["digest"], sibling)).otherwise(state["digest"])
        return F.struct(F.sha2(both, 256).alias("digest"), (state["at"] + F.when(step == ALONE, 0).otherwise(1)).alias("at"))

    return F.aggregate(steps, F.struct(start.alias("digest"), F.lit(0).alias("at")), up, lambda s: s["digest"])


def proven(docs: DataFrame) -> DataFrame:
    """Documents in a manifest by language, each with its proof, and the check of that proof after a row was tampered with.

    Where 7 divides the CRC-32 of a document's decimal id, n_chars is one more when it is checked; a null n_chars stays, and
    a document without an id is never tampered with.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    c = {name: F.col(name) for name in rows.columns}
    hit = F.crc32(c["doc_id"].cast("string").cast("binary")) % 7 == 0
    changed = F.when(hit, leaf(c["doc_id"], c["source"], c["lang"], c["n_chars"] + 1, c["text"]))
    nodes = rows.select(c["lang"].alias("tree"), "doc_id", F.unhex(leaf(*(c[n] for n in ("doc_id", "source", "lang", "n_chars", "text")))).alias("leaf"), F.unhex(changed).alias("changed"))
    with common.scratch(docs.sparkSession):
        found = manifest(common.stored(nodes, "merkle-leaves"), ["doc_id"])
        out = found.select(
            "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), F.sha2(_hex(F.col("path")), 256).alias("proof_sha256"),
            folded(_hex(F.coalesce("changed", "leaf")), F.col("path"), F.col("steps")).alias("folded_root"),
        ).withColumn("verified", F.col("folded_root") == F.col("root"))
        return common.stored(out, "merkle-proofs", keep=True)
