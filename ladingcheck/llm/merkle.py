"""A Merkle manifest of a dataset: a tree of leaves per source, a tree of their roots, and Octopus multiproofs.

H is SHA-256 in lower-case hexadecimal; digests are hashed as text. A row's leaf is H of its fields, each `-` if null, else
its length in bytes, a colon and its value. Every FANOUT consecutive nodes of a level become one of the next.

*Positions.* Leaves are dealt by ranges of (source, doc_id) and numbered inside each range; what the ranges before hold of
the same source is a sum over one row per range. So a source of a third of all rows is numbered by many tasks.

*Trees.* A group of BLOCK consecutive nodes gives LEVELS levels at once; as many rounds as it takes to come to one node.

*Octopus multiproofs.* Wanted leaves are dealt into partitions of neighbours. Each partition works out the least set of
coordinates (tree, level, index) that its leaves cannot give themselves, over all its leaves and both trees together, and
these nodes are fetched once, in one join. It then derives all interiors that its leaves share and expands the proof of
each leaf from them; a claimed leaf that differs is folded along its own path.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladingcheck.llm.shared import ascii_lower, stored

FANOUT = 16
#: Levels that one group of nodes gives, and the nodes of such a group.
LEVELS = 3
BLOCK = FANOUT**LEVELS
#: Leaves of one range of the order.
RANGE_ROWS = 1 << 17
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of roots; trees of sources are named "" for null, else "=" and the source, which keeps their order.
TOP = "^"


def _leaf(text: Column | str = "text") -> Column:
    def field(value):
        value = (F.col(value) if isinstance(value, str) else value).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(text if f == "text" else f) for f in FIELDS]), 256)


def height(n: Column) -> Column:
    """Levels above n leaves."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(1, 15)), F.when(n > 1, 1).otherwise(0))


@dataclass(frozen=True)
class Manifest:
    """leaves: doc_id, tree, n, top, n_top, pos, leaf, claim; nodes: tree, n, level, idx, digest; root: None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    rows: int


def _numbered(rows: DataFrame, order: list[str], what: str) -> tuple[DataFrame, DataFrame, int]:
    """(rows with part and at, per (tree, part) what to add to `at` for the position, and the tree's size; rows in all)."""
    n = rows.count()
    dealt = rows.repartitionByRange(-(-n // RANGE_ROWS) or 1, "tree", *order).sortWithinPartitions("tree", *order)
    # The id holds the number of the partition above 33 bits and the place in it below.
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), what).withColumn("part", F.shiftright("at", 33))
    own = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")  # one row a range
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    shifts = own.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return dealt, stored(shifts, f"{what}_shifts"), n


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """tree, n, level, idx, digest of the next LEVELS levels of trees that go on above `level`."""
    def up(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FANOUT).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * FANOUT + 1, FANOUT), ""), 256))

    block = F.floor(F.col("idx") / BLOCK)
    groups = nodes.where(height(F.col("n")) > level).groupBy("tree", "n", block.alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("d0"))
    for k in range(LEVELS):
        groups = groups.withColumn(f"d{k + 1}", F.when(height(F.col("n")) > level + k, up(F.col(f"d{k}"))))
    levels = F.array(*[F.struct(F.lit(level + k).alias("level"), (F.col("block") * (BLOCK // FANOUT**k)).alias("first"),
                                F.col(f"d{k}").alias("ds")) for k in range(1, LEVELS + 1)])
    rows = groups.select("tree", "n", F.explode(levels).alias("l")).where("l.ds is not null")
    return rows.select("tree", "n", F.col("l.level").alias("level"), F.col("l.first").alias("first"), F.posexplode("l.ds").alias("i", "digest")).select(
        "tree", "n", "level", (F.col("first") + F.col("i")).alias("idx"), "digest")


def _trees(leaves: DataFrame, most: int, what: str) -> DataFrame:
    """All nodes over level-0 nodes (tree, n, level, idx, digest) of trees of at most `most` leaves."""
    out, last, level = leaves, leaves, 0
    while most > 1:
        new = stored(_above(last, level), f"{what}{level}")
        out, level, most = out.unionByName(new), level + LEVELS, -(-most // BLOCK)
        last = new.where(F.col("level") == level)
    return out


def build(documents: DataFrame, claimed_text: Column | None = None) -> Manifest:
    """The manifest over all rows. claimed_text: the text of which each row's claim, a leaf to be proved, is made."""
    own, claim = _leaf(), _leaf() if claimed_text is None else _leaf(claimed_text)
    rows = stored(documents.select(*FIELDS).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
        own.alias("leaf"), claim.alias("claim"), F.monotonically_increasing_id().alias("row")), "leaves")
    # The row's number only parts equal rows, which are the same leaf, so that no range is filled by one of them.
    dealt, shifts, n = _numbered(rows, ["doc_id", "leaf", "row"], "dealt")
    sources = shifts.select("tree", "n").distinct().select(F.lit(TOP).alias("tree"), F.col("tree").alias("source_tree"))
    tops, top_shifts, n_top = _numbered(stored(sources, "sources"), ["source_tree"], "tops")
    tops = tops.join(top_shifts, ["tree", "part"]).select(
        F.col("source_tree").alias("tree"), (F.col("at") + F.col("shift")).alias("top"), F.col("n").alias("n_top"))
    placed = dealt.join(shifts.join(tops, "tree"), ["tree", "part"]).select(
        "doc_id", "tree", "n", "top", "n_top", (F.col("at") + F.col("shift")).alias("pos"), "leaf", "claim")
    leaves = placed.select("tree", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest"))
    nodes = _trees(leaves, shifts.agg(F.max("n")).first()[0] or 0, "nodes")
    subroots = nodes.where(F.col("level") == height(F.col("n"))).join(tops, "tree").select(
        F.lit(TOP).alias("tree"), F.col("n_top").alias("n"), F.lit(0).alias("level"), F.col("top").alias("idx"), "digest")
    top_nodes = _trees(stored(subroots, "subroots"), n_top, "top_nodes")
    root = top_nodes.where(F.col("level") == height(F.col("n"))).select("digest").first()
    return Manifest(placed, nodes.unionByName(top_nodes), root and root[0], n)


def missing(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, idx) of the least set of nodes that, with the leaves `known` of n, gives all nodes above these leaves."""
    out, level = [], 0
    known = np.unique(known)
    while n > 1:
        runs = np.unique(known // FANOUT)
        need = (runs[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        need = np.setdiff1d(need[need < n], known, assume_unique=True)
        out += [(level, int(i)) for i in need]
        known, level, n = runs, level + 1, -(-n // FANOUT)
    return out


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Branch:
    """The nodes of one tree that a partition has: given and fetched ones, and the interiors derived from them."""

    def __init__(self, n: int, known: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.runs: list[dict[int, list[str]]] = []
        while n > 1:
            level = len(self.runs)
            runs = {r: [known[i] if i in known else fetched[level, i] for i in range(r * FANOUT, min(n, (r + 1) * FANOUT))]
                    for r in {i // FANOUT for i in known}}
            self.runs.append(runs)
            known, n = {r: _digest(run) for r, run in runs.items()}, -(-n // FANOUT)
        self.root = next(iter(known.values()))
        self.shared: dict[tuple[int, int], str] = {}

    def siblings(self, i: int, level: int = 0) -> str:
        """The proof of node i of a level, up to the root; its part above the run is worked out once for the run."""
        if level == len(self.runs):
            return ""
        run, k = self.runs[level][i // FANOUT], i % FANOUT
        above = self.shared.get((level, i // FANOUT))
        if above is None:
            above = self.shared[level, i // FANOUT] = self.siblings(i // FANOUT, level + 1)
        return "".join(run[:k]) + "".join(run[k + 1:]) + above

    def fold(self, i: int, digest: str) -> str:
        for runs in self.runs:
            run = list(runs[i // FANOUT])
            run[i % FANOUT] = digest
            i, digest = i // FANOUT, _digest(run)
        return digest


def _asked(group: pa.Table) -> pa.Table:
    """cell, tree, level, idx of the nodes that a partition of leaves lacks."""
    at = group.to_pandas()
    rows = [(tree, *x) for tree, own in at.groupby("tree") for x in missing(own["pos"].to_numpy(), int(own["n"].iloc[0]))]
    rows += [(TOP, *x) for x in missing(at["top"].to_numpy(), int(at["n_top"].iloc[0]))]
    trees, levels, idx = zip(*rows) if rows else ((), (), ())
    return pa.table({"cell": pa.array([int(at["cell"].iloc[0])] * len(rows), pa.int64()), "tree": pa.array(trees, pa.string()),
                     "level": pa.array(levels, pa.int32()), "idx": pa.array(idx, pa.int64())})


def _expanded(listed: bool):
    def run(wanted: pa.Table, fetched: pa.Table) -> pa.Table:
        nodes: dict[str, dict[tuple[int, int], str]] = {}
        for tree, level, i, digest in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
            nodes.setdefault(tree, {})[level, i] = digest
        at = wanted.to_pandas()
        branches = {tree: Branch(int(own["n"].iloc[0]), dict(zip(own["pos"], own["leaf"])), nodes.get(tree, {}))
                    for tree, own in at.groupby("tree")}
        if not branches:
            return pa.Table.from_pylist([], _schema(listed))
        place = dict(zip(at["tree"], at["top"]))
        top = Branch(int(at["n_top"].iloc[0]), {int(place[t]): b.root for t, b in branches.items()}, nodes.get(TOP, {}))
        tails = {tree: top.siblings(int(i)) for tree, i in place.items()}
        subroot, proof, folded = [], [], []
        for tree, i, leaf, claim in zip(at["tree"], at["pos"], at["leaf"], at["claim"]):
            branch = branches[tree]
            subroot.append(branch.root)
            proof.append(branch.siblings(int(i)) + tails[tree])
            # An unchanged leaf folds through the interiors that have been derived from it.
            folded.append(top.root if claim == leaf else top.fold(int(place[tree]), branch.fold(int(i), claim)))
        out = {"doc_id": wanted.column("doc_id"), "leaf": wanted.column("leaf"), "subroot": pa.array(subroot, pa.string()),
               "proof_sha256": pa.array([hashlib.sha256(p.encode()).hexdigest() for p in proof], pa.string()),
               "folded_root": pa.array(folded, pa.string())}
        if listed:
            out["proof"] = pa.array([[p[i:i + 64] for i in range(0, len(p), 64)] for p in proof], pa.list_(pa.string()))
        return pa.table(out)

    return run


def _schema(listed: bool) -> pa.Schema:
    names = ("leaf", "subroot", "proof_sha256", "folded_root")
    return pa.schema([("doc_id", pa.int64()), *[(x, pa.string()) for x in names], *([("proof", pa.list_(pa.string()))] if listed else [])])


def prove(manifest: Manifest, wanted: DataFrame | None = None, listed: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of wanted leaves (rows of manifest.leaves; None: all).

    listed: also `proof`, the siblings from the leaf to the root, left to right.
    """
    wanted = manifest.leaves if wanted is None else wanted
    cells = -(-manifest.rows // BLOCK) or 1
    # A partition is a block of neighbours of one tree, or small trees whole.
    cell = F.when(F.col("n") > BLOCK, F.xxhash64("tree", F.floor(F.col("pos") / BLOCK))).otherwise(
        F.pmod(F.xxhash64("tree"), F.lit(cells)))
    wanted = wanted.withColumn("cell", cell)
    asked = wanted.select("cell", "tree", "n", "pos", "top", "n_top").groupBy("cell").applyInArrow(
        _asked, "cell long, tree string, level int, idx long")
    fetched = asked.join(manifest.nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"]).select(
        "cell", "tree", "level", "idx", "digest")
    out = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string" + (", proof array<string>" if listed else "")
    proved = wanted.groupBy("cell").cogroup(fetched.groupBy("cell")).applyInArrow(_expanded(listed), out)
    root = F.lit(manifest.root).cast("string")
    return proved.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                         (F.col("folded_root") == root).alias("verified"), *(["proof"] if listed else []))


def audit(documents: DataFrame) -> DataFrame:
    """Every row proved against its manifest, with claims tampered where 5 divides crc32(doc_id): A-Z of text lower-cased.

    Nulls in any column are fields of their own kind, different from empty ones; rows without doc_id come first in their
    source and are not tampered; rows without source are the first source. Repeated rows and rows of one doc_id are leaves
    of their own, in the order of doc_id and leaf. Columns other than the five fields are not read. An empty table gives an
    empty result.
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return prove(build(documents, tampered))
