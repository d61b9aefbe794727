"""Exact top-k inner products by dual-tree search over cover trees.

The rows are dealt to blocks and the queries to chunks; each pair of a block and a chunk is one group that builds a cover
tree of its distinct vectors and one of its queries and descends both together. A pair of nodes is dropped when
<cq, cx> + |cq| rx + |cx| rq + rq rx, the largest product that their covering radii allow, is below the worst k-th score
of the queries under the node. Blocks grow with the square root of the table, so queries travel as little as rows do.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladingcheck.llm.shared import stored

LEAF = 24
#: Ratio of the covering radii of two levels.
BASE = 1.3
BLOCK_LEAST, BLOCK_MOST, CHUNK = 1024, 1 << 17, 4096
#: Sums of products up to this size are exact in doubles.
_EXACT = 2.0**52


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list["Node"] = field(default_factory=list)
    norm: float = 0.0
    worst: float = -np.inf


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, centre: int | None = None) -> Node:
    """Children are centred on points of the node that are further apart than the next radius and cover all of it."""
    points = np.arange(len(x)) if points is None else points
    centre = int(points[0]) if centre is None else centre
    root = None
    work: list[tuple[np.ndarray, int, Node | None]] = [(points, centre, None)]
    while work:
        points, centre, parent = work.pop()
        away = np.sqrt(((x[points] - x[centre]) ** 2).sum(axis=1))
        node = Node(x[centre], float(away.max()), points, norm=float(np.sqrt((x[centre] ** 2).sum())))
        if parent is None:
            root = node
        else:
            parent.children.append(node)
        if len(points) <= LEAF or node.radius == 0:
            continue
        reach, near, owner, centres = node.radius / BASE, away, np.zeros(len(points), np.int64), [centre]
        while near.max() > reach:
            centres.append(int(points[np.argmax(near)]))
            d = np.sqrt(((x[points] - x[centres[-1]]) ** 2).sum(axis=1))
            owner[d < near] = len(centres) - 1
            near = np.minimum(near, d)
        small = []
        for i, c in enumerate(centres):
            own = points[owner == i]
            if len(own) * 4 <= LEAF:
                small.append(own)  # single points of a wide net are searched together
            else:
                work.append((own, c, node))
        if small:
            rest = np.concatenate(small)
            for at in range(0, len(rest), LEAF):
                own = rest[at:at + LEAF]
                c = x[own].mean(axis=0)
                r = float(np.sqrt(((x[own] - c) ** 2).sum(axis=1)).max())
                node.children.append(Node(c, r, own, norm=float(np.sqrt((c ** 2).sum()))))
    return root


def dual_search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """Best k scores and ids of each query (missing ones -inf); ids[i]: the ids of the distinct vector x[i], smallest first."""
    most = max(len(i) for i in ids)
    table = np.full((len(ids), most), np.iinfo(np.int64).max, np.int64)
    for i, own in enumerate(ids):
        table[i, :len(own)] = own
    scores = np.full((len(queries), k), -np.inf)
    found = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
    q_root, x_root = cover_tree(queries), cover_tree(x)

    def bound(a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + 1e-9 * (abs(top) + a.norm * b.norm) + 1e-6  # rounding must not close a pair

    heap, serial = [(-bound(q_root, x_root), 0, q_root, x_root)], 0
    while heap:
        minus, _, a, b = heapq.heappop(heap)
        if -minus < a.worst:
            continue
        if not a.children and not b.children:
            mine = a.points
            products = queries[mine] @ x[b.points].T
            near = table[b.points]
            new_ids = np.broadcast_to(near.reshape(1, -1), (len(mine), near.size))
            new = np.repeat(products, most, axis=1)
            new = np.where((new_ids == query_ids[mine][:, None]) | (new_ids == np.iinfo(np.int64).max), -np.inf, new)
            all_s, all_i = np.concatenate([scores[mine], new], 1), np.concatenate([found[mine], new_ids], 1)
            order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            scores[mine] = np.take_along_axis(all_s, order, 1)
            found[mine] = np.take_along_axis(all_i, order, 1)
            a.worst = float(scores[mine, -1].min())
            continue
        pairs = [(c, b) for c in a.children] if a.children and (not b.children or a.radius > b.radius) else [
            (a, c) for c in b.children]
        for c, d in pairs:
            c.worst = max(c.worst, a.worst) if c is not a else c.worst
            top = bound(c, d)
            if top >= c.worst:
                serial += 1
                heapq.heappush(heap, (-top, serial, c, d))
    return scores, found


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dims = left.column("dim")[0].as_py()

        def matrix(t: pa.Table) -> np.ndarray:
            column = t.column("v").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            return column.flatten().to_numpy().astype(np.float64).reshape(t.num_rows, dims)

        q, x = matrix(left), matrix(right)
        q_ids, x_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        if not dims or float(np.abs(q).max()) * float(np.abs(x).max()) * dims > _EXACT:
            return _plain(left, right, k, schema)
        once = list({(i, v.tobytes()): at for at, (i, v) in enumerate(zip(q_ids.tolist(), q))}.values())
        q, q_ids = q[once], q_ids[once]
        distinct, owner = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((x_ids, owner.ravel()))
        cuts = np.searchsorted(owner.ravel()[order], np.arange(len(distinct) + 1))
        # Beyond the k + 1 smallest ids of equal vectors none can be among the k best of a query.
        ids = [np.unique(x_ids[order[a:b]])[:k + 1] for a, b in zip(cuts[:-1], cuts[1:])]
        scores, found = dual_search(q, q_ids, distinct, ids, k)
        there = scores > -np.inf
        return pa.table({"query_id": np.repeat(q_ids, k).reshape(-1, k)[there], "vec_id": found[there],
                         "score": scores[there].astype(np.int64)}, schema=schema)

    return run


def _plain(left: pa.Table, right: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """Products too large for doubles, or vectors without components: whole numbers of Python; scores are cut to 64 bits."""
    rows, asked = (list({(i, tuple(v)): None for i, v in zip(t.column("vec_id").to_pylist(), t.column("v").to_pylist())})
                   for t in (right, left))
    out = []
    for q, v in asked:
        scored = ((max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in rows if i != q)
        out += [(q, i, s) for s, i in heapq.nsmallest(k, scored, key=lambda t: (-t[0], t[1]))]
    return pa.table({n: pa.array([r[j] for r in out], pa.int64()) for j, n in enumerate(schema.names)})


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each row whose vec_id is divisible by `every`.

    Components become floor(scale * x). Null vectors, vectors with null or non-finite components and rows without vec_id
    take no part; vectors meet only those of as many components. Equal scores go to the smaller vec_id; rows that repeat a
    vec_id and vector count once, and only vec_id and embedding are read. Fewer than k candidates give fewer rows.
    """
    ints = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where("vec_id is not null and embedding is not null").where(fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), ints.alias("v"))
    rows = stored(rows, "vectors")
    n, n_q = rows.count(), rows.where(F.col("vec_id") % every == 0).count()
    blocks = -(-n // min(BLOCK_MOST, max(BLOCK_LEAST, int(4 * n ** 0.5)))) or 1
    chunks = -(-n_q // CHUNK) or 1
    spread = lambda name, seed, parts: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).alias(name)
    each = lambda name, parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias(name)
    key = ["dim", "block", "chunk"]
    left = rows.where(F.col("vec_id") % every == 0).select("*", spread("chunk", 1, chunks)).select("*", each("block", blocks))
    right = rows.select("*", spread("block", 2, blocks)).select("*", each("chunk", chunks))
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _search(k), "query_id long, vec_id long, score long")
    # The rank limit is applied before the shuffle as well.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
