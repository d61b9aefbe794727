"""Links between members of common groups, confirmed on full sets in blocks of bounded size.

A group of up to BLOCK members is one block, in which all pairs that nothing has connected yet are compared; a text moves
once to each block it is in. A larger group is dealt by hash of the member into several blocks, and CENTRES members of the
smallest ranks go into each of them; the ranks are the same in all groups, so near copies meet the same few centres and
their blocks are connected through them. Where a large group then has members that are not connected, two steps follow:

* A shingle that only members of one component hold is shared with no other component. A member whose other shingles
  are too few for a link goes; a group goes with it if what is left is connected.
* What still is not connected is compared pair by pair: its members are dealt into half blocks, and any two of them meet.

So every pair of a group is compared on full sets, or connected, or excluded by an exact bound; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladingcheck.llm.shared import stored

#: Members of a block, on average where a group is dealt into several.
BLOCK = 256
#: Members of a large group that are in all of its blocks.
CENTRES = 4
#: Members of a block whose distances to all others prune pairs by the triangle inequality (1 - J is a metric).
PIVOTS = 2
#: Rows whose sets are made at once.
ROWS = 1000

Sets = Callable[[pa.Array], list[np.ndarray]]


def links_within(ids: np.ndarray, labels: np.ndarray, own: list[np.ndarray], part: int, whole: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect what is linked: pairs of one label, or already connected here, are not compared."""
    sizes = np.array([len(s) for s in own])
    out: list[tuple[int, int]] = []
    if len(ids) < 2 or (labels == labels[0]).all():
        return out
    labels = np.unique(labels, return_inverse=True)[1]
    _, tokens = np.unique(np.concatenate(own), return_inverse=True)
    stops = np.cumsum(sizes)
    parts = [tokens[b - k:b] for b, k in zip(stops, sizes)]
    flags = np.zeros(len(tokens), bool)
    later = np.arange(len(ids))
    distances: list[np.ndarray] = []
    for i in range(len(ids) - 1):
        others = later[i + 1:]
        others = others[(labels[others] != labels[i]) & (whole * np.minimum(sizes[others], sizes[i]) >= part * np.maximum(sizes[others], sizes[i]))]
        others = others[sizes[others] > 0]
        for d in distances:  # a little slack for rounding
            others = others[np.abs(d[others] - d[i]) <= (whole - part) / whole + 1e-9]
        pivot = len(distances) < PIVOTS and len(ids) > 4 * PIVOTS and sizes[i]
        if not len(others) and not pivot:
            continue
        flags[parts[i]] = True
        if pivot:
            both = np.array([np.count_nonzero(flags[p]) for p in parts])
            distances.append(1 - both / (sizes[i] + sizes - both))
            shared = both[others]
        else:
            shared = np.array([np.count_nonzero(flags[parts[j]]) for j in others])
        flags[parts[i]] = False
        near = others[whole * shared >= part * (sizes[i] + sizes[others] - shared)]
        if len(near):
            out += [(int(ids[i]), int(ids[j])) for j in near]
            labels[np.isin(labels, labels[near])] = labels[i]
    return out


def _links(sets: Sets, part: int, whole: int):
    """a, b of the links in each block; rows of one block stand in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, labels, own, out = None, [], [], [], []

        def ended() -> list[tuple[int, int]]:
            return links_within(np.concatenate(ids), np.concatenate(labels), own, part, whole) if len(own) > 1 else []

        def rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                key, x, label = (piece.column(c).to_numpy() for c in ("block", "x", "label"))
                found = sets(piece.column("text"))
                cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
                for first, last in zip([0, *cuts], [*cuts, len(key)]):
                    if key[first] != block:
                        out += ended()
                        block, ids, labels, own = key[first], [], [], []
                    ids.append(x[first:last])
                    labels.append(label[first:last])
                    own.extend(found[first:last])
            if out:
                yield rows(out)
                out = []
        out += ended()
        if out:
            yield rows(out)

    return run


def _in_blocks(rows: DataFrame, docs: DataFrame, sets: Sets, part: int, whole: int, what: str) -> DataFrame:
    """The links of rows (block, x, label)."""
    moved = rows.join(docs.select(F.col("doc_id").alias("x"), "text"), "x")
    met = moved.select("block", "x", "label", "text").repartition("block").sortWithinPartitions("block")
    return stored(met.mapInArrow(_links(sets, part, whole), "a long, b long"), what)


def _hashes(sets: Sets):
    """x, label, h of every shingle of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                own = sets(piece.column("text"))
                turn = np.repeat(np.arange(len(own)), [len(s) for s in own])
                yield pa.record_batch({
                    "x": piece.column("x").take(pa.array(turn)), "label": piece.column("label").take(pa.array(turn)),
                    "h": pa.array(np.concatenate(own).view(np.int64))})

    return run


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of x; x itself where it has none."""
    return rows.join(labels.select(F.col("doc_id").alias("x"), "label"), "x", "left").withColumn("label", F.coalesce("label", "x"))


def unconnected(rows: DataFrame) -> DataFrame:
    """rows (b, x, n, label) of the groups with more than one label, with the number of their members."""
    mixed = rows.groupBy("b").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"))
    return rows.join(mixed.where("low < high").select("b", "members"), "b")


def _closed(rows: DataFrame, docs: DataFrame, sets: Sets, part: int, whole: int) -> DataFrame:
    """x of the members of rows (b, x, n, label) that can have no link to another label.

    Of each shingle that one label only holds, its smallest and its largest member count it; the others may have it
    uncounted, which leaves them in. Ids of several rows stay.
    """
    wanted = rows.select("x", "label").distinct()
    once = docs.select(F.col("doc_id").alias("x")).join(wanted.select("x"), "x").groupBy("x").agg(
        F.count(F.lit(1)).alias("texts")).where("texts = 1").select("x")
    held = docs.select(F.col("doc_id").alias("x"), "text").join(wanted, "x").select("x", "label", "text").mapInArrow(
        _hashes(sets), "x long, label long, h long")
    private = held.groupBy("h").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("x").alias("first"), F.max("x").alias("last")).where(
        "low = high").select(F.explode(F.array_distinct(F.array("first", "last"))).alias("x")).groupBy("x").agg(
        F.count(F.lit(1)).alias("private"))
    sizes = rows.groupBy("x").agg(F.max("n").alias("n"))
    return private.join(sizes, "x").where(whole * (F.col("n") - F.col("private")) < part * F.col("n")).join(once, "x").select("x")


def in_pairs(rows: DataFrame, most: int) -> DataFrame:
    """rows (b, x, members) with `block`, dealt into blocks of about `most` members such that any two of a group meet in one."""
    rows = rows.withColumn("blocks", dealt("members", max(1, most // 2))).withColumn(
        "blocks", F.when(F.col("members") > most, F.col("blocks")).otherwise(1)).withColumn(
        "i", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    return rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> j or blocks = 1").withColumn(
        "block", F.xxhash64("b", F.least("i", "j"), F.greatest("i", "j"))).drop("blocks", "i", "j")


def dealt(members: str, most: int) -> Column:
    return F.ceil(F.col(members) / most).cast("int")


def components(groups: DataFrame, docs: DataFrame, sets: Sets, part: int, whole: int, known: DataFrame | None = None) -> DataFrame:
    """doc_id, label (the smallest id that links reach) of every member of groups that has a link.

    known: doc_id, label of what is connected already; it is part of the result.

    groups: b, x, n, members, one row for each member of a group, n the size of its set, members that of the group; docs:
    doc_id, text; sets: the sorted distinct shingle hashes of each row of a text column. An id may stand for several texts.
    """
    place = F.xxhash64("x")
    rows = groups.select(F.xxhash64("b", F.pmod(place, dealt("members", BLOCK)).cast("int")).alias("block"), "x", F.col("x").alias("label"))
    large = groups.where(F.col("members") > BLOCK)
    centres = large.groupBy("b", F.pmod(F.xxhash64(F.lit(1), "x"), F.lit(CENTRES)).alias("turn")).agg(
        F.min(F.struct(F.xxhash64(F.lit(2), "x"), "x")).alias("c"), F.max("members").alias("members")).select(
        "b", F.col("c.x").alias("x"), F.explode(F.sequence(F.lit(0), dealt("members", BLOCK) - 1)).alias("i")).select(
        F.xxhash64("b", "i").alias("block"), "x", F.col("x").alias("label"))
    rows = rows.unionAll(centres)
    if known is not None:
        rows = labelled(rows.drop("label"), known)
    links = _in_blocks(rows, docs, sets, part, whole, "links")
    labels = component_labels(links) if known is None else merged(known, links)
    rest = stored(unconnected(labelled(large.select("b", "x", "n"), labels)), "unconnected")
    if not rest.limit(1).count():
        return labels
    rest = rest.drop("members")
    rest = stored(unconnected(rest.join(_closed(rest, docs, sets, part, whole), "x", "left_anti").select("b", "x", "n", "label")), "open")
    if not rest.limit(1).count():
        return labels
    pairs = in_pairs(rest, BLOCK).select("block", "x", "label")
    return merged(labels, _in_blocks(pairs, docs, sets, part, whole, "more_links"))


def component_labels(links: DataFrame) -> DataFrame:
    """doc_id, label of every linked document: the smallest id reachable over links (a, b).

    All other ends of a document's links are first tied to its smallest one, which leaves about one link a document. Then labels
    go to neighbours, and on to the label's own label, until none changes.
    """
    links = links.distinct()
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    tied = links.join(least, "b").where("a <> m").select("a", F.col("m").alias("b")).distinct()
    few = least.select(F.col("m").alias("a"), "b").unionAll(tied)
    both = stored(few.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
                  .select("e.*"), "both")
    n = both.count()
    labels = stored(both.groupBy(F.col("a").alias("doc_id")).agg(F.min(F.least("a", "b")).alias("label")), "labels", n)
    while True:
        near = (both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "doc_id").select(
            "doc_id", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("doc_id").alias("next"), F.col("label").alias("far"))
        new = stored(step.join(jump, "next", "left").select(
            "doc_id", F.least("next", "far").alias("label"), "old"), "labels", n)
        changed = new.where("label <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, label (the smallest id reachable) after new links (a, b); only links between different labels are followed."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("doc_id").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    roots = stored(links.select(*[F.coalesce(f"label_{end}", end).alias(end) for end in ("a", "b")]).where("a <> b").distinct(), "roots")
    if not roots.limit(1).count():
        return labels
    moved = component_labels(roots)
    old = labels.join(moved.select(F.col("doc_id").alias("label"), F.col("label").alias("to")), "label", "left").select(
        "doc_id", F.coalesce("to", "label").alias("label"))
    return stored(old.unionByName(moved.join(labels, "doc_id", "left_anti")), "merged")
