"""N-gram Jaccard join in the metric space of shingle sets.

1 - J is a metric on sets, so the join is done by regions around pivots. The pivots come in two kinds:

* Level 0: the one-shingle sets {s}. Every document is nearest to the pivots of its own shingles, and a document that
  shares nothing with another is at the full distance 1 from its pivots, so document pivots alone could not separate
  such documents (all would fall in every window). A total order of the shingles breaks the ties. If d(x, y) <= r, then
  |x without y| <= r |x|, so the first common shingle of both is among the first floor(r |x|) + 1 of x and of y: the
  window into which x is replicated. The order puts shingles that are frequent in the corpus last (a fixed-size table
  of counts over all documents says which), so shared passages do not make large regions.
* First, each document goes with its text to the region of its first shared shingle. What is linked there is connected;
  in a block of documents the first ones are pivots, and the triangle inequality spares pairs whose distances to
  a pivot differ by more than r (`near_pairs`). Large groups of near copies are one component from here on.
* Then the members of all regions that are not connected meet by bitmaps, which bound the distance of a pair from below; regions
  with the same members count once. The few pairs that may be linked are compared on full sets, in blocks again.

Equal sets are one class from the start, so exact copies cost nothing. Nothing is dropped: the result is exact but for
collisions of 58-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladingcheck.llm import near_pairs
from ladingcheck.llm import words as W
from ladingcheck.llm.shared import stored

#: Slots of the table of counts that orders shingles; fixed, so what is broadcast is 4 bytes each at any input size.
SLOTS = 1 << 18
#: Slots that are summed as one row.
BLOCK = 1 << 12
#: Least bits of a document that tell, for each of as many classes of shingles, whether their number is odd; longer
#: documents have the power of two up to their shingles. Every shingle of one set alone changes one bit, so as many bits
#: as differ, as many shingles at least are not shared: an exact bound. Half the bits are the halves' exclusive or.
BITMAP = 1024
#: Regions up to this size are one block of bitmaps; larger ones are dealt into blocks in which any two members meet.
SMALL = 1024
#: Lower bits of the hashes whose sums stand for a region's members; sums of 2^27 members stay within 63 bits.
_PART = (1 << 36) - 1
_HASH = np.uint64((1 << 58) - 1)


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = W.words(data, offsets, W.SPACE)
    hashes, n = W.shingles(W.word_hashes(data, starts, ends), counts, width)
    return hashes & _HASH, n


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(58 - SLOTS.bit_length() + 1)).astype(np.int64)


def _counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in W.pieces(batch.column("text")):
                total += np.bincount(_slots(_sets(data, offsets, width)[0]), minlength=SLOTS)
        if total.any():
            yield pa.record_batch({"block": pa.array(range(SLOTS // BLOCK), pa.int32()),
                                   "counts": pa.array([x.tobytes() for x in total.reshape(-1, BLOCK)], pa.binary())})

    return run


def _summed(parts: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in parts.column("counts"):
        total += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"block": parts.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _order_table(documents: DataFrame, width: int) -> np.ndarray:
    """For each slot 0 if its count is usual, else a class that grows with the logarithm of the excess."""
    schema = "block int, counts binary"
    rows = documents.mapInArrow(_counts(width), schema).groupBy("block").applyInArrow(_summed, schema).collect()
    total = np.zeros((SLOTS // BLOCK, BLOCK), np.int64)
    for row in rows:  # SLOTS counts in all, whatever the input
        total[row["block"]] = np.frombuffer(row["counts"], np.int64)
    usual = np.median(total)
    excess = np.maximum(1, total.ravel() - usual - 8 * np.sqrt(usual) - 8)
    return np.minimum(31, np.log2(excess).astype(np.int64)).astype(np.uint8)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()),
                                    pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _prints(width: int, rest: int, whole: int, order) -> object:
    """doc_id, n, two sums that stand for the set, and the first shingles in the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = order.value.astype(np.uint64)
        for batch in batches:
            for first, rows, data, offsets in W.pieces(batch.column("text")):
                hashes, counts = _sets(data, offsets, width)
                tokens = (table[_slots(hashes)] << np.uint64(58)) | hashes
                ends = np.cumsum(counts)
                n, a, b, heads = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), []
                marks = []
                for i in range(rows):
                    own = np.unique(tokens[ends[i] - counts[i]:ends[i]])
                    n[i] = len(own)
                    a[i], b[i] = W.mix(own).sum(), W.mix(own ^ _HASH).sum()
                    bits = max(BITMAP, 1 << len(own).bit_length() >> 1)
                    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                    marks.append(np.packbits(odd.astype(bool)).view(np.int64))
                    heads.append(own[:rest * len(own) // whole + 1].view(np.int64))
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(first, rows), "n_shingles": pa.array(n),
                    "sum_a": pa.array(a.view(np.int64)), "sum_b": pa.array(b.view(np.int64)),
                    "marks": _lists(marks), "head": _lists(heads)})

    return run


def _text_sets(width: int) -> near_pairs.Sets:
    def sets(texts: pa.Array) -> list[np.ndarray]:
        out = []
        for _, rows, data, offsets in W.pieces(texts):
            hashes, counts = _sets(data, offsets, width)
            ends = np.cumsum(counts)
            out += [np.unique(hashes[ends[i] - counts[i]:ends[i]]) for i in range(rows)]
        return out

    return sets


def _folded(marks: np.ndarray) -> np.ndarray:
    half = marks.shape[1] // 2
    return marks[:, :half] ^ marks[:, half:]


def near_by_marks(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, marks: list[np.ndarray], part: int, whole: int,
                  before: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Arrays of pairs (a, b) with different labels that may be linked by their sizes and bitmaps.

    before: the regions that come before this one for each member; pairs that share one of them are left to it.
    """
    order = np.argsort([len(m) for m in marks], kind="stable")
    ids, labels, sizes = ids[order], labels[order], sizes[order]
    words = np.array([len(marks[i]) for i in order])
    out = []
    for many in np.unique(words):
        mine = np.flatnonzero(words == many)
        bits = np.stack([marks[order[i]] for i in mine])
        # Sets of sizes that can link differ by less than a factor of two, so one folding makes their bitmaps equally long.
        twice = np.flatnonzero(words == 2 * many)
        others, all_bits = mine, bits
        if len(twice):
            others = np.concatenate([mine, twice])
            all_bits = np.concatenate([bits, _folded(np.stack([marks[order[i]] for i in twice]))])
        for k, i in enumerate(mine):
            at = np.arange(k + 1, len(others))
            j = others[at]
            ok = (labels[j] != labels[i]) & (whole * np.minimum(sizes[j], sizes[i]) >= part * np.maximum(sizes[j], sizes[i]))
            at, j = at[ok], j[ok]
            if not len(j):
                continue
            apart = np.bitwise_count((all_bits[at] ^ bits[k]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            both = sizes[j] + sizes[i]
            near = j[(whole + part) * ((both - apart) // 2) >= part * both]
            if before is not None and len(near) and len(mine_before := before[order[i]]):
                theirs = [before[order[x]] for x in near]
                met = np.isin(np.concatenate(theirs), mine_before)
                turn = np.repeat(np.arange(len(near)), [len(x) for x in theirs])
                near = near[np.bincount(turn[met], minlength=len(near)) == 0]
            if len(near):
                out.append(np.stack([np.minimum(ids[near], ids[i]), np.maximum(ids[near], ids[i])]))
    return out


def _near(part: int, whole: int):
    """a, b of the pairs in each block that may be linked, in the first region that both are in; rows of one block stand in a row."""
    def lists(column: pa.Array) -> list[np.ndarray]:
        ends = np.cumsum(column.value_lengths().to_numpy())
        return np.split(column.flatten().to_numpy(), ends[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, out = None, [], []

        def ended() -> list[np.ndarray]:
            if sum(len(h[0]) for h in held) < 2:
                return []
            ids, labels, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
            marks, before = ([x for h in held for x in h[i]] for i in (3, 4))
            return near_by_marks(ids, labels, sizes, marks, part, whole, before)

        def rows(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.concatenate(found, axis=1)
            return pa.record_batch({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

        for batch in batches:
            if not batch.num_rows:
                continue
            key, b, x, label, n = (batch.column(c).to_numpy() for c in ("block", "b", "x", "label", "n"))
            marks, regions = lists(batch.column("marks")), lists(batch.column("regions"))
            before = [r[r < own] for r, own in zip(regions, b)]
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for first, last in zip([0, *cuts], [*cuts, len(key)]):
                if key[first] != block:
                    out += ended()
                    block, held = key[first], []
                held.append((x[first:last], label[first:last], n[first:last], marks[first:last], before[first:last]))
            if out:
                yield rows(out)
                out = []
        out += ended()
        if out:
            yield rows(out)

    return run


def _regions(heads: DataFrame, part: int, whole: int) -> DataFrame:
    """b, x, n, left, members of the regions in which two members may be linked; of regions with the same members one is left."""
    sums = lambda *c: F.sum(F.xxhash64(*c).bitwiseAND(F.lit(_PART)))
    dealt = heads.repartition("s")  # counts and members come from one shuffle
    # Of a pair's regions the first in the order leaves at most the shingles from there on to share. A region of two that
    # could not be the first of a linked pair has nothing to do.
    counted = dealt.groupBy("s").agg(
        F.count(F.lit(1)).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("left").alias("least"),
        F.sum("n").alias("both"), sums("x").alias("s1"), sums(F.lit(7), "x").alias("s2")).where(
        (F.col("members") > 2) | (F.col("members") == 2) & (whole * F.col("low") >= part * F.col("high")) & (
            (whole + part) * F.col("least") >= part * F.col("both"))).select("s", "members", "s1", "s2")
    rows = stored(dealt.join(counted, "s"), "regions")
    one = rows.groupBy("members", "s1", "s2").agg(F.min("s").alias("s")).select("s")
    return stored(rows.join(one, "s").select(F.col("s").alias("b"), "x", "n", "left", "members"), "open")


def ngram_jaccard(documents: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links: whole * |x and y| >= part * |x or y|.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct runs of `width` words,
    or all words as one with fewer. Null, empty and blank texts have no shingles and no link. Equal texts, ties and
    repeated doc_ids are fine (rows of one id with different texts are linked only if their sets are; the id's component
    is then the smaller). Columns other than doc_id and text are not read; rows without doc_id take no part.
    """
    if 2 * part < whole:
        raise ValueError("a similarity below one half is not supported")
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    order = spark.sparkContext.broadcast(_order_table(docs, width))
    prints = stored(docs.mapInArrow(
        _prints(width, whole - part, whole, order),
        "doc_id long, n_shingles long, sum_a long, sum_b long, marks array<long>, head array<long>"), "prints")
    key = ["n_shingles", "sum_a", "sum_b"]
    classes = prints.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = stored(prints.select("doc_id", *key).join(classes, key, "left"), "members")
    reps = members.where("doc_id = rep").select("doc_id", "n_shingles").distinct()
    heads = prints.where("n_shingles > 0").join(reps, ["doc_id", "n_shingles"]).select(
        F.posexplode("head").alias("pos", "s"), F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"))
    heads = heads.select("s", "x", "n", (F.col("n") - F.col("pos")).alias("left"))
    regions = _regions(heads, part, whole)
    sets = _text_sets(width)
    # Each document with its text in the region of its first shared shingle.
    first = regions.groupBy("x").agg(F.max(F.struct("left", "b", "n")).alias("f")).select("x", "f.b", "f.n")
    size = first.groupBy("b").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    labels = near_pairs.components(stored(first.join(size, "b"), "first"), docs, sets, part, whole)
    # Everything else by bitmaps, then what may be linked by text: a document with those of larger ids.
    rest = stored(near_pairs.unconnected(near_pairs.labelled(regions.select("b", "x", "n"), labels)), "rest")
    own = rest.groupBy("x", "n").agg(F.collect_set("b").alias("regions"))  # as many as a head has shingles at most
    marks = prints.where("n_shingles > 0").select("doc_id", "n_shingles", "marks").join(reps, ["doc_id", "n_shingles"]).select(
        F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), "marks").join(own, ["x", "n"])
    met = near_pairs.in_pairs(rest, SMALL).join(marks, ["x", "n"]).select("block", "b", "x", "label", "n", "marks", "regions").repartition(
        "block").sortWithinPartitions("block")
    near = stored(stored(met.mapInArrow(_near(part, whole), "a long, b long"), "near").distinct(), "pairs")
    stars = near.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("members"))
    pairs = near.join(stars, "a").select(F.col("a").alias("b"), F.col("b").alias("x"), "members").unionAll(
        stars.select(F.col("a").alias("b"), F.col("a").alias("x"), "members")).join(
        reps.groupBy(F.col("doc_id").alias("x")).agg(F.max("n_shingles").alias("n")), "x")
    final = near_pairs.components(stored(pairs.select("b", "x", "n", "members"), "stars"), docs, sets, part, whole, labels)
    component = final.select(F.col("doc_id").alias("rep"), F.col("label").alias("component"))
    return members.join(component, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The documents whose id is their component's smallest; all columns stay. Rows without doc_id stay."""
    kept = ngram_jaccard(documents, width, part, whole).where("doc_id = component_id").select("doc_id").distinct()
    return documents.where("doc_id is null").unionByName(documents.join(kept, "doc_id", "left_semi").select(documents.columns))
