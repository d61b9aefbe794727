"""Near-duplicate groups by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidates.

One permutation: every shingle is hashed once; the range of hashes is cut into BINS bins of equal width, and a bin's value
is the smallest hash in it. Sorted hashes run through the bins in order, so a set is sorted once and looked up at the bins'
edges. Optimal densification: an empty bin takes the value of a full one, the first full one in a pseudo-random order of
its own that is the same for all documents, so bins stay as independent as full ones. BANDS bands of ROWS bins are hashed to
bucket numbers; documents of similarity 0.85 share no bucket with probability (1 - 0.85^ROWS)^BANDS = 2.6e-7 (0.8: 6e-5).

The members of a bucket are compared on full sets in blocks of bounded size (`near_pairs`): what links have connected is not
compared again, and members that hold too much that nobody else in the buckets holds go by an exact bound. Every pair that
the buckets propose is compared, connected or excluded; only then is anything left out.

Equal sets are one class from the start: exact copies make no rows in buckets.
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

BANDS = 32
ROWS = 6
BINS = BANDS * ROWS
#: At most this many classes hold more than one part in HEAVY of all rows each; those are broadcast.
HEAVY = 10_000
#: Lower bits of the two hashes whose sums stand for a bucket's members; sums of 2^27 members stay within 63 bits.
_PART = (1 << 36) - 1
_ROW_KEYS = W.mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BAND_KEYS = W.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: Lowest hash of each bin and one past the last.
_EDGES = np.array([-(-(i << 64) // BINS) for i in range(BINS)], np.uint64)


def _turns() -> np.ndarray:
    """For each bin the turn at which it asks each other bin for a value: a pseudo-random order per bin."""
    keys = W.mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(BINS, BINS)
    return keys.argsort(axis=1).argsort(axis=1).astype(np.int16)


_TURNS = _turns()


def signature(own: np.ndarray) -> np.ndarray:
    """The BINS values of a set of sorted distinct hashes (not empty)."""
    at = np.searchsorted(own, _EDGES)
    full = np.diff(np.append(at, len(own))) > 0
    values = own[np.minimum(at, len(own) - 1)]
    if not full.all():
        givers = np.flatnonzero(full)
        empty = np.flatnonzero(~full)
        values[empty] = values[givers[_TURNS[np.ix_(empty, givers)].argmin(axis=1)]]
    return values


def buckets(own: np.ndarray) -> np.ndarray:
    """The bucket number of each band."""
    return W.mix(W.mix(signature(own).reshape(BANDS, ROWS) + _ROW_KEYS).sum(axis=1) + _BAND_KEYS)


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    starts, ends, counts = W.words(data, offsets, W.SPACE)
    hashes, n = W.shingles(W.word_hashes(data, starts, ends), counts, width)
    stops = np.cumsum(n)
    return [np.unique(hashes[b - k:b]) for b, k in zip(stops, n)]


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, data, offsets in W.pieces(batch.column("text")):
                sets = _sets(data, offsets, width)
                bands = [buckets(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])])
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(first, rows),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "sum_a": pa.array(np.array([W.mix(s).sum() for s in sets], np.uint64).view(np.int64)),
                    "sum_b": pa.array(np.array([W.mix(~s).sum() for s in sets], np.uint64).view(np.int64)),
                    "buckets": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands)))})

    return run


def _text_sets(width: int) -> near_pairs.Sets:
    return lambda texts: [s for _, _, data, offsets in W.pieces(texts) for s in _sets(data, offsets, width)]


def _members(classes: DataFrame) -> DataFrame:
    """b, x, n, members: members of all buckets of two or more; of buckets with the same members one is left."""
    rows = classes.select(F.explode("buckets").alias("b"), F.col("rep").alias("x"), F.col("n_shingles").alias("n"))
    part = lambda *c: F.sum(F.xxhash64(*c).bitwiseAND(F.lit(_PART)))
    sums = rows.groupBy("b").agg(F.count(F.lit(1)).alias("members"), part("x").alias("s1"), part(F.lit(7), "x").alias("s2"))
    one = sums.where("members > 1").groupBy("members", "s1", "s2").agg(F.min("b").alias("b")).select("b", "members")
    return stored(rows.join(one, "b"), "buckets")


def _of_classes(rows: DataFrame, classes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the columns of their class. Classes of many copies are broadcast: HEAVY of them at most."""
    most = max(1000, total // HEAVY)
    found = rows.join(F.broadcast(classes.where(F.col("copies") > most).select(
        *keys, F.col("component").alias("heavy"))), keys, "left")
    rest = found.where("heavy is null").drop("heavy").join(classes.where(F.col("copies") <= most).select(*keys, "component"), keys)
    return found.where("heavy is not null").withColumnRenamed("heavy", "component").unionByName(rest)


def near_duplicates(documents: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links: whole * |x and y| >= part * |x or y|.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct runs of `width` words, or all
    words as one with fewer. component_id is the smallest doc_id that links reach, kept says that it is the document's own.
    Null, empty and blank texts have no shingles and no link. Repeated rows and equal texts get one component; where a doc_id
    stands for several texts, each row gets the component of its own. Columns other than doc_id and text are not read; rows
    without doc_id take no part. An empty table gives an empty result.
    """
    if not 0 < part <= whole or 2 * part < whole:
        raise ValueError("a similarity from one half to one is supported")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sketches = stored(docs.mapInArrow(
        _sketches(width), "doc_id long, n_shingles long, sum_a long, sum_b long, buckets array<long>"), "sketches")
    keys = ["n_shingles", "sum_a", "sum_b"]
    some = sketches.where("n_shingles > 0")
    classes = stored(some.groupBy(*keys).agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("buckets").alias("buckets")), "classes")
    labels = near_pairs.components(_members(classes), docs, _text_sets(width), part, whole).select(
        F.col("doc_id").alias("component"), "label")
    named = classes.select(*keys, "copies", F.col("rep").alias("component")).join(labels, "component", "left").withColumn(
        "component", F.coalesce("label", "component")).drop("label")
    named = stored(named, "components")
    found = _of_classes(some.select("doc_id", *keys), named, keys, sketches.count())
    out = found.select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionAll(
        sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
