"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes is counted on a bounded sample and frozen. A byte costs
-log2(count / (total + kinds)) in the longest context that has seen it; each longer context that was seen, but not with
this byte, costs an escape of -log2(kinds / (total + kinds)) first; a byte that no context knows costs eight bits more.
A text gets the language with the shortest code, in exact whole units of 2^-16 bit over the whole text.

The trees become one table per order: for every context and byte seen in any language the code in all languages, so a
position mostly takes one look-up. Sampled documents bound the tables and so what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladingcheck.llm import words as W
from ladingcheck.llm.shared import quoted

ORDER = 4
UNIT = 1 << 16
#: Documents of each language that the trees are counted on, about; chosen by the hash of their id.
SAMPLE_DOCS = 300
#: Codes longer than this many bits a byte are no text of a learnt language (the pipeline's stage rejects them).
MOST_BITS = 7.0
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _keys(data: np.ndarray, offsets: np.ndarray, longest: int) -> np.ndarray:
    """For each byte the `longest` bytes that end there, as a number; before a text stand zero bytes."""
    out = np.zeros(len(data), np.uint64)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(longest - 1, -1, -1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[back:] = data[:len(data) - back]
        if back:
            shifted[at < back] = 0
        out = (out << np.uint64(8)) | shifted
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, rows, data, offsets in W.pieces(batch.column("text")):
            keys = _keys(data, offsets, ORDER + 1)
            row = np.repeat(np.arange(rows), np.diff(offsets))
            own = np.array(langs[first:first + rows])
            for lang in sorted(set(langs[first:first + rows])):
                mine = keys[(own == lang)[row]]
                for order in range(ORDER + 1):
                    key, n = np.unique(mine & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(key)), "k": pa.array(np.full(len(key), order, np.int32)),
                                           "key": pa.array(key.view(np.int64)), "n": pa.array(n.astype(np.int64))})


class Table:
    """Rows by number key: open addressing over arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(4 * len(keys) + 1).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]  # of several the last stays
            stays = self.slots[place] == left
            left, place = left[~stays], (place[~stays] + 1) & (len(self.slots) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if unknown."""
        place = self._place(keys)
        out = self.slots[place]
        if not len(self.keys):
            return out
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(left):
            place[left] = (place[left] + 1) & (len(self.slots) - 1)
            out[left] = self.slots[place[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != keys[left])]
        return out


class Model:
    """Frozen trees of all languages. counts: one (lang number, order, key, n) column each."""

    def __init__(self, langs: list[str], lang: np.ndarray, order: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.symbols: list[tuple[Table, np.ndarray]] = []
        self.escapes: list[tuple[Table, np.ndarray]] = []
        size = len(langs)
        shorter = np.full((1, size), 8 * UNIT, np.int64)
        for k in range(ORDER + 1):
            at = order == k
            keys, row = np.unique(key[at], return_inverse=True)
            count = np.zeros((len(keys), size), np.int64)
            count[row, lang[at]] = n[at]
            contexts, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), size), np.int64), np.zeros((len(contexts), size), np.int64)
            np.add.at(total, owner, count)
            np.add.at(kinds, owner, count > 0)
            seen = total > 0
            escape = np.where(seen, np.rint(-UNIT * np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1))), 0).astype(np.int64)
            if k:
                below = shorter[self.symbols[-1][0].find(keys & np.uint64((1 << 8 * k) - 1))]
            else:
                below = np.repeat(shorter, len(keys), axis=0)
            own = np.rint(-UNIT * np.log2(np.maximum(count, 1) / np.maximum(total + kinds, 1)[owner])).astype(np.int64)
            shorter = np.where(count > 0, own, escape[owner] + below)
            self.symbols.append((Table(keys), shorter.astype(np.int32)))
            self.escapes.append((Table(contexts), escape.astype(np.int32)))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in units."""
        keys = _keys(data, offsets, ORDER + 1)
        codes = np.zeros((len(data), len(self.langs)), np.int32)
        open_ = np.arange(len(data))
        for k in range(ORDER, -1, -1):
            own = keys[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            table, cost = self.symbols[k]
            row = table.find(own)
            known = row >= 0
            if k == ORDER:
                np.take(cost, np.maximum(row, 0), axis=0, out=codes)
                codes[~known] = 0
            else:
                codes[open_[known]] += cost[row[known]]
            open_, own = open_[~known], own[~known]
            if not len(open_):
                break
            table, cost = self.escapes[k]
            row = table.find(own >> np.uint64(8))
            known = row >= 0
            codes[open_[known]] += cost[row[known]]
        codes[open_] += 8 * UNIT
        sums = np.zeros((len(data) + 1, len(self.langs)), np.int64)
        np.cumsum(codes, axis=0, dtype=np.int64, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def learn(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """The model of the labelled documents that are not held out; None without any."""
    crc = F.crc32(F.col("doc_id").cast("string")) % 4
    labelled = documents.where("doc_id is not null and text is not null and lang is not null").where(crc != 2).select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    limit = F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items()) for v in (
        lang, (1 << 20) if n <= sample_docs else max(1, (1 << 20) * sample_docs // n))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit[F.col("lang")])
    counts = sample.select("lang", "text").mapInArrow(_counted, "lang string, k int, key long, n long").groupBy(
        "lang", "k", "key").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    number = {x: i for i, x in enumerate(langs)}
    return Model(langs, np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64), counts.column("k").to_numpy(),
                 counts.column("key").to_numpy().view(np.uint64), counts.column("n").to_numpy())


def _identifier(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = sent.value
        for batch in batches:
            n = batch.num_rows
            letters = np.array(batch.column("letters").to_numpy(zero_copy_only=False), bool)
            langs, scores, bits = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            if model is not None:
                for first, rows, data, offsets in W.pieces(batch.column("text"), 1 << 20):
                    lengths = model.lengths(data, offsets)
                    best = lengths.argmin(axis=1)
                    more = (lengths - lengths.min(axis=1, keepdims=True)) / UNIT
                    mine = np.flatnonzero(letters[first:first + rows])
                    langs[first + mine] = np.array(model.langs, object)[best[mine]]
                    scores[first + mine] = (1 / np.exp2(-np.minimum(more, 1000)).sum(axis=1))[mine]
                    bits[first + mine] = (lengths.min(axis=1) / UNIT / np.maximum(1, np.diff(offsets)))[mine]
            yield pa.record_batch({"row": batch.column("row"), "lang_pred": pa.array(langs, pa.string()),
                                   "score": pa.array(scores), "bits": pa.array(bits)})

    return run


def identify(documents: DataFrame, carry: list[str] | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The columns `carry` (default: all) with lang_pred, score, bits (per byte) of every row.

    Null texts and texts without a letter are `und` with score 0, and so is all if nothing is labelled. Equal codes go to
    the first language by name. The score is the language's share of 2^-length over all languages. Rows of no label, no
    doc_id or held-out ids are predicted like all others; columns named like a result are replaced.
    """
    new = ["lang_pred", "score", "bits"]
    carry = [c for c in (documents.columns if carry is None else carry) if c.lower() not in new]
    sent = documents.sparkSession.sparkContext.broadcast(learn(documents, sample_docs))
    # The carried columns travel in a struct, so none of them can clash with a name used here.
    rows = documents.select(F.struct(*quoted(carry)).alias("row"), "text", F.coalesce(
        F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    row = T.StructType([T.StructField(c, documents.schema[c].dataType) for c in carry])
    out = T.StructType().add("row", row).add("lang_pred", "string").add("score", "double").add("bits", "double")
    found = rows.mapInArrow(_identifier(sent), out)
    return found.select(*[F.col("row").getField(c).alias(c) for c in carry], *new)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def in_a_known_language(documents: DataFrame) -> DataFrame:
    """The documents whose text is in a learnt language: not `und`, and coded with at most MOST_BITS a byte."""
    found = identify(documents).where(F.col("lang_pred") != "und").where(F.col("bits") <= MOST_BITS)
    return found.select(*quoted(documents.columns))
