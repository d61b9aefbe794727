"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words. An item of m words is found where a window is within floor((1 - similarity) m) word
edits of it; its best end counts, so it may be longer or shorter than m by as many words. The walk of Chakraborty, Goldenberg and Koucky copies a sequence symbol by symbol and moves on or stays
by a random bit of the step and the symbol; sequences of small edit distance give outputs of small Hamming distance, so
a few sampled outputs agree often. Repetitions are added until a simulation with edits up to the limit, walked and
verified, reaches the target recall. Windows that hold too many words of no item cannot match and are not walked (exact); every agreement is
verified by banded dynamic programming, so nothing false is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladingcheck.llm import words as W

#: Items that are broadcast at once; more go over the documents in further passes.
ITEMS_AT_ONCE = 20_000
#: Items of a class differ in length by at most this ratio, so that one window length serves it.
CLASS_RATIO = 1.15
MOST_REPEATS = 96
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def edits_allowed(m: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor(np.asarray(m) * (1 - similarity) + 1e-9).astype(np.int64)


def sample_walk(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, repeat: int,
                seen: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Walks over text[start:end] (beyond the end: no symbol): which starts are left, one number each for their outputs at
    `places`, and the sorted distinct outputs of each place. With `seen`, starts whose output is not in it are given up."""
    at, left, key, symbols = starts.copy(), np.arange(len(starts)), np.zeros(len(starts), np.uint64), []
    text, ends = np.append(text, np.uint64(0)), ends.copy()
    for step in range(int(places[-1]) + 1):
        inside = at < ends
        symbol = text[np.where(inside, at, len(text) - 1)]
        if step in places:
            if seen is not None:
                known = seen[len(symbols)]
                stays = np.flatnonzero(known[np.searchsorted(known[:-1], symbol)] == symbol)
                at, ends, left, key, symbol, inside = (x[stays] for x in (at, ends, left, key, symbol, inside))
            key = W.mix(key ^ (symbol + np.uint64(step)))
            symbols.append(np.unique(symbol))
        # The top bit of a product is coin enough: symbols are hashes, and the factor depends on step and repetition.
        coin = (symbol * np.uint64((repeat * 8198 + 2 * step + 1) * int(_GOLD) & (1 << 64) - 1)) >> np.uint64(63)
        at += coin.astype(np.int64) & inside
    return left, key, symbols


@dataclass
class ItemClass:
    """Items of similar length: `least` words are walked."""
    items: np.ndarray
    least: int
    known: np.ndarray  # sorted words of the items
    walks: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]  # places, sorted keys, items in that order, outputs


class Items:
    """Word hashes of the items one after the other, and the walks of each class."""

    def __init__(self, ids: np.ndarray, texts: list[str | None], similarity: float, recall: float, seed: int):
        self.similarity = similarity
        parts = []
        self.length = np.zeros(len(ids), np.int64)
        done = 0
        for _, rows, data, offsets in W.pieces(pa.array(texts, pa.string())):
            starts, ends, counts = W.words(data, offsets, W.PUNCTUATION)
            parts.append(W.word_hashes(data, starts, ends))
            self.length[done:done + rows] = counts
            done += rows
        self.ids, self.words = ids, np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.allowed = edits_allowed(self.length, similarity)
        self.known = np.unique(self.words)
        rng = np.random.default_rng(seed)
        self.classes: list[ItemClass] = []
        order = np.argsort(self.length, kind="stable")
        order = order[self.length[order] > 0]
        while len(order):
            least = int(self.length[order[0]])
            n = int(np.searchsorted(self.length[order], max(least, int(least * CLASS_RATIO)), "right"))
            self.classes.append(self._class(order[:n], least, recall, rng))
            order = order[n:]

    def _class(self, items: np.ndarray, least: int, recall: float, rng: np.random.Generator) -> ItemClass:
        """Repetitions until a simulated share `recall` of edited items is caught and found within the limit."""
        copies = np.resize(items, max(64, min(400, 2 * len(items))))
        text, starts, ends = [], [], []
        at = 0
        for item in copies:
            own = self.words[self.start[item]:self.start[item] + self.length[item]].tolist()
            for _ in range(int(self.allowed[item])):
                i, kind = int(rng.integers(0, len(own) + 1)), int(rng.integers(0, 3))
                new = [int(rng.integers(0, 1 << 63))]
                own[i:i + (kind != 1)] = new if kind < 2 else []
            starts.append(at)
            at += len(own)
            ends.append(min(at, starts[-1] + least))
            text += own
        text_, starts_, ends_ = np.array(text or [0], np.uint64), np.array(starts, np.int64), np.array(ends, np.int64)
        item_starts = self.start[items]
        item_ends = np.minimum(item_starts + self.length[items], item_starts + least)
        known = np.unique(np.concatenate([self.words[a:a + n] for a, n in zip(item_starts, self.length[items])]))
        whole_ends, fits = np.append(starts_[1:], at), np.zeros(len(copies), bool)
        for item in np.unique(copies):
            mine = np.flatnonzero(copies == item)
            fits[mine] = self.distances(text_, starts_[mine], whole_ends[mine], int(item), any_end=True) <= self.allowed[item]
        for samples in (3, 2, 1):
            walks, caught = [], np.zeros(len(copies), bool)
            for repeat in range(MOST_REPEATS):
                places = np.sort(rng.choice(max(samples, 2 * least), samples, replace=False))
                _, key, seen = sample_walk(self.words, item_starts, item_ends, places, repeat)
                caught |= sample_walk(text_, starts_, ends_, places, repeat)[1] == np.resize(key, len(copies))
                by = np.argsort(key, kind="stable")
                walks.append((places, key[by], items[by], seen))
                if (caught & fits).mean() >= recall:
                    return ItemClass(items, least, known, walks)
        return ItemClass(items, least, known, walks)

    def candidates(self, text: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item) pairs whose walks agree, for documents text[first:first + count]."""
        if not len(text) or not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.known, text), len(self.known) - 1)
        right = self.known[place] == text
        ends = np.repeat(first + counts, counts)
        found = []
        for c in self.classes:
            allowed = int(self.allowed[c.items].max())
            is_known = np.isin(self.known, c.known, assume_unique=True)[place] & right
            known, at = np.concatenate([[0], np.cumsum(is_known)]), np.arange(len(text))
            stop = np.minimum(at + c.least, ends)
            enough = known[stop] - known[at] >= c.least - allowed
            at = np.flatnonzero(enough)
            if not len(at):
                continue
            stop, hits = stop[at], []
            for repeat, (places, keys, items, seen) in enumerate(c.walks):
                left, key, _ = sample_walk(text, at, stop, places, repeat, seen)
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                some = np.flatnonzero(high > low)
                if len(some):
                    n = high[some] - low[some]
                    pick = np.repeat(low[some] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
                    hits.append(np.stack([np.repeat(at[left[some]], n), items[pick]]))
            if hits:
                found.append(np.unique(np.concatenate(hits, axis=1), axis=1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.concatenate(found, axis=1)
        return both[0], both[1]

    def equal(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray) -> np.ndarray:
        out = self.length[item] <= ends - starts
        for one in np.unique(item[out]):
            mine = np.flatnonzero(out & (item == one))
            m = int(self.length[one])
            own = self.words[self.start[one]:self.start[one] + m]
            mine, rest = mine[text[starts[mine]] == own[0]], mine[text[starts[mine]] != own[0]]
            out[rest] = False
            out[mine] = (text[starts[mine, None] + np.arange(m)] == own).all(axis=1)
        return out

    def distances(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: int, any_end: bool = False) -> np.ndarray:
        """Word edit distance of text[start:min(start + m, end)] to the item, or more than allowed.

        With any_end the least of all windows from the start that end within the document: those of m - allowed to
        m + allowed words, as others are farther.
        """
        m, most = int(self.length[item]), int(self.allowed[item])
        own = self.words[self.start[item]:self.start[item] + m]
        wide = m + most if any_end else m
        size = np.minimum(wide, ends - starts)
        out = np.full(len(starts), most + 1, np.int64)
        at = np.minimum(starts + np.arange(wide)[:, None], len(text) - 1)
        window = np.where(np.arange(wide)[:, None] < size, text[at], ~np.uint64(0))  # a row for each place
        # All but the allowed words of the item must be there.
        near = np.flatnonzero(np.isin(window, own).sum(axis=0) >= m - most)
        window, size = window[:, near], size[near]
        far = most + 1
        row = np.repeat(np.minimum(np.arange(wide + 1), far)[:, None], len(near), axis=1)
        for i in range(1, m + 1 if len(near) else 1):
            new = np.full_like(row, far)
            if i <= most:
                new[0] = i
            low, high = max(1, i - most), min(wide, i + most)
            swapped = row[low - 1:high] + (window[low - 1:high] != own[i - 1])
            np.minimum(swapped, row[low:high + 1] + 1, out=swapped)
            for j in range(low, high + 1):
                np.minimum(swapped[j - low], new[j - 1] + 1, out=new[j])
            row = new
        last = np.where(np.arange(wide + 1)[:, None] <= size, row, far).min(axis=0) if any_end else row[size, np.arange(len(near))]
        out[near] = np.minimum(last, far)
        return out


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        for batch in batches:
            for first_row, rows, data, offsets in W.pieces(batch.column("text")):
                starts, ends, counts = W.words(data, offsets, W.PUNCTUATION)
                text = W.word_hashes(data, starts, ends)
                first = np.concatenate([[0], np.cumsum(counts)])[:-1]
                at, item = items.candidates(text, first, counts)
                if not len(at):
                    continue
                doc = np.searchsorted(first + counts, at, "right")
                distance = np.zeros(len(at), np.int64)
                same = items.equal(text, at, (first + counts)[doc], item)
                # Where an item stands unchanged no other window of the document is better.
                done = np.isin(doc * len(items.ids) + item, (doc * len(items.ids) + item)[same])
                at, item, doc, distance, same = (x[same | ~done] for x in (at, item, doc, distance, same))
                for one in np.unique(item[~same]):
                    mine = np.flatnonzero((item == one) & ~same)
                    distance[mine] = items.distances(text, at[mine], (first + counts)[doc[mine]], int(one), any_end=True)
                fits = distance <= items.allowed[item]
                at, item, doc, distance = at[fits], item[fits], doc[fits], distance[fits]
                order = np.lexsort((at, distance, item, doc))
                lead = np.ones(len(order), bool)
                lead[1:] = (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)
                best = order[lead]
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").take(pa.array(first_row + doc[best])),
                    "item_id": pa.array(items.ids[item[best]]), "start_word": pa.array(at[best] - first[doc[best]]),
                    "distance": pa.array(distance[best]), "item_words": pa.array(items.length[item[best]])})

    return run


def leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, seed: int = 11) -> DataFrame:
    """doc_id, item_id, start_word, distance, item_words: the best window of each document for each item that it holds.

    Words are runs of ASCII letters (lower-cased), digits and everything beyond ASCII. Ties go to the first window. Items and documents without words hold nothing; items of fewer than
    1 / (1 - similarity) words match only exactly. Null ids take no part. Repeated rows answer by row (items: once).
    Found pairs are exact; a pair with edits is missed with a probability of at most about 1 - recall, one without never.
    """
    spark = documents.sparkSession
    rows = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    passes = max(1, -(-rows.count() // ITEMS_AT_ONCE))
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for k in range(passes):
        part = sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect())
        items = Items(np.array([r[0] for r in part], np.int64), [r[1] for r in part], similarity, recall, seed)
        found = docs.mapInArrow(_finder(spark.sparkContext.broadcast(items)),
                                "doc_id long, item_id long, start_word long, distance long, item_words long")
        out = found if out is None else out.unionAll(found)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """The documents that hold no item; all columns stay. Rows without doc_id stay."""
    gone = leaks(documents, benchmark, similarity, recall).select("doc_id").distinct()
    return documents.where("doc_id is null").unionByName(
        documents.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(documents.columns))
