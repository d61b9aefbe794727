"""Maximal periodic runs of words by string synchronising sets, and texts with the repeats collapsed.

A run is a stretch with smallest period q (words q apart are equal) of at least 2q words that no neighbour extends. The words
of many documents make one sequence, with a word of its own between documents, so no run crosses them and every step
is an array operation.

* Scale t (a power of two) proposes periods from 3t to below 6t. The synchronising set of the scale holds position i if the
  smallest hash among the windows of t words that start at i to i + t is that of the first or the last of them. Windows
  with a period of at most t/3 have no hash. Membership of i depends on the words i to i + 2t - 1 alone, so positions of a
  run agree with those one period on: pairs of members with equal hashes of these 2t words propose their distance. A run has
  q - 2t + 1 > t positions whose partner's 2t words are in the run; a stretch of t positions has a member unless its
  3t - 1 words have a period of at most t/3. Members are about 2/t of all positions and equal hashes at least t/3 apart, so a
  member meets a bounded number of others within reach.
* Hence a run is not proposed only if its first q words all have one small period p, and then its second q words have it too:
  they lie in two p-runs that touch. Periods below SMALL come from comparing words SMALL apart at most; runs of smaller
  periods, found at smaller scales, are the highly periodic regions, and two of equal period that touch propose all
  distances at which one continues the other.

Every proposed pair is extended to both sides by comparing words themselves (numbers that stand for distinct words),
so hashes decide only what is proposed, alike at equal contexts: the result is exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ladingcheck.llm.words import mix

#: Least words of a reported run.
LEAST = 12
#: Periods below this are found by comparing each word with the one a period on.
SMALL = 6
#: Words that are worked on at once; a longer document is a piece of its own.
PIECE_WORDS = 1 << 18
#: Equal words in a row after which an extension doubles its step.
_STEP = 64
_NONE = np.uint64(2**64 - 1)


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every i that has so many: from blocks of this width, forwards and backwards."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, _NONE)
    padded[:len(x)] = x
    ahead = np.minimum.accumulate(padded.reshape(blocks, width), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def synchronising_set(hashes: np.ndarray, t: int) -> np.ndarray:
    """Positions of the set at scale t; hashes are those of windows of t words, _NONE where the window is highly periodic."""
    if len(hashes) <= t:
        return np.zeros(0, np.int64)
    least = _window_minima(hashes, t + 1)
    return np.flatnonzero((least != _NONE) & ((least == hashes[:len(least)]) | (least == hashes[t:t + len(least)])))


class _Found:
    """Runs of one sequence by (start, end), each with its smallest period."""

    def __init__(self, words: np.ndarray):
        self.words, self.by_span, self.by_period = words, {}, {}

    def add(self, start: int, end: int, q: int) -> None:
        if end - start >= 2 * q and self.by_span.setdefault((start, end), q) == q:
            self.by_period.setdefault(q, {})[start] = end

    def _equal(self, i: int, j: int, way: int) -> int:
        """Words from i and j on that are equal, forwards (way 1) or backwards from those before i and j (way -1)."""
        total, step, words = 0, _STEP, self.words
        while True:
            if way > 0:
                n = min(step, len(words) - j)
                differ = words[i:i + n] != words[j:j + n]
            else:
                n = min(step, i)
                differ = (words[i - n:i] != words[j - n:j])[::-1]
            if n <= 0:
                return total
            first = int(differ.argmax())
            if differ[first]:
                return total + first
            total, i, j, step = total + n, i + way * n, j + way * n, step * 2

    def propose(self, i: int, q: int) -> None:
        """The run of period q, if there is one, that holds positions i and i + q as equal words."""
        back, ahead = self._equal(i, i + q, -1), self._equal(i, i + q, 1)
        if back + ahead >= q:
            self.add(i - back, i + q + ahead, q)


def _small_periods(found: _Found) -> None:
    words = found.words
    for q in range(1, min(SMALL, len(words))):
        same = np.concatenate([[False], words[:-q] == words[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2]
        for a, b in zip(*(x[ends - starts >= q].tolist() for x in (starts, ends))):
            found.add(a, b + q, q)


def _pairs(found: _Found, hashes: np.ndarray, contexts: np.ndarray, t: int) -> None:
    at = synchronising_set(hashes, t)
    at = at[at < len(contexts)]
    context, k = contexts[at], 0
    seen: dict[int, int] = {}
    proposed: list[tuple[int, int]] = []
    while True:
        k += 1
        apart = at[k:] - at[:-k] if k < len(at) else np.zeros(0, np.int64)
        if not (apart < 6 * t).any():
            break
        hit = np.flatnonzero((apart >= 3 * t) & (apart < 6 * t) & (context[k:] == context[:-k]))
        proposed += zip(at[hit].tolist(), apart[hit].tolist())
    for i, q in sorted(proposed):
        # Positions inside the run that this period gave last are its own.
        if seen.get(q, -1) <= i:
            found.propose(i, q)
            runs = found.by_period.get(q)
            last = next(reversed(runs)) if runs else -1
            seen[q] = runs[last] - q if runs and last <= i < runs[last] - q else i + 1


def _touching(found: _Found, p: int) -> None:
    """Runs between two p-runs that touch: distances q, equal modulo p, at which words of one continue the other."""
    words, runs = found.words, sorted((a, b) for a, b in found.by_period[p].items() if b - a >= 2 * p + 1)
    for (a1, e1), (a2, e2) in zip(runs, runs[1:]):
        if a2 > e1:
            continue
        root, other = np.tile(words[a1:a1 + p], 2), words[a2:a2 + p]
        turns = [c for c in np.flatnonzero(root[:p] == other[0]) if (root[c:c + p] == other).all()]
        if not turns:
            continue
        first = (a2 - a1 - int(turns[0])) % p
        for q in range(first + p if first == 0 else first, min(e1 - a1, e2 - a2) + 1, p):
            low, high = max(a1, a2 - q), min(e1, e2 - q)
            if q > p and high - low >= q:
                found.propose(low, q)


def runs(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs; documents of `lengths` words, longest first, each followed by a word of its own."""
    found = _Found(words)
    _small_periods(found)
    touched, t = set(), 2
    ends = np.cumsum(lengths + 1)
    hashes = mix(words.astype(np.uint64) + np.uint64(1))
    hashes = mix(hashes[:-1] * np.uint64(3) + mix(hashes[1:] + np.uint64(11))) if len(hashes) > 1 else hashes[:0]
    while True:
        # Documents that can hold a run of this scale's periods; the others come after them.
        able = int(np.searchsorted(-lengths, -max(LEAST, 6 * t), "right"))
        if not able:
            break
        n = int(ends[able - 1])
        hashes = hashes[:n - t + 1]
        if len(hashes) <= t:
            break
        contexts = mix(hashes[:-t] * np.uint64(3) + mix(hashes[t:] + np.uint64(11)))
        free = hashes.copy()
        for p, own in found.by_period.items():
            if 3 * p <= t:
                for a, b in own.items():
                    if b - a >= t:
                        free[a:max(a, b - t + 1)] = _NONE
        _pairs(found, free, contexts, t)
        for p in sorted(found.by_period):
            if p not in touched and 9 * p <= 6 * t:
                touched.add(p)
                _touching(found, p)
        hashes, t = contexts, 2 * t
    return [(a, b, q) for (a, b), q in found.by_span.items() if b - a >= max(LEAST, 2 * q)]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """For one document in ten, by its id, words from a place on repeat a stretch of their own."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _row(doc_id, words: list[bytes], own: list[tuple[int, int, int]]) -> dict:
    kept = words
    if own:
        gone = np.zeros(len(words), bool)
        for a, b, q in own:
            gone[a + q:b] = True
        kept = [words[i] for i in np.flatnonzero(~gone)]
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(own, key=lambda r: (r[0], r[2])))
    best = min(own, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return {"doc_id": doc_id, "n_runs": len(own), **dict(zip(("start", "length", "period", "exponent_milli"), longest)),
            "runs": [{"start": a, "length": b - a, "period": q} for a, b, q in sorted(own, key=lambda r: (r[0], r[2]))],
            "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed": kept}


def _piece(ids: list, texts: list[list[bytes]]) -> list[dict]:
    """Rows of documents, given as words."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = {}
    parts = []
    for k, i in enumerate(order):
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in texts[i]), np.int64, len(texts[i])))
        parts.append(np.array([-1 - k], np.int64))  # a word that stands nowhere else
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    firsts = np.concatenate([[0], np.cumsum(lengths + 1)])
    own: dict[int, list[tuple[int, int, int]]] = {}
    for a, b, q in runs(np.concatenate(parts), lengths):
        k = int(np.searchsorted(firsts, a, "right")) - 1
        own.setdefault(order[k], []).append((a - int(firsts[k]), b - int(firsts[k]), q))
    return [_row(d, w, own.get(i, [])) for i, (d, w) in enumerate(zip(ids, texts))]


RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def _out(rows: list[dict], whole: bool) -> pa.RecordBatch:
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    out = {"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()),
           **{c: pa.array([r[c] for r in rows], pa.int64()) for c in longs},
           "runs_sha256": pa.array([r["runs_sha256"] for r in rows], pa.string()),
           "collapsed_sha256": pa.array([hashlib.sha256(b" ".join(r["collapsed"])).hexdigest() for r in rows], pa.string())}
    if whole:
        out["runs"] = pa.array([r["runs"] for r in rows], pa.list_(RUN))
        out["collapsed"] = pa.array([b" ".join(r["collapsed"]).decode() for r in rows], pa.string())
    return pa.record_batch(out)


def _batches(plant: bool, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                # Bytes split at ASCII white space, which is the contract's set.
                words = (text.as_py() or "").encode().split()
                doc_id = doc_id.as_py()
                ids.append(doc_id)
                texts.append(planted(words, doc_id) if plant else words)
                n += len(words)
                if n >= PIECE_WORDS:
                    yield _out(_piece(ids, texts), whole)
                    ids, texts, n = [], [], 0
        if ids:
            yield _out(_piece(ids, texts), whole)

    return run


def periodic_runs(documents: DataFrame, plant: bool = False, whole: bool = True) -> DataFrame:
    """One row per row of documents: doc_id, n_runs, the longest run, digests, and (whole) all runs and the collapsed text.

    Words are runs of anything but ASCII white space. The longest run is that of greatest length, then smallest start, then
    smallest period; without a run its columns are null. The collapsed text lacks the words that a run holds after its first
    period, and joins the others by a blank. Null, empty and blank texts have no words, no run and an empty collapsed text.
    Repeated rows and ids are rows of their own, and rows without doc_id stay. Columns other than doc_id and text are not
    read. plant: words are first replaced as planted() says, to have runs that are known.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if whole:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    docs = documents.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    return docs.mapInArrow(_batches(plant, whole), schema)
