"""Periodic runs against all stretches of all periods: random, Fibonacci and Thue-Morse words, repeats of repeats, documents."""

import hashlib
import random
import re

import numpy as np

from ladingcheck.llm import periodic_runs


def brute(words, least):
    """(start, end, smallest period) of all maximal stretches."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= max(q, least - q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def sequence(rng):
    k, kind, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.random(), rng.randrange(0, 220)
    if kind < 0.3:
        return [rng.randrange(k) for _ in range(n)]
    if kind < 0.45:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind < 0.55:
        return [i.bit_count() % 2 for i in range(n)]
    out = []
    while len(out) < n:
        base = [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.4 and out:
            base = out[-rng.randrange(1, min(len(out), 90) + 1):]
        out += base * rng.randrange(1, 6)
        if rng.random() < 0.3:
            out.append(rng.randrange(k))
    return out[:rng.randrange(1, 400)]


def test_all_runs_of_many_sequences(monkeypatch):
    rng = random.Random(2)
    for least in (1, 12):
        monkeypatch.setattr(periodic_runs, "LEAST", least)
        for _ in range(300):
            docs = sorted((sequence(rng) for _ in range(rng.randrange(1, 4))), key=len, reverse=True)
            words = np.concatenate([np.array([*d, -1 - i], np.int64) for i, d in enumerate(docs)])
            want, at = [], 0
            for d in docs:
                want += [(a + at, b + at, q) for a, b, q in brute(d, least)]
                at += len(d) + 1
            assert sorted(periodic_runs.runs(words, np.array([len(d) for d in docs]))) == sorted(want)


def test_touching_regions_of_a_small_period():
    """(u^k u')(u^k u') with u' a part of u: the first period has a small period all over."""
    for p in (1, 2, 3, 5):
        u = list(range(p))
        for k in (9, 20, 40):
            for rest in range(1, p + 1):
                one = u * k + (u[:rest] if rest < p else [77])
                for words in (one * 2, [99, *one, *one, 98], one * 3):
                    assert sorted(w for w in periodic_runs.runs(np.array([*words, -1]), np.array([len(words)]))) == brute(words, 12)


def test_synchronising_set_is_consistent_and_dense():
    rng, t = np.random.default_rng(5), 8
    words = rng.integers(0, 3, 3000)
    words[1000:1400] = words[200:600]
    hashes = np.array([hash(words[i:i + t].tobytes()) & 2**63 - 1 for i in range(len(words) - t + 1)], np.uint64)
    at = set(periodic_runs.synchronising_set(hashes, t).tolist())
    assert {i for i in at if 200 <= i <= 600 - 2 * t} == {i - 800 for i in at if 1000 <= i <= 1400 - 2 * t}
    assert max(np.diff(sorted(at))) <= t and len(at) < 4 * len(words) / t


def rows_of(words, own):
    gone = {i for a, b, q in own for i in range(a + q, b)}
    own = sorted(own, key=lambda r: (r[0], r[2]))
    best = min(own, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in own)
    return (len(own), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), text


SCHEMA = "doc_id long, text string, runs string, start int, collapsed long"


def test_documents_with_and_without_planted_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE_WORDS", 3000)
    rng = random.Random(6)
    texts = [None, "", " \n\t", "one", "Ja ja " * 9, "a b " * 20, "x " * 4000, "é\x0bü\x0c" * 12]
    texts += [" ".join(f"W{w}" for w in sequence(rng)) for _ in range(120)] + [" ".join(str(rng.random()) for _ in range(6000))]
    rows = [(i if i != 5 else None, t, "x", 1, 2) for i, t in enumerate(texts)] + [(6, "x " * 4000, "x", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for plant in (False, True):
        want, n_planted = [], 0
        for i, t, *_ in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            if plant:
                moved = [w.decode() for w in periodic_runs.planted([w.encode() for w in words], i)]
                n_planted, words = n_planted + (moved != words), moved
            want.append((i, *rows_of(words, brute(words, 12))[0]))
        got = periodic_runs.periodic_runs(docs, plant=plant, whole=False)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert n_planted > 2 or not plant
    full = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert full[3]["runs"] == [] and [tuple(r) for r in full[4]["runs"]] == [(0, 18, 2)] and full[4]["collapsed"] == "Ja ja"
    assert full[6]["runs"][0]["period"] == 1 and full[6]["collapsed"] == "x"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_planted_words_repeat_with_their_period():
    words = [str(i).encode() for i in range(100)]
    ids = [i for i in range(400) if periodic_runs.planted(words, i) != words]
    assert 20 < len(ids) < 70
    for i in ids:
        out = periodic_runs.planted(words, i)
        a = next((k for k in range(100) if out[k] != words[k]), 100)
        assert len(out) == 100 and out[a] in out[:a]
