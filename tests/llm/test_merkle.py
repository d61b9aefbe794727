"""Merkle manifests against a plain tree in Python: sizes around the fan-out, nulls, repeats, subsets, broken claims."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ladingcheck.llm import merkle


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 16 * 16
        out += [d for k, d in enumerate(level[first:first + 16], first) if k != i]
        i //= 16
    return out


def fold(tree, i, d):
    for level in tree[:-1]:
        first = i // 16 * 16
        run = level[first:first + 16]
        run[i - first] = d
        i, d = i // 16, digest(run)
    return d


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in own[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for t, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            lower = lambda x: None if x is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
            claim = leaf((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            folded = fold(top, t, fold(trees[s], i, claim))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest(siblings(trees[s], i) + siblings(top, t)), folded, folded == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, n int, pos int, at string, claim string"
EXTRA = ("x", 1, 2, "y", "z")


def table():
    rng = random.Random(8)
    rows = [(i, "big", "en", 3, f"Text {i}") for i in range(4200)]
    rows += [(10_000 + i, "s17", None, None, rng.choice(["Aé", "a", None, ""])) for i in range(17)]
    rows += [(20_000 + i, "s16", "", 0, "Same") for i in range(16)] + [(30_000, "one", "en", 1, "ÄB")]
    rows += [(40_000, None, "de", 1, "N"), (None, None, None, None, None), (None, "big", "en", None, "A"), (40_001, "", "en", 1, "E")]
    rows += [(5, "big", "en", 3, "Text 5")] * 3 + [(5, "big", "en", 3, "other")] + [(i, f"é{i}", "fr", 1, "T") for i in range(60_000, 60_030)]
    rng.shuffle(rows)
    return [(*r, *EXTRA) for r in rows]


def test_manifest_is_that_of_plain_trees(spark):
    rows = table()
    got = merkle.audit(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)
    assert 0 < sum(not r[-1] for r in brute(rows)) < len(rows)


def test_proofs_of_a_subset_need_no_other_leaf(spark):
    rows = [r for r in table() if r[0] is not None]
    made = merkle.build(spark.createDataFrame(rows, SCHEMA))
    some = made.leaves.where(F.pmod(F.xxhash64("doc_id"), F.lit(40)) == 0)
    got = merkle.prove(made, some, listed=True).collect()
    assert len(got) == some.count() > 50 and all(r["verified"] for r in got)
    for r in got:
        assert digest(r["proof"]) == r["proof_sha256"]
    forged = merkle.prove(made, some.withColumn("claim", F.sha2(F.col("leaf"), 256))).collect()
    assert not any(r["verified"] for r in forged)


def test_missing_is_the_least_set():
    rng = np.random.default_rng(4)
    for n in (1, 2, 16, 17, 256, 257, 5000):
        for size in {1, min(n, 3), min(n, 40), n}:
            known = rng.permutation(n)[:size]
            got = merkle.missing(known, n)
            have = {(0, int(i)) for i in known} | set(got)
            assert len(have) == len(set(known.tolist())) + len(got)  # nothing that is known is fetched
            level, width = 0, n
            while width > 1:
                runs = {i // 16 for k, i in have if k == level and (level, i) not in got}
                assert {(level, i) for r in runs for i in range(r * 16, min(width, r * 16 + 16))} == {x for x in have if x[0] == level}
                assert not {(level + 1, r) for r in runs} & set(got)
                have |= {(level + 1, r) for r in runs}
                level, width = level + 1, -(-width // 16)
            assert (level, 0) in have
    assert merkle.missing(np.arange(5000), 5000) == []


def test_empty_and_single_tables(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "s", "en", 1, "x", *EXTRA)]
    assert [tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()] == brute(rows)


def test_numbers_across_ranges_and_rounds(spark, monkeypatch):
    """Ranges and blocks so small that sources span many of them and trees need several rounds."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 40)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i * 3, f"s{i % 2}", "en", 1, f"T{i}", *EXTRA) for i in range(700)]
    got = merkle.audit(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
