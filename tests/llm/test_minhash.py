"""MinHash near-duplicates against all pairs: groups, copies, stars whose centre is no link, nulls, repeats, clashing names."""

import random

import numpy as np
import pytest

from ladingcheck.llm import minhash_dedup
from tests.llm.test_documents import WORDS, brute_components, edited, frame, sentence, shingle_sets


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = [None, "", " \t\n", "One", "one", "one two", "a b c d e", "a  B\tc\nd E", "a b c d e f"]
    for _ in range(10):
        base = sentence(rng, rng.randrange(20, 150))
        out += [base, base.upper(), base, *(edited(rng, base, k) for k in (1, 1, 2, 3))]
    # Chains: each links with its neighbours only, so no centre is linked with all.
    words = sentence(rng, 400).split()
    out += [" ".join(words[i:i + 200]) for i in range(0, 100, 8)]
    # Boilerplate of four fifths: one bucket for many that are not linked, with pairs that are.
    shared = sentence(rng, 160)
    for i in range(14):
        own = sentence(rng, 40)
        out += [shared + " " + own] + [shared + " " + edited(rng, own, 2)] * (i % 3)
    out.append(sentence(rng, 50_000))
    out.append(out[-1] + " more")
    return out


@pytest.mark.parametrize("width, part", [(5, 85), (2, 60)])
def test_groups_are_those_of_all_pairs(spark, texts, width, part):
    sets = shingle_sets(texts, width)
    want = [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, brute_components(sets, part, 100)))]
    got = minhash_dedup.near_duplicates(frame(spark, texts), width, part, 100)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == want


def test_star_without_links_goes_on(spark):
    """Two groups in common buckets: the centre of one settles nothing in the other."""
    rng = random.Random(3)
    shared = sentence(rng, 300)
    heads = [sentence(rng, 50) for _ in range(6)]
    texts = [f"{shared} {h} tail{j}" for h in heads for j in range(5)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, texts), part=85).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(shingle_sets(texts, 5), 85, 100)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None), (4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash_dedup.near_duplicates(docs).collect()))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 1, 4, True)]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(docs, part=40)


def test_input_columns_of_any_name_are_left_alone(spark):
    names = ["rep", "b", "x", "p", "label", "component", "copies", "buckets", "kept", "slot", "salt", "sum_a"]
    docs = spark.createDataFrame([(1, "a b c d e f", *["v"] * len(names)), (2, "a b c d e f", *["w"] * len(names))],
                                 "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(map(tuple, minhash_dedup.near_duplicates(docs).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_heavy_classes_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "max", lambda *_: 3, raising=False)
    docs = frame(spark, ["a b c d e f g"] * 50 + ["q r s t u v w"] * 2)
    got = [r["component_id"] for r in minhash_dedup.near_duplicates(docs).orderBy("doc_id").collect()]
    assert got == [0] * 50 + [50] * 2


def test_densified_bins_stay_independent():
    """Shares of equal bins and of shared buckets at a similarity, for sets smaller and larger than the number of bins."""
    rng = np.random.default_rng(7)
    for n in (7, 20, 200, 2000):
        equal, met, tries = [], 0, 200
        for _ in range(tries):
            own = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            less = np.sort(own[rng.permutation(n)[:n - max(1, round(n * 0.14))]])
            equal.append((minhash_dedup.signature(own) == minhash_dedup.signature(less)).mean())
            met += bool(np.isin(minhash_dedup.buckets(own), minhash_dedup.buckets(less)).any())
        similarity = (n - max(1, round(n * 0.14))) / n
        assert abs(np.mean(equal) - similarity) < 0.03
        assert met == tries
    alone = minhash_dedup.signature(np.array([5], np.uint64))
    assert (alone == 5).all()
    assert len(WORDS) == 36
