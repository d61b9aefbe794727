"""Links in blocks of bounded size: large groups against all pairs, and how often texts move."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ladingcheck.llm import minhash_dedup, near_pairs, ngram_jaccard
from tests.llm.test_documents import brute_components, edited, frame, sentence, shingle_sets


def groups_of(spark, sets, groups):
    rows = [(b, x, len(sets[x]), len(g)) for b, g in enumerate(groups) for x in g]
    return spark.createDataFrame(rows, "b long, x long, n long, members long")


def components(spark, texts, groups, part=85):
    docs = frame(spark, texts).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = near_pairs.components(groups_of(spark, shingle_sets(texts, 5), groups), docs, minhash_dedup._text_sets(5), part, 100)
    labels = {r["doc_id"]: r["label"] for r in found.collect()}
    return [labels.get(i, i) for i in range(len(texts))]


@pytest.fixture
def moved(monkeypatch):
    """Rows of texts that each pass over the blocks moves."""
    counts = []
    real = near_pairs._in_blocks

    def counting(rows, *others):
        counts.append(rows.count())
        return real(rows, *others)

    monkeypatch.setattr(near_pairs, "_in_blocks", counting)
    monkeypatch.setattr(near_pairs, "BLOCK", 8)
    return counts


def test_one_large_group_of_families(spark, moved):
    """Boilerplate families of near copies: none is linked with another, and members far apart in the blocks are found."""
    rng = random.Random(5)
    shared = sentence(rng, 160)
    texts = []
    for _ in range(15):
        own = sentence(rng, 40)
        texts += [shared + " " + own, shared + " " + edited(rng, own, 1)]
    texts += [shared + " " + " ".join(sentence(rng, 12)) for _ in range(3)]
    chain = sentence(rng, 300).split()
    texts += [" ".join(chain[i:i + 200]) for i in range(0, 60, 6)]
    rng.shuffle(texts)
    got = components(spark, texts, [range(len(texts))])
    assert got == brute_components(shingle_sets(texts, 5), 85, 100)


def test_near_copies_and_outsiders_move_once(spark, moved):
    """Near copies of one text, and members that share four fifths of it and link with nobody: no pass over all pairs."""
    rng = random.Random(9)
    base = sentence(rng, 400)
    texts = [base] + [edited(rng, base, 1) for _ in range(120)] + [" ".join(base.split()[:310]) + " " + sentence(rng, 90) for _ in range(60)]
    got = components(spark, texts, [range(len(texts))])
    assert got == brute_components(shingle_sets(texts, 5), 85, 100)
    assert len(moved) == 1 and moved[0] <= len(texts) * (1 + near_pairs.CENTRES / 8) + 2 * near_pairs.CENTRES


def test_ids_of_several_texts_stay(spark, moved):
    """An id with a text of its own kind and one that links: the other text's shingles do not close it."""
    rng = random.Random(2)
    base = sentence(rng, 60)
    near = [base + f" tail{i}" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(near)] + [(3, sentence(rng, 600)), (50, sentence(rng, 70)), (51, sentence(rng, 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = spark.createDataFrame([(0, x, n, 22) for x, n in [*((i, 57) for i in range(20)), (50, 66), (51, 66)]], "b long, x long, n long, members long")
    found = near_pairs.components(groups, docs, minhash_dedup._text_sets(5), 85, 100)
    assert {r["doc_id"]: r["label"] for r in found.collect()} == {i: 0 for i in range(20)}


def test_links_within_a_block():
    rng = random.Random(1)
    base = sentence(rng, 200)
    texts = [base, edited(rng, base, 1), sentence(rng, 200), edited(rng, base, 1), "", ""]
    sets = minhash_dedup._text_sets(5)(pa.array(texts))
    ids = np.arange(len(texts))
    assert sorted({frozenset(x) for x in near_pairs.links_within(ids, ids, sets, 85, 100)}, key=sorted) == [{0, 1}, {0, 3}]
    assert near_pairs.links_within(ids, ids * 0, sets, 85, 100) == []


def test_bitmaps_lose_no_pair_that_may_be_linked():
    """Bitmaps of one length and of two; negative words count their bits as well."""
    rng = np.random.default_rng(4)
    sets = []
    for n in (40, 900, 1020, 2040, 2050):
        own = np.unique(rng.integers(0, 2**58, n, dtype=np.uint64))
        sets += [own, own[:-max(1, n // 20)], np.unique(rng.integers(0, 2**58, n, dtype=np.uint64))]
    marks = []
    for own in sets:
        bits = max(ngram_jaccard.BITMAP, 1 << len(own).bit_length() >> 1)
        odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        marks.append(np.packbits(odd.astype(bool)).view(np.int64))
    ids, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    found = {(int(a), int(b)) for pairs in ngram_jaccard.near_by_marks(ids, ids, sizes, marks, 85, 100) for a, b in pairs.T}
    shared = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    want = {(i, j) for j in ids for i in range(j) if 100 * shared(i, j) >= 85 * (sizes[i] + sizes[j] - shared(i, j))}
    assert len(want) >= 5 and want <= found
    assert len(found) < 20
    assert ngram_jaccard.near_by_marks(ids, ids * 0, sizes, marks, 85, 100) == []


def test_a_pair_counts_in_its_first_common_region_only():
    """Members that share an earlier region are left to it; without that every region made the pair again."""
    rng = np.random.default_rng(6)
    own = np.unique(rng.integers(0, 2**58, 300, dtype=np.uint64))
    odd = np.bincount((own % np.uint64(1024)).astype(np.int64), minlength=1024) & 1
    marks, ids = [np.packbits(odd.astype(bool)).view(np.int64)] * 4, np.arange(4)
    before = [np.array(x, np.int64) for x in ([5, 9], [9], [], [7])]
    found = {(int(a), int(b)) for pairs in ngram_jaccard.near_by_marks(ids, ids, np.full(4, 300), marks, 85, 100, before) for a, b in pairs.T}
    assert found == {(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}
