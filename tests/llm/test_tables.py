"""URL cascades, cover trees and WARC derivatives against brute force and round trips."""

import random
from urllib.parse import urlsplit

import numpy as np
import pytest

from ladingcheck.llm import cover_tree, url_filter, warc
from ladingcheck.llm.queries import RULES


def test_cascade_is_exact_on_its_universe():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 2**64, 20_000, dtype=np.uint64), rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    for share in (0.0, 0.001, 0.3, 1.0):
        listed = rng.random(20_000) < share
        levels = url_filter.cascade_levels(h1, h2, listed)
        assert (url_filter.member(levels, h1, h2) == listed).all()
        assert share in (0.0, 1.0) or len(levels) > 1
    with pytest.raises(ValueError):
        url_filter.cascade_levels(np.zeros(2, np.uint64), np.zeros(2, np.uint64), np.array([True, False]))


def brute_urls(rows):
    ruled = []
    for i, url in rows:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for v, r in RULES if (host + "/").endswith(h := r.split("/")[0] + "/") and (
            host == h[:-1] or host.endswith("." + h[:-1])) and path.startswith(r[len(h) - 1:])]
        best = max(fits, default=(0, None, None))
        ruled.append((i, host, path, best[1], best[2]))
    listed = {h for _, h, _, _, v in ruled if v == "block" and h}
    return sorted(((i, h, p, r, v or ("block" if h in listed else "allow"), h in listed) for i, h, p, r, v in ruled), key=repr)


def test_url_filter_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(0, None), (1, ""), (2, "nothing"), (3, "http://"), (4, "http://COM/"), (5, "http://net"), (6, "x://a.NET/es/?q#f"),
            (7, "http://example.com/en"), (8, "http://www.example.com/en/1"), (9, "http://xexample.com/en/"), (10, "a://b://c.net/fr/"),
            (None, "http://é.net/fr/ü"), (11, "http://a..net/es/"), (12, "http://a.net:80/es/")]
    for i in range(300):
        host = ".".join(rng.choice(["www", "m", "a", "example", "net", "com", "org"]) for _ in range(rng.randrange(1, 4)))
        rows.append((20 + i // 2, f"http://{host}{rng.choice(['', '/', '/en/', '/es/x', '/fr', '/fr/', '?q=/es/', '#/fr/'])}"))
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, listed int")
    got = sorted(map(tuple, url_filter.url_filter(pages, RULES).collect()), key=repr)
    assert got == brute_urls(rows)
    assert url_filter.url_filter(pages.limit(0), RULES).count() == 0


def test_url_filter_groups_of_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARDS_AT_ONCE", 3)
    monkeypatch.setattr(url_filter, "KEYS_PER_SHARD", 5)
    rows = [(i, f"http://h{i % 40}.{'net' if i % 3 else 'org'}/{'es' if i % 7 == 0 else 'en'}/") for i in range(120)]
    got = sorted(map(tuple, url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()), key=repr)
    assert got == brute_urls(rows)


def test_hosts_agree_with_urlsplit():
    assert brute_urls([(1, "http://A.b.net/es/q?x#y")])[0][1:3] == (urlsplit("http://A.b.net").netloc.lower(), "/es/q")


def brute_top(rows, every, k):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(
        x is not None and np.isfinite(x) for x in v)]
    fine = list({(i, tuple(v)): None for i, v in fine})
    out = []
    for q, v in fine:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [40, 1024])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK_LEAST", block)
    monkeypatch.setattr(cover_tree, "BLOCK_MOST", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, [float(x) for x in (centres[i % 6] + rng.normal(size=8) * 0.1).round(2)]) for i in range(400)]
    vectors += [(i, vectors[0][1]) for i in range(500, 560)] + [(600, vectors[0][1])] * 2
    vectors += [(700, None), (701, []), (750, [None] * 8), (702, [float("nan")] * 8), (800, [float("inf")] + [0.0] * 7),
                (850, [1.0]), (851, [2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, label int, rank int")
    got = sorted(map(tuple, cover_tree.top_k(df, 50, 5, 256).collect()))
    assert got == brute_top(vectors, 50, 5)


def test_top_k_few_candidates_large_numbers_and_empty(spark):
    rows = [(0, [1e9, 1e9]), (50, [1e9, -1e9]), (7, [3e8, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, cover_tree.top_k(df).collect())) == [
        (q, r, i, max(-2**63, min(2**63 - 1, s))) for q, r, i, s in brute_top(rows, 50, 5)]
    assert cover_tree.top_k(df.limit(0)).count() == 0


def test_cover_tree_covers_and_separates():
    x = np.random.default_rng(2).normal(size=(500, 4))
    work = [cover_tree.cover_tree(x)]
    while work:
        node = work.pop()
        assert np.sqrt(((x[node.points] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        work += node.children


def test_warc_round_trip_and_links(spark, tmp_path):
    html = ("<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><p>One&nbsp;two</p>\n<div>1 &lt; 2 é</div>"
            "<a href='x'>l</a><script>no</script></body></html>")
    pages = spark.createDataFrame([(1, "http://a/b", html, 5), (2, None, None, 5), (3, "http://c", "", 5), (4, "http://d\r\nX: y", "plain", 5)],
                                  "page_id long, url string, html string, block int")
    source = warc.responses(pages).cache()
    made = warc.derive(source).cache()
    assert made.count() == 8
    ids = {r["record_id"]: r for r in source.collect()}
    assert len(ids) == 4
    for r in made.collect():
        origin = ids[r["refers_to"]]
        assert (r["target_uri"], r["date"], r["refers_to_digest"]) == (origin["target_uri"], origin["date"], origin["payload_digest"])
    text = {r["page_id"]: r["block"] for r in made.where("record_type = 'conversion'").collect()}
    assert text == {1: "A & B\nOne two\n1 < 2 é\nl", 2: "", 3: "", 4: "plain"}
    meta = {r["page_id"]: r["block"] for r in made.where("record_type = 'metadata'").collect()}
    assert "title: A & B\r\n" in meta[1] and "outlinks: 1\r\n" in meta[1] and "http-status: 200\r\n" in meta[2]
    every = source.unionByName(made).drop("page_id")
    warc.write(every, str(tmp_path / "out"))
    back = warc.read(spark, str(tmp_path / "out"))
    shown = list(warc.RECORD)
    clean = [tuple(" ".join(v.split("\r\n")) if c == "target_uri" else v for c, v in zip(shown, r)) for r in every.select(shown).collect()]
    assert sorted(map(tuple, back.select(shown).collect()), key=repr) == sorted(clean, key=repr)
    again = warc.derive(back)
    assert sorted(r["record_id"] for r in again.where("target_uri not like '%X: y'").collect()) == sorted(
        r["record_id"] for r in made.where("page_id <> 4").collect())
    assert warc.derive(source.limit(0)).count() == 0


def test_warc_text_resolves_all_references_once(spark):
    cases = {"&copy; 2024 &middot; caf&eacute;": "© 2024 · café", "it&#8217;s &#x27;so&#X27;": "it’s 'so'", "&amp;lt; &amp;amp; &lt;b&gt;": "&lt; &amp; <b>",
             "a&nbsp;&#160;b&#xA0;c": "a b c", "&copy 5 &notit; &nosuch; & &# &#x; AT&T": "© 5 ¬it; &nosuch; & &# &#x; AT&T",
             "&#0;&#xD800;&#x110000;&#128;": "\ufffd\ufffd\ufffd€", "&#" + "9" * 6000 + ";&#x" + "f" * 6000 + ";": "\ufffd\ufffd",
             "&#" + "0" * 6000 + "65;&#x" + "0" * 6000 + "42": "AB", "&#x1F600;&NotEqualTilde;": "\U0001F600≂̸", "&apos;&#39;&quot;&#34;": "''\"\""}
    pages = spark.createDataFrame([(i, "http://a", f"<title>{t}</title>") for i, t in enumerate(cases)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages)).collect()
    text = {r["page_id"]: r["block"] for r in made if r["record_type"] == "conversion"}
    assert [text[i] for i in range(len(cases))] == list(cases.values())
    assert all(f"title: {want}\r\n" in r["block"] for r in made if r["record_type"] == "metadata" for want in [list(cases.values())[r["page_id"]]])
