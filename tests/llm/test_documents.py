"""Document operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ladingcheck.llm import decontaminate, language_id, license_scan, line_dedup, mixing, ngram_jaccard, pii

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "st") for b in ("ba", "do", "fe", "gu", "ix", "on")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, n_removed string"


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", len(t or ""), 0.0, -1, "x") for i, t in enumerate(texts)]


def frame(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", "  \t\n", "One", "one", "one two", "ONE two", "a b c d", "a  b\tc\nd"]
    for _ in range(25):
        base = sentence(rng, rng.randrange(20, 120))
        out += [base, base.upper(), *(edited(rng, base, k) for k in (1, 2, 5))]
    shared = sentence(rng, 40)
    out += [sentence(rng, 30) + " " + shared + " " + sentence(rng, 60) for _ in range(60)]
    near = sentence(rng, 200)
    out += [edited(rng, near, rng.randrange(1, 9)) for _ in range(60)]
    out.append(sentence(rng, 60_000))
    return out


def shingle_sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute_components(sets, part, whole):
    label = list(range(len(sets)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and whole * both >= part * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("width, part", [(4, 85), (5, 80), (1, 50)])
def test_ngram_jaccard_is_exact(spark, texts, width, part):
    sets = shingle_sets(texts, width)
    want = [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, brute_components(sets, part, 100)))]
    got = ngram_jaccard.ngram_jaccard(frame(spark, texts), width, part, 100)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == want


def test_ngram_jaccard_levels_and_pairs_agree(spark, texts, monkeypatch):
    sets = shingle_sets(texts, 5)
    want = brute_components(sets, 80, 100)
    monkeypatch.setattr(ngram_jaccard, "SMALL", 2)
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.ngram_jaccard(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_one_of_each_keeps_columns_and_loners(spark, texts):
    docs = frame(spark, texts)
    kept = {r["doc_id"] for r in ngram_jaccard.one_of_each(docs).collect()}
    assert kept == set(brute_components(shingle_sets(texts, 5), 80, 100))
    assert ngram_jaccard.one_of_each(docs).columns == docs.columns


def test_ngram_jaccard_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)],
                                 "doc_id long, text string")
    got = sorted(map(tuple, ngram_jaccard.ngram_jaccard(docs).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_license_scan_base_and_rules(spark):
    texts = ["GNU General, Public\nLicense and mit  license; MIT License", None, "", "nothing", "cc by-nc 4.0 cc by",
             "SPDX-License-Identifier: Apache-2.0", "Released under the MIT License.", "gnu general public licenses",
             "All rights reserved.", "x " * 30_000 + "apache license " * 300]
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        at = [(k, lab) for p, lab in license_scan.BASE for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert r["first_word"] == min((k for k, _ in at), default=None)
        assert r["last_word"] == max((k for k, _ in at), default=None)
        assert r["base_labels"] == ",".join(sorted({lab for _, lab in at}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert got[5]["labels"] == "apache-2.0" and got[5]["score"] == 0.95
    assert "cc-by-nc" in got[4]["labels"].split(",")
    assert got[8]["labels"] == "proprietary"


def test_license_spans_against_brute_force(spark):
    texts = ["Licensed under the Apache License, Version 2.0 (the \"License\")", "the mit license and the MIT license",
             "gnu lesser general public license version 3; gnu general public license version 2",
             "see license file. all rights reserved. copyright 2020"]
    docs = frame(spark, texts)
    got = sorted((r["doc_id"], r["start"], r["end"], r["label"], r["rank"]) for r in license_scan.license_spans(docs).collect())
    want = []
    for i, t in enumerate(texts):
        t = t.lower()
        spans = [(m.start(), m.end(), lab, r) for r, lab, key, p in license_scan.RULES if key in t for m in re.finditer(p, t)]
        want += [(i, a, b, lab, r) for a, b, lab, r in spans if not any(
            c <= a and d >= b and (q < r or q == r and d - c > b - a) for c, d, _, q in spans)]
    assert got == sorted(want)


def test_every_license_keyword_has_a_stem():
    assert len(license_scan.RULES) > 200
    assert all(any(s in key for s in license_scan.STEMS) for _, _, key, _ in license_scan.RULES)


#: One official spelling of each named license, and more for those that are written in several ways.
OFFICIAL = [
    ("afl-3.0", "Academic Free License"), ("agpl-3.0", "GNU Affero General Public License"),
    ("apache-1.1", "Apache Software License, Version 1.1"), ("apache-2.0", "Apache License, Version 2.0"),
    ("artistic-1.0", "Artistic License 1.0"), ("artistic-2.0", "Artistic License 2.0"), ("beerware", "Beerware License"),
    ("bsd-2-clause", 'BSD 2-Clause "Simplified" License'), ("bsd-2-clause", "2-Clause BSD License"),
    ("bsd-3-clause", 'BSD 3-Clause "New" or "Revised" License'), ("bsd-3-clause", "3-Clause BSD License"),
    ("bsd-4-clause", 'BSD 4-Clause "Original" or "Old" License'), ("0bsd", "BSD Zero Clause License"), ("0bsd", "Zero-Clause BSD License"),
    ("bsl-1.0", "Boost Software License"), ("busl-1.1", "Business Source License"),
    ("cc0-1.0", "Creative Commons Zero v1.0 Universal License"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa-4.0", "Creative Commons Attribution Share Alike 4.0 International"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4.0", "Creative Commons Attribution-NoDerivs 3.0 Unported"),
    ("cc-by-nd-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cddl-1.0", "Common Development and Distribution License"), ("cecill-2.1", "CeCILL Free Software License Agreement"),
    ("cpl-1.0", "Common Public License"), ("ecl-2.0", "Educational Community License"), ("efl-2.0", "Eiffel Forum License"),
    ("elastic-2.0", "Elastic License 2.0"), ("epl-1.0", "Eclipse Public License - v 1.0"), ("epl-1.0", "Eclipse Public License v1.0"),
    ("epl-2.0", "Eclipse Public License - v 2.0"), ("epl-2.0", "Eclipse Public License v2.0"),
    ("eupl-1.2", "European Union Public Licence"), ("gfdl-1.3", "GNU Free Documentation License"),
    ("gpl-1.0", "GNU General Public License, version 1"), ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License version 3"), ("hpnd", "Historical Permission Notice and Disclaimer"),
    ("intel", "Intel Open Source License"), ("ipl-1.0", "IBM Public License"), ("isc", "ISC License"), ("json", "JSON License"),
    ("lgpl-2.0", "GNU Library General Public License"), ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3"), ("llvm-exception", "LLVM Exceptions to the Apache 2.0 License"),
    ("lppl-1.3c", "LaTeX Project Public License"), ("miros", "MirOS Licence"), ("mit-0", "MIT No Attribution License"),
    ("mit", "MIT License"), ("mpl-1.1", "Mozilla Public License Version 1.1"), ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("mpl-2.0", "Mozilla Public License, v. 2.0"), ("mpl-2.0", "Mozilla Public License v2.0"), ("ms-pl", "Microsoft Public License"),
    ("ms-rl", "Microsoft Reciprocal License"), ("mulanpsl-2.0", "Mulan Permissive Software License"),
    ("nasa-1.3", "NASA Open Source Agreement"), ("ncsa", "University of Illinois Open Source License"),
    ("npl-1.1", "Netscape Public License"), ("odbl-1.0", "Open Database License"), ("odc-by-1.0", "Open Data Commons Attribution License"),
    ("ofl-1.1", "SIL Open Font License"), ("openssl", "OpenSSL License"), ("osl-3.0", "Open Software License"),
    ("pddl-1.0", "Open Data Commons Public Domain Dedication and License"), ("php-3.01", "PHP License"),
    ("polyform-nc", "PolyForm Noncommercial License"), ("postgresql", "PostgreSQL License"), ("psf-2.0", "Python Software Foundation License"),
    ("qpl-1.0", "Q Public License"), ("rpl-1.5", "Reciprocal Public License"), ("ruby", "Ruby License"), ("sleepycat", "Sleepycat License"),
    ("sspl-1.0", "Server Side Public License"), ("unicode-dfs", "Unicode License Agreement"), ("unlicense", "The Unlicense"),
    ("upl-1.0", "Universal Permissive License"), ("vim", "Vim License"), ("w3c", "W3C Software Notice and License"),
    ("wtfpl", "Do What The F*ck You Want To Public License"), ("x11", "X11 License"), ("zlib", "zlib License"),
    ("zpl-2.1", "Zope Public License")]


def test_every_license_name_is_found_as_it_is_written(spark):
    # In _rules() the name rule of a license is the one between its identifier and its address.
    name_rules = [b for a, b, c in zip(license_scan.RULES, license_scan.RULES[1:], license_scan.RULES[2:])
                  if (a[0], b[0], c[0]) == (1, 2, 3) and a[1] == b[1] == c[1]]
    assert {r[1] for r in name_rules} == {label for label, _ in OFFICIAL} and len(name_rules) > 70
    got = {(r["doc_id"], r["label"]) for r in license_scan.license_spans(
        frame(spark, [f"under the {name}." for _, name in OFFICIAL]), name_rules).collect()}
    assert [OFFICIAL[i] for i in range(len(OFFICIAL)) if (i, OFFICIAL[i][0]) not in got] == []


#: Sentences of the notices that the keywords gate, with their labels.
SENTENCES = [
    ("gpl", "GNU General Public License"), ("lgpl", "GNU Lesser General Public License"), ("agpl", "GNU Affero General Public License"),
    ("gpl-or-later", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("apache", "Apache License"), ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"), ("bsd", "a BSD license"),
    ("bsd", "a BSD-style license"), ("cc-by", "CC BY"), ("cc-by-sa", "CC BY-SA 4.0"), ("cc-by-nc-nd", "CC BY-NC-ND 4.0"), ("cc0-1.0", "CC0 1.0"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"), ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("creative-commons", "licensed under a Creative Commons Attribution 4.0 International License"), ("see-license", "see the accompanying licence file"),
    ("public-domain", "placed in the public domain"), ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"), ("eula", "End User License Agreement"), ("no-license", "no license is granted"),
    ("mit", "released under the MIT license"), ("warranty-disclaimer", "without warranty of any kind")]


def test_license_gates_let_wrapped_texts_through(spark):
    """As by the patterns alone, without stems and keywords: texts wrapped at their blanks, names with hyphens."""
    assert not any(c.isspace() for _, _, key, _ in license_scan.RULES for c in key) and not any(" " in s for s in license_scan.STEMS)
    texts = [t.replace(" ", b) for _, t in SENTENCES + OFFICIAL for b in ("\n", "\t", "  ", " \r\n   ")]
    texts += [t.replace(" ", "-") for _, t in OFFICIAL]
    labels = [label for label, _ in SENTENCES + OFFICIAL for _ in range(4)] + [label for label, _ in OFFICIAL]
    got = sorted((r["doc_id"], r["start"], r["end"], r["label"], r["rank"]) for r in license_scan.license_spans(frame(spark, texts)).collect())
    want = []
    for i, t in enumerate(texts):
        spans = [(m.start(), m.end(), lab, r) for r, lab, _, p in license_scan.RULES for m in re.finditer(p, t.lower())]
        assert labels[i] in {lab for _, _, lab, _ in spans}, t
        want += [(i, a, b, lab, r) for a, b, lab, r in spans if not any(
            c <= a and d >= b and (q < r or q == r and d - c > b - a) for c, d, _, q in spans)]
    assert got == sorted(want)


def test_license_keys_are_in_every_match():
    texts = [t.lower().replace(" ", b) for _, t in SENTENCES + OFFICIAL for b in (" ", "\n", "\t ", "-")]
    assert all(key in m.group() for _, _, key, p in license_scan.RULES for t in texts for m in re.finditer(p, t))


def test_license_scan_empty_and_repeated(spark):
    assert license_scan.license_scan(frame(spark, []).limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (1, "cc by"), (None, "mit license")],
                                 "doc_id long, text string")
    got = sorted((r["n_base"], r["base_labels"]) for r in license_scan.license_scan(docs).collect())
    assert got == [(1, "cc-by"), (1, "mit"), (1, "mit"), (1, "mit")]


def brute_mix(rows, budget_share, max_repeats):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows if i is not None]
    docs = [d for d in docs if d[2]]
    tokens = Counter()
    for _, s, n in docs:
        tokens[s] += n
    total = sum(tokens.values())
    budget = int(total * budget_share)
    low, high = -1, 1 << 20
    while high - low > 1:
        mid = (low + high) // 2
        w = {s: (n / total) ** (mid / (1 << 20)) for s, n in tokens.items()}
        z = sum(w.values())
        if max(w[s] / tokens[s] for s in w) * budget / z <= max_repeats:
            high = mid
        else:
            low = mid
    w = {s: (n / total) ** (high / (1 << 20)) for s, n in tokens.items()}
    z, out = sum(w.values()), []
    for s in tokens:
        own = [d for d in docs if d[1] == s]
        part = int(w[s] / z * budget)
        whole, rest = divmod(part, tokens[s])
        key = lambda b, i: hashlib.md5(f"17:{b}:{i}".encode()).hexdigest()
        out += [(i, s, b, key(b, i), n) for b in range(whole) for i, _, n in own]
        run = 0
        for k, i, n in sorted((key(whole, i), i, n) for i, _, n in own):
            run += n
            if run <= rest:
                out.append((i, s, whole, k, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("repeats", [1.2, 4.0, 50.0])
def test_mixing_against_brute_force(spark, repeats):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 12 + ["small", None]), rng.choice([None, "", sentence(rng, rng.randrange(1, 60))]))
            for i in range(400)] + [(None, "big", "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS weight", "2 AS block")
    got = sorted((tuple(r)[:5] for r in mixing.mix(docs, 1.0, repeats).collect()), key=repr)
    assert got == brute_mix([(a, b, c) for a, b, c in rows], 1.0, repeats)


def test_mixing_entropy_and_empty(spark):
    docs = spark.createDataFrame([(i, "a" if i % 10 else "b", "x y z") for i in range(200)], "doc_id long, source string, text string")
    weights = {r["source"]: r["weight"] for r in mixing.mix(docs, 1.0, None, 0.9).collect()}
    entropy = -sum(w * np.log(w) for w in weights.values())
    assert entropy <= 0.9 * np.log(2) + 1e-9 and entropy == pytest.approx(0.9 * np.log(2), abs=1e-4)
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_lines(rows):
    places = defaultdict(list)
    for i, t in rows:
        if i is None or t is None:
            continue
        lines = [x.strip(" ") for x in t.split("\n")]
        for k in range(len(lines) - 2):
            if any(lines[k:k + 3]):
                places[tuple(lines[k:k + 3])].append((i, k))
    gone = defaultdict(set)
    for found in places.values():
        first = min(found)
        for i, k in found:
            if (i, k) != first:
                gone[i] |= set(range(max(k, first[1] + 3) if i == first[0] else k, k + 3))
    out = []
    for i, t in rows:
        lines = None if t is None else t.split("\n")
        drop = gone.get(i, set()) if i is not None and t is not None else set()
        kept = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop)
        out.append((i, kept, len(lines or []), len(drop)))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    pool = [sentence(rng, 3) for _ in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "q\nq\nq\nq\nq\nq"), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, len(t or ""), "z", 7) for i, t in rows],
                                 "doc_id long, text string, n_chars long, n_lines string, gone_ int")
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "n_chars", "gone_", "n_lines", "n_removed"]
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got), key=repr) == brute_lines(rows)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def code_lengths(train, texts):
    """Code length in bits by plain dictionaries."""
    order = language_id.ORDER
    out = []
    for lang in sorted(train):
        count = defaultdict(Counter)
        for t in train[lang]:
            data = b"\0" * order + t.encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    count[data[i - k:i]][data[i]] += 1
        own = []
        for t in texts:
            data, bits = b"\0" * order + t.encode(), 0.0
            for i in range(order, len(data)):
                for k in range(order, -1, -1):
                    seen = count.get(data[i - k:i])
                    if seen is None:
                        continue
                    total, kinds = sum(seen.values()), len(seen)
                    if data[i] in seen:
                        bits -= np.log2(seen[data[i]] / (total + kinds))
                        break
                    bits -= np.log2(kinds / (total + kinds))
                else:
                    bits += 8
            own.append(bits)
        out.append(own)
    return np.array(out).T


def test_language_codes_against_brute_force(spark):
    rng = random.Random(1)
    texts = {"xx": [sentence(rng, 40) for _ in range(12)], "yy": ["".join(rng.choice("äbcdé fg") for _ in range(200)) for _ in range(12)]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    rows += [(100, None, "xx"), (101, "", None), (102, "123 !!", "yy"), (103, "zzz ka", None), (None, "kaba", "xx"), (104, "é" * 9, "qq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'u' AS score")
    import zlib
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    train = defaultdict(list)
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and not held(i):
            train[lang].append(t)
    got = {(r["doc_id"], r["text"]): r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows)
    names = sorted(train)
    for (i, t, _), lengths in zip(rows, code_lengths(train, [r[1] or "" for r in rows])):
        r = got[i, t]
        if t is None or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert lengths[names.index(r["lang_pred"])] <= lengths.min() + 0.01
            assert r["bits"] == pytest.approx(lengths.min() / len(t.encode()), abs=1e-3)
    kept = language_id.in_a_known_language(docs.drop("score"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, t, _ in rows[:24]}


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id.identify(docs).where(language_id.held_out()).where("lang_pred <> 'und'").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.9


def test_language_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(docs).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(k, sentence(rng, n)) for k, n in enumerate([3, 12, 12, 20, 25, 33, 40])] + [(50, None), (51, ""), (52, "...")]
    texts = [None, "", "!!", sentence(rng, 300)]
    for _, t in items[:7]:
        for edits in (0, 0, 1, 2):
            words = t.split()
            for _ in range(min(edits, len(words) // 5)):
                words[rng.randrange(len(words))] = "other"
            texts.append(sentence(rng, rng.randrange(0, 50)) + " " + " ".join(words).upper() + ", " + sentence(rng, rng.randrange(0, 50)))
    docs, benchmark = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    want = {}
    for i, t in enumerate(texts):
        words = (t or "").lower().replace(",", "").split()
        for k, item in items[:7]:
            own = item.split()
            most = int(len(own) * 0.2 + 1e-9)
            found = [(distance(own, words[a:a + len(own)]), a) for a in range(len(words)) if len(words[a:a + len(own)]) >= len(own) - most]
            if found and min(found)[0] <= most:
                want[i, k] = min(found)
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start_word"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert set(got) <= set(want)
    assert all(want[k][0] <= v[0] <= int(len(items[k[1]][1].split()) * 0.2) for k, v in got.items())
    assert {k: v for k, v in want.items() if v[0] == 0} == {k: v for k, v in got.items() if v[0] == 0}
    assert len(got) >= 0.9 * len(want)
    clean = decontaminate.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in got}
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_decontamination_distance_is_exact():
    rng = random.Random(8)
    texts = [sentence(rng, n) for n in (10, 15, 30)]
    items = decontaminate.Items(np.arange(3), texts, 0.7, 0.9, 1)
    for item, text in enumerate(texts):
        own = items.words[items.start[item]:items.start[item] + items.length[item]]
        most = int(items.allowed[item])
        for _ in range(40):
            other = own.tolist()
            for _ in range(rng.randrange(0, most + 3)):
                i = rng.randrange(len(other) + 1)
                other[i:i + rng.randrange(2)] = [rng.randrange(1 << 60)] * rng.randrange(2)
            other = np.array(other, np.uint64)
            got = items.distances(other, np.array([0]), np.array([len(other)]), item)[0]
            true = distance(own.tolist(), other[:len(own)].tolist())
            assert min(got, most + 1) == (min(true, most + 1) if len(own) - len(other) <= most else most + 1)


def random_edits(rng, words, n):
    """n substitutions, insertions and deletions, not before the first word and not behind the last one."""
    words = list(words)
    for _ in range(n):
        kind, i = rng.randrange(3), rng.randrange(1, len(words) - 1)
        words[i:i + (kind != 1)] = [f"other{rng.randrange(10**6)}"] if kind < 2 else []
    return words


def test_decontamination_takes_the_best_end(spark):
    """Passages with as many random edits as the limit allows, between other words, against all starts and all ends."""
    rng = random.Random(12)
    items = [(k, [f"w{k}x{i}" for i in range(m)]) for k, m in enumerate([20, 40] * 12)]
    texts, most = [], {k: len(own) // 5 for k, own in items}
    for k, own in items:
        around = sentence(rng, 60).split()
        # At the end of a document too, where no words follow; net insertions and deletions both occur.
        texts += [around[:30] + random_edits(rng, own, most[k]) + around[30:], around[:7] + random_edits(rng, own, most[k])]
    benchmark = spark.createDataFrame([(k, " ".join(own)) for k, own in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(frame(spark, [" ".join(t) for t in texts]), benchmark).collect()}
    one_length = 0
    for i, words in enumerate(texts):
        own = items[i // 2][1]
        m, limit = len(own), most[i // 2]
        at = words.index(own[0])
        best = min(distance(own, words[at:at + n]) for n in range(m - limit, m + limit + 1))
        assert best <= limit and got.get((i, i // 2), best) >= best
        one_length += distance(own, words[at:at + m]) <= limit
    assert one_length < 0.8 * len(texts)  # windows of m words alone would lose these
    assert set(got) <= {(i, i // 2) for i in range(len(texts))} and len(got) >= 0.9 * len(texts)


def test_decontamination_best_end_is_exact():
    rng = random.Random(15)
    texts = [sentence(rng, n) for n in (10, 15, 30)]
    items = decontaminate.Items(np.arange(3), texts, 0.7, 0.9, 1)
    for item in range(3):
        own = items.words[items.start[item]:items.start[item] + items.length[item]].tolist()
        most = int(items.allowed[item])
        for _ in range(40):
            other = own + [rng.randrange(1 << 60) for _ in range(rng.randrange(4))]
            for _ in range(rng.randrange(0, most + 3)):
                i = rng.randrange(len(other) + 1)
                other[i:i + rng.randrange(2)] = [rng.randrange(1 << 60)] * rng.randrange(2)
            got = items.distances(np.array(other, np.uint64), np.array([0]), np.array([len(other)]), item, any_end=True)[0]
            assert got == min(most + 1, min(distance(own, other[:n]) for n in range(len(other) + 1)))


def brute_spans(text):
    """The contract's patterns as they are written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(d[::-1][::2]) % 10 == (-sum(x * 2 - 9 * (x > 4) for x in d[::-1][1::2])) % 10:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_patterns_against_the_contract():
    rng = random.Random(2)
    alphabet = ["a", "Z", "@", ".", "1", "4", "0", "255", "+", "-", " ", "(", ")", "_", "é", "x.y", "@b.c", "4111 1111 1111 1111"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("a" * 200_000 + "@") == []
    assert pii.base_spans("1" * 200_000) == []


def test_pii_rows(spark):
    texts = [None, "", "mail ann@ex.org or call +49 (30) 1234567.", "ip 10.0.0.1, 300.1.1.1; card 4111-1111-1111-1111",
             "x " * 50_000 + "4111 1111 1111 1111"] + [f"card 4111 1111 1111 1111 mail u{i}@ex.org" for i in range(30)]
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in want) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(","))
    assert pii.find_pii(frame(spark, []).limit(0)).count() == 0


def test_pii_skip_edges_pull_other_spellings_along():
    """A number that the patterns miss is found through its recognised twin, and messages match exact marginals on a tree."""
    rng = np.random.default_rng(3)
    weights = {"node": rng.normal(size=(3 * pii.BUCKETS, 5)), "edge": rng.normal(size=(2, 5, 5)), "bias": rng.normal(size=5)}
    features, edges = np.array([[1, 5000, 9000], [2, 5001, 9001], [3, 5002, 9002]]), np.array([[0, 1, 0], [0, 2, 1]])
    own = weights["node"][features].sum(axis=1) + weights["bias"]
    joint = np.zeros((5, 5, 5))
    for x in np.ndindex(5, 5, 5):
        joint[x] = sum(own[i, x[i]] for i in range(3)) + sum(weights["edge"][k, x[a], x[b]] for a, b, k in edges)
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    saved, pii.ROUNDS = pii.ROUNDS, 60
    got = pii.beliefs(weights, features, edges)
    pii.ROUNDS = saved
    for i in range(3):
        assert got[i] == pytest.approx(joint.sum(axis=tuple(k for k in range(3) if k != i)), abs=1e-6)
    tokens, _, edges = pii.graph("call 030 1234567 now and later (1234567)")
    assert {e for e in edges if e[2] == 1} == {(1, 2, 1)}
    assert (0, 1, 0) in edges


def test_pii_evidence_reaches_all_occurrences():
    """On a chain of 40 repeats with the evidence at its head: exact marginals, and the same beside other documents."""
    rng, n = np.random.default_rng(4), 40
    pull = np.where(np.eye(5) > 0, 6.0, 0.0)
    weights = {"node": rng.normal(size=(3 * pii.BUCKETS, 5)) * 1e-3, "edge": np.array([np.zeros((5, 5)), pull]), "bias": np.zeros(5)}
    features = np.array([[1, 5000, 9000]] + [[2, 5001, 9001]] * (n - 1))
    weights["node"][1, 3] = 9.0
    edges = np.array([[i, i + 1, 1] for i in range(n - 1)])
    got = pii.beliefs(weights, features, edges)
    own = weights["node"][features].sum(axis=1) + weights["bias"]
    ahead, behind = [own[0]], [np.zeros(5)]
    for i in range(1, n):
        ahead.append(own[i] + np.logaddexp.reduce(ahead[-1][:, None] + pull, axis=0))
        behind.append(np.logaddexp.reduce((own[n - i] + behind[-1])[None, :] + pull, axis=1))
    want = np.exp((exact := np.array(ahead) + np.array(behind[::-1])) - exact.max(axis=1, keepdims=True))
    assert got == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-5)
    assert got[-1, 3] > 0.5  # six rounds leave it near one fifth
    joined = pii._join([(features, edges), (features[:2], edges[:1]), (features[:1], edges[:0])])
    assert (pii.beliefs(weights, *joined, [n, 2, 1])[:n] == got).all()
    long = "1" * 64
    assert pii.graph(f"x {long}@a.org")[1][0] != pii.graph(f"x {long}")[1][0]
