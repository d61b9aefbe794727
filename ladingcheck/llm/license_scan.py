"""License scan by ordered signature rules, in DataFrame functions only.

A few stems gate the texts; a rule's keyword gates its pattern; patterns give spans of the lower-cased text. A span that
lies inside a longer span of a rule of the same or a higher rank, or equals one of a higher rank, is suppressed. The base phrases are
counted on words apart from that and always stay.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladingcheck.llm.shared import ascii_lower

#: Phrase and label; the words of a phrase stand consecutively.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Every keyword contains one of these; keywords without one are added below. No blanks: a text may be wrapped at any of them.
STEMS = ["licen", "copyright", "copyleft", "spdx", "domain", "creative", "gpl", "warranty", "redistrib", "reserved",
         "cc0", "cc", "agreement", "opensource.org", "gnu.org", "apache.org", "permission"]

#: A stem that is too short to gate by itself, with what follows it in every match.
FOLLOWED = {"cc": r"cc[\s_0-]"}

# Licenses by label: how the name is written (words; a blank stands for white space, hyphen or underscore), the SPDX
# identifier, and a part of the address of the text.
_NAMED = {
    "afl-3.0": ("academic free license", "afl-[123](?:\\.[0-9])?", "opensource.org/licenses/afl"),
    "agpl-3.0": ("gnu affero general public license", "agpl-3\\.0(?:-only|-or-later)?", "gnu.org/licenses/agpl"),
    "apache-1.1": ("apache software license,? version 1\\.1", "apache-1\\.1", "apache.org/licenses/license-1.1"),
    "apache-2.0": ("apache license,? version 2(?:\\.0)?", "apache-2\\.0", "apache.org/licenses/license-2.0"),
    "artistic-1.0": ("artistic license 1\\.0", "artistic-1\\.0(?:-perl|-cl8)?", "opensource.org/licenses/artistic-license-1"),
    "artistic-2.0": ("artistic license 2\\.0", "artistic-2\\.0", "opensource.org/licenses/artistic-license-2"),
    "beerware": ("beerware license", "beerware", "people.freebsd.org/~phk/license"),
    "bsd-2-clause": ("(?:(?:simplified|freebsd|2[ -]clause) bsd|bsd 2[ -]clause(?: \"?simplified\"?)?) license", "bsd-2-clause(?:-patent|-views)?", "opensource.org/licenses/bsd-2-clause"),
    "bsd-3-clause": ("(?:(?:new|revised|modified|3[ -]clause) bsd|bsd 3[ -]clause(?: \"?new\"? or \"?revised\"?)?) license", "bsd-3-clause(?:-clear|-lbnl)?", "opensource.org/licenses/bsd-3-clause"),
    "bsd-4-clause": ("(?:(?:original|old|4[ -]clause) bsd|bsd 4[ -]clause(?: \"?original\"? or \"?old\"?)?) license", "bsd-4-clause(?:-uc)?", "directory.fsf.org/wiki/license:bsd-4clause"),
    "0bsd": ("(?:(?:zero[ -]clause|free public) bsd|bsd zero[ -]clause) license", "0bsd", "opensource.org/licenses/0bsd"),
    "bsl-1.0": ("boost software license", "bsl-1\\.0", "boost.org/license_1_0"),
    "busl-1.1": ("business source license", "busl-1\\.1", "mariadb.com/bsl11"),
    "cc0-1.0": ("(?:cc0|creative commons zero)(?: v?1\\.0)?(?: universal)?(?: 1\\.0)? license", "cc0-1\\.0", "creativecommons.org/publicdomain/zero"),
    "cc-by-4.0": ("creative commons attribution(?: 4\\.0)? international license", "cc-by-[1234]\\.[05]", "creativecommons.org/licenses/by/"),
    "cc-by-sa-4.0": ("creative commons attribution[ -]share ?alike", "cc-by-sa-[1234]\\.[05]", "creativecommons.org/licenses/by-sa/"),
    "cc-by-nc-4.0": ("creative commons attribution[ -]non ?commercial", "cc-by-nc-[1234]\\.[05]", "creativecommons.org/licenses/by-nc/"),
    "cc-by-nd-4.0": ("creative commons attribution[ -]no ?deriv(?:ative)?s?", "cc-by-nd-[1234]\\.[05]", "creativecommons.org/licenses/by-nd/"),
    "cc-by-nc-sa-4.0": ("creative commons attribution[ -]non ?commercial[ -]share ?alike", "cc-by-nc-sa-[1234]\\.[05]", "creativecommons.org/licenses/by-nc-sa/"),
    "cc-by-nc-nd-4.0": ("creative commons attribution[ -]non ?commercial[ -]no ?deriv(?:ative)?s?", "cc-by-nc-nd-[1234]\\.[05]", "creativecommons.org/licenses/by-nc-nd/"),
    "cddl-1.0": ("common development and distribution license", "cddl-1\\.[01]", "opensource.org/licenses/cddl"),
    "cecill-2.1": ("cecill(?:-[bc])? free software license", "cecill-(?:[bc]|[12]\\.[01])", "cecill.info/licences"),
    "cpl-1.0": ("common public license", "cpl-1\\.0", "opensource.org/licenses/cpl"),
    "ecl-2.0": ("educational community license", "ecl-[12]\\.0", "opensource.org/licenses/ecl"),
    "efl-2.0": ("eiffel forum license", "efl-[12]\\.0", "opensource.org/licenses/eiffel"),
    "elastic-2.0": ("elastic license(?: 2\\.0)?", "elastic-2\\.0", "elastic.co/licensing/elastic-license"),
    "epl-1.0": ("eclipse public license(?: -)? v(?:ersion)? ?1\\.0", "epl-1\\.0", "eclipse.org/legal/epl-v10"),
    "epl-2.0": ("eclipse public license(?: -)? v(?:ersion)? ?2\\.0", "epl-2\\.0", "eclipse.org/legal/epl-2.0"),
    "eupl-1.2": ("european union public licen[cs]e", "eupl-1\\.[012]", "joinup.ec.europa.eu/software/page/eupl"),
    "gfdl-1.3": ("gnu free documentation license", "gfdl-1\\.[123](?:-only|-or-later)?", "gnu.org/licenses/fdl"),
    "gpl-1.0": ("gnu general public license,? version 1", "gpl-1\\.0(?:-only|-or-later|\\+)?", "gnu.org/licenses/old-licenses/gpl-1"),
    "gpl-2.0": ("gnu general public license,? version 2", "gpl-2\\.0(?:-only|-or-later|\\+)?", "gnu.org/licenses/old-licenses/gpl-2"),
    "gpl-3.0": ("gnu general public license,? version 3", "gpl-3\\.0(?:-only|-or-later|\\+)?", "gnu.org/licenses/gpl-3"),
    "hpnd": ("historical permission notice and disclaimer", "hpnd(?:-sell-variant)?", "opensource.org/licenses/hpnd"),
    "intel": ("intel open source license", "intel", "opensource.org/licenses/intel-open-source-license"),
    "ipl-1.0": ("ibm public license", "ipl-1\\.0", "opensource.org/licenses/ipl"),
    "isc": ("isc license", "isc", "opensource.org/licenses/isc"),
    "json": ("json license", "json", "json.org/license"),
    "lgpl-2.0": ("gnu library general public license", "lgpl-2\\.0(?:-only|-or-later|\\+)?", "gnu.org/licenses/old-licenses/lgpl-2.0"),
    "lgpl-2.1": ("gnu lesser general public license,? version 2\\.1", "lgpl-2\\.1(?:-only|-or-later|\\+)?", "gnu.org/licenses/old-licenses/lgpl-2.1"),
    "lgpl-3.0": ("gnu lesser general public license,? version 3", "lgpl-3\\.0(?:-only|-or-later|\\+)?", "gnu.org/licenses/lgpl-3"),
    "llvm-exception": ("llvm exceptions? to the apache(?: 2\\.0)? license", "(?:apache-2\\.0 with )?llvm-exception", "llvm.org/license"),
    "lppl-1.3c": ("latex project public license", "lppl-1\\.[0123][ac]?", "latex-project.org/lppl"),
    "miros": ("miros licen[cs]e", "miros", "opensource.org/licenses/miros"),
    "mit-0": ("mit no attribution license", "mit-0", "opensource.org/licenses/mit-0"),
    "mit": ("(?:mit|expat) license", "mit", "opensource.org/licenses/mit"),
    "mpl-1.1": ("mozilla public license,? v(?:ersion)? ?\\.? ?1\\.[01]", "mpl-1\\.[01]", "mozilla.org/mpl/1.1"),
    "mpl-2.0": ("mozilla public license,? v(?:ersion)? ?\\.? ?2\\.0", "mpl-2\\.0(?:-no-copyleft-exception)?", "mozilla.org/mpl/2.0"),
    "ms-pl": ("microsoft public license", "ms-pl", "opensource.org/licenses/ms-pl"),
    "ms-rl": ("microsoft reciprocal license", "ms-rl", "opensource.org/licenses/ms-rl"),
    "mulanpsl-2.0": ("mulan permissive software license", "mulanpsl-[12]\\.0", "license.coscl.org.cn/mulanpsl"),
    "nasa-1.3": ("nasa open source agreement", "nasa-1\\.3", "opensource.org/licenses/nasa"),
    "ncsa": ("(?:ncsa|university of illinois) open source license", "ncsa", "opensource.org/licenses/uoi-ncsa"),
    "npl-1.1": ("netscape public license", "npl-1\\.[01]", "mozilla.org/mpl/npl"),
    "odbl-1.0": ("open database license", "odbl-1\\.0", "opendatacommons.org/licenses/odbl"),
    "odc-by-1.0": ("open data commons attribution license", "odc-by-1\\.0", "opendatacommons.org/licenses/by"),
    "ofl-1.1": ("sil open font license", "ofl-1\\.[01](?:-rfn|-no-rfn)?", "scripts.sil.org/ofl"),
    "openssl": ("openssl license", "openssl(?:-standalone)?", "openssl.org/source/license"),
    "osl-3.0": ("open software license", "osl-[123]\\.[01]", "opensource.org/licenses/osl"),
    "pddl-1.0": ("public domain dedication and license", "pddl-1\\.0", "opendatacommons.org/licenses/pddl"),
    "php-3.01": ("php license", "php-3\\.0?[01]?", "php.net/license"),
    "polyform-nc": ("polyform noncommercial license", "polyform-noncommercial-1\\.0\\.0", "polyformproject.org/licenses/noncommercial"),
    "postgresql": ("postgresql licen[cs]e", "postgresql", "postgresql.org/about/licen"),
    "psf-2.0": ("(?:psf|python software foundation) license(?: agreement)?", "(?:psf|python)-2\\.0(?:\\.1)?", "docs.python.org/license"),
    "qpl-1.0": ("q public license", "qpl-1\\.0", "opensource.org/licenses/qpl"),
    "rpl-1.5": ("reciprocal public license", "rpl-1\\.[15]", "opensource.org/licenses/rpl"),
    "ruby": ("ruby license", "ruby", "ruby-lang.org/en/about/license"),
    "sleepycat": ("sleepycat license", "sleepycat", "opensource.org/licenses/sleepycat"),
    "sspl-1.0": ("server side public license", "sspl-1\\.0", "mongodb.com/licensing/server-side-public-license"),
    "unicode-dfs": ("unicode(?: data files and software)? license agreement", "unicode-(?:dfs-20(?:15|16)|3\\.0)", "unicode.org/copyright"),
    "unlicense": ("the unlicense", "unlicense", "unlicense.org"),
    "upl-1.0": ("universal permissive license", "upl-1\\.0", "oss.oracle.com/licenses/upl"),
    "vim": ("vim license", "vim", "vimhelp.org/uganda.txt.html#license"),
    "w3c": ("w3c software (?:notice and )?license", "w3c(?:-19980720|-20150513)?", "w3.org/consortium/legal/copyright-software"),
    "wtfpl": ("do what the f\\W{0,3}\\w{0,4} you want to public license", "wtfpl", "wtfpl.net"),
    "x11": ("x11 license", "x11(?:-distribute-modifications-variant)?", "spdx.org/licenses/x11"),
    "zlib": ("zlib(?:/libpng)? license", "zlib(?:-acknowledgement)?", "zlib.net/zlib_license"),
    "zpl-2.1": ("zope public license", "zpl-[12]\\.[01]", "opensource.org/licenses/zpl"),
}

# Sentences of license texts and notices: label, keyword (a single word that every match holds), pattern.
_NOTICES = [
    ("gpl-or-later", "gnu", "gnu general public license as published by the free software foundation[;,] either version [123] of the license, or \\(at your option\\) any later version"),
    ("gpl", "gnu", "gnu general public license"),
    ("lgpl", "lesser", "gnu lesser general public license"),
    ("agpl", "affero", "gnu affero general public license"),
    ("gpl", "gpl", "\\b(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?:v[123])?\\b"),
    ("lgpl", "lgpl", "\\b(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl(?:v[23](?:\\.1)?)?\\b"),
    ("apache", "apache", "apache license"),
    ("apache-2.0", "apache", "licensed under the apache license, version 2\\.0"),
    ("mit", "licen", "\\b(?:licen[cs]ed|released|distributed) under the (?:terms of the )?mit license"),
    ("mit", "hereby", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "hereby", "permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "bsd", "\\bbsd(?: |-)(?:style )?licen[cs]e"),
    ("bsd-3-clause", "contributors", "neither the name of [\\s\\S]{1,80}? nor the names of its contributors may be used to endorse or promote [\\s\\S]{1,60}? without specific prior written permission"),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public license, v\\. 2\\.0"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license 2\\.0"),
    ("cc-by", "cc", "\\bcc by(?: [1234]\\.0)?\\b"),
    ("cc-by-nc", "cc", "\\bcc by-nc(?: [1234]\\.0)?\\b"),
    ("cc-by-sa", "cc", "\\bcc by-sa(?: [1234]\\.0)?\\b"),
    ("cc-by-nd", "cc", "\\bcc by-nd(?: [1234]\\.0)?\\b"),
    ("cc-by-nc-sa", "cc", "\\bcc by-nc-sa(?: [1234]\\.0)?\\b"),
    ("cc-by-nc-nd", "cc", "\\bcc by-nc-nd(?: [1234]\\.0)?\\b"),
    ("cc0-1.0", "cc0", "\\bcc0(?: 1\\.0)?\\b"),
    ("creative-commons", "creative", "licensed under a creative commons [\\s\\S]{1,80}? licen[cs]e"),
    ("public-domain", "domain", "\\b(?:is|are|placed|released) in(?:to)? the public domain\\b"),
    ("unlicense", "domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "licen", "this software is provided 'as-is', without any express or implied warranty[\\s\\S]{0,200}? licen[cs]e"),
    ("proprietary", "reserved", "\\ball rights reserved\\b"),
    ("copyright-notice", "copyright", "\\bcopyright (?:\\(c\\) )?(?:19|20)[0-9]{2}"),
    ("see-license", "licen", "\\bsee (?:the )?(?:accompanying )?licen[cs]e(?:\\.txt|\\.md)?(?: file)?\\b"),
    ("license-reference", "licen", "\\b(?:licen[cs]ed|released|distributed) under (?:the |a )?[a-z0-9 .+-]{2,60}? licen[cs]e\\b"),
    ("no-license", "licen", "\\bno licen[cs]e (?:is )?granted\\b"),
    ("commercial", "licen", "\\bcommercial licen[cs]e\\b"),
    ("eula", "licen", "\\bend user licen[cs]e agreement\\b"),
    ("warranty-disclaimer", "warranty", "\\bwithout warranty of any kind\\b"),
]


def _keyword(name: str) -> str:
    """A plain piece of the name pattern that holds a stem, or the stem that every form of it holds."""
    for piece in ("permission", "agreement", "cc0", "creative"):
        if piece in name.split("(?:")[0]:
            return piece
    return "agreement" if "agreement" in name and "licen" not in name else "creative" if name.startswith("creative") else "licen"


def _spaced(name: str, between: str) -> str:
    """The pattern with its blanks as runs of the class `between`: an optional blank may be empty, a class of blank and hyphen is one blank."""
    return re.sub(r"\[ -\]| (\?)?", lambda m: f"[{between}]{'*' if m[1] else '+'}", name)


def _rules() -> list[tuple[int, str, str, str]]:
    """Rank (1 first), label, keyword, pattern."""
    out = []
    for label, (name, spdx, address) in _NAMED.items():
        out.append((1, label, "spdx", f"spdx-license-identifier:\\s*(?:{spdx})(?:[^a-z0-9.+-]|$)"))
        out.append((2, label, _keyword(name), "\\b(?:" + _spaced(name, "\\s_-") + ")\\b"))
        out.append((3, label, next((s for s in STEMS if s in address), address), "\\b" + address.replace(".", "\\.")))
    out += [(2 if "-" in label else 3 if label not in ("copyright-notice", "license-reference", "warranty-disclaimer", "see-license")
             else 4, label, key, pattern.replace(" ", "\\s+")) for label, key, pattern in _NOTICES]
    return out


RULES = _rules()
STEMS += sorted({key for _, _, key, _ in RULES if not any(s in key for s in STEMS)})
#: What a detection of each rank is worth: 1 - the product of (1 - worth) over the detections kept is the score.
WORTH = {1: 0.95, 2: 0.8, 3: 0.5, 4: 0.2}
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_spans(documents: DataFrame, rules: list[tuple[int, str, str, str]] | None = None,
                  stems: list[str] | None = None) -> DataFrame:
    """doc_id, text_hash, start, end, label, rank of the detections that are kept; characters from 0, end exclusive.

    Rows without doc_id or text have none; rows that repeat an id and text count once. Of equal spans of one rank all
    labels stay.
    """
    rules, stems = RULES if rules is None else rules, STEMS if stems is None else stems
    docs = documents.where("doc_id is not null").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), ascii_lower(F.col("text")).alias("t"), F.lower("text").alias("low"))
    gates = [F.col("low").rlike(FOLLOWED[s]) if s in FOLLOWED else F.contains("low", F.lit(s)) for s in stems]
    docs = docs.where(reduce(lambda a, b: a | b, gates)).drop("low").dropDuplicates()
    table = F.from_json(F.lit(json.dumps([dict(no=i, rank=r, label=lab, key=k, re=p) for i, (r, lab, k, p) in enumerate(rules)])),
                        "array<struct<no:int,rank:int,label:string,key:string,re:string>>")
    hits = docs.select("doc_id", "text_hash", "t", F.explode(
        F.filter(table, lambda r: F.contains(F.col("t"), r["key"]))).alias("r"))
    hits = hits.withColumn("found", F.regexp_extract_all("t", F.col("r.re"), F.lit(0))).where(F.size("found") > 0)
    # Places follow from the lengths of the matches and of the pieces between them.
    pieces = hits.select("doc_id", "text_hash", "r.no", "r.rank", "r.label", F.posexplode(F.arrays_zip(
        F.transform("found", lambda m: F.length(m)).alias("long"),
        F.transform(F.split("t", F.col("r.re"), -1), lambda g: F.length(g)).alias("gap"))).alias("i", "z"))
    run = Window.partitionBy("doc_id", "text_hash", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = pieces.where("z.long is not null").withColumn("end", F.sum(F.col("z.long") + F.col("z.gap")).over(run)).select(
        "doc_id", "text_hash", "rank", "label", (F.col("end") - F.col("z.long")).alias("start"), "end")
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end"), "rank")
    earlier = before.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = {r: F.max(F.when(F.col("rank") <= r, F.struct("end", -F.col("start")))).over(earlier) for r in WORTH}
    kept = spans
    for r in WORTH:
        kept = kept.withColumn(f"_reach{r}", reach[r])
    own = F.struct("end", -F.col("start"))
    inside = F.lit(False)
    for r in WORTH:
        # An earlier start (or the same one) with an end as far: a longer span, or an equal one of a higher rank.
        inside = inside | ((F.col("rank") == r) & (F.col(f"_reach{r}") > own))
        if r > 1:
            inside = inside | ((F.col("rank") == r) & (F.col(f"_reach{r - 1}.end") >= F.col("end")))
    return kept.where(~F.coalesce(inside, F.lit(False))).select("doc_id", "text_hash", "start", "end", "label", "rank")


def license_scan(documents: DataFrame, rules: list[tuple[int, str, str, str]] | None = None,
                 stems: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Words are runs of ASCII letters (lower-cased), digits and everything beyond ASCII. Null text counts as empty: no
    words, no labels (empty strings), score 0. The score is the worth of the best rank among the detections, 0.5 at
    least with a base phrase. Only doc_id and text are read; rows without doc_id get their base phrases only.
    """
    # lower() changes other letters too, but makes no ASCII letter that a phrase could take for its own.
    low = F.lower(F.coalesce("text", F.lit("")))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _SEPARATOR, " ")), F.lit(" "))
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), spaced.alias("w"))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    docs = docs.withColumn("n_words", F.when(F.length("w") <= 2, F.lit(0)).otherwise(blanks(F.col("w")) - 1).cast("long"))
    count, first, last, labels = [], [], [], []
    for i, (phrase, label) in enumerate(BASE):
        long = len(phrase.split())
        docs = docs.withColumn(f"p{i}", F.when(F.contains("w", F.lit(f" {phrase} ")), F.split("w", f" {phrase}(?= )", -1)))
        there = F.col(f"p{i}").isNotNull()
        count.append(F.when(there, F.size(f"p{i}") - 1).otherwise(0))
        first.append(F.when(there, blanks(F.get(f"p{i}", F.lit(0)))))
        last.append(F.when(there, F.col("n_words") - long - (blanks(F.element_at(f"p{i}", -1)) - 1)))
        labels.append(F.when(there, F.lit(label)))
    base = docs.select("doc_id", "text_hash", "n_words", reduce(lambda a, b: a + b, count).cast("long").alias("n_base"),
                       F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
                       F.array_sort(F.array_compact(F.array(*labels))).alias("base"))
    found = license_spans(documents, rules, stems).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("more"), F.min("rank").alias("best"))  # labels of the rules at most
    worth = F.coalesce(*[F.when(F.col("best") == r, F.lit(w)) for r, w in WORTH.items()], F.lit(0.0))
    return base.join(found, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(worth, F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"))
