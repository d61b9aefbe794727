"""OP7_SQL resolves character references as the operator does."""

import re

import duckdb

from ladingcheck.llm import queries, warc

TEXTS = ["a &copy; b &middot;c &amp;lt; &#65;&#x42;&#X43 &nbsp;x&nbsp; &notit; &notin; &bogus; &#0; &#128; &#xD800; it's &apos;",
         "&#1114112; &#99999999999999999999; &#160;z & && &#; &a &Aacute &acE; &fjlig; &#000000000000065; &#11; &#xfdd0; &#x1F600;",
         "", "plain"]


def test_all_references():
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, 'u', ?)", [list(t) for t in enumerate(TEXTS)])
    got = con.execute(f"SELECT page_id, block FROM ({queries.OP7_SQL}) WHERE record_type = 'conversion' ORDER BY 1").fetchall()
    for (i, block), text in zip(got, TEXTS, strict=True):
        want = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f]+", " ", warc.resolved(text))).strip(" \n")
        assert block == want, i
