"""The registered queries of the dealt operators and, where SQL can say it, their results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladingcheck.llm import (
    cover_tree, decontaminate, language_id, license_scan, line_dedup, merkle, minhash_dedup, mixing, ngram_jaccard, periodic_runs, pii,
    url_filter, warc)
from ladingcheck.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard(table(spark, sf_dir, "documents"), width=4, part=85, whole=100)


def _groups_sql(width: int, part: int, more: str = "") -> str:
    """Groups of documents linked by shingles of `width` words at a similarity of `part` per cent."""
    return f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {width - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {width - 1}) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {part} * (a.n + b.n - k)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id{more}
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""


OP1_SQL = _groups_sql(4, 85)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _base_places(phrase: str, label: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"ws[i + {j}] = {_text(w)}" for j, w in enumerate(words))
    return f"""SELECT doc_id, i - 1 AS place, i + {len(words)} - 2 AS last_place, {_text(label)} AS label FROM spots WHERE {same}"""


OP2_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
base AS MATERIALIZED ({' UNION ALL '.join(_base_places(p, lab) for p, lab in license_scan.BASE)}),
b AS MATERIALIZED (
  SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
  FROM base GROUP BY doc_id),
rules(no, rank, label, key, re) AS MATERIALIZED (VALUES {', '.join(
    f"({i}, {r}, {_text(lab)}, {_text(k)}, {_text(p)})" for i, (r, lab, k, p) in enumerate(license_scan.RULES))}),
hits AS MATERIALIZED (
  SELECT d.doc_id, r.no, r.rank, r.label, regexp_extract_all(d.t, r.re) AS found, string_split_regex(d.t, r.re) AS gaps
  FROM d JOIN rules r ON contains(d.t, r.key)),
pieces AS (SELECT doc_id, no, rank, label, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM hits),
ends AS (SELECT doc_id, no, rank, label, i, length(found[i]) AS n,
    sum(length(found[i]) + length(gaps[i])) OVER (PARTITION BY doc_id, no ORDER BY i) AS b FROM pieces),
spans AS MATERIALIZED (SELECT doc_id, no, rank, label, b - n AS a, b FROM ends),
kept AS MATERIALIZED (
  SELECT * FROM spans s WHERE NOT EXISTS (
    SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.a <= s.a AND o.b >= s.b
      AND (o.rank < s.rank OR o.rank = s.rank AND o.b - o.a > s.b - s.a))),
m AS MATERIALIZED (SELECT doc_id, list(DISTINCT label) AS labels, min(rank) AS best FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word,
  b.last_word::BIGINT AS last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  greatest(CASE m.best {' '.join(f'WHEN {r} THEN {w}' for r, w in license_scan.WORTH.items())} ELSE 0 END,
    CASE WHEN b.n > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), budget_share=1.0, max_repeats=4.0)
    return out.withColumn("weight", F.round("weight", 9))


OP3_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL),
k AS MATERIALIZED (SELECT * FROM d WHERE n_tokens > 0),
s AS MATERIALIZED (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM k GROUP BY source),
t AS MATERIALIZED (SELECT sum(tokens)::BIGINT AS total FROM s),
grid AS MATERIALIZED (
  SELECT g.k, max(pow(s.tokens / t.total::DOUBLE, g.k / 1048576.0) / s.tokens) * t.total::DOUBLE
    / sum(pow(s.tokens / t.total::DOUBLE, g.k / 1048576.0)) <= 4.0 AS holds
  FROM (SELECT unnest(range(0, 1048576, 64)) AS k) g, s, t GROUP BY g.k, t.total),
rough AS MATERIALIZED (SELECT coalesce(min(k), 1048576) AS high FROM grid WHERE holds),
fine AS MATERIALIZED (
  SELECT g.k, max(pow(s.tokens / t.total::DOUBLE, g.k / 1048576.0) / s.tokens) * t.total::DOUBLE
    / sum(pow(s.tokens / t.total::DOUBLE, g.k / 1048576.0)) <= 4.0 AS holds
  FROM (SELECT unnest(range(greatest(0, high - 63), high)) AS k FROM rough) g, s, t GROUP BY g.k, t.total),
a AS MATERIALIZED (
  SELECT coalesce((SELECT min(k) FROM fine WHERE holds), (SELECT high FROM rough)) / 1048576.0 AS a),
p AS MATERIALIZED (SELECT source, tokens, pow(tokens / total::DOUBLE, a) AS w FROM s, t, a),
q AS MATERIALIZED (
  SELECT source, tokens, w / (SELECT sum(w) FROM p) AS weight, floor(w / (SELECT sum(w) FROM p) * total)::BIGINT AS budget FROM p, t),
b AS MATERIALIZED (
  SELECT k.doc_id, k.source, k.n_tokens, q.weight, q.budget // q.tokens AS whole, q.budget % q.tokens AS rest
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source),
l AS MATERIALIZED (SELECT *, md5('17:' || whole || ':' || doc_id) AS place FROM b),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT doc_id, source, block, md5('17:' || block || ':' || doc_id) AS place, n_tokens, round(weight, 9) AS weight
FROM (SELECT *, unnest(range(0, whole)) AS block FROM b)
UNION ALL
SELECT doc_id, source, whole AS block, place, n_tokens, round(weight, 9) AS weight FROM r WHERE run <= rest
"""

def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, carry=["doc_id"]).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), RULES)


OP5_SQL = f"""
WITH u AS MATERIALIZED (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, rule_verdict, h, s) AS (
  SELECT r, v, regexp_extract(r, '^[^/]*'), regexp_extract(r, '/.*')
  FROM (VALUES {', '.join(f"('{r}', '{v}')" for v, r in RULES)}) x(r, v)),
f AS MATERIALIZED (
  SELECT p.page_id, p.host, p.path, r.rule, r.rule_verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS place
  FROM p LEFT JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s)),
o AS MATERIALIZED (SELECT * FROM f WHERE place = 1),
listed AS MATERIALIZED (SELECT DISTINCT host FROM o WHERE rule_verdict = 'block' AND host <> '')
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
  host IN (SELECT host FROM listed) AS listed_host FROM o
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def _stripped(html: str) -> str:
    steps = [(r"(?s)<!--.*?-->", ""),
             (r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>", ""),
             (r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title|/article|/section|/header|/footer|/nav|/ul|/ol|/table)\b[^>]*>", None),
             (r"<[!/?a-zA-Z][^>]*>", "")]
    for pattern, by in steps:
        html = f"regexp_replace({html}, {_text(pattern)}, {'chr(10)' if by is None else _text(by)}, 'g')"
    return html


_REFERENCE = "'&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)'"


def _tidied(text: str) -> str:
    """Character references by the map `made` of table refs_made, then blanks and line feeds."""
    text = (f"array_to_string(list_transform(list_zip(string_split_regex({text}, {_REFERENCE}), regexp_extract_all({text}, {_REFERENCE})), "
            "lambda p: coalesce(p[1], '') || CASE WHEN p[2] IS NULL THEN '' ELSE made[p[2]] END), '')")
    text = f"regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def _values(pairs) -> str:
    """Rows of a key and a text, the text by its code points."""
    return ", ".join(f"({k}, {' || '.join(f'chr({ord(c)})' for c in v) or _text('')})" for k, v in pairs)


# HTML's names and the low numbers with a meaning of their own, from the standard library.
_NAMES = _values((_text(name), sign) for name, sign in sorted(html5.items()))
_LOW = _values((n, unescape(f"&#{n};")) for n in range(1, 160))
_REFS = f"""
names(name, sign) AS MATERIALIZED (SELECT * FROM (VALUES {_NAMES})),
low(n, sign) AS MATERIALIZED (SELECT * FROM (VALUES {_LOW})),
refs AS MATERIALIZED (
  SELECT DISTINCT unnest(list_concat(regexp_extract_all(raw_title, {_REFERENCE}), regexp_extract_all(raw_text, {_REFERENCE}))) AS ref FROM x),
numbers AS (
  SELECT ref, TRY_CAST(CASE WHEN lower(ref[3]) = 'x' THEN '0x' || trim(ref[4:], ';') ELSE trim(ref[3:], ';') END AS BIGINT) AS n
  FROM refs WHERE ref LIKE '&#%'),
named AS (
  SELECT ref, arg_max(sign || substr(ref, length(name) + 2), length(name)) AS sign
  FROM (SELECT ref, unnest(generate_series(2, length(ref) - 1)) AS k FROM refs WHERE ref NOT LIKE '&#%')
  JOIN names ON name = substr(ref, 2, k) GROUP BY ref),
solved AS (
  SELECT ref, CASE WHEN n IS NULL OR n > 1114111 OR n = 0 OR n BETWEEN 55296 AND 57343 THEN chr(65533)
    WHEN n < 160 THEN sign WHEN n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INTEGER) END AS sign
  FROM numbers LEFT JOIN low USING (n)
  UNION ALL SELECT ref, coalesce(sign, ref) FROM refs LEFT JOIN named USING (ref) WHERE ref NOT LIKE '&#%'),
refs_made AS MATERIALIZED (
  SELECT coalesce(map(list(ref), list(CASE WHEN sign[1] = chr(160) THEN ' ' || sign[2:] ELSE sign END)), MAP {{}}) AS made FROM solved)"""


def _uuid(*parts: str) -> str:
    h = f"md5({' || chr(10) || '.join(parts)})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_NL = "chr(13) || chr(10)"
OP7_SQL = f"""
WITH h AS MATERIALIZED (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
r AS MATERIALIZED (SELECT *, 'HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8 | Content-Length: ' || strlen(html) AS head FROM h),
s AS MATERIALIZED (
  SELECT *, replace(head, ' | ', {_NL}) || {_NL} || {_NL} || html AS block FROM r),
d AS MATERIALIZED (
  SELECT *, 'sha256:' || sha256(block) AS digest, 'sha256:' || sha256(html) AS refers_to_digest, strlen(block) AS length FROM s),
i AS MATERIALIZED (SELECT *, {_uuid("'response'", 'page_id', 'target_uri', 'digest')} AS refers_to FROM d),
x AS MATERIALIZED (
  SELECT *, {_stripped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")} AS raw_title, {_stripped('html')} AS raw_text FROM i),
{_REFS},
k AS MATERIALIZED (
  SELECT i.*, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-content-type: application/http; msgtype=response' || {_NL} || 'source-content-length: ' || length || {_NL}
    || 'source-block-digest: ' || digest || {_NL} || 'source-payload-digest: ' || refers_to_digest || {_NL}
    || 'http-status: 200' || {_NL} || 'http-headers: ' || head || {_NL}
    || 'title: ' || regexp_replace({_tidied('raw_title')}, '\\s+', ' ', 'g') || {_NL}
    || 'outlinks: ' || len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=')) || {_NL} AS out FROM x AS i, refs_made
  UNION ALL
  SELECT i.*, 'conversion', 'text/plain', {_tidied('raw_text')} FROM x AS i, refs_made)
SELECT page_id, record_type, {_uuid('record_type', 'refers_to', "'sha256:' || sha256(out)")} AS record_id, refers_to, target_uri,
  '2024-01-01T00:00:00Z' AS date, content_type, 'text/html' AS payload_type, 'sha256:' || sha256(out) AS block_digest,
  'sha256:' || sha256(out) AS payload_digest, refers_to_digest, strlen(out)::BIGINT AS content_length, out AS block FROM k
"""


def op8_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


OP8_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP10_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS MATERIALIZED (
  SELECT doc_id, i - 1 AS pos, trim(lines[i]) || chr(10) || trim(lines[i + 1]) || chr(10) || trim(lines[i + 2]) AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM d)),
f AS MATERIALIZED (
  SELECT w, min(struct_pack(d := doc_id, p := pos)) AS f FROM w WHERE w <> chr(10) || chr(10) GROUP BY w HAVING count(*) > 1),
later AS (SELECT w.doc_id, CASE WHEN f.f.d = w.doc_id THEN greatest(w.pos, f.f.p + 3) ELSE w.pos END AS a, w.pos + 2 AS b
  FROM w JOIN f ON w.w = f.w WHERE struct_pack(d := w.doc_id, p := w.pos) <> f.f),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line FROM later),
l AS (SELECT doc_id, i - 1 AS line, lines[i] AS t FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
kept AS (SELECT l.doc_id, string_agg(l.t, chr(10) ORDER BY l.line) AS text FROM l ANTI JOIN gone USING (doc_id, line) GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.lines IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in DuckDB: half a byte a step, the lower half first."""
    halves = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        halves.append(c)
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT & 15, ascii(c)::BIGINT >> 4]))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), "
            f"lambda c, x: xor(c >> 4, ([{', '.join(map(str, halves))}]::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295::BIGINT)")


def _merkle_sql(levels: int) -> str:
    """Trees of up to 16^levels leaves a source and as many sources."""
    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    def tree(name: str, key: str) -> list[str]:
        parts = []
        for k in range(levels):
            parts.append(f"{name}r{k} AS MATERIALIZED (SELECT {key}, width, idx // 16 AS run, list(digest ORDER BY idx) AS ds "
                         f"FROM {name}{k} WHERE width > 1 GROUP BY ALL)")
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {key}, (width + 15) // 16 AS width, run AS idx, "
                         f"sha256(array_to_string(ds, '')) AS digest FROM {name}r{k})")
        roots = " UNION ALL ".join(f"SELECT {key}, digest FROM {name}{k} WHERE width = 1" for k in range(levels + 1))
        parts.append(f"{name}root AS MATERIALIZED ({roots})")
        return parts

    def climb(name: str, key: str, before: str, at: str) -> tuple[list[str], str]:
        parts = []
        for k in range(levels):
            place = f"(b.{at} // {16**k} % 16)"
            parts.append(f"""{name}c{k} AS MATERIALIZED (
  SELECT b.* REPLACE (
    b.proof || coalesce(array_to_string(r.ds[1:{place}] || r.ds[{place} + 2:], ''), '') AS proof,
    CASE WHEN r.ds IS NULL THEN b.folded ELSE sha256(array_to_string(r.ds[1:{place}] || [b.folded] || r.ds[{place} + 2:], '')) END AS folded)
  FROM {before} b LEFT JOIN {name}r{k} r ON r.{key} = b.{key} AND r.run = b.{at} // {16**(k + 1)})""")
            before = f"{name}c{k}"
        return parts, before

    up, climbed = climb("s", "tree", "d", "pos")
    top_up, ended = climb("t", "forest", climbed, "top")
    ctes = [
        f"rows_ AS MATERIALIZED (SELECT *, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL "
        f"AND {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(_LOWER.format('text'))} ELSE {leaf('text')} END AS claim FROM documents)",
        "s0 AS MATERIALIZED (SELECT doc_id, tree, leaf AS digest, claim, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, "
        "count(*) OVER (PARTITION BY tree) AS width FROM rows_)",
        *tree("s", "tree"),
        "t0 AS MATERIALIZED (SELECT 0 AS forest, tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS width FROM sroot)",
        *tree("t", "forest"),
        "d AS MATERIALIZED (SELECT s0.doc_id, s0.tree, 0 AS forest, s0.idx AS pos, t0.idx AS top, s0.digest AS leaf, s0.claim AS folded, '' AS proof, "
        "t0.digest AS subroot FROM s0 JOIN t0 USING (tree))", *up, *top_up]
    return ("WITH " + ",\n".join(ctes) + "\nSELECT doc_id, leaf, subroot, (SELECT digest FROM troot) AS root, sha256(proof) AS proof_sha256, "
            f"folded AS folded_root, folded = (SELECT digest FROM troot) AS verified FROM {ended}")


OP11_SQL = _merkle_sql(5)


def op12_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True, whole=False)


# A run of length >= max(12, 2q) has six words or more that are equal one period on, so pairs of equal six-word shingles
# at distance q, in a row, are the runs of period q; of one stretch the smallest q counts.
OP12_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws, {_crc32('doc_id::VARCHAR')} AS h FROM documents),
a AS MATERIALIZED (SELECT doc_id, ws, h, h // 10 AS g, len(ws) AS n, CASE WHEN len(ws) > 0 THEN h // 10 % len(ws) END AS a FROM d),
p AS MATERIALIZED (SELECT doc_id, ws, n, CASE WHEN h % 10 = 0 THEN a ELSE n END AS a, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS MATERIALIZED (
  SELECT doc_id, n, list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) AS ws FROM p WHERE n > 0),
g AS MATERIALIZED (
  SELECT doc_id, i - 1 AS i, hash(ws[i:i + 5]) AS g, ws[i:i + 5] AS x FROM (SELECT doc_id, ws, unnest(range(1, n - 4)) AS i FROM w)),
e AS MATERIALIZED (
  SELECT y.doc_id, y.i, z.i - y.i AS q FROM g y JOIN g z ON y.doc_id = z.doc_id AND y.g = z.g AND y.i < z.i AND y.x = z.x),
i AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM i GROUP BY doc_id, q, island),
r AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS q FROM s WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
b AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) AS place FROM r),
l AS MATERIALIZED (
  SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
t AS (SELECT doc_id, i - 1 AS i, ws[i] AS t FROM (SELECT doc_id, ws, unnest(range(1, n + 1)) AS i FROM w)),
k AS MATERIALIZED (SELECT t.doc_id, string_agg(t.t, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(l.n, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period,
  (1000 * b.length // b.q)::BIGINT AS exponent_milli, sha256(coalesce(l.runs, '')) AS runs_sha256,
  sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND b.place = 1 LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=5, part=85, whole=100)


OP13_SQL = _groups_sql(5, 85, ", c.component_id = d.doc_id AS kept")


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_ngram_jaccard_join, op2_license_scans, op3_temperature_mixing, op4_language_id, op5_url_filters, op6_benchmark_decontamination, op7_warc,
    op8_exact_top_k_search, op9_pii, op10_line_dedup, op11_merkle_manifest,
    op12_periodic_run_detection, op13_minhash_near_dedup)}

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_license_scans": OP2_SQL,
    "op3_temperature_mixing": OP3_SQL,
    "op5_url_filters": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op8_exact_top_k_search": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_periodic_run_detection": OP12_SQL,
    "op13_minhash_near_dedup": OP13_SQL,
}
