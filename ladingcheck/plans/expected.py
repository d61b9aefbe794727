"""What each query must give, stated over the source tables in ANSI SQL (DuckDB).

No text is parsed here: results follow from order columns and the injection rule.
"""

from __future__ import annotations

import re

from ladingcheck import constants as K

_FACTS = """
place AS (
  SELECT n_nationkey, n_name, 'PORT ' || n_name || ', ' || r_name AS place,
         'N' || translate(lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), '0123456789', 'ABCDEFGHIJ') AS code
  FROM nation JOIN region ON n_regionkey = r_regionkey),
lines AS (
  SELECT l_orderkey, min(l_suppkey) AS suppkey, count(*) AS containers,
         CAST(sum(CAST(l_quantity AS DECIMAL(12,0))) AS BIGINT) AS quantity
  FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT o_orderkey AS k, o_orderdate AS received_at, suppkey, s_name AS shipper, sp.n_name AS shipper_nation,
         c_name AS consignee, containers, sp.place AS pol, sp.code AS pol_code, cp.place AS pod, cp.code AS pod_code,
         'email_' || printf('%08d', o_orderkey) AS email_id,
         CASE WHEN (o_orderkey // 200) % 2 = 0 THEN 'participant' ELSE 'synthetic_demo' END AS registry,
         CASE WHEN (o_orderkey // 200) % 2 = 0 THEN 'EVAL' ELSE 'DEMO' END AS run_kind,
         o_orderkey % 10 AS m,
         CASE WHEN quantity IS NULL THEN 19 ELSE (o_orderkey // 10) % 20 END AS d,
         1000 + 100 * quantity + o_orderkey % 7 AS kg
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey
  LEFT JOIN supplier ON suppkey = s_suppkey LEFT JOIN place sp ON s_nationkey = sp.n_nationkey
  JOIN customer ON o_custkey = c_custkey JOIN place cp ON c_nationkey = cp.n_nationkey)
"""

_CASES = _FACTS + """,
exp AS (
  SELECT *, 'attachments/' || email_id AS base,
    m >= 4 AS is_bl, m >= 4 AND d <> 19 AS has_files,
    CASE WHEN m = 0 THEN 'SPAM' WHEN m = 1 THEN 'INVOICE_QUERY' WHEN m = 2 THEN 'SI_REQUEST' WHEN m = 3 THEN 'GENERAL'
         ELSE 'BL_COMPARISON' END AS category,
    CASE WHEN m = 0 THEN 'R-SPAM-1' WHEN m = 1 THEN 'R-INV-1' WHEN m = 2 THEN 'R-SI-1'
         WHEN m = 3 AND (k // 10) % 2 = 0 THEN 'R-GEN-1' WHEN m = 3 THEN 'R-GEN-DEFAULT' ELSE 'R-CMP-1' END AS rule_id,
    CASE WHEN m < 4 THEN NULL
         WHEN d = 1 THEN 'consignee' WHEN d = 2 THEN 'container_count' WHEN d = 3 THEN 'gross_weight_kg'
         WHEN d = 4 THEN 'shipper,port_of_discharge' WHEN d = 12 THEN 'port_of_loading' END AS wrong,
    CASE WHEN m < 4 THEN NULL WHEN d = 5 THEN 'missing_value' WHEN d IN (6, 19) THEN 'missing_attachment'
         WHEN d IN (7, 13) THEN 'wrong_doc_type' WHEN d IN (8, 14, 16, 17) THEN 'unreadable'
         WHEN d = 9 AND registry = 'participant' THEN 'unreadable' END AS review_reason
  FROM facts),
res AS (
  SELECT *, CASE WHEN review_reason IS NOT NULL THEN 'NEEDS_REVIEW' WHEN wrong IS NOT NULL THEN 'MISMATCH' ELSE 'OK' END AS status,
    coalesce(wrong, '') AS defects, wrong IS NOT NULL AS has_defect,
    CASE WHEN review_reason IS NULL THEN 'COMPLETED' WHEN d IN (6, 7, 17, 19) THEN 'BLOCKED_EXTERNAL' ELSE 'AWAITING_HUMAN' END AS workflow_status,
    CASE WHEN review_reason IS NULL AND wrong IS NOT NULL THEN 'CORRECTION_REQUIRED'
         WHEN review_reason IS NOT NULL AND d IN (6, 7, 17, 19) THEN 'AWAIT_EXTERNAL' ELSE 'NONE' END AS follow_up,
    CASE WHEN wrong IS NULL THEN 0 ELSE len(string_split(wrong, ',')) END AS mismatches,
    CASE WHEN review_reason IS NULL THEN NULL WHEN d IN (5, 8, 9, 16) THEN 'VALUE_INPUT' WHEN d IN (13, 14) THEN 'CHOICE'
         ELSE 'ACKNOWLEDGE' END AS ui_mode,
    CASE WHEN m >= 4 AND (k // 10) % 5 = 0 THEN 'REQUEST BL DRAFT ' || k ELSE 'Shipment ' || k END AS subject,
    'desk' || (k % 7) || '@example.test' AS from_addr
  FROM exp)
"""

_FIELDS = _CASES + """,
names AS (SELECT * FROM (VALUES ('shipper', 0), ('consignee', 1), ('notify_party', 2), ('port_of_loading', 3),
  ('port_of_discharge', 4), ('container_count', 5), ('gross_weight_kg', 6)) AS t(field, place_no)),
vals AS (
  SELECT r.*, field, place_no,
    CASE field
      WHEN 'shipper' THEN lower(shipper) || '   no ' || suppkey || ' dock road; ' || lower(shipper_nation)
      WHEN 'consignee' THEN lower(consignee) WHEN 'notify_party' THEN lower(consignee)
      WHEN 'port_of_loading' THEN lower(pol || ' (' || pol_code || ')')
      WHEN 'port_of_discharge' THEN lower(pod || ' (' || pod_code || ')')
      WHEN 'container_count' THEN CAST(containers AS VARCHAR)
      ELSE CASE WHEN d = 11 THEN CAST(1000 * (kg // 1000) AS VARCHAR) ELSE CAST(kg AS VARCHAR) END END AS si_all,
    CASE field
      WHEN 'shipper' THEN CASE WHEN d = 4 THEN 'other ' ELSE '' END || lower(shipper) || '   no ' || suppkey || ' dock road; ' || lower(shipper_nation)
      WHEN 'consignee' THEN CASE WHEN d = 1 THEN 'other ' ELSE '' END || lower(consignee)
      WHEN 'notify_party' THEN lower(consignee)
      WHEN 'port_of_loading' THEN CASE WHEN d = 12 THEN lower(pol) ELSE lower(pol || ' (' || pol_code || ')') END
      WHEN 'port_of_discharge' THEN CASE WHEN d = 4 THEN 'other ' ELSE '' END || lower(pod || ' (' || pod_code || ')')
      WHEN 'container_count' THEN CASE WHEN d = 2 THEN CAST(containers + 1 AS VARCHAR) WHEN d = 16 THEN NULL ELSE CAST(containers AS VARCHAR) END
      ELSE CASE WHEN d IN (5, 8, 14) OR (d = 9 AND registry = 'participant') THEN NULL WHEN d = 3 THEN CAST(kg + 100 AS VARCHAR)
                WHEN d = 11 THEN CAST(1000 * (kg // 1000) AS VARCHAR) ELSE CAST(kg AS VARCHAR) END END AS bl_all
  FROM res r CROSS JOIN names WHERE is_bl),
outc AS (
  SELECT *, CASE WHEN d <> 19 THEN regexp_replace(si_all, ' +', ' ', 'g') END AS si_value,
    CASE WHEN d NOT IN (6, 7, 13, 17, 19) THEN regexp_replace(bl_all, ' +', ' ', 'g') END AS bl_value,
    CASE WHEN d = 19 THEN 'DOCUMENT_LEVEL' END AS si_cause,
    CASE WHEN d IN (6, 7, 13, 17, 19) THEN 'DOCUMENT_LEVEL'
         WHEN bl_all IS NOT NULL THEN NULL
         WHEN d = 5 THEN 'MISSING_VALUE' WHEN d = 8 THEN 'MISSING_UNIT' WHEN d = 9 THEN 'AMBIGUOUS_SEPARATOR'
         ELSE 'COMPETING_CANDIDATES' END AS bl_cause
  FROM vals),
cmp AS (
  SELECT *, coalesce(si_cause, bl_cause) AS private_cause,
    CASE WHEN si_value IS NULL OR bl_value IS NULL THEN 'NOT_COMPARABLE' WHEN si_value = bl_value THEN 'MATCH' ELSE 'MISMATCH' END AS result,
    CASE coalesce(si_cause, bl_cause) WHEN 'MISSING_UNIT' THEN 'UNREADABLE' WHEN 'AMBIGUOUS_SEPARATOR' THEN 'AMBIGUOUS'
      WHEN 'COMPETING_CANDIDATES' THEN 'AMBIGUOUS' ELSE coalesce(si_cause, bl_cause) END AS public_cause
  FROM outc),
scored AS (
  SELECT *, CASE WHEN result = 'MISMATCH' THEN 0.98
    WHEN result = 'MATCH' AND d = 10 AND field = 'notify_party' THEN 0.94
    WHEN result = 'MATCH' AND field LIKE 'port%' THEN 0.98 WHEN result = 'MATCH' THEN 1.0
    WHEN public_cause = 'MISSING_VALUE' THEN 0.5 WHEN public_cause = 'AMBIGUOUS' THEN 0.4
    WHEN public_cause = 'UNREADABLE' THEN 0.2 ELSE 0.3 END AS confidence
  FROM cmp),
overall AS (
  SELECT email_id, CASE WHEN any_value(d) IN (6, 7, 13, 17, 19) THEN least(round(avg(CAST(confidence AS DOUBLE)), 2), 0.4)
    ELSE round(avg(CAST(confidence AS DOUBLE)), 2) END AS overall_confidence
  FROM scored GROUP BY email_id)
"""

_GROUND = _FIELDS + """,
cand AS (
  SELECT k % 11 AS t, field, 'SI' AS side, d = 10 AND field = 'notify_party' AS refers, 1 AS c FROM cmp WHERE si_value IS NOT NULL
  UNION ALL SELECT k % 11, field, 'BL', d = 10 AND field = 'notify_party',
    CASE WHEN field = 'gross_weight_kg' AND d = 15 THEN 2 ELSE 1 END FROM cmp WHERE bl_value IS NOT NULL
  UNION ALL SELECT k % 11, field, 'BL', false, 2 FROM cmp WHERE field = 'gross_weight_kg' AND d = 14)
"""

_DOCS = _CASES + """,
docs AS (
  SELECT r.*, t.kind, base || t.suffix AS path, substr(base || t.suffix, 13) AS filename,
    t.kind <> 'BL' OR d <> 6 AS present
  FROM res r CROSS JOIN (VALUES ('SI', '_SI.txt'), ('BL', '_BL.txt'), ('BL2', '_BL_rev2.txt')) AS t(kind, suffix)
  WHERE has_files AND (t.kind <> 'BL2' OR d = 13))
"""

_EVENTS = _CASES + """,
ev AS (
  SELECT e.*, (event_id // 2) % (SELECT max(o_orderkey) + 1 FROM orders) AS ek FROM events e),
dec AS (
  SELECT ev.*, r.*, CASE WHEN event_type = 'view' THEN 'ACKNOWLEDGE' WHEN event_type = 'purchase' THEN 'SELECT_OPTION' ELSE 'PROVIDE_VALUE' END AS action,
    CASE WHEN event_type = 'signup' THEN kg + 5 WHEN event_id % 3 = 0 THEN kg + 1 ELSE kg END AS typed,
    CASE WHEN (event_id // 4) % 2 = 0 THEN 'doc_1' ELSE 'val_1' END AS option_id
  FROM ev LEFT JOIN res r ON ek = r.k AND r.review_reason IS NOT NULL),
judged AS (
  SELECT *, CASE
    WHEN k IS NULL THEN 'NOT_FOUND' WHEN event_id % 17 = 3 THEN 'STALE_RUN'
    WHEN action = 'ACKNOWLEDGE' THEN CASE WHEN ui_mode = 'CHOICE' THEN 'ACTION_NOT_ALLOWED' END
    WHEN action = 'SELECT_OPTION' THEN CASE WHEN ui_mode <> 'CHOICE' THEN 'ACTION_NOT_ALLOWED'
        WHEN d = 13 AND option_id = 'val_1' OR d = 14 AND option_id = 'doc_1' THEN 'OPTION_NOT_FOUND' END
    WHEN ui_mode <> 'VALUE_INPUT' OR d = 16 THEN 'ACTION_NOT_ALLOWED'
    WHEN event_type = 'error' THEN 'INVALID_VALUE'
    WHEN event_type = 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'INVALID_CONFIRMATION' END
    WHEN d = 5 OR event_id % 3 = 0 THEN 'VALUE_NOT_FOUND_IN_DOCUMENT' END AS error_code
  FROM dec),
won AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS rn FROM judged WHERE error_code IS NULL) WHERE rn = 1),
applied AS (
  SELECT *, CASE WHEN action = 'ACKNOWLEDGE' THEN 'NEEDS_REVIEW' WHEN event_type = 'signup' THEN 'MISMATCH' ELSE 'OK' END AS final_status
  FROM won)
"""

_RUNS = """
runs AS (
  SELECT 'case_' || printf('%08d', l_orderkey) AS case_id,
    'run_' || printf('%08d', l_orderkey) || '_' || l_linenumber AS run_id,
    l_shipdate AS started_at, CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem),
cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY started_at DESC, run_id DESC, quantity DESC) AS rn FROM runs) WHERE rn = 1),
marked AS (SELECT *, run_id NOT IN (SELECT run_id FROM cur) AS old FROM runs)
"""

_LOG = """
log AS (
  SELECT printf('%012d', event_id) AS event_id, 'case_' || printf('%04d', event_id % 500) AS case_id,
    'case_' || printf('%04d', event_id % 500) || '_r' || ((event_id // 500) % 2) AS run_id, ts AS moment,
    CASE event_type WHEN 'signup' THEN 'CASE_CREATED' WHEN 'view' THEN 'REVIEW_NOTIFIED' WHEN 'click' THEN 'DECISION_RECEIVED'
      WHEN 'purchase' THEN 'CASE_COMPLETED' ELSE 'PROCESSING_FAILED' END AS type
  FROM events)
"""

_SCORES = _CASES + """,
truth AS (SELECT k, category, status, review_reason, has_defect,
  CASE WHEN wrong IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(wrong, ',') END AS fields FROM res),
sub AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'GENERAL' ELSE category END AS category,
  CASE WHEN k % 11 <> 0 AND k % 17 <> 0 AND k % 19 = 0 THEN 'NEEDS_REVIEW' ELSE status END AS status,
  k % 11 <> 0 AND has_defect AS has_defect,
  CASE WHEN k % 11 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 17 = 0 AND len(fields) > 0 THEN fields[1:len(fields)-1] ELSE fields END AS fields,
  CASE WHEN k % 2 = 0 THEN 'rule' WHEN k % 4 = 1 THEN 'model' END AS decided_by FROM truth WHERE k % 13 <> 0),
pairs AS (
  SELECT t.k, t.category AS t_category, t.status AS t_status, t.review_reason, t.has_defect AS gold, t.fields AS t_fields,
    coalesce(s.category, 'GENERAL') AS predicted, coalesce(s.category = 'BL_COMPARISON', false) AS routed,
    coalesce(s.has_defect, false) AS flagged, coalesce(s.status = 'NEEDS_REVIEW', false) AS escalated,
    coalesce(s.fields, CAST([] AS VARCHAR[])) AS s_fields, s.decided_by
  FROM truth t LEFT JOIN sub s ON t.k = s.k),
cats AS (SELECT * FROM (VALUES ('BL_COMPARISON'), ('SI_REQUEST'), ('INVOICE_QUERY'), ('GENERAL'), ('SPAM')) AS t(category)),
prf0 AS (
  SELECT category, count(*) FILTER (WHERE t_category = category AND predicted = category) AS tp,
    count(*) FILTER (WHERE t_category <> category AND predicted = category) AS fp,
    count(*) FILTER (WHERE t_category = category AND predicted <> category) AS fn
  FROM cats CROSS JOIN pairs GROUP BY category),
prf1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM prf0),
prf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM prf1),
cmpb AS (SELECT *, gold AND flagged AND routed AS hit, CASE WHEN routed THEN s_fields ELSE CAST([] AS VARCHAR[]) END AS f
  FROM pairs WHERE t_category = 'BL_COMPARISON' AND t_status <> 'NEEDS_REVIEW'),
def0 AS (SELECT count(*) AS doc_total, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT gold AND flagged AND routed) AS fp,
  count(*) FILTER (WHERE gold AND NOT (flagged AND routed)) AS fn, count(*) FILTER (WHERE list_sort(f) = list_sort(t_fields)) AS exact,
  sum(len(list_intersect(f, t_fields))) AS field_tp, sum(len(f) - len(list_intersect(f, t_fields))) AS field_fp,
  sum(len(t_fields) - len(list_intersect(f, t_fields))) AS field_fn FROM cmpb),
def AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, field_tp / (field_tp + field_fp) AS fp_, field_tp / (field_tp + field_fn) AS fr_ FROM def0),
e2e AS (SELECT count(*) AS total, count(*) FILTER (WHERE routed AND flagged AND list_sort(s_fields) = list_sort(t_fields)) AS success
  FROM pairs WHERE t_category = 'BL_COMPARISON' AND gold)
"""

_LABEL_ROWS = {
    # label place (p_partkey % 9): normalized, field, not_a_weight, not_a_count, ambiguous, total, kg, tonnes
    0: ("shipper/exporter", "shipper", 0, 0, 0, 0, 0, 0),
    1: ("consignee", "consignee", 0, 0, 0, 0, 0, 0),
    2: ("gross weight毛重(kgs) (毛重 kgs)", "gross_weight_kg", 0, 0, 0, 0, 1, 0),
    3: ("no. of containers or packages", "container_count", 0, 0, 1, 0, 0, 0),
    4: ("net weight", None, 1, 0, 0, 0, 0, 0),
    5: ("total gross weight (kgs)", "gross_weight_kg", 0, 0, 0, 1, 1, 0),
    6: ("intermediate consignee", "notify_party", 0, 0, 0, 0, 0, 0),
    7: ("gross wt (mt)", "gross_weight_kg", 0, 0, 0, 0, 0, 1),
    8: ("seal no", None, 1, 1, 0, 0, 0, 0),
}


def _case(key: str, values: dict, column: int) -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v}'"

    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {lit(v[column])}" for k, v in values.items()) + " END"


def _flag(key: str, values: dict, column: int) -> str:
    true = ", ".join(str(k) for k, v in values.items() if v[column])
    return f"{key} IN ({true})" if true else "false"


def _with(ctes: str, select: str) -> str:
    """The tables are named more than once each, so each is made once."""
    made_once = re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", ctes.strip())
    return f"WITH {made_once}\n{select}"


def oracle_sql() -> dict[str, str]:
    place9 = "p_partkey % 9"
    out: dict[str, str] = {
        # sources
        "s02_validate_emails": _with(_CASES, """
SELECT CASE k % 41 WHEN 1 THEN 'UNSAFE_EMAIL_ID' WHEN 2 THEN 'MISSING_SUBJECT' WHEN 3 THEN 'BAD_RECEIVED_AT'
  WHEN 4 THEN 'DUPLICATE_EMAIL_ID' ELSE 'good' END AS problem,
  sum(CASE WHEN k % 41 = 4 THEN 2 ELSE 1 END) AS n FROM res GROUP BY 1"""),
        "s03_decode_text": """
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'utf-8-sig' WHEN western THEN 'cp1252' END AS encoding,
  CASE WHEN doc_id % 4 IN (0, 1) THEN length(text) WHEN western THEN octet_length(encode(text)) + 2 END AS chars
FROM (SELECT *, doc_id % 4 = 2 AND NOT regexp_matches(hex(encode(text)), '^(..)*(81|8D|8F|90|9D)') AS western FROM documents)""",
        "s04_detect_format": """
SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'xlsx' WHEN 4 THEN 'unsupported'
  WHEN 5 THEN 'unsupported' WHEN 6 THEN 'unsupported' ELSE 'text' END AS format FROM documents""",
        "s05_media_type": f"""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf'
  WHEN 2 THEN '{K.MEDIA_TYPES[".docx"]}' WHEN 3 THEN '{K.MEDIA_TYPES[".xlsx"]}'
  ELSE 'application/octet-stream' END AS media_type FROM part""",
        "s06_resolve_sources": _with(_DOCS, """
SELECT run_kind, issue, count(*) AS n, count(*) FILTER (WHERE issue IS NULL) AS present,
  count(*) FILTER (WHERE issue IS NULL) AS hashed, count(*) AS document_ids
FROM (SELECT run_kind, CASE WHEN NOT present THEN 'MISSING_FILE' END AS issue FROM docs
      UNION ALL SELECT run_kind, 'UNSAFE_REFERENCE' FROM res WHERE m = 4)
GROUP BY run_kind, issue"""),
        "s07_verify_sources": _with(_DOCS, """
SELECT k % 25 <> 4 AS intact, count(*) AS n FROM docs WHERE present GROUP BY 1"""),
        "s08_pick_registry": _with(_CASES, """
SELECT registry, count(*) AS n, count(DISTINCT email_id) AS ids FROM (
  SELECT email_id, CASE WHEN m = 7 THEN 'synthetic_demo' ELSE registry END AS registry FROM res) GROUP BY registry"""),
        "s09_snapshot": _with(_CASES, """
SELECT run_kind, registry = 'synthetic_demo' AS demo_safe, CASE WHEN NOT has_files THEN 0 WHEN d = 13 THEN 3 ELSE 2 END AS source_count,
  count(*) AS n, count(*) AS versions, 28 AS id_length FROM res GROUP BY ALL"""),
        "s10_seed_cases": """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS config_version, count(*) AS n
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0 GROUP BY 1""",
        "s11_clear_inbox": """
SELECT 'cases' AS what, count(*) AS n FROM orders WHERE o_orderkey % 5 IN (0, 4)
UNION ALL SELECT 'jobs', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 5 IN (0, 4)""",
        "s12_submission": _with(_CASES, """
SELECT email_id AS case_id, '{"category":"' || category || '","defect_fields":[' ||
  CASE WHEN wrong IS NULL THEN '' ELSE '"' || replace(wrong, ',', '","') || '"' END || '],"has_defect":' ||
  CASE WHEN has_defect THEN 'true' ELSE 'false' END || ',"review_reason":' ||
  coalesce('"' || review_reason || '"', 'null') || ',"status":"' || status || '"}' AS body
FROM res WHERE run_kind = 'EVAL'"""),
        "s13_manifest": _with(_CASES, """
, l0 AS (SELECT case_id AS id, 1 AS n, sha256(case_id || chr(10) || body) AS h FROM (
SELECT email_id AS case_id, '{"category":"' || category || '","defect_fields":[' ||
  CASE WHEN wrong IS NULL THEN '' ELSE '"' || replace(wrong, ',', '","') || '"' END || '],"has_defect":' ||
  CASE WHEN has_defect THEN 'true' ELSE 'false' END || ',"review_reason":' ||
  coalesce('"' || review_reason || '"', 'null') || ',"status":"' || status || '"}' AS body
FROM res WHERE run_kind = 'EVAL')),
l1 AS (SELECT left(id, greatest(length(id) - 3, 0)) AS id, sum(n) AS n, sha256(string_agg(h, '' ORDER BY id)) AS h
  FROM l0 GROUP BY left(id, greatest(length(id) - 3, 0))),
l2 AS (SELECT left(id, greatest(length(id) - 3, 0)) AS id, sum(n) AS n, sha256(string_agg(h, '' ORDER BY id)) AS h
  FROM l1 GROUP BY left(id, greatest(length(id) - 3, 0))),
l3 AS (SELECT left(id, greatest(length(id) - 3, 0)) AS id, sum(n) AS n, sha256(string_agg(h, '' ORDER BY id)) AS h
  FROM l2 GROUP BY left(id, greatest(length(id) - 3, 0)))
SELECT '2.1.1' AS schema_version, 'EVAL' AS run_kind, 'v1' AS input_version, 'v1' AS config_version,
  sum(n)::BIGINT AS total_cases, sha256(string_agg(h, '' ORDER BY id)) AS sha256 FROM l3"""),
        "s14_report_csv": _with(_FIELDS, """
SELECT r.email_id AS case_id, r.category, r.workflow_status AS workflow, r.status,
  CAST(CAST(trunc(coalesce(o.overall_confidence, 1.0) * 100) AS INTEGER) AS VARCHAR) || '%' AS overall_confidence, r.follow_up,
  coalesce(c.field, 'N/A') AS field_name, coalesce(c.result, 'N/A') AS result,
  CAST(CAST(trunc(CAST(coalesce(c.confidence, 1.0) AS DOUBLE) * 100) AS INTEGER) AS VARCHAR) || '%' AS field_confidence,
  coalesce(c.si_value, '') AS si_normalized, coalesce(c.bl_value, '') AS bl_normalized
FROM res r LEFT JOIN overall o ON r.email_id = o.email_id LEFT JOIN scored c ON r.email_id = c.email_id"""),
        "s15_report_json": _with(_CASES, """
SELECT email_id AS case_id, category, status, CASE WHEN is_bl THEN 7 ELSE 0 END AS fields,
  CASE WHEN NOT has_files THEN 0 WHEN d = 13 THEN 3 ELSE 2 END AS documents,
  CASE WHEN ui_mode IS NULL THEN NULL WHEN ui_mode = 'VALUE_INPUT' OR d = 14 THEN 'FIELD' ELSE 'DOCUMENT' END AS scope, ui_mode FROM res"""),
        "s16_mime_rows": """
SELECT conv_id || '/' || turn AS path, 'Desk <desk@example.test>' AS from_addr, 'Conv ' || conv_id AS subject,
  length(trim(text, ' \t\n\r')) AS chars, 1 AS files FROM conversations""",
        "s17_strip_html": r"""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages""",
        "s18_safe_filename": """
SELECT page_id, CASE WHEN clean = '' OR clean LIKE '.%' THEN 'attachment_' || ltrim(clean, '.') ELSE clean END AS safe,
  page_id || '_1_' || CASE WHEN clean = '' OR clean LIKE '.%' THEN 'attachment_' || ltrim(clean, '.') ELSE clean END AS target
FROM (SELECT page_id, regexp_replace(string_split(rtrim(name, '/'), '/')[-1], '[^a-zA-Z0-9_.-]', '_', 'g') AS clean FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '.' ELSE 'p q/' END || regexp_replace(url, '^https?://', '') AS name FROM pages))""",
        # lists
        "f01_case_summary": _with(_CASES, """
SELECT email_id AS case_id, from_addr, subject, category, workflow_status, status AS machine_status, review_reason,
  status AS final_status, mismatches AS mismatch_count, ui_mode IS NOT NULL AS has_open_review, run_kind FROM res"""),
        "f02_list_cases": _with(_CASES, """
SELECT email_id AS case_id, review_reason, workflow_status FROM res WHERE is_bl AND status = 'NEEDS_REVIEW'
ORDER BY email_id LIMIT 50 OFFSET 5"""),
        "f03_scope": _with(_CASES, """
SELECT 'DEMO/EVAL' AS who, count(*) AS n FROM res WHERE run_kind = 'DEMO'
UNION ALL SELECT 'EVAL/None', count(*) FROM res WHERE run_kind = 'EVAL'
UNION ALL SELECT 'EVAL/DEMO', count(*) FROM res WHERE run_kind = 'DEMO'"""),
        "f04_demo_safe_only": _with(_CASES, "SELECT category, count(*) AS n FROM res WHERE run_kind = 'DEMO' GROUP BY category"),
        "f05_open_reviews": _with(_CASES, """
SELECT email_id AS case_id, CASE WHEN ui_mode = 'VALUE_INPUT' OR d = 14 THEN 'FIELD' ELSE 'DOCUMENT' END AS scope, ui_mode,
  CASE WHEN d IN (5, 8, 9, 14) THEN 'gross_weight_kg' WHEN d = 16 THEN 'container_count' END AS field,
  CASE WHEN d IN (5, 8, 9, 14, 16) THEN 'BL' END AS side, CASE WHEN d = 13 THEN 'BL' END AS target_role,
  CASE WHEN d IN (5, 8, 9) THEN 'What is the gross weight in kg on the BL document?'
    WHEN d = 16 THEN 'What is the container count on the BL document?'
    WHEN d = 14 THEN 'Which value is the gross weight in kg on the BL?'
    WHEN d = 13 THEN 'Which attachment is the BL for this shipment?'
    ELSE 'This case needs action outside the system. Please acknowledge.' END AS question
FROM res WHERE ui_mode IS NOT NULL"""),
        "f06_search_cases": _with(_CASES, """
SELECT email_id AS case_id, subject FROM res WHERE is_bl AND contains(lower(subject || ' ' || from_addr || ' ' || email_id), 'draft 1')"""),
        "f07_queue_group": _with(_CASES, """
SELECT g AS group_name, n AS cases FROM (SELECT count(*) AS "All cases", count(*) FILTER (WHERE ui_mode IS NOT NULL) AS "Needs input",
  count(*) FILTER (WHERE status = 'MISMATCH') AS "Discrepancies",
  count(*) FILTER (WHERE is_bl AND status = 'OK') AS "Matched",
  count(*) FILTER (WHERE workflow_status = 'BLOCKED_EXTERNAL') AS "Awaiting external",
  CAST(0 AS BIGINT) AS "Processing", CAST(0 AS BIGINT) AS "Failed" FROM res)
UNPIVOT (n FOR g IN ("All cases", "Needs input", "Discrepancies", "Matched", "Awaiting external", "Processing", "Failed"))"""),
        "f08_find_by_review": _with(_CASES, """
SELECT email_id AS case_id, workflow_status FROM res WHERE ui_mode IS NOT NULL ORDER BY email_id LIMIT 1"""),
        "f09_only_mismatches": _with(_CASES, "SELECT email_id AS case_id, defects FROM res WHERE status = 'MISMATCH'"),
        "f10_documents_by_role": _with(_CASES, """
SELECT email_id AS case_id, CASE WHEN has_files THEN email_id || '_SI.txt' END AS si_filename,
  CASE WHEN has_files AND d NOT IN (6, 7, 13, 17) THEN email_id || '_BL.txt' END AS bl_filename FROM res"""),
        # blocks
        "b01_label_blocks": _with(_DOCS, """
SELECT path AS document_id, CASE WHEN kind = 'SI' THEN
    'Shipper/Exporter|CONSIGNEE|NOTIFY PARTY|Port of Loading|Discharge Port|No. of Containers or Packages|'
    || CASE WHEN d = 18 THEN 'Gross Weight毛重(KGS)' ELSE 'Gross Weight (KG)' END || '|Booking Ref'
    || CASE WHEN registry = 'synthetic_demo' THEN '|Cargo Value' ELSE '' END
  WHEN d = 7 THEN 'Seller|Buyer|Invoice Amount'
  ELSE 'SHIPPER|Consignee (Non-Negotiable)|Notify Party|Load Port|POD|'
    || CASE d WHEN 16 THEN 'No. of Containers or Packages' WHEN 18 THEN 'CONTAINER COUNT' ELSE 'Container Count' END || '|'
    || CASE WHEN d IN (8, 11) THEN 'Gross Wt' WHEN d = 14 THEN 'Gross Wt (kgs)|Gross Weight' WHEN d = 15 THEN 'Gross Wt (kgs)|Total Gross Weight'
       ELSE 'Gross Wt (kgs)' END || '|B/L No' END AS labels
FROM docs WHERE present AND NOT (kind = 'BL' AND d = 17)"""),
        "b01_offsets": _with(_DOCS, """
SELECT sum(CASE WHEN kind = 'SI' THEN 8 + CASE WHEN registry = 'synthetic_demo' THEN 1 ELSE 0 END
  WHEN d = 7 THEN 3 WHEN d IN (14, 15) THEN 9 ELSE 8 END) AS blocks, CAST(0 AS BIGINT) AS wrong
FROM docs WHERE present AND NOT (kind = 'BL' AND d = 17)"""),
        "b02_column_blocks": _with(_FACTS, """
SELECT email_id AS document_id, t.ord, t.label, replace(CASE t.ord WHEN 0 THEN shipper || '|                NO ' || suppkey
  WHEN 1 THEN consignee ELSE pol || '|Gross Weight    ' || kg || ' KG' END, chr(10), '|') AS value
FROM facts CROSS JOIN (VALUES (0, 'Shipper'), (1, 'Consignee'), (2, 'POL')) AS t(ord, label) WHERE containers IS NOT NULL"""),
        "b03_grid_blocks": _with(_FACTS, """
SELECT email_id AS document_id, t.r AS row, t.label, CASE t.r WHEN 1 THEN shipper WHEN 2 THEN CAST(containers AS VARCHAR)
  WHEN 3 THEN kg || '.5' ELSE consignee END AS value, CASE t.r WHEN 1 THEN CASE WHEN t.label = 'Shipper' THEN 'remark' ELSE '' END ELSE '' END AS extra
FROM facts CROSS JOIN (VALUES (2, 'Container Count'), (3, 'Gross Weight (KG)'), (4, 'Consignee')) AS t(r, label) WHERE containers IS NOT NULL
UNION ALL SELECT email_id, 1, 'Shipper', '', '' FROM facts WHERE containers IS NOT NULL
UNION ALL SELECT email_id, 1, shipper, 'remark', '' FROM facts WHERE containers IS NOT NULL"""),
        "b04_merged_cells": _with(_FACTS, """
SELECT t.r AS row, t.c AS col, count(*) AS n FROM facts CROSS JOIN
  (VALUES (1,1),(1,3),(1,4),(2,1),(2,3),(3,1),(3,2),(4,1),(4,2)) AS t(r, c) WHERE containers IS NOT NULL GROUP BY 1, 2"""),
        "b05_render_cell": _with(_FACTS, """
SELECT email_id AS document_id, t.r AS row, t.c AS col, CASE t.r WHEN 2 THEN CAST(containers AS VARCHAR) WHEN 3 THEN kg || '.5' ELSE '' END AS text
FROM facts CROSS JOIN (VALUES (2, 3), (3, 2), (4, 2)) AS t(r, c) WHERE containers IS NOT NULL"""),
        "b06_heading": _with(_DOCS, """
SELECT CASE WHEN kind = 'SI' THEN 'SHIPPING INSTRUCTION' WHEN d = 7 THEN 'COMMERCIAL INVOICE' ELSE 'BILL OF LADING (DRAFT)' END AS first_line,
  CASE WHEN d = 7 AND kind = 'BL' THEN 5 ELSE 6 END AS lines, count(*) AS n
FROM docs WHERE present AND NOT (kind = 'BL' AND d = 17) GROUP BY 1, 2"""),
        "b07_page_status": _with(_FACTS, """
SELECT CASE WHEN k % 11 = 0 THEN 'UNREADABLE' ELSE 'OK' END AS status,
  CASE WHEN k % 11 = 0 AND k % 2 = 0 THEN 'IMAGE_ONLY_PAGE,IMAGE_ONLY_DOCUMENT' WHEN k % 11 = 0 THEN 'IMAGE_ONLY_DOCUMENT' ELSE '' END AS diagnostics,
  count(*) AS n FROM facts WHERE containers IS NOT NULL GROUP BY 1, 2"""),
        "b07_grid_status": _with(_FACTS, """
SELECT email_id AS document_id, 'OK' AS status, 8 AS filled, 9 AS cell_count, '' AS diagnostics FROM facts WHERE containers IS NOT NULL"""),
        "b08_quote_view": _with(_CASES, """
SELECT email_id, 11 + length(CASE WHEN m = 0 THEN 'Congratulations, you have won a prize' WHEN m = 1 THEN 'Query on invoice ' || k || ': please advise'
  WHEN m = 2 THEN 'Please find attached shipping instructions for ' || k || '. Kindly prepare the draft.'
  WHEN m = 3 AND (k // 10) % 2 = 0 THEN 'Vessel schedule update for voyage ' || k WHEN m = 3 THEN 'Good morning, noted with thanks.'
  ELSE 'Please compare the SI and draft BL and confirm the shipment details agree.' END) AS current_chars,
  CASE WHEN k % 3 = 0 THEN 99 ELSE 0 END AS quoted_chars FROM res"""),
        # intent
        "k01_classify": _with(_CASES, """
SELECT email_id, category, rule_id, 'DETERMINISTIC' AS classified_by, rule_id = 'R-GEN-DEFAULT' AS unresolved FROM res"""),
        "k02_relevance": _with(_CASES, """
SELECT email_id, rule_id NOT IN ('R-SPAM-1', 'R-GEN-DEFAULT') AND NOT (k % 3 = 0 AND true) AS relevant,
  CASE WHEN m = 0 THEN 'Unsolicited promotional / spam content (Congratulations, you have won)'
    WHEN k % 3 = 0 THEN 'Unsolicited promotional / spam content (congratulations you have won)'
    WHEN rule_id = 'R-GEN-DEFAULT' THEN 'Automated third-party service / non-shipping notification'
    WHEN rule_id = 'R-GEN-1' THEN 'Matched operational maritime / shipping traffic' ELSE 'Matched shipping intent: ' || category END AS reason FROM res"""),
        "k03_classify_with_proposals": _with(_CASES, """
SELECT email_id, CASE WHEN rule_id <> 'R-GEN-DEFAULT' THEN category WHEN k % 7 = 0 OR k % 3 = 1 THEN NULL ELSE 'GENERAL' END AS category,
  CASE WHEN rule_id <> 'R-GEN-DEFAULT' THEN 'DETERMINISTIC' WHEN k % 7 = 0 OR k % 3 = 1 THEN NULL ELSE 'AI' END AS classified_by,
  CASE WHEN rule_id <> 'R-GEN-DEFAULT' THEN NULL WHEN k % 7 = 0 THEN 'UNKNOWN_CATEGORY' WHEN k % 3 = 1 THEN 'FABRICATED_QUOTE' END AS proposal_problem FROM res"""),
        "k04_call_budget": """
SELECT rn <= 3 AS allowed, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem) GROUP BY 1""",
        "k05_consent_gate": _with(_CASES, "SELECT registry, count(*) AS n FROM res WHERE m = 3 AND registry <> 'participant' GROUP BY registry"),
        # roles
        "r01_role_scores": _with(_DOCS, """
SELECT path, CASE WHEN kind = 'SI' THEN 4.5 ELSE 0.0 END AS si,
  CASE WHEN kind = 'SI' OR d = 7 OR (kind = 'BL' AND d = 17) THEN 0.0 ELSE 4.5 END AS bl,
  CASE WHEN kind = 'BL' AND d = 7 THEN 5.0 ELSE 0.0 END AS other FROM docs WHERE present"""),
        "r02_assess_role": _with(_DOCS, """
SELECT path, CASE WHEN kind = 'SI' THEN 'SI' WHEN d = 17 THEN 'UNKNOWN' WHEN d = 7 THEN 'OTHER' ELSE 'BL' END AS role,
  CASE WHEN kind = 'SI' THEN 4.5 WHEN d = 17 THEN 0.0 WHEN d = 7 THEN 5.0 ELSE 4.5 END AS score,
  NOT (kind = 'BL' AND d = 17) AS readable FROM docs WHERE present"""),
        "r03_field_label_count": _with(_DOCS, """
SELECT path, CASE WHEN kind = 'BL' AND d IN (7, 17) THEN 0 ELSE 7 END AS field_labels FROM docs WHERE present"""),
        "r04_resolve_roles": _with(_CASES, """
SELECT email_id AS case_id, true AS has_si, d NOT IN (6, 7, 13, 17) AS has_bl, 0 AS si_alternatives,
  CASE WHEN d = 13 THEN 2 ELSE 0 END AS bl_alternatives FROM res WHERE has_files"""),
        "r05_role_issues": _with(_CASES, """
SELECT email_id AS case_id, CASE d WHEN 6 THEN 'BL_MISSING,SOURCE_MISSING' WHEN 7 THEN 'BL_WRONG_DOC_TYPE'
  WHEN 13 THEN 'BL_AMBIGUOUS_CANDIDATES,BL_ROLE_UNRESOLVED' WHEN 17 THEN 'BL_UNREADABLE,UNREADABLE_DOCUMENT'
  WHEN 19 THEN 'SI_MISSING,BL_MISSING' ELSE '' END AS issues FROM res WHERE is_bl"""),
        "r06_filename_hint": _with(_DOCS, """
SELECT path, CASE kind WHEN 'SI' THEN 'SI' WHEN 'BL' THEN 'BL' END AS hint FROM docs"""),
        "r07_role_of": _with(_DOCS, """
SELECT role, parse_status, count(*) AS n FROM (SELECT CASE WHEN NOT present THEN 'UNKNOWN' WHEN kind = 'SI' THEN 'SI'
  WHEN d IN (7, 13) THEN 'OTHER' WHEN d = 17 THEN 'UNKNOWN' ELSE 'BL' END AS role,
  CASE WHEN NOT present THEN 'NOT_PARSED' WHEN kind = 'BL' AND d = 17 THEN 'UNSUPPORTED' ELSE 'OK' END AS parse_status FROM docs)
GROUP BY 1, 2"""),
        # labels
        "l01_normalize_label": f"SELECT p_partkey, {_case(place9, _LABEL_ROWS, 0)} AS normalized FROM part",
        "l02_label_variants": f"""
SELECT p_partkey, CASE {place9}
  WHEN 2 THEN 'gross weight;gross weight (kgs) ( kgs);gross weight(kgs) ( kgs);gross weight毛重;gross weight毛重 (kgs) (毛重 kgs);gross weight毛重(kgs) (毛重 kgs)'
  WHEN 5 THEN 'total gross weight;total gross weight (kgs)' WHEN 7 THEN 'gross wt;gross wt (mt)'
  ELSE {_case(place9, _LABEL_ROWS, 0)} END AS variants FROM part""",
        "l03_match_field": f"SELECT p_partkey, {_case(place9, _LABEL_ROWS, 1)} AS field FROM part",
        "l04_negative_label": f"""
SELECT p_partkey, {_flag(place9, _LABEL_ROWS, 2)} AS not_a_weight, {_flag(place9, _LABEL_ROWS, 3)} AS not_a_count FROM part""",
        "l05_label_flags": f"""
SELECT p_partkey, {_flag(place9, _LABEL_ROWS, 4)} AS ambiguous, {_flag(place9, _LABEL_ROWS, 5)} AS total,
  {_flag(place9, _LABEL_ROWS, 6)} AS kg, {_flag(place9, _LABEL_ROWS, 7)} AS tonnes FROM part""",
        # values
        "n01_is_missing": "SELECT p_partkey, p_partkey % 9 NOT IN (2, 3, 5) AS missing FROM part",
        "n02_normalize_party": """
SELECT c_custkey, lower(c_name) || ' ltd' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'ab' END AS party FROM customer""",
        "n03_normalize_port": _with(_FACTS, "SELECT k, lower(pod || ' (' || pod_code || ')') AS port FROM facts"),
        "n04_port_alternatives": _with(_FACTS, "SELECT k, k % 2 = 0 AND regexp_matches(pod, '[A-Za-z]{2,}$') AS several FROM facts"),
        "n05_port_code": _with(_FACTS, "SELECT k, CASE WHEN k % 3 <> 0 THEN pod_code END AS code FROM facts"),
        "n06_port_code_state": """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'corpus_convention' WHEN 1 THEN 'absent' WHEN 2 THEN 'contradicted'
  WHEN 3 THEN 'unestablished' ELSE 'corpus_convention' END AS state FROM part""",
        "n07_port_key": """
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'singapore' END AS key,
  CASE p_partkey % 5 WHEN 0 THEN 'singapore' WHEN 1 THEN 'singapore' WHEN 4 THEN 'nantong, china' END AS approved_key FROM part""",
        "n08_port_equal": """
SELECT p_partkey, p_partkey % 5 = 1 AS same, p_partkey % 5 IN (0, 1) AS same_approved FROM part""",
        "n09_countries": """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'KR' WHEN 1 THEN 'SI,TR' WHEN 2 THEN '' ELSE 'VN' END AS countries FROM part""",
        "n10_doc_convention": _with(_DOCS, """
SELECT path, CASE WHEN kind = 'SI' AND registry = 'synthetic_demo' THEN 'en' ELSE '' END AS convention
FROM docs WHERE present AND NOT (kind = 'BL' AND d = 17)"""),
        "n11_corpus_convention": """
SELECT registry, registry_convention FROM (VALUES ('participant', ''), ('synthetic_demo', 'en')) AS t(registry, registry_convention)""",
        "n12_parse_number": """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN CAST(l_orderkey + 1 AS VARCHAR)
    WHEN 2 THEN ((l_orderkey + 1) * 1000 + 5) || '.25' WHEN 3 THEN ((l_orderkey + 1) * 1000 + 5) || '.25'
    WHEN 5 THEN (l_orderkey + 1) || '.5' END AS number,
  CASE l_linenumber WHEN 4 THEN 'LONE_SEPARATOR_AMBIGUOUS' WHEN 6 THEN 'MALFORMED_SEPARATORS' WHEN 7 THEN 'NOT_NUMERIC' END AS reason,
  CASE l_linenumber WHEN 1 THEN CAST(l_orderkey + 1 AS VARCHAR) WHEN 2 THEN ((l_orderkey + 1) * 1000 + 5) || '.25'
    WHEN 3 THEN ((l_orderkey + 1) * 1000 + 5) || '.25' WHEN 4 THEN CAST(7000 + (l_orderkey + 1) % 1000 AS VARCHAR)
    WHEN 5 THEN (l_orderkey + 1) || '.5' END AS en_number FROM lineitem""",
        "n13_parse_count": """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
    WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) + 1 AS VARCHAR) WHEN 3 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS number,
  CASE WHEN l_linenumber = 4 THEN 'NON_POSITIVE' WHEN l_linenumber > 4 THEN 'UNRECOGNIZED_COUNT_FORMAT' END AS reason,
  CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
    WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) + 1 AS VARCHAR) END AS strict_number,
  CASE WHEN l_linenumber = 3 THEN 'NO_CONTAINER_CONTEXT' WHEN l_linenumber = 4 THEN 'NON_POSITIVE'
    WHEN l_linenumber > 4 THEN 'UNRECOGNIZED_COUNT_FORMAT' END AS strict_reason FROM lineitem""",
        "n14_parse_weight": """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
    WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) * 1000 AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) * 1000 AS VARCHAR)
    WHEN 5 THEN CAST(l_quantity AS INTEGER) || '.5' WHEN 6 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS number,
  CASE l_linenumber % 7 WHEN 0 THEN 'kg' WHEN 1 THEN 'mt' WHEN 2 THEN 'mt' WHEN 3 THEN 'tons' WHEN 4 THEN 'stones' WHEN 5 THEN 'kgs' ELSE 'kilograms' END AS unit,
  CASE l_linenumber % 7 WHEN 3 THEN 'AMBIGUOUS_UNIT' WHEN 4 THEN 'UNKNOWN_UNIT' END AS reason FROM lineitem""",
        "n16_wire_number": """
SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 1 AS ok FROM lineitem""",
        "n17_parse_user_value": """
WITH v AS (SELECT ['shipper','consignee','notify_party','port_of_loading','port_of_discharge','container_count','gross_weight_kg'][(l_linenumber % 7) + 1] AS field,
  l_orderkey % 5 AS o FROM lineitem),
w AS (SELECT field, CASE WHEN field NOT IN ('container_count', 'gross_weight_kg') THEN ['acme, ltd', '1,500', '12.5', '3', '-4'][o + 1]
  WHEN o = 1 THEN '1500' WHEN o = 2 AND field = 'gross_weight_kg' THEN '12.5' WHEN o = 3 THEN '3' END AS norm_key FROM v)
SELECT field, norm_key, CASE WHEN norm_key IS NULL THEN 'INVALID_VALUE' END AS error_code, count(*) AS n FROM w GROUP BY ALL""",
        "n18_interpretations": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '4' || t || ',' || rtrim(rtrim('4.' || t, '0'), '.')
  ELSE '4' || t || ',4' || t || '000' END AS readings
FROM (SELECT *, lpad(CAST(l_orderkey % 1000 AS VARCHAR), 3, '1') AS t FROM lineitem)""",
        "n15_normalize_value": _with(_DOCS, """
, chosen AS (SELECT d.*, kind AS side FROM docs d WHERE present AND (kind = 'SI' OR d NOT IN (6, 7, 13, 17, 19))),
names AS (SELECT * FROM (VALUES ('shipper', 'TEXT'), ('consignee', 'TEXT'), ('notify_party', 'TEXT'), ('port_of_loading', 'TEXT'),
  ('port_of_discharge', 'TEXT'), ('container_count', 'INTEGER'), ('gross_weight_kg', 'DECIMAL')) AS t(field, kind0)),
every AS (SELECT field, side, CASE WHEN side = 'BL' AND (field = 'gross_weight_kg' AND (d IN (5, 8) OR d = 9 AND registry = 'participant')
    OR field = 'container_count' AND d = 16) THEN NULL ELSE kind0 END AS norm_kind,
  CASE WHEN side = 'BL' AND field = 'gross_weight_kg' AND d IN (14, 15) THEN 2 ELSE 1 END AS c FROM chosen CROSS JOIN names)
SELECT field, side, norm_kind, sum(c) AS n, CASE WHEN norm_kind IS NULL THEN 0 ELSE sum(c) END AS usable FROM every GROUP BY 1, 2, 3"""),
        # outcomes
        "x02_same_as_consignee": _with(_FIELDS, """
SELECT email_id AS case_id, side, field, si_value AS value, 2 AS quotes FROM cmp CROSS JOIN (VALUES ('SI'), ('BL')) AS s(side)
WHERE d = 10 AND field = 'notify_party'"""),
        "x03_preferred": _with(_FIELDS, """
SELECT email_id AS case_id, 'BL' AS side, bl_value AS value, 1 AS alternatives FROM cmp WHERE d = 15 AND field = 'gross_weight_kg'"""),
        "x04_resolve_field": _with(_FIELDS, """
SELECT email_id AS case_id, 'SI' AS side, field, si_value AS value, si_cause AS cause FROM cmp
UNION ALL SELECT email_id, 'BL', field, bl_value, bl_cause FROM cmp"""),
        "x05_extract_sides": _with(_CASES, """
SELECT email_id AS case_id, 14 AS outcomes, 14 AS distinct_targets FROM res WHERE is_bl"""),
        "x06_unresolved_targets": _with(_FIELDS, """
SELECT case_id, rn AS place, field, side, cause FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY place_no, so) AS rn FROM (
  SELECT email_id AS case_id, field, 'SI' AS side, si_cause AS cause, place_no, 0 AS so FROM cmp WHERE si_cause IS NOT NULL
  UNION ALL SELECT email_id, field, 'BL', bl_cause, place_no, 1 FROM cmp WHERE bl_cause IS NOT NULL))"""),
        "x07_judge_proposals": _with(_CASES, """
SELECT 'BL' AS side, 'gross_weight_kg' AS field, CASE WHEN k % 5 = 0 THEN 'EVIDENCE_DISAGREES' WHEN k % 7 = 0 THEN 'DISCLAIMED' END AS rejected,
  count(*) * 2 AS n FROM res WHERE is_bl AND d = 14 GROUP BY 3
UNION ALL SELECT 'BL', 'container_count', 'NOT_REQUESTED', count(*) FROM res WHERE is_bl AND d = 16"""),
        "x07_apply_proposals": _with(_CASES, """
SELECT field, side, assisted, count(*) AS n FROM (
  SELECT 'gross_weight_kg' AS field, 'BL' AS side, k % 2 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 AS assisted FROM res WHERE is_bl AND d = 14
  UNION ALL SELECT 'container_count', 'BL', false FROM res WHERE is_bl AND d = 16) GROUP BY ALL"""),
        "x08_field_value": _with(_FIELDS, """
SELECT side, field, 'DETERMINISTIC' AS resolved_by, 'DOCUMENT_EXTRACTED' AS value_origin, true AS grounded, count(*) AS n FROM (
  SELECT 'SI' AS side, field FROM cmp WHERE si_value IS NOT NULL UNION ALL SELECT 'BL', field FROM cmp WHERE bl_value IS NOT NULL)
GROUP BY ALL"""),
        "g04_ground": _with(_FIELDS, """
SELECT side, true AS grounded, sum(c) AS n FROM (
  SELECT 'SI' AS side, 1 AS c FROM cmp WHERE si_value IS NOT NULL
  UNION ALL SELECT 'BL', CASE WHEN field = 'gross_weight_kg' AND d = 15 THEN 2 ELSE 1 END FROM cmp WHERE bl_value IS NOT NULL
  UNION ALL SELECT 'BL', 2 FROM cmp WHERE field = 'gross_weight_kg' AND d = 14) GROUP BY side"""),
        "g05_document_support": _with(_CASES, """
SELECT email_id AS case_id, d NOT IN (3, 5) AND NOT (d = 11 AND kg % 1000 <> 0) AS supported,
  CASE WHEN d IN (3, 5) OR d = 11 AND kg % 1000 <> 0 THEN NULL WHEN d IN (8, 11) THEN 'Gross Wt' ELSE 'Gross Wt (kgs)' END AS label
FROM res WHERE is_bl AND d NOT IN (6, 7, 13, 17, 19)"""),
        "g01_check_source": _with(_GROUND, """
SELECT CASE WHEN t IN (1, 2, 3) THEN 'G1' END AS failed_gate,
  CASE t WHEN 1 THEN 'QUOTE_MISMATCH' WHEN 2 THEN 'NO_EVIDENCE' WHEN 3 THEN 'NO_BOUND_BLOCK' END AS failure, sum(c) AS n
FROM cand WHERE NOT (t = 4 AND field = 'shipper') AND NOT (t = 5 AND NOT refers) GROUP BY 1, 2"""),
        "g02_check_label": _with(_GROUND, """
SELECT 'LABEL_DOES_NOT_SUPPORT_FIELD' AS failure, sum(c) AS n FROM cand WHERE t = 4 AND field = 'shipper'"""),
        "g03_check_derivation": _with(_GROUND, """
SELECT CASE WHEN field LIKE 'port%' THEN 'PORT_DERIVATION_MISMATCH' WHEN field = 'container_count' THEN 'COUNT_MISMATCH'
  WHEN field = 'gross_weight_kg' THEN 'WEIGHT_MISMATCH' WHEN refers THEN 'REFERENCE_MISMATCH' ELSE 'PARTY_DERIVATION_MISMATCH' END AS failure, sum(c) AS n
FROM cand WHERE t = 5 AND NOT refers GROUP BY 1"""),
        # comparison
        "c01_values_equal": _with(_FIELDS, """
SELECT field, count(*) AS n, count(*) FILTER (WHERE si_value = bl_value) AS equal FROM cmp
WHERE si_value IS NOT NULL AND bl_value IS NOT NULL GROUP BY field"""),
        "c02_compare": _with(_FIELDS, """
SELECT email_id AS case_id, field, result, public_cause AS not_comparable_cause, private_cause FROM cmp"""),
        "c03_confidence": _with(_FIELDS, """
SELECT email_id AS case_id, field, CAST(confidence AS DOUBLE) AS confidence FROM scored"""),
        "c09_review_text": _with(_FIELDS, """
SELECT r.email_id AS case_id, CASE WHEN r.ui_mode IS NULL THEN NULL
    WHEN r.d IN (5, 8, 9) THEN 'What is the gross weight in kg on the BL document?'
    WHEN r.d = 16 THEN 'What is the container count on the BL document?' WHEN r.d = 14 THEN 'Which value is the gross weight in kg on the BL?'
    WHEN r.d = 13 THEN 'Which attachment is the BL for this shipment?'
    ELSE 'This case needs action outside the system. Please acknowledge.' END AS question, coalesce(w.mismatches, '') AS mismatches
FROM res r LEFT JOIN (SELECT email_id, string_agg(CASE field WHEN 'gross_weight_kg' THEN 'gross weight in kg' ELSE replace(field, '_', ' ') END
  || ': SI ' || si_value || ', BL ' || bl_value, '; ' ORDER BY place_no) AS mismatches FROM cmp WHERE result = 'MISMATCH' GROUP BY 1) w
  ON r.email_id = w.email_id WHERE r.status = 'MISMATCH' OR r.ui_mode IS NOT NULL"""),
        "c04_document_reason": _with(_CASES, """
SELECT CASE WHEN d IN (6, 19) THEN 'missing_attachment' WHEN d IN (7, 13) THEN 'wrong_doc_type' WHEN d = 17 THEN 'unreadable' END AS reason,
  count(*) AS n FROM res WHERE is_bl GROUP BY 1"""),
        "c05_roll_up": _with(_FIELDS, """
SELECT r.email_id AS case_id, status, review_reason, has_defect, defects, coalesce(o.overall_confidence, 1.0) AS overall_confidence
FROM res r LEFT JOIN overall o ON r.email_id = o.email_id"""),
        "c06_follow_up": _with(_CASES, "SELECT category, follow_up, count(*) AS n FROM res GROUP BY 1, 2"),
        "c07_workflow_status": _with(_CASES, "SELECT run_kind, workflow_status, count(*) AS n FROM res GROUP BY 1, 2"),
        "c08_review_requirement": _with(_CASES, """
SELECT email_id AS case_id, CASE WHEN ui_mode = 'VALUE_INPUT' OR d = 14 THEN 'FIELD' ELSE 'DOCUMENT' END AS scope, ui_mode, review_reason AS reason,
  CASE WHEN d IN (5, 8, 9, 14) THEN 'gross_weight_kg' WHEN d = 16 THEN 'container_count' END AS field,
  CASE WHEN d IN (5, 8, 9, 14, 16) THEN 'BL' END AS side, CASE WHEN d = 13 THEN 'BL' END AS target_role,
  CASE WHEN d = 13 THEN 'doc_1,doc_2,NONE_OF_THESE' WHEN d = 14 THEN 'val_1,val_2,NONE_OF_THESE' END AS options,
  CASE ui_mode WHEN 'CHOICE' THEN 'SELECT_OPTION' WHEN 'VALUE_INPUT' THEN 'PROVIDE_VALUE,ACKNOWLEDGE' ELSE 'ACKNOWLEDGE' END AS actions,
  ui_mode = 'ACKNOWLEDGE' AS blocks FROM res WHERE ui_mode IS NOT NULL"""),
        "c10_verify": _with(_CASES, """
SELECT run_kind, email_id AS case_id, category, rule_id, status, review_reason, has_defect, defects, workflow_status, follow_up FROM res"""),
        # decisions
        "d01_validate_decisions": _with(_EVENTS, """
SELECT event_id, action, error_code, coalesce(error_code IS NULL AND action = 'ACKNOWLEDGE', false) AS escape,
  CASE WHEN error_code IS NULL AND (action = 'PROVIDE_VALUE' OR d = 14 AND action = 'SELECT_OPTION') THEN 'gross_weight_kg' END AS target_field,
  CASE WHEN error_code IS NULL AND d = 13 AND action = 'SELECT_OPTION' THEN 'BL' END AS choice_role,
  CASE WHEN error_code IS NULL AND event_type = 'signup' THEN 'MANUAL_OVERRIDE'
    WHEN error_code IS NULL AND (action = 'PROVIDE_VALUE' OR d = 14 AND action = 'SELECT_OPTION') THEN 'DOCUMENT_CONFIRMED' END AS value_origin,
  coalesce(error_code IS NULL AND event_type <> 'signup' AND (action = 'PROVIDE_VALUE' OR d = 14 AND action = 'SELECT_OPTION'), false) AS grounded,
  CASE WHEN error_code IS NOT NULL THEN NULL WHEN action = 'PROVIDE_VALUE' THEN CAST(typed AS VARCHAR)
    WHEN action = 'SELECT_OPTION' AND d = 14 AND option_id = 'val_1' THEN CAST(kg AS VARCHAR) END AS norm_key FROM judged"""),
        "d02_check_confirmation": _with(_EVENTS, """
SELECT error_code, count(*) AS n FROM judged WHERE event_type = 'signup'
  AND (error_code IS NULL OR error_code = 'INVALID_CONFIRMATION') GROUP BY 1"""),
        "d03_first_accepted_wins": _with(_EVENTS, "SELECT event_id, k, action FROM won"),
        "d04_budget_ledger": """
WITH d AS (SELECT 'run_' || printf('%02d', event_id % 50) AS run_id, event_id AS sequence,
  CASE WHEN event_type <> 'view' THEN ['shipper', 'consignee', 'notify_party', 'port_of_loading'][(user_id % 4) + 1] END AS f,
  CASE WHEN user_id % 2 = 0 THEN 'SI' ELSE 'BL' END AS s, event_type = 'view' AS choice FROM events),
x AS (SELECT *, CASE WHEN f IS NOT NULL THEN row_number() OVER (PARTITION BY run_id, f ORDER BY sequence) - 1 END AS field_before,
  CASE WHEN f IS NOT NULL THEN row_number() OVER (PARTITION BY run_id, f, s ORDER BY sequence) - 1 END AS field_side_before,
  CASE WHEN choice THEN row_number() OVER (PARTITION BY run_id, choice, s ORDER BY sequence) - 1 END AS role_before,
  f IS NOT NULL AND row_number() OVER (PARTITION BY run_id, f ORDER BY sequence) = 1 AS is_new FROM d),
y AS (SELECT *, coalesce(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER w, 0) AS fields_before,
  coalesce(sum(CASE WHEN choice THEN 1 ELSE 0 END) OVER w, 0) AS choices_before FROM x
  WINDOW w AS (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run_id, sequence, field_before, field_side_before, role_before, fields_before, choices_before,
  CASE WHEN choice THEN role_before < 1 AND choices_before < 2
    ELSE field_before < 2 AND field_side_before < 1 AND (NOT is_new OR fields_before < 2) END AS allowed FROM y""",
        "d05_apply_decisions": _with(_EVENTS, """
SELECT email_id AS case_id, 'NEEDS_REVIEW' AS machine_status, final_status, CASE WHEN final_status = 'MISMATCH' THEN 'gross_weight_kg' ELSE '' END AS defects,
  CASE WHEN final_status = 'NEEDS_REVIEW' THEN 'BLOCKED_EXTERNAL' ELSE 'COMPLETED' END AS workflow_status,
  CASE final_status WHEN 'NEEDS_REVIEW' THEN 'AWAIT_EXTERNAL' WHEN 'MISMATCH' THEN 'CORRECTION_REQUIRED' ELSE 'NONE' END AS follow_up,
  false AS asks_again FROM applied"""),
        "d06_override_values": _with(_CASES, """
SELECT email_id AS case_id, CASE WHEN d IN (6, 7, 17, 19) OR status = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' ELSE 'MISMATCH' END AS final_status,
  CASE WHEN status = 'NEEDS_REVIEW' THEN '' WHEN d = 1 THEN 'consignee' WHEN d = 10 THEN 'consignee,notify_party'
    WHEN d = 4 THEN 'shipper,consignee,port_of_discharge' WHEN d = 2 THEN 'consignee,container_count'
    WHEN d = 3 THEN 'consignee,gross_weight_kg' WHEN d = 12 THEN 'consignee,port_of_loading' ELSE 'consignee' END AS defects,
  workflow_status FROM res WHERE is_bl AND k % 9 <> 0"""),
        "d07_operational_roles": _with(_EVENTS, """
, ad AS (SELECT a.*, t.kind FROM applied a CROSS JOIN (VALUES ('SI'), ('BL'), ('BL2')) AS t(kind) WHERE d <> 19 AND (t.kind <> 'BL2' OR d = 13))
SELECT d = 13 AS chosen, CASE WHEN kind = 'SI' THEN 'SI' WHEN d = 13 THEN 'ROLE' WHEN d IN (6, 17) THEN 'UNKNOWN' WHEN d = 7 THEN 'OTHER' ELSE 'BL' END AS role,
  count(*) AS n FROM ad WHERE d <> 13 GROUP BY 1, 2
UNION ALL SELECT true, 'SI', count(*) FROM applied WHERE d = 13 HAVING count(*) > 0
UNION ALL SELECT true, 'BL', count(*) FROM applied WHERE d = 13 HAVING count(*) > 0
UNION ALL SELECT true, 'OTHER', count(*) FROM applied WHERE d = 13 HAVING count(*) > 0"""),
        "d08_latest_run": _with(_RUNS, "SELECT case_id, run_id, quantity FROM cur"),
        "d09_reprocess": _with(_RUNS, """
SELECT CASE WHEN old THEN 'review/CLOSED/SUPERSEDED' ELSE 'review/OPEN' END AS what, count(*) AS n FROM marked GROUP BY 1
UNION ALL SELECT 'job/' || CASE WHEN quantity % 2 <> 0 THEN 'COMPLETED' WHEN old THEN 'SUPERSEDED' ELSE 'RUNNING' END, count(*) FROM marked GROUP BY 1
UNION ALL SELECT 'decision/' || CASE WHEN quantity % 3 = 0 THEN 'applied' ELSE 'open' END, count(*) FROM marked WHERE NOT (old AND quantity % 3 <> 0) GROUP BY 1"""),
        "d10_run_guard": _with(_RUNS, "SELECT count(*) AS n, count(DISTINCT case_id) AS ids FROM cur"),
        "d11_run_identity": _with(_RUNS, """
, last AS (SELECT case_id, max(quantity % 5) AS q FROM runs GROUP BY case_id)
SELECT CASE WHEN quantity % 11 = 0 THEN 'RUN_STATE_UNAVAILABLE' WHEN quantity % 5 <> q OR quantity % 7 = 0 THEN 'RUN_IDENTITY_CHANGED' END AS problem,
  count(*) AS n FROM runs JOIN last USING (case_id) GROUP BY 1"""),
        "d12_job_outcomes": """
WITH a AS (SELECT 'job_' || printf('%08d', event_id // 3) AS job_id, ts,
  CASE WHEN event_id % 97 = 0 THEN 'SUPERSEDED' WHEN event_type IN ('signup', 'view') THEN 'STARTED'
    WHEN event_type IN ('click', 'purchase') THEN 'DONE' ELSE 'FAILED' END AS event FROM events)
SELECT job_id, CASE WHEN bool_or(event = 'SUPERSEDED') THEN 'SUPERSEDED' WHEN count(*) FILTER (WHERE event = 'FAILED') >= 2 THEN 'FAILED'
  WHEN arg_max(event, (ts, event)) = 'DONE' THEN 'COMPLETED' ELSE 'PENDING' END AS status,
  count(*) FILTER (WHERE event = 'FAILED') AS failures FROM a GROUP BY job_id""",
        "d13_batch_create": """
WITH asked AS (SELECT o_orderkey - o_orderkey % 2 AS k, count(*) AS asked FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1),
x AS (SELECT *, CASE WHEN k % 12 = 0 THEN 'concealed' WHEN k % 6 = 0 THEN 'existing' WHEN k % 4 <> 2 THEN 'created' ELSE 'skipped' END AS outcome FROM asked)
SELECT outcome, count(*) AS ids, sum(CASE WHEN outcome = 'created' THEN 1 ELSE 0 END) AS created,
  sum(CASE outcome WHEN 'existing' THEN asked WHEN 'created' THEN asked - 1 ELSE 0 END) AS existing FROM x GROUP BY 1""",
        "d14_idempotent_create": _with(_RUNS, "SELECT count(DISTINCT case_id) AS n FROM runs WHERE case_id NOT LIKE '%5'"),
        "d15_case_state": _with(_LOG, """
, starts AS (SELECT case_id, arg_max(run_id, (moment, event_id)) AS run_id FROM log WHERE type = 'CASE_CREATED' GROUP BY case_id)
SELECT case_id, run_id, CASE arg_max(type, (moment, event_id)) WHEN 'CASE_CREATED' THEN 'PROCESSING' WHEN 'DECISION_RECEIVED' THEN 'PROCESSING'
  WHEN 'REVIEW_NOTIFIED' THEN 'AWAITING_HUMAN' WHEN 'PROCESSING_FAILED' THEN 'FAILED' ELSE 'COMPLETED' END AS status
FROM log JOIN starts USING (case_id, run_id) GROUP BY case_id, run_id"""),
        "d16_timeline": _with(_LOG, """
SELECT event_id, case_id, round((epoch_us(moment) - epoch_us(lag(moment) OVER (PARTITION BY case_id ORDER BY moment, event_id))) / 1e6, 6) AS seconds_since FROM log"""),
        "d16_run_durations": _with(_LOG, """
SELECT case_id, run_id, round((epoch_us(max(moment) FILTER (WHERE type = 'CASE_COMPLETED')) - epoch_us(min(moment) FILTER (WHERE type = 'CASE_CREATED'))) / 1e6, 6) AS seconds
FROM log GROUP BY 1, 2 HAVING count(*) FILTER (WHERE type = 'CASE_COMPLETED') > 0 AND count(*) FILTER (WHERE type = 'CASE_CREATED') > 0"""),
        "d17_invalid_rate_limit": """
WITH RECURSIVE a AS MATERIALIZED (
  SELECT CAST(user_id % 10 AS VARCHAR) AS actor, epoch_ms(ts) // 2000 AS at_ms, event_type <> 'view' AS invalid,
    row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_ms(ts) // 2000, event_id) AS i FROM events),
s AS (
  SELECT actor, i, CASE WHEN invalid THEN [at_ms] ELSE CAST([] AS BIGINT[]) END AS counted, false AS limited FROM a WHERE i = 1
  UNION ALL
  SELECT actor, i, CASE WHEN invalid AND len(live) < 12 THEN list_append(live, at_ms) ELSE live END, len(live) >= 12
  FROM (SELECT a.actor, a.i, a.at_ms, a.invalid, list_filter(s.counted, lambda t: a.at_ms - t < 60000) AS live
        FROM s JOIN a ON a.actor = s.actor AND a.i = s.i + 1))
SELECT actor, count(*) AS attempts, count(*) FILTER (WHERE limited) AS limited FROM s GROUP BY actor""",
        "d17_invalid_burst": """
WITH a AS (SELECT printf('%012d', event_id) AS attempt_id, user_id % 10 AS actor, epoch_ms(ts) // 2000 AS at_ms, event_type <> 'view' AS invalid FROM events)
SELECT attempt_id, n AS invalid_before, n >= 12 AS burst FROM (SELECT attempt_id,
  coalesce(sum(CASE WHEN invalid THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY at_ms RANGE BETWEEN 59999 PRECEDING AND 1 PRECEDING), 0) AS n FROM a)""",
        "d18_mark_notified": _with(_RUNS, """
SELECT CASE WHEN quantity % 4 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status,
  CASE WHEN quantity % 4 <> 0 AND NOT old THEN CAST(1700000000 AS BIGINT) END AS notified_at, count(*) AS n FROM marked GROUP BY 1, 2"""),
        "d19_backlog": """
SELECT CAST(user_id AS VARCHAR) AS recipient, count(DISTINCT event_type || '|' || (event_id % 40)) AS waiting,
  count(DISTINCT event_type || '|' || (event_id % 40)) > 3 AS digest FROM events WHERE event_type <> 'purchase' GROUP BY 1""",
        "d20_emit_history": _with(_DOCS, """
SELECT type, run_kind, count(*) AS n, count(*) AS ids FROM (
  SELECT 'EMAIL_CLASSIFIED' AS type, run_kind FROM res UNION ALL SELECT 'DOCUMENT_PARSED', run_kind FROM docs WHERE present
  UNION ALL SELECT 'COMPARISON_COMPLETED', run_kind FROM res WHERE is_bl UNION ALL SELECT 'REVIEW_CREATED', run_kind FROM res WHERE ui_mode IS NOT NULL
  UNION ALL SELECT 'CASE_COMPLETED', run_kind FROM res WHERE ui_mode IS NULL) GROUP BY 1, 2"""),
        "d21_pending_work": _with(_CASES, "SELECT email_id FROM res WHERE ui_mode IS NOT NULL"),
        # statistics
        "a01_stats": _with(_FIELDS, """
SELECT count(*) AS total_cases, CAST(0 AS BIGINT) AS unclassified, count(*) FILTER (WHERE ui_mode IS NOT NULL) AS awaiting_human_now,
  count(*) FILTER (WHERE ui_mode IS NULL) AS auto_completed, CAST(0 AS BIGINT) AS ai_assisted_cases, CAST(0 AS BIGINT) AS ai_calls_total,
  count(*) FILTER (WHERE is_bl) AS bl_total, count(*) FILTER (WHERE is_bl AND status = 'OK') AS bl_ok,
  count(*) FILTER (WHERE is_bl AND status = 'MISMATCH') AS bl_mismatch, count(*) FILTER (WHERE is_bl AND status = 'NEEDS_REVIEW') AS bl_needs_review,
  (SELECT count(si_value) + count(bl_value) FROM cmp) AS values_present, (SELECT count(si_value) + count(bl_value) FROM cmp) AS values_grounded,
  CASE WHEN count(*) FILTER (WHERE ui_mode IS NULL) > 0 THEN 0.0::DOUBLE END AS avg_processing_ms,
  100.0 AS grounding_accuracy FROM res"""),
        "a02_counts_by": _with(_CASES, """
, dims AS (SELECT * FROM (VALUES ('category', 'BL_COMPARISON'), ('category', 'SI_REQUEST'), ('category', 'INVOICE_QUERY'), ('category', 'GENERAL'),
  ('category', 'SPAM'), ('machine_status', 'OK'), ('machine_status', 'MISMATCH'), ('machine_status', 'NEEDS_REVIEW'), ('effective_status', 'OK'),
  ('effective_status', 'MISMATCH'), ('effective_status', 'NEEDS_REVIEW'), ('workflow_status', 'PROCESSING'), ('workflow_status', 'AWAITING_HUMAN'),
  ('workflow_status', 'BLOCKED_EXTERNAL'), ('workflow_status', 'COMPLETED'), ('workflow_status', 'FAILED')) AS t(dimension, value))
SELECT dimension, value, (SELECT count(*) FROM res WHERE CASE dimension WHEN 'category' THEN category WHEN 'workflow_status' THEN workflow_status ELSE status END = value) AS cases FROM dims"""),
        "a03_bl_comparison": _with(_CASES, """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'OK') AS ok, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatch,
  count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS needs_review FROM res WHERE is_bl"""),
        "a04_validation_report": _with(_CASES, """
SELECT metric, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'total_cases' AS metric, CAST(count(*) AS DOUBLE) AS value FROM res
  UNION ALL SELECT 'unclassified_cases', 0 UNION ALL SELECT 'assessment_completeness_pct', 100
  UNION ALL SELECT 'total_defects', count(*) FROM res WHERE has_defect
  UNION ALL SELECT 'auto_completed_runs', count(*) FROM res WHERE ui_mode IS NULL
  UNION ALL SELECT 'awaiting_human', count(*) FROM res WHERE workflow_status = 'AWAITING_HUMAN'
  UNION ALL SELECT 'blocked_external', count(*) FROM res WHERE workflow_status = 'BLOCKED_EXTERNAL'
  UNION ALL SELECT 'ai_assisted_cases', 0 UNION ALL SELECT 'ai_calls_total', 0
  UNION ALL SELECT 'reason:' || t.r, count(*) FILTER (WHERE review_reason = t.r) FROM res CROSS JOIN (VALUES ('wrong_doc_type'), ('missing_attachment'), ('unreadable'), ('missing_value')) AS t(r) GROUP BY t.r
  UNION ALL SELECT 'defect:' || t.f, count(*) FILTER (WHERE list_contains(string_split(defects, ','), t.f)) FROM res CROSS JOIN (VALUES ('shipper'), ('consignee'), ('notify_party'),
    ('port_of_loading'), ('port_of_discharge'), ('container_count'), ('gross_weight_kg')) AS t(f) GROUP BY t.f
  UNION ALL SELECT 'category_pct:' || t.c, round(count(*) FILTER (WHERE category = t.c) * 100.0 / count(*), 2) FROM res CROSS JOIN
    (VALUES ('BL_COMPARISON'), ('SI_REQUEST'), ('INVOICE_QUERY'), ('GENERAL'), ('SPAM')) AS t(c) GROUP BY t.c)"""),
        "a05_port_codes": _with(_DOCS, """
, seen AS (
  SELECT lower(pol) AS place, pol_code AS code FROM docs WHERE present AND NOT (kind <> 'SI' AND (d IN (7, 17) OR d = 12))
  UNION ALL SELECT CASE WHEN kind <> 'SI' AND d = 4 THEN 'other ' ELSE '' END || lower(pod), pod_code FROM docs WHERE present AND NOT (kind <> 'SI' AND d IN (7, 17))),
c AS (SELECT place, code, count(*) AS n FROM seen GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY place) AS total, row_number() OVER (PARTITION BY place ORDER BY n DESC, code) AS rk,
  lead(n) OVER (PARTITION BY place ORDER BY n DESC, code) AS runner_up FROM c)
SELECT place, CASE WHEN rejected IS NULL THEN code END AS code, n AS observations, total, rejected FROM (
  SELECT *, CASE WHEN n < 3 THEN 'too few observations' WHEN n = runner_up THEN 'evidence is split' WHEN n * 2 <= total THEN 'not a strict majority' END AS rejected
  FROM r WHERE rk = 1)"""),
        "a06_inventory": _with(_DOCS, """
SELECT kind, value, count(*) AS n FROM (
  SELECT 'emails' AS kind, 'all' AS value FROM res UNION ALL SELECT 'emails', 'with_attachments' FROM res WHERE has_files
  UNION ALL SELECT 'attachment_count', CASE WHEN NOT has_files THEN '0' WHEN d = 13 THEN '3' ELSE '2' END FROM res
  UNION ALL SELECT 'emails', 'with_received_at' FROM res
  UNION ALL SELECT 'extension', '.txt' FROM docs
  UNION ALL SELECT 'format', CASE WHEN kind = 'BL' AND d = 17 THEN 'unsupported' ELSE 'text' END FROM docs WHERE present
  UNION ALL SELECT 'parse_status', CASE WHEN kind = 'BL' AND d = 17 THEN 'UNSUPPORTED' ELSE 'OK' END FROM docs WHERE present
  UNION ALL SELECT 'issue', 'MISSING_FILE' FROM docs WHERE NOT present
  UNION ALL SELECT 'diagnostic', CASE WHEN kind = 'BL' AND d = 17 THEN 'UNSUPPORTED_FORMAT' ELSE 'TEXT_ENCODING' END FROM docs WHERE present) GROUP BY 1, 2"""),
        "a07_ai_usage": """
SELECT CAST(user_id % 100 AS VARCHAR) AS run_id, count(*) FILTER (WHERE event_type <> 'view') AS ai_calls, count(*) FILTER (WHERE event_type = 'view') AS cache_hits,
  count(DISTINCT CASE WHEN event_type = 'click' THEN (event_id % 7) * 2 + event_id % 2 END) AS ai_assisted_fields,
  CASE WHEN (user_id % 100) % 2 = 0 THEN CAST(count(*) AS DOUBLE) END AS est_cost FROM events GROUP BY user_id % 100""",
        "a08_label_profile": _with(_DOCS, """
, l AS (SELECT unnest(string_split(CASE WHEN kind = 'SI' THEN
    'Shipper/Exporter|CONSIGNEE|NOTIFY PARTY|Port of Loading|Discharge Port|No. of Containers or Packages|'
    || CASE WHEN d = 18 THEN 'Gross Weight毛重(KGS)' ELSE 'Gross Weight (KG)' END || '|Booking Ref'
    || CASE WHEN registry = 'synthetic_demo' THEN '|Cargo Value' ELSE '' END
  WHEN d = 7 THEN 'Seller|Buyer|Invoice Amount'
  ELSE 'SHIPPER|Consignee (Non-Negotiable)|Notify Party|Load Port|POD|'
    || CASE d WHEN 16 THEN 'No. of Containers or Packages' WHEN 18 THEN 'CONTAINER COUNT' ELSE 'Container Count' END || '|'
    || CASE WHEN d IN (8, 11) THEN 'Gross Wt' WHEN d = 14 THEN 'Gross Wt (kgs)|Gross Weight' WHEN d = 15 THEN 'Gross Wt (kgs)|Total Gross Weight'
       ELSE 'Gross Wt (kgs)' END || '|B/L No' END, '|')) AS label FROM docs WHERE present AND NOT (kind = 'BL' AND d = 17))
SELECT label, count(*) AS n, lower(label) AS normalized, CASE
  WHEN lower(label) LIKE 'shipper%' THEN 'shipper' WHEN lower(label) LIKE 'consignee%' THEN 'consignee' WHEN lower(label) LIKE 'notify%' THEN 'notify_party'
  WHEN label IN ('Port of Loading', 'Load Port') THEN 'port_of_loading' WHEN label IN ('Discharge Port', 'POD') THEN 'port_of_discharge'
  WHEN lower(label) LIKE '%container%' THEN 'container_count' WHEN lower(label) LIKE '%gross%' THEN 'gross_weight_kg' END AS field FROM l GROUP BY label"""),
        # scores
        "e01_confusion": _with(_SCORES, "SELECT t_category AS actual, predicted, count(*) AS n FROM pairs GROUP BY 1, 2"),
        "e02_prf": _with(_SCORES, "SELECT category, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM prf"),
        "e03_rule_share": _with(_SCORES, """
SELECT round(count(*) FILTER (WHERE decided_by = 'rule') / count(decided_by), 6) AS rule_share FROM pairs"""),
        "e04_defect_score": _with(_SCORES, """
SELECT doc_total, tp, fp, fn, field_tp, field_fp, field_fn, round(p, 6) AS defect_precision, round(r, 6) AS defect_recall,
  round(2 * p * r / (p + r), 6) AS defect_f1, round(2 * fp_ * fr_ / (fp_ + fr_), 6) AS field_f1, round(exact / doc_total, 6) AS exact_match_rate FROM def"""),
        "e05_reliability": _with(_SCORES, """
SELECT gold_review, pred_review, caught, round(caught / gold_review, 6) AS escalation_recall, round(caught / pred_review, 6) AS escalation_precision,
  round(2 * (caught / gold_review) * (caught / pred_review) / (caught / gold_review + caught / pred_review), 6) AS escalation_f1 FROM (
  SELECT count(*) FILTER (WHERE t_status = 'NEEDS_REVIEW') AS gold_review, count(*) FILTER (WHERE escalated) AS pred_review,
    count(*) FILTER (WHERE t_status = 'NEEDS_REVIEW' AND escalated) AS caught FROM pairs)"""),
        "e05_reliability_by_reason": _with(_SCORES, """
SELECT review_reason, count(*) AS total, count(*) FILTER (WHERE escalated) AS caught FROM pairs WHERE t_status = 'NEEDS_REVIEW' GROUP BY 1"""),
        "e06_end_to_end": _with(_SCORES, "SELECT total, success, round(success / total, 6) AS rate FROM e2e"),
        "e07_final_score": _with(_SCORES, """
SELECT round(macro, 6) AS macro_f1, round(df1, 6) AS defect_f1, round(rate, 6) AS end_to_end, round(0.3 * macro + 0.2 * df1 + 0.5 * rate, 6) AS final_score
FROM (SELECT sum(f1) / 5 AS macro FROM prf), (SELECT 2 * p * r / (p + r) AS df1 FROM def), (SELECT success / total AS rate FROM e2e)"""),
        # audits
        "q01_audit_comparisons": _with(_FIELDS, """
SELECT 'result must follow equality' AS rule, count(*) AS n FROM cmp WHERE field = 'shipper' AND m = 4 AND result = 'MATCH'"""),
        "q02_audit_assessments": _with(_CASES, """
SELECT 'only a mismatch has defects' AS rule, count(*) AS n FROM res WHERE m = 5 AND status = 'MISMATCH'"""),
        "q03_audit_reviews": _with(_CASES, """
SELECT 'closure disagrees with status' AS rule, count(*) AS n FROM res WHERE m = 6 AND ui_mode IS NOT NULL"""),
        "q04_audit_cases": _with(_CASES, """
SELECT 'wrong follow-up' AS rule, count(*) AS n FROM res WHERE m = 7 AND workflow_status <> 'BLOCKED_EXTERNAL'"""),
        "q05_audit_stats": """
SELECT 'stats' AS scope, rule FROM (VALUES ('workflow counts differ from total'), ('category counts differ from total'),
  ('more machine statuses than cases'), ('more effective statuses than cases')) AS t(rule)""",
        "q06_export_gate": _with(_CASES, """
SELECT 'NO_ASSESSMENT' AS problem, count(*) AS n FROM res WHERE k % 50 = 4
UNION ALL SELECT 'MISSING', count(*) FROM res WHERE k % 70 = 0 OR k % 50 = 4"""),
        # queues
        "p01_recent_cases": _with(_CASES, """
SELECT email_id AS case_id, workflow_status FROM res ORDER BY received_at DESC, email_id DESC LIMIT 8"""),
        "p02_work_queue": _with(_CASES, """
SELECT email_id AS case_id, CASE WHEN workflow_status = 'BLOCKED_EXTERNAL' OR status = 'MISMATCH' THEN 'investigate' WHEN ui_mode IS NULL THEN 'done'
    WHEN ui_mode = 'CHOICE' THEN 'quick' ELSE 'investigate' END AS work_group,
  CASE WHEN workflow_status = 'BLOCKED_EXTERNAL' THEN 'Needs investigation · Obtain missing source'
    WHEN status = 'MISMATCH' THEN 'Needs investigation · Check corrections needed' WHEN ui_mode IS NULL THEN 'No review needed'
    WHEN d = 13 THEN 'Quick review · Choose BL document' WHEN d = 14 THEN 'Quick review · Choose evidenced value'
    ELSE 'Needs investigation · Inspect missing or uncertain value' END AS work_label,
  CASE WHEN workflow_status = 'BLOCKED_EXTERNAL' OR status = 'MISMATCH' THEN 0 WHEN ui_mode IS NULL THEN 3 WHEN ui_mode = 'CHOICE' THEN 1 ELSE 0 END AS group_rank FROM res"""),
        "p03_queue_page": _with(_CASES, """
SELECT email_id AS case_id, 'quick' AS work_group, place, true AS has_previous, true AS has_next FROM (
  SELECT email_id, row_number() OVER (ORDER BY received_at DESC, email_id) AS place FROM res WHERE ui_mode = 'CHOICE') WHERE place BETWEEN 11 AND 20"""),
    }
    for name, sql in out.items():
        # A select that begins with a comma carries further common tables.
        out[name] = sql.replace(")\n\n, ", "),\n").replace(")\n\n\n, ", "),\n")
    return out
