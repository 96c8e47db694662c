"""DuckDB SQL that gives the rows of the table queries."""

from __future__ import annotations

from lucerna.operators.secrets import ANY, HEURISTIC, PERSONAL, RULES
from lucerna.operators.verdict import RECOMMENDATIONS, WEIGHTS


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mask(x: str) -> str:
    return f"CASE WHEN length({x}) < 12 THEN '************' ELSE left({x}, 4) || '************' || right({x}, 2) END"


def case(column: str, values: dict[str, object], otherwise: str) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def redacted(column: str) -> str:
    for r in RULES:
        column = f"regexp_replace({column}, {quote(r.pattern)}, '[{r.rule}]', 'g')"
    return column


SUFFIX = " - sin metadatos"

# One list of hits for each line and rule, then one row for each hit.
HITS = (
    f"lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE regexp_matches(text, {quote(ANY)}))), lists AS ("
    + " UNION ALL ".join(f"SELECT doc_id, line_no, '{r.rule}' AS rule, regexp_extract_all(line, {quote(r.pattern)}, 0) AS x FROM lines" for r in RULES)
    + f"), hits AS (SELECT doc_id, line_no, rule, nth, {mask('h')} AS masked FROM (SELECT doc_id, line_no, rule, generate_subscripts(x, 1) AS nth, unnest(x) AS h FROM lists))"
)
WEAK = ", ".join(map(quote, HEURISTIC))
TITLES, LEVELS = {r.rule: r.titulo for r in RULES}, {r.rule: r.nivel for r in RULES}
SIGNALS = (
    HITS
    + f""", counted AS (
  SELECT * FROM hits h WHERE rule NOT IN ({WEAK})
  UNION ALL SELECT * FROM hits h WHERE rule IN ({WEAK}) AND NOT EXISTS (SELECT 1 FROM hits p WHERE p.rule NOT IN ({WEAK}) AND p.doc_id = h.doc_id AND p.line_no = h.line_no)
), signals AS (
  SELECT doc_id, rule, {case("rule", LEVELS, "NULL")} AS nivel, {case("rule", TITLES, "NULL")} AS titulo,
    count(*) || CASE WHEN count(*) = 1 THEN ' coincidencia (línea ' ELSE ' coincidencias (línea ' END || min(line_no) || '). Ejemplo: ' || arg_min(masked, (line_no, nth)) AS detalle
  FROM counted GROUP BY doc_id, rule
)"""
)
VERDICTS = (
    SIGNALS
    + f""", scores AS (SELECT doc_id, least(100, sum({case("nivel", WEIGHTS, "0")})) AS s, count(*) AS n FROM signals GROUP BY doc_id),
verdicts AS (
  SELECT d.doc_id, CASE WHEN coalesce(s, 0) >= 40 THEN 'alto' WHEN coalesce(s, 0) >= 15 THEN 'medio' ELSE 'bajo' END AS riesgo, CAST(coalesce(s, 0) AS INTEGER) AS puntuacion, CAST(coalesce(n, 0) AS BIGINT) AS n_signals
  FROM documents d LEFT JOIN scores USING (doc_id)
)"""
)
OWN = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, CAST(len(regexp_extract_all(text, {quote(p)})) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, {quote(p)})" for k, p in PERSONAL)
FINDINGS = SIGNALS + f", own AS ({OWN}), findings AS (SELECT doc_id, 'credenciales' AS grp, rule AS label, 'media' AS sev, false AS keep FROM signals UNION ALL SELECT doc_id, 'personales', label, 'personal', true FROM own)"
BYTES = "CAST(strlen(text) AS BIGINT)"
LEDGER = """ledger AS (
  SELECT ts AS fecha, CASE event_type WHEN 'purchase' THEN 'liquidado' ELSE 'fallido' END AS resultado, CASE WHEN user_id % 2 = 0 THEN '/v1/scan' ELSE '/v1/clean' END AS recurso,
    CAST(CAST(value AS DECIMAL(12, 2)) * 100 AS BIGINT) AS cents, CAST(user_id AS VARCHAR) AS pagador
  FROM events WHERE event_type IN ('purchase', 'error')
)"""

ORACLE = {
    "file_card": f"SELECT doc_id, 'doc-' || doc_id || '.txt' AS name, {BYTES} AS bytes, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' WHEN strlen(text) < 1048576 THEN printf('%.1f', round(strlen(text) / 1024.0, 1)) || ' KB' ELSE printf('%.2f', round(strlen(text) / 1048576.0, 2)) || ' MB' END AS shown, sha256(text) AS sha256 FROM documents",
    "secret_hits": f"WITH {HITS} SELECT doc_id, line_no, rule, nth, masked FROM hits",
    "secret_findings": f"WITH {SIGNALS} SELECT doc_id, rule, nivel, titulo, detalle FROM signals",
    "secret_verdict": f"WITH {VERDICTS} SELECT * FROM verdicts",
    "verdict_recommendation": f"WITH {VERDICTS} SELECT doc_id, riesgo, {case('riesgo', RECOMMENDATIONS, 'NULL')} AS recomendacion FROM verdicts",
    "verdict_totals": f"WITH {VERDICTS} SELECT source, count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (riesgo = 'alto') AS high, CAST(max(puntuacion) AS BIGINT) AS most FROM documents JOIN verdicts USING (doc_id) GROUP BY ROLLUP (source)",
    "redact_text": f"SELECT doc_id, {redacted('text')} AS text FROM documents",
    "redact_residue": "WITH r AS (SELECT doc_id, " + redacted("text") + " AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{r.rule}' AS rule FROM r WHERE regexp_matches(t, {quote(r.pattern)})" for r in RULES),
    "personal_findings": f"SELECT doc_id, label, n FROM ({OWN})",
    "findings_by_group": f"WITH {FINDINGS} SELECT grp, count(*) AS findings, count(*) FILTER (sev = 'personal') AS personal, count(DISTINCT doc_id) AS documents FROM findings GROUP BY grp",
    "personal_share": f"WITH own AS ({OWN}), p AS (SELECT DISTINCT doc_id, 1 AS personal FROM own) SELECT source, count(*) AS documents, count(personal) AS personal, CAST(floor(count(personal) * 10000 / count(*)) AS BIGINT) AS hundredths FROM documents LEFT JOIN p USING (doc_id) GROUP BY source",
    "pending_findings": f"WITH {FINDINGS} SELECT DISTINCT doc_id, grp, label FROM findings WHERE keep",
    "page_meta_extract": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset FROM pages""",
    "page_active_signals": """WITH c AS (SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS scripts, CAST(len(regexp_extract_all(html, '<iframe')) AS BIGINT) AS frames, CAST(len(regexp_extract_all(html, 'href="/')) AS BIGINT) AS links FROM pages),
s AS (SELECT *, least(100, CASE WHEN scripts > 0 THEN 40 ELSE 0 END + CASE WHEN frames > 0 THEN 15 ELSE 0 END + CASE WHEN links > 0 THEN 5 ELSE 0 END) AS p FROM c)
SELECT doc_id, scripts, frames, links, CAST(p AS BIGINT) AS puntuacion, CASE WHEN p >= 40 THEN 'alto' WHEN p >= 15 THEN 'medio' ELSE 'bajo' END AS riesgo FROM s""",
    "page_tag_counts": "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS total, count(DISTINCT page_id) AS pages FROM t GROUP BY tag",
    "page_escape": """SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_sha256 FROM pages""",
    "safe_names": r"SELECT page_id, CASE WHEN n = '' THEN 'archivo' WHEN length(n) > 150 THEN left(n, 140) || right(n, 10) ELSE n END AS name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(string_split(regexp_replace(coalesce(url, ''), '[\\/]+', '/', 'g'), '/')[-1], '[\x00-\x1f\x7f]', '', 'g'), '^\.+', '')) AS n FROM pages)",
    "dup_name_numbering": "WITH n AS (SELECT p_partkey, p_brand || '.docx' AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_brand FROM part) SELECT p_partkey, name, CASE WHEN k = 1 THEN name ELSE p_brand || ' (' || k || ').docx' END AS unique_name FROM n",
    "packed_stamps": "WITH b AS (SELECT o_orderkey, o_orderkey % 65536 AS t, (o_orderkey * 7) % 65536 AS d FROM orders) SELECT o_orderkey, printf('%d-%02d-%02d %02d:%02d:%02d', 1980 + ((d >> 9) & 127), (d >> 5) & 15, d & 31, (t >> 11) & 31, (t >> 5) & 63, (t & 31) * 2) AS stamp FROM b",
    "latest_revision": "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "first_wins_merge": "WITH n AS (SELECT o_custkey AS key, o_orderkey AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('second', o_orderdate) DESC, o_orderkey) AS k FROM orders) WHERE k = 1) SELECT key, value, 'section' AS origin FROM n UNION ALL SELECT c_custkey, -1, 'scan' FROM customer WHERE c_custkey NOT IN (SELECT key FROM n)",
    "span_ends": "SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS span_end FROM events",
    "dangling_refs": "SELECT 'label' AS origin, doc_id AS ref FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations) UNION ALL SELECT DISTINCT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "package_diff": f"WITH a AS (SELECT doc_id, sha256({redacted('text')}) AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM documents d LEFT JOIN a USING (doc_id) WHERE a.doc_id IS NULL OR a.s <> sha256(d.text)",
    "label_lookup": "SELECT event_type, CASE event_type WHEN 'click' THEN 'Clic' WHEN 'view' THEN 'Vista' WHEN 'purchase' THEN 'Compra' ELSE event_type END AS label, count(*) AS n FROM events GROUP BY event_type",
    "network_check": "WITH s AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) SELECT nation, customers, coalesce(suppliers, 0) AS suppliers, suppliers IS NOT NULL AS ok FROM c LEFT JOIN s USING (nation)",
    "paired_outputs": f"SELECT doc_id, 'doc-' || doc_id || '.txt' AS name, CASE WHEN lang <> 'en' THEN 'missing' WHEN sha256({redacted('text')}) = sha256(text) THEN 'same' ELSE 'changed' END AS state FROM documents",
    "date_span": "SELECT event_type, count(*) AS marks, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last FROM events GROUP BY event_type",
    "stamp_preview": "WITH l AS (SELECT o_custkey, list_sort(list(DISTINCT strftime(o_orderdate, '%Y-%m-%d'))) AS s FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(s[1:3], ' · ') || CASE WHEN len(s) > 3 THEN ' (+' || (len(s) - 3) || ' más)' ELSE '' END AS preview FROM l",
    "conversation_people": "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations WHERE trim(coalesce(role, '')) <> '' GROUP BY 1, 2) SELECT conv_id, count(*) AS n_people, string_agg(role, ', ' ORDER BY t, role) AS people FROM f GROUP BY conv_id",
    "running_limit": f"WITH d AS (SELECT doc_id, doc_id // 12 AS request, {BYTES} AS bytes FROM documents), r AS (SELECT *, count(*) OVER w AS k, sum(bytes) OVER w AS s FROM d WINDOW w AS (PARTITION BY request ORDER BY doc_id ROWS UNBOUNDED PRECEDING)), x AS (SELECT *, CASE WHEN bytes > 20000 THEN 'file too large' WHEN k > 10 THEN 'too many files' WHEN s > 40000 THEN 'request too large' END AS reason FROM r) SELECT doc_id, request, bytes, reason IS NULL AS accepted, reason FROM x",
    "base64_round_trip": "WITH b AS (SELECT doc_id, text, ((strlen(text) + 2) // 3) * 4 * 0.75 <= 16500 AS fits FROM documents) SELECT doc_id, fits, sha256(CASE WHEN fits THEN text ELSE '' END) AS sha256 FROM b",
    "price_units": "SELECT p_partkey, '$' || CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) AS price, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) * 1000000 AS BIGINT) AS units FROM part",
    "config_numbers": "WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey * 97 AS VARCHAR) END AS raw FROM customer), v AS (SELECT c_custkey, raw, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN CAST(raw AS BIGINT) END AS v FROM r) SELECT c_custkey, CASE WHEN v > 0 THEN v ELSE -1 END AS n, CASE WHEN v <= 65535 THEN v ELSE -1 END AS port, CASE WHEN c_custkey % 4 <> 0 THEN 'svm' WHEN v IS NOT NULL THEN 'evm' ELSE 'none' END AS family FROM v",
    "ledger_totals": f"WITH {LEDGER} SELECT recurso, resultado, count(*) AS lines, CAST(sum(cents) AS BIGINT) AS cents FROM ledger GROUP BY ALL",
    "ledger_windows": f"WITH {LEDGER} SELECT strftime(time_bucket(INTERVAL 6 HOUR, fecha, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, recurso, count(*) AS lines, CAST(sum(cents) AS BIGINT) AS cents FROM ledger WHERE resultado = 'liquidado' GROUP BY ALL",
    "ledger_sessions": f"WITH {LEDGER}, g AS (SELECT *, CASE WHEN fecha - lag(fecha) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM ledger WINDOW w AS (PARTITION BY pagador ORDER BY fecha)), s AS (SELECT *, sum(new) OVER (PARTITION BY pagador ORDER BY fecha ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT strftime(min(fecha), '%Y-%m-%d %H:%M:%S') AS session_start, pagador, count(*) AS lines FROM s GROUP BY pagador, s",
    "stats_roll_up": "SELECT counter, CAST(sum(n) AS BIGINT) AS total, count(*) AS documents FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS counter, len(regexp_extract_all(text, {quote(p)})) AS n FROM documents" for k, p in (*PERSONAL, ("generic", RULES[-1].pattern))) + ") WHERE n > 0 GROUP BY counter",
    "document_notes": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {quote(p)}) THEN '{w}' END" for w, p in (("correos", PERSONAL[0][1]), ("direcciones", PERSONAL[1][1]), ("credenciales", ANY))) + "], lambda x: x IS NOT NULL), '; ') AS notes FROM documents",
    "reachability": "SELECT 'root' AS node UNION SELECT 'r' || r_regionkey FROM region WHERE r_regionkey <> 0 UNION SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey <> 0 UNION SELECT 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0",
}
ORACLE["product_order"] = """WITH f AS (SELECT c_custkey, c_custkey % 2 = 0 AS s, c_custkey % 3 = 0 AS c, c_custkey % 5 = 0 AS o FROM customer)
SELECT c_custkey, CASE WHEN NOT s AND NOT c AND NOT o THEN '/v1/clean /v1/scan /v1/secrets' ELSE concat_ws(' ', CASE WHEN c THEN '/v1/clean' END, CASE WHEN s THEN '/v1/secrets' END) END AS routes, CASE WHEN o THEN 'other' ELSE '' END AS unknown FROM f"""
ORACLE["kinds_by_name"] = "SELECT p_partkey, ['office', 'pdf', 'image', 'ole', 'none'][p_partkey % 5 + 1] AS kind FROM part"
_SAFE = ORACLE["safe_names"]
ORACLE["output_names"] = f"WITH s AS ({_SAFE}), m AS (SELECT page_id, name || '.html' AS name FROM s) SELECT page_id, regexp_replace(name, '\\.[^.]+$', '') || '{SUFFIX}' || regexp_extract(name, '\\.[^.]*$') AS output_name FROM m"

ORACLE["config_lists"] = """SELECT c_custkey, 'eip155:' || c_custkey % 3 || CASE WHEN c_custkey % 2 <> c_custkey % 3 THEN ' eip155:' || c_custkey % 2 ELSE '' END AS networks,
  CASE WHEN c_custkey % 2 = 0 THEN 'precioScan=$' || (c_custkey % 10 + 1) || ' precioSecrets=$' || (c_custkey % 10 + 2) WHEN c_custkey % 3 = 0 THEN 'precio=$' || c_custkey % 10
    ELSE 'precio=$' || c_custkey % 10 || ' precioScan=$' || (c_custkey % 10 + 1) || ' precioSecrets=$' || (c_custkey % 10 + 2) END AS prices,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN 6 WHEN c_custkey % 25 <= 18 THEN c_custkey % 25 ELSE -1 END AS INTEGER) AS decimals, CASE WHEN c_custkey % 3 = 2 THEN '/l/' || c_custkey ELSE '' END AS ledger FROM customer"""
ORACLE["ledger_round_trip"] = ORACLE["ledger_totals"]
