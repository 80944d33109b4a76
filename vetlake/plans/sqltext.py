"""DuckDB building blocks of the oracle queries: the same adapters and gates written as SQL."""

from __future__ import annotations

from ..functions import paths as FP
from ..functions.text import BLANK_OR_COMMENT, WS
from . import corpus as C


def s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(s(x) for x in items) + "]"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {s(pattern)})"


def any_in(col: str, keys) -> str:
    """Any key is a substring of the (already lower-cased) column."""
    return "(" + " OR ".join(f"contains({col}, {s(k.lower())})" for k in keys) + ")"


def any_raw(col: str, keys) -> str:
    return "(" + " OR ".join(f"contains({col}, {s(k)})" for k in keys) + ")"


def trim(col: str) -> str:
    return f"regexp_replace({col}, {s(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def code_line(col: str) -> str:
    return f"NOT {rx(col, BLANK_OR_COMMENT)}"


def log_only(col: str) -> str:
    return f"({any_in(f'lower({col})', ['log_event(', 'logger.', 'log.'])} AND NOT {any_in(f'lower({col})', ['=', 'set', 'cache', 'store'])})"


def base(col: str) -> str:
    return f"regexp_extract({col}, '([^/]*)$', 1)"


def ext(col: str) -> str:
    return f"lower(regexp_extract({base(col)}, '(\\.[^.]*)$', 1))"


def low_dir(col: str) -> str:
    return f"list_has_any(string_split(lower({col}), '/'), {lst(FP.LOW_SIGNAL_DIRS)})"


def low_signal(col: str) -> str:
    return "(" + low_dir(col) + "".join(f" OR ends_with(lower({col}), {s(x)})" for x in FP.LOW_SIGNAL_SUFFIXES) + ")"


def production(col: str) -> str:
    return f"(NOT {low_signal(col)} AND ({ext(col)} IN ({', '.join(s(x) for x in FP.PRODUCTION_EXT)}) OR {ext(col)} = ''))"


def signal_file(col: str) -> str:
    return f"(NOT {low_dir(col)} AND ({ext(col)} IN ({', '.join(s(x) for x in FP.SIGNAL_EXT)}) OR {ext(col)} = ''))"


def declaration(col: str) -> str:
    return f"lower({base(col)}) IN ({', '.join(s(x) for x in FP.DECLARATION_NAMES)})"


def script(col: str) -> str:
    return f"((contains(lower({col}), '/scripts/') OR starts_with(lower({col}), 'scripts/')) AND {production(col)})"


DOC_LINES = """
doc_l AS (SELECT source AS skill_id, 'scripts/doc_' || doc_id AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, doc_id FROM documents)"""

PAGE_FILES = r"""
page_f AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS skill_id, 'scripts/page_' || page_id AS path,
  replace(replace(replace(replace(replace(html, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS content FROM pages),
page_l AS (SELECT skill_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM page_f)"""

_N, _D = len(C.SAMPLE_LINES), len(C.DECLARATIONS)
SEED_LINES = f"""
seed0 AS (SELECT doc_id, doc_id // 5 AS g, doc_id % 5 AS k, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
seed1 AS (SELECT doc_id, g, k, i, CASE WHEN k = 0 AND i = 1 THEN [({lst(C.DECLARATIONS)})[(g % {_D}) + 1], l]
    WHEN (doc_id * 7 + (i - 1) * 3) % 4 = 0 THEN [l, ({lst(C.SAMPLE_LINES)})[((doc_id * 13 + (i - 1) * 29 + g * 7) % {_N}) + 1]] ELSE [l] END AS two FROM seed0),
seed2 AS (SELECT doc_id, g, k, i, unnest(two) AS line, generate_subscripts(two, 1) AS j FROM seed1),
seed_t AS (SELECT 'skill_' || g AS skill_id,
  CASE k WHEN 0 THEN CASE WHEN g % 3 = 1 THEN 'README.md' ELSE 'SKILL.md' END WHEN 1 THEN 'scripts/run_' || doc_id || '.py' WHEN 2 THEN 'src/app_' || doc_id || '.js'
    WHEN 3 THEN CASE g % 4 WHEN 0 THEN 'docs/guide_' || doc_id || '.md' WHEN 1 THEN 'tests/test_' || doc_id || '.py' WHEN 2 THEN 'scripts/tool_' || doc_id || '.sh' ELSE 'requirements.txt' END
    ELSE 'src/lib_' || doc_id || '.go' END AS path,
  row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS line_no, line FROM seed2),
man0 AS (SELECT doc_id // 5 AS g, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1),
man_f AS (SELECT 'skill_' || g AS skill_id, CASE WHEN g % 2 = 0 THEN 'package.json' ELSE 'go.mod' END AS path,
  CASE WHEN g % 2 = 0 THEN '{{"dependencies":{{"lib' || (n % 97) || '":"' || ({lst(C.MANIFEST_VERSIONS)})[(g % {len(C.MANIFEST_VERSIONS)}) + 1] || '","pkg' || g || '":"1.2.' || (n % 10) || '"}}}}'
  ELSE 'module m' || chr(10) || chr(10) || 'require (' || chr(10) || chr(9) || 'example.com/lib' || (n % 97) || ' v1.' || (n % 10) || '.0' || chr(10) || chr(9) || 'example.com/typo' || g || ' v0.9.1 // indirect' || chr(10) || ')' || chr(10) || chr(10) || 'require example.com/one v0.0.0' || chr(10) END AS content, g, n FROM man0),
man_l AS (SELECT skill_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM man_f),
l AS (SELECT skill_id, path, line_no, line FROM seed_t UNION ALL SELECT skill_id, path, line_no, line FROM man_l),
f AS (SELECT skill_id, path, string_agg(line, chr(10) ORDER BY line_no) AS content, list(line ORDER BY line_no) AS ls FROM l GROUP BY 1, 2)"""

_PERMS = ["root", "/**", "HOME", "network", "0.0.0.0", "read file"]
SEED_SKILLS = f"""
sk AS (SELECT 'skill_' || g AS skill_id, 'tool ' || g AS name, CASE WHEN g % 7 = 0 THEN '' ELSE ({lst(C.DECLARATIONS)})[((g * 3) % {_D}) + 1] END AS description,
  CASE WHEN g % 4 = 0 THEN []::VARCHAR[] ELSE [({lst(_PERMS)})[(n % 6) + 1], ({lst(_PERMS)})[(g % 6) + 1]] END AS permissions FROM man0)"""

_CASE_EV = "CASE event_type " + " ".join(f"WHEN {s(a)} THEN {s(b)}" for a, b in C.EVENT_CATEGORY.items()) + " END"
EVENT_POINTS = f"""
pts AS (SELECT 'skill_' || (user_id // 15) AS skill_id, 'u' || user_id AS path, CAST(floor(epoch(ts)) AS BIGINT) AS line_no, {_CASE_EV} AS category, event_type FROM events),
p1 AS (SELECT *, lag(line_no) OVER (PARTITION BY skill_id, path ORDER BY line_no) AS prev FROM pts),
p2 AS (SELECT *, sum(CASE WHEN prev IS NULL OR line_no - prev > {C.EVENT_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY skill_id, path ORDER BY line_no, category ROWS UNBOUNDED PRECEDING) AS seg FROM p1),
sc AS (SELECT skill_id, path, seg, category, count(*) AS n, min(line_no) AS first, max(line_no) AS last FROM p2 GROUP BY ALL),
sg AS (SELECT skill_id, path, seg, min(first) AS range_start, max(last) AS range_end, count(*) AS n_categories, sum(n)::BIGINT AS total FROM sc GROUP BY ALL)"""

_SHOWN = f"({lst(C.BEHAVIORS)})[(l_suppkey * 5 + substr(p_brand, 7)::BIGINT % (l_suppkey % 6 + 1)) % {len(C.BEHAVIORS)} + 1]"
_CASE_PRE = "CASE category " + " ".join(f"WHEN {s(a)} THEN {s(b)}" for a, b in C.BEHAVIOR_PREFIX.items()) + " ELSE category || ' ' END"
SUPPLIER = f"""
bh0 AS (SELECT 'supp_' || l_suppkey AS skill_id, {_SHOWN} AS category, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
bh AS (SELECT skill_id, category, {_CASE_PRE} || p_name AS item FROM bh0 WHERE category IS NOT NULL),
sel AS (SELECT 'sel_' || s_nationkey AS selection_id, 'supp_' || s_suppkey AS skill_id FROM supplier)"""

REPORTS = """
rep AS (SELECT 'R' || o_orderkey AS report_id, 'cust_' || o_custkey AS skill_id, 'order_' || o_orderkey || '.zip' AS file_name, c_name AS username, 'team_' || c_nationkey AS team,
  epoch(o_orderdate)::BIGINT AS created_at, o_orderstatus AS status, o_orderkey AS seq, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
usr AS (SELECT c_name AS username, 'team_' || c_nationkey AS team, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role FROM customer),
reg AS (SELECT 'cust_' || c_custkey AS skill_id, 'R' || k AS report_id, c_name AS name, 'tool of ' || lower(c_mktsegment) AS display_name, '1.0' AS version, 'serves ' || lower(c_mktsegment) AS description,
  '' AS review_summary, lower(c_mktsegment) AS risk_tag, CASE WHEN c_acctbal > 5000 THEN 'approved' WHEN c_acctbal > 0 THEN 'pending' ELSE 'rejected' END AS admission_status,
  CASE WHEN c_acctbal > 2500 THEN 'pass' ELSE 'review' END AS review_decision, created_at, updated_at, c_custkey AS seq
  FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS k, epoch(max(o_orderdate))::BIGINT AS updated_at, epoch(min(o_orderdate))::BIGINT AS created_at FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""

LABELS = """
vd AS (SELECT doc_id::VARCHAR AS finding_id, doc_id, CASE WHEN quality = 1 THEN 'likely_false_positive' ELSE 'confirmed' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 2 END AS cr, 'deterministic-vuln-reviewer' AS reviewer, 2 AS rr, CASE WHEN quality = 1 THEN 'no multi-source support' END AS missing, 1 AS seq FROM labels
  UNION ALL SELECT doc_id::VARCHAR, doc_id, CASE WHEN toxic = 1 THEN 'confirmed' ELSE 'likely_false_positive' END, 'medium_high', 3, 'llm-vuln-reviewer', 1, CASE WHEN toxic = 1 THEN NULL ELSE 'too little risk evidence' END, 0 FROM labels)"""
