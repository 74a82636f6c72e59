"""DuckDB SQL for the queries, on the same tables. Fixed values are spelled from the same lists; the logic is written again."""

from __future__ import annotations

from gridmend.functions import fixed as X
from gridmend.plans.queries import HEADERS, TABLES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def texts(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def any_like(col: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(p)})" for p in parts) + ")"


FAM = "fam(m, lo, hi, p, ord, back) AS (VALUES " + ", ".join(
    [f"({m}, {lo}, {hi}, {q(p)}, {i}, false)" for i, (m, lo, hi, p) in enumerate(X.FAMILIES)]
    + [f"({m}, {lo}, {hi}, {q(p)}, {50 + i}, true)" for i, (m, lo, hi, p) in enumerate(X.FAMILIES_BACKWARD)]
) + ")"
MODERN = "CASE " + " ".join(
    f"WHEN regexp_matches(sym, '^{old}[1-9][0-9]?$') AND CAST(substr(sym, {len(old) + 1}) AS INT) <= {last} THEN '{new}' || substr(sym, {len(old) + 1})" for old, (new, last) in X.RENAMED.items()
) + " " + " ".join(f"WHEN sym = {q(a)} THEN {q(b)}" for a, b in X.RENAMED_ONE.items()) + " END"
FAMILY_OF = "CASE " + " ".join(f"WHEN starts_with(s, {q(p)}) THEN {q(p)}" for p in X.MODERN_PREFIXES) + " " + " ".join(f"WHEN regexp_matches(s, '^{p}-*[0-9]+$') THEN {q(p)}" for p in X.FAMILY_PREFIXES) + " ELSE 'OTHER' END"


def reversed_dates(base: str) -> str:
    """CTEs base(key, d, fmt), hits(key, sym, pos): symbols of dates, in order of pos."""
    day, year = "fmt IS NULL OR NOT (contains(fmt, 'y') AND NOT contains(fmt, 'd'))", "(contains(fmt, 'y') AND NOT contains(fmt, 'd')) OR (fmt IS NULL AND day(d) = 1 AND year(d) BETWEEN 2000 AND 2059)"
    sym = lambda n: f"p || CASE WHEN back THEN 32 - {n} ELSE {n} END"
    one = lambda n, part, when: f"SELECT key, {sym(n)} AS sym, {part} + ord AS pos FROM base JOIN fam ON month(d) = m AND {n} BETWEEN lo AND hi WHERE year(d) BETWEEN 1900 AND 2100 AND ({when})"
    return f"base AS ({base}), {FAM}, raw AS ({one('day(d)', 0, day)} UNION ALL {one('(year(d) % 100)', 100, year)}), hits AS (SELECT key, sym, min(pos) AS pos FROM raw GROUP BY key, sym)"


CANON = (
    f"canon AS (SELECT key, sym, min(pos) AS pos FROM (SELECT key, sym, pos FROM hits UNION ALL SELECT key, {MODERN} AS sym, pos - 1000 FROM hits) WHERE sym IS NOT NULL GROUP BY key, sym), "
    f"ones AS (SELECT key, count(DISTINCT {MODERN}) = 1 AS one_modern FROM hits GROUP BY key)"
)
FMT = "CASE o_orderkey % 3 WHEN 1 THEN 'mmm-yy' WHEN 2 THEN 'd-mmm' END"
BASE = f"SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS d, {FMT} AS fmt FROM orders"
JOINED = "SELECT key, string_agg(sym, '|' ORDER BY pos) AS symbols FROM {} GROUP BY key"
MONTHS = "CASE " + " ".join(f"WHEN lower(tok) IN ({', '.join(q(n) for n in names)}) THEN {m}" for m, names in X.MONTHS.items()) + " END"
MON = "(" + "|".join(n for names in X.MONTHS.values() for n in names) + ")"
DATE_TEXT = """CASE o_orderkey % 8 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%-d-%b') WHEN 2 THEN strftime(d, '%b-%d-%y') WHEN 3 THEN strftime(d, '%d/%m/%y')
 WHEN 4 THEN strftime(d, '%B %-d, %Y') WHEN 5 THEN strftime(d, '%-d.%b.%Y') WHEN 6 THEN 'OCT4,' || strftime(d, '%-d-%b') ELSE strftime(d, '%-d %B %Y') END"""
FULL_YEAR = "CASE WHEN y = '' THEN 2026 WHEN CAST(y AS INT) < 100 THEN 2000 + CAST(y AS INT) ELSE CAST(y AS INT) END"
MKDATE = "TRY_CAST(lpad(CAST(yy AS VARCHAR), 4, '0') || '-' || lpad(CAST(mm AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') AS DATE)"


def parsed(whole_only: bool) -> str:
    """(o_orderkey, dates) of the rendered dates, form by form."""
    t = "t" if whole_only else "CASE WHEN starts_with(t, 'OCT4,') THEN substr(t, 6) ELSE t END"
    dm, md = f"(?i)^([0-9]{{1,2}})[-/.]{MON}([-/.]([0-9]{{2,4}}))?$", f"(?i)^{MON}[-/.]([0-9]{{1,2}})([-/.]([0-9]{{2,4}}))?$"
    nn = "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})$"
    long = "|".join(X.LONG_MONTHS)
    lm, ld = f"(?i)^({long}) ([0-9]{{1,2}}), ([0-9]{{4}})$", f"(?i)^([0-9]{{1,2}}) ({long}) ([0-9]{{4}})$"
    ex = lambda p, i: f"regexp_extract(s, {q(p)}, {i})"
    form = lambda p, y, tok, dd, pos: f"SELECT k, {pos} AS pos, {ex(p, y)} AS y, {tok} AS tok, CAST(NULL AS INT) AS mon, CAST({ex(p, dd)} AS INT) AS dd FROM src WHERE regexp_matches(s, {q(p)})"
    numbers = lambda a, b, pos: f"SELECT k, {pos}, {ex(nn, 3)}, '', CAST({ex(nn, a)} AS INT), CAST({ex(nn, b)} AS INT) FROM src WHERE regexp_matches(s, {q(nn)})"
    iso = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    return f"""WITH src AS (SELECT k, t, {t} AS s FROM (SELECT o_orderkey AS k, {DATE_TEXT} AS t FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders))),
 p AS ({form(dm, 4, ex(dm, 2), 1, 0)} UNION ALL {form(md, 4, ex(md, 1), 2, 0)} UNION ALL {form(lm, 3, f'left({ex(lm, 1)}, 3)', 2, 0)} UNION ALL {form(ld, 3, f'left({ex(ld, 2)}, 3)', 1, 0)}
 UNION ALL {numbers(2, 1, 0)} UNION ALL {numbers(1, 2, 1)} UNION ALL SELECT k, 0, {ex(iso, 1)}, '', CAST({ex(iso, 2)} AS INT), CAST({ex(iso, 3)} AS INT) FROM src WHERE regexp_matches(s, {q(iso)})),
 made AS (SELECT k, pos, {FULL_YEAR} AS yy, coalesce(mon, {MONTHS}) AS mm, dd FROM p),
 dates AS (SELECT k, {MKDATE} AS day, min(pos) AS pos FROM made GROUP BY k, day),
 agg AS (SELECT k, string_agg(CAST(day AS VARCHAR), '|' ORDER BY pos) AS dates FROM dates WHERE day IS NOT NULL GROUP BY k)
 SELECT src.k AS o_orderkey, {'t, ' if whole_only else ''}coalesce(dates, '') AS dates FROM src LEFT JOIN agg USING (k)"""


def kind_of(s: str) -> str:
    """Kind of a stripped text."""
    ids = " ".join(f"WHEN regexp_matches({s}, {q(p)}) THEN {q(k)}" for k, p in X.ID_SHAPES)
    return f"""CASE WHEN {s} = '' THEN 'empty' WHEN lower({s}) IN ({', '.join(map(q, X.MISSING))}) OR {s} IN ({', '.join(map(q, X.ZEROS))}) THEN 'placeholder' {ids}
 WHEN regexp_matches({s}, {q(X.GENE_LIKE)}) THEN 'gene_like' WHEN regexp_matches({s}, {q(X.RIKEN)}) THEN 'riken_pattern'
 WHEN regexp_matches({s}, {q(X.NUMERIC_TEXT)}) AND NOT coalesce(abs(TRY_CAST(nullif(regexp_extract({s}, '[eE]([+-]?[0-9]+)$', 1), '') AS BIGINT)) >= 10, false) THEN 'numeric' ELSE 'string-other' END"""


ID_TEXT = """CASE o_orderkey % 14 WHEN 0 THEN 'ENSG' || lpad(CAST(o_orderkey AS VARCHAR), 11, '0') WHEN 1 THEN 'NM_' || o_orderkey || '.2' WHEN 2 THEN 'P' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')
 WHEN 3 THEN 'HGNC:' || o_orderkey WHEN 4 THEN 'MGI:' || o_orderkey WHEN 5 THEN 'FBgn' || lpad(CAST(o_orderkey AS VARCHAR), 11, '0') WHEN 6 THEN CAST(o_orderkey AS VARCHAR) WHEN 7 THEN 'GENE' || (o_orderkey % 100)
 WHEN 8 THEN ' N/A ' WHEN 9 THEN (o_orderkey % 1000) || '.5e3' WHEN 10 THEN lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') || 'E13' WHEN 11 THEN 'free text ' || o_orderkey WHEN 12 THEN '0.0' ELSE '  ' END"""

COLUMN_KINDS = {
    "customer": ["c_custkey:i", "c_name:s", "c_nationkey:i", "c_acctbal:f", "c_mktsegment:s"],
    "part": ["p_partkey:i", "p_name:s", "p_brand:s", "p_type:s", "p_size:i", "p_retailprice:f"],
    "nation": ["n_nationkey:i", "n_name:s", "n_regionkey:i"],
    "region": ["r_regionkey:i", "r_name:s"],
    "supplier": ["s_suppkey:i", "s_name:s", "s_nationkey:i", "s_acctbal:f"],
    "orders": ["o_orderkey:i", "o_custkey:i", "o_orderstatus:s", "o_totalprice:f", "o_orderdate:d", "o_orderpriority:s"],
}


def cells() -> str:
    """cells(sheet, col_ord, col, row_id, vtype, s, x) of the six tables."""
    parts = []
    for t, cols in COLUMN_KINDS.items():
        for i, c in enumerate(cols):
            name, k = c.split(":")
            vtype = {"i": "int", "f": "float", "s": "str", "d": "date"}[k]
            s = f"trim(CAST({name} AS VARCHAR))" if k == "s" else "NULL"
            x = f"CAST({name} AS DOUBLE)" if k in "if" else "NULL"
            parts.append(f"SELECT {q(t)} AS sheet, {i} AS col_ord, {q(name)} AS col, CAST({TABLES[t]} AS BIGINT) AS row_id, {q(vtype)} AS vtype, {s} AS s, {x} AS x FROM {t} WHERE {name} IS NOT NULL")
    return " UNION ALL ".join(parts)


def cell_kind() -> str:
    return f"CASE vtype WHEN 'str' THEN {kind_of('s')} WHEN 'date' THEN 'date' ELSE CASE WHEN x = 0 THEN 'placeholder' ELSE 'numeric' END END"


def classified() -> str:
    """CTEs ending in cls(sheet, col, column_type, confidence, n_samples). No value of these tables is a known symbol."""
    share = lambda k: f"k_{k} / total"
    kinds = ["hgnc_id", "ensembl", "refseq", "uniprot", "entrez", "riken_pattern", "gene_like", "date", "numeric"]
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {q(k)}) * 1.0 AS k_{k}" for k in kinds) + ", count(*) FILTER (WHERE kind = 'string-other') * 1.0 AS k_other"
    rules = [("seen < 5", "'free_text'", "0.0"), ("total = 0", "'empty'", "0.0")]
    rules += [(f"{share(k)} >= 0.3", q(k), share(k)) for k in kinds[:5]]
    rules += [(f"{share('riken_pattern')} >= 0.3", "'riken'", share("riken_pattern")), (f"{share('gene_like')} >= 0.3", "'gene_symbol'", share("gene_like"))]
    rules += [(f"{share('date')} >= 0.2 AND k_gene_like = 0 AND k_riken_pattern = 0", "'date'", share("date")), (f"{share('numeric')} >= 0.5", "'measurement'", share("numeric")), (f"{share('date')} >= 0.5", "'date'", share("date"))]
    case = lambda i, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rules) + f" ELSE {other} END"
    return f"""cells AS ({cells()}), first AS (SELECT *, {cell_kind()} AS kind FROM (SELECT *, row_number() OVER (PARTITION BY sheet, col ORDER BY row_id) AS rn FROM cells) WHERE rn <= 200),
 agg AS (SELECT sheet, col, count(*) AS seen, count(*) FILTER (WHERE kind NOT IN ('placeholder', 'empty')) AS total, {counts} FROM first GROUP BY sheet, col),
 cls AS (SELECT sheet, col, {case(1, "'free_text'")} AS column_type, round({case(2, 'k_other / total')}, 6) AS confidence, CASE WHEN seen < 5 THEN seen ELSE total END AS n_samples FROM agg)"""


def counted() -> str:
    return f"""ev AS (SELECT sheet, col, count(*) AS n, count(*) FILTER (WHERE vtype = 'str') AS n_text, count(*) FILTER (WHERE vtype IN ('int', 'float')) AS n_num, count(*) FILTER (WHERE regexp_matches(s, {q(X.GENE_LIKE)})) AS n_gene_like,
 count(*) FILTER (WHERE regexp_matches(s, {q(X.DECIMAL_PERIOD)})) AS n_period, count(*) FILTER (WHERE regexp_matches(s, {q(X.DECIMAL_COMMA)})) AS n_comma, count(*) FILTER (WHERE regexp_matches(s, '^0[0-9]+$')) AS n_lz, min(row_id) AS first_row FROM cells GROUP BY sheet, col)"""


def hinted(col: str, hints: list[str]) -> str:
    """Whether a header has a hint; the header's words are matched by regular expression."""
    ends = " OR ".join(f"list_bool_or(list_transform(toks, lambda x: length(x) >= 4 AND length(x) >= {len(h) + 2} AND ends_with(x, {q(h)})))" for h in hints)
    return f"coalesce(list_has_any(toks, {texts(hints)}) OR {ends}, false)"


def tokens(col: str) -> str:
    return f"CASE WHEN length(trim({col})) > 80 THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(lower(trim({col})), '[a-z0-9]+') END"


VERDICTS = f"""WITH {classified()}, {counted()}, j AS (SELECT *, {tokens('col')} AS toks FROM cls JOIN ev USING (sheet, col)),
 h AS (SELECT *, {hinted('col', X.IDENTIFIER_HINTS)} AS hint, {hinted('col', X.NON_IDENTIFIER_HINTS)} AS non_hint FROM j),
 v AS (SELECT *, CASE WHEN column_type IN ('gene_symbol', 'riken') THEN true WHEN column_type = 'free_text' THEN NOT non_hint AND ((n_gene_like > 0 AND (n_gene_like + n - n_text) * 1.0 / n >= 0.5) OR hint) ELSE false END AS is_id FROM h)
 SELECT sheet, col, is_id, (n_lz >= 3 OR is_id OR hint OR column_type IN ('gene_symbol', 'entrez', 'uniprot', 'refseq', 'ensembl', 'hgnc_id', 'riken')) AS promoted,
 NOT {any_like('lower(col)', X.MEASUREMENT_EXEMPT)} AND ({any_like('lower(col)', X.MEASUREMENT_HEADERS)} OR (n >= 10 AND n_num * 1.0 / n >= 0.95)) AS measured, false AS legit_dates,
 NOT non_hint AND column_type NOT IN ('entrez', 'uniprot', 'refseq', 'ensembl', 'hgnc_id', 'measurement', 'date', 'empty') AS blind FROM v"""

SUSP_BASE = f"WITH {reversed_dates(BASE.replace(FMT, q('d-mmm')))}, {CANON}"
SUSP = f"""{SUSP_BASE}, susp AS (SELECT 'file' || (key % 23) || '_x.csv' AS file_id, 'S' || (key % 3) AS sheet, key % 7 AS col_ord, 'c' || (key % 7) AS col, key AS row_id, 'R' || (key % 4) AS rule_id, {texts(X.KINDS[:12])}[CAST(key % 12 + 1 AS INT)] AS kind,
 CAST(d AS VARCHAR) AS value_repr, symbols, string_split(symbols, '|') AS candidates, key % 20 / 20 AS confidence FROM base JOIN ({JOINED.format('canon')}) USING (key))"""
BAND = "CASE WHEN confidence >= 0.85 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' WHEN confidence >= 0.3 THEN 'Low' ELSE 'Info' END"
BUCKET = "CASE WHEN confidence >= 0.85 THEN 'high (>=0.85)' WHEN confidence >= 0.5 THEN 'medium (0.5-0.85)' ELSE 'low (<0.5)' END"

REG = """ok AS (SELECT p_partkey AS row, 'GEN' || p_partkey AS symbol, 'OLD' || (p_partkey % 300) || '|GEN' || (p_partkey + 1) AS prev, 'ALI' || (p_partkey % 200) || '| OLD' || (p_partkey % 400) || '| ali' || (p_partkey % 150) AS ali FROM part WHERE p_partkey % 17 <> 0),
 cur AS (SELECT symbol FROM ok), prv AS (SELECT old, arg_min(symbol, row) AS symbol, min(row) AS row FROM (SELECT trim(unnest(string_split(prev, '|'))) AS old, symbol, row FROM ok) WHERE old NOT IN (SELECT symbol FROM cur) GROUP BY old),
 als AS (SELECT old, arg_min(symbol, row) AS symbol, min(row) AS row FROM (SELECT trim(unnest(string_split(ali, '|'))) AS old, symbol, row FROM ok) WHERE old NOT IN (SELECT symbol FROM cur) AND old NOT IN (SELECT old FROM prv) GROUP BY old)"""
LEVELS = "lev AS (SELECT symbol AS key, symbol, 0 AS l, 0 AS row FROM cur UNION ALL SELECT old, symbol, 1, row FROM prv UNION ALL SELECT old, symbol, 2, row FROM als), ex AS (SELECT key, arg_min(symbol, (l, symbol)) AS symbol FROM lev GROUP BY key), fo AS (SELECT lower(key) AS key, arg_min(symbol, (l, -row, symbol)) AS symbol FROM lev GROUP BY lower(key))"
HOMO_FROM = "".join(X.HOMOGLYPHS)
HOMO_TO = "".join(t * len(f) for f, t in X.HOMOGLYPHS.items())
BRAND = "replace(CASE WHEN p_partkey % 5 = 0 THEN translate(upper(p_brand), 'ABR', 'АΒꓣ') ELSE upper(p_brand) END, '#', '')"

SQL: dict[str, str] = {
    "serial_to_date": "SELECT o_orderkey, n, CASE WHEN n BETWEEN 20000 AND 60000 THEN CAST(DATE '1899-12-30' + CAST(n AS INT) AS VARCHAR) END AS decoded FROM (SELECT o_orderkey, 19990 + o_orderkey % 40020 AS n FROM orders)",
    "reverse_date": f"WITH {reversed_dates(BASE)} SELECT key AS o_orderkey, coalesce(symbols, '') AS symbols FROM base LEFT JOIN ({JOINED.format('hits')}) USING (key)",
    "canonicalize": f"WITH {reversed_dates(BASE)}, {CANON} SELECT key AS o_orderkey, coalesce(symbols, '') AS symbols, coalesce(one_modern, false) AS one_modern FROM base LEFT JOIN ({JOINED.format('canon')}) USING (key) LEFT JOIN ones USING (key)",
    "gene_date_by_family": f"WITH {reversed_dates(BASE)}, {CANON} SELECT {FAMILY_OF} AS family, count(*) AS n FROM (SELECT key, arg_min(sym, pos) AS s FROM canon GROUP BY key) GROUP BY family",
    "parse_date_text": parsed(True),
    "parse_cell_dates": parsed(False),
    "simulate_roundtrip": f"""WITH s AS (SELECT c_custkey, ['SEPT', 'MARCH', 'DEC', 'OCT', 'JUN', 'TAMM', 'BRCA'][CAST(c_custkey % 7 + 1 AS INT)] AS p, c_custkey % 53 AS n FROM customer),
 m AS (SELECT c_custkey, p || n AS symbol, CASE WHEN p = 'SEPT' AND n BETWEEN 1 AND 15 THEN make_date(2024, 9, n) WHEN p = 'MARCH' AND n BETWEEN 1 AND 12 THEN make_date(2024, 3, n) WHEN p = 'DEC' AND n BETWEEN 1 AND 2 THEN make_date(2024, 12, n)
 WHEN p = 'OCT' AND n BETWEEN 1 AND 11 THEN make_date(2024, 10, n) WHEN p = 'JUN' AND n BETWEEN 1 AND 3 THEN make_date(2024, 5, 32 - n) WHEN p = 'TAMM' AND n BETWEEN 30 AND 50 THEN make_date(2000 + n, 1, 1) END AS made FROM s)
 SELECT c_custkey, symbol, CAST(made AS VARCHAR) AS made, made IS NOT NULL AS round_trip FROM m""",
    "riken_signature": """WITH v AS (SELECT DISTINCT l_orderkey, CAST(1000000 + l_orderkey * 7919 % 9000000 AS DOUBLE) * [CAST('1e0' AS DOUBLE), CAST('1e1' AS DOUBLE), CAST('1e6' AS DOUBLE), CAST('1e13' AS DOUBLE), CAST('1e20' AS DOUBLE), CAST('1e25' AS DOUBLE)][CAST(l_orderkey % 6 + 1 AS INT)] AS x FROM lineitem),
 e AS (SELECT *, CAST(floor(log10(x)) AS INT) AS k FROM v), m AS (SELECT *, x / [""" + ", ".join(f"CAST('1e{i}' AS DOUBLE)" for i in range(27)) + """][k - 5] AS m FROM e),
 d AS (SELECT *, CASE WHEN m = floor(m) AND m BETWEEN 1000000 AND 9999999 THEN CAST(CAST(m AS BIGINT) AS VARCHAR) END AS g FROM m)
 SELECT l_orderkey, coalesce(k BETWEEN 7 AND 31 AND g IS NOT NULL AND NOT ends_with(g, '00') AND len(list_filter(list_distinct(string_split(g, '')), lambda c: c <> '0')) >= 3, false) AS signature, abs(x) >= 9007199254740992.0 AS beyond_exact FROM d""",
    "leading_zeros": """WITH r AS (SELECT c_custkey AS row_id, right(c_name, 9) AS s FROM customer), t AS (SELECT row_id, CASE WHEN row_id % 7 = 0 THEN CAST(CAST(s AS BIGINT) AS VARCHAR) ELSE s END AS t FROM r)
 SELECT row_id, t AS value_repr, lpad(t, 9, '0') AS suggestion, 0.85 AS confidence FROM t WHERE NOT starts_with(t, '0') AND length(t) < 9""",
    "time_texts": f"WITH t AS (SELECT event_id, strftime(ts, '%H:%M') || CASE WHEN event_id % 5 = 0 THEN ':71' ELSE '' END AS t FROM events) SELECT event_id, t, CASE WHEN regexp_matches(t, {q(X.TIME_TEXT)}) THEN CAST(CAST(string_split(t, ':')[1] AS INT) AS VARCHAR) || ':' || string_split(t, ':')[2] END AS h_mm FROM t",
    "cas_and_aliases": f"WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey + 10) || '-' || (o_orderkey % 100) || '-' || (o_orderkey % 10) WHEN 1 THEN ['Oct-3/4', '3/4-Oct', 'OCT34', 'oct3/4', 'Oct-4'][CAST(o_orderkey % 5 + 1 AS INT)] ELSE o_orderkey || '-' || o_orderkey END AS t FROM orders) SELECT o_orderkey, regexp_matches(t, {q(X.CAS)}) AS cas, regexp_matches(t, {q('(?i)' + X.OCT34)}) AS oct34 FROM t",
    "decimal_commas": """WITH t AS (SELECT c_custkey AS k, printf('%.2f', c_acctbal) AS one FROM customer), s AS (SELECT k, CASE WHEN k % 50 = 0 THEN replace(one, '.', ',') ELSE one END AS v FROM t)
 SELECT 'sparse' AS col, k AS row_id, 'R-DC-CELL' AS rule_id, v AS value_repr, 0.40 AS confidence FROM s WHERE contains(v, ',')
 UNION ALL SELECT 'throughout', min(k), 'R-DC-COL', count(*) || '/' || count(*) || ' cells use comma-decimal', 0.55 FROM t""",
    "homoglyphs": f"""WITH t AS (SELECT p_partkey, {BRAND} AS t FROM part), f AS (SELECT *, translate(t, {q(HOMO_FROM)}, {q(HOMO_TO)}) AS repaired FROM t)
 SELECT p_partkey, repaired, CASE WHEN repaired <> t AND (regexp_matches(repaired, {q(X.GENE_LIKE)}) OR regexp_matches(repaired, {q(X.GENE_LIKE_LOOSE)})) THEN repaired END AS symbol, length(t) - length(translate(t, {q(HOMO_FROM)}, '')) AS n FROM f""",
    "value_kinds": f"WITH t AS (SELECT o_orderkey, trim({ID_TEXT}) AS s FROM orders) SELECT o_orderkey, {kind_of('s')} AS kind, CASE {' '.join(f'WHEN regexp_matches(s, {q(p)}) THEN {q(k)}' for k, p in X.ID_SHAPES)} END AS external FROM t",
    "header_hints": f"WITH h(header) AS (VALUES {', '.join(f'({q(h)})' for h in HEADERS)}), t AS (SELECT header, {tokens('header')} AS toks FROM h) SELECT header, array_to_string(toks, '|') AS tokens, {hinted('header', X.IDENTIFIER_HINTS)} AS identifier, {hinted('header', X.NON_IDENTIFIER_HINTS)} AS other FROM t",
    "cells_of_tables": f"SELECT sheet, col_ord, col, vtype, count(*) AS n, min(row_id) AS lo, max(row_id) AS hi FROM ({cells()}) GROUP BY ALL",
    "classify_columns": f"WITH {classified()} SELECT * FROM cls",
    "column_verdicts": VERDICTS,
    "column_counts": f"WITH cells AS ({cells()}), {counted()} SELECT * FROM ev",
    "bands": f"{SUSP} SELECT {BAND} AS band, {BUCKET} AS bucket, count(*) AS n FROM susp GROUP BY ALL",
    "exit_codes": f"{SUSP} SELECT file_id, CASE WHEN max(confidence) >= 0.85 THEN 1 WHEN max(confidence) >= 0.3 THEN 2 ELSE 0 END AS code FROM susp GROUP BY file_id",
    "audit": f"""{SUSP}, f AS (SELECT 'file' || i || '_x.csv' AS file_id FROM range(25) t(i)), b AS (SELECT *, {BAND} AS band FROM susp)
 SELECT f.file_id, count(*) FILTER (WHERE band = 'High') AS high, count(*) FILTER (WHERE band = 'Medium') AS medium, count(*) FILTER (WHERE band = 'Low') AS low, count(*) FILTER (WHERE band = 'Info') AS info, coalesce(string_agg(DISTINCT kind, '|' ORDER BY kind), '') AS kinds FROM f LEFT JOIN b USING (file_id) GROUP BY f.file_id""",
    "analytics": f"""{SUSP}, c AS (SELECT *, {FAMILY_OF.replace('(s,', '(candidates[1],')} AS fam, {BUCKET} AS bucket, sheet || '::' || col AS place FROM susp)
 SELECT 'kind' AS facet, kind AS item, count(*) AS n FROM c GROUP BY kind UNION ALL SELECT 'family', fam, count(*) FROM c GROUP BY fam
 UNION ALL SELECT 'bucket', b, count(c.bucket) FROM (VALUES ('high (>=0.85)'), ('medium (0.5-0.85)'), ('low (<0.5)')) t(b) LEFT JOIN c ON c.bucket = b GROUP BY b
 UNION ALL SELECT * FROM (SELECT 'place', place, count(*) AS n FROM c GROUP BY place ORDER BY n DESC, place LIMIT 15)
 UNION ALL SELECT 'total', 'n', count(*) FROM c UNION ALL SELECT 'total', 'sheets', count(DISTINCT sheet) FROM c UNION ALL SELECT 'total', 'columns', count(DISTINCT place) FROM c""",
    "capped": f"{SUSP}, b AS (SELECT *, {BAND} AS band FROM susp), r AS (SELECT file_id, band, row_number() OVER (PARTITION BY file_id, band ORDER BY confidence DESC, sheet, col_ord, row_id, rule_id) AS n, row_id FROM b) SELECT * FROM r WHERE n <= 3",
    "proposals": f"{SUSP} SELECT sheet, col AS column, row_id AS row, confidence >= 0.85 AS accept, value_repr AS original, candidates[1] AS proposed, array_to_string(candidates[2:], ' | ') AS alt_candidates, kind FROM susp",
    "audit_log": f"""{SUSP}, s AS (SELECT *, kind IN ('decimal-comma', 'cas-registry') AS adv FROM susp WHERE file_id = 'file3_x.csv'), w AS (SELECT *, CASE WHEN sheet <> 'S0' THEN 'sheet not in workbook' WHEN col NOT IN ('c0', 'c1') THEN 'could not resolve cell' WHEN adv THEN 'advisory only' END AS skip_reason FROM s)
 SELECT sheet, col, row_id, skip_reason IS NULL AS applied, skip_reason, candidates[1] AS proposed_value FROM w""",
    "apply_corrections": f"""{SUSP}, ok AS (SELECT col, row_id, candidates[1] AS new FROM susp WHERE file_id = 'file3_x.csv' AND sheet = 'S0' AND col IN ('c0', 'c1') AND kind NOT IN ('decimal-comma', 'cas-registry')),
 c AS (SELECT 'c0' AS col, o_orderkey AS row_id, 'date' AS vtype, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS v FROM orders UNION ALL SELECT 'c1', o_orderkey, 'int', CAST(o_custkey AS VARCHAR) FROM orders)
 SELECT c.col, c.row_id, CASE WHEN new IS NULL THEN vtype ELSE 'str' END AS vtype, coalesce(new, v) AS value FROM c LEFT JOIN ok USING (col, row_id)""",
    "registry_build": f"WITH {REG} SELECT 'prev' AS part, old, symbol FROM prv UNION ALL SELECT 'alias', old, symbol FROM als",
    "registry_resolve": f"WITH {REG}, {LEVELS}, a AS (SELECT DISTINCT ['GEN', 'gen', 'OLD', 'Ali', 'ALI', 'none'][CAST(o_orderkey % 6 + 1 AS INT)] || (o_orderkey % 350) AS ask FROM orders) SELECT ask, coalesce(ex.symbol, fo.symbol) AS resolved FROM a LEFT JOIN ex ON ex.key = ask LEFT JOIN fo ON fo.key = lower(ask)",
    "registry_equivalents": f"""WITH {REG}, {LEVELS}, a AS (SELECT symbol FROM cur UNION SELECT old FROM prv), r AS (SELECT a.symbol, coalesce(ex.symbol, fo.symbol) AS res FROM a LEFT JOIN ex ON ex.key = a.symbol LEFT JOIN fo ON fo.key = lower(a.symbol)),
 own AS (SELECT symbol, symbol AS name FROM r UNION SELECT symbol, res FROM r WHERE res IS NOT NULL), o AS (SELECT * FROM prv UNION ALL SELECT * FROM als) SELECT symbol, name AS equivalent FROM own UNION SELECT own.symbol, o.old FROM own JOIN o ON o.symbol = own.name""",
    "xref_lookup": """WITH i AS (SELECT DISTINCT l_suppkey % 4 AS f, l_partkey AS k FROM lineitem), nm AS (SELECT p_partkey % 900 AS n, min(p_partkey) AS p FROM part WHERE p_partkey % 17 <> 0 GROUP BY 1)
 SELECT DISTINCT CASE f WHEN 0 THEN 'ENSG' || lpad(CAST(k AS VARCHAR), 11, '0') || '.7' WHEN 1 THEN 'HGNC:' || k WHEN 2 THEN CAST(k + 1000 AS VARCHAR) ELSE 'NM_' || (k % 900) || '.1' END AS id,
 CASE WHEN f = 3 THEN 'GEN' || nm.p WHEN k % 17 <> 0 AND k IN (SELECT p_partkey FROM part) THEN 'GEN' || k END AS gene FROM i LEFT JOIN nm ON f = 3 AND nm.n = k % 900""",
    "xref_adjudicate": f"""WITH {REG}, {LEVELS}, o AS (SELECT o_orderkey AS row_id, o_orderkey % 60 + 1 AS c, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 0 THEN o_orderkey % 60 + 1 ELSE o_orderkey % 50 + 1 END AS h, 0.15 + (o_orderkey % 5) * 0.2 AS conf, o_orderkey % 10 <> 9 AS sug FROM orders),
 eq AS (SELECT c, coalesce(ex.symbol, fo.symbol) AS res FROM (SELECT DISTINCT c FROM o) LEFT JOIN ex ON ex.key = 'GEN' || c LEFT JOIN fo ON fo.key = 'gen' || c),
 olds AS (SELECT * FROM prv UNION ALL SELECT * FROM als),
 e AS (SELECT c, 'GEN' || c AS g FROM eq UNION SELECT c, res FROM eq WHERE res IS NOT NULL UNION SELECT eq.c, olds.old FROM eq JOIN olds ON olds.symbol = 'GEN' || eq.c OR olds.symbol = eq.res),
 r AS (SELECT o.*, CASE WHEN h IN (SELECT row FROM ok) THEN 'GEN' || h END AS gene FROM o), s AS (SELECT r.*, e.g IS NOT NULL AS hit FROM r LEFT JOIN e ON e.c = r.c AND e.g = r.gene)
 SELECT row_id, CASE WHEN sug THEN CASE WHEN gene IS NULL THEN 'absent' WHEN hit THEN 'corroborated' ELSE 'contradicted' END END AS xref_status,
 round(CASE WHEN NOT sug OR gene IS NULL THEN conf WHEN hit THEN least(0.99, conf + 0.4) ELSE least(conf, 0.2) END, 6) AS confidence FROM s""",
    "prefilter": """WITH w AS (SELECT doc_id // 100 AS f, CASE WHEN doc_id % 4 = 0 THEN 'SEPT' || (doc_id // 4 % 20) END AS v FROM documents) SELECT 'f' || f AS file_id FROM w WHERE v IN (SELECT 'SEPT' || i FROM range(1, 16) t(i)) GROUP BY f HAVING count(DISTINCT v) >= 5""",
    "precision_intervals": """WITH g AS (SELECT CAST(toxic AS VARCHAR) AS kind, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS hits FROM labels GROUP BY toxic), p AS (SELECT *, hits / n AS p, 1.959964 AS z FROM g)
 SELECT kind, n, hits, round(p, 6) AS precision, round((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 6) AS lo, round((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 6) AS hi FROM p""",
    "corpus_summary": f"""{SUSP}, f AS (SELECT 'file' || i || '_x.csv' AS file_id FROM range(40) t(i)), b AS (SELECT file_id, {BAND} AS band FROM susp), p AS (SELECT file_id, string_split(file_id, '_')[1] AS paper, length(file_id) = 11 AS gene, file_id IN (SELECT file_id FROM b) AS hit FROM f), fb AS (SELECT * FROM b WHERE file_id IN (SELECT file_id FROM f))
 SELECT count(*) AS files, count(*) FILTER (WHERE gene) AS gene_files, count(*) FILTER (WHERE gene AND hit) AS corrupted_files, count(DISTINCT paper) AS papers, count(DISTINCT CASE WHEN gene AND hit THEN paper END) AS papers_corrupted,
 (SELECT count(*) FROM fb WHERE band = 'High') AS high, (SELECT count(*) FROM fb WHERE band = 'Medium') AS medium, (SELECT count(*) FROM fb WHERE band = 'Low') AS low, (SELECT count(*) FROM fb WHERE band = 'Info') AS info FROM p""",
    "batch_summary": f"{SUSP} SELECT 'files' AS item, 40 AS n UNION ALL SELECT 'files with suspicions', count(DISTINCT file_id) FROM susp UNION ALL SELECT {BAND}, count(*) FROM susp GROUP BY 1",
    "detect_sheet": f"""WITH {reversed_dates("SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS d, CAST(NULL AS VARCHAR) AS fmt FROM orders WHERE o_orderkey % 11 = 0")}, {CANON}, js AS (SELECT key, string_agg(sym, ' | ' ORDER BY pos) AS symbols, count(*) AS k FROM canon GROUP BY key),
 n AS (SELECT count(DISTINCT key) AS c FROM hits)
 SELECT 'symbol' AS col, key AS row_id, 'R-DATE' AS rule_id, 'gene-date' AS kind, symbols AS suggestion, CASE WHEN k = 1 THEN 0.95 WHEN k IS NULL THEN 0.0 WHEN c < 2 THEN CASE WHEN one_modern THEN 0.3 ELSE 0.2 END WHEN one_modern THEN 0.6 ELSE 0.5 END AS confidence
 FROM base LEFT JOIN js USING (key) LEFT JOIN ones USING (key), n UNION ALL SELECT 'note', o_orderkey, 'R-DSTR', 'gene-date-string', 'OCT2', 0.55 FROM orders WHERE o_orderkey % 97 = 0""",
    "recall": f"""{SUSP}, e AS (SELECT o_orderkey AS note_id, 'file' || (o_orderkey % 29) || '_x.csv' AS file_id, CASE o_orderkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['MARC1', 'MARCH1', 'SEPT2'] WHEN 2 THEN ['DEC1'] ELSE ['MARCH9', 'OCT4'] END AS symbols FROM orders),
 o AS (SELECT file_id, list_distinct(flatten(list(candidates))) AS offered FROM susp GROUP BY file_id)
 SELECT note_id, array_to_string(symbols, '|') AS symbols, CASE WHEN len(symbols) = 0 THEN 'ambiguous-note' WHEN offered IS NULL THEN 'FN-missed' WHEN list_has_any(symbols, offered) THEN 'TP' ELSE 'FN-suggestion-mismatch' END AS outcome FROM e LEFT JOIN o USING (file_id)""",
    "html_sniff": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'tsv' ELSE CASE WHEN contains(lower(substr(html, 1, 2048)), '<table') THEN 'html' WHEN regexp_matches(lower(ltrim(substr(html, 1, 2048))), '^(<!doctype html|<html|<head|<\\?xml version|<script)') THEN 'error' WHEN contains(substr(html, 1, 2048), chr(9)) THEN 'tsv' ELSE 'as named' END END AS format FROM pages",
    "merged_fill": "SELECT a.n_nationkey + i AS row_id, c AS col, CASE WHEN c = 'b' AND i = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE n_name END AS v_str FROM (SELECT * FROM nation WHERE n_nationkey % 5 = 0) a, range(4) r(i), (VALUES ('a'), ('b')) t(c)",
    "snapshot_ages": """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01') END AS age FROM orders) SELECT o_orderkey, age, CASE WHEN age > 30 THEN 'registry snapshot is ' || age || ' days old' END AS note FROM p""",
    "date_prone": "SELECT 'SEPT' || i AS old, 'SEPTIN' || i AS symbol FROM range(1, 16) t(i) UNION ALL SELECT 'MARCH' || i, 'MARCHF' || i FROM range(1, 13) t(i) UNION ALL SELECT 'MARC' || i, 'MTARC' || i FROM range(1, 3) t(i) UNION ALL SELECT 'DEC1', 'DELEC1'",
    "autofill_runs": """WITH RECURSIVE src AS (SELECT o_orderkey // 13 AS grp, o_orderkey % 13 AS r, DATE '2010-01-01' + CAST((o_orderkey % 13) * [1, 7, 7, 30, 365, 1, 1, 12][CAST((o_orderkey // 13) % 8 + 1 AS INT)] + CASE WHEN o_orderkey % 13 > 6 THEN o_orderkey % 3 ELSE 0 END AS INT) AS d FROM orders),
 c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY r) AS rn, count(*) OVER (PARTITION BY grp) AS total FROM src),
 f AS (SELECT grp, rn, total, r, d, r AS first, 1 AS n, -1 AS band, CAST(NULL AS BIGINT) AS cf, 0 AS cn FROM c WHERE rn = 1 UNION ALL
 SELECT grp, rn, total, r, d, CASE WHEN go THEN first ELSE r END, CASE WHEN go THEN n + 1 ELSE 1 END, CASE WHEN go THEN b ELSE -1 END, CASE WHEN NOT go AND n >= 3 THEN first END, CASE WHEN NOT go AND n >= 3 THEN n ELSE 0 END
 FROM (SELECT c.grp, c.rn, c.total, c.r, c.d, f.first, f.n, CASE WHEN c.d - f.d = 1 THEN 0 WHEN c.d - f.d = 7 THEN 1 WHEN c.d - f.d BETWEEN 28 AND 32 THEN 2 WHEN c.d - f.d BETWEEN 365 AND 367 THEN 3 ELSE -2 END AS b,
 (c.r - f.r BETWEEN 1 AND 2) AND (CASE WHEN c.d - f.d = 1 THEN 0 WHEN c.d - f.d = 7 THEN 1 WHEN c.d - f.d BETWEEN 28 AND 32 THEN 2 WHEN c.d - f.d BETWEEN 365 AND 367 THEN 3 ELSE -2 END) >= 0
 AND (f.band = -1 OR f.band = CASE WHEN c.d - f.d = 1 THEN 0 WHEN c.d - f.d = 7 THEN 1 WHEN c.d - f.d BETWEEN 28 AND 32 THEN 2 WHEN c.d - f.d BETWEEN 365 AND 367 THEN 3 ELSE -2 END) AS go FROM f JOIN c ON c.grp = f.grp AND c.rn = f.rn + 1))
 SELECT grp, cf AS first_row, cn AS length FROM f WHERE cn >= 3 UNION ALL SELECT grp, first, n FROM f WHERE rn = total AND n >= 3""",
    "schema_fields": VERDICTS.replace(" SELECT sheet, col, is_id, (n_lz", ", vv AS (SELECT sheet, col, is_id, (n_lz", 1) + f"""), t AS (SELECT sheet, col, any_value(vtype) AS vtype, count(*) FILTER (WHERE regexp_matches(s, {q(X.GENE_LIKE)})) AS g, count(*) FILTER (WHERE regexp_matches(s, {q(X.RIKEN)})) AS r FROM first GROUP BY sheet, col)
 SELECT sheet, col, CASE WHEN promoted THEN CASE WHEN g > 0 AND g >= r THEN 'HGNC' WHEN r > 0 THEN 'RIKEN' ELSE 'generic' END END AS registry, CASE WHEN promoted THEN 'string' ELSE CASE vtype WHEN 'int' THEN 'integer' WHEN 'float' THEN 'number' WHEN 'date' THEN 'date' ELSE 'string' END END AS type,
 CASE WHEN promoted AND g > 0 AND g >= r THEN '^[A-Z][A-Z0-9-]{{1,14}}$' WHEN promoted AND r > 0 THEN '^\\d{{7}}[A-Z]\\d{{2}}$' END AS pattern FROM vv JOIN t USING (sheet, col)""",
    # what each rule has to say of the golden sheets, once for each nation
    "rule_sheets": """SELECT sheet, col, row_id, rule_id, kind, suggestion, CAST(confidence AS DOUBLE) AS confidence, (SELECT count(*) FROM nation) AS n FROM (VALUES
 ('times', 'gene', 3, 'R-TIME-STR', 'time-coercion', '1:03', 0.75),
 ('times', 'gene', 4, 'R-TIME-STR', 'time-coercion', '11:30', 0.75),
 ('times', 'gene', 5, 'R-TIME-OBJ', 'time-coercion', '1:3', 0.80),
 ('alike', 'gene', 4, 'R-HOMO', 'homoglyph', 'TP53', 0.85),
 ('alike', 'gene', 5, 'R-HOMO', 'homoglyph', 'ATM', 0.85),
 ('dates', 'symbol', 2, 'R-DATE', 'gene-date', 'SEPTIN2 | SEPT2 | SEP2', 0.60),
 ('dates', 'symbol', 3, 'R-DATE', 'gene-date', 'MARCHF1 | MTARC1 | MARCH1 | MARC1', 0.50),
 ('lone', 'symbol', 3, 'R-DATE', 'gene-date', 'SEPTIN2 | SEPT2 | SEP2', 0.30),
 ('serial', 'symbol', 2, 'R-SER-NUM', 'gene-date-serial', 'MARCH1 | MARC1', 0.85),
 ('serial', 'symbol', 4, 'R-SER-STR', 'gene-date-serial', 'SEPT2 | SEP2', 0.75),
 ('serial', 'symbol', 5, 'R-DATE', 'gene-date', 'SEPTIN2 | SEPT2 | SEP2', 0.30),
 ('serial', 'symbol', 6, 'R-SER-NUM', 'gene-date-serial', 'SEPT1 | SEP1 | SEPT12 | SEP12', 0.85),
 ('serial_alone', 'symbol', 4, 'R-SER-NUM', 'gene-date-serial', 'MARCH1 | MARC1', 0.15),
 ('serial_alone', 'symbol', 5, 'R-SER-STR', 'gene-date-serial', 'SEPT2 | SEP2', 0.15),
 ('id_float', 'symbol', 4, 'R-IDFLOAT-P1', 'id-float', NULL, 0.85),
 ('zeros', 'acc', 3, 'R-LZ', 'leading-zero-stripped', '00012345', 0.85),
 ('zeros', 'acc', 4, 'R-LZ', 'leading-zero-stripped', '00023456', 0.85),
 ('zeros_two', 'acc', 3, 'R-LZ', 'leading-zero-stripped', '00012345', 0.65),
 ('long', 'accession', 4, 'R-LONG', 'long-int-precision-loss', NULL, 0.85),
 ('floats', 'gene_id', 1, 'R-IDF-A', 'id-float', NULL, 0.95),
 ('floats', 'gene_id', 3, 'R-IDF-A', 'id-float', NULL, 0.95),
 ('floats', 'gene_id', 4, 'R-IDF-A', 'id-float', NULL, 0.80),
 ('riken', 'RIKEN_cdna_id', 0, 'R-IDF-B', 'id-float', NULL, 0.85),
 ('riken', 'RIKEN_cdna_id', 1, 'R-IDF-B', 'id-float', NULL, 0.85),
 ('riken', 'RIKEN_cdna_id', 2, 'R-IDF-B', 'id-float', NULL, 0.85),
 ('riken', 'RIKEN_cdna_id', 3, 'R-IDF-C', 'id-float', NULL, 0.55),
 ('blind', 'misc_col', 2, 'R-SSTR', 'gene-date-serial', 'SEPT2 | SEP2', 0.30),
 ('blind', 'Unnamed_1', 0, 'R-SNUM', 'gene-date-serial', 'MARCH8', 0.30),
 ('blind', 'col_a', 1, 'R-DSTR', 'gene-date-string', 'OCT2', 0.55),
 ('blind', 'misc_b', 1, 'R-DATE-P2', 'gene-date', 'SEPTIN2 | SEPT2 | SEP2', 0.30),
 ('texts', 'marker', 0, 'R-OCT34', 'gene-date-string', 'POU5F1 | OCT4 | OCT3', 0.80),
 ('texts', 'remark', 1, 'R-CAS', 'cas-registry', '50-78-2', 0.70),
 ('texts', 'cas_number', 1, 'R-CAS', 'cas-registry', '50-78-2', 0.20),
 ('auto', 'symbol', 5, 'R-AUTO', 'autofill-sequence', NULL, 0.90),
 ('auto', 'symbol', 5, 'R-DATE', 'gene-date', 'SEPTIN2 | SEPT2 | SEP2', 0.60),
 ('auto', 'symbol', 6, 'R-DATE', 'gene-date', 'SEPTIN3 | SEPT3 | SEP3', 0.60),
 ('auto', 'symbol', 7, 'R-DATE', 'gene-date', 'SEPTIN4 | SEPT4 | SEP4', 0.60),
 ('auto', 'symbol', 8, 'R-DATE', 'gene-date', 'SEPTIN5 | SEPT5 | SEP5', 0.60),
 ('auto', 'symbol', 9, 'R-DATE', 'gene-date', 'SEPTIN6 | SEPT6 | SEP6', 0.60),
 ('commas', 'value', 0, 'R-DC-COL', 'decimal-comma', 'set decimalChar to `,` in the table schema, or convert numbers to period-decimal', 0.55),
 ('comma_cell', 'value', 9, 'R-DC-CELL', 'decimal-comma', 'period-decimal (replace `,` with `.`)', 0.40),
 ('unknown', 'symbol', 10, 'R-UNREC', 'unrecognized-symbol', NULL, 0.20)) t(sheet, col, row_id, rule_id, kind, suggestion, confidence)""",
    "large_files": "SELECT 'f' || o_orderkey AS file_id, 'R-BIG' AS rule_id, 'file-too-large' AS kind, format('{:,}', o_orderkey * 10007) || ' bytes' AS value_repr, CAST(0 AS DOUBLE) AS confidence FROM orders WHERE o_orderkey * 10007 > 100000000",
    "stratified_sample": "SELECT o_orderkey AS row_id, CAST(o_totalprice AS DOUBLE) AS v_num FROM orders WHERE o_orderkey < 100 OR o_orderkey >= (SELECT max(o_orderkey) - 99 FROM orders)",
    "column_names": "SELECT p_partkey, p_name AS name FROM part",
    "walk_files": """WITH f AS (SELECT DISTINCT o_orderkey % 50 AS a, o_orderkey % 7 AS b FROM orders), g AS (SELECT 'cache/PMC' || a || '_t' || b || CASE WHEN b = 3 THEN '.csv' ELSE '.xlsx' END AS file_id, a, b FROM f)
 SELECT o_orderkey AS note_id, g.file_id FROM orders LEFT JOIN g ON g.a = o_orderkey % 50 AND g.b = o_orderkey % 30 AND g.b <> 3 WHERE o_orderkey % 4 > 0 UNION ALL
 SELECT o_orderkey, g.file_id FROM orders LEFT JOIN g ON g.a = o_orderkey % 50 AND g.b <> 3 WHERE o_orderkey % 4 = 0""",
}
