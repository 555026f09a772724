"""SQL twins of the ERP-shaped views and of shared intermediate tables, for the oracle queries."""

from __future__ import annotations

import re

OFFSET = 2 ** 0.5 - 1

# name -> SQL text; names used inside a text are resolved recursively by `sql`
CTES: dict[str, str] = {
    "lines": """
SELECT l.*, CAST(o.o_orderdate AS DATE) AS day,
       upper(strftime(o.o_orderdate, '%b-%y')) AS SOURCE_MONTH
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "invoice": """
SELECT CAST(o_orderkey AS VARCHAR) AS INVNO, CAST(o_orderdate AS DATE) AS INVDT, '00:00' AS TIME,
       CAST(o_orderdate AS DATE) + 30 AS DUEDT,
       upper(strftime(o_orderdate, '%b-%y')) AS SOURCE_MONTH,
       CAST(o_custkey AS VARCHAR) AS CCODE, CAST(o_custkey AS VARCHAR) AS ACODE,
       substr(o_orderpriority, 1, 1) AS SCODE, t.amt AS TOT_AMT,
       CAST(0 AS DOUBLE) AS DISC_PER, CAST(0 AS DOUBLE) AS FDISC_AMT, CAST(0 AS DOUBLE) AS ST_AMT,
       o_totalprice AS NET_AMT, 0 AS CANCEL_ID, o_orderstatus AS REMARK
FROM orders LEFT JOIN (
  SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amt
  FROM lineitem GROUP BY l_orderkey) t ON o_orderkey = t.l_orderkey""",
    "invdet": """
SELECT CAST(l_orderkey AS VARCHAR) AS INVNO, CAST(l_partkey AS VARCHAR) AS MDCODE,
       CAST(l_linenumber AS VARCHAR) AS BATCH, CAST(l_shipdate AS DATE) + 365 AS EXP,
       l_quantity AS QTY, CAST(0 AS DOUBLE) AS FQTY, l_extendedprice / l_quantity AS RATE,
       l_extendedprice / l_quantity AS SERATE, l_extendedprice / l_quantity AS ACRATE,
       p_retailprice AS PRATE, l_extendedprice / l_quantity * CAST(1.2 AS DOUBLE) AS MRP,
       CAST(CAST(floor(l_tax * 100 + 0.5) AS INTEGER) AS VARCHAR) AS TCODE,
       CASE WHEN l_returnflag = 'R' THEN 1 END AS CANCEL_ID, CAST(l_suppkey AS VARCHAR) AS SUPNO,
       CAST(l_shipdate AS DATE) AS LPDT, 0 AS RATCHG, SOURCE_MONTH, p_brand AS BRAND, p_type AS KIND
FROM lines JOIN part ON l_partkey = p_partkey""",
    "medimast": """
SELECT CAST(p_partkey AS VARCHAR) AS MDCODE, p_name AS MDNAME, p_type AS PACKG,
       CAST(NULL AS VARCHAR) AS DETAIL, p_brand AS SUPCODE,
       CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS HSN, CAST(NULL AS VARCHAR) AS UQC,
       first_day AS NEWDT, CASE WHEN p_size > 25 THEN first_day END AS SMDT, SOURCE_MONTH
FROM (SELECT SOURCE_MONTH, l_partkey, CAST(min(date_trunc('month', day)) AS DATE) AS first_day
      FROM lines GROUP BY SOURCE_MONTH, l_partkey) m JOIN part ON l_partkey = p_partkey""",
    "purchase": """
SELECT CAST(l_orderkey AS VARCHAR) AS PINVNO, CAST(l_partkey AS VARCHAR) AS MDCODE,
       CAST(l_linenumber AS VARCHAR) AS BAT, CAST(l_shipdate AS DATE) + 365 AS EXP,
       l_quantity AS QTY, CAST(0 AS DOUBLE) AS FQTY, p_retailprice AS PRATE,
       l_extendedprice / l_quantity AS SRATE,
       l_extendedprice / l_quantity * CAST(1.2 AS DOUBLE) AS MRP,
       CAST(CAST(floor(l_tax * 100 + 0.5) AS INTEGER) AS VARCHAR) AS TCODE, l_quantity AS SOH,
       SOURCE_MONTH
FROM lines JOIN part ON l_partkey = p_partkey""",
    "compur": """
SELECT CAST(o_orderkey AS VARCHAR) AS PINVNO, CAST(o_orderdate AS DATE) AS PINVDT,
       CAST(o_orderdate AS DATE) AS TRADT, CAST(o_custkey AS VARCHAR) AS PACODE,
       CAST(supplier_key AS VARCHAR) AS SUPNO, CALVAL, o_totalprice AS INVAMT,
       CAST(0 AS DOUBLE) AS ADDDTL, CAST(0 AS DOUBLE) AS ADDAMT,
       upper(strftime(o_orderdate, '%b-%y')) AS SOURCE_MONTH
FROM orders JOIN (
  SELECT l_orderkey, min(l_suppkey) AS supplier_key,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS CALVAL
  FROM lineitem GROUP BY l_orderkey) h ON o_orderkey = h.l_orderkey""",
    "supmast": """
SELECT CAST(s_suppkey AS VARCHAR) AS SUPNO, s_name AS SUPNAME, ' s' || s_suppkey AS SUPCODE,
       CAST(NULL AS VARCHAR) AS RNAME, 'Region ' || s_nationkey AS RADD1, '' AS RADD2,
       'Depot ' AS RADD3, '' AS RADD4,
       CASE WHEN s_acctbal > 0 THEN CAST(s_suppkey AS VARCHAR) ELSE ' ' END AS RPHON, SOURCE_MONTH
FROM (SELECT DISTINCT SOURCE_MONTH, l_suppkey FROM lines) m JOIN supplier ON l_suppkey = s_suppkey""",
    "sfile": """
SELECT DISTINCT substr(o_orderpriority, 1, 1) AS SCODE, substr(o_orderpriority, 3) AS SNAME,
       upper(strftime(o_orderdate, '%b-%y')) AS SOURCE_MONTH FROM orders""",
    "tfile": """
SELECT DISTINCT CAST(CAST(floor(l_tax * 100 + 0.5) AS INTEGER) AS VARCHAR) AS TCODE,
       floor(l_tax * 100 + 0.5) AS IGST, floor(l_tax * 100 + 0.5) / 2 AS CGST,
       floor(l_tax * 100 + 0.5) / 2 AS SGST, SOURCE_MONTH FROM lines""",
}


def define(name: str, text: str) -> None:
    if name in CTES:
        raise KeyError(name)
    CTES[name] = text


def _used(text: str, known) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text))
    return [n for n in known if n in words]


def sql(body: str) -> str:
    """Prefix a query with the CTEs it uses, each defined once, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _used(CTES[name], CTES):
            if dep != name:
                visit(dep)
        ordered.append(name)

    for name in _used(body, CTES):
        visit(name)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in ordered)
    return f"WITH {parts}\n{body.strip()}"


def rounded(body: str, columns: str) -> str:
    """The query with the named double columns cut to four decimals by plain arithmetic, as the
    Spark side does (built-in rounding differs between engines at ties)."""
    cut = ", ".join(f"floor({c} * 1e4 + {OFFSET}) / 1e4 AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({cut}) FROM (\n{body.strip()}\n) AS q"


def month_start(tag: str) -> str:
    """First day of a month tag, two-digit years from 70 on in the 1900s."""
    yy = f"CAST(substr({tag}, 5, 2) AS INTEGER)"
    mm = f"CAST((instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', substr({tag}, 1, 3)) + 2) / 3 AS INTEGER)"
    return f"make_date(CASE WHEN {yy} >= 70 THEN 1900 ELSE 2000 END + {yy}, {mm}, 1)"
