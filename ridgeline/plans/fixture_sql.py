"""SQL twins of the fixture frames (common table expressions for the oracle)."""

from .fixtures import VALUE_LABEL_ROWS

HH_RAW = """hh_raw AS (
SELECT o.o_orderkey AS hhid,
       o.o_totalprice * (CAST(1.0 AS DOUBLE) + CAST(0.04 AS DOUBLE) * ((o.o_orderkey * 7 + o.o_custkey) % 29))
         * CAST(CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 1.5 ELSE 1.0 END AS DOUBLE)
         * (CAST(1.0 AS DOUBLE) + CAST(0.2 AS DOUBLE) * n.n_regionkey) AS hhincome,
       CAST(l.n_lines AS INT) AS hhsizer,
       CAST(CASE WHEN o.o_orderkey % 89 = 0 THEN -3 ELSE l.n_numbers END AS INT) AS h_dwlrms,
       CAST(CASE WHEN o.o_orderkey % 97 = 0 THEN -8 ELSE 17 + l.max_qty END AS INT) AS head_age,
       CAST((o.o_orderkey * 7 + o.o_custkey) % 29 - 3 AS INT) AS head_educ,
       CAST(CASE WHEN o.o_orderkey % 101 = 0 THEN -5 ELSE CAST(substr(o.o_orderpriority, 1, 1) AS INT) END AS INT) AS h_dwltyp,
       CAST(n.n_regionkey + 1 AS INT) AS hhprov,
       CAST(CASE WHEN o.o_orderkey % 53 = 0 THEN -8 WHEN o.o_orderstatus = 'F' THEN 1 ELSE 2 END AS INT) AS h_owncom,
       CAST(CASE WHEN o.o_orderkey % 59 = 0 THEN -8 WHEN c.c_mktsegment = 'MACHINERY' THEN 1 ELSE 2 END AS INT) AS h_ownwsh,
       CAST(CASE WHEN c.c_acctbal < 0 THEN 2 ELSE 1 END AS INT) AS head_gender,
       concat(n.n_name, ' District Municipality') AS district_label,
       CAST(1 AS INT) AS const_flag
FROM orders o
JOIN (SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_linenumber) AS n_numbers, max(l_quantity) AS max_qty
      FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


VALUE_LABELS = ("value_labels AS (SELECT * FROM (VALUES "
                + ", ".join(f"({_q(v)}, {c}, {_q(lab)})" for v, c, lab in VALUE_LABEL_ROWS)
                + ") AS t(variable, code, label))")

VALUE_LABELS_FULL = ("value_labels_full AS (SELECT variable, code, label FROM value_labels UNION ALL "
                     "SELECT 'district' AS variable, CAST(n_nationkey AS INT) AS code, "
                     "concat(n_name, ' District Municipality') AS label FROM nation)")

HH = """hh AS (
SELECT hhid, ln(CAST(hhincome AS DOUBLE) / hhsizer) AS log_income_pc,
       hhsizer AS members, h_dwlrms AS rooms, head_age, head_educ,
       h_dwltyp AS dwelling, hhprov AS prov, h_owncom AS computer, h_ownwsh AS washer, head_gender
FROM hh_raw
WHERE h_dwltyp NOT IN (-3, -5, -8, -13) AND h_owncom NOT IN (-3, -5, -8, -13)
  AND h_ownwsh NOT IN (-3, -5, -8, -13)
  AND hhsizer >= 1 AND h_dwlrms >= 1 AND head_age >= 1 AND head_educ >= 0
  AND hhincome / hhsizer > 0
)"""

EARN = """earn AS (
SELECT event_id AS pid,
       CAST(16 + user_id % 50 AS INT) AS age,
       CAST((user_id * 3) % 16 AS INT) AS educ,
       event_type AS occupation,
       CAST(user_id % 9 AS INT) AS union_code,
       CAST(day(ts) AS INT) AS wave,
       CAST(hour(ts) AS DOUBLE) AS hours,
       CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE user_id % 20 END AS DOUBLE) AS tenure,
       value AS wages
FROM events
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
