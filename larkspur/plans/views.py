"""Derived inputs: the test tables hold no missing values, scores or censoring, so fixed rules make them.

Each view is one SQL text that both Spark and the SQL twins run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

VIEWS: dict[str, str] = {
    # every seventh event has lost its value
    "v_gap": """SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events""",
    # scored orders: a score with many ties, a noisy outcome, a group and a treatment arm
    "v_scores": """SELECT o_orderkey AS id,
        CAST((o_orderkey * 7919) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) AS score,
        CASE WHEN ((o_orderkey * 7919) % 1009) + ((o_orderkey * 104729) % 1009) > 1009 THEN 1 ELSE 0 END AS y,
        o_orderpriority AS grp, CAST(o_custkey % 2 AS INT) AS treatment, o_totalprice AS amount FROM orders""",
    # regression rows: features, target and a deviating prediction
    "v_reg": """SELECT l.l_orderkey, l.l_linenumber, l.l_quantity AS x1, p.p_retailprice AS x2, l.l_discount AS x3,
        l.l_extendedprice AS y, l.l_extendedprice * (1 + CAST((l.l_orderkey * 31 + l.l_linenumber) % 21 - 10 AS DOUBLE)
        / CAST(100 AS DOUBLE)) AS y_hat, l.l_returnflag AS seg FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    # censored durations
    "v_surv": """SELECT c_custkey AS id, CAST(1 + (c_custkey * 37) % 60 AS INT) AS duration,
        CASE WHEN (c_custkey * 101) % 10 < 3 THEN 1 ELSE 0 END AS event, c_mktsegment AS grp,
        CAST((c_custkey * 53) % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS risk FROM customer""",
    # daily panel per user
    "v_day": """SELECT user_id, CAST(ts AS DATE) AS d, COUNT(*) AS n, SUM(value) AS v FROM events
        GROUP BY user_id, CAST(ts AS DATE)""",
    # failures of assets
    "v_fail": "SELECT user_id AS asset_id, ts AS failure_ts FROM events WHERE event_type = 'error' AND value > 100",
    # labelled texts
    "v_text": """SELECT d.doc_id, d.text, d.lang, d.source, l.quality AS y, l.toxic
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    # neighbour nations
    "v_edge": """SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b
        ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
    # places on a map: customers and suppliers in a 2 x 2 degree area
    "v_place": """SELECT c_custkey AS id, CAST(45 AS DOUBLE) + CAST((c_custkey * 7919) % 2003 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
        CAST(7 AS DOUBLE) + CAST((c_custkey * 104729) % 1997 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon, c_acctbal AS value FROM customer""",
    "v_poi": """SELECT s_suppkey AS poi_id, CAST(45 AS DOUBLE) + CAST((s_suppkey * 15485863) % 2003 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
        CAST(7 AS DOUBLE) + CAST((s_suppkey * 32452843) % 1997 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon FROM supplier""",
}

_BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def with_views(sql: str) -> str:
    """Prefix a SQL twin with the CTEs of the views it mentions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    text = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(head):
            return f"{head}{ctes}, {text[len(head):]}"
    return f"WITH {ctes} {text}"


def view(t, name: str) -> DataFrame:
    """The derived input ``name`` over the tables of ``t``."""
    text = VIEWS[name]
    frames = {}
    for table in _BASE:
        if re.search(rf"\b(FROM|JOIN)\s+{table}\b", text):
            text = re.sub(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}}", text)
            frames[table] = t.read(table)
    return t.spark.sql(text, **frames)
