"""Extensions: relational coverage of the star schema and windows over events."""

from __future__ import annotations

SQL = {
    "revenue_rollup": """SELECT coalesce(l_returnflag, 'all') AS returnflag, coalesce(l_linestatus, 'all') AS linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "nation_orders": """SELECT n_name, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "order_gaps": """SELECT o_orderkey, CAST(datediff(o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS INTEGER) AS gap FROM orders""",
    "event_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}


def _query(name: str, sql: str):
    tables = [t for t in ("lineitem", "customer", "orders", "nation", "events") if f"{t}" in sql]

    def run(spark, sf_dir):
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
        text = sql
        for t in tables:
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {t} ", f"{word} {{{t}}} ")
        return spark.sql(text, **{t: f for t, f in frames.items() if f"{{{t}}}" in text})

    run.__name__ = name
    return run


QUERIES = {k: _query(k, v + " ") for k, v in SQL.items()}
ORACLE_SQL = SQL | {"order_gaps": SQL["order_gaps"].replace("datediff(o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))", "date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)")}
