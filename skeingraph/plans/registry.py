"""Named queries with the SQL that states their result, over shared definitions of the graph."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import BY_KEY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _keyed(key: str) -> str:
    return ", ".join(f"{sql.format(k=key)} AS {name}" for name, sql in BY_KEY.items())


#: The graph of ``sources.tables`` in DuckDB's SQL.
DEFINITIONS = {
    "tasks": f"SELECT 'T' || c_custkey AS id, 'TASK' AS type, c_name AS name, c_mktsegment AS description, concat_ws(' ', c_name, c_mktsegment) AS content, {_keyed('c_custkey')}, updated_at FROM customer LEFT JOIN (SELECT o_custkey, max((epoch_us(o_orderdate) // 1000)) AS updated_at FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "skills": f"SELECT 'S' || p_partkey AS id, 'SKILL' AS type, p_name AS name, concat_ws(' ', p_brand, p_type) AS description, concat_ws(' ', p_name, p_brand, p_type) AS content, {_keyed('p_partkey')}, updated_at FROM part LEFT JOIN (SELECT l_partkey, max((epoch_us(l_shipdate) // 1000)) AS updated_at FROM lineitem GROUP BY 1) ON p_partkey = l_partkey",
    "event_nodes": f"SELECT 'E' || event_id AS id, 'EVENT' AS type, event_type || '-' || user_id AS name, event_type AS description, props AS content, {_keyed('event_id')}, (epoch_us(ts) // 1000) AS updated_at FROM events",
    "nodes": "SELECT * FROM tasks UNION ALL SELECT * FROM skills UNION ALL SELECT * FROM event_nodes",
    "errors": "SELECT * FROM events WHERE event_type = 'error'",
    "edges": """
        SELECT 'T' || o_custkey AS from_id, 'S' || l_partkey AS to_id, 'USED_SKILL' AS type, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
        UNION ALL SELECT 'E' || event_id, 'S' || (event_id % (SELECT count(*) FROM part)), 'SOLVED_BY', 1.0::DOUBLE FROM errors
        UNION ALL SELECT 'E' || event_id, 'E' || prev, 'CAUSED_BY', (event_id % 10) / 10::DOUBLE + 0.1::DOUBLE FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM errors) WHERE prev IS NOT NULL
        UNION ALL SELECT 'T' || c_custkey, 'E' || event_id, 'LEADS_TO', (event_id % 7) / 7::DOUBLE + 0.1::DOUBLE FROM events JOIN customer ON user_id = c_custkey
        UNION ALL SELECT 'S' || p_partkey, 'S' || nxt, 'PATCHES', 1.0::DOUBLE FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part) WHERE nxt IS NOT NULL
        UNION ALL SELECT 'S' || a.p_partkey, 'S' || b.p_partkey, 'CONFLICTS_WITH', 1.0::DOUBLE FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""",
    "structural": "SELECT from_id, to_id, CASE WHEN type = 'PATCHES' AND from_id LIKE '%3' THEN 'NEXT_SESSION' WHEN type = 'CONFLICTS_WITH' AND to_id LIKE '%7' THEN 'CONTAINS' WHEN type = 'SOLVED_BY' AND to_id LIKE '%1' THEN 'MENTIONS' ELSE type END AS type, weight FROM edges",
    "both_ways": "SELECT from_id AS a, to_id AS b FROM edges UNION ALL SELECT to_id, from_id FROM edges",
    "messages": "SELECT 'm' || conv_id || '-' || turn AS id, conv_id::VARCHAR AS session_key, turn, role, text AS content FROM conversations",
    "mentions": "SELECT DISTINCT 'O' || l_orderkey AS msg_id, 'S' || l_partkey AS node_id FROM lineitem",
    "judged": "SELECT 'f' || user_id || '-' || ((epoch_us(ts) // 1000) // 86400000) AS feedback_id, 'S' || (event_id % 50) AS node_id, max(CASE WHEN event_type = 'purchase' THEN 'used' ELSE 'unused' END) AS verdict, max((epoch_us(ts) // 1000)) AS ts FROM events GROUP BY 1, 2",
}


def graph_sql(body: str, extra: dict[str, str] | None = None, materialise: bool = True) -> str:
    """``body`` after the definitions that it names, directly or not."""
    known = DEFINITIONS | (extra or {})
    wanted: list[str] = []

    def want(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in wanted and text is not known[name]:
                want(known[name])
                if name not in wanted:
                    wanted.append(name)

    want(body)
    kind = "MATERIALIZED " if materialise else ""
    return "WITH " + ", ".join(f"{n} AS {kind}({known[n]})" for n in wanted) + " " + body if wanted else body


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None, materialise: bool = True):
    """Registers a function (spark, sf_dir) under ``name``, with DuckDB SQL over the graph's definitions."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = graph_sql(sql, extra, materialise)
        return function

    return register
