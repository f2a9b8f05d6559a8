"""DuckDB text of the shared fixture views (FIXTURES.md), inlined as CTEs in every
oracle query so both engines read exactly the same derived inputs."""

from __future__ import annotations

FIXTURE_CTES = {
    "rates": """rates AS (
  SELECT user_id AS currency, CAST(ts AS DATE) AS exchange_date, value AS exchange_rate
  FROM events WHERE event_type = 'purchase')""",
    "transactions": """transactions AS (
  SELECT DISTINCT user_id AS currency, CAST(ts AS DATE) AS trans_date
  FROM events WHERE event_type = 'click')""",
    "daily": """daily AS (
  SELECT currency, exchange_date, avg(exchange_rate) AS exchange_rate,
         CAST(count(*) AS BIGINT) AS num_observations
  FROM rates GROUP BY currency, exchange_date)""",
    "supplier_series": """supplier_series AS (
  SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS d, l_discount AS rate FROM lineitem)""",
    "trades": """trades AS (
  SELECT l_orderkey, l_linenumber,
         c_name AS client,
         l_linestatus AS leg_type,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE p_type END AS product_name,
         CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE upper(p_type) END AS product_group,
         n_name AS currency, n_regionkey AS office, o_orderpriority AS risk, o_orderstatus AS source_system,
         CAST(l_shipdate AS DATE) AS d,
         strftime(l_shipdate, '%d/%m/%Y') AS trade_date,
         l_extendedprice AS notional, 1 - l_discount AS fx_rate,
         CASE WHEN l_orderkey % 211 = 0 THEN 0.0 ELSE l_extendedprice * (1 - l_discount) END AS gbp,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount >= 0.09 THEN 1 ELSE 0 END AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = l_partkey)""",
}

# views other views are built from
_DEPENDS = {"daily": ["rates"]}


def with_fixtures(sql: str, *views: str) -> str:
    """Prefix ``sql`` (which may start with its own ``WITH`` list) with fixture CTEs."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in _DEPENDS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    ctes = ",\n".join(FIXTURE_CTES[v] for v in order)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
