"""The logical tables as DuckDB CTEs over the fixture views.

Same mapping as ``fleetlens/sources/fixtures.py``, written as SQL.
"""

TABLE_CTES = {
    "customers": """
    SELECT c_custkey AS customer_id, c_name AS customer_name FROM customer""",
    "loads": """
    SELECT o_orderkey AS load_id, o_custkey AS customer_id, c_nationkey AS route_id,
           CAST(o_orderdate AS DATE) AS load_date,
           CAST(o_totalprice AS DECIMAL(12,2)) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey""",
    "trips": """
    SELECT l_orderkey * 10 + l_linenumber AS trip_id,
           l_orderkey AS load_id,
           CASE WHEN l_linenumber <> 6 THEN MIN(l_suppkey) END AS driver_id,
           CASE WHEN l_linenumber <> 7 THEN MIN(l_partkey) END AS truck_id,
           CAST(MIN(l_shipdate) AS DATE) AS dispatch_date,
           CAST(SUM(CAST(l_quantity AS DECIMAL(8,2))) AS DECIMAL(12,2)) AS actual_distance_miles,
           CAST(5 + 10 * MAX(CAST(l_discount AS DECIMAL(4,2)))
                  + 10 * MAX(CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(6,2)) AS average_mpg
    FROM lineitem
    GROUP BY l_orderkey, l_linenumber""",
    "delivery_events": """
    SELECT l_partkey AS event_id,
           l_orderkey * 10 + l_linenumber AS trip_id,
           CAST(l_shipdate AS DATE) AS actual_date,
           CASE WHEN l_returnflag = 'R' THEN FALSE
                WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL
                ELSE TRUE END AS on_time_flag
    FROM lineitem""",
    "fuel_purchases": """
    SELECT l_orderkey * 10 + l_linenumber AS trip_id,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS total_cost
    FROM lineitem WHERE l_tax > 0""",
    "maintenance_records": """
    SELECT l_partkey AS truck_id,
           CAST(l_shipdate AS DATE) AS maintenance_date,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS total_cost,
           CAST(l_quantity - 1 AS DECIMAL(8,2)) AS downtime_hours
    FROM lineitem WHERE l_returnflag = 'R'""",
    "safety_incidents": """
    SELECT CASE WHEN l_linenumber <> 6 THEN l_suppkey END AS driver_id,
           CAST(l_shipdate AS DATE) AS incident_date,
           CASE WHEN l_discount <> 0 THEN l_discount >= 0.05 END AS preventable_flag
    FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'""",
    "trucks": """
    SELECT p_partkey AS truck_id FROM part""",
}


def with_tables(body: str) -> str:
    """Prefix a report query with the logical-table CTEs.

    ``body`` is a SELECT or starts with its own WITH; its CTEs are appended
    to the table CTEs.
    """
    ctes = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in TABLE_CTES.items())
    text = body.strip()
    if text[:4].upper() == "WITH":
        return f"WITH {ctes},\n{text[4:].lstrip()}"
    return f"WITH {ctes}\n{text}"
