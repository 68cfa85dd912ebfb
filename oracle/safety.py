"""Oracle SQL: safety incidents."""

from oracle.sqlkit import label, month, rdiv

_P = "CAST(SUM(CASE WHEN preventable_flag = TRUE THEN 1 ELSE 0 END) AS BIGINT)"
_NP = "CAST(SUM(CASE WHEN preventable_flag = FALSE THEN 1 ELSE 0 END) AS BIGINT)"

SQL = {
    "driver_incidents": """
SELECT driver_id, COUNT(*) AS total_incidents
FROM safety_incidents WHERE driver_id IS NOT NULL GROUP BY driver_id
""",
    "driver_preventable_rate": f"""
SELECT driver_id, {_P} AS preventable_incidents, COUNT(*) AS total_incidents,
       {rdiv(_P, 'COUNT(*)', 2, ns=0, ds=0, pct=True)} AS preventable_rate_pct
FROM safety_incidents WHERE driver_id IS NOT NULL GROUP BY driver_id
""",
    "incident_mom": f"""
WITH mi AS (
  SELECT {month('incident_date')} AS m, COUNT(*) AS cur
  FROM safety_incidents GROUP BY {month('incident_date')}
), l AS (SELECT m, cur, LAG(cur) OVER (ORDER BY m ASC NULLS LAST) AS prev FROM mi)
SELECT {label('m')} AS incident_month, prev AS prev_month_incidents, cur AS current_month_incidents,
       cur - prev AS monthly_incident_change
FROM l WHERE prev IS NOT NULL
""",
    "driver_incident_rank": """
SELECT driver_id, COUNT(*) AS total_incidents,
       CAST(DENSE_RANK() OVER (ORDER BY COUNT(*) DESC) AS BIGINT) AS incident_frequency_rank
FROM safety_incidents WHERE driver_id IS NOT NULL GROUP BY driver_id
""",
    "preventable_ratio": f"""
WITH c AS (SELECT {_P} AS p, {_NP} AS np FROM safety_incidents)
SELECT p AS preventable_incidents, np AS non_preventable_incidents,
       {rdiv('p', 'np', 2, ns=0, ds=0)} AS preventable_to_non_preventable_ratio
FROM c
""",
    "driver_incidents_per_100_trips": f"""
WITH d AS (
  SELECT driver_id, COUNT(*) AS total_trips,
    (SELECT COUNT(*) FROM safety_incidents WHERE safety_incidents.driver_id = trips.driver_id) AS total_incidents
  FROM trips WHERE driver_id IS NOT NULL GROUP BY driver_id)
SELECT driver_id, total_incidents, total_trips,
       {rdiv('total_incidents', 'total_trips', 2, ns=0, ds=0, pct=True)} AS incidents_per_100_trips
FROM d
""",
}
