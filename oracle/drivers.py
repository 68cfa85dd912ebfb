"""Oracle SQL: driver performance."""

from oracle.sqlkit import fixed, fixed_round, month, ravg, rdiv

_ON_TIME = "COUNT(CASE WHEN de.on_time_flag THEN 1 END)"
_EVENTS = "COUNT(de.event_id)"

SQL = {
    "driver_on_time": f"""
SELECT tr.driver_id,
       {_EVENTS} AS total_deliveries,
       {_ON_TIME} AS on_time_deliveries,
       {rdiv(_ON_TIME, _EVENTS, 2, ns=0, ds=0, pct=True)} AS on_time_delivery_rate
FROM trips tr JOIN delivery_events de ON de.trip_id = tr.trip_id
GROUP BY tr.driver_id
""",
    "driver_mpg": f"""
SELECT driver_id, COUNT(trip_id) AS total_trips, {ravg('average_mpg', 2)} AS avg_driver_mpg
FROM trips GROUP BY driver_id
""",
    "driver_revenue_per_mile": f"""
SELECT tr.driver_id,
       CAST(SUM(tr.actual_distance_miles) AS DOUBLE) AS total_distance,
       CAST(SUM(lo.revenue) AS DOUBLE) AS total_revenue,
       {rdiv('SUM(lo.revenue)', 'SUM(tr.actual_distance_miles)', 2)} AS revenue_per_mile
FROM trips tr JOIN loads lo ON lo.load_id = tr.load_id
GROUP BY tr.driver_id
""",
    "driver_monthly_on_time_rank": f"""
WITH per_month AS (
  SELECT tr.driver_id, {month('de.actual_date')} AS month,
         {_EVENTS} AS total_deliveries, {_ON_TIME} AS on_time_deliveries,
         {rdiv(_ON_TIME, _EVENTS, 2, ns=0, ds=0, pct=True)} AS on_time_delivery_rate
  FROM trips tr JOIN delivery_events de ON de.trip_id = tr.trip_id
  GROUP BY tr.driver_id, {month('de.actual_date')}
)
SELECT *, CAST(DENSE_RANK() OVER (PARTITION BY month ORDER BY on_time_delivery_rate DESC NULLS FIRST) AS BIGINT) AS monthly_rank
FROM per_month
""",
    "driver_top_decile": f"""
WITH d AS (
  SELECT tr.driver_id,
         CAST(SUM(tr.actual_distance_miles) AS DOUBLE) AS total_distance_miles,
         CAST(SUM(lo.revenue) AS DOUBLE) AS total_revenue,
         {rdiv('SUM(lo.revenue)', 'SUM(tr.actual_distance_miles)', 2)} AS revenue_per_mile
  FROM trips tr JOIN loads lo ON lo.load_id = tr.load_id
  GROUP BY tr.driver_id
), b AS (
  SELECT *, CAST(NTILE(10) OVER (ORDER BY revenue_per_mile DESC NULLS FIRST, driver_id ASC NULLS LAST) AS BIGINT) AS revenue_bucket
  FROM d
)
SELECT * FROM b WHERE revenue_bucket = 1
""",
    "driver_mpg_vs_fleet": f"""
WITH d AS (SELECT driver_id, SUM(average_mpg) AS s, COUNT(average_mpg) AS n FROM trips GROUP BY driver_id),
     f AS (SELECT SUM(average_mpg) AS fs, COUNT(average_mpg) AS fn FROM trips)
SELECT driver_id,
       {rdiv('s', 'n', 2, ds=0)} AS driver_avg_mpg,
       {rdiv('fs', 'fn', 2, ds=0)} AS fleet_avg_mpg,
       {fixed_round(f"{fixed('s', 'n')} - {fixed('fs', 'fn')}", 2)} AS mpg_difference
FROM d CROSS JOIN f
""",
    "driver_revenue_mom": f"""
WITH m AS (
  SELECT tr.driver_id, {month('tr.dispatch_date')} AS month, SUM(lo.revenue) AS monthly_revenue
  FROM trips tr JOIN loads lo ON lo.load_id = tr.load_id
  GROUP BY tr.driver_id, {month('tr.dispatch_date')}
)
SELECT driver_id, month,
       CAST(monthly_revenue AS DOUBLE) AS monthly_revenue,
       CAST(LAG(monthly_revenue) OVER w AS DOUBLE) AS previous_month_revenue,
       CAST(monthly_revenue - LAG(monthly_revenue) OVER w AS DOUBLE) AS revenue_trend
FROM m
WINDOW w AS (PARTITION BY driver_id ORDER BY month ASC NULLS LAST)
""",
    "driver_best_mpg_latest_month": f"""
WITH m AS (
  SELECT driver_id, {month('dispatch_date')} AS month, {ravg('average_mpg', 2)} AS avg_mpg
  FROM trips GROUP BY driver_id, {month('dispatch_date')}
)
SELECT driver_id, month, avg_mpg FROM m
WHERE month = (SELECT MAX(month) FROM m)
ORDER BY avg_mpg DESC NULLS FIRST, driver_id ASC NULLS LAST
LIMIT 1
""",
}
