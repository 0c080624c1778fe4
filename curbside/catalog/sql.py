"""The derived tables of the queries as plain SQL, added to a query text as it needs them."""

from __future__ import annotations

import re


def r2(x: str) -> str:
    return f"(floor(({x}) * 100.0 + 0.5) / 100.0)"


def r4(x: str) -> str:
    return f"(floor(({x}) * 10000.0 + 0.500001) / 10000.0)"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000.0 + 0.500001) / 1000000.0)"


def mean_cents(x: str, when: str = "TRUE") -> str:
    cents = f"sum(CAST(round({x} * 100) AS BIGINT)) FILTER (WHERE {when})"
    return f"(floor({cents} / (count({x}) FILTER (WHERE {when})) + 0.5) / 100.0)"


def unit(key: str, seed: int = 42) -> str:
    """Hash of a text key and seed as a number in [0, 1)."""
    return f"(CAST('0x' || substr(md5({key} || ':{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0)"


ACTION = (
    "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
)
MENU = "list_value(1.0::DOUBLE, 1.2::DOUBLE, 1.5::DOUBLE, 1.8::DOUBLE, 2.0::DOUBLE)"
OFF_PEAK = "(day_of_week IN (2, 3) AND request_hour IN (2, 3))"

TABLES: dict[str, str] = {
    "raw": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trip_key,
          c_nationkey + 1 AS PULocationID, s_nationkey + 1 AS DOLocationID,
          o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS request_datetime,
          o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT)
            + INTERVAL '1' SECOND * CAST(60 + l_partkey % 900 AS INT) AS pickup_datetime,
          CASE WHEN l_partkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity END AS trip_miles,
          CAST(l_quantity * 180 AS BIGINT) AS trip_time,
          3 + 2.5 * l_quantity + l_extendedprice / 5000 AS base_passenger_fare,
          l_extendedprice * 3 / 100000 AS bcf, l_extendedprice * l_tax / 1000 AS sales_tax,
          CAST(CASE WHEN l_returnflag = 'A' THEN 2.75 ELSE 0 END AS DOUBLE) AS congestion_surcharge,
          CAST(CASE WHEN l_linestatus = 'O' THEN 1.5 ELSE 0 END AS DOUBLE) AS cbd_congestion_fee,
          l_extendedprice / 2000 AS driver_pay, l_tax * 10 AS tips
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "trips": f"""
        SELECT trip_key, PULocationID, DOLocationID, trip_miles, trip_time,
          CAST((epoch_us(pickup_datetime) - epoch_us(request_datetime)) // 1000000 AS BIGINT) AS waiting_time,
          CAST(request_datetime AS DATE) AS request_date,
          CAST(extract(dow FROM request_datetime) AS INT) AS day_of_week,
          CAST(extract(hour FROM request_datetime) AS INT) AS request_hour,
          {r2('base_passenger_fare + bcf + sales_tax')} AS base_fare,
          congestion_surcharge + cbd_congestion_fee AS congestion_tax,
          {r2('driver_pay + tips')} AS driver_income
        FROM raw""",
    "edges": f"""
        SELECT PULocationID, DOLocationID, {r2('avg(trip_miles)')} AS baseline_distance,
          {r2('avg(trip_time)')} AS baseline_time,
          {r2(f'avg(trip_miles) FILTER (WHERE {OFF_PEAK})')} AS off_peak_distance,
          {mean_cents('base_fare', OFF_PEAK)} AS baseline_fare
        FROM trips GROUP BY 1, 2""",
    "fit": """
        SELECT regr_intercept(baseline_fare, off_peak_distance) AS intercept,
          regr_slope(baseline_fare, off_peak_distance) AS price_per_mile FROM edges""",
    "graph": f"""
        SELECT PULocationID, DOLocationID, baseline_distance, baseline_time,
          coalesce(baseline_fare, {r2('baseline_distance * price_per_mile + intercept')}) AS baseline_fare
        FROM edges, fit""",
    "graph_fit": """
        SELECT regr_intercept(baseline_fare, baseline_distance) AS intercept,
          regr_slope(baseline_fare, baseline_distance) AS price_per_mile FROM graph""",
    "counts": """
        SELECT request_date, day_of_week, request_hour, PULocationID, count(*) AS num_trips
        FROM trips GROUP BY 1, 2, 3, 4""",
    "dates": "SELECT DISTINCT request_date, day_of_week FROM trips",
    "zones": "SELECT DISTINCT PULocationID FROM trips",
    "historical": """
        SELECT z.PULocationID, d.day_of_week, h.request_hour, coalesce(t.trips, 0) / d.n AS historical_poisson
        FROM zones z, (SELECT day_of_week, count(*) AS n FROM dates GROUP BY 1) d,
          (SELECT CAST(range AS INT) AS request_hour FROM range(24)) h
        LEFT JOIN (SELECT PULocationID, day_of_week, request_hour, sum(num_trips) AS trips FROM counts GROUP BY 1, 2, 3) t
          ON t.PULocationID = z.PULocationID AND t.day_of_week = d.day_of_week AND t.request_hour = h.request_hour""",
    "priced": """
        SELECT *, exp(-0.4 * (implied_surge - 1.0)) AS p_accept FROM (
          SELECT *, CASE WHEN baseline_fare > 0 THEN CASE WHEN raw_surge < 1.0 THEN 1.0 ELSE raw_surge END
              ELSE CAST(1.0 AS DOUBLE) END AS implied_surge
          FROM (SELECT t.*, g.baseline_distance, g.baseline_fare,
                  ((t.base_fare - fit.intercept) / t.trip_miles * g.baseline_distance + fit.intercept)
                    / g.baseline_fare AS raw_surge
                FROM trips t LEFT JOIN graph g USING (PULocationID, DOLocationID) CROSS JOIN fit))""",
    "acceptance": """
        SELECT PULocationID, day_of_week, request_hour, avg(p_accept) AS avg_historical_acceptance
        FROM priced GROUP BY 1, 2, 3""",
    "latent": f"""
        SELECT PULocationID, day_of_week, request_hour, historical_poisson,
          {r2('avg_historical_acceptance')} AS avg_historical_acceptance,
          {r2('CASE WHEN avg_historical_acceptance > 0.01 THEN historical_poisson / avg_historical_acceptance ELSE historical_poisson END')} AS latent_poisson
        FROM historical LEFT JOIN acceptance USING (PULocationID, day_of_week, request_hour)""",
    "demand": """
        SELECT z.PULocationID AS zone, CAST(d.range AS INT) AS day, CAST(h.range AS INT) AS hour,
          coalesce(l.latent_poisson, l.historical_poisson, 0) AS demand
        FROM zones z CROSS JOIN range(7) d CROSS JOIN range(24) h
        LEFT JOIN latent l ON l.PULocationID = z.PULocationID AND l.day_of_week = d.range AND l.request_hour = h.range""",
    "dcounts": "SELECT PULocationID, day_of_week, request_hour, DOLocationID, count(*) AS n FROM trips GROUP BY 1, 2, 3, 4",
    "dist": """
        SELECT s.PULocationID, s.day_of_week, s.request_hour, z.DOLocationID,
          (coalesce(c.n, 0) + 10.0::DOUBLE * z.p_zone) / (s.n_slot + 10.0::DOUBLE) AS p
        FROM (SELECT z.PULocationID, CAST(d.range AS INT) AS day_of_week, CAST(h.range AS INT) AS request_hour, coalesce(sum(n), 0) AS n_slot
              FROM zones z CROSS JOIN range(7) d CROSS JOIN range(24) h
              LEFT JOIN dcounts c ON c.PULocationID = z.PULocationID AND c.day_of_week = d.range AND c.request_hour = h.range
              GROUP BY 1, 2, 3) s
        JOIN (SELECT t.PULocationID, a.DOLocationID,
                (coalesce(zd.n, 0) + 10.0::DOUBLE * (a.n_do / g.total)) / (t.n_zone + 10.0::DOUBLE) AS p_zone
              FROM (SELECT PULocationID, sum(n) AS n_zone FROM dcounts GROUP BY 1) t
              CROSS JOIN (SELECT DOLocationID, sum(n) AS n_do FROM dcounts GROUP BY 1) a
              CROSS JOIN (SELECT sum(n) AS total FROM dcounts) g
              LEFT JOIN (SELECT PULocationID, DOLocationID, sum(n) AS n FROM dcounts GROUP BY 1, 2) zd
                ON zd.PULocationID = t.PULocationID AND zd.DOLocationID = a.DOLocationID) z
          ON z.PULocationID = s.PULocationID
        LEFT JOIN dcounts c ON c.PULocationID = s.PULocationID AND c.day_of_week = s.day_of_week
          AND c.request_hour = s.request_hour AND c.DOLocationID = z.DOLocationID""",
    "mapping": """
        SELECT d.DOLocationID AS dropoff, coalesce(z.PULocationID, (SELECT min(PULocationID) FROM zones)) AS target
        FROM (SELECT DISTINCT DOLocationID FROM trips) d LEFT JOIN zones z ON z.PULocationID = d.DOLocationID""",
    "dest_prob": """
        SELECT zone, day, hour, dest, p / sum(p) OVER (PARTITION BY zone, day, hour) AS p FROM (
          SELECT PULocationID AS zone, day_of_week AS day, request_hour AS hour, target AS dest, sum(p) AS p
          FROM dist JOIN mapping ON dropoff = DOLocationID GROUP BY 1, 2, 3, 4)""",
    "cdf": """
        SELECT zone, day, hour, dest,
          sum(p) OVER (PARTITION BY zone, day, hour ORDER BY dest ROWS UNBOUNDED PRECEDING) AS cdf FROM dest_prob""",
    "policy": f"""
        SELECT s.scenario, CAST(p.range AS INT) AS platform, z.PULocationID AS zone, CAST(d.range AS INT) AS day,
          CAST(h.range AS INT) AS hour,
          list_extract({MENU}, CAST(1 + (z.PULocationID * 3 + p.range * 5 + d.range * 7 + h.range + length(s.scenario)) % 5 AS INT)) AS multiplier
        FROM (SELECT DISTINCT c_mktsegment AS scenario FROM customer) s
          CROSS JOIN range(4) p CROSS JOIN zones z CROSS JOIN range(7) d CROSS JOIN range(24) h""",
    "fleet": "SELECT * FROM (VALUES (0, 2900), (1, 700), (2, 700), (3, 700)) f(platform, fleet_size)",
    "inventory": """
        SELECT scenario, platform, zone, day, hour,
          CAST(fleet_size AS DOUBLE) / (SELECT count(*) FROM zones) AS n_taxis
        FROM policy JOIN fleet USING (platform)""",
    "fares": """
        SELECT a.PULocationID AS zone, b.PULocationID AS dest,
          CASE WHEN g.PULocationID IS NOT NULL THEN g.baseline_fare
            ELSE 5.0::DOUBLE * f.price_per_mile + f.intercept END AS fare
        FROM zones a CROSS JOIN zones b CROSS JOIN graph_fit f
        LEFT JOIN graph g ON g.PULocationID = a.PULocationID AND g.DOLocationID = b.PULocationID""",
    "fare_means": """
        SELECT p.zone, p.day, p.hour, sum(p.p * f.fare) AS mean_fare
        FROM dest_prob p JOIN fares f USING (zone, dest) GROUP BY 1, 2, 3""",
    "shares": """
        SELECT scenario, platform, zone, day, hour, accept * (v / total) AS share FROM (
          SELECT *, exp(-0.4 * (multiplier - 1.0)) AS v,
            sum(exp(-0.4 * (multiplier - 1.0))) OVER (PARTITION BY scenario, zone, day, hour) AS total,
            exp(-0.4 * (avg(multiplier) OVER (PARTITION BY scenario, zone, day, hour) - 1.0)) AS accept
          FROM policy)
        UNION ALL
        SELECT scenario, 4, zone, day, hour, 1.0 - exp(-0.4 * (avg(multiplier) - 1.0)) FROM policy GROUP BY 1, 3, 4, 5""",
    "split": "SELECT scenario, platform, zone, day, hour, demand * share AS demand FROM shares JOIN demand USING (zone, day, hour)",
    "matched": """
        SELECT scenario, platform, zone, day, hour, demand, n_taxis, least(demand, n_taxis) AS matched,
          n_taxis - least(demand, n_taxis) AS idle
        FROM inventory JOIN split USING (scenario, platform, zone, day, hour)""",
    "relo": """
        SELECT zone, CASE WHEN hour = 0 THEN (day + 6) % 7 ELSE day END AS day,
          CASE WHEN hour = 0 THEN 23 ELSE hour - 1 END AS hour,
          CASE WHEN total > 0 THEN demand / total ELSE 1.0 / n END AS p
        FROM (SELECT *, sum(demand) OVER (PARTITION BY day, hour) AS total,
                count(*) OVER (PARTITION BY day, hour) AS n FROM demand)""",
    "arrivals": """
        SELECT m.scenario, m.platform, p.dest AS zone, m.day, m.hour, sum(m.matched * p.p) AS arrivals
        FROM matched m JOIN dest_prob p USING (zone, day, hour) WHERE m.matched > 0 GROUP BY 1, 2, 3, 4, 5""",
    "decisions": f"""
        SELECT 'log' AS run, 0 AS agent, user_id AS arm, CAST(extract(day FROM ts) AS INT) AS episode,
          event_id AS step, CAST(event_id * 7 % 10 AS INT) AS state, {ACTION} AS action,
          CAST(0.2 AS DOUBLE) AS prob, value AS reward, CAST(event_id % 20 AS INT) AS n_taxis,
          CAST(lead(event_id * 7 % 10) OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS next_state
        FROM events""",
    "scaled": """
        SELECT *, CASE WHEN n_taxis > 0 THEN greatest(0.0, least(1.0, reward / n_taxis / 100.0)) ELSE 0.0 END AS r
        FROM decisions""",
    "two_action": "SELECT * REPLACE (CASE WHEN action >= 2 THEN 1 ELSE 0 END AS action) FROM decisions",
    "firm_log": f"""
        SELECT CAST(extract(day FROM ts) - 1 AS INT) AS iteration, CAST(user_id % 4 AS INT) AS firm_id,
          CAST(1 + user_id // 4 % 25 AS INT) AS zone, event_id AS step, {ACTION} AS action,
          CAST(0.2 AS DOUBLE) AS prob, value AS reward, CAST(event_id % 20 AS INT) AS n_taxis,
          list_extract({MENU}, 1 + {ACTION}) AS multiplier
        FROM events""",
    "weights": """
        SELECT a.arm, CAST(b.range AS INT) AS action, 0.1 * coalesce(sum(s.r / s.prob), 0) AS log_w
        FROM (SELECT DISTINCT arm FROM decisions) a CROSS JOIN range(5) b
        LEFT JOIN scaled s ON s.arm = a.arm AND s.action = b.range GROUP BY 1, 2""",
    "timeline": """
        SELECT CAST(o_orderkey % 210 AS INT) AS iteration, CAST(o_custkey % 4 AS INT) AS firm_id,
          sum(o_totalprice) AS profit FROM orders GROUP BY 1, 2""",
    "firm_grid": """
        SELECT i.iteration, CAST(f.range AS INT) AS firm_id, coalesce(t.profit, 0) AS value
        FROM (SELECT DISTINCT iteration FROM timeline) i CROSS JOIN range(4) f
        LEFT JOIN timeline t ON t.iteration = i.iteration AND t.firm_id = f.range""",
    "history": """
        SELECT CAST((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) - 1 AS INT) AS Episode,
          CASE WHEN count(*) % 2 = 1 THEN 'missing'
            ELSE CAST(CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS VARCHAR) END AS Revenue
        FROM orders GROUP BY 1""",
}


def _needed(text: str) -> list[str]:
    found: list[str] = []
    for name in TABLES:
        if re.search(rf"(?<![\w.']){name}(?![\w'])", text) and name not in found:
            found.append(name)
    return found


def with_tables(body: str) -> str:
    """Put the derived tables that `body` reads, and those they read, in front of it."""
    order: list[str] = []

    def visit(name: str, path: tuple[str, ...] = ()) -> None:
        if name in order or name in path:
            return
        for dep in _needed(TABLES[name]):
            if dep != name:
                visit(dep, path + (name,))
        order.append(name)

    for name in _needed(body):
        visit(name)
    parts = [f"{name} AS ({TABLES[name]})" for name in order]
    text = body.strip()
    if not parts:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + text[len("WITH RECURSIVE"):].lstrip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + text
