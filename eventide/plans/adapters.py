"""Views that give the driver's tables the shape of event logs, sensors, works and records.

The texts are plain SQL that Spark and the oracle read alike; the operators under test come after them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "gap_events": "SELECT 'C' || (user_id % 3) AS company, 'P' || user_id AS permit_number, 'Site ' || (event_id % 4) AS location_name, ts AS start_time, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop_time, event_id, event_type, value FROM events",
    "ship_events": "SELECT ' ' || l_returnflag || ' ' AS company, CAST(l_suppkey AS VARCHAR(20)) AS permit_number, 'L' || l_linenumber AS location_name, o_orderdate AS start_time, l_shipdate AS stop_time, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "provided": "SELECT 'file' || (l_orderkey % 5) AS source_file, CASE WHEN l_linenumber = 7 THEN ' ' ELSE CAST(l_suppkey AS VARCHAR(20)) END AS permit_number, CAST(l_shipdate AS VARCHAR(40)) AS start_time, CASE WHEN l_orderkey % 11 = 0 THEN 'soon' ELSE CAST(l_shipdate AS VARCHAR(40)) END AS stop_time, CASE WHEN l_orderkey % 13 = 0 THEN 'abc' WHEN l_orderkey % 17 = 0 THEN 'Infinity' WHEN l_linenumber = 6 THEN '-1' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END AS duration_minutes FROM lineitem",
    "sensors": "SELECT 'C' || c_custkey AS sensor, 'n' || c_nationkey AS company, CAST((c_custkey * 7919) % 700000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1300000 AS DOUBLE) AS y, c_custkey FROM customer",
    "works": "SELECT 'S' || s_suppkey AS works, 'n' || s_nationkey AS company, CAST((s_suppkey * 7919) % 700000 AS DOUBLE) AS works_x, CAST((s_suppkey * 104729) % 1300000 AS DOUBLE) AS works_y, s_suppkey FROM supplier",
    "pairs": "SELECT 'n' || (c_custkey % 4) AS company, 'W' || (c_custkey % 211) AS code, 'C' || c_custkey AS sensor, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 4500 AS DOUBLE) END AS x, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS works_x, CAST((c_custkey * 13) % 900 AS DOUBLE) AS works_y, CAST((c_custkey * 37) % 4500 AS DOUBLE) AS audited, c_custkey % 3 = 0 AS exact, CAST(80 + c_custkey % 21 AS DOUBLE) AS score, CAST(c_custkey % 9 AS DOUBLE) AS margin FROM customer",
    "days": "SELECT 'u' || (user_id % 20) AS place, CAST(ts AS DATE) AS date, round(sum(value) / 20, 4) AS mm, count(*) % 5 <> 0 AS complete FROM events GROUP BY 'u' || (user_id % 20), CAST(ts AS DATE)",
    "records": "SELECT 'P' || (l_partkey % 300) AS code, 'name ' || l_returnflag AS name, CAST(year(l_shipdate) AS DOUBLE) AS year, CAST(CASE WHEN l_linenumber = 7 THEN -1 ELSE l_quantity END AS DOUBLE) AS load, CAST(CASE WHEN l_linenumber >= 5 THEN 0 ELSE CAST(floor(l_extendedprice / 5000) AS INT) END AS DOUBLE) AS capacity FROM lineitem",
    "masters": "SELECT 'n' || c_nationkey AS company, 'C' || c_custkey AS sensor, 'W' || (c_custkey % 97) AS code, CASE c_custkey % 5 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'exact' WHEN 2 THEN 'normalised' WHEN 3 THEN NULL ELSE 'exact' END AS match, c_custkey % 23 = 0 AS conflict, c_custkey % 19 <> 0 AS coordinate_valid, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST((c_custkey * 7919) % 720000 AS DOUBLE) END AS x, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST((c_custkey * 104729) % 1300000 AS DOUBLE) END AS y, CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 2e0 ELSE (c_custkey % 190) / 1e2 END AS beta, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE (c_custkey % 190) / 1e2 - 1e-1 END AS ci_low, (c_custkey % 190) / 1e2 + (c_custkey % 6) / 1e1 AS ci_high, (c_custkey % 6) / 1e1 + CASE WHEN c_custkey % 37 = 0 THEN 3e-1 ELSE 1e-1 END AS ci_width, 1e0 - (c_custkey % 8) / 1e2 AS success_rate, (c_custkey % 9) / 1e2 AS hit_rate, c_custkey % 41 <> 0 AS fitted, c_custkey % 43 <> 0 AS bootstrapped, c_custkey % 60 AS tail_count, c_custkey % 60 + c_custkey % 100 AS total_count FROM customer",
    "measures": "SELECT 'n' || (c_custkey % 5) AS company, 'C' || c_custkey AS sensor, c_custkey, CAST(c_acctbal AS DOUBLE) AS bal, CAST(c_custkey % 101 AS DOUBLE) AS x1, CAST((c_custkey * 31) % 89 AS DOUBLE) AS x2, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST((c_custkey * 17) % 53 AS DOUBLE) END AS x3, 1e0 + (c_custkey * 7) % 31 / 1e1 + (c_custkey % 101) / 5e1 AS outcome FROM customer",
    "place_names": "SELECT p_partkey, p_name, CASE p_partkey % 9 WHEN 0 THEN upper(p_name) || ' SEWAGE TREATMENT WORKS' WHEN 1 THEN p_name || '  STW' WHEN 2 THEN 'North ' || p_name || ' (CSO)' WHEN 3 THEN p_name || ' Storm Tank - STORM' WHEN 4 THEN 'South ' || p_name || ' No 2 Pumping Station' WHEN 5 THEN p_name || ' Emergency Overflow, PS' WHEN 6 THEN p_name || ' outfall' WHEN 7 THEN 'STORM STORM' ELSE p_name END AS raw FROM part",
    "squares": "SELECT 'Q' || s_suppkey AS polygon, 'n' || s_nationkey AS company, CAST((s_suppkey * 7919) % 700000 AS DOUBLE) AS x0, CAST((s_suppkey * 104729) % 1300000 AS DOUBLE) AS y0, CAST(60000 + (s_suppkey % 7) * 20000 AS DOUBLE) AS side FROM supplier",
    "predictions": "SELECT 'm' || (l_linenumber % 4) AS model, CAST(l_quantity AS DOUBLE) AS y, CAST(l_quantity * 6e-1 + (l_partkey % 23) AS DOUBLE) AS predicted, 25e0 AS base FROM lineitem",
    "hours": "SELECT 'u' || (l_suppkey % 6) AS place, CAST(l_shipdate AS DATE) AS date, CAST(l_partkey % 24 AS INT) AS hour, CAST(avg(l_quantity) AS DOUBLE) AS mm, 12 - CASE WHEN min(l_orderkey) % 90 = 0 THEN 1 ELSE 0 END AS samples, 12 AS source_samples FROM lineitem GROUP BY 'u' || (l_suppkey % 6), CAST(l_shipdate AS DATE), CAST(l_partkey % 24 AS INT)",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; columns that aren't used are pruned down to the scan."""
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", text), **used)


def oracle(text: str) -> str:
    """The oracle's text with the views that it names put before it."""
    own = [f"{n} AS ({sql})" for n, sql in VIEWS.items() if re.search(rf"\b{n}\b", text)]
    if not own:
        return text
    if re.match(r"\s*WITH\s", text):
        return "WITH " + ", ".join(own) + ", " + re.sub(r"^\s*WITH\s", "", text, count=1)
    return "WITH " + ", ".join(own) + " " + text
