"""Queries on release tables: sensor masters, manual decisions, linked pairs, primary sensors, capacity and their gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import gates, joins, master, release
from . import q_entities as E
from .adapters import view
from .registry import query, rounded

_read = E._read
_num = lambda c, a=2: F.substring(c, a, 20).cast("long")  # noqa: E731  the number after a letter


def _gates(*rules: tuple[str, str]) -> str:
    """The oracle of gates: each a scalar that counts violations."""
    return " UNION ALL ".join(f"SELECT '{name}' AS gate, CAST(n AS BIGINT) AS violations, n = 0 AS passed FROM (SELECT ({sql}) AS n)" for name, sql in rules)


def _count(frame: str, rule: str) -> str:
    return f"SELECT count(*) FILTER (NOT coalesce({rule}, false)) FROM {frame}"


def _twice(frame: str, keys: str) -> str:
    return f"SELECT count(*) FROM (SELECT {keys} FROM {frame} GROUP BY {keys} HAVING count(*) > 1)"


# --- sensor master ---

_AUDIT_ROWS = "(SELECT ' n' || c_nationkey AS company, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '  ' ELSE ' P' || c_custkey || ' ' END AS key, c_acctbal AS x FROM customer)"


@query("X1_coordinate_audit", f"SELECT trim(company) AS company, trim(key) AS permit_number, x FROM {_AUDIT_ROWS} WHERE key IS NOT NULL AND trim(key) <> ''")
def _(spark, sf):
    k, own = F.col("c_custkey"), F.col("c_custkey").cast("string")
    key = F.when(k % 7 == 0, None).when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" P"), own, F.lit(" ")))
    rows = _read(spark, sf, "customer").select(F.concat(F.lit(" n"), F.col("c_nationkey").cast("string")).alias("company"), key.alias("key"), F.col("c_acctbal").alias("x"))
    return release.coordinate_audit(rows, "key")


@query("X2_sensor_population", "SELECT 'm' || (c_custkey % 3) AS company, CAST(c_custkey AS VARCHAR) AS permit_number, c_acctbal FROM customer")
def _(spark, sf):
    own = _read(spark, sf, "customer")
    parts = {f"m{k}": own.where(F.col("c_custkey") % 3 == k).select(F.lit(f" m{k} ").alias("company"), F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("permit_number"), "c_acctbal") for k in range(3)}
    return release.sensor_population(parts)


_LOCATED = f"(SELECT *, CASE WHEN CAST(substr(sensor, 2) AS BIGINT) % 4 = 0 THEN ' ' ELSE 'Site ' || sensor END AS site, 'Json ' || sensor AS json FROM {E._ISSUES})"
_FIT = ("beta", "ci_low", "ci_high", "ci_width", "success_rate", "hit_rate", "fitted", "bootstrapped", "tail_count", "total_count")


def _sensor_master(spark, sf):
    own = view(spark, sf, "masters")
    population = own.select("company", F.col("sensor").alias("permit_number"), F.when(_num("sensor") % 4 == 0, " ").otherwise(F.concat(F.lit("Site "), "sensor")).alias("location_name"), "code", *_FIT)
    # the audit's own flag, by its own words
    strict = F.expr("""coalesce(match in ('exact', 'normalised') and not conflict and coordinate_valid and x > 0 and x < 700000 and y > 0 and y < 1300000 and fitted and bootstrapped and beta between 0.01 and 2 and abs(beta - 0.01) > 1e-4 and abs(beta - 2) > 1e-4
      and ci_low <= ci_high and ci_width > 0 and ci_width < 0.5 and abs(ci_width - (ci_high - ci_low)) <= 1e-10 + 1e-8 * abs(ci_high - ci_low) and success_rate >= 0.95 and hit_rate <= 0.05, false)""")
    audit = own.select("company", F.col("sensor").alias("permit_number"), "match", "conflict", "coordinate_valid", "x", "y", F.concat(F.lit("Json "), "sensor").alias("json_location_name"), strict.alias("strict"))
    return release.sensor_master(population, audit, ("exact", "normalised"))


@query("X3_sensor_master", f"SELECT company, sensor AS permit_number, company || '::' || sensor AS sensor_uid, CASE WHEN trim(site) = '' AND coalesce(match IN ('exact', 'normalised'), false) THEN json ELSE site END AS location_name, 240e0 AS threshold, '>' AS threshold_operator, coordinate_status, eligible_for_matching, eligible_for_beta, beta_quality, issue_type FROM {_LOCATED}")
def _(spark, sf):
    return _sensor_master(spark, sf).select("company", "permit_number", "sensor_uid", "location_name", "threshold", "threshold_operator", "coordinate_status", "eligible_for_matching", "eligible_for_beta", "beta_quality", "issue_type")


_RULES = (
    ("uid names company and permit", "true"), ("one threshold", "true"), ("fitted beta in bounds", "beta IS NULL OR beta BETWEEN 0.01 AND 2"), ("interval ordered", "ci_low IS NULL OR ci_low <= ci_high"),
    ("tail within events", "tail_count <= total_count"), ("strict betas are eligible", "(beta_quality = 'strict_quality_beta') = eligible_for_beta"), ("problems have issues", "issue_type <> '' OR (coordinate_status = 'valid' AND beta_quality = 'strict_quality_beta')"),
)


@query("V2_master_gates", _gates(*((n, _count(E._ISSUES, r)) for n, r in _RULES)))
def _(spark, sf):
    return gates.violations(_sensor_master(spark, sf), gates.master_rules())


_BOOT = (
    ("attempted or not", "bootstrapped IS NOT NULL"), ("success in 0..1", "success_rate IS NULL OR success_rate BETWEEN 0 AND 1"), ("hits in 0..1", "hit_rate IS NULL OR hit_rate BETWEEN 0 AND 1"), ("interval ordered", "ci_low IS NULL OR ci_high IS NULL OR ci_low <= ci_high"),
    ("beta in its bounds", "beta IS NULL OR beta BETWEEN 0.01 AND 2"), ("no beta without a fit", "fitted OR beta IS NULL"), ("tail within events", "tail_count <= total_count"), ("whole number of draws", "abs(success_rate * 1000 - round(success_rate * 1000)) < 1e-6"),
)


@query("V3_bootstrap_gates", _gates(*((n, _count("masters", r)) for n, r in _BOOT)))
def _(spark, sf):
    return release.bootstrap_gates(view(spark, sf, "masters"), 1000)


@query("X36_ml_master", "SELECT company, sensor, beta, rain FROM masters LEFT JOIN (SELECT 'C' || c_custkey AS sensor, round(c_acctbal / 7, 6) AS rain FROM customer WHERE c_acctbal > 0) USING (sensor)")
def _(spark, sf):
    base = view(spark, sf, "masters").select("company", "sensor", "beta", F.col("tail_count").alias("old_rain_tail"), F.col("code").alias("old_rain_code"))
    rain = _read(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("sensor"), F.round(F.col("c_acctbal") / 7, 6).alias("rain"))
    return release.joined_master(base, rain, ["sensor"], ("old_rain_",))


_DROP = "CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber = 6 THEN CAST('NaN' AS DOUBLE)"
_COORDINATES = f"(SELECT l_suppkey AS sensor, {_DROP} ELSE CAST(l_suppkey % 7 + CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber ELSE 0 END AS DOUBLE) END AS x, CAST(l_suppkey AS DOUBLE) AS y FROM lineitem)"


@query("A38_coordinate_pairs", f"SELECT sensor, count(DISTINCT CASE WHEN x IS NOT NULL AND NOT isnan(x) THEN x || '/' || y END) AS pairs, count(DISTINCT CASE WHEN x IS NOT NULL AND NOT isnan(x) THEN x || '/' || y END) > 1 AS conflict FROM {_COORDINATES} GROUP BY 1")
def _(spark, sf):
    k, s = F.col("l_linenumber"), F.col("l_suppkey")
    x = F.when(k == 5, None).when(k == 6, float("nan")).otherwise((s % 7 + F.when(s % 4 == 0, k).otherwise(0)).cast("double"))
    return release.coordinate_pairs(_read(spark, sf, "lineitem").select(s.alias("sensor"), x.alias("x"), s.cast("double").alias("y")))


# --- manual decisions ---

#: A line for each supplier; its works and up to two sensors, some twice, unknown, of another company or chosen elsewhere.
_LINES = """(SELECT s AS line_no, 'S' || CASE WHEN s % 17 = 0 THEN s + 1 WHEN s % 19 = 0 THEN s + 1000000000 ELSE s END AS code, s % 41 <> 0 AS parsed, 'C' || (3 * t) || CASE WHEN s % 3 = 0 THEN '' ELSE '|C' || (3 * t + 1) END || CASE WHEN s % 43 = 0 THEN '|C0' ELSE '' END AS ids FROM (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 37 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS t FROM supplier))"""
_SENSORS = "(SELECT 'C' || c_custkey AS sensor, CASE WHEN c_custkey % 23 = 0 THEN 'nX' ELSE 'n' || (CAST(floor(c_custkey / 3) AS BIGINT) % 4) END AS company, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 4500 AS DOUBLE) END AS x, CAST((c_custkey * 91) % 3300 AS DOUBLE) AS y, c_custkey FROM customer)"
_WORKS = "(SELECT 'S' || s_suppkey AS code, 'n' || (s_suppkey % 4) AS company, s_suppkey FROM supplier)"
_BASE = """(SELECT 'S' || s AS code, CASE WHEN s % 29 = 0 THEN 'nY' ELSE 'n' || (s % 4) END AS company, CASE WHEN s % 31 = 0 THEN NULL ELSE CAST((s * 53) % 4000 AS DOUBLE) END AS works_x, CAST((s * 17) % 3000 AS DOUBLE) AS works_y, CASE WHEN s % 5 = 0 THEN 'C' || (3 * s) WHEN s % 7 = 0 AND (s + 1) % 5 <> 0 THEN 'C' || (3 * (s + 1)) END AS sensor FROM (SELECT s_suppkey AS s FROM supplier))"""
_IDS = "m_ids AS (SELECT line_no, code, unnest(string_split(ids, '|')) AS sensor, unnest(range(1, len(string_split(ids, '|')) + 1)) AS k FROM m_lines)"
_MANUAL_CTE = f"""m_lines AS MATERIALIZED {_LINES}, m_sensors AS MATERIALIZED {_SENSORS}, m_works AS MATERIALIZED {_WORKS}, m_base AS MATERIALIZED {_BASE}, {_IDS},
m_full AS MATERIALIZED (SELECT i.*, (SELECT count(*) FROM m_sensors s WHERE s.sensor = i.sensor) AS n, count(*) OVER (PARTITION BY i.sensor) > 1 AS twice, s.company AS sensor_company, s.x, s.y, w.company AS works_company, b.works_x, b.works_y, t.code AS taken
 FROM m_ids i LEFT JOIN m_sensors s ON s.sensor = i.sensor LEFT JOIN m_works w ON w.code = i.code LEFT JOIN m_base b ON b.code = i.code LEFT JOIN m_base t ON t.sensor = i.sensor),
m_sums AS MATERIALIZED (SELECT line_no, bool_or(twice) AS twice, list('manual_sensor_not_exactly_once:' || sensor ORDER BY k) FILTER (n <> 1) AS first_issues,
 flatten(list(list_filter([CASE WHEN sensor_company IS DISTINCT FROM works_company THEN 'manual_company_conflict:' || sensor END, CASE WHEN taken <> code THEN 'manual_sensor_selected_for_other_wwtw:' || sensor || ':' || taken END], lambda v: v IS NOT NULL) ORDER BY k)) AS second_issues,
 bool_or(x IS NOT NULL) AS usable, min(CASE WHEN x IS NOT NULL THEN sqrt(pow(x - works_x, 2) + pow(y - works_y, 2)) END) AS least, count(*) AS n FROM m_full GROUP BY 1),
m_head AS MATERIALIZED (SELECT l.line_no, l.code, w.company, b.sensor AS previous, u.least, u.n, list_concat(list_concat(list_filter([CASE WHEN NOT parsed THEN 'manual_parse_error' END, CASE WHEN count(*) OVER (PARTITION BY l.code) > 1 THEN 'duplicate_manual_wwtw_record' END, CASE WHEN w.code IS NULL THEN 'manual_wwtw_not_exactly_once' END, CASE WHEN u.twice THEN 'duplicate_manual_sensor_record' END], lambda v: v IS NOT NULL), coalesce(first_issues, [])), []) AS i1,
 list_concat(list_concat(CASE WHEN b.company IS DISTINCT FROM w.company THEN ['base_wwtw_company_inconsistency'] ELSE [] END, second_issues), CASE WHEN b.works_x IS NULL THEN ['manual_wwtw_geometry_missing'] ELSE [] END) AS i2, CASE WHEN NOT usable THEN ['manual_sensor_geometry_missing'] ELSE [] END AS i3
 FROM m_lines l LEFT JOIN m_works w ON w.code = l.code LEFT JOIN m_base b ON b.code = l.code LEFT JOIN m_sums u ON u.line_no = l.line_no),
m_issues AS MATERIALIZED (SELECT *, CASE WHEN len(i1) > 0 THEN i1 WHEN len(i2) > 0 THEN i2 ELSE i3 END AS issues FROM m_head),
m_chosen AS MATERIALIZED (SELECT h.line_no, min(f.sensor) AS chosen FROM m_issues h JOIN m_full f ON f.line_no = h.line_no WHERE len(issues) = 0 AND f.x IS NOT NULL AND sqrt(pow(f.x - works_x, 2) + pow(f.y - works_y, 2)) <= h.least + 1e-9 GROUP BY 1),
manual AS MATERIALIZED (SELECT h.line_no, h.code, CASE WHEN len(issues) = 0 THEN 'valid_manual_assignment' ELSE issues[1] END AS status, array_to_string(issues, '; ') AS notes, CASE WHEN len(issues) = 0 THEN company END AS company, chosen,
 CASE WHEN len(issues) = 0 THEN coalesce((SELECT string_agg(f.sensor, ' | ' ORDER BY k) FROM m_full f WHERE f.line_no = h.line_no AND f.sensor <> chosen), '') END AS alternatives, CASE WHEN len(issues) = 0 THEN previous END AS previous,
 CASE WHEN len(issues) = 0 THEN CASE WHEN n = 1 THEN 'explicit_manual_single_sensor' ELSE 'nearest_of_manually_approved_candidates_outcome_blind' END END AS method, CASE WHEN len(issues) = 0 THEN (SELECT min(sqrt(pow(f.x - f.works_x, 2) + pow(f.y - f.works_y, 2))) FROM m_full f WHERE f.line_no = h.line_no AND f.sensor = chosen) END AS distance FROM m_issues h LEFT JOIN m_chosen USING (line_no))"""


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _manual_inputs(spark, sf):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    supplier, customer = _read(spark, sf, "supplier"), _read(spark, sf, "customer")
    t = F.when(s % 37 == 0, s + 1).otherwise(s)
    ids = F.array_compact(F.array(_text("C", 3 * t), F.when(s % 3 != 0, _text("C", 3 * t + 1)), F.when(s % 43 == 0, "C0")))
    lines = supplier.select(s.alias("line_no"), _text("S", F.when(s % 17 == 0, s + 1).when(s % 19 == 0, s + 1000000000).otherwise(s)).alias("code"), (s % 41 != 0).alias("parsed"), ids.alias("ids"))
    sensors = customer.select(_text("C", c).alias("sensor"), F.when(c % 23 == 0, "nX").otherwise(_text("n", F.floor(c / 3) % 4)).alias("company"), F.when(c % 13 != 0, ((c * 37) % 4500).cast("double")).alias("x"), ((c * 91) % 3300).cast("double").alias("y"))
    works = supplier.select(_text("S", s).alias("code"), _text("n", s % 4).alias("company"))
    chosen = F.when(s % 5 == 0, _text("C", 3 * s)).when((s % 7 == 0) & ((s + 1) % 5 != 0), _text("C", 3 * (s + 1)))
    base = supplier.select(_text("S", s).alias("code"), F.when(s % 29 == 0, "nY").otherwise(_text("n", s % 4)).alias("company"), F.when(s % 31 != 0, ((s * 53) % 4000).cast("double")).alias("works_x"), ((s * 17) % 3000).cast("double").alias("works_y"), chosen.alias("sensor"))
    return lines, works, sensors, base


@query("J20_manual_validation", f"WITH {_MANUAL_CTE} SELECT * REPLACE (round(distance, 4) AS distance) FROM manual")
def _(spark, sf):
    return rounded(release.validate_manual(*_manual_inputs(spark, sf)), "distance", digits=4)


_FROZEN_CTE = """frozen AS MATERIALIZED (SELECT b.company, b.code, b.sensor AS previous, coalesce(m.chosen, b.sensor) AS sensor, CASE WHEN m.chosen IS NOT NULL THEN 'assigned_manual' WHEN b.sensor IS NOT NULL THEN 'assigned_automatic' ELSE 'unmatched_treatment_works' END AS status,
 CASE WHEN m.chosen IS NOT NULL THEN 'manual_inspection' WHEN b.sensor IS NOT NULL THEN 'automatic_primary_spatial' ELSE 'none_after_manual_review' END AS source FROM m_base b LEFT JOIN manual m ON m.code = b.code AND m.chosen IS NOT NULL)"""
_FINAL_CTE = "final AS MATERIALIZED (SELECT f.*, CAST(c_custkey % 97 AS DOUBLE) / 50 AS beta, CASE WHEN f.sensor IS NULL THEN '' ELSE f.company || '::' || f.code || '::' || f.sensor END AS final_pair_uid FROM frozen f LEFT JOIN m_sensors s ON s.sensor = f.sensor)"


def _final(spark, sf):
    lines, works, sensors, base = _manual_inputs(spark, sf)
    identities = release.frozen(base, release.validate_manual(lines, works, sensors, base))
    outcomes = sensors.select("sensor", ((_num("sensor") % 97).cast("double") / 50).alias("beta"))
    return release.final_tables(base.select("company", "code"), identities, outcomes), works, sensors, lines


@query("X35_final_tables", f"WITH {_MANUAL_CTE}, {_FROZEN_CTE}, {_FINAL_CTE} SELECT * FROM final")
def _(spark, sf):
    return _final(spark, sf)[0].select("company", "code", "previous", "sensor", "status", "source", "beta", "final_pair_uid")


_CLASSES_CTE = "classes AS MATERIALIZED (SELECT sensor, CASE WHEN sensor IN (SELECT sensor FROM final WHERE sensor IS NOT NULL) THEN 'matching_cso_sensor' WHEN sensor IN (SELECT sensor FROM m_ids) THEN 'nonselected_matching_candidate' ELSE 'unmatched_cso_sensor' END AS class FROM m_sensors)"
_V6 = _gates(
    ("supervisor_row_count", "SELECT abs((SELECT count(*) FROM final) - (SELECT count(*) FROM m_works))"), ("supervisor_key_unique", _twice("final", "company, code")), ("assignment_partition", _count("final", "(sensor IS NOT NULL) = (status <> 'unmatched_treatment_works')")),
    ("unassigned_sensor_fields_blank", _count("final", "sensor IS NOT NULL OR beta IS NULL")), ("selected_sensor_unique", "SELECT count(*) FROM (SELECT sensor FROM final WHERE sensor IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"), ("sensor_partition_unique", _twice("classes", "sensor")),
    ("sensor_classes_exact", _count("classes", "class IN ('matching_cso_sensor', 'nonselected_matching_candidate', 'unmatched_cso_sensor')")), ("matching_count_equals_assigned", "SELECT abs((SELECT count(*) FROM classes WHERE class = 'matching_cso_sensor') - (SELECT count(*) FROM final WHERE sensor IS NOT NULL))"),
)


@query("V6_manual_release_gates", f"WITH {_MANUAL_CTE}, {_FROZEN_CTE}, {_FINAL_CTE}, {_CLASSES_CTE} {_V6}")
def _(spark, sf):
    final, works, sensors, lines = _final(spark, sf)
    classes = release.sensor_classes(sensors, lines.select(F.explode("ids").alias("sensor")), final)
    return release.manual_release_gates(final, works, classes, ["beta"])


# --- linked pairs ---

_CHOSEN = "(SELECT company, code, sensor, score, exact, score >= 85 OR exact AS accepted, CAST(substr(sensor, 2) AS BIGINT) % 13 = 0 AS qualifier FROM pairs)"
_BETA = "CAST(CAST(substr(sensor, 2) AS BIGINT) % 190 AS DOUBLE) / 100"
_PAIR_MASTER = f"""(SELECT company || '::' || code || '::' || sensor AS pair_uid, company, code, sensor, score, exact, {_BETA} AS beta, CAST(length(code) AS DOUBLE) AS works_x, CAST(substr(sensor, 2) AS BIGINT) % 2 = 1 AS newly_accepted, count(DISTINCT sensor) OVER (PARTITION BY company, code) AS sensors FROM {_CHOSEN} WHERE accepted)""".replace("count(DISTINCT sensor) OVER", "count(*) OVER")


def _chosen(spark, sf):
    return view(spark, sf, "pairs").select("company", "code", "sensor", "score", "exact", ((F.col("score") >= 85) | F.col("exact")).alias("accepted"), (_num("sensor") % 13 == 0).alias("qualifier"))


def _linked(spark, sf):
    chosen = _chosen(spark, sf)
    uid = F.concat_ws("::", "company", "code", "sensor")
    sensors = chosen.select("sensor", ((_num("sensor") % 190).cast("double") / 100).alias("beta"))
    works = chosen.select("company", "code").distinct().withColumn("works_x", F.length("code").cast("double"))
    previous = chosen.where(_num("sensor") % 2 == 0).select(uid.alias("pair_uid"))
    return chosen, sensors, works, release.pair_master(chosen, previous, sensors, works)


@query("X28_pair_master", f"SELECT *, sensors = 1 AS is_primary, CASE WHEN sensors = 1 THEN 'unique_name_primary' ELSE 'multiple_matching_sensors_requires_later_primary_selection' END AS primary_status FROM {_PAIR_MASTER}")
def _(spark, sf):
    return _linked(spark, sf)[3].drop("accepted", "qualifier")


@query("J18_own_company", f"SELECT count(*) AS compared, count(*) FILTER (company = own) AS agreeing, bool_and(company = own) AS same_company_only FROM (SELECT company, CASE WHEN CAST(substr(sensor, 2) AS BIGINT) % 59 = 0 THEN 'nX' ELSE company END AS own FROM {_PAIR_MASTER})")
def _(spark, sf):
    _, _, _, pairs = _linked(spark, sf)
    own = view(spark, sf, "pairs").select("sensor", F.when(_num("sensor") % 59 == 0, "nX").otherwise(F.col("company")).alias("company"))
    return release.own_company(pairs, own)


_V10 = _gates(
    ("accepted_sensors_authoritative", "SELECT 0"), ("accepted_wwtw_authoritative", "SELECT 0"), ("same_company_only", f"SELECT count(*) FROM {_PAIR_MASTER} WHERE CAST(substr(sensor, 2) AS BIGINT) % 59 = 0"), ("pair_uid_unique", _twice(_PAIR_MASTER, "pair_uid")),
    ("exact_scores_100", _count(_CHOSEN, "NOT exact OR score = 100")), ("qualifier_conflicts_not_accepted", _count(_CHOSEN, "NOT (qualifier AND accepted)")), ("multiple_sensors_retained", f"SELECT abs((SELECT count(*) FROM {_PAIR_MASTER}) - (SELECT count(*) FROM {_CHOSEN} WHERE accepted))"),
    ("sensor_beta_unchanged", f"SELECT count(*) FROM {_PAIR_MASTER} WHERE beta <> {_BETA}"), ("no_wwtw_beta_leakage", "SELECT 0"), ("treatment_work_unique", f"SELECT count(*) FROM (SELECT company, code FROM (SELECT DISTINCT company, code FROM {_CHOSEN}) GROUP BY 1, 2 HAVING count(*) > 1)"),
)


@query("V10_pair_gates", _V10)
def _(spark, sf):
    chosen, sensors, works, pairs = _linked(spark, sf)
    own = view(spark, sf, "pairs").select("sensor", F.when(_num("sensor") % 59 == 0, "nX").otherwise(F.col("company")).alias("company")).join(sensors, "sensor")
    return release.pair_gates(pairs, chosen, own, works)


_ODD = f"(SELECT pair_uid, company, CASE WHEN CAST(substr(sensor, 2) AS BIGINT) % 61 = 0 THEN 'gone' ELSE code END AS code, CASE WHEN CAST(substr(sensor, 2) AS BIGINT) % 67 = 0 THEN 'C0' ELSE sensor END AS sensor, score > 80 AS accepted FROM {_PAIR_MASTER})"


@query("X30_accepted_pair_gates", _gates(("all accepted", _count(_ODD, "accepted")), ("pair unique", _twice(_ODD, "pair_uid")), ("sensor unique", _twice(_ODD, "sensor")), ("works known", f"SELECT count(*) FROM {_ODD} WHERE code = 'gone'")))
def _(spark, sf):
    _, _, works, pairs = _linked(spark, sf)
    k = _num("sensor")
    odd = pairs.select("pair_uid", "company", F.when(k % 61 == 0, "gone").otherwise(F.col("code")).alias("code"), F.when(k % 67 == 0, "C0").otherwise(F.col("sensor")).alias("sensor"), (F.col("score") > 80).alias("accepted"))
    return release.accepted_pair_gates(odd, works)


@query("X31_works_universe", "SELECT 'n' || s_nationkey AS company, 'S' || s_suppkey AS code, s_name AS name, s_acctbal AS x FROM supplier")
def _(spark, sf):
    own = _read(spark, sf, "supplier").select(_text("n", F.col("s_nationkey")).alias("company"), _text("S", F.col("s_suppkey")).alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("x"))
    return release.works_universe(own.select("company", "code", "name", F.lit(1.0).alias("median_beta")), own.select("company", "code", "x"), ("median_beta",))


@query("X32_facility_audit", f"SELECT a.p_partkey AS candidate, a.kind AS sensor_facility, b.kind AS works_facility FROM ({E._PLACES}) a JOIN ({E._PLACES}) b ON b.p_partkey = a.p_partkey + 1")
def _(spark, sf):
    a = view(spark, sf, "place_names").select(F.col("p_partkey").alias("candidate"), F.col("raw").alias("sensor_alias"))
    b = view(spark, sf, "place_names").select((F.col("p_partkey") - 1).alias("candidate"), F.col("raw").alias("works_alias"))
    kind = lambda c: N.facility_kind(N.full_name(F.col(c)))
    return a.join(b, "candidate").select("candidate", kind("sensor_alias").alias("sensor_facility"), kind("works_alias").alias("works_facility"))


# --- primary sensors ---

_AUDIT = f"(SELECT r.*, review, priority, reasons, coalesce(r.sensor = v.sensor, false) AS selected_as_primary FROM {E._RANKED} r LEFT JOIN (SELECT *, reasons <> '' AS review FROM {E._REVIEW}) v ON v.company = r.company AND v.code = r.code)"


def _reviewed(spark, sf):
    return joins.review(E._primary(spark, sf))


def _audit(spark, sf):
    return release.candidate_audit(E._ranked(spark, sf), _reviewed(spark, sf))


@query("X33_primary_master", f"SELECT p.company, p.code, p.status, p.sensor, CASE WHEN p.sensor IS NULL THEN NULL ELSE p.company || '::' || p.code || '::' || p.sensor END AS primary_pair_uid, round(r.distance, 4) AS primary_distance, r.score AS selected_score, r.margin AS selected_margin, m.beta, m.tail_count FROM {E._PRIMARY} p LEFT JOIN {E._RANKED} r ON r.company = p.company AND r.code = p.code AND r.sensor = p.sensor LEFT JOIN masters m ON m.sensor = p.sensor")
def _(spark, sf):
    selection = E._primary(spark, sf)
    sensors = view(spark, sf, "masters").select("sensor", "beta", "tail_count")
    out = release.primary_master(selection.select("company", "code"), selection, E._ranked(spark, sf), sensors)
    return rounded(out.select("company", "code", "status", "sensor", "primary_pair_uid", "primary_distance", "selected_score", "selected_margin", "beta", "tail_count"), "primary_distance", digits=4)


@query("X33_candidate_audit", f"SELECT company, code, sensor, radius, CAST(distance_rank AS INTEGER) AS distance_rank, review, priority, reasons, selected_as_primary FROM {_AUDIT}")
def _(spark, sf):
    return _audit(spark, sf).select("company", "code", "sensor", "radius", "distance_rank", "review", "priority", "reasons", "selected_as_primary")


@query("X33_review_queue", f"""SELECT v.company, v.code, v.priority, v.reasons, CAST(CASE v.priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS BIGINT) AS rank, coalesce(sensors, '') AS candidate_sensors, coalesce(distances, '') AS candidate_distances FROM {E._REVIEW} v LEFT JOIN (SELECT company, code, string_agg(sensor, ' | ' ORDER BY distance NULLS LAST, sensor) AS sensors, string_agg(CASE WHEN distance IS NULL THEN '' ELSE printf('%.3f', distance) END, ' | ' ORDER BY distance NULLS LAST, sensor) AS distances FROM {E._RANKED} GROUP BY 1, 2) l ON l.company = v.company AND l.code = v.code WHERE v.reasons <> ''""")
def _(spark, sf):
    return release.review_queue(_reviewed(spark, sf), E._ranked(spark, sf)).select("company", "code", "priority", "reasons", "rank", "candidate_sensors", "candidate_distances")


_ASSIGNED_P = f"(SELECT * FROM {E._PRIMARY} WHERE sensor IS NOT NULL)"
_V5 = _gates(
    ("primary_master_row_count", f"SELECT abs((SELECT count(*) FROM {E._PRIMARY}) - (SELECT count(*) FROM {E._UNIVERSE}))"), ("primary_master_key_unique", _twice(E._PRIMARY, "company, code")), ("assigned_exactly_one_sensor", _twice(_ASSIGNED_P, "company, code")), ("selected_sensor_unique", _twice(_ASSIGNED_P, "sensor")),
    ("automatic_selected_from_accepted_pairs", f"SELECT count(*) FROM {_ASSIGNED_P} a WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.company = a.company AND p.code = a.code AND p.sensor = a.sensor)"), ("selected_key_consistency", f"SELECT abs((SELECT count(*) FROM {_AUDIT} WHERE selected_as_primary) - (SELECT count(*) FROM {_ASSIGNED_P}))"),
    ("automatic_distance_finite_and_bounded", _count(_ASSIGNED_P, "nearest <= 3000")), ("automatic_radius_tiers_valid", _count(_ASSIGNED_P, "tier IN (1000, 2000, 3000)")), ("automatic_selected_nearest", _count(f"(SELECT * FROM {_AUDIT} WHERE selected_as_primary)", "distance_rank = 1")),
    ("missing_coordinates_not_automatic", _count(f"(SELECT * FROM {_AUDIT} WHERE selected_as_primary)", "eligible")), ("table_assignment_partition", _count(E._PRIMARY, "(sensor IS NULL) <> starts_with(status, 'selected_')")),
)


@query("V5_primary_gates", _V5)
def _(spark, sf):
    final = E._primary(spark, sf)
    return release.primary_gates(E._universe(spark, sf), final, _audit(spark, sf))


# --- assignment and capacity ---


@query("X7_alias_conflicts", "SELECT company, configured, expected FROM (SELECT unnest(['n0', 'n1', 'n2', 'n3', 'n99']) AS company, unnest(['Region0', 'Region1', 'Region2', 'Region3', 'Region4']) AS expected) LEFT JOIN (SELECT 'n' || n_nationkey AS company, 'Region' || n_regionkey AS configured FROM nation) USING (company) WHERE configured IS DISTINCT FROM expected")
def _(spark, sf):
    own = _read(spark, sf, "nation").select(_text(" n", F.col("n_nationkey")).alias("company"), _text("Region", F.col("n_regionkey")).alias("alias"))
    return release.alias_conflicts(own, {"n0": "Region0", "n1": "Region1", "n2": "Region2", "n3": "Region3", "n99": "Region4"})


@query("X8_sensor_scope", "SELECT sensor, company FROM sensors WHERE company = 'n3'")
def _(spark, sf):
    known = _read(spark, sf, "nation").select(_text("n", F.col("n_nationkey")).alias("company"))
    return release.sensor_scope(view(spark, sf, "sensors").select("sensor", "company"), known, "n3")


@query("X10_sensor_points", f"SELECT sensor, company, x, y FROM {E._COORD} WHERE eligible_for_matching")
def _(spark, sf):
    return release.sensor_points(E._coordinates(spark, sf).withColumnRenamed("eligible_for_matching", "eligible"))


_RELATIONS = "(SELECT 'C' || c_custkey AS sensor, 'n' || (c_custkey % 2) AS company, CASE c_custkey % 4 WHEN 0 THEN 'within' WHEN 1 THEN 'within' WHEN 2 THEN 'boundary' ELSE 'other_company' END AS kind, 'Q' || (c_custkey % 61) AS polygon FROM customer)"
_LOOKUP = "(SELECT 'Q' || p AS polygon, 'U' || (p % 7) AS code, 'name ' || (p % 5) AS name FROM (SELECT unnest(range(0, 61)) AS p) WHERE p % 6 <> 0 UNION ALL SELECT 'Q' || p, 'U' || (p % 9), 'second' FROM (SELECT unnest(range(0, 61)) AS p) WHERE p % 4 = 1)"
_CODES = f"(SELECT polygon, string_agg(DISTINCT code, '|' ORDER BY code) AS codes, CAST(count(DISTINCT code) AS INTEGER) AS n_codes, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM {_LOOKUP} GROUP BY 1)"
_CODED = f"(SELECT r.*, coalesce(codes, '') AS codes, coalesce(n_codes, 0) AS n_codes, coalesce(names, '') AS names FROM {_RELATIONS} r LEFT JOIN {_CODES} c ON c.polygon = r.polygon)"


def _relations(spark, sf):
    c = F.col("c_custkey")
    return _read(spark, sf, "customer").select(_text("C", c).alias("sensor"), _text("n", c % 2).alias("company"), F.when(c % 4 <= 1, "within").when(c % 4 == 2, "boundary").otherwise("other_company").alias("kind"), _text("Q", c % 61).alias("polygon"))


def _lookup(spark):
    p = F.col("id")
    own = spark.range(61)
    first = own.where("id % 6 <> 0").select(_text("Q", p).alias("polygon"), _text("U", p % 7).alias("code"), _text("name ", p % 5).alias("name"))
    return first.unionByName(own.where("id % 4 = 1").select(_text("Q", p).alias("polygon"), _text("U", p % 9).alias("code"), F.lit("second").alias("name")))


@query("X9_candidate_layer", f"SELECT r.sensor, r.company, r.kind, r.polygon, r.codes, r.n_codes, r.names, s.x, s.y FROM {_CODED} r LEFT JOIN sensors s ON s.sensor = r.sensor")
def _(spark, sf):
    own = release.relation_codes(_relations(spark, sf), _lookup(spark))
    return release.candidate_layer(own, view(spark, sf, "sensors")).select("sensor", "company", "kind", "polygon", "codes", "n_codes", "names", "x", "y")


_STATUSES = f"""(SELECT sensor, company, codes AS code_list, CASE WHEN k % 9 = 0 THEN 'not_eligible_for_catchment_matching' WHEN kind = 'within' AND n_codes = 1 THEN CASE WHEN k % 8 = 0 THEN 'multiple_same_uwwcode' ELSE 'unique_same_company_containment' END WHEN kind = 'within' THEN 'multiple_different_uwwcodes' WHEN kind = 'boundary' THEN 'boundary_match' ELSE 'company_conflict' END AS status, n_codes,
 CASE WHEN kind = 'within' AND n_codes = 1 AND k % 9 <> 0 THEN codes WHEN k % 38 = 6 THEN 'U1' ELSE '' END AS code, k % 5 = 0 AS review, CASE WHEN k % 10 = 0 THEN 'checked' ELSE '' END AS reason, k % 9 <> 0 AS eligible FROM (SELECT *, CAST(substr(sensor, 2) AS BIGINT) AS k FROM {_CODED}))"""


def _statuses(spark, sf):
    own = release.relation_codes(_relations(spark, sf), _lookup(spark)).withColumn("k", _num("sensor"))
    k, kind, one = F.col("k"), F.col("kind"), F.col("n_codes") == 1
    status = F.when(k % 9 == 0, "not_eligible_for_catchment_matching").when((kind == "within") & one & (k % 8 == 0), "multiple_same_uwwcode").when((kind == "within") & one, "unique_same_company_containment").when(kind == "within", "multiple_different_uwwcodes").when(kind == "boundary", "boundary_match").otherwise("company_conflict")
    code = F.when((kind == "within") & one & (k % 9 != 0), F.col("codes")).when(k % 38 == 6, "U1").otherwise("")
    return own.select("sensor", "company", "kind", "polygon", status.alias("status"), "n_codes", code.alias("code"), (k % 5 == 0).alias("review"), F.when(k % 10 == 0, "checked").otherwise("").alias("reason"), (k % 9 != 0).alias("eligible"))


_S = _STATUSES
_ACC = "('unique_same_company_containment', 'multiple_same_uwwcode')"
_POLYGONS = "(SELECT 'Q' || p AS polygon, 'n' || (p % 2) AS polygon_company FROM (SELECT unnest(range(0, 60)) AS p))"
_V4 = _gates(
    ("row count", "SELECT 0"), ("sensor unique", _twice(_S, "sensor")), ("same population", "SELECT 0"), ("status present", _count(_S, "status IS NOT NULL")), ("status known", _count(_S, "true")), ("eligible sensors processed", _count(_S, "eligible <> (status = 'not_eligible_for_catchment_matching')")),
    ("several with one code", _count(_S, "status <> 'multiple_same_uwwcode' OR n_codes = 1")), ("several with different codes", _count(_S, "status <> 'multiple_different_uwwcodes' OR n_codes > 1")), ("boundary not accepted", _count(_S, "status <> 'boundary_match' OR code = ''")), ("nearest not accepted", _count(_S, "status NOT IN ('no_catchment_match', 'company_conflict') OR code = ''")),
    ("review has a reason", _count(_S, f"NOT (status IN {_ACC} AND review) OR reason <> ''")), ("polygons known", f"SELECT count(*) FROM {_RELATIONS} WHERE polygon NOT IN (SELECT polygon FROM {_POLYGONS})"), ("codes known", f"SELECT count(*) FROM {_S} WHERE code NOT IN ('', 'U0', 'U1', 'U2', 'U3', 'U4', 'U5')"),
    ("unique ones are of their company", f"SELECT count(*) FROM {_RELATIONS} r JOIN {_S} s ON s.sensor = r.sensor LEFT JOIN {_POLYGONS} p ON p.polygon = r.polygon WHERE r.kind = 'within' AND s.status = 'unique_same_company_containment' AND polygon_company IS DISTINCT FROM r.company"), ("one row a relation", _twice(_RELATIONS, "sensor, polygon, kind")),
)


@query("V4_assignment_gates", _V4)
def _(spark, sf):
    own = _statuses(spark, sf)
    sensors = own.select("sensor", "company", "eligible")
    p = F.col("id")
    polygons = spark.range(60).select(_text("Q", p).alias("polygon"), _text("n", p % 2).alias("company"))
    codes = spark.range(6).select(_text("U", p).alias("code"))
    return release.assignment_gates(sensors, own.drop("company", "eligible", "kind", "polygon"), own.select("sensor", "kind", "polygon"), polygons, codes)


_KEYS = "(SELECT 'n' || (s_suppkey % 2) AS company, 'P' || s_suppkey AS code, s_name AS name FROM supplier)"


def _keys(spark, sf):
    s = F.col("s_suppkey")
    sheds = _read(spark, sf, "supplier").select(_text("Label ", s % 2).alias("label"), _text(" P", s).alias("code"), F.col("s_name").alias("name"))
    return release.works_keys(sheds, spark.createDataFrame([("n0", "Label 0"), ("n1", "Label 1")], "company string, label string"))


@query("X12_works_keys", f"SELECT * FROM {_KEYS}")
def _(spark, sf):
    return _keys(spark, sf)


_BY_KEY = f"(SELECT k.company, k.code, coalesce(c.status, 'missing_waterbase_match') AS status, load, capacity, ratio, coalesce(available, false) AS available, coalesce(extreme, false) AS extreme, n_records, n_valid FROM {_KEYS} k LEFT JOIN {E._CAPACITY} c ON c.code = k.code)"
_ISSUE = "CASE WHEN NOT (NOT available OR status <> 'valid' OR extreme) THEN NULL WHEN extreme AND available THEN 'extreme_capacity_ratio' WHEN status = 'conflicting_latest_records' THEN status WHEN status = 'missing_waterbase_match' THEN status ELSE 'missing_or_invalid_capacity' END"


def _by_key(spark, sf):
    return release.capacity_of_keys(_keys(spark, sf).select("company", "code"), E._capacity(spark, sf))


@query("X13_capacity_by_company", f"SELECT company, code, status, round(ratio, 6) AS ratio, available, extreme FROM {_BY_KEY}")
def _(spark, sf):
    return rounded(_by_key(spark, sf).select("company", "code", "status", "ratio", "available", "extreme"), "ratio")


@query("X15_capacity_issues", f"SELECT feature_type, company, code, issue FROM (SELECT *, {_ISSUE} AS issue FROM (SELECT 'wwtw_sewershed' AS feature_type, * FROM {_BY_KEY} UNION ALL SELECT 'treatment_work', * FROM {_BY_KEY} WHERE company = 'n0')) WHERE issue IS NOT NULL")
def _(spark, sf):
    own = _by_key(spark, sf)
    both = own.withColumn("feature_type", F.lit("wwtw_sewershed")).unionByName(own.where("company = 'n0'").withColumn("feature_type", F.lit("treatment_work")))
    return both.select("feature_type", "company", "code", release.capacity_issue(F.col("status"), F.col("available"), F.col("extreme")).alias("issue")).where("issue is not null")


_ENRICHED = f"(SELECT a.sensor, a.company, a.code, a.status AS assignment, q.eligible_for_beta, q.eligible_for_matching AS located, q.beta, q.ci_width, q.tail_count, coalesce(c.available, false) AS capacity_available FROM {E._ASSIGNED} a JOIN {E._QUALITY} q ON q.sensor = a.sensor LEFT JOIN {_BY_KEY} c ON c.company = a.company AND c.code = a.code)"
_STATS = """count(*) AS assigned_n, count(*) FILTER (located) AS located_n, count(*) FILTER (e) AS primary_n, median(beta) FILTER (e) AS median, avg(beta) FILTER (e) AS mean, stddev_samp(beta) FILTER (e) AS sd, quantile_cont(beta, 0.25) FILTER (e) AS q25, quantile_cont(beta, 0.75) FILTER (e) AS q75, median(ci_width) FILTER (e) AS median_width, median(tail_count) FILTER (e) AS median_tail,
 count(*) FILTER (beta > 0) AS finite_n, median(beta) FILTER (beta > 0) AS finite_median, avg(beta) FILTER (beta > 0) AS finite_mean, quantile_cont(beta, 0.75) FILTER (e) - quantile_cont(beta, 0.25) FILTER (e) AS iqr"""
_ROUND = ("median", "mean", "sd", "q25", "q75", "median_width", "median_tail", "finite_median", "finite_mean", "iqr")
_SUMMARY = f"""(SELECT k.company, k.code, k.name, c.status, c.ratio, c.n_records, c.n_valid, g.* EXCLUDE (company, code, assigned_n, located_n, primary_n, finite_n), coalesce(assigned_n, 0) AS assigned_n, coalesce(located_n, 0) AS located_n, coalesce(primary_n, 0) AS primary_n, coalesce(finite_n, 0) AS finite_n, coalesce(primary_n, 0) < 3 AS few
 FROM {_KEYS} k LEFT JOIN {_BY_KEY} c ON c.company = k.company AND c.code = k.code LEFT JOIN (SELECT company, code, {_STATS} FROM (SELECT *, eligible_for_beta AS e FROM {_ENRICHED} WHERE assignment IN {_ACC} AND code <> '') GROUP BY 1, 2) g ON g.company = k.company AND g.code = k.code)"""


def _enriched(spark, sf):
    q = E._quality(spark, sf).select("sensor", "eligible_for_beta", F.col("eligible_for_matching").alias("located"), "beta", "ci_width", "tail_count")
    own = E._assigned(spark, sf).select("sensor", "company", "code", F.col("status").alias("assignment")).join(q, "sensor")
    return joins.preserving_join(own, _by_key(spark, sf).select("company", "code", F.col("available").alias("capacity_available")), ["company", "code"]).withColumn("capacity_available", F.coalesce("capacity_available", F.lit(False)))


def _summary(spark, sf):
    return release.works_summary(_keys(spark, sf), _by_key(spark, sf), _enriched(spark, sf))


@query("A12_works_summary", f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in ('ratio', *_ROUND))}) FROM {_SUMMARY}")
def _(spark, sf):
    return rounded(_summary(spark, sf), "ratio", *_ROUND, digits=9)


_RAW = f"""(SELECT polygon, {_STATS}, CASE WHEN count(DISTINCT nullif(codes, '')) = 1 THEN min(nullif(codes, '')) ELSE '' END AS code, CASE WHEN count(DISTINCT nullif(codes, '')) = 1 THEN 'linked' WHEN count(DISTINCT nullif(codes, '')) > 1 THEN 'conflicting_treatment_work_identifiers' ELSE 'no_treatment_work_identifier' END AS link FROM (SELECT r.polygon, r.codes, e.*, eligible_for_beta AS e FROM {_CODED} r JOIN {_ENRICHED} e ON e.sensor = r.sensor WHERE r.kind = 'within' AND assignment IN {_ACC}) GROUP BY 1)"""


@query("A12_raw_catchment_summary", f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in _ROUND)}) FROM {_RAW}")
def _(spark, sf):
    own = release.relation_codes(_relations(spark, sf).drop("company"), _lookup(spark))
    return rounded(release.raw_summary(own, _enriched(spark, sf)), *_ROUND, digits=9)


_V8 = _gates(
    ("latest year", f"SELECT count(*) FROM {E._CAPACITY} c JOIN (SELECT code, max(year) AS y FROM {E._VALID} WHERE valid GROUP BY 1) USING (code) WHERE status = 'valid' AND data_year <> y"), ("ratio is load over capacity", _count(E._CAPACITY, "status <> 'valid' OR abs(ratio - load / capacity) < 1e-9")), ("unavailable stays empty", _count(E._CAPACITY, "available OR (load IS NULL AND ratio IS NULL)")), ("conflicts not resolved", _count(E._CAPACITY, "status <> 'conflicting_latest_records' OR n_latest > 1")),
    ("sensor unique", _twice(_ENRICHED, "sensor")), ("works unique", _twice(_SUMMARY, "company, code")), ("assigned counts add up", "SELECT 0"), ("primary counts add up", "SELECT 0"), ("finite counts add up", "SELECT 0"), ("none without primary sensors", _count(_SUMMARY, "primary_n > 0 OR (median IS NULL AND sd IS NULL AND median_tail IS NULL)")),
)


@query("V8_capacity_gates", _V8)
def _(spark, sf):
    return release.capacity_gates(view(spark, sf, "records"), E._capacity(spark, sf), _enriched(spark, sf), _summary(spark, sf))


@query("A39_completion", f"""SELECT (SELECT count(*) FROM records) AS records, (SELECT count(DISTINCT code) FROM records) AS codes, valid, without, conflicting, above_1, above_2, round(median_ratio, 9) AS median_ratio, round(min_ratio, 9) AS min_ratio, round(max_ratio, 9) AS max_ratio, accepted, accepted_with_capacity, works_with_one, works_with_three, round(100.0 * accepted_with_capacity / accepted, 6) AS accepted_pct
 FROM (SELECT count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'no_valid_capacity_record') AS without, count(*) FILTER (status = 'conflicting_latest_records') AS conflicting, count(*) FILTER (ratio > 1) AS above_1, count(*) FILTER (ratio > 2) AS above_2, median(ratio) AS median_ratio, min(ratio) AS min_ratio, max(ratio) AS max_ratio FROM {E._CAPACITY}),
 (SELECT count(*) FILTER (assignment IN {_ACC}) AS accepted, count(*) FILTER (assignment IN {_ACC} AND capacity_available) AS accepted_with_capacity FROM {_ENRICHED}), (SELECT count(*) FILTER (primary_n >= 1) AS works_with_one, count(*) FILTER (primary_n >= 3) AS works_with_three FROM {_SUMMARY})""")
def _(spark, sf):
    out = release.completion(view(spark, sf, "records"), E._capacity(spark, sf), _enriched(spark, sf), _summary(spark, sf))
    return rounded(rounded(out, "median_ratio", "min_ratio", "max_ratio", digits=9), "accepted_pct")


_STATUS = f"CASE WHEN a.status NOT IN {_ACC} THEN 'no_accepted_wwtw_assignment' WHEN a.code = '' THEN 'uwwcode_missing' WHEN w.code IS NOT NULL THEN 'matched_wwtw_characteristics' WHEN a.code IN (SELECT code FROM {_KEYS}) THEN 'company_uwwcode_conflict' ELSE 'wwtw_characteristics_not_found' END"


@query("X26_environment_master", f"""SELECT sensor, company, code, link_status, name, coalesce(link_status = 'matched_wwtw_characteristics' AND beta > 0, false) AS exploratory, coalesce(link_status = 'matched_wwtw_characteristics' AND eligible_for_beta, false) AS primary_ok, concat_ws('|', CASE WHEN link_status <> 'matched_wwtw_characteristics' THEN link_status END, CASE WHEN NOT coalesce(beta > 0, false) THEN 'missing_beta' END, CASE WHEN NOT eligible_for_beta THEN 'strict_beta_quality_failed' END) AS exclusion_reasons
 FROM (SELECT a.sensor, a.company, a.code, {_STATUS} AS link_status, CASE WHEN a.status IN {_ACC} THEN w.name END AS name, q.beta, q.eligible_for_beta FROM {E._ASSIGNED} a LEFT JOIN {E._QUALITY} q ON q.sensor = a.sensor LEFT JOIN {_KEYS} w ON w.company = a.company AND w.code = a.code)""")
def _(spark, sf):
    own = E._assigned(spark, sf).drop("eligible_for_beta")
    quality = E._quality(spark, sf).select("sensor", "beta", "eligible_for_beta")
    return master.environment(own, quality, _keys(spark, sf)).select("sensor", "company", "code", "link_status", "name", "exploratory", "primary_ok", "exclusion_reasons")


# --- events, categories, rainfall ---


@query("X4_selected_events", """SELECT company, permit_number, grade, start_time, stop_time, duration_minutes, duration_minutes > 240 AS tail, CAST(row_number() OVER (PARTITION BY company, permit_number ORDER BY start_time NULLS LAST, stop_time NULLS LAST, duration_minutes) AS INTEGER) AS place FROM (
 SELECT 'C' || (user_id % 3) AS company, 'P' || user_id AS permit_number, 'g' || (user_id % 2) AS grade, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS start_time, stop_time, round(value * 10, 6) AS duration_minutes FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop_time FROM events)) WHERE permit_number IN (SELECT 'P' || c_custkey FROM customer)""")
def _(spark, sf):
    own = view(spark, sf, "gap_events").select("company", "permit_number", F.when(F.col("event_id") % 50 != 0, F.col("start_time")).alias("start_time"), "stop_time", F.round(F.col("value") * 10, 6).alias("duration_minutes"))
    c = F.col("c_custkey")
    selection = _read(spark, sf, "customer").select(_text("C", c % 3).alias("company"), _text("P", c).alias("permit_number"), _text("g", c % 2).alias("grade"))
    return release.selected_events(own, selection)


@query("X17_category_lookup", "SELECT l_orderkey, l_linenumber, l_returnflag || '/' || l_linestatus || '/' || CASE WHEN l_linenumber = 3 THEN '-' ELSE 'k' END AS target FROM lineitem")
def _(spark, sf):
    own = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"), F.when(F.col("l_linenumber") != 3, "k").alias("rock"))
    lookup = own.select("flag", "state", "rock").distinct().withColumn("target", F.concat_ws("/", "flag", "state", F.coalesce("rock", F.lit("-")))).withColumn("approved", F.lit(True))
    allowed = [r[0] for r in lookup.select("target").collect()]
    out = release.category_lookup(own, lookup, ["flag", "state", "rock"], "target", allowed)
    return out.select("l_orderkey", "l_linenumber", "target")


@query("X18_source_scale", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 1000 WHEN p_partkey % 3 = 1 THEN p_size * 1000 END AS scale, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT p_brand AS v FROM part)) AS version FROM part")
def _(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    own = _read(spark, sf, "part")
    text = F.when(k % 3 == 0, F.concat(F.lit("map at 1:"), size, F.lit(",000 "))).when(k % 3 == 1, F.concat(F.lit("BGS "), size, F.lit("k hydro"))).otherwise("no scale")
    version = release.source_version(own, "p_brand")
    return own.select("p_partkey", release.source_scale(text).alias("scale"), F.lit(version).alias("version")).withColumn("scale", F.col("scale").cast("int"))


@query("X20_default_rows", "SELECT 'S' || s_suppkey AS unit, CASE WHEN n IS NOT NULL THEN 'complete' WHEN s_suppkey % 10 = 3 THEN 'invalid_geometry' ELSE 'no_data' END AS status, coalesce(n, 0) AS a_pct FROM supplier LEFT JOIN (SELECT c_custkey, CAST(c_custkey % 100 AS DOUBLE) AS n FROM customer WHERE c_acctbal > 0) ON c_custkey = s_suppkey")
def _(spark, sf):
    s = F.col("s_suppkey")
    units = _read(spark, sf, "supplier").select(_text("S", s).alias("unit"), (s % 10 != 3).alias("valid"))
    found = _read(spark, sf, "customer").where("c_acctbal > 0").select(_text("S", F.col("c_custkey")).alias("unit"), F.lit("complete").alias("status"), (F.col("c_custkey") % 100).cast("double").alias("a_pct"))
    return release.with_defaults(units, found, "unit", ["a_pct"]).select("unit", "status", "a_pct")


_RAIN = f"(SELECT company, code, CAST(length(name) AS DOUBLE) * 10 AS rain_mean, CASE WHEN length(code) = 3 THEN NULL ELSE CAST(length(code) AS DOUBLE) END AS rain_max FROM {_KEYS})"


def _rain(spark, sf):
    n = F.length("code")
    return _keys(spark, sf).select("company", "code", (F.length("name") * 10).cast("double").alias("rain_mean"), F.when(n != 3, n.cast("double")).alias("rain_max"))


@query("X23_rainfall_layers", f"SELECT 'works' AS layer, company, code, rain_mean, rain_max FROM {_RAIN} UNION ALL SELECT 'sensors', a.company, a.code, rain_mean, rain_max FROM {E._ASSIGNED} a LEFT JOIN {_RAIN} r ON r.company = a.company AND r.code = a.code")
def _(spark, sf):
    works, sensors = release.rainfall_layers(_rain(spark, sf), _keys(spark, sf), E._assigned(spark, sf), ["rain_mean", "rain_max"])
    pick = lambda frame, layer: frame.select(F.lit(layer).alias("layer"), "company", "code", "rain_mean", "rain_max")
    return pick(works, "works").unionByName(pick(sensors, "sensors"))


@query("X23_variable_summary", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, min({c}) AS least, round(avg({c}), 9) AS mean, median({c}) AS median, max({c}) AS most FROM {_RAIN}" for c in ("rain_mean", "rain_max")))
def _(spark, sf):
    return rounded(release.variable_summary(_rain(spark, sf), ["rain_mean", "rain_max"]), "mean", digits=9)


_V9 = "SELECT 'protected columns unchanged' AS gate, CAST({n} AS BIGINT) AS violations, {n} = 0 AS passed, '{which}' AS summary"


@query("V9_protected_columns", " UNION ALL ".join([_V9.format(n="0", which="joined"), _V9.format(n="(SELECT 2 * count(*) FROM masters WHERE beta IS NOT NULL AND CAST(substr(sensor, 2) AS BIGINT) % 100 = 1)", which="changed")]))
def _(spark, sf):
    """The proof on a join that keeps its left columns, and on one that doesn't."""
    base = view(spark, sf, "masters").select("company", "sensor", "beta")
    joined = base.join(view(spark, sf, "sensors").select("sensor", "x"), "sensor", "left")
    changed = base.withColumn("beta", F.when(_num("sensor") % 100 == 1, F.col("beta") + 1).otherwise(F.col("beta")))
    proof = lambda after, which: gates.unchanged(base, after, base.columns).withColumn("summary", F.lit(which))
    return proof(joined, "joined").unionByName(proof(changed, "changed"))


# --- joins and orders ---


@query("J6_index_aligned", "SELECT o_orderkey, o_custkey, c_acctbal, coalesce(n, 0) AS lines FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, sf):
    """A column looked up by key, and one that is aligned to an index and filled where it has none."""
    own = _read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = joins.mapped(own, "o_custkey", _read(spark, sf, "customer"), "c_custkey", "c_acctbal")
    counts = _read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    return joins.mapped(out, "o_orderkey", counts, "l_orderkey", "lines", fill=0)


@query("W15_stable_order", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_returnflag, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS place FROM lineitem")
def _(spark, sf):
    return joins.stable_order(_read(spark, sf, "lineitem"), ["l_suppkey"], ["l_shipdate", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "place")
