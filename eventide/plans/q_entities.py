"""Queries on entities: parsing, masters, joins, rankings, names, decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalars as S

from ..operators import gates, joins, master
from ..sources import files
from .adapters import view
from .registry import query, rounded


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("C8_number_coercion", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS x FROM part")
def _(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", S.number(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))).alias("x"))


_BOOL = "(SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'True ' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'yes' WHEN 5 THEN 'T' WHEN 6 THEN 'maybe' WHEN 7 THEN NULL ELSE '1.0' END AS v FROM part)"


@query("C9_boolean_parsers", f"""SELECT p_partkey, coalesce(lower(trim(v)) IN ('true', '1'), false) AS lenient, CASE WHEN lower(trim(v)) IN ('true', '1') THEN true WHEN lower(trim(v)) IN ('false', '0') THEN false END AS strict, coalesce(upper(trim(v)) IN ('TRUE', 'T', 'YES', 'Y', '1'), false) AS wordy,
  coalesce(TRY_CAST(trim(v) AS DOUBLE) = 1, false) OR coalesce(lower(trim(v)) IN ('true', 'yes'), false) AS numeric FROM {_BOOL}""")
def _(spark, sf):
    k = F.col("p_partkey") % 9
    v = F.when(k == 0, "True ").when(k == 1, "FALSE").when(k == 2, "1").when(k == 3, "0").when(k == 4, "yes").when(k == 5, "T").when(k == 6, "maybe").when(k == 8, "1.0")
    return _read(spark, sf, "part").select("p_partkey", S.lenient_bool(v).alias("lenient"), S.strict_bool(v).alias("strict"), S.wordy_bool(v).alias("wordy"), S.numeric_bool(v).alias("numeric"))


@query("C10_C11_C12_text_keys", r"SELECT DISTINCT raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS squeezed, upper(regexp_replace(raw, '\s+', '', 'g')) AS permit, regexp_replace(upper(regexp_replace(raw, '\s+', '', 'g')), '[^A-Z0-9]', '', 'g') AS letters FROM place_names")
def _(spark, sf):
    raw = F.col("raw")
    return view(spark, sf, "place_names").select("raw", S.squeeze(raw).alias("squeezed"), S.permit_key(raw).alias("permit"), S.permit_letters(raw).alias("letters")).distinct()


_FULL = r"trim(regexp_replace(upper(trim(regexp_replace(raw, '\s+', ' ', 'g'))), '[^0-9A-Z]+', ' ', 'g'))"


def _sql_phrases(phrases) -> str:
    return "|".join(sorted(set(phrases), key=lambda p: (-len(p.split()), p)))


def _sql_core(full: str) -> str:
    alternatives = _sql_phrases(N.TREATMENT + N.OVERFLOW + N.PUMPING)
    # a word's end is looked at without eating it: spaces are doubled first, so neighbours don't share one
    gone = rf"regexp_replace(' ' || replace({full}, ' ', '  ') || ' ', ' (?:{alternatives.replace(' ', '  ')}) ', ' ', 'g')"
    return rf"trim(regexp_replace(trim(regexp_replace({gone}, ' +', ' ', 'g')), '(?:(?:^| )STORM)+$', ''))"


def _sql_has(full: str, *phrases: str) -> str:
    return f"regexp_matches({full}, '(^| )({_sql_phrases(phrases)})( |$)')"


_KIND = f"""CASE WHEN {_sql_has('f', 'EMERGENCY OVERFLOW', 'EMO', 'EO')} THEN 'EMERGENCY OVERFLOW' WHEN {_sql_has('f', 'FINAL EFFLUENT', 'F E', 'FINAL DISCHARGE')} THEN 'FINAL EFFLUENT' WHEN {_sql_has('f', 'STORM TANK')} THEN 'STORM TANK' WHEN {_sql_has('f', 'OUTFALL')} THEN 'OUTFALL'
 WHEN {_sql_has('f', 'OUTLET')} THEN 'OUTLET' WHEN {_sql_has('f', *N.OVERFLOW)} THEN 'STORM OVERFLOW' WHEN {_sql_has('f', *N.PUMPING)} THEN 'PUMPING STATION' WHEN {_sql_has('f', *N.TREATMENT)} THEN 'TREATMENT WORKS' ELSE '' END"""
_PLACES = f"SELECT p_partkey, raw, f, {_KIND} AS kind, {_sql_core('f')} AS core FROM (SELECT p_partkey, raw, {_FULL} AS f FROM place_names)"


def _places(spark, sf, tasks=None, by=None):
    """Names with their normal form, kind and core; dealt over tasks by a column first, if both are given."""
    own = view(spark, sf, "place_names")
    own = (own.repartition(tasks, by) if tasks else own).withColumn("f", N.full_name(F.col("raw")))
    return own.select("p_partkey", "raw", "f", N.facility_kind(F.col("f")).alias("kind"), N.place_core(F.col("f")).alias("core"))


@query("C13_C14_C15_C16_place_names", _PLACES)
def _(spark, sf):
    return _places(spark, sf)


@query("X27_compatible_assets", f"SELECT kind, count(*) AS n, kind IN ({', '.join(repr(k) for k in N.COMPATIBLE)}) AS compatible FROM ({_PLACES}) GROUP BY 1")
def _(spark, sf):
    return _places(spark, sf).groupBy("kind").agg(F.count("*").alias("n")).withColumn("compatible", N.compatible(F.col("kind")))


#: Companies of fifty names, whatever the table's size; within one all pairs of names are compared.
_COMPANY = "CAST(floor(p_partkey / 50) AS BIGINT)"
_CORES = f"(SELECT DISTINCT {_COMPANY} AS company, core FROM ({_PLACES}) WHERE core <> '')"
_PAIRS = f"(SELECT a.company, a.core AS l, b.core AS r, list_filter(string_split(a.core, ' '), lambda t: t <> '') AS x, list_filter(string_split(b.core, ' '), lambda t: t <> '') AS y FROM {_CORES} a JOIN {_CORES} b ON a.company = b.company AND a.core < b.core)"


def _sql_differ(x: str, y: str) -> str:
    return f"(len({x}) > 0 AND len({y}) > 0 AND list_sort(list_distinct({x})) <> list_sort(list_distinct({y})))"


_CONFLICT = " OR ".join([_sql_differ(*(f"list_filter({v}, lambda t: regexp_matches(t, '^(?:(?:NO|NUMBER)?[0-9]+[A-Z]?|[IVX]+)$'))" for v in "xy"))] + [_sql_differ(*(f"list_intersect({v}, ['{a}', '{b}'])" for v in "xy")) for a, b in N.OPPOSING])


def _name_pairs(spark, sf):
    core = _places(spark, sf).where("core <> ''").select(F.floor(F.col("p_partkey") / 50).alias("company"), "core").distinct()
    return core.withColumnRenamed("core", "l").join(core.withColumnRenamed("core", "r"), "company").where("l < r")


@query("C17_C18_F1_F4_name_pairs", f"""SELECT company, l, r, ({_CONFLICT}) AS conflict, NOT ({_CONFLICT}) AND len(list_filter(CASE WHEN len(list_distinct(x)) <= len(list_distinct(y)) THEN x ELSE y END, lambda t: NOT list_contains(CASE WHEN len(list_distinct(x)) <= len(list_distinct(y)) THEN y ELSE x END, t))) = 0
 AND len(list_filter(CASE WHEN len(list_distinct(x)) <= len(list_distinct(y)) THEN x ELSE y END, lambda t: regexp_matches(t, '^[A-Z]{{4,}}$'))) > 0 AS subset, round(100.0 * (1 - levenshtein(l, r) / greatest(length(l), length(r))), 6) AS similarity, round(100.0 * len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y))), 6) AS overlap FROM {_PAIRS}""")
def _(spark, sf):
    left, right = F.col("l"), F.col("r")
    out = _name_pairs(spark, sf)
    return rounded(out.select("company", "l", "r", N.qualifier_conflict(left, right).alias("conflict"), N.subset_match(left, right).alias("subset"), N.levenshtein_similarity(left, right).alias("similarity"), N.token_overlap(left, right).alias("overlap")), "similarity", "overlap")


@query("F2_F3_F5_composite_scores")
def _(spark, sf):
    left, right = F.col("l"), F.col("r")
    return rounded(_name_pairs(spark, sf).select("company", "l", "r", N.token_set_ratio(left, right).alias("token_set"), N.weighted_ratio(left, right).alias("weighted"), N.composite_score(left, right).alias("score")), "token_set", "weighted", "score")


@query("J14_fuzzy_candidates")
def _(spark, sf):
    """Names of sensors against names of works of one company: aliases exploded, the best pair of aliases for each pair of entities, ties kept at the fifth score.

    Texts that meet in many companies are scored once, over four tasks a core: a pair's bytes say little of what its score costs.
    """
    tasks, company = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.floor(F.col("p_partkey") / 50)
    own = _places(spark, sf, tasks, company).where("core <> ''").select("p_partkey", company.alias("company"), "core", "f").persist()
    s = own.where("p_partkey % 3 <> 0").select("company", F.col("p_partkey").alias("sensor"), F.explode(F.array_distinct(F.array("core", "f"))).alias("a"))
    w = own.where("p_partkey % 3 = 0").select("company", F.col("p_partkey").alias("works"), F.explode(F.array_distinct(F.array("core", "f"))).alias("b"))
    pairs = s.join(w, "company").select("sensor", "works", "a", "b")
    texts = s.select("company", "a").distinct().join(w.select("company", "b").distinct(), "company").select("a", "b").distinct().repartition(tasks, "a", "b")
    scored = texts.withColumn("score", F.round(N.composite_score(F.col("a"), F.col("b")), 6))
    # read four times below
    best = pairs.join(scored, ["a", "b"]).groupBy("sensor", "works").agg(F.max("score").alias("score")).persist()
    return joins.margins(joins.top_with_ties(best, "sensor", "score", 5), "sensor", "score").withColumn("dense", F.col("dense").cast("long"))


@query("C19_aliases", "WITH s AS (SELECT p_partkey, trim(unnest(string_split(p_name || '; ' || upper(p_name) || ';' || p_brand, ';'))) AS v FROM part) SELECT p_partkey, string_agg(DISTINCT upper(v), '|' ORDER BY upper(v)) AS aliases FROM s WHERE v <> '' GROUP BY 1")
def _(spark, sf):
    split = F.filter(F.transform(F.split(F.concat_ws(";", F.concat(F.col("p_name"), F.lit("; "), F.upper("p_name")), F.col("p_brand")), ";"), lambda v: F.upper(F.trim(v))), lambda v: v != "")
    return _read(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(split)), "|").alias("aliases"))


@query("C20_grid_bounds", "SELECT sensor, x > 0 AND x < 700000 AND y > 0 AND y < 1300000 AS strict, x BETWEEN 0 AND 700000 AND y BETWEEN 0 AND 1300000 AS inclusive FROM sensors")
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    return view(spark, sf, "sensors").select("sensor", S.inside_grid(x, y, False).alias("strict"), S.inside_grid(x, y, True).alias("inclusive"))


_COORD = """(SELECT *, CASE WHEN eligible_for_matching THEN 'valid' WHEN coalesce(match, '') = 'ambiguous' THEN 'ambiguous_match_rejected' WHEN conflict THEN 'coordinate_conflict_rejected' WHEN (x IS NULL) <> (y IS NULL) THEN 'partial_coordinates_rejected'
  WHEN match IN ('exact', 'normalised') AND x IS NOT NULL AND y IS NOT NULL THEN 'invalid_coordinates' WHEN match IN ('exact', 'normalised') THEN 'missing_coordinates' ELSE 'unmatched_permit' END AS coordinate_status
 FROM (SELECT *, coalesce(match IN ('exact', 'normalised') AND NOT conflict AND coordinate_valid AND x > 0 AND x < 700000 AND y > 0 AND y < 1300000, false) AS eligible_for_matching FROM masters))"""


def _coordinates(spark, sf):
    return master.coordinate_status(view(spark, sf, "masters"), ("exact", "normalised"))


@query("C21_coordinate_status", f"SELECT sensor, coordinate_status, eligible_for_matching FROM {_COORD}")
def _(spark, sf):
    return _coordinates(spark, sf).select("sensor", "coordinate_status", "eligible_for_matching")


_QUALITY = f"""(SELECT *, CASE WHEN eligible_for_beta THEN 'strict_quality_beta' WHEN beta_at_bound THEN 'optimisation_boundary_beta' WHEN beta_positive THEN 'exploratory_beta' ELSE 'no_finite_beta' END AS beta_quality FROM (
 SELECT *, eligible_for_matching AND fitted AND beta_positive AND beta_in_bounds AND NOT beta_at_bound AND strict_interval AND bootstrapped AND success_ok AND hits_ok AS eligible_for_beta FROM (
 SELECT *, interval_valid AND ci_width > 0 AND ci_width < 0.5 AND width_agrees AS strict_interval FROM (
 SELECT *, coalesce(beta > 0, false) AS beta_positive, coalesce(beta BETWEEN 0.01 AND 2, false) AS beta_in_bounds, coalesce(abs(beta - 0.01) <= 1e-4 OR abs(beta - 2) <= 1e-4, false) AS beta_at_bound, coalesce(ci_low <= ci_high, false) AS interval_valid,
  NOT coalesce(ci_low <= ci_high, false) OR abs(ci_width - (ci_high - ci_low)) <= 1e-10 + 1e-8 * abs(ci_high - ci_low) AS width_agrees, success_rate >= 0.95 AS success_ok, hit_rate <= 0.05 AS hits_ok FROM {_COORD}))))"""


def _quality(spark, sf):
    return master.beta_quality(_coordinates(spark, sf))


_FLAG_COLUMNS = ("beta_positive", "beta_in_bounds", "beta_at_bound", "interval_valid", "width_agrees", "strict_interval", "success_ok", "hits_ok", "eligible_for_beta", "beta_quality")


@query("C22_beta_quality", f"SELECT sensor, {', '.join(_FLAG_COLUMNS)} FROM {_QUALITY}")
def _(spark, sf):
    return _quality(spark, sf).select("sensor", *_FLAG_COLUMNS)


_ISSUES = f"""(SELECT *, concat_ws(';', CASE WHEN coordinate_status <> 'valid' THEN 'coordinate_unavailable' END, CASE WHEN NOT fitted THEN 'point_fit_unavailable' END, CASE WHEN NOT beta_positive OR NOT beta_in_bounds THEN 'beta_missing_or_invalid' END, CASE WHEN beta_at_bound THEN 'beta_at_optimisation_bound' END,
 CASE WHEN NOT interval_valid THEN 'bootstrap_interval_unavailable' WHEN NOT width_agrees THEN 'beta_ci_width_mismatch' WHEN NOT strict_interval THEN 'beta_interval_not_strict_quality' END,
 CASE WHEN NOT bootstrapped THEN 'bootstrap_not_attempted' WHEN NOT success_ok THEN 'bootstrap_success_below_threshold' END, CASE WHEN bootstrapped AND NOT hits_ok THEN 'beta_bound_hit_rate_not_strict_quality' END) AS issue_type FROM {_QUALITY})"""


@query("C23_issues", f"SELECT sensor, issue_type FROM {_ISSUES}")
def _(spark, sf):
    return master.with_issues(_quality(spark, sf)).select("sensor", "issue_type")


_RULES = {
    "tail within events": "tail_count <= total_count",
    "interval ordered": "ci_low IS NULL OR ci_low <= ci_high",
    "problems have issues": "issue_type <> '' OR (coordinate_status = 'valid' AND beta_quality = 'strict_quality_beta')",
    "width under one": "ci_width < 0.55",
}


@query("V2_named_rules", " UNION ALL ".join(f"SELECT '{n}' AS gate, count(*) FILTER (NOT coalesce({r}, false)) AS violations, count(*) FILTER (NOT coalesce({r}, false)) = 0 AS passed FROM {_ISSUES}" for n, r in _RULES.items()))
def _(spark, sf):
    return gates.violations(master.with_issues(_quality(spark, sf)), {n: F.expr(r) for n, r in _RULES.items()})


@query("X5_company_quality", f"SELECT company, count(*) AS sensors, count(*) FILTER (eligible_for_matching) AS located, count(*) FILTER (beta_quality = 'strict_quality_beta') AS strict, count(*) FILTER (issue_type <> '') AS with_issues FROM {_ISSUES} GROUP BY 1")
def _(spark, sf):
    own = master.with_issues(_quality(spark, sf))
    return own.groupBy("company").agg(F.count("*").alias("sensors"), F.count_if("eligible_for_matching").alias("located"), F.count_if(F.col("beta_quality") == "strict_quality_beta").alias("strict"), F.count_if(F.col("issue_type") != "").alias("with_issues"))


@query("A11_group_beta", f"""SELECT company, count(DISTINCT sensor) AS sensors, count(*) FILTER (e) AS primary_n, round(median(beta) FILTER (e), 9) AS primary_median, round(avg(beta) FILTER (e), 9) AS primary_mean, round(stddev_samp(beta) FILTER (e), 9) AS primary_sd, round(quantile_cont(beta, 0.25) FILTER (e), 9) AS q25, round(quantile_cont(beta, 0.75) FILTER (e), 9) AS q75,
 count(*) FILTER (beta > 0) AS finite_n, round(median(beta) FILTER (beta > 0), 9) AS finite_median, round(avg(beta) FILTER (beta > 0), 9) AS finite_mean, round(quantile_cont(beta, 0.75) FILTER (e) - quantile_cont(beta, 0.25) FILTER (e), 9) AS iqr, count(*) FILTER (e) < 3 AS few FROM (SELECT *, eligible_for_beta AS e FROM {_QUALITY}) GROUP BY 1""")
def _(spark, sf):
    return rounded(master.group_beta(_quality(spark, sf), "company"), "primary_median", "primary_mean", "primary_sd", "q25", "q75", "finite_median", "finite_mean", "iqr", digits=9)


@query("C24_exclusion_reasons", f"SELECT sensor, concat_ws('|', CASE WHEN NOT eligible_for_matching THEN 'no_accepted_assignment' END, CASE WHEN NOT beta_positive THEN 'missing_beta' END, CASE WHEN beta_at_bound THEN 'beta_at_bound' END, CASE WHEN NOT eligible_for_beta THEN 'strict_beta_quality_failed' END) AS reasons FROM {_QUALITY}")
def _(spark, sf):
    return _quality(spark, sf).select("sensor", F.concat_ws("|", S.issues((~F.col("eligible_for_matching"), "no_accepted_assignment"), (~F.col("beta_positive"), "missing_beta"), (F.col("beta_at_bound"), "beta_at_bound"), (~F.col("eligible_for_beta"), "strict_beta_quality_failed"))).alias("reasons"))


@query("C28_C29_transforms", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount > 0 THEN log2(l_discount) END, 6) AS log_discount, round(l_extendedprice / 1000, 5) AS scaled, round(CASE WHEN l_tax > 0 THEN l_discount / l_tax END, 6) AS ratio FROM lineitem")
def _(spark, sf):
    own = _read(spark, sf, "lineitem")
    return own.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.log2_positive(F.col("l_discount")), 6).alias("log_discount"), F.round(F.col("l_extendedprice") / 1000, 5).alias("scaled"), F.round(S.guarded_ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"))


@query("C32_file_tokens", "SELECT DISTINCT raw, rtrim(substr(trim(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 12), '_') AS token FROM place_names")
def _(spark, sf):
    return view(spark, sf, "place_names").select("raw", S.file_token(F.col("raw"), 12).alias("token")).distinct()


@query("C33_company_aliases", "SELECT c_custkey, coalesce(a.v, 'n' || c_nationkey) AS company FROM customer LEFT JOIN (VALUES ('n0', 'north'), ('n1', 'south')) a(k, v) ON a.k = 'n' || c_nationkey")
def _(spark, sf):
    aliases = spark.createDataFrame([("n0", "north"), ("n1", "south")], "k string, v string")
    own = _read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("k"))
    return own.join(joins.small(aliases), "k", "left").select("c_custkey", F.coalesce("v", "k").alias("company"))


@query("C37_stable_seeds", "SELECT c_custkey, sha256('42|' || c_nationkey || '|' || c_custkey) AS digest FROM customer")
def _(spark, sf):
    return _read(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws("|", F.lit("42"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")), 256).alias("digest"))


@query("C38_null_safe_keys", "SELECT coalesce(match, '<NULL>') || chr(31) || code AS key, count(*) AS n FROM masters GROUP BY 1")
def _(spark, sf):
    return view(spark, sf, "masters").groupBy(S.null_safe_key(F.col("match"), F.col("code")).alias("key")).agg(F.count("*").alias("n"))


@query("C39_first_exclusion", f"SELECT sensor, CASE WHEN NOT eligible_for_matching THEN 'not accepted primary pair' WHEN NOT beta_positive THEN 'missing/non-positive beta' WHEN beta_at_bound THEN 'fitted at optimizer boundary' ELSE 'eligible' END AS reason FROM {_QUALITY}")
def _(spark, sf):
    return _quality(spark, sf).select("sensor", master.first_reason((~F.col("eligible_for_matching"), "not accepted primary pair"), (~F.col("beta_positive"), "missing/non-positive beta"), (F.col("beta_at_bound"), "fitted at optimizer boundary")).alias("reason"))


@query("C40_rounded_projection", "SELECT sensor, beta, round_even(ci_high + 0.013, 2) AS ci_high FROM masters")
def _(spark, sf):
    return view(spark, sf, "masters").select("sensor", "beta", F.bround(F.col("ci_high") + 0.013, 2).alias("ci_high"))


@query("IO6_IO12_names_and_dates", "SELECT DISTINCT 'run_' || year(o_orderdate) || '_' || (o_orderkey % 3) || CASE WHEN o_orderkey % 4 = 0 THEN '_2003' ELSE '' END AS name, CASE WHEN o_orderkey % 4 = 0 AND year(o_orderdate) <> 2003 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year, CAST(CAST('1800-01-01' AS TIMESTAMP) + to_hours(CAST(o_orderkey % 500 AS INTEGER) * 24) AS DATE)::VARCHAR AS day FROM orders")
def _(spark, sf):
    own = _read(spark, sf, "orders").select(F.concat(F.lit("run_"), F.year("o_orderdate").cast("string"), F.lit("_"), (F.col("o_orderkey") % 3).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "_2003").otherwise("")).alias("name"), (F.col("o_orderkey") % 500 * 24).alias("h"))
    return own.select("name", S.year_in_name(F.col("name")).alias("year"), S.hours_since_1800(F.col("h")).cast("date").cast("string").alias("day")).distinct()


@query("IO8_coordinate_repair", "SELECT sensor, CASE WHEN s THEN y ELSE x END AS x, CASE WHEN s THEN x ELSE y END AS y, s AS swapped, CASE WHEN s THEN true ELSE ok END AS valid FROM (SELECT sensor, x, y, x <= 700000 AND y <= 1300000 AS ok, NOT (x <= 700000 AND y <= 1300000) AND y <= 700000 AND x <= 1300000 AS s FROM (SELECT sensor, y AS x, x AS y FROM sensors))")
def _(spark, sf):
    return files.repaired_coordinates(view(spark, sf, "sensors").select("sensor", F.col("y").alias("x"), F.col("x").alias("y")))


@query("IO15_manual_matches", r"""WITH l AS (SELECT p_partkey AS line_no, CASE p_partkey % 5 WHEN 0 THEN 'UK' || p_partkey || ' -> demo::S' || p_partkey WHEN 1 THEN 'UK1 UK2 demo::a' WHEN 2 THEN 'UK' || p_partkey WHEN 3 THEN 'UK7: demo::a, demo::b' ELSE 'nothing' END AS value FROM part),
r AS (SELECT line_no, list_distinct(regexp_extract_all(value, '\b(UK[A-Z0-9_]+)\b', 1)) AS w, list_distinct(regexp_extract_all(value, '\b([a-z_]+::[A-Za-z0-9./-]+)', 1)) AS s FROM l)
SELECT line_no, len(w) AS works, len(s) AS sensors, CASE WHEN len(w) = 0 AND len(s) = 0 THEN 'no_ids' WHEN len(w) <> 1 THEN 'not_one_works' WHEN len(s) = 0 THEN 'no_sensor' WHEN len(s) = 1 THEN 'one_sensor' ELSE 'several_sensors' END AS status FROM r""")
def _(spark, sf):
    k, own = F.col("p_partkey"), F.col("p_partkey").cast("string")
    value = F.when(k % 5 == 0, F.concat(F.lit("UK"), own, F.lit(" -> demo::S"), own)).when(k % 5 == 1, "UK1 UK2 demo::a").when(k % 5 == 2, F.concat(F.lit("UK"), own)).when(k % 5 == 3, "UK7: demo::a, demo::b").otherwise("nothing")
    return files.manual_matches(_read(spark, sf, "part").select(k.alias("line_no"), value.alias("value"))).withColumns({c: F.size(c).cast("long") for c in ("works", "sensors")})


# --- joins ---


@query("J0_J1_J3_preserving_join", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    right = _read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.preserving_join(_read(spark, sf, "orders").select("o_orderkey", "o_custkey"), right, ["o_custkey"]).select("o_orderkey", "c_mktsegment")


@query("J2_inner_join", "SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(spark, sf):
    s, n, r = (_read(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"))


_RARE = "(SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 480000)"


def _rare(spark, sf):
    return _read(spark, sf, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey")).distinct()


@query("J4_indicator_join", f"SELECT c_custkey, r.c_custkey IS NOT NULL AS matched FROM customer LEFT JOIN {_RARE} r USING (c_custkey)")
def _(spark, sf):
    return joins.indicated_join(_read(spark, sf, "customer").select("c_custkey"), _rare(spark, sf), ["c_custkey"])


@query("J5_semi_and_anti", f"SELECT c_custkey, 'in' AS side FROM customer WHERE c_custkey IN (SELECT c_custkey FROM {_RARE}) UNION ALL SELECT c_custkey, 'out' FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {_RARE})")
def _(spark, sf):
    own, rare = _read(spark, sf, "customer").select("c_custkey"), _rare(spark, sf)
    return own.join(rare, "c_custkey", "left_semi").withColumn("side", F.lit("in")).unionByName(own.join(rare, "c_custkey", "left_anti").withColumn("side", F.lit("out")))


@query("J7_masked_join", "SELECT sensor, m.company, CASE WHEN m.fitted THEN n_name END AS n_name FROM masters m LEFT JOIN nation ON 'n' || n_nationkey = m.company")
def _(spark, sf):
    n = _read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("company"), "n_name")
    return joins.masked_join(view(spark, sf, "masters").select("sensor", "company", "fitted"), n, ["company"], F.col("fitted")).drop("fitted")


@query("J8_nearest_works", "SELECT sensor, works, round(d, 4) AS distance FROM (SELECT sensor, works, d, row_number() OVER (PARTITION BY sensor ORDER BY d, works) AS k FROM (SELECT sensor, works, sqrt(pow(x - works_x, 2) + pow(y - works_y, 2)) AS d FROM sensors JOIN works USING (company))) WHERE k = 1 AND d <= 200000")
def _(spark, sf):
    return rounded(joins.nearest(view(spark, sf, "sensors").drop("c_custkey"), view(spark, sf, "works").drop("s_suppkey"), "company", 200_000.0), "distance", digits=4)


_CASCADE = """WITH l AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'AB-' || (c_custkey % 200) WHEN 1 THEN 'ab ' || (c_custkey % 300) ELSE 'X/' || c_custkey END AS p FROM customer),
k AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'AB-' || s_suppkey WHEN 1 THEN 'Ab' || s_suppkey ELSE 'x ' || s_suppkey END AS key FROM supplier),
h AS (SELECT key, 1 AS level, count(*) AS n FROM k JOIN l ON key = p GROUP BY key UNION ALL SELECT key, 2, count(*) FROM k JOIN l ON upper(replace(key, ' ', '')) = upper(replace(p, ' ', '')) GROUP BY key
 UNION ALL SELECT key, 3, count(*) FROM k JOIN l ON regexp_replace(upper(key), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(p), '[^A-Z0-9]', '', 'g') GROUP BY key),
m AS (SELECT key, min(level) AS level FROM h GROUP BY 1)
SELECT k.key, m.level, coalesce(h.n, 0) AS n, CASE WHEN h.n IS NULL THEN 'unmatched' WHEN h.n > 1 THEN 'ambiguous' WHEN m.level = 1 THEN 'exact' WHEN m.level = 2 THEN 'normalised' ELSE 'alphanumeric' END AS status FROM k LEFT JOIN m ON k.key = m.key LEFT JOIN h ON h.key = m.key AND h.level = m.level"""


@query("J9_permit_cascade", _CASCADE)
def _(spark, sf):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    text = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    locations = _read(spark, sf, "customer").select(c.alias("location"), F.when(c % 4 == 0, text("AB-", c % 200)).when(c % 4 == 1, text("ab ", c % 300)).otherwise(text("X/", c)).alias("permit"))
    keys = _read(spark, sf, "supplier").select(F.when(s % 3 == 0, text("AB-", s)).when(s % 3 == 1, text("Ab", s)).otherwise(text("x ", s)).alias("key")).distinct()
    return joins.cascade(locations, keys)


@query("J17_cardinality_proof", "SELECT count(*) AS n, sum(k) AS expected, count(*) = sum(k) AS equal FROM (SELECT o_orderkey, 1.0 AS k FROM orders JOIN customer ON o_custkey = c_custkey)".replace("sum(k) AS expected", "CAST(sum(k) AS BIGINT) AS expected"))
def _(spark, sf):
    right = _read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    out = joins.checked_join(_read(spark, sf, "orders"), right, ["o_custkey"], "inner")
    expected = _read(spark, sf, "orders").join(right, "o_custkey", "left_semi").agg(F.count("*").alias("expected"))
    return out.agg(F.count("*").alias("n")).join(F.broadcast(expected)).withColumn("equal", F.col("n") == F.col("expected"))


# --- candidate choice ---

_D = "(SELECT *, x IS NOT NULL AS eligible, CASE WHEN x IS NOT NULL THEN sqrt(pow(x - works_x, 2) + pow(y - works_y, 2)) END AS distance FROM pairs)"
_RANKED = f"""(SELECT *, CASE WHEN NOT eligible THEN 'coordinate_ineligible' WHEN distance <= 1000 THEN 'within_1000m' WHEN distance <= 2000 THEN 'within_2000m' WHEN distance <= 3000 THEN 'within_3000m' ELSE 'outside_max_radius' END AS radius, coalesce(abs(distance - audited) > 1, false) AS discrepant,
 CASE WHEN eligible THEN row_number() OVER (PARTITION BY company, code ORDER BY distance NULLS LAST, exact DESC, score DESC, margin DESC, sensor) END AS distance_rank, row_number() OVER (PARTITION BY company, code ORDER BY score DESC, margin DESC, exact DESC, sensor) AS name_rank FROM {_D})"""


def _ranked(spark, sf):
    return joins.candidate_distances(view(spark, sf, "pairs"))


@query("W1_W10_candidate_ranks", f"SELECT company, code, sensor, eligible, round(distance, 4) AS distance, radius, discrepant, CAST(distance_rank AS INTEGER) AS distance_rank, CAST(name_rank AS INTEGER) AS name_rank FROM {_RANKED}")
def _(spark, sf):
    return rounded(_ranked(spark, sf).select("company", "code", "sensor", "eligible", "distance", "radius", "discrepant", "distance_rank", "name_rank"), "distance", digits=4)


_UNIVERSE = "(SELECT DISTINCT 'n' || (c_custkey % 4) AS company, 'W' || (c_custkey % 230) AS code, c_custkey % 230 <> 5 AS works_ok FROM customer)"
_PRIMARY = f"""(SELECT company, code, coalesce(candidates, 0) AS candidates, coalesce(with_coordinates, 0) AS with_coordinates, tier, CASE WHEN tier IS NOT NULL THEN best.sensor END AS sensor, nearest, second, second - nearest AS gap, CASE WHEN tier IS NOT NULL THEN best.exact END AS exact, CASE WHEN tier IS NOT NULL THEN abs(top_score - best.score) <= 1e-6 END AS top_name, coalesce(inconsistent, false) AS inconsistent,
 CASE WHEN candidates IS NULL THEN 'unassigned_no_accepted_name_candidate' WHEN NOT works_ok THEN 'unassigned_missing_wwtw_coordinates' WHEN with_coordinates = 0 THEN 'unassigned_no_coordinate_eligible_candidate' WHEN tier IS NULL THEN 'unassigned_no_candidate_within_max_radius'
  ELSE 'selected_' || CASE WHEN CASE tier WHEN 1000 THEN k1 WHEN 2000 THEN k2 ELSE k3 END = 1 THEN 'unique' ELSE 'nearest_of_multiple' END || '_within_' || CAST(CAST(tier AS INTEGER) AS VARCHAR) || 'm' END AS status
 FROM (SELECT u.*, g.* EXCLUDE (company, code), CASE WHEN works_ok THEN CASE WHEN nearest <= 1000 THEN 1000e0 WHEN nearest <= 2000 THEN 2000e0 WHEN nearest <= 3000 THEN 3000e0 END END AS tier FROM {_UNIVERSE} u LEFT JOIN (
 SELECT company, code, count(*) AS candidates, count(*) FILTER (eligible) AS with_coordinates, count(*) FILTER (distance <= 1000) AS k1, count(*) FILTER (distance <= 2000) AS k2, count(*) FILTER (distance <= 3000) AS k3, min(distance) AS nearest, max(CASE WHEN distance_rank = 2 THEN distance END) AS second, max(score) AS top_score, bool_or(discrepant) AS inconsistent,
  max(CASE WHEN distance_rank = 1 THEN {{'sensor': sensor, 'exact': exact, 'score': score}} END) AS best FROM {_RANKED} GROUP BY 1, 2) g USING (company, code)))"""


def _universe(spark, sf):
    c = F.col("c_custkey")
    return _read(spark, sf, "customer").select(F.concat(F.lit("n"), (c % 4).cast("string")).alias("company"), F.concat(F.lit("W"), (c % 230).cast("string")).alias("code"), (c % 230 != 5).alias("works_ok")).distinct()


def _primary(spark, sf):
    return joins.primary(_universe(spark, sf), _ranked(spark, sf))


@query("W8_W9_primary_selection", f"SELECT * REPLACE (round(nearest, 4) AS nearest, round(second, 4) AS second, round(gap, 4) AS gap) FROM {_PRIMARY}")
def _(spark, sf):
    return rounded(_primary(spark, sf), "nearest", "second", "gap", digits=4)


_REVIEW = f"""(SELECT company, code, sensor, tier, reasons, CASE WHEN contains(reasons, 'inconsistency') OR contains(reasons, 'conflict') THEN 'critical' WHEN sensor IS NULL OR contains(reasons, 'missing_coordinate') OR contains(reasons, 'near_distance_tie') OR coalesce(tier >= 3000, false) THEN 'high' WHEN reasons <> '' THEN 'medium' ELSE 'low' END AS priority FROM (
 SELECT *, concat_ws(' | ', CASE WHEN inconsistent THEN 'source_or_distance_inconsistency' END, CASE WHEN sensor IS NULL THEN status END, CASE WHEN candidates > 1 THEN 'multiple_accepted_matching_candidates' END, CASE WHEN tier > 1000 THEN 'selected_outside_1000m_tier_' || CAST(CAST(tier AS INTEGER) AS VARCHAR) || 'm' END, CASE WHEN sensor IS NOT NULL AND NOT exact THEN 'selected_candidate_not_exact_place_core' END,
  CASE WHEN gap < 100 THEN 'near_distance_tie_under_100m' END, CASE WHEN sensor IS NOT NULL AND NOT top_name THEN 'nearest_candidate_not_highest_name_score' END, CASE WHEN candidates > with_coordinates THEN 'accepted_candidate_missing_coordinates' END) AS reasons FROM {_PRIMARY}))"""


@query("C26_review_reasons", f"SELECT company, code, reasons, priority, reasons <> '' AS review FROM {_REVIEW}")
def _(spark, sf):
    return joins.review(_primary(spark, sf)).select("company", "code", "reasons", "priority", "review")


@query("J19_F8_manual_override", f"SELECT company, code, final, coalesce(action IN ('select', 'none') AND final IS DISTINCT FROM sensor, false) AS overridden FROM (SELECT p.company, p.code, p.sensor, d.action, CASE d.action WHEN 'select' THEN d.chosen WHEN 'none' THEN NULL ELSE p.sensor END AS final FROM {_PRIMARY} p LEFT JOIN (SELECT company, code, CASE WHEN length(code) = 2 THEN 'select' WHEN length(code) = 3 THEN 'none' ELSE 'accept' END AS action, 'C1' AS chosen FROM {_UNIVERSE} WHERE code LIKE '%7') d USING (company, code))")
def _(spark, sf):
    own = _primary(spark, sf)
    n = F.length("code")
    decisions = own.where("code like '%7'").select("company", "code", F.when(n == 2, "select").when(n == 3, "none").otherwise("accept").alias("action"), F.lit("C1").alias("chosen"))
    return joins.override(own, decisions).select("company", "code", "final", "overridden")


_SCORES = "(SELECT company, sensor, CAST((c * 37 % 23) AS DOUBLE) AS score FROM (SELECT company, sensor, CAST(substr(sensor, 2) AS BIGINT) AS c FROM pairs))"


def _scores(spark, sf):
    return view(spark, sf, "pairs").select("company", "sensor", (F.substring("sensor", 2, 20).cast("long") * 37 % 23).cast("double").alias("score"))


@query("W3_top_with_ties", f"SELECT company, sensor, score FROM (SELECT *, nth_value(score, 5) OVER (PARTITION BY company ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut FROM {_SCORES}) WHERE score >= cut - 1e-6")
def _(spark, sf):
    return joins.top_with_ties(_scores(spark, sf), "company", "score", 5)


@query("W2_W4_margins", f"SELECT company, sensor, score, CAST(dense_rank() OVER (PARTITION BY company ORDER BY round(score, 6) DESC) AS INTEGER) AS dense, max(score) OVER (PARTITION BY company) AS best, nth_value(score, 2) OVER (PARTITION BY company ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, max(score) OVER (PARTITION BY company) - nth_value(score, 2) OVER (PARTITION BY company ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS margin FROM {_SCORES}")
def _(spark, sf):
    return joins.margins(_scores(spark, sf), "company", "score")


@query("W20_top_alternatives", "SELECT company, string_agg(code, '|' ORDER BY m DESC, code) AS codes FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY m DESC, code) AS k FROM (SELECT company, code, max(score) AS m FROM pairs GROUP BY 1, 2)) WHERE k <= 5 GROUP BY 1")
def _(spark, sf):
    best = view(spark, sf, "pairs").groupBy("company", "code").agg(F.max("score").alias("m"))
    top = best.withColumn("k", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("m"), "code"))).where("k <= 5")
    return top.groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda r: r["code"]), "|").alias("codes"))


# --- latest records, capacity ---

_VALID = "(SELECT *, coalesce(load >= 0 AND capacity > 0, false) AS valid FROM records)"
_CAPACITY = f"""(SELECT b.code, names, n_records, n_valid, coalesce(n_latest, 0) AS n_latest, CASE WHEN n_latest = 1 THEN l.load END AS load, CASE WHEN n_latest = 1 THEN l.capacity END AS capacity, CASE WHEN n_latest = 1 THEN l.load / l.capacity END AS ratio, CASE WHEN n_latest = 1 THEN CAST(latest AS INTEGER) END AS data_year,
 CASE WHEN n_valid = 0 THEN 'no_valid_capacity_record' WHEN n_latest = 1 THEN 'valid' ELSE 'conflicting_latest_records' END AS status, coalesce(n_latest, 0) = 1 AS available, coalesce(n_latest = 1 AND l.load / l.capacity > 1, false) AS over_design, coalesce(n_latest = 1 AND l.load / l.capacity > 2, false) AS extreme, coalesce(n_latest = 1 AND l.load = 0, false) AS zero_load
 FROM (SELECT code, string_agg(DISTINCT trim(name), '|' ORDER BY trim(name)) AS names, count(*) AS n_records, count(*) FILTER (valid) AS n_valid, max(year) FILTER (valid) AS latest FROM {_VALID} GROUP BY 1) b
 LEFT JOIN (SELECT code, year, count(*) AS n_latest, any_value(load) AS load, any_value(capacity) AS capacity FROM (SELECT DISTINCT code, name, year, load, capacity FROM {_VALID} WHERE valid) GROUP BY 1, 2) l ON b.code = l.code AND b.latest = l.year)"""


def _capacity(spark, sf):
    return master.latest_capacity(view(spark, sf, "records"))


@query("A13_A14_latest_capacity", f"SELECT * REPLACE (round(ratio, 6) AS ratio) FROM {_CAPACITY}")
def _(spark, sf):
    return rounded(_capacity(spark, sf), "ratio")


_ASSIGNED = "(SELECT 'C' || c_custkey AS sensor, 'n' || (c_custkey % 2) AS company, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'P' || (c_custkey % 330) END AS code, CASE c_custkey % 4 WHEN 0 THEN 'unique_same_company_containment' WHEN 1 THEN 'multiple_same_uwwcode' WHEN 2 THEN 'boundary_match' ELSE 'no_catchment_match' END AS status, c_custkey % 3 <> 0 AS eligible_for_beta FROM customer)"


def _assigned(spark, sf):
    c = F.col("c_custkey")
    status = F.when(c % 4 == 0, "unique_same_company_containment").when(c % 4 == 1, "multiple_same_uwwcode").when(c % 4 == 2, "boundary_match").otherwise("no_catchment_match")
    return _read(spark, sf, "customer").select(F.concat(F.lit("C"), c.cast("string")).alias("sensor"), F.concat(F.lit("n"), (c % 2).cast("string")).alias("company"), F.when(c % 9 == 0, "").otherwise(F.concat(F.lit("P"), (c % 330).cast("string"))).alias("code"), status.alias("status"), (c % 3 != 0).alias("eligible_for_beta"))


@query("X13_X14_capacity_enrichment", f"""SELECT sensor, capacity_status, capacity_available, status IN ('unique_same_company_containment', 'multiple_same_uwwcode') AND eligible_for_beta AND code <> '' AND capacity_available AND capacity_status = 'valid' AS eligible_for_capacity FROM (
 SELECT a.*, coalesce(c.status, CASE WHEN a.status NOT IN ('unique_same_company_containment', 'multiple_same_uwwcode') THEN 'not_applicable_assignment_status' WHEN a.code = '' THEN 'missing_accepted_uwwcode' ELSE 'missing_company_waterbase_match' END) AS capacity_status, coalesce(c.available, false) AS capacity_available
 FROM {_ASSIGNED} a LEFT JOIN (SELECT 'n0' AS company, * FROM {_CAPACITY}) c USING (company, code))""")
def _(spark, sf):
    capacity = _capacity(spark, sf).withColumn("company", F.lit("n0"))
    return master.enrich_capacity(_assigned(spark, sf), capacity).select("sensor", "capacity_status", "capacity_available", "eligible_for_capacity")


@query("C25_link_status", f"""WITH w AS (SELECT DISTINCT 'n' || (l_partkey % 2) AS company, 'P' || (l_partkey % 300) AS code FROM lineitem)
SELECT sensor, CASE WHEN a.status NOT IN ('unique_same_company_containment', 'multiple_same_uwwcode') THEN 'no_accepted_wwtw_assignment' WHEN a.code = '' THEN 'uwwcode_missing' WHEN w.code IS NOT NULL THEN 'matched_wwtw_characteristics' WHEN a.code IN (SELECT code FROM w) THEN 'company_uwwcode_conflict' ELSE 'wwtw_characteristics_not_found' END AS link_status
FROM {_ASSIGNED} a LEFT JOIN w ON a.company = w.company AND a.code = w.code""")
def _(spark, sf):
    k = F.col("l_partkey")
    w = _read(spark, sf, "lineitem").select(F.concat(F.lit("n"), (k % 2).cast("string")).alias("company"), F.concat(F.lit("P"), (k % 300).cast("string")).alias("code")).distinct()
    own = joins.indicated_join(_assigned(spark, sf), w, ["company", "code"])
    known = w.groupBy("code").agg(F.collect_set("company").alias("companies"))
    out = own.join(known, "code", "left")
    return out.select("sensor", master.link_status(F.col("status"), F.col("code"), F.col("matched"), F.array_contains("companies", F.col("company"))).alias("link_status"))


_DECIDE = """(SELECT sensor, CASE WHEN k % 29 = 0 THEN '' ELSE 'core' END AS core, k % 13 = 0 AS qualifier, k % 11 = 0 AS tied, k % 2 = 0 AS same_core, CASE WHEN k % 3 = 0 THEN 'U1' ELSE '' END AS existing, k % 6 = 0 AS agrees, CAST(70 + k % 31 AS DOUBLE) AS score, CAST(k % 17 AS DOUBLE) AS margin, k % 5 = 0 AS subset, k % 7 = 0 AS exact, CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k * 37 % 3000 AS DOUBLE) END AS distance, k % 19 = 0 AS weak_alias, k % 8 <> 0 AS sensor_ok, k % 10 <> 0 AS works_ok FROM (SELECT sensor, CAST(substr(sensor, 2) AS BIGINT) AS k FROM pairs))"""
_EVIDENCE = "CASE status WHEN 'accepted_exact_place_core' THEN 'exact_place_core' WHEN 'accepted_place_subset_supported' THEN 'place_subset_with_support' WHEN 'accepted_place_core_existing_uwwcode' THEN 'high_place_core_with_support' WHEN 'accepted_place_core_spatial_support' THEN 'high_place_core_with_support' ELSE 'high_place_core' END"


@query("F6_C27_name_decisions", f"""SELECT sensor, status, status LIKE 'accepted%' AS accepted, {_EVIDENCE} AS evidence FROM (SELECT sensor, CASE WHEN core = '' THEN 'no_meaningful_place_name' WHEN qualifier THEN 'different_place_name' WHEN tied AND same_core THEN 'ambiguous_duplicate_place_name' WHEN tied THEN 'ambiguous_multiple_wwtw_candidates' WHEN existing <> '' AND NOT agrees AND (score >= 85 OR subset) THEN 'name_spatial_conflict'
 WHEN weak_alias AND NOT (agrees OR near) THEN 'different_place_name' WHEN exact THEN 'accepted_exact_place_core' WHEN score >= 85 AND agrees THEN 'accepted_place_core_existing_uwwcode' WHEN subset AND (agrees OR near) THEN 'accepted_place_subset_supported' WHEN score >= 85 AND near THEN 'accepted_place_core_spatial_support' WHEN score >= 85 AND margin >= 8 THEN 'accepted_place_core_85'
 WHEN subset AND NOT sensor_ok AND existing = '' THEN 'missing_sensor_coordinates' WHEN subset AND NOT works_ok AND NOT agrees THEN 'missing_wwtw_coordinates' WHEN score < 85 THEN 'different_place_name' ELSE 'ambiguous_multiple_wwtw_candidates' END AS status FROM (SELECT *, coalesce(distance <= 1000, false) AS near FROM {_DECIDE}))""")
def _(spark, sf):
    k = F.col("k")
    own = view(spark, sf, "pairs").select("sensor", F.substring("sensor", 2, 20).cast("long").alias("k"))
    own = own.select("sensor", F.when(k % 29 == 0, "").otherwise("core").alias("core"), (k % 13 == 0).alias("qualifier"), (k % 11 == 0).alias("tied"), (k % 2 == 0).alias("same_core"), F.when(k % 3 == 0, "U1").otherwise("").alias("existing"), (k % 6 == 0).alias("agrees"), (70 + k % 31).cast("double").alias("score"), (k % 17).cast("double").alias("margin"), (k % 5 == 0).alias("subset"), (k % 7 == 0).alias("exact"), F.when(k % 4 != 0, (k * 37 % 3000).cast("double")).alias("distance"), (k % 19 == 0).alias("weak_alias"), (k % 8 != 0).alias("sensor_ok"), (k % 10 != 0).alias("works_ok"))
    return master.name_decision(own).select("sensor", "status", "accepted", "evidence")


# --- sets ---


@query("U1_union_filled", "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def _(spark, sf):
    return joins.union_filled(_read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")))


@query("U2_U4_union_and_intersection", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersection', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def _(spark, sf):
    a, b = _read(spark, sf, "customer").select("c_nationkey"), _read(spark, sf, "supplier").select("s_nationkey")
    return a.union(b).distinct().agg(F.count("*").alias("n")).select(F.lit("union").alias("op"), "n").unionByName(a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("intersection").alias("op"), "n"))


@query("U3_U5_key_differences", f"SELECT c_custkey, 'left' AS side FROM (SELECT c_custkey FROM customer EXCEPT SELECT c_custkey FROM {_RARE}) UNION ALL SELECT c_custkey, 'right' FROM (SELECT c_custkey FROM {_RARE} EXCEPT SELECT c_custkey FROM customer)")
def _(spark, sf):
    return joins.key_differences(_read(spark, sf, "customer"), _rare(spark, sf), ["c_custkey"])


@query("U6_partition_proof", "SELECT true AS whole, false AS part")
def _(spark, sf):
    own = _read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    parts = [own.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    return spark.createDataFrame([(joins.is_partition(own, parts, ["o_orderkey"]), joins.is_partition(own, parts[:2], ["o_orderkey"]))], "whole boolean, part boolean")


@query("X29_before_after", "SELECT coalesce(a.c, b.c) AS company, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM (SELECT c_nationkey AS c, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS c, count(*) AS n FROM customer WHERE c_acctbal < 500 GROUP BY 1) b ON a.c = b.c")
def _(spark, sf):
    own = _read(spark, sf, "customer").withColumnRenamed("c_nationkey", "company")
    a, b = own.where("c_acctbal > 9000").groupBy("company").agg(F.count("*").alias("before")), own.where("c_acctbal < 500").groupBy("company").agg(F.count("*").alias("after"))
    out = a.join(b, "company", "full").select("company", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return out.withColumn("change", F.col("after") - F.col("before"))


@query("U1_issue_union", f"SELECT 'sensor' AS feature, sensor AS id, CASE WHEN NOT eligible_for_matching THEN 'no_location' ELSE 'weak_fit' END AS issue FROM {_QUALITY} WHERE NOT eligible_for_beta UNION ALL SELECT 'works', code, status FROM {_CAPACITY} WHERE status <> 'valid'")
def _(spark, sf):
    a = _quality(spark, sf).where("not eligible_for_beta").select(F.lit("sensor").alias("feature"), F.col("sensor").alias("id"), F.when(~F.col("eligible_for_matching"), "no_location").otherwise("weak_fit").alias("issue"))
    return a.unionByName(_capacity(spark, sf).where("status <> 'valid'").select(F.lit("works").alias("feature"), F.col("code").alias("id"), F.col("status").alias("issue")))


@query("F9_sensor_classes", f"WITH p AS ({_PRIMARY[1:-1]}) SELECT DISTINCT a.sensor, CASE WHEN a.sensor IN (SELECT sensor FROM p WHERE sensor IS NOT NULL) THEN 'selected' WHEN a.eligible THEN 'candidate' ELSE 'unmatched' END AS class FROM {_D} a")
def _(spark, sf):
    ranked = _ranked(spark, sf)
    chosen = joins.primary(_primary(spark, sf).select("company", "code", (F.col("status") != "unassigned_missing_wwtw_coordinates").alias("works_ok")), ranked).where("sensor is not null").select("sensor").distinct()
    out = joins.indicated_join(ranked.select("sensor", "eligible").distinct(), chosen, ["sensor"])
    return out.select("sensor", F.when(F.col("matched"), "selected").when(F.col("eligible"), "candidate").otherwise("unmatched").alias("class"))


@query("C36_V11_outcome_blind", "SELECT true AS invariant")
def _(spark, sf):
    own = _ranked(spark, sf).withColumn("outcome_beta", F.rand(3)).withColumn("outcome_tail", F.lit(1))
    universe = own.select("company", "code").distinct().withColumn("works_ok", F.lit(True))
    return spark.createDataFrame([(gates.invariant(lambda f: joins.primary(universe, f), own, ["outcome_beta", "outcome_tail"]),)], "invariant boolean")


