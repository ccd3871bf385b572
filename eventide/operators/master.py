"""Sensor and works masters: status ladders, quality tiers, issues, latest records, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, inside_grid, issues, sorted_pipe

#: Limits of the strict beta quality (fixed values).
BETA_LOW, BETA_HIGH, BOUND_SLACK = 0.01, 2.0, 1e-4
MAX_WIDTH, MIN_SUCCESS, MAX_HITS = 0.5, 0.95, 0.05
ACCEPTED = ("unique_same_company_containment", "multiple_same_uwwcode")


def coordinate_status(frame: DataFrame, accepted: tuple[str, ...]) -> DataFrame:
    """A sensor's coordinate state from match (status), conflict, coordinate_valid, x and y: the strongest reason first."""
    match = F.coalesce(F.col("match"), F.lit("unmatched"))
    ambiguous, conflict, known = match == "ambiguous", F.col("conflict"), match.isin(*accepted)
    has_x, has_y = (finite(F.col(c)) & ~(ambiguous | conflict) for c in ("x", "y"))
    both, partial = has_x & has_y, has_x != has_y
    valid = known & ~conflict & F.col("coordinate_valid") & both & inside_grid(F.col("x"), F.col("y"), inclusive=False)
    status = (
        F.when(valid, "valid").when(ambiguous, "ambiguous_match_rejected").when(conflict, "coordinate_conflict_rejected").when(partial, "partial_coordinates_rejected")
        .when(known & both, "invalid_coordinates").when(known & ~both, "missing_coordinates").otherwise("unmatched_permit")
    )
    return frame.withColumn("coordinate_status", status).withColumn("eligible_for_matching", valid)


def beta_quality(frame: DataFrame) -> DataFrame:
    """The quality ladder of a fitted beta, with the diagnostics that make it."""
    beta, lo, hi, width = F.col("beta"), F.col("ci_low"), F.col("ci_high"), F.col("ci_width")
    false = F.lit(False)
    positive = finite(beta) & F.coalesce(beta > 0, false)
    bounds = F.coalesce(beta.between(BETA_LOW, BETA_HIGH), false)
    at_bound = finite(beta) & F.coalesce((F.abs(beta - BETA_LOW) <= BOUND_SLACK) | (F.abs(beta - BETA_HIGH) <= BOUND_SLACK), false)
    interval = finite(lo) & finite(hi) & F.coalesce(lo <= hi, false)
    agrees = ~(interval & finite(width)) | F.coalesce(F.abs(width - (hi - lo)) <= 1e-10 + 1e-8 * F.abs(hi - lo), false)
    strict = interval & finite(width) & F.coalesce((width > 0) & (width < MAX_WIDTH), false) & agrees
    success, hits = F.coalesce(F.col("success_rate") >= MIN_SUCCESS, false), F.coalesce(F.col("hit_rate") <= MAX_HITS, false)
    eligible = F.col("eligible_for_matching") & F.col("fitted") & positive & bounds & ~at_bound & strict & F.col("bootstrapped") & success & hits
    label = F.when(eligible, "strict_quality_beta").when(at_bound, "optimisation_boundary_beta").when(positive, "exploratory_beta").otherwise("no_finite_beta")
    return frame.withColumns({"beta_positive": positive, "beta_in_bounds": bounds, "beta_at_bound": at_bound, "interval_valid": interval, "width_agrees": agrees, "strict_interval": strict, "success_ok": success, "hits_ok": hits, "eligible_for_beta": eligible, "beta_quality": label})


def with_issues(frame: DataFrame) -> DataFrame:
    """All of a sensor's issues, types joined by ';'."""
    found = issues(
        (F.col("coordinate_status") != "valid", "coordinate_unavailable"),
        (~F.col("fitted"), "point_fit_unavailable"),
        (~F.col("beta_positive") | ~F.col("beta_in_bounds"), "beta_missing_or_invalid"),
        (F.col("beta_at_bound"), "beta_at_optimisation_bound"),
        (~F.col("interval_valid"), "bootstrap_interval_unavailable"),
        (F.col("interval_valid") & ~F.col("width_agrees"), "beta_ci_width_mismatch"),
        (F.col("interval_valid") & F.col("width_agrees") & ~F.col("strict_interval"), "beta_interval_not_strict_quality"),
        (~F.col("bootstrapped"), "bootstrap_not_attempted"),
        (F.col("bootstrapped") & ~F.col("success_ok"), "bootstrap_success_below_threshold"),
        (F.col("bootstrapped") & ~F.col("hits_ok"), "beta_bound_hit_rate_not_strict_quality"),
    )
    return frame.withColumn("issue_type", F.concat_ws(";", found))


def latest_capacity(records: DataFrame) -> DataFrame:
    """The latest valid record of each code; several different ones at that year are a conflict. records: (code, name, year, load, capacity)."""
    year, load, capacity = F.col("year"), F.col("load"), F.col("capacity")
    valid = finite(year) & finite(load) & finite(capacity) & F.coalesce((load >= 0) & (capacity > 0), F.lit(False))
    rows = records.withColumn("valid", valid)
    base = rows.groupBy("code").agg(sorted_pipe(F.col("name")).alias("names"), F.count("*").alias("n_records"), F.count_if("valid").alias("n_valid"), F.max(F.when(F.col("valid"), year)).alias("latest"))
    own = rows.where("valid").select("code", "name", "year", "load", "capacity").distinct()
    last = own.groupBy("code", "year").agg(F.count("*").alias("n_latest"), F.first("load").alias("load"), F.first("capacity").alias("capacity"))
    out = base.join(last.withColumnRenamed("year", "latest"), ["code", "latest"], "left").withColumn("n_latest", F.coalesce("n_latest", F.lit(0)))
    ok = F.col("n_latest") == 1
    ratio = F.when(ok, F.col("load") / F.col("capacity"))
    status = F.when(F.col("n_valid") == 0, "no_valid_capacity_record").when(ok, "valid").otherwise("conflicting_latest_records")
    return out.select("code", "names", "n_records", "n_valid", "n_latest", F.when(ok, F.col("load")).alias("load"), F.when(ok, F.col("capacity")).alias("capacity"), ratio.alias("ratio"), F.when(ok, F.col("latest")).cast("int").alias("data_year"), status.alias("status"), ok.alias("available"), F.coalesce(ratio > 1, F.lit(False)).alias("over_design"), F.coalesce(ratio > 2, F.lit(False)).alias("extreme"), F.coalesce(ok & (F.col("load") == 0), F.lit(False)).alias("zero_load"))


def enrich_capacity(assignments: DataFrame, capacity: DataFrame) -> DataFrame:
    """Capacity joined to assignments (company, code, status, eligible_for_beta), with the reason where there is none."""
    out = assignments.join(capacity.select("company", "code", F.col("status").alias("capacity_status"), F.col("available").alias("capacity_available")), ["company", "code"], "left")
    accepted, blank = F.col("status").isin(*ACCEPTED), F.col("code").isNull() | (F.col("code") == "")
    reason = F.when(~accepted, "not_applicable_assignment_status").when(blank, "missing_accepted_uwwcode").otherwise("missing_company_waterbase_match")
    out = out.withColumn("capacity_status", F.coalesce("capacity_status", reason)).withColumn("capacity_available", F.coalesce("capacity_available", F.lit(False)))
    return out.withColumn("eligible_for_capacity", accepted & F.col("eligible_for_beta") & ~blank & F.col("capacity_available") & (F.col("capacity_status") == "valid"))


def group_beta(frame: DataFrame, *by: str) -> DataFrame:
    """Beta statistics of groups: those of eligible sensors and of all finite positive fits."""
    beta, ok = F.col("beta"), F.col("eligible_for_beta")
    own = F.when(ok, beta)
    some = F.when(finite(beta) & (beta > 0), beta)
    out = frame.groupBy(*by).agg(
        F.countDistinct("sensor").alias("sensors"), F.count_if(ok).alias("primary_n"), F.median(own).alias("primary_median"), F.avg(own).alias("primary_mean"), F.stddev_samp(own).alias("primary_sd"),
        F.percentile(own, F.lit(0.25)).alias("q25"), F.percentile(own, F.lit(0.75)).alias("q75"), F.count(some).alias("finite_n"), F.median(some).alias("finite_median"), F.avg(some).alias("finite_mean"),
    )
    return out.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("few", F.col("primary_n") < 3)


def assignment_status(sensors: DataFrame, relations: DataFrame) -> DataFrame:
    """The spatial assignment of each sensor from its relations.

    sensors: (sensor, eligible); relations: (sensor, kind: within | boundary | other_company, polygon, code or null, n_codes).
    Within decides before the boundary, the boundary before another company's polygon. Overlaps without any code are an
    error, which `unresolved` lists.
    """
    def side(kind: str, name: str) -> DataFrame:
        own = relations.where(F.col("kind") == kind)
        codes = F.array_sort(F.collect_set("code"))
        return own.groupBy("sensor").agg(sorted_pipe(F.col("polygon")).alias(f"{name}_polygons"), F.countDistinct("polygon").alias(f"{name}_n"), F.array_join(codes, "|").alias(f"{name}_codes"), F.size(codes).alias(f"{name}_code_n"), F.min(F.coalesce("n_codes", F.lit(0)) == 1).alias(f"{name}_each"))

    out = sensors
    for kind, name in (("within", "in"), ("boundary", "edge"), ("other_company", "other")):
        out = out.join(side(kind, name), "sensor", "left")
    inside, edge, other = (F.col(f"{n}_n").isNotNull() for n in ("in", "edge", "other"))
    status = (
        F.when(~F.col("eligible"), "not_eligible_for_catchment_matching").when(inside & (F.col("in_n") == 1), "unique_same_company_containment").when(inside & (F.col("in_code_n") == 1), "multiple_same_uwwcode")
        .when(inside, "multiple_different_uwwcodes").when(edge, "boundary_match").when(other, "company_conflict").otherwise("no_catchment_match")
    )
    accepted = status.isin(*ACCEPTED)
    one = F.col("in_code_n") == 1
    review = ~(accepted & F.coalesce(one, F.lit(False)) & (F.coalesce(F.col("in_n") == 1, F.lit(False)) | F.coalesce(F.col("in_each"), F.lit(False))))
    return out.select("sensor", status.alias("status"), F.coalesce(F.col("in_polygons"), F.col("edge_polygons"), F.col("other_polygons"), F.lit("")).alias("polygons"), F.when(accepted & one, F.col("in_codes")).otherwise("").alias("code"), F.coalesce("in_code_n", F.lit(0)).alias("n_codes"), review.alias("review"))


def unresolved(assigned: DataFrame) -> DataFrame:
    return assigned.where((F.col("status") == "multiple_different_uwwcodes") & (F.col("n_codes") == 0))


def link_status(status: Column, code: Column, matched: Column, own_company: Column) -> Column:
    """How a sensor relates to works characteristics; own_company: whether any works of the code is of its company, null where the code is unknown."""
    return (
        F.when(~status.isin(*ACCEPTED), "no_accepted_wwtw_assignment").when(code.isNull() | (F.trim(code) == ""), "uwwcode_missing").when(matched, "matched_wwtw_characteristics")
        .when(own_company == F.lit(False), "company_uwwcode_conflict").otherwise("wwtw_characteristics_not_found")
    )


def environment(assignments: DataFrame, quality: DataFrame, works: DataFrame) -> DataFrame:
    """Sensors with their quality, how they link to works characteristics, those characteristics where accepted, and two eligibilities with all reasons against.

    assignments: (sensor, company, code, status); quality: (sensor, beta, eligible_for_beta); works: (company, code, ...).
    """
    extra = [c for c in works.columns if c not in ("company", "code")]
    known = works.groupBy("code").agg(F.collect_set("company").alias("__companies"))
    out = assignments.join(quality, "sensor", "left").join(works.withColumn("__hit", F.lit(True)), ["company", "code"], "left").join(known, "code", "left")
    link = link_status(F.col("status"), F.col("code"), F.col("__hit").isNotNull(), F.array_contains("__companies", F.col("company")))
    out = out.withColumn("link_status", link)
    ok = F.col("link_status") == "matched_wwtw_characteristics"
    out = out.withColumns({c: F.when(F.col("status").isin(*ACCEPTED), F.col(c)) for c in extra})
    positive, strict = F.coalesce(finite(F.col("beta")) & (F.col("beta") > 0), F.lit(False)), F.coalesce("eligible_for_beta", F.lit(False))
    reasons = F.array_compact(F.array(F.when(~ok, F.col("link_status")), F.when(~positive, "missing_beta"), F.when(~strict, "strict_beta_quality_failed")))
    return out.withColumns({"exploratory": ok & positive, "primary_ok": ok & strict, "exclusion_reasons": F.array_join(reasons, "|")}).drop("__hit", "__companies")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The text of the first rule that holds, else 'eligible'."""
    out = F.lit("eligible")
    for when, text in reversed(rules):
        out = F.when(when, text).otherwise(out)
    return out


def name_decision(frame: DataFrame, threshold: float = 85.0, margin: float = 8.0, near: float = 1000.0) -> DataFrame:
    """The ordered decision on each sensor's chosen candidate.

    frame: core, qualifier, tied, same_core, existing, agrees, score, margin, subset, exact, distance, weak_alias, sensor_ok, works_ok.
    """
    false = F.lit(False)
    spatial = F.coalesce(F.col("distance") <= near, false)
    high, agrees, subset = F.col("score") >= threshold, F.col("agrees"), F.col("subset")
    known = F.coalesce(F.col("existing") != "", false)
    status = (
        F.when(F.col("core") == "", "no_meaningful_place_name").when(F.col("qualifier"), "different_place_name")
        .when(F.col("tied") & F.col("same_core"), "ambiguous_duplicate_place_name").when(F.col("tied"), "ambiguous_multiple_wwtw_candidates")
        .when(known & ~agrees & (high | subset), "name_spatial_conflict").when(F.col("weak_alias") & ~(agrees | spatial), "different_place_name")
        .when(F.col("exact"), "accepted_exact_place_core").when(high & agrees, "accepted_place_core_existing_uwwcode")
        .when(subset & (agrees | spatial), "accepted_place_subset_supported").when(high & spatial, "accepted_place_core_spatial_support").when(high & (F.col("margin") >= margin), "accepted_place_core_85")
        .when(subset & ~F.col("sensor_ok") & ~known, "missing_sensor_coordinates").when(subset & ~F.col("works_ok") & ~agrees, "missing_wwtw_coordinates")
        .when(~high, "different_place_name").otherwise("ambiguous_multiple_wwtw_candidates")
    )
    return frame.withColumn("status", status).withColumn("accepted", F.col("status").startswith("accepted_")).withColumn("evidence", evidence(F.col("status")))


def evidence(status: Column) -> Column:
    return F.when(status == "accepted_exact_place_core", "exact_place_core").when(status == "accepted_place_subset_supported", "place_subset_with_support").when(status.isin("accepted_place_core_existing_uwwcode", "accepted_place_core_spatial_support"), "high_place_core_with_support").otherwise("high_place_core")


def shares(areas: DataFrame, unit: str, kind: str, area: str, total: str, kinds: list[str], slack: float = 1e-6) -> DataFrame:
    """Percent of a unit's area by kind (a pivot over a fixed list, zero filled), the coverage, and the dominant kinds with ties joined."""
    wide = areas.groupBy(unit).pivot(kind, kinds).sum(area).fillna(0.0)
    whole = areas.groupBy(unit).agg(F.first(total).alias("__total"))
    out = wide.join(whole, unit)
    out = out.select(unit, *(F.try_divide(100.0 * F.col(f"`{k}`"), F.col("__total")).alias(f"{k}_pct") for k in kinds))
    most = F.greatest(*(F.col(f"{k}_pct") for k in kinds)) if len(kinds) > 1 else F.col(f"{kinds[0]}_pct")
    names = F.array_sort(F.array_compact(F.array(*(F.when(F.abs(F.col(f"{k}_pct") - most) <= slack, F.lit(k)) for k in kinds))))
    covered = sum((F.col(f"{k}_pct") for k in kinds[1:]), F.col(f"{kinds[0]}_pct"))
    return out.withColumn("dominant", F.when(most > slack, F.array_join(names, "|"))).withColumn("covered_pct", covered)


def coverage_status(coverage: Column, cells: Column, overlap: Column) -> Column:
    return F.when(cells == 0, "no_raster_overlap").when(overlap <= 0, "failed_extraction").when(coverage >= 99.5, "complete").when(coverage >= 95, "minor_nodata").otherwise("substantial_nodata")
