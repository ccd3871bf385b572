"""Daily series: completeness, runs that gaps break, rolling windows, annual indices, year eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WET = 1.0


def daily_from_hours(hours: DataFrame) -> DataFrame:
    """(place, date, mm, complete): a day is complete with 24 finite hours of 12 samples each. hours: (place, date, hour, mm, samples, source_samples)."""
    ok = (F.col("samples") == 12) & (F.col("source_samples") == 12) & F.coalesce(~F.isnan("mm") & (F.abs("mm") < float("inf")), F.lit(False))
    out = hours.groupBy("place", "date").agg((F.count_if(ok) == 24).alias("some"), F.count("*").alias("n"), F.sum("mm").alias("mm"))
    complete = F.col("some") & (F.col("n") == 24)
    return out.select("place", "date", F.when(complete, F.col("mm")).alias("mm"), complete.alias("complete"))


def runs(days: DataFrame, wet: float = WET) -> DataFrame:
    """(place, year, cwd, cdd): the longest runs of wet and dry days among consecutive complete days of one year."""
    own = days.where("complete").select("place", "date", (F.col("mm") >= wet).alias("wet"), F.year("date").alias("year"))
    w = Window.partitionBy("place", "year", "wet").orderBy("date")
    island = own.withColumn("island", F.date_sub("date", F.row_number().over(w)))
    lengths = island.groupBy("place", "year", "wet", "island").agg(F.count("*").alias("n"))
    return lengths.groupBy("place", "year").agg(F.coalesce(F.max(F.when(F.col("wet"), F.col("n"))), F.lit(0)).alias("cwd"), F.coalesce(F.max(F.when(~F.col("wet"), F.col("n"))), F.lit(0)).alias("cdd"))


def five_day(days: DataFrame) -> DataFrame:
    """(place, year, rx5): the largest sum of five consecutive complete days of one year."""
    own = days.where("complete").select("place", F.year("date").alias("year"), F.unix_date("date").alias("d"), "mm")
    w = Window.partitionBy("place", "year").orderBy("d").rangeBetween(-4, 0)
    out = own.withColumn("n", F.count("*").over(w)).withColumn("s", F.sum("mm").over(w))
    return out.groupBy("place", "year").agg(F.max(F.when(F.col("n") == 5, F.col("s"))).alias("rx5"))


def annual(days: DataFrame) -> DataFrame:
    """The annual indices of complete days; days that are missing are never dry."""
    mm = F.when(F.col("complete"), F.col("mm"))
    base = days.groupBy("place", F.year("date").alias("year")).agg(
        F.count_if("complete").alias("complete_days"), F.coalesce(F.sum(F.when(mm >= WET, mm)), F.lit(0.0)).alias("prcptot"), F.max(mm).alias("rx1"),
        F.try_divide(F.sum(F.when(mm >= WET, mm)), F.count_if(mm >= WET)).alias("sdii"), F.count_if(mm >= 10).alias("r10"), F.count_if(mm >= 20).alias("r20"),
    )
    return base.join(five_day(days), ["place", "year"], "left").join(runs(days), ["place", "year"], "left")


def year_quality(years: DataFrame, least: float = 0.95) -> DataFrame:
    """Eligibility of a place's year: the monitoring interval [first, last] covers it and enough of its days are complete."""
    start, end = F.make_timestamp_ntz(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp_ntz(F.col("year"), F.lit(12), F.lit(31), F.lit(23), F.lit(55), F.lit(0))
    length = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    full = (F.col("first").cast("timestamp_ntz") <= start) & (F.col("last").cast("timestamp_ntz") >= end)
    out = years.withColumn("coverage", F.col("complete_days") / length).withColumn("full_year", F.coalesce(full, F.lit(False)))
    out = out.withColumn("eligible", F.col("full_year") & (F.col("coverage") >= least))
    return out.withColumn("flag", F.when(F.col("eligible"), "valid_complete_year").when(~F.col("full_year"), "incomplete_monitoring_year").otherwise("insufficient_radar_coverage"))


def multi_year(annual_: DataFrame, indices: list[str]) -> DataFrame:
    """Means over a place's eligible years, their count, first and last, and a label."""
    out = annual_.where("eligible").groupBy("place").agg(*(F.avg(c).alias(c) for c in indices), F.count("*").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return out.withColumn("label", F.when(F.col("n_years") >= 3, "strong_3plus_complete_years").when(F.col("n_years") >= 2, "usable_2_complete_years").otherwise("limited_1_complete_year"))


def inventory(days: DataFrame) -> DataFrame:
    """Median, least and most complete days of the places of each year."""
    own = days.groupBy("place", F.year("date").alias("year")).agg(F.count_if("complete").alias("n"))
    return own.groupBy("year").agg(F.median("n").alias("median_days"), F.min("n").alias("min_days"), F.max("n").alias("max_days"))
