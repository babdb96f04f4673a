"""Dates as the sources write them, calendar windows, and the temporal rules of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """The first ten characters as a date, null if they are none."""
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def iso_timestamp(text: Column) -> Column:
    t = F.regexp_replace(F.trim(text), r"Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def source_date(text: Column) -> Column:
    """Milliseconds in /Date(...)/ (their offset is ignored, the UTC day counts), ISO, then month/day/year."""
    t = F.trim(text)
    ms = F.regexp_extract(t, r"^/Date\((-?\d+)(?:[+-]\d{4})?\)/$", 1)
    days = F.floor(F.nullif(ms, F.lit("")).try_cast("bigint") / 86400000)
    from_ms = F.when(days.between(-719162, 2932896), F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))
    day = lambda p, shape: F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(p)).cast("date"))
    return F.coalesce(from_ms, iso_date(t), day("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), day("M/d/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"))


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Half-open windows [start, end) by calendar month, cut at both ends."""
    if end <= start:
        raise ValueError("end must be after start")
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(s, "MM"), F.date_sub(e, 1), F.expr("interval 1 month"))).alias("m"))
    return months.select(F.greatest("m", s).alias("start"), F.least(F.add_months("m", 1), e).alias("end"))


def chunk_windows(spark: SparkSession, start: str, end: str, months: int) -> DataFrame:
    """Closed windows of some months from the start day on; the day is cut to the month's length."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    most = F.floor(F.months_between(e, s) / months) + 1
    k = spark.range(1).select(F.explode(F.sequence(F.lit(0), most.cast("int"))).alias("k"))
    w = k.select(F.add_months(s, F.col("k") * months).alias("start"), F.least(F.date_sub(F.add_months(s, (F.col("k") + 1) * months), 1), e).alias("end"))
    return w.where(F.col("start") <= e)


def remote_filter(field: str, start: str, end: str) -> str:
    """Predicate text for a source that filters by itself."""
    return f"{field} ge datetime'{start}T00:00:00' and {field} lt datetime'{end}T00:00:00'"


def pre_recall_public(incident: Column, publication: Column, recall: Column) -> Column:
    """Happened and was published before the recall; a missing date is never before."""
    return F.coalesce((incident < recall) & (publication < recall), F.lit(False))


def temporal_status(incident: Column, publication: Column, recall: Column, missing: str = "insufficient_dates") -> Column:
    return (
        F.when(incident.isNull() | publication.isNull() | recall.isNull(), missing)
        .when((incident < recall) & (publication < recall), "pre_recall_public")
        .when(incident < recall, "pre_incident_published_after_recall")
        .otherwise("incident_on_or_after_recall")
    )


def lead_days(recall: Column, evidence: Column) -> Column:
    return F.datediff(recall, evidence)
