"""Services that answer by pages as data sources of Spark: a partition is a window of dates, filters reach the request.

The transport is a function that the caller gives: request parameters in, decoded answer out; it runs in the tasks. Filters
on dates become the windows that are asked for and hold exactly; filters on names go out as a wider condition of the service
and are applied again by Spark. A window that fails after some attempts ends with a row that says so; it fails nothing else."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from ..functions import dates
from . import readers

Fetch = Callable[[dict], object]
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
# Parameters of the incident service, the order in which incidents are asked for, and its date field.
PAGE_SIZE, PAGE_START, PAGE_FILTER, PAGE_ORDER, PAGE_COUNT, PAGE_FORMAT = "$top", "$skip", "$filter", "$orderby", "$inlinecount", "$format"
INCIDENT_ORDER = "IncidentDate asc,IncidentReportNumber asc"
INCIDENT_DATE, INCIDENT_NUMBER = "IncidentDate", "IncidentReportNumber"
# Parameters of the recall service, and the fields of its records that filters speak of.
RECALL_PARAMETERS = {"start_date": "RecallDateStart", "end_date": "RecallDateEnd", "product_name": "ProductName", "hazard": "Hazard"}
RECALL_DATE, RECALL_NAMES = "RecallDate", {"product_name": ("Products", "Name"), "hazard": ("Hazards", "Name")}

DAY = dt.timedelta(days=1)


@dataclass
class Span:
    """Days first .. last, both included; None is open."""

    first: dt.date | None = None
    last: dt.date | None = None

    def narrowed(self, first: dt.date | None = None, last: dt.date | None = None) -> Span:
        lows, highs = [x for x in (self.first, first) if x is not None], [x for x in (self.last, last) if x is not None]
        return Span(max(lows, default=None), min(highs, default=None))

    def holds(self, day: dt.date | None) -> bool:
        if self.first is None and self.last is None:
            return True
        return day is not None and (self.first is None or day >= self.first) and (self.last is None or day <= self.last)

    def cut(self, months: int) -> list[Span]:
        """Pieces of some calendar months; one piece if an end is open, none if the span is empty."""
        if self.first is None or self.last is None:
            return [self]
        out, start = [], self.first
        while start <= self.last:
            ahead = start.year * 12 + start.month - 1 + months
            following = dt.date(ahead // 12, ahead % 12 + 1, 1)
            out.append(Span(start, min(self.last, following - DAY)))
            start = following
        return out


class Bounds:
    """What a query's filters say about one date column, and the words that other columns must hold."""

    def __init__(self, column: str, worded: tuple[str, ...] = ()):
        self.column, self.worded = column, worded
        self.span, self.words = Span(), {}

    def take(self, f: Filter) -> bool:
        """Note a filter; whether it needs no further evaluation."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == self.column:
            if isinstance(f, EqualTo):
                self.span = self.span.narrowed(f.value, f.value)
            elif isinstance(f, GreaterThanOrEqual):
                self.span = self.span.narrowed(first=f.value)
            elif isinstance(f, GreaterThan):
                self.span = self.span.narrowed(first=f.value + DAY)
            elif isinstance(f, LessThanOrEqual):
                self.span = self.span.narrowed(last=f.value)
            elif isinstance(f, LessThan):
                self.span = self.span.narrowed(last=f.value - DAY)
            else:
                return False
            return True
        if name in self.worded and isinstance(f, (EqualTo, StringContains, StringStartsWith, StringEndsWith)) and f.value:
            self.words.setdefault(name, f.value)
        return False


@dataclass
class Ask(InputPartition):
    """One window: its name and condition, how far it is, and what is known of its size."""

    window: dt.date | None
    condition: str | None
    span: Span
    at: int = 0
    page: int = 0
    total: int | None = None


def told(answer: object) -> tuple[list, int | None]:
    """Records and, if it is said, the size of the whole window."""
    if isinstance(answer, dict) and "d" in answer:
        inner = answer["d"]
        return (inner, None) if isinstance(inner, list) else (inner.get("results", []), _number(inner.get("__count")))
    return answer.get("value", []), _number(answer.get("odata.count"))


def _number(x: object) -> int | None:
    return None if x is None else int(x)


def attempted(fetch: Fetch, asked: dict, attempts: int, pause: float) -> object:
    for left in range(attempts - 1, -1, -1):
        try:
            return fetch(asked)
        except Exception:
            if not left:
                raise
            time.sleep(pause)


def pages_of(fetch: Fetch, ask: Ask, size: int, attempts: int, pause: float) -> Iterator[tuple[int, int, list, int | None, object]]:
    """(page, records before it, its records, total if told, answer) from where the window is; services cap the page size,
    so the next page starts after the records that came, not after those that were asked for."""
    at, page, total = ask.at, ask.page, ask.total
    while total is None or at < total:
        asked = {PAGE_FORMAT: "json", PAGE_SIZE: size, PAGE_START: at, PAGE_ORDER: INCIDENT_ORDER}
        if ask.condition:
            asked[PAGE_FILTER] = ask.condition
        if at == 0:
            asked[PAGE_COUNT] = "allpages"
        answer = attempted(fetch, asked, attempts, pause)
        records, now = told(answer)
        records = [r for r in records if isinstance(r, dict)]
        page, total = page + 1, now if total is None else total
        yield page, at, records, now, answer
        if not records:
            return
        at += len(records)


def _day(text: object) -> dt.date | None:
    """Day of an ISO date or of milliseconds in /Date(...)/."""
    text = str(text or "").strip()
    if text.startswith("/Date("):
        digits = text[6:].split(")")[0]
        sign, digits = (-1, digits[1:]) if digits.startswith("-") else (1, digits)
        return dt.date(1970, 1, 1) + dt.timedelta(milliseconds=sign * int(digits.split("+")[0].split("-")[0]))
    try:
        return dt.date.fromisoformat(text[:10])
    except ValueError:
        return None


class _Reader(DataSourceReader):
    def __init__(self, bounds: Bounds):
        self.bounds = bounds

    def pushFilters(self, filters: list[Filter]):
        return [f for f in filters if not self.bounds.take(f)]


PAGES = "window_start date, page long, skip long, n_records long, total long, body string, error string"


def page_source(name: str, fetch: Fetch, asks: list[Ask], size: int, attempts: int, pause: float) -> type[DataSource]:
    """The pages of given windows as they came, one partition for each; a window that fails ends with a row that has the error."""

    class Reader(DataSourceReader):
        def partitions(self):
            return asks

        def read(self, ask):
            if ask is None:
                return
            page, at = ask.page, ask.at
            try:
                for page, at, records, total, answer in pages_of(fetch, ask, size, attempts, pause):
                    yield ask.window, page, at, len(records), total, json.dumps(answer, ensure_ascii=False), None
                    at += len(records)
            except Exception as e:  # whatever the service does: the other windows go on, and this one says where it stopped
                yield ask.window, page + 1, at, None, None, None, f"{type(e).__name__}: {e}"

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return PAGES

        def reader(self, schema):
            return Reader()

    return Source


def incident_source(name: str, fetch: Fetch, size: int = 100, months: int = 1, attempts: int = 3, pause: float = 1.0, within: Span = Span()) -> type[DataSource]:
    """(incident_date, report_number, body): filters on incident_date are the windows that are asked for."""

    class Reader(_Reader):
        def partitions(self):
            span = self.bounds.span
            return [Ask(None, condition(s), s) for s in span.cut(months)]

        def read(self, ask):
            for _, _, records, _, _ in pages_of(fetch, ask, size, attempts, pause) if ask else ():
                for r in records:
                    day = _day(r.get(INCIDENT_DATE))
                    if self.bounds.span.holds(day):
                        yield day, r.get(INCIDENT_NUMBER) and str(r[INCIDENT_NUMBER]), json.dumps(r, ensure_ascii=False)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "incident_date date, report_number string, body string"

        def reader(self, schema):
            bounds = Bounds("incident_date")
            bounds.span = within
            return Reader(bounds)

    return Source


def condition(span: Span) -> str | None:
    """The service's condition for a span of days; its end is exclusive there."""
    if span.first is None and span.last is None:
        return None
    parts = [f"{INCIDENT_DATE} ge datetime'{span.first}T00:00:00'"] * (span.first is not None) + [f"{INCIDENT_DATE} lt datetime'{span.last and span.last + DAY}T00:00:00'"] * (span.last is not None)
    return " and ".join(parts)


def recall_records(payload: object) -> list[dict]:
    """Records of a recall answer: a list, the list or the one record in a known container, or the answer itself."""
    if payload is None:
        return []
    if isinstance(payload, list):
        return payload
    if not isinstance(payload, dict):
        raise ValueError(f"an answer of recalls cannot be {type(payload).__name__}")
    held = next((payload[c] for c in readers.SERVICE_CONTAINERS if isinstance(payload.get(c), (list, dict))), payload)
    return held if isinstance(held, list) else [held]


def _names(record: dict, path: tuple[str, str]) -> str | None:
    held = record.get(path[0])
    names = [str(x[path[1]]) for x in held if isinstance(x, dict) and x.get(path[1])] if isinstance(held, list) else []
    return " | ".join(names) or None


def recall_source(name: str, fetch: Fetch, months: int = 3, attempts: int = 3, pause: float = 1.0, within: Span = Span(), words: dict[str, str] | None = None) -> type[DataSource]:
    """(recall_date, product_name, hazard, body): dates are asked for by windows, names go to the service and are checked again."""

    class Reader(_Reader):
        def partitions(self):
            return [Ask(None, None, s) for s in self.bounds.span.cut(months)]

        def read(self, ask):
            if ask is None:
                return
            asked = {"format": "json"} | {RECALL_PARAMETERS[k]: v for k, v in ({"start_date": ask.span.first and str(ask.span.first), "end_date": ask.span.last and str(ask.span.last)} | self.bounds.words).items() if v}
            for r in recall_records(attempted(fetch, asked, attempts, pause)):
                day = _day(r.get(RECALL_DATE))
                if ask.span.holds(day):
                    yield day, *(_names(r, p) for p in RECALL_NAMES.values()), json.dumps(r, ensure_ascii=False)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "recall_date date, product_name string, hazard string, body string"

        def reader(self, schema):
            bounds = Bounds("recall_date", tuple(RECALL_NAMES))
            bounds.span, bounds.words = within, dict(words or {})
            return Reader(bounds)

    return Source


def opened(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    """The source as a frame; filters on it go to the service."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


def incidents(spark: SparkSession, fetch: Fetch, **options) -> DataFrame:
    return opened(spark, incident_source("paged_incidents", fetch, **options))


def recalls(spark: SparkSession, fetch: Fetch, **options) -> DataFrame:
    return opened(spark, recall_source("windowed_recalls", fetch, **options))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """The landed pages, each once: two runs at the same time may have brought one twice."""
    pages = spark.read.schema(PAGES).parquet(f"{root}/pages").where("error is null")
    return pages.dropDuplicates(["window_start", "skip"])


def landed(pages: DataFrame) -> DataFrame:
    """(window_start, records, total, last_page, least): what is there of each window; the first total that was told holds."""
    first = F.min_by("total", F.when(F.col("total").isNotNull(), F.col("page")))
    return pages.groupBy("window_start").agg(F.sum("n_records").alias("records"), first.alias("total"), F.max("page").alias("last_page"), F.min("n_records").alias("least"))


def unfinished(windows: DataFrame, state: DataFrame) -> DataFrame:
    """Windows (window_start, filter) that are not wholly there, with how far they are."""
    out = windows.join(state, "window_start", "left")
    done = F.coalesce(F.col("records") >= F.col("total"), F.lit(False)) | F.coalesce(F.col("least") == 0, F.lit(False))
    return out.where(~done).select("window_start", "filter", F.coalesce("records", F.lit(0)).alias("skip"), "total", F.coalesce("last_page", F.lit(0)).alias("last_page"))


def land(spark: SparkSession, windows: DataFrame, root: str, fetch: Fetch, size: int = 100, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """Fetch what is missing of windows (window_start, filter) and give (window_start, records, total, complete, error) of each.

    A window is one task, and its pages are committed when the task ends (the second algorithm of the file committer moves a
    task's files to their place at once): neither a failing service nor a job that breaks off loses other windows' pages, and
    the next run asks only for the rest. A task that is tried again writes over what it has written. The windows, one for each
    month or so, are the only thing the driver holds."""
    if size < 1:
        raise ValueError("a page holds at least one record")
    target = f"{root}/pages"
    there = read_pages(spark, root) if _exists(spark, target) else spark.createDataFrame([], PAGES)
    todo = unfinished(windows, landed(there)).orderBy("window_start").collect()
    failed = spark.createDataFrame([], "window_start date, error string")
    if todo:
        asks = [Ask(w["window_start"], w["filter"], Span(), w["skip"], w["last_page"], w["total"]) for w in todo]
        source = page_source("landing_pages", fetch, asks, size, attempts, pause)
        run = str(time.time_ns())
        opened(spark, source).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{target}/run={run}")
        failed = spark.read.schema(PAGES).parquet(f"{target}/run={run}").where("error is not null").select("window_start", "error")
    state = landed(read_pages(spark, root)) if _exists(spark, target) else landed(there)
    out = windows.select("window_start").join(state, "window_start", "left").join(failed, "window_start", "left")
    complete = F.coalesce(F.col("records") >= F.col("total"), F.lit(False)) | F.coalesce(F.col("least") == 0, F.lit(False))
    return out.select("window_start", F.coalesce("records", F.lit(0)).alias("records"), "total", complete.alias("complete"), "error")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def month_asks(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(window_start, filter) of the calendar months of a half-open range."""
    months = dates.month_windows(spark, start, end)
    bound = lambda c: F.concat(F.lit("datetime'"), F.col(c).cast("string"), F.lit("T00:00:00'"))
    return months.select(F.col("start").alias("window_start"), F.concat(F.lit(f"{INCIDENT_DATE} ge "), bound("start"), F.lit(f" and {INCIDENT_DATE} lt "), bound("end")).alias("filter"))
