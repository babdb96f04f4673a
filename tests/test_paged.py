"""Paged services: windows that go on after a failure, filters that reach the request."""

import datetime as dt
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

from skeinwork.sources import paged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests
DAY = dt.date(2020, 1, 1)


def service(log, per_month=40, cap=15, broken=()):
    """Incidents of each month, `cap` at most a page; says how many only on the first page. broken: conditions that fail after the first page."""

    def fetch(params):
        with open(log, "a") as f:
            f.write(json.dumps(params) + "\n")
        cond, at = params.get("$filter") or "", params["$skip"]
        if cond in broken and at:
            raise OSError("gone")
        n = 0 if cond == "none" else per_month
        rows = [{"IncidentReportNumber": f"{cond}-{i}", "IncidentDate": f"2020-{1 + i % 3:02d}-05"} for i in range(at, min(n, at + min(cap, params["$top"])))]
        return {"d": {"results": rows} | ({"__count": str(n)} if "$inlinecount" in params else {})}

    return fetch


def asked(log):
    return [json.loads(x) for x in Path(log).read_text().splitlines()] if Path(log).exists() else []


def months(spark, *conditions):
    return spark.createDataFrame([(dt.date(2020, 1 + i, 1), c) for i, c in enumerate(conditions)], "window_start date, filter string")


def pages(spark, root):
    return sorted((r.window_start.month, r.page, r.skip, r.n_records) for r in paged.read_pages(spark, root).collect())


WHOLE = [(1, 0, 15), (2, 15, 15), (3, 30, 10)]


def test_a_failing_window_leaves_the_others(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "in")
    windows = months(spark, "a", "b", "none")
    state = {r.window_start.month: r for r in paged.land(spark, windows, root, service(log, broken={"b"}), attempts=2, pause=0).collect()}
    assert state[1].complete and state[1].records == 40 and state[3].complete and state[3].records == 0
    assert not state[2].complete and state[2].records == 15 and state[2].total == 40 and state[2].error == "OSError: gone"
    assert sum(p["$filter"] == "b" and p["$skip"] == 15 for p in asked(log)) == 2
    before = len(asked(log))
    state = paged.land(spark, windows, root, service(log), pause=0).collect()
    assert all(r.complete and r.error is None for r in state)
    assert [(p["$filter"], p["$skip"]) for p in asked(log)[before:]] == [("b", 15), ("b", 30)] and "$inlinecount" not in asked(log)[-1]
    assert pages(spark, root) == [(1, *w) for w in WHOLE] + [(2, *w) for w in WHOLE] + [(3, 1, 0, 0)]
    before = len(asked(log))
    paged.land(spark, windows, root, service(log), pause=0).collect()
    assert len(asked(log)) == before  # all there: nothing is asked


def test_a_job_that_breaks_off_keeps_the_windows_that_ended(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "in")
    whole = service(log)

    def dies(params):
        if params["$filter"] == "b":
            while not any(p["$filter"] == "a" and p["$skip"] == 30 for p in asked(log)):
                pass
            import time

            time.sleep(3)
            os._exit(1)
        return whole(params)

    with pytest.raises(Exception, match="aborted|failed|crashed|Python worker"):
        paged.land(spark, months(spark, "a", "b"), root, dies, pause=0)
    assert pages(spark, root) == [(1, *w) for w in WHOLE]
    before = len(asked(log))
    assert all(r.complete for r in paged.land(spark, months(spark, "a", "b"), root, whole, pause=0).collect())
    assert {p["$filter"] for p in asked(log)[before:]} == {"b"} and pages(spark, root) == [(m, *w) for m in (1, 2) for w in WHOLE]


RETRIED = """
import os, sys
sys.path[:0] = [{here!r}, {root!r}]
from pyspark.sql import SparkSession
from tests.test_paged import service, months, pages, WHOLE
from skeinwork.sources import paged
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
whole = service({log!r})
def fetch(params):
    if params["$skip"] == 15 and not os.path.exists({mark!r}):
        open({mark!r}, "w").close()
        os._exit(1)
    return whole(params)
state = paged.land(spark, months(spark, "a"), {out!r}, fetch, pause=0).collect()
assert [r.records for r in state] == [40] and pages(spark, {out!r}) == [(1, *w) for w in WHOLE], state
print("ONCE")
"""


def test_a_task_that_is_tried_again(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = RETRIED.format(here=str(root / "tests"), root=str(root), log=str(tmp_path / "log"), mark=str(tmp_path / "mark"), out=str(tmp_path / "out"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=root, env=os.environ | {"PYTHONPATH": f"{root}"})
    assert "ONCE" in done.stdout, done.stderr[-2000:]
    assert sum(p["$skip"] == 0 for p in asked(str(tmp_path / "log"))) == 2


def test_total_is_not_told_or_page_is_capped(spark, tmp_path):
    """Without a total a window ends with an empty page."""
    log = str(tmp_path / "log")

    def fetch(params):
        with open(log, "a") as f:
            f.write(json.dumps(params) + "\n")
        return {"value": [{"k": i} for i in range(params["$skip"], min(7, params["$skip"] + 3))]}

    r = paged.land(spark, months(spark, "x"), str(tmp_path / "o"), fetch, pause=0).first()
    assert (r.records, r.total, r.complete) == (7, None, True) and [p["$skip"] for p in asked(log)] == [0, 3, 6, 7]
    with pytest.raises(ValueError):
        paged.land(spark, months(spark, "x"), str(tmp_path / "o"), fetch, size=0)


def test_incident_filters_are_windows(spark, tmp_path):
    log = str(tmp_path / "log")
    d = paged.incidents(spark, service(log, 6), pause=0).where("incident_date >= date'2020-01-03' and incident_date < date'2020-03-01' and report_number like '%-1'")
    plan = d._sc._jvm.PythonSQLUtils.explainString(d._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(incident_date" in plan and "LessThan(incident_date" in plan
    rows = d.collect()
    assert {p["$filter"] for p in asked(log)} == {"IncidentDate ge datetime'2020-01-03T00:00:00' and IncidentDate lt datetime'2020-02-01T00:00:00'", "IncidentDate ge datetime'2020-02-01T00:00:00' and IncidentDate lt datetime'2020-03-01T00:00:00'"}
    assert len(rows) == 2 and all(r.report_number.endswith("-1") and r.incident_date.month < 3 for r in rows)
    assert paged.incidents(spark, service(log, 6), pause=0).count() == 6 and "$filter" not in asked(log)[-1]
    assert paged.incidents(spark, service(log, 6), pause=0).where("incident_date > date'2020-02-01' and incident_date < date'2020-01-01'").count() == 0


def recall_service(log):
    held = [{"RecallID": i, "RecallDate": f"2021-{i:02d}-15T00:00:00", "Products": [{"Name": f"Lamp {i}"}, {"Name": "Cord"}], "Hazards": [{"Name": "Fire" if i % 2 else "fire"}]} for i in range(1, 13)]

    def fetch(params):
        with open(log, "a") as f:
            f.write(json.dumps(params) + "\n")
        lo, hi = params.get("RecallDateStart", ""), params.get("RecallDateEnd", "9")
        return {"Recalls": [r for r in held if lo <= r["RecallDate"][:10] <= hi and params.get("Hazard", "").lower() in r["Hazards"][0]["Name"].lower()]}

    return fetch


def test_recall_filters_reach_the_request(spark, tmp_path):
    log = str(tmp_path / "log")
    d = paged.recalls(spark, recall_service(log), pause=0).where("recall_date between date'2021-02-01' and date'2021-07-31' and hazard = 'Fire' and product_name like '%Lamp%'")
    assert sorted(r.recall_date.month for r in d.collect()) == [3, 5, 7]
    assert sorted((p["RecallDateStart"], p["RecallDateEnd"]) for p in asked(log)) == [("2021-02-01", "2021-04-30"), ("2021-05-01", "2021-07-31")]
    assert all(p["Hazard"] == "Fire" and p["ProductName"] == "Lamp" and p["format"] == "json" for p in asked(log))
    assert paged.recalls(spark, recall_service(log), pause=0).count() == 12 and asked(log)[-1] == {"format": "json"}


def test_recall_answers():
    for payload, n in ((None, 0), ([{"a": 1}, {"a": 2}], 2), ({"Recalls": [{"a": 1}]}, 1), ({"recall": {"a": 1}}, 1), ({"a": 1}, 1)):
        assert len(paged.recall_records(payload)) == n
    with pytest.raises(ValueError):
        paged.recall_records("text")


def test_days_and_spans():
    assert paged._day("/Date(1577836800000-0500)/") == DAY and paged._day("2020-01-01T10:00") == DAY and paged._day("soon") is None and paged._day("/Date(-86400000)/") == dt.date(1969, 12, 31)
    cut = paged.Span(dt.date(2020, 11, 20), dt.date(2021, 3, 2)).cut(3)
    assert [(s.first.isoformat(), s.last.isoformat()) for s in cut] == [("2020-11-20", "2021-01-31"), ("2021-02-01", "2021-03-02")]
    assert paged.Span(DAY, DAY - paged.DAY).cut(1) == []


def test_month_asks(spark):
    rows = paged.month_asks(spark, "2020-01-15", "2020-03-01").orderBy("window_start").collect()
    assert [r["filter"] for r in rows] == ["IncidentDate ge datetime'2020-01-15T00:00:00' and IncidentDate lt datetime'2020-02-01T00:00:00'", "IncidentDate ge datetime'2020-02-01T00:00:00' and IncidentDate lt datetime'2020-03-01T00:00:00'"]
