"""Documents of several runs whose fields change."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandweave.sources.documents import DocumentStore

FIRST = [("7", 1.5, dt.date(2020, 1, 2)), ("8", None, None)]


def store(spark, tmp_path):
    s = DocumentStore(spark, f"{tmp_path}/alerts")
    s.write(spark.createDataFrame(FIRST, "id string, value double, day date"), "2020-01")
    return s


def test_fields_added_in_a_later_run(spark, tmp_path):
    s = store(spark, tmp_path)
    later = spark.createDataFrame([("9", "OPEN", [1, 2], 3)], "id string, status string, tags array<int>, `a.b` int")
    s.write(later, "2020-02")
    got = sorted(map(tuple, s.load("id string, value double, day date, status string, tags array<int>, `a.b` int").collect()))
    assert got == [("2020-01", "7", 1.5, dt.date(2020, 1, 2), None, None, None), ("2020-01", "8", None, None, None, None, None),
                   ("2020-02", "9", None, None, "OPEN", [1, 2], 3)]
    assert [tuple(r) for r in s.latest("id string").collect()] == [("2020-02", "9")]
    assert s.runs() == ["2020-01", "2020-02"]
    assert s.load("id string", ["2020-01"]).count() == 2
    kinds = {r["run"]: r["schema"] for r in s.fields().collect()}
    assert "value: D" in kinds["2020-01"] and "status: STRING" in kinds["2020-02"]


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    s = store(spark, tmp_path)
    s.write(spark.createDataFrame(FIRST[:1], "id string, value double, day date"), "2020-01")
    assert s.load("id string").count() == 1


def test_values_that_do_not_fit(spark, tmp_path):
    s = store(spark, tmp_path)
    s.write(spark.createDataFrame([("9", "much")], "id string, value string"), "2020-02")
    assert {r["id"]: r["value"] for r in s.load("id string, value double").collect()} == {"7": 1.5, "8": None, "9": None}
    with pytest.raises(Exception, match="VARIANT|cast"):
        s.load("value double", strict=True).collect()


def test_nothing_stored_empty_runs_and_bad_names(spark, tmp_path):
    s = DocumentStore(spark, f"{tmp_path}/none")
    assert s.runs() == [] and s.load("id string").count() == 0 and s.latest("id string").columns == ["run", "id"]
    df = spark.createDataFrame(FIRST, "id string, value double, day date")
    s.write(df.limit(0), "r1")
    assert s.runs() == ["r1"] and s.latest("id string").count() == 0
    for name in ("", "../x", "a/b", "_x", "a b"):
        with pytest.raises(ValueError):
            s.write(df, name)
    with pytest.raises(FileNotFoundError):
        s.load("id string", ["r2"])
    (tmp_path / "none" / "run=r9").mkdir()  # a write that did not end
    assert s.runs() == ["r1"]
