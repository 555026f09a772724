"""Fixed-width files by position: round trips, ranges, broken files, files beyond 2 GiB."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from demandweave.sources import fixedwidth, landing

D = dt.date
SHAPE = "NAME string, QTY int, RATE double, DAY date, DONE boolean, SOURCE_MONTH string, gone boolean"
ROWS = [("a", 1, 0.1, D(2018, 1, 2), True, "JAN-18", False), ("é ñ", -7, 1e-300, D(1999, 12, 31), False, "JAN-18", None),
        (None, None, None, None, None, "FEB-18", False), ("x" * 255, 2**31 - 1, -1.7976931348623157e308, D(2020, 2, 29), True, "FEB-18", False),
        ("lost", 0, 0.0, D(2018, 1, 1), False, "JAN-18", True)]
KEPT = sorted((r[:6] for r in ROWS if not r[6]), key=str)


def read(spark, root, **options):
    df = landing.read_binary_table(spark, root, "T", **options)
    df = df.select("NAME", F.col("QTY").cast("int").alias("QTY"), "RATE", "DAY", "DONE", "SOURCE_MONTH")
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(spark, root, rows=ROWS, **options):
    return fixedwidth.write_binary_table(spark.createDataFrame(rows, SHAPE).repartition(3), root, "T.DAT", deleted="gone", **options)


def test_round_trip(spark, tmp_path):
    done = {r["SOURCE_MONTH"]: r["records"] for r in write(spark, f"{tmp_path}/a").collect()}
    assert done == {"JAN-18": 3, "FEB-18": 2}
    assert read(spark, f"{tmp_path}/a") == read(spark, f"{tmp_path}/a", range_bytes=1) == read(spark, f"{tmp_path}/a", seek=False) == KEPT
    assert not glob.glob(f"{tmp_path}/a/*/T.DAT/_*")
    one = landing.read_binary_table(spark, f"{tmp_path}/a", "T", month="FEB-18")
    assert one.count() == 2 and one.columns[-1] == "SOURCE_MONTH"


def test_parts_are_bounded(spark, tmp_path):
    rows = [(f"n{i}", i, i / 7, D(2018, 1, 1), i % 2 == 0, "JAN-18", False) for i in range(300)]
    done = write(spark, f"{tmp_path}/b", rows, part_bytes=1000, widths={"NAME": 8}).first()
    paths = glob.glob(f"{tmp_path}/b/JAN-18/T.DAT/part-*")
    assert done["files"] == len(paths) > 10 and done["records"] == 300
    assert max(map(os.path.getsize, paths)) < 1400
    assert read(spark, f"{tmp_path}/b", range_bytes=100) == sorted((r[:6] for r in rows), key=str)
    write(spark, f"{tmp_path}/b", rows, part_bytes=1000, widths={"NAME": 8})  # a second run replaces its parts
    assert len(read(spark, f"{tmp_path}/b")) == 300


def test_what_the_layout_cannot_hold(spark, tmp_path):
    root = f"{tmp_path}/c"
    df = spark.createDataFrame([("abc", "JAN-18")], "NAME string, SOURCE_MONTH string")
    for bad, message in ((df.withColumnRenamed("NAME", "N" * 11), "names end"), (df.withColumn("X", F.array(F.lit(1))), "no type"),
                         (df.withColumn("NAME", F.repeat("NAME", 100)), "255")):
        with pytest.raises(ValueError, match=message):
            fixedwidth.write_binary_table(bad, root, "T.DAT")
    for bad in (df.withColumn("SOURCE_MONTH", F.lit(None).cast("string")), df.withColumn("NAME", F.lit("日"))):
        with pytest.raises(Exception, match="SOURCE_MONTH|latin-1"):
            fixedwidth.write_binary_table(bad, root, "T.DAT")
    with pytest.raises(Exception, match="wider than 2"):
        fixedwidth.write_binary_table(df, root, "T.DAT", {"NAME": 2})
    assert fixedwidth.write_binary_table(df.limit(0), root, "T.DAT").count() == 0


def test_cut_and_empty_files(spark, tmp_path):
    folder = tmp_path / "JAN-18"
    folder.mkdir()
    fields = [("NAME", "C", 4)]
    whole = fixedwidth.header_bytes(fields, 3) + b" aaaa bbbb cccc"
    (folder / "T.DAT").write_bytes(whole[:-2])
    assert [r["NAME"] for r in landing.read_binary_table(spark, str(tmp_path), "T").collect()] == ["aaaa", "bbbb"]
    (folder / "T.DAT").write_bytes(fixedwidth.header_bytes(fields, 0))
    assert landing.read_binary_table(spark, str(tmp_path), "T").collect() == []
    (folder / "T.DAT").write_bytes(b"\3\0")
    with pytest.raises(Exception, match="no header"):
        landing.read_binary_table(spark, str(tmp_path), "T").collect()


def test_a_file_beyond_two_gib(spark, tmp_path):
    folder = tmp_path / "JAN-18"
    folder.mkdir()
    fields = [("NAME", "C", 10)] + [(f"F{i}", "C", 255) for i in range(200)]
    record, records = 1 + 10 + 200 * 255, 45_000
    head = fixedwidth.header_bytes(fields, records)
    with open(folder / "T.DAT", "wb") as f:  # a sparse file: it takes up next to nothing
        f.write(head)
        for n in (0, 44_000, records - 1):
            f.seek(len(head) + n * record)
            f.write(b" " + str(n).encode().ljust(10))
        f.truncate(len(head) + records * record)
    assert os.path.getsize(folder / "T.DAT") > 2**31
    df = landing.read_binary_table(spark, str(tmp_path), "T", schema=landing.T.StructType().add("NAME", "string"))
    assert sorted(r[0] for r in df.where("NAME is not null").collect()) == ["0", "44000", "44999"]


def test_no_record_is_shuffled(spark, tmp_path):
    write(spark, f"{tmp_path}/d")
    plan = landing.read_binary_table(spark, f"{tmp_path}/d", "T")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert fixedwidth.open_system("file:/a b/c")[1] == fixedwidth.open_system("file:///a b/c")[1] == "/a b/c"
