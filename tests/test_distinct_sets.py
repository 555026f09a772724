"""Distinct counts from merged bitmaps against plain sets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from demandweave.operators import distinct_sets as DS
from demandweave.operators import quality as Q


def rows(spark, seed=1, n=4000):
    rng, start = random.Random(seed), dt.date(2020, 12, 1)
    out = []
    for _ in range(n):
        who = "hot" if rng.random() < 0.34 else f"k{rng.randrange(600)}"
        number = rng.choice([rng.randrange(100), rng.randrange(200_000), 2**40 + rng.randrange(5), -rng.randrange(1, 50), 0])
        out.append((start + dt.timedelta(rng.randrange(90)), who if rng.random() < 0.97 else None, number))
    return out, spark.createDataFrame(out, "day date, who string, number long")


def expected(data, period):
    names, numbers = {}, {}
    for day, who, number in data:
        names.setdefault(period(day), set()).add(who)
        numbers.setdefault(period(day), set()).add(number)
    return {p: (len(names[p] - {None}), len(numbers[p])) for p in names}


def test_days_months_and_years(spark):
    data, df = rows(spark)
    sets = Q.union_all([DS.day_sets(df, ["day"], "who", "Who", DS.key_ids(df, "who")), DS.day_sets(df, ["day"], "number", "Number")])
    month = DS.roll_up(sets, {"p": F.trunc("day", "month")})
    year = DS.roll_up(month, {"p": F.trunc("p", "year")})
    whole = DS.roll_up(year, [])
    for df, column, period in ((sets, "day", lambda d: d), (month, "p", lambda d: d.replace(day=1)), (year, "p", lambda d: d.replace(month=1, day=1))):
        got = {r[0]: (r["Who"], r["Number"]) for r in DS.set_sizes(df, [column], ["Who", "Number"]).collect()}
        assert got == expected(data, period)
    one = DS.set_sizes(whole, [], ["Who", "Number", "Nothing"]).first()
    assert (one["Who"], one["Number"]) == expected(data, lambda d: 0)[0] and one["Nothing"] == 0


def test_any_grouping_of_parts_gives_the_same_set(spark):
    data, df = rows(spark, 2)
    ids = DS.key_ids(df, "who")
    parts = [DS.day_sets(df.where(F.crc32(F.col("number").cast("string")) % 3 == i), ["day"], "who", "Who", ids) for i in range(3)]
    merged = DS.roll_up(Q.union_all(parts), ["day"])
    got = {r["day"]: r["Who"] for r in DS.set_sizes(merged, ["day"], ["Who"]).collect()}
    assert got == {d: n for d, (n, _) in expected(data, lambda d: d).items()}


def test_ids_stay_when_keys_are_added(spark):
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "who string")
    first = DS.key_ids(frame(["b", "a", None, "b", ""]), "who")
    known = {r["key"]: r["id"] for r in first.collect()}
    assert sorted(known.values()) == [1, 2, 3] and set(known) == {"a", "b", ""}
    more = {r["key"]: r["id"] for r in DS.key_ids(frame(["z", "a", "c", "0"]), "who", first).collect()}
    assert {k: more[k] for k in known} == known and sorted(more.values()) == [1, 2, 3, 4, 5, 6]
    again = {r["key"]: r["id"] for r in DS.key_ids(frame(["a", None]), "who", first).collect()}
    assert again == known
    assert DS.key_ids(frame([]), "who").count() == 0


def test_overlaps(spark):
    data, df = rows(spark, 3, 1500)
    number = F.year("day") * 12 + F.month("day")
    months = DS.roll_up(DS.day_sets(df, ["day"], "who", "Who", DS.key_ids(df, "who")), {"m": number})
    sets = {}
    for day, who, _ in data:
        if who is not None:
            sets.setdefault(day.year * 12 + day.month, set()).add(who)
    for step in (1, 2):
        got = {r["m"]: (r["size"], r["kept"]) for r in DS.overlap_sizes(months, "m", step, "Who").collect()}
        assert got == {m: (len(s), len(s & sets.get(m - step, set()))) for m, s in sets.items()}


def test_sparse_numbers_take_several_rows(spark):
    df = spark.createDataFrame([(1, n) for n in (1, 32768, 32769, 65536, 10**12)], "p int, n long")
    sets = DS.day_sets(df, ["p"], "n", "N")
    assert sets.count() == 3 and sets.agg(F.max(F.length("ids"))).first()[0] == 4096
    assert DS.set_sizes(sets, ["p"], ["N"]).first()["N"] == 5
    nothing = DS.day_sets(df.where("n is null"), ["p"], "n", "N")
    assert nothing.count() == 0 and DS.set_sizes(nothing, ["p"], ["N"]).count() == 0
    with pytest.raises(KeyError):
        DS.key_ids(df, "absent")
