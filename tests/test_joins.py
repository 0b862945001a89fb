"""Joins without an equality of their own, against loops over all pairs."""

import random

from pyspark.sql import functions as F

from placeworks.operators import joins as J


def test_contained_strings(spark):
    """Parts shorter than the gram, repeated ones, ones that nothing holds, and many with a common beginning."""
    rng = random.Random(1)
    wholes = ["tokyo" + "".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(80)] + ["", "ab", "x"]
    parts = ["tokyo" + "".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(40)] + ["a", "ab", "abc", "kyoa", "zzzz", "", "x", "x"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs] + [(None,)], "text string")
    got = sorted((r["whole"], r["part"]) for r in J.contained_in(frame(wholes), frame(parts)).collect())
    assert got == sorted({(w, p) for w in wholes for p in parts if p and p in w})


def test_addresses_and_names(spark):
    rng = random.Random(2)
    left = [(k, "osaka" + "".join(rng.choice("12-") for _ in range(rng.randrange(6)))) for k in range(60)] + [(90, "ab"), (91, None)]
    right = [(100 + k, "osaka" + "".join(rng.choice("12-") for _ in range(rng.randrange(4)))) for k in range(30)] + [(190, "b"), (90, "ab"), (191, "")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, address string")
    got = sorted((r["a"], r["b"]) for r in J.containing_addresses(frame(left), frame(right)).collect())
    assert got == sorted((a, b) for a, x in left for b, y in right if a != b and x and y and (x in y or y in x))
    queries = ["Cafe Alpha namba", "alphabet", "b e", "none"]
    names = ["ALPHA", "be", "c", "namba"]
    found = J.names_in_queries(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r["query"] for r in found.collect()} == {"Cafe Alpha namba", "alphabet", "b e"}


def test_windows_in_slots(spark):
    rng = random.Random(3)
    windows = [(k, k % 7, s := rng.randrange(1440), min(1440, s + rng.randrange(200))) for k in range(150)]
    instants = [(k, rng.randrange(7), rng.randrange(1440)) for k in range(200)]
    got = sorted((r["n"], r["shop_id"]) for r in J.within_windows(spark.createDataFrame(instants, "n long, weekday int, minute int"), spark.createDataFrame(windows, "shop_id long, weekday int, opens int, closes int")).collect())
    assert got == sorted((n, w) for n, d, m in instants for w, e, s, c in windows if d == e and s <= m < c)


def test_windows_of_a_key(spark):
    """Slots of a day find the same as short ones, and exploded windows, of which Spark knows no size, are not broadcast."""
    rng = random.Random(4)
    windows = spark.createDataFrame([(k % 9, k % 3, s := rng.randrange(1440), rng.randrange(s, 1441)) for k in range(150)], "shop_id long, weekday int, opens int, closes int")
    instants = spark.createDataFrame([(k, k % 11, rng.randrange(3), rng.randrange(1440)) for k in range(200)], "n long, shop_id long, weekday int, minute int")
    found = [J.within_windows(instants, windows, m, keys=("shop_id",)) for m in (30, 1440)]
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect())) and found[0].count() > 100
    for df in (*found, J.within_windows(instants.drop("shop_id"), windows)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_grams_are_not_broadcast(spark):
    """Exploded substrings are many times the strings that Spark goes by; of the joins of E24 none of them is sent to the driver."""
    frame = lambda p: spark.range(50).select("id", F.concat(F.lit(p), "id").alias("address"))
    plan = J.containing_addresses(frame("street1"), frame("street"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
