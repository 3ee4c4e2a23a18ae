"""Ranks, running totals and neighbours against pandas, with one key that holds a third of the rows."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipalign.operators import ordering as o


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(np.arange(n) % 3 == 0, "hot", np.char.add("k", (rng.integers(0, 40, n)).astype(str)))
    value = rng.integers(0, 25, n).astype(float)
    value[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"id": np.arange(n), "key": key, "value": value})


@pytest.fixture(scope="module")
def table(spark, frame):
    rows = [(int(i), str(k), None if np.isnan(v) else float(v)) for i, k, v in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "id long, key string, value double").repartition(5)


def test_row_numbers_by_group(table, frame):
    got = {r["id"]: r["rank"] for r in o.row_numbers(table, [F.col("value").desc(), F.col("id")], ["key"]).collect()}
    ordered = frame.sort_values(["value", "id"], ascending=[False, True], na_position="last")
    want = dict(zip(ordered["id"], ordered.groupby("key").cumcount() + 1))
    assert got == want


def test_row_numbers_overall(table, frame):
    got = {r["id"]: r["rank"] for r in o.row_numbers(table, [F.col("id").desc()]).collect()}
    assert got == {i: len(frame) - i for i in range(len(frame))}


def test_running_totals(table, frame):
    amount = F.coalesce("value", F.lit(0.0))
    got = {r["id"]: r["upto"] for r in o.running_totals(table, [F.col("id")], {"upto": amount}, ["key"]).collect()}
    filled = frame.fillna({"value": 0.0}).sort_values("id")
    assert got == dict(zip(filled["id"], filled.groupby("key")["value"].cumsum()))


def test_neighbours(table, frame):
    got = {r["id"]: (r["prev_x"], r["next_x"]) for r in o.neighbours(table, [F.col("id")], {"x": "id"}, ["key"]).collect()}
    grouped = frame.sort_values("id").groupby("key")["id"]
    for i, before, after in zip(frame["id"], grouped.shift(1), grouped.shift(-1)):
        assert got[i] == (None if np.isnan(before) else before, None if np.isnan(after) else after)


def test_carry_last(table, frame):
    got = {r["id"]: r["held"] for r in o.carry_last(table, [F.col("id")], "value", ["key"]).collect()}
    want = frame.sort_values("id").groupby("key")["value"].ffill()
    for i, held in zip(frame["id"], want):
        assert got[i] == (None if np.isnan(held) else held)


@pytest.fixture(scope="module")
def shuffled(frame):
    frame = frame.assign(digest=[hashlib.md5(f"s:{i}".encode()).hexdigest() for i in frame["id"]])
    return frame.sort_values("digest")


@pytest.mark.parametrize("slice_rows", [1, 7, 50_000])
def test_hash_ranks_follow_the_digest(table, frame, shuffled, slice_rows):
    got = {r["id"]: (r["rank"], r["rank_of"]) for r in o.hash_ranks(table, "s", "id", ["key"], slice_rows=slice_rows).collect()}
    sizes = frame.groupby("key")["id"].transform("size")
    want_rank = dict(zip(shuffled["id"], shuffled.groupby("key").cumcount() + 1))
    assert got == {i: (want_rank[i], n) for i, n in zip(frame["id"], sizes)}
    whole = {r["id"]: r["rank"] for r in o.hash_ranks(table, "s", "id", slice_rows=slice_rows).collect()}
    assert whole == {i: n for n, i in enumerate(shuffled["id"], 1)}


@pytest.mark.parametrize("slice_rows", [3, 50_000])
def test_hash_first_takes_the_first_of_the_digest(table, shuffled, slice_rows):
    got = {r["id"] for r in o.hash_first(table, "s", "id", ["key"], 11, slice_rows).collect()}
    assert got == set(shuffled.groupby("key").head(11)["id"])
    quota = table.groupBy("key").agg((F.count("*") - 2).alias("quota"))
    got = {r["id"] for r in o.hash_first(table, "s", "id", ["key"], quota, slice_rows).collect()}
    sizes = shuffled.groupby("key")["id"].transform("size")
    assert got == set(shuffled[shuffled.groupby("key").cumcount() < sizes - 2]["id"])


def test_a_large_group_has_as_many_slices_as_it_needs(spark):
    rows = spark.range(200_000).select("id", F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("key"))
    sliced = o.digest_slices(rows, "s", "id", ["key"], "n", 20).groupBy("key", "_slice").count().groupBy("key").agg(
        F.count("*").alias("slices"), F.max("count").alias("most")).collect()
    for r in sliced:
        assert r["most"] < 60 and r["slices"] == pytest.approx({"hot": 9000, "small": 1000}[r["key"]], rel=0.01)


def test_ranks_start_no_checkpoint(spark):
    plan = o.hash_ranks(spark.range(100), "s", "id")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Range" in plan


def test_exact_quantiles(table, frame):
    rows = o.exact_quantiles(table, "value", {"q10": 0.1, "mid": 0.5, "p90": 0.9}, ["key"], nearest=["p90"]).collect()
    for r in rows:
        values = np.sort(frame.loc[frame["key"] == r["key"], "value"].dropna())
        assert r["q10"] == pytest.approx(np.quantile(values, 0.1))
        assert r["mid"] == pytest.approx(np.median(values))
        assert r["p90"] == values[round((len(values) - 1) * 0.9)]
    whole = o.exact_quantiles(table, "value", {"mid": 0.5}).collect()
    assert whole[0]["mid"] == np.median(frame["value"].dropna())


def test_known_around(table, frame):
    rows = o.known_around(table, [F.col("id")], "value", ["key"]).collect()
    got = {r["id"]: (r["prev_known"], r["next_known"]) for r in rows}
    grouped = frame.sort_values("id").groupby("key")["value"]
    for i, before, after in zip(frame["id"], grouped.ffill(), grouped.bfill()):
        assert got[i] == (None if np.isnan(before) else before, None if np.isnan(after) else after)
