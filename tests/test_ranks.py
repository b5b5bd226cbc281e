import random
import statistics

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import benchmarks, packs, ranks, states


@pytest.fixture(scope="module")
def rows(spark):
    """One key has nine tenths of the rows; values tie and may be null."""
    rng = random.Random(3)
    return [("hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", k, rng.choice([None, *map(float, range(40))])) for k in range(3000)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, value double").repartition(7)


def of_keys(rows):
    found = {}
    for key, ident, value in rows:
        found.setdefault(key, []).append((ident, value))
    return found


def test_ranks_and_sums(table, rows):
    got = {r.id: r.rank for r in ranks.ranked(table, ["key"], [F.col("id")], "rank").collect()}
    sums = {r.id: r.before for r in ranks.sums_before(table.fillna(0.0), ["key"], [F.col("id")], F.col("value"), "before").collect()}
    for one in of_keys(rows).values():
        total = 0
        for k, (ident, value) in enumerate(sorted(one)):
            assert (got[ident], sums[ident]) == (k, total)
            total += value or 0
    places = {r.id: r.place for r in ranks.ranked(table, [], [F.col("id").desc()], "place").collect()}
    assert all(places[k] == 2999 - k for k in range(3000))


def test_medians(table, rows):
    low, high = {r.key: r.median for r in ranks.medians(table, ["key"], "value").collect()}, {r.key: r.upper_median for r in benchmarks.upper_median(table, ["key"]).collect()}
    summary = {r.key: r for r in benchmarks.summarize(table, ["key"]).collect()}
    for key, one in of_keys(rows).items():
        values = sorted(v for _, v in one if v is not None)
        assert low[key] == summary[key].median == statistics.median(values) and high[key] == values[len(values) // 2]
        assert summary[key].mad == statistics.median(abs(v - low[key]) for v in values)


def test_empty_tables(table):
    none = table.limit(0)
    assert ranks.ranked(none, ["key"], [F.col("id")], "rank").count() == ranks.medians(none, ["key"], "value").count() == 0
    assert benchmarks.summarize(none, ["key"]).count() == benchmarks.pooled(none.withColumns({"round": F.lit(1), "iteration": F.lit(1)}), ["key"]).count() == 0


def test_places_and_offsets(spark):
    files = spark.createDataFrame([("z", None), ("a", 2), ("c", 1), ("b", 2)], "path string, inode long")
    assert {r.path: r.place for r in states.locality_places(files).collect()} == {"c": 1, "a": 2, "b": 3, "z": 4}
    entries = spark.createDataFrame([("p", f"{k:02}", 10 * k) for k in range(30)] + [("q", "x", 5)], "pack_hash string, blob_hash string, compressed_len long")
    got = {(r.pack_hash, r.blob_hash): r.offset for r in packs.with_offsets(entries).collect()}
    assert got == {(r.pack_hash, r.blob_hash): r.offset for r in packs.with_offsets_of_bounded(entries).collect()}
    assert got["p", "00"] == got["q", "x"] == 8 and got["p", "03"] == 8 + 3 * 24 + 30
