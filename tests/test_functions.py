import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hashing, paths, text
from palimpsest.operators import benchmarks, states
from palimpsest.sources import generators, ignore


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_hashes(spark):
    r = one(spark, empty=hashing.xxh3_hex(F.lit(b"")), md5=hashing.md5_hex(F.lit("a")), raw=hashing.hash_of_hex(F.lit("0" * 31 + "f")))
    assert r.empty == "7f498d4624c30160d8984701d306aa99"
    assert hashing.short_id("") == "99aa06d3014798d8"
    assert r.md5 == "0cc175b9c0f1b6a831c399e269772661" and bytes(r.raw) == bytes(15) + b"\x0f"
    with pytest.raises(Exception, match="not a hash"):
        one(spark, raw=hashing.hash_of_hex(F.lit("xyz")))


def test_paths(spark):
    r = one(spark, parent=paths.parent(F.lit("a/b/c")), top=paths.parent(F.lit("a")), name=paths.base_name(F.lit("a/b/c")), depth=paths.depth(F.lit("a/b/c")), root=paths.depth(F.lit("")), above=paths.ancestors(F.lit("a/b/c")), none=paths.ancestors(F.lit("a")), joined=paths.joined(F.lit(""), F.lit("x")), part=paths.part_name(F.lit("ab"), F.lit(7)), slashes=paths.with_slashes(F.lit("a\\b")))
    assert (r.parent, r.top, r.name, r.depth, r.root, r.above, r.none, r.joined, r.part, r.slashes) == ("a/b", "", "c", 3, 0, ["a", "a/b"], [], "x", "pack-ab.dat.part-000007", "a/b")


@pytest.mark.parametrize(("path", "is_dir", "deps", "ignored"), [(".git", True, True, True), (".git/HEAD", False, True, True), ("target/debug/main", False, True, True), ("crates/core/target/debug/app", False, False, True), ("node_modules/pkg/index.js", False, False, True), ("packages/app/node_modules", True, False, True), ("node_modules/pkg/index.js", False, True, False), ("src/main.rs", False, False, False), (".gitignore", False, False, False), ("src/targeting.rs", False, False, False), ("debug.log", False, False, True), ("build/out.o", False, False, True), ("build", False, False, False), ("keep.log", False, False, False), ("a/b.tmp", False, False, True), ("docs/a/b.md", False, False, True), ("x/docs/a.md", False, False, False)])
def test_ignore_rules(spark, path, is_dir, deps, ignored):
    rules = ignore.parse_rules("# c\n*.log\nbuild/\n!keep.log\n**/*.tmp\n/docs/**\n\n")
    assert ignore.matches(rules, path, is_dir, deps) is ignored
    if not is_dir:
        assert one(spark, x=ignore.is_ignored(F.lit(path), rules, deps)).x is ignored


def test_text(spark):
    r = one(spark, kv=text.key_values(F.lit("iteration=1 cold_ms=4.5 x=")), kind=text.line_kind(F.lit("average a=1")), label=text.label(F.lit("  a b/c!! ")), nothing=text.label(F.lit(" ! ")), size=text.human_size(F.lit(1572864)), small=text.human_size(F.lit(7)), change=text.percent_change(F.lit(0.0), F.lit(5.0)), lasted=text.human_duration(F.lit(61.25)))
    assert r.kv == {"iteration": 1.0, "cold_ms": 4.5} and (r.kind, r.label, r.nothing, r.size, r.small, r.change, r.lasted) == ("average", "a-b-c", "run", "1.5 MB", "7 B", 0.0, "1m 1.3s")


def test_lz4_round_trip_of_generated_bytes(spark):
    df = spark.range(5).select((F.col("id") * 100).alias("n"), generators.xorshift_bytes(F.col("id") * 100, F.col("id")).alias("b"))
    back = df.withColumn("z", hashing.lz4_frame("b")).select("b", hashing.lz4_plain("z", "n").alias("again"))
    assert all(r.b == r.again for r in back.collect())


def test_generators(spark):
    assert generators.manifest(spark, 100, 10).select("blob_hash").distinct().count() == 10
    assert generators.blobs(spark, 10).where("pack_hash is null").count() == 2
    assert generators.text_files(spark, 4, 2).select("path").distinct().count() == 4
    assert generators.snapshots(spark, 3).count() == 3


def test_upper_median_and_best_of_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 4), ("a", 2.0, 2, 2), ("a", 3.0, 3, 8), ("a", 1.0, 0, 16)], "k string, value double, ordinal int, threads int")
    assert benchmarks.upper_median(df, ["k"]).first().upper_median == 2.0
    assert benchmarks.best(df, ["k"], "threads", "value", "ordinal").first().best == 16


def test_zero_median_has_no_spread(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 5.0)], "k string, value double")
    r = benchmarks.summarize(df, ["k"]).first()
    assert (r.samples, r.median, r.relative_mad_pct, r.span_pct) == (3.0, 0.0, 0.0, 0.0)


def test_diff_of_types_and_empty_sides(spark):
    schema = "path string, blob_hash string, mode int"
    target = spark.createDataFrame([("a", "1", 33188), ("b", "2", 41471), ("c", "3", 33188), ("link", "4", 41471)], schema)
    current = spark.createDataFrame([("b", "9", 33188), ("c", "3", 33188), ("d", "5", 33188), ("link", "4", 33188)], schema)
    got = {r.path: r.status for r in states.diff(target, current).collect()}
    assert got == {"a": "add", "b": "change", "c": "unchanged", "d": "remove", "link": "change"}
    assert states.diff(target.limit(0), current.limit(0)).count() == 0


def test_hard_links(spark):
    df = spark.createDataFrame([("a", 1, 1, 33188), ("b", 1, 1, 33188), ("c", 1, 2, 33188), ("d", 1, 3, 33188), ("e", 1, 3, 33188), ("l", 1, 3, 41471), ("n", None, None, 33188)], "path string, device long, inode long, mode int")
    assert {r.path: r.read_path for r in states.hardlink_groups(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "l": "l", "n": "n"}
    order = [r.path for r in states.by_locality(df).collect()]
    assert order[:2] == ["a", "b"] and order[-1] == "n"


def test_report_and_faulty_part_lists(spark):
    from palimpsest.operators import packs

    compared = spark.createDataFrame([("cold_ms", 10.0, 8.0, -2.0, -20.0)], "metric string, before double, after double, delta double, percent double")
    lines = [r.line for r in benchmarks.markdown(compared, "metric").collect()]
    assert lines[2] == "| cold_ms | 10.00 | 8.00 | -2.00 | -20.0% |"
    good = '[{"path":"a","offset":0,"size":3},{"path":"b","offset":3,"size":1}]'
    bad = ["nonsense", "[]", good.replace('"b"', '"../b"'), good.replace('"offset":3', '"offset":4'), good.replace('"size":1', '"size":0')]
    rows = spark.createDataFrame([(x,) for x in [good, *bad]], "json string")
    assert [r.fault for r in packs.part_list_faults(rows).collect()] == [None, "not a list", "empty", "bad name", "gap", "gap"]
    with pytest.raises(Exception, match="part list"):
        packs.checked_part_lists(rows).collect()
