"""The query catalogue: every operator applied to whole tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, paths, text
from ..operators import benchmarks, catalog, merkle, packs, states
from ..operators.tables import tables_dir, written
from ..sources import ignore, logs
from ..sources import states as derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (read) under its name; read(table) gives a DataFrame of the query's folder."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: derived.table(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# SQL of the derived tables, by which the oracles start.
_STATES = """WITH w AS (SELECT doc_id, concat(lang,'/',source,'/',lpad(cast(doc_id AS varchar),8,'0'),'.txt') AS path, text,
  CAST(CASE WHEN doc_id % 97 = 0 THEN 41471 ELSE 33188 END AS BIGINT) AS mode FROM documents),
s0 AS (SELECT path, md5(text) AS blob_hash, CAST(strlen(text) AS BIGINT) AS size, mode, doc_id FROM w WHERE doc_id % 10 <> 3),
x1 AS (SELECT *, CASE WHEN doc_id % 10 = 5 THEN concat(text,'#v1') ELSE text END AS body FROM w WHERE doc_id % 10 <> 7),
s1 AS (SELECT path, md5(body) AS blob_hash, CAST(strlen(body) AS BIGINT) AS size, mode, doc_id FROM x1)"""
_CATALOG = """WITH snapshots AS (SELECT cast(o_orderkey AS varchar) AS id, o_orderdate AS created_at, o_orderpriority AS message, o_custkey AS project,
  CASE WHEN o_orderkey % 5 = 0 THEN cast(o_orderkey - 4 AS varchar) END AS manifest_snapshot_id FROM orders),
files AS (SELECT cast(l_orderkey AS varchar) AS snapshot_id, concat('f', cast(l_linenumber AS varchar)) AS path, l_partkey AS blob_hash, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
blobs AS (SELECT l_partkey AS blob_hash, max(CAST(l_quantity AS BIGINT)) AS size, l_partkey % 64 AS pack_hash FROM lineitem GROUP BY l_partkey)"""
_PAGES = """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, html FROM pages)"""
_SAMPLES = """WITH s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS side, event_type AS metric, event_id AS iteration, value FROM events)"""
_STATUS = "CASE WHEN c.path IS NULL THEN 'add' WHEN t.path IS NULL THEN 'remove' WHEN {differs} THEN 'change' ELSE 'unchanged' END AS status"
_LINK = "((t.mode & 61440) = 40960) <> ((c.mode & 61440) = 40960)"


def _diff_sql(differs: str) -> str:
    return f"SELECT coalesce(t.path, c.path) AS path, {_STATUS.format(differs=differs)} FROM s0 t FULL OUTER JOIN s1 c ON t.path = c.path"


def _s(read, which: int) -> DataFrame:
    return derived.document_state(read("documents"), which)


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row as one row."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


@query(f"{_STATES}, d AS ({_diff_sql('t.blob_hash <> c.blob_hash')}) SELECT status, count(*) AS n FROM d GROUP BY status")
def q01_state_diff_summary(read):
    return states.summary(states.diff(_s(read, 0), _s(read, 1), include_type=False))


@query(f"{_STATES} {_diff_sql('t.blob_hash <> c.blob_hash')}")
def q02_state_diff_rows(read):
    return states.diff(_s(read, 0), _s(read, 1), include_type=False)


@query(f"{_STATES} {_diff_sql('t.blob_hash <> c.blob_hash OR ' + _LINK)}")
def q03_state_diff_with_type(read):
    return states.diff(_s(read, 0), _s(read, 1))


@query(f"{_STATES}, s2 AS (SELECT path, blob_hash, CASE WHEN doc_id % 4 = 0 THEN 33261 ELSE mode END AS mode FROM s1) {_diff_sql('t.blob_hash <> c.blob_hash OR t.mode <> c.mode').replace('s1 c', 's2 c')}")
def q04_state_diff_with_mode(read):
    current = _s(read, 1).withColumn("mode", F.when(F.col("doc_id") % 4 == 0, F.lit(33261).cast("long")).otherwise(F.col("mode")))
    return states.diff(_s(read, 0), current, include_mode=True)


@query(f"{_STATES} SELECT path, blob_hash, size, mode FROM s0")
def q05_manifest(read):
    return _s(read, 0).select("path", "blob_hash", "size", "mode").orderBy("path")


_PART_PATHS = "SELECT p_partkey, concat(replace(p_type,' ','/'), '/', CASE p_partkey % 7 WHEN 0 THEN 'target/x' WHEN 1 THEN 'node_modules/y' WHEN 2 THEN 'targets/z' ELSE 'src' END, '/', p_name, CASE WHEN p_partkey % 3 = 0 THEN '.log' ELSE '.js' END) AS path FROM part"


def _part_paths(read) -> DataFrame:
    middle = F.when(F.col("p_partkey") % 7 == 0, "target/x").when(F.col("p_partkey") % 7 == 1, "node_modules/y").when(F.col("p_partkey") % 7 == 2, "targets/z").otherwise("src")
    ending = F.when(F.col("p_partkey") % 3 == 0, ".log").otherwise(".js")
    return read("part").select("p_partkey", F.concat(F.regexp_replace("p_type", " ", "/"), F.lit("/"), middle, F.lit("/"), F.col("p_name"), ending).alias("path"))


@query(f"WITH p AS ({_PART_PATHS}) SELECT p_partkey, path, list_has_any(string_split(path,'/'), ['.git','.palimpsest','target']) AS excluded, list_has_any(string_split(path,'/'), ['.git','.palimpsest','target','node_modules','.venv','venv','__pypackages__','.tox','.nox','.gradle','.m2']) AS excluded_with_deps FROM p")
def q06_excluded_components(read):
    p = _part_paths(read)
    return p.withColumns({"excluded": paths.is_excluded(F.col("path"), True), "excluded_with_deps": paths.is_excluded(F.col("path"))})


@query(f"WITH p AS ({_PART_PATHS}) SELECT p_partkey, path, list_has_any(string_split(path,'/'), ['.git','.palimpsest','target','node_modules']) OR regexp_matches(path, '(^|/)targets/.') OR (regexp_matches(path, '[.]log$') AND NOT regexp_matches(path, '(^|/)[^/]*1[^/]*[.]log$')) AS ignored FROM p")
def q07_ignore_rules(read):
    rules = ignore.parse_rules("# logs, but for those with a 1\n*.log\n!*1*.log\ntargets/\n")
    return _part_paths(read).withColumn("ignored", ignore.is_ignored(F.col("path"), rules))


_INDEX = "f AS (SELECT path, blob_hash, size, mode, doc_id AS mtime_secs, CAST(0 AS BIGINT) AS mtime_nanos, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id END AS inode FROM {s})"


def _files(read, which: int) -> DataFrame:
    return _s(read, which).select("path", "blob_hash", "size", "mode", F.col("doc_id").alias("mtime_secs"), F.lit(0).cast("long").alias("mtime_nanos"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("inode"))


@query(f"{_STATES}, {_INDEX.format(s='s1')}, i AS (SELECT path, blob_hash, size, mode, doc_id AS mtime_secs, CAST(0 AS BIGINT) AS mtime_nanos, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id END AS inode FROM s0) SELECT f.path, i.blob_hash AS cached_hash, i.path IS NOT NULL AS hit FROM f LEFT JOIN i ON f.path = i.path AND f.size = i.size AND f.mode = i.mode AND f.mtime_secs = i.mtime_secs AND f.mtime_nanos = i.mtime_nanos AND f.inode IS NOT DISTINCT FROM i.inode")
def q08_cache_probe(read):
    probed = states.cache_probe(_files(read, 1), _files(read, 0))
    return probed.select("path", "cached_hash", F.col("cached_hash").isNotNull().alias("hit"))


@query(f"{_STATES} SELECT path FROM s0 WHERE path NOT IN (SELECT path FROM s1)")
def q09_removed_paths(read):
    return states.removed_paths(_s(read, 0), _s(read, 1))


@query(f"{_STATES} SELECT blob_hash, min(path) AS first_path, count(*) AS n FROM s0 GROUP BY blob_hash HAVING count(*) > 1")
def q10_dup_groups(read):
    return states.duplicate_groups(_s(read, 0))


@query(f"{_STATES} SELECT blob_hash, max(size) AS size FROM s1 WHERE blob_hash NOT IN (SELECT blob_hash FROM s0) GROUP BY blob_hash")
def q11_new_objects(read):
    return states.new_objects(_s(read, 1), _s(read, 0))


@query(f"{_STATES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, (SELECT count(DISTINCT blob_hash) FROM s1 WHERE blob_hash NOT IN (SELECT blob_hash FROM s0)) AS new_objects FROM s1")
def q12_save_stats(read):
    new = states.new_objects(_s(read, 1), _s(read, 0)).agg(F.count(F.lit(1)).alias("new_objects"))
    return side_by_side(_s(read, 1).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")), new)


_LINKS = f"{_STATES}, g AS (SELECT path, mode, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id // 3 END AS inode FROM s0)"


@query(f"{_LINKS}, e AS (SELECT inode, min(path) AS first_path, count(*) AS links FROM g WHERE inode IS NOT NULL AND (mode & 61440) <> 40960 GROUP BY inode) SELECT g.path, coalesce(e.first_path, g.path) AS read_path, coalesce(e.links, 1) AS links FROM g LEFT JOIN e ON g.inode = e.inode AND (g.mode & 61440) <> 40960")
def q13_hardlink_groups(read):
    files = _s(read, 0).select("path", "mode", F.lit(1).alias("device"), F.when(F.col("doc_id") % 13 != 0, F.floor(F.col("doc_id") / 3)).alias("inode"))
    return states.hardlink_groups(files).select("path", "read_path", F.col("links").cast("long").alias("links"))


@query(f"{_LINKS} SELECT path, inode, row_number() OVER (ORDER BY inode ASC NULLS LAST, path) AS place FROM g")
def q14_locality_order(read):
    files = _s(read, 0).select("path", F.when(F.col("doc_id") % 13 != 0, F.floor(F.col("doc_id") / 3)).alias("inode"))
    return states.locality_places(files)


_ENTRIES = f"{_STATES}, e0 AS (SELECT blob_hash, max(size) AS compressed_len, substr(blob_hash,1,1) AS pack_hash FROM s0 GROUP BY blob_hash), e AS (SELECT *, CAST(8 + coalesce(sum(24 + compressed_len) OVER (PARTITION BY pack_hash ORDER BY blob_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM e0)"


def _entries(read) -> DataFrame:
    blobs = _s(read, 0).groupBy("blob_hash").agg(F.max("size").alias("compressed_len")).withColumn("pack_hash", F.substring("blob_hash", 1, 1))
    return packs.with_offsets(blobs)


@query(f"{_ENTRIES} SELECT pack_hash, blob_hash, compressed_len, \"offset\" FROM e")
def q15_pack_offsets(read):
    return _entries(read)


PART = 65536


@query(f"{_ENTRIES} SELECT blob_hash, \"offset\" // {PART} AS first_part, (\"offset\" + 24 + compressed_len - 1) // {PART} AS last_part FROM e")
def q16_pack_parts(read):
    return packs.part_span(_entries(read), PART).select("blob_hash", "first_part", "last_part")


_PARTS = f"{_ENTRIES}, ends AS (SELECT pack_hash, max(\"offset\" + 24 + compressed_len) AS pend FROM e GROUP BY pack_hash), parts AS (SELECT pack_hash, part, part * {PART} AS \"offset\", least({PART}, pend - part * {PART}) AS size FROM (SELECT pack_hash, pend, unnest(range(0, (pend - 1) // {PART} + 1)) AS part FROM ends))"


@query(f"{_PARTS} SELECT e.blob_hash, p.part FROM e JOIN parts p ON e.pack_hash = p.pack_hash AND e.\"offset\" < p.\"offset\" + p.size AND e.\"offset\" + 24 + e.compressed_len > p.\"offset\"")
def q17_range_lookup(read):
    entries = _entries(read)
    ranges = entries.select("pack_hash", "blob_hash", F.col("offset").alias("start"), (F.col("offset") + packs.ENTRY + F.col("compressed_len")).alias("end"))
    found = packs.range_parts(ranges, packs.parts(entries, PART), PART)
    return found.join(ranges.select("pack_hash", "start", "blob_hash"), ["pack_hash", "start"]).select("blob_hash", "part")


@query(f"{_PARTS} SELECT pack_hash, part, \"offset\", size, CAST(coalesce(lag(\"offset\" + size) OVER (PARTITION BY pack_hash ORDER BY part), 0) AS BIGINT) AS expected, \"offset\" = coalesce(lag(\"offset\" + size) OVER (PARTITION BY pack_hash ORDER BY part), 0) AS contiguous FROM parts")
def q18_parts_contiguity(read):
    return packs.contiguity(packs.parts(_entries(read), PART))


@query(f"{_ENTRIES} SELECT DISTINCT s1.blob_hash, e.pack_hash, e.pack_hash IS NOT NULL AS found FROM s1 LEFT JOIN e ON s1.blob_hash = e.blob_hash")
def q19_blob_locate(read):
    return packs.located(_s(read, 1), _entries(read))


@query(f"{_ENTRIES}, d AS ({_diff_sql('t.blob_hash <> c.blob_hash')}) SELECT e.pack_hash, e.\"offset\", s0.path, s0.size FROM d JOIN s0 ON d.path = s0.path JOIN e ON s0.blob_hash = e.blob_hash WHERE status IN ('add','change')")
def q20_restore_tasks(read):
    wanted = states.diff(_s(read, 0), _s(read, 1), include_type=False).where("status in ('add', 'change')")
    return packs.restore_tasks(wanted, _s(read, 0), _entries(read)).orderBy("pack_hash", "offset", "path")


@query(f"{_ENTRIES}, d AS ({_diff_sql('t.blob_hash <> c.blob_hash')}) SELECT DISTINCT e.pack_hash FROM d JOIN s0 ON d.path = s0.path JOIN e ON s0.blob_hash = e.blob_hash WHERE status IN ('add','change')")
def q21_packs_needed(read):
    wanted = states.diff(_s(read, 0), _s(read, 1), include_type=False).where("status in ('add', 'change')")
    return packs.packs_needed(_s(read, 0).join(wanted.select("path"), "path", "left_semi"), _entries(read)).orderBy("pack_hash")


_ANCESTORS = "SELECT {columns}, unnest(list_transform(range(1, len(string_split(path,'/'))), lambda i: array_to_string(list_slice(string_split(path,'/'), 1, i), '/'))) AS dir FROM {t}"


@query(f"{_STATES}, a AS ({_ANCESTORS.format(columns='path', t='s0')}) SELECT dir, CAST(len(string_split(dir,'/')) AS BIGINT) AS depth, count(*) AS files FROM a GROUP BY dir")
def q22_dir_ancestors(read):
    one = _s(read, 0).select(F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    return one.groupBy("dir").agg(F.count(F.lit(1)).alias("files")).withColumn("depth", paths.depth(F.col("dir")).cast("long"))


_FILE_ENTRY = "concat_ws(':', regexp_extract(path, '[^/]*$'), CASE WHEN (mode & 61440) = 40960 THEN 'symlink' ELSE 'file' END, blob_hash, cast(size AS varchar), cast(mode AS varchar))"
_LEVELS = f"""{_STATES}, l2 AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, md5(string_agg({_FILE_ENTRY}, '|' ORDER BY regexp_extract(path, '[^/]*$'))) AS tree_hash FROM s0 GROUP BY 1)"""
_DIR_ENTRY = "concat_ws(':', regexp_extract(dir, '[^/]*$'), 'directory', tree_hash, '0', '16877')"


@query(f"{_LEVELS} SELECT dir, tree_hash FROM l2")
def q23_dir_level_hash(read):
    return merkle.nodes(_s(read, 0)).where("depth = 2").select("dir", "tree_hash")


@query(f"{_LEVELS}, l1 AS (SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) AS dir, md5(string_agg({_DIR_ENTRY}, '|' ORDER BY regexp_extract(dir, '[^/]*$'))) AS tree_hash FROM l2 GROUP BY 1) SELECT md5(string_agg({_DIR_ENTRY}, '|' ORDER BY dir)) AS root_hash FROM l1")
def q24_merkle_root(read):
    return merkle.nodes(_s(read, 0)).where("depth = 0").select(F.col("tree_hash").alias("root_hash"))


@query(f"{_STATES} SELECT path, blob_hash, CASE WHEN (mode & 61440) = 40960 THEN 'symlink' ELSE 'file' END AS entry_type FROM s0")
def q25_tree_expand(read):
    nodes = written(merkle.nodes(_s(read, 0)))
    return merkle.expand(merkle.tree_table(nodes), nodes.where("dir = ''").first().tree_hash)


@query(f"{_STATES}, r AS (SELECT path FROM s0 WHERE doc_id % 10 >= 2), k AS (SELECT path FROM s0 WHERE doc_id % 10 < 2), ra AS (SELECT DISTINCT dir FROM ({_ANCESTORS.format(columns='path', t='r')})), ka AS (SELECT DISTINCT dir FROM ({_ANCESTORS.format(columns='path', t='k')})) SELECT dir, CAST(len(string_split(dir,'/')) AS BIGINT) AS depth FROM ra WHERE dir NOT IN (SELECT dir FROM ka)")
def q26_empty_dir_candidates(read):
    s0 = _s(read, 0)
    found = merkle.empty_after_removal(s0.where("doc_id % 10 >= 2"), s0.where("doc_id % 10 < 2"))
    return found.select("dir", F.col("depth").cast("long").alias("depth"))


def _snapshots(read) -> DataFrame:
    return derived.snapshots(read("orders"))


def _manifest_rows(read) -> DataFrame:
    return derived.snapshot_files(read("lineitem"))


@query(f"{_CATALOG} SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, coalesce(message,'') AS message FROM snapshots ORDER BY created_at DESC, id DESC LIMIT 20")
def q27_list_snapshots(read):
    return catalog.newest_first(_snapshots(read), 20).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.coalesce("message", F.lit("")).alias("message"))


@query(f"{_CATALOG} SELECT project, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id DESC) AS rn FROM snapshots) WHERE rn = 1")
def q28_latest_per_project(read):
    return catalog.latest_by(_snapshots(read), "project")


@query(f"{_CATALOG}, p AS (SELECT DISTINCT substr(cast(o_orderkey AS varchar), 1, 3) AS prefix FROM orders UNION SELECT 'zz'), h AS (SELECT prefix, count(id) AS hits FROM p LEFT JOIN snapshots ON starts_with(id, prefix) GROUP BY prefix) SELECT prefix, hits, CASE hits WHEN 0 THEN 'not found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS verdict FROM h")
def q29_resolve_prefix(read):
    s = _snapshots(read)
    prefixes = s.select(F.substring("id", 1, 3).alias("prefix")).distinct().unionByName(s.sparkSession.createDataFrame([("zz",)], "prefix string"))
    return catalog.prefix_verdicts(s, prefixes)


@query(f"{_CATALOG} SELECT s.id AS snapshot_id, f.path, f.blob_hash, f.size FROM snapshots s JOIN files f ON coalesce(s.manifest_snapshot_id, s.id) = f.snapshot_id")
def q30_manifest_via_owner(read):
    return catalog.manifests(_snapshots(read), _manifest_rows(read))


@query(f"{_CATALOG}, gone AS (SELECT id FROM snapshots WHERE cast(id AS BIGINT) % 10 = 1), h AS (SELECT manifest_snapshot_id AS old_owner, arg_max(id, row(created_at, id)) AS heir FROM snapshots WHERE manifest_snapshot_id IN (SELECT id FROM gone) AND id NOT IN (SELECT id FROM gone) GROUP BY 1) SELECT s.id, CASE WHEN h.heir IS NULL THEN s.manifest_snapshot_id WHEN h.heir = s.id THEN NULL ELSE h.heir END AS manifest_snapshot_id FROM snapshots s LEFT JOIN h ON s.manifest_snapshot_id = h.old_owner WHERE s.id NOT IN (SELECT id FROM gone)")
def q31_delete_transfer(read):
    s = _snapshots(read)
    return catalog.after_delete(s, _manifest_rows(read), s.where(F.col("id").cast("long") % 10 == 1))[0].select("id", "manifest_snapshot_id")


@query(f"{_CATALOG}, gone AS (SELECT id FROM snapshots WHERE cast(id AS BIGINT) % 10 = 1), h AS (SELECT manifest_snapshot_id AS old_owner, arg_max(id, row(created_at, id)) AS heir FROM snapshots WHERE manifest_snapshot_id IN (SELECT id FROM gone) AND id NOT IN (SELECT id FROM gone) GROUP BY 1) SELECT coalesce(h.heir, f.snapshot_id) AS snapshot_id, f.path, f.blob_hash, f.size FROM files f LEFT JOIN h ON f.snapshot_id = h.old_owner WHERE h.heir IS NOT NULL OR f.snapshot_id NOT IN (SELECT id FROM gone)")
def q31b_delete_transfer_files(read):
    s = _snapshots(read)
    return catalog.after_delete(s, _manifest_rows(read), s.where(F.col("id").cast("long") % 10 == 1))[1]


@query(f"{_CATALOG}, new AS (SELECT p_partkey AS blob_hash, CAST(p_size AS BIGINT) AS size, CAST(999 AS BIGINT) AS pack_hash FROM part WHERE p_partkey % 3 = 0) SELECT blob_hash, size, pack_hash FROM blobs WHERE blob_hash NOT IN (SELECT blob_hash FROM new) UNION ALL SELECT blob_hash, size, pack_hash FROM new")
def q32_blob_upsert(read):
    new = read("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("blob_hash"), F.col("p_size").cast("long").alias("size"), F.lit(999).cast("long").alias("pack_hash"))
    return states.upserted(derived.blob_index(read("lineitem")), new, "blob_hash")


@query(f"{_STATES} SELECT path, blob_hash, size, mode FROM s0 WHERE path NOT IN (SELECT path FROM s1 WHERE doc_id % 10 = 5) AND doc_id % 10 <> 9 UNION ALL SELECT path, blob_hash, size, mode FROM s1 WHERE doc_id % 10 = 5")
def q33_index_apply(read):
    s0, s1 = _s(read, 0), _s(read, 1)
    return states.index_applied(s0, s0.where("doc_id % 10 = 9"), s1.where("doc_id % 10 = 5")).select("path", "blob_hash", "size", "mode")


_KEPT = f"{_CATALOG}, kept AS (SELECT * FROM snapshots WHERE cast(id AS BIGINT) % 100 = 1), r AS (SELECT DISTINCT f.blob_hash FROM files f WHERE f.snapshot_id IN (SELECT coalesce(manifest_snapshot_id, id) FROM kept))"


def _kept(read) -> DataFrame:
    return _snapshots(read).where(F.col("id").cast("long") % 100 == 1)


@query(f"{_KEPT} SELECT (SELECT count(*) FROM r) AS reachable, (SELECT count(*) FROM blobs WHERE blob_hash NOT IN (SELECT blob_hash FROM r)) AS swept")
def q34_gc(read):
    live = catalog.reachable(_kept(read), _manifest_rows(read))
    swept = catalog.sweep(derived.blob_index(read("lineitem")), live)
    return side_by_side(live.agg(F.count(F.lit(1)).alias("reachable")), swept.agg(F.count(F.lit(1)).alias("swept")))


@query(f"{_KEPT}, packs AS (SELECT range AS pack_hash FROM range(0, 70)) SELECT packs.pack_hash, count(b.blob_hash) AS n FROM packs LEFT JOIN blobs b ON packs.pack_hash = b.pack_hash GROUP BY 1")
def q35_pack_refcount(read):
    blobs = derived.blob_index(read("lineitem"))
    return packs.reference_counts(blobs.sparkSession.range(70).withColumnRenamed("id", "pack_hash"), blobs)


@query(f"{_KEPT} SELECT pack_hash, CAST(coalesce(sum(size) FILTER (blob_hash IN (SELECT blob_hash FROM r)), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(size) FILTER (blob_hash NOT IN (SELECT blob_hash FROM r)), 0) AS BIGINT) AS dead_bytes FROM blobs GROUP BY pack_hash")
def q36_pack_dead_bytes(read):
    return packs.dead_bytes(derived.blob_index(read("lineitem")), catalog.reachable(_kept(read), _manifest_rows(read)))


@query(f"{_STATES} SELECT CASE WHEN size < 1024 THEN 'small' WHEN size < 262144 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM s0 GROUP BY 1")
def q37_size_buckets(read):
    return benchmarks.size_buckets(_s(read, 0))


@query("WITH b AS (SELECT lang, md5(text) AS h, max(strlen(text)) AS size, count(*) AS n, sum(strlen(text)) AS total FROM documents GROUP BY 1, 2) SELECT lang, CAST(sum(total) AS BIGINT) AS logical_bytes, CAST(sum(size) AS BIGINT) AS stored_bytes, floor(sum(total) * 10.0 / sum(size)) / 10 AS ratio FROM b GROUP BY lang")
def q38_dedup_ratio(read):
    size = F.octet_length("text")
    once = read("documents").groupBy("lang", F.md5("text").alias("h")).agg(F.max(size).alias("size"), F.sum(size).alias("total"))
    return once.groupBy("lang").agg(F.sum("total").alias("logical_bytes"), F.sum("size").cast("long").alias("stored_bytes")).withColumn("ratio", F.floor(F.col("logical_bytes") * 10.0 / F.col("stored_bytes")) / 10)


@query("WITH l AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'config' ELSE 'iteration' END AS kind, event_id FROM events) SELECT kind, CAST(NULL AS BIGINT) AS iteration, unnest(['source_files','dirs']) AS metric, unnest([CAST(event_id AS DOUBLE), 60.0]) AS value FROM l WHERE kind = 'config' UNION ALL SELECT kind, event_id AS iteration, unnest(['cold_save_ms','warm_save_ms']) AS metric, unnest([event_id % 97 + 40.5::DOUBLE, event_id % 13 + 9.25::DOUBLE]) AS value FROM l WHERE kind = 'iteration'")
def q39_bench_parse(read):
    return benchmarks.parse(logs.log_lines(read("events")))


_SUMMARY = f"{_SAMPLES}, a AS (SELECT side, metric, CAST(count(value) AS DOUBLE) AS samples, avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max FROM s GROUP BY 1, 2), d AS (SELECT s.side, s.metric, median(abs(s.value - a.median)) AS mad FROM s JOIN a ON s.side = a.side AND s.metric = a.metric GROUP BY 1, 2), u AS (SELECT a.*, d.mad, CASE WHEN a.median = 0 THEN 0 ELSE d.mad / a.median * 100 END AS relative_mad_pct, CASE WHEN a.median = 0 THEN 0 ELSE (a.max - a.min) / a.median * 100 END AS span_pct FROM a JOIN d ON a.side = d.side AND a.metric = d.metric)"


def _summary(read) -> DataFrame:
    return benchmarks.summarize(derived.bench_samples(read("events")), ["side", "metric"])


@query(f"{_SUMMARY} SELECT side, metric, samples, round(mean, 6) AS mean, round(median, 6) AS median, min, max, round(mad, 6) AS mad, round(relative_mad_pct, 6) AS relative_mad_pct, round(span_pct, 6) AS span_pct FROM u")
def q40_bench_summary(read):
    return _summary(read).select("side", "metric", "samples", *(F.round(c, 6).alias(c) for c in ("mean", "median")), "min", "max", *(F.round(c, 6).alias(c) for c in ("mad", "relative_mad_pct", "span_pct")))


@query(f"{_SUMMARY} SELECT b.metric, round(b.median, 6) AS before, round(f.median, 6) AS after, round(f.median - b.median, 6) AS delta, round(CASE WHEN b.median = 0 THEN 0 ELSE (f.median - b.median) / b.median * 100 END, 6) AS percent FROM u b JOIN u f ON b.metric = f.metric AND b.side = 'before' AND f.side = 'after'")
def q41_bench_compare(read):
    u = _summary(read)
    return benchmarks.compare(u.where("side = 'before'"), u.where("side = 'after'"), ["metric"]).select("metric", *(F.round(c, 6).alias(c) for c in ("before", "after", "delta", "percent")))


@query(f"{_SUMMARY} SELECT side, metric, samples, round(span_pct, 6) AS span_pct FROM u WHERE samples >= 3 AND NOT (span_pct < 15 AND relative_mad_pct < 5)")
def q42_bench_instability(read):
    return benchmarks.unstable(_summary(read)).select("side", "metric", "samples", F.round("span_pct", 6).alias("span_pct"))


@query(f"{_SAMPLES}, b AS (SELECT DISTINCT iteration // 2 % 1000 AS k FROM s WHERE side = 'before' AND iteration % 3 = 0), a AS (SELECT DISTINCT iteration // 2 % 1000 AS k FROM s WHERE side = 'after' AND iteration % 5 = 0) SELECT k, 'before' AS side FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'after' AS side FROM a WHERE k NOT IN (SELECT k FROM b)")
def q43_bench_coverage(read):
    s = derived.bench_samples(read("events")).withColumn("k", F.expr("iteration div 2 % 1000"))
    return benchmarks.coverage(s.where("side = 'before' and iteration % 3 = 0"), s.where("side = 'after' and iteration % 5 = 0"), "k")


@query(f"{_SAMPLES} SELECT side, metric, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median FROM s WHERE value IS NOT NULL GROUP BY 1, 2")
def q44_bench_upper_median(read):
    return benchmarks.upper_median(derived.bench_samples(read("events")).where("value is not null"), ["side", "metric"])


@query(f"{_SAMPLES} SELECT metric, iteration % 4 AS round, value, row_number() OVER (PARTITION BY metric ORDER BY iteration % 4, iteration) AS iteration FROM s")
def q45_bench_ab_pool(read):
    s = derived.bench_samples(read("events")).withColumn("round", F.col("iteration") % 4)
    return benchmarks.pooled(s, ["metric"]).select("metric", "round", "value", "iteration")


@query("SELECT event_type, arg_min(user_id % 16, row(value, event_id)) AS best, min(value) AS least FROM events GROUP BY event_type")
def q46_argmin_threads(read):
    e = read("events").withColumn("threads", F.col("user_id") % 16)
    return benchmarks.best(e, ["event_type"], "threads", "value", "event_id")


@query("WITH s AS (SELECT p_partkey, p_partkey * p_partkey * p_size AS size FROM part) SELECT p_partkey, CASE WHEN size >= 1073741824 THEN concat(cast(size * 10 // 1073741824 // 10 AS varchar), '.', cast(size * 10 // 1073741824 % 10 AS varchar), ' GB') WHEN size >= 1048576 THEN concat(cast(size * 10 // 1048576 // 10 AS varchar), '.', cast(size * 10 // 1048576 % 10 AS varchar), ' MB') WHEN size >= 1024 THEN concat(cast(size * 10 // 1024 // 10 AS varchar), '.', cast(size * 10 // 1024 % 10 AS varchar), ' KB') ELSE concat(cast(size AS varchar), ' B') END AS shown FROM s")
def q47_human_size(read):
    return read("part").select("p_partkey", text.human_size(F.col("p_partkey") * F.col("p_partkey") * F.col("p_size")).alias("shown"))


@query("WITH s AS (SELECT p_partkey, concat(' ?', p_name, ' / ', p_type, '! ') AS raw FROM part) SELECT p_partkey, coalesce(nullif(trim(regexp_replace(trim(raw), '[^a-zA-Z0-9._-]+', '-', 'g'), '-'), ''), 'run') AS label FROM s")
def q48_label_sanitize(read):
    raw = F.concat(F.lit(" ?"), F.col("p_name"), F.lit(" / "), F.col("p_type"), F.lit("! "))
    return read("part").select("p_partkey", text.label(raw).alias("label"))


@query('SELECT count(text) AS n, count(DISTINCT text) AS "distinct" FROM documents')
def q49_xxh3_distinct(read):
    """Rows and distinct contents by XXH3-128."""
    hashed = read("documents").select(hashing.xxh3_hex(F.encode("text", "UTF-8")).alias("h"))
    return hashed.agg(F.count("h").alias("n"), F.countDistinct("h").alias("distinct"))


@query("SELECT concat('n', cast(s_nationkey AS varchar), '/', replace(s_name, '#', '_'), '.txt') AS relative_path, CAST(strlen(s_name) AS BIGINT) AS size, md5(s_name) AS blob_hash FROM supplier")
def q50_workspace_scan(read):
    """The suppliers as a tree of files, in the shared folder, scanned and hashed."""
    from ..sources.generators import write_files
    from ..sources.workspace import read_workspace, with_hash

    rows = read("supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/"), F.regexp_replace("s_name", "#", "_"), F.lit(".txt")).alias("path"), F.encode("s_name", "UTF-8").alias("content"))
    root = f"{tables_dir(rows.sparkSession).removeprefix('file:')}/files-{uuid.uuid4().hex}"
    write_files(rows, root)
    return with_hash(read_workspace(rows.sparkSession, root), root).select("relative_path", "size", "blob_hash")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, true AS same FROM documents")
def q51_lz4_roundtrip(read):
    content = F.encode("text", "UTF-8")
    framed = read("documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), content.alias("content"), hashing.lz4_frame(content).alias("framed"))
    return framed.select("doc_id", "size", (hashing.lz4_plain("framed", "size") == F.col("content")).alias("same"))


@query(f"{_CATALOG} SELECT project, id, lag(id) OVER (PARTITION BY project ORDER BY created_at, id) AS parent FROM snapshots")
def q52_lineage_parent(read):
    order = Window.partitionBy("project").orderBy("created_at", "id")
    return _snapshots(read).select("project", "id", F.lag("id").over(order).alias("parent"))


@query(f"{_PAGES} SELECT path, md5(html) AS blob_hash, CAST(strlen(html) AS BIGINT) AS size, CAST(33188 AS BIGINT) AS mode FROM p")
def q53_page_state(read):
    return derived.page_state(read("pages"))


@query(f"{_STATES} SELECT blob_hash, path, row_number() OVER (PARTITION BY blob_hash ORDER BY path) = 1 AS is_new FROM s0")
def q54_first_occurrence(read):
    return states.first_occurrences(_s(read, 0)).select("blob_hash", "path", "is_new")


@query("WITH r AS (SELECT range AS round FROM range(0, 6)) SELECT round, CAST(p AS BIGINT) AS position, CASE WHEN (round + p) % 2 = 0 THEN 'before' ELSE 'after' END AS side FROM r, (SELECT unnest([0, 1]) AS p)")
def q55_alternating_schedule(read):
    return benchmarks.alternating(6, read("region").sparkSession).select("round", F.col("position").cast("long").alias("position"), "side")


@query(f"{_STATES} SELECT DISTINCT blob_hash FROM s0")
def q56_tree_reachable(read):
    nodes = written(merkle.nodes(_s(read, 0)))
    return merkle.reachable_blobs(merkle.tree_table(nodes), nodes.where("dir = ''"))


@query(f"{_PARTS} SELECT pack_hash, cast(to_json(list(struct_pack(path := concat('pack-', pack_hash, '.dat.part-', lpad(cast(part AS varchar), 6, '0')), \"offset\" := \"offset\", size := size) ORDER BY part)) AS varchar) AS json FROM parts GROUP BY pack_hash")
def q57_part_lists(read):
    return packs.checked_part_lists(packs.part_lists(packs.parts(_entries(read), PART)))


@query(f"{_PARTS} SELECT pack_hash, CASE WHEN count(*) = 1 THEN 'empty' ELSE 'gap' END AS fault FROM parts GROUP BY pack_hash")
def q58_part_list_faults(read):
    """Part lists without their first part."""
    parts = packs.parts(_entries(read), PART)
    later = packs.part_lists(parts.where("part > 0"))
    lists = parts.select("pack_hash").distinct().join(later, "pack_hash", "left").withColumn("json", F.coalesce("json", F.lit("[]")))
    return packs.part_list_faults(lists).select("pack_hash", "fault")


_DOCS = _STATES.replace("FROM documents)", "FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)")


def _stored(read):
    """A store with the documents' states 0 and 1, and the ids of its two snapshots."""
    from .store import Store

    docs = read("documents").where("text is not null and lang is not null and source is not null")
    store = Store(docs.sparkSession, f"{tables_dir(docs.sparkSession)}/store-{uuid.uuid4().hex}", pack_bytes=1 << 20)
    first, second = (store.save(derived.document_files(docs, k), f"state {k}", pack_chunk_bytes=(None, PART)[k])["snapshot_id"] for k in (0, 1))
    return store, first, second


@query(f"{_DOCS} SELECT path, blob_hash, size, CAST(mode AS INT) AS mode FROM s0")
def q59_store_manifest(read):
    """What a store says of its first snapshot after a second one."""
    store, first, _ = _stored(read)
    return store.manifest(first)


@query(f"{_DOCS} SELECT DISTINCT blob_hash, size FROM (SELECT blob_hash, size FROM s0 UNION ALL SELECT blob_hash, size FROM s1)")
def q60_store_blob_index(read):
    store, _, _ = _stored(read)
    return store.table("blob_index").select("blob_hash", "size")


@query(f"{_DOCS}, d AS ({_diff_sql('t.blob_hash <> c.blob_hash OR ' + _LINK)}) SELECT s0.path, CAST(s0.mode AS INT) AS mode, s0.blob_hash, s0.size FROM d JOIN s0 ON d.path = s0.path WHERE status IN ('add', 'change')")
def q61_store_restored(read):
    """The contents that a restore of the first snapshot writes over the second one's state; contents of the second are cut into parts."""
    store, first, second = _stored(read)
    data = store.restored(first, store.manifest(second))
    return data.select("path", "mode", F.md5("data").alias("blob_hash"), F.octet_length("data").cast("long").alias("size"))


@query(f"{_DOCS} SELECT DISTINCT blob_hash, size FROM s1")
def q62_store_after_delete(read):
    """What is left of the blobs once the first snapshot is gone, told by their contents."""
    store, first, second = _stored(read)
    store.delete(first)
    data = store.restored(second)
    return data.select(F.md5("data").alias("blob_hash"), F.octet_length("data").cast("long").alias("size")).distinct()


@query(f"{_DOCS} SELECT 'state 0' AS message, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes, count(DISTINCT blob_hash) AS new_objects FROM s0 UNION ALL SELECT 'state 1', count(*), CAST(sum(size) AS BIGINT), (SELECT count(DISTINCT blob_hash) FROM s1 WHERE blob_hash NOT IN (SELECT blob_hash FROM s0)) FROM s1")
def q63_store_snapshots(read):
    store, _, _ = _stored(read)
    return store.list().select("message", "total_files", "total_bytes", "new_objects")


_PHASES = "WITH e AS (SELECT event_id, event_id % 500 AS a, event_id % 60 AS b FROM events)"


@query(f"{_PHASES} SELECT event_id, unnest(['phases', 'index', 'index', 'index', 'index', 'phases', 'metadata', 'resources']) AS section, unnest(['index_total_ms', 'load_ms', 'check_ms', 'cached', 'new', 'build_tree_ms', 'tree_dirs', 'peak_rss_kb']) AS metric, CAST(unnest([a, b, a, b, a, b, a, event_id]) AS DOUBLE) AS value FROM e")
def q64_phase_lines(read):
    lines = F.array(
        F.format_string("  [index] %dms (load: %dms, check: %dms, cached: %d, new: %d)", "a", "b", "a", "b", "a"),
        F.format_string("[build_tree] %dms (%d dirs)", "b", "a"),
        F.format_string("peak_rss_kb=%d", "event_id"),
        F.lit("a line of another kind 5ms"),
    )
    e = read("events").select("event_id", (F.col("event_id") % 500).alias("a"), (F.col("event_id") % 60).alias("b"))
    return benchmarks.phases(e.select("event_id", F.explode(lines).alias("value")))


_RUNS = "WITH s AS (SELECT event_type AS scenario, user_id % 7 AS run, 'phases' AS section, CASE WHEN event_id % 2 = 0 THEN 'scan_ms' ELSE 'total' END AS metric, value FROM events)"


def _runs(read) -> DataFrame:
    return read("events").select(F.col("event_type").alias("scenario"), (F.col("user_id") % 7).alias("run"), F.lit("phases").alias("section"), F.when(F.col("event_id") % 2 == 0, "scan_ms").otherwise("total").alias("metric"), "value")


@query(f"{_RUNS}, r AS (SELECT scenario, count(DISTINCT run) AS ab_run_count FROM s GROUP BY 1) SELECT s.scenario, section, metric, CAST(count(value) AS DOUBLE) AS samples, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, any_value(ab_run_count) AS ab_run_count FROM s JOIN r ON s.scenario = r.scenario GROUP BY 1, 2, 3")
def q65_runs_rolled_up(read):
    up = benchmarks.rolled_up(_runs(read))
    return up.select("scenario", "section", "metric", "samples", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.col("min").alias("least"), F.col("max").alias("most"), "ab_run_count")


@query(f"{_RUNS} SELECT scenario, count(value) AS runs, round(avg(value), 6) AS mean, max(value) AS peak FROM s WHERE metric = 'scan_ms' GROUP BY 1")
def q66_resource_peaks(read):
    return benchmarks.peaks(_runs(read), ["scenario"], "scan_ms").select("scenario", "runs", F.round("mean", 6).alias("mean"), "peak")


@query(f"{_SAMPLES}, m AS (SELECT metric, median(value) AS median, avg(value) AS mean FROM s WHERE side = 'before' AND metric <> 'view' GROUP BY 1), a AS (SELECT metric, max(value) AS average FROM s WHERE side = 'after' GROUP BY 1) SELECT coalesce(m.metric, a.metric) AS metric, round(coalesce(median, average, mean), 6) AS shown FROM m FULL OUTER JOIN a ON m.metric = a.metric")
def q67_metric_resolved(read):
    s = derived.bench_samples(read("events"))
    averages = s.where("side = 'after'").groupBy("metric").agg(F.max("value").alias("value"))
    return benchmarks.resolved(benchmarks.summarize(s.where("side = 'before' and metric <> 'view'"), ["metric"]), averages, ["metric"]).select("metric", F.round("shown", 6).alias("shown"))


@query("SELECT concat('run-', cast(event_id // 500 AS varchar)) AS label, event_type AS scenario, row_number() OVER (PARTITION BY event_type, event_id // 500 ORDER BY event_id) - 1 AS iteration, 'wait_ms' AS metric, value FROM events WHERE value IS NOT NULL")
def q68_result_files(read):
    """The events as results of runs of 500 each, written to the shared folder and read."""
    run = F.concat(F.lit("run-"), F.floor(F.col("event_id") / 500).cast("string"))
    its = read("events").where("value is not null").groupBy(run.alias("label"), "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("all"))
    parsed = F.struct(F.transform("all", lambda x: F.create_map(F.lit("wait_ms"), x["value"])).alias("iterations"))
    runs = its.groupBy("label").agg(F.collect_list(F.struct(F.col("event_type").alias("name"), F.lit("events").alias("kind"), parsed.alias("parsed"))).alias("results"))
    path = f"{tables_dir(runs.sparkSession)}/results-{uuid.uuid4().hex}"
    runs.select(F.to_json(F.struct("label", "results")).alias("value")).write.text(path)
    return logs.read_results(runs.sparkSession, path, lines=True)


@query(f"{_STATES} SELECT count(*) AS n, round(100.0 * count(*) FILTER (size < 1024) / count(*), 6) AS tiny_percent, round(100.0 * count(*) FILTER (size >= 65536) / count(*), 6) AS large_percent, round(sum(size) / 1e6, 6) AS megabytes FROM s0 WHERE size > 0")
def q69_size_shares(read):
    return benchmarks.size_shares(_s(read, 0)).select("n", *(F.round(c, 6).cast("double").alias(c) for c in ("tiny_percent", "large_percent", "megabytes")))


@query("SELECT p_partkey, CASE WHEN s >= 60 THEN concat(cast(CAST(floor(s / 60) AS BIGINT) AS varchar), 'm ', printf('%.1f', s % 60), 's') ELSE concat(printf('%.1f', s), 's') END AS shown FROM (SELECT p_partkey, p_partkey * 0.5::DOUBLE AS s FROM part)")
def q70_human_duration(read):
    return read("part").select("p_partkey", text.human_duration(F.col("p_partkey") * F.lit(0.5)).alias("shown"))


@query(f"{_ENTRIES} SELECT pack_hash, blob_hash, unnest(range((\"offset\" + 24) // 256, greatest((\"offset\" + 24) // 256, (\"offset\" + 23 + compressed_len) // 256) + 1)) AS part, true AS whole FROM e")
def q71_pieces_rejoined(read):
    """Blobs cut at the borders of small parts; put together again they are what they were."""
    docs = read("documents").where("doc_id % 10 <> 3").select(F.md5("text").alias("blob_hash"), F.encode("text", "UTF-8").alias("data")).dropDuplicates(["blob_hash"])
    blobs = _entries(read).join(docs, "blob_hash")
    cut = written(packs.pieces(blobs, 256))
    whole = packs.rejoined(cut).select("pack_hash", "blob_hash", (F.md5("data") == F.col("blob_hash")).alias("whole"))
    return cut.select("pack_hash", "blob_hash", "part").join(whole, ["pack_hash", "blob_hash"])


@query("SELECT p_partkey, concat('pack-', p_brand, '.dat.part-', lpad(cast(p_size AS varchar), 6, '0')) AS name, p_brand AS pack, CAST(NULL AS varchar) AS other FROM part")
def q72_pack_of_part(read):
    named = read("part").select("p_partkey", "p_name", paths.part_name(F.col("p_brand"), F.col("p_size")).alias("name"))
    return named.select("p_partkey", "name", paths.pack_of_part(F.col("name")).alias("pack"), paths.pack_of_part(F.col("p_name")).alias("other"))
