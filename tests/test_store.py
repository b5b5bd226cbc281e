import os

import pytest
from pyspark.sql import functions as F

from palimpsest.plans.errors import LockHeld, SnapshotNotFound
from palimpsest.plans.store import Store
from palimpsest.sources.workspace import read_workspace, with_content


def files(spark, contents, mode=33188):
    rows = [(p, c.encode(), len(c), 1, 0, mode, 1, i) for i, (p, c) in enumerate(sorted(contents.items()))]
    return spark.createDataFrame(rows, "path string, content binary, size long, mtime_secs long, mtime_nanos long, mode int, device long, inode long").withColumn("mtime_secs", F.crc32("content"))


def state(store, df):
    return store.hashed(df).select("path", "blob_hash", "size", "mode")


def test_life_of_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a = files(spark, {"x/a": "one", "x/b": "two", "c": "two", "node_modules/p": "dep"})
    first = store.save(a, "first")
    assert (first["total_files"], first["new_objects"], first["total_bytes"]) == (3, 2, 9)
    again = store.save(a)
    assert again["new_objects"] == 0
    rows = {r.id: r for r in store.list().collect()}
    assert rows[again["snapshot_id"]].manifest_snapshot_id == first["snapshot_id"] and rows[again["snapshot_id"]].parent_snapshot_id == first["snapshot_id"]
    b = files(spark, {"x/a": "changed", "c": "two", "d": "new"})
    second = store.save(b)
    assert second["new_objects"] == 2
    assert store.resolve("latest") == second["snapshot_id"]
    dry = store.restore(first["snapshot_id"], state(store, b))
    assert dry == {"files_added": 1, "files_changed": 1, "files_removed": 1, "files_unchanged": 1}
    # Back to the first state: the new snapshot's manifest is the first one's, not the latest one's.
    third = store.save(a)
    want = {(r.path, r.blob_hash) for r in store.manifest(first["snapshot_id"]).collect()}
    assert {(r.path, r.blob_hash) for r in store.manifest(third["snapshot_id"]).collect()} == want
    # The owner goes; its alias inherits the manifest.
    store.delete(first["snapshot_id"])
    assert {(r.path, r.blob_hash) for r in store.manifest(again["snapshot_id"]).collect()} == want
    with pytest.raises(SnapshotNotFound):
        store.delete("latest")


def test_save_after_collection_stores_blobs_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a = files(spark, {"a": "one", "b": "two"})
    gone = store.save(a)
    assert store.delete(gone["snapshot_id"])["dead_blobs"] == 2
    again = store.save(a)
    assert again["new_objects"] == 2
    data = {r.path: bytes(r.data) for r in store.restored("latest").collect()}
    assert data == {"a": b"one", "b": b"two"}


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_packs_are_bounded_and_their_space_is_freed(spark, tmp_path):
    import random

    rng, heard = random.Random(1), []
    body = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=3000))
    store = Store(spark, str(tmp_path / "s"), pack_bytes=30_000, progress=lambda step, figures: heard.append(step))
    shared, own = {f"k/{k}": body() for k in range(20)}, {f"o/{k}": body() for k in range(200)}
    first = store.save(files(spark, {**shared, **own}))
    packs = store.table("blobs").groupBy("pack_hash").agg(F.sum("compressed_len").alias("bytes"), F.count("*").alias("n")).collect()
    assert len(packs) > 10 and max(p.bytes for p in packs) < 100_000
    rows = store.table("blobs").collect()
    for p in packs:  # an entry begins where the one before it ends
        at = 8
        for r in sorted((r for r in rows if r.pack_hash == p.pack_hash), key=lambda r: r.blob_hash):
            assert (r.offset, r.compressed_len) == (at, len(r.data))
            at += 24 + r.compressed_len
    store.save(files(spark, shared))
    before = size_of(tmp_path / "s")
    gone = store.delete(first["snapshot_id"])
    assert gone["dead_blobs"] == 200 and gone["freed_packs"] > 0 and size_of(tmp_path / "s") < before / 2
    assert {r.path: bytes(r.data).decode() for r in store.restored("latest").collect()} == shared
    assert heard[0] == "scanned" and "packed" in heard and heard[-1] == "deleted"
    again = store.save(files(spark, {**shared, **own}))
    assert again["new_objects"] == 200 and store.restored("latest").count() == 220


def test_packs_cut_into_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    want = {f"a/{k}": chr(97 + k) * (k * 500) + str(k) for k in range(12)}
    store.save(files(spark, want), pack_chunk_bytes=64)
    assert store.table("blobs").count() > 12 and store.table("blobs").agg(F.max(F.length("data"))).first()[0] <= 64
    assert {r.path: bytes(r.data).decode() for r in store.restored("latest").collect()} == want
    extra = store.save(files(spark, {**want, "b": "more"}))
    store.delete(store.list().collect()[-1].id)
    assert {r.path: bytes(r.data).decode() for r in store.restored(extra["snapshot_id"]).collect()} == {**want, "b": "more"}


def test_damaged_blobs_and_roots(spark, tmp_path):
    from palimpsest.plans.errors import StoreCorrupted

    store = Store(spark, str(tmp_path / "s"))
    saved = store.save(files(spark, {"a/b": "one", "c": "two"}))
    stored = store.root_hash("latest")
    pointer = store._pointer()
    bare = store.table("snapshots").withColumn("root_tree_hash", F.lit(None).cast("string"))
    wrong = store.table("blobs").withColumn("data", F.first("data").over(__import__("pyspark").sql.Window.orderBy("blob_hash")))
    store._publish({**pointer, "snapshots": [store._write("snapshots", bare)], "blobs": [store._write("blobs", wrong)]})
    assert store.root_hash(saved["snapshot_id"]) == stored is not None
    empty = files(spark, {"z": "z"}).limit(0)
    with pytest.raises(StoreCorrupted):
        store.restore("latest", state(store, empty), str(tmp_path / "out"))


def test_hard_links_are_read_once(spark, tmp_path):
    from palimpsest.sources.generators import link_files

    root, log = tmp_path / "w", tmp_path / "read"
    link_files(str(root), packages=6, links=4, pool=5)

    def load(df):
        def noted(batches):
            for batch in batches:
                with open(log, "a") as f:
                    f.write("".join(f"{p}\n" for p in batch.column(batch.schema.get_field_index("relative_path")).to_pylist()))
                yield batch

        return with_content(df.mapInArrow(noted, df.schema), str(root))

    store = Store(spark, str(tmp_path / "s"))
    saved = store.save(read_workspace(spark, str(root)), load=load)
    assert (saved["total_files"], saved["new_objects"]) == (29, 5)
    assert len(log.read_text().split()) == 10  # once for the hashes, once for the contents
    assert store.restored("latest").count() == 29


def test_tools(spark, tmp_path):
    import io
    import json

    from palimpsest import api

    root = tmp_path / "w"
    root.mkdir()
    (root / "a").write_text("one")
    ask = [{"id": 1, "tool": "checkpoint_save", "arguments": {"root": str(root), "message": "m"}}, {"id": 2, "tool": "checkpoint_list", "arguments": {"root": str(root)}}, {"id": 3, "tool": "checkpoint_restore", "arguments": {"root": str(root), "ref": "zz"}}, {"id": 4, "tool": "other"}]
    out = io.StringIO()
    api.serve(spark, io.StringIO("\n".join(map(json.dumps, ask)) + "\nnot json\n"), out, str(tmp_path / "home"))
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert said[0]["result"]["total_files"] == 1 and said[1]["result"][0]["stats"]["total_bytes"] == 3 and len(said[1]["result"][0]["root_tree_hash"]) == 32
    assert said[2]["error"].startswith("SnapshotNotFound") and "error" in said[3] and "error" in said[4]
    assert [r["relative_path"] for r in api.scan(spark, str(root))] == ["a"]
    assert api.nth(spark, str(root), 1, home=str(tmp_path / "home")) == said[0]["result"]["snapshot_id"]


def test_lock(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with store._lock(), pytest.raises(LockHeld):
        store.save(files(spark, {"a": "x"}))


def test_empty_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    saved = store.save(files(spark, {"a": "x"}).limit(0))
    assert saved["total_files"] == 0 and store.manifest("latest").count() == 0


def test_workspace_round_trip(spark, tmp_path):
    root = tmp_path / "w"
    for name, body in {"a.txt": "1", "d/b.txt": "2", "d/.hidden": "3", ".git/HEAD": "no", "build/x": "no", "debug.log": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    os.symlink("a.txt", root / "link")
    (root / ".palimpsestignore").write_text("*.log\nbuild/\n")
    found = read_workspace(spark, str(root))
    assert {r.relative_path for r in found.collect()} == {"a.txt", "d/b.txt", "d/.hidden", "link", ".palimpsestignore"}
    store = Store(spark, str(tmp_path / "s"))
    saved = store.save(found, load=lambda df: with_content(df, str(root)))
    assert saved["total_files"] == 5
    (root / "a.txt").write_text("other")
    (root / "new").mkdir()
    (root / "new/extra").write_text("x")
    os.remove(root / "link")
    now = store.hashed(read_workspace(spark, str(root)), load=lambda df: with_content(df, str(root))).select("path", "blob_hash", "size", "mode")
    result = store.restore("latest", now, str(root))
    assert result == {"files_added": 1, "files_changed": 1, "files_removed": 1, "files_unchanged": 3}
    assert (root / "a.txt").read_text() == "1" and os.readlink(root / "link") == "a.txt" and not (root / "new").exists()


def test_command_line_and_views(spark, tmp_path, capsys):
    import json

    from palimpsest.__main__ import main
    from palimpsest.functions.hashing import short_id
    from palimpsest.plans.views import register

    root, home = tmp_path / "w", tmp_path / "home"
    root.mkdir()
    (root / "a").write_text("one")
    ask = lambda *args: (main(["--store", str(home), "--root", str(root), *args]), capsys.readouterr())
    code, said = ask("save", "-m", "first")
    ident = json.loads(said.out)["snapshot_id"]
    assert code == 0 and json.loads(ask("list")[1].out)["message"] == "first"
    (root / "a").write_text("changed")
    assert json.loads(ask("restore", "--dry-run")[1].out)["files_changed"] == 1
    ask("restore", ident[:20])
    assert (root / "a").read_text() == "one"
    names = register(Store(spark, str(home / "stores" / short_id(str(root)))))
    assert "store_pack_bytes" in names and spark.sql("select live_bytes, dead_bytes from store_pack_bytes").first() == (3, 0)
    assert ask("delete", ident)[0] == 0 and ask("delete", ident)[0] == 1
