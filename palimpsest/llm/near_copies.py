"""Near copies by SimHash, verified by exact Jaccard similarity of word shingles; what SimHash misses is joined by prefixes of ordered sets.

A text is the set of its 5-word shingles as 64-bit hashes (words as in `simhash`). Two sets of Jaccard
similarity t or more that are put in one order share a shingle among the first n - ceil(t n) + 1 of each
(n: the set's size), so an equality join on these prefixes misses no pair, whatever the order. Shingles that
are in many texts come last, which keeps common passages out of prefixes. What is known of them is a bit for
each of a fixed number of buckets of hashes; it decides about speed alone. Equal sets are one node.

SimHash comes first: a set's fingerprint has a bit of 64 set if over half of its shingles' hashes have it, and
fingerprints are linked as `simhash.links` does it, by deletion-variant signatures. Its links are candidates: sets
of one fingerprint with the first of them, the first ones of linked fingerprints with each other. Those that
are similar enough are connected. Similar sets may differ in more bits than signatures allow, so the prefixes
go on from there.

Candidates of prefixes are compared in two steps, and what is linked is connected after each: every node with the
first node of each of its prefix shingles, the one with the fewest shingles before it (of a group of edited
copies it is the least edited one, which most are similar to); then, of the nodes of a shingle that aren't in its largest
component, each with all nodes of other components. So a large group of near copies costs comparisons by
its size, and no pair that could connect two components is left out. Before whole sets are compared,
parities are: of each set a bit for each of about 2 n buckets says whether an odd number of shingles is in
it. Two sets' bits differ in no more places than the sets do, so what differs in too many is no pair.

Defined results: texts without words are equal to each other; fewer words than a shingle make one
shingle; of a component the row with the least id stays (null last), of equal ones the first written;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import alone, portions
from .lm_score import numbered
from .shared import forgotten, free_name, setting, swept, written
from .simhash import components
from .simhash import links as linked_prints

#: Buckets of hashes in the bit sets that are broadcast (8 MB); a shingle in more texts than this comes last.
BUCKET_BITS, OFTEN = 26, 16
#: Rows and characters whose shingles are made at once, rows that are given back at once, and comparisons with one node that one task makes.
ROWS, CHARS, AT_ONCE, TOGETHER = 10_000, 4_000_000, 200_000, 2048
#: Bytes of a batch that goes to Python, but for the last row: long texts and large sets come in fewer rows.
BATCH_BYTES = 8 << 20


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending."""
    coded, hashes = numbered(texts)
    of, out = hashes.view(np.uint64), []
    for c in coded:
        w, size = of[c], min(shingle, len(c))
        h = np.zeros(len(w) - size + 1 if size else 0, np.uint64)
        for j in range(size):
            h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - size + 1 + j]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        out.append(np.unique(h ^ h >> np.uint64(32)))
    return out


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Of 64-bit numbers of any kind: the upper bits of a multiplicative hash."""
    return (hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bit_set(numbers: DataFrame) -> np.ndarray:
    """A bit for each bucket that some number of the one column is in, packed; made as bitmaps of 32,768 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(buckets(batch.column(0).to_numpy(zero_copy_only=False))) + 1)], names=["bucket"])

    found = numbers.mapInArrow(alone("near_copies", run), "bucket long").groupBy(F.bitmap_bucket_number("bucket").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bucket")).alias("bits"))
    bits = np.zeros((1 << BUCKET_BITS) // 8, np.uint8)
    found = written(found)
    for part, b in found.toLocalIterator():
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(b), np.uint8)
    forgotten(found)
    return bits


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = buckets(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.bool_)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def often(rows: DataFrame, *, shingle: int) -> np.ndarray:
    """The bit set of shingles that are in many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in portions(batches, 0, rows=ROWS, chars=CHARS):
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts, shingle)]), return_counts=True)
            for at in range(0, len(found), AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + AT_ONCE].view(np.int64)), pa.array(n[at : at + AT_ONCE].astype(np.int32))], names=["token", "m"])

    counts = rows.select("text").mapInArrow(alone("near_copies", run), "token long, m int").groupBy("token").agg(F.sum("m").alias("m"))
    return bit_set(counts.where(F.col("m") > OFTEN).select("token"))


def parities(s: np.ndarray) -> bytes:
    size = max(64, 1 << int(2 * len(s)).bit_length())
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.bool_), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many places the parities of two sets differ; of sets with more buckets, halves are added up first."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    n, m = 8 * len(x), 8 * len(y)
    while n != m:
        if n > m:
            n //= 2
            a = a >> n ^ a & (1 << n) - 1
        else:
            m //= 2
            b = b >> m ^ b & (1 << m) - 1
    return (a ^ b).bit_count()


def print_of(s: np.ndarray) -> int:
    """The SimHash fingerprint of a set, as a signed 64-bit number: the bits that over half of its hashes have."""
    total = np.zeros(64, np.int64)
    octets = np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 1 << 16):
        total += np.unpackbits(octets[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(s), bitorder="little").tobytes(), "little", signed=True)


def nodes(rows: DataFrame, sent, *, shingle: int, percent: int) -> DataFrame:
    """Of rows (row, text, id) a node for each distinct set: node (the row of the least id), first (last, id, row), n, bits, prefix, fp."""
    import xxhash

    schema = T.StructType([*(rows.schema[c] for c in ("row", "id")), T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, 1, rows=ROWS, chars=CHARS):
            sets = shingle_sets(texts, shingle)
            ordered = (s[np.argsort(has(sent.value, s), kind="stable")][: prefix_length(len(s), percent)].view(np.int64) for s in sets)
            columns = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(map(parities, sets), pa.binary()), pa.array(list(ordered), pa.list_(pa.int64())), pa.array(map(print_of, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=schema.names)

    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    made = rows.select("row", "text", "id").mapInArrow(alone("near_copies", run), schema).groupBy("digest").agg(first, *(F.any_value(c).alias(c) for c in ("n", "bits", "prefix", "fp")))
    return made.select(F.col("first.row").alias("node"), "first", "n", "bits", "prefix", "fp")


def listed(some: DataFrame) -> DataFrame:
    """(token, node, at): the shingles of prefixes; at has the set's size and the shingle's place in its order, 32 bits each."""
    return some.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "node", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))


def may_be_alike(x: Column, y: Column, percent: int) -> Column:
    """Whether sets that have a shingle in common, but none before it in their orders, can be similar enough by their sizes and its places.

    Of each set only the shingle and what comes after it can be in both. A pair is judged by its first common
    shingle, wherever else it meets.
    """
    size = lambda at: F.shiftright(at, 32)
    both = F.least(size(x) - x.bitwiseAND(F.lit(0xFFFFFFFF)), size(y) - y.bitwiseAND(F.lit(0xFFFFFFFF)))
    return (100 * F.least(size(x), size(y)) >= percent * F.greatest(size(x), size(y))) & ((100 + percent) * both >= percent * (size(x) + size(y)))


def alike(pairs: DataFrame, rows: DataFrame, some: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose texts are similar enough.

    Parities rule most out. The sets of all b of one a meet a's set in tasks of bounded size. A bit
    set that spares no node in question tells, where texts are read, whose sets to make.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            # Of sets that are similar enough, at most so many shingles are in one only.
            apart = ((100 - percent) * (n + m) // (100 + percent)).tolist()
            stays = [differing(x.as_py(), y.as_py()) <= most for x, y, most in zip(batch.column(4), batch.column(5), apart, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(stays, pa.bool_()))

    of = lambda side: some.select("node", "n", "bits").toDF(side, f"n_{side}", f"bits_{side}").hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    fit = written(both.mapInArrow(alone("near_copies", possible), "a long, b long"))
    many = fit.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("shares"))
    dealt = written(fit.join(many.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), "b"))
    asked = dealt.select("a", "share", F.lit(1).alias("turn"), F.col("b").alias("node")).unionByName(dealt.select("a", "share").distinct().select("a", "share", F.lit(0).alias("turn"), F.col("a").alias("node")))
    sent = pairs.sparkSession.sparkContext.broadcast(bit_set(asked.select("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has(sent.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for some, found in portions([batch], 1, rows=500, chars=CHARS):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in shingle_sets(found, shingle)], pa.binary())], names=["node", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            turns, same = batch.column(1).to_pylist(), []
            for turn, h in zip(turns, batch.column(3), strict=True):
                other = np.frombuffer(h.as_py(), np.uint64)
                if turn:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    same.append(100 * both >= percent * (len(own) + len(other) - both))
                else:  # sorted: a's own set comes first
                    own = other
                    same.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    sets = rows.select(F.col("row").alias("node"), "text").mapInArrow(alone("near_copies", run), "node long, hashes binary")
    met = asked.join(sets.hint("merge"), "node").repartition("a", "share").sortWithinPartitions("a", "share", "turn")
    found = written(met.select("a", "turn", "node", "hashes").mapInArrow(alone("near_copies", compare), "a long, b long"))
    sent.destroy()
    forgotten(fit, dealt)
    return found


def by_prints(some: DataFrame, *, bucket: int = 16) -> DataFrame:
    """(a, b): the candidates of SimHash among nodes, by their fingerprints; some: (node, fp)."""
    first = written(some.groupBy("fp").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("k")))
    equal = some.join(first.where("k > 1").hint("merge"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    near = linked_prints(first.select("fp"), bucket)
    one = lambda side: first.select(F.col("fp").alias(side), F.col("a").alias(f"node_{side}")).hint("merge")
    apart = near.where("a <> b").join(one("a"), "a").join(one("b"), "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    found = written(equal.unionByName(apart).distinct())
    forgotten(first)
    return found


def links(rows: DataFrame, some: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """(a, b): links of nodes, enough of them to connect all that are linked; some: (node, n, bits, prefix, fp)."""
    same = {"rows": rows, "some": some, "shingle": shingle, "percent": percent}
    candidates = by_prints(some.select("node", "fp"))
    printed = alike(candidates, **same)
    forgotten(candidates)
    groups = components(printed)
    pos = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    tokens = written(listed(some).groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(pos).alias("least")).where("m > 1").drop("m"))
    swept(rows.sparkSession)
    shared = written(listed(some).join(tokens.hint("merge"), "token"))
    first = shared.where(pos == F.col("least")).groupBy("token").agg(F.min("node").alias("first"), F.min_by("at", "node").alias("first_at"))
    members = written(shared.drop("least").join(first.hint("merge"), "token"))
    forgotten(tokens, shared)
    stars = members.where(F.col("node") != F.col("first")).where(may_be_alike(F.col("at"), F.col("first_at"), percent)).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    # What SimHash has connected needn't meet again.
    group = lambda side: groups.toDF(side, f"group_{side}").hint("merge")
    stars = written(stars.join(group("a"), "a", "left").join(group("b"), "b", "left").where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b"))
    found = printed.unionByName(alike(stars, **same))
    forgotten(stars, groups)
    # Of a shingle's nodes, those outside its largest component still have to meet the others.
    labels = components(found)
    member = written(members.join(labels.hint("merge"), "node", "left").select("token", "node", "at", "first", F.coalesce("label", "node").alias("label")))
    forgotten(members, labels)
    sizes = member.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    # The first node of a shingle has met all its others.
    split = written(member.where(F.col("node") != F.col("first")).join(main.select("token", F.col("main.label").alias("main")).hint("merge"), "token").drop("first"))
    forgotten(member)
    left = split.where("label <> main").select("token", F.col("node").alias("x"), F.col("label").alias("of_x"), F.col("at").alias("at_x"))
    apart = (F.col("label") != F.col("of_x")) & ((F.col("label") == F.col("main")) | (F.col("x") < F.col("node")))
    met = left.join(split, (left["token"] == split["token"]) & apart & may_be_alike(F.col("at_x"), F.col("at"), percent))
    pairs = written(met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct())
    forgotten(split)
    found = found.unionByName(alike(pairs, **same))
    forgotten(pairs)
    return found


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one stays for each component of texts that are similar by `percent` or more."""
    row, stays = free_name(docs, "row"), free_name(docs, "stays")
    context = docs.sparkSession.sparkContext
    marked = written(docs.withColumn(row, F.monotonically_increasing_id()))
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        rows = marked.select(F.col(row).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
        sent = context.broadcast(often(rows, shingle=shingle))
        swept(docs.sparkSession)
        made = written(nodes(rows, sent, shingle=shingle, percent=percent))
        labels = components(links(rows, made.select("node", "n", "bits", "prefix", "fp"), shingle=shingle, percent=percent))
        named = made.join(labels.hint("merge"), "node", "left")
        stay = written(named.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(stays)))
        forgotten(made, labels)
    return marked.join(stay.hint("merge"), F.col(row) == F.col(stays), "left_semi").select(*docs.columns)
