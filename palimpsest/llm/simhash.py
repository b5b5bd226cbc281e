"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most two are alike in one half but for at most one bit.
So a fingerprint is indexed under 64 signatures: each half with each one of its bits deleted. An
equality join on signatures finds the candidates, which are verified. Work is done on distinct
fingerprints. Signatures with up to `bucket` fingerprints give their pairs; the fingerprints of larger
ones (a hot half) are linked exactly another way: each is listed under every value that is at most
one bit away. What is listed under one value is at most two bits apart, and what is at most two bits
apart has such a value in common; a value lists 65 fingerprints at most, so nothing is hot.

Components are found by passing least labels along links and to labels' own labels, until nothing
changes; each round is written to the shared folder. Only counts come to the driver.

Defined results: null or wordless texts have fingerprint zero and link like any other; fewer words
than a shingle make one shingle; a null id takes no part in a component's least id (null if there is
no other); repeated rows are further members; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forgotten, free_name, narrowed, written

#: Links differ in this many bits at most; the halves and the lists above follow from it.
MAX_BITS = 2
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    size = min(shingle, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 1 << 16):
        total += np.unpackbits(packed[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, *, text_col: str, name: str, drop_text: bool, shingle: int = 3) -> DataFrame:
    """docs with the fingerprint as a signed long; without the text if so asked."""
    place = docs.columns.index(text_col)
    fields = [f for f in docs.schema if not (drop_text and f.name == text_col)]
    schema = T.StructType([*fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(place)), np.uint64, batch.num_rows)
            columns = [c for k, c in enumerate(batch.columns) if not (drop_text and k == place)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def signatures(prints: DataFrame) -> DataFrame:
    """(fp, sig): each half of fp with one bit deleted; sig also tells the half and the bit."""
    # A written table of fingerprints is small and has few files: without a new deal few tasks would make 64 rows of each.
    dealt = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    one = dealt.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    return one.select("fp", F.expr("(cast(p as bigint) << 32) | (((fp >> (32 * (p div 32))) & 4294967295L) & ~(1L << (p % 32)))").alias("sig"))


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, bucket: int) -> DataFrame:
    """(a, b) with a < b: links of distinct fingerprints, enough of them to connect all that are linked."""
    buckets = written(signatures(prints).groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x")).where("n > 1"))
    twos = buckets.where("n <= 3").select("a", "b")
    # Of three, the third is what the exclusive or of all leaves.
    third = buckets.where("n = 3").select("a", F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b")).alias("c"), "b")
    twos = twos.unionByName(third.select("a", F.col("c").alias("b"))).unionByName(third.select(F.col("c").alias("a"), "b"))
    # Both sides grow with the corpus: a merge join at every size.
    more = written(signatures(prints).join(buckets.where("n > 3").select("sig", "n").hint("merge"), "sig"))
    few = more.where(F.col("n") <= bucket)
    pairs = few.select("sig", F.col("fp").alias("a")).join(few.select("sig", F.col("fp").alias("b")), "sig").where("a < b").select("a", "b")
    found = twos.unionByName(pairs).where(apart("a", "b") <= MAX_BITS).distinct()
    hot = more.where(F.col("n") > bucket).select("fp").distinct()
    near = hot.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("value"))
    listed = near.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = listed.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b").distinct()
    return found.unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for the nodes of edges (a, b)."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        own = both.join(labels.select(F.col("node").alias("a"), F.col("label").alias("of_a")), "a")
        seen = own.join(labels.select(F.col("node").alias("b"), F.col("label").alias("of_b")), "b")
        # A node, and the node that its label names, hear the labels of the node's neighbours.
        heard = seen.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("of_b").alias("label")), F.struct(F.col("of_a").alias("node"), F.col("of_b").alias("label")))).alias("x")).select("x.node", "x.label")
        least = written(heard.unionByName(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label")))
        jumped = least.join(least.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = written(jumped.join(labels.select("node", F.col("label").alias("old")), "node").select("node", "label", (F.col("label") != F.col("old")).alias("changed")))
        forgotten(least, labels)
        labels = narrowed(new, "node", "label")
        if new.where("changed").isEmpty():
            forgotten(both)
            return labels


def grouped(rows: DataFrame, *, id_col: str, bucket: int = 16) -> DataFrame:
    """(fp, component_id) of rows with id_col and fp: the least id of all rows in the component."""
    prints = written(rows.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    labels = written(components(links(prints.select("fp"), bucket)))
    named = written(prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label")))
    least = written(named.groupBy("label").agg(F.min("least_id").alias("component_id")))
    return written(named.select("fp", "label").join(least, "label").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = 16) -> DataFrame:
    """One row a document: id_col, fingerprint (16 hexadecimal digits), component_id."""
    rows = written(with_fingerprint(docs.select(id_col, text_col), text_col=text_col, name="fp", drop_text=True, shingle=shingle))
    groups = grouped(rows, id_col=id_col, bucket=bucket)
    return rows.join(groups, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = 16) -> DataFrame:
    """The rows of docs of which one stays for each component: the one with the least id (null last), of equal ones the first written."""
    row, fp, stays = free_name(docs, "row"), free_name(docs, "fp_"), free_name(docs, "stays")
    marked = written(with_fingerprint(docs.withColumn(row, F.monotonically_increasing_id()), text_col=text_col, name=fp, drop_text=False, shingle=shingle))
    rows = marked.select(F.col(fp).alias("fp"), F.col(id_col).alias("id_"), F.col(row).alias("row_"))
    # The components of fingerprints, named by the least fingerprint; rows are numbered, ids may not be.
    prints = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("id_").isNull().alias("last"), "id_", "row_")).alias("first")))
    labels = written(components(links(prints.select("fp"), bucket)))
    named = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    stay = written(named.groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first")).select(F.col("first.row_").alias(stays)))
    return marked.join(stay.hint("merge"), F.col(row) == F.col(stays), "left_semi").select(*docs.columns)
