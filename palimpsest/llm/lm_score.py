"""Stupid-backoff language-model scores, computed relationally.

Counting: every word (run of non-blanks, A-Z lower-cased) and every n-gram up to `order` words is counted
over the whole corpus, words by their 64-bit hashes; nothing is left out or merged. The count tables are
partitioned by ranges of the n-grams' hashes: each portion of texts sends its distinct n-grams with their
numbers to the partitions, sorted and packed, and each partition adds them up and answers the portions,
joined on hash. A portion sends an n-gram once, so a frequent one costs a partition no more than an entry
for each portion; partitions hold about `PART_KEYS` entries whatever the corpus. Portions meet their answers sorted,
one after the other. Tasks grow in number with the corpus, and what one holds at once is bounded by rows and
bytes, not by its share of the input.

Scoring: S(w | context) = c(context w) / c(context) if the n-gram also occurs outside the document that is
scored (its count exceeds the document's own: a document doesn't vouch for itself), else `backoff` times
the score with a shorter context; a word alone has c(w) / total. Logarithms are summed by document.

Texts are read once: the first pass writes them as word codes, with a list of distinct words for each portion,
which all further passes read. Each order is counted and answered before the next begins.

Defined results: texts without words (null, empty) score 0 with 0 words; repeated rows count as often
as they occur, vouch for each other and get equal scores; columns not named are ignored; an empty table
gives an empty result. All texts are counted and scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import portions
from .shared import forgotten, setting, written

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def numbered(texts: Iterable[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text its words as places in the list of distinct words' hashes, and that list."""
    import xxhash

    place: dict[bytes, int] = {}
    coded = []
    for text in texts:
        found = words(text)
        for w in found:
            if w not in place:
                place[w] = len(place)
        coded.append(np.fromiter(map(place.__getitem__, found), np.int64, len(found)))
    return coded, np.fromiter(map(xxhash.xxh64_intdigest, place), np.uint64, len(place)).view(np.int64)


#: Rows and characters of a portion of texts; n-grams of portions in a partition of a count table, about.
ROWS, CHARS, PART_KEYS = 2_500, 2_000_000, 1_000_000
#: What one task holds at once, however large its share is: portions of a row group and of a partition, bytes of a batch.
GROUP, TOGETHER, BATCH_BYTES = 8, 4, 8 << 20


def in_planes(codes: np.ndarray) -> bytes:
    """Numbers below 2^31 by halves, first the lower ones of all: the upper ones mostly are zero and compress."""
    c = codes.astype(np.uint32)
    return (c & np.uint32(0xFFFF)).astype(np.uint16).tobytes() + (c >> np.uint32(16)).astype(np.uint16).tobytes()


def of_planes(data: pa.Buffer) -> np.ndarray:
    low, high = np.frombuffer(data, np.uint16).reshape(2, -1)
    return low.astype(np.int64) | high.astype(np.int64) << 16


def tokens(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """A row for each portion of texts: ids, n (words), sizes (words of each), codes (places in words), words (hashes); numbers are packed."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("n", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "codes", "words"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, 1, rows=ROWS, chars=CHARS):
            coded, hashes = numbered(texts)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.concatenate([*coded, np.zeros(0, np.int64)])
            columns = [pa.ListArray.from_arrays([0, len(texts)], batch.column(0)), pa.array([len(flat)], pa.int64()), *(pa.array([x], pa.binary()) for x in (sizes.tobytes(), in_planes(flat), hashes.tobytes()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """The 64-bit key of n-grams whose words' hashes are given; of one word, the hash itself."""
    h = columns[0].astype(np.int64).view(np.uint64)
    for c in columns[1:]:
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(29)).view(np.int64) if len(columns) > 1 else h.view(np.int64)


class Portion:
    """The words of a portion's texts in order, as hashes, and where its n-grams are."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray, hashes: np.ndarray):
        self.sizes, self.own = sizes, hashes[codes]
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.last = np.repeat(np.cumsum(sizes), sizes)

    def starts(self, k: int) -> np.ndarray:
        """Where the k-grams begin that lie in one text."""
        return np.flatnonzero(np.arange(len(self.text)) + k <= self.last)

    def keys(self, k: int) -> np.ndarray:
        at = self.starts(k)
        return mixed([self.own[at + j] for j in range(k)]).view(np.uint64)


_PORTION = ("portion", "sizes", "codes", "words")


def portions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Portion, pa.RecordBatch]]:
    """Of batches that begin with the columns of _PORTION: each row's number, what it holds, and the row."""
    for batch in batches:
        for k in range(batch.num_rows):
            sizes, codes, hashes = (batch.column(c)[k].as_buffer() for c in (1, 2, 3))
            yield batch.column(0)[k].as_py(), Portion(np.frombuffer(sizes, np.int64), of_planes(codes), np.frombuffer(hashes, np.int64)), batch.slice(k, 1)


def packed(counts: np.ndarray) -> bytes:
    """Counts, which mostly are small: how many, a byte for each, and 8 bytes for each from 255 on."""
    return np.uint32(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    counts = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    large = counts == 255
    if large.any():
        counts[large] = np.frombuffer(data, np.int64, offset=4 + n)
    return counts


def stretches(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(partition, begin, end) of the stretches of ascending keys that belong to one partition; partitions are equal ranges of hashes."""
    of = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), np.bool_), of[1:] != of[:-1]]))
    return list(zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=False))


def added_up(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, with the sums of their numbers."""
    all_keys, n = np.concatenate(keys), np.concatenate(numbers)
    order = np.argsort(all_keys, kind="stable")
    all_keys, n = all_keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
    return all_keys[first], np.add.reduceat(n, first)


def gram_counts(coded: DataFrame, k: int, parts: int) -> DataFrame:
    """(portion, part, counts): for the distinct k-grams of each portion, ascending, and within a partition, how often they occur in all texts."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion, own, _ in portions_of(batches):
            keys, n = np.unique(own.keys(k), return_counts=True)
            rows = stretches(keys, parts)
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in some], pa.int32()), pa.array([portion] * len(some), pa.int64()), pa.array([keys[a:b].tobytes() for _, a, b in some], pa.binary()), pa.array([packed(n[a:b]) for _, a, b in some], pa.binary())],
                    names=["part", "portion", "keys", "n"],
                )

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of a partition's entries, added up; sorted by partition, they follow one another."""
        held: list[tuple[int, pa.Buffer, pa.Buffer]] = []
        part = -1

        def answers() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys = [np.frombuffer(x, np.uint64) for _, x, _ in held]
            table, sums = added_up(keys, [unpacked(x) for _, _, x in held])
            for at in range(0, len(held), 256):
                some = [packed(sums[np.searchsorted(table, own)]) for own in keys[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in held[at : at + 256]], pa.int64()), pa.array([part] * len(some), pa.int32()), pa.array(some, pa.binary())], names=["portion", "part", "counts"])

        for batch in batches:
            for p, portion, x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if p != part:
                    yield from answers()
                    held, part = [], p
                held.append((portion, x.as_buffer(), n.as_buffer()))
        yield from answers()

    entries = coded.select(*_PORTION).mapInArrow(sent, "part int, portion long, keys binary, n binary")
    # As many tasks as there are partitions: a task's share doesn't grow with the corpus.
    return entries.repartition(parts, "part").sortWithinPartitions("part", "portion").mapInArrow(answered, "portion long, part int, counts binary")


def log_scores(own: Portion, counts: list[np.ndarray], total: int, backoff: float) -> np.ndarray:
    """The sum of log S over each text of a portion; counts[k - 1]: of its distinct k-grams, ascending."""
    score = np.zeros(len(own.text))
    # By the place of a k-gram's last word: its count, and whether it occurs elsewhere.
    shorter = np.zeros(len(own.text))
    for k, c in enumerate(counts, 1):
        at = own.starts(k)
        if not len(at):
            break
        _, place = np.unique(own.keys(k), return_inverse=True)
        here, end = c[place], at + k - 1
        if k == 1:
            score[:] = np.log(here / max(1, total))
        else:
            pair = own.text[at] * np.int64(len(c)) + place
            _, same, n = np.unique(pair, return_inverse=True, return_counts=True)
            elsewhere = here > n[same]
            score[end] += math.log(backoff)
            score[end[elsewhere]] = np.log(here[elsewhere] / shorter[end[elsewhere] - 1])
        shorter = np.zeros(len(own.text))
        shorter[end] = here
    return np.add.reduceat(np.append(score, 0.0), np.minimum(np.cumsum(own.sizes) - own.sizes, len(score))) * (own.sizes > 0)


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, backoff: float = 0.4) -> DataFrame:
    """One row a document: id_col, n_words, log_score (natural logarithm of S over all words), mean_log_score (0 without words)."""
    if order < 1:
        raise ValueError("order 1 or more")
    spark = docs.sparkSession
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        coded = written(tokens(docs, id_col=id_col, text_col=text_col).withColumn("portion", F.monotonically_increasing_id()), **{"parquet.block.row.count.limit": GROUP})
        total, n_portions = coded.select(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        parts = max(1, -(-total // PART_KEYS))
        found = [written(gram_counts(coded, k, parts)) for k in range(1, order + 1)]
        scores = written(scored(coded, found, total, max(1, -(-n_portions // TOGETHER)), id_col=id_col, backoff=backoff))
    forgotten(coded, *found)
    return scores


def scored(coded: DataFrame, found: list[DataFrame], total: int, tasks: int, *, id_col: str, backoff: float) -> DataFrame:
    """The scores of all portions: each portion's row, then its answers of each order by partition, follow one another."""
    ids, order = coded.schema["ids"].dataType, len(found)
    rows = coded.select(*_PORTION, "ids", F.lit(0).alias("k"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("counts"))
    for k, answers in enumerate(found, 1):
        empty = (F.lit(None).cast("binary").alias(c) for c in _PORTION[1:])
        rows = rows.unionByName(answers.select("portion", *empty, F.lit(None).cast(ids).alias("ids"), F.lit(k).alias("k"), "part", "counts"))
    schema = T.StructType([T.StructField(id_col, ids.elementType), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_ids = None, None
        got: list[list[np.ndarray]] = []

        def scores() -> Iterator[pa.RecordBatch]:
            if own is not None:
                summed = log_scores(own, [np.concatenate([np.zeros(0, np.int64), *x]) for x in got], total, backoff)
                yield pa.RecordBatch.from_arrays([own_ids, pa.array(own.sizes), pa.array(summed), pa.array(summed / np.maximum(1, own.sizes))], names=schema.names)

        for batch in batches:
            for at, (k, counts) in enumerate(zip(batch.column(5).to_pylist(), batch.column(7), strict=True)):
                if k:
                    got[k - 1].append(unpacked(counts.as_buffer()))
                else:
                    yield from scores()
                    ((_, own, row),) = portions_of([batch.slice(at, 1)])
                    own_ids, got = row.column(4)[0].values, [[] for _ in range(order)]
        yield from scores()

    return rows.repartition(tasks, "portion").sortWithinPartitions("portion", "k", "part").mapInArrow(run, schema)
