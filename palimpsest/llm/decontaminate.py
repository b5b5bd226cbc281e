"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

The words of all items of a block, with a separator of its own after each item, make one suffix
automaton. A document's words stream through it; at each word the automaton holds the longest suffix
of what was read that some item contains. Where that length reaches the window, the last `window` words
are a passage of an item; an item shorter than the window counts where it occurs whole. Spans of hit
words can be removed, and documents covered beyond a limit dropped.

Items are cut into blocks of `block_words` words, the bound of what the driver holds, of what is broadcast
and of an automaton's memory. With one block, documents pass through it once. A larger benchmark has more
blocks: for each in turn all documents pass through its automaton, which is then dropped; what was hit is
written by document and block and merged at the end.

Defined results: null texts and texts without words have no words and no hits; null item texts no
windows; repeated items count by their ids, once each (n_items: distinct ids); a null item id takes
part as the empty string; repeated documents repeat their results; without items nothing is hit.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import kept_by, portions
from .shared import free_name, written

#: Bytes of UTF-8: A-Z become a-z, what isn't a word becomes a blank.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class SuffixAutomaton:
    """Of the items' words. By state: its transitions, its suffix link, the length of its longest string."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in words(t)] for _, t in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for k, item in enumerate(coded):
            for c in [*item, -1 - k]:
                last = self._extend(last, c)
        self.least = min((min(len(x), window) for x in coded if x), default=0)
        self._mark(coded)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = copy
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
        return new

    def _mark(self, coded: list[list[int]]) -> None:
        """By state: the state of its strings' last `window` words, and the short items that end there with their lengths."""
        n, w = len(self.next), self.window
        self.passage = [-1] * n
        self.items_of: dict[int, set[int]] = {}
        own: dict[int, dict[int, set[int]]] = {}
        for k, item in enumerate(coded):
            if 0 < len(item) < w:
                v = 0
                for c in item:
                    v = self.next[v][c]
                own.setdefault(v, {}).setdefault(len(item), set()).add(k)
        self.short: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= w:
                self.passage[v] = v if self.length[up] < w else self.passage[up]
            inherited = self.short[up]
            self.short[v] = inherited + tuple((size, frozenset(ks)) for size, ks in own[v].items()) if v in own else inherited
        for k, item in enumerate(coded):
            v = 0
            for at, c in enumerate(item):
                v = self.next[v][c]
                if at + 1 >= w:
                    self.items_of.setdefault(self.passage[v], set()).add(k)

    def scan(self, coded: list[int], offset: int) -> Iterator[tuple[int, int, set[int] | frozenset[int], int]]:
        """(first, past the last, items, longest matching length) of each window that ends in these words of a document."""
        nxt, link, length, passage, short, w = self.next, self.link, self.length, self.passage, self.short, self.window
        v = n = 0
        for at, c in enumerate(coded, offset + 1):
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(c)
            if to is None:
                continue
            v, n = to, n + 1
            if n >= w:
                yield at - w, at, self.items_of[passage[v]], n
            for size, ks in short[v]:
                if n >= size:
                    yield at - size, at, ks, n

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Stretches of hit words (merged, in order), the ids of items, the longest match that reached a window."""
        get, least = self.vocab.get, self.least
        if not least or len(found) < least:
            return [], set(), 0
        coded = np.fromiter((get(x, -1) for x in found), np.int64, len(found))
        gaps = np.flatnonzero(coded < 0)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.append(gaps, len(coded))
        spans: list[list[int]] = []
        items: set[int] = set()
        longest = 0
        for k in np.flatnonzero(ends - starts >= least):
            a = int(starts[k])
            for first, past, ks, n in self.scan(coded[a : ends[k]].tolist(), a):
                items |= ks
                longest = max(longest, n)
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and spans[-1][1] >= first:
                    spans[-1][1] = max(spans[-1][1], past)
                else:
                    spans.append([first, past])
        return [(a, b) for a, b in spans], {self.ids[k] for k in items}, longest


def item_blocks(items: DataFrame, *, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most block_words words (or one item), read block by block."""
    block: list[tuple[str, str | None]] = []
    size = 0
    for row in items.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator():
        n = len(words(row[1]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        if n:
            block.append((row[0] or "", row[1]))
            size += n
    if block:
        yield block


def _automaton(key: bytes, block: list[tuple[str, str | None]], window: int) -> SuffixAutomaton:
    """The block's automaton; a worker keeps one."""
    built = kept_by("decontaminate")
    if key not in built:
        built.clear()
        built[key] = SuffixAutomaton(block, window)
    return built[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


#: Rows and characters that are read at once.
ROWS, CHARS = 1000, 6_000_000
Found = tuple[list[tuple[int, int]], set[str], int]
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def as_structs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the stretches of words that spans name."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


class Block:
    """A block of items for the tasks of one pass."""

    def __init__(self, docs: DataFrame, items: list[tuple[str, str | None]], window: int):
        self.key, self.window = hashlib.sha256(repr((items, window)).encode()).digest(), window
        self.sent = docs.sparkSession.sparkContext.broadcast(items)

    def hits(self, found: list[bytes]) -> Found:
        return _automaton(self.key, self.sent.value, self.window).hits(found)


def result_fields(id_field: T.StructField) -> T.StructType:
    return T.StructType([id_field, *(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", _SPAN), T.StructField("longest_match", T.LongType())])


def result_batch(ids: pa.Array, n_words: list[int], all_found: list[Found], names: list[str]) -> pa.RecordBatch:
    rows = []
    for n, (spans, item_ids, longest) in zip(n_words, all_found, strict=True):
        ordered = sorted(item_ids)
        rows.append((n, sum(b - a for a, b in spans), len(ordered), hashlib.sha256(",".join(ordered).encode()).hexdigest(), bool(spans), ordered, as_structs(spans), longest))
    kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.string()), _ARROW_SPAN, pa.int64()]
    return pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)


def by_one_block(docs: DataFrame, block: Block, place: int, schema: T.StructType, clean: bool, max_coverage: float) -> DataFrame:
    def cleaned(text: str) -> str | None:
        """The text without hit words (again, as words that come together may make a window); None if too many are hit."""
        while True:
            own = words(text)
            spans, _, _ = block.hits(own)
            if not spans:
                return text
            if sum(b - a for a, b in spans) > max_coverage * len(own):
                return None
            text = cut(text, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, given in portions(batches, place, rows=ROWS, chars=CHARS):
            if clean:
                texts = [None if x is None else cleaned(x) for x in given]
                stays = pa.array([t is not None or x is None for t, x in zip(texts, given, strict=True)])
                columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(stays)
            else:
                found = [words(x) for x in given]
                yield result_batch(batch.column(0), [len(x) for x in found], [block.hits(x) for x in found], schema.names)

    return docs.mapInArrow(run, schema)


def hits_by_row(rows: DataFrame, blocks: Iterator[Block]) -> DataFrame:
    """(row, spans, ids, longest) of the rows (row, text) that some block hits; a pass for each block."""

    def passed(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, given in portions(batches, 1, rows=ROWS, chars=CHARS):
                found = [block.hits(words(x)) for x in given]
                hit = [k for k, f in enumerate(found) if f[0]]
                columns = [pa.array([as_structs(found[k][0]) for k in hit], _ARROW_SPAN), pa.array([sorted(found[k][1]) for k in hit], pa.list_(pa.string())), pa.array([found[k][2] for k in hit], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64())), *columns], names=["row", "spans", "ids", "longest"])

        return run

    out = None
    for block in blocks:
        one = written(rows.select("row", "text").mapInArrow(passed(block), "row long, spans array<struct<start: long, end: long>>, ids array<string>, longest long"))
        block.sent.destroy()
        out = one if out is None else out.unionByName(one)
    # A row has as many entries as blocks at most.
    return written(out.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("longest").alias("longest")))


def with_hits(rows: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    return rows.join(hits.withColumnRenamed("row", "h_row").hint("merge"), F.col("row") == F.col("h_row"), how)


def by_many_blocks(docs: DataFrame, blocks, text_col: str, schema: T.StructType, clean: bool, max_coverage: float) -> DataFrame:
    """blocks(): all blocks, one after another, as often as needed."""
    row = free_name(docs, "row_number")
    marked = written(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = marked.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    if not clean:
        id_col = schema.names[0]
        hits = hits_by_row(rows, blocks())

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, given in portions(batches, 1, rows=ROWS, chars=CHARS):
                found = [(merged([(x["start"], x["end"]) for x in s or ()]), set(i or ()), n or 0) for s, i, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield result_batch(batch.column(0), [len(words(x)) for x in given], found, schema.names)

        joined = with_hits(marked.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), hits, "left")
        return joined.select("id", "text", "spans", "ids", "longest").mapInArrow(told, schema)

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, given in portions(batches, 1, rows=ROWS, chars=CHARS):
            texts = []
            for text, spans in zip(given, batch.column(2).to_pylist(), strict=True):
                spans = merged([(x["start"], x["end"]) for x in spans])
                over = sum(b - a for a, b in spans) > max_coverage * len(words(text))
                texts.append(None if over else cut(text, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    changed, rest = None, rows.where("text is not null")
    while True:
        hits = hits_by_row(rest, blocks())
        if hits.isEmpty():
            break
        new = written(with_hits(rest, hits, "inner").select("row", "text", "spans").mapInArrow(shortened, "row long, text string"))
        changed = new if changed is None else written(new.unionByName(changed.join(new.select("row").hint("merge"), "row", "left_anti")))
        rest = new.where("text is not null")
    if changed is None:
        return docs
    c_row, c_text = free_name(marked, "c_row"), free_name(marked, "c_text")
    changed = changed.select(F.col("row").alias(c_row), F.col("text").alias(c_text))
    joined = marked.join(changed.hint("merge"), F.col(row) == F.col(c_row), "left").where(F.col(c_row).isNull() | F.col(c_text).isNotNull())
    return joined.select(*(F.coalesce(c_text, c).alias(c) if c == text_col else c for c in docs.columns))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 200_000, clean: bool = False, max_coverage: float = 0.5) -> DataFrame:
    """One row a document: id_col, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans (of word numbers), longest_match.

    With clean, the columns of docs instead: hit words are cut out of the text (again, until no window
    is left), and documents of which more than max_coverage of the words are hit are dropped.
    """
    if clean:
        chosen, schema, place = docs, docs.schema, docs.columns.index(text_col)
    else:
        chosen, schema, place = docs.select(id_col, text_col), result_fields(docs.schema[id_col]), 1

    def blocks() -> Iterator[Block]:
        for b in item_blocks(items, item_id=item_id, item_text=item_text, block_words=block_words):
            yield Block(docs, b, window)

    first_two = list(itertools.islice(item_blocks(items, item_id=item_id, item_text=item_text, block_words=block_words), 2))
    if len(first_two) < 2:
        return by_one_block(chosen, Block(docs, first_two[0] if first_two else [], window), place, schema, clean, max_coverage)
    return by_many_blocks(chosen, blocks, text_col, schema, clean, max_coverage)
