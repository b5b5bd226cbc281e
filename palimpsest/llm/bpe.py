"""BPE encoding and decoding by prefix-sharing trie traversal.

A word's encoding follows from the *last tokens* of its prefixes: the last token of a prefix is the
one vocabulary token that ends the prefix and can stand after the last token of what precedes it.
Distinct words are visited in sorted order, which is the depth-first order of their trie, so a state
is computed once for all words that share the prefix; only the path from the root to the present
node is in memory. A word's ids are read back along that path.

Defined results: null text is the empty text (0 tokens); tokens marked special in the vocabulary
file are found in the raw text first, as the tokenizers library does; rows are independent, so
repeated rows give repeated results, and an empty table an empty result. Texts are processed whole,
one at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import alone, kept_by, portions

#: White space of Unicode, and the pieces that a text is cut into.
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"

#: What a tokenizer file must say for the pieces above to be its own.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Words and characters of words in one generation of a Python worker's memory; it keeps two, so what is used again stays.
CACHED_WORDS, CACHED_CHARS = 120_000, 4_000_000
#: Pairs of tokens whose compatibility is remembered.
CACHED_PAIRS = 250_000
#: Documents, and characters but for the last document, that are encoded at once: their new words make one trie.
OUT_ROWS, OUT_CHARS = 1024, 3_000_000
WORD_END = 1 << 16


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class WordBpe:
    """BPE with word ends, from a tokenizers file of that kind."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        if d.get("normalizer") != NORMALIZER or d.get("pre_tokenizer") != PRE_TOKENIZER or d.get("decoder") or d.get("post_processor"):
            raise ValueError("a tokenizer of another kind: its normaliser, pieces or decoder aren't the built-in ones")
        m = d["model"]
        self.end: str = m["end_of_word_suffix"]
        self.vocab: dict[str, int] = m["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.text_of: dict[int, str] = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        # By token: when it is made (-1: from the start), and of which two.
        self.made: dict[int, int] = dict.fromkeys(self.vocab.values(), -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, xy = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[x, y], self.made[xy], self.halves[xy] = r, r, (x, y)
        self._build_suffixes()
        self._may_follow: dict[int, bool] = {}
        self._split = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or r"(?!)")
        self._byte = {i: c for i, c in enumerate(byte_alphabet())}
        import regex

        self._spaces, self._pieces = re.compile(f"[{SPACE}]+"), regex.compile(PIECES)

    def _build_suffixes(self) -> None:
        """An automaton of the tokens' strings: by state, the tokens that what was read ends with, longest first.

        A character that carries the word's end is a symbol of its own.
        """
        goto: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        edges: list[list[tuple[int, int]]] = [[]]
        for t, i in self.vocab.items():
            ends = len(t) > len(self.end) and t.endswith(self.end)
            symbols = list(map(ord, t[: -len(self.end)] if ends else t))
            if ends:
                symbols[-1] |= WORD_END
            at = 0
            for x in symbols:
                to = goto.get(at << 17 | x)
                if to is None:
                    to = goto[at << 17 | x] = len(own)
                    own.append(None)
                    edges.append([])
                    edges[at].append((x, to))
                at = to
            own[at] = len(symbols), i
        fail, outs, level = [0] * len(own), [()] * len(own), [0]
        while level:
            below = []
            for at in level:
                for x, to in edges[at]:
                    f = fail[at]
                    while at and f and f << 17 | x not in goto:
                        f = fail[f]
                    fail[to] = goto.get(f << 17 | x, 0) if at else 0
                    outs[to] = ((own[to],) if own[to] else ()) + outs[fail[to]]
                    below.append(to)
            level = below
        self._goto, self._fail, self._outs = goto, fail, outs

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging left's and right's characters together ends in just these two tokens.

        Time runs backwards: of the two tokens at the boundary, the one made last is taken apart. A
        merge across the boundary that would have come before that moment rules the pair out; at equal
        rank the leftmost pair of a text merges first.
        """
        key = left << 20 | right
        known = self._may_follow.get(key)
        if known is None:
            if len(self._may_follow) >= CACHED_PAIRS:
                self._may_follow.clear()
            known = self._may_follow[key] = self._boundary_holds(left, right)
        return known

    def _boundary_holds(self, x: int, y: int) -> bool:
        made, halves, rank = self.made, self.halves, self.rank
        before = len(rank) + 1.0
        while True:
            r = rank.get((x, y))
            if r is not None and r < before:
                return False
            if made[x] < 0 and made[y] < 0:
                return True
            if made[x] > made[y]:
                before, x = made[x], halves[x][1]
            else:
                before, y = made[y] + 0.5, halves[y][0]

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct non-empty words in the byte alphabet, in the depth-first order of their trie."""
        goto, fail, outs, follows, may_follow = self._goto, self._fail, self._outs, self._may_follow, self.may_follow
        token: list[int] = [-1]  # of the present path, by depth: the last token, the depth where it starts, the automaton's state
        start: list[int] = [0]
        state: list[int] = [0]
        before = ""
        for w in sorted(words):
            n, d = len(w), 0
            most = min(n - 1, len(token) - 1)
            while d < most and w[d] == before[d]:
                d += 1
            del token[d + 1 :], start[d + 1 :], state[d + 1 :]
            at = state[d]
            for d in range(d, n):  # the last character carries the word's end
                x = ord(w[d]) if d < n - 1 else ord(w[d]) | WORD_END
                to = goto.get(at << 17 | x)
                while to is None and at:
                    at = fail[at]
                    to = goto.get(at << 17 | x)
                at = to or 0
                for size, t in outs[at]:
                    s = d + 1 - size
                    if not s:
                        break
                    ok = follows.get(token[s] << 20 | t)
                    if ok or (ok is None and may_follow(token[s], t)):
                        break
                if d < n - 1:
                    token.append(t)
                    start.append(s)
                    state.append(at)
            ids = [t]
            while s:
                ids.append(token[s])
                s = start[s]
            yield w, ids[::-1]
            before = w

    def pieces(self, text: str) -> list[str]:
        """The pieces between special tokens: composed, white space as one blank, in lower case character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would look at what follows a sigma
        return self._pieces.findall(self._spaces.sub(" ", text).lower())

    def in_bytes(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self._byte)

    def segments(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Pieces of each stretch of ordinary text, and the special token after it, if any."""
        at = 0
        for m in self._split.finditer(text) if self.special else ():
            yield self.pieces(text[at : m.start()]), self.special[m[0]]
            at = m.end()
        yield self.pieces(text[at:] if at else text), None

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for pieces, special in self.segments(text or ""):
            own = {p: self.in_bytes(p) for p in dict.fromkeys(pieces)}
            known = dict(self.encode_words(set(own.values())))
            for p in pieces:
                ids += known[own[p]]
            ids += [] if special is None else [special]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings, special ones included, joined by a blank, as the library does where a file names no decoder."""
        return " ".join([self.text_of[i] for i in ids])


class Memory:
    """What a worker knows of words (pieces of text): their ids as text and their decoding, in two generations."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self.chars = 0
        self.old: tuple[dict[str, str], dict[str, str]] = {}, {}

    def learn(self, pieces: set[str]) -> None:
        """After it, ids and text know all of pieces."""
        ids, text = self.ids, self.text
        missing = pieces.difference(ids)
        if not missing:
            return
        self.chars += sum(map(len, missing))
        if len(ids) + len(missing) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self.old, self.ids, self.text = (ids, text), {}, {}
            self.chars = sum(map(len, pieces))
            ids, text = self.ids, self.text
            missing = pieces
        old_ids, old_text = self.old
        new = {}
        for p in missing:
            known = old_ids.get(p)
            if known is None:
                new[self.bpe.in_bytes(p)] = p
            else:
                ids[p], text[p] = known, old_text[p]
        for w, found in self.bpe.encode_words(new):
            p = new[w]
            ids[p], text[p] = " ".join(map(str, found)), self.bpe.decode(found)


def _worker(spec: str) -> Memory:
    """The tokenizer and the words encoded so far, once in each Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    loaded = kept_by("bpe")
    if key not in loaded:
        loaded.clear()
        loaded[key] = Memory(WordBpe(spec))
    return loaded[key]


def encode_documents(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """One row a document: id_col, n_tokens, ids_sha256, decoded_sha256, then `keep`, then input_ids if with_ids.

    tokenizer_json is a file's content (about 2 MB whatever the corpus) and goes along with the tasks.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_json)
    fields = [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *(docs.schema[c] for c in keep)]
    fields += [T.StructField("input_ids", T.ArrayType(T.IntegerType(), False))] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, sha = _worker(spec.value), hashlib.sha256
        for batch, texts in portions(batches, 1, rows=OUT_ROWS, chars=OUT_CHARS):
            counts, id_digests, text_digests, lists = [], [], [], []
            segmented = [list(memory.bpe.segments(text or "")) for text in texts]
            memory.learn({p for segments in segmented for pieces, _ in segments for p in pieces})
            ids_of, text_of = memory.ids.__getitem__, memory.text.__getitem__
            for segments in segmented:
                ids, decoded = [], []
                for pieces, special in segments:
                    ids += map(ids_of, pieces)
                    decoded += map(text_of, pieces)
                    if special is not None:
                        ids.append(str(special))
                        decoded.append(memory.bpe.text_of[special])
                joined = " ".join(ids)
                counts.append(joined.count(" ") + 1 if joined else 0)
                id_digests.append(sha(joined.encode()).hexdigest())
                text_digests.append(sha(" ".join(decoded).encode()).hexdigest())
                if with_ids:
                    lists.append(np.fromstring(joined, np.int32, sep=" ") if joined else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string()), *batch.columns[2:]]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, np.concatenate(lists), type=pa.list_(pa.field("element", pa.int32(), False))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, F.col(text_col), *keep).mapInArrow(alone("bpe", run), T.StructType(fields))
