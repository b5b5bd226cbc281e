"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over the characters of tokens are trained from labelled samples: random
strings (values that the fixed patterns matched, and generated ones of hexadecimal, base-62 and
base-64 digits) and ordinary identifiers (words and dotted, dashed or underscored names of the
corpus outside those values that are shorter than 16 characters or have no digit). A token of 16 characters or more with a digit and a letter whose mean
log-likelihood ratio is above the threshold is a secret of kind `markov`, unless a fixed pattern has
it already.

Defined results: null text is the empty text; offsets are code points, the end exclusive; repeated
rows give repeated results; an empty table gives an empty result (and models of generated strings
against none). The models are trained on a bounded sample of documents (`sample_docs`, chosen by a
hash of the id); every text is scanned whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order of spans that start together.
KINDS = ("assign", "access", "hex", "markov")


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more; shorter matches would be dropped
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
WORD = re.compile(r"[A-Za-z][A-Za-z0-9_.-]{3,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    spans = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return sorted(spans)


def codes(token: str) -> np.ndarray:
    """Places in ALPHABET; the last place is for all other characters."""
    return _PLACE[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]


_PLACE = np.full(256, len(ALPHABET), np.uint8)
_PLACE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET) + 1


#: Observations that a character's overall frequency counts for.
PRIOR = 20.0


class Markov:
    """Counts of character pairs; what was rarely seen after a character is judged by its overall frequency."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((SIZE, SIZE)) if counts is None else counts

    def add(self, token: str) -> None:
        c = codes(token)
        np.add.at(self.counts, (c[:-1], c[1:]), 1)

    def log_probabilities(self) -> np.ndarray:
        overall = self.counts.sum(0) + 0.5
        overall /= overall.sum()
        return np.log((self.counts + PRIOR * overall) / (self.counts.sum(1, keepdims=True) + PRIOR))


def generated_secrets(n: int, seed: int = 17) -> Iterator[str]:
    """Random strings of three alphabets, the same ones each time."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64] + "=")
    for k in range(n):
        yield "".join(rng.choices(alphabets[k % 3], k=rng.randint(16, 40)))


def train(docs: DataFrame, *, id_col: str, text_col: str, sample_docs: int) -> np.ndarray:
    """The matrix of log-likelihood ratios of character pairs, random string over identifier."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000)).select(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret, ordinary = Markov(), Markov()
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py() or ""
                taken = base_spans(text)
                for start, _, end in taken:
                    secret.add(text[start:end].split("=")[-1].strip("\"' :"))
                at = 0
                for start, _, end in [*taken, (len(text), 0, len(text))]:
                    for m in WORD.finditer(text, at, max(at, start)):
                        if len(m[0]) < 16 or not DIGIT.search(m[0]):  # others are what is to be judged
                            ordinary.add(m[0])
                    at = max(at, end)
        flat = np.concatenate([secret.counts.ravel(), ordinary.counts.ravel()])
        seen = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(flat[seen].astype(np.int64))], names=["pair", "n"])

    secret, ordinary = Markov(), Markov()
    for token in generated_secrets(3000):
        secret.add(token)
    # No more rows than the two matrices have places.
    got = sample.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(2 * SIZE * SIZE)
    flat[got["pair"].to_numpy()] = got["n"].to_numpy()
    secret.counts += flat[: SIZE * SIZE].reshape(SIZE, SIZE)
    ordinary.counts += flat[SIZE * SIZE :].reshape(SIZE, SIZE)
    return (secret.log_probabilities() - ordinary.log_probabilities()).astype(np.float32)


def markov_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int, int]]:
    """Tokens outside the base spans (sorted) that are more like random strings; both lists are walked once."""
    spans, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        token, start, end = m[0], m.start(), m.end()
        while at < len(taken) and taken[at][0] < end:  # reach: the furthest end of what starts before this token's end
            reach = max(reach, taken[at][2])
            at += 1
        if reach <= start and DIGIT.search(token) and LETTER.search(token):
            c = codes(token)
            if ratio[c[:-1], c[1:]].mean() > threshold:
                spans.append((start, 3, end))
    return spans


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every stretch that spans cover replaced by the mask."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if end > at:
            if start >= at:
                out += [text[at:start], mask]
            at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 3.5, sample_docs: int = 4000, redact: str | None = None) -> DataFrame:
    """One row a document: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    With redact (a mask), the columns of docs instead, secrets masked in the text.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(train(docs, id_col=id_col, text_col=text_col, sample_docs=sample_docs))  # 69 x 69 numbers
    names = ["n_assign", "n_access", "n_hex"]
    if redact is None:
        chosen = docs.select(id_col, text_col)
        schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_markov", T.LongType())])
        place = 1
    else:
        chosen, schema, place = docs, docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        llr = ratio.value
        for batch in batches:
            base_all, more_all, masked = [], [], []
            for x in batch.column(place):
                text = x.as_py() or ""
                base = base_spans(text)
                more = markov_spans(text, llr, base, threshold)
                if redact is None:
                    base_all.append(base)
                    more_all.append(more)
                else:
                    masked.append(redacted(text, base + more, redact) if base or more else x.as_py())
            if redact is None:
                counts = [pa.array([sum(s[1] == k for s in b) for b in base_all], pa.int64()) for k in range(3)]
                digests = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base_all], pa.string())
                columns = [batch.column(0), *counts, digests, pa.array([listed(b + m) for b, m in zip(base_all, more_all, strict=True)], pa.string()), pa.array(map(len, more_all), pa.int64())]
            else:
                columns = [pa.array(masked, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return chosen.mapInArrow(run, schema)
