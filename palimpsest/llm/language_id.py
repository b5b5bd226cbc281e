"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased; everything but letters becomes a blank, and runs of blanks one, with a blank at
either end. Every 1-, 2- and 3-gram of characters is hashed to one of `buckets` features. Training counts
features by language; the log-probability matrix (buckets x languages) is broadcast. Scoring is sparse, a
portion of texts at a time: the features of all texts are one row-compressed matrix of ones, whose
product with the log-probabilities is summed in numpy, a bounded number of features at once.

The classifier is fitted on a bounded sample: at most `docs_per_language` labelled training documents
of each language in expectation, chosen by a hash of the id, all of them where there are fewer; of the
`max_languages` languages with the most documents. `most_cells` bounds the matrix: with many languages
there are fewer buckets. Every text is predicted, whole, in pieces of bounded size that give the same
features as the whole.

Defined results: null text or no letter: `und`, score 0; nothing to learn from: `und` for all; ties go
to the first language in order; a null id counts as the empty text for the fold; repeated rows get
repeated results; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import portions

ORDERS = (1, 2, 3)
#: Characters of a text that are turned into features at once.
PIECE = 1 << 19
#: Texts and characters of a portion; numbers of the matrix that are looked up at once.
ROWS, CHARS, AT_ONCE = 512, 1 << 20, 1 << 22
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """By code point: whether it is a letter; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Feature numbers of a text's n-grams, piece by piece; nothing if it has no letter."""
    is_letter = letter_table()
    blank, text = np.array([32], np.uint32), text.replace("Σ", "σ")  # lower() would look at what follows a sigma
    done, fresh = blank[:0], blank  # the last characters whose n-grams have been given, and those still to come
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        fresh = np.concatenate([fresh, np.where(is_letter[c], c, np.uint32(32)), blank if at + PIECE >= len(text) else blank[:0]])
        before = np.concatenate([done[-1:] if len(done) else ~blank, fresh[:-1]])
        fresh = fresh[(fresh != 32) | (before != 32)]
        if not len(done) and not (fresh != 32).any():
            continue
        for n in ORDERS:
            c = np.concatenate([done[len(done) - min(n - 1, len(done)) :], fresh])
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                yield (h & np.uint32(buckets - 1)).astype(np.int32)
        done, fresh = np.concatenate([done, fresh])[-2:], blank[:0]


class NaiveBayes:
    def __init__(self, languages: list[str], log_probabilities: np.ndarray, priors: np.ndarray):
        """log_probabilities: buckets x languages."""
        self.languages, self.table, self.priors = languages, log_probabilities, priors

    def sums(self, rows: list[int], parts: list[np.ndarray], n_rows: int) -> np.ndarray:
        """The product of a sparse matrix of counts with the table: parts[k] has the features of some of row rows[k]."""
        out = np.zeros((n_rows, len(self.languages)))
        if parts and self.languages:
            columns = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            step = max(1, AT_ONCE // len(self.languages))
            for at in range(0, len(columns), step):
                here = columns[at : at + step]
                first = int(np.searchsorted(ends, at, side="right"))
                last = int(np.searchsorted(ends, at + len(here), side="left"))
                starts = np.concatenate([[0], ends[first:last] - at])
                np.add.at(out, rows[first : last + 1], np.add.reduceat(self.table[here], starts, axis=0, dtype=np.float64))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        rows, parts = [], []
        for k, text in enumerate(texts):
            for f in features(text or "", len(self.table)):
                rows.append(k)
                parts.append(f)
        total = self.sums(rows, parts, len(texts)) + self.priors
        seen = set(rows) if self.languages else set()
        out = [("und", 0.0)] * len(texts)
        for k in seen:
            best = int(total[k].argmax())
            out[k] = self.languages[best], float(1 / np.exp(total[k] - total[k, best]).sum())
        return out


def fold(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5


def train(docs: DataFrame, *, id_col: str, text_col: str, label_col: str, buckets: int, docs_per_language: int, max_languages: int, most_cells: int) -> NaiveBayes:
    labelled = docs.where(F.col(label_col).isNotNull() & (fold(id_col) != 0))
    sizes = {r[0]: r[1] for r in labelled.groupBy(label_col).count().orderBy(F.col("count").desc(), label_col).limit(max_languages).collect()}
    languages = sorted(sizes)
    while len(languages) * buckets > most_cells and buckets > 256:
        buckets //= 2
    if not languages:
        return NaiveBayes([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, int(1_000_000 * min(1.0, docs_per_language / sizes[name])))])
    sample = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isin(languages)).where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < F.try_element_at(share, F.col(label_col))).select(label_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), buckets), np.int64)
        place = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for f in features(text.as_py(), buckets):
                    counts[place[name]] += np.bincount(f, minlength=buckets)
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(counts[k, b])], names=["language", "bucket", "n"])

    rows = sample.mapInArrow(count, "language long, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # at most max_languages x buckets rows
    counts = np.zeros((len(languages), buckets))
    counts[got["language"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    learned = counts.any(1)  # others have labels but no text with a letter in the sample
    languages, counts = [x for x, k in zip(languages, learned, strict=True) if k], counts[learned]
    if not languages:
        return NaiveBayes([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    smooth = counts + 0.5
    table = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)
    priors = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))
    return NaiveBayes(languages, np.ascontiguousarray(table), priors)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", buckets: int = 1 << 16, docs_per_language: int = 4000, max_languages: int = 4096, most_cells: int = 1 << 24) -> DataFrame:
    """One row a document: id_col, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col=id_col, text_col=text_col, label_col=label_col, buckets=buckets, docs_per_language=docs_per_language, max_languages=max_languages, most_cells=most_cells))
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, 2, rows=ROWS, chars=CHARS):
            said = model.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=schema.names)

    return docs.select(F.col(id_col), (fold(id_col) == 0).alias("held_out"), F.col(text_col)).mapInArrow(run, schema)
