"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, white space as single blanks, trimmed) and hashed (MD5). For each
host, the distinct documents of a line are counted: a document is known by the hash of all its
normalised lines, so copies of one document count once, and a line that unrelated documents share counts
each of them. Lines in more documents of a host than the limit are removed (the limit is absolute, so it
acts alike in hosts of any size), and a document that loses more than a set share of its words is
rejected as depleted.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own;
an empty table gives an empty result; repeated rows are judged alike and count as copies; columns
that aren't named in the arguments are ignored. Nothing is gathered by document, host or line but
counts, so a hot host is only more rows for the same partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, words_of, written

#: A repeated three-word window is looked up in a short list of hashes as long as it is this short.
FEW_REPEATS = 12


def repeated_window_words(words: Column) -> Column:
    """How many words are in 3-word windows that occur twice or more."""

    def window_hashes(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))

    def covered(starts: Column) -> Column:
        """starts: ascending positions of windows; each covers three words, or those before the next window."""
        return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def by_list(h: Column, twice: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def by_sort(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))

    def count(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False)))))
        return let(twice, lambda t: F.when(F.size(t) == 0, F.lit(0).cast("long")).when(F.size(t) <= FEW_REPEATS, covered(by_list(h, t))).otherwise(covered(by_sort(h))))

    return let(words, lambda w: let(window_hashes(w), count))


def normalised_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def base_features(text: Column) -> dict[str, Column]:
    """The figures of single documents."""
    text = F.coalesce(text, F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_window_words(words_of(text)),
    }


def document_lines(docs: DataFrame, *, key: list[Column], host_col: str, text_col: str) -> DataFrame:
    """A row for each line with words of a document: the key, host, document (a hash of all its normalised lines), pos, line (MD5), words."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), normalised_line), lambda x: x != "")
    hashed = let(lines, lambda found: F.struct(F.md5(F.array_join(found, "\n")).alias("document"), F.transform(found, lambda x: F.struct(F.md5(x).alias("line"), (F.regexp_count(x, F.lit(" ")) + 1).alias("words"))).alias("lines")))
    some = docs.select(*key, F.col(host_col).alias("host"), hashed.alias("h"))
    kept = [c for c in some.columns if c != "h"]
    one = some.select(*kept, "h.document", F.posexplode_outer("h.lines").alias("pos", "x")).where(F.col("pos").isNotNull())  # a plain posexplode would filter by size first and make the lines twice
    return one.select(*kept, "document", "pos", F.col("x.line").alias("line"), F.col("x.words").alias("words"))


def frequent_lines(docs: DataFrame, *, host_col: str, text_col: str, max_documents: int) -> DataFrame:
    """(host, line, n_docs) of the lines in more distinct documents of a host than the limit: two partial aggregations, by document and by line."""
    lines = document_lines(docs, key=[], host_col=host_col, text_col=text_col)
    once = lines.select("host", "line", "document").distinct()
    return once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_documents)


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_documents: int = 20,
    max_removed_percent: int = 50,
    carry: tuple[Column, ...] = (),
) -> DataFrame:
    """One row a document: id_col, the base figures, base_failed, kept, n_removed_words (in lines above the limit), depleted, removed_lines (their hashes, or null)."""
    text, host = F.coalesce(F.col(text_col), F.lit("")), F.col(host_col)
    key = [F.col(id_col).alias("k_id"), F.xxhash64(text).alias("k_text")]
    carried = docs.select(*carry).columns if carry else []
    base = docs.select(F.col(id_col).alias("doc_key"), F.xxhash64(text).alias("text_key"), host.alias("host_key"), *(c.alias(n) for n, c in base_features(F.col(text_col)).items()), *carry)
    over = frequent_lines(docs, host_col=host_col, text_col=text_col, max_documents=max_documents)
    lines = document_lines(docs, key=key, host_col=host_col, text_col=text_col)
    # Written, so that their real sizes decide between a broadcast and a shuffle.
    over = written(over.select(F.col("host").alias("o_host"), F.col("line").alias("o_line")))
    hit = lines.join(over, (F.col("line") == F.col("o_line")) & F.col("host").eqNullSafe(F.col("o_host")))
    # Rows that are the same document twice have their lines twice: a position counts once.
    removed = hit.dropDuplicates(["k_id", "k_text", "host", "pos"]).groupBy("k_id", "k_text", "host").agg(F.sum("words").alias("all_removed"), F.collect_set("line").alias("removed_lines"))
    same = written(removed.select(F.col("k_id").alias("r_id"), F.col("k_text").alias("r_text"), F.col("host").alias("r_host"), "all_removed", "removed_lines"))
    # As many rows as documents with such lines: a merge join at every size.
    joined = base.join(same.hint("merge"), F.col("doc_key").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_text")) & F.col("host_key").eqNullSafe(F.col("r_host")), "left")
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = 100 * F.col("n_removed_words") > max_removed_percent * F.col("n_words")
    return (
        joined.withColumn("n_removed_words", F.coalesce("all_removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed)
        .withColumn("depleted", depleted)
        .select(F.col("doc_key").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"), "n_removed_words", "depleted", "removed_lines", *carried)
    )


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in removed (null: none)."""
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, F.md5(normalised_line(x))))
    return F.when(removed.isNull(), text).otherwise(F.array_join(left, "\n"))
