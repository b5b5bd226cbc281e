"""Personal data by patterns and bootstrapped contexts, in DataFrame functions only.

Fixed patterns give the seeds: emails, IP addresses, card and phone numbers. Bootstrapping then looks
at identifier-like tokens (five digits or more, or an @) and the two words before each. Patterns (those
words, digits as 0) and instances (the tokens) form a bipartite graph. Instances are labelled or not: seeds have
confidence one, ordinary numbers (tokens that stand after many different words) confidence zero, what is
discovered its own, and the rest is unlabelled and says nothing for or against a pattern. A pattern's
trust is the mean confidence of its labelled instances; patterns of enough confidence in all and enough
trust vouch for their other instances, whose confidence is one minus the product of the patterns' doubts.
Instances above the threshold are discovered, count like seeds from then on with their confidence, and
the rounds go on until nothing is added; a pattern's word counts a little less than the instances that
made it, so confidence fades with the distance from real seeds. Discovered instances are spans of kind
`context` wherever no base span overlaps them.

Defined results: null text is the empty text; a row's spans are its own, so repeated rows repeat them;
offsets are code points, the end exclusive; an empty table gives an empty result. All matches of all
texts count. Java's regular expressions stay linear here: repetitions are possessive where nothing
could be given back, and a match starts only where a run starts or where the last match ended. Work
is linear in a text's length: offsets are sums over blocks of matches, what is exploded carries no text,
and spans meet by equal stretches of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forgotten, let, written

#: Kinds in the order of spans that start together.
KINDS = ("email", "ip", "card", "phone", "context")

_LOCAL, _PART = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_PART}++(?:\.{_PART}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be there at all; cheaper than the pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+"}
#: A token with a digit or an @ and the digit groups after it.
TOKEN = r"(?<!\S)\S*[0-9@]\S*(?:\x20[(]?[0-9]\S*)*+"


#: Matches whose offsets are summed in one go; sums of blocks are summed in blocks again.
BLOCK = 256


def running_sums(lengths: Column) -> Column:
    """array<bigint> of the sums up to and with each place, in blocks, so that no growing array is copied for each place."""
    none = F.expr("cast(array() as array<bigint>)")

    def of_few(few: Column) -> Column:
        return F.aggregate(few, none, lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long")) + x)))

    def of_blocks(few: Column, add) -> Column:
        """few: an array of blocks' running sums; add(total before the block, block)."""
        before = let(few, lambda f: F.transform(f, lambda x: F.get(x, F.size(x) - 1)))
        return let(before, lambda t: let(add(t), lambda sums: F.flatten(F.transform(few, lambda x, k: F.transform(x, lambda y: y + F.when(k > 0, F.get(sums, k - 1)).otherwise(F.lit(0)))))))

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: of_few(F.slice(all_, at + 1, F.lit(BLOCK))))

    def in_blocks(all_: Column, deeper: int) -> Column:
        if not deeper:
            return of_few(all_)
        return let(cut(all_), lambda few: of_blocks(few, lambda totals: in_blocks(totals, deeper - 1)))

    return let(lengths, lambda n: F.when(F.size(n) <= BLOCK, of_few(n)).otherwise(in_blocks(n, 2)))


def matches(text: Column, pattern: str, body) -> Column:
    """body(hits, gaps, ends) of a pattern's non-overlapping matches, leftmost first, what stands between them, and where they end.

    What stands between the matches comes from split(), the matches from regexp_extract_all(); both
    walk the text the same way, so offsets are running sums of lengths.
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return let(found, lambda f: let(running_sums(F.transform(f["hits"], lambda x, i: (F.length(x) + F.length(F.get(f["gaps"], i))).cast("long"))), lambda ends: body(f["hits"], f["gaps"], ends)))


def match_spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end, match>> of a pattern's matches; keep: which of them."""
    spans = matches(text, pattern, lambda hits, gaps, ends: F.transform(hits, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("match"))))
    return F.filter(spans, lambda s: keep(s["match"])) if keep else spans


def n_digits(s: Column) -> Column:
    return F.regexp_count(s, F.lit("[0-9]"))


def passes_luhn(s: Column) -> Column:
    """Every second digit from the right counts twice (less nine above nine); the sum is a multiple of ten."""

    def total(d: Column) -> Column:
        def value(i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + value(i))

    return let(F.regexp_replace(s, "[^0-9]", ""), total) % 10 == 0


KEEP = {
    "email": None,
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda m: F.when(n_digits(m).between(14, 19), passes_luhn(m)).otherwise(F.lit(False)),
    "phone": lambda m: n_digits(m).between(10, 15),
}
_NONE = "cast(array() as array<struct<start: bigint, end: bigint, match: string>>)"


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the spans that the fixed patterns find in a text that isn't null."""
    hint = {k: text.contains(h) if len(h) == 1 else text.rlike(h) for k, h in HINTS.items()}
    return {k: F.when(hint[k], match_spans(text, PATTERNS[k], KEEP[k])).otherwise(F.expr(_NONE)) for k in PATTERNS}


def listed(spans: Column) -> Column:
    """`kind:start:end` of array<struct<start, kind (its place in KINDS), end>>, in that order, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def text_key(id_col: str, text: Column) -> list[Column]:
    return [F.col(id_col).alias("k_id"), F.xxhash64(text).alias("k_text")]


def candidates(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(k_id, k_text, start, end, instance, pattern) of the identifier-like tokens after two words; rows of one id and text count once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    wraps = "\"'(\\[<,;:"

    def one(hits: Column, gaps: Column, ends: Column):
        def token(x: Column, i: Column) -> Column:
            # Every match has a word, so the two words before one are in the two matches before it and what stands between.
            before = F.concat(*(F.coalesce(c, F.lit("")) for c in (F.get(hits, i - 2), F.get(gaps, i - 1), F.get(hits, i - 1), F.get(gaps, i))))
            lead = F.regexp_extract(x, f"^[{wraps}]*+", 0)
            bare = F.regexp_replace(F.substring(x, F.length(lead) + 1, F.length(x)), "(?<![\"')\\]>,;:.!?])[\"')\\]>,;:.!?]++$", "")
            return F.struct((F.get(ends, i) - F.length(x) + F.length(lead)).alias("start"), bare.alias("instance"), F.reverse(F.regexp_extract(F.reverse(before), r"^\s*+(\S++\s++\S++)", 1)).alias("before"))

        wanted = F.transform(hits, lambda x, i: F.when((n_digits(x) >= 5) | x.contains("@"), token(x, i)))
        return F.filter(wanted, lambda t: t.isNotNull())

    some = docs.where(F.col(text_col).rlike("[0-9@]")).select(*text_key(id_col, text), matches(text, TOKEN, one).alias("tokens"))
    rows = some.select("k_id", "k_text", F.explode_outer("tokens").alias("t")).where("length(t.instance) > 0 and length(t.before) > 0")
    pattern = F.regexp_replace(F.regexp_replace(F.lower("t.before"), r"\s++", " "), "[0-9]", "0")
    return rows.select("k_id", "k_text", "t.start", (F.col("t.start") + F.length("t.instance")).alias("end"), F.lower("t.instance").alias("instance"), pattern.alias("pattern")).distinct()


#: Code points of the stretches of a text by which spans meet.
STRETCH = 1024


def touching(spans: DataFrame, base: DataFrame, kind: str) -> DataFrame:
    """The rows of spans (k_id, k_text, start, end) with a base span of the same text that overlaps them ("left_semi"), or without ("left_anti")."""

    def stretches(df: DataFrame) -> DataFrame:
        return df.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))))

    b = stretches(base).select(F.col("k_id").alias("b_id"), F.col("k_text").alias("b_text"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("stretch").alias("b_stretch"))
    same = F.col("k_id").eqNullSafe(F.col("b_id")) & (F.col("k_text") == F.col("b_text")) & (F.col("stretch") == F.col("b_stretch"))
    hit = stretches(spans).join(b, same & (F.col("b_start") < F.col("end")) & (F.col("b_end") > F.col("start")), "left_semi").select("k_id", "k_text", "start", "end").distinct()
    hit = hit.select(F.col("k_id").alias("h_id"), F.col("k_text").alias("h_text"), F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    return spans.join(hit, F.col("k_id").eqNullSafe(F.col("h_id")) & (F.col("k_text") == F.col("h_text")) & (F.col("start") == F.col("h_start")) & (F.col("end") == F.col("h_end")), kind)


def bootstrap(found: DataFrame, *, min_seeds: float, min_pattern: float, min_instance: float, fading: float, many_patterns: int) -> DataFrame:
    """(instance) of the unseen instances that trusted patterns vouch for; found: (pattern, instance, seed)."""
    edges = written(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    first = edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    first = first.select("instance", F.when(F.col("seed"), 1.0).when(F.col("n") > many_patterns, 0.0).alias("confidence"), (F.col("seed") | (F.col("n") > many_patterns)).alias("fixed"))
    instances = written(first)
    known = 0
    while True:
        labelled = edges.select("pattern", "instance").join(instances.where("confidence is not null").hint("merge"), "instance")
        patterns = labelled.groupBy("pattern").agg(F.avg("confidence").alias("trust"), F.sum("confidence").alias("mass")).where((F.col("mass") >= min_seeds) & (F.col("trust") >= min_pattern))
        doubt = F.log(1 - F.lit(fading) * F.col("trust"))
        vouched = edges.select("pattern", "instance").join(patterns.hint("merge"), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(doubt))).alias("vouched"))
        new = F.when(F.col("fixed"), F.col("confidence")).when(F.col("vouched") >= min_instance, F.greatest("vouched", F.coalesce("confidence", F.lit(0.0)))).otherwise(F.col("confidence"))
        later = written(instances.join(vouched.hint("merge"), "instance", "left").select("instance", new.alias("confidence"), "fixed"))
        forgotten(instances)
        instances, before = later, known
        known = instances.where("not fixed and confidence is not null").count()
        if known == before:
            forgotten(edges)
            return instances.where("not fixed and confidence is not null").select("instance")


def find_personal_data(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_seeds: float = 3.0,
    min_pattern: float = 0.8,
    min_instance: float = 0.8,
    fading: float = 0.95,
    many_patterns: int = 8,
) -> DataFrame:
    """One row a document: id_col, counts of the base kinds, base_sha256, spans, n_context, n_spans (of any kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(*text_key(id_col, text), text.alias("text_"))
    own = own.select("k_id", "k_text", *(s.alias(k) for k, s in base_spans(F.col("text_")).items()))
    own = written(own.select("k_id", "k_text", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), F.concat(*(of_kind(F.col(k), k) for k in PATTERNS)).alias("base")))
    base = written(own.where("size(base) > 0").select("k_id", "k_text", F.explode("base").alias("s")).select("k_id", "k_text", "s.start", "s.end").distinct())
    found = written(candidates(docs, id_col=id_col, text_col=text_col))
    seeds = touching(found, base, "left_semi")
    others = written(touching(found, base, "left_anti"))
    edges = seeds.select("pattern", "instance", F.lit(True).alias("seed")).unionByName(others.select("pattern", "instance", F.lit(False).alias("seed")))
    unseen = bootstrap(edges, min_seeds=min_seeds, min_pattern=min_pattern, min_instance=min_instance, fading=fading, many_patterns=many_patterns)
    more = others.join(unseen.hint("merge"), "instance", "left_semi")
    more = more.groupBy(F.col("k_id").alias("m_id"), F.col("k_text").alias("m_text")).agg(F.collect_set(F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end")).alias("more"))
    both = own.join(more, F.col("k_id").eqNullSafe(F.col("m_id")) & (F.col("k_text") == F.col("m_text")), "left")
    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")
    n_context = F.coalesce(F.size("more"), F.lit(0)).cast("long")
    return both.select(
        F.col("k_id").alias(id_col),
        *(f"n_{k}" for k in PATTERNS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", F.coalesce("more", none))).alias("spans"),
        n_context.alias("n_context"),
        (F.size("base") + n_context).cast("long").alias("n_spans"),
    )
