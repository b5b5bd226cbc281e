import random

import pyarrow as pa

from palimpsest.llm import batches, bpe, near_copies, pipeline_stages, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def brute(rows):
    """The least id of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            both = len(a & b)
            if 10 * both >= 8 * (len(a) + len(b) - both):
                group[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return set(least.values())


def test_edited_copies_against_all_pairs(spark):
    """Copies edited more than SimHash's two bits allow, chains of them, a large group, a passage in all texts, short and empty texts."""
    rng = random.Random(3)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    passage, texts = words(25), []
    for _ in range(25):
        w = words(rng.randrange(30, 120)) + passage
        texts.append(w)
        for _ in range(4):  # each from the one before
            w = list(w)
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            texts.append(w)
    base = words(100)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(100)] = f"edit{rng.random()}"
        texts.append(w)
    texts += [["a", "b"], ["A", "b"], ["a", "c"], [], [], base, base]
    rng.shuffle(texts)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    want = brute(rows)
    out = pipeline_stages.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)
    assert simhash.one_of_each(docs).count() > len(want)


def test_documents_of_the_table(spark, all_docs):
    rows = [(r.doc_id if r.doc_id is not None else 1 << 60, r.text) for r in all_docs.collect()]
    assert {r.doc_id if r.doc_id is not None else 1 << 60 for r in near_copies.one_of_each(all_docs).collect()} == brute(rows)
    assert near_copies.one_of_each(all_docs.limit(0)).count() == 0


def test_simhash_is_the_first_step(spark, monkeypatch):
    """SimHash's links of different texts are found by fingerprints, verified, and connect texts before prefixes are joined."""
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(20):  # long texts with one word changed at the end: few bits differ
        w = words(600)
        texts += [w, [*w[:-1], f"edit{rng.random()}"]]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    candidates, verified = [], []
    by_prints, alike = near_copies.by_prints, near_copies.alike

    def kept(some):
        found = by_prints(some)
        candidates.append({tuple(r) for r in found.collect()})
        return found

    def checked(pairs, **same):
        found = alike(pairs, **same)
        verified.append({tuple(r) for r in found.collect()})
        return found

    monkeypatch.setattr(near_copies, "by_prints", kept)
    monkeypatch.setattr(near_copies, "alike", checked)
    out = pipeline_stages.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(brute(rows))
    sets = near_copies.shingle_sets([t for _, t in rows], 5)
    prints = [near_copies.print_of(s) & (1 << 64) - 1 for s in sets]
    bits = [sum(2 * sum(int(h) >> b & 1 for h in s) > len(s) for s in sets[:1]) for b in range(64)]
    assert [prints[0] >> b & 1 for b in range(64)] == bits
    near = sum((prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 2 for k in range(20))
    assert near and len(candidates[0]) == near and verified[0] == candidates[0]
    # Pairs that SimHash has connected don't meet again.
    assert len(verified[1]) == 20 - near and not verified[1] & verified[0]


def mapped(monkeypatch, spark, rows):
    """What near-dedup gives to mapInArrow."""
    given, frame = [], type(rows)
    plain = frame.mapInArrow

    def kept(self, run, *a, **b):
        given.append((run, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)))
        return plain(self, run, *a, **b)

    with monkeypatch.context() as m:
        m.setattr(frame, "mapInArrow", kept)
        pipeline_stages.near_dedup(spark, rows, "").collect()
    return given


def test_workers_hold_nothing_of_other_operators(spark, monkeypatch):
    """A worker that has encoded texts lets its tokenizer and words go before near-dedup's tasks; their batches are bounded in bytes."""
    w = [f"v{k}" for k in range(200)]
    texts = [" ".join(w), " ".join([*w[:-1], "edit"]), " ".join(w[::-1])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    given = mapped(monkeypatch, spark, docs)
    assert len(given) > 5 and {size for _, size in given} == {str(near_copies.BATCH_BYTES)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    for run, _ in given:
        memory = bpe._worker(queries.tokenizer_json())
        memory.learn({"word"})
        assert bpe._worker(queries.tokenizer_json()) is memory and "bpe" in batches._kept
        list(run(iter([])))
        assert "bpe" not in batches._kept


def test_kept_by_one_operator(monkeypatch):
    monkeypatch.setattr(batches, "_kept", {})
    batches.kept_by("a")["x"] = 1
    assert batches.kept_by("a") == {"x": 1}
    assert batches.kept_by("b") == {} and batches.kept_by("a") == {}
    task = batches.alone("b", lambda found: (b.slice(1) for b in found))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["n"])
    assert [b.num_rows for b in task(iter([batch, batch]))] == [1, 1] and list(batches._kept) == ["b"]
