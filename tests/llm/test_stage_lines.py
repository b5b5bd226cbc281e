from palimpsest.llm import pipeline_stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def own(k):
    return " ".join(f"w{k}x{j}" for j in range(60))


def without(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", h, len(t)) for i, t, h in rows], SCHEMA)
    return {r.doc_id: r.text for r in pipeline_stages.quality_rules(spark, docs, "").collect()}


def test_documents_with_several_lines_in_common(spark):
    """Unrelated documents that share a block of lines are as many documents; copies count once."""
    block = "\n".join(f"shared footer {j}" for j in range(8))
    rows = [(k, f"{own(k)}\n{block}", "h") for k in range(25)] + [(100 + k, f"{own('copy')}\nonly in copies", "h") for k in range(40)]
    got = without(spark, rows)
    assert all(got[k] == own(k) for k in range(25))
    assert all(got[100 + k].endswith("only in copies") for k in range(40))


def test_lines_of_large_hosts(spark):
    """A line in 25 documents goes, be the host small or large."""
    rows = [(k, f"{own(k)}\nshared line", "small" if k < 25 else "large") for k in range(50)] + [(100 + k, own(k + 100), "large") for k in range(2600)]
    got = without(spark, rows)
    assert all(got[k] == own(k) for k in range(50)) and len(got) == len(rows)
