import corpus_pipeline
from kvspark.llm import decontaminate, language, simhash

from .test_mixing import check
from .test_simhash import brute_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


def leaks(text, items, size=13):
    """Whether some window of a benchmark item is in the text, by plain search."""
    row = f" {b' '.join(decontaminate.words((text or '').encode())).decode()} "
    for t in items:
        w = decontaminate.words((t or "").encode())
        for i in range(max(1, len(w) - size + 1) if w else 0):
            if f" {b' '.join(w[i : i + size]).decode()} " in row:
                return True
    return False


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = language.recognised(docs).collect()  # trained here, so that there is no plain twin
    assert len(seen) > 0.99 * docs.count()
    comps = brute_components([plain_fingerprint(r.text) for r in seen], [r.doc_id for r in seen])
    left = [r for r, c in zip(seen, comps) if r.doc_id == c]
    clean = {r.doc_id for r in left if not leaks(r.text, items)}
    assert len(clean) < len(left)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(clean)
    check(got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names


def tables(spark, folder, rows, schema, items):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_one_passage_in_a_long_text_is_too_much(spark, tmp_path):
    passage = " ".join(f"item{k}" for k in range(13))
    long = [f"some{k} words" for k in range(1000)]
    rows = [(i, " ".join(f"{w}{i}" for w in long), "en", "s") for i in range(4)]
    rows[2] = (2, " ".join([*long[:400], passage, *long[400:]]), "en", "s")
    rows[3] = (3, " ".join([*rows[1][1].upper().split()[::-1], *passage.split()[:12], "end"]), "en", "s")
    sf = tables(spark, tmp_path, rows, "doc_id long, text string, lang string, source string", [(1, passage)])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == [0, 1, 3]


def test_cases(spark, tmp_path):
    words = lambda a, n=60: " ".join(f"word{a}x{k}" for k in range(n))
    passage = words("q", 20)
    rows = [
        (1, words(1), "en", "a", 5), (1, words(1), "en", "a", 5),  # a repeated row stays once
        (2, words(2), None, None, None), (None, words(3), "en", "b", 1), (None, words(3), "en", "b", 1),
        (4, None, "en", "a", 1), (5, "", "en", "a", 1), (6, "12 3!", None, "a", 1),  # no language
        (7, words(7, 100_000), "en", "a", 1), (8, words(1), "en", "c", 1),  # a copy of 1
        (9, passage.upper(), "en", "a", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_hit long"  # the name of a column of decontamination
    sf = tables(spark, tmp_path / "full", rows, schema, [(1, passage), (None, None), (2, "")])
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "7", "None"]
    check(got)
    none = [(*r[:2], None, *r[3:]) for r in rows]
    sf = tables(spark, tmp_path / "unlabelled", none, schema, [(1, passage)])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, sf).collect()) == ["1", "2", "7", "None"]
    sf = tables(spark, tmp_path / "empty", [], schema, [])
    assert corpus_pipeline.run(spark, sf).collect() == []
