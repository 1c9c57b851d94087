import importlib
from collections import Counter

import pytest

corpus_pipeline = importlib.import_module("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(tag, n, start=0):
    return " ".join(f"{tag}{i}" for i in range(start, start + n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    shared = prose("pass", 60)
    docs = [
        (1, prose("a", 120), "en", "s0"), (2, prose("a", 120) + "!", "en", "s0"), (3, prose("b", 80) + "\n" + shared, "en", "s1"), (4, prose("c", 90) + "\n" + shared + "\nend", "de", "s1"),
        (5, "too short", "en", "s2"), (6, None, "en", "s2"), (7, prose("d", 70) + " password = hunter2hunter2 " + prose("e", 20), "fr", "s2"), (8, prose("a", 120), "en", "s3"), (9, "again and " * 100, "en", "s3"),
    ]
    rows = [(i, t, lang, src, len(t or "")) for i, t, lang, src in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    assert set(seen["quality_rules"]) == {1, 2, 3, 4, 7, 8}
    assert set(seen["line_dedup"]) == {1, 2, 3, 4, 7}  # 8 repeats 1 wholly
    assert "pass3" in seen["line_dedup"][3].text and "pass3" not in seen["line_dedup"][4].text
    assert seen["line_dedup"][4].n_chars == len(seen["line_dedup"][4].text)
    assert set(seen["near_dedup"]) == {1, 3, 4, 7}
    assert "hunter2" not in seen["secret_scan"][7].text and "[SECRET]" in seen["secret_scan"][7].text
    pieces = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert all(n == total for (_, total), n in pieces.items()) and {i for i, _ in pieces} == {1, 3, 4, 7}


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
