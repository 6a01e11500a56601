"""The corpus pipeline on a small folder."""

import corpus_pipeline
from tests.llm.helpers import LABELS, awkward, clashing, documents, prose


def folder(spark, docs, labels, items, path):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_decides(spark, tmp_path):
    clean = [(i, " ".join(prose(i, 90, 5000)) + "\nfooter line") for i in range(30)]
    near = [(100 + k, clean[3][1].replace(clean[3][1].split()[5], f"new{k}")) for k in range(3)]
    exact = [(110, clean[4][1])]
    item = " ".join(prose(77, 40, 5000))
    leaked = [(120, " ".join(prose(501, 60, 5000)) + " " + item)]
    noise = [(130 + k, " | ".join(f"{w}$$$" for w in prose(k, 90))) for k in range(8)]
    short = [(150, "far too short")]
    docs = documents(spark, [*clean, *near, *exact, *leaked, *noise, *short])
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in noise]
    path = folder(spark, docs, labels, [(1, item)], tmp_path)
    kept = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, path).write.parquet(f"{path}/{name}")
        kept = spark.read.parquet(f"{path}/{name}")
        assert kept.columns == docs.columns
        seen.append({r["doc_id"] for r in kept.collect()})
    good = {i for i, _ in clean}
    assert seen[0] == seen[1] == good | {100, 101, 102, 110, 120}
    assert seen[2] == good | {120}
    assert seen[3] == good
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert sum("footer" in t for t in texts.values()) == 1 and "footer" in texts[0]
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == good and all(r["sequence"] for r in rows)


def test_awkward_and_empty_tables(spark, tmp_path):
    docs = clashing(awkward(spark))
    path = folder(spark, docs, [], [], tmp_path / "a")
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == {5}
    path = folder(spark, docs.limit(0), [], [], tmp_path / "b")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_stages_on_awkward_rows_alone(spark, tmp_path):
    docs = clashing(awkward(spark))
    path = folder(spark, docs, [], [], tmp_path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        stage(spark, docs, path).count()
