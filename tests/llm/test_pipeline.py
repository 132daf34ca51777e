"""The pipeline's stages against brute force over their own inputs."""

import corpus_pipeline
from recfeat.llm import langid

from . import brute


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        path = str(tmp_path / str(at))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        after = {r.doc_id for r in rows}
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "language ID":
            und = {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}
            assert after.isdisjoint(und) and len(after) > 0.9 * (len(before) - len(und))
        elif name == "near-duplicates":
            assert after == {i for i, (_, c) in brute.near(list(before.items()), 5).items() if i == c}
        elif name == "decontamination":
            assert after == {i for i, *_, bad in brute.contamination(list(before.items()), bench) if not bad}
        else:
            assert after == set(before) and len(rows) == len(before)
    assert sorted({r.shard for r in rows}) == list(range(24))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
    assert langid.UNDETERMINED == "und"
