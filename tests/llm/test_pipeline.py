import corpus_pipeline
from heliograph.llm import decontaminate, secret_scan

ROOT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "decontaminate", "secret_scan", "source_mix"]
    columns, held = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = held.count()
        held = spark.createDataFrame(stage(spark, held, ROOT).collect(), docs.schema)
        assert held.columns == columns and 0 < held.count() <= before, name
        if name == "language_id":
            assert held.count() >= 0.98 * before
    assert held.count() == held.select("doc_id").distinct().count()
    assert secret_scan.scan(held)[0].filter("size(findings) > 0").count() == 0
    bench = spark.read.parquet(f"{ROOT}/benchmark.parquet")
    assert decontaminate.contaminated(held, bench).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, held, ROOT)
    rows = mixed.collect()
    assert all(0 < r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - g) <= 1 for t, g in by.values())
