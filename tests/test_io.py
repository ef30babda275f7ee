import hashlib

import pytest
from pyspark.sql import functions as F

from heliograph.plans import generation
from heliograph.sources import readers, sinks
from heliograph.streaming import incremental


def test_scan_directory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jpg").write_bytes(b"one")
    (tmp_path / "b.png").write_bytes(b"one")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.relative_path: r for r in readers.scan_directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/x.jpg", "b.png"} and got["b.png"].duplicate_of == got["a/x.jpg"].item_id
    assert readers.scan_directory(spark, str(tmp_path), limit=1).count() == 1
    sinks.write_manifest(readers.scan_directory(spark, str(tmp_path)), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/quality")).first().duplicates == 1 and spark.read.json(str(tmp_path / "m/faults")).first().fault == "duplicate"
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no images"):
        readers.scan_directory(spark, str(tmp_path / "none"))


def test_scan_split(spark, tmp_path):
    for name in ("10.jpg", "9.jpg", "x.png"):
        (tmp_path / name).write_bytes(b"same")
    got = {r.item_id: r for r in readers.scan_split(spark, str(tmp_path), "Train").collect()}
    assert set(got) == {"train-9", "train-10"} and got["train-10"].duplicate_of == "train-9" and got["train-9"].relative_path == "Train/9.jpg"


def test_lines_and_judgments(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n[1]\nbad\n')
    good, bad = readers.json_lines_checked(spark, str(tmp_path / "l.jsonl"))
    assert [r.line for r in good.collect()] == [1] and sorted((r.line, r.error) for r in bad.collect()) == [(3, "not an object"), (4, "not JSON")]
    # lines keep their numbers where a file is read in several splits
    (tmp_path / "long.jsonl").write_text("\n".join('{"k": %d, "pad": "%s"}' % (k, "x" * (k % 97)) if k % 50 else "" for k in range(1, 3001)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    long, _ = readers.json_lines_checked(spark, str(tmp_path / "long.jsonl"))
    assert long.select(F.get_json_object("value", "$.k").cast("int").alias("k"), "line").filter("k <> line").count() == 0 and long.count() == 2940
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    strict = readers.json_lines(spark, str(tmp_path / "long.jsonl"), "k int, pad string")
    assert strict.count() == 2940
    (tmp_path / "wrong.jsonl").write_text('{"k": "no"}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.json_lines(spark, str(tmp_path / "wrong.jsonl"), "k int").collect()
    (tmp_path / "q.csv").write_text("query_id,image_id,relevance\nq,a,1\nq,a,2\n")
    assert [(r.item_id, r.relevance) for r in readers.judgments_csv(spark, str(tmp_path / "q.csv")).collect()] == [("a", 2)]


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.write_atomic(spark.range(3).toDF("x"), at)
    sinks.write_atomic(spark.range(5).toDF("x"), at)
    assert spark.read.parquet(at).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    table = spark.createDataFrame([("a_b", 0.5, True), ('say "x", y', 0.25, False)], "n string, v double, success boolean")
    assert r"a\_b" in sinks.latex_table(table)
    sinks.write_with_failures(table.select("n", F.when(F.col("success"), None).otherwise("bad").alias("error")), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1 and spark.read.json(str(tmp_path / "f.failures")).first().error == "bad"
    sinks.write_evaluation(table, table, str(tmp_path / "e"))
    text = next((tmp_path / "e/summary_csv").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("\ufeffn,v,success\n") and '"say ""x"", y"' in text and spark.read.json(str(tmp_path / "e/failures_json")).count() == 1
    assert "tabular" in "".join(p.read_text() for p in (tmp_path / "e/summary_tex").glob("part-*"))
    sinks.write_ablation(table, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="no ablation"):
        sinks.write_ablation(table.filter("false"), str(tmp_path / "b"))
    sinks.write_benchmark(table, table.limit(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2 and spark.read.json(str(tmp_path / "r.summary")).count() == 1
    sinks.write_import(table.select(F.col("n").alias("item_id")).limit(1), table.limit(0), spark.createDataFrame([("a_b",), ("c",)], "item_id string"), str(tmp_path / "i"))
    assert [r.item_id for r in spark.read.json(str(tmp_path / "i/missing")).collect()] == ["c"]
    digest = sinks.write_delivery(spark.createDataFrame([("{}",)], "value string"), "{\"k\": 1}", str(tmp_path / "d"))
    assert digest == hashlib.sha256(b'{"k": 1}').hexdigest() and spark.read.text(str(tmp_path / "d/batches")).count() == 1


def test_incremental(spark, tmp_path):
    schema = "item_id string, valid boolean"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def annotate(df):
        """A generator that never answers for one item, with two tries."""
        say = lambda rows: rows.withColumns({"raw": F.when(F.col("item_id") != "bad", '{"summary": "s", "search_queries": ["a", "b", "c"]}'), "error": F.lit(None).cast("string")})
        good, bad = generation.annotated(df, "describe", say, "v1", retries=1)
        return good.select("item_id", "answer", F.lit(None).cast("string").alias("error")).unionByName(bad.select("item_id", F.lit(None).cast("string").alias("answer"), "error"))

    for rows in ([("a", True), ("bad", True), ("no", False)], [("a", True), ("b", True)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        incremental.annotate_stream(spark, src, schema, annotate, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.item_id for r in spark.read.json(out).collect()) == ["a", "b"]
    assert {r.item_id for r in spark.read.json(out + ".failures").collect()} == {"bad"}
