"""Staged runs: taken up after a death, refused when they don't match, and from a folder of images to indexes."""

import pytest
from pyspark.sql import functions as F

from heliograph.plans import directory, indexing, stages
from heliograph.plans.stages import Log, Run, Stage, content_digest


def three(spark, calls, source=3, dies=(), params=None, square=lambda c: c * c):
    """source -> squared -> total; ``calls`` notes which stages were made."""

    def made(name, make):
        def f(tables, at):
            calls.append(name)
            if name in dies:
                raise RuntimeError(f"{name} died\nat once")
            return make(tables)

        return f

    return [
        Stage("source", made("source", lambda t: spark.range(source).repartition(2)), source=True),
        Stage("squared", made("squared", lambda t: t["source"].select(square(F.col("id")).alias("x"))), ("source",), params or {}),
        Stage("total", made("total", lambda t: t["squared"].agg(F.sum("x").alias("total"))), ("squared",), check=lambda made, t: ["no total"] if made.first()[0] is None else []),
    ]


def test_a_run_that_died_is_taken_up(spark, tmp_path):
    calls, at = [], f"{tmp_path}/run"
    with pytest.raises(RuntimeError, match="total died"):
        Run(spark, at, {"n": 1}).run(three(spark, calls, dies=("total",)))
    state = Log(spark, f"{at}/state").read()
    assert (state["status"], state["current_stage"], state["stages"]["total"]["error"]) == ("failed", "total", "RuntimeError: total died")
    with pytest.raises(FileExistsError, match="resume"):
        Run(spark, at, {"n": 1})
    with pytest.raises(ValueError, match="something else"):
        Run(spark, at, {"n": 2}, resume=True)
    calls.clear()
    run = Run(spark, at, {"n": 1}, resume=True)
    assert run.run(three(spark, calls)) == {"source": "resumed", "squared": "resumed", "total": "made"}
    assert calls == ["source", "total"] and run.table("total").first()[0] == 5
    assert Log(spark, f"{at}/state").read()["status"] == "completed"
    assert not [p for p in (tmp_path / "run" / "stages").rglob(".*") if p.is_dir()]  # nothing half made is left


def test_a_killed_job_leaves_a_stage_running_and_files_that_dont_count(spark, tmp_path):
    at = f"{tmp_path}/run"
    run = Run(spark, at, {})
    run.run(three(spark, [])[:1])
    run._update("squared", "running", key="k")  # and then the machine went away
    (tmp_path / "run" / "stages" / "squared" / "k").mkdir(parents=True)
    (tmp_path / "run" / "state" / ".torn").write_text("{")
    assert Run(spark, at, {}, resume=True).run(three(spark, [])) == {"source": "resumed", "squared": "made", "total": "made"}


def test_changed_sources_are_refused_or_followed(spark, tmp_path):
    at = f"{tmp_path}/run"
    Run(spark, at, {}).run(three(spark, []))
    with pytest.raises(ValueError, match="source has changed"):
        Run(spark, at, {}, resume=True).run(three(spark, [], source=4))
    assert Run(spark, at, {}, resume=True).run(three(spark, [])) == {"source": "resumed", "squared": "resumed", "total": "resumed"}  # the old contents
    run = Run(spark, at, {}, resume=True, changed="rebuild")
    assert run.run(three(spark, [], source=4)) == {"source": "remade", "squared": "remade", "total": "remade"} and run.table("total").first()[0] == 14


def test_what_comes_out_as_before_changes_nothing_after_it(spark, tmp_path):
    at, calls = f"{tmp_path}/run", []
    Run(spark, at, {}).run(three(spark, []))
    done = Run(spark, at, {}, resume=True).run(three(spark, calls, params={"way": 2}, square=lambda c: F.pow(c, F.lit(2)).cast("long")))
    assert done == {"source": "resumed", "squared": "remade", "total": "resumed"} and calls == ["source", "squared"]


def test_faults_end_a_run(spark, tmp_path):
    with pytest.raises(ValueError, match="total: no total"):
        Run(spark, f"{tmp_path}/a", {}).run(three(spark, [], source=0))
    with pytest.raises(ValueError, match="needs"):
        Run(spark, f"{tmp_path}/b", {}).run(three(spark, [])[1:])
    with pytest.raises(ValueError, match="changed"):
        Run(spark, f"{tmp_path}/c", {}, changed="maybe")


def test_digests_are_of_contents(spark):
    a = spark.createDataFrame([(1, ["x"], {"k": 1}), (2, None, None), (2, None, None)], "a long, b array<string>, c map<string,int>")
    assert content_digest(a) == content_digest(a.repartition(3).select("c", "a", "b"))
    assert content_digest(a)[1] == 3
    assert len({content_digest(df)[0] for df in (a, a.dropDuplicates(["a"]), a.withColumnRenamed("a", "z"), a.filter("a = 1"), a.withColumn("a", F.col("a") + 1))}) == 5


# --- from a folder of images


def images(tmp_path, n=4):
    folder = tmp_path / "images"
    folder.mkdir(exist_ok=True)
    for k in range(n):
        (folder / f"{k}.jpg").write_bytes(b"image" + bytes([k]))
    (folder / "empty.png").write_bytes(b"")
    return str(folder)


def annotator(good=lambda c: F.lit(True)):
    said = F.lit('{"summary": "a house", "scene": "town", "search_queries": ["a", "b", "c"]}')

    def generate(rows):
        return rows.withColumn("raw", F.when(good(F.col("item_id")), said)).withColumn("error", F.when(~good(F.col("item_id")), "timeout"))

    return generate


def vectors(items):
    return items.select("item_id", F.array(F.lit(1.0), F.length("item_id").cast("double")).alias("vector"))


def test_a_folder_becomes_indexes_and_annotation_is_taken_up(spark, tmp_path):
    source, at = images(tmp_path), f"{tmp_path}/run"
    plan = {"prompt": "describe", "version": "v1", "image": vectors, "retries": 0}
    with pytest.raises(ValueError, match="validation: missing"):
        directory.run(spark, source, at, annotate=annotator(lambda c: ~c.endswith("0") & F.lit(False)), **plan)
    with pytest.raises(ValueError, match="something else"):
        directory.run(spark, source, at, resume=True, mode="image-only")
    run = directory.run(spark, source, f"{tmp_path}/other", annotate=annotator(), **plan)
    assert run.done == dict.fromkeys(("manifest", "annotation", "validation", "documents", "indexes"), "made")
    told = {r["branch"]: (r["items"], r["error"], r["folder"]) for r in run.table("indexes").collect()}
    assert told["image"][0] == 4 and told["bm25"][0] == 4 and told["text"][0] is None and "no vectors" in told["text"][1]
    assert indexing.stored_manifest(spark, told["bm25"][2])["count"] == 4
    again = directory.run(spark, source, f"{tmp_path}/other", resume=True, annotate=annotator(lambda c: F.lit(False)), **plan)
    assert set(again.done.values()) == {"resumed"}
    (tmp_path / "images" / "9.jpg").write_bytes(b"new")
    with pytest.raises(ValueError, match="manifest has changed"):
        directory.run(spark, source, f"{tmp_path}/other", resume=True, annotate=annotator(), **plan)


def test_without_annotation_only_vectors_are_indexed(spark, tmp_path):
    run = directory.run(spark, images(tmp_path), f"{tmp_path}/run", mode="image-only", limit=3, image=vectors)
    assert list(run.done) == ["manifest", "documents", "indexes"] and run.table("documents").count() == 3
    with pytest.raises(ValueError, match="mode"):
        directory.planned(spark, "x", mode="half")
    with pytest.raises(ValueError, match="generator"):
        directory.planned(spark, "x")
    assert stages.Stage("a", None).version == "1"
