"""Throttled clients, measured suites, and the stream's ledger."""

import pytest
from pyspark.sql import functions as F

from heliograph.operators import rerank
from heliograph.plans import clients, measured
from heliograph.plans.clients import Caller, Policy
from heliograph.streaming import ledger


class Clock:
    """Time that passes only where it is told to."""

    def __init__(self):
        self.now, self.slept = 100.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(round(seconds, 6))
        self.now += seconds


def scripted(*answers):
    """Calls answered in turn; an exception alone is raised."""
    calls, left = [], list(answers)

    def call(prompts):
        calls.append(list(prompts))
        said = left.pop(0)
        if isinstance(said, Exception):
            raise said
        return said

    return call, calls


def test_waits_grow_and_are_bounded():
    clock, (call, calls) = Clock(), scripted(*[TimeoutError("x")] * 5, ["at last"])
    assert Caller(call, Policy(retries=5), clock, clock.sleep).ask(["p"]) == [("at last", None, 6)]
    assert clock.slept == [1, 2, 4, 4, 4] and calls == [["p"]] * 6
    clock, (call, _) = Clock(), scripted(*[ValueError("no")] * 3)
    assert Caller(call, Policy(retries=2), clock, clock.sleep).ask(["p"]) == [(None, "failed after 3 attempts: ValueError", 3)]
    assert clock.slept == [1, 2]  # none after the last


def test_only_what_failed_is_sent_again():
    clock, (call, calls) = Clock(), scripted(["a", KeyError("k"), "c"], [None], ["b"])
    assert Caller(call, Policy(batch=3), clock, clock.sleep).ask(["1", "2", "3"]) == [("a", None, 1), ("b", None, 3), ("c", None, 1)]
    assert calls == [["1", "2", "3"], ["2"], ["2"]]
    clock, (call, _) = Clock(), scripted(["a"], ["a", "b"])  # too few answers are a failed call
    assert [x[0] for x in Caller(call, Policy(), clock, clock.sleep).ask(["1", "2"])] == ["a", "b"]


def test_calls_are_spaced_by_a_tasks_share_of_the_limit():
    clock, (call, _) = Clock(), scripted(["a"], ["b"], ValueError(), ["c"])
    caller = Caller(call, Policy(per_second=8, tasks=4), clock, clock.sleep)
    caller.ask(["1"])
    caller.ask(["2"])
    clock.now += 0.3
    caller.ask(["3"])
    assert clock.slept == [0.5, 0.2, 1.0]  # the wait after a failure is longer than the space
    with pytest.raises(ValueError, match="positive"):
        Policy(per_second=0)


def test_a_client_is_a_generator(spark):
    def call(prompts):
        if any("bad" in p for p in prompts):
            raise ConnectionError
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "a", [1]), (2, None, None), (None, "bad", []), (4, "d", [2])], "k long, prompt string, more array<int>")
    got = clients.client(call, Policy(retries=1, tasks=2), sleep=lambda s: None)(rows)
    assert sorted((r.k or 0, r.raw, r.error, r.calls, r.more) for r in got.collect()) == [(0, None, "failed after 2 attempts: ConnectionError", 2, []), (1, "A", None, 1, [1]), (2, None, "no prompt", 0, None), (4, "D", None, 1, [2])]
    assert all(r.seconds >= 0 for r in got.collect())
    made = clients.client(None, Policy(batch=4, tasks=1), make=lambda: lambda prompts: [f"{len(prompts)}" for _ in prompts])
    assert sorted(r.raw for r in made(rows.filter("prompt is not null")).collect()) == ["3", "3", "3"]
    assert got.filter("k < 0").count() == 0


# --- suites


def sets(spark):
    candidates = spark.createDataFrame([(q, i, i) for q, n in ((1, 5), (2, 3), (3, 1)) for i in range(1, n + 1)], "query_id long, item_id long, rank int")
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b")], "query_id long, category string")
    return measured.collected(candidates, queries, (3, 5, 3))


def test_candidates_are_sliced_and_shortages_told(spark):
    good, bad = sets(spark)
    assert sorted((r.query_id, r.top_k, r.item_ids) for r in good.collect()) == [(1, 3, [1, 2, 3]), (1, 5, [1, 2, 3, 4, 5]), (2, 3, [1, 2, 3])]
    assert sorted((r.query_id, r.top_k, r.stage, r.error) for r in bad.collect()) == [(2, 5, "candidate_count", "3 candidates"), (3, 3, "candidate_count", "1 candidates"), (3, 5, "candidate_count", "1 candidates"), (4, 3, "retrieval", "no candidates"), (4, 5, "retrieval", "no candidates")]
    with pytest.raises(ValueError, match="positive"):
        measured.collected(good, bad, ())


def timed(cost, fails=()):
    """A call and a clock on which a call of a prompt takes ``cost`` of it."""

    class Ticks:  # of this function, so that it goes to the tasks with it
        now = 0.0

        def __call__(self):
            return self.now

    clock = Ticks()

    def call(prompt):
        clock.now += cost(prompt)
        if prompt in fails:
            raise TimeoutError(prompt)
        return prompt

    return call, clock


def run(spark, call, clock, **more):
    good, _ = sets(spark)
    out = measured.measured(good, call, lambda i: F.concat(F.lit("item "), i.cast("string")), lambda l: F.concat(F.lit("list "), F.size(l).cast("string")), clock=clock, **more)
    return sorted(out.collect(), key=lambda r: r.run)


def test_runs_are_numbered_and_timed_where_they_are_made(spark):
    call, clock = timed(lambda p: 1.0 if p == "warm up" else 0.5 if p.startswith("list") else 0.01 * int(p[5:]))
    got = run(spark, call, clock, repeats=2)
    assert [(r.run, r.top_k, r.query_id, r.method, r.repeat) for r in got] == [(k + 1, *x) for k, x in enumerate((t, q, m, n) for t, q in ((3, 1), (3, 2), (5, 1)) for m in measured.METHODS for n in (1, 2))]
    assert [round(r.latency_ms) for r in got] == [60, 60, 500, 500] * 2 + [150, 150, 500, 500]
    assert got[0].answers == ["item 1", "item 2", "item 3"] and all(r.success and not r.degraded and r.peak_bytes > 0 for r in got)
    assert {r.worker for r in got} == {0} and [r.worker for r in run(spark, call, clock, workers=3)] == [0, 0, 1, 1, 2, 2]


def test_failures_are_rows_and_end_a_task(spark):
    call, clock = timed(lambda p: 0.001, fails=("item 2", "list 3"))
    got = run(spark, call, clock, repeats=1, most_failures=2, warm=None)
    assert [(r.error, r.success, r.latency_ms is None) for r in got] == [("TimeoutError: item 2", False, False), ("TimeoutError: list 3", False, False)] + [("aborted", False, True)] * 4
    call, clock = timed(lambda p: 0.001)
    got = run(spark, call, clock, usable=lambda method, answers: (method == "listwise", True))
    assert [(r.error, r.success, r.degraded) for r in got][:2] == [("unusable answers", False, True), (None, True, True)]
    with pytest.raises(ValueError, match="repeats"):
        run(spark, call, clock, repeats=0)


def test_suites_are_summed_up(spark):
    call, clock = timed(lambda p: 0.01)
    good, _ = sets(spark)
    out = measured.measured(good, call, lambda i: i.cast("string"), None, repeats=2, clock=clock)
    told = {(r.scope, r.group): (r.runs, r.failures, round(r["mean"])) for r in rerank.latency_suite(out).collect()}
    assert told[("overall", "all")] == (6, 0, 37) and told[("phase", "cold")] == (1, 0, 30) and told[("top_k", "5")] == (2, 0, 50) and told[("category", "b")] == (2, 0, 30)


# --- the ledger

ITEMS = "item_id long, sha256 string, valid boolean"


def feed(spark, tmp_path, rows):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def start(spark, tmp_path, asked, fails=lambda r: F.lit(False), attempts=3):
    def annotate(batch):
        asked.extend((r.item_id, r.sha256, r.attempt) for r in batch.collect())
        bad = fails(batch)
        return batch.withColumn("answer", F.when(~bad, F.concat(F.lit("about "), "sha256"))).withColumn("error", F.when(bad, "timeout"))

    q = ledger.annotate_new(spark, f"{tmp_path}/in", ITEMS, lambda df: df, annotate, f"{tmp_path}/out", f"{tmp_path}/checkpoint", attempts)
    q.awaitTermination()
    assert q.exception() is None


def test_a_ledger_asks_about_new_versions_and_failures_only(spark, tmp_path):
    asked = []
    feed(spark, tmp_path, [(1, "a", True), (1, "a", True), (2, "b", True), (3, "c", False), (4, "d", True)])
    start(spark, tmp_path, asked, lambda b: F.col("item_id").isin(2, 4))
    assert sorted(asked) == [(1, "a", 1), (2, "b", 1), (4, "d", 1)]
    feed(spark, tmp_path, [(1, "a", True), (1, "z", True), (5, "e", True)])
    asked.clear()
    (tmp_path / "out" / "done").rename(tmp_path / "out" / "elsewhere")  # what was written isn't read again
    start(spark, tmp_path, asked, lambda b: F.col("item_id") == 4)
    (tmp_path / "out" / "elsewhere" / "epoch=0").rename(tmp_path / "out" / "done" / "epoch=0")
    assert sorted(asked) == [(1, "z", 1), (2, "b", 2), (4, "d", 2), (5, "e", 1)]
    asked.clear()
    start(spark, tmp_path, asked, lambda b: F.col("item_id") == 4)
    assert asked == [(4, "d", 3)]
    asked.clear()
    start(spark, tmp_path, asked)
    assert asked == []
    assert sorted((r.item_id, r.sha256, r.attempt) for r in ledger.done(spark, f"{tmp_path}/out").collect()) == [(1, "a", 1), (1, "z", 1), (2, "b", 2), (5, "e", 1)]
    assert [(r.item_id, r.attempt, r.error) for r in ledger.failures(spark, f"{tmp_path}/out").collect()] == [(4, 3, "timeout")]
    assert sorted((r.item_id, r.sha256, r.answer) for r in ledger.current(spark, f"{tmp_path}/out").collect()) == [(1, "z", "about z"), (2, "b", "about b"), (5, "e", "about e")]


def test_a_batch_that_died_is_run_again_and_replaces_its_own(spark, tmp_path):
    feed(spark, tmp_path, [(1, "a", True), (2, "b", True)])

    def dying(batch):
        raise RuntimeError("died")

    q = ledger.annotate_new(spark, f"{tmp_path}/in", ITEMS, lambda df: df, dying, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    with pytest.raises(Exception, match="died"):
        q.awaitTermination()
    (tmp_path / "out" / "done" / "epoch=0").mkdir(parents=True)
    asked = []
    start(spark, tmp_path, asked)
    assert sorted(asked) == [(1, "a", 1), (2, "b", 1)] and ledger.done(spark, f"{tmp_path}/out").count() == 2
