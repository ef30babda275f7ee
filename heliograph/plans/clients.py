"""Clients of a slow and fallible service, run where the rows are: batched, throttled, and tried again after growing waits.

``client`` makes a generator (see ``generation``) of a function that calls the service. Each task calls for its own rows, some
at a time; a call that fails is repeated for those prompts only that have no answer yet, after 1, 2, 4, ... seconds, at most
``most_wait``. A limit of calls a second holds for all ``tasks`` together: each takes its share, and keeps to it by spacing its
calls. Clock and sleep are arguments, so that tests need no time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Call = Callable[[list[str]], list]


@dataclass(frozen=True)
class Policy:
    """``batch`` prompts a call; ``retries`` after the first try; calls ``per_second`` of all ``tasks`` together (None: no limit)."""

    batch: int = 1
    retries: int = 2
    most_wait: float = 4.0
    per_second: float | None = None
    tasks: int = 8

    def __post_init__(self):
        if self.batch < 1 or self.retries < 0 or self.tasks < 1 or self.most_wait < 0 or (self.per_second is not None and self.per_second <= 0):
            raise ValueError("batch and tasks must be positive, retries and most_wait not negative, per_second positive")


class Caller:
    """Calls for one task. ``call`` takes prompts and returns an answer for each: a text, or an exception."""

    def __init__(self, call: Call, policy: Policy, clock=time.monotonic, sleep=time.sleep):
        self.call, self.policy, self.clock, self.sleep = call, policy, clock, sleep
        self.next = None

    def _turn(self) -> None:
        """Wait until this task may call again."""
        if self.policy.per_second is None:
            return
        gap, now = self.policy.tasks / self.policy.per_second, self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + gap

    def ask(self, prompts: list[str]) -> list[tuple[str | None, str | None, int]]:
        """(answer, error, calls) of each prompt."""
        out: list[tuple[str | None, str | None, int]] = [(None, "not asked", 0)] * len(prompts)
        todo = list(range(len(prompts)))
        for n in range(self.policy.retries + 1):
            self._turn()
            try:
                said = self.call([prompts[k] for k in todo])
                if len(said) != len(todo):
                    raise ValueError(f"{len(said)} answers to {len(todo)} prompts")
            except Exception as e:  # the whole call failed
                said = [e] * len(todo)
            for k, answer in zip(todo, said):
                ok = isinstance(answer, str)
                out[k] = (answer, None, n + 1) if ok else (None, f"failed after {n + 1} attempts: {type(answer).__name__}", n + 1)
            todo = [k for k, answer in zip(todo, said) if not isinstance(answer, str)]
            if not todo:
                break
            if n < self.policy.retries:
                self.sleep(min(2.0**n, self.policy.most_wait))
        return out


def client(call: Call, policy: Policy = Policy(), clock=time.monotonic, sleep=time.sleep, make: Callable[[], Call] | None = None):
    """A generator: rows with ``prompt`` get raw, error, calls (how often their prompt was sent) and seconds (till it was answered).

    ``make`` builds ``call`` in the task instead, for clients that can't be sent there. A null prompt is an error.
    """

    def generate(rows: DataFrame) -> DataFrame:
        schema = StructType(list(rows.schema.fields)).add("raw", "string").add("error", "string").add("calls", "integer").add("seconds", "double")
        shape, at = to_arrow_schema(schema), rows.columns.index("prompt")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            caller = Caller(make() if make else call, policy, clock, sleep)
            for b in batches:
                prompts, said, took = b.column(at).to_pylist(), [], []
                for lo in range(0, len(prompts), policy.batch):
                    part, began = prompts[lo : lo + policy.batch], clock()
                    answers = iter(caller.ask([p for p in part if p is not None]) if any(p is not None for p in part) else [])
                    said += [(None, "no prompt", 0) if p is None else next(answers) for p in part]
                    took += [clock() - began] * len(part)
                new = [pa.array([x[j] for x in said], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns, *new, pa.array(took, pa.float64())], shape)], schema=shape)

        return rows.repartition(policy.tasks).mapInArrow(run, schema)

    return generate
