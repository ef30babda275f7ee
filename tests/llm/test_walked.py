"""Windows that no match can come of aren't walked."""

import numpy as np

from heliograph.llm import decontaminate


def test_only_windows_with_enough_runs_are_walked(monkeypatch):
    rng = np.random.default_rng(5)
    item, other = (rng.integers(1, 1 << 62, 20).astype(np.uint64) for _ in range(2))
    index = decontaminate.build([1, 2], [item, other])
    walked, walk = [], decontaminate.walk

    def counted(symbols, starts, size, seed):
        walked.append(len(starts))
        return walk(symbols, starts, size, seed)

    monkeypatch.setattr(decontaminate, "walk", counted)
    noise = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    run = decontaminate.whole_run(20, 0.8)
    assert decontaminate.matches(index, [np.concatenate([noise(50), item[5 : 5 + run], noise(50)])]) == []
    assert not walked  # one run of the 20 words is too little
    edited = item.copy()
    edited[[3, 9, 15]] = noise(3)
    assert decontaminate.matches(index, [np.concatenate([noise(50), edited, noise(50)]), np.concatenate([noise(9), other])]) == [(0, 0, 3, 50), (1, 1, 0, 9)]
    assert walked
