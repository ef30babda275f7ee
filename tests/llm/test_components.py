"""Components end with the step that settles them."""

import random

from heliograph.llm import components


def test_stars_take_no_step_and_chains_few(spark, monkeypatch):
    taken, star = [], components._star

    def counted(edges, large, many):
        taken.append(large)
        return star(edges, large, many)

    monkeypatch.setattr(components, "_star", counted)
    found = lambda edges: {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    stars = [(1, 5), (7, 1), (3, 4), (None, 2), (6, 6), (5, 1)]
    assert found(stars) == {(5, 1), (7, 1), (4, 3)}
    assert not taken
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 440)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        root[hi] = lo
    assert found(edges) == {(x, top(x)) for x in root if top(x) != x}
    assert found([]) == set()
