"""Decontamination's pairs and distances against the true ones, over documents with several copies of an item."""

import numpy as np
import pyarrow as pa

from heliograph.llm import decontaminate
from heliograph.llm.wordops import ALNUM, words


def as_words(text):
    return words(np.frombuffer(text.encode(), np.uint8), ALNUM)


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for k, symbol in enumerate(item, 1):
        new = [k]
        for j, other in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (symbol != other)))
        row = new
    return min(row)


def edited(rng, item, edits, vocabulary):
    out = list(item)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        if kind == 0:
            out[at] = rng.choice(vocabulary)
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, rng.choice(vocabulary))
    return out


def test_distances_are_the_least_of_the_whole_document():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [list(rng.choice(vocabulary, n)) for n in (6, 9, 14, 22, 22, 35, 60)]
    index = decontaminate.build(list(range(len(items))), [as_words(" ".join(i)) for i in items])
    docs = []
    for k in range(150):
        item = items[k % len(items)]
        most = decontaminate.allowed(len(item), 0.8)
        parts = [list(rng.choice(vocabulary, int(rng.integers(0, 40))))]
        for edits in rng.permutation([0, most, most + 2, 1])[: rng.integers(1, 4)]:
            parts += [edited(rng, item, int(edits), vocabulary), list(rng.choice(vocabulary, int(rng.integers(0, 30))))]
        docs.append(" ".join(w for p in parts for w in p))
    docs += [" ".join(items[5][7:]) + " end", "x " + " ".join(items[6][:-12]), " ".join(items[4] * 5), "", " ".join(items[0])]
    found = {(d, i): distance for d, i, distance, _ in decontaminate._all(index, pa.array(docs))}
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            distance = plain_distance(item, text.split())
            if distance <= decontaminate.allowed(len(item), 0.8):
                want[d, i] = distance
    assert {p: want.get(p) for p in found} == found  # each distance is the true one
    assert len(found) >= 0.97 * len(want) and all(p in found for p, distance in want.items() if distance == 0)
