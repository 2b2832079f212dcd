"""Connected components against union-find."""

import random

import pytest

from tidemark.llm import graph


def _expected(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(root) if find(x) != x}


CASES = {
    "empty": [],
    "loop only": [(5, 5)],
    "stars already": [(9, 1), (8, 1), (7, 2)],
    "star upside down": [(1, 9), (1, 8)],
    "chain": [(i, i + 1) for i in range(120)],
    "random": [(random.Random(k).randint(-200, 200), random.Random(-k - 1).randint(-200, 200)) for k in range(220)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    found = [tuple(r) for r in graph.components(spark.createDataFrame(CASES[name], "u long, v long")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == _expected(CASES[name])
