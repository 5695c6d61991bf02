"""Brute-force helpers of the tests."""

import pytest

from corpusloom.session import Scratch


@pytest.fixture
def scratch(spark):
    own = Scratch(spark, "test")
    yield own
    own.clear()


def linked(edges):
    """The smallest vertex linked with each vertex."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}
