"""Connected components against union-find."""

from __future__ import annotations

import random

from textloom.llm.components import components


def test_components_like_union_find(rows):
    random.seed(5)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(rows(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(rows(None, "a bigint, b bigint"), "a", "b").count() == 0
