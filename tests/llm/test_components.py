"""Connected components against a walk over the graph."""

import random

from sentigrade.llm.components import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 560)] + [(7, 7), (8, 9), (9, 8)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want = {}
    for node in sorted(near):
        queue = [node]
        while queue:
            k = queue.pop()
            if k not in want:
                want[k] = node
                queue += near[k]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: root for k, root in want.items() if k != root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
