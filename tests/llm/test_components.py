import random


from veriflux.llm.common import Scratch
from veriflux.llm.components import components


def reachable(pairs):
    low = {}
    for a, b in pairs:
        low.setdefault(a, a), low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def found(spark, pairs, one_task):
    links = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    rows = components(links, Scratch(spark, "test"), one_task=one_task).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.component_id for r in rows}


def test_one_task_and_shuffles_agree_with_brute_force(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)]
    want = {k: v for k, v in reachable([p for p in pairs if p[0] != p[1]]).items() if k != v}
    assert found(spark, pairs, 10**6) == want
    assert found(spark, pairs, 0) == want


def test_no_links(spark):
    assert found(spark, [], 10**6) == {}
    assert found(spark, [], 0) == {}
