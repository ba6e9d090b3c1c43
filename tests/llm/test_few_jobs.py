"""The driver keeps something of every job, so components take no more rounds than they need."""

import os
import random

from lithogrid.llm.common import Shared
from lithogrid.llm.components import components


def test_stars_need_no_round(spark):
    stars = [(10 * k, 10 * k + i) for k in range(40) for i in range(1, 6)] + [(7001, 7002), (7002, 7001), (9, 9)]
    shared = Shared(spark)
    got = components(spark.createDataFrame(stars, "a long, b long"), shared).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(
        [(10 * k + i, 10 * k) for k in range(40) for i in range(6)] + [(7002, 7001), (7001, 7001)])
    assert os.listdir(shared.path) == ["links-0"]


def test_other_links_take_rounds(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(45)]
    links += [(200 + i, 260) for i in range(50)] + [(300, 302), (301, 302)]
    root = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "a long, b long"), Shared(spark)).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long"), Shared(spark)).count() == 0
