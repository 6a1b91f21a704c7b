"""Names that contain texts: q-grams against every pair."""

import random

from sheaf.operators import graph, substring


def test_pairs_equal_every_pair(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé中 ") for _ in range(n))
    names = [word(rng.randint(0, 12)) for _ in range(300)] + [None, "aaaa", "aaaa", "x" * 5000 + "needle"]
    asked = [word(rng.randint(1, 6)) for _ in range(80)] + ["", None, "aaa", "aaaaa", "needle", "a", "中é", "a" * 40]
    got = substring.containing(spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame([(a,) for a in asked], "text string"))
    want = {(a, n) for a in asked if a for n in names if n is not None and a in n}
    rows = [(r.text, r.node) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 200


def test_entities_are_found_without_a_nested_loop(spark):
    names = ["rice", "brown rice", "rice bran", "wheat", "a", ""]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    asked = ["Rice ", "bran", "ice", "heat", "zzz", "w", " ", "A", None]
    out = graph.resolve(nodes, spark.createDataFrame([(a,) for a in asked], "entity string"))
    assert {r.entity: r.node for r in out.collect()} == {"Rice ": "rice", "bran": "rice bran", "ice": "brown rice", "heat": "wheat", "w": "brown rice", " ": "", "A": "a"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
