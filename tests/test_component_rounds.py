"""Components by rounds: what their joins make stays in proportion to the links, whatever the groups look like."""

import random

from incidex.operators import graph


def joined_rows(spark, work):
    """Result of ``work`` and the rows that all joins made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made, runs = 0, store.executionsList(before, 10_000)
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in node.name():
                for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        made += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out, made


def labelled(df, node="element_id"):
    return {r[node]: r["label"] for r in df.collect()}


def test_dense_group_joins_its_links_once(spark):
    rng, n = random.Random(3), 400
    ids = rng.sample(range(10**6), n)
    pairs = [(ids[i], ids[j]) for i in range(n) for j in rng.sample(range(i), min(i, 30))]
    nodes = spark.createDataFrame([(i,) for i in ids], "element_id long")
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    found, made = joined_rows(spark, lambda: labelled(graph.components(nodes, edges, [])))
    assert found == dict.fromkeys(ids, min(ids))
    assert 0 < made < 5 * len(pairs)


def test_chains_stars_and_foreign_ends(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10**6), 900)
    mixed, rising, star = ids[:300], sorted(ids[300:600]), sorted(ids[600:])
    pairs = list(zip(mixed, mixed[1:])) + list(zip(rising, rising[1:])) + [(star[-1], x) for x in star[:-2]]
    pairs += [(star[-2], 2_000_000), (2_000_000, mixed[0]), (mixed[5], mixed[5])]  # no node, a node with itself
    nodes = spark.createDataFrame([(1, i) for i in ids] + [(2, ids[0]), (2, ids[1])], "g int, element_id int")
    edges = spark.createDataFrame([(1, a, b) for p in pairs for a, b in (p, p[::-1])], "g int, src int, dst int")
    found = graph._rounds(nodes, edges, ["g"], "element_id", 20)
    assert [t for _, t in found.dtypes] == ["int", "int", "int"]
    want = {(2, ids[0]): ids[0], (2, ids[1]): ids[1], (1, star[-2]): star[-2]}
    for part in (mixed, rising, [*star[:-2], star[-1]]):
        want |= {(1, i): min(part) for i in part}
    assert {(r["g"], r["element_id"]): r["label"] for r in found.collect()} == want
