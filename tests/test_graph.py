import random

from pyspark.sql import functions as F

from tessella.operators import derived, graph


def test_representatives_and_touching(spark):
    edges = spark.createDataFrame([(1, 2, "calls", 0.5, "a"), (1, 2, "calls", 0.9, "c"), (1, 2, "calls", 0.9, "b"), (2, 3, "imports", 1.0, "d")], "src int, dst int, kind string, confidence double, id string")
    assert {r.id for r in graph.representatives(edges, ["id"]).collect()} == {"b", "d"}
    assert graph.touching(edges, [2], "outgoing").count() == 1 and graph.touching(edges, [2], kinds=[]).count() == 0 and graph.touching(edges, [2], least=0.95).count() == 1


def test_bounded_walk_budgets(spark):
    edges = spark.createDataFrame([(0, i, "k", 1.0) for i in range(1, 9)], "src int, dst int, kind string, confidence double")
    nodes, found, truncated = graph.bounded_walk(edges, [0], most_nodes=4)
    assert (len(nodes), len(found), truncated) == (4, 3, True)
    assert graph.bounded_walk(edges, [0], most_edges=5)[2] and not graph.bounded_walk(edges, [0])[2]


def test_strong_components_against_reachability(spark):
    rng = random.Random(5)
    n = 30
    arcs = {(rng.randrange(n), rng.randrange(n)) for _ in range(45)}
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in arcs:
            for x in reach.values():
                if a in x:
                    x.add(b)
    wanted = {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n)}
    got = derived.components_strong(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(list(arcs), "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == wanted


def test_cluster_merge_picks_the_most_connected():
    sizes, weights = {"a": 1, "b": 5, "c": 5, "d": 1}, {("a", "b"): 1, ("a", "c"): 3}
    assert derived.merged_clusters(sizes, weights, 3) == {"a": "c", "b": "b", "c": "c", "d": "b"}


def test_flows_end_where_they_must(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "src int, dst int")
    rows = derived.flows(edges, spark.createDataFrame([(1,)], "node int"), 3).collect()
    assert {tuple(r.path): r.terminal for r in rows} == {(1, 2, 3): "cycle", (1, 2, 4): "terminal"}
    assert {r.terminal for r in derived.flows(edges, spark.createDataFrame([(1,)], "node int"), 1).collect()} == {"depth_limit"}


def test_layers_need_exactly_one_rule(spark):
    items = spark.createDataFrame([("api/x",), ("api/test",), ("zzz",), ("tests/y",)], "s string")
    rules = {"api": ["api"], "tests": ["test"]}
    assert {r.s: r.layer for r in derived.layers(items, rules, F.col("s")).collect()} == {"api/x": "api", "api/test": "unclassified", "zzz": "unclassified", "tests/y": "tests"}


def test_longest_prefix(spark):
    paths = spark.createDataFrame([("a/b/c",), ("ab/c",), ("a",)], "p string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "r string")
    assert {r.p: r.root for r in derived.longest_prefix(paths, roots, "p", "r").collect()} == {"a/b/c": "a/b", "ab/c": None, "a": "a"}


def test_whole_graph_queries_see_all_pairs_and_roots(spark):
    from tessella.plans import catalogue, graph_queries

    folder = "/root/testdata/sf0.001"
    pairs = {(r.src, r.dst) for r in graph_queries.trade(spark, folder).select("src", "dst").collect() if r.src != r.dst}
    ranks = {r.node: r for r in catalogue.QUERIES["q_importance_whole"](spark, folder).collect()}
    assert {n: (r.fan_in, r.fan_out) for n, r in ranks.items()} == {n: (sum(d == n for _, d in pairs), sum(s == n for s, _ in pairs)) for n in range(25)}
    assert max(r.fan_out for r in ranks.values()) > 2
    roots = {int(r.path.split(">")[0]) for r in catalogue.QUERIES["q_flows_all_roots"](spark, folder).collect()}
    assert roots == set(range(25))
