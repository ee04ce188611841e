"""Bindings of many patterns, recursive rules and searches between sets, against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators.patterns import Pattern, bindings, counted, partial_bindings, reduced, tree
from factloom.operators.recursion import Atom, Rule, Value, layers, solve
from factloom.operators.search import shortest_paths

# Patterns.


def facts_of(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(f"id{k}", rng.choice("ABCD"), None if rng.random() < 0.05 else rng.randint(0, 12), rng.randint(0, 9), rng.randint(0, 5)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "fact_id string, fact_type string, x int, y int, z int")


A, B = Pattern("a", "A", {"p": "x", "q": "y"}), Pattern("b", "B", {"q": "y", "r": "z"}, "x > 3")
C, D = Pattern("c", "C", {"r": "z", "s": "x"}), Pattern("d", "D", {"p": "x"}, "y = 4")


def plain_bindings(rows, patterns):
    column = {"x": 2, "y": 3, "z": 4}
    tests = {"x > 3": lambda r: r[2] is not None and r[2] > 3, "y = 4": lambda r: r[3] == 4, "true": lambda r: True, "y = 77": lambda r: False}
    own = [[r for r in rows if r[1] == p.kind and tests[p.condition](r)] for p in patterns]
    partial = [({}, ())]
    for p, mine in zip(patterns, own, strict=True):
        grown = []
        for bound, ids in partial:
            for r in mine:
                new = {v: r[column[c]] for v, c in p.variables.items()}
                if None not in new.values() and all(bound.get(v, x) == x for v, x in new.items()):
                    grown.append((bound | new, (*ids, r[0])))
        partial = grown
    return sorted(ids for _, ids in partial)


@pytest.mark.parametrize("patterns", [[A, B], [A, B, C], [C, D, B, A], [D, A]])
def test_bindings_equal_plain_ones_and_no_table_is_larger_than_input_and_output(spark, patterns):
    rows, facts = facts_of(spark)
    names = [f"{p.name}_fact_id" for p in sorted(patterns, key=lambda p: p.name)]
    wanted = sorted(plain_bindings(rows, sorted(patterns, key=lambda p: p.name)))
    assert sorted(tuple(r) for r in bindings(facts, patterns).select(*names).collect()) == wanted and wanted
    plan, kept = reduced(facts, patterns)
    sizes = [df.count() for df in partial_bindings(plan, kept)]
    assert sizes == sorted(sizes) and sizes[-1] == len(wanted)
    assert all(kept[p.name].count() <= plan.counts[p.name] for p in plan.order)


def test_a_hub_value_makes_no_rows_that_are_in_no_binding(spark):
    hub = [(f"a{k}", "A", k, 1, 0) for k in range(300)] + [(f"b{k}", "B", 9, 1, k) for k in range(300)] + [("c", "C", 1, 0, 7)]
    facts = spark.createDataFrame(hub, "fact_id string, fact_type string, x int, y int, z int")
    plan, kept = reduced(facts, [A, B, C])
    assert [p.name for p in plan.order] == ["c", "b", "a"]
    assert [df.count() for df in partial_bindings(plan, kept)] == [1, 1, 300]  # a and b alone would give 90,000


def test_existing_patterns_conditions_and_errors(spark):
    rows, facts = facts_of(spark)
    there = Pattern("e", "D", {"p": "x"}, "y = 4", exists=True)
    some = {r[2] for r in rows if r[1] == "D" and r[3] == 4}
    got = sorted(tuple(r) for r in bindings(facts, [there, A, B], F.col("p") < F.col("r") + 3).select("a_fact_id", "b_fact_id").collect())
    by = {r[0]: r for r in rows}
    assert got == [(a, b) for a, b in plain_bindings(rows, [A, B]) if by[a][2] in some and by[a][2] < by[b][4] + 3]
    none = Pattern("n", "D", {"p": "x"}, "y = 77")
    assert counted(facts, [none, A])["n"] == 0 and bindings(facts, [none, A]).count() == 0
    ring = [Pattern("a", "A", {"p": "x", "q": "y"}), Pattern("b", "B", {"q": "y", "r": "z"}), Pattern("c", "C", {"r": "z", "p": "x"})]
    for bad in (ring, [A, Pattern("u", "B", {"w": "z"})], [A, A]):
        with pytest.raises(ValueError):
            reduced(facts, bad)
    assert tree([A, there], {"a": 1, "e": 9}).order[0] is A
    with pytest.raises(ValueError):
        tree([there], {"e": 1})


# Recursive rules.


def closure(edges, start):
    seen, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_taint_spreads_through_a_long_chain_and_cycles(spark):
    edges = [(k, k + 1) for k in range(40)] + [(40, 20), (60, 61), (61, 60), (None, 3), (5, None)]
    tables = {"source": spark.createDataFrame([(0, True), (60, False), (0, True)], "f long, on boolean"), "passes": spark.createDataFrame(edges, "f long, g long"), "flow": spark.createDataFrame([(k,) for k in (3, 39, 61, 70)], "f long")}
    rules = [Rule(Atom("tainted", "f"), [Atom("source", "f", Value(True))]), Rule(Atom("tainted", "g"), [Atom("passes", "f", "g"), Atom("tainted", "f")]), Rule(Atom("clean", "f", Value("ok")), [Atom("flow", "f")], absent=[Atom("tainted", "f")])]
    out = solve(tables, rules)
    assert {r[0] for r in out["tainted"].collect()} == set(range(41)) and out["tainted"].count() == 41
    assert sorted(map(tuple, out["clean"].collect())) == [(61, "ok"), (70, "ok")]
    with pytest.raises(ValueError, match="after 5 rounds"):
        solve(tables, rules[:2], most=5)


def test_rules_that_use_their_own_table_twice_and_each_other(spark):
    rng = random.Random(3)
    edges = list({(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(40)})
    e = spark.createDataFrame(edges, "a int, b int")
    twice = [Rule(Atom("path", "x", "y"), [Atom("e", "x", "y")]), Rule(Atom("path", "x", "z"), [Atom("path", "x", "y"), Atom("path", "y", "z")])]
    wanted = {(a, y) for a in range(26) for b in {q for p, q in edges if p == a} for y in closure(edges, [b])}
    assert {tuple(r) for r in solve({"e": e}, twice)["path"].collect()} == wanted
    turns = [Rule(Atom("even", "x"), [Atom("start", "x")]), Rule(Atom("odd", "y"), [Atom("even", "x"), Atom("e", "x", "y")]), Rule(Atom("even", "y"), [Atom("odd", "x"), Atom("e", "x", "y")]), Rule(Atom("loop", "x"), [Atom("e", "x", "x")]), Rule(Atom("far", "x"), [Atom("even", "x"), Atom("e", "x", "_")], where=F.col("x") > 9)]
    out = solve({"e": e, "start": spark.createDataFrame([(edges[0][0],)], "x int")}, turns)
    even, odd = {edges[0][0]}, set()
    for _ in range(60):
        odd |= {b for a, b in edges if a in even}
        even |= {b for a, b in edges if a in odd}
    assert {r[0] for r in out["even"].collect()} == even and {r[0] for r in out["odd"].collect()} == odd
    assert {r[0] for r in out["loop"].collect()} == {a for a, b in edges if a == b}
    assert {r[0] for r in out["far"].collect()} == {x for x in even if x > 9 and any(a == x for a, _ in edges)}
    nothing = solve({"e": e.limit(0)}, twice)["path"]
    assert nothing.count() == 0 and nothing.dtypes == [("c0", "int"), ("c1", "int")]


def test_rules_without_sense_are_errors(spark):
    e = spark.createDataFrame([(1, 2)], "a int, b int")
    loop = [Rule(Atom("p", "x"), [Atom("e", "x", "_")], absent=[Atom("q", "x")]), Rule(Atom("q", "x"), [Atom("e", "x", "_")], absent=[Atom("p", "x")])]
    bad = [loop, [Rule(Atom("p", "z"), [Atom("e", "x", "y")])], [Rule(Atom("p", "x"), [Atom("e", "x")])], [Rule(Atom("p", "x", "u"), [Atom("e", "x", "y"), Atom("e", "u", "w")])], [Rule(Atom("p", "x"), [Atom("p", "x")])]]
    for rules in bad:
        with pytest.raises(ValueError):
            solve({"e": e}, rules)
    assert [len(x) for x in layers([Rule(Atom("a", "x"), [Atom("e", "x", "_")]), Rule(Atom("b", "x"), [Atom("a", "x")], absent=[Atom("a", "x")])])] == [1, 1]


# Searches.


def plain_distances(edges, sources):
    out, todo = dict.fromkeys(sources, 0), list(sources)
    to = defaultdict(list)
    for a, b in edges:
        to[a].append(b)
    for x in todo:
        for y in to[x]:
            if y not in out:
                out[y] = out[x] + 1
                todo.append(y)
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "fan in", "fan out"])
def test_paths_are_shortest_and_run_from_a_source_to_each_sink(spark, shape):
    rng = random.Random(5)
    edges = {"random": [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(110)], "chain": [(f"n{k}", f"n{k + 1}") for k in range(44)], "fan in": [(f"n{k}", "hub") for k in range(40)] + [("hub", "n50"), ("n50", "n51")], "fan out": [("n0", "n1"), ("n1", "hub"), *[("hub", f"n{k}") for k in range(20, 60)]]}[shape]
    sources = ["n0", "n7", "n0", "alone"] if shape == "random" else ["n0"]
    sinks = {"random": [f"n{k}" for k in range(20, 50)] + ["n7", "unknown"], "chain": ["n44", "n1"], "fan in": ["n51"], "fan out": [f"n{k}" for k in range(20, 60)]}[shape]
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "node string")
    found = {r.sink: r for r in shortest_paths(spark.createDataFrame(edges, "src string, dst string"), names(sources), names(sinks)).collect()}
    far = plain_distances(edges, dict.fromkeys(sources))
    assert {s: r.steps for s, r in found.items()} == {s: far[s] for s in sinks if s in far}
    for s, r in found.items():
        assert r.path[0] in sources and r.path[-1] == s and len(r.path) == r.steps + 1
        assert all(step in set(edges) for step in zip(r.path, r.path[1:], strict=False))


def test_a_bounded_search_and_empty_sets(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "src long, dst long")
    nodes = lambda *xs: spark.createDataFrame([(x,) for x in xs], "node long")
    assert [(r.sink, r.steps) for r in shortest_paths(edges, nodes(0), nodes(3, 9), most=5).collect()] == [(3, 3)]
    assert shortest_paths(edges, nodes(), nodes(3)).count() == 0 and shortest_paths(edges, nodes(0), nodes()).count() == 0
    assert shortest_paths(edges.limit(0), nodes(3), nodes(3)).collect()[0].path == [3]
