import random
from collections import Counter

import pytest

from pagelake.operators.components import components
from pagelake.operators.hierarchy import CYCLE, contract, descendants, edges_of, hierarchy, subtree_sizes


def brute(edges):
    parents, children = {}, {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
        children.setdefault(p, set()).add(c)

    def above(n):
        seen, level, d, out = {n}, {n}, 0, {}
        while level:
            d += 1
            level = {p for x in level for p in parents.get(x, ())}
            for p in level:
                out.setdefault(p, d)
            level -= seen
            seen |= level
        return out

    up = {n: above(n) for n in set(parents) | set(children)}
    on_loop = {n for n in up if n in up[n]}
    rows = set()
    for n in parents:
        if n in on_loop or on_loop & set(up[n]):
            rows.add((n, CYCLE, -1))
        else:
            rows |= {(n, r, d) for r, d in up[n].items() if r not in parents}
    down = {(p, n) for n, a in up.items() for p in a if p != n}
    return rows, down


@pytest.mark.parametrize(("limit", "finish", "seed"), [(0, 0, 1), (6, 1_000, 2), (1_000, 0, 1), (1_000, 1_000, 2)])
def test_against_brute_force(spark, limit, finish, seed):
    """In rounds, mixed and in tasks: always the same rows."""
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(1, 22)}", f"n{rng.randrange(0, 21)}") for _ in range(9)} | {(f"t{i}", f"t{i // 2}") for i in range(1, 9)} | {("x", "x"), ("y", "x")}
    df = spark.createDataFrame([*edges, *list(edges)[:3], (None, "a"), ("b", None), ("c", " "), ("", "d")], "c string, p string")
    e = edges_of(df, "c", "p", "g")
    rows, down = brute(edges)
    got = hierarchy(e, limit=limit, finish=finish).collect()
    assert {(r.node_id, r.root_id, r.depth) for r in got} == rows
    assert len(got) == len(rows)
    for r in got:
        if r.depth >= 0:
            steps = r.path.split("/")
            assert steps[0] == r.root_id and steps[-1] == r.node_id and len(steps) == r.depth + 1
            assert all((b, a) in edges for a, b in zip(steps, steps[1:]))
        else:
            assert r.path is None
    if seed == 1:
        found = descendants(e, limit=limit, finish=finish).collect()
        assert {(r.node_id, r.descendant_id) for r in found} == down and len(found) == len(down)
        sizes = Counter(n for n, _ in down)
        assert {(r.node_id, r.subtree) for r in subtree_sizes(e, limit=limit, finish=finish).collect()} == set(sizes.items())


def test_empty(spark):
    e = edges_of(spark.createDataFrame([], "c string, p string, path string, root_id string"), "c", "p", "g")
    assert hierarchy(e).isEmpty() and descendants(e).isEmpty()


def test_long_chain_in_few_rounds(spark):
    chain = [(f"n{i + 1:03}", f"n{i:03}") for i in range(200)] + [(f"loop{i}", f"loop{(i + 1) % 5}") for i in range(5)]
    e = edges_of(spark.createDataFrame(chain, "c string, p string"), "c", "p", "g")
    rest, inner = contract(e)
    assert [(r.child, r.parent, r.steps) for r in rest.collect()] == [("n200", "n000", 200)] and inner.where("top is null").count() == 5
    got = {r.node_id: r for r in hierarchy(e, limit=0).collect()}
    assert len(got) == 205 and all(got[f"n{i:03}"].depth == i and got[f"n{i:03}"].path.count("/") == i for i in range(1, 201))
    assert all(got[f"loop{i}"].root_id == CYCLE for i in range(5))


@pytest.mark.parametrize("finish", [0, 1_000])
def test_components(spark, finish):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), finish).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    assert set(got) == set(parent)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in got for b in got)
