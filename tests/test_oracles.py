"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from phylochron import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, (int,)) and not isinstance(v, bool) else v

    return sorted(([None if v is None else one(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def instances(spark):
    """Problem by instance of the order queries, and the tree."""
    import collections

    from phylochron import derived
    from phylochron.operators import kernels
    from phylochron.plans import orders

    tree = orders.tree_of(derived.nodes(spark))
    by = collections.defaultdict(list)
    for r in catalog._instances(spark, SF).collect():
        if r["weight"]:
            by[r["instance_id"]].append((r["donor"], r["receptor"], float(r["weight"]), r["first_seq"]))
    return {k: kernels.Problem(*tree, [e[:3] for e in sorted(v, key=lambda e: (-e[2], e[3]))]) for k, v in by.items()}


def plain_value(p, order):
    """The weight that an order violates; checks that it is a legal order of all inner nodes."""
    at = {x: i for i, x in enumerate(order)}
    assert sorted(order) == sorted(p.inner) and all(at[p.parent[x]] < at[x] for x in p.inner if p.parent[x] is not None)
    return sum(w for a, b, w in p.edges if a in at and b in at and at[a] > at[b])


def test_heuristic_orders_are_legal_and_no_worse_than_random(spark, instances):
    import collections
    import random

    from phylochron.operators import kernels

    found = collections.defaultdict(list)
    for r in catalog.queries()["heuristic_orders"](spark, SF).orderBy("pos").collect():
        found[r["instance_id"], r["method"]].append(r["label"])
    assert set(found) == {(k, m) for k in instances for m in ("greedy", "mixing")}
    for (k, _), order in found.items():
        p = instances[k]
        got = plain_value(p, order)
        assert abs(got - kernels.value(p, order)) < 1e-6
        assert got <= sorted(plain_value(p, kernels.random_order(p, random.Random(i))) for i in range(20))[2]


def test_local_search_never_ends_above_its_start(spark, instances):
    from phylochron.operators import kernels

    rows = catalog.queries()["local_search_best"](spark, SF).collect()
    assert sorted((r["instance_id"], r["seed"]) for r in rows) == sorted((k, s) for k in instances for s in (1, 2))
    for r in rows:
        p = instances[r["instance_id"]]
        assert abs(plain_value(p, list(r["labels"])) - r["value"]) < 1e-6
        assert r["value"] <= kernels.value(p, kernels.greedy(p)[0]) + 1e-6


def test_chain_states_have_their_energy(spark, instances):
    rows = catalog.queries()["mh_chain"](spark, SF).collect()
    assert {(r["instance_id"], r["chain_id"]) for r in rows} == {(k, s) for k in instances for s in (1, 2)} and len(rows) >= 200
    for r in rows[:200]:
        assert abs(plain_value(instances[r["instance_id"]], [int(x) for x in r["state"].split(",")]) - r["energy"]) < 1e-6


def test_every_query_without_sql_gives_rows(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, SF).count() > 0, name
