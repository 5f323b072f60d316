"""Queries read all rows of their tables, whatever the keys are."""

import pyarrow as pa
import pyarrow.parquet as pq

from factloom.plans.queries import QUERIES


def table(root, name, **columns):
    pq.write_table(pa.table(columns), root / f"{name}.parquet")


def test_engine_statuses_see_late_events(spark, tmp_path):
    table(tmp_path, "events", event_id=[1, 1999, 2000, 90_000], user_id=[1, 2, 2, 1], event_type=["view", "view", "click", "error"])
    got = {r["name"]: (r["status"], r["message"]) for r in QUERIES["engine_statuses"](spark, str(tmp_path)).collect()}
    assert got == {"u1": ("failed", "e90000"), "u2": ("incomplete", "")}


def trade(root, lines):
    """Nations 0 (region 0, a root) to 3; a line ``(order, number, quantity, customer's nation, supplier's nation)``."""
    nations = [0, 1, 2, 3]
    table(root, "region", r_regionkey=[0, 1], r_name=["AFRICA", "AMERICA"])
    table(root, "nation", n_nationkey=nations, n_name=["A", "B", "C", "D"], n_regionkey=[0, 1, 1, 1])
    table(root, "customer", c_custkey=nations, c_nationkey=nations)
    table(root, "supplier", s_suppkey=nations, s_nationkey=nations)
    owner = {order: source for order, _, _, source, _ in lines}
    table(root, "orders", o_orderkey=list(owner), o_custkey=list(owner.values()))
    orders, numbers, quantities, _, targets = map(list, zip(*lines, strict=True))
    table(root, "lineitem", l_orderkey=orders, l_linenumber=numbers, l_quantity=quantities, l_suppkey=targets)


def graph(spark, root):
    run = lambda name: QUERIES[name](spark, str(root)).collect()
    return {r["name"] for r in run("call_reachability")}, {r["name"] for r in run("unreachable")}, {r["members"] for r in run("scc_groups")}


def test_call_graph_sees_late_orders(spark, tmp_path):
    trade(tmp_path, [(1, 1, 50, 0, 1), (1500, 1, 50, 1, 2), (70_000, 1, 50, 2, 1)])
    assert graph(spark, tmp_path) == ({"n0", "n1", "n2"}, {"n3"}, {"n1,n2"})


def test_every_line_item_is_an_edge(spark, tmp_path):
    trade(tmp_path, [(1, 1, 50, 0, 1), (1, 2, 50, 0, 2), (2, 1, 1, 1, 0), (3, 3, 1, 2, 1), (4, 2, 44, 1, 2), (4, 4, 3, 1, 0)])
    found = sorted(map(tuple, QUERIES["forbidden_dependency"](spark, str(tmp_path)).collect()))
    assert found == [(1, "AFRICA", "AMERICA"), (1, "AFRICA", "AMERICA"), (2, "AMERICA", "AFRICA"), (4, "AMERICA", "AFRICA")]
    assert graph(spark, tmp_path) == ({"n0", "n1", "n2"}, {"n3"}, {"n0,n1,n2"})


def test_interop_pairing_sees_late_suppliers(spark, tmp_path):
    table(tmp_path, "customer", c_custkey=[1, 2, 3, 10], c_nationkey=[5, 6, 7, 5])
    table(tmp_path, "supplier", s_suppkey=[15, 900, 901], s_nationkey=[5, 5, 6])
    found = sorted((r["symbol"], r["status"], r["julia_path"] or "", r["odin_path"] or "") for r in QUERIES["interop_pairing"](spark, str(tmp_path)).collect())
    assert found == [("5", "external", "julia/10", ""), ("5", "matched", "julia/1", "odin/15"), ("5", "missing-julia", "", "odin/900"), ("6", "matched", "julia/2", "odin/901"), ("7", "missing-odin", "julia/3", "")]
