"""Orphans, hierarchies and snapshots against brute force, with nulls, repeats, ties, empty tables and extra columns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators import bloom
from factloom.operators import hierarchy as H
from factloom.operators import orphans as O
from factloom.operators import snapshots as S
from factloom.tables import hot_keys, latest, lookup

T0 = datetime(2025, 1, 1)
REF = "occ string, scan_id string, fact_id string, symbol_id string, ingested_at timestamp, h string, key string"
PAR = "scan_id string, fact_id string, ingested_at timestamp, status string"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def run_orphans(spark, refs, pars, share=0.01):
    r = O.references(spark.createDataFrame([(o, s, f, None, at(t), "x", "y") for o, s, f, t in refs], REF), "occurrences", "occ", {"fact_id": "facts", "symbol_id": "symbols"}, "scan_id")
    p = O.parents(spark.createDataFrame([(s, f, at(t), "z") for s, f, t in pars], PAR), "facts", "fact_id", "scan_id")
    return {(x.row_key, x.field_name, x.status) for x in O.orphans(r, p, ["occurrences"], share).collect()}


def test_orphans_by_hand(spark):
    refs = [("a", "s1", "f1", 5), ("b", "s1", "f2", 1), ("c", "s1", "f3", 1), ("d", "s1", "nowhere", 1), ("e", "s1", None, 1), ("g", "s1", "", 1), ("a", "s1", "f1", 2), ("n", "s1", "f2", None)]
    pars = [("s1", "f1", 3), ("s1", "f1", 1), ("s1", "f2", 2), ("s2", "f3", 0), ("s1", None, 0)]
    assert run_orphans(spark, refs, pars) == {("b", "fact_id", "late"), ("c", "fact_id", "elsewhere"), ("d", "fact_id", "missing"), ("g", "fact_id", "missing")}


def test_orphans_latest_key_and_earliest_delivery_count(spark):
    assert run_orphans(spark, [("a", "s1", "old", 1), ("a", "s1", "f1", 9)], [("s1", "f1", 2)]) == {("a", "fact_id", "late")}


def test_orphans_empty_tables(spark):
    assert run_orphans(spark, [], [("s1", "f1", 1)]) == set()
    assert run_orphans(spark, [("a", "s1", "f1", 1)], []) == {("a", "fact_id", "missing")}


def test_orphans_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(4)
    pars = [(f"s{rnd.randrange(3)}", f"f{rnd.randrange(40)}", rnd.randrange(20)) for _ in range(60)]
    refs = [(f"o{i}", f"s{rnd.randrange(3)}", "f1" if i % 3 == 0 else f"f{rnd.randrange(60)}", rnd.randrange(20)) for i in range(300)]
    first = {}
    for s, f, t in pars:
        first[s, f] = min(t, first.get((s, f), 99))
    known = {f for _, f in first}
    want = set()
    for o, s, f, t in refs:
        if (s, f) not in first:
            want.add((o, "fact_id", "elsewhere" if f in known else "missing"))
        elif first[s, f] > t:
            want.add((o, "fact_id", "late"))
    assert run_orphans(spark, refs, pars, share=0.05) == want


def test_report_counts_by_month(spark):
    found = spark.createDataFrame([("t", "f", "1", "late", at(0)), ("t", "f", "2", "late", at(800)), ("t", "f", "3", "late", None)], "table_name string, field_name string, row_key string, status string, seen_at timestamp")
    assert {(r.month, r.n_rows) for r in O.orphans_by_month(found).collect()} == {("2025-01", 1), ("2025-02", 1), (None, 1)}


def test_bloom_never_denies(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    lines = bloom.build(keys, ["k"], 1 << 12)
    assert lines.count() <= (1 << 12) // bloom.LINE
    assert bloom.probe(keys, ["k"], lines, 1 << 12, "hit").where(~F.col("hit")).count() == 0
    others = spark.range(5000, 10_000).select(F.col("id").cast("string").alias("k"))
    assert bloom.sharded(others, ["k"], keys, 5000, "hit").where("hit").count() < 500


def test_filters_are_bounded_and_grow_in_number(spark, monkeypatch):
    assert bloom.words_for(0) == (bloom.MIN_WORDS, 1) and bloom.words_for(10**12)[0] == bloom.MAX_WORDS and bloom.words_for(10**12)[1] > 10_000
    monkeypatch.setattr(bloom, "MAX_WORDS", 1 << 10)
    keys = spark.range(30_000).select(F.col("id").cast("string").alias("k"), F.lit(None).cast("string").alias("n"))
    others = spark.range(30_000, 60_000).select(F.col("id").cast("string").alias("k"), F.lit(None).cast("string").alias("n"))
    assert bloom.words_for(30_000) == (1 << 10, 8)
    got = bloom.sharded(keys.unionByName(others), ["k", "n"], keys, 30_000, "hit").groupBy((F.col("k").cast("int") < 30_000).alias("own"), "hit").count().collect()
    assert {(r.own, r.hit): r["count"] for r in got}[True, True] == 30_000 and sum(r["count"] for r in got) == 60_000 and sum(r["count"] for r in got if r.hit) < 33_000
    refs = [(f"o{i}", "s", f"f{i % 700}", 5) for i in range(900)]
    monkeypatch.setattr(bloom, "MIN_WORDS", 1)
    monkeypatch.setattr(bloom, "BITS_A_KEY", 1 << 9)
    assert run_orphans(spark, refs, [("s", f"f{i}", 1) for i in range(600)]) == {(f"o{i}", "fact_id", "missing") for i in range(900) if i % 700 >= 600}


# ---- hierarchies

LINKS = "table_name string, scope_id string, node_id string, parent_id string"


def brute_tree(links):
    """{(scope, node): (root, depth, n_descendants)} by following each chain."""
    parent = {(s, n): (p if (s, p) in {(a, b) for _, a, b, _ in links} else None) for _, s, n, p in links}
    out, above = {}, {}
    for (s, n) in parent:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parent[s, x]
        out[s, n] = ("", -1) if x is not None else (seen[-1], len(seen) - 1)
        above[s, n] = set(seen) - {n}
    return {k: (*v, sum(1 for q in above if q[0] == k[0] and k[1] in above[q])) for k, v in out.items()}


def tree_rows(df):
    return {(r.scope_id, r.node_id): (r.root_id, r.depth, r.n_descendants) for r in df.collect()}


@pytest.mark.parametrize("bound", [3, 10_000])
def test_hierarchy_against_brute_force(spark, bound):
    rnd = random.Random(bound)
    links = []
    for s in ("x", "y"):
        names = [f"n{i}" for i in range(40)]
        for i, n in enumerate(names):
            links.append(("t", s, n, rnd.choice([None, "nowhere", names[rnd.randrange(40)], names[max(0, i - 1)], names[0]])))
    links += [("t", "z", "a", "b"), ("t", "z", "b", "a"), ("t", "z", "c", "a"), ("t", "z", "d", "d"), ("t", "z", "aa", "c"), ("t", "z", "e", None)]
    df = spark.createDataFrame(links, LINKS)
    tree = H.hierarchy(df, max_colocated=bound)
    assert tree_rows(tree) == brute_tree(links)
    rows = tree.collect()
    for r in rows:
        assert len(r.path) == r.steps if r.depth < 0 else (r.path[0] == r.root_id and r.path[-1] == r.node_id and len(r.path) == r.depth + 1)
    up = {(s, n): p for _, s, n, p in links}
    want = set()
    for s, n in up:
        x, steps = up[s, n], 1
        seen = {n}
        while (s, x) in up and x not in seen:
            want.add((s, x, n, steps))
            seen.add(x)
            x, steps = up[s, x], steps + 1
    pairs = [(r.scope_id, r.node_id, r.descendant_id, r.distance) for r in H.descendants(tree).collect()]
    assert set(pairs) == want and len(pairs) == len(want) == sum(r.n_descendants for r in rows)
    assert tree_rows(H.hierarchy(df, with_paths=False, max_colocated=bound)) == brute_tree(links)


@pytest.mark.parametrize("bound", [5, 10_000])
def test_deep_chain_and_star(spark, bound):
    links = [("t", "s", f"c{i}", f"c{i - 1}" if i else None) for i in range(150)] + [("t", "s", f"leaf{i}", "hub") for i in range(100)] + [("t", "s", "hub", " ")]
    got = tree_rows(H.hierarchy(spark.createDataFrame([(t, s, n, None if p == " " else p) for t, s, n, p in links], LINKS), with_paths=False, max_colocated=bound))
    assert got["s", "c149"] == ("c0", 149, 0) and got["s", "c0"] == ("c0", 0, 149) and got["s", "hub"] == ("hub", 0, 100)


def test_back_edges_are_marked_once_a_cycle(spark):
    links = [("t", "s", "a", "b"), ("t", "s", "b", "c"), ("t", "s", "c", "a"), ("t", "s", "tail", "a"), ("t", "s", "self", "self")]
    for bound in (1, 1000):
        assert {r.node_id for r in H.hierarchy(spark.createDataFrame(links, LINKS), max_colocated=bound).collect() if r.back_edge} == {"a", "self"}


def test_links_take_the_latest_row_and_blank_parents_as_none(spark):
    rows = [("s", "a", "old", at(1), "x"), ("s", "a", "  ", at(2), "x"), ("s", "b", "a", None, "x"), (None, "q", "a", at(1), "x"), ("s", None, "a", at(1), "x"), ("s", "b", "a", None, "x")]
    got = H.links(spark.createDataFrame(rows, "scope string, node string, parent string, ingested_at timestamp, parent_id string"), "t", "scope", "node", "parent").collect()
    assert {(r.node_id, r.parent_id) for r in got} == {("a", None), ("b", "a")}


def test_empty_hierarchy_and_descendants(spark):
    empty = spark.createDataFrame([], LINKS)
    assert H.hierarchy(empty).count() == 0
    links = [("t", "s", "a", None), ("t", "s", "b", "a"), ("t", "s", "c", "b")]
    got = {(r.node_id, r.descendant_id, r.distance) for r in H.descendants(H.hierarchy(spark.createDataFrame(links, LINKS))).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


# ---- snapshots


def brute_changes(present, n_scans):
    out = set()
    for key in {k for k, _ in present}:
        for i in range(1, n_scans):
            a, b = present.get((key, i - 1)), present.get((key, i))
            if b is not None and a is None:
                out.add((i, key, "added"))
            elif a is not None and b is None:
                out.add((i, key, "removed"))
            elif a is not None and a != b:
                out.add((i, key, "changed"))
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_changes_against_brute_force(spark, block):
    rnd = random.Random(block)
    n = 9
    present = {(f"k{k}", i): rnd.randrange(2) for k in range(25) for i in range(n) if rnd.random() < 0.7}
    rows = [(f"s{i}", k, at(1), v) for (k, i), v in present.items()] + [("ghost", "k1", at(1), 1), ("s1", None, at(1), 1)]
    rows += [(f"s{i}", k, at(0), 7) for (k, i), _ in list(present.items())[:40]]  # superseded deliveries
    scans = spark.createDataFrame([(f"s{i}", b"x", i, n - 1) for i in range(n)], "scan string, series binary, idx int, last int")
    got = S.changes(spark.createDataFrame(rows, "scan string, key string, at timestamp, state bigint"), scans, block)
    assert {(int(r.scan_id[1:]), r.key, r.change_kind) for r in got.collect()} == brute_changes(present, n)
    assert got.count() == len(brute_changes(present, n))


def test_scans_are_ordered_by_instant_not_text(spark):
    rows = [("a", "r", ".", "2025-01-01T10:00:00+09:00", at(1)), ("b", "r", ".", "2025-01-01T02:00:00Z", at(1)), ("b", "r", ".", "2025-01-01T02:00:00Z", at(1)), ("c", "r", None, "no time", at(1)), ("d", "r", ".", "2025-01-01T02:30:00Z", at(1))]
    m = spark.createDataFrame(rows, "scan_id string, repo string, root string, scanned_at string, ingested_at timestamp")
    got = {r.scan: (r.idx, r.last) for r in S.numbered_scans(m, ["repo", "root"], "scan_id", "scanned_at").collect()}
    assert got == {"a": (0, 2), "b": (1, 2), "d": (2, 2), "c": (0, 0)}


def test_maps_compare_by_contents(spark):
    texts = [('{"a":"1","b":"2"}', '{ "b": "2", "a": "1" }', True), ('{"a":"1"}', '{"a":"2"}', False), ('{"a":null}', '{"a":""}', False), ("no json", "no json", True), (None, '{"a":"1"}', False)]
    df = spark.createDataFrame(texts, "a string, b string, same boolean")
    h = lambda c: S.state_hash(S.map_text(F.col(c)))
    assert [r.eq for r in df.select((h("a") == h("b")).alias("eq")).collect()] == [t[2] for t in texts]


def test_changes_of_empty_tables(spark):
    scans = spark.createDataFrame([], "scan string, series binary, idx int, last int")
    assert S.changes(spark.createDataFrame([], "scan string, key string, at timestamp, state bigint"), scans).count() == 0


# ---- shared parts


def test_latest_breaks_ties_and_ignores_extra_columns(spark):
    df = spark.createDataFrame([("k", None, "z", 1), ("k", at(1), "a", 2), ("k", at(1), "b", 3), (None, at(1), "n", 4)], "k string, at timestamp, v string, order int")
    assert {(r.k, r.v, r.first) for r in latest(df, ["k"], "at", ["v"], "first").collect()} == {("k", "b", at(1)), (None, "n", at(1))}


def test_hot_keys_and_split_lookup(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") == 1, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    hot = hot_keys(left, "k", 0.1)
    assert hot == [7]
    right = spark.range(0, 3000, 2).select((F.col("id") + 1).alias("k"), F.lit(True).alias("there"))
    plain = {(r.v, r.there) for r in left.join(right, "k", "left").collect()}
    assert {(r.v, r.there) for r in lookup(left, right, ["k"], small=False, hot=hot, hot_col="k").collect()} == plain
    assert hot_keys(left.limit(0), "k") == []
