"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, with cycles marked.

Links never leave their scope, so scopes up to MAX_COLOCATED nodes go to one task whole: it splits them into connected
components and walks each depth first with white, grey and black nodes. In larger scopes components are found by pointer
doubling (as many rounds as the logarithm of the depth), co-located and walked likewise, many a task. Components above
MAX_COLOCATED stay distributed: there doubling also gives sizes, paths and rings, so no group without bound reaches one task.
All ways give the same rows.

Defined results: a parent that is null, blank or unknown within the scope makes a root (depth 0). Nodes on a cycle, or
whose parents lead into one, get root '' and depth -1. Rows with a null node are dropped; repeated rows of a node count
once (latest delivery, ties by the greater parent). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, hot_keys, key_hash, latest, lookup

#: Nodes of a scope or component up to which one task walks it (about 200 bytes each).
MAX_COLOCATED = 300_000
#: path: from the root to the node; without a root, from the first node below the cycle. On or below a cycle ring_id is its
#: least node, ring_at the place of the node on it, or of the ring's node above, counted towards the parents, and steps the
#: way to the ring.
OUT = "table_name string, scope_id string, node_id string, root_id string, depth int, n_descendants int, path array<string>, back_edge boolean, ring_id string, ring_at int, ring_size int, steps int"
COLS = [x.split()[0] for x in OUT.split(", ")]
#: Path elements after which a task hands on what it has.
FLUSH = 200_000


def links(df: DataFrame, table_name: str, scope: str, node: str, parent: str, order: str = "ingested_at") -> DataFrame:
    """(table_name, scope_id, node_id, parent_id) with one row a node; blank parents are null."""
    src = df.where(F.col(node).isNotNull() & F.col(scope).isNotNull()).select(F.col(scope).alias("scope_id"), F.col(node).alias("node_id"), F.col(parent).alias("parent_id"), F.col(order).alias("o"))
    one = latest(src, ["scope_id", "node_id"], "o", ["parent_id"])
    blank = F.trim(F.coalesce(F.col("parent_id"), F.lit(""))) == ""
    return one.select(F.lit(table_name).alias("table_name"), "scope_id", "node_id", F.when(~blank, F.col("parent_id")).alias("parent_id"))


def _follow(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows with what their pointer's row holds; a pointer shared by many nodes isn't sent to one task."""
    hot = hot_keys(left, "ptr")
    return lookup(left, right, ["ptr"], "left", small=False, hot=hot, hot_col="ptr")


def components(base: DataFrame) -> DataFrame:
    """(nk, comp, linked) for the nodes `base` (nk, pk): comp names the component, linked whether the parent exists.

    Trees get their root's key by doubling. What no round resolves lies on or below a cycle and gets the least key on it.
    """
    there = base.select(F.col("nk").alias("ptr"), F.lit(True).alias("there"))
    parts = base.rdd.getNumPartitions()  # joins split into hot and other keys would multiply them
    state = _follow(base.select("nk", F.col("pk").alias("ptr")), there)
    linked = F.coalesce(F.col("there"), F.lit(False))
    state = cut(state.select("nk", linked.alias("linked"), F.when(linked, F.col("ptr")).alias("ptr"), (~linked).alias("done"), F.when(~linked, F.col("nk")).alias("comp")).coalesce(parts))
    open_ = state.where(~F.col("done")).count()
    while open_:
        ahead = state.select(F.col("nk").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("done").alias("done2"), F.col("comp").alias("comp2"))
        moved = _follow(state.where(~F.col("done")).select("nk", "linked", "ptr"), ahead)
        moved = moved.select("nk", "linked", F.when(~F.col("done2"), F.col("ptr2")).alias("ptr"), F.col("done2").alias("done"), F.col("comp2").alias("comp"))
        state = cut(state.where("done").unionByName(moved).coalesce(parts))
        left = state.where(~F.col("done")).count()
        if left == open_:
            break
        open_ = left
    trees = state.where("done").select("nk", "comp", "linked")
    if not open_:
        return trees
    ring = cut(state.where(~F.col("done")).select("nk").join(base.select("nk", F.col("pk").alias("ptr")), "nk").withColumn("least", F.col("nk")))
    # First every node gets the least key ahead of it, which on a cycle is the cycle's least; then each takes over what
    # its pointer's node has, until all agree with the node ahead, so tails end up with their cycle's.
    for settle in (F.least("least", "least2"), F.col("least2")):
        while True:
            ahead = ring.select(F.col("nk").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("least").alias("least2"))
            moved = _follow(ring, ahead).select("nk", F.col("ptr2").alias("ptr"), settle.alias("least"), (settle != F.col("least")).alias("moved"))
            ring = cut(moved.coalesce(parts))
            more = ring.where("moved").limit(1).count()
            ring = ring.drop("moved")
            if not more:
                break
    return trees.unionByName(ring.select("nk", F.col("least").alias("comp"), F.lit(True).alias("linked")))


def split(rows: list[tuple[str, str | None]]) -> list[list[tuple[str, str | None]]]:
    """The connected components of (node, parent) rows, in order; a parent that isn't among the nodes counts as none."""
    known = {n for n, _ in rows}
    chief = {n: p if p in known else n for n, p in rows}

    def find(n: str) -> str:
        trail: dict[str, None] = {}
        while n not in trail:
            trail[n] = None
            n = chief[n]
        end = n if chief[n] == n else min(list(trail)[list(trail).index(n):])  # a cycle's least node stands for it
        chief[end] = end
        for x in trail:
            chief[x] = end
        return end

    out: dict[str, list[tuple[str, str | None]]] = {}
    for n, p in rows:
        out.setdefault(find(n), []).append((n, p if p in known else None))
    return list(out.values())


def walk(rows: list[tuple[str, str | None]], with_paths: bool) -> Iterator[tuple]:
    """(node, root, depth, descendants, path, back edge, ring, place, ring's size, steps) of one component's rows.

    Iterative depth-first walk: white nodes are new, grey ones on the current path, black ones finished. A grey child
    closes the cycle: the ring is the current path from it on. A component without a root is entered by its nodes in
    order, so the first ring node met is the least.
    """
    parent = dict(rows)
    below: dict[str, list[str]] = {}
    for node, up in rows:
        if up is not None:
            below.setdefault(up, []).append(node)
    grey, black = 1, 2
    colour: dict[str, int] = {}
    depth: dict[str, int] = {}
    size: dict[str, int] = {}
    ring: list[str] = []
    roots = [n for n, up in rows if up is None]
    for start in roots or sorted(parent):
        if start in colour:
            continue
        colour[start], size[start], depth[start] = grey, 0, 0
        stack: list[tuple[str, Iterator[str]]] = [(start, iter(below.get(start, ())))]
        while stack:
            node, children = stack[-1]
            for child in children:
                if colour.get(child) == grey:
                    on_path = [n for n, _ in stack]
                    ring = on_path[on_path.index(child):]
                elif child in colour:
                    size[node] += size[child] + 1  # walked before from below the ring
                else:
                    colour[child], size[child], depth[child] = grey, 0, depth[node] + 1
                    stack.append((child, iter(below.get(child, ()))))
                    break
            else:
                colour[node] = black
                stack.pop()
                if stack:
                    size[stack[-1][0]] += size[node] + 1
    if roots:
        root = roots[0]
        for node, _ in rows:
            path: list[str] = []
            at = node if with_paths else None
            while at is not None:
                path.append(at)
                at = parent[at]
            yield node, root, depth[node], size[node], path[::-1], False, None, None, None, None
        return
    # The walk ran down the ring; places count towards the parents.
    place = {n: (len(ring) - i) % len(ring) for i, n in enumerate(ring)}
    for node, _ in rows:
        trail, at = [], node
        while at not in place:
            trail.append(at)
            at = parent[at]
        yield node, "", -1, size[node] if trail else len(rows) - 1, trail[::-1] if with_paths else [], node == ring[0], ring[0], place[at], len(ring), len(trail)


def _walker(with_paths: bool):
    def partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by scope or component, which may span batches."""
        out: list[tuple] = []
        group: list[tuple[str, str | None]] = []
        current, weight = None, 0

        def flush() -> pd.DataFrame:
            nonlocal out, weight
            done, out, weight = out, [], 0
            frame = pd.DataFrame(done, columns=COLS)
            return frame.astype({c: "Int32" for c in ("ring_at", "ring_size", "steps")})

        def close() -> Iterator[pd.DataFrame]:
            nonlocal weight
            for part in split(group):
                for r in walk(part, with_paths):
                    out.append((*current[1:], *r))
                    weight += 4 + len(r[4])
                    if weight > FLUSH:
                        yield flush()

        for pdf in frames:
            for comp, t, s, n, p in pdf[["comp", "table_name", "scope_id", "node_id", "parent_id"]].itertuples(index=False, name=None):
                if (comp, t, s) != current:
                    if group:
                        yield from close()
                    group, current = [], (comp, t, s)
                group.append((n, p if isinstance(p, str) else None))
        if group:
            yield from close()
        if out:
            yield flush()

    return partition


def _chase(nodes: DataFrame, rounds: int, trails: DataFrame | None = None) -> DataFrame:
    """(nk, ptr, size, hops, top, trail) of nodes (nk, node_id, ptr) by pointer doubling; ptr stays on and below a cycle.

    size counts a node and what is below it; hops is the way to the root `top`, trail the nodes on it from the root on,
    for the components of `trails` (comp): on or below a cycle a trail would have no end.
    """
    empty = F.array().cast("array<string>")
    trail = empty if trails is None else F.when(F.col("rooted"), F.array("node_id")).otherwise(empty)
    src = nodes if trails is None else nodes.join(F.broadcast(trails.withColumn("rooted", F.lit(True))), "comp", "left")
    state = cut(src.select("nk", "ptr", F.lit(1).cast("long").alias("size"), F.when(F.col("ptr").isNull(), 0).otherwise(1).alias("hops"), trail.alias("trail"), F.col("nk").alias("top")))
    parts = nodes.rdd.getNumPartitions()
    for _ in range(rounds):
        if not state.where(F.col("ptr").isNotNull()).limit(1).count():
            break
        gain = state.where(F.col("ptr").isNotNull()).groupBy(F.col("ptr").alias("nk")).agg(F.sum("size").alias("gain"))
        ahead = state.select(F.col("nk").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("trail").alias("trail2"), F.col("top").alias("top2"), F.col("hops").alias("hops2"))
        open_ = _follow(state.where(F.col("ptr").isNotNull()), ahead)
        open_ = open_.select("nk", F.col("ptr2").alias("ptr"), "size", (F.col("hops") + F.col("hops2")).alias("hops"), F.concat("trail2", "trail").alias("trail"), F.col("top2").alias("top"))
        state = open_.unionByName(state.where(F.col("ptr").isNull())).join(gain, "nk", "left")
        state = cut(state.withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0))).drop("gain").coalesce(parts))
    return state


def _doubled(big: DataFrame, with_paths: bool) -> DataFrame:
    """The same result for components too large for one task: (nk, comp, table_name, scope_id, node_id, ptr)."""
    rounds = max(1, big.count().bit_length())
    base = big.select("nk", "comp", "table_name", "scope_id", "node_id")
    rooted = big.where(F.col("ptr").isNull()).select("comp").distinct()
    state = _chase(big, rounds, rooted if with_paths else None)
    # After as many rounds all pointers left lie on a ring.
    open_ = state.where(F.col("ptr").isNotNull())
    tops = base.select(F.col("nk").alias("top"), F.col("node_id").alias("top_id"))
    trees = base.join(state.where(F.col("ptr").isNull()), "nk").join(tops, "top").select(
        "table_name", "scope_id", "node_id", F.col("top_id").alias("root_id"), F.col("hops").cast("int").alias("depth"), (F.col("size") - 1).cast("int").alias("n_descendants"), F.col("trail").alias("path"),
        F.lit(False).alias("back_edge"), F.lit(None).cast("string").alias("ring_id"), *[F.lit(None).cast("int").alias(c) for c in ("ring_at", "ring_size", "steps")],
    )
    if not open_.limit(1).count():
        return trees
    on_ring = open_.select(F.col("ptr").alias("nk")).distinct()
    rings = cut(base.join(on_ring, "nk"))
    of_comp = rings.groupBy("comp").agg(F.min(F.struct("node_id", "nk")).alias("least"), F.count(F.lit(1)).alias("ring_size")).select("comp", "least.nk", "ring_size", F.col("least.node_id").alias("ring_id"))
    total = base.groupBy("comp").agg(F.count(F.lit(1)).alias("total"))
    cyclic = big.join(of_comp.select("comp", "ring_size", "ring_id"), "comp")
    ring_mark = rings.select("nk", F.lit(True).alias("on_ring"))
    # Cut off their parents, all ring nodes are roots of what hangs on them; cut at its least node, the ring is a chain.
    tails = cyclic.join(ring_mark, "nk", "left").withColumn("ptr", F.when(F.col("on_ring").isNull(), F.col("ptr")))
    hang = _chase(tails, rounds, of_comp.select("comp") if with_paths else None)
    chain = cyclic.join(ring_mark, "nk").withColumn("ptr", F.when(F.col("node_id") != F.col("ring_id"), F.col("ptr")))
    place = _chase(chain, rounds).join(cyclic.select("nk", "ring_size"), "nk").select(F.col("nk").alias("top"), F.pmod(F.col("ring_size") - F.col("hops"), F.col("ring_size")).cast("int").alias("ring_at"))
    full = cyclic.join(hang.select("nk", "size", "hops", "top", "trail"), "nk").join(place, "top").join(total, "comp")
    ring = F.col("hops") == 0
    return trees.unionByName(full.select(
        "table_name", "scope_id", "node_id", F.lit("").alias("root_id"), F.lit(-1).alias("depth"),
        F.when(ring, F.col("total") - 1).otherwise(F.col("size") - 1).cast("int").alias("n_descendants"),
        F.when(ring | F.lit(not with_paths), F.array().cast("array<string>")).otherwise(F.slice("trail", 2, F.col("hops"))).alias("path"),
        (ring & (F.col("node_id") == F.col("ring_id"))).alias("back_edge"), "ring_id", "ring_at", F.col("ring_size").cast("int").alias("ring_size"), F.col("hops").cast("int").alias("steps"),
    ))


def hierarchy(nodes: DataFrame, with_paths: bool = True, max_colocated: int = MAX_COLOCATED) -> DataFrame:
    """OUT of the nodes (table_name, scope_id, node_id, parent_id), one row each.

    path is empty without `with_paths`. back_edge marks, of each cycle, the node whose link to its parent closes it (the
    least node).
    """
    every = cut(nodes.select("table_name", "scope_id", "node_id", "parent_id"))
    scope = ["table_name", "scope_id"]
    # At most nodes / max_colocated scopes; what is broadcast shrinks with the bound that makes it.
    wide = cut(every.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_colocated).select(*scope))
    small = every.join(F.broadcast(wide), scope, "left_anti").withColumn("comp", F.lit(None).cast("binary"))
    out = small.repartition(*scope).sortWithinPartitions(*scope).mapInPandas(_walker(with_paths), OUT)
    if not wide.limit(1).count():
        return out
    key = key_hash("table_name", "scope_id", "node_id")
    up = F.when(F.col("parent_id").isNotNull(), key_hash("table_name", "scope_id", "parent_id"))
    base = cut(every.join(F.broadcast(wide), scope, "left_semi").withColumns({"nk": key, "pk": up}))
    comp = components(base.select("nk", "pk"))
    full = base.join(comp, "nk").withColumn("parent_id", F.when(F.col("linked"), F.col("parent_id")))
    big = F.broadcast(cut(comp.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_colocated).select("comp")))
    near = full.join(big, "comp", "left_anti").select("comp", "table_name", "scope_id", "node_id", "parent_id")
    out = out.unionByName(near.repartition("comp").sortWithinPartitions("comp").mapInPandas(_walker(with_paths), OUT))
    far = full.join(big, "comp", "left_semi").select("nk", "comp", "table_name", "scope_id", "node_id", F.when(F.col("linked"), F.col("pk")).alias("ptr"))
    return out.unionByName(_doubled(cut(far), with_paths)) if far.limit(1).count() else out


def descendants(tree: DataFrame) -> DataFrame:
    """(table_name, scope_id, node_id, descendant_id, distance): every node with each distinct other one below it.

    A node on or below a cycle has all nodes of the ring above it, at the least distance. There are as many rows as
    n_descendants counts: in a chain or ring of n nodes about n * n, which is the result asked for.
    """
    keys = ["table_name", "scope_id"]
    up = F.expr("slice(path, 1, greatest(size(path) - 1, 0))")
    above = tree.where(F.size("path") > 1).select(*keys, F.col("node_id").alias("descendant_id"), F.size("path").alias("n"), F.posexplode(up).alias("i", "node_id"))
    out = above.select(*keys, "node_id", "descendant_id", (F.col("n") - 1 - F.col("i")).cast("int").alias("distance"))
    ring = tree.where("steps = 0").select(*keys, "ring_id", "node_id", F.col("ring_at").alias("place"))
    under = tree.where("ring_id is not null").select(*keys, "ring_id", F.col("node_id").alias("descendant_id"), "ring_at", "ring_size", "steps")
    turn = F.col("steps") + F.pmod(F.col("place") - F.col("ring_at"), F.col("ring_size"))
    return out.unionByName(under.join(ring, [*keys, "ring_id"]).where(F.col("node_id") != F.col("descendant_id")).select(*keys, "node_id", "descendant_id", turn.cast("int").alias("distance")))
