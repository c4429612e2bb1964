"""Bounded traversals of evidence graphs, level by level.

A queue's order is the order of (depth, start, ranks of the edges taken), so paths carry their ranks and a level is one
join; caps cut in that order, and where a cap is None nothing is sorted. Levels are written to the checkpoint folder
and read again; large ones without caps are only streamed.

Defined results: edges with a null end are ignored; parallel edges are different ways; a path holds at least one edge;
depth, path and frontier caps leave gap rows, cycles only where asked. Empty inputs give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import edge_rank, tier_rank
from ..tables import BROADCAST_ROWS, cut, row_bound, union

#: Rows of a level beyond which uncapped paths are streamed past broadcast edges instead of being written.
STREAM_ROWS = 200_000
#: Distinct edges up to which every task of `reachable` holds the graph (about 60 MB of names and numbers).
HELD_EDGES = 1_000_000
PATH = ["start", "node", "depth", "nodes", "edges", "order", "tier", "review", "unknown"]


def ordered_edges(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(from_node, to_node, edge_id, kind, rank, tier, review, unknown) with each node's edges ranked from 0.

    `edges` has edge_id, source, target, kind, evidence_tier and optionally classification.
    """
    a, b = ("target", "source") if reverse else ("source", "target")
    has_class = "classification" in edges.columns
    cls = F.col("classification") if has_class else F.lit(None).cast("string")
    rows = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select(F.col(a).alias("from_node"), F.col(b).alias("to_node"), "edge_id", "kind", tier_rank(F.col("evidence_tier")).alias("e_tier"), cls.alias("cls"))
    w = Window.partitionBy("from_node").orderBy(edge_rank(F.col("kind")), "to_node", "edge_id")
    review = F.col("kind").isin("interface-candidate", "override-candidate", "symbol-reconciliation") | ((F.col("kind") == "endpoint-match") & ((F.coalesce("cls", F.lit("")) != "MatchedEndpoint") | (F.col("e_tier") != 2))) | (F.col("e_tier") == 3)
    return rows.select("from_node", "to_node", "edge_id", "kind", (F.row_number().over(w) - 1).alias("rank"), "e_tier", F.coalesce(review, F.lit(False)).alias("e_review"), F.coalesce(F.col("cls") == "UnknownAnalysisGap", F.lit(False)).alias("e_unknown"), F.col("kind").isin("implements", "overrides").alias("e_hop"), F.col("kind").isin("interface-candidate", "override-candidate").alias("e_cand"))


def path_class(tier: Column, review: Column, unknown: Column) -> Column:
    """A path's class from its weakest tier's rank and whether any edge asks for review or is a gap."""
    return F.when(unknown, F.lit("UnknownAnalysisGap")).when(review | (tier == 3), F.lit("NeedsReviewPath")).when(tier == 2, F.lit("ProbableStaticPath")).otherwise(F.lit("StrongStaticPath"))


def bounded_paths(starts: DataFrame, edges: DataFrame, terminals: DataFrame | None, max_depth: int = 8, max_paths: int | None = 100, max_frontier: int | None = 10_000, reverse: bool = False, on_cycle: str = "gap", guard: bool = True, per_start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Node-simple paths from `starts` (node) to `terminals` (node), breadth first, and the gaps.

    A path ends at the first terminal that it reaches; without terminals, where nothing leads on. With `guard` no path mixes
    implements or overrides with candidate edges. `per_start` caps the paths of each root (in reverse a path's end) before
    the total cap. A cap of None keeps everything.
    """
    spark = starts.sparkSession
    e = ordered_edges(edges, reverse).drop("kind")
    # A way ends at a terminal or, without terminals, where nothing leads on; the edge into such a node says so.
    marks = terminals.select(F.col("node").alias("to_node")).distinct() if terminals is not None else e.select(F.col("from_node").alias("to_node")).distinct()
    e = e.join(marks.withColumn("__mark", F.lit(True)), "to_node", "left")
    e = cut(e.withColumn("e_end", F.col("__mark").isNotNull() if terminals is not None else F.col("__mark").isNull()).drop("__mark"))
    # Without caps no level has to be whole at any time: once levels grow large they are streamed past the edges, not written.
    may_stream = max_paths is None and max_frontier is None and not per_start and row_bound(e, BROADCAST_ROWS)
    degree = e.groupBy("from_node").agg(F.count(F.lit(1)).alias("out"))
    streamed = False
    first = starts.select("node").where(F.col("node").isNotNull()).distinct()
    frontier = cut(first.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.array().cast("array<int>").alias("order"), F.lit(1).alias("tier"), F.lit(False).alias("review"), F.lit(False).alias("unknown"), F.lit(False).alias("hop"), F.lit(False).alias("cand"), F.lit(False).alias("ended")))
    found, gaps = [], []
    gap = lambda df, kind: df.select("start", "node", "depth", F.lit(kind).alias("gap"))
    for depth in range(max_depth + 1):
        state = frontier
        if terminals is not None or depth < max_depth:
            found.append(state.where("ended").select(*PATH))
            state = state.where(~F.col("ended"))
        if depth == max_depth:
            gaps.append(gap(state, "DepthLimit"))
            if terminals is None:
                found.append(state.where(F.size("edges") > 0).select(*PATH))
            break
        if may_stream and not streamed:
            ahead = state.join(F.broadcast(degree), F.col("node") == F.col("from_node")).agg(F.sum("out")).first()[0] or 0
            if streamed := ahead > STREAM_ROWS:
                state = state.repartition(8 * spark.sparkContext.defaultParallelism)
        step = state.join(F.broadcast(e) if streamed else e, F.col("node") == F.col("from_node"))
        seen = F.expr("array_contains(nodes, to_node)")
        if on_cycle == "gap":
            gaps.append(gap(step.where(seen), "CycleDetected"))
        ok = ~seen
        if guard:
            ok = ok & ~((F.col("hop") & F.col("e_cand")) | (F.col("cand") & F.col("e_hop")))
        moved = step.where(ok).select("start", F.col("to_node").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_append("nodes", F.col("to_node")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("order", F.col("rank")).alias("order"), F.greatest("tier", "e_tier").alias("tier"), (F.col("review") | F.col("e_review")).alias("review"), (F.col("unknown") | F.col("e_unknown")).alias("unknown"), (F.col("hop") | F.col("e_hop")).alias("hop"), (F.col("cand") | F.col("e_cand")).alias("cand"), F.col("e_end").alias("ended"))
        if streamed:
            frontier = moved
            continue
        moved = cut(moved)
        n = moved.count()
        if max_frontier is not None and n > max_frontier:
            gaps.append(spark.createDataFrame([(None, None, depth + 1, "FrontierLimit")], "start string, node string, depth int, gap string"))
            moved = cut(moved.orderBy("start", "order").limit(max_frontier))
        if not n:
            break
        frontier = moved
    paths = union(found) if found else frontier.where(F.lit(False)).select(*PATH)
    if per_start:
        # A reverse path's root is its end.
        root = "node" if reverse else "start"
        paths = cut(paths.withColumn("__r", F.row_number().over(Window.partitionBy(root).orderBy("depth", "start", "order"))))
        gaps.append(paths.where(F.col("__r") == per_start + 1).select("start", "node", "depth", F.lit("RootPathLimit").alias("gap")))
        paths = paths.where(F.col("__r") <= per_start).drop("__r")
    if max_paths is not None:
        paths = cut(paths)
        if paths.count() > max_paths:
            gaps.append(spark.createDataFrame([(None, None, None, "PathLimit")], "start string, node string, depth int, gap string"))
        paths = paths.orderBy("depth", "start", "order").limit(max_paths)
    all_gaps = union(gaps) if gaps else spark.createDataFrame([], "start string, node string, depth int, gap string")
    return paths.withColumn("classification", path_class(F.col("tier"), F.col("review"), F.col("unknown"))), all_gaps


def edge_simple_paths(starts: DataFrame, edges: DataFrame, max_depth: int = 5, max_paths: int | None = 50, direction: str = "outgoing", maximal: bool = True) -> DataFrame:
    """Depth-first paths that use no edge twice, in depth-first order: (start, node, depth, nodes, edges).

    `direction` is outgoing, incoming or both; paths are the maximal ones, cut at max_depth.
    """
    sides = {"outgoing": [False], "incoming": [True], "both": [False, True]}[direction]
    e = ordered_edges(edges, sides[0])
    for r in sides[1:]:
        e = e.unionByName(ordered_edges(edges, r))
    e = cut(e.withColumn("rank", F.row_number().over(Window.partitionBy("from_node").orderBy("rank", "to_node", "edge_id"))))
    first = starts.select("node").where(F.col("node").isNotNull()).distinct()
    frontier = cut(first.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.array().cast("array<int>").alias("order")))
    found = []
    for _ in range(max_depth):
        step = frontier.join(e, (F.col("node") == F.col("from_node")) & ~F.expr("array_contains(edges, edge_id)"), "left")
        dead = step.where(F.col("edge_id").isNull() & (F.size("edges") > 0))
        found.append(dead.select("start", "node", "depth", "nodes", "edges", "order"))
        frontier = cut(step.where(F.col("edge_id").isNotNull()).select("start", F.col("to_node").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_append("nodes", F.col("to_node")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("order", F.col("rank")).alias("order")))
        if not maximal:
            found.append(frontier)
        if not frontier.limit(1).count():
            break
    out = frontier
    for f in found:
        out = out.unionByName(f)
    out = out.dropDuplicates(["start", "order"])
    return out if max_paths is None else out.orderBy("start", "order").limit(max_paths)


def drop_suffixes(paths: DataFrame) -> DataFrame:
    """Paths that are no strict suffix of another: each path's strict suffixes are listed once and joined away."""
    tails = paths.select(F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("edges"), F.lit(2))), lambda i: F.slice("edges", i, F.size("edges")))).alias("edges")).where(F.size("edges") > 0).distinct()
    return paths.join(tails, "edges", "left_anti")


def gap_counts(starts: DataFrame, edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """(gap, n): how many CycleDetected and DepthLimit gaps bounded_paths without terminals, caps and guard has.

    No way is listed for its own sake: parallel edges are one with a weight, a start that nothing leads to can't be met
    again, so ways from such starts are counted as one, and the last level follows from degrees. Large levels are streamed.
    """
    ends = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy("source", "target").agg(F.count(F.lit(1)).alias("w"))
    ends = cut(ends)
    ids = cut(ends.select(F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()))
    g = ends.join(ids.select(F.col("name").alias("source"), F.col("id").alias("a")), "source").join(ids.select(F.col("name").alias("target"), F.col("id").alias("b")), "target")
    g = cut(g.select("a", "b", "w"))
    small = row_bound(g, BROADCAST_ROWS)
    side = F.broadcast if small else (lambda df: df)
    degree = g.groupBy("a").agg(F.sum("w").alias("out"), F.count(F.lit(1)).alias("n_out"))
    met = g.select(F.col("b").alias("id"), F.lit(True).alias("met")).distinct()
    first = starts.select(F.col("node").alias("name")).where(F.col("name").isNotNull()).distinct().join(ids, "name", "left").join(met, "id", "left")
    # (at, nodes, w): where ways stand, the nodes on them that can be met again, and how many ways these are.
    state = cut(first.select(F.col("id").alias("at"), F.when(F.col("met"), F.array("id")).otherwise(F.array().cast("array<bigint>")).alias("nodes"), F.lit(1).cast("long").alias("w")).groupBy("at", "nodes").agg(F.sum("w").alias("w")))
    counts, streamed = [], False
    count = lambda df, kind, n: df.agg(F.sum(n).alias("n")).select(F.lit(kind).alias("gap"), "n")
    if max_depth == 0:
        counts.append(count(state, "DepthLimit", F.col("w")))
    for depth in range(max_depth):
        seen = state.select("at", F.col("w").alias("ways"), F.explode("nodes").alias("seen")).join(side(g), (F.col("at") == F.col("a")) & (F.col("seen") == F.col("b")))
        counts.append(count(seen, "CycleDetected", F.col("ways") * F.col("w")))
        if depth == max_depth - 1:
            counts += [count(state.join(side(degree), F.col("at") == F.col("a")), "DepthLimit", F.col("w") * F.col("out")), count(seen, "DepthLimit", -F.col("ways") * F.col("w"))]
            break
        if small and depth and not streamed:
            ahead = state.join(side(degree), F.col("at") == F.col("a")).agg(F.sum("n_out")).first()[0] or 0
            if streamed := ahead > STREAM_ROWS:
                state = state.repartition(8 * state.sparkSession.sparkContext.defaultParallelism)
        moved = state.withColumnRenamed("w", "ways").join(side(g), F.col("at") == F.col("a")).where(~F.expr("array_contains(nodes, b)"))
        moved = moved.select(F.col("b").alias("at"), F.array_append("nodes", F.col("b")).alias("nodes"), (F.col("ways") * F.col("w")).alias("w"))
        if not depth:  # from then on ways that differ stay different
            moved = moved.groupBy("at", "nodes").agg(F.sum("w").alias("w"))
        state = moved if streamed else cut(moved)
    return union(counts).groupBy("gap").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def reachable(starts: DataFrame, edges: DataFrame, max_depth: int | None = None, reverse: bool = False, max_held: int = HELD_EDGES) -> DataFrame:
    """(start, node, distance): everything reachable, each at its least distance; a node seen before isn't expanded.

    It goes on until nothing new is found, or for `max_depth` levels. Up to `max_held` distinct edges are held by every task,
    which searches from its starts with no row of a pair written or shuffled; more are searched level by level.
    """
    a, b = ("target", "source") if reverse else ("source", "target")
    e = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where(F.col("node").isNotNull() & F.col("next").isNotNull()).distinct())
    first = starts.select("node").where(F.col("node").isNotNull()).distinct()
    if row_bound(e, max_held):
        return _reach_held(first, e, max_depth)
    frontier = cut(first.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance")))
    levels, d = [frontier], 0
    while max_depth is None or d < max_depth:
        d += 1
        new = frontier.join(e, "node").select("start", F.col("next").alias("node")).distinct().join(union(levels).select("start", "node"), ["start", "node"], "left_anti")
        frontier = cut(new.withColumn("distance", F.lit(d)))
        if not frontier.limit(1).count():
            break
        levels.append(frontier)
        if len(levels) > 8:
            levels = [cut(union(levels).coalesce(64))]
    return union(levels)


def _reach_held(starts: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """`reachable` over edges (node, next) that fit into memory: breadth first from 64 starts at a time, a bit for each."""
    spark = starts.sparkSession
    pairs = edges.toArrow()
    names = pc.unique(pa.chunked_array([*pairs["node"].chunks, *pairs["next"].chunks], pa.string()).combine_chunks())
    source, target = (pc.index_in(pairs[c], names).to_numpy().astype(np.int32) for c in ("node", "next"))
    order = np.argsort(source, kind="stable")
    held = spark.sparkContext.broadcast((names, np.concatenate([[0], np.cumsum(np.bincount(source, minlength=len(names)))]), target[order]))
    columns = ["start", "node", "distance"]

    def rows(start, node, distance: int):
        return pa.RecordBatch.from_arrays([start.cast(pa.string()), node.cast(pa.string()), pa.array(np.full(len(start), distance, np.int32))], names=columns)

    def search(batches):
        names, begin, target = held.value
        for batch in batches:
            own = batch.column(0)
            yield rows(own, own, 0)
            ids = pc.index_in(own, names).drop_null().to_numpy()
            for at in range(0, len(ids), 64):
                block = ids[at : at + 64]
                seen = np.zeros(len(names), np.uint64)
                seen[block] = np.uint64(1) << np.arange(len(block), dtype=np.uint64)
                nodes, bits, d = block, seen[block], 0
                while len(nodes) and (max_depth is None or d < max_depth):
                    d += 1
                    n = begin[nodes + 1] - begin[nodes]
                    to = target[np.repeat(begin[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                    if not len(to):
                        break
                    by = np.argsort(to, kind="stable")
                    to, came = to[by], np.repeat(bits, n)[by]
                    heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                    nodes, bits = to[heads], np.bitwise_or.reduceat(came, heads)
                    bits &= ~seen[nodes]
                    nodes, bits = nodes[bits != 0], bits[bits != 0]
                    seen[nodes] |= bits
                    for k in range(0, len(nodes), 4096):
                        of = np.unpackbits(bits[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        which, bit = np.nonzero(of)
                        yield rows(names.take(pa.array(block[bit])), names.take(pa.array(nodes[k : k + 4096][which])), d)

    parts = 8 * spark.sparkContext.defaultParallelism
    return starts.select("node").repartition(parts).mapInArrow(search, "start string, node string, distance int")


def reaching(targets: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node: everything from which a target (node) can be reached, in `max_depth` steps if given, targets included; one row
    a node, whatever the starts."""
    e = cut(edges.select(F.col("target").alias("node"), F.col("source").alias("next")).where(F.col("node").isNotNull() & F.col("next").isNotNull()).distinct())
    frontier = cut(targets.select("node").where(F.col("node").isNotNull()).distinct())
    levels, d = [frontier], 0
    while (max_depth is None or d < max_depth) and frontier.limit(1).count():
        d += 1
        frontier = cut(frontier.join(e, "node").select(F.col("next").alias("node")).distinct().join(union(levels), "node", "left_anti"))
        levels.append(frontier)
        if len(levels) > 8:
            levels = [cut(union(levels).coalesce(64))]
    return union(levels)


def bfs_tree(starts: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(start, node, distance, parent, edge_id): one way to each node of a start, the first in breadth-first order."""
    e = cut(ordered_edges(edges))
    frontier = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("edge_id"), F.array(F.lit(0)).alias("order")).distinct())
    seen = frontier
    for d in range(1, max_depth + 1):
        step = frontier.join(e, F.col("node") == F.col("from_node")).select("start", F.col("to_node").alias("node"), F.lit(d).alias("distance"), F.col("from_node").alias("parent"), e["edge_id"].alias("edge_id"), F.array_append("order", F.col("rank")).alias("order"))
        best = step.groupBy("start", "node").agg(F.min(F.struct("order", "parent", "edge_id")).alias("m")).select("start", "node", F.lit(d).alias("distance"), "m.parent", "m.edge_id", "m.order")
        frontier = cut(best.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier).coalesce(64))
    return seen.drop("order")


def lift_to_sources(paths: DataFrame, sources: DataFrame, per_source: int = 5) -> DataFrame:
    """Paths under each source that they touch, at most `per_source`; `sources` has node, source_id."""
    touched = paths.select("start", "order", "depth", F.explode("nodes").alias("node")).join(sources, "node").select("start", "order", "depth", "source_id").distinct()
    w = Window.partitionBy("source_id").orderBy("depth", "start", "order")
    return touched.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_source)


# ---- classes of paths and what is missing


def reverse_class(tier: Column, review: Column, unknown: Column, reduced_source: Column) -> Column:
    """A reverse path's class: a source that was read in part asks for review, whatever the edges say."""
    return F.when(unknown, F.lit("UnknownAnalysisGap")).when(reduced_source | review | (tier == 3), F.lit("NeedsReviewPath")).when(tier == 2, F.lit("ProbableStaticPath")).otherwise(F.lit("StrongStaticPath"))


def value_origin(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, order, value_class) of the paths that hold value edges (arguments or forwarded parameters).

    `paths` has start, order, edges; `edges` as for bounded_paths. Paths without a value edge have none.
    """
    e = edges.select("edge_id", "kind", tier_rank(F.col("evidence_tier")).alias("t"))
    steps = paths.select("start", "order", F.explode("edges").alias("edge_id")).join(e, "edge_id")
    value = F.col("kind").isin("parameter-forward", "argument-passed")
    agg = steps.groupBy("start", "order").agg(F.bool_or(value).alias("has"), F.max("t").alias("t"), F.bool_or(value & (F.col("t") > 1)).alias("weak"), F.bool_or(F.col("kind").isin("symbol-reconciliation", "endpoint-match")).alias("review"))
    cls = F.when(F.col("t") == 4, F.lit("UnknownAnalysisGap")).when(F.col("review") | (F.col("t") == 3), F.lit("NeedsReviewPath")).when((F.col("t") == 2) | F.col("weak"), F.lit("ProbableStaticPath")).otherwise(F.lit("StrongStaticPath"))
    return agg.where("has").select("start", "order", cls.alias("value_class"))


def legacy_class(paths: DataFrame, edges: DataFrame, hub: int = 5, generic: tuple[str, ...] = ("id", "name", "value", "key", "type", "data")) -> DataFrame:
    """Paths whose end many edges reach, or that has a generic name, are for review in the legacy view."""
    degree = edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    weak = (F.coalesce("in_degree", F.lit(0)) >= hub) | F.lower(F.regexp_extract("node", r"([^.:]*)$", 1)).isin(*generic)
    return paths.join(degree, "node", "left").withColumn("classification", F.when(weak & F.col("classification").isin("StrongStaticPath", "ProbableStaticPath"), F.lit("NeedsReviewPath")).otherwise(F.col("classification"))).drop("in_degree")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """Display names that several nodes of one source have; paths over them are downgraded."""
    return nodes.groupBy("source_id", "display_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def no_path_gaps(starts: DataFrame, paths: DataFrame, edges: DataFrame, nodes: DataFrame, reduced: DataFrame) -> DataFrame:
    """(start, gap) for starts without a path: unknown where a source read in part is reachable, else no path.

    `nodes` has node, source_id; `reduced` source_id.
    """
    alone = starts.select(F.col("node").alias("start")).distinct().join(paths.select("start").distinct(), "start", "left_anti")
    read_in_part = nodes.join(reduced.select("source_id").distinct(), "source_id", "left_semi").select("node")
    met = reaching(read_in_part, edges).select(F.col("node").alias("start"), F.lit(True).alias("hit"))
    return alone.join(met, "start", "left").select("start", F.when(F.col("hit"), F.lit("UnknownAnalysisGap")).otherwise(F.lit("NoPathFound")).alias("gap"))


def override_candidates(relationships: DataFrame, max_depth: int = 5) -> DataFrame:
    """(base, candidate, depth): members that override a base through a chain of at most `max_depth` overrides."""
    r = relationships.where(F.col("kind") == "overrides").select(F.col("to_symbol").alias("source"), F.col("from_symbol").alias("target"))
    return reachable(r.select(F.col("source").alias("node")).distinct(), r, max_depth).where(F.col("distance") > 0).select(F.col("start").alias("base"), F.col("node").alias("candidate"), F.col("distance").alias("depth"))
