"""Iterative jobs: breadth-first reach, best paths, witness forests, components.

All loops are semi-naive: a round joins only the rows found in the round before
with the edges, removes what is already known with an anti join and appends the
rest to a written table. They end when nothing new is found; a bound on the
depth is part of a question and never a default here. Edges are a written table
and joined as they are: a small frontier is broadcast by its measured size and
the edges do not move, a large one is joined by a shuffle whose hot keys the
adaptive skew join may split. Once the known rows are many they are bucketed by
their key, so that the anti join of a round moves the new rows only. Walks that
stay inside a key (a lockfile) are dealt out by it once, and no round moves a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from supplygraph import session
from supplygraph.session import DealtTable, GrowingTable, Scratch


def rounds(first: int, last: int | None):
    """Depths from ``first`` to ``last``, without an end if that is None."""
    return count(first) if last is None else range(first, last + 1)


def reach(
    seeds: DataFrame,
    edges: DataFrame,
    group: Sequence[str],
    scratch: Scratch,
    max_depth: int | None = None,
    carry: dict[str, Column] | None = None,
    start_depth: int = 0,
    edge_keys: Sequence[str] = (),
    keep: Column | None = None,
    entering: DataFrame | None = None,
    dealt: bool = False,
    saved: bool = False,
) -> DataFrame:
    """Every node reachable from a seed with its smallest depth.

    ``seeds``: ``group`` columns, ``node`` and the ``carry`` columns.
    ``edges``: ``edge_keys`` (shared with the seeds), ``src``, ``dst``.
    ``carry`` maps a column to the aggregate that picks its value among the
    equally short arrivals, which makes witnesses deterministic.
    ``keep`` is a predicate on new rows, evaluated every round. Without
    ``max_depth`` the walk ends when a round finds nothing new.
    ``entering`` (the seeds' columns and ``depth``) are rows that join the walk
    in the round of their depth; all rounds to ``max_depth`` are then made.
    ``dealt``: seeds and edges are written tables that are dealt out by
    ``edge_keys`` already. ``saved``: the edges are a written table, no plan.
    """
    carry = carry or {}
    key = [*group, "node"]
    cols = [*key, "depth", *carry]

    def once(rows: DataFrame, depth: int) -> DataFrame:
        rows = rows.groupBy(*key).agg(*[agg.alias(c) for c, agg in carry.items()]) if carry else rows.select(*key).distinct()
        return rows.withColumn("depth", F.lit(depth))

    def following(frontier: DataFrame, arcs: DataFrame, known: DataFrame, depth: int) -> DataFrame:
        step = frontier.withColumnRenamed("node", "src").join(arcs, [*edge_keys, "src"]).drop("src", "depth")
        step = step.withColumnRenamed("dst", "node")
        if entering is not None:
            step = step.unionByName(entering.filter(F.col("depth") == depth).select(*step.columns))
        step = once(step, depth)
        if keep is not None:
            step = step.filter(keep)
        return step.join(known.select(*key), key, "left_anti").select(*cols)

    edges = edges.select(*edge_keys, "src", "dst")
    if edge_keys and entering is None and set(edge_keys) <= set(group) and (dealt or edges.count() > session.DEALT_FROM):
        return _reach_apart(seeds, edges, edge_keys, once, following, cols, scratch, rounds(start_depth + 1, max_depth), start_depth, dealt)
    seen = GrowingTable(scratch, "reach", key)
    frontier, _ = seen.append(once(seeds, start_depth).select(*cols))
    if not saved:
        edges = scratch.save(edges, "edges")
        written = scratch.last
    for depth in rounds(start_depth + 1, max_depth):
        frontier, n = seen.append(following(frontier, edges, seen.read(), depth))
        if n == 0 and entering is None:
            break
    if not saved:
        scratch.forget(written)
    return seen.read()


def _reach_apart(seeds, edges, edge_keys, once, following, cols, scratch: Scratch, depths, start_depth: int, dealt: bool) -> DataFrame:
    """The rounds of ``reach`` where no walk leaves its ``edge_keys``: all tables are dealt out by these."""
    with session.keys_apart(scratch.spark):
        arcs, seen = DealtTable(scratch, "arcs", edge_keys), DealtTable(scratch, "apart", edge_keys)
        if not dealt:
            arcs.append(edges, shuffle=True)
            seeds = seeds.repartition(seen.buckets, *edge_keys)
        seen.append(once(seeds, start_depth).select(*cols))
        for depth in depths:
            frontier = seen.read().filter(F.col("depth") == depth - 1)
            if not seen.append(following(frontier, edges if dealt else arcs.read(), seen.read(), depth)):
                break
        if not dealt:
            arcs.forget()
    return seen.read()


def shortest_paths(
    seeds: DataFrame,
    edges: DataFrame,
    targets: DataFrame,
    scratch: Scratch,
    max_hops: int,
    per_pair: int,
    any_target: bool = False,
) -> DataFrame:
    """Up to ``per_pair`` simple paths per (source, target), shortest first, equal lengths by path.

    ``seeds``: ``source``. ``edges``: ``src, dst``. ``targets``: ``node``. With
    ``any_target`` the number holds for a source over all its targets.

    The graph is cut to what the sources reach. Paths then grow backwards from
    the targets: a node keeps its ``width`` best ways to each target, so the rows
    are bounded by nodes, targets and width, however many paths there are. A way
    that is not among a node's best is on no wanted path, because the better ones
    extend alike; only where one of them would visit a node twice may it be
    needed after all. Targets where a node that lost ways had one refused for
    that are done again with four times the width, until there is none.
    """
    starts = seeds.select("source").distinct()
    near = reach(starts.select(F.col("source").alias("node")), edges, [], scratch, max_hops)
    live = scratch.save(
        edges.select("src", "dst").distinct().join(near.select(F.col("node").alias("src"), F.col("depth").alias("before")), "src")
        .join(near.select(F.col("node").alias("dst")), "dst", "left_semi"),
        "live",
    )
    left = scratch.save(targets.select("node").distinct().join(near.select("node"), "node", "left_semi").select(
        "node", F.lit("").alias("goal") if any_target else F.col("node").cast("string").alias("goal")
    ), "goals")
    width, parts = per_pair, []
    while True:
        ways, again = best_ways(left, live, scratch, max_hops, width)
        mine = ways.filter("hops > 0").join(starts, F.col("node") == F.col("source"), "left_semi")
        if again is None:
            parts.append(mine)
            break
        parts.append(mine.join(again, "goal", "left_anti"))
        left, width = left.join(again, "goal", "left_semi"), 4 * width
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    ranked = top_k(found, ["node", "goal"], [F.col("hops"), F.col("path")], per_pair)
    return ranked.select(F.col("node").alias("source"), F.element_at("path", -1).alias("target"), "hops", "path", "rank")


def best_ways(goals: DataFrame, live: DataFrame, scratch: Scratch, max_hops: int, width: int) -> tuple[DataFrame, DataFrame | None]:
    """``node, goal, hops, path``: each node's ``width`` best simple ways to each goal, and the goals for which that was too few.

    ``goals``: ``node, goal``. ``live``: ``src, dst, before``, the last being the
    least number of hops in which ``src`` is reached at all.
    """
    kept = GrowingTable(scratch, "ways")
    frontier, n = kept.append(goals.select("node", "goal", F.lit(0).alias("hops"), F.array("node").alias("path"), F.lit(False).alias("over")))
    refused = []
    for hops in range(1, max_hops + 1):
        if n == 0:
            break
        grown = frontier.filter("not over").withColumnRenamed("node", "dst").join(live.filter(F.col("before") + hops <= max_hops), "dst")
        loops, seen = F.array_contains("path", F.col("src")), Observation()
        step = grown.observe(seen, F.count_if(loops).alias("n")).filter(~loops).select(
            F.col("src").alias("node"), "goal", F.lit(hops).alias("hops"), F.concat(F.array("src"), "path").alias("path")
        )
        # one more than may stay tells whether any is lost
        best = top_k(step, ["node", "goal"], [F.col("path")], width + 1)
        have = kept.read().filter("not over").groupBy("node", "goal").agg(F.count("*").alias("have"))
        place = F.col("rank") + F.coalesce("have", F.lit(0))
        fresh = best.join(have, ["node", "goal"], "left").filter(place <= width + 1).select(
            "node", "goal", "hops", "path", (place > width).alias("over")
        )
        last = frontier
        frontier, n = kept.append(fresh)
        if seen.get["n"]:
            again = last.filter("not over").withColumnRenamed("node", "dst").join(live, "dst").filter(loops)
            refused.append(scratch.save(again.select(F.col("dst").alias("node"), "goal").distinct(), "refused"))
    ways = kept.read()
    if not refused:
        return ways.filter("not over").drop("over"), None
    lost, some = ways.filter("over").select("node", "goal").distinct(), refused[0]
    for more in refused[1:]:
        some = some.unionByName(more)
    again, n = scratch.save_counted(some.join(lost, ["node", "goal"], "left_semi").select("goal").distinct(), "again")
    return ways.filter("not over").drop("over"), again if n else None


def witness_forest(seeds: DataFrame, edges: DataFrame, scratch: Scratch, max_depth: int | None = None) -> DataFrame:
    """``pv, node, depth, pred``: all that a seed reaches, with one predecessor on a shortest path.

    ``seeds``: ``pv, node``. Of several predecessors the least counts, so the
    whole path follows from the rows; ``rendered`` writes it out.
    """
    seen = GrowingTable(scratch, "forest", ["pv", "node"])
    frontier, _ = seen.append(seeds.select("pv", "node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("pred")).distinct())
    edges = scratch.save(edges.select("src", "dst"), "edges")
    for depth in rounds(1, max_depth):
        step = frontier.select("pv", F.col("node").alias("src")).join(edges, "src").groupBy("pv", F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
        fresh = step.join(seen.read().select("pv", "node"), ["pv", "node"], "left_anti").select("pv", "node", F.lit(depth).alias("depth"), "pred")
        frontier, n = seen.append(fresh)
        if n == 0:
            break
    return seen.read()


def rendered(forest: DataFrame, scratch: Scratch, wanted: DataFrame | None = None) -> DataFrame:
    """``pv, node, depth, path``: the paths of a forest from seed to node, by pointer doubling.

    A row knows the nodes from itself back to just before ``far``; a round puts
    those of ``far`` in front, so a path of ``d`` nodes takes about log2 ``d``
    rounds. ``wanted`` (``pv, node``) leaves out what lies on no wanted path.
    """
    if wanted is not None:
        up = forest.filter("pred is not null").select("pv", F.col("node").alias("src"), F.col("pred").alias("dst"))
        back = reach(wanted.select("pv", "node").distinct(), up, ["pv"], scratch, edge_keys=["pv"])
        forest = forest.join(back.select("pv", "node"), ["pv", "node"], "left_semi")
    first = forest.select("pv", "node", "depth", F.col("pred").alias("far"), F.array("node").alias("path"))
    done, waiting = first.filter("far is null"), first.filter("far is not null")
    left = not waiting.isEmpty()
    while left:
        known = done.unionByName(waiting).select("pv", F.col("node").alias("far"), F.col("far").alias("next"), F.col("path").alias("front"))
        step = waiting.join(known, ["pv", "far"]).select("pv", "node", "depth", F.col("next").alias("far"), F.concat("front", "path").alias("path"))
        seen = Observation()
        step = scratch.save(step.observe(seen, F.count_if(F.col("far").isNotNull()).alias("n")), "doubled")
        done, waiting, left = done.unionByName(step.filter("far is null")), step.filter("far is not null"), seen.get["n"] > 0
    out = done.drop("far")
    return out if wanted is None else out.join(wanted.select("pv", "node").distinct(), ["pv", "node"], "left_semi")


def strong_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Strongly connected components: ``(node, root)``, the root being the least node.

    ``edges``: ``src, dst``. Nodes without an edge in or out are components of
    their own and go first, round by round. In what is left a node's colour is
    the least node that reaches it; a component has one colour, and the nodes of
    a colour that lead back to the colour's own node are its component. They go,
    with all edges between colours, until no edge is left.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left, n = scratch.save_counted(edges.select("src", "dst").filter("src <> dst").distinct(), "arcs")
    parts = []
    while n:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
            left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        before = n
        left, n = scratch.save_counted(inner.select("src", "dst"), "trimmed")
        if n < before:
            continue
        colour = coloured(left, scratch)
        both = left.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(
            colour.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").filter("colour = other")
        both = scratch.save(both.select("colour", F.col("dst").alias("src"), F.col("src").alias("dst")), "within")
        roots = colour.filter("node = colour").select("colour", "node")
        member = reach(roots, both, ["colour"], scratch, edge_keys=["colour"]).select("node", F.col("colour").alias("root"))
        parts.append(member)
        gone = member.select("node")
        rest = both.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(
            gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left, n = scratch.save_counted(rest, "arcs")
    if not parts:
        return nodes.select("node", F.col("node").alias("root"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def condensed_reach(seeds: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What each seed reaches, itself included, whatever the distance: ``(node, root)`` and ``(root, reached)``.

    Nodes of one strongly connected component reach the same, so that is stored
    once for a component: which components ``reached`` it leads to. ``seeds``:
    ``node``; ``members_reached`` writes the nodes out.
    """
    member = scratch.save(strong_components(edges, scratch), "members")
    alone = seeds.select("node").distinct().join(member, "node", "left_anti").select("node", F.col("node").alias("root"))
    member = scratch.save(member.unionByName(alone), "members")
    arcs = edges.join(member.withColumnRenamed("node", "src").withColumnRenamed("root", "a"), "src").join(
        member.withColumnRenamed("node", "dst").withColumnRenamed("root", "b"), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    roots = seeds.select("node").distinct().join(member, "node").select("root", F.col("root").alias("node")).distinct()
    return member, reach(roots, arcs, ["root"], scratch).select("root", F.col("node").alias("reached"))


def members_reached(seeds: DataFrame, member: DataFrame, reached: DataFrame) -> DataFrame:
    """``node, reaches`` of the given seeds, from the tables of ``condensed_reach``."""
    found = seeds.select("node").distinct().join(member, "node").join(reached, "root").select("node", "reached")
    return found.join(member.select(F.col("node").alias("reaches"), F.col("root").alias("reached")), "reached").select("node", "reaches")


def coloured(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, colour``: the least node that reaches each node, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    state = scratch.save(nodes.select("node", F.col("node").alias("colour")), "colour")
    moved, n = state, 1
    while n:
        offer = moved.withColumnRenamed("node", "src").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
        joined = state.join(offer, "node", "left").select("node", F.least("colour", "offer").alias("colour"), (F.col("offer") < F.col("colour")).alias("moved"))
        seen = Observation()
        state = scratch.save(joined.observe(seen, F.count_if("moved").alias("n")), "colour")
        moved, n = state.filter("moved").select("node", "colour"), seen.get["n"]
        state = state.select("node", "colour")
    return state


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group. Spark keeps only ``k`` per task before the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components: ``(node, root)``, the root being the least node.

    Alternating star contraction. Each half-round is one ``min`` per node
    (partially aggregated before the shuffle) and one join; no neighbour list
    is ever collected, so a hub with a third of all links stays cheap. The loop
    ends when every node has one parent and no parent has one itself.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    nodes = both.select(F.col("u").alias("node")).union(both.select("v")).distinct()

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # edges hold u > v. Large star looks at every neighbour and moves the
        # bigger ones, small star looks at the smaller ones and moves them.
        arcs = edges.select("u", "v")
        if large:
            arcs = arcs.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = arcs.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        joined = arcs.join(low, "u")
        if large:
            moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.select("u", F.col("m").alias("v"))
            )
        return moved.filter("u <> v").distinct()

    edges = scratch.save(
        both.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
            edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above"))
        )
        unsettled = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if unsettled.filter("below > 1 OR (below > 0 AND above > 0)").isEmpty():
            break
        edges = scratch.save(star(scratch.save(star(edges, True), "large"), False), "small")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
