"""Graph operators over ``edges(src, dst)``: degrees, closure, cycles, layers, neighbourhoods, paths.

Edges of any orderable type; a dependency points from ``src`` to what it needs, ``dst``. Cycles, layers and the
critical path are made in one pass on the driver while there are at most ``LOCAL_EDGES`` different edges,
which is checked first; a graph of projects is of that size. Larger graphs go in rounds of joins, of which the
driver keeps a row count only; each round is written (``durable``), so no plan grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylib.session import durable

from .components import connected_components  # noqa: F401

LOCAL_EDGES = 100_000


def _few(edges: DataFrame) -> list[tuple] | None:
    """The different edges, if there are at most ``LOCAL_EDGES``."""
    rows = edges.select("src", "dst").distinct().limit(LOCAL_EDGES + 1).collect()
    return [(r[0], r[1]) for r in rows] if len(rows) <= LOCAL_EDGES else None


def _table(like: DataFrame, rows: list[tuple], *columns: str, **more: str) -> DataFrame:
    kind = like.schema["src"].dataType.simpleString()
    schema = ", ".join([*(f"{c} {kind}" for c in columns), *(f"{c} {t}" for c, t in more.items())])
    return like.sparkSession.createDataFrame(rows, schema)


def _parts(edges: list[tuple]) -> dict:
    """The least node of each node's strong component, by an iterative depth-first search (Tarjan's)."""
    out: dict[object, list] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order, low, part, stack = {}, {}, {}, []
    for root in out:
        if root in order:
            continue
        work = [(root, iter(out[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in order:
                    order[to] = low[to] = len(order)
                    stack.append(to)
                    work.append((to, iter(out[to])))
                    break
                if to not in part:
                    low[node] = min(low[node], order[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = [stack.pop()]
                    while members[-1] != node:
                        members.append(stack.pop())
                    least = min(members)
                    part.update(dict.fromkeys(members, least))
    return part


def _levels(edges: list[tuple], part: dict) -> dict:
    """The longest path from each component down, by taking away components whose needs are all done."""
    needs: dict[object, set] = {p: set() for p in part.values()}
    users: dict[object, list] = {p: [] for p in needs}
    for a, b in edges:
        a, b = part[a], part[b]
        if a != b and b not in needs[a]:
            needs[a].add(b)
            users[b].append(a)
    left = {p: len(n) for p, n in needs.items()}
    level = {p: 0 for p, n in left.items() if not n}
    todo = list(level)
    for p in todo:
        for u in users[p]:
            level[u] = max(level.get(u, 0), level[p] + 1)
            left[u] -= 1
            if not left[u]:
                todo.append(u)
    return level


def link(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """``src, dst, resolved`` of references ``src, target`` against ``nodes(node)``; repeats kept."""
    known = nodes.select(F.col("node").alias("dst"))
    return refs.join(known, refs["target"] == known["dst"], "left").select(
        "src", F.col("target").alias("dst"), known["dst"].isNotNull().alias("resolved")
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, fan_in, fan_out``: numbers of edges, repeats counted, 0 for nodes without."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counts = ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return nodes.select("node").join(counts, "node", "left").select(
        "node", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out")]
    )


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches; a loop touches its node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return nodes.select("node").join(ends, "node", "left_anti")


def edge_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``src, dst`` for each node and what it reaches by one edge or more.

    Path doubling: a round joins all paths found with all, so rounds grow with the logarithm of the
    longest path. The result may be quadratic; ``cycles`` and ``layers`` don't build it.
    """
    paths = durable(edges.select("src", "dst").distinct(), "closure")
    n = paths.count()
    for _ in range(max_rounds):
        longer = paths.toDF("src", "mid").join(paths.toDF("mid", "dst"), "mid").select("src", "dst")
        paths = durable(paths.union(longer).distinct(), "closure")
        if (m := paths.count()) == n:
            return paths
        n = m
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def dependency_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, deps, dependents``: sorted sets, of edges to known nodes only."""
    known = induced(edges.select("src", "dst").distinct(), nodes)
    down = known.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("deps"))
    up = known.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list("src")).alias("dependents"))
    empty = F.array().cast(edges.select(F.array("dst")).schema[0].dataType)
    both = nodes.select("node").distinct().join(down, "node", "left").join(up, "node", "left")
    return both.select("node", F.coalesce("deps", empty).alias("deps"), F.coalesce("dependents", empty).alias("dependents"))


def dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, rebuild``: each node with itself and all that reach it, what to build again when it changes."""
    up = closure(edges).select(F.col("dst").alias("node"), F.col("src").alias("rebuild"))
    return nodes.select("node", F.col("node").alias("rebuild")).union(up).distinct()


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that can lie on a cycle: those of nodes without an edge in, or without one out, go in turn."""
    e = durable(edges.select("src", "dst").distinct(), "trim")
    n = e.count()
    while n:
        e = durable(
            e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            .join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            .select("src", "dst"),
            "trim",
        )
        if (m := e.count()) == n:
            break
        n = m
    return e


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``node, component``: the nodes on cycles, loops included, and the least node of their strong component.

    What can't be on a cycle is trimmed first. Then, on what is left, the least node that reaches a node is
    passed along the edges until nothing changes; the nodes that reach the one they were given backwards,
    with equal labels, are one component. They are taken out and the rest goes again. All steps
    are joins and minima that are summed before the shuffle, without the closure.
    """
    if (few := _few(edges)) is not None:
        part, loops = _parts(few), {a for a, b in few if a == b}
        size: dict = {}
        for p in part.values():
            size[p] = size.get(p, 0) + 1
        return _table(edges, [(n, p) for n, p in part.items() if size[p] > 1 or n in loops], "node", "component")
    found = None
    e = trimmed(edges)
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        label = _spread(nodes.withColumn("label", F.col("node")), e)
        inner = durable(
            e.join(label.select(F.col("node").alias("src"), F.col("label").alias("a")), "src")
            .join(label.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
            .filter("a = b").select("src", "dst", F.col("a").alias("label")),
            "scc-inner",
        )
        # from each label backwards, inside its own label
        reach = durable(label.filter("node = label"), "scc-reach")
        new = reach
        while not new.isEmpty():
            step = inner.join(new.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
            new = durable(step.join(reach, ["node", "label"], "left_anti"), "scc-new")
            reach = durable(reach.union(new), "scc-reach")
        part = reach.select("node", F.col("label").alias("component"))
        found = part if found is None else found.union(part)
        e = trimmed(inner.select("src", "dst").join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if found is None:
        return _table(edges, [], "node", "component")
    # a component of one node without a loop is no cycle
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    size = found.groupBy("component").agg(F.count("*").alias("n"))
    return found.join(size, "component").join(loops, "node", "left").filter((F.col("n") > 1) | F.col("loop")).select("node", "component")


def _spread(label: DataFrame, e: DataFrame) -> DataFrame:
    """Least label that reaches each node, ``label`` of the node itself included."""
    label = durable(label, "scc-label")
    while True:
        came = e.join(label.select(F.col("node").alias("src"), "label"), "src").groupBy("dst").agg(F.min("label").alias("came"))
        joined = label.join(came.select(F.col("dst").alias("node"), "came"), "node", "left")
        now = durable(joined.select("node", F.least("label", "came").alias("label"), (F.col("came") < F.col("label")).alias("moved")), "scc-label")
        if now.filter("moved").isEmpty():
            return now.select("node", "label")
        label = now.select("node", "label")


def cycles(edges: DataFrame) -> DataFrame:
    """``component, size, members`` (sorted, of each cycle)."""
    return strong_components(edges).groupBy("component").agg(
        F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")
    )


def layers(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``node, layer``: the longest path to a node without dependencies; a cycle's nodes are one node.

    Peeling: a component whose dependencies all have layers gets one more than the highest, so a
    round is one join over the edges that are still open, and there are as many as layers.
    """
    if (few := _few(edges)) is not None:
        part = _parts(few)
        level = _levels(few, part)
        done = _table(edges, [(n, level[p]) for n, p in part.items() if level[p]], "node", layer="long")
        return nodes.select("node").distinct().join(done, "node", "left").select("node", F.coalesce("layer", F.lit(0)).cast("long").alias("layer"))
    group = strong_components(edges)
    of = durable(
        nodes.select("node").distinct().join(group, "node", "left").select("node", F.coalesce("component", "node").alias("part")), "layer-parts"
    )
    between = (
        edges.select("src", "dst")
        .join(of.select(F.col("node").alias("src"), F.col("part").alias("a")), "src")
        .join(of.select(F.col("node").alias("dst"), F.col("part").alias("b")), "dst")
        .filter("a <> b").select("a", "b").distinct()
    )
    open_ = durable(between, "layer-edges")
    parts = of.select("part").distinct()
    done = durable(parts.join(open_.select(F.col("a").alias("part")), "part", "left_anti").withColumn("layer", F.lit(0).cast("long")), "layers")
    fresh = done
    for k in range(1, max_rounds + 1):
        if open_.isEmpty():
            return of.join(done, "part").select("node", "layer")
        rest = open_.join(fresh.select(F.col("part").alias("b")), "b", "left_anti").select("a", "b")
        freed = open_.select(F.col("a").alias("part")).distinct().join(rest.select(F.col("a").alias("part")), "part", "left_anti")
        fresh = durable(freed.withColumn("layer", F.lit(k).cast("long")), "layers-new")
        open_ = durable(rest, "layer-edges")
        done = durable(done.union(fresh), "layers")
    raise RuntimeError(f"more than {max_rounds} layers")


def waves(layered: DataFrame) -> DataFrame:
    """``wave, size, members`` (sorted) of ``node, layer``: what can be built side by side."""
    return layered.groupBy(F.col("layer").alias("wave")).agg(
        F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")
    )


def critical_path(layered: DataFrame, edges: DataFrame) -> DataFrame:
    """``step, node``, from step 0 at layer 0: a longest chain, walked down from the first node at the top.

    From each node the least dependency one layer below is next, so the walk follows a function of the
    nodes; it ends early where a cycle leaves no such dependency.
    """
    at = layered.select("node", "layer")
    tight = (
        edges.select("src", "dst").distinct()
        .join(at.select(F.col("node").alias("src"), F.col("layer").alias("up")), "src")
        .join(at.select(F.col("node").alias("dst"), F.col("layer").alias("down")), "dst")
        .filter("down = up - 1").groupBy("src").agg(F.min("dst").alias("dst"))
    )
    top = at.agg(F.max(F.struct("layer")).alias("t")).select(F.col("t.layer").alias("layer"))
    now = durable(at.join(top, "layer").agg(F.min("node").alias("node")).filter("node is not null").withColumn("back", F.lit(0)), "path")
    steps = tight.limit(LOCAL_EDGES + 1).collect()
    if len(steps) <= LOCAL_EDGES:
        follow, walk = {r["src"]: r["dst"] for r in steps}, [r["node"] for r in now.collect()]
        while walk and walk[-1] in follow:
            walk.append(follow[walk[-1]])
        return _table(edges, [(n, len(walk) - 1 - k) for k, n in enumerate(walk)], "node", step="long").select("step", "node")
    tight = durable(tight, "tight")
    path, k = now, 0
    while True:
        k += 1
        now = durable(now.join(tight, now["node"] == tight["src"]).select(F.col("dst").alias("node"), F.lit(k).alias("back")), "path")
        if now.isEmpty():
            break
        path = path.union(now)
    return path.select((F.max("back").over(Window.partitionBy()) - F.col("back")).cast("long").alias("step"), "node")


def neighbourhood(edges: DataFrame, focus: DataFrame, up: int = 1, down: int = 1) -> DataFrame:
    """``node`` of what lies ``down`` hops along the edges from ``focus(node)``, then ``up`` hops against them.

    Nodes that the first walk found are not walked on from in the second, so in a graph with cycles
    the order matters. The rounds are unrolled into one plan.
    """
    e = edges.select("src", "dst").distinct()
    start = focus.select("node").distinct()
    kept = start
    for hops, a, b in ((down, "src", "dst"), (up, "dst", "src")):
        front = start
        for _ in range(hops):
            front = e.join(front.select(F.col("node").alias(a)), a).select(F.col(b).alias("node")).distinct().join(kept, "node", "left_anti")
            kept = kept.union(front)
    return kept


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between some nodes, repeats kept."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("node").alias("dst")), "dst", "left_semi"
    )


def composition_roots(degree: DataFrame, test_like: Column) -> DataFrame:
    """Nodes that nothing uses, that use three or more, and whose names aren't those of tests."""
    return degree.filter((F.col("fan_in") == 0) & (F.col("fan_out") >= 3) & ~test_like)
