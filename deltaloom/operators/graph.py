"""Call graphs and include graphs as edge tables: neighbours, roots, closures, trees, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaloom.plans.session import materialise


def call_edges(functions: DataFrame, name: str = "name", callees: str = "callees", ord_col: str = "ord") -> DataFrame:
    """Edges (caller, callee, ord) of functions with an array of callees: the last definition of a name wins, no self calls."""
    last = functions.groupBy(name).agg(F.max_by(callees, ord_col).alias("c"))
    edges = last.select(F.col(name).alias("caller"), F.posexplode("c").alias("ord", "callee"))
    return edges.where((F.col("callee") != F.col("caller")) & (F.trim("callee") != ""))


def callers_of(edges: DataFrame, callee: str | Column) -> DataFrame:
    return edges.where(F.col("callee") == callee).select("caller").distinct()


def callee_map(edges: DataFrame) -> DataFrame:
    """Callees of each caller in order, the first of repeated ones kept."""
    first = edges.groupBy("caller", "callee").agg(F.min("ord").alias("o"))
    return first.groupBy("caller").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "callee"))), lambda x: x["callee"]).alias("callees"))


def entry_nodes(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.select(node).distinct().join(edges.select(F.col("callee").alias(node)).distinct(), node, "left_anti")


def neighbours(edges: DataFrame, kinds: list[str] | None = None, most: int = 40) -> DataFrame:
    """The first ``most`` neighbours of each source by (kind, target)."""
    kept = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    order = Window.partitionBy("source").orderBy("kind", "target")
    return kept.dropDuplicates(["source", "kind", "target"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def reach(starts: DataFrame, edges: DataFrame, depth: int | None = None, node: str = "node", source: str = "source", target: str = "target") -> DataFrame:
    """Rows (root, node, depth): everything reachable from each start along edges, with its least depth (0: itself).

    Level by level: only newly met pairs go on, and each level is a written table.
    """
    level = materialise(starts.select(F.col(node).alias("root"), F.col(node).alias("node")).distinct().withColumn("depth", F.lit(0)), "reach")
    seen, step = level, edges.select(F.col(source).alias("node"), F.col(target).alias("next_")).distinct()
    at = 0
    while (depth is None or at < depth) and not level.isEmpty():
        at += 1
        met = level.join(step, "node").select("root", F.col("next_").alias("node")).distinct()
        level = materialise(met.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(at)), "reach")
        seen = seen.unionByName(level)
    return seen


def _spread(labels: DataFrame, step: DataFrame, better) -> DataFrame:
    """Labels (node, label) after they have gone along edges (node, next_) as far as they improve; ``better`` is F.max or F.min."""
    moved = labels
    while not moved.isEmpty():
        met = moved.join(step, "node").groupBy(F.col("next_").alias("node")).agg(better("label").alias("new_"))
        best = labels.join(met, "node", "left").withColumn("old_", F.col("label"))
        pick = F.greatest if better is F.max else F.least
        best = materialise(best.select("node", pick("label", "new_").alias("label"), "old_"), "labels")
        moved, labels = best.where("label <> old_").select("node", "label"), best.select("node", "label")
    return labels


#: Times that ends of paths are cut off before what is left is written.
TRIMS = 3


def _inner(nodes: DataFrame, step: DataFrame) -> DataFrame:
    """Nodes with edges in and out among the nodes."""
    kept = step.join(nodes, "node", "left_semi").join(nodes.select(F.col("node").alias("next_")), "next_", "left_semi")
    return kept.select("node").distinct().join(kept.select(F.col("next_").alias("node")).distinct(), "node", "left_semi")


def _among(nodes: DataFrame, step: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, written."""
    return materialise(step.join(nodes, "node", "left_semi").join(nodes.select(F.col("node").alias("next_")), "next_", "left_semi").select("node", "next_"), "edges")


def _contract(step: DataFrame, kept=None) -> tuple[list[DataFrame], DataFrame]:
    """(levels, core): nodes with one edge in or out at most (not node ``kept``) are taken out of edges (node, next_), and edges put past them.

    What the others reach stays the same, and edges do not grow in number. A level holds the edges of the nodes taken out
    in a round: ``from_`` or ``to_`` tells which end was. No two of a level are neighbours: of such the one with fewer edges in, then out,
    goes first, then the least by a hash. The core has two edges in and out at each node; a graph without cycles has none.
    """
    levels: list[DataFrame] = []
    while True:
        ends = step.select(F.explode(F.array(F.struct(F.col("node").alias("node"), F.lit(0).alias("in_"), F.lit(1).alias("out_")), F.struct(F.col("next_").alias("node"), F.lit(1).alias("in_"), F.lit(0).alias("out_")))).alias("e")).select("e.*")
        few = F.when(F.col("in_") == 0, 0).when(F.col("out_") == 0, 1).when(F.col("in_") == 1, 2).when(F.col("out_") == 1, 3)
        place = few.cast("long") * (1 << 60) + F.shiftrightunsigned(F.xxhash64("node", F.lit(len(levels))), 4)
        sought = ends.groupBy("node").agg(F.sum("in_").alias("in_"), F.sum("out_").alias("out_")).select("node", (place if kept is None else F.when(F.col("node") != F.lit(kept), place)).alias("place"))
        placed = materialise(step.join(sought, "node").join(sought.select(F.col("node").alias("next_"), F.col("place").alias("to_place")), "next_").select("node", "next_", F.col("place").alias("from_place"), "to_place"), "placed")
        later = placed.select(F.explode(F.array(F.when(F.col("to_place") <= F.col("from_place"), F.col("node")), F.when(F.col("from_place") <= F.col("to_place"), F.col("next_")))).alias("node")).where("node IS NOT NULL").distinct()
        marked = placed.join(later.withColumn("a", F.lit(True)), "node", "left").join(later.select(F.col("node").alias("next_"), F.lit(True).alias("b")), "next_", "left")
        level = materialise(marked.select("node", "next_", (F.col("from_place").isNotNull() & F.col("a").isNull()).alias("from_"), (F.col("to_place").isNotNull() & F.col("b").isNull()).alias("to_"), (F.col("from_place").isNotNull() | F.col("to_place").isNotNull()).alias("open")), "level")
        if level.where("open").isEmpty():
            return levels, level.select("node", "next_")
        levels.append(level)
        past = level.where("to_").select(F.col("node").alias("first"), F.col("next_").alias("node")).join(level.where("from_").select("node", "next_"), "node").where("first <> next_")
        step = level.where("NOT from_ AND NOT to_").select("node", "next_").union(past.select("first", "next_")).distinct()


def _taken(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges in, edges out) of the nodes taken out in a level, as rows (node, other)."""
    return level.where("to_").select(F.col("next_").alias("node"), F.col("node").alias("other")), level.where("from_").select("node", F.col("next_").alias("other"))


def strong_components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component): nodes that reach each other share a component, named by its largest node; every end of an edge has one.

    Ends of paths go first, then nodes with one edge in or out (``_contract``): rounds grow with the logarithm of a path's length. In a core
    that is left each node gets the largest node that reaches it; what reaches such a node back within its label is that
    node's component, and the others go on. At last, from the level taken out last, a node joins the component that it has an edge from and one to.
    """
    step = materialise(edges.select(F.col(source).alias("node"), F.col(target).alias("next_")).where("node IS NOT NULL AND next_ IS NOT NULL AND node <> next_").distinct(), "edges")
    nodes = materialise(edges.select(F.explode(F.array(source, target)).alias("node")).where("node IS NOT NULL").distinct(), "nodes")
    inner = nodes
    for _ in range(TRIMS):
        inner = _inner(inner, step)
    levels, step = _contract(_among(materialise(inner, "core"), step))
    shared = nodes.select("node", F.col("node").alias("component")).limit(0)
    while not step.isEmpty():
        core = step.select(F.explode(F.array("node", "next_")).alias("node")).distinct()
        labels = _spread(core.select("node", F.col("node").alias("label")), step, F.max)
        same = step.join(labels, "node").join(labels.select(F.col("node").alias("next_"), F.col("label").alias("to_")), "next_").where("label = to_")
        back = materialise(same.select(F.col("next_").alias("node"), F.col("node").alias("next_")), "edges")
        found = level = materialise(labels.where("node = label").select("node", F.col("label").alias("component")), "component")
        while not level.isEmpty():
            level = materialise(level.join(back, "node").select(F.col("next_").alias("node"), "component").distinct().join(found, "node", "left_anti"), "component")
            found = found.unionByName(level)
        shared = shared.unionByName(found)
        more, step = _contract(_among(materialise(core.join(found, "node", "left_anti"), "nodes"), step))
        levels += more
    for level in reversed(levels):
        of = shared.withColumnRenamed("node", "other")
        before, after = (side.join(of, "other", "left").select("node", F.coalesce("component", "other").alias("component")) for side in _taken(level))
        joined = materialise(before.join(after, ["node", "component"]).distinct(), "component")
        if not joined.isEmpty():
            shared = shared.unionByName(joined)
    named = nodes.join(shared, "node", "left").select("node", F.coalesce("component", "node").alias("at"))
    return named.join(named.groupBy("at").agg(F.max("node").alias("component")), "at").select("node", "component")


def _between(edges: DataFrame, parts: DataFrame, source: str, target: str) -> DataFrame:
    """Edges (node, next_) between different components."""
    ends = edges.select(F.col(source).alias("from_"), F.col(target).alias("to_")).join(parts.select(F.col("node").alias("from_"), F.col("component").alias("node")), "from_").join(parts.select(F.col("node").alias("to_"), F.col("component").alias("next_")), "to_")
    return materialise(ends.where("node <> next_").select("node", "next_").distinct(), "between")


def _closure(sizes: DataFrame, step: DataFrame, hub=None) -> tuple[DataFrame, DataFrame]:
    """(pairs, flags) of a graph without cycles, of nodes (node, size) and edges (node, next_).

    pairs (node, reached, up, down, size): what each node reaches, itself included. flags (node, up, down, size): whether it reaches ``hub``, and
    whether the hub reaches it. Pairs of an ``up`` node and a ``down`` one are left out: whatever reaches the hub reaches all
    that the hub reaches, and they are many where both are. Nodes come back by the levels of ``_contract``: each pair is made of pairs
    of the node's neighbours, once for each of these.
    """
    levels, _ = _contract(step, hub)
    at_hub = F.lit(False) if hub is None else F.col("node") == F.lit(hub)
    top = sizes
    if levels:
        gone = levels[0].limit(0).select("node")
        for level in levels:
            gone = gone.union(level.where("from_").select("node")).union(level.where("to_").select("next_"))
        top = sizes.join(gone.distinct(), "node", "left_anti")
    kept = F.expr("NOT (up AND down)")
    flags = materialise(top.select("node", at_hub.alias("up"), at_hub.alias("down"), "size"), "flags")
    pairs = materialise(flags.select("node", F.col("node").alias("reached"), "up", "down", "size").where(kept), "pairs")
    for level in reversed(levels):
        before, after = _taken(level)
        of = flags.withColumnRenamed("node", "other")
        seen = after.join(of, "other").select("node", "up", F.lit(False).alias("down")).union(before.join(of, "other").select("node", F.lit(False), "down"))
        new = materialise(seen.groupBy("node").agg(F.max("up").alias("up"), F.max("down").alias("down")).join(sizes, "node"), "flags")
        ahead = after.join(new.select("node", "up"), "node").join(pairs.select(F.col("node").alias("other"), "reached", "down", "size"), "other")
        out = ahead.select("node", "reached", "up", "down", "size").where(kept).distinct().union(new.select("node", F.col("node").alias("reached"), "up", "down", "size"))
        pairs = pairs.union(materialise(out, "pairs"))
        behind = before.withColumnRenamed("node", "reached").join(new.select(F.col("node").alias("reached"), "down", "size"), "reached").join(pairs.select("node", F.col("reached").alias("other"), "up"), "other")
        pairs = pairs.union(materialise(behind.select("node", "reached", "up", "down", "size").where(kept).distinct(), "pairs"))
        flags = flags.union(new)
    return pairs, flags


def component_closure(edges: DataFrame, source: str = "source", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """((node, component), (component, reached)): what each component reaches, itself included. All pairs are rows: where counts will do, ``reach_sizes`` makes fewer."""
    parts = materialise(strong_components(edges, source, target), "components")
    pairs, _ = _closure(parts.select(F.col("component").alias("node")).distinct().withColumn("size", F.lit(1)), _between(edges, parts, source, target))
    return parts, pairs.select(F.col("node").alias("component"), "reached")


def reach_sizes(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component, n_reached): every node's component, and how many nodes it reaches, itself included.

    Components that others lead to are paired with what they reach, save by way of the largest component: all that it reaches is counted once for
    those that reach it. Others (most, in sparse graphs) take the count of the only component they lead to, or that of their successors' pairs together.
    """
    parts = materialise(strong_components(edges, source, target), "components")
    sizes = materialise(parts.groupBy(F.col("component").alias("node")).agg(F.count("*").alias("size")), "sizes")
    step = _between(edges, parts, source, target)
    inner = sizes.join(step.select(F.col("next_").alias("node")).distinct(), "node", "left_semi")
    largest = inner.orderBy(F.desc("size"), "node").select("node").first()
    pairs, flags = _closure(inner, step.join(inner, "node", "left_semi"), largest and largest["node"])
    by_hub = flags.where("down").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("by_hub"))
    n_reached = F.coalesce("apart", F.lit(0)) + F.when(F.col("up"), F.col("by_hub")).otherwise(0)
    apart = pairs.groupBy("node").agg(F.sum("size").alias("apart"))
    inside = materialise(flags.join(apart, "node", "left").crossJoin(F.broadcast(by_hub)).select("node", n_reached.alias("n_reached"), "up"), "reached")
    first = step.join(inner, "node", "left_anti")
    asked = materialise(first.groupBy("node").agg(F.count("*").alias("n"), F.min("next_").alias("only")).join(sizes, "node"), "asked")
    one = asked.where("n = 1").join(inside.select(F.col("node").alias("only"), "n_reached"), "only").select("node", (F.col("size") + F.col("n_reached")).alias("n_reached"))
    many = first.join(asked.where("n > 1").select("node"), "node", "left_semi").join(inside.select(F.col("node").alias("next_"), "up"), "next_")
    reaching = many.groupBy("node").agg(F.max("up").alias("up"))
    met = many.select("node", "next_").join(reaching, "node").join(pairs.select(F.col("node").alias("next_"), "reached", "down", "size"), "next_").where(F.expr("NOT (up AND down)"))
    apart = met.groupBy("node", "reached").agg(F.max("size").alias("size")).groupBy("node").agg(F.sum("size").alias("apart"))
    several = reaching.join(apart, "node", "left").join(sizes, "node").crossJoin(F.broadcast(by_hub)).select("node", (F.col("size") + n_reached).alias("n_reached"))
    alone = sizes.join(inner, "node", "left_anti").join(asked, "node", "left_anti").select("node", F.col("size").alias("n_reached"))
    counts = inside.select("node", "n_reached").union(one).union(several).union(alone)
    return parts.join(counts.withColumnRenamed("node", "component"), "component").select("node", "component", "n_reached")


def reachable(starts: DataFrame, edges: DataFrame, node: str = "node", source: str = "source", target: str = "target") -> DataFrame:
    """(root, node): everything reachable from each start, itself included; pairs of nodes are made from component sets at the end only."""
    parts, closure = component_closure(edges, source, target)
    roots = starts.select(F.col(node).alias("root")).where("root IS NOT NULL").distinct()
    met = roots.join(parts.select(F.col("node").alias("root"), "component"), "root").join(closure, "component").join(parts.select("node", F.col("component").alias("reached")), "reached")
    alone = roots.join(parts.select(F.col("node").alias("root")), "root", "left_anti").select("root", F.col("root").alias("node"))
    return met.select("root", "node").unionByName(alone)


def impact(changed: DataFrame, edges: DataFrame, depth: int = 2, node: str = "node") -> DataFrame:
    """What depends on changed nodes: reach over reversed edges that are not of kind ``contains``."""
    reverse = edges.where(F.col("kind") != "contains").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return reach(changed, reverse, depth, node)


def call_tree(roots: DataFrame, edges: DataFrame, columns: int = 4, most_depth: int = 3, node: str = "node") -> DataFrame:
    """Call paths from roots as rows level0..: one for each path that ends in a node without further callees or at the depth cap.

    A node already on the path is not entered again; cells beyond the path's end hold ``-``.
    """
    step = edges.select(F.col("caller").alias("last"), F.col("callee").alias("next_")).distinct()
    paths = roots.select(F.array(node).alias("path")).distinct().withColumn("open", F.lit(True))
    for _ in range(most_depth):
        grown = paths.withColumn("last", F.element_at("path", -1)).join(step, "last", "left")
        usable = F.col("open") & F.col("next_").isNotNull() & ~F.array_contains("path", F.col("next_"))
        grown = grown.withColumn("child", F.when(usable, F.col("next_")))
        some = grown.groupBy("path").agg(F.max("open").alias("open"), F.collect_set("child").alias("children"))
        more = some.select(F.explode_outer("children").alias("child"), "path")
        paths = more.select(F.when(F.col("child").isNull(), F.col("path")).otherwise(F.concat("path", F.array("child"))).alias("path"), F.col("child").isNotNull().alias("open"))
    return paths.select(*[F.coalesce(F.get("path", F.lit(k)), F.lit("-")).alias(f"level{k}") for k in range(columns)])


def include_edges(includes: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows (rel_path, header): each include's project header, by whole path or base name; the shortest, then least, wins."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    heads = headers.select(F.col("rel_path").alias("header"), base(F.col("rel_path")).alias("base"))
    asked = includes.select("rel_path", F.col("include").alias("name"), base(F.col("include")).alias("base"))
    best = asked.join(heads, "base").groupBy("rel_path", "name").agg(F.min_by("header", F.struct(F.length("header"), F.col("header"))).alias("header"))
    return best.select("rel_path", "header").distinct()


def overview(nodes: DataFrame, edges: DataFrame, most_nodes: int, node: str = "node", ord_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(the first ``most_nodes`` nodes by order, distinct edges among them)."""
    kept = nodes.groupBy(node).agg(F.min(ord_col).alias(ord_col)).orderBy(ord_col, node).limit(most_nodes)
    ends = kept.select(node)
    inner = edges.dropDuplicates(["source", "target", "kind"]).join(ends.withColumnRenamed(node, "source"), "source", "left_semi").join(ends.withColumnRenamed(node, "target"), "target", "left_semi")
    return kept, inner


def to_dot(edges: DataFrame, name: str = "graph") -> DataFrame:
    """One line of DOT text for each edge, in order, between the opening and closing lines."""
    line = F.concat(F.lit('  "'), "source", F.lit('" -> "'), "target", F.lit('";'))
    body = edges.select("source", "target").distinct().select(F.lit(1).alias("part"), line.alias("line"))
    spark = edges.sparkSession
    ends = spark.createDataFrame([(0, f"digraph {name} {{"), (2, "}")], "part int, line string")
    return ends.unionByName(body).orderBy("part", "line")
