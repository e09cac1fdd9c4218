"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors become one node with a multiplicity. Nodes are dealt to overlapping shards level by level: a shard beyond BLOCK nodes
gets centroids, fitted on a bounded sample of it by an executor, and every node goes to as many of the nearest as it takes
for TOGETHER of sampled vectors to share one with a vector just at the threshold. So the number of shards grows
with the table and their size does not. A shard that splitting does not help (one dense group) is dealt out as hashed blocks
and every pair of blocks is searched. Each block's graph keeps robust-pruned near and far neighbours; the adjacency lists
of all blocks are united per node, and in each pair of blocks every node searches greedily from the medoids, then
expands everything in range until nothing new is in range. Pairs are verified in double precision.

A pair that meets in several shards counts in one of them, the least that its nodes share. No pair leaves a task: a task returns
how many links each of its nodes has, and a spanning forest of them. ``audit_recall`` compares the counts with brute force on a
sample of queries; ``near_duplicates`` runs it and deals to twice as many centroids while the recall is below LEAST_RECALL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import mix, small_batches, write_out
from deltaloom.llm.components import connected_components, least_of_component

THRESHOLD = 0.95
#: Bounds of the sample of a shard on which its centroids are fitted, in vectors and bytes; every vector is indexed.
SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
#: Nodes that a shard should have, most centroids of one split, nearest centroids at least, nodes of a block.
SHARD, CENTROIDS, OVERLAP, BLOCK = 250, 512, 2, 2048
#: Bytes of vectors that one task deals out.
DEAL_BYTES = 4 << 20
#: Share of pairs at the threshold that are to meet in a shard, and vectors of the sample on which it is measured.
TOGETHER, PROBED = 0.99, 2_000
NEAR, FAR, POOL, ALPHA, BEAM, WIDTH = 24, 8, 96, 1.2, 48, 4
#: A query with more than this part of a block in its range is compared with all of the block, which is less work than the walk.
DENSE = 16
#: Queries of the audit, and the recall below which the search is widened.
AUDITED, LEAST_RECALL = 64, 0.95


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one, whatever their scale; rows of zeros stay."""
    if not rows.size:
        return rows
    _, power = np.frexp(np.abs(rows).max(axis=1, keepdims=True))
    rows = np.ldexp(rows, -power)  # exact, and no square can over- or underflow
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means centres of unit vectors."""
    pick = np.random.default_rng(seed)
    centre = sample[pick.permutation(len(sample))[:count]]
    for _ in range(rounds):
        near = np.concatenate([(part @ centre.T).argmax(1) for part in np.array_split(sample, len(sample) // 4096 + 1)])
        sums = np.zeros_like(centre)
        np.add.at(sums, near, sample)
        empty = np.bincount(near, minlength=len(centre)) == 0
        sums[empty] = centre[empty]
        centre = unit(sums)
    return centre


def overlap(centre: np.ndarray, sample: np.ndarray, threshold: float, seed: int = 7) -> int:
    """Nearest centroids that each node goes to, so that TOGETHER of the pairs just at the threshold share one.

    The pairs are vectors of ``sample``, turned by the threshold's angle at random and along differences of the sample. The
    centroids should not be fitted on it: vectors that they were fitted on lie nearer to them than others.
    """
    pick = np.random.default_rng(seed)
    x = sample[pick.permutation(len(sample))[:PROBED]]
    one, other = (sample[pick.integers(0, len(sample), len(x))] for _ in range(2))

    def ranks(rows):
        order = np.argsort(-(rows @ centre.T), axis=1, kind="stable")
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.arange(len(centre))[None, :], axis=1)
        return out

    own, wanted = ranks(x), [OVERLAP]
    for turn in (pick.normal(size=x.shape), one - other):
        turn = unit(turn - np.einsum("ij,ij->i", turn, x)[:, None] * x)
        moved = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * turn
        wanted.append(int(np.quantile(np.maximum(own, ranks(moved)).min(1), TOGETHER, method="higher")) + 1)
    return max(wanted)


def pruned_graph(vectors: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Neighbours of each unit vector: robust pruning of its near pool and of a random far pool, edges both ways."""
    n = len(vectors)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    likeness = vectors @ vectors.T
    gap = np.sqrt(np.maximum(2 - 2 * likeness, 0))
    np.fill_diagonal(likeness, -2)
    pool = min(POOL, n - 1)
    near = np.argpartition(-likeness, pool - 1, axis=1)[:, :pool]
    far = np.random.default_rng(seed).integers(0, n, (n, min(4 * FAR, n)))
    edges = []
    for candidates, keep in ((near, NEAR), (far, FAR)):
        own = np.take_along_axis(gap, candidates, axis=1)
        order = np.argsort(own, axis=1, kind="stable")
        candidates, own = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(own, order, axis=1)
        alive = candidates != np.arange(n)[:, None]
        for _ in range(keep):
            left = np.flatnonzero(alive.any(1))
            if not len(left):
                break
            first = alive[left].argmax(1)
            chosen = candidates[left, first]
            edges.append(np.stack((left, chosen), axis=1))
            alive[left] &= ALPHA * gap[chosen[:, None], candidates[left]] > own[left]
            alive[left, first] = False
    pairs = np.concatenate(edges)
    pairs = np.unique(np.concatenate((pairs, pairs[:, ::-1])), axis=0)
    return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n)))


def medoids(vectors: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean and others, each farthest from those before it."""
    start = [int((vectors @ vectors.mean(0)).argmax())]
    best = vectors @ vectors[start[0]]
    while len(start) < max(1, len(vectors) // 48):
        start.append(int(best.argmin()))
        best = np.maximum(best, vectors @ vectors[start[-1]])
    return np.array(start)


def range_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) numbers of the pairs in range that the walk meets; ``links``: neighbours, -1 for none.

    A query in a dense group ends its walk early, for it is compared with every node.
    """
    n, found = len(vectors), ([], [])
    start = medoids(vectors)
    for first in range(0, len(queries), 256):
        q = queries[first : first + 256]
        score = np.full((len(q), n), -3.0, dtype=np.float32)
        score[:, start] = q @ vectors[start].T
        todo = np.full((len(q), n), -3.0, dtype=np.float32)  # scores of met nodes that were not expanded
        todo[:, start] = score[:, start]
        live, near_by = np.arange(len(q)), (score >= radius).sum(1)
        while len(live):
            width, beam = min(WIDTH, n), min(BEAM, n)
            best = np.argpartition(-todo[live], width - 1, axis=1)[:, :width]
            value = np.take_along_axis(todo[live], best, axis=1)
            bar = np.minimum(-np.partition(-score[live], beam - 1, axis=1)[:, beam - 1], radius)
            row, column = np.nonzero(value >= np.maximum(bar, -2)[:, None])
            if not len(row):
                break
            who, node = live[row], best[row, column]
            todo[who, node] = -3.0
            near = links[node]
            pair = np.unique((who[:, None] * n + near)[near >= 0])
            a, b = pair // n, pair % n
            new = score[a, b] < -2
            a, b = a[new], b[new]
            score[a, b] = todo[a, b] = likeness = np.einsum("ij,ij->i", q[a], vectors[b])
            near_by += np.bincount(a[likeness >= radius], minlength=len(q))
            live = np.unique(who)
            dense = live[near_by[live] * DENSE > n]
            score[dense] = q[dense] @ vectors.T
            live = live[near_by[live] * DENSE <= n]
        row, column = np.nonzero(score >= radius)
        found[0].append(row + first), found[1].append(column)
    return np.concatenate(found[0]) if found[0] else np.zeros(0, np.int64), np.concatenate(found[1]) if found[1] else np.zeros(0, np.int64)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _valid(column: str) -> str:
    """SQL: a vector with finite components only, some of them not zero."""
    return f"{column} is not null and size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({column}, x -> x <> 0)"


def representatives(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (rep, copies, vector): one for each distinct usable vector; rep is its smallest id."""
    usable = vectors.where(F.col(id_col).isNotNull()).where(_valid(f"`{vector_col}`"))
    return usable.groupBy(F.col(vector_col).alias("vector")).agg(F.min(F.col(id_col).cast("long")).alias("rep"), F.count("*").alias("copies"))


def _fit(wide: int, sizes: tuple[int, int], threshold: float, row: tuple, sample: np.ndarray):
    """(shard, centres, overlap, tasks, useful) of one shard by a sample of its vectors, ``wide`` times the overlap it takes."""
    shard, count, tasks = row
    sample = unit(sample)
    apart = min(PROBED, len(sample) // 5)
    fitted = sample[apart:]
    centre = centroids(fitted, max(1, min(sizes[1], len(fitted) // 2, count // sizes[0])))
    near = min(len(centre), wide * overlap(centre, sample[:apart] if apart else sample, threshold))
    held = np.bincount(np.argsort(-(fitted @ centre.T), axis=1, kind="stable")[:, :near].ravel(), minlength=len(centre)) / len(fitted)
    return shard, centre.astype(np.float64).tobytes(), near, tasks, bool((held**2).sum() <= 0.5)  # half of the comparisons at most


def deal_shards(nodes: DataFrame, threshold: float = THRESHOLD, wide: int = 1) -> DataFrame:
    """Rows (shard, rep, copies, vector, blocks): every node in each of its shards, those of a length apart from others."""
    kind = nodes.schema["vector"].dataType.simpleString()
    sizes, block, most, deal = (SHARD, CENTROIDS), BLOCK, SAMPLE, DEAL_BYTES
    dealt, done, level = nodes.select(F.size("vector").cast("string").alias("shard"), "rep", "copies", "vector"), None, 0
    while True:
        dealt, _ = write_out(dealt, f"shards-{level}")
        counts, _ = write_out(dealt.groupBy("shard").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")), f"shard-counts-{level}")
        large = counts.where(F.col("n") > block)
        room = F.least(F.lit(most), F.floor(F.lit(SAMPLE_BYTES / 8) / F.col("size")))
        large = large.select("shard", "n", F.ceil(F.col("n") * F.col("size") * 8 / deal).cast("long").alias("tasks"), (room / F.col("n")).alias("part"))

        def fit(table: pa.Table) -> pa.Table:
            row = table.column("shard")[0].as_py(), table.column("n")[0].as_py(), table.column("tasks")[0].as_py()
            order = np.argsort(mix(table.column("rep").to_numpy().view(np.uint64)), kind="stable")
            found = _fit(wide, sizes, threshold, row, _matrix(table.column("vector").combine_chunks().take(pa.array(order))))
            return pa.table({name: [x] for name, x in zip(("shard", "centres", "near", "tasks", "useful"), found)})

        drawn = dealt.join(large, "shard").where(F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) < F.col("part") * (1 << 30))
        plans = drawn.select("shard", "n", "tasks", "rep", "vector").groupBy("shard").applyInArrow(fit, "shard string, centres binary, near bigint, tasks bigint, useful boolean")
        plans, _ = write_out(plans.where("useful").drop("useful"), f"shard-plans-{level}")
        split = plans.select("shard", "tasks")
        rest = dealt.join(split, "shard", "left_anti").join(counts.select("shard", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "shard")
        done = rest if done is None else done.unionByName(rest)
        if plans.isEmpty():
            return done

        def assign(rows: pa.Table, plan: pa.Table) -> pa.Table:
            out, names = [], ["shard", "rep", "copies", "vector"]
            if rows.num_rows and plan.num_rows:
                vectors, shard, count = unit(_matrix(rows.column("vector"))), plan.column("shard")[0].as_py(), plan.column("near")[0].as_py()
                centre = np.frombuffer(plan.column("centres")[0].as_py(), dtype=np.float64).reshape(-1, vectors.shape[1])
                nearest = np.argsort(-(vectors @ centre.T), axis=1, kind="stable")[:, :count]
                for k in range(count):
                    out.append(pa.table([pa.array([f"{shard}.{c}" for c in nearest[:, k]]), *(rows.column(c) for c in names[1:])], names=names))
            return pa.concat_tables(out) if out else rows.select(names).slice(0, 0)

        asked = dealt.join(split, "shard").withColumn("task", F.expr(f"pmod(xxhash64(rep, {level}), tasks)")).drop("tasks")
        told = plans.withColumn("task", F.explode(F.expr("sequence(0, tasks - 1)"))).drop("tasks")
        dealt = asked.groupBy("shard", "task").cogroup(told.groupBy("shard", "task")).applyInArrow(assign, f"shard string, rep long, copies long, vector {kind}")
        level += 1


def _neighbours(table: pa.Table, reps: np.ndarray) -> np.ndarray:
    """Numbers of the neighbours of each row that are rows themselves, -1 for none."""
    order = np.argsort(reps)
    near = table.column("near").combine_chunks()
    flat, starts = near.flatten().to_numpy(), near.offsets.to_numpy()
    at = np.minimum(np.searchsorted(reps[order], flat), len(reps) - 1)
    inside = reps[order][at] == flat
    owner = np.repeat(np.arange(len(reps)), np.diff(starts))[inside]
    flat = order[at[inside]]
    degree = np.bincount(owner, minlength=len(reps))
    links = np.full((len(reps), max(1, int(degree.max()) if len(degree) else 1)), -1, dtype=np.int64)
    links[owner, np.arange(len(owner)) - np.repeat(np.cumsum(degree) - degree, degree)] = flat
    return links


def _lesser_homes(table: pa.Table) -> np.ndarray:
    """Bits for the shards before this one that each row is in as well; two rows with a common bit count elsewhere."""
    homes, here = table.column("homes").combine_chunks(), table.column("home")[0].as_py()
    flat, owner = homes.flatten().to_numpy(), np.repeat(np.arange(len(homes)), np.diff(homes.offsets.to_numpy()))
    less = flat < here
    names, number = np.unique(flat[less], return_inverse=True)
    bits = np.zeros((len(homes), max(1, len(names))), dtype=bool)
    bits[owner[less], number] = True
    return np.packbits(bits, axis=1)


def near_links(nodes: DataFrame, threshold: float = THRESHOLD, wide: int = 1) -> DataFrame:
    """Rows (rep, other, n) of nodes (rep, copies, vector): ``n`` vectors, copies counted, whose cosine with it is ``threshold`` or more.

    A node has a row for each task that found some; their n add up. ``other`` is a node of the same component, and
    all rows together hold a spanning forest. Vectors of different lengths do not link.
    """
    dealt, _ = write_out(deal_shards(nodes, threshold, wide).withColumn("block", F.expr("cast(pmod(xxhash64(rep, 7), blocks) as int)")).withColumn("home", F.xxhash64("shard")), "shards")

    def build(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_numpy()
        near = pruned_graph(unit(_matrix(table.column("vector"))).astype(np.float32))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in near])))
        flat = reps[np.concatenate(near)] if len(near) else reps
        return pa.table({"rep": pa.array(reps), "home": table.column("home"), "near": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))})

    lists = dealt.select("shard", "block", "home", "rep", "vector").groupBy("shard", "block").applyInArrow(build, "rep long, home long, near array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.sort_array(F.collect_set("home")).alias("homes"))
    met = dealt.join(united, "rep").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("home", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "copies", "vector", "near", "homes")

    def search(table: pa.Table) -> pa.Table:
        reps, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
        exact = unit(_matrix(table.column("vector")))
        single = exact.astype(np.float32)
        q, v = range_search(single, _neighbours(table, reps), single, threshold - 1e-4)
        both = np.unique(np.concatenate((q * len(reps) + v, v * len(reps) + q)))  # a pair that one side met counts for both
        q, v = both // len(reps), both % len(reps)
        keep = q != v
        if table.column("x")[0].as_py() != table.column("y")[0].as_py():
            keep &= block[q] != block[v]  # pairs within a block have a task of their own
        q, v = q[keep], v[keep]
        good = np.einsum("ij,ij->i", exact[q], exact[v]) >= threshold
        q, v = q[good], v[good]
        less = _lesser_homes(table)
        own = ~(less[q] & less[v]).any(axis=1)
        q, v = q[own], v[own]
        count = np.bincount(q, weights=copies[v], minlength=len(reps)).astype(np.int64)
        label = np.arange(len(reps))
        i, j = q, v
        while len(i):
            up = np.arange(len(reps))
            np.minimum.at(up, i, j)
            while (up[up] != up).any():
                up = up[up]
            label, i, j = up[label], up[i], up[j]
            i, j = i[i != j], j[i != j]
        some = np.flatnonzero(count)
        return pa.table({"rep": pa.array(reps[some]), "other": pa.array(reps[label[some]]), "n": pa.array(count[some])})

    return met.groupBy("home", "x", "y").applyInArrow(search, "rep long, other long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, audited: int = AUDITED) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept) for every vector with an id.

    ``n_links`` counts other vectors linked directly, copies included; ``component_id`` is the smallest id reachable,
    the own one included; ``kept`` marks it. With ``audited`` queries the recall is measured by brute force, and the search widened
    while it is below LEAST_RECALL.

    * Nulls: a row with a null id is left out, as nothing could name it. Vectors that are null, empty or zero, or hold null or
      non-finite components, link with nothing. Vectors of any finite scale count.
    * Very long vectors count whole. Vectors of different lengths do not link.
    * Ties: a cosine of exactly the threshold is a link. Of equal vectors the smallest id stands for all.
    * Repeated rows: rows that repeat an id stay, as vectors of their own. An empty table gives an empty result.
    * Other columns are not carried, so their names cannot clash.
    """
    nodes, _ = write_out(representatives(vectors, id_col, vector_col).withColumn("node", F.monotonically_increasing_id()), "vectors")
    wide = 1
    while True:
        result, _ = write_out(_named(vectors, nodes, id_col, vector_col, threshold, wide), "vector-result")
        if not audited or wide >= 16 or audit_recall(vectors, result, audited, id_col, vector_col, threshold) >= LEAST_RECALL:
            return result
        wide *= 2


def _named(vectors: DataFrame, nodes: DataFrame, id_col: str, vector_col: str, threshold: float, wide: int) -> DataFrame:
    links, _ = write_out(near_links(nodes.select(F.col("node").alias("rep"), "copies", "vector"), threshold, wide), "vector-links")
    near = links.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("n"))
    joined = connected_components(links.where("rep <> other").select("rep", "other"), "vector-components")
    named = least_of_component(nodes, joined, "rep", "component_id").join(near, "node", "left").select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id_"), F.expr(f"if({_valid(f'`{vector_col}`')}, `{vector_col}`, null)").alias("vector"))
    linked = rows.where("vector is not null").join(named, "vector").select("id_", "n_links", "component_id")
    alone = rows.where("vector is null").select("id_", F.lit(0).cast("long").alias("n_links"), F.col("id_").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id_").alias(id_col), "n_links", "component_id", (F.col("id_") == F.col("component_id")).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, queries: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> float:
    """Share of the links of at most ``queries`` vectors (smallest hash of the id) that ``result`` counts, by brute force."""
    usable = vectors.where(F.col(id_col).isNotNull()).where(_valid(f"`{vector_col}`")).select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = usable.orderBy(F.xxhash64("i")).limit(queries).collect()
    if not asked:
        return 1.0
    ids, wanted = [row.i for row in asked], [np.array(row.v) for row in asked]

    def compare(batches):
        for batch in batches:
            counts = np.zeros(len(ids), dtype=np.int64)
            length = np.diff(batch.column(1).offsets.to_numpy())
            for size in np.unique(length):
                rows = unit(_matrix(batch.filter(pa.array(length == size)).column(1)))
                for k, q in enumerate(wanted):
                    if len(q) == size:
                        counts[k] += int((rows @ unit(q[None])[0] >= threshold).sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], names=[id_col, "n"])

    truth = usable.mapInArrow(compare, f"`{id_col}` long, n long").groupBy(id_col).agg((F.sum("n") - 1).alias("n"))
    row = truth.join(result.select(id_col, "n_links"), id_col).agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return row[1] / row[0] if row[0] else 1.0


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    small_batches(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
