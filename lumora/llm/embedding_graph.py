"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors become one node with a multiplicity. Vectors that are null or zero or hold null or non-finite components
   are no nodes and link with nothing.
2. Centroids are fitted on at most SAMPLE nodes, those of the smallest hash (a documented bound); every node is assigned to
   its OVERLAP nearest clusters. A cluster of more than SHARD nodes is dealt by hash to several shards, and its nodes search
   all of them.
3. In each shard a graph is built: each node's nearest neighbours, robust-pruned (a neighbour goes if a kept one is ALPHA times
   nearer to it). Adjacency lists of a node from different shards are united.
4. Each node searches the shards of its clusters: greedy from the medoid, then by expanding everything in range. Links found
   are extended across shards by neighbours in the united lists until nothing new is found.
5. A link is kept if its cosine in double precision reaches the threshold: none below it is returned. Recall is audited
   against brute force over all nodes for at most AUDIT queries, as the mean of their recalls; below TARGET, the index is built
   again with twice the overlap and beam, until every node is searched in all clusters. If even that stays below LEAST, an
   error is raised: no result of less recall is returned.

Lengths of which there are at most SHARD nodes are a cluster each, all in one index; as they are small, an exact comparison of
each follows. Rows that repeat a vec_id are vectors of their own. A null vec_id is a component only if all its vectors have none. Empty
tables give empty results. Vectors of different lengths are compared only with those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import smallest_hashed, staged
from lumora.llm.components import components

THRESHOLD = 0.95
SAMPLE, CLUSTERS, SHARD = 20_000, 2048, 1500
OVERLAP, DEGREE, NEAREST, ALPHA, BEAM = 2, 24, 64, 1.2, 24
AUDIT, TARGET, LEAST = 300, 0.95, 0.9


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, unit vector in double precision as bytes or null)."""
    for batch in batches:
        out = []
        for x in batch.column("embedding"):
            v = x.values
            u = None
            if v is not None and len(v) and not v.null_count:
                a = v.to_numpy(zero_copy_only=False).astype(float)
                top = np.abs(a).max()
                if np.isfinite(top) and top > 0:
                    a = a / top
                    u = (a / np.sqrt(a @ a)).tobytes()
            out.append(u)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "unit"])


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), float).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums**2).sum(1))
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def robust_prune(x: np.ndarray, near: np.ndarray, alpha: float, degree: int) -> list[int]:
    """Of candidates by rising distance from a node (its row is near[0]), those to keep as its neighbours."""
    v = x[near]
    distance = np.sqrt(np.maximum(0, 2 - 2 * v @ v.T))
    alive, kept = np.ones(len(near), bool), []
    alive[0] = False
    for i in range(1, len(near)):
        if alive[i]:
            kept.append(int(near[i]))
            if len(kept) == degree:
                break
            alive &= alpha * distance[i] > distance[0]
    return kept


def _build(nearest: int, alpha: float, degree: int):
    def run(table: pa.Table) -> pa.Table:
        x, names = _matrix(table.column("unit")), table.column("node").to_numpy()
        out: list[list[int]] = []
        for a in range(0, len(x), 512):
            score = x[a : a + 512] @ x.T
            score[np.arange(len(score)), np.arange(a, a + len(score))] = 2  # itself first
            m = min(nearest + 1, len(x))
            top = np.argpartition(-score, m - 1, 1)[:, :m]
            for row, own in zip(score, top, strict=True):
                own = own[np.argsort(-row[own], kind="stable")]
                out.append(robust_prune(x, own, alpha, degree))
        back: list[list[int]] = [[] for _ in out]
        for i, own in enumerate(out):
            for j in own:
                back[j].append(i)
        both = [list(dict.fromkeys([*own, *extra[: 2 * degree]])) for own, extra in zip(out, back, strict=True)]
        lists = pa.array([names[own].tolist() for own in both], pa.list_(pa.int64()))
        return pa.table({"node": table.column("node"), "near": lists})

    return run


def range_search(q: np.ndarray, x: np.ndarray, graph: list[np.ndarray], start: int, threshold: float, beam: int) -> np.ndarray:
    """Rows of x with a cosine of at least threshold: greedy from start with a beam, then expanding all in range."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    rows, scores, open_ = np.array([start]), x[[start]] @ q, np.array([True])
    while True:
        # in the beam or in range, and not expanded
        order = np.argsort(-scores, kind="stable")
        rows, scores, open_ = rows[order], scores[order], open_[order]
        todo = open_ & ((np.arange(len(rows)) < beam) | (scores >= threshold))
        if not todo.any():
            return rows[scores >= threshold]
        pick = np.flatnonzero(todo)
        if scores[pick[0]] < threshold:
            pick = pick[:4]
        new = np.unique(np.concatenate([graph[i] for i in rows[pick]]))
        open_[pick] = False
        new = new[~seen[new]]
        seen[new] = True
        rows, scores, open_ = np.concatenate([rows, new]), np.concatenate([scores, x[new] @ q]), np.concatenate([open_, np.ones(len(new), bool)])


def _search(threshold: float, beam: int):
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        u: list[int] = []
        v: list[int] = []
        if members.num_rows and queries.num_rows:
            x, names = _matrix(members.column("unit")), members.column("node").to_numpy()
            order = np.argsort(names)
            graph = []
            for own in members.column("near").to_pylist():
                own = np.array(own or [], np.int64)
                place = order[np.minimum(np.searchsorted(names, own, sorter=order), len(names) - 1)]
                graph.append(place[names[place] == own])
            medoid = int((x @ x.mean(0)).argmax())
            for node, q in zip(queries.column("node").to_pylist(), _matrix(queries.column("unit")), strict=True):
                hits = names[range_search(q, x, graph, medoid, threshold, beam)]
                hits = hits[hits != node].tolist()
                u += [node] * len(hits)
                v += hits
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _assign(centroids: np.ndarray, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("unit"))
            if not len(x):
                continue
            m = min(overlap, len(centroids))
            score = x @ centroids.T
            near = np.argpartition(-score, m - 1, 1)[:, :m]
            row = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row)), pa.array(near.ravel().astype(np.int32)), batch.column("unit").take(pa.array(row))], ["node", "cluster", "unit"])

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v), those whose vectors reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("a")), _matrix(batch.column("b"))
            keep = pa.array((a * b).sum(1) >= threshold)
            yield batch.select(["u", "v"]).filter(keep)

    own = nodes.select("node", "unit")
    both = pairs.join(own.withColumnsRenamed({"node": "u", "unit": "a"}), "u").join(own.withColumnsRenamed({"node": "v", "unit": "b"}), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _compare(threshold: float):
    """All nodes of one length to their links."""

    def run(table: pa.Table) -> pa.Table:
        x, names = _matrix(table.column("unit")), table.column("node").to_numpy()
        i, j = np.nonzero(x @ x.T >= threshold)
        ok = names[i] < names[j]
        return pa.table({"u": pa.array(names[i][ok], pa.int64()), "v": pa.array(names[j][ok], pa.int64())})

    return run


def links_of(nodes: DataFrame, threshold: float, overlap: int, beam: int = BEAM, total: int | None = None) -> DataFrame:
    """nodes(node, unit), all of one length, to links (u, v) with u < v."""
    total = nodes.count() if total is None else total
    # bounded: SAMPLE vectors
    sample = _matrix(pa.table({"u": [r["unit"] for r in smallest_hashed(nodes, "node", SAMPLE, total).select("unit").collect()]}).column("u")) if total else np.zeros((0, 1))
    if not len(sample):
        return nodes.sparkSession.createDataFrame([], "u long, v long")
    centroids = kmeans(sample, max(1, min(CLUSTERS, -(-total // (SHARD // 2)), len(sample))))
    placed = staged(nodes.mapInArrow(_assign(centroids, overlap), "node long, cluster int, unit binary"), "placed")
    return linked(placed, nodes, threshold, beam)


def linked(placed: DataFrame, nodes: DataFrame, threshold: float, beam: int = BEAM) -> DataFrame:
    """placed(node, cluster, unit), the vectors of a cluster being of one length, to links (u, v) with u < v."""
    sizes = placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))  # CLUSTERS rows at most
    dealt = placed.join(F.broadcast(sizes), "cluster")
    members = dealt.withColumn("shard", F.concat_ws("-", "cluster", F.pmod(F.xxhash64("node"), F.col("parts"))))
    lists = members.groupBy("shard").applyInArrow(_build(NEAREST, ALPHA, DEGREE), "node long, near array<long>")
    united = staged(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    # a cluster's nodes search all of its shards, in blocks of about SHARD queries: shard and block bound what a task holds
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    inside = members.join(united, "node").select("shard", "node", "unit", "near", parts.alias("block"))
    asking = dealt.select("node", "unit", "cluster", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("block"), parts.alias("p"))
    asking = asking.select(F.concat_ws("-", "cluster", "p").alias("shard_"), F.col("block").alias("block_"), F.col("node").alias("node"), F.col("unit").alias("unit"))
    found = inside.groupBy("shard", "block").cogroup(asking.groupBy("shard_", "block_")).applyInArrow(_search(threshold, beam), "u long, v long")
    links = fresh = staged(_ordered(found), "links")
    # neighbours that no shard has together can only be met through the united lists
    together = F.collect_set("cluster")
    clusters = placed.groupBy("node").agg(together.alias("c"))
    edges = united.select("node", F.explode("near").alias("y")).join(clusters, "node").join(clusters.withColumnsRenamed({"node": "y", "c": "d"}), "y")
    edges = staged(edges.where("c <> d").select(F.col("node").alias("x"), "y", "d"), "cross")
    while not fresh.isEmpty():
        both = fresh.select(F.col("u").alias("q"), F.col("v").alias("x")).union(fresh.select(F.col("v"), F.col("u")))
        step = both.join(edges, "x").join(clusters.withColumnsRenamed({"node": "q"}), "q").where(~F.arrays_overlap("c", "d"))
        cand = _ordered(step.select(F.col("q").alias("u"), F.col("y").alias("v"))).join(links, ["u", "v"], "left_anti")
        fresh = staged(_verified(cand, nodes, threshold), "fresh")
        links = links.union(fresh)
    return links


def audit(nodes: DataFrame, links: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Mean over at most `queries` nodes that have links of the share of them that was found, by brute force over all nodes."""
    rows = smallest_hashed(nodes, "node", queries).select("node", "unit").collect()  # bounded
    if not rows:
        return 1.0
    names, q = np.array([r["node"] for r in rows]), np.array([np.frombuffer(r["unit"], float) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch.column("unit")), batch.column("node").to_numpy()
            i, j = np.nonzero(x @ q.T >= threshold) if len(x) else (np.zeros(0, int),) * 2
            ok = own[i] != names[j]
            yield pa.RecordBatch.from_arrays([pa.array(names[j][ok], pa.int64()), pa.array(own[i][ok], pa.int64())], ["query", "other"])

    true = nodes.select("node", "unit").mapInArrow(run, "query long, other long").select("query", F.least("query", "other").alias("u"), F.greatest("query", "other").alias("v"))
    found = true.join(links.select("u", "v").withColumn("hit", F.lit(1)), ["u", "v"], "left").groupBy("query").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return found.agg(F.coalesce(F.avg("recall"), F.lit(1.0)).alias("r")).first()["r"]


def _indexed(nodes: DataFrame, total: int, threshold: float, overlap: int) -> tuple[DataFrame, float]:
    """Links of nodes of one length, and their audited recall."""
    most, beam = min(CLUSTERS, -(-total // (SHARD // 2))), BEAM
    while True:
        links = staged(links_of(nodes, threshold, overlap, beam, total), "found")
        recall = audit(nodes, links, threshold)
        if recall >= TARGET or (overlap >= most and recall >= LEAST):
            return links, recall
        if overlap >= most:
            raise RuntimeError(f"recall {recall:.3f} stays below {LEAST}")
        overlap, beam = 2 * overlap, 2 * beam


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_recall of each row of vectors(vec_id, embedding)."""
    rows = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_unit, "vec_id long, unit binary"), "units")
    nodes = rows.where("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = staged(nodes.select(F.xxhash64("unit").alias("node"), "unit", "copies", "least"), "nodes")
    lengths = nodes.groupBy(F.octet_length("unit").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    large = lengths.where(F.col("n") > SHARD).collect()  # each of them has an index of its own
    few = nodes.withColumn("length", F.octet_length("unit")).where(~F.col("length").isin([r["length"] for r in large])) if large else nodes.withColumn("length", F.octet_length("unit"))
    few = staged(few.select("node", F.col("length").alias("cluster"), "unit"), "placed")
    exact = few.groupBy("cluster").applyInArrow(_compare(threshold), "u long, v long")
    links, recalls = staged(linked(few, nodes, threshold).union(exact).distinct(), "found"), [1.0]
    for r in large:
        part, recall = _indexed(nodes.where(F.octet_length("unit") == r["length"]), r["n"], threshold, overlap)
        recalls.append(recall)
        links = links.union(part)
    both = links.union(links.select(F.col("v"), F.col("u")))
    near = both.join(nodes.select(F.col("node").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("others"))
    known = nodes.join(near.withColumnRenamed("u", "node"), "node", "left").join(components(links), "node", "left")
    known = staged(known.select("node", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = known.join(least, "component").select("node", "n_links", "component_id")
    out = rows.withColumn("node", F.when(F.col("unit").isNotNull(), F.xxhash64("unit"))).drop("unit").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"), F.lit(min(recalls)).alias("audited_recall"))
