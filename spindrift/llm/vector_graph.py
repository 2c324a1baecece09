"""Near-duplicate vectors by range search on a robust-pruned flat graph."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, stored
from .components import connected_components
from .vectors import matrix, usable

log = logging.getLogger(__name__)

#: Vectors for each cluster centre, and the most centres there are (with their bytes, what is broadcast).
CLUSTER, CENTRES = 400, 32_768
#: Clusters that a vector belongs to.
OVERLAP = 3
#: Largest half of a shard; larger clusters are cut into blocks, and pairs of blocks are shards.
BLOCK = 1000
#: Candidates for an edge, edges that stay, and the slack of the pruning rule.
CANDIDATES, DEGREE, ALPHA = 32, 16, 1.2
#: Beam of the greedy search when the graph is built and when it is asked; similarity below the
#: threshold to which a range is expanded.
BUILD_BEAM, BEAM, SLACK = 24, 8, 0.06
#: Vectors audited against all others, and the recall under which a label is compared exactly.
AUDITED, LEAST_RECALL = 512, 0.98


class Graph:
    """A flat graph over unit vectors: up to ``DEGREE`` edges for each, or lists of any length.

    ``compared`` counts the similarities that were computed.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.compared = x, 0
        self.edges, self.lists = np.full((len(x), DEGREE), -1), None
        self.medoid = int((x @ x.mean(axis=0)).argmax()) if len(x) else 0

    def join(self, i: np.ndarray, j: np.ndarray) -> Graph:
        """Use these edges from now on, both ways: in a group of copies, all may point to a few that point to none."""
        code = np.unique(np.r_[i, j] * len(self.x) + np.r_[j, i])
        owner = code // max(len(self.x), 1)
        self.lists = np.searchsorted(owner, np.arange(len(self.x) + 1)), code % max(len(self.x), 1)
        return self

    def neighbours(self, owner: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.lists is None:
            return np.repeat(owner, DEGREE), self.edges[node].ravel()
        start, to = self.lists
        n = start[node + 1] - start[node]
        first = np.cumsum(n) - n
        return np.repeat(owner, n), to[np.arange(n.sum()) - np.repeat(first - start[node], n)]

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.compared += len(i)
        return np.einsum("ij,ij->i", self.x[i], self.x[j])

    def search(self, queries: np.ndarray, starts: np.ndarray, beam: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What some vectors visit from their starts, as ``query position, vector, similarity``.

        Greedy search expands the best vector of the beam until all of the beam are expanded. Then
        all visited vectors of similarity ``least`` or more are expanded, until no new one turns up.
        """
        n, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((n, len(self.x)), bool)
        owner, node = np.repeat(rows, starts.shape[1]), starts.ravel()
        visited: list = []

        def visit(owner: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            fresh = (node >= 0) & ~seen[owner, node]
            code = np.unique(owner[fresh] * len(self.x) + node[fresh])
            owner, node = code // len(self.x), code % len(self.x)
            seen[owner, node] = True
            visited.append((owner, node, self.similar(queries[owner], node)))
            return visited[-1]

        # The beam of each query: vectors, similarities, and whether they are still to be expanded.
        ids, sims, todo = np.full((n, beam), -1), np.full((n, beam), -3.0), np.zeros((n, beam), bool)
        while True:
            owner, node, s = visit(owner, node)
            first = np.searchsorted(owner, rows)
            place = np.arange(len(owner)) - first[owner] if len(owner) else owner
            width = int(place.max(initial=-1)) + 1
            more_ids, more_sims = np.full((n, width), -1), np.full((n, width), -3.0)
            more_ids[owner, place], more_sims[owner, place] = node, s
            all_ids, all_sims = np.hstack([ids, more_ids]), np.hstack([sims, more_sims])
            all_todo = np.hstack([todo, more_ids >= 0])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids, sims, todo = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_todo))
            next_ = np.where(todo, sims, -4).argmax(axis=1)
            go = np.flatnonzero(todo[rows, next_])
            if not len(go):
                break
            todo[go, next_[go]] = False
            owner, node = self.neighbours(go, ids[go, next_[go]])
        if least is not None:
            owner, node, s = (np.concatenate(a) for a in zip(*visited, strict=True))
            while len(owner):
                near = s >= least
                owner, node, s = visit(*self.neighbours(owner[near], node[near]))
        return tuple(np.concatenate(a) for a in zip(*visited, strict=True))

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, sims: np.ndarray) -> None:
        """Set the edges of some vectors: of their candidates (-1: none), the nearest that no chosen edge covers.

        A candidate goes when it is nearer to a chosen neighbour, by the factor ``ALPHA``, than to the vector.
        """
        order = np.argsort(-np.where(candidates >= 0, sims, -3), axis=1, kind="stable")[:, :CANDIDATES]
        near, far = np.take_along_axis(candidates, order, 1), 1 - np.take_along_axis(sims, order, 1)
        alive, rows = near >= 0, np.arange(len(nodes))
        alive[:, 1:] &= near[:, 1:] != near[:, :-1]
        out = np.full((len(nodes), DEGREE), -1)
        for r in range(DEGREE):
            pick = alive.argmax(axis=1)
            some = np.flatnonzero(alive[rows, pick])
            if not len(some):
                break
            chosen = near[some, pick[some]]
            out[some, r] = chosen
            alive[some, pick[some]] = False
            i, j = np.nonzero(alive[some])
            covered = ALPHA * (1 - self.similar(chosen[i], near[some[i], j])) <= far[some[i], j]
            alive[some[i[covered]], j[covered]] = False
        self.edges[nodes] = out

    def build(self) -> Graph:
        """Insert the vectors in batches, each as large as all before: search, prune, and lead edges back."""
        n = len(self.x)
        order = np.r_[self.medoid, np.delete(np.arange(n), self.medoid)] if n else np.zeros(0, np.int64)
        done = 1
        while done < n:
            batch = order[done : done + min(done, 256)]
            owner, node, s = self.search(batch, np.full((len(batch), 1), self.medoid), BUILD_BEAM)
            self.prune(batch, *table_of(owner, node, s, len(batch)))
            self.lead_back(batch)
            done += len(batch)
        return self

    def lead_back(self, batch: np.ndarray) -> None:
        i, r = np.nonzero(self.edges[batch] >= 0)
        source, target = batch[i], self.edges[batch][i, r]
        nodes, where = np.unique(target, return_inverse=True)
        held = self.edges[nodes]
        a, b = np.nonzero(held >= 0)
        owner, node = np.r_[where, a], np.r_[source, held[a, b]]
        self.prune(nodes, *table_of(owner, node, self.similar(nodes[owner], node), len(nodes)))


def table_of(owner: np.ndarray, node: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors and similarities for each owner, the most similar first, at most 2 * CANDIDATES."""
    order = np.lexsort((node, -s, owner))
    owner, node, s = owner[order], node[order], s[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner] if len(owner) else owner
    good = place < 2 * CANDIDATES
    ids, sims = np.full((n, 2 * CANDIDATES), -1), np.full((n, 2 * CANDIDATES), -3.0)
    ids[owner[good], place[good]], sims[owner[good], place[good]] = node[good], s[good]
    return ids, sims


def range_search(graph: Graph, least: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i < j`` found with a similarity of about ``least`` or more; every vector is a query.

    A query enters the graph at the medoid and at its own node. Only vectors that it visits are compared.
    """
    n, pairs = len(graph.x), []
    for at in range(0, n, step):
        own = np.arange(at, min(n, at + step))
        i, j, s = graph.search(own, np.column_stack([own, np.full(len(own), graph.medoid)]), BEAM, least - SLACK)
        i = own[i]
        hit = (s >= least - 1e-9) & (i != j)
        pairs.append(np.minimum(i, j)[hit] * n + np.maximum(i, j)[hit])
    code = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return code // max(n, 1), code % max(n, 1)


def all_pairs(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i < j`` by comparing all, for labels in which the audit found too little."""
    return np.nonzero(np.triu(x @ x.T >= least - 1e-9, 1))


def tree_of(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector with a link, the first vector that it hangs together with."""
    label = np.arange(n)
    while len(i):
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    rows = np.unique(np.r_[i, j])
    return rows, label[rows]


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.einsum("ij,ij->i", x[i], x[j]) / (length[i] * length[j])


def link_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", overlap: int = OVERLAP) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every distinct row ``(id, label, vector)``.

    Vectors of one label link when their cosine, in double precision, is at least ``least``. Equal
    vectors of a label are one node with a weight, so copies are never expanded into pairs. Nodes join
    the shards of their nearest cluster centres, or their label's. Each shard builds a pruned graph, the adjacency lists of all shards are
    united, and every node searches each of its shards. A pair is counted in the first shard that
    both are in, so no pair is listed or counted twice. An audit compares a bounded number of nodes
    with all others; labels whose recall is low, and labels without an audited node if the recall of
    all is low, are compared exactly, block by block. ``n_links`` counts vectors, ``component_id`` is
    the smallest id reachable.

    Null label, or a vector that is null, zero or holds null or non-finite components: no links,
    a component of its own. Vectors of different lengths never link. Null id: no links, null
    component, not kept. Rows equal in all three columns count and return once; an id under two
    labels, or with two vectors, is two vectors. Empty table: empty result. Other columns are ignored.
    """
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(group_col).cast("string").alias("label")).distinct())
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"), F.lit(False))
    marked = rows.where(good).withColumn("node", F.xxhash64("label", "v"))  # a node is a label and a vector, named by 64 bits
    nodes = stored(marked.groupBy("node", "label", "v").agg(F.min("id").alias("least_id"), F.count("*").alias("weight")))
    links, edges = search_shards(assign(nodes, overlap), least)
    poor, recall = audit(nodes, links, least)
    log.info("recall %.4f, labels compared exactly: %s", recall, "none" if poor is None else poor.count())
    if poor is not None:
        again = stored(nodes.join(poor, "label", "left_semi"))
        more, ends = search_shards(again.select("node", "v", "weight", F.array(F.xxhash64("label", F.size("v"))).alias("shards")), least, exact=True)
        links = stored(links.join(again.select("node"), "node", "left_anti").unionByName(more))
        edges = edges.unionByName(ends)
    named = nodes.select("node", "weight", "least_id").join(links, "node", "left").join(connected_components(edges, "a", "b"), "node", "left")
    named = stored(named.select("node", "least_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = marked.select("id", "node").join(named.join(smallest, "component").select("node", "n_links", "component_id"), "node").drop("node")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def assign(nodes: DataFrame, overlap: int) -> DataFrame:
    """``(node, v, weight, shards)``: each node with its shards, the nearest centres of its label and length.

    Centres are nodes drawn by a hash of their name, about ``CENTRES`` at most. A label of which none
    was drawn is a shard itself.
    """
    spark = nodes.sparkSession
    size = F.size("v").alias("size")
    modulus = max(CLUSTER, -(-nodes.count() // CENTRES))
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(modulus)) == 0).select("label", size, "node", "v")
    centres: dict = {}
    for r in drawn.collect():
        centres.setdefault((r["label"], r["size"]), []).append((r["node"], r["v"]))
    shipped = {}
    for key, held in centres.items():
        held.sort(key=lambda x: x[0])
        x = np.array([v for _, v in held], np.float64)
        shipped[key] = (np.array([n for n, _ in held]), x / np.linalg.norm(x, axis=1, keepdims=True))
    centre = spark.sparkContext.broadcast(shipped)
    schema = pa.schema([("node", pa.int64()), ("near", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, lists = batch.column(1).to_pylist(), batch.column(2)
            keys = list(zip(labels, np.diff(lists.offsets.to_numpy()).tolist(), strict=True))
            near: list = [[] for _ in keys]
            places: dict = {}
            for i, key in enumerate(keys):
                if key in centre.value:
                    places.setdefault(key, []).append(i)
            for key, at in places.items():
                names, c = centre.value[key]
                s = matrix(lists.take(pa.array(at))) @ c.T
                k = min(overlap, len(c))
                best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(k), (len(at), 1))
                for i, row in zip(at, names[np.sort(best, axis=1)], strict=True):
                    near[i] = row.tolist()
            yield record_batch(schema, (batch.column(0), near))

    found = nodes.select("node", "label", "v").mapInArrow(run, "node long, near array<long>")
    joined = nodes.join(found, "node")
    alone = F.array(F.xxhash64("label", F.size("v")))
    return joined.select("node", "v", "weight", F.when(F.size("near") > 0, F.col("near")).otherwise(alone).alias("shards"))


def search_shards(placed: DataFrame, least: float, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(node, links)`` and spanning edges ``(a, b)``, by graph search or, if ``exact``, by comparing all."""
    placed = stored(placed)
    members = placed.select("node", F.explode("shards").alias("shard"))
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("halves"))
    blocks = F.when(F.col("halves") > 1, F.col("halves") * 2).otherwise(1)
    cut = placed.select("*", F.explode("shards").alias("shard")).join(sizes, "shard").withColumn("blocks", blocks)
    cut = cut.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = cut.select("shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "v", "weight", "shards")
    tasks = ["shard", "low", "high"]
    built = pa.schema([("node", pa.int64()), ("edges", pa.list_(pa.int64()))])

    def units(group: pa.Table) -> np.ndarray:
        x = matrix(group.column("v"))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def build(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(group.column("node").to_numpy(), kind="stable"))
        ids, edges = group.column("node").to_numpy(), Graph(units(group)).build().edges
        return pa.Table.from_arrays([pa.array(ids), pa.array([ids[row[row >= 0]] for row in edges], pa.list_(pa.int64()))], schema=built)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def search(key: tuple, group: pa.Table) -> pa.Table:
        shard, low, high = (k.as_py() for k in key)
        group = group.take(np.argsort(group.column("node").to_numpy(), kind="stable"))
        ids, x, weight, unit = group.column("node").to_numpy(), matrix(group.column("v")), group.column("weight").to_numpy(), units(group)
        if exact:
            i, j = all_pairs(unit, least)
        else:
            lists = group.column("edges").combine_chunks()
            owner, to = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
            inside = ids[at] == to
            graph = Graph(unit).join(owner[inside], at[inside])
            i, j = range_search(graph, least)
        real = cosines(x, i, j) >= least
        i, j = i[real], j[real]
        # A pair counts in the first shard of both, and of its blocks' pairs in one.
        sets = group.column("shards").combine_chunks()
        width = int(np.diff(sets.offsets.to_numpy()).max(initial=0))
        belongs, some = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), bool)
        for r, s in enumerate(sets.to_pylist()):
            belongs[r, : len(s)], some[r, : len(s)] = s, True
        common = ((belongs[i][:, :, None] == belongs[j][:, None, :]) & some[i][:, :, None] & some[j][:, None, :]).any(axis=2)
        top = np.iinfo(np.int64).max
        first = np.where(common, belongs[i], top).min(axis=1, initial=top)
        block = group.column("block").to_numpy()
        own = (first == shard) & ((block[i] != block[j]) | (low == high))
        links = np.bincount(i[own], weight[j[own]], len(ids)) + np.bincount(j[own], weight[i[own]], len(ids))
        rows, roots = tree_of(len(ids), i, j)
        counted = np.flatnonzero(links)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.Table.from_arrays([pa.array(np.r_[ids[counted], ids[rows]]), pa.concat_arrays([none(len(counted)), pa.array(ids[roots])]), pa.concat_arrays([pa.array(links[counted].astype(np.int64)), none(len(rows))])], schema=out)

    if not exact:
        graph = held.groupBy(*tasks).applyInArrow(build, "node long, edges array<long>")
        graph = stored(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")))
        held = held.join(graph, "node")
    met = stored(held.groupBy(*tasks).applyInArrow(search, "a long, b long, links long"))
    return met.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), met.where("b is not null").select("a", "b")


def audit(nodes: DataFrame, links: DataFrame, least: float) -> tuple[DataFrame | None, float]:
    """Labels in which the search has found too few links (none: None), and the share found in all.

    About ``AUDITED`` nodes, and as many of those with links, are drawn by hash and compared with all others.
    """
    spark = nodes.sparkSession
    draw = F.xxhash64(F.lit(1), "node")
    linked = nodes.join(links.select("node"), "node", "left_semi")
    drawn = nodes.orderBy(draw, "node").limit(AUDITED).unionByName(linked.orderBy(draw, "node").limit(AUDITED)).dropDuplicates(["node"])
    groups: dict = {}
    for r in drawn.select("node", "label", "v").collect():
        groups.setdefault((r["label"], len(r["v"])), []).append((r["node"], r["v"]))
    if not groups:
        return None, 1.0
    asked = spark.sparkContext.broadcast({k: (np.array([i for i, _ in v]), np.array([x for _, x in v], np.float64)) for k, v in groups.items()})
    schema = pa.schema([("node", pa.int64()), ("label", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, weight = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            places: dict = {}
            for i, key in enumerate(zip(batch.column(1).to_pylist(), np.diff(lists.offsets.to_numpy()).tolist(), strict=True)):
                if key in asked.value:
                    places.setdefault(key, []).append(i)
            for key, at in places.items():
                own, q = asked.value[key]
                x = matrix(lists.take(pa.array(at)))
                cos = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
                near = (cos >= least) & (own[:, None] != ids[at][None, :])
                yield record_batch(schema, (own, [key[0]] * len(own), (near * weight[at]).sum(axis=1).astype(np.int64)))

    true = nodes.select("node", "label", "v", "weight").mapInArrow(run, "node long, label string, n long").groupBy("node", "label").agg(F.sum("n").alias("n"))
    each = stored(true.join(links, "node", "left").groupBy("label").agg(F.sum(F.least("n", F.coalesce("links", F.lit(0)))).alias("found"), F.sum("n").alias("every")))
    found, every = each.agg(F.sum("found"), F.sum("every")).first()
    recall = found / every if every else 1.0
    short = each.where(F.col("found") < LEAST_RECALL * F.col("every")).select("label")
    if recall < LEAST_RECALL:
        fine = each.where(F.col("found") >= LEAST_RECALL * F.col("every")).select("label")
        return stored(nodes.select("label").distinct().join(fine, "label", "left_anti")), recall
    return (None if short.isEmpty() else short), recall
