"""Near-duplicate vectors through hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class. Classes are dealt to shards by a hash, each shard gets a graph, and every class
asks every shard. A query descends the layers, walks the lowest one with a beam, and from what it finds
above the threshold floods along the links for as long as they stay above it, so a large group is found
whole whatever the beam. Each task audits itself first: stored vectors moved to just inside the threshold
have to be found again, else the beam is doubled. All links are verified in double precision.

Insertions and queries are worked off in batches of numpy arrays; the graph is the same as if each batch were
inserted at once, its members linked to each other by comparing the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm.common import components, gathered, needs, shared_table, single_groups, star_forest

#: Links of a node on the upper layers; the lowest has twice as many.
LINKS = 12
BUILD_BEAM = 48
BEAM = 32
BATCH = 256
#: Share of audit queries that have to find the vector they were made from.
RECALL = 0.99
AUDITS = 128
#: Shards and query parts at least, and vectors of each at most.
SHARDS, PARTS, PER_SHARD = 8, 6, 50_000


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def levels_of(n: int, seed: int = 11) -> np.ndarray:
    """Highest layer of each node: geometric, fixed by the node's place."""
    draw = np.random.default_rng(seed).random(n)
    return np.minimum(-np.log(1 - draw) / np.log(LINKS), 12).astype(np.int64)


class Graph:
    """Links of each layer as rows of node numbers, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray]):
        self.vectors = vectors.astype(np.float32)
        self.layers, self.members = layers, members
        self.both: tuple[np.ndarray, np.ndarray] | None = None

    def close(self) -> None:
        """After the last insertion: let links of the lowest layer be walked both ways.

        Pruning leaves nodes to which little or nothing links. A flood follows all reverse links; the walk gets a few
        more per node, first those to nodes that are linked least.
        """
        table = self.layers[0]
        n, width = table.shape
        source, place = np.nonzero(table >= 0)
        target = table[source, place].astype(np.int64)
        linked = np.bincount(target, minlength=n)
        pairs = np.unique(np.concatenate([source * n + target, target * n + source]))
        near, far = np.divmod(pairs, n)
        self.both = np.append(0, np.cumsum(np.bincount(near, minlength=n))), far
        back = np.setdiff1d(target * n + source, source * n + target)
        near, far = np.divmod(back, n)
        order = np.lexsort((linked[far], near))
        near, far = near[order], far[order]
        count = np.bincount(near, minlength=n)
        rank = np.arange(len(near)) - np.repeat(np.cumsum(count) - count, count)
        more = np.full((n, LINKS), -1, np.int32)
        more[near[rank < LINKS], rank[rank < LINKS]] = far[rank < LINKS]
        self.layers[0] = np.concatenate([table, more], 1)

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        level = levels_of(n)
        graph = cls(vectors, [], [])
        order = np.argsort(-level, kind="stable")
        for layer in range(int(level.max()), -1, -1):
            members = order[: int((level >= layer).sum())]
            width = LINKS if layer else 2 * LINKS
            graph.layers.insert(0, np.full((n, width), -1, np.int32))
            graph.members.insert(0, members)
            graph.insert_all(members, width)
        return graph

    def insert_all(self, members: np.ndarray, width: int) -> None:
        done, inserted = 0, np.zeros(len(self.vectors), bool)
        while done < len(members):
            batch = members[done : done + min(BATCH, max(32, done))]
            own = self.vectors[batch]
            among = own @ own.T
            np.fill_diagonal(among, -2)
            many = min(len(batch), width)
            near = np.argpartition(-among, many - 1, axis=1)[:, :many]
            ids, sims = batch[near], np.take_along_axis(among, near, 1)
            sims = np.where(sims > -2, sims, -np.inf)
            if done:
                entry = self.entries(own)
                entry = np.where(inserted[entry], entry, members[0])
                found, scores = self.search(own, BUILD_BEAM, entry, self.layers[0], done)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, scores], 1)
            ids = np.where(np.isfinite(sims), ids, -1)
            chosen, scores = self.chosen(ids, sims, width)
            self.layers[0][batch] = chosen
            back, place = np.nonzero(chosen >= 0)
            self.link_back(chosen[back, place].astype(np.int64), batch[back], scores[back, place], width)
            inserted[batch] = True
            done += len(batch)

    def link_back(self, nodes: np.ndarray, others: np.ndarray, sims: np.ndarray, width: int) -> None:
        """Add others to the links of nodes; of too many, the nearest new ones and the old ones compete."""
        if not len(nodes):
            return
        order = np.lexsort((-sims, nodes))
        nodes, others, sims = nodes[order], others[order], sims[order]
        first = np.append(True, nodes[1:] != nodes[:-1])
        start = np.flatnonzero(first)
        rank = np.arange(len(nodes)) - start[np.cumsum(first) - 1]
        keep = rank < width
        own = nodes[start]
        row = (np.cumsum(first) - 1)[keep]
        new = np.full((len(own), width), -1, np.int64)
        new_sims = np.full((len(own), width), -np.inf, np.float32)
        new[row, rank[keep]], new_sims[row, rank[keep]] = others[keep], sims[keep]
        for i in range(0, len(own), 512):
            part = slice(i, i + 512)
            old = self.layers[0][own[part]].astype(np.int64)
            old_sims = np.einsum("bd,bkd->bk", self.vectors[own[part]], self.vectors[old])
            old_sims = np.where(old >= 0, old_sims, -np.inf)
            # A batch links both ways, so a new link may be there already.
            twice = (new[part][:, :, None] == old[:, None, :]).any(2)
            ids = np.concatenate([old, np.where(twice, -1, new[part])], 1)
            both = np.concatenate([old_sims, np.where(twice, -np.inf, new_sims[part])], 1)
            self.layers[0][own[part]] = self.chosen(ids, both, width)[0]

    def chosen(self, ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Half the links go to nodes nearer to the centre than to any link chosen before, the rest to the nearest."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        stored = self.vectors[ids]
        between = stored @ stored.transpose(0, 2, 1)
        picked = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            rival = np.where(picked, between[:, j, :], -np.inf).max(1)
            picked[:, j] = np.isfinite(sims[:, j]) & (rival < sims[:, j]) & (picked.sum(1) < width // 2)
        rest = np.where(picked, np.inf, sims)
        order = np.argsort(-rest, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        if ids.shape[1] < width:
            gap = ((0, 0), (0, width - ids.shape[1]))
            ids, sims = np.pad(ids, gap, constant_values=-1), np.pad(sims, gap, constant_values=-np.inf)
        return np.where(np.isfinite(sims), ids, -1), sims

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Where to enter the lowest layer: found by way of the layers above it."""
        top = self.members[-1]
        sims = queries @ self.vectors[top[: 4 * LINKS]].T
        entry = top[np.argsort(-sims, axis=1, kind="stable")[:, :4]]
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self.search(queries, 8, entry, self.layers[layer], len(self.members[layer]))[0]
        return entry

    def search(self, queries: np.ndarray, beam: int, entry: np.ndarray, links: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` best nodes that a walk along the links finds, best first; -1 and -inf where there are fewer."""
        n = len(queries)
        rows = np.arange(n)[:, None]
        beam = min(beam, max(size, 1))
        seen = np.zeros((n, len(self.vectors) + 1), bool)  # the last column is that of no node
        seen[:, -1] = True
        entry = np.sort(entry, axis=1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
        sims = np.where(entry >= 0, np.einsum("bd,bkd->bk", queries, self.vectors[entry]), -np.inf)
        seen[rows, entry] = True
        ids, open_ = entry.astype(np.int64), entry >= 0
        while True:
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                break
            at = np.argsort(~open_[live], axis=1, kind="stable")[:, :2]
            usable = np.take_along_axis(open_[live], at, 1)
            nodes = np.where(usable, np.take_along_axis(ids[live], at, 1), -1)
            mine = open_[live]
            np.put_along_axis(mine, at, False, 1)
            fresh = []
            for j in range(nodes.shape[1]):
                near = np.where(nodes[:, j : j + 1] >= 0, links[nodes[:, j]], -1)
                near = np.where(seen[live[:, None], near], -1, near)
                seen[live[:, None], near] = True
                fresh.append(near)
            near = np.concatenate(fresh, 1).astype(np.int64)
            score = np.where(near >= 0, np.einsum("bd,bkd->bk", queries[live], self.vectors[near]), -np.inf)
            all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], score], 1)
            all_open = np.concatenate([mine, near >= 0], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            if best.shape[1] > ids.shape[1]:
                gap = ((0, 0), (0, best.shape[1] - ids.shape[1]))
                ids, sims, open_ = np.pad(ids, gap, constant_values=-1), np.pad(sims, gap, constant_values=-np.inf), np.pad(open_, gap)
            ids[live], sims[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_open))
        return ids, sims

    def within(self, queries: np.ndarray, exact: np.ndarray, stored: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with a cosine of at least the threshold, verified on the double vectors `exact` and `stored`."""
        ids, sims = self.search(queries, beam, self.entries(queries), self.layers[0], len(self.vectors))
        loose = threshold - 1e-4  # single precision
        query, place = np.nonzero(sims >= loose)
        node = ids[query, place]
        seen = np.zeros((len(queries), len(self.vectors) + 1), bool)
        seen[:, -1] = True
        seen[query, node] = True
        found = [(query, node)]
        while len(query):
            nexts = []
            for i in range(0, len(query), 20_000):
                start, far = self.both
                size = start[node[i : i + 20_000] + 1] - start[node[i : i + 20_000]]
                near = gathered(far, start[node[i : i + 20_000]], size)
                owner = np.repeat(query[i : i + 20_000], size)
                new = ~seen[owner, near]
                pair = np.unique(owner[new] * len(self.vectors) + near[new])
                owner, near = np.divmod(pair, len(self.vectors))
                seen[owner, near] = True
                close = np.einsum("bd,bd->b", queries[owner], self.vectors[near]) >= loose
                nexts.append((owner[close], near[close]))
            query, node = (np.concatenate(x) for x in zip(*nexts))
            found.append((query, node))
        query, node = (np.concatenate(x) for x in zip(*found))
        true = np.zeros(len(query), bool)
        for i in range(0, len(query), 50_000):
            part = slice(i, i + 50_000)
            true[part] = np.einsum("bd,bd->b", exact[query[part]], stored[node[part]]) >= threshold
        return query[true], node[true]


def audited_beam(graph: Graph, stored: np.ndarray, threshold: float, beam: int = BEAM) -> int:
    """The beam, doubled until vectors just inside the threshold of stored ones find them."""
    random = np.random.default_rng(3)
    origin = random.permutation(len(stored))[:AUDITS]
    noise = random.normal(size=(len(origin), stored.shape[1]))
    noise -= (noise * stored[origin]).sum(1, keepdims=True) * stored[origin]
    size = np.sqrt((noise * noise).sum(1, keepdims=True))
    cosine = min(1.0, threshold + 1e-6)
    moved = cosine * stored[origin] + np.sqrt(1 - cosine**2) * np.divide(noise, size, out=np.zeros_like(noise), where=size > 1e-9)
    moved = unit(moved)
    while beam < len(stored):
        query, node = graph.within(moved.astype(np.float32), moved, stored, threshold - 1e-9, beam)
        found = np.zeros(len(origin), bool)
        found[query[node == origin[query]]] = True
        if found.mean() >= RECALL:
            break
        beam *= 2
    return beam


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def built(group: pa.Table) -> pa.Table:
    """Adds the nodes' links, layer by layer, to the rows of a shard."""
    group = group.sort_by([("id", "ascending")])
    graph = Graph.build(unit(matrix(group["vector"])))
    layers = [x.tolist() for x in graph.layers]
    member = [set(m.tolist()) for m in graph.members]
    links = [[layer[i] for layer, inside in zip(layers, member) if i in inside] for i in range(len(group))]
    return group.append_column("node", pa.array(np.arange(len(group)))).append_column("links", pa.array(links, pa.list_(pa.list_(pa.int32()))))


def loaded(index: pa.Table) -> tuple[Graph, np.ndarray]:
    """The graph of a shard's rows, sorted by node, and its vectors."""
    stored = unit(matrix(index["vector"]))
    links = index["links"].to_pylist()
    depth = max(map(len, links))
    layers, members = [], []
    level = np.array([len(x) for x in links])
    for layer in range(depth):
        own = np.flatnonzero(level > layer)
        table = np.full((len(links), len(links[own[0]][layer])), -1, np.int32)
        table[own] = [links[i][layer] for i in own.tolist()]
        layers.append(table)
        members.append(own)
    graph = Graph(stored, layers, members)
    graph.close()
    return graph, stored


def shard_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n): how many vectors n class a links to in a shard (b is null), and a star forest of links (n is null)."""

    def rows(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
        empty = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), empty if b is None else pa.array(b), empty if n is None else pa.array(n)], names=["a", "b", "n"])

    for run in single_groups(batches, ["dim", "shard", "part"]):
        asks = run["asks"].to_numpy()
        index, queries = run.filter(pa.array(~asks)), run.filter(pa.array(asks))
        if not len(index) or not len(queries):
            continue
        graph, stored = loaded(index)
        own, copies = index["id"].to_numpy(), index["copies"].to_numpy()
        beam = audited_beam(graph, stored, threshold)
        ids = queries["id"].to_numpy()
        exact = unit(matrix(queries["vector"]))
        left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = max(16, min(BATCH, (1 << 24) // (len(stored) + 1)))
        for i in range(0, len(ids), size):
            part = exact[i : i + size]
            query, node = graph.within(part.astype(np.float32), part, stored, threshold, beam)
            other = ids[i + query] != own[node]
            query, node = i + query[other], node[other]
            count = np.bincount(query - i, copies[node], len(part)).astype(np.int64)
            some = np.flatnonzero(count)
            if len(some):
                yield rows(ids[i + some], None, count[some])
            left, right = star_forest(np.concatenate([left, ids[query]]), np.concatenate([right, own[node]]))
        if len(left):
            yield rows(left, right, None)


def comparable(vector: str) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    column = F.col(vector)
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(column, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    n_links counts the other rows linked directly, equal vectors included; component_id is the smallest key reachable,
    null if only rows without a key are. Vectors that are not comparable link with nothing. Vectors of different length
    never link. Rows of one key are vectors of their own: classes of equal vectors go by numbers, and by their smallest
    key only in the result. An empty table gives an empty one.
    """
    needs(vectors, key, vector)
    rows = vectors.select(key, F.col(vector).alias("vector"))
    usable = comparable("vector")
    classes = rows.where(usable).groupBy("vector").agg(F.min(key).cast("long").alias("low"), F.count("*").alias("copies"))
    classes = classes.withColumn("id", F.monotonically_increasing_id())
    classes = shared_table(classes.withColumn("draw", F.xxhash64("vector")).withColumn("dim", F.size("vector")), "vectors")
    n = classes.count()
    shards, parts = max(SHARDS, -(-n // PER_SHARD)), max(PARTS, -(-n // PER_SHARD))
    dealt = classes.select("vector", "id", "copies", "dim", F.pmod("draw", F.lit(shards)).cast("int").alias("shard"))
    fields = "id long, copies long, dim int, shard int"
    kind = vectors.schema[vector].dataType.simpleString()
    graphs = dealt.groupBy("dim", "shard").applyInArrow(built, f"vector {kind}, {fields}, node long, links array<array<int>>")
    graphs = shared_table(graphs, "graphs")

    index = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("asks", F.lit(False))
    queries = (
        classes.withColumn("part", F.pmod(F.shiftright("draw", 20), F.lit(parts)).cast("int"))
        .drop("draw", "low")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumns({"asks": F.lit(True), "node": F.lit(None).cast("long"), "links": F.lit(None).cast("array<array<int>>")})
    )
    group = ["dim", "shard", "part"]
    met = index.unionByName(queries).repartition(*group).sortWithinPartitions(*group, "asks", "node")
    found = shared_table(met.mapInArrow(lambda batches: shard_links(batches, threshold), "a long, b long, n long"), "links")

    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("n is null").select("a", "b"))
    named = (
        classes.select("vector", "id", "low", "copies")
        .join(counts, F.col("id") == F.col("a"), "left")
        .join(roots, F.col("id") == F.col("node"), "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"), "low")
    )
    lows = named.groupBy("root").agg(F.min("low").alias("smallest"))
    named = named.join(lows, "root").select("vector", "n_links", "smallest", F.lit(True).alias("linked"))
    joined = rows.withColumn("usable", usable).join(named, "vector", "left")
    alone = ~F.col("usable") | F.col("linked").isNull()
    component = F.when(alone, F.col(key).cast("long")).otherwise(F.col("smallest"))
    return joined.select(
        key,
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"),
    )
