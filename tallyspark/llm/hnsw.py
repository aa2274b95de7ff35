"""Operator 4: embedding near-duplicates by a navigable small-world graph that tells which vectors meet."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, local_forest, table

#: Vectors of a block at most (on average; blocks are dealt by hash), and tasks that vectors are dealt to at least.
SHARD_ROWS, LEAST_SHARDS = 1 << 14, 6
#: Vectors that one task asks the graph about, and bytes of a block's vectors at most.
TASK_ROWS, BLOCK_BYTES = 4096, 16 << 20
#: Rows of cells that are compared by one call, on average.
BUCKET_ROWS = 1 << 15
#: Routers of n vectors: so many times the square root of n.
ROUTERS = 16
#: Links of a node on upper layers and on the ground layer, beam width of building and first one of asking.
LINKS, GROUND_LINKS, BUILD_BEAM, ASK_BEAM = 12, 24, 48, 48
BATCH = 256
#: Further links of a ground node to what would be cut off.
BRIDGES = 4
#: Queries of a graph's audit, half of them planted, against every vector of it, and the share of true links they must find.
AUDIT, RECALL = 128, 0.99
#: Vectors whose links all are looked for beside as many planted ones, and the share of either's links that must meet.
PROBES, MEET = 512, 0.999


class Graph:
    """A hierarchical small-world graph over unit vectors; queries and insertions run in batches.

    Layer ``l`` holds the nodes whose level is at least ``l``. ``links[l]`` has a row per node, -1 where empty.
    """

    def __init__(self, vectors, seed: int = 7):
        import numpy as np

        self.v = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.v)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable")  # high nodes first: node k of the graph is vector order[k]
        self.v = self.v[self.order]
        self.level = level[self.order]
        self.sizes = [int((self.level >= k).sum()) for k in range(int(self.level.max(initial=0)) + 1)]
        self.links = [np.full((s, GROUND_LINKS if k == 0 else LINKS), -1, np.int32) for k, s in enumerate(self.sizes)]

    def build(self):
        import numpy as np

        n, at = len(self.v), min(1, len(self.v))
        while at < n:
            to = min(n, at + min(max(at, 1), BATCH))
            self._insert(np.arange(at, to), at)
            at = to
        self._bridge()
        return self

    def _bridge(self) -> None:
        """Link what cannot be reached from the entry on the ground layer to its nearest reachable node, one way in."""
        import numpy as np

        n = len(self.v)
        extra = np.full((n, BRIDGES), -1, np.int32)
        links = np.concatenate([self.links[0], extra], 1)
        reached, front = np.zeros(n, bool), np.array([0] if n else [], np.int64)
        used = np.zeros(n, int)
        while True:
            while len(front):
                reached[front] = True
                near = np.unique(links[front])
                near = near[near >= 0]
                front = near[~reached[near]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            home = np.flatnonzero(reached & (used < BRIDGES))
            sims = self.v[lost[:BATCH]] @ self.v[home].T
            k = int(sims.max(1).argmax())
            node, at = int(lost[k]), int(home[sims[k].argmax()])
            links[at, -BRIDGES + used[at]] = node
            used[at] += 1
            front = np.array([node])
        self.links[0] = links

    def _layer(self, k: int, known: int) -> int:
        return min(self.sizes[k], known)

    def _insert(self, new, known: int) -> None:
        """Nodes ``new`` are linked to the first ``known`` nodes and to each other."""
        import numpy as np

        q = self.v[new]
        entry = np.zeros((len(new), 1), np.int64)
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        for k in range(len(self.sizes) - 1, -1, -1):
            inside = self._layer(k, known)
            here = new < self.sizes[k]
            ids, sims = self.beam(k, q, entry, BUILD_BEAM if here.any() else 1, inside)
            entry = ids[:, :1] if k and not here.any() else np.where(ids[:, :4] < 0, ids[:, :1], ids[:, :4])
            if not here.any():
                continue
            rows = np.flatnonzero(here)
            near = min(BUILD_BEAM // 2, len(rows))
            mates = np.argsort(-own[np.ix_(rows, rows)], axis=1)[:, :near]
            mate_sims = np.take_along_axis(own[np.ix_(rows, rows)], mates, 1)
            mate_ids = np.where(np.isfinite(mate_sims), new[rows][mates], -1)
            c_ids, c_sims = np.concatenate([ids[rows], mate_ids], 1), np.concatenate([sims[rows], mate_sims], 1)
            chosen = self.select(c_ids, c_sims, self.links[k].shape[1] // 2)
            self.links[k][new[rows], : chosen.shape[1]] = chosen
            self._link_back(k, new[rows], chosen)

    def _link_back(self, k: int, new, chosen) -> None:
        import numpy as np

        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        ok = target >= 0
        source, target = source[ok], target[ok]
        if not len(target):
            return
        order = np.lexsort((-np.einsum("ij,ij->i", self.v[source], self.v[target]), target))
        source, target = source[order], target[order]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        width = self.links[k].shape[1]
        nth = np.arange(len(target)) - np.repeat(begin, count)
        grown = np.full((len(nodes), 2 * width), -1, np.int64)
        grown[:, :width] = self.links[k][nodes]
        keep = nth < width
        grown[np.repeat(np.arange(len(nodes)), count)[keep], width + nth[keep]] = source[keep]
        dup = (grown[:, width:, None] == grown[:, None, :width]).any(2)
        grown[:, width:][dup] = -1
        sims = np.where(grown >= 0, np.einsum("ijk,ik->ij", self.v[grown], self.v[nodes]), -np.inf)
        full = (grown >= 0).sum(1) > width
        packed = np.argsort(grown < 0, axis=1, kind="stable")
        out = np.take_along_axis(grown, packed, 1)[:, :width]
        if full.any():
            out[full] = self.select(grown[full], sims[full], width)
        self.links[k][nodes] = out

    def select(self, ids, sims, most: int):
        """Of each row's candidates the nearest that are nearer to the node than to any chosen before; then the nearest left."""
        import numpy as np

        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = (ids >= 0) & np.isfinite(sims)
        vec = self.v[np.where(valid, ids, 0)]
        between = np.matmul(vec, vec.transpose(0, 2, 1))
        rows, width = ids.shape
        taken, count = np.zeros((rows, width), bool), np.zeros(rows, int)
        worst = np.full((rows, width), -np.inf, np.float32)
        for j in range(width):
            good = valid[:, j] & (count < most) & (sims[:, j] > worst[:, j])
            taken[good, j] = True
            count += good
            worst = np.where(good[:, None], np.maximum(worst, between[:, j]), worst)
        rest = valid & ~taken
        fill = rest & (np.cumsum(rest, axis=1) <= (most - count)[:, None])
        taken |= fill
        back = np.argsort(~taken, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(taken, back, 1), np.take_along_axis(ids, back, 1), -1)

    def beam(self, k: int, q, entry, width: int, inside: int):
        """The ``width`` best nodes found on a layer from ``entry`` nodes, best first, for every query at once."""
        import numpy as np

        rows = len(q)
        seen = np.zeros((rows, max(inside, 1)), bool)
        entry = np.where((entry >= 0) & (entry < inside), entry, 0)
        first = np.ones(entry.shape, bool)
        for j in range(1, entry.shape[1]):
            first[:, j] = ~(entry[:, j : j + 1] == entry[:, :j]).any(1)
        np.put_along_axis(seen, entry, True, 1)
        sims = np.where(first, np.einsum("ijk,ik->ij", self.v[entry], q), -np.inf).astype(np.float32)
        ids = np.where(first, entry, -1)
        if ids.shape[1] < width:
            pad = width - ids.shape[1]
            ids = np.concatenate([ids, np.full((rows, pad), -1)], 1)
            sims = np.concatenate([sims, np.full((rows, pad), -np.inf, np.float32)], 1)
        open_ = np.isfinite(sims)
        live = np.arange(rows)
        step = 1 if width < 8 else 4
        while len(live):
            want = np.where(open_[live], sims[live], -np.inf)
            best = np.argpartition(-want, step - 1, axis=1)[:, :step] if want.shape[1] > step else np.argsort(-want, axis=1)[:, :step]
            has = np.isfinite(np.take_along_axis(want, best, 1))
            alive = has.any(1)
            live, best, has = live[alive], best[alive], has[alive]
            if not len(live):
                break
            open_[live[:, None], best] = False
            nodes = np.where(has, np.take_along_axis(ids[live], best, 1), -1)
            near = self.links[k][np.maximum(nodes, 0)].astype(np.int64)
            near[nodes < 0] = -1
            near = near.reshape(len(live), -1)
            near[near >= inside] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            node = near[r, c]
            seen[live[r], node] = True
            got = np.full(near.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("ij,ij->i", self.v[node], q[live[r]])
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
            all_sims = np.concatenate([sims[live], got], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live] = np.take_along_axis(all_ids, top, 1)
            sims[live] = np.take_along_axis(all_sims, top, 1)
            open_[live] = np.take_along_axis(all_open, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def ask(self, q, width: int, least: float, whole: bool = False):
        """``(query, vector)`` pairs found at similarity ``least`` or more. A query whose beam ends above it asks again, wider.

        With ``whole`` every vector is looked at instead, which is the last step of an audit that no beam passes.
        """
        import numpy as np

        n = len(self.v)
        out: list[tuple] = []
        if whole:
            for s in range(0, len(q), BATCH):
                r, c = np.nonzero(q[s : s + BATCH] @ self.v.T >= least)
                out.append((r + s, self.order[c]))
        for s in range(0, 0 if whole else len(q), BATCH):
            rows, beam = np.arange(s, min(s + BATCH, len(q))), min(width, n)
            while len(rows):
                entry = np.zeros((len(rows), 1), np.int64)
                for k in range(len(self.sizes) - 1, 0, -1):
                    entry = self.beam(k, q[rows], entry, min(4, self.sizes[k]), self.sizes[k])[0]
                ids, sims = self.beam(0, q[rows], entry, beam, n)
                more = (sims[:, -1] >= least) & (beam < n)
                r, c = np.nonzero((sims >= least) & (ids >= 0) & ~more[:, None])
                out.append((rows[r], self.order[ids[r, c]]))
                rows, beam = rows[more], min(beam * 4, n)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 2

    def nearest(self, q, width: int, whole: bool = False):
        """Each query's ``width`` nearest vectors that a beam finds, nearest first, -1 where it finds no more."""
        import numpy as np

        n = len(self.v)
        width, out = min(width, n), []
        for s in range(0, len(q), BATCH):
            part = np.ascontiguousarray(q[s : s + BATCH], dtype=np.float32)
            if whole:
                sims = part @ self.v.T
                ids = np.argpartition(-sims, width - 1, axis=1)[:, :width]
                ids = np.take_along_axis(ids, np.argsort(-np.take_along_axis(sims, ids, 1), axis=1), 1)
            else:
                entry = np.zeros((len(part), 1), np.int64)
                for k in range(len(self.sizes) - 1, 0, -1):
                    entry = self.beam(k, part, entry, min(4, self.sizes[k]), self.sizes[k])[0]
                ids = self.beam(0, part, entry, width, n)[0]
            out.append(np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1).astype(np.int32))
        return np.concatenate(out) if out else np.zeros((0, width), np.int32)

    def dump(self) -> bytes:
        import io

        import numpy as np

        f = io.BytesIO()
        np.savez(f, order=self.order, level=self.level, **{f"l{k}": x for k, x in enumerate(self.links)})
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes, vectors) -> "Graph":
        import io

        import numpy as np

        g, f = cls.__new__(cls), np.load(io.BytesIO(blob))
        g.order, g.level = f["order"], f["level"]
        g.v = np.ascontiguousarray(vectors[g.order], dtype=np.float32)
        g.links = [f[f"l{k}"] for k in range(len(f.files) - 2)]
        g.sizes = [len(x) for x in g.links]
        return g


def planted(vectors, count: int, least: float, seed: int = 11):
    """Unit queries that each have a link: vectors of the shard, turned in a random direction to a cosine from ``least`` up."""
    import numpy as np

    rng = np.random.default_rng(seed)
    base = vectors[rng.integers(0, len(vectors), count)]
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    size = np.sqrt((away * away).sum(1, keepdims=True))
    away = np.divide(away, size, out=np.zeros_like(away), where=size > 0)
    cos = least + (1 - least) * rng.random((count, 1)) ** 2  # most of them near the threshold, where links are hardest to find
    out = cos * base + np.sqrt(1 - cos * cos) * away
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def widened(graph: Graph, vectors, queries, least: float, same: bool) -> tuple[int, bool, float]:
    """``(beam, whole, recall)``: the first beam at which an audit passes, its recall, and whether all vectors must be looked at.

    The audit compares queries spread evenly over the block, and as many planted ones, with every vector of the shard. So
    every audit has true links, whatever the data hold; a query's own vector is none (``same``: queries and vectors are
    the same rows). A beam of a quarter of the shard that still misses links gives way to looking at every vector.
    """
    import numpy as np

    count = AUDIT // 2
    probe = np.unique(np.linspace(0, len(queries) - 1, min(count, len(queries))).astype(int))
    asked = np.concatenate([queries[probe], planted(vectors, count, least)])
    truth = asked @ vectors.T >= least
    if same:
        truth[np.arange(len(probe)), probe] = False
    width = ASK_BEAM
    while True:
        r, c = graph.ask(asked.astype(np.float32), width, least - 1e-5)
        hit = np.zeros_like(truth)
        hit[r, c] = True
        recall = (hit & truth).sum() / max(truth.sum(), 1)
        if recall >= RECALL or not truth.any():
            return width, False, float(recall)
        if 4 * width >= len(vectors):
            return width, True, 1.0
        width *= 2


def unit(rows):
    """Lists of numbers as unit vectors in double precision."""
    import numpy as np

    v = np.array(rows.tolist(), dtype=np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def thinned(v, least: float):
    """Vectors, in their order, of which none is linked to one before it that stays: a dense group keeps one of them."""
    import numpy as np

    stays = np.zeros(len(v), bool)
    for s in range(0, len(v), BATCH):
        part = v[s : s + BATCH]
        free = ~((part @ v[:s][stays[:s]].T) >= least).any(1)
        own = np.tril(part @ part.T >= least, -1)
        for k in np.flatnonzero(free):
            stays[s + k] = not (own[k] & stays[s : s + len(part)]).any()
    return v[stays]


def needed(a, b):
    """How wide two beams must be to share a router, by row; above any width where they share none."""
    import numpy as np

    far = np.int64(1) << 30
    both = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    at = np.maximum(np.arange(a.shape[1])[:, None], np.arange(b.shape[1])[None, :]) + 1
    return np.where(both, at, far).reshape(len(a), -1).min(1)


def met(v, w, least: float, same: bool):
    """Index pairs of rows of ``v`` and ``w`` at ``least`` or more, in chunks; with ``same`` each pair once."""
    import numpy as np

    for s in range(0, len(v), 512):
        x, y = np.nonzero(v[s : s + 512] @ w.T >= least)
        x += s
        if same:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 1 << 15):
            yield x[k : k + (1 << 15)], y[k : k + (1 << 15)]


def embedding_components(vectors: DataFrame, least: float = 0.9, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Equal vectors meet first and count as one node with its copies. Some nodes, as many as a multiple of the square
    root of their number and no two of them linked, are routers, over which a graph is built. Every node asks the graph for
    its nearest routers, and nodes that share a router are compared. How many routers a node is given is the least number at which
    all links of some nodes, and of as many planted vectors, share one; the beam widens until there is such a number. Only if
    a beam of a quarter of the routers has none do all nodes meet all. A router's nodes are cut into blocks that are dealt by
    hash, and each pair of blocks is a task's work. A pair is counted at the first router that it shares. Pairs too
    near the threshold for single precision are verified in double; a task returns links per node and a spanning forest.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: ``n_links`` 0,
    own component, kept. Vectors of different lengths never link. Copies link with each other and with whatever
    their vector links with. Rows with a null id are copies without a name: they count as links, get their
    class's ``n_links`` and component (null if no row of it has an id) and are not kept. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fit = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = cut(rows.withColumn("fit", fit))
    nodes = rows.where("fit").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("node", F.xxhash64("v")))
    parts = [cut(_linked(nodes.where(F.size("v") == r[0]), r[0], r[1], least, shard_rows, least_shards)) for r in nodes.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()]
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    links = parts[0]
    for part in parts[1:]:
        links = links.unionByName(part)
    roots = components(links.where("a <> b").select("a", "b"))
    named = nodes.select("node", "rep", "copies").join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").withColumn("root", F.coalesce("component", "node"))
    first = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    total = links.groupBy(F.col("a").alias("t_node")).agg(F.sum("n").alias("n"))
    known = named.join(first, "root").join(total, F.col("node") == F.col("t_node"), "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.withColumn("node", F.when(F.col("fit"), F.xxhash64("v"))).join(cut(known), "node", "left")
    comp = F.when(F.col("fit"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))


def _linked(nodes: DataFrame, dim: int, count: int, least: float, shard_rows: int, least_shards: int) -> DataFrame:
    """``(a, b, n)`` of nodes of one length: ``n`` links of ``a`` found in a task, and ``b`` of its component there."""
    import math

    import numpy as np
    import pandas as pd

    spark, margin = nodes.sparkSession, 1e-6 + 2e-7 * dim
    routers = max(1, min(count // 2, int(ROUTERS * math.sqrt(count))))
    picked = nodes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(min(count, routers + PROBES))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=pdf["node"].map(lambda x: hash((x, 1)))).sort_values(["o", "node"])
        v = unit(pdf["v"])
        apart = slice(routers if len(v) > routers else 0, None)  # no router is a probe, which would find itself
        probes = v[apart]
        asked = np.concatenate([probes, planted(probes, PROBES, least)])
        kept = thinned(v[:routers].astype(np.float32), least)
        graph = Graph(kept).build()
        beam, whole, _ = widened(graph, kept.astype(np.float64), probes, least, False)
        return pd.DataFrame({"graph": [graph.dump()], "routers": [kept.tobytes()], "asked": [asked.tobytes()], "names": [pdf["node"].to_numpy(np.int64)[apart].tobytes()], "beam": [beam], "whole": [whole]})

    built = picked.groupBy().applyInPandas(build, "graph binary, routers binary, asked binary, names binary, beam int, whole boolean").collect()[0].asDict()
    sent = spark.sparkContext.broadcast({k: bytes(x) if isinstance(x, (bytes, bytearray)) else x for k, x in built.items()})
    dealt = cut(nodes.select("node", "copies", "v").repartition(max(least_shards, -(-count // TASK_ROWS)), "node"))
    size = len(built["routers"]) // (4 * dim)

    floats = lambda column: np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)

    def route(width: int, whole: bool) -> DataFrame:
        def ask(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph = None
            for pdf in pdfs:
                graph = graph or Graph.load(sent.value["graph"], np.frombuffer(sent.value["routers"], np.float32).reshape(-1, dim))
                v = unit(pdf["v"])
                yield pd.DataFrame({"node": pdf["node"], "copies": pdf["copies"], "u": [x.tobytes() for x in v.astype(np.float32)], "cells": [x.tobytes() for x in graph.nearest(v, width, whole)]})

        return cut(dealt.mapInPandas(ask, "node long, copies long, u binary, cells binary"))

    def widths(routed: DataFrame, width: int, whole: bool) -> tuple[int, bool]:
        """The least number of routers at which the probes' links share one, and whether there is one."""

        def probe(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = np.frombuffer(sent.value["asked"], np.float64).reshape(-1, dim).astype(np.float32)
            names = np.frombuffer(sent.value["names"], np.int64)
            cells = Graph.load(sent.value["graph"], np.frombuffer(sent.value["routers"], np.float32).reshape(-1, dim)).nearest(asked, width, whole)
            for pdf in pdfs:
                u, own = floats(pdf["u"]), np.frombuffer(b"".join(pdf["cells"]), np.int32).reshape(len(pdf), -1)
                node = pdf["node"].to_numpy(np.int64)
                for x, y in met(asked, u, least + margin, False):
                    other = np.append(names, np.zeros(len(asked) - len(names), np.int64))[x] != node[y]
                    x, y = x[other | (x >= len(names))], y[other | (x >= len(names))]
                    for s in range(0, len(x), 1 << 12):
                        i, j = x[s : s + (1 << 12)], y[s : s + (1 << 12)]
                        yield pd.DataFrame({"planted": i >= len(names), "need": needed(cells[i], own[j])})

        need = pd.DataFrame(routed.mapInPandas(probe, "planted boolean, need long").groupBy("planted", "need").count().collect(), columns=["planted", "need", "n"])
        least_width = 1
        for _, part in need.groupby("planted"):
            part = part.sort_values("need")
            share = part["n"].cumsum() / part["n"].sum()
            least_width = max(least_width, int(part["need"][share >= MEET].iloc[0]))
        return least_width, least_width <= width

    width = built["beam"]
    while True:
        routed = route(min(width, size), built["whole"])
        given, enough = widths(routed, width, built["whole"])
        if enough or 4 * width >= size:
            break
        width *= 2
    given = min(width, given + given // 2)  # what the probes need and half as many again, for links that they did not see
    # where no beam is wide enough, all nodes meet in one cell
    end = 2**31 - 1  # stands for no router, and behind all routers

    def cells(pdf: pd.DataFrame):
        own = np.frombuffer(b"".join(pdf["cells"]), np.int32).reshape(len(pdf), -1)[:, :given]
        return np.sort(np.where(own < 0, end, own), axis=1) if enough else np.zeros((len(pdf), 1), np.int32)

    def counts(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            cell, n = np.unique(cells(pdf), return_counts=True)
            yield pd.DataFrame({"cell": cell, "n": n})

    def file(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_pdf in pdfs:
            for s in range(0, len(whole_pdf), 1024):
                pdf = whole_pdf[s : s + 1024]
                own = cells(pdf)
                pdf = pdf.assign(cells=[x.tobytes() for x in own])
                pdf = pdf.loc[pdf.index.repeat(own.shape[1])].assign(cell=own.ravel())
                yield pdf[pdf["cell"] < end]

    filed = routed.mapInPandas(file, "node long, copies long, u binary, cells binary, cell int")
    sizes = cut(routed.mapInPandas(counts, "cell int, n long").where(F.col("cell") < end).groupBy("cell").agg(F.sum("n").alias("n")))
    block = max(1, min(shard_rows, BLOCK_BYTES // (4 * dim)))
    large = {r[0]: -(-r[1] // block) for r in sizes.where(F.col("n") > block).collect()}
    buckets = max(least_shards, sum(sizes.selectExpr(f"n * ceil(n / {block})").groupBy().sum().collect()[0]) // BUCKET_ROWS)
    blocks = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in large.items() for x in kv)), F.col("cell")), F.lit(1)) if large else F.lit(1)
    filed = filed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    filed = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "i", "j", "own", "node"])
        v, own = floats(pdf["u"]), np.frombuffer(b"".join(pdf["cells"]), np.int32).reshape(len(pdf), -1)
        names, copies, n, unsure = pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), np.zeros(len(pdf), np.int64), []
        at = pdf[["cell", "i", "j"]].to_numpy()
        begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
        second = pdf["own"].to_numpy() == at[:, 2]

        def counted():
            for s, e in zip(begin, np.append(begin[1:], len(at)), strict=True):
                cell, same = at[s, 0], at[s, 1] == at[s, 2]
                w = s if same else s + int((~second[s:e]).sum())
                early = own[s:e, : max(1, int((own[s:e] < cell).sum(1).max()))]
                early = np.where(early < cell, early, -1)
                for x, y in met(v[s : e if same else w], v[w:e], least - margin, same):
                    y = y + (w - s)
                    # a pair counts at the first router that it shares
                    first = (early[x, 0] < 0) | (early[y, 0] < 0)
                    ask = np.flatnonzero(~first & (early[x, 0] != early[y, 0]))
                    for k in range(0, len(ask), 1 << 12):
                        k = ask[k : k + (1 << 12)]
                        first[k] = needed(early[x[k]], early[y[k]]) > early.shape[1]
                    x, y = x[first] + s, y[first] + s
                    sure = np.einsum("ij,ij->i", v[x], v[y]) >= least + margin
                    unsure.append((names[x[~sure]], names[y[~sure]]))
                    x, y = x[sure], y[sure]
                    np.add.at(n, x, copies[y])
                    np.add.at(n, y, copies[x])
                    yield x, y

        label = local_forest(len(names), counted())
        keep = n > 0
        made = [pd.DataFrame({"a": names[keep], "b": names[label[keep]], "n": n[keep], "sure": True})]
        made += [pd.DataFrame({"a": a, "b": b, "n": np.zeros(len(a), np.int64), "sure": False}) for a, b in unsure if len(a)]
        return pd.concat(made)

    bucket = F.pmod(F.xxhash64("cell", "i", "j"), F.lit(int(buckets))).cast("int")
    found = cut(filed.drop("other", "blocks").groupBy(bucket).applyInPandas(compare, "a long, b long, n long, sure boolean"))

    def verify(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                pdf = pdf[(unit(pdf["va"]) * unit(pdf["vb"])).sum(1) >= least]
                yield pd.DataFrame({"a": np.append(pdf["a"], pdf["b"]), "b": np.append(pdf["b"], pdf["a"]), "n": np.append(pdf["cb"], pdf["ca"])})

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("v").alias(f"v{x}"), F.col("copies").alias(f"c{x}"))
    near = found.where("NOT sure").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return found.where("sure").select("a", "b", "n").unionByName(near.mapInPandas(verify, "a long, b long, n long"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.vec_id = l.a),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = c.vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
