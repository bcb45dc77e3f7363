"""Nearest neighbours by inner product: a navigable small-world graph per shard, results merged.

Vectors get one more component so that their lengths agree; then the nearest by Euclidean distance
are those of the largest inner product. Equal vectors are one node of a graph, with the smallest
ids that can be asked for, so that repeated rows neither crowd a graph nor hide one another.
Graphs are arrays of neighbours of fixed width, a row of -1 padded numbers for each node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table


def _distances(points: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances, less each query's own square, from each row of q to the points of its row of ids."""
    return norms[ids] - 2 * np.matmul(points[ids], q[:, :, None])[:, :, 0]


def search_layer(points: np.ndarray, norms: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of a batch in step: ids (-1 padded) and distances of the ef nearest, ascending."""
    n = len(q)
    beam = np.full((n, ef), -1, dtype=np.int64)
    dist = np.full((n, ef), np.inf, dtype=np.float32)
    done = np.ones((n, ef), dtype=bool)
    seen = np.zeros((n, len(points) + 1), dtype=bool)  # the last column stands for -1
    k = min(entry.shape[1], ef)
    beam[:, :k], done[:, :k] = entry[:, :k], entry[:, :k] < 0
    dist[:, :k] = np.where(entry[:, :k] >= 0, _distances(points, norms, q, entry[:, :k]), np.inf)
    np.put_along_axis(seen, entry[:, :k], True, axis=1)
    seen[:, -1] = True
    live = np.arange(n)
    while len(live):
        d = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(d, min(width, ef - 1), axis=1)[:, :width]
        open_ = np.isfinite(np.take_along_axis(d, pick, 1))
        some = open_.any(1)
        live, pick, open_ = live[some], pick[some], open_[some]
        if not len(live):
            break
        nodes = np.where(open_, np.take_along_axis(beam[live], pick, 1), -1)
        done[live[:, None], pick] = True
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1).astype(np.int64)
        near.sort(axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        most = int(fresh.sum(1).max())
        if not most:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        near = np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(near, order, 1), -1)
        found = np.where(near >= 0, _distances(points, norms, q[live], near), np.inf)
        all_d = np.concatenate([dist[live], found], axis=1)
        all_i = np.concatenate([beam[live], near], axis=1)
        all_f = np.concatenate([done[live], near < 0], axis=1)
        keep = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        dist[live] = np.take_along_axis(all_d, keep, 1)
        beam[live] = np.take_along_axis(all_i, keep, 1)
        done[live] = np.take_along_axis(all_f, keep, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(beam, order, 1), np.take_along_axis(dist, order, 1)


def select(points: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted by true squared distance, those nearer to the base than to any chosen
    before; places left over go to the nearest passed over. Rows of -1 padded ids."""
    n, c = ids.shape
    v = points[ids]
    sq = np.einsum("ncd,ncd->nc", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((n, c), dtype=bool)
    count = np.zeros(n, dtype=int)
    for j in range(c):
        blocked = ((between[:, j, :] < dist[:, j, None]) & chosen).any(1)
        take = (ids[:, j] >= 0) & ~blocked & (count < most)
        chosen[:, j] = take
        count += take
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)


class Graph:
    """Layers from the lowest: node numbers, and links between them as numbers within the layer."""

    def __init__(self, points: np.ndarray, m: int = 16, ef: int = 80, batch: int = 256, seed: int = 7):
        self.points = np.ascontiguousarray(points, dtype=np.float32)
        n = len(points)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(int), 12)
        top = int(levels.max()) if n else 0
        self.nodes = [np.flatnonzero(levels >= level) for level in range(top + 1)]
        self.links = [np.zeros((0, 0), dtype=np.int32)] * (top + 1)
        for level in range(top, -1, -1):
            self.links[level] = self._layer(level, 2 * m if level == 0 else m, m, ef, batch)

    def _entry(self, level: int, q: np.ndarray) -> np.ndarray:
        """The nearest node of the layer above, as a number within this layer."""
        if level + 1 >= len(self.nodes):
            return np.zeros((len(q), 1), dtype=np.int64)
        found, _ = self._descend(q, level + 1, 4)
        return np.searchsorted(self.nodes[level], self.nodes[level + 1][found])

    def _descend(self, q: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        p = self.points[self.nodes[level]]
        return search_layer(p, np.einsum("nd,nd->n", p, p), self.links[level], q, self._entry(level, q), ef)

    def _layer(self, level: int, degree: int, m: int, ef: int, batch: int) -> np.ndarray:
        """Links nodes in batches: each batch searches what is linked already, and itself by brute force."""
        p = self.points[self.nodes[level]]
        norms = np.einsum("nd,nd->n", p, p)
        n = len(p)
        links = np.full((n, degree), -1, dtype=np.int32)
        # the layer above is a subset: its nodes come first, so that every entry is linked already
        upper = np.searchsorted(self.nodes[level], self.nodes[level + 1]) if level + 1 < len(self.nodes) else np.zeros(min(n, 1), dtype=np.int64)
        rest = np.setdiff1d(np.arange(n), upper)
        order = np.concatenate([upper, rest])
        linked = 0
        while linked < n:
            size = 1 if linked == 0 else min(batch, max(1, linked), n - linked)
            new = order[linked : linked + size]
            q = p[new]
            within = np.broadcast_to(new, (size, size)).copy()
            within[np.arange(size), np.arange(size)] = -1
            parts, dists = [within], [np.where(within >= 0, norms[within] - 2 * (q @ q.T), np.inf)]
            if linked:
                entry = self._entry(level, q)
                inside = np.zeros(n, dtype=bool)
                inside[order[:linked]] = True
                entry = np.where(inside[entry], entry, order[0])
                found, d = search_layer(p, norms, links, q, entry, min(ef, max(linked, 1)))
                parts.append(found)
                dists.append(d)
            ids, d = np.concatenate(parts, 1), np.concatenate(dists, 1)
            best = np.argsort(d, axis=1, kind="stable")[:, : ef]
            ids, d = np.take_along_axis(ids, best, 1), np.take_along_axis(d, best, 1) + norms[new][:, None]
            ids = np.where(np.isfinite(d), ids, -1)
            mine = select(p, ids, d, m)
            links[new, : mine.shape[1]] = mine
            self._link_back(p, norms, links, new, mine, degree)
            linked += size
        return links

    @staticmethod
    def _link_back(p: np.ndarray, norms: np.ndarray, links: np.ndarray, new: np.ndarray, mine: np.ndarray, degree: int) -> None:
        to, source = mine.ravel(), np.repeat(new, mine.shape[1])
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        has = (links[nodes] >= 0).sum(1)
        fits = has + count <= degree
        slot = has[np.repeat(np.arange(len(nodes)), count)] + np.arange(len(to)) - np.repeat(first, count)
        easy = np.repeat(fits, count)
        links[to[easy], slot[easy]] = source[easy]
        for part in np.array_split(np.flatnonzero(~fits), max(1, math.ceil((~fits).sum() / 256))):
            if not len(part):
                continue
            wide = np.full((len(part), degree + int(count[part].max())), -1, dtype=np.int64)
            wide[:, :degree] = links[nodes[part]]
            for i, x in enumerate(part):
                wide[i, degree : degree + count[x]] = source[first[x] : first[x] + count[x]]
            base = p[nodes[part]]
            d = np.where(wide >= 0, norms[wide] - 2 * np.matmul(p[wide], base[:, :, None])[:, :, 0] + norms[nodes[part]][:, None], np.inf)
            by = np.argsort(d, axis=1, kind="stable")[:, : degree + 16]
            kept = select(p, np.take_along_axis(wide, by, 1), np.take_along_axis(d, by, 1), 3 * degree // 4)
            links[nodes[part]] = -1
            links[nodes[part], : kept.shape[1]] = kept

    def search(self, q: np.ndarray, ef: int, batch: int = 256) -> np.ndarray:
        """Node numbers (-1 padded) of about the ef nearest for each query."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        out = [self._descend(q[i : i + batch], 0, ef)[0] for i in range(0, len(q), batch)]
        return np.concatenate(out) if out else np.zeros((0, ef), dtype=np.int64)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    more = np.sqrt(np.maximum(longest**2 - np.einsum("nd,nd->n", x, x), 0))
    return np.concatenate([x, more[:, None]], axis=1)


def _sound(rows: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    """Ids and vectors (as doubles) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias(name), x.alias("x")).where(F.col(name).isNotNull() & finite & F.exists("x", lambda v: v != 0))


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """One row per distinct vector that takes part: x (doubles) and its k + 1 smallest ids.

    Of a vector that very many rows have, each task passes on its k + 1 smallest ids alone, which is
    all that an answer of k can name.
    """
    rows = _sound(vectors, id_col, vector_col, "id")
    rows = rows.withColumn("h", F.xxhash64("x"))
    least = rows.withColumn("rn", F.row_number().over(Window.partitionBy("h", "x").orderBy("id"))).where(F.col("rn") <= k + 1)
    return least.groupBy("h", "x").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("x"))


def build(nodes: DataFrame, shards: int, *, m: int, ef: int, chunk: int = 4096) -> DataFrame:
    """Graphs as rows: for each shard (of one dimension) chunks of nodes with their layer's links."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        dim, shard = key
        part = part.sort_values("h", kind="stable")
        x = np.stack(part["x"].to_numpy())
        longest = float(np.sqrt(np.einsum("nd,nd->n", x, x).max()))
        g = Graph(_lifted(x, longest), m=m, ef=ef)
        out = []
        for level, (nodes_, links) in enumerate(zip(g.nodes, g.links, strict=True)):
            for i in range(0, len(nodes_), chunk):
                own = nodes_[i : i + chunk]
                out.append((dim, shard, level, i, own.astype("<i4").tobytes(), links[i : i + chunk].astype("<i4").tobytes(), links.shape[1], x[own].astype("<f8").tobytes() if level == 0 else b"", [list(map(int, v)) for v in part["ids"].iloc[own]] if level == 0 else []))
        return pd.DataFrame(out, columns=["dim", "shard", "level", "at", "nodes", "links", "width", "x", "ids"])

    schema = "dim int, shard int, level int, at int, nodes binary, links binary, width int, x binary, ids array<array<long>>"
    return nodes.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(run, schema)


def load(rows: pd.DataFrame) -> tuple[Graph, np.ndarray, list]:
    """The graph of one shard from its rows, its vectors and ids."""
    rows = rows.sort_values(["level", "at"])
    g = Graph.__new__(Graph)
    g.nodes, g.links = [], []
    dim = int(rows["dim"].iloc[0])
    for _, level in rows.groupby("level"):
        g.nodes.append(np.frombuffer(b"".join(level["nodes"]), dtype="<i4").astype(np.int64))
        g.links.append(np.frombuffer(b"".join(level["links"]), dtype="<i4").reshape(-1, int(level["width"].iloc[0])))
    base = rows[rows["level"] == 0]
    x = np.frombuffer(b"".join(base["x"]), dtype="<f8").reshape(-1, dim)
    g.points = _lifted(x, float(np.sqrt(np.einsum("nd,nd->n", x, x).max()))).astype(np.float32)
    return g, x, [ids for chunk in base["ids"] for ids in chunk]


def search(graphs: DataFrame, queries: DataFrame, shards: int, blocks: int, *, k: int, ef: int) -> DataFrame:
    """Each block of queries against each shard; then the k best of each query over its shards."""

    def run(key: tuple, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(graph) or not len(asked):
            return pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0)})
        g, x, ids = load(graph)
        out = []
        for i in range(0, len(asked), 1024):
            q = np.stack(asked["x"].iloc[i : i + 1024].to_numpy())
            found = g.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1), max(ef, k + 1))
            for row, own, v in zip(found, asked["query_id"].iloc[i : i + 1024], q, strict=True):
                row = row[row >= 0]
                score = (x[row] * v).sum(axis=1)
                best = []
                for j in np.argsort(-score, kind="stable"):
                    if len(best) > k and score[j] < best[k][0] * -1:
                        break
                    best += [(-score[j], c) for c in ids[row[j]]]
                    best.sort()
                mine = (-float((v * v).sum()), own)
                at = next((n for n, (s, c) in enumerate(best) if c == own and np.isclose(s, mine[0])), None)
                if at is not None:
                    del best[at]
                out += [(own, c, -s) for s, c in best[:k]]
        return pd.DataFrame(out, columns=columns)

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = queries.select("query_id", "x", F.size("x").alias("dim"), block.alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("dim", "shard", "block")
    hits = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, m: int = 16, ef_build: int = 80, ef: int = 240, shard_rows: int = 20_000, least_shards: int = 6, block_rows: int = 100_000) -> DataFrame:
    """For each query its k nearest rows by inner product, its own row left out: query_id, rank, vec_id, score.

    Vectors that are null, zero or have null or non-finite components take no part, nor do rows
    without an id; vectors meet only those of their own dimension. Ties go to the smaller id. A
    query that occurs twice with one vector is asked once. Recall falls with the size of a shard and
    rises with ``ef``, so shards are kept small. Shards and blocks have a bounded number
    of rows, however many there are; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    nodes = scratch.put(nodes_of(vectors, id_col, vector_col, k), "nodes")
    shards = max(least_shards, math.ceil(nodes.count() / shard_rows))
    graphs = scratch.put(build(nodes, shards, m=m, ef=ef_build), "graphs")
    asked = scratch.put(asked_of(queries, id_col, vector_col), "queries")
    blocks = max(1, math.ceil(asked.count() / block_rows))
    return search(graphs, asked, shards, blocks, k=k, ef=ef)


def asked_of(queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return _sound(queries, id_col, vector_col, "query_id").distinct()


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all; odd rows as ``nearest`` says."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
