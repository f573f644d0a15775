"""Embedding near-duplicates by navigable small-world graphs, one hierarchy for each shard.

1. Equal vectors of a label are one class with a number of its own; only classes are compared, ids come back last.
2. A label's classes are dealt to shards by the nearest of some of its own vectors (pivots), about CAPACITY to a
   shard; shards that are still too large are cut by a hash. A pair within the threshold lies close together, so
   each end is nearer than the threshold's distance to the plane between both ends' pivots: every shard that can
   hold a neighbour is queried, the rest are proven not to. One of two shards, by a fixed rule, visits the other.
3. Each shard builds its graph in one task, with bounded rows, and audits it: the beam doubles until a sample of its
   own vectors finds the target share of what brute force finds. Only where no beam below the shard's size
   passes are all rows compared (`exhausted` in small_worlds). All members then query the graph; a pair found
   from either end counts for both. Graphs that have visitors are written as rows of a table, so a lost
   executor costs no second build.
4. Visitors query the other shards' graphs in blocks. A query whose beam ends inside the threshold goes on over
   the graph's links from all that it found, until nothing new lies within. Cosines are verified in double
   precision; sums by class and links to groups inside the shard go out, never all pairs of a group.

Vectors that are null, empty, zero or hold null or non-finite parts, and those without a label, link with
nothing. Vectors of different lengths are never compared: label and length together are the group. Repeated
rows are members of a class, each a vector of its own to the others; rows that share an id but not a vector are told apart. Rows
without an id count as links of others; their component is the smallest id they reach, else null. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_table, table
from .components import components

COSINE, CAPACITY, BLOCK, PIVOTS, PIVOT_BYTES = 0.93, 4096, 16_384, 16_384, 1 << 26
DEGREE, BEAM, WIDEN, AUDIT, RECALL, NEAREST, STEP = 12, 16, 5, 128, 0.999, 0.95, 512
#: Queries go on to rows this far below the threshold, so that a link just outside doesn't end the way.
SLACK = 0.02


def _once(rows: np.ndarray) -> np.ndarray:
    """Each row sorted, with -1 for what it names twice."""
    rows = np.sort(rows, 1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
    return rows


class Graph:
    """A hierarchical navigable small-world graph over unit vectors.

    Level 0 holds all rows, each further level a random 1/16 of the one below. Rows come in batches that double
    the graph; a batch searches the graph so far for its neighbours, and adds those within the batch itself.
    Searches of many queries run side by side as array operations; -1 stands for no row.
    """

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = 24, seed: int = 7):
        self.x, self.beam = x.astype(np.float32), beam
        n = len(x)
        rng = np.random.default_rng(seed)
        height = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(16)).astype(int), 4)
        order = np.lexsort((np.arange(n), -height))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(int(height.max(initial=0)), -1, -1):
            members = order[height[order] >= level]
            self.levels.append((members.astype(np.int32), self._build(members, degree * (2 if level == 0 else 1)).astype(np.int32)))

    def body(self) -> list:
        return self.levels

    @classmethod
    def of(cls, x: np.ndarray, body: list) -> Graph:
        graph = cls.__new__(cls)
        graph.x, graph.beam, graph.levels = x.astype(np.float32), BEAM, body
        return graph

    def _build(self, members: np.ndarray, degree: int) -> np.ndarray:
        """Neighbour lists (positions in members); reverse links keep the nearest ones."""
        n, x = len(members), self.x[members]
        links = np.full((n, degree), -1, np.int64)
        sims = np.full((n, degree), -2, np.float32)
        done = min(n, 4 * degree)
        self._join(x, links, sims, np.arange(done), np.zeros((done, 0), np.int64), degree)
        while done < n:
            new = np.arange(done, min(n, 2 * done, done + 1024))
            near, _ = self._search(x, links, x[new], self._entries(done, len(new)), self.beam)
            self._join(x, links, sims, new, near, degree)
            done += len(new)
        for _ in range(4):  # a row that no link leads to takes the last place of its nearest one
            lost = np.flatnonzero(np.bincount(links[links >= 0], minlength=n) == 0)
            lost = lost[links[lost, 0] >= 0]
            links[links[lost, 0], -1] = lost
        return links

    @staticmethod
    def _entries(n: int, queries: int) -> np.ndarray:
        start = np.unique(np.linspace(0, n - 1, 8).astype(np.int64))
        return np.repeat(start[None], queries, 0)

    @staticmethod
    def _diverse(x: np.ndarray, near: np.ndarray, sim: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the candidates (best first) those nearer to the row than to any chosen before, then the best others."""
        if near.shape[1] <= degree:
            return near, sim
        chosen = np.zeros(near.shape, bool)
        v = x[np.maximum(near, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        closest = np.full(near.shape, -2, np.float32)
        for k in range(near.shape[1]):
            take = (near[:, k] >= 0) & (closest[:, k] < sim[:, k])
            chosen[:, k] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, k]), closest)
        rank = np.argsort(np.where(near < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :degree]
        return np.take_along_axis(near, rank, 1), np.take_along_axis(sim, rank, 1)

    def _join(self, x, links, sims, new, near, degree) -> None:
        inside = x[new] @ x[new].T
        np.fill_diagonal(inside, -2)
        k = min(2 * degree, len(new) - 1)
        if k > 0:
            best = np.argpartition(-inside, k - 1, axis=1)[:, :k]
            near = np.concatenate([near, new[best]], 1)
        if not near.shape[1]:
            return
        sim = np.where(near < 0, -2, np.einsum("qd,qcd->qc", x[new], x[np.maximum(near, 0)]))
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 3 * degree]
        mine, mine_sim = self._diverse(x, np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1), degree)
        links[new, : mine.shape[1]], sims[new, : mine.shape[1]] = mine, np.where(mine < 0, -2, mine_sim)
        to, of, s = mine.reshape(-1), np.repeat(new, mine.shape[1]), mine_sim.reshape(-1)
        ok = to >= 0
        to, of, s = to[ok], of[ok], s[ok]
        # reverse links: the nearest offers to a row compete with what it has
        touched, where = np.unique(to, return_inverse=True)
        many = np.bincount(where, minlength=len(touched))
        width = min(int(many.max(initial=0)), 2 * degree)
        rank = np.lexsort((-s, where))
        place = np.arange(len(rank)) - np.repeat(np.cumsum(many) - many, many)
        fits = place < width
        offers = np.full((len(touched), width), -1, np.int64)
        offer_sims = np.full((len(touched), width), -2, np.float32)
        offers[where[rank][fits], place[fits]] = of[rank][fits]
        offer_sims[where[rank][fits], place[fits]] = s[rank][fits]
        for a in range(0, len(touched), 1024):
            rows = touched[a : a + 1024]
            both = np.concatenate([links[rows], offers[a : a + 1024]], 1)
            both_sims = np.concatenate([sims[rows], offer_sims[a : a + 1024]], 1)
            order = np.lexsort((both, -both_sims), axis=1)
            both, both_sims = np.take_along_axis(both, order, 1), np.take_along_axis(both_sims, order, 1)
            repeat = np.zeros(both.shape, bool)
            repeat[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)
            both, both_sims = np.where(repeat, -1, both), np.where(repeat, -2, both_sims)
            kept, kept_sims = self._diverse(x, both, both_sims, degree)
            links[rows, : kept.shape[1]], sims[rows, : kept.shape[1]] = kept, np.where(kept < 0, -2, kept_sims)

    @staticmethod
    def _search(x, links, queries, entries, beam) -> tuple[np.ndarray, np.ndarray]:
        """Best-first beam search of all queries at once: positions and cosines, best first, -1 where none."""
        q, n = len(queries), len(x)
        seen = np.zeros((q, n + 1), bool)
        seen[:, -1] = True  # -1, no row, is never new
        width = min(beam, n)
        near = np.full((q, width), -1, np.int64)
        sim = np.full((q, width), -2, np.float32)
        open_ = np.zeros((q, width), bool)
        fresh, active = _once(entries.astype(np.int64)), np.arange(q)
        while True:
            # only rows that are new to their query are compared with it
            at, col = np.nonzero(~seen[active[:, None], fresh])
            to = fresh[at, col]
            seen[active[at], to] = True
            is_new = np.zeros(fresh.shape, bool)
            is_new[at, col] = True
            fresh_sim = np.full(fresh.shape, -2, np.float32)
            fresh_sim[at, col] = np.einsum("nd,nd->n", queries[active[at]], x[to])
            both = np.concatenate([near[active], np.where(is_new, fresh, -1)], 1)
            both_sim = np.concatenate([sim[active], fresh_sim], 1)
            both_open = np.concatenate([open_[active], is_new], 1)
            order = np.argsort(-both_sim, axis=1, kind="stable")[:, :width]
            near[active], sim[active] = np.take_along_axis(both, order, 1), np.take_along_axis(both_sim, order, 1)
            open_[active] = np.take_along_axis(both_open, order, 1)
            active = active[open_[active].any(1)]
            if not len(active):
                return near, sim
            # expand the three best open ones of each query
            o, every = open_[active], np.arange(len(active))
            steps = []
            for _ in range(3):
                best = o.argmax(1)
                have = o[every, best]
                o[every, best] = False
                steps.append(np.where(have[:, None], links[np.maximum(near[active, best], 0)], -1))
            open_[active] = o
            fresh = _once(np.concatenate(steps, 1).astype(np.int64))

    def search(self, queries: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and cosines of up to `beam` nearest rows for each query; `own`: rows to start from as well."""
        queries = queries.astype(np.float32)
        entries = None
        for depth, (members, links) in enumerate(self.levels):
            last = depth == len(self.levels) - 1
            place = np.full(len(self.x) + 1, -1, np.int64)
            place[members] = np.arange(len(members))
            start = self._entries(len(members), len(queries))
            if entries is not None:
                start = np.concatenate([start, place[entries]], 1)
            if last and own is not None:
                start = np.concatenate([start, place[own][:, None]], 1)
            near, sim = self._search(self.x[members], links, queries, start, beam if last else 8)
            entries = np.where(near >= 0, members[np.maximum(near, 0)], -1)
        return entries, sim

    def spread(self, queries: np.ndarray, near: np.ndarray, sim: np.ndarray, bound: float) -> np.ndarray:
        """For each query (rows of the result) the rows of at least `bound` that links lead to from those in `near`
        over rows of at least `bound`."""
        members, links = self.levels[-1]
        place = np.full(len(self.x) + 1, -1, np.int64)
        place[members] = np.arange(len(members))
        x, queries = self.x[members], queries.astype(np.float32)
        n = len(members)
        # links count both ways here: a row that others crowded out of its neighbours' lists still leads to them
        order = np.argsort(links, axis=None, kind="stable")
        back, ptr = order // links.shape[1], np.searchsorted(links.reshape(-1)[order], np.arange(n + 1))
        inside, seen = np.zeros((len(queries), n), bool), np.zeros((len(queries), n), bool)
        at, col = np.nonzero((near >= 0) & (sim >= bound))
        row = place[near[at, col]]
        inside[at, row] = seen[at, row] = True
        while len(at):
            offered = np.zeros((len(queries), n + 1), bool)
            offered[at[:, None], links[row]] = True
            many = ptr[row + 1] - ptr[row]
            offered[np.repeat(at, many), back[np.repeat(ptr[row] + many - np.cumsum(many), many) + np.arange(many.sum())]] = True
            at, row = np.nonzero(offered[:, :n] & ~seen)
            seen[at, row] = True
            ok = np.concatenate([np.einsum("nd,nd->n", queries[at[a : a + 65_536]], x[row[a : a + 65_536]]) >= bound for a in range(0, len(at), 65_536)] or [np.zeros(0, bool)])
            at, row = at[ok], row[ok]
            inside[at, row] = True
        found = np.zeros((len(queries), len(self.x)), bool)
        found[:, members] = inside
        return found


def within(graph: Graph, x: np.ndarray, queries: np.ndarray, beam: int, cosine: float, own: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query its distinct rows with a cosine (in double precision) of at least `cosine`: those in its beam, and
    where the beam ends inside the threshold those that links lead to from there. A beam of all rows compares all."""
    found: list[np.ndarray] = []
    for a in range(0, len(queries), STEP):
        asked = queries[a : a + STEP]
        if beam >= len(x):
            found += [np.flatnonzero(row) for row in asked @ x.T >= cosine]
            continue
        near, sim = graph.search(asked, beam, None if own is None else own[a : a + STEP])
        rows = [np.unique(r[(r >= 0) & (s >= cosine - 1e-4)]) for r, s in zip(near, sim)]
        full = np.flatnonzero(sim[:, -1] >= cosine - SLACK)
        for b in range(0, len(full), 64):
            part = full[b : b + 64]
            for i, row in zip(part, graph.spread(asked[part], near[part], sim[part], cosine - SLACK)):
                rows[i] = np.flatnonzero(row)
        found += [r[x[r] @ q >= cosine] if len(r) else r for r, q in zip(rows, asked)]
    return found


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each row's group (its smallest row) once the rows i and j are linked as well."""
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def audited(graph: Graph, x: np.ndarray, cosine: float, members: bool, recall: float = RECALL, sample: int = AUDIT) -> tuple[int, float]:
    """The beam at which `recall` of what brute force finds within the threshold for a sample of rows is found and, for a
    share of NEAREST, four rows as near as the four nearest; and the recall found. `members`: rows start from themselves,
    as the shard's own do, else as visitors must. A beam of len(x) compares all rows: the resort where WIDEN doublings don't pass."""
    rows, beam = np.unique(np.linspace(0, len(x) - 1, sample).astype(int)), BEAM
    top = x[rows] @ x.T
    top[np.arange(len(rows)), rows] = -2  # to find itself proves nothing
    truth = [np.flatnonzero(t >= cosine) for t in top]
    nearest = -np.partition(-top, 3, axis=1)[:, 3] if len(x) > 3 else np.full(len(rows), -2.0)
    own = rows if members else None
    while beam < min(len(x), BEAM << WIDEN):
        got = within(graph, x, x[rows], beam, cosine, own)
        share = sum(len(np.intersect1d(a, b)) for a, b in zip(got, truth)) / max(sum(map(len, truth)), 1)
        close = np.mean(graph.search(x[rows], beam, own)[1][:, 4] >= nearest - 0.01)  # says more where few are within
        if (share >= recall or not any(map(len, truth))) and close >= NEAREST:
            return beam, float(share)
        beam *= 2
    return max(beam, len(x)), 1.0


def _unit(values: pa.ChunkedArray) -> np.ndarray:
    values = values.combine_chunks()
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def class_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, grp (label and length; null for vectors that link with nothing) and print, two hashes of the vector."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))
    grp = F.when(usable, F.concat_ws("/", F.col("label").cast("string"), F.size(e).cast("string")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), grp.alias("grp"), F.when(usable, e).alias("embedding"))
    return out.withColumn("print", F.struct(F.xxhash64(F.lit(1), "embedding").alias("a"), F.xxhash64(F.lit(2), "embedding").alias("b")))


def visits_first(a, b):
    """Which of two shards (or cuts of one) visits the other: true one way round, spread evenly."""
    return (a < b) == ((a + b) % 2 == 0)


def pivot_vectors(classes: DataFrame, capacity: int) -> dict[str, np.ndarray]:
    """Unit pivots of each group with more than `capacity` classes, chosen by hash, about one for each `capacity`. PIVOTS
    and PIVOT_BYTES bound what reaches the driver and is broadcast; beyond that shards grow and are cut."""
    counts = classes.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"))
    total, d = counts.agg(F.sum("n"), F.max("d")).first()
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * (d or 1))))
    each = max(capacity, math.ceil((total or 0) / most))
    share = F.pmod(F.xxhash64("cls", F.lit(41)), F.lit(1 << 30))
    large = counts.where(F.col("n") > each).select("grp")  # most / 2 rows at most
    chosen = classes.join(large, "grp", "left_semi").where(share < (1 << 30) / each).select("grp", "embedding", share.alias("_at")).orderBy("_at", "grp").limit(2 * most).toArrow()
    groups = np.array(chosen["grp"].to_pylist(), object)
    return {g: _unit(chosen["embedding"].filter(pa.array(groups == g))) for g in sorted(set(groups))}


def routed(classes: DataFrame, pivots: dict[str, np.ndarray], cosine: float) -> DataFrame:
    """classes with `home`, the shard of the nearest pivot, and `visits`, the other shards it must ask."""
    if not pivots:
        return classes.select("grp", "cls", "size", "embedding", F.lit(0).alias("home"), F.array().cast("array<int>").alias("visits"))
    held = classes.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES twice at most
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    thin = classes.select("grp", "cls", "size", "embedding")

    def route(batches):
        for batch in batches:
            home, visits = np.zeros(batch.num_rows, np.int32), [[]] * batch.num_rows
            groups = np.array(batch.column(0).to_pylist(), object)
            for g in set(groups) & held.value.keys():
                p = held.value[g]
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0)) if len(p) <= 2048 else None
                rows = np.flatnonzero(groups == g)
                for at in np.array_split(rows, -(-len(rows) * len(p) // (1 << 21))):
                    dots = _unit(pa.chunked_array([batch.column(3).take(pa.array(at))])) @ p.T
                    own = dots.argmax(1)
                    gap = apart[own] if apart is not None else np.linalg.norm(p[None] - p[own][:, None], axis=2)
                    ask = (dots[np.arange(len(at)), own][:, None] - dots <= reach * gap + 1e-9) & visits_first(own[:, None], np.arange(len(p))[None])
                    ask[np.arange(len(at)), own] = False
                    home[at] = own
                    for i, row in zip(at, ask):
                        visits[i] = np.flatnonzero(row).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "home", "visits"])

    return thin.mapInArrow(route, f"grp string, cls long, size long, embedding {dict(thin.dtypes)['embedding']}, home int, visits array<int>")


SHARD = ("grp", "home", "cut")
_GRAPH = "grp string, home int, cut int, members long, beam int, recall double, exhausted boolean, graph binary, cls long, links long, root long"


def small_worlds(members: DataFrame, cosine: float, visited: bool) -> DataFrame:
    """From (grp, home, cut, cls, size, embedding), for each shard one row with its graph (written out only where it is
    `visited`), its beam and audited recall, and for each member with a link (cls) the vectors linked to it
    inside the shard and a class (root) that stands for its group there."""

    def built(key, t):
        x, cls, size = _unit(t["embedding"]), t["cls"].to_numpy(), t["size"].to_numpy()
        n, graph = len(x), Graph(x)
        beam, recall = audited(graph, x, cosine, members=True)
        body, ask = None, 0
        if visited:
            ask, least = audited(graph, x, cosine, members=False)
            recall = min(recall, least)
            raw = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            body = pickle.dumps((cls, size, raw, graph.body(), ask), protocol=5)
        pair = np.zeros((n, n), bool)  # a shard is bounded, and so is this
        for a in range(0, n, STEP):
            for i, f in enumerate(within(graph, x, x[a : a + STEP], beam, cosine, np.arange(a, min(a + STEP, n))), a):
                pair[i, f] = True
        root, links = np.arange(n), np.zeros(n, np.int64)
        for a in range(0, n, STEP):  # a pair found from either end is one
            both = pair[a : a + STEP] | pair[:, a : a + STEP].T
            both[np.arange(len(both)), np.arange(a, a + len(both))] = False
            links[a : a + STEP] = both @ size.astype(np.float64)
            i, j = np.nonzero(both)
            root = merged(root, i + a, j) if len(i) else root
        hit = np.flatnonzero(links)
        none = [None] * len(hit)
        own = [[k.as_py()] * (1 + len(hit)) for k in key]
        columns = (*own, [n, *none], [max(beam, ask), *none], [recall, *none], [max(beam, ask) >= n > BEAM, *none], [body, *none], [None, *cls[hit]], [None, *links[hit]], [None, *cls[root[hit]]])
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _GRAPH.split(", ")])

    return members.select(*SHARD, "cls", "size", "embedding").groupBy(*SHARD).applyInArrow(built, _GRAPH)


def visiting_links(graphs: DataFrame, visitors: DataFrame, cosine: float) -> DataFrame:
    """cls, links and root of visitors (grp, home, cut, cls, size, embedding) and of the members they link with."""
    sizes = visitors.groupBy(*SHARD).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = visitors.join(sizes, [*SHARD]).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(47)), F.col("blocks")).cast("int")).drop("blocks")
    copies = graphs.join(sizes, [*SHARD]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def linked(left, right):
        cls, size, raw, body, beam = pickle.loads(left["graph"][0].as_py())
        x = raw.astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        graph, n, m = Graph.of(x, body), len(x), right.num_rows
        q, weight = _unit(right["embedding"]), right["size"].to_numpy()
        root, links = np.arange(n + m), np.zeros(n + m, np.int64)
        for a in range(0, m, STEP):  # what a step finds is folded into counts and groups at once
            found = within(graph, x, q[a : a + STEP], beam, cosine)
            for i, f in enumerate(found, a):
                links[n + i] = size[f].sum()
                links[f] += weight[i]
            who = np.repeat(np.arange(a, a + len(found)), [len(f) for f in found])
            if len(who):
                root = merged(root, n + who, np.concatenate(found))
        every, hit = np.concatenate([cls, right["cls"].to_numpy()]), np.flatnonzero(links)
        return pa.table([pa.array(c, pa.int64()) for c in (every[hit], links[hit], every[root[hit]])], names=["cls", "links", "root"])

    keys = [*SHARD, "block"]
    return copies.select(*keys, "graph").groupBy(*keys).cogroup(asked.select(*keys, "cls", "size", "embedding").groupBy(*keys)).applyInArrow(linked, "cls long, links long, root long")


def crossing_cuts(a: Column, cuts: Column) -> Column:
    """The cuts of its own shard that a member of cut a visits."""
    return F.filter(F.sequence(F.lit(0), cuts - 1), lambda b: (b != a) & visits_first(a, b))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, capacity: int = CAPACITY) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label); the module says what of."""
    rows = stage_table(class_vectors(vectors), "hnsw-rows")
    known = rows.where(F.col("grp").isNotNull()).groupBy("grp", "print").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    classes = stage_table(known.withColumn("cls", F.monotonically_increasing_id()), "hnsw-classes")
    pivots = pivot_vectors(classes, capacity)
    placed = stage_table(routed(classes, pivots, cosine), "hnsw-routes") if pivots else routed(classes, pivots, cosine)
    loads = placed.groupBy("grp", "home").agg(F.ceil(F.count("*") / (2 * capacity)).cast("int").alias("cuts"))
    members = placed.join(loads, ["grp", "home"]).withColumn("cut", F.pmod(F.xxhash64("cls", F.lit(43)), F.col("cuts")).cast("int"))
    visited = loads.where("cuts > 1").limit(1).count() > 0 or bool(pivots)
    worlds = stage_table(small_worlds(members, cosine, visited), "hnsw-graphs")
    found = worlds.where("cls is not null").select("cls", "links", "root")
    if visited:
        thin = ["grp", "cls", "size", "embedding"]
        away = placed.select(*thin, F.explode("visits").alias("home")).join(loads, ["grp", "home"]).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        beside = members.where("cuts > 1").select(*thin, "home", F.explode(crossing_cuts(F.col("cut"), F.col("cuts"))).alias("cut"))
        visitors = away.select(*thin, "home", "cut").unionByName(beside.select(*thin, "home", "cut"))
        found = stage_table(visiting_links(worlds.where("graph is not null").select(*SHARD, "graph"), visitors, cosine).unionByName(found), "hnsw-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    grouped = components(found.where("cls != root").select(F.col("cls").alias("a"), F.col("root").alias("b")), "hnsw-components").withColumnRenamed("node", "cls")
    # ids come back: the smallest of a component's classes
    each = classes.select("grp", "print", "cls", "first_id", "size").join(links, "cls", "left").join(grouped, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = each.groupBy("component").agg(F.min("first_id").alias("least"))
    of = each.join(least, "component").select("grp", "print", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    out = rows.select("vec_id", "grp", "print").join(of, ["grp", "print"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates over the whole of `embeddings`: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
