"""Approximate nearest neighbours by balanced posting lists, on two levels.

Equal vectors are one class with its ``k + 1`` smallest ids, so a hot vector is searched, stored and answered once.

Cells: a bounded sample is split in halves, again and again, at the median along the direction between two centres,
into as many parts as the table has CELL_ROWS rows; the parts' means are the cells' centroids. Every vector is stored in
the cell of its nearest centroid and, near a boundary, in a second one: where the distance to the second centroid is at
most so many times the first as CELL_SHARE of the sample stay below. Lists: the task that holds a cell splits its rows in
the same way, into lists of LIST rows, and replicates those near boundaries (LIST_SHARE) to a second list. The number of
lists therefore grows with the table and their size does not; no place holds more than a cell. A cell of many rows is cut
into parts by hash first, each with lists of its own.

Search: centroids are found through in-memory neighbour graphs: from a few pivots, nodes within reach are expanded until
none is left. Reach is a ratio of the query's ANCHOR-th least distance to the centroids of the sample's own small parts:
one ratio for the cells to visit, one for the lists to read there. Both are calibrated on the exact neighbours of
SAMPLE_QUERIES queries among all rows (a scan in blocks): CELL_TARGET of them lie in a visited cell, LIST_TARGET in a
list within reach. Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2), which is 0 for queries; the
reported score is the inner product of the original vectors, summed in one way whatever the block, so ties are ties.

Only each part's best ``k + 1`` classes of a query leave a task. A cell that very many queries visit is read by several
tasks; only then are its rows copied.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id.
Vectors are compared with those of their own length only. Rows that repeat an id are one candidate (its best
score); a query that repeats is answered once for each of its vectors, and the best of both counts. Empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.scratch import Scratch

#: Rows that the cells are fitted on at most, cells at most (8 bytes a dimension are broadcast for each), rows of the table a cell, and of a list.
SAMPLE_ROWS, MAX_CELLS, CELL_ROWS, LIST = 32_768, 8_192, 4_096, 12
#: Shares of the vectors that are stored a second time, in a cell and in a list of it.
REPLICAS, CELL_SHARE, LIST_SHARE = 2, 0.15, 0.25
DEGREE, PIVOTS, BEAM = 24, 64, 8
#: Parts of the sample that the anchor is taken from at most, and its rank.
ANCHORS, ANCHOR = 2_048, 16
CELL_TARGET, LIST_TARGET, SAMPLE_QUERIES = 0.99, 0.96, 128
#: The lists of a query hold so many times k + 1 rows, if there are so many.
LEAST = 4
#: Rows and queries of a part at most, about, and numbers that are worked on at once.
PART_ROWS, PART_QUERIES, CELLS_AT_ONCE = 4 * CELL_ROWS, 32_768, 2_000_000
SEED = 5


def lift(x: np.ndarray, bound: float | None) -> np.ndarray:
    """One more coordinate, after which the nearest vector of a query (bound None) is the one of largest inner product."""
    last = np.zeros(len(x)) if bound is None else np.sqrt(np.maximum(bound**2 - (x**2).sum(axis=1), 0.0))
    return np.hstack([x, last[:, None]])


def balanced_parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Index sets of nearly equal size, split at medians; neighbours in the list are neighbours in the tree."""
    rng = np.random.default_rng(SEED)

    def split(at: np.ndarray, n: int) -> list[np.ndarray]:
        if n <= 1 or len(at) <= 1:
            return [at]
        a, b = x[at[rng.integers(len(at))]], x[at[rng.integers(len(at))]]
        for _ in range(3):
            right = ((x[at] - a) ** 2).sum(axis=1) > ((x[at] - b) ** 2).sum(axis=1)
            if right.all() or not right.any():
                break
            a, b = x[at[~right]].mean(axis=0), x[at[right]].mean(axis=0)
        order = at[np.argsort(x[at] @ (b - a), kind="stable")]
        left = n // 2
        cut = len(at) * left // n
        return split(order[:cut], left) + split(order[cut:], n - left)

    return [at for at in split(np.arange(len(x)), parts) if len(at)]


class Graph:
    """Centroids and the graph that they are searched through."""

    def __init__(self, centroids: np.ndarray):
        self.c, k = centroids, len(centroids)
        rng = np.random.default_rng(SEED)
        self.pivots = np.sort(rng.choice(k, min(PIVOTS, k), replace=False))
        self.squares = (centroids**2).sum(axis=1)
        links, rows = min(DEGREE, k - 1), []
        for lo in range(0, k, 256):
            d = self.squares[lo : lo + 256, None] + self.squares - 2 * centroids[lo : lo + 256] @ centroids.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            rows.append(np.argpartition(d, links - 1, axis=1)[:, :links] if links else np.empty((len(d), 0), np.int64))
        # long edges keep the graph connected: each node also knows its successor in tree order and one far node
        self.graph = np.hstack([np.concatenate(rows), np.stack([(np.arange(k) + 1) % k, (np.arange(k) + k // 2) % k], axis=1)])

    def distances(self, v: np.ndarray, reach: np.ndarray | None, beam: int = BEAM) -> np.ndarray:
        """Distances of (lifted) vectors to the centroids met on the way to all within ``reach`` and the ``beam`` nearest; infinite for the others."""
        k, n = len(self.c), len(v)
        own = (v**2).sum(axis=1)
        dist, done = np.full((n, k), np.inf), np.zeros((n, k), dtype=bool)
        dist[:, self.pivots] = np.sqrt(np.maximum(own[:, None] + self.squares[self.pivots] - 2 * v @ self.c[self.pivots].T, 0.0))
        last = min(beam, k) - 1
        while True:
            border = np.partition(dist, last, axis=1)[:, last]
            border = border if reach is None else np.maximum(border, reach)
            q, c = np.nonzero((dist <= border[:, None]) & ~done & np.isfinite(dist))
            if not len(q):
                return dist
            done[q, c] = True
            new = np.zeros((n, k), dtype=bool)
            new[q[:, None], self.graph[c]] = True
            q, c = np.nonzero(new & np.isinf(dist))
            for lo in range(0, len(q), 100_000):
                a, b = q[lo : lo + 100_000], c[lo : lo + 100_000]
                dist[a, b] = np.sqrt(np.maximum(own[a] + self.squares[b] - 2 * np.einsum("ij,ij->i", v[a], self.c[b]), 0.0))

    def blocks(self, v: np.ndarray, reach: np.ndarray | None = None, beam: int = BEAM) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, CELLS_AT_ONCE // max(1, len(self.c)))
        for lo in range(0, len(v), step):
            yield lo, self.distances(v[lo : lo + step], None if reach is None else reach[lo : lo + step], beam)

    def anchor(self, v: np.ndarray) -> np.ndarray:
        """The ANCHOR-th least distance (the greatest, of fewer centroids)."""
        m = min(ANCHOR, len(self.c)) - 1
        return np.concatenate([np.partition(d, m, axis=1)[:, m] for _, d in self.blocks(v, beam=ANCHOR + BEAM)] or [np.empty(0)])

    def stored(self, v: np.ndarray, boundary: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, centroid) of the lists that hold each vector."""
        at, lists = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, d in self.blocks(v):
            m = min(REPLICAS, d.shape[1])
            best = np.argpartition(d, m - 1, axis=1)[:, :m]
            e = np.take_along_axis(d, best, axis=1)
            q, j = np.nonzero(e <= (e.min(axis=1) * boundary)[:, None])
            at.append(q + lo)
            lists.append(best[q, j])
        return np.concatenate(at), np.concatenate(lists)

    def boundary(self, v: np.ndarray, share: float) -> float:
        """The ratio of the second least distance to the least that ``share`` of the vectors stay below."""
        if len(self.c) < 2:
            return 1.0
        two = np.concatenate([np.partition(d, 1, axis=1)[:, :2] for _, d in self.blocks(v)])
        return float(max(1.0, np.quantile(two[:, 1] / np.maximum(two[:, 0], 1e-12), share)))

    def wanted(self, v: np.ndarray, reach: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, centroid) of the lists to read: those within reach, and more where they hold fewer than ``least`` rows."""
        at, lists = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, d in self.blocks(v, reach):
            pick = d <= reach[lo : lo + len(d), None]
            for i in np.flatnonzero((pick * sizes).sum(axis=1) < least):
                order = np.argsort(((self.c - v[lo + i]) ** 2).sum(axis=1), kind="stable")
                pick[i, order[: int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1]] = True
            q, c = np.nonzero(pick)
            at.append(q + lo)
            lists.append(c)
        return np.concatenate(at), np.concatenate(lists)


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.array(v, dtype=np.float64) + 0.0 for v in batch.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("asks"), pa.array([len(v) for v in x], pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([float(np.sqrt((v**2).sum())) for v in x], pa.float64())], ["vec_id", "asks", "dim", "v", "norm"])


def _exact(asked, dim: int, k: int):
    """The best k rows of each batch for the queries of the calibration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), dim)
            s = q @ x.T
            s[(q[:, None, :1] == x[None, :, :1])[:, :, 0] & np.isclose(s, (q**2).sum(axis=1)[:, None])] = -np.inf  # itself
            m = min(k, len(x))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            at = np.repeat(np.arange(len(q)), m)
            take = pa.array(top.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(s[at, top.ravel()]), batch.column("cid").take(take), batch.column("low").take(take)], ["q", "s", "cid", "low"])

    return run


def _post(graph, dim: int, bound: float, boundary: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at, cells = g.stored(lift(_matrix(batch.column("v"), dim), bound), boundary)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *(batch.column(c).take(take) for c in ("cid", "low", "v", "ids"))], ["cell", "cid", "low", "v", "ids"])

    return run


def _lists(dim: int, bound: float):
    """The rows of a part of a cell to its lists, and their centroids (rows without an id)."""

    def run(key, table):
        up = lift(_matrix(table.column("v"), dim), bound)
        g = Graph(np.array([up[at].mean(axis=0) for at in balanced_parts(up, max(1, -(-len(up) // LIST)))]))
        at, lists = g.stored(up, g.boundary(up, LIST_SHARE))
        take, k = pa.array(at), len(g.c)
        of = lambda c: table.column(c).take(take).combine_chunks()
        none = pa.nulls(k, pa.int64())
        parts = [
            pa.table({"list": pa.array(lists, pa.int32()), "cid": of("cid"), "low": of("low"), "v": of("v"), "ids": of("ids")}),
            pa.table({"list": pa.array(range(k), pa.int32()), "cid": none, "low": none, "v": pa.array([c.tobytes() for c in g.c], pa.binary()), "ids": pa.nulls(k, pa.binary())}),
        ]
        out = pa.concat_tables(parts)
        return out.add_column(0, "part", pa.array([key[1].as_py()] * len(out), pa.int32())).add_column(0, "cell", pa.array([key[0].as_py()] * len(out), pa.int32()))

    return run


def _ask(graph, anchors, dim: int, cell_ratio: float, list_ratio: float, sizes, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = lift(_matrix(batch.column("v"), dim), None)
            anchor = anchors.value.anchor(v)
            at, cells = graph.value.wanted(v, anchor * cell_ratio, sizes.value, least)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *(batch.column(c).take(take) for c in ("cid", "low", "v")), pa.array(anchor[at] * list_ratio)], ["cell", "cid", "low", "v", "reach"])

    return run


def read_lists(graph: Graph, lists: np.ndarray, row: np.ndarray, x: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of the best k rows in the lists within reach, those that tie with the last too, and how many rows were read. ``lists`` and ``row`` are the postings."""
    order = np.argsort(lists, kind="stable")
    sizes = np.bincount(lists, minlength=len(graph.c))
    ends = np.cumsum(sizes)
    held = [row[order[hi - n : hi]] for hi, n in zip(ends, sizes, strict=True)]
    asks = lift(q, None)
    out_q, out_x, out_s, read = [], [], [], 0
    step = max(1, CELLS_AT_ONCE // len(x))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        qi, li = graph.wanted(asks[lo : lo + step], reach[lo : lo + step], sizes, LEAST * k)
        read += int(sizes[li].sum())
        s = np.full((len(part), len(x)), -np.inf)
        by = qi[np.argsort(li, kind="stable")]
        many = np.bincount(li, minlength=len(held))
        stop = np.cumsum(many)
        for c in np.flatnonzero(many):
            mine = by[stop[c] - many[c] : stop[c]]
            s[mine[:, None], held[c]] = part[mine] @ x[held[c]].T
        m = min(k, len(x))
        floor = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        a, b = np.nonzero((s >= np.where(np.isfinite(floor), floor - 1e-9, -np.inf)[:, None]) & np.isfinite(s))
        out_q.append(a + lo)
        out_x.append(b)
        out_s += [(part[a[i : i + 50_000]] * x[b[i : i + 50_000]]).sum(axis=1) for i in range(0, len(a), 50_000)]
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s), read


def _scan(dim: int, k: int):
    schema = pa.schema([("q_cid", pa.int64()), ("q_low", pa.int64()), ("cid", pa.int64()), ("low", pa.int64()), ("ids", pa.binary()), ("score", pa.float64())])

    def run(key, table):
        is_row, is_query = (table.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("ids", "reach"))
        rows, asks, middle = (table.filter(pa.array(m)) for m in (is_row, is_query, ~is_row & ~is_query))
        if not rows.num_rows or not asks.num_rows:
            return schema.empty_table()
        middle = middle.sort_by("list")
        graph = Graph(_matrix(middle.column("v"), dim + 1))
        rows = rows.sort_by([("cid", "ascending"), ("low", "ascending")])
        cid, low = rows.column("cid").to_numpy(), rows.column("low").to_numpy()
        new = np.r_[True, (cid[1:] != cid[:-1]) | (low[1:] != low[:-1])]  # a row of two lists is one
        lists, row = rows.column("list").to_numpy(), np.cumsum(new) - 1
        rows, low = rows.filter(pa.array(new)), low[new]
        q, x, s, _ = read_lists(graph, lists, row, _matrix(rows.column("v"), dim), _matrix(asks.column("v"), dim), asks.column("reach").to_numpy(), k)
        order = np.lexsort((low[x], -s, q))
        q, x, s = q[order], x[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        q, x, s = q[rank < k], x[rank < k], s[rank < k]
        of = lambda t, c, i: t.column(c).take(pa.array(i)).combine_chunks()
        return pa.table([of(asks, "cid", q), of(asks, "low", q), of(rows, "cid", x), of(rows, "low", x), of(rows, "ids", x), pa.array(s)], schema=schema)

    return run


def _calibrate(spark: SparkSession, rows: DataFrame, asked: DataFrame, lists: DataFrame, graph: Graph, anchors: Graph, dim: int, bound: float, k: int) -> tuple[float, float]:
    """The ratios to the anchor within which the cells and the lists of the exact neighbours of some queries lie."""
    picked = asked.select("v", F.xxhash64("cid", F.lit(SEED)).alias("o"), "low").orderBy("o", "low").limit(SAMPLE_QUERIES).select("v").toArrow()
    q = _matrix(picked.column("v"), dim)
    near = rows.select("cid", "low", "v").mapInArrow(_exact(spark.sparkContext.broadcast(q), dim, k), "q int, s double, cid long, low long")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "low", "cid"))).where(F.col("r") <= k).select("q", "cid", "low")
    place = ["cell", "part", "list"]
    middle = lists.where("ids is null").select(*place, F.col("v").alias("c"))
    # k rows for each query of the sample, twice or four times
    found = lists.where("ids is not null").select(*place, "cid", "low").join(F.broadcast(near), ["cid", "low"]).join(middle, place).select("q", "cid", "low", "cell", "c").toArrow()
    if not found.num_rows:
        return 1.0, 1.0
    v = lift(q, None)
    anchor, own = anchors.anchor(v), found.column("q").to_numpy()
    _, pair = np.unique(np.stack([own, found.column("cid").to_numpy(), found.column("low").to_numpy()]), axis=1, return_inverse=True)
    pair = pair.ravel()

    def ratio(to: np.ndarray, share: float) -> float:
        need = np.full(pair.max() + 1, np.inf)
        np.minimum.at(need, pair, np.sqrt(((v[own] - to) ** 2).sum(axis=1)) / np.maximum(anchor[own], 1e-12))
        return float(np.quantile(need, share)) + 1e-9

    return ratio(graph.c[found.column("cell").to_numpy()], CELL_TARGET), ratio(_matrix(found.column("c"), dim + 1), LIST_TARGET)


def _search(spark: SparkSession, work: Scratch, rows: DataFrame, asked: DataFrame, dim: int, bound: float, n: int, k: int) -> DataFrame:
    """(q_cid, q_low, cid, low, ids, score) of one length of vectors."""
    sample = rows.select("v", F.xxhash64("cid", F.lit(SEED)).alias("o"), "low").orderBy("o", "low").limit(SAMPLE_ROWS).select("v").toArrow()
    up = lift(_matrix(sample.column("v"), dim), bound)
    graph, anchors = (Graph(np.array([up[at].mean(axis=0) for at in balanced_parts(up, min(m, len(up)))])) for m in (min(MAX_CELLS, max(1, -(-n // CELL_ROWS))), max(1, min(ANCHORS, len(up) // LIST))))
    share = spark.sparkContext.broadcast
    shared = share(graph)
    posted = work.write(rows.select("cid", "low", "v", "ids").mapInArrow(_post(shared, dim, bound, graph.boundary(up, CELL_SHARE)), "cell int, cid long, low long, v binary, ids binary"), "posted")
    sizes = np.zeros(len(graph.c), np.int64)
    for r in posted.groupBy("cell").count().collect():  # at most MAX_CELLS rows
        sizes[r["cell"]] = r["count"]
    parts = F.broadcast(spark.createDataFrame([(c, max(1, -(-int(m) // PART_ROWS))) for c, m in enumerate(sizes)], "cell int, parts int"))
    placed = posted.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("cid", "low"), F.col("parts")).cast("int"))
    lists = placed.groupBy("cell", "part").applyInArrow(_lists(dim, bound), "cell int, part int, list int, cid long, low long, v binary, ids binary")
    lists = work.write(lists, "lists")
    cell_ratio, list_ratio = _calibrate(spark, rows, asked, lists, graph, anchors, dim, bound, k)
    asks = asked.select("cid", "low", "v").mapInArrow(_ask(shared, share(anchors), dim, cell_ratio, list_ratio, share(sizes), LEAST * REPLICAS * (k + 1)), "cell int, cid long, low long, v binary, reach double")
    asks = work.write(asks, "asks")
    visits = [(r["cell"], max(1, -(-r["count"] // PART_QUERIES))) for r in asks.groupBy("cell").count().collect()]  # at most MAX_CELLS rows
    turns = F.broadcast(spark.createDataFrame(visits, "cell int, turns int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = lists.join(turns, "cell").select("cell", "part", each("turns").alias("turn"), "list", "cid", "low", "v", "ids", F.lit(None).cast("double").alias("reach"))
    asks = asks.join(turns, "cell").join(parts, "cell").withColumn("turn", F.pmod(F.xxhash64("cid", "low"), F.col("turns")).cast("int"))
    asks = asks.select("cell", each("parts").alias("part"), "turn", F.lit(None).cast("int").alias("list"), "cid", "low", "v", F.lit(None).cast("binary").alias("ids"), "reach")
    return held.unionByName(asks).groupBy("cell", "part", "turn").applyInArrow(_scan(dim, k + 1), "q_cid long, q_low long, cid long, low long, ids binary, score double")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of the classes, from bytes."""
    for batch in batches:
        lists = [np.frombuffer(b, dtype="<i8") for b in batch.column("ids").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("q_cid", "q_low", "score")), pa.array(np.concatenate(lists) if lists else [], pa.int64())], ["q_cid", "q_low", "score", "vec_id"])


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pa.array([np.array(x, dtype="<i8").tobytes() for x in batch.column("ids").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "low", "dim", "norm", "v")), ids], ["cid", "low", "dim", "norm", "v", "ids"])


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each row that ``is_query`` selects."""
    work = Scratch(spark, "ann")
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    raw = raw.where(fine).where(F.exists("embedding", lambda x: x != 0))
    rows = work.write(raw.mapInArrow(_pack, "vec_id long, asks boolean, dim int, v binary, norm double").withColumn("cid", F.xxhash64("v")), "rows")
    # of each class the smallest ids: the window's limit is applied before the shuffle
    ids = rows.select("cid", "v", "vec_id", "dim", "norm").distinct().withColumn("r", F.row_number().over(Window.partitionBy("cid", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = ids.groupBy("cid", "v").agg(F.min("vec_id").alias("low"), F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = work.write(classes.mapInArrow(_as_bytes, "cid long, low long, dim int, norm double, v binary, ids binary"), "classes")
    asked = work.write(classes.join(rows.where("asks").select("cid", "v").distinct(), ["cid", "v"], "left_semi"), "asked")
    dims = asked.select("dim").distinct().join(classes.groupBy("dim").agg(F.max("norm").alias("bound"), F.count(F.lit(1)).alias("n")), "dim").orderBy("dim").collect()
    found = None
    for r in dims:
        same = F.col("dim") == r["dim"]
        part = _search(spark, work, classes.where(same), asked.where(same), r["dim"], r["bound"], r["n"], k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of_query = Window.partitionBy("q_cid", "q_low")
    found = found.dropDuplicates(["q_cid", "q_low", "cid", "low"])  # a class that is stored twice
    top = found.withColumn("r", F.row_number().over(of_query.orderBy(F.desc("score"), "low", "cid"))).where(F.col("r") <= k + 1)
    each = top.select("q_cid", "q_low", "score", "ids").mapInArrow(_ids, "q_cid long, q_low long, score double, vec_id long")
    each = each.groupBy("q_cid", "q_low", "vec_id").agg(F.max("score").alias("score"))
    each = each.withColumn("r", F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = each.groupBy("q_cid", "q_low").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    lists = work.write(lists.join(asked.select(F.col("cid").alias("q_cid"), F.col("low").alias("q_low"), "v"), ["q_cid", "q_low"]).select(F.col("q_cid").alias("cid"), "v", "near"), "near")
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "cid", "v").distinct()
    answers = queries.join(lists, ["cid", "v"]).select("query_id", F.explode("near").alias("x")).select("query_id", "x.*").where("query_id <> vec_id")
    best = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
