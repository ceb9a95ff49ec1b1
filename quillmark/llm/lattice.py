"""Near-duplicate embeddings by lattice hashing.

Vectors of one label and equal direction (bit for bit, as unit vectors) are one class with a number of members, so a
group of copies costs as much as one vector; a class counts its members for those that it links with.

In each of TABLES tables a random projection takes the unit vector to two blocks of eight dimensions,
and each block is decoded to its nearest point of the E8 lattice; the two points are the cell. A vector
is stored in its own cell and looks into PROBES neighbouring cells: those that take the next-best lattice
point in one of the blocks. Vectors that meet in a cell are compared by cosine in double precision, in
blocks of numpy matrices inside one task, so a pair of vectors never becomes a row. A pair counts at the
first table (and cell) where it meets, so its link is counted once. A cell with more than BLOCK members is
cut into parts of BLOCK, and every two parts meet in a task of their own.

From a block come, per vector, the number of new links, and a spanning forest of the links; counts are
summed and the forests' components found by contraction.

Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with
nothing. Repeated rows are counted as rows: equal (or null) vec_ids are told apart by a row number. A component without any vec_id
has none, and is not kept. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.graph import connected_components
from quillmark.llm.scratch import Scratch

TABLES, PROBES, BLOCKS = 10, 3, 2
#: Cell size: a link at cosine 0.98 (distance 0.2) is about 0.2 * sqrt(8) * SCALE apart in a block; lattice points are sqrt(2) apart.
SCALE = 0.75
SEED = 88
BLOCK = 1024


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum): round, and where the sum is odd, round the worst coordinate the other way."""
    r = np.rint(x)
    odd = (r.sum(axis=1).astype(np.int64) & 1).astype(bool)
    if odd.any():
        d = x[odd] - r[odd]
        k = np.abs(d).argmax(axis=1)
        i = np.arange(len(k))
        fix = r[odd]
        fix[i, k] += np.where(d[i, k] >= 0, 1.0, -1.0)
        r[odd] = fix
    return r


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest E8 point, and twice that of the other coset (D8 or D8 + 1/2), which is a near neighbour."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    best, other = np.where(near[:, None], a, b), np.where(near[:, None], b, a)
    return (2 * best).astype(np.int64), (2 * other).astype(np.int64)


def _next_best(x: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Twice the point of the same coset beyond the two coordinates that are furthest from ``best``."""
    d = x - best / 2
    k = np.argsort(-np.abs(d), axis=1)[:, :2]
    i = np.arange(len(x))[:, None]
    out = best.copy()
    out[i, k] += 2 * np.where(d[i, k] >= 0, 1, -1)
    return out


def _hash(points: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(points), salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for j in range(points.shape[1]):
            h = (h ^ points[:, j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h.astype(np.int64)


def cells(unit: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """For each vector, table and probe the cell: int64 of shape (n, TABLES, 1 + PROBES). Column 0 is the own cell."""
    n, dim = unit.shape
    rng = np.random.default_rng(SEED + dim)
    out = np.empty((n, TABLES, 1 + PROBES), dtype=np.int64)
    for t in range(TABLES):
        p = rng.normal(size=(dim, 8 * BLOCKS))
        shift = rng.uniform(0, 2, size=8 * BLOCKS)
        y = unit @ p * scale + shift
        best, other, gap, nxt = [], [], [], []
        for b in range(BLOCKS):
            x = y[:, 8 * b : 8 * b + 8]
            o, c = decode_e8(x)
            e = _next_best(x, o)
            dist = lambda q, x=x: ((x - q / 2) ** 2).sum(axis=1)
            swap = dist(e) < dist(c)
            first, second = np.where(swap[:, None], e, c), np.where(swap[:, None], c, e)
            best.append(o)
            other.append(first)
            nxt.append(second)
            gap.append(dist(first) - dist(o))
        out[:, t, 0] = _hash(np.hstack(best), t + 1)
        # neighbours: the next point in either block, and in both
        out[:, t, 1] = _hash(np.hstack([other[0], best[1]]), t + 1)
        out[:, t, 2] = _hash(np.hstack([best[0], other[1]]), t + 1)
        closer = (gap[0] <= gap[1])[:, None]
        out[:, t, 3] = _hash(np.hstack([np.where(closer, nxt[0], best[0]), np.where(closer, best[1], nxt[1])]), t + 1)
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, label, embedding to row, vec_id, label, dim, unit vector (doubles), and the key of its class."""
    from hashlib import md5

    for batch in batches:
        vectors = batch.column("embedding").to_pylist()
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dim.setdefault(len(v), []).append(i)
        for dim, at in by_dim.items():
            x = np.array([vectors[i] for i in at], dtype=np.float64)
            # scaled first, so that squares neither overflow nor vanish; + 0.0 makes a negative zero one with zero
            x /= np.abs(x).max(axis=1)[:, None]
            unit = [u.tobytes() for u in x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0]
            take = batch.take(pa.array(at))
            keys = [md5(f"{dim} {label}".encode() + u).digest() for label, u in zip(take.column("label").to_pylist(), unit, strict=True)]
            yield pa.RecordBatch.from_arrays([take.column("row"), take.column("vec_id"), take.column("label"), pa.array([dim] * len(at), pa.int32()), pa.array(unit, pa.binary()), pa.array(keys, pa.binary())], ["row", "vec_id", "label", "dim", "unit", "key"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cells of each class."""
    for batch in batches:
        dims, unit = batch.column("dim").to_numpy(), batch.column("unit").to_pylist()
        out: list[bytes] = [b""] * len(unit)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for i, c in zip(at, cells(np.frombuffer(b"".join(unit[i] for i in at), dtype=np.float64).reshape(-1, int(dim))), strict=True):
                out[i] = c.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "cells"])


def _first_meeting(ka: np.ndarray, kb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of cell arrays (n, TABLES, 1 + PROBES): the first table in which they meet, and the cell (the first vector's own cell before the second's)."""
    own = ka[:, :, 0] == kb[:, :, 0]
    a_in_b = (ka[:, :, :1] == kb[:, :, 1:]).any(axis=2)
    b_in_a = (kb[:, :, :1] == ka[:, :, 1:]).any(axis=2)
    meet = own | a_in_b | b_in_a
    t = meet.argmax(axis=1)
    i = np.arange(len(t))
    cell = np.where(own[i, t] | a_in_b[i, t], ka[i, t, 0], kb[i, t, 0])
    return t, cell


def _links(t: int, cell: int, xs: np.ndarray, ks: np.ndarray, rows: np.ndarray, own: np.ndarray, part: np.ndarray, ij: tuple[int, int], least: float):
    """Pairs of members of a cell (of part i with part j) that link and that meet here first."""
    left, right = np.flatnonzero(part == ij[0]), np.flatnonzero(part == ij[1])
    s = xs[left] @ xs[right].T
    ia, ib = np.nonzero(s >= least)
    a, b = left[ia], right[ib]
    some = (rows[a] < rows[b]) if ij[0] == ij[1] else (rows[a] != rows[b])
    some &= own[a] | own[b]
    a, b = a[some], b[some]
    swap = rows[a] > rows[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out_a, out_b = [], []
    for lo in range(0, len(a), 20_000):
        pa_, pb_ = a[lo : lo + 20_000], b[lo : lo + 20_000]
        tt, cc = _first_meeting(ks[pa_], ks[pb_])
        here = (tt == t) & (cc == cell)
        out_a.append(pa_[here])
        out_b.append(pb_[here])
    empty = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out


def _compare(least: float):
    def run(key, table):
        t, cell, dim = key[0].as_py(), key[1].as_py(), key[3].as_py()
        rows = table.column("row").to_numpy()
        order = np.argsort(rows, kind="stable")
        table, rows = table.take(pa.array(order)), rows[order]
        xs = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype=np.float64).reshape(-1, dim)
        ks = np.frombuffer(b"".join(table.column("cells").to_pylist()), dtype=np.int64).reshape(-1, TABLES, 1 + PROBES)
        own, part = table.column("own").to_numpy(zero_copy_only=False), table.column("part").to_numpy()
        ij = (key[4].as_py(), key[5].as_py())
        a, b = _links(t, cell, xs, ks, rows, own, part, ij, least)
        m = table.column("m").to_numpy()
        n = np.bincount(a, weights=m[b], minlength=len(rows)) + np.bincount(b, weights=m[a], minlength=len(rows))
        n = n.astype(np.int64)
        some = np.flatnonzero(n)
        trees = _forest(rows[a], rows[b])
        # counts and links in one table: (row, n, null) and (row, 0, other row)
        return pa.table({"row": pa.array([*rows[some].tolist(), *(x for x, _ in trees)], pa.int64()), "n": pa.array([*n[some].tolist(), *([0] * len(trees))], pa.int64()), "other": pa.array([*([None] * len(some)), *(y for _, y in trees)], pa.int64())})

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id, embedding, label."""
    work = Scratch(spark, "lattice")
    rows = work.write(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")), "rows")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine).where(F.exists("embedding", lambda x: x != 0))
    hashed = work.write(usable.select("row", "vec_id", "label", "embedding").mapInArrow(_hashes, "row long, vec_id long, label string, dim int, unit binary, key binary"), "hashed")
    classes = hashed.groupBy("key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("low"), *(F.first(c).alias(c) for c in ("label", "dim", "unit")))
    classes = work.write(classes.mapInArrow(_cells, "key binary, row long, m long, low long, label string, dim int, unit binary, cells binary"), "classes")
    linked = _linked(work, classes, least)
    # each row to its class; what links with nothing is its own component
    named = hashed.select("row", "key").join(linked, "key").select("row", "n_links", "component_id")
    out = rows.select("row", "vec_id").join(named, "row", "left").withColumn("component_id", F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each table and cell of a vector: t, cell, label, dim, row, own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = np.frombuffer(b"".join(batch.column("cells").to_pylist()), dtype=np.int64).reshape(-1, TABLES, 1 + PROBES)
        n, each = len(ks), TABLES * (1 + PROBES)
        at = pa.array(np.repeat(np.arange(n), each))
        t = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), n)
        own = np.tile(np.arange(1 + PROBES) == 0, n * TABLES)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(ks.reshape(-1)), batch.column("label").take(at), batch.column("dim").take(at), batch.column("row").take(at), pa.array(own)], ["t", "cell", "label", "dim", "row", "own"])


def _linked(work: Scratch, hashed: DataFrame, least: float) -> DataFrame:
    """(key, n_links, component_id) of the classes; ``row`` stands for a class."""
    key = ["t", "cell", "label", "dim"]
    each = work.write(hashed.mapInArrow(_spread, "t int, cell long, label string, dim int, row long, own boolean"), "each")
    sizes = each.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.count_if("own").alias("o")).where("m > 1 and o > 0")
    sizes = work.write(sizes.withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")), "sizes")
    met = each.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    # A part meets every part, itself included: one task for each two of them.
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    met = met.select(*key, "row", "own", "part", F.explode(pairs).alias("p"))
    full = met.join(hashed.select("row", "m", "unit", "cells"), "row").select("t", "cell", "label", "dim", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "row", "own", "part", "m", "unit", "cells")
    found = work.write(full.groupBy("t", "cell", "label", "dim", "i", "j").applyInArrow(_compare(least), "row long, n long, other long"), "found")
    work.drop(each, sizes)
    counts = found.where("n > 0").groupBy("row").agg(F.sum("n").alias("n_links"))
    roots = connected_components(work, found.where("other is not null").select(F.col("row").alias("a"), F.col("other").alias("b")))
    named = hashed.select("row", "key", "m", "low").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    named = work.write(named, "named")
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    out = named.join(ids, "root").join(counts, "row", "left")
    return out.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
