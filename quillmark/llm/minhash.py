"""Near-duplicate documents: banded MinHash with sequential Bayesian verification.

1. Each whole text becomes the set of its distinct word shingles (64-bit hashes) and a signature of
   BANDS x ROWS minima. Texts with equal sets form a class, found by one aggregation; from here on
   only one text of a class matters, so thousands of copies cost as much as one.
2. A band of the signature is a bucket. In every bucket the most popular member (the one whose buckets
   are largest, which is the centre of a group of near copies) stands for the bucket, and the others are
   compared with it only. Links found this way join most of a group in one round, without its pairs.
3. What stays apart around one representative may still link with each other. For these groups the members outside
   the largest component meet all members: a task holds two blocks of signatures and whole shingle sets, and emits a
   spanning forest of the links. Groups of any size are cut into blocks; no pair becomes a row.
4. Every comparison, with a representative or in a block, is sequential: signatures are compared in batches of BATCH
   positions, and after each one the pair is dropped if the posterior probability that its similarity reaches the
   threshold is below ``miss`` (uniform prior, so the posterior is a binomial tail). Survivors are verified exactly on
   their whole shingle sets, in integers (in a block that has many by an inverted index of the sets, or of the absences, for
   shingles that most of them have, so near copies cost their differences only).
5. Components of the links come from repeated contraction.

Null, empty and white-space texts have no shingles, link with nothing and are kept. Texts with fewer
words than a shingle are one shingle. Rows that repeat a doc_id are rows of one document id: each is
returned, and equal texts are linked as always. Rows with a null doc_id link like others; a component of such rows only has a
null component_id, and they are kept. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.graph import connected_components
from quillmark.llm.scratch import Scratch

#: A pair at 0.85 misses all bands with probability (1 - 0.85^6)^24 = 1.2e-5; at 0.8, 5e-4.
BANDS, ROWS = 24, 6
BATCH = 24
MISS = 1e-7
SEED = 20_240_601
#: Bytes of shingle sets on either side of a block, and sets, about.
BLOCK_BYTES, BLOCK_SETS = 8 << 20, 4_096
#: Up to so many survivors of a set are verified one by one.
FEW = 48
CACHE_WORDS, CACHE_BYTES = 400_000, 48


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Whole texts to sorted arrays of distinct shingle hashes. Words are runs of other than ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int):
        self.k, self.cache = words, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        from xxhash import xxh3_64_intdigest

        cache, out = self.cache, []
        for text in texts:
            ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if not ws:
                out.append(np.empty(0, np.uint64))
                continue
            try:
                h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
            except KeyError:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                long = {}
                for w in set(ws):
                    if w not in cache:
                        (cache if len(w) <= CACHE_BYTES else long)[w] = xxh3_64_intdigest(w)
                h = np.fromiter((cache[w] if w in cache else long[w] for w in ws) if long else map(cache.__getitem__, ws), np.uint64, len(ws))
            if len(h) < self.k:
                s = _mix(h[:1])
                for i in range(1, len(h)):
                    s = _mix(s * np.uint64(3) + h[i : i + 1])
                s = _mix(s + np.uint64(len(h)))
            else:
                n = len(h) - self.k + 1
                s = _mix(h[:n])
                for i in range(1, self.k):
                    s = _mix(s * np.uint64(3) + h[i : i + n])
            out.append(np.unique(s))
        return out


def signature(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over the set, 32 bits each."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(s), 512):
        np.minimum(low, (s[lo : lo + 512, None] * mult).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _lots(col, rows: int = 500, size: int = 2_000_000) -> Iterator[tuple[int, list]]:
    lo, part, n = 0, [], 0
    for i in range(len(col)):
        part.append(col[i].as_py())
        n += len(part[-1] or "")
        if len(part) >= rows or n >= size:
            yield lo, part
            lo, part, n = i + 1, [], 0
    if part:
        yield lo, part


def _sign(words: int, bands: int, rows: int):
    mult = _odd(bands * rows, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shingler = Shingler(words)
        recent: dict[bytes, bytes] = {}
        for batch in batches:
            for lo, texts in _lots(batch.column("text")):
                n, keys, sigs = [], [], []
                for s in shingler.sets(texts):
                    n.append(len(s))
                    key = xxh3_128_digest(s.tobytes()) if len(s) else None
                    if key is not None and key not in recent:
                        if len(recent) > 20_000:
                            recent.clear()
                        recent[key] = signature(s, mult).tobytes()
                    keys.append(key)
                    sigs.append(recent[key] if key else None)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, len(texts)) for c in ("doc_id", "place")), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "place", "n_shingles", "node", "sig"])

    return run


def least_matches(n: int, t: float, miss: float) -> int:
    """The fewest matches in n positions with which P(similarity >= t) is at least ``miss``: under a uniform prior that is P(Bin(n + 1, t) <= matches)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def _steps(t: float, size: int, miss: float) -> list[tuple[int, int]]:
    """(positions compared, fewest matches to go on) after each batch."""
    return [(e, least_matches(e, t, miss)) for e in range(BATCH, size + 1, BATCH)]


def survivors(one: np.ndarray, many: np.ndarray, among: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Of the signatures ``many`` at ``among``, those that the sequential comparison with ``one`` leaves."""
    hits, done = np.zeros(len(among), np.int64), 0
    for end, least in steps:
        if not len(among):
            break
        hits += (many[among, done:end] == one[done:end]).sum(axis=1)
        among, hits, done = among[hits >= least], hits[hits >= least], end
    return among


def _prune(t: float, size: int, miss: float):
    steps = _steps(t, size, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("sa").to_pylist()), dtype="<u4").reshape(-1, size)
            y = np.frombuffer(b"".join(batch.column("sb").to_pylist()), dtype="<u4").reshape(-1, size)
            alive, hits, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for end, least in steps:
                hits[alive] += (x[alive, done:end] == y[alive, done:end]).sum(axis=1)
                alive, done = alive[hits[alive] >= least], end
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shingler = Shingler(words)
        for batch in batches:
            for lo, texts in _lots(batch.column("text")):
                nodes, sets = batch.column("node").slice(lo, len(texts)).to_pylist(), [s.tobytes() for s in shingler.sets(texts)]
                # another text under the same doc_id is not the one that was asked for
                own = [(n, x) for n, x in zip(nodes, sets, strict=True) if n == xxh3_128_digest(x)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.binary()), pa.array([x for _, x in own], pa.binary())], ["node", "shingles"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("xa")[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(batch.column("xb")[i].as_buffer(), dtype=np.uint64)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


class _Finder:
    def __init__(self, spark: SparkSession, docs: DataFrame, words: int, num: int, den: int, miss: float):
        self.work = Scratch(spark, "minhash")
        self.words, self.num, self.den, self.miss = words, num, den, miss
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # the text's hash tells rows with a null doc_id apart
        self.docs = rows.withColumn("place", F.xxhash64("text"))
        self.signed = self.work.write(self.docs.mapInArrow(_sign(words, BANDS, ROWS), "doc_id long, place long, n_shingles long, node binary, sig binary"), "signed")
        #: one row per class of equal sets: its least doc_id (a null one only if there is no other), where its text is, and its signature
        where = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("w")
        classes = self.signed.where(F.col("node").isNotNull()).groupBy("node").agg(where, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        self.classes = self.work.write(classes.select("node", "w.doc_id", "w.place", "n_shingles", "sig"), "classes")

    def members(self) -> DataFrame:
        """(bucket, node, pop) of buckets with two classes at least."""
        width = 4 * ROWS
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width))))
        each = self.work.write(self.classes.select("node", F.explode(bands).alias("bucket")), "bands")
        shared = self.work.write(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        both = self.work.write(each.join(shared, "bucket"), "shared")
        pop = both.groupBy("node").agg(F.sum("n").alias("pop"))
        out = self.work.write(both.join(pop, "node").select("bucket", "node", "pop"), "members")
        self.work.drop(each, both, shared)
        return out

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the given nodes, from their whole texts."""
        ids = self.classes.join(nodes, "node", "left_semi").select("doc_id", "place", "node").alias("i")
        same = [F.col("d.place") == F.col("i.place"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id"))]
        sets = self.docs.alias("d").join(ids, same).select("node", "text").mapInArrow(_shingles(self.words), "node binary, shingles binary")
        return self.work.write(sets.dropDuplicates(["node"]), "sets")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the signatures leave and the whole sets confirm."""
        sig = self.classes.select("node", "sig")
        x = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        left = self.work.write(x.select("a", "b", "sa", "sb").mapInArrow(_prune(self.num / self.den, BANDS * ROWS, self.miss), "a binary, b binary"), "survivors")
        sets = self.sets(left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))))
        y = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
        out = self.work.write(y.select("a", "b", "xa", "xb").mapInArrow(_verify(self.num, self.den), "a binary, b binary"), "links")
        self.work.drop(left, sets)
        return out

    def components(self) -> DataFrame:
        """(node, root) of the classes that have links."""
        members = self.members()
        best = self.work.write(members.groupBy("bucket").agg(F.max(F.struct("pop", "node"))["node"].alias("rep")), "best")
        star = self.work.write(members.join(best, "bucket").where("node <> rep").select("rep", "node").distinct(), "star")
        self.work.drop(members, best)
        links = self.compare(star.select(F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b")).distinct())
        roots = connected_components(self.work, links)
        more = self.apart(star, roots)
        if more is None or more.isEmpty():
            return roots
        return connected_components(self.work, links.unionByName(more))

    def apart(self, star: DataFrame, roots: DataFrame) -> DataFrame | None:
        """Links between members of one representative that are in different components."""
        group = star.join(roots, "node", "left").select("rep", "node", F.coalesce("root", "node").alias("root"))
        group = self.work.write(group.join(self.classes.select("node", "n_shingles"), "node"), "groups")
        per_root = group.groupBy("rep", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
        main = F.max(F.struct("n", "root", "size")).alias("m")
        plan = per_root.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("roots"), main).where("roots > 1")
        parts = lambda n, size: F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(size * 8 / BLOCK_BYTES)).cast("int")
        plan = plan.select("rep", F.col("m.root").alias("main"), parts(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size")).alias("rows"), parts(F.col("n"), F.col("size")).alias("cols"))
        plan = self.work.write(plan, "plan")
        if plan.isEmpty():
            return None
        met = group.join(plan, "rep")
        h = F.xxhash64("node")
        few = met.where("root <> main").select("rep", "node", "root", F.lit(True).alias("few"), F.pmod(h, F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
        every = met.select("rep", "node", "root", F.lit(False).alias("few"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(h, F.col("cols")).cast("int").alias("j"))
        blocks = self.work.write(few.unionByName(every), "blocks")
        sets = self.sets(blocks.select("node"))
        steps = _steps(self.num / self.den, BANDS * ROWS, self.miss)
        both = blocks.join(sets.join(self.classes.select("node", "sig"), "node"), "node")
        found = both.groupBy("rep", "i", "j").applyInArrow(_meet(self.num, self.den, steps), "a binary, b binary")
        found = self.work.write(found, "links")
        self.work.drop(group, plan, blocks, sets)
        return found


class Index:
    """Sets by their members, and by the members they lack where most have them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(c) for c in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.values, inverse, self.counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.owner = owner[np.argsort(inverse, kind="stable")]
        self.ends = np.cumsum(self.counts)
        self.most = self.counts * 2 > len(sets)
        everyone = np.arange(len(sets))
        self.lacking = {int(v): np.setdiff1d(everyone, self.having(v), assume_unique=True) for v in np.flatnonzero(self.most)}

    def having(self, v: int) -> np.ndarray:
        return self.owner[self.ends[v] - self.counts[v] : self.ends[v]]

    def shared(self, x: np.ndarray) -> np.ndarray:
        """How many members of ``x`` each set has."""
        at = np.searchsorted(self.values, x)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == x]
        common, rare = at[self.most[at]], at[~self.most[at]]
        both = np.full(len(self.sizes), len(common), dtype=np.int64)
        if len(common):
            both -= np.bincount(np.concatenate([self.lacking[int(v)] for v in common]), minlength=len(both))
        if len(rare):
            both += np.bincount(np.concatenate([self.having(v) for v in rare]), minlength=len(both))
        return both


def meet(rows: list[np.ndarray], row_sigs: np.ndarray, row_roots: list, cols: list[np.ndarray], col_sigs: np.ndarray, col_roots: list, num: int, den: int, steps: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(row, column) of the sets in different components that link: signatures sequentially, then whole sets."""
    names = {r: k for k, r in enumerate(dict.fromkeys([*row_roots, *col_roots]))}
    col_root = np.array([names[r] for r in col_roots])
    sizes = np.array([len(c) for c in cols])
    index = None
    for i, x in enumerate(rows):
        near = (col_root != names[row_roots[i]]) & (den * np.minimum(sizes, len(x)) >= num * np.maximum(sizes, len(x)))
        left = survivors(row_sigs[i], col_sigs, np.flatnonzero(near), steps)
        if len(left) > FEW:
            index = index or Index(cols)
            both = index.shared(x)[left]
        else:
            both = np.array([len(np.intersect1d(x, cols[j], assume_unique=True)) for j in left], dtype=np.int64)
        for j in left[den * both >= num * (len(x) + sizes[left] - both)]:
            yield i, int(j)


def _meet(num: int, den: int, steps: list[tuple[int, int]]):
    def run(key, table):
        few = table.column("few").to_numpy(zero_copy_only=False)
        nodes, roots = table.column("node").to_pylist(), table.column("root").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles")]
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u4").reshape(len(nodes), -1)
        row, col = np.flatnonzero(few), np.flatnonzero(~few)
        parent: dict[bytes, bytes] = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        if len(row) and len(col):
            for i, j in meet([sets[k] for k in row], sigs[row], [roots[k] for k in row], [sets[k] for k in col], sigs[col], [roots[k] for k in col], num, den, steps):
                # one link joins two components for good
                a, b = top(roots[row[i]]), top(roots[col[j]])
                if a != b:
                    parent[a] = b
                    out.append((nodes[row[i]], nodes[col[j]]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of its component) and kept. Links: den * intersection >= num * union."""
    f = _Finder(spark, docs, words, num, den, miss)
    roots = f.components()
    own = f.classes.select("node", "doc_id")
    joined = own.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(least, "root").select("node", "component_id")
    rows = f.signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=85, den=100)
