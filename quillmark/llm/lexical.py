"""Ranked lexical search: document at a time over compressed postings, shard by shard.

Index: each task cuts its documents into shards of at most SHARD_POSTINGS postings (or one document). In a shard the documents are
numbered in the order of doc_id. A term's postings are ascending document numbers, as differences, and frequencies, both as variable-length bytes; the
shard's document table has ids and lengths. Shards need no shuffle, and a term of all documents is as
many short lists as there are shards.

Search: the queries' terms pick their lists (the index is joined with the distinct terms), document frequencies are summed over the shards, and each
(shard, block of queries) is one group. There a query's lists are merged by a heap on the document number; a
bounded heap keeps the best ``k`` by score, then doc_id. Lists whose best contributions together cannot lift a document over the k-th
score leave the merge and are only looked up for documents that may still enter, so the result is exact. The shards' best ``k`` are merged by
rank.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. With N documents that have terms, L terms in
them, n in this one and df documents with the term: weight w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 100 - 50 + (50 n N div L),
score = sum of w * (10^9 tf div (1000 tf + 20 m)) over a query's distinct terms.

Null or empty texts have no terms: such documents are not counted, such queries have no results. Each row is a document, or a query, of its
own, so repeated rows give repeated results; equal scores go by doc_id, null ids last. Empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.scratch import Scratch

#: Postings of a shard at most (12 bytes each while it is built), and queries of a block.
SHARD_POSTINGS, BLOCK = 4_000_000, 256
#: Up to so many distinct query terms (about 50 bytes each) are broadcast to pick lists; beyond, they are joined by key.
BROADCAST_TERMS = 200_000
K1, SCALE, FLOOR, SPAN = 20, 1000, 50, 50
_INDEX = "shard long, term string, df long, tokens long, postings binary"
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def terms(text: bytes) -> list[bytes]:
    """Of UTF-8."""
    return text.translate(_FOLD).split()


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative numbers as bytes of seven bits, the last of each number with the high bit clear; and where each begins."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k)) if k < 9 else v >= np.uint64(1 << 63)
    at = np.zeros(len(v) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.empty(int(at[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        byte = (v[has] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[at[:-1][has] + k] = byte | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes(), at


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.uint64)
    size = last - first + 1
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (raw[first[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


class _Shard:
    """Documents of a shard while it is built."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.docs: list[tuple[bool, int, int]] = []
        self.term: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        tf = Counter(words)
        self.term.append(np.fromiter(map(self.number.__getitem__, tf), np.int32, len(tf)))
        self.tf.append(np.fromiter(tf.values(), np.int32, len(tf)))
        self.docs.append((doc_id is None, doc_id or 0, len(words)))
        self.postings += len(tf)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        docs = np.array(self.docs, np.int64)
        order = np.lexsort((docs[:, 2], docs[:, 1], docs[:, 0]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, [len(t) for t in self.term])
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        by = np.lexsort((doc, term))
        doc, tf = doc[by], tf[by]
        df = np.bincount(term, minlength=len(self.number))
        ends = np.cumsum(df)
        gap = np.diff(doc, prepend=0)
        gap[ends[:-1]] = doc[ends[:-1]]  # each list begins anew
        data, at = pack(np.column_stack([gap, tf]).ravel())
        total = np.add.reduceat(tf.astype(np.int64), ends - df)
        cuts = (at[2 * np.concatenate([[0], ends])]).tolist()
        names = pa.array(list(self.number), pa.binary()).cast(pa.string())
        table = np.column_stack([docs[order, 0], docs[order, 1], docs[order, 2]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([len(docs)]), pa.array([int(docs[:, 2].sum())]), pa.array([table], pa.binary())], [x.split()[0] for x in _INDEX.split(", ")])
        for lo in range(0, len(names), 50_000):
            hi = min(lo + 50_000, len(names))
            blobs = [data[a:b] for a, b in zip(cuts[lo:hi], cuts[lo + 1 : hi + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, shard)), names.slice(lo, hi - lo), pa.array(df[lo:hi]), pa.array(total[lo:hi]), pa.array(blobs, pa.binary())], [x.split()[0] for x in _INDEX.split(", ")])


def _build(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = count(TaskContext.get().partitionId() << 32)
        shard = _Shard()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id"), texts, strict=True):
                if words := terms(text.as_py() or b""):
                    shard.add(doc_id.as_py(), words)
                if shard.postings >= most:
                    yield from shard.rows(next(numbers))
                    shard = _Shard()
        if shard.docs:
            yield from shard.rows(next(numbers))

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, item, text in zip(batch.column("row"), batch.column("item_id"), batch.column("text").cast(pa.binary()), strict=True):
            if found := sorted(set(terms(text.as_py() or b""))):
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * n), pa.array([item.as_py()] * n, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], ["row", "item_id", "term"])


def best_of_shard(lists: dict[str, tuple[list[int], list[int], int]], query: list[str], k: int) -> list[tuple[int, int]]:
    """(score, document number) of the best ``k``, ties to the smaller number; ``lists``: numbers ascending, contributions, the largest of them."""
    picked = sorted((lists[t] for t in query if t in lists and lists[t][2] > 0), key=lambda x: x[2])
    docs, gains, reach, total = [x[0] for x in picked], [x[1] for x in picked], [], 0
    for x in picked:
        total += x[2]
        reach.append(total)
    at, n, aside, least = [0] * len(picked), len(picked), 0, 0
    best: list[tuple[int, int]] = []
    merge = [(d[0], i) for i, d in enumerate(docs)]
    heapify(merge)
    while merge:
        doc, score = merge[0][0], 0
        while merge and merge[0][0] == doc:
            i = merge[0][1]
            if i < aside:
                heappop(merge)
                continue
            p = at[i]
            score += gains[i][p]
            at[i] = p = p + 1
            if p < len(docs[i]):
                heapreplace(merge, (docs[i][p], i))
            else:
                heappop(merge)
        if not score:
            continue
        for i in range(aside - 1, -1, -1):
            if score + reach[i] <= least:
                break
            at[i] = p = bisect_left(docs[i], doc, at[i])
            if p < len(docs[i]) and docs[i][p] == doc:
                score += gains[i][p]
        if score > least:
            if len(best) < k:
                heappush(best, (score, -doc))
            else:
                heapreplace(best, (score, -doc))
            if len(best) == k:
                least = best[0][0]
                while aside < n and reach[aside] <= least:
                    aside += 1
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def _search(k: int, docs_total: int, tokens_total: int):
    schema = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        lists, queries, items, table = {}, defaultdict(list), {}, None
        for term, postings in zip(group["term"], group["postings"], strict=True):
            if not term.is_valid:
                table = np.frombuffer(postings.as_py(), "<i8").reshape(-1, 3)
        # lengths times totals as Python numbers, lest they pass 64 bits
        m = np.array([100 - FLOOR + (SPAN * n * docs_total) // tokens_total for n in table[:, 2].tolist()], np.int64)
        for term, w, asked, postings in zip(group["term"].to_pylist(), group["w"].to_pylist(), group["asked"].to_pylist(), group["postings"], strict=True):
            if term is None:
                continue
            pairs = unpack(postings.as_py()).reshape(-1, 2)
            docs, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
            gain = w * ((1_000_000_000 * tf) // (SCALE * tf + K1 * m[docs]))
            lists[term] = (docs.tolist(), gain.tolist(), int(gain.max()))
            for q in asked:
                queries[q["row"]].append(term)
                items[q["row"]] = q["item_id"]
        out = [(q, items[q], None if table[d, 0] else int(table[d, 1]), s) for q, asked in queries.items() for s, d in best_of_shard(lists, asked, k)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], schema=schema)

    return run


class LexicalIndex:
    """The postings of all terms of ``docs`` (doc_id, text), written once and searched as often as wanted."""

    def __init__(self, spark: SparkSession, docs: DataFrame, shard_postings: int = SHARD_POSTINGS):
        self.spark, self.work = spark, Scratch(spark, "lexical")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.index = self.work.write(rows.mapInArrow(_build(shard_postings), _INDEX), "index")
        sums = self.index.where("term is null").agg(F.sum("df").alias("n"), F.sum("tokens").alias("l")).first()
        self.docs, self.tokens = sums["n"] or 0, sums["l"] or 0

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """item_id, rank, doc_id and score of the ``k`` best documents with a score above 0 for each row of ``queries`` (item_id, text)."""
        asked = queries.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        asked = self.work.write(asked.mapInArrow(_query_terms, "row long, item_id long, term string"), "asked")
        distinct = self.work.write(asked.select("term").distinct(), "terms")
        wanted = F.broadcast(distinct) if distinct.count() <= BROADCAST_TERMS else distinct
        hits = self.work.write(self.index.join(wanted, "term", "left_semi"), "hits")
        weight = F.floor(1000 * F.log((2.0 * self.docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
        weights = hits.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("w"))
        block = F.expr(f"row div {BLOCK}")
        blocks = asked.groupBy(block.alias("block"), "term").agg(F.collect_list(F.struct("row", "item_id")).alias("asked"))
        lists = self.work.write(hits.select("shard", "term", "postings").join(blocks.join(weights, "term"), "term"), "lists")
        tables = self.index.where("term is null").select("shard", "postings").join(lists.select("shard", "block").distinct(), "shard")
        units = lists.select("shard", "block", "term", "w", "asked", "postings").unionByName(tables, allowMissingColumns=True)
        found = units.groupBy("shard", "block").applyInArrow(_search(k, self.docs, self.tokens), "row long, item_id long, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = LexicalIndex(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS k FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(k)) AS BIGINT) AS total FROM d WHERE len(k) > 0),
q AS (SELECT row_number() OVER () AS j, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
i AS (SELECT j, item_id, term FROM q),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(k) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(docs) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
m AS (SELECT r, doc_id, 50 + (50 * len(k) * docs) // total AS m FROM d, s),
x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 50
"""
