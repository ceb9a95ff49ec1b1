"""Toxicity with a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their first PREFIX letters (which reach inflected and
compounded forms), hashed to 64 bits. From a bounded sample of labelled rows Spark counts in how many
toxic and other texts each term occurs; the MAX_TERMS most telling ones (likelihood ratio) become inputs of
the machine, and so do the terms of the MAX_PAIRS most telling pairs: of the PAIR_TERMS terms that occur in most sampled texts, pairs
whose share of toxic texts lies PAIR_Z standard errors off what the two terms alone would add up to, so terms that
tell nothing alone are found by what they say together. Score: bias + sum of w[i] + sum over pairs of <v[i], v[j]>. It is trained on the same sample by adaptive gradient steps on the driver,
whose memory the sample's bound bounds. Every whole text is then scored; a word is looked up once per worker.

Null and empty texts get the score of a text without terms. Several labels of one document count once, as
toxic if any is. Without labels of both kinds every score is the smoothed share of toxic labels. Rows of
equal doc_id are scored each; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.scratch import Scratch

#: Labelled rows that are learned from at most (those of least hash), and terms that become inputs.
SAMPLE_ROWS, MAX_TERMS = 40_000, 2_048
PREFIX, FACTORS, STEPS, BATCH = 5, 8, 2_000, 256
RATE, DECAY, SEED = 0.05, 2e-5, 7
#: A term must occur in so many sampled texts and reach this likelihood ratio.
MIN_DOCS, MIN_RATIO = 4, 15.0
#: Terms whose pairs are counted (8 bytes for each pair, on the driver), pairs that become inputs, and how far off they are.
PAIR_TERMS, MAX_PAIRS, PAIR_Z, PAIR_DOCS = 2_048, 512, 6.0, 20
CACHE_WORDS, CACHE_CHARS = 400_000, 48

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(token: str) -> list[int]:
    """Signed 64-bit hashes of the words in a token and of their prefixes."""
    from xxhash import xxh3_64_intdigest

    names = [x for w in _WORD.findall(token) for x in ({"w" + w, "p" + w[:PREFIX]} if len(w) > PREFIX else {"w" + w})]
    return [h - (1 << 64) if h >= 1 << 63 else h for h in (xxh3_64_intdigest(x.encode()) for x in names)]


def _texts(batch: pa.RecordBatch, size: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    col, lo, part, n = batch.column("text"), 0, [], 0
    for i in range(len(col)):
        part.append((col[i].as_py() or "").lower())
        n += len(part[-1])
        if n >= size:
            yield lo, part
            lo, part, n = i + 1, [], 0
    if part:
        yield lo, part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (term, toxic texts, other texts) with partial sums."""
    counts = (Counter(), Counter())
    known: dict[str, list[int]] = {}

    def terms(token):
        hit = known.get(token)
        if hit is None:
            hit = terms_of(token)
            if len(token) <= CACHE_CHARS:
                if len(known) > CACHE_WORDS:
                    known.clear()
                known[token] = hit
        return hit

    def flush():
        every = list(counts[0].keys() | counts[1].keys())
        for lo in range(0, len(every), 100_000):
            t = every[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array([counts[1][x] for x in t], pa.int64()), pa.array([counts[0][x] for x in t], pa.int64())], ["term", "pos", "neg"])
        for c in counts:
            c.clear()

    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for lo, texts in _texts(batch):
            for y, text in zip(toxic[lo : lo + len(texts)], texts, strict=True):
                counts[y].update({h for token in set(text.split()) for h in terms(token)})
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield from flush()
    yield from flush()


class Lookup:
    """Tokens to the inputs among them; most have none."""

    def __init__(self, terms: np.ndarray):
        self.index = {int(t): i for i, t in enumerate(terms)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def inputs(self, text: str) -> np.ndarray:
        tokens, cache = set(text.split()), self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        found: set[int] = set()
        for t in tokens:
            hit = cache.get(t)
            if hit is None:
                hit = tuple(self.index[h] for h in terms_of(t) if h in self.index)
                if len(t) <= CACHE_CHARS:
                    cache[t] = hit
            if hit:
                found.update(hit)
        return np.fromiter(found, np.int64, len(found))


def telling_pairs(rows: list[np.ndarray], y: np.ndarray, n_terms: int) -> np.ndarray:
    """The terms in pairs whose share of toxic texts is far from what both terms alone add up to (in log odds)."""
    sums = np.zeros((2, n_terms, n_terms), dtype=np.float32)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        for lo in range(0, len(at), 512):
            x = np.zeros((min(512, len(at) - lo), n_terms), dtype=np.float32)
            for i, k in enumerate(at[lo : lo + 512]):
                x[i, rows[k]] = 1.0
            sums[label] += x.T @ x
    toxic, n = sums[1], sums[0] + sums[1]
    logit = lambda a, b: np.log((a + 0.5) / (b - a + 0.5))
    base = logit((y == 1).sum(), len(y))
    alone = logit(toxic.diagonal(), n.diagonal()) - base
    share = 1 / (1 + np.exp(-(base + alone[:, None] + alone)))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(toxic - n * share) / np.sqrt(n * share * (1 - share))
    # a pair that always comes together says what one of the two says
    z[(n < PAIR_DOCS) | (n > 0.9 * np.minimum(n.diagonal()[:, None], n.diagonal()))] = 0
    i, j = np.triu_indices(n_terms, 1)
    far = np.flatnonzero(z[i, j] >= PAIR_Z)
    far = far[np.argsort(-z[i[far], j[far]], kind="stable")][:MAX_PAIRS]
    return np.unique(np.concatenate([i[far], j[far]]))


def _inputs(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(terms.value)
        for batch in batches:
            for lo, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(lo, len(texts)), pa.array([np.sort(look.inputs(t)).astype("<u2").tobytes() for t in texts], pa.binary())], ["toxic", "inputs"])

    return run


@dataclass
class Machine:
    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, inputs: np.ndarray) -> float:
        z = self.bias
        if len(inputs):
            v = self.v[inputs]
            z += self.w[inputs].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def train(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, share: float) -> Machine:
    """Logistic loss, adaptive steps, weight decay. ``rows`` are the inputs of each text."""
    rng = np.random.default_rng(SEED)
    m = Machine(terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), FACTORS)))
    if not len(terms):
        return m
    gw, gv, gb = np.full(len(terms), 1e-3), np.full(m.v.shape, 1e-3), 1e-3
    order = np.empty(0, np.int64)
    for _ in range(STEPS):
        if not len(order):
            order = rng.permutation(len(rows))
        pick, order = order[:BATCH], order[BATCH:]
        x = np.zeros((len(pick), len(terms)), dtype=np.float32)
        for i, k in enumerate(pick):
            x[i, rows[k]] = 1.0
        sums = x @ m.v
        z = m.bias + x @ m.w + 0.5 * ((sums**2).sum(axis=1) - x @ (m.v**2).sum(axis=1))
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick)
        dw = x.T @ e + DECAY * m.w
        dv = x.T @ (e[:, None] * sums) - (x.T @ e)[:, None] * m.v + DECAY * m.v
        gw += dw**2
        gv += dv**2
        gb += e.sum() ** 2
        m.w -= RATE * dw / np.sqrt(gw)
        m.v -= RATE * 0.3 * dv / np.sqrt(gv)
        m.bias -= RATE * e.sum() / np.sqrt(gb)
    return m


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> Machine:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    work = Scratch(spark, "toxicity")
    pick = work.write(pick, "sample")  # of at most ``rows`` rows of two numbers
    texts = work.write(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(pick), "doc_id").select("toxic", "text"), "texts")
    counts = texts.mapInArrow(_count, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").cast("double").alias("a"), F.sum("neg").cast("double").alias("b"))
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    pos, neg = float(size.get(1, 0)), float(size.get(0, 0))
    share = (pos + 1) / (pos + neg + 2)
    none = np.empty(0, np.int64)
    if not pos or not neg:
        return train(none, [], none, share)
    log = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    seen = a + b
    all_rows = pos + neg
    ratio = 2 * (log(a, seen * pos / all_rows) + log(b, seen * neg / all_rows) + log(F.lit(pos) - a, (F.lit(all_rows) - seen) * pos / all_rows) + log(F.lit(neg) - b, (F.lit(all_rows) - seen) * neg / all_rows))
    telling = counts.where((seen >= MIN_DOCS) & (seen < all_rows)).select("term", ratio.alias("g")).where(F.col("g") >= MIN_RATIO)
    terms = np.array([r["term"] for r in telling.orderBy(F.desc("g"), "term").limit(MAX_TERMS).collect()], dtype=np.int64)
    often = counts.where((seen >= PAIR_DOCS) & (seen <= 0.95 * all_rows)).select("term", seen.alias("n")).orderBy(F.desc("n"), "term").limit(PAIR_TERMS)
    often = np.array([r["term"] for r in often.collect()], dtype=np.int64)
    every = np.concatenate([terms, often[~np.isin(often, terms)]])
    sample = texts.mapInArrow(_inputs(spark.sparkContext.broadcast(every)), "toxic int, inputs binary").toArrow()
    inputs = [np.frombuffer(x.as_buffer(), dtype="<u2").astype(np.int64) for x in sample.column("inputs")]
    y = sample.column("toxic").to_numpy().astype(np.float64)
    work.drop(pick, texts)
    place = np.full(len(every), -1, np.int64)
    place[np.flatnonzero(np.isin(every, often))] = np.arange(len(often))
    own = np.flatnonzero(place >= 0)
    pairs = own[telling_pairs([p[p >= 0] for p in (place[x] for x in inputs)], y, len(often))] if len(often) else own
    chosen = np.union1d(np.arange(len(terms)), pairs)
    new = np.full(len(every), -1, np.int64)
    new[chosen] = np.arange(len(chosen))
    return train(every[chosen], [p[p >= 0] for p in (new[x] for x in inputs)], y, share)


def _score(machine, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        look = Lookup(m.terms)
        for batch in batches:
            for lo, texts in _texts(batch):
                s = np.array([m.score(look.inputs(t)) for t in texts])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, len(texts)) for k in keys), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keys, "score", "predicted"])

    return run


def fold(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out (not learned from), score, predicted for every document."""
    machine = spark.sparkContext.broadcast(learn(spark, docs, labels, fold(5) != 0, rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(machine, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
