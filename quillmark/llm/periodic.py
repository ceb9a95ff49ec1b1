"""Periodic runs of words, by a suffix automaton of the words of a text.

A *run* is a stretch of consecutive words with smallest period q that no neighbouring word extends. Every run of
at least ``min_length`` words and ``min_exponent`` periods is found:

1. Stretches that can hold no such run are left out. In a run of period q all but the last q words occur again at most q words
   later, and these are at least (min_exponent - 1) * q in a row. For q in (T/2, T], T = 1, 2, 4, ..., the stretches of words that occur
   again within T and are long enough for this are kept, with T words after them: no run is lost, and ordinary prose leaves nothing.
2. The suffix automaton of what is kept has one state for each set of end positions. From the longest state to the
   shortest, the ordered set of a state is merged into that of its suffix link, the smaller set into the larger one. When an end position gets a new
   neighbour at a distance d with (min_exponent - 1) * d <= length of the state, the words of the state occur twice, d apart, and
   overlap: a seed of period d. States shorter than the shortest seed are not merged into.
3. A seed is extended over the whole text as far as the period holds. Of seeds with the same stretch the least period is kept.

Work is per text, and texts do not meet: nothing is shuffled. A text of n words takes O(n log n) for step 1 and, for what it keeps,
O(m) states and O(m log m) insertions. Memory is some 100 bytes for each word kept.

Words are ``[^\\x20\\x09-\\x0D]+``. Null or empty text has no words: no run, empty collapsed text. Repeated rows
give repeated results, a null doc_id stays null, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: (doc_id, words) to the words that are searched.
Edit = Callable[[int | None, list[bytes]], list[bytes]]
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))


def stretches(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """Disjoint stretches [start, stop) that hold every run whole."""
    n = len(ids)
    if n < min_length:
        return []
    order = np.argsort(ids, kind="stable")
    far = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: list[tuple[int, int]] = []
    t = 1
    while t // 2 + 1 <= n // min_exponent:
        least = max((min_exponent - 1) * (t // 2 + 1), min_length - t)
        near = np.empty(n + 2, bool)
        near[0] = near[-1] = False
        np.less_equal(far, t, out=near[1:-1])
        edge = np.flatnonzero(near[1:] != near[:-1])
        start, stop = edge[::2], edge[1::2]
        long = stop - start >= least
        found += zip(start[long].tolist(), np.minimum(stop[long] + t, n).tolist(), strict=True)
        t *= 2
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class SuffixAutomaton:
    """States in arrays. A state's first transition is in two arrays too, as most have no other; ``more`` has the rest."""

    def __init__(self, word: list[int]):
        self.length, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.symbol, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        last = 0
        for at, c in enumerate(word):
            last = self._append(last, c, at)

    def _state(self, length: int, link: int, end: int, symbol: int = -1, to: int = -1) -> int:
        for a, x in ((self.length, length), (self.link, link), (self.end, end), (self.symbol, symbol), (self.to, to)):
            a.append(x)
        return len(self.length) - 1

    def _append(self, last: int, c: int, at: int) -> int:
        length, link, symbol, to, more = self.length, self.link, self.symbol, self.to, self.more
        new = self._state(length[last] + 1, 0, at)
        p, q = last, -1
        while p >= 0:
            if symbol[p] == c:
                q = to[p]
                break
            if symbol[p] < 0:
                symbol[p], to[p] = c, new
            else:
                rest = more.get(p)
                if rest is None:
                    more[p] = {c: new}
                elif c in rest:
                    q = rest[c]
                    break
                else:
                    rest[c] = new
            p = link[p]
        if q < 0:
            return new
        if length[q] != length[p] + 1:
            copy = self._state(length[p] + 1, link[q], -1, symbol[q], to[q])
            if q in more:
                more[copy] = dict(more[q])
            while p >= 0:
                if symbol[p] == c:
                    if to[p] != q:
                        break
                    to[p] = copy
                elif (rest := more.get(p)) and rest.get(c) == q:
                    rest[c] = copy
                else:
                    break
                p = link[p]
            link[q] = q = copy
        link[new] = q
        return new

    def seeds(self, shortest: int, overlap: int) -> Iterator[tuple[int, int]]:
        """(end, distance) of new neighbours with overlap * distance <= length of the state, in states of ``shortest`` and more."""
        length, link = self.length, self.link
        ends: dict[int, list[int]] = {}
        for v in np.argsort(-np.frombuffer(length, np.int32), kind="stable").tolist():
            most = length[v]
            if most < shortest:
                return
            if self.end[v] >= 0:
                own = ends.get(v)
                if own is None:
                    ends[v] = [self.end[v]]
                else:  # a prefix ends first where it is itself the whole
                    own.insert(0, self.end[v])
                    if (d := own[1] - own[0]) * overlap <= most:
                        yield own[0], d
            parent, most = link[v], length[link[v]]
            small = ends.pop(v)
            if most < shortest:
                continue
            large = ends.get(parent)
            if large is None:
                ends[parent] = small
                continue
            if len(small) > len(large):
                small, large = large, small
                ends[parent] = large
            for x in small:
                i = bisect_left(large, x)
                if i and (d := x - large[i - 1]) * overlap <= most:
                    yield x - d, d
                if i < len(large) and (d := large[i] - x) * overlap <= most:
                    yield x, d
                large.insert(i, x)


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ``min_exponent`` is 2 at least."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    # a run of period d and length n has a seed in a state of n - d words
    shortest = min(max(min_length, min_exponent * d) - d for d in range(1, min_length + 1))
    breaks: dict[int, np.ndarray] = {}
    known: dict[int, tuple[list[int], list[int]]] = {}
    least: dict[tuple[int, int], int] = {}
    for a, b in stretches(ids, min_length, min_exponent):
        for end, d in SuffixAutomaton(ids[a:b].tolist()).seeds(shortest, min_exponent - 1):
            at = a + end
            starts, stops = known.setdefault(d, ([], []))
            i = bisect_right(starts, at)
            if i and at < stops[i - 1]:
                continue
            if d not in breaks:
                breaks[d] = np.flatnonzero(ids[:-d] != ids[d:])
            j = int(np.searchsorted(breaks[d], at))
            start = int(breaks[d][j - 1]) + 1 if j else 0
            stop = int(breaks[d][j]) if j < len(breaks[d]) else len(ids) - d
            starts.insert(i, start)
            stops.insert(i, stop)
            size = stop + d - start
            if size >= max(min_length, min_exponent * d):
                least[start, size] = min(d, least.get((start, size), d))
    return sorted(((s, n, d) for (s, n), d in least.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay when every run is cut down to its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, size, period in runs:
        keep[start + period : start + size] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _search(min_length: int, min_exponent: int, edit: Edit | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id")
            texts = batch.column("text").cast(pa.binary())
            for lo in range(0, batch.num_rows, 500):
                counts, runs, left = [], [], []
                for i in range(lo, min(lo + 500, batch.num_rows)):
                    words = (texts[i].as_py() or b"").split()
                    if edit:
                        words = edit(keys[i].as_py(), words)
                    found = find_runs(word_ids(words), min_length, min_exponent) if len(words) >= min_length else []
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": d} for s, n, d in found])
                    left.append(collapse(words, found))
                columns = [keys.slice(lo, 500), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text with every run cut down to one period."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_search(min_length, min_exponent, edit), SCHEMA)


def make_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by crc32 of the id, go on with a period of their own from some word on; a null id changes nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[: n - a]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=make_periodic)
    # by exponent, compared as fractions, then start, then period
    before = lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    best = F.get(F.array_sort("runs", before), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")
