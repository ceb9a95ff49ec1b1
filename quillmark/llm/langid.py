"""Language identification with interpolated Kneser-Ney character models.

One 5-gram model per language over words padded at both ends. The corpus is counted in Spark (each
partition sums its distinct words first, so a shuffle carries n-grams, not text), and smoothed in
Spark, all n-grams of all languages. The models are sorted arrays of packed n-grams, in ranges, each
n-gram with the log probabilities of the languages that have it. The ranges are files in the shared
folder, which workers map into memory (or read, where the folder is not a local path); the driver
holds a line for each range and no n-gram. A text gets the language of lowest cross-entropy per
character, over the whole text; each distinct word is scored once per worker, by binary searches.

Rejection is calibrated on labelled texts that were not counted: a bounded number of each language, picked by a hash of the row,
a quarter of its texts at most; all others are counted. Per language they give the mean cross-entropy of its own texts,
that of the best wrong language, and the spread of the former (which shrinks with the root of a text's length); a
language of fewer than LEAST_TEXTS such texts takes the means of the others. A text is rejected if its cross-entropy lies beyond
``reject_share`` of the way from the own to the wrong mean and ``reject_z`` spreads above the own: texts
that only quote another language stay. A text without letters (language ``und``) is rejected too.

Letters are the characters of Unicode category L. Null and empty texts get ``und`` with score 0. Rows of equal or null doc_id are
predicted each. With an empty
table, or no labelled rows, nothing is learned and every text is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.scratch import Scratch

ORDER = 5
BITS = 12
START, END = 1, 2
DISCOUNT = 0.75
#: Texts of a language on which the rejection is calibrated, about, at most; the share of its texts at most; and texts that its own means need.
CALIBRATION_TEXTS, CALIBRATION_SHARE, LEAST_TEXTS = 2_000, 0.25, 20
REJECT_Z, REJECT_SHARE = 6.0, 0.75
#: Sharpness of the posterior over languages, per character of cross-entropy, up to so many characters.
SHARPNESS_CHARS = 40
CACHE_CHARS = 48
#: Numbers (words times languages) that a worker keeps of words it scored, and that it works on at once.
CACHE_CELLS, WORK_CELLS = 2_000_000, 4_000_000

RESULT = ("lang_pred", "score", "cross_entropy", "rejected")

_WORD = regex.compile(r"\p{L}+")


def pack_chars(text: str) -> np.ndarray:
    """Code points in BITS bits: the first ones as they are, the rest folded by a hash."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    fold = (cp * 2654435761 >> 7) & 0xFFF
    return np.where((cp > END) & (cp < 0xFFF), cp, np.maximum(fold, 3))


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All padded ORDER-grams of the words, packed, and the index of the word each belongs to."""
    joined = "".join(words)
    if not joined:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = pack_chars(joined)
    pad = ORDER - 1
    whole = sizes + pad + 1
    ends = np.cumsum(whole)
    seq = np.full(int(ends[-1]), START, dtype=np.int64)
    at = np.repeat(ends - whole + pad, sizes) + (np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    seq[at] = chars
    seq[ends - 1] = END
    key = np.zeros(len(seq) - pad, dtype=np.int64)
    for k in range(ORDER):
        key = (key << BITS) | seq[k : len(seq) - pad + k]
    owner = np.repeat(np.arange(len(words)), whole)
    last = np.arange(pad, len(seq))
    inside = last - np.repeat(ends - whole, whole)[pad:] >= pad
    return key[inside], owner[pad:][inside]


def letters_of(token: str) -> list[str]:
    return _WORD.findall(token)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n): words are summed before they are cut to n-grams, and partial sums are emitted when they get large."""
    words: dict[str, Counter] = {}

    def flush():
        for lang, counts in words.items():
            parts, weights = [], []
            for token, n in counts.items():
                for w in letters_of(token):
                    parts.append(w)
                    weights.append(n)
            for lo in range(0, len(parts), 200_000):
                grams, owner = grams_of(parts[lo : lo + 200_000])
                if len(grams):
                    unique, inverse = np.unique(grams, return_inverse=True)
                    total = np.bincount(inverse, weights=np.asarray(weights[lo : lo + 200_000], dtype=np.float64)[owner])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(unique), pa.string()), pa.array(unique), pa.array(total.astype(np.int64))], ["lang", "gram", "n"])
        words.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        for i, lang in enumerate(langs):
            words.setdefault(lang, Counter()).update((texts[i].as_py() or "").lower().split())
        if sum(map(len, words.values())) > 400_000:
            yield from flush()
    yield from flush()


@dataclass
class Model:
    """langs; per order (1 to ORDER) sorted packed n-grams with log probabilities, and sorted contexts with log back-off weights, in arrays or in ``ranges`` of files; per language the calibrated mean and spread of own cross-entropies and the mean of the best wrong language."""

    langs: list[str] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    unseen: float = 0.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    wrong: np.ndarray | None = None
    #: (part, first key, keys, entries, URI) in order; part 2k - 2 has the n-grams of order k, 2k - 1 their contexts.
    ranges: list[tuple[int, int, int, int, str]] = field(default_factory=list)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def estimate(langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], discount: float = DISCOUNT) -> Model:
    """Interpolated Kneser-Ney in arrays: full counts at the highest order, numbers of distinct left neighbours below it. ``estimate_ranges`` does the same in Spark."""
    m = Model(langs)
    if not langs:
        return m
    mask = (1 << BITS) - 1
    keep = lambda k: (1 << (BITS * k)) - 1
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [counts]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, [np.unique(g & keep(k), return_counts=True) for g, _ in levels[0]])
    alphabet = np.unique(np.concatenate([g for g, _ in levels[0]]) & mask)
    m.unseen = float(-np.log(len(alphabet) + 1))
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([g for g, _ in levels[k - 1]]))
        contexts = np.unique(union >> BITS)
        p = np.zeros((len(union), len(langs)))
        gamma = np.ones((len(contexts), len(langs)))
        for j, (g, n) in enumerate(levels[k - 1]):
            if not len(g):
                continue
            n = n.astype(np.float64)
            c = np.searchsorted(contexts, g >> BITS)
            total = np.bincount(c, weights=n, minlength=len(contexts))
            kinds = np.bincount(c, minlength=len(contexts))
            seen = total > 0
            gamma[seen, j] = discount * kinds[seen] / total[seen]
            p[np.searchsorted(union, g), j] = np.maximum(n - discount, 0) / total[c]
        up = np.searchsorted(contexts, union >> BITS)
        if k == 1:
            lower = np.full(p.shape, np.exp(m.unseen))
        else:
            lower = np.exp(m.logp[k - 2])[np.searchsorted(m.grams[k - 2], union & keep(k - 1))]
        p += gamma[up] * lower
        m.grams.append(union)
        m.logp.append(np.log(p).astype(np.float32))
        m.contexts.append(contexts)
        m.backoff.append(np.log(gamma).astype(np.float32))
    return m


def score_words(m: Model, words: list[str]) -> np.ndarray:
    """Log probability of each padded word under each language."""
    out = np.zeros((len(words), len(m.langs)))
    key, owner = grams_of(words)
    add = np.zeros((len(key), len(m.langs)), dtype=np.float32)
    left = np.arange(len(key))
    for k in range(ORDER, 0, -1):
        now = key[left] & ((1 << (BITS * k)) - 1)
        at, found = _find(m.grams[k - 1], now)
        add[left[found]] += m.logp[k - 1][at[found]]
        left, now = left[~found], now[~found]
        at, found = _find(m.contexts[k - 1], now >> BITS)
        add[left[found]] += m.backoff[k - 1][at[found]]
    add[left] += m.unseen
    for j in range(len(m.langs)):
        out[:, j] = np.bincount(owner, weights=add[:, j], minlength=len(words))
    return out


def _write_ranges(root: str, langs: list[str]):
    """One file for each part in a partition: keys, offsets of their entries, languages and values of the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyarrow import fs

        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        t = pa.Table.from_batches(batches)
        store, base = fs.FileSystem.from_uri(root)
        part, gram, v = (t.column(c).to_numpy() for c in ("part", "gram", "v"))
        code = pc.index_in(t.column("lang"), value_set=pa.array(langs, pa.string())).to_numpy()
        rows = []
        for p in np.unique(part):
            lo, hi = np.searchsorted(part, p), np.searchsorted(part, p, "right")
            keys, start = np.unique(gram[lo:hi], return_index=True)
            name = f"{uuid.uuid4().hex}.bin"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                for array, kind in ((keys, np.int64), (np.append(start, hi - lo), np.int64), (code[lo:hi], np.int32), (v[lo:hi], np.float32)):
                    out.write(array.astype(kind).tobytes())
            rows.append((int(p), int(keys[0]), len(keys), int(hi - lo), f"{root}/{name}"))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["part", "first", "n_keys", "n_entries", "uri"])

    return run


def estimate_ranges(spark: SparkSession, langs: list[str], counts: DataFrame, discount: float = DISCOUNT) -> Model:
    """The same as ``estimate``, of (lang, gram, n) in Spark, into files."""
    from pyarrow import fs

    m = Model(langs)
    work = Scratch(spark, "language-models")
    keep = lambda k: F.lit((1 << (BITS * k)) - 1).cast("long")
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].select("lang", F.col("gram").bitwiseAND(keep(k)).alias("gram"))
        levels[k] = work.write(shorter.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "counts")
    alphabet = levels[1].select("gram").distinct().count()
    m.unseen = float(-np.log(alphabet + 1))
    parts, lower = [], None
    of_context = Window.partitionBy("lang", "context")
    for k in range(1, ORDER + 1):
        x = levels[k].withColumn("context", F.shiftright("gram", BITS))
        x = x.withColumn("total", F.sum("n").over(of_context)).withColumn("gamma", discount * F.count(F.lit(1)).over(of_context) / F.col("total"))
        if k == 1:
            x = x.withColumn("lower", F.lit(float(np.exp(m.unseen))))
        else:
            x = x.withColumn("suffix", F.col("gram").bitwiseAND(keep(k - 1))).join(lower, ["lang", "suffix"])
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("lower")
        x = work.write(x.select("lang", "gram", "context", "gamma", p.alias("p")), "smoothed")
        lower = x.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        parts.append(x.select(F.lit(2 * k - 2).alias("part"), "gram", "lang", F.log("p").alias("v")))
        parts.append(x.groupBy("lang", "context").agg(F.first("gamma").alias("gamma")).select(F.lit(2 * k - 1).alias("part"), F.col("context").alias("gram"), "lang", F.log("gamma").alias("v")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = work.write(every, "entries")
    root = work.path("ranges")
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    placed = every.repartitionByRange("part", "gram").sortWithinPartitions("part", "gram")
    written = placed.mapInArrow(_write_ranges(root, langs), "part int, first long, n_keys long, n_entries long, uri string").collect()
    m.ranges = sorted(tuple(r) for r in written)
    for df in (*(levels[k] for k in range(1, ORDER)), every):
        work.drop(df)
    return m


class Ranges:
    """The files of a model, opened when they are asked for."""

    def __init__(self, model: Model):
        self.unseen, self.n_langs, self.open = model.unseen, len(model.langs), {}
        self.parts = {p: [r for r in model.ranges if r[0] == p] for p in range(2 * ORDER)}
        self.firsts = {p: np.array([r[1] for r in rows], dtype=np.int64) for p, rows in self.parts.items()}

    def _arrays(self, part: int, i: int) -> tuple[np.ndarray, ...]:
        if (part, i) not in self.open:
            from pyarrow import fs

            _, _, keys, entries, uri = self.parts[part][i]
            store, path = fs.FileSystem.from_uri(uri)
            if isinstance(store, fs.LocalFileSystem):
                data = pa.memory_map(path).read_buffer()
            else:
                with store.open_input_file(path) as f:
                    data = f.read_buffer()
            at = 8 * (2 * keys + 1)
            self.open[part, i] = (np.frombuffer(data, np.int64, keys), np.frombuffer(data, np.int64, keys + 1, 8 * keys), np.frombuffer(data, np.int32, entries, at), np.frombuffer(data, np.float32, entries, at + 4 * entries))
        return self.open[part, i]

    def find(self, part: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the key, language, value) of all entries of the keys."""
        out = []
        which = np.searchsorted(self.firsts[part], keys, "right") - 1
        for i in np.unique(which[which >= 0]):
            table, starts, codes, values = self._arrays(part, int(i))
            rows = np.flatnonzero(which == i)
            at, found = _find(table, keys[rows])
            rows, at = rows[found], at[found]
            sizes = starts[at + 1] - starts[at]
            entry = np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            out.append((np.repeat(rows, sizes), codes[entry], values[entry]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each padded word under each language: from the lowest order up, what a language lacks is backed off to."""
        lots, size = [], max(1, WORK_CELLS // (16 * self.n_langs))
        for lo in range(0, len(words), size):
            part = words[lo : lo + size]
            key, owner = grams_of(part)
            key, back = np.unique(key, return_inverse=True)
            p = np.full((len(key), self.n_langs), self.unseen)
            for k in range(1, ORDER + 1):
                now, same = np.unique(key & ((1 << (BITS * k)) - 1), return_inverse=True)
                weight, own = np.zeros((len(now), self.n_langs)), np.full((len(now), self.n_langs), np.nan)
                rows, langs, v = self.find(2 * k - 1, now >> BITS)
                weight[rows, langs] = v
                rows, langs, v = self.find(2 * k - 2, now)
                own[rows, langs] = v
                own = own[same]
                p = np.where(np.isnan(own), p + weight[same], own)
            lots.append(np.stack([np.bincount(owner, weights=p[back, j], minlength=len(part)) for j in range(self.n_langs)], axis=1))
        return np.concatenate(lots) if lots else np.zeros((0, self.n_langs))


class Scorer:
    """Whole texts to (sum of log probabilities per language, number of scored characters)."""

    def __init__(self, model: Model):
        self.m, self.index, self.table, self.ranges = model, {}, np.zeros((0, len(model.langs) + 1)), Ranges(model)

    def batch(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        if self.table.size > CACHE_CELLS:
            self.index, self.table = {}, self.table[:0]
        seen = set()
        for ws in split:
            seen.update(ws)
        new = [w for w in seen if w not in self.index]
        if new:
            parts, owner = [], []
            for i, token in enumerate(new):
                for w in letters_of(token):
                    parts.append(w)
                    owner.append(i)
            rows = np.zeros((len(new), len(self.m.langs) + 1))
            if parts:
                scores = self.ranges.score_words(parts)
                for j in range(len(self.m.langs)):
                    rows[:, j] = np.bincount(owner, weights=scores[:, j], minlength=len(new))
                rows[:, -1] = np.bincount(owner, weights=[len(w) + 1 for w in parts], minlength=len(new))
            base = len(self.table)
            self.table = np.concatenate([self.table, rows])
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
        out = np.zeros((len(texts), len(self.m.langs) + 1))
        get = self.index.__getitem__
        for i, ws in enumerate(split):
            if ws:
                out[i] = self.table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
        if any(len(w) > CACHE_CHARS for w in new):
            for w in new:
                if len(w) > CACHE_CHARS:
                    del self.index[w]
        return out


def _slices(batch: pa.RecordBatch, name: str = "text", chars: int = 2_000_000, rows: int = 1000) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in small lots, so that a lot of long texts stays small in memory."""
    col, lo, part, size = batch.column(name), 0, [], 0
    for i in range(len(col)):
        part.append(col[i].as_py() or "")
        size += len(part[-1])
        if size >= chars or len(part) >= rows:
            yield lo, part
            lo, part, size = i + 1, [], 0
    if part:
        yield lo, part


def _entropies(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model.value)
        for batch in batches:
            for lo, texts in _slices(batch):
                r = s.batch(texts)
                langs = batch.column("lang").slice(lo, len(texts)).to_pylist()
                j = [s.m.langs.index(x) if x in s.m.langs else 0 for x in langs]
                n, at = r[:, -1], np.arange(len(texts))
                h = -r[:, :-1] / np.maximum(n, 1)[:, None]
                own = h[at, j]
                h[at, j] = np.inf
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(own), pa.array(h.min(axis=1)), pa.array(n)], ["lang", "h", "w", "n"])

    return run


def learn(spark: SparkSession, docs: DataFrame, usable: Column, calibration: int = CALIBRATION_TEXTS) -> Model:
    """Counts all rows of ``usable`` but about ``calibration`` of each language, which the rejection is calibrated on."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    texts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    langs = sorted(texts)
    if not langs:
        return Model()
    parts = 1 << 20
    some = F.create_map(*(F.lit(x) for lang, n in texts.items() for x in (lang, int(parts * min(CALIBRATION_SHARE, calibration / n)))))
    held_back = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(parts)) < some[F.col("lang")]
    counted = known.where(~held_back).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    counts = Scratch(spark, "language-counts").write(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "sums")
    m = estimate_ranges(spark, langs, counts)
    return calibrate(spark, m, known.where(held_back))


def calibrate(spark: SparkSession, m: Model, labelled: DataFrame) -> Model:
    shared = spark.sparkContext.broadcast(m)
    got = labelled.select("lang", "text").mapInArrow(_entropies(shared), "lang string, h double, w double, n double").where("n > 0").toArrow()
    lang, h, w, n = (got.column(c).to_numpy(zero_copy_only=False) if c == "lang" else got.column(c).to_numpy() for c in ("lang", "h", "w", "n"))
    own = [np.flatnonzero(lang == x) for x in m.langs]
    mean, spread, wrong = (np.full(len(m.langs), np.nan) for _ in range(3))
    for j, at in enumerate(own):
        if len(at) >= LEAST_TEXTS:
            mean[j] = np.average(h[at], weights=n[at])
            spread[j] = max(0.3, float(np.sqrt(np.mean((h[at] - mean[j]) ** 2 * np.minimum(n[at], 400)))))
            if np.isfinite(w[at]).all():
                wrong[j] = max(np.average(w[at], weights=n[at]), mean[j] + 1.0)
    rest = lambda x, default: np.where(np.isnan(x), np.nanmean(x) if np.isfinite(x).any() else default, x)
    m.mean, m.spread = rest(mean, 3.0), rest(spread, 3.0)
    m.wrong = np.maximum(rest(wrong, 6.0), m.mean + 1.0)
    return m


def _predict(model, reject_z: float, reject_share: float, drop: tuple[str, ...] = ("text",), prefix: str = ""):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model.value)
        m = s.m
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            for lo, texts in _slices(batch):
                r = s.batch(texts) if m.langs else np.zeros((len(texts), 1))
                n = r[:, -1]
                some = (n > 0) & bool(m.langs)
                lang, score, reject, best = np.full(len(texts), len(m.langs)), np.zeros(len(texts)), ~some, np.zeros(len(texts))
                if m.langs:
                    h = -r[:, :-1] / np.maximum(n, 1)[:, None]
                    lang = np.where(some, h.argmin(axis=1), len(m.langs))
                    best = np.where(some, h.min(axis=1), 0.0)
                    z = np.exp(-(h - h.min(axis=1)[:, None]) * np.minimum(n, SHARPNESS_CHARS)[:, None])
                    score = np.where(some, 1.0 / z.sum(axis=1), 0.0)
                    j = np.minimum(lang, len(m.langs) - 1)
                    excess = best - m.mean[j]
                    far = excess * np.sqrt(np.minimum(np.maximum(n, 1), 400)) > reject_z * m.spread[j]
                    reject = ~some | (far & (excess > reject_share * (m.wrong[j] - m.mean[j])))
                kept = [batch.column(c).slice(lo, len(texts)) for c in batch.schema.names if c not in drop]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(best), pa.array(reject)], [*(c for c in batch.schema.names if c not in drop), *(prefix + c for c in RESULT)])

    return run


def predict(spark: SparkSession, docs: DataFrame, model: Model, keys: dict[str, str], reject_z: float = REJECT_Z, reject_share: float = REJECT_SHARE) -> DataFrame:
    """``keys`` (name to type) are carried along; adds lang_pred, score, cross_entropy (nats per character) and rejected."""
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", lang_pred string, score double, cross_entropy double, rejected boolean"
    return docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(_predict(shared, reject_z, reject_share), schema)


def keep(spark: SparkSession, docs: DataFrame, model: Model, columns: dict[str, str]) -> DataFrame:
    """Like ``predict``, with the columns of ``docs`` (text too) as they are; the names of the results begin with ``__``."""
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items()) + ", __lang_pred string, __score double, __cross_entropy double, __rejected boolean"
    return docs.select(*(f"`{c}`" for c in columns)).mapInArrow(_predict(shared, REJECT_Z, REJECT_SHARE, (), "__"), schema)


def fold(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learns from the rows whose fold is not 2 and predicts all: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    model = learn(spark, docs, fold(4) != 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(4) == 2).alias("held_out"))
    return predict(spark, rows, model, {"doc_id": "long", "held_out": "boolean"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
