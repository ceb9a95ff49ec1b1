"""Ratcliff/Obershelp similarity and the joins that need it.

Spark has no such function, so the ratio is a Pandas UDF over Arrow batches; it only sees pairs of distinct normalised strings
that pass bounds which no qualifying pair fails. ``matches`` compares fixed-size signatures of characters and pairs of characters in blocks of
strings whose lengths fit: at thresholds on characters, two strings that are unlike share as many rare pairs of characters as not, so
joins on shared grams meet each pair of strings several times over, at many times the price of one comparison of signatures.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quillmark.functions.text import normalize_text
from quillmark.session import written

#: 64-bit words of a signature of characters and of one of pairs of characters.
WORDS = {1: 2, 2: 4}
#: Strings of one side in a block, at least and at most, and pairs that are compared at a time.
SMALL, LARGE, AT_ONCE = 2_000, 20_000, 65_536
#: Pairs that a block holds before they are compared further.
HELD = 524_288


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([(1.0 if a == b else SequenceMatcher(None, a, b).ratio()) if a and b else 0.0 for a, b in zip(left, right, strict=True)])


def nearest(k: int, overlap_weight: float, similarity_weight: float):
    """Of a title and its list of (doc_id, overlap, name), the k best of (doc_id, sim) by the weighted sum, if that is above 0, ties to the smaller doc_id.

    The ratio is computed from the best on, as far as the longest common subsequence leaves room for one of the k.
    """

    @F.pandas_udf("array<struct<doc_id:long,sim:double>>")
    def run(titles: pd.Series, lists: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out = []
        for a, found in zip(titles, lists, strict=True):
            order = []
            for r in found:
                b, both = r["name"], len(a) + len(r["name"])
                room = 1.0 if a == b else 2 * common_length(a, b) / both if a and b else 0.0
                order.append((-(overlap_weight * r["overlap"] + similarity_weight * room), r["doc_id"], r["overlap"], b))
            order.sort()
            kept: list[tuple[float, int, float]] = []
            for bound, doc, overlap, b in order:
                if len(kept) >= k and bound > kept[k - 1][0]:
                    break
                sim = (1.0 if a == b else SequenceMatcher(None, a, b).ratio()) if a and b else 0.0
                kept.append((-(overlap_weight * overlap + similarity_weight * sim), doc, sim))
                kept.sort()
            out.append([{"doc_id": doc, "sim": sim} for score, doc, sim in kept[:k] if score < 0])
        return pd.Series(out)

    return run


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table at a time as the bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def common_lengths(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs (left[i], right[j]), no less than the length of the longest common subsequence: that length, but for lefts of over
    256 characters, and for blocks of over 255 characters, of which some stand for each other."""
    alphabet: dict[str, int] = {}
    for t in (*left, *right):
        for c in t:
            alphabet.setdefault(c, len(alphabet) % 255)
    na, nb = np.array([len(t) for t in left]), np.array([len(t) for t in right])
    codes = np.full((len(right), int(nb.max())), 255, np.uint8)  # 255 is in no left
    for row, t in enumerate(right):
        codes[row, : len(t)] = [alphabet[c] for c in t]
    out = np.minimum(na[i], nb[j])
    for words in range(1, 5):
        mine = np.flatnonzero(-(-na // 64) == words)
        place = np.full(len(left), -1)
        place[mine] = np.arange(len(mine))
        at = np.zeros((words, len(mine), 256), np.uint64)
        own = np.zeros((words, len(mine)), np.uint64)
        for row, t in enumerate(left[x] for x in mine.tolist()):
            for p, c in enumerate(t):
                at[p // 64, row, alphabet[c]] |= np.uint64(1 << p % 64)
                own[p // 64, row] |= np.uint64(1 << p % 64)
        pairs = np.flatnonzero(place[i] >= 0)
        for lo in range(0, len(pairs), AT_ONCE):
            some = pairs[lo : lo + AT_ONCE]
            x, y = place[i[some]], j[some]
            rows = [np.full(len(x), ~np.uint64(0)) for _ in range(words)]
            for p in range(int(nb[y].max())):
                c, carry = codes[y, p], np.zeros(len(x), np.uint64)
                for w, row in enumerate(rows):
                    hit = row & at[w, x, c]
                    total = row + hit
                    over = total < row
                    total += carry
                    carry = (over | (total < carry)).astype(np.uint64) if w + 1 < words else carry
                    rows[w] = total | (row - hit)
            out[some] = na[i[some]] - sum(np.bitwise_count(row & own[w, x]).astype(np.int64) for w, row in enumerate(rows))
    return out


def _ratio_from(least: float):
    """The ratio where it is ``least`` at least, else null. Matching characters are a common subsequence, so most pairs need no more than its length."""

    @F.pandas_udf(DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        matcher, out, last = SequenceMatcher(None), [], None
        for a, b in zip(left, right, strict=True):
            r = None
            if 2 * common_length(a, b) >= least * (len(a) + len(b)) - 1e-9:
                if b != last:
                    matcher.set_seq2(b)  # what it knows of the second string serves all of its partners
                    last = b
                matcher.set_seq1(a)
                r = matcher.ratio()
            out.append(r if r is not None and r >= least else None)
        return pd.Series(out, dtype="float64")

    return ratio


def sequence_similarity(left: Column, right: Column) -> Column:
    """Of the normalised strings, in this order (the ratio is not symmetric); 0 if one is empty."""
    return _ratio(normalize_text(left), normalize_text(right))



def _numbered(t: str, q: int) -> list[str]:
    """The q-grams of a string, each with its number, so that equal multisets are equal sets."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(t) - q + 1):
        g = t[i : i + q]
        seen[g] = k = seen.get(g, 0) + 1
        out.append(f"{g}{k}")
    return out


def _bits(grams: list[str], words: int) -> list[int]:
    """One bit for each gram, by its hash, in signed 64-bit words."""
    out = [0] * words
    for g in grams:
        h = zlib.crc32(g.encode()) % (64 * words)
        out[h // 64] |= 1 << h % 64
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _signatures(q: int):
    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            signs = [[x for k in range(1, q + 1) for x in _bits(_numbered(t, k), WORDS[k])] for t in part["t"]]
            yield pd.DataFrame({"t": part["t"], "n": part["t"].map(len), "signs": signs})

    return rows


def _needed(least: float, k: int, total: np.ndarray) -> np.ndarray:
    """Shared k-grams that a ratio of ``least`` needs, of two lengths that add up to ``total``.

    The ratio is 2M / total, for M matching characters. They are shared characters; in pairs of neighbours, all but one
    for each run of them count, and between two runs one of the other total - 2M characters stands at least.
    """
    return np.ceil((least / 2 if k == 1 else 1.5 * least - 1) * total - (k - 1) - 1e-6)


def _near_pairs(least: float, q: int):
    """Pairs of a block that signatures do not rule out: neither string has so many grams which the other lacks that the rest is too
    few. A bit of one signature only stands for one such gram at least."""
    names = [f"s{i}" for i in range(sum(WORDS[k] for k in range(1, q + 1)))]
    first = [names.index(f"s{i}") for i in range(len(names) - WORDS[q], len(names))]  # words of the longest grams tell most

    def side(t: pa.Table):
        n = t["n"].to_numpy()
        order = np.argsort(n, kind="stable")
        return n[order], [t[c].to_numpy()[order].view(np.uint64) for c in names], order

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"left": pa.array([], pa.string()), "right": pa.array([], pa.string())})
        if not left.num_rows or not right.num_rows:
            return none
        (na, sa, oa), (nb, sb, ob) = side(left), side(right)
        lacking = [~x for x in sb]

        def alike(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            w = 0
            for k in range(1, q + 1):
                words, w = range(w, w + WORDS[k]), w + WORDS[k]
                for n, x, y, i, j in ((na, sa, sb, "a", "b"), (nb, sb, sa, "b", "a")):
                    own, other = (a, b) if i == "a" else (b, a)
                    alone = sum(np.bitwise_count(x[v][own] & ~y[v][other]).astype(np.int32) for v in words)
                    ok = n[own] - (k - 1) - alone >= _needed(least, k, na[a] + nb[b])
                    a, b = a[ok], b[ok]
            if not len(a):
                return none
            ta, tb = left["t"].take(pa.array(oa[a])), right["t"].take(pa.array(ob[b]))
            # each string once for the table of its characters
            ua, ia = np.unique(a, return_inverse=True)
            ub, ib = np.unique(b, return_inverse=True)
            longest = common_lengths(left["t"].take(pa.array(oa[ua])).to_pylist(), right["t"].take(pa.array(ob[ub])).to_pylist(), ia, ib)
            some = pa.array(2 * longest >= least * (na[a] + nb[b]) - 1e-9)
            return pa.table({"left": ta.filter(some), "right": tb.filter(some)})

        found, held, out = [], 0, [none]
        starts = np.flatnonzero(np.diff(na, prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(na)], strict=True):
            n = int(na[lo])
            r0, r1 = np.searchsorted(nb, math.ceil(n * least / (2 - least) - 1e-9), "left"), np.searchsorted(nb, math.floor(n * (2 - least) / least + 1e-9), "right")
            if r0 >= r1:
                continue
            room = n - (q - 1) - _needed(least, q, n + nb[r0:r1])  # so many grams may be missing
            step = max(1, AT_ONCE // int(r1 - r0))
            for at in range(lo, hi, step):
                end = min(hi, at + step)
                alone = np.zeros((end - at, r1 - r0), np.uint16)
                for w in first:
                    alone += np.bitwise_count(sa[w][at:end, None] & lacking[w][None, r0:r1])
                i, j = np.nonzero(alone <= room)
                if len(i):
                    found.append((i + at, j + r0))
                    held += len(i)
                if held >= HELD:  # what is held does not grow with the block
                    out.append(alike(found))
                    found, held = [], 0
        if found:
            out.append(alike(found))
        return pa.concat_tables(out)

    return run


class SignedTexts:
    """Distinct normalised strings (column ``t``) and their signatures, for joins at one threshold. With ``path`` they are written there, to be joined as often as wanted."""

    def __init__(self, texts: DataFrame, least: float, path: str | None = None):
        self.least, self.q = least, 2 if least >= 0.8 else 1
        n_signs = sum(WORDS[k] for k in range(1, self.q + 1))
        rows = texts.select("t").mapInPandas(_signatures(self.q), "t string, n int, signs array<long>")
        rows = rows.select("t", "n", *(F.get("signs", F.lit(i)).alias(f"s{i}") for i in range(n_signs)))
        if path:
            rows.write.parquet(path)
            rows = texts.sparkSession.read.schema(rows.schema).parquet(path)
        else:
            rows = written(rows, "signed")
        self.rows, self.count = rows, rows.count()

    def blocks(self) -> int:
        return max(1, -(-self.count // min(LARGE, max(SMALL, self.count // 8))))


def matches(left: SignedTexts, right: SignedTexts) -> DataFrame:
    """(left, right, score) of all pairs of strings with a ratio of at least the threshold of both.

    Lengths that fit are in the same band or in neighbouring ones. A band is cut into blocks of either side by a hash; each pair of
    blocks is one group, where signatures are compared 64 bits at a time, so no group grows with the table. Only pairs that are nearly
    alike come out; they are compared once, first by their longest common subsequence.
    """
    least = left.least
    band = F.floor(F.log(F.col("n")) / (math.log((2 - least) / least) + 1e-9))
    sides = []
    for own, other, near in ((left, right, (-1, 0, 1)), (right, left, (0,))):
        x = own.rows.withColumn("band", F.explode(F.array(*(band + i for i in near))))
        x = x.withColumn("own", F.pmod(F.xxhash64("t"), F.lit(own.blocks())).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other.blocks() - 1))))
        sides.append(x.withColumnsRenamed({"own": "i", "other": "j"} if own is left else {"own": "j", "other": "i"}).groupBy("band", "i", "j"))
    near = sides[0].cogroup(sides[1]).applyInArrow(_near_pairs(least, left.q), "left string, right string")
    pairs = near.repartition("right").sortWithinPartitions("right")
    return pairs.withColumn("score", _ratio_from(least)("left", "right")).where(F.col("score") >= least)


def one_more(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right) of strings (column ``t`` of either) where the right is the left with one character more.

    One half of the left is at its end of the right, so only rights that share a half and the length are tried without each of their characters.
    """
    n = F.length("t")
    half = lambda side, size, piece: F.xxhash64(F.lit(side), size, piece)
    h = F.floor(n / 2).cast("int")
    asked = left.select(F.explode(F.array(half(0, n + 1, F.substring("t", F.lit(1), h)), half(1, n + 1, F.substring("t", h + 1, n)))).alias("k")).distinct()
    g = F.floor((n - 1) / 2).cast("int")
    offered = right.where(n > 1).select("t", F.explode(F.array(half(0, n, F.substring("t", F.lit(1), g)), half(1, n, F.substring("t", g + 2, n)))).alias("k"))
    some = offered.join(asked, "k", "left_semi").select("t").distinct()
    tried = some.select(F.col("t").alias("right"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    tried = tried.select("right", F.concat(F.substring("right", F.lit(1), F.col("i") - 1), F.substring("right", F.col("i") + 1, F.length("right"))).alias("left")).distinct()
    return tried.join(left.select(F.col("t").alias("left")), "left").select("left", "right")


def best_matches(left: DataFrame, right: SignedTexts) -> DataFrame:
    """(left, right, score) of pairs with a ratio from the threshold on; all with the highest of each left (distinct strings ``t``, none of them a right).

    No string that differs has a higher ratio than one with a single character more; lefts that have such a right need no comparison with all others.
    """
    # written first, as the planner would compute the ratio of all that is tried, before the join
    one = written(one_more(left, right.rows.select("t")), "tried").withColumn("score", _ratio("left", "right"))
    one = written(one.where((F.col("score") >= right.least) & (F.col("score") == 2.0 * F.length("left") / (2 * F.length("left") + 1))), "one-more")
    rest = left.join(one.select(F.col("left").alias("t")).distinct(), "t", "left_anti")
    return one.unionByName(matches(SignedTexts(rest, right.least), right))


def distinct_texts(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(normalize_text(text).alias("t")).where(F.length("t") > 0).distinct()


def blocked_pairs(left: DataFrame, lkey: str, ltext: str, right: DataFrame, rkey: str, rtext: str, least: float) -> DataFrame:
    """(lkey, rkey, ltext, rtext, score) of all pairs with a ratio of at least ``least`` (above 0). Distinct normalised strings are compared once."""
    b = SignedTexts(distinct_texts(right, rtext), least)
    a = SignedTexts(distinct_texts(left, ltext), least)
    scored = matches(a, b)
    x = left.select(lkey, F.col(ltext).alias("__a"), normalize_text(ltext).alias("left"))
    y = right.select(rkey, F.col(rtext).alias("__b"), normalize_text(rtext).alias("right"))
    return scored.join(x, "left").join(y, "right").select(lkey, rkey, F.col("__a").alias(ltext), F.col("__b").alias(rtext), "score")


def best_others(items: DataFrame, key: str, text: str, rkey: str, rtext: str, least: float, k: int) -> DataFrame:
    """The k best other items of each item by ``blocked_pairs``, ties to the smaller key. Of the items of one text only the k + 1 smallest can be among them."""
    names = items.select(text).distinct()
    pairs = blocked_pairs(names.select(F.col(text).alias("__l"), text), "__l", text, names.select(F.col(text).alias("__r"), F.col(text).alias(rtext)), "__r", rtext, least).drop("__l", "__r")
    small = items.select(F.col(key).alias(rkey), F.col(text).alias(rtext))
    few = small.withColumn("__i", F.row_number().over(Window.partitionBy(rtext).orderBy(rkey))).where(F.col("__i") <= k + 1).drop("__i")
    top = pairs.join(few, rtext).withColumn("__i", F.row_number().over(Window.partitionBy(text).orderBy(F.desc("score"), rkey))).where(F.col("__i") <= k + 1).drop("__i")
    return best_match(items.join(top, text).where(F.col(key) != F.col(rkey)).select(key, rkey, text, rtext, "score"), key, rkey, k)


def best_match(pairs: DataFrame, lkey: str, rkey: str, k: int = 1) -> DataFrame:
    w = Window.partitionBy(lkey).orderBy(F.desc("score"), rkey)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
