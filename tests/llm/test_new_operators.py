"""Periodic runs, ranked lexical search and Arrow sequences: against brute force, and the edge cases that their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import arrowfile, lexical, periodic

ODD = [None, "", " \t\n", "a", "a a a a a a a", "x y " * 30, " é 漢字 ≥ z", "<|endoftext|> 's 'S don't", "one two three " * 20_000, "ΑΣ İ ǅ ́x y\0z"]


def _docs(spark, rows, parts=3):
    rows = [(i, t, "clash", 1) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, `row` string, `a.b` int").repartition(parts)


def _prose(rng, n):
    return " ".join(rng.choice("the of Tree river2 stone, cloud night paper -- glass wind".split()) + rng.choice(["", "", "s", "9"]) for _ in range(n))


# 11 ------------------------------------------------------------------------------------------------------------


def _runs(w, least, exponent):
    """By definition: every period, every stretch."""
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            if n >= max(least, exponent * p) and not any(all(w[x] == w[x + q] for x in range(s, s + n - q)) for q in range(1, p)):
                out.append((s, n, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (5, 3), (12, 2)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(700):
        w, k = [], rng.choice([1, 2, 3, 6])
        while len(w) < rng.randrange(90):
            unit = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
            w += unit * rng.randrange(2, 8) if rng.random() < 0.5 else [rng.randrange(k + 5) for _ in range(5)]
        assert periodic.find_runs(np.array(w, np.int32), least, exponent) == _runs(w, least, exponent)


def test_stretches_hold_every_run_and_leave_prose_out():
    rng = random.Random(2)
    w = [int(rng.paretovariate(0.6)) % 5000 for _ in range(20_000)]
    w[7000:7000] = [1, 2, 3] * 40
    found = periodic.stretches(np.array(w, np.int32))
    assert any(a <= 7000 and b >= 7120 for a, b in found)
    assert sum(b - a for a, b in found) < 2000


def test_automaton_of_a_long_periodic_text_stays_small():
    w = np.array([*range(400)] * 500, np.int32)
    assert periodic.find_runs(w) == [(0, 200_000, 400)]


def test_periodic_query_equals_definition(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, _prose(rng, rng.randrange(1, 200))) for i in range(300)] + [(None, "k k k k k k k"), (100, "z z z z z z"), (100, "z z z z z z")]
    _docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in periodic.query(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 0
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        number = {x: k for k, x in enumerate(dict.fromkeys(w))}
        runs = periodic.find_runs(np.array([number[x] for x in w], np.int32)) if n > 5000 else _runs(w, 6, 4)
        drop = {j for s, m, p in runs for j in range(s + p, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in drop))] += 1
    assert got == want


def test_periodic_on_an_empty_table(spark):
    assert periodic.periodic_runs(_docs(spark, [])).count() == 0


# 12 ------------------------------------------------------------------------------------------------------------


def test_numbers_survive_packing():
    rng = random.Random(4)
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**62, *(rng.randrange(1 << rng.randrange(1, 60)) for _ in range(500))], np.int64)
    data, at = lexical.pack(v)
    assert lexical.unpack(data).tolist() == v.tolist() and at[-1] == len(data)
    assert lexical.unpack(data[at[3] : at[9]]).tolist() == v[3:9].tolist()
    assert lexical.pack(v[:0])[0] == b"" and len(lexical.unpack(b"")) == 0


def test_terms_are_those_of_the_pattern():
    rng = random.Random(5)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for _ in range(300):
        t = "".join(rng.choice("aZ09 .,_^`{|}\x7f\x80 éÉ漢 \0\n-") for _ in range(40))
        assert [x.decode() for x in lexical.terms(t.encode())] == [x.translate(lower) for x in pattern.findall(t)]


def _ranking(docs, items, k):
    held = [(i, Counter(x.decode() for x in lexical.terms((t or "").encode()))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, q in items:
        asked = {x.decode() for x in lexical.terms((q or "").encode())}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked if df[t]}
        scored = [(sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * m * n // total))) for t in w if t in c), i) for i, c, m in held]
        best = sorted(((s, i) for s, i in scored if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("postings", [1, 40, 4_000_000])
def test_search_equals_brute_force(spark, postings):
    rng = random.Random(6)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(20 + i, _prose(rng, rng.randrange(1, 60))) for i in range(150)] + [(None, "Tree of glass")] + [(7, "river2 stone")] * 3
    items = [(i, _prose(rng, rng.randrange(1, 12))) for i in range(40)] + [(50, None), (51, "?!"), (52, "unknownword"), (53, "é 漢字 TREE tree"), (3, "stone")]
    index = lexical.LexicalIndex(spark, _docs(spark, docs), postings)
    queries = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int").repartition(2)
    for k in (1, 5, 500):
        got = [tuple(r) for r in index.search(queries, k).collect()]
        assert Counter(got) == Counter(_ranking(docs, items, k))


def test_skipped_lists_do_not_change_a_shard():
    rng = random.Random(7)
    for _ in range(200):
        lists = {}
        for t in "abcdef":
            docs = sorted(rng.sample(range(60), rng.randrange(1, 60)))
            gains = [rng.randrange(0, 4 if t < "d" else 30) for _ in docs]
            lists[t] = (docs, gains, max(gains))
        total = Counter()
        for d, g, _ in lists.values():
            for x, y in zip(d, g, strict=True):
                total[x] += y
        want = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))
        for k in (1, 4, 100):
            assert lexical.best_of_shard(lists, list("abcdefg"), k) == want[:k]


def test_search_on_empty_tables(spark):
    items = spark.createDataFrame([(1, "tree")], "item_id long, text string")
    assert lexical.LexicalIndex(spark, _docs(spark, [])).search(items, 5).count() == 0
    assert lexical.LexicalIndex(spark, _docs(spark, [(1, "tree")])).search(items.limit(0), 5).count() == 0


# 13 ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(arrowfile.tokenizer_path(arrowfile.TOKENIZER))
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(whole):
    enc = arrowfile.encoder(arrowfile.TOKENIZER)
    assert enc.chunked
    rng = random.Random(8)
    pool = [*"aAbBzZ 09'.,!?-\n\t\r\x0b\x0c\x1c\x85  ​́éÉçßσςΣİı漢가👩‍👧\0", *map(chr, range(0xA1, 0x180)), "'s", "'LL", "<|endoftext|>", "<|", " the", "x" * 70]
    texts = [t or "" for t in ODD[:-2]] + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for lo in range(0, len(texts), 500):
        for t, got in zip(texts[lo : lo + 500], enc.batch(pa.array(texts[lo : lo + 500])), strict=True):
            assert np.frombuffer(got, enc.dtype).tolist() == whole(t), repr(t)


def test_remembered_keys_move_back():
    r = arrowfile.Remembered(2)
    for keys in ("abc", "ad", "ae"):
        for k in r.unknown(set(keys)):
            r.now[k] = k.upper()
        assert all(r.now[k] == k.upper() for k in keys)
    assert len(r.now) + len(r.older) <= 6


@pytest.mark.parametrize("file_sequences", [1, 7, 32_768])
def test_sequences_round_trip(spark, whole, file_sequences):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20 + i, _prose(rng, rng.randrange(1, 80))) for i in range(200)] + [(None, "first"), (None, None), (30, "again"), (30, "again")]
    data = arrowfile.SequenceDataset(spark, _docs(spark, rows), seq_len=64, file_sequences=file_sequences)
    want = sorted(((i, [*whole(t), 2]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted((tuple(r) for r in data.read_back().collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [i for i, _ in want]
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(x), crc(x)) for i, x in want)
    # any sequence, without reading those before it: views into the mapped file, all of one length
    files = data.files.orderBy("part", "nth").collect()
    at = 0
    for f in files:
        reader = arrowfile.SequenceReader(data.root, f["file"])
        pieces, real = [], 0
        for i in reversed(range(f["n_sequences"])):
            ids, mask = reader.sequence(i)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata and not ids.flags.writeable
            assert mask.to_pylist() == [i * 64 + j < f["n_tokens"] for j in range(64)]
            real += mask.true_count
            pieces.insert(0, ids)
        assert real == f["n_tokens"] and f["base"] == at
        starts = [d[1] for d in reader.documents()]
        flat = np.concatenate(pieces)
        assert starts[0] == 0 and all(flat[s - 1] == 2 for s in starts[1:])
        at += real


def test_a_hot_id_is_split(spark):
    rows = [(5, f"text {i}") for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = arrowfile.SequenceDataset(spark, _docs(spark, rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert data.files.count() > 2 and data.files.agg(F.max("n_docs")).first()[0] < 2000
    assert data.read_back().count() == 4000


def test_sequences_of_an_empty_table(spark):
    assert arrowfile.SequenceDataset(spark, _docs(spark, [])).read_back().count() == 0
