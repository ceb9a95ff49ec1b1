"""Streams against their batch rules, searches over sources and for counter-evidence against plain versions, joins by similarity."""

import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmark.functions.text import STOPWORDS
from quillmark.operators import audit, chunks, counter, labels, mixed, multisource, retrieve, rules, similarity
from quillmark.plans import catalogue, extended
from quillmark.session import new_folder, shared_dir
from quillmark.sources import adapters as A
from quillmark.streaming import audits, expiry, tables


def _norm(t):
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split())


def _tokens(t):
    return [w for w in _norm(t).split() if w not in STOPWORDS]


# ---- similarity --------------------------------------------------------------------------------------------------


def _titles(rng, n):
    words = ["".join(rng.choice(("an", "tion", "re", "con", "pro", "ing", "al", "ver", "sta", "lin")) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 12))) for _ in range(n)]


def _typo(rng, t):
    i = rng.randrange(len(t))
    return t[:i] + rng.choice(("", "x", t[i] * 2)) + t[i + 1 :]


@pytest.mark.parametrize("least", [0.85, 0.9, 0.65])
def test_pairs_equal_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(similarity, "SMALL", 30)  # many blocks
    rng = random.Random(1)
    right = [*_titles(rng, 110), "a", "ab", "abc", "", "b", "ab ab ab", "漢字 漢字漢字", "x" * 300, _titles(rng, 1)[0] * 5]
    left = [*(_typo(rng, t) for t in right[:60]), *_titles(rng, 40), "a", "ab", "abd", "", "漢字 テスト 漢字漢字", "x" * 290, right[-1] + "y"]
    norm = lambda t: " ".join("".join(c if (c.isascii() and c.isalnum()) or "一" <= c <= "鿿" else " " for c in t.lower()).split())
    want = {(i, j) for i, a in enumerate(map(norm, left)) for j, b in enumerate(map(norm, right)) if a and b and SequenceMatcher(None, a, b).ratio() >= least}
    a, b = (spark.createDataFrame(list(enumerate(x)), f"{k} long, {t} string") for x, k, t in ((left, "i", "x"), (right, "j", "y")))
    got = [(r["i"], r["j"]) for r in similarity.blocked_pairs(a, "i", "x", b, "j", "y", least).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert least > 0.8 or len(want) > 40


def test_common_lengths():
    import numpy as np

    rng = random.Random(2)
    left, right = (["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 260))) for _ in range(25)] for _ in range(2))
    i, j = np.divmod(np.arange(625), 25)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b):
                before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k + 1], row[k])
        return row[-1]

    got = similarity.common_lengths(left, right, i, j)
    assert got.tolist() == [plain(left[x], right[y]) if len(left[x]) <= 256 else got[k] for k, (x, y) in enumerate(zip(i, j, strict=True))]
    assert all(similarity.common_length(left[x], right[y]) == plain(left[x], right[y]) for x, y in zip(range(25), range(25), strict=True))


def test_similarity_join_at_size(spark):
    """3,000 by 3,000 distinct titles: every typo is found."""
    rng = random.Random(3)
    right = sorted({t for t in _titles(rng, 3600) if len(t) > 20})[:3000]
    left = [_typo(rng, t) if i % 5 == 0 else t[::-1] for i, t in enumerate(right)]
    a, b = (spark.createDataFrame(list(enumerate(x)), f"{k} long, {t} string") for x, k, t in ((left, "i", "x"), (right, "j", "y")))
    got = {(r["i"], r["j"]) for r in similarity.blocked_pairs(a, "i", "x", b, "j", "y", 0.85).select("i", "j").collect()}
    assert {(i, i) for i in range(0, len(right), 5)} <= got


# ---- retrieval ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "parts"), [(4096, "8"), (2, "3")])
def test_best_of_groups_equals_definition(spark, monkeypatch, block, parts):
    monkeypatch.setattr(retrieve, "BLOCK", block)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))), f"s{i % 3}") for i in range(120)]
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))) for i in range(9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        d, q = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(asked, "query_id long, q string")
        got = Counter((r["query_id"], r["source"], r["doc_id"], r["rank"]) for r in retrieve.overlap_search(d, "doc_id", "text", q, "q", 4, within="source").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = Counter()
    for i, t in asked:
        own = set(t.split())
        for s in ("s0", "s1", "s2"):
            scored = [(-round(len(own & set(x.split())) / len(own), 6), k) for k, x, src in docs if src == s and own & set(x.split())] if own else []
            want.update((i, s, k, rank) for rank, (_, k) in enumerate(sorted(scored)[:4], 1))
    assert got == want


# ---- keyed tables ------------------------------------------------------------------------------------------------

ROW = "key string, row_id long, value string, updated_at long"


def _table(spark, buckets=4):
    schema = spark.createDataFrame([], ROW).schema
    return tables.KeyedTable(spark, new_folder(spark, "table"), schema, order=("updated_at", "row_id"), buckets=buckets)


def _rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_replayed_batches_and_first_writes(spark):
    t = _table(spark)
    assert _rows(t) == []
    one = spark.createDataFrame([("a", 1, "x", 10), ("a", 2, "y", 10), ("b", 3, "z", 5)], ROW)
    two = spark.createDataFrame([("a", 4, "new", 20), ("c", 5, None, 7), ("b", 6, "late", 1)], ROW)
    assert t.merge(one, 0) and t.merge(two, 1)
    want = [("a", 4, "new", 20, 10), ("b", 3, "z", 5, 1), ("c", 5, None, 7, 7)]
    assert _rows(t) == want
    assert not t.merge(one, 0) and not t.merge(two, 1) and _rows(t) == want
    assert t.merge(one.limit(0), 2) and _rows(t) == want
    assert t.merge(one, 0, writer="other") and _rows(t) == want


def test_only_touched_buckets_are_rewritten(spark):
    t = _table(spark, buckets=16)
    t.merge(spark.createDataFrame([(f"k{i}", i, "x", i) for i in range(200)], ROW), 0)
    before = t.head()["buckets"]
    t.merge(spark.createDataFrame([("k5", 900, "y", 900)], ROW), 1)
    after = t.head()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(_rows(t)) == 200
    t.merge(spark.createDataFrame([("k5", 901, "z", 901)], ROW), 2)
    assert t.vacuum(keep=1) >= 1 and len(_rows(t)) == 200 and ("k5", 901, "z", 901, 5) in _rows(t)


def test_a_faster_writer_wins_and_nothing_is_lost(spark, monkeypatch):
    t = _table(spark)
    rival = tables.KeyedTable(spark, t.path, t.schema, order=t.order, buckets=t.buckets)
    create, calls = t.files.create, []

    def slow(name, text):
        if not calls:
            calls.append(rival.merge(spark.createDataFrame([("a", 7, "rival", 70), ("r", 8, "r", 1)], ROW), 0, writer="rival"))
        return create(name, text)

    monkeypatch.setattr(t.files, "create", slow)
    assert t.merge(spark.createDataFrame([("a", 1, "mine", 10), ("m", 2, "m", 2)], ROW), 0, writer="mine")
    assert calls == [True] and [r[:3] for r in _rows(t)] == [("a", 7, "rival"), ("m", 2, "m"), ("r", 8, "r")]
    assert t.head()["writers"] == {"rival": 0, "mine": 0}


# ---- expiry ------------------------------------------------------------------------------------------------------


def test_expiry_equals_the_batch_rule_at_every_trigger(spark):
    rng = random.Random(6)
    at, rows = 0, []
    for i in range(240):
        at += rng.randrange(0, 40)
        rows.append((f"k{rng.randrange(12)}", i, f"v{i}", rng.choice((0, 1, 3)), rng.random() < 0.2, at))
    folder = new_folder(spark, "entries")
    schema = "key string, row_id long, value string, record_count long, failed boolean, at timestamp"
    for n in range(6):
        part = spark.createDataFrame([(*r[:5], r[5]) for r in rows[n * 40 : n * 40 + 40]], "key string, row_id long, value string, record_count long, failed boolean, s long")
        part.withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(folder)
    positive, negative = 900, 200
    for k, v in expiry.STATE_STORE.items():
        spark.conf.set(k, v)
    out = new_folder(spark, "changes")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
        seen = []
        q = expiry.changes(stream, positive, negative).writeStream.foreachBatch(lambda b, i: seen.append((i, [tuple(r) for r in b.collect()])) and None).option("checkpointLocation", out).trigger(availableNow=True).start()
        q.awaitTermination()
        marks = {p["batchId"]: p["eventTime"].get("watermark") for p in q.recentProgress if "eventTime" in p}
    finally:
        for k in expiry.STATE_STORE:
            spark.conf.unset(k)
    from datetime import datetime

    live, read = {}, 0
    for i, changed in seen:
        mark = datetime.fromisoformat(marks[i].replace("Z", "+00:00")).timestamp() if marks.get(i) else 0
        if read < len(rows):
            read += 40
        for change, key, row_id, *_ in sorted(changed, key=lambda c: (c[0] == "put", c[4])):
            if change == "expired" and live.get(key) == row_id:
                del live[key]
            elif change == "put":
                live[key] = row_id
        for change, key, row_id, *_ in changed:  # put and gone within one trigger
            if change == "expired" and live.get(key) == row_id:
                del live[key]
        newest = {}
        for key, row_id, _, n, failed, s in rows[:read]:
            if not failed:
                newest[key] = (s, row_id, positive if n else negative)
        assert live == {k: r for k, (s, r, ttl) in newest.items() if mark - s < ttl}
    assert read == len(rows) and any(c[0] == "expired" for _, b in seen for c in b)


def test_a_bucket_of_keys_costs_a_few_calls_to_the_state():
    import pandas as pd

    calls = []

    class Handle:
        """State and timers of one bucket."""

        def __init__(self):
            self.state, self.timers = None, set()
            self.get, self.update = (lambda: calls.append("get") or self.state), (lambda x: calls.append("update") or setattr(self, "state", x))
            self.exists, self.clear = (lambda: self.state is not None), (lambda: setattr(self, "state", None))
            self.getValueState = lambda *_: self
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    h, p = Handle(), expiry.Expiring(900, 200)
    p.init(h)
    n = 5000
    rows = pd.DataFrame({"key": [f"k{i % n}" for i in range(2 * n)], "ms": [i // n * 10 for i in range(2 * n)], "row_id": range(2 * n), "value": "v", "record_count": [i % 2 for i in range(2 * n)], "failed": False})
    out = pd.concat(p.handleInputRows((0,), iter([rows[:n], rows[n:]]), None))
    assert len(calls) <= 4 and len(out) == n and set(out["updated_ms"]) == {10} and h.timers == {200_010}
    h.timers.clear()  # as Spark does with one that went off
    gone = pd.concat(p.handleExpiredTimer((0,), At(200_010), At(200_010)))
    assert set(gone["key"]) == {f"k{i}" for i in range(0, n, 2)} and h.timers == {900_010} and len(calls) <= 8
    assert [*p.handleInputRows((0,), iter([rows[:n]]), None)][0]["key"].nunique() == n // 2  # those that are gone may come again, those held are newer
    assert h.timers == {200_000}


# ---- audits ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cut", [[], [7], [1, 50, 60, 199]])
def test_stream_of_references_equals_one_batch(spark, sf_dir, cut):
    corpus, cands = A.corpus(spark, sf_dir), A.candidates(spark, sf_dir)
    folder = new_folder(spark, "references")
    edges = [-1, *cut, 10**9]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = cands.where((F.col("cand_id") > lo) & (F.col("cand_id") <= hi))
        again = cands.where((F.col("cand_id") <= lo) & (F.col("cand_id") % 9 == 0))  # those that came before
        part.unionByName(again).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(cands.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = new_folder(spark, "audits")
    audits.audits(stream, corpus, out).awaitTermination()
    got = sorted(tuple(r) for r in audits.results(corpus, out).collect())
    assert got == sorted(tuple(r) for r in audits.audit_batch(cands, corpus).collect())
    assert {r[2] for r in got} == {"doi", "arxiv", "title", "similar", "none"}


def test_shared_folder_is_required_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(RuntimeError):
        shared_dir(Cluster)


# ---- several sources ---------------------------------------------------------------------------------------------

RECORD = "doc_id long, title string, authors array<string>, year int, venue string, abstract string, doi string, arxiv_id string, url string, source string, source_score double"


def _full(r):
    return sum(bool(r[f]) for f in multisource.FIELDS)


def _merge(a, b):
    p, o = (b, a) if _full(b) > _full(a) else (a, b)
    out = {f: p[f] or o[f] for f in multisource.FIELDS}
    out["doi"] = out["doi"].lower()
    return out | {"doc_id": p["doc_id"], "source": p["source"], "source_score": max(a["source_score"], b["source_score"]), "merged": sorted({*a["merged"], *b["merged"], a["source"], b["source"]})}


def test_search_over_sources_equals_definition(spark):
    rng = random.Random(7)
    words = "deep graph model citation network language bayes kernel proof survey".split()
    sources = {}
    for name in ("one", "two", "three"):
        rows = []
        for i in range(25):
            k = rng.randrange(18)  # works that several sources have
            has = lambda x, p=0.6: x if rng.random() < p else ""
            rows.append({"doc_id": i, "title": " ".join(random.Random(k).choice(words) for _ in range(4)), "authors": rng.choice(([], ["A B"])), "year": rng.choice((None, 2000 + k)), "venue": has(f"V{name}"), "abstract": has(" ".join(rng.choice(words) for _ in range(6))), "doi": has(rng.choice((f"10.1/K{k}", f"10.1/k{k}")), 0.5), "arxiv_id": "", "url": has(f"https://{name}/{i}"), "source": name, "source_score": float(rng.randrange(90))})
        sources[name] = rows
    asked = [(i, " ".join(rng.choice(words) for _ in range(3))) for i in range(6)]
    frames = {n: spark.createDataFrame([tuple(r[f.split()[0]] for f in RECORD.split(", ")) for r in rows], RECORD) for n, rows in sources.items()}
    queries = spark.createDataFrame(asked, "query_id long, q string")
    for k in (2, 5):
        got = {(r["query_id"], r["rank"]): r for r in multisource.search(queries, frames, k).collect()}
        n = 0
        for i, t in asked:
            own, found = set(_tokens(t)), {}
            for rows in sources.values():
                scored = sorted(((-round(len(own & set(_tokens(r["title"] + " " + r["abstract"]))) / len(own), 6), r["doc_id"], j) for j, r in enumerate(rows)), key=lambda x: x[:2])
                for s, _, j in scored[: max(k, 3)]:
                    if s < 0:
                        r = rows[j] | {"merged": []}
                        key = ("doi", r["doi"].lower()) if r["doi"] else ("title", _norm(r["title"]))
                        found[key] = _merge(found[key], r) if key in found else r

            def score(r):
                sim = SequenceMatcher(None, _norm(t), _norm(r["title"])).ratio()
                six = sum(bool(r[f]) for f in ("authors", "year", "venue", "abstract", "doi", "url")) / 6
                return round(0.35 * len(own & set(_tokens(r["title"] + " " + r["abstract"]))) / len(own) + 0.30 * sim + 0.20 * r["source_score"] / (r["source_score"] + 50) + 0.15 * six, 6)

            for rank, r in enumerate(sorted(found.values(), key=score, reverse=True)[:k], 1):
                g = got[i, rank]
                assert (g["score"], g["rec"]["doc_id"], g["rec"]["source"], g["rec"]["merged"]) == (pytest.approx(score(r), abs=2e-6), r["doc_id"], r["source"], r["merged"])
                assert [g["rec"][f] or None for f in ("title", "year", "venue", "abstract", "url")] == [r[f] or None for f in ("title", "year", "venue", "abstract", "url")]
                n += 1
        assert len(got) == n


# ---- counter-evidence --------------------------------------------------------------------------------------------


def _references(spark, n=60):
    """References and three sources of few titles, near titles, identifiers of several versions and identifiers of which nothing is left."""
    rng = random.Random(5)
    titles = ["a study of graph search engines", "a study of graph search engine", "b study of graph search engines", "the quick brown fox jumps over", "the quick brown fox jumped over", "quick brown foxes jump over it", ""]
    dois, ids = ["", "", "10.1/a", "doi: 10.1/A", "10.1/b", "doi:", None], ["", "", "2001.00001v1", "arXiv: 2001.00001v2", "2001.00002", "v2", "arxiv:", None]
    row = lambda i: (i, rng.choice(titles), ["Ann B"], rng.choice([2000, 2001, 2005]), rng.choice(["", "V"]), "", rng.choice(dois), rng.choice(ids), "")
    schema = "doc_id long, title string, authors array<string>, year int, venue string, abstract string, doi string, arxiv_id string, url string"
    frames = {name: spark.createDataFrame([row(i) for i in range(8)], schema).withColumns({"source": F.lit(name), "source_score": F.lit(1.0)}) for name in ("x", "y", "z")}
    return spark.createDataFrame([row(i) for i in range(n)], schema).withColumnRenamed("doc_id", "cand_id"), frames


def test_lookup_equals_that_of_all_titles(spark, monkeypatch):
    asked, frames = _references(spark)
    got = {r["cand_id"]: r for r in multisource.lookup(asked, frames).collect()}
    cascade = audit.cascade
    monkeypatch.setattr(audit, "cascade", lambda candidates, corpus, compared=None: cascade(candidates, corpus))
    every = {r["cand_id"]: r for r in multisource.lookup(asked, frames).collect()}
    assert got == every and len(every) > 10
    monkeypatch.setattr(multisource, "_given", lambda f: F.lit(True))
    assert got == {r["cand_id"]: r for r in multisource.lookup(asked, frames).collect()}


def test_lookup_compares_no_titles_in_vain(spark, monkeypatch):
    asked, frames = _references(spark)
    few = asked.where("coalesce(arxiv_id, '') = '' AND coalesce(doi, '') NOT IN ('', 'doi:') OR coalesce(doi, '') = '' AND coalesce(arxiv_id, '') = ''")

    def refuse(left, right):
        raise AssertionError("titles are compared with all others")

    monkeypatch.setattr(audit, "best_matches", refuse)
    assert multisource.lookup(few, frames).count() > 0


def test_leads_are_folded_ranked_and_cut(spark):
    record = "doc_id long, title string, abstract string, doi string, arxiv_id string, source_score double"
    records = spark.createDataFrame(
        [
            (1, "Pruning improves speed of parsers", "", "10.1/A", "", 0.0), (2, "Copy of it", "Pruning improves speed", "10.1/a", "", 0.9), (3, "Pruning does not improve speed", "", "", "", 0.0),
            (4, "Cooking at home", "", "", "", 1.0), (5, "", "", "", "", 0.0), (6, "Speed is worse", "", "", "2001.00001", None),
        ],
        record,
    )
    claims = spark.createDataFrame([(7, "Pruning  improves speed"), (8, "  "), (9, None), (10, "Unheard words")], "claim_id long, claim string")
    rows = counter.search(claims, "claim_id", "claim", records, 3).orderBy("claim_id", "rank").collect()
    assert [(r["claim_id"], r["rank"]) for r in rows] == [(7, 1), (7, 2), (7, 3)]
    assert [r["doc_id"] for r in rows] == [3, 1, 6]  # a cue outranks likeness; 2 is 1 again
    assert rows[0]["signal"] == "explicit_contradiction_cue" and rows[1]["signal"] == "related_candidate"
    assert rows[0]["roles"] == ["claim_similarity", "improvement_negation"] and rows[0]["queries"][0] == "Pruning improves speed"
    assert rows[0]["score"] == pytest.approx(0.55 * 2 / 3 + 0.35)
    assert [r["evidence_scope"] for r in rows] == ["title"] * 3
    assert counter.search(claims, "claim_id", "claim", records, 1).count() == 1


def test_cues_are_the_rules(spark, sf_dir):
    pairs = extended._pairs(spark, sf_dir)
    x = rules.evaluate(pairs, "claim", "evidence")
    norm = lambda c: extended.text.normalize_text(c)
    x = x.withColumn("m", rules.cues(norm("claim"), "claim").bitwiseAND(rules.cues(norm("evidence"), "evidence")))
    for r in x.collect():
        assert [rule.name for i, rule in enumerate(rules.RULES) if r["m"] >> i & 1] == r["fired"]


def test_flags_and_enrichment(spark):
    rows = [("supported", "", "x", "abstract", ""), ("contradicted", "", "x", "abstract", "contradicted"), ("weakly_supported", "", "x", "a", "weak_support"), ("insufficient_evidence", "ambiguous", "x", "a", "unresolved_citation"), ("insufficient_evidence", "verified", "heuristic", "none", "heuristic_limited"), ("insufficient_evidence", "", "x", "none", "no_evidence_text"), ("insufficient_evidence", "", "x", "a", "insufficient_evidence")]
    df = spark.createDataFrame(rows, "verdict string, resolution string, engine string, scope string, want string")
    for r in df.select("verdict", "want", counter.review_flags(*(F.col(c) for c in ("verdict", "resolution", "engine", "scope"))).alias("f")).collect():
        assert r["f"]["counterevidence_reason"] == r["want"] and r["f"]["counterevidence_review"] == (r["verdict"] != "supported")
    sets = spark.createDataFrame([("supported", 1, ""), ("contradicted", 0, "contradicted"), ("insufficient_evidence", 2, "weak_support"), ("insufficient_evidence", 0, "insufficient_evidence")], "v string, n int, want string")
    assert all(r["r"] == r["want"] for r in sets.select("want", counter.set_review_flags(F.col("v"), F.col("n"))["counterevidence_reason"].alias("r")).collect())
    records = spark.createDataFrame([(3, "Pruning does not improve speed", "", "", "", 0.0)], "doc_id long, title string, abstract string, doi string, arxiv_id string, source_score double")
    items = spark.createDataFrame([(0, "Pruning improves speed", True), (1, "Pruning improves speed", False), (2, "Pruning improves  speed", True), (3, None, True)], "i long, claim string, counterevidence_review boolean")
    got = {r["i"]: r["counterevidence"] for r in counter.enrich(items, "i", "claim", records).collect()}
    assert [x["doc_id"] for x in got[0]] == [3] and got[0] == got[2] and got[1] is None and got[3] is None


# ---- chunks and caps ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_chunks_keep_their_order_under_any_partitioning(spark, parts):
    rng = random.Random(8)
    rows = []
    for owner in range(4):
        for i in range(40):
            rows.append((owner, i, rng.choice(("Same text", "same  TEXT", "other", "", None, f"own {i % 9}")), rng.choice(("", "https://a/" + str(i))), rng.choice(("", f"n{i}")), rng.choice(("", "abstract"))))
    df = spark.createDataFrame(rows, "owner long, i int, text string, source_url string, source_name string, evidence_scope string").repartition(parts)
    got = defaultdict(list)
    for r in chunks.merge(df, "owner", ["i"]).orderBy("owner", "position").collect():
        got[r["owner"]].append((r["text"], r["source_url"], r["source_name"], r["evidence_scope"]))
    want = defaultdict(list)
    for owner, _, text, url, name, scope in rows:
        text = " ".join((text or "").split())
        own = [text, url, name, scope]
        same = next((x for x in want[owner] if x[0].lower() == text.lower()), None)
        if not text:
            continue
        if same is None:
            want[owner].append(own)
        elif not same[1] and url:
            same[:] = [text, url, name or "", scope or ""]
        else:
            same[2], same[3] = same[2] or name, same[3] or scope
    # a chunk that takes another's place brings its own facts
    assert got == {k: [tuple(x) for x in v] for k, v in want.items()}


def test_attached_abstracts(spark):
    df = spark.createDataFrame([(0, "", "given"), (1, "own text", "Own, text!"), (2, "own", "another"), (3, None, None), (4, "own", " ")], "i int, abstract string, given string")
    got = {r["i"]: (r["abstract"], r["own"] and r["own"]["text"]) for r in chunks.attach(df).collect()}
    assert got == {0: ("given", None), 1: ("own text", None), 2: ("own", "another"), 3: ("", None), 4: ("own", None)}


def _greedy(rows, caps, limit):
    counts, out = Counter(), []
    for r in rows:
        facets = [(f, r[f]) for f in caps]
        if all(counts[f] < caps[f[0]] for f in facets):
            out.append(r["i"])
            counts.update(facets)
        if len(out) == limit:
            break
    return out


@pytest.mark.parametrize(("n", "limit"), [(0, 5), (400, 60), (20_000, 100_000)])
def test_joint_caps_equal_the_sequence(spark, n, limit):
    rng = random.Random(n)
    rows = [{"i": i, "lang": rng.choice(["en"] * 6 + ["zh", None]), "kind": f"k{rng.randrange(9)}", "scope": f"s{rng.randrange(30)}"} for i in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "i long, lang string, kind string, scope string").repartition(5)
    for caps in ({"lang": 30, "kind": 12, "scope": 3}, {"lang": n // 3 + 1, "kind": n // 20 + 1, "scope": n // 50 + 1}):
        got = [r["i"] for r in labels.joint_caps(df, ["i"], caps, limit).orderBy("i").collect()]
        assert got == _greedy(rows, caps, limit)
    assert labels.joint_caps(df, ["i"], {"lang": 0}, 5).count() == 0


def test_names_of_queries_do_not_repeat():
    with pytest.raises(ValueError, match="two queries"):
        catalogue._query("bm25_topk")(lambda spark, sf: None)


def test_cascade_by_prepared_lookups(spark, sf_dir):
    corpus, cands = A.corpus(spark, sf_dir), A.candidates(spark, sf_dir)
    made = audit.Lookups(corpus, new_folder(spark, "lookups"))
    one, two = (sorted(map(str, audit.cascade(cands, x).collect())) for x in (corpus, made))
    assert one == two


def test_mixed_batches(spark):
    """Items by index: a fault is a row; a single citation and a set are folded by their own rules."""
    verdicts = {1: ("supported", 0.8, "abstract", "verified"), 2: ("weakly_supported", 0.4, "title", "verified"), 3: ("weakly_supported", 0.6, "full_text", "verified"), 4: ("contradicted", 0.7, "abstract", "verified"), 5: ("insufficient_evidence", 0.0, "none", "ambiguous"), 6: ("insufficient_evidence", 0.0, "none", "verified")}
    items = [(0, "c", [1], None), (1, "c", [2, 3], None), (2, " ", [1], None), (3, "c", [], None), (4, "c", None, None), (5, "c", [1, 4, 2], None), (6, "c", [5], None), (7, "c", [2], "citation_set"), (8, "c", [6], ""), (9, "c", [1], "odd"), (10, "c", [99], None), (11, "c", [2, 1, 1], "citation")]
    df = spark.createDataFrame(items, "idx long, claim string, citations array<long>, input_mode string").repartition(3)
    known = spark.createDataFrame([(k, *v, "heuristic") for k, v in verdicts.items()], "citation long, verdict string, confidence double, scope string, resolution string, engine string")
    got = {r["idx"]: r for r in mixed.audit_items(df, lambda pairs: pairs.join(known, "citation")).collect()}
    assert sorted(got) == list(range(12))
    assert [got[i]["error"] for i in (2, 3, 4, 9)] == ["missing_claim", "missing_citation", "missing_citation", "unknown_mode"] and all(got[i]["verdict"] is None for i in (2, 3, 4, 9))
    show = lambda i: (got[i]["input_mode"], got[i]["verdict"], got[i]["confidence"], got[i]["risk_score"], got[i]["evidence_scope"], got[i]["support_mode"], got[i]["next_action"], got[i]["counterevidence_reason"])
    assert show(0) == ("citation", "supported", 0.8, 0.05, "abstract", None, "keep_claim", "")
    assert show(1) == ("citation_set", "weakly_supported", 0.5, 0.6, "mixed_with_full_text", "multiple_weak_support", "tighten_claim_or_inspect_full_text", "weak_support")
    assert show(5) == ("citation_set", "contradicted", 0.7, 0.98, "abstract", "contradiction_dominates", "rewrite_or_replace_evidence", "contradicted")
    assert show(6) == ("citation", "insufficient_evidence", 0.0, 0.9, "none", None, "disambiguate_identifier", "unresolved_citation")
    assert show(7) == ("citation_set", "weakly_supported", 0.4, 0.6, "title", "single_weak_support", "tighten_claim_or_inspect_full_text", "weak_support")
    assert show(8)[6:] == ("inspect_full_text_or_find_stronger_citation", "heuristic_limited") and show(10)[7] == "no_evidence_text"
    assert show(11)[:2] == ("citation", "weakly_supported") and (got[5]["supporting"], got[5]["contradicting"]) == (2, 1)
