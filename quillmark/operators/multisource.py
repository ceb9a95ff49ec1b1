"""Search and lookup over several sources of records, merged by identity.

Records have ``FIELDS``, source and source_score. What the sources return is put in one order (of the sources, then of each source's
ranks), folded by identity in that order, so that the richer record keeps its values and blanks are filled from the other, and ranked again.
Only what the sources return is joined with whole records: max(k, 3) of each source for a query, one of each for a lookup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.ident import author_coverage, base_arxiv, normalize_arxiv, normalize_doi, record_key, year_matches
from quillmark.functions.text import blank, normalize_text, tokenize
from quillmark.operators import audit, resolve, retrieve
from quillmark.operators.similarity import sequence_similarity
from quillmark.session import handed, written

FIELDS = ("title", "authors", "year", "venue", "abstract", "doi", "arxiv_id", "url")
LEAST_OF_SOURCE, MATCH = 3, 0.70
Similarity = Callable[[Column, Column], Column]


def completeness(r: Column) -> Column:
    """How many of the eight fields of a record struct are there."""
    text = sum((F.when(F.length(blank(r[f])) > 0, 1).otherwise(0) for f in FIELDS if f not in ("authors", "year")), F.lit(0))
    return text + F.when(F.size(r["authors"]) > 0, 1).otherwise(0) + F.when(r["year"].isNotNull(), 1).otherwise(0)


def _struct(r: DataFrame | Column, merged: Column) -> Column:
    names = [r[f].alias(f) for f in FIELDS]
    return F.struct(r["doc_id"].alias("doc_id"), *names, r["source"].alias("source"), r["source_score"].alias("source_score"), merged.alias("merged"))


def merge_two(a: Column, b: Column) -> Column:
    """The richer of two record structs (the first at a tie), its blanks filled from the other; all sources, and the better source score."""
    second = completeness(b) > completeness(a)
    p, o = (lambda f: F.when(second, b[f]).otherwise(a[f])), (lambda f: F.when(second, a[f]).otherwise(b[f]))
    filled = {f: F.when(F.length(blank(p(f))) > 0, p(f)).otherwise(o(f)) for f in FIELDS if f not in ("authors", "year")}
    filled |= {"authors": F.when(F.size(p("authors")) > 0, p("authors")).otherwise(o("authors")), "year": F.coalesce(p("year"), o("year"))}
    filled |= {"doi": normalize_doi(filled["doi"]), "arxiv_id": normalize_arxiv(filled["arxiv_id"])}
    every = F.array_sort(F.array_union(F.array_union(a["merged"], b["merged"]), F.filter(F.array(a["source"], b["source"]), lambda s: F.length(blank(s)) > 0)))
    return F.struct(p("doc_id").alias("doc_id"), *(filled[f].alias(f) for f in FIELDS), p("source").alias("source"), F.greatest(a["source_score"], b["source_score"]).alias("source_score"), every.alias("merged"))


def fold(found: DataFrame, by: list[str]) -> DataFrame:
    """``found``: ``by``, ord and the columns of records. One row for each of ``by`` and identity: rec, and ord of the first."""
    none = F.array().cast("array<string>")
    plain = [F.coalesce(F.col(f), F.lit("")).alias(f) if f not in ("authors", "year") else F.coalesce("authors", none).alias(f) if f == "authors" else F.col(f) for f in FIELDS]
    rows = found.select(*by, "ord", "doc_id", *plain, F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("source_score").cast("double"), F.lit(0.0)).alias("source_score"))
    rows = rows.select(*by, "ord", record_key("doi", "arxiv_id", "title").alias("identity"), _struct({c: F.col(c) for c in ("doc_id", *FIELDS, "source", "source_score")}, none).alias("rec"))
    # no more records of one identity for one query than the sources return
    g = rows.groupBy(*by, "identity").agg(F.array_sort(F.collect_list(F.struct("ord", "rec"))).alias("x"))
    rest = F.slice("x", F.lit(2), F.size("x"))
    return g.select(*by, "identity", F.col("x")[0]["ord"].alias("ord"), F.aggregate(rest, F.col("x")[0]["rec"], lambda acc, y: merge_two(acc, y["rec"])).alias("rec"))


def rank_score(query: Column, rec: Column, similarity: Similarity) -> Column:
    """Of a merged record for a query: words, title, the source's own score squashed to 0-1, and six fields that should be there."""
    asked = F.array_distinct(tokenize(query))
    shared = F.size(F.array_intersect(asked, tokenize(F.concat_ws(" ", rec["title"], rec["abstract"]))))
    has = sum((F.when(F.length(rec[f]) > 0, 1).otherwise(0) for f in ("venue", "abstract", "doi", "url")), F.when(F.size(rec["authors"]) > 0, 1).otherwise(0) + F.when(rec["year"].isNotNull(), 1).otherwise(0))
    own = F.greatest(rec["source_score"], F.lit(0.0))
    return 0.35 * shared / F.greatest(F.size(asked), F.lit(1)) + 0.30 * similarity(query, rec["title"]) + 0.20 * own / (own + 50) + 0.15 * has / 6


def _whole(hits: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """``hits`` (with at, the number of the source, and doc_id) and the columns of their records."""
    every, (hits, _) = None, handed(hits, "hits")
    for i, records in enumerate(sources.values()):
        rows = hits.where(F.col("at") == i).join(records.select("doc_id", *FIELDS, "source", "source_score"), "doc_id")
        every = rows if every is None else every.unionByName(rows)
    return every


def search(queries: DataFrame, sources: dict[str, DataFrame], k: int = 5, similarity: Similarity = sequence_similarity) -> DataFrame:
    """(query_id, rank, score, rec): the k best merged records for each query (query_id, q). Ties keep the order of the sources."""
    per = max(k, LEAST_OF_SOURCE)
    hits = None
    for i, records in enumerate(sources.values()):
        found = retrieve.overlap_search(records.select("doc_id", F.concat_ws(" ", "title", "abstract").alias("said")), "doc_id", "said", queries, "q", per)
        found = found.select("query_id", "doc_id", F.lit(i).alias("at"), (F.lit(i * per) + F.col("rank")).alias("ord"))
        hits = found if hits is None else hits.unionByName(found)
    merged = fold(_whole(hits, sources), ["query_id"]).join(queries.select("query_id", "q"), "query_id")
    scored = merged.withColumn("score", F.round(rank_score(F.col("q"), F.col("rec"), similarity), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "score", "rec")


def match_score(cand: Column, rec: Column, similarity: Similarity) -> Column:
    """Of a record for a reference: identifiers weigh most."""
    equal = lambda f, norm: (F.length(blank(cand[f])) > 0) & (F.length(blank(rec[f])) > 0) & (norm(cand[f]) == norm(rec[f]))
    return resolve.source_score(similarity(cand["title"], rec["title"]), equal("doi", normalize_doi), equal("arxiv_id", base_arxiv), author_coverage(cand["authors"], rec["authors"]), F.coalesce(year_matches(cand["year"], rec["year"]), F.lit(False)))


def _given(f: str) -> Column:
    return F.length(blank(f)) > 0


def _compared(asked: DataFrame, keys: list[DataFrame]) -> DataFrame:
    """(cand_id, at): the references whose title each source has to compare with similar ones.

    Title, authors and year score 0.40 together, so what is found by a similar title counts where it is merged with a record of the
    reference's DOI or base arXiv id. A record of that DOI is found by it. So the reference has an arXiv id, and the source a record of the
    identity of a record, of any source, of that id's base. Identifiers of which normalisation leaves nothing equal each other; they are rare and all compared.
    """
    known = None
    for i, records in enumerate(keys):
        rows = records.select(F.lit(i).alias("at"), F.when(_given("arxiv_id"), base_arxiv("arxiv_id")).alias("base"), record_key("doi", "arxiv_id", "title").alias("identity"))
        known = rows if known is None else known.unionByName(rows)
    known = written(known.distinct(), "known")
    bases = known.where("base is not null").select("base", "identity").distinct().join(known.select("at", "identity").distinct(), "identity").select("base", "at").distinct()
    base, bare = base_arxiv("arxiv_id"), (_given("doi") & (F.length(normalize_doi("doi")) == 0)) | (_given("arxiv_id") & (F.length(base_arxiv("arxiv_id")) == 0))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(keys) - 1))).alias("at")
    some = asked.where(_given("arxiv_id") & ~bare).select("cand_id", base.alias("base")).join(bases, "base").select("cand_id", "at")
    return written(some.unionByName(asked.where(bare).select("cand_id", every)), "compared")


def lookup(candidates: DataFrame, sources: dict[str, DataFrame], similarity: Similarity = sequence_similarity) -> DataFrame:
    """(cand_id, score, rec): each source looks a reference up by itself; of the merged records the best, if it scores MATCH at least.

    No reference without identifiers scores that (see ``_compared``). The rows are those of a lookup of all references and all titles.
    """
    hits = None
    asked = written(candidates.select("cand_id", "title", "authors", "year", "doi", "arxiv_id").where(_given("doi") | _given("arxiv_id")), "references")
    keys = [written(records.select("doc_id", "doi", "arxiv_id", "title"), "keys") for records in sources.values()]
    compared = _compared(asked, keys)
    for i, records in enumerate(keys):
        found = audit.cascade(asked, records, compared.where(F.col("at") == i)).where("doc_id is not null").select("cand_id", "doc_id", F.lit(i).alias("at"), F.lit(i).alias("ord"))
        hits = found if hits is None else hits.unionByName(found)
    asked = asked.select("cand_id", F.struct("title", "authors", "year", "doi", "arxiv_id").alias("cand"))
    merged = fold(_whole(hits, sources), ["cand_id"]).join(asked, "cand_id")
    scored = merged.withColumn("score", F.round(match_score(F.col("cand"), F.col("rec"), similarity), 6))
    best = scored.groupBy("cand_id").agg(F.min_by(F.struct("score", "rec"), F.struct(-F.col("score"), "ord")).alias("x"))
    return best.select("cand_id", "x.score", "x.rec").where(F.col("score") >= MATCH)


def same_title(a: Column, b: Column) -> Column:
    """1 for equal normalised titles, else 0: a similarity that SQL has too."""
    return F.when((F.length(normalize_text(a)) > 0) & (normalize_text(a) == normalize_text(b)), 1.0).otherwise(0.0)
