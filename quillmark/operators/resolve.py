"""Resolution of citations by score: the record that an identifier names, the one that a lookup finds, and search results.

Records are scored by ``match_score``: an equal DOI or arXiv id is 1, else title similarity, authors and year. The search is a
ranked one, as a source's: of the ``pool`` records that share most of a title's tokens, the ``search`` best by overlap and
similarity (``search_score``). A title is compared with few others, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.ident import author_coverage, base_arxiv, normalize_arxiv, normalize_doi, year_matches
from quillmark.functions.text import blank, normalize_text
from quillmark.operators import audit, retrieve, similarity
from quillmark.session import written

POOL, SEARCH = 20, 5
#: Weights of overlap and similarity in a search.
SEARCH_WEIGHTS = (0.6, 0.4)
FIELDS = ("title", "authors", "year", "venue", "doi", "arxiv_id")
#: Fixed value: the source that is asked about each identifier.
AUTHORITY = {"arxiv_id": "arxiv", "doi": "crossref"}


def source_score(title: Column, same_doi: Column, same_arxiv: Column, authors: Column, year: Column) -> Column:
    """Of a record of a source: identifiers weigh most, 1 at most."""
    b = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), 0.6 * b(same_doi) + 0.6 * b(same_arxiv) + 0.25 * title + 0.10 * authors + 0.05 * b(year))


def completeness8(r: str = "rec") -> Column:
    """How many of eight fields a record has."""
    c = lambda f: F.length(blank(F.col(f"{r}.{f}"))) > 0
    have = [c("title"), F.size(F.coalesce(F.col(f"{r}.authors"), F.array().cast("array<string>"))) > 0, F.col(f"{r}.year").isNotNull(), c("venue"), c("abstract"), c("doi"), c("arxiv_id"), c("url")]
    return sum((h.cast("int") for h in have), F.lit(0))


def rank_score(overlap: Column, title: Column, cited: Column, complete: Column) -> Column:
    """Of a record among those of several sources: a source's own score counts as s / (s + 50)."""
    return 0.35 * overlap + 0.30 * title + 0.20 * cited / (cited + 50) + 0.15 * F.least(complete, F.lit(6)) / 6


def search_score(overlap: Column, title: Column) -> Column:
    return SEARCH_WEIGHTS[0] * overlap + SEARCH_WEIGHTS[1] * title


def identifier_status(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """(cand_id, kind, status, hit): the arXiv id, else the DOI, is looked up among the records; null kind without one."""
    arxiv, doi = normalize_arxiv("arxiv_id"), normalize_doi("doi")
    ids = candidates.select("cand_id", F.when(F.length(arxiv) > 0, "arxiv_id").when(F.length(doi) > 0, "doi").alias("kind"), F.when(F.length(arxiv) > 0, base_arxiv("arxiv_id")).otherwise(doi).alias("value"))
    known = corpus.select("doc_id", F.explode(F.array(F.struct(F.lit("arxiv_id").alias("kind"), base_arxiv("arxiv_id").alias("value")), F.struct(F.lit("doi").alias("kind"), doi.alias("value")))).alias("k"))
    known = known.where(F.length("k.value") > 0).groupBy("k.kind", "k.value").agg(F.min("doc_id").alias("hit"))
    some = ids.where("kind is not null").join(known, ["kind", "value"], "left")
    some = some.select("cand_id", "kind", F.when(F.col("hit").isNull(), "miss").otherwise("hit").alias("status"), "hit")
    none = F.lit(None)
    return some.unionByName(ids.where("kind is null").select("cand_id", "kind", none.cast("string").alias("status"), none.cast("long").alias("hit")))


def scored(candidates: DataFrame, corpus: DataFrame, ids: DataFrame, pool: int = POOL, search: int = SEARCH) -> DataFrame:
    """(cand_id, doc_id, score): union of what the identifier names and what the search finds, each record once."""
    asked = candidates.select(F.col("cand_id").alias("query_id"), "title")
    shared = retrieve.overlap_search(corpus.select("doc_id", "title"), "doc_id", "title", asked, "title", pool).select("query_id", "doc_id", F.col("score").alias("overlap"))
    names = corpus.select("doc_id", normalize_text("title").alias("name"))
    lists = shared.join(names, "doc_id").groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "overlap", "name")).alias("found"))  # ``pool`` at most
    best = similarity.nearest(search, *SEARCH_WEIGHTS)(normalize_text("title"), F.col("found"))
    near = lists.join(asked, "query_id").select(F.col("query_id").alias("cand_id"), F.explode(best).alias("x")).select("cand_id", "x.doc_id", "x.sim")
    hits = ids.where("hit is not null").select("cand_id", F.col("hit").alias("doc_id"))
    every = hits.select("cand_id", "doc_id", F.lit(None).cast("double").alias("sim")).unionByName(near).groupBy("cand_id", "doc_id").agg(F.max("sim").alias("sim"))
    x = every.join(candidates.select("cand_id", F.struct(*FIELDS).alias("cand")), "cand_id").join(corpus.select("doc_id", F.struct(*FIELDS).alias("rec"), "suspect"), "doc_id")
    equal = lambda f, norm: (F.length(blank(F.col(f"cand.{f}"))) > 0) & (norm(F.col(f"cand.{f}")) == norm(F.col(f"rec.{f}")))
    same = equal("doi", normalize_doi) | equal("arxiv_id", base_arxiv)
    # the record of an identifier is compared only where its title was not already
    unknown = F.col("sim").isNull()
    sim = F.coalesce("sim", similarity.sequence_similarity(F.when(unknown, F.col("cand.title")), F.when(unknown, F.col("rec.title"))))
    score = audit.match_score(sim, author_coverage(F.col("cand.authors"), F.col("rec.authors")), year_matches(F.col("cand.year"), F.col("rec.year")))
    return x.select("cand_id", "doc_id", F.when(same, 1.0).otherwise(score).alias("score"), F.col("rec.year").alias("year"), "suspect")


def outcome(candidates: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """(cand_id, doc_id, score, reason, alternatives, id_kind, id_status): best record, the next three, and why they cannot be told apart."""
    ids = identifier_status(candidates, corpus)
    x = scored(candidates, corpus, ids, **options).join(ids.select("cand_id", "kind", "status"), "cand_id")
    w = Window.partitionBy("cand_id").orderBy(F.desc("score"), F.col("suspect").asc(), "doc_id")
    x = x.withColumn("rank", F.row_number().over(w))
    strong = F.when(F.col("score") >= audit.STRONG, F.col("year"))
    at = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    g = x.groupBy("cand_id").agg(
        at(1, "doc_id").alias("doc_id"), at(1, "score").alias("score"), at(1, "suspect").alias("odd"), at(2, "score").alias("next"), (F.max(strong) - F.min(strong)).alias("spread"),
        F.transform(F.sort_array(F.collect_list(F.when((F.col("rank") > 1) & (F.col("rank") <= 4), F.struct("rank", "doc_id")))), lambda s: s["doc_id"]).alias("alternatives"),
    )
    y = candidates.select("cand_id").join(ids, "cand_id").join(g, "cand_id", "left")
    unsure = (F.col("score") >= audit.STRONG) & (F.col("score") - F.col("next") < audit.MARGIN) & F.col("kind").isNull()
    hit = F.coalesce(F.col("status") == "hit", F.lit(False))
    near = F.when(F.coalesce(unsure, F.lit(False)), "near_duplicate").otherwise("")
    reason = F.when(hit, near).when(F.coalesce(F.col("spread") > 1, F.lit(False)), "year_conflict").when((near == "") & F.coalesce("odd", F.lit(False)), "suspect_record").otherwise(near)
    return y.select("cand_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), reason.alias("reason"), F.coalesce("alternatives", F.array().cast("array<long>")).alias("alternatives"), F.col("kind").alias("id_kind"), F.col("status").alias("id_status"))


def verify(candidates: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """(cand_id, verdict, confidence, score, doc_id, mismatched, alternatives, id_status) for every candidate."""
    found = written(outcome(candidates, corpus, **options), "outcomes")  # a small row for each candidate, read for the fields and for the verdict
    pairs = found.where(F.col("score") >= audit.STRONG).join(candidates.select("cand_id", F.struct(*FIELDS).alias("cand")), "cand_id").join(corpus.select("doc_id", F.struct(*FIELDS).alias("rec")), "doc_id")
    fields = audit.field_diffs(pairs.select("cand_id", "cand", "rec"), similarity.sequence_similarity)
    bad = fields.where(~F.col("matches")).groupBy("cand_id").agg(F.array_join(F.sort_array(F.collect_list("field")), ",").alias("mismatched"))
    x = found.join(bad, "cand_id", "left").withColumn("mismatched", F.coalesce("mismatched", F.lit("")))
    v = audit.verdict(F.col("score"), F.col("reason"), F.length("mismatched"))
    shown = F.when(v == "metadata_mismatch", F.col("mismatched")).otherwise("")
    return x.select("cand_id", v.alias("verdict"), audit.confidence(v, F.col("score"), F.lit("none")).alias("confidence"), F.round("score", 4).alias("score"), F.when(v != "not_found", F.col("doc_id")).alias("doc_id"), shown.alias("mismatched"), F.array_join(F.transform("alternatives", lambda a: a.cast("string")), ",").alias("alternatives"), "id_status")
