"""Resolution of citations against a corpus, verdicts, risk ranking and review summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.ident import author_coverage, base_arxiv, normalize_arxiv, normalize_doi, record_key, year_matches
from quillmark.functions.text import blank, normalize_text
from quillmark.operators.similarity import SignedTexts, best_matches
from quillmark.session import written

STRONG, MARGIN = 0.70, 0.05
SIMILAR = 0.85
TITLE_MATCH, AUTHOR_MATCH, VENUE_MATCH = 0.90, 0.50, 0.60
#: Risk level, score and next action of each verdict.
RISK = {"verified": ("low", 0.05, "keep"), "metadata_mismatch": ("medium", 0.65, "review_metadata"), "not_found": ("high", 0.95, "resolve_identifier_or_replace"), "ambiguous": ("high", 0.85, "disambiguate_identifier")}
SUSPECT_PREFIXES = ("10.65215",)


class Lookups:
    """What references are looked up by: the first record of each DOI, versioned arXiv id and normalised title, and the titles for
    comparison. With ``folder`` these are tables there, made once for many lookups."""

    def __init__(self, corpus: DataFrame, folder: str | None = None):
        self.first = {}
        for name, key in _keys().items():
            x = corpus.select(key.alias("k"), "doc_id").where(F.length("k") > 0).groupBy("k").agg(F.min("doc_id").alias("hit"))
            if folder:
                x.write.parquet(f"{folder}/{name}")
                x = corpus.sparkSession.read.schema(x.schema).parquet(f"{folder}/{name}")
            self.first[name] = x
        self.folder, self._titles = folder, None

    @property
    def titles(self) -> SignedTexts:
        if self._titles is None:
            self._titles = SignedTexts(self.first["t"].select(F.col("k").alias("t")), SIMILAR, path=f"{self.folder}/signed" if self.folder else None)
        return self._titles


def _keys() -> dict[str, Column]:
    return {"d": normalize_doi("doi"), "a": normalize_arxiv("arxiv_id"), "t": normalize_text("title")}


def cascade(candidates: DataFrame, corpus: DataFrame | Lookups, compared: DataFrame | None = None) -> DataFrame:
    """(cand_id, doc_id, method): by DOI, else by versioned arXiv id, else by normalised title, else by the most similar title from SIMILAR on, of equals one that ends with the given; the first record wins; null if none.

    ``compared``: the cand_id of candidates for which the last step counts, where it does not for all.
    """
    lookups = corpus if isinstance(corpus, Lookups) else Lookups(corpus)
    x = candidates.select("cand_id", *(key.alias(name) for name, key in _keys().items()))
    for name, first in lookups.first.items():
        # most candidates lack most keys: instead of '' they get a key of their own that matches nothing, so no partition holds them all
        asked = F.when(F.length(name) > 0, F.col(name)).otherwise(F.concat(F.lit("\u0000"), F.col("cand_id").cast("string")))
        x = x.withColumn("__k", asked).join(first.withColumnsRenamed({"k": "__k", "hit": f"h{name}"}), "__k", "left").drop("__k")
    x = written(x.select("cand_id", "t", "hd", "ha", "ht"), "cascade")  # a small row for each candidate, read again for those left
    left = x.where(F.coalesce("hd", "ha", "ht").isNull() & (F.length("t") > 0))
    if compared is not None:
        left = left.join(compared.select("cand_id"), "cand_id", "left_semi")
    left = written(left.select("t").distinct(), "left")
    if left.isEmpty():
        x = x.withColumn("hs", F.lit(None).cast(dict(x.dtypes)["ht"]))
    else:
        near = best_matches(left, lookups.titles)
        near = near.join(lookups.first["t"].withColumnRenamed("k", "right"), "right")
        # of equally similar titles, one that ends with the whole of the given one: what is lost is mostly a beginning
        near = near.groupBy("left").agg(F.min_by("hit", F.struct(-F.col("score"), ~F.endswith("right", "left"), "hit")).alias("hs"))
        x = x.join(near.withColumnRenamed("left", "t"), "t", "left")
    method = F.when(F.col("hd").isNotNull(), "doi").when(F.col("ha").isNotNull(), "arxiv").when(F.col("ht").isNotNull(), "title").when(F.col("hs").isNotNull(), "similar").otherwise("none")
    return x.select("cand_id", F.coalesce("hd", "ha", "ht", "hs").alias("doc_id"), method.alias("method"))


def field_diffs(pairs: DataFrame, similar: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row per compared field: only those that the candidate gives. ``pairs`` has structs cand and rec; without ``similar`` strings must be equal when normalised."""
    c, r = (lambda f: F.col(f"cand.{f}")), (lambda f: F.col(f"rec.{f}"))
    same = similar or (lambda a, b: F.when(normalize_text(a) == normalize_text(b), 1.0).otherwise(0.0))
    tests = [
        ("title", F.length(blank(c("title"))) > 0, same(c("title"), r("title")) >= TITLE_MATCH),
        ("authors", F.size(F.coalesce(c("authors"), F.array().cast("array<string>"))) > 0, author_coverage(c("authors"), r("authors")) >= AUTHOR_MATCH),
        ("year", c("year").isNotNull(), year_matches(c("year"), r("year"))),
        ("venue", F.length(blank(c("venue"))) > 0, same(c("venue"), r("venue")) >= VENUE_MATCH),
        ("doi", F.length(blank(c("doi"))) > 0, normalize_doi(c("doi")) == normalize_doi(r("doi"))),
        ("arxiv_id", F.length(blank(c("arxiv_id"))) > 0, base_arxiv(c("arxiv_id")) == base_arxiv(r("arxiv_id"))),
    ]
    rows = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), given.alias("given"), ok.alias("matches")) for f, given, ok in tests)), lambda x: x["given"])
    return pairs.select("cand_id", F.explode(rows).alias("x")).select("cand_id", "x.field", "x.matches")


def match_score(similarity: Column, authors: Column, years: Column) -> Column:
    return 0.70 * similarity + 0.18 * authors + 0.12 * F.when(years, 1.0).otherwise(0.0)


def resolve(scored: DataFrame, key: str = "cand_id") -> DataFrame:
    """Best record, its runner-up and whether they can be told apart. ``scored``: key, doc_id, score, year, has_id, suspect."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.col("suspect").asc(), "doc_id")
    whole = Window.partitionBy(key)
    strong_year = F.when(F.col("score") >= STRONG, F.col("year"))
    x = scored.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    x = x.withColumn("spread", F.max(strong_year).over(whole) - F.min(strong_year).over(whole))
    near = (F.col("score") >= STRONG) & F.coalesce(F.col("score") - F.col("next") < MARGIN, F.lit(False)) & ~F.col("has_id")
    reason = F.when(F.coalesce(F.col("spread") > 1, F.lit(False)), "year_conflict").when(near, "near_duplicate").when(F.col("suspect"), "suspect_record").otherwise("")
    return x.where("rank = 1").select(key, "doc_id", "score", reason.alias("reason"))


def suspect(doi: Column, cited: Column, year: Column, now_year: int) -> Column:
    listed = F.lit(False)
    for prefix in SUSPECT_PREFIXES:
        listed = listed | normalize_doi(doi).startswith(prefix)
    return listed | F.coalesce((cited >= 1000) & (year >= now_year - 1), F.lit(False))


def failure_mode(checked: Column, failed: Column, responded: Column) -> Column:
    return F.when(F.size(failed) == 0, "none").when(F.size(responded) > 0, "partial_outage").when(F.size(F.array_except(checked, failed)) == 0, "all_sources_failed").otherwise("partial_outage")


def verdict(score: Column, reason: Column, mismatches: Column) -> Column:
    return F.when(score.isNull() | (score < STRONG), "not_found").when(F.length(reason) > 0, "ambiguous").when(mismatches > 0, "metadata_mismatch").otherwise("verified")


def confidence(verdict_: Column, score: Column, mode: Column) -> Column:
    absent = verdict_ == "not_found"
    raw = F.when(absent, 1 - score).otherwise(score)
    cap = F.when(mode == "all_sources_failed", 0.35).when((mode == "partial_outage") & absent, 0.65).when(mode == "partial_outage", 0.85).otherwise(1.0)
    return F.round(F.least(raw, cap), 4)


def _by_verdict(i: int) -> Column:
    out = None
    for name, values in RISK.items():
        out = F.when(F.col("verdict") == name, values[i]) if out is None else out.when(F.col("verdict") == name, values[i])
    return out


def risk_items(results: DataFrame) -> DataFrame:
    """Adds risk, risk_score and next_action; a failed source lifts low to medium and the score to 0.55 at least."""
    failed = F.size("sources_failed") > 0
    x = results.withColumn("mode", failure_mode(F.col("sources_checked"), F.col("sources_failed"), F.col("sources_responded")))
    x = x.withColumn("risk", F.when(failed & (_by_verdict(0) == "low"), "medium").otherwise(_by_verdict(0)))
    x = x.withColumn("risk_score", F.when(failed, F.greatest(_by_verdict(1), F.lit(0.55))).otherwise(_by_verdict(1)))
    action = F.when(F.col("mode") == "all_sources_failed", "retry_or_check_source_health").when(failed & (F.col("verdict") == "verified"), "inspect_source_health").otherwise(_by_verdict(2))
    return x.withColumn("next_action", action)


def ranked(items: DataFrame) -> DataFrame:
    """Risk order: a total order needs one sequence number, given by ranges of (score, index) instead of one task."""
    per = items.groupBy("risk_score").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("risk_score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    x = items.withColumn("part", F.floor(F.col("idx") / 4096))
    parts = x.groupBy("risk_score", "part").agg(F.count(F.lit(1)).alias("m"))
    above = parts.withColumn("above", F.coalesce(F.sum("m").over(Window.partitionBy("risk_score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    near = F.row_number().over(Window.partitionBy("risk_score", "part").orderBy("idx"))
    y = x.withColumn("near", near).join(above, ["risk_score", "part"]).join(before, "risk_score")
    return y.withColumn("position", (F.col("base") + F.col("above") + F.col("near")).cast("long")).drop("near", "above", "base", "part")


def verdict_counts(results: DataFrame) -> DataFrame:
    """All verdicts, with zeros."""
    names = F.explode(F.array(*(F.lit(v) for v in RISK))).alias("verdict")
    every = results.sparkSession.range(1).select(names)
    return every.join(results.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merge_records(records: DataFrame) -> DataFrame:
    """One record per key (DOI, arXiv id, title): the richer record wins, the earlier at a tie, and blanks are filled in that order."""
    x = records.withColumn("key", record_key("doi", "arxiv_id", "title"))
    full = sum((F.when(F.length(blank(c)) > 0, 1).otherwise(0) for c in ("title", "venue", "abstract", "doi", "arxiv_id")), F.when(F.col("year").isNotNull(), 1).otherwise(0))
    x = x.withColumn("full", full)
    order = F.struct((-F.col("full")).alias("f"), F.col("doc_id").alias("o"))
    pick = lambda c: F.min_by(F.when(F.length(blank(c)) > 0, F.col(c)), F.when(F.length(blank(c)) > 0, order))
    return x.groupBy("key").agg(
        F.min_by("doc_id", order).alias("doc_id"),
        F.coalesce(pick("title"), F.lit("")).alias("title"),
        F.coalesce(pick("venue"), F.lit("")).alias("venue"),
        F.min_by("year", F.when(F.col("year").isNotNull(), order)).alias("year"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.count(F.lit(1)).alias("n_records"),
    )


def completeness(title: Column, authors: Column, year: Column, venue: Column, abstract: Column, doi: Column, arxiv: Column, url: Column) -> Column:
    has = [F.length(blank(title)) > 0, F.size(authors) > 0, year.isNotNull(), F.length(blank(venue)) > 0, F.length(blank(abstract)) > 0, (F.length(blank(doi)) > 0) | (F.length(blank(arxiv)) > 0), F.length(blank(url)) > 0]
    names = ("title", "authors", "year", "venue", "abstract", "identifier", "url")
    missing = F.filter(F.array(*(F.when(~h, n) for h, n in zip(has, names, strict=True))), lambda x: x.isNotNull())
    return F.struct(missing.alias("missing"), F.round((7 - F.size(missing)) / 7.0, 4).alias("ratio"))
