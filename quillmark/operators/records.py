r"""Records: citations parsed from what is given, matches by identifier, cache exports, corpora and their checks, files of a manuscript."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillmark.functions.ident import author_coverage, base_arxiv, extract_arxiv, extract_doi, extract_year, gbt_reference, normalize_arxiv, normalize_doi, stable_id, year_matches
from quillmark.functions.text import blank
from quillmark.operators import resolve, similarity

# ---- citations --------------------------------------------------------------------------------------------------


def parse_citation(given: DataFrame) -> DataFrame:
    """Fields of a citation from raw_text, title, authors, year, venue, doi and arxiv_id: what is given wins over what the raw text holds.
    Without a title a reference in the style of GB/T 7714 gives one; else the raw text is only searched for (``title_explicit`` is false)."""
    raw, title = blank("raw_text"), blank("title")
    first = lambda a, b: F.when(F.length(a) > 0, a).otherwise(b)
    x = given.withColumn("__g", F.when((F.length(raw) > 0) & (F.length(title) == 0), gbt_reference(raw)))
    named = first(title, F.coalesce("__g.title", F.lit("")))
    names = F.coalesce("authors", F.array().cast("array<string>"))
    doi, arxiv = first(normalize_doi("doi"), extract_doi(raw)), first(normalize_arxiv("arxiv_id"), extract_arxiv(raw))
    search = first(named, raw)
    fields = {
        "authors": F.when(F.size(names) > 0, names).otherwise(F.coalesce("__g.authors", names)),
        "year": F.coalesce("year", extract_year(raw)),
        "venue": first(blank("venue"), F.coalesce("__g.venue", F.lit(""))),
        "doi": doi,
        "arxiv_id": arxiv,
        "title_explicit": F.length(named) > 0,
        "reference_format": F.when(F.col("__g").isNotNull(), "gbt7714").otherwise(""),
        "citation_id": stable_id("input", first(first(doi, arxiv), first(search, F.lit("citation")))),
        "title": search,
    }
    return x.withColumns(fields).drop("__g")


def existence_score(title: Column, same_doi: Column, same_arxiv: Column) -> Column:
    """Of a record that was found: half is the find itself, the rest an equal identifier or the similarity of titles."""
    return F.least(F.lit(1.0), F.greatest(title, F.when(same_doi | same_arxiv, 0.5).otherwise(0.0)) + 0.5)


def metadata_score(title: Column, authors: Column, year: Column, venue: Column) -> Column:
    """``venue`` is null where one side has none, which counts a half."""
    return 0.45 * title + 0.25 * authors + 0.15 * F.when(year, 1.0).otherwise(0.0) + 0.15 * F.coalesce(venue, F.lit(0.5))


def findings(pairs: DataFrame) -> DataFrame:
    """(cand_id, doc_id, existence, metadata, passed) of pairs with structs ``cand`` and ``rec``."""
    c, r = (lambda f: F.col(f"cand.{f}")), (lambda f: F.col(f"rec.{f}"))
    same = lambda f, norm: (F.length(blank(c(f))) > 0) & (norm(c(f)) == norm(r(f)))
    both = (F.length(blank(c("venue"))) > 0) & (F.length(blank(r("venue"))) > 0)
    x = pairs.withColumn("__t", similarity.sequence_similarity(c("title"), r("title"))).withColumn("__v", F.when(both, similarity.sequence_similarity(c("venue"), r("venue"))))
    cover = author_coverage(c("authors"), r("authors"))
    nobody = F.size(F.coalesce(c("authors"), F.array().cast("array<string>"))) == 0
    return x.select(
        "cand_id", "doc_id", F.round(existence_score(F.col("__t"), same("doi", normalize_doi), same("arxiv_id", base_arxiv)), 4).alias("existence"),
        F.round(metadata_score(F.col("__t"), cover, year_matches(c("year"), r("year")), F.col("__v")), 4).alias("metadata"), ((F.col("__t") >= 0.9) & ((cover >= 0.5) | nobody)).alias("passed"),
    )


def local_match(candidates: DataFrame, corpus: DataFrame, least: float = 0.70) -> DataFrame:
    """(cand_id, doc_id, score): the best record of at least ``least`` by ``resolve.source_score``, the smaller id at a tie.

    Without an equal identifier a score is 0.40 at most, so for ``least`` above that records meet by DOI and by arXiv id only: two joins
    by key that lose nothing."""
    if least <= 0.40:
        raise ValueError("records without an equal identifier can reach 0.40; ask for more")
    cand = candidates.select("cand_id", F.struct(*resolve.FIELDS).alias("cand"))
    rec = corpus.select("doc_id", F.struct(*resolve.FIELDS).alias("rec"))
    keys = {"doi": normalize_doi, "arxiv_id": base_arxiv}

    def by(field: str) -> DataFrame:
        key = lambda df, side, id_: df.select(id_, keys[field](F.col(f"{side}.{field}")).alias("k")).where(F.length("k") > 0)
        return key(cand, "cand", "cand_id").join(key(rec, "rec", "doc_id"), "k").select("cand_id", "doc_id")

    pairs = by("doi").unionByName(by("arxiv_id")).distinct().join(cand, "cand_id").join(rec, "doc_id")
    same = lambda f: (F.length(blank(F.col(f"cand.{f}"))) > 0) & (keys[f](F.col(f"cand.{f}")) == keys[f](F.col(f"rec.{f}")))
    score = resolve.source_score(
        similarity.sequence_similarity(F.col("cand.title"), F.col("rec.title")), same("doi"), same("arxiv_id"), author_coverage(F.col("cand.authors"), F.col("rec.authors")), year_matches(F.col("cand.year"), F.col("rec.year"))
    )
    best = pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("cand_id").agg(F.max_by(F.struct("doc_id", "score"), F.struct("score", (-F.col("doc_id")).alias("d"))).alias("b"))
    return best.select("cand_id", "b.doc_id", F.round("b.score", 4).alias("score"))


# ---- cache exports ----------------------------------------------------------------------------------------------

CACHED = "citation_id string, title string, authors array<string>, year int, venue string, abstract string, doi string, arxiv_id string, url string, source string"


def entry_operation(key: Column, metadata: Column) -> Column:
    """What a cache row is of: its metadata say so, else the prefix of its key."""
    prefix = F.substring_index(key, ":", 1)
    said = F.nullif(F.get_json_object(metadata, "$.operation"), F.lit(""))
    return F.coalesce(said, F.when(prefix.isin("search", "lookup") & F.contains(key, F.lit(":")), prefix).otherwise("other"))


def select_entries(rows: DataFrame, operation: str | None = None, source: str | None = None) -> DataFrame:
    """Cache rows (key, value, metadata, updated_at) of an operation and a source."""
    x = rows
    if operation:
        x = x.where(entry_operation(F.col("key"), F.col("metadata")) == operation)
    if source:
        x = x.where(F.get_json_object("metadata", "$.source") == source)
    return x


def export_key() -> Column:
    low = lambda c: F.lower(blank(c))
    return F.coalesce(F.nullif(low("doi"), F.lit("")), F.nullif(low("arxiv_id"), F.lit("")), F.concat(low("title"), F.lit("::"), low("source")))


def export(rows: DataFrame, deterministic: bool = False) -> DataFrame:
    """Records that cache rows hold (a JSON object or a list of them), each once: that of the first key and place. Rows that are no JSON give
    none. ``deterministic`` leaves the time out. Order by lower title, year, source to write it."""
    x = rows.select("key", "updated_at", F.posexplode(F.from_json("value", f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in CACHED.split(', '))}>>")).alias("pos", "r")).where(F.col("r").isNotNull())
    x = x.select("key", "updated_at", "pos", "r.*").withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("cache")))
    names = [f.split()[0] for f in CACHED.split(", ")]
    one = x.groupBy(export_key().alias("export_key")).agg(F.min_by(F.struct(*names, "key", "updated_at"), F.struct("key", "pos")).alias("r"))
    time = F.lit(None).cast("timestamp") if deterministic else F.col("r.updated_at")
    return one.select("export_key", *(f"r.{n}" for n in names), F.col("r.key").alias("cache_key"), time.alias("cache_updated_at"))


def manifest(rows: DataFrame, selected: DataFrame, exported: DataFrame, deterministic: bool = False) -> DataFrame:
    """One row that describes an export."""
    prefix = F.substring_index("key", ":", 1)
    counts = lambda p: [F.count(F.lit(1)).alias(f"{p}entries"), *(F.count_if(prefix == v).alias(f"{p}{v}") for v in ("search", "lookup")), F.count_if(~prefix.isin("search", "lookup")).alias(f"{p}other")]
    when = lambda c: F.lit(None).cast("timestamp") if deterministic else c
    a = rows.agg(*counts(""), when(F.min("updated_at")).alias("oldest"), when(F.max("updated_at")).alias("newest"))
    x = a.crossJoin(selected.agg(*counts("selected_"))).crossJoin(exported.agg(F.count(F.lit(1)).alias("record_count")))  # one row each
    return x.withColumns({"deterministic": F.lit(deterministic), "fixture_format": F.lit("manifest_records"), "provenance_policy": F.lit("cache_export_replay_fixture")})


# ---- corpora ----------------------------------------------------------------------------------------------------


def corpus_errors(rows: DataFrame, key: str, required: tuple[str, ...] = ("citation_id", "title")) -> DataFrame:
    """Rows of a corpus that lack a required field, with the fields they lack."""
    missing = F.array_compact(F.array(*(F.when(F.length(F.trim(blank(c))) == 0, c) for c in required)))
    return rows.select(key, F.array_join(missing, ",").alias("missing")).where(F.length("missing") > 0)


def with_claim(citations: DataFrame, claim: str) -> DataFrame:
    """Citations without a claim get the given one; without either an error says so."""
    own = F.trim(blank("claim"))
    filled = F.when(F.length(own) > 0, own).otherwise(F.lit(claim.strip()))
    return citations.withColumn("claim", filled).withColumn("error", F.when(F.length(filled) == 0, "a claim is required"))


# ---- label cases ------------------------------------------------------------------------------------------------

#: Order of annotation by type of case and by split.
TYPE_ORDER = ("contradiction", "hard_negative", "full_text_required", "weak_set_boundary", "contradiction_set", "weak_support", "direct_support", "set_aggregation", "metadata_only", "unrelated_negative", "standard")
SPLIT_ORDER = ("test", "dev", "train")
UNKNOWN_TYPE = 8


def annotation_ranks(cases: DataFrame) -> DataFrame:
    """Adds type_rank and split_rank: the order of annotation is by both and the id."""
    place = lambda names, c, other: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)) - 1, F.lit(other))
    return cases.withColumn("type_rank", place(TYPE_ORDER, "case_type", UNKNOWN_TYPE)).withColumn("split_rank", place(SPLIT_ORDER, "split", len(SPLIT_ORDER)))


def packet(cases: DataFrame, size: int) -> DataFrame:
    """The first cases to annotate, each with a digest of its fields as JSON with sorted keys."""
    fields = sorted(("case_id", "case_type", "evidence_scope", "lang", "split"))
    first = annotation_ranks(cases).orderBy("type_rank", "split_rank", "case_id").limit(size)
    return first.select("case_id", "type_rank", "split_rank", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias("digest"))


def label_sources(labelled: DataFrame) -> DataFrame:
    """Cases by source of the label and state of review; blank is ``unknown``."""
    known = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown"))
    return labelled.groupBy(known("label_source").alias("label_source"), known("status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(blank("source_locator")) > 0).alias("n_located"))


# ---- manuscripts ------------------------------------------------------------------------------------------------


def _linked(text: Column, pattern: str, suffix: str) -> Column:
    """Names in braces after a command, in order, each once; those with a scheme go, those without a suffix get one."""
    names = F.flatten(F.transform(F.regexp_extract_all(blank(text), F.lit(pattern), 1), lambda g: F.split(g, ",")))
    fine = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: (F.length(n) > 0) & ~F.contains(n, F.lit("://")))
    return F.array_distinct(F.transform(fine, lambda n: F.when(F.substring_index(n, "/", -1).rlike("[^.]\\.[^.]"), n).otherwise(F.concat(n, F.lit(suffix)))))


def bibliography_links(files: DataFrame) -> DataFrame:
    r"""(path, ord, link): files of ``\bibliography`` and then of ``\addbibresource``, beside the file that names them."""
    t = F.col("text")
    links = F.array_distinct(F.concat(_linked(t, r"\\bibliography\{([^}]+)\}", ".bib"), _linked(t, r"\\addbibresource(?:\[[^\]]*\])?\{([^}]+)\}", ".bib")))
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    x = files.select("path", folder.alias("folder"), F.posexplode(links).alias("ord", "name"))
    return x.select("path", "ord", F.when(F.col("name").startswith("/"), F.col("name")).otherwise(F.concat("folder", "name")).alias("link"))


@F.arrow_udf(ArrayType(IntegerType()))
def _reading_order(projects: pa.Array) -> pa.Array:
    """Of each project's files (structs of path, main and links) the places of those that are read, in the order of reading."""
    out = []
    for files in projects.to_pylist():
        at = {posixpath.normpath(f["path"]): i for i, f in enumerate(files)}
        seen: dict[int, None] = {}  # in the order of reading
        stack = sorted((i for i, f in enumerate(files) if f["main"]), key=lambda i: files[i]["path"], reverse=True)
        while stack:
            i = stack.pop()
            if i in seen:
                continue
            seen[i] = None
            folder = posixpath.dirname(files[i]["path"])
            found = (at.get(posixpath.normpath(posixpath.join(folder, n))) for n in files[i]["links"])
            stack += [j for j in reversed([*found]) if j is not None and j not in seen]
        out.append([*seen])
    return pa.array(out, pa.list_(pa.int32()))


def tex_parts(files: DataFrame) -> DataFrame:
    r"""(project, ord, path, text): the main file of every project and what it includes by ``\input`` and ``\include``, depth first, each file
    once. ``files``: project, path, text, main. Files that are not there are passed over. A project's files are one row, as one manuscript is;
    Python sees batches of projects, and no texts."""
    x = files.select("project", "path", "text", "main", _linked(F.col("text"), r"\\(?:input|include)\{([^}]+)\}", ".tex").alias("links"))
    x = x.groupBy("project").agg(F.collect_list(F.struct("path", "text", "main", "links")).alias("files"))
    x = x.withColumn("order", _reading_order(F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["main"].alias("main"), f["links"].alias("links")))))
    x = x.select("project", "files", F.posexplode("order").alias("ord", "i")).withColumn("f", F.get("files", F.col("i")))
    return x.select("project", "ord", "f.path", "f.text")
