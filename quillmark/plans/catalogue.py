"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import cite, ident, text
from quillmark.operators import audit, cachetab, evaluate, extract, labels, retrieve, rules, similarity, support
from quillmark.session import handed
from quillmark.sources import adapters as A
from quillmark.sources import readers
from quillmark.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- SQL fragments of the oracles -------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9一-鿿\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all({_norm(x)}, '[a-z0-9]+'), lambda t: t NOT IN ({_STOP}))"


def _doi(x: str) -> str:
    return rf"lower(regexp_replace(trim(regexp_replace(trim({x}), '^(?:\s*(?:doi\s*:?\s*|(?:https?://)?(?:dx\.)?doi\.org/))+', '', 'i')), '[.,;]+$', ''))"


def _arxiv(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(trim({x}), '^(?:\s*(?:arxiv\s*:\s*|(?:https?://)?arxiv\.org/(?:abs|pdf|html)/))+', '', 'i'), '(?:[?#].*|\.pdf)$', ''))"


def _tok_cjk(x: str) -> str:
    """Tokens of both languages: the pairs of neighbours of a run of ideographs, and Latin words."""
    pairs = "CASE WHEN length(s) = 1 THEN [s] ELSE list_transform(generate_series(1, length(s) - 1), lambda i: substr(s, CAST(i AS INTEGER), 2)) END"
    return f"flatten(list_transform(regexp_extract_all({_norm(x)}, '[一-鿿]+|[a-z0-9]+'), lambda s: CASE WHEN regexp_matches(s, '^[一-鿿]') THEN {pairs} WHEN s IN ({_STOP}) THEN CAST([] AS VARCHAR[]) ELSE [s] END))"


_CLAIMS = "SELECT item_id AS query_id, text AS q FROM benchmark"
_DOC = "SELECT doc_id, text FROM documents"


def _share(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END, 4)"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return A.spread(A.table(spark, sf, "documents").select("doc_id", "text"))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


T, Q = "text", "q"

# ---- text and identifiers ---------------------------------------------------------------------------------------


@_query("normalize_text", f"SELECT doc_id, {_norm('text')} AS norm FROM documents")
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", text.normalize_text("text").alias("norm"))


@_query("tokenize_count", f"SELECT conv_id, turn, CAST(len({_tok('text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_tok('text')})) AS INTEGER) AS n_distinct FROM conversations")
def tokenize_count(spark, sf):
    t = text.tokenize("text")
    return A.table(spark, sf, "conversations").select("conv_id", "turn", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@_query(
    "token_bigrams",
    f"""WITH t AS (SELECT item_id, {_tok("text")} AS k FROM benchmark),
    g AS (SELECT DISTINCT item_id, k[i] || ' ' || k[i + 1] AS bigram FROM (SELECT item_id, k, unnest(generate_series(1, len(k) - 1)) AS i FROM t))
    SELECT bigram, count(*) AS n FROM g GROUP BY bigram""",
)
def token_bigrams(spark, sf):
    b = A.table(spark, sf, "benchmark").select("item_id", F.explode(text.bigrams(text.tokenize("text"))).alias("bigram"))
    return b.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


@_query("doi_normalize", f"SELECT doc_id, {_doi('doi')} AS doi FROM ({A.CORPUS_SQL})")
def doi_normalize(spark, sf):
    return A.corpus(spark, sf).select("doc_id", ident.normalize_doi("doi").alias("doi"))


@_query("arxiv_normalize", rf"SELECT doc_id, {_arxiv('arxiv_id')} AS arxiv_id, regexp_replace({_arxiv('arxiv_id')}, 'v[0-9]+$', '') AS base_id FROM ({A.CORPUS_SQL})")
def arxiv_normalize(spark, sf):
    return A.corpus(spark, sf).select("doc_id", ident.normalize_arxiv("arxiv_id").alias("arxiv_id"), ident.base_arxiv("arxiv_id").alias("base_id"))


@_query("stable_id", f"SELECT doc_id, 'input:' || substr(md5({_doi('doi')}), 1, 12) AS record_id FROM ({A.CORPUS_SQL})")
def stable_id(spark, sf):
    return A.corpus(spark, sf).select("doc_id", ident.stable_id("input", ident.normalize_doi("doi")).alias("record_id"))


@_query(
    "record_key",
    f"""SELECT cand_id, CASE WHEN {_doi("doi")} <> '' THEN 'doi:' || {_doi("doi")} WHEN {_arxiv("arxiv_id")} <> '' THEN 'arxiv:' || {_arxiv("arxiv_id")}
    ELSE 'title:' || {_norm("title")} END AS key FROM ({A.CANDIDATES_SQL})""",
)
def record_key(spark, sf):
    return A.candidates(spark, sf).select("cand_id", ident.record_key("doi", "arxiv_id", "title").alias("key"))


_RAW_SQL = f"""SELECT doc_id, title || '. ' || venue || ', ' || year || '. doi:' || doi || ' ' || arxiv_id AS raw FROM ({A.CORPUS_SQL})"""


_FIRST_DOI = r"regexp_extract(raw, '10\.[0-9]{4,9}/[-._;()/:a-zA-Z0-9]+', 0)"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    c = A.corpus(spark, sf)
    return c.select("doc_id", F.concat("title", F.lit(". "), "venue", F.lit(", "), F.col("year").cast("string"), F.lit(". doi:"), "doi", F.lit(" "), "arxiv_id").alias("raw"))


@_query(
    "extract_identifiers",
    rf"""SELECT doc_id, {_doi(_FIRST_DOI)} AS doi,
    lower(regexp_extract(raw, '(?:arxiv|arXiv):\s*([0-9]{{4}}\.[0-9]{{4,5}}(?:v[0-9]+)?)', 1)) AS arxiv_id,
    CAST(nullif(regexp_extract(raw, '\b(?:19|20)[0-9]{{2}}\b', 0), '') AS INTEGER) AS year FROM ({_RAW_SQL})""",
)
def extract_identifiers(spark, sf):
    labelled = F.regexp_extract("raw", f"(?i)arxiv:\\s*({ident.ARXIV})", 1)
    return _raw(spark, sf).select("doc_id", ident.extract_doi("raw").alias("doi"), ident.normalize_arxiv(labelled).alias("arxiv_id"), ident.extract_year("raw").alias("year"))


@_query("strip_tags", r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(coalesce(html, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def strip_tags(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", text.strip_tags("html").alias("plain"))


_WHOLE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_PARTS = rf"list_filter(string_split(regexp_replace({_WHOLE}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@_query("split_sentences", f"SELECT doc_id, CAST(len({_PARTS}) + CASE WHEN {_WHOLE} = '' OR list_contains({_PARTS}, {_WHOLE}) THEN 0 ELSE 1 END AS INTEGER) AS n_sentences FROM documents")
def split_sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(text.split_sentences("text")).alias("n_sentences"))


@_query("snippet", f"SELECT doc_id, CASE WHEN length({_WHOLE}) <= 360 THEN {_WHOLE} ELSE rtrim(substr({_WHOLE}, 1, 357)) || '...' END AS snippet FROM documents")
def snippet(spark, sf):
    return _docs(spark, sf).select("doc_id", text.snippet("text").alias("snippet"))


# ---- retrieval --------------------------------------------------------------------------------------------------

_TERMS = f"SELECT doc_id, unnest({_tok('text')}) AS token FROM documents"
_QTERMS = f"SELECT query_id, unnest({_tok('q')}) AS token FROM ({_CLAIMS})"


@_query("doc_frequency", f"SELECT token, count(DISTINCT doc_id) AS df FROM ({_TERMS}) GROUP BY token")
def doc_frequency(spark, sf):
    return retrieve.doc_frequency(retrieve.term_table(_docs(spark, sf), "doc_id", T))


@_query("tf_norms", f"WITH t AS (SELECT doc_id, token, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL) SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n_tokens, round(sqrt(sum(tf * tf)), 6) AS norm FROM t GROUP BY doc_id")
def tf_norms(spark, sf):
    return retrieve.norms(retrieve.term_table(_docs(spark, sf), "doc_id", T), "doc_id").withColumn("norm", F.round("norm", 6))


_BM25 = f"""
l AS (SELECT doc_id, len({_tok("text")}) AS n FROM documents), s AS (SELECT count(*) AS d, greatest(avg(n), 1) AS m FROM l),
q AS (SELECT query_id, token, count(*) AS q FROM ({_QTERMS}) GROUP BY ALL),
h AS (SELECT doc_id, token, count(*) AS tf FROM ({_TERMS}) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM h GROUP BY token),
b AS (SELECT query_id, doc_id, round(sum(q * ln(1 + (d - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))), 6) AS score
  FROM h JOIN f USING (token) JOIN q USING (token) JOIN l USING (doc_id), s GROUP BY ALL)"""


def _ranked(src: str, k: int) -> str:
    return f"SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {src} WHERE score > 0 QUALIFY rank <= {k}"


def _bm25(spark, sf, k):
    return retrieve.bm25(_docs(spark, sf), "doc_id", T, _claims(spark, sf), Q, k)


@_query("bm25_topk", f"WITH {_BM25} {_ranked('b', 5)}")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, 5)


_COS = f"""
t AS (SELECT doc_id, token, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL), tn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM t GROUP BY doc_id),
u AS (SELECT query_id, token, count(*) AS q FROM ({_QTERMS}) GROUP BY ALL), un AS (SELECT query_id, sqrt(sum(q * q)) AS n FROM u GROUP BY query_id),
c AS (SELECT query_id, doc_id, round(sum(q * tf) / (any_value(tn.n) * any_value(un.n)), 6) AS score FROM t JOIN u USING (token) JOIN tn USING (doc_id) JOIN un USING (query_id) GROUP BY ALL)"""


def _cosine(spark, sf, k):
    return retrieve.cosine(_docs(spark, sf), "doc_id", T, _claims(spark, sf), Q, k)


@_query("cosine_topk", f"WITH {_COS} {_ranked('c', 5)}")
def cosine_topk(spark, sf):
    return _cosine(spark, sf, 5)


@_query(
    "hybrid_topk",
    f"""WITH {_BM25}, {_COS}, x AS ({_ranked("b", 10)}), y AS ({_ranked("c", 10)}),
    z AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.doc_id, y.doc_id) AS doc_id, round(coalesce(x.score, 0) * 0.6 + coalesce(y.score, 0) * 0.4, 6) AS score, coalesce(x.rank, y.rank + 10) AS r
      FROM x FULL JOIN y ON x.query_id = y.query_id AND x.doc_id = y.doc_id)
    SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r, doc_id) AS INTEGER) AS rank FROM z QUALIFY rank <= 5""",
)
def hybrid_topk(spark, sf):
    return retrieve.hybrid_search(_docs(spark, sf), "doc_id", T, _claims(spark, sf), Q, 5)


_OVER = f"""
t AS (SELECT DISTINCT doc_id, token FROM ({_TERMS})), u AS (SELECT DISTINCT query_id, token FROM ({_QTERMS})), n AS (SELECT query_id, count(*) AS n FROM u GROUP BY query_id),
o AS (SELECT query_id, doc_id, round(CAST(count(*) AS DOUBLE) / any_value(n), 6) AS score FROM t JOIN u USING (token) JOIN n USING (query_id) GROUP BY ALL)"""


@_query("overlap_topk", f"WITH {_OVER} {_ranked('o', 5)}")
def overlap_topk(spark, sf):
    return retrieve.overlap_search(_docs(spark, sf), "doc_id", T, _claims(spark, sf), Q, 5)


@_query(
    "multi_source_topk",
    f"""WITH {_OVER}, p AS (SELECT o.*, source FROM o JOIN documents USING (doc_id) WHERE score > 0),
    s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) <= 3)
    SELECT query_id, doc_id, score, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
)
def multi_source_topk(spark, sf):
    docs = A.spread(A.table(spark, sf, "documents").select("doc_id", "text", "source"))
    hits = retrieve.overlap_search(docs, "doc_id", T, _claims(spark, sf), Q, 3, within="source")
    return retrieve.multi_source(hits, "doc_id", 5).select("query_id", "doc_id", "score", "source", "rank")


# ---- resolution and verdicts ------------------------------------------------------------------------------------

_CASCADE = f"""
c AS ({A.CORPUS_SQL}), k AS ({A.CANDIDATES_SQL}),
d AS (SELECT {_doi("doi")} AS k, min(doc_id) AS hit FROM c WHERE {_doi("doi")} <> '' GROUP BY 1),
a AS (SELECT {_arxiv("arxiv_id")} AS k, min(doc_id) AS hit FROM c WHERE {_arxiv("arxiv_id")} <> '' GROUP BY 1),
t AS (SELECT {_norm("title")} AS k, min(doc_id) AS hit FROM c WHERE {_norm("title")} <> '' GROUP BY 1),
y AS (SELECT doc_id AS cand_id, hit FROM c JOIN t ON {_norm("title")} = t.k WHERE {A.TYPO_SQL}),
r AS (SELECT cand_id, coalesce(d.hit, a.hit, t.hit, y.hit) AS doc_id, CASE WHEN d.hit IS NOT NULL THEN 'doi' WHEN a.hit IS NOT NULL THEN 'arxiv' WHEN t.hit IS NOT NULL THEN 'title' WHEN y.hit IS NOT NULL THEN 'similar' ELSE 'none' END AS method
  FROM k LEFT JOIN d ON {_doi("k.doi")} = d.k LEFT JOIN a ON {_arxiv("k.arxiv_id")} = a.k LEFT JOIN t ON {_norm("k.title")} = t.k LEFT JOIN y USING (cand_id))"""


def _resolved(spark, sf):
    return audit.cascade(A.candidates(spark, sf), A.corpus(spark, sf))


@_query("fallback_cascade", f"WITH {_CASCADE} SELECT * FROM r")
def fallback_cascade(spark, sf):
    return _resolved(spark, sf)


@_query("unresolved_anti", f"WITH {_CASCADE} SELECT cand_id, title FROM k ANTI JOIN (SELECT * FROM r WHERE method <> 'none') AS h USING (cand_id)")
def unresolved_anti(spark, sf):
    hits = _resolved(spark, sf).where("method <> 'none'").select("cand_id")
    return A.candidates(spark, sf).join(hits, "cand_id", "left_anti").select("cand_id", "title")


_FIELDS = f"""
p AS (SELECT cand_id, k.title AS t, c.title AS ct, k.authors AS a, c.authors AS ca, k.year AS y, c.year AS cy, k.venue AS v, c.venue AS cv, k.doi AS d, c.doi AS cd, k.arxiv_id AS x, c.arxiv_id AS cx FROM k JOIN r USING (cand_id) JOIN c USING (doc_id)),
f AS (SELECT cand_id, 'title' AS field, {_norm("t")} = {_norm("ct")} AS matches FROM p WHERE t <> ''
UNION ALL SELECT cand_id, 'authors', CAST(len(list_intersect(list_distinct(a), list_distinct(ca))) AS DOUBLE) / len(list_distinct(a)) >= 0.5 FROM p WHERE len(a) > 0
UNION ALL SELECT cand_id, 'year', coalesce(abs(y - cy) <= 1, false) FROM p WHERE y IS NOT NULL
UNION ALL SELECT cand_id, 'venue', {_norm("v")} = {_norm("cv")} FROM p WHERE v <> ''
UNION ALL SELECT cand_id, 'doi', {_doi("d")} = {_doi("cd")} FROM p WHERE d <> ''
UNION ALL SELECT cand_id, 'arxiv_id', regexp_replace({_arxiv("x")}, 'v[0-9]+$', '') = regexp_replace({_arxiv("cx")}, 'v[0-9]+$', '') FROM p WHERE x <> '')"""


def _pairs(spark, sf, resolved=None):
    c = A.candidates(spark, sf).select("cand_id", F.struct("title", "authors", "year", "venue", "doi", "arxiv_id").alias("cand"))
    r = A.corpus(spark, sf).select("doc_id", F.struct("title", "authors", "year", "venue", "doi", "arxiv_id").alias("rec"))
    return c.join(_resolved(spark, sf) if resolved is None else resolved, "cand_id").join(r, "doc_id")


@_query("field_diffs", f"WITH {_CASCADE}, {_FIELDS} SELECT * FROM f")
def field_diffs(spark, sf):
    return audit.field_diffs(_pairs(spark, sf))


@_query(
    "verify_citations",
    f"""WITH {_CASCADE}, {_FIELDS}, m AS (SELECT cand_id, count(*) FILTER (NOT matches) AS mismatches FROM f GROUP BY cand_id)
    SELECT r.cand_id, CASE WHEN method = 'none' THEN 'not_found' WHEN mismatches > 0 THEN 'metadata_mismatch' ELSE 'verified' END AS verdict,
    CASE WHEN method = 'none' THEN 1.0 ELSE 1.0 END AS confidence, coalesce(mismatches, 0) AS mismatches FROM r LEFT JOIN m USING (cand_id)""",
)
def verify_citations(spark, sf):
    resolved = _resolved(spark, sf).persist()
    bad = audit.field_diffs(_pairs(spark, sf, resolved)).groupBy("cand_id").agg(F.count_if(~F.col("matches")).alias("mismatches"))
    x = resolved.join(bad, "cand_id", "left").withColumn("mismatches", F.coalesce("mismatches", F.lit(0)).cast("long"))
    score = F.when(F.col("method") == "none", 0.0).otherwise(1.0)
    v = audit.verdict(score, F.lit(""), F.col("mismatches"))
    return x.select("cand_id", v.alias("verdict"), audit.confidence(v, score, F.lit("none")).alias("confidence"), "mismatches")


def _scored(spark, sf):
    """Title groups: every document of the same first word stands as a match, with a score from its id."""
    c = A.corpus(spark, sf)
    first = F.substring_index(text.normalize_text("title"), " ", 1)
    cited = F.col("n_chars") % 1500
    return c.select(F.xxhash64(first).alias("h"), first.alias("cand_id"), "doc_id", F.round(0.5 + (F.col("doc_id") * 7919 % 500) / 1000.0, 4).alias("score"), "year", (F.col("doc_id") % 2 == 0).alias("has_id"), audit.suspect(F.col("doi"), cited, F.col("year"), 2024).alias("suspect")).drop("h")


_SCORED = f"""
g AS (SELECT split_part({_norm("title")}, ' ', 1) AS cand_id, doc_id, round(0.5 + CAST(doc_id * 7919 % 500 AS DOUBLE) / 1000.0, 4) AS score, year, doc_id % 2 = 0 AS has_id,
  {_doi("doi")} LIKE '10.65215%' OR (n_chars % 1500 >= 1000 AND year >= 2023) AS suspect FROM ({A.CORPUS_SQL}))"""


@_query(
    "ambiguity",
    f"""WITH {_SCORED}, w AS (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS nxt, max(CASE WHEN score >= 0.7 THEN year END) OVER p - min(CASE WHEN score >= 0.7 THEN year END) OVER p AS spread
      FROM g WINDOW o AS (PARTITION BY cand_id ORDER BY score DESC, suspect, doc_id), p AS (PARTITION BY cand_id))
    SELECT cand_id, doc_id, score, CASE WHEN spread > 1 THEN 'year_conflict' WHEN score >= 0.7 AND score - nxt < 0.05 AND NOT has_id THEN 'near_duplicate' WHEN suspect THEN 'suspect_record' ELSE '' END AS reason FROM w WHERE rn = 1""",
)
def ambiguity(spark, sf):
    return audit.resolve(_scored(spark, sf))


@_query("suspect_records", f"WITH {_SCORED} SELECT doc_id FROM g WHERE suspect")
def suspect_records(spark, sf):
    return _scored(spark, sf).where("suspect").select("doc_id")


@_query("author_year", f"WITH {_CASCADE} SELECT cand_id, round(CAST(len(list_intersect(list_distinct(k.authors), list_distinct(c.authors))) AS DOUBLE) / len(list_distinct(k.authors)), 4) AS coverage, coalesce(abs(k.year - c.year) <= 1, false) AS year_ok FROM k JOIN r USING (cand_id) JOIN c USING (doc_id)")
def author_year(spark, sf):
    return _pairs(spark, sf).select("cand_id", F.round(ident.author_coverage(F.col("cand.authors"), F.col("rec.authors")), 4).alias("coverage"), ident.year_matches(F.col("cand.year"), F.col("rec.year")).alias("year_ok"))


@_query(
    "merge_records",
    f"""WITH m AS (SELECT *, {_norm("title")} AS key, '' AS none FROM ({A.CORPUS_SQL})),
    o AS (SELECT *, (title <> '')::INT + (venue <> '')::INT + (abstract <> '')::INT + (year IS NOT NULL)::INT AS f FROM m)
    SELECT 'title:' || key AS key, arg_min(doc_id, (-f, doc_id)) AS doc_id, coalesce(arg_min(title, (-f, doc_id)) FILTER (title <> ''), '') AS title, coalesce(arg_min(venue, (-f, doc_id)) FILTER (venue <> ''), '') AS venue,
    arg_min(year, (-f, doc_id)) AS year, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS n_records FROM o GROUP BY key""",
)
def merge_records(spark, sf):
    return audit.merge_records(A.corpus(spark, sf).withColumns({"doi": F.lit(""), "arxiv_id": F.lit("")}))


@_query(
    "metadata_quality",
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN title = '' THEN 'title' END, CASE WHEN len(authors) = 0 THEN 'authors' END, CASE WHEN year IS NULL THEN 'year' END, CASE WHEN venue = '' THEN 'venue' END,
    CASE WHEN abstract = '' THEN 'abstract' END, CASE WHEN doi = '' AND arxiv_id = '' THEN 'identifier' END, 'url'], lambda x: x IS NOT NULL), ',') AS missing,
    round((6 - (title = '')::INT - (len(authors) = 0)::INT - (year IS NULL)::INT - (venue = '')::INT - (abstract = '')::INT - (doi = '' AND arxiv_id = '')::INT) / 7.0, 4) AS ratio FROM ({A.CORPUS_SQL})""",
)
def metadata_quality(spark, sf):
    q = audit.completeness(*(F.col(c) for c in ("title", "authors", "year", "venue", "abstract", "doi", "arxiv_id")), F.lit(""))
    return A.corpus(spark, sf).select("doc_id", q.alias("q")).select("doc_id", F.array_join("q.missing", ",").alias("missing"), F.col("q.ratio").alias("ratio"))


_MODE = "CASE WHEN len(sources_failed) = 0 THEN 'none' WHEN len(sources_responded) > 0 THEN 'partial_outage' WHEN len(list_filter(sources_checked, lambda s: NOT list_contains(sources_failed, s))) = 0 THEN 'all_sources_failed' ELSE 'partial_outage' END"
_RISKS = f"""
i AS (SELECT *, {_MODE} AS mode, len(sources_failed) > 0 AS bad FROM ({A.VERDICTS_SQL})),
k AS (SELECT *, CASE verdict WHEN 'verified' THEN CASE WHEN bad THEN 'medium' ELSE 'low' END WHEN 'metadata_mismatch' THEN 'medium' ELSE 'high' END AS risk,
  CASE WHEN bad THEN greatest(CAST(CASE verdict WHEN 'verified' THEN 0.05 WHEN 'metadata_mismatch' THEN 0.65 WHEN 'not_found' THEN 0.95 ELSE 0.85 END AS DOUBLE), 0.55) ELSE CAST(CASE verdict WHEN 'verified' THEN 0.05 WHEN 'metadata_mismatch' THEN 0.65 WHEN 'not_found' THEN 0.95 ELSE 0.85 END AS DOUBLE) END AS risk_score,
  CASE WHEN mode = 'all_sources_failed' THEN 'retry_or_check_source_health' WHEN bad AND verdict = 'verified' THEN 'inspect_source_health' WHEN verdict = 'verified' THEN 'keep' WHEN verdict = 'metadata_mismatch' THEN 'review_metadata' WHEN verdict = 'not_found' THEN 'resolve_identifier_or_replace' ELSE 'disambiguate_identifier' END AS next_action FROM i)"""


@_query("verdict_counts", f"SELECT v AS verdict, count(idx) AS n FROM (SELECT unnest(['verified', 'metadata_mismatch', 'not_found', 'ambiguous']) AS v) LEFT JOIN ({A.VERDICTS_SQL}) ON v = verdict GROUP BY v")
def verdict_counts(spark, sf):
    return audit.verdict_counts(A.verdicts(spark, sf))


@_query("source_failure_mode", f"SELECT mode, count(*) AS n FROM (SELECT {_MODE} AS mode FROM ({A.VERDICTS_SQL})) GROUP BY mode")
def source_failure_mode(spark, sf):
    return audit.risk_items(A.verdicts(spark, sf)).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@_query("risk_ranking", f"WITH {_RISKS} SELECT idx, risk, risk_score, next_action, row_number() OVER (ORDER BY risk_score DESC, idx) AS position FROM k")
def risk_ranking(spark, sf):
    return audit.ranked(audit.risk_items(A.verdicts(spark, sf))).select("idx", "risk", "risk_score", "next_action", "position")


@_query("review_summary", f"WITH {_RISKS} SELECT risk, next_action, count(*) AS n, array_to_string(list_sort(list(idx))[1:5], ',') AS first_five FROM k GROUP BY ALL")
def review_summary(spark, sf):
    x = audit.risk_items(A.verdicts(spark, sf))
    w = Window.partitionBy("risk", "next_action").orderBy("idx")
    top = x.select("risk", "next_action", "idx", F.row_number().over(w).alias("r")).where("r <= 5")
    few = top.groupBy("risk", "next_action").agg(F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda v: v.cast("string")), ",").alias("first_five"))
    return x.groupBy("risk", "next_action").agg(F.count(F.lit(1)).alias("n")).join(few, ["risk", "next_action"])


@_query("high_risk_only", f"WITH {_RISKS} SELECT idx, verdict, risk_score FROM k WHERE risk = 'high'")
def high_risk_only(spark, sf):
    return audit.risk_items(A.verdicts(spark, sf)).where("risk = 'high'").select("idx", "verdict", "risk_score")


@_query("confidence_caps", f"SELECT idx, round(least(CASE WHEN verdict = 'not_found' THEN 1 - score ELSE score END, CASE WHEN mode = 'all_sources_failed' THEN 0.35 WHEN mode = 'partial_outage' AND verdict = 'not_found' THEN 0.65 WHEN mode = 'partial_outage' THEN 0.85 ELSE 1.0 END), 4) AS confidence FROM (SELECT *, {_MODE} AS mode FROM ({A.VERDICTS_SQL}))")
def confidence_caps(spark, sf):
    x = audit.risk_items(A.verdicts(spark, sf))
    return x.select("idx", audit.confidence(F.col("verdict"), F.col("score"), F.col("mode")).alias("confidence"))


_LEAD = "list_last(string_split(trim(authors[1]), ' '))"


@_query(
    "format_citations",
    f"""SELECT doc_id, '(' || {_LEAD} || ', ' || year || ')' AS inline, array_to_string(authors, ', ') || ' (' || year || '). ' || title || '.' || CASE WHEN venue <> '' THEN ' ' || venue || '.' ELSE '' END AS reference,
    '@article{{' || lower({_LEAD}) || year || lower(CASE WHEN regexp_extract(title, '[A-Za-z0-9]+', 0) = '' THEN 'record' ELSE regexp_extract(title, '[A-Za-z0-9]+', 0) END) AS entry_key,
    array_to_string(authors, ', ') || '. ' || title || CASE WHEN venue <> '' THEN '[J]. ' || venue || ', ' || year ELSE '[EB/OL], ' || year END || '. DOI: ' || doi || '.' AS gbt FROM ({A.CORPUS_SQL})""",
)
def format_citations(spark, sf):
    a, y, t, v, d = (F.col(c) for c in ("authors", "year", "title", "venue", "doi"))
    entry = cite.bibtex(a, y, t, v, d, F.lit(""))
    return A.corpus(spark, sf).select("doc_id", cite.inline(a, y, t).alias("inline"), cite.reference(a, y, t, v).alias("reference"), F.substring_index(entry, ",", 1).alias("entry_key"), cite.gbt7714(a, y, t, v, d, F.lit("")).alias("gbt"))


@_query(
    "page_urls",
    """SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_matches(url, '^https?://[^/]') AND NOT regexp_matches(url, '^https?://(localhost|127\\.|10\\.|192\\.168\\.)') AS allowed FROM pages""",
)
def page_urls(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.try_parse_url(F.col("url"), F.lit("HOST")).alias("host"), readers.allowed_url(F.col("url")).alias("allowed"))


# ---- similarity (no SQL counterpart) ----------------------------------------------------------------------------


@_query("fuzzy_title_match")
def fuzzy_title_match(spark, sf):
    parts = A.table(spark, sf, "part").select(F.col("p_partkey").alias("cand_id"), F.col("p_name").alias("title"))
    return similarity.best_others(parts, "cand_id", "title", "doc_id", "name", 0.571, 3)


# ---- support ----------------------------------------------------------------------------------------------------


def _evidence(spark, sf):
    """Claims with the sentences of their three best documents."""
    top, _ = handed(_bm25(spark, sf, 3).select("query_id", F.col("doc_id").alias("citation")), "best")
    spans = support.evidence_spans(A.corpus(spark, sf).select(F.col("doc_id").alias("citation"), "title", "abstract").join(top.select("citation"), "citation", "left_semi"), "citation")
    return top.join(spans, "citation").join(_claims(spark, sf), "query_id")


@_query("evidence_spans", f"""WITH c AS (SELECT doc_id, title, {_WHOLE.replace("text", "abstract")} AS whole FROM ({A.CORPUS_SQL})),
    s AS (SELECT doc_id, list_filter([trim(title)], lambda x: x <> '') AS h, CASE WHEN whole = '' THEN [] ELSE list_filter(string_split(regexp_replace(whole, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') END AS p, whole FROM c),
    e AS (SELECT doc_id, len(h) AS n_title, list_concat(h, p, CASE WHEN whole = '' OR list_contains(p, whole) THEN [] ELSE [whole] END) AS l FROM s),
    u AS (SELECT doc_id, n_title, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS ord FROM e)
    SELECT doc_id, CAST(min(ord) AS INTEGER) AS ord, CASE WHEN min(ord) < any_value(n_title) THEN 'title' ELSE 'abstract' END AS scope, text FROM u GROUP BY doc_id, text""")
def evidence_spans(spark, sf):
    return support.evidence_spans(A.corpus(spark, sf), "doc_id")


_HEUR = f"""
hq AS (SELECT item_id AS query_id, {_tok("text")} AS ct FROM benchmark), t AS ({_ranked("b", 3)}),
e AS (SELECT query_id, doc_id, ct, {_tok("text")} AS et FROM t JOIN documents USING (doc_id) JOIN hq USING (query_id)),
g AS (SELECT query_id, doc_id, list_distinct(ct) AS a, list_distinct(et) AS b, list_distinct(list_transform(generate_series(1, len(ct) - 1), lambda i: ct[i] || ' ' || ct[i + 1])) AS ab,
  list_distinct(list_transform(generate_series(1, len(et) - 1), lambda i: et[i] || ' ' || et[i + 1])) AS bb FROM e),
v AS (SELECT query_id, doc_id, len(list_intersect(a, b)) AS shared, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(a), 1) AS coverage, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(b), 1) AS prec,
  CASE WHEN len(ab) = 0 THEN 0 ELSE CAST(len(list_intersect(ab, bb)) AS DOUBLE) / len(ab) END AS phrase FROM g),
z AS (SELECT *, least(1.0, 0.55 * coverage + 0.25 * prec + 0.20 * phrase) AS score FROM v)"""


def _best_texts(spark, sf):
    """Claims with the texts of their three best documents."""
    top, few = handed(_bm25(spark, sf, 3).select("query_id", "doc_id"), "best")
    docs = A.table(spark, sf, "documents").select("doc_id", "text") if few else _docs(spark, sf)
    return docs.join(top, "doc_id").join(_claims(spark, sf), "query_id")


def _heuristic(spark, sf):
    x = _best_texts(spark, sf)
    return support.heuristic_support(x, Q, T)


@_query("heuristic_support", f"WITH {_BM25}, {_HEUR} SELECT query_id, doc_id, CAST(shared AS INTEGER) AS shared, round(coverage, 4) AS coverage, round(prec, 4) AS prec, round(phrase, 4) AS phrase, round(score, 4) AS score, score >= 0.18 AND shared >= 2 AS passed FROM z")
def heuristic_support(spark, sf):
    r = lambda c: F.round(c, 4).alias(c)
    return _heuristic(spark, sf).select("query_id", "doc_id", "shared", r("coverage"), r("prec"), r("phrase"), r("score"), "passed")


@_query("best_span")
def best_span(spark, sf):
    x = support.heuristic_support(_evidence(spark, sf), Q, T).withColumn("score", F.round("score", 6))
    return support.best_span(x, "query_id")


_SENT = """SELECT doc_id AS cand_id, CASE doc_id % 6 WHEN 0 THEN 'The method improves recall of ' WHEN 1 THEN 'All methods must use ' WHEN 2 THEN 'The study supports ' WHEN 3 THEN 'It is not claimed to support ' WHEN 4 THEN 'Exclusion criteria cover every case of ' ELSE 'Plain words about ' END || source AS claim,
  CASE doc_id % 5 WHEN 0 THEN 'It does not improve results, they are worse for ' WHEN 1 THEN 'This step is optional by default in ' WHEN 2 THEN 'The data do not support ' WHEN 3 THEN 'Details are available in the appendix of ' ELSE 'Nothing is said of ' END || source AS evidence FROM documents"""


def _sentences(spark, sf):
    k, s = F.col("doc_id"), F.col("source")
    pick = lambda n, xs: F.concat(F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int")), s)
    return A.table(spark, sf, "documents").select(
        k.alias("cand_id"),
        pick(6, ["The method improves recall of ", "All methods must use ", "The study supports ", "It is not claimed to support ", "Exclusion criteria cover every case of ", "Plain words about "]).alias("claim"),
        pick(5, ["It does not improve results, they are worse for ", "This step is optional by default in ", "The data do not support ", "Details are available in the appendix of ", "Nothing is said of "]).alias("evidence"),
    )


@_query(
    "contradiction_rules",
    f"""WITH n AS (SELECT cand_id, {_norm("claim")} AS c, {_norm("evidence")} AS e FROM ({_SENT}))
    SELECT cand_id, {rules.family_sql("contradiction", "c", "e")} AS contradicts, {rules.family_sql("boundary", "c", "e")} AS boundary FROM n""",
)
def contradiction_rules(spark, sf):
    c, e = F.col("claim"), F.col("evidence")
    return _sentences(spark, sf).select("cand_id", support.contradiction(c, e).alias("contradicts"), support.full_text_boundary(c, e).alias("boundary"))


@_query(
    "support_decision",
    """WITH p AS (SELECT doc_id, CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS en, CAST(doc_id * 53 % 101 AS DOUBLE) / 100 AS co, CASE WHEN doc_id % 11 = 0 THEN 0.6 ELSE 0.0 END AS ex, CAST(doc_id * 71 % 101 AS DOUBLE) / 100 AS an, doc_id % 13 = 0 AS bo, ['title', 'abstract', 'full_text', 'metadata_snippet'][doc_id % 4 + 1] AS sc FROM documents)
    SELECT doc_id, CASE WHEN ex >= 0.55 THEN 'contradicted' WHEN bo AND sc <> 'full_text' THEN 'insufficient_evidence' WHEN en >= 0.55 AND en >= co + 0.05 THEN 'supported' WHEN co >= 0.55 AND an >= 0.30 THEN 'contradicted'
    WHEN sc IN ('metadata_snippet', 'full_text') AND en >= 0.40 AND en >= co + 0.05 AND an >= 0.18 THEN 'supported' WHEN an > 0 AND en >= 0.30 AND en >= co + 0.05 THEN 'weakly_supported' ELSE 'insufficient_evidence' END AS verdict FROM p""",
)
def support_decision(spark, sf):
    k = F.col("doc_id")
    p = lambda m: (k * m % 101).cast("double") / 100
    scope = F.element_at(F.array(*map(F.lit, ("title", "abstract", "full_text", "metadata_snippet"))), (k % 4 + 1).cast("int"))
    return A.table(spark, sf, "documents").select("doc_id", support.decide(p(37), p(53), F.when(k % 11 == 0, 0.6).otherwise(0.0), p(71), k % 13 == 0, scope).alias("verdict"))


@_query(
    "support_set",
    """WITH m AS (SELECT conv_id, ['supported', 'weakly_supported', 'insufficient_evidence', 'contradicted', 'insufficient_evidence', 'weakly_supported', 'insufficient_evidence'][(conv_id * 3 + turn * 5) % 7 + 1] AS v, CAST((conv_id + turn * 17) % 100 AS DOUBLE) / 100 AS c FROM conversations),
    g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (v = 'contradicted') AS nc, count(*) FILTER (v = 'supported') AS ns, count(*) FILTER (v = 'weakly_supported') AS nw, max(c) FILTER (v = 'contradicted') AS cc, max(c) FILTER (v = 'supported') AS cs, avg(c) FILTER (v = 'weakly_supported') AS cw FROM m GROUP BY conv_id)
    SELECT conv_id, CASE WHEN nc > 0 THEN 'contradicted' WHEN ns > 0 THEN 'supported' WHEN nw > 0 THEN 'weakly_supported' ELSE 'insufficient_evidence' END AS verdict, round(CASE WHEN nc > 0 THEN cc WHEN ns > 0 THEN cs WHEN nw > 0 THEN cw ELSE 0 END, 4) AS confidence, n, nc AS n_contradicted, ns AS n_supported, nw AS n_weak FROM g""",
)
def support_set(spark, sf):
    names = ("supported", "weakly_supported", "insufficient_evidence", "contradicted", "insufficient_evidence", "weakly_supported", "insufficient_evidence")
    m = A.table(spark, sf, "conversations").select("conv_id", F.element_at(F.array(*map(F.lit, names)), ((F.col("conv_id") * 3 + F.col("turn") * 5) % 7 + 1).cast("int")).alias("verdict"), (((F.col("conv_id") + F.col("turn") * 17) % 100).cast("double") / 100).alias("confidence"))
    return support.support_set(m, "conv_id")


_PROBES = " UNION ALL ".join(f"SELECT item_id, '{role}' AS role, text || ' {tail}' AS query FROM c WHERE {rules.probe_cue(p, t).sql('n')}" for role, p, t, tail in rules.PROBES)


@_query("counterevidence_queries", f"WITH c AS (SELECT item_id, text, {_norm('text')} AS n FROM benchmark) SELECT item_id, 'claim_similarity' AS role, text AS query FROM c UNION ALL {_PROBES}")
def counterevidence_queries(spark, sf):
    return rules.counter_queries(A.table(spark, sf, "benchmark"), "item_id", "text")


_CUE = ", ".join(f"'{c}'" for c in support.CUES)


@_query("contradiction_cues", f"""WITH {_BM25}, t AS ({_ranked("b", 3)}), e AS (SELECT query_id, t.doc_id, list_distinct({_tok("benchmark.text")}) AS c, list_distinct({_tok("documents.text")}) AS d FROM t JOIN documents USING (doc_id) JOIN benchmark ON item_id = query_id),
    n AS (SELECT query_id, doc_id, len(list_intersect(c, d)) AS s, len(list_intersect(d, [{_CUE}])) AS h FROM e)
    SELECT query_id, doc_id, round(greatest(CASE WHEN s > 0 THEN least(1.0, CAST(h AS DOUBLE) / s) ELSE 0 END, least(1.0, h / 3.0)), 6) AS risk FROM n""")
def contradiction_cues(spark, sf):
    x = _best_texts(spark, sf)
    return support.contradiction_risk(x, Q, T).select("query_id", "doc_id", F.round("risk", 6).alias("risk"))


def _findings(spark, sf):
    k = F.col("doc_id")
    one = lambda name, m, t: F.struct(F.lit(name).alias("verifier"), ((k * m % 101).cast("double") / 100).alias("score"), ((k * m % 101).cast("double") / 100 >= t).alias("passed"))
    x = A.table(spark, sf, "documents").select((k % 97).alias("claim"), k.alias("citation"), F.explode(F.array(one("existence", 31, 0.2), one("metadata", 47, 0.2), one("support", 59, 0.3), one("contradiction", 67, 0.65))).alias("f"))
    return x.select("claim", "citation", "f.*")


_GATE = """
f AS (SELECT doc_id % 97 AS claim, doc_id AS citation, CAST(doc_id * 31 % 101 AS DOUBLE) / 100 AS e, CAST(doc_id * 47 % 101 AS DOUBLE) / 100 AS m, CAST(doc_id * 59 % 101 AS DOUBLE) / 100 AS s, CAST(doc_id * 67 % 101 AS DOUBLE) / 100 AS c FROM documents),
r AS (SELECT *, round(1 - (e * 0.35 + m * 0.25 + s * 0.30 + c * 0.10) / 1.0, 6) AS risk FROM f),
g AS (SELECT claim, citation, risk, CASE WHEN e < 0.2 OR m < 0.2 THEN 'abstain' WHEN risk <= 0.35 AND s >= 0.3 THEN 'cite' WHEN risk <= 0.55 THEN 'rewrite' ELSE 'abstain' END AS action FROM r)"""


@_query("risk_fusion_gate", f"WITH {_GATE} SELECT * FROM g")
def risk_fusion_gate(spark, sf):
    return support.fuse(_findings(spark, sf), ["claim", "citation"])


@_query("best_decision", f"WITH {_GATE} SELECT claim, citation, action, risk FROM g QUALIFY row_number() OVER (PARTITION BY claim ORDER BY CASE action WHEN 'cite' THEN 2 WHEN 'rewrite' THEN 1 ELSE 0 END DESC, risk, citation) = 1")
def best_decision(spark, sf):
    return support.best_decision(support.fuse(_findings(spark, sf), ["claim", "citation"]), "claim", "citation")


# ---- evaluation -------------------------------------------------------------------------------------------------

_J = f"j AS ({A.JUDGED_SQL})"
_G, _P = "gold = 'supported'", "pred = 'supported'"


def _n(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


@_query(
    "support_metrics",
    f"""WITH {_J} SELECT count(*) AS n, {_share(_n("gold = pred"), "count(*)")} AS accuracy, {_share(_n(f"{_G} AND {_P}"), _n(_P))} AS supported_precision, {_share(_n(f"{_G} AND {_P}"), _n(_G))} AS supported_recall,
    {_share("2 * " + _n(f"{_G} AND {_P}"), f"({_n(_P)} + {_n(_G)})")} AS supported_f1, {_share(_n(f"{_P} AND gold <> 'supported'"), _n("gold <> 'supported'"))} AS false_support_rate,
    {_n("pred IN ('supported', 'weakly_supported') AND gold NOT IN ('supported', 'weakly_supported')")} AS support_overcall_count, {_share(_n("pred = 'insufficient_evidence'"), "count(*)")} AS abstention_rate,
    {_share(_n(f"{_G} AND pred IN ('contradicted', 'insufficient_evidence')"), _n(_G))} AS misjudged_support_rate, {_share(_n("gold = 'contradicted' AND pred = 'contradicted'"), _n("gold = 'contradicted'"))} AS contradiction_recall FROM j""",
)
def support_metrics(spark, sf):
    return evaluate.support_metrics(A.judged(spark, sf))


_LABELS = f"""l AS (SELECT label, {_n("gold = label AND pred = label")} AS tp, {_n("pred = label")} AS predicted, {_n("gold = label")} AS gold FROM j, (SELECT unnest(['supported', 'weakly_supported', 'insufficient_evidence', 'contradicted']) AS label) GROUP BY label),
m AS (SELECT label, tp, predicted, gold, {_share("tp", "predicted")} AS prec, {_share("tp", "gold")} AS recall, {_share("2 * tp", "(predicted + gold)")} AS f1 FROM l)"""


@_query("per_label", f"WITH {_J}, {_LABELS} SELECT * FROM m")
def per_label(spark, sf):
    return evaluate.per_label(A.judged(spark, sf))


_WHOLE_SUM = lambda c, by: f"sum(CAST(round({c} * 10000) AS BIGINT){by})"
_HALF_UP = lambda s, n: f"floor((2 * {s} + {n}) / (2 * {n})) / 10000.0::DOUBLE"


@_query("macro_weighted", f"WITH {_J}, {_LABELS} SELECT " + ", ".join(f"{_HALF_UP(_WHOLE_SUM(c, ''), 'count(*)')} AS macro_{c}, {_HALF_UP(_WHOLE_SUM(c, ' * gold'), 'greatest(sum(gold), 1)')} AS weighted_{c}" for c in ("prec", "recall", "f1")) + " FROM m")
def macro_weighted(spark, sf):
    return evaluate.averages(evaluate.per_label(A.judged(spark, sf)))


@_query("confusion_matrix", f"WITH {_J} SELECT gold, " + ", ".join(f"{_n(f'pred = {chr(39)}{x}{chr(39)}')} AS {x}" for x in evaluate.LABELS) + " FROM j GROUP BY gold")
def confusion_matrix(spark, sf):
    return evaluate.confusion(A.judged(spark, sf))


@_query("grouped_metrics", f"WITH {_J}, g AS (" + " UNION ALL ".join(f"SELECT '{f}' AS facet, {f} AS value, count(*) AS n, {_n('gold = pred')} AS h, {_n(chr(112) + 'red = ' + chr(39) + 'insufficient_evidence' + chr(39))} AS a FROM j GROUP BY {f}" for f in ("case_type", "evidence_scope", "lang", "split")) + f" UNION ALL SELECT 'overall', 'all', count(*), {_n('gold = pred')}, {_n(chr(112) + 'red = ' + chr(39) + 'insufficient_evidence' + chr(39))} FROM j) SELECT facet, value, n, {_share('h', 'n')} AS accuracy, {_share('a', 'n')} AS abstention_rate FROM g")
def grouped_metrics(spark, sf):
    return evaluate.grouped_metrics(A.judged(spark, sf), ["case_type", "evidence_scope", "lang", "split"])


_BUCKET = {
    "false_support": "pred = 'supported' AND gold <> 'supported'",
    "weak_false_support": "pred = 'weakly_supported' AND gold NOT IN ('supported', 'weakly_supported')",
    "missed_contradiction": "gold = 'contradicted' AND pred <> 'contradicted'",
    "supported_rejected": "gold = 'supported' AND pred IN ('contradicted', 'insufficient_evidence')",
    "incorrect_abstention": "pred = 'insufficient_evidence' AND gold <> 'insufficient_evidence'",
    "correct_abstention": "pred = 'insufficient_evidence' AND gold = 'insufficient_evidence'",
}


@_query("error_buckets", f"WITH {_J}, b AS (" + " UNION ALL ".join(f"SELECT '{k}' AS bucket, case_type FROM j WHERE {v}" for k, v in _BUCKET.items()) + ") SELECT bucket, count(*) AS n, count(DISTINCT case_type) AS case_types FROM b GROUP BY bucket")
def error_buckets(spark, sf):
    return evaluate.error_buckets(A.judged(spark, sf))


@_query(
    "review_queue",
    f"WITH {_J}, q AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _BUCKET.items() if k != "correct_abstention") + "], lambda x: x IS NOT NULL) AS b, greatest(" + ", ".join(f"CASE WHEN {_BUCKET[k]} THEN {s} ELSE 0 END" for k, s in evaluate.SEVERITY.items()) + ") AS severity FROM j) SELECT case_id, case_type, split, array_to_string(b, ',') AS buckets, severity, split = 'test' AS first FROM q WHERE len(b) > 0",
)
def review_queue(spark, sf):
    return evaluate.review_queue(A.judged(spark, sf))


@_query("integrity_metrics", "WITH a AS (SELECT avg(CAST(quality = 0 AS INT)) AS p, avg(CAST(toxic = 1 AS INT)) AS e, avg(CAST(quality = 1 AS INT)) AS s, avg(CAST(doc_id % 5 = 0 AS INT)) AS u, avg(CAST(doc_id % 3 = 0 AS INT)) AS a FROM labels) SELECT round(p, 4) AS PCR, round(e, 4) AS MCR, round(s, 4) AS CSR, round(u, 4) AS UCR, round(a, 4) AS AU, round(0.25 * (1 - p) + 0.2 * (1 - e) + 0.3 * s + 0.15 * (1 - u) + 0.1 * a, 4) AS RIS FROM a")
def integrity_metrics(spark, sf):
    x = A.table(spark, sf, "labels").select((F.col("quality") == 0).alias("phantom"), (F.col("toxic") == 1).alias("metadata_error"), (F.col("quality") == 1).alias("claim_supported"), (F.col("doc_id") % 5 == 0).alias("unsupported"), (F.col("doc_id") % 3 == 0).alias("abstained"))
    return evaluate.integrity(x)


@_query(
    "calibration_grid",
    """WITH e AS (SELECT CAST(doc_id % 11 AS DOUBLE) / 10 AS a, CAST(doc_id % 7 AS DOUBLE) / 6 AS b, quality = 1 AS s FROM labels), g AS (SELECT w, t AS threshold, f AS floor FROM (SELECT unnest([0.2, 0.5, 0.8]) AS w), (SELECT unnest([0.3, 0.5, 0.7]) AS t), (SELECT unnest([0.0, 0.1, 0.2]) AS f)),
    h AS (SELECT CAST(w AS DOUBLE) AS w, CAST(threshold AS DOUBLE) AS threshold, CAST(floor AS DOUBLE) AS floor, s, CAST(w AS DOUBLE) * a + (1 - CAST(w AS DOUBLE)) * b >= CAST(threshold AS DOUBLE) AND a >= CAST(floor AS DOUBLE) AS hit FROM e, g),
    m AS (SELECT w, threshold, floor, count(*) FILTER (hit AND s) AS tp, count(*) FILTER (hit AND NOT s) AS fp, count(*) FILTER (NOT hit AND s) AS fn, count(*) FILTER (NOT hit AND NOT s) AS tn FROM h GROUP BY ALL)
    SELECT *, round(CAST(tp AS DOUBLE) / greatest(tp + fp, 1), 4) AS prec, round(CAST(tp AS DOUBLE) / greatest(tp + fn, 1), 4) AS recall, round(2.0 * tp / greatest(2 * tp + fp + fn, 1), 4) AS f1 FROM m""",
)
def calibration_grid(spark, sf):
    x = A.table(spark, sf, "labels").where("quality is not null").select(((F.col("doc_id") % 11).cast("double") / 10).alias("a"), ((F.col("doc_id") % 7).cast("double") / 6).alias("b"), (F.col("quality") == 1).alias("supported"))
    axis = lambda name, values: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    return evaluate.calibration(x, axis("w", [0.2, 0.5, 0.8]).crossJoin(axis("threshold", [0.3, 0.5, 0.7])).crossJoin(axis("floor", [0.0, 0.1, 0.2])))


@_query("facet_caps", f"WITH {_J} SELECT case_id, lang, case_type FROM j QUALIFY row_number() OVER (PARTITION BY lang ORDER BY case_type, case_id) <= 10")
def facet_caps(spark, sf):
    return evaluate.facet_caps(A.judged(spark, sf), "lang", [F.col("case_type"), F.col("case_id")], 10).select("case_id", "lang", "case_type")


@_query("review_coverage_cube", f"WITH {_J} SELECT coalesce(lang, '*') AS lang, coalesce(case_type, '*') AS case_type, count(*) AS n, {_share(_n('gold = pred'), 'count(*)')} AS agreement FROM j GROUP BY CUBE (lang, case_type)")
def review_coverage_cube(spark, sf):
    x = A.judged(spark, sf).cube("lang", "case_type").agg(F.count(F.lit(1)).alias("n"), evaluate.share(F.count_if(F.col("gold") == F.col("pred")), F.count(F.lit(1))).alias("agreement"))
    return x.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("case_type", F.lit("*")).alias("case_type"), "n", "agreement")


@_query("label_maturity", f"WITH {_J} SELECT split, count(*) AS n, {_n('gold = pred')} AS agreed, array_to_string(list_sort(list_distinct(list(gold))), ',') AS seen FROM j GROUP BY split")
def label_maturity(spark, sf):
    return A.judged(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("agreed"), F.array_join(F.array_sort(F.collect_set("gold")), ",").alias("seen"))


# ---- cache, extraction, streams -----------------------------------------------------------------------------------

_CACHE = """SELECT CASE event_type WHEN 'click' THEN 'search:' WHEN 'view' THEN 'lookup:' ELSE 'misc:' END || user_id AS key, event_id AS row_id, value, ts AS updated_at, CAST(json_extract_string(props, '$.k') AS INTEGER) AS record_count FROM events"""


def _cache(spark, sf):
    e = A.table(spark, sf, "events")
    op = F.when(F.col("event_type") == "click", "search:").when(F.col("event_type") == "view", "lookup:").otherwise("misc:")
    return e.select(F.concat(op, F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("row_id"), "value", F.col("ts").alias("updated_at"), F.get_json_object("props", "$.k").cast("int").alias("record_count"))


@_query("cache_upsert_latest", f"SELECT key, arg_max(value, (updated_at, row_id)) AS value, max(updated_at) AS updated_at, min(updated_at) AS created_at, count(*) AS writes FROM ({_CACHE}) GROUP BY key")
def cache_upsert_latest(spark, sf):
    return cachetab.latest(_cache(spark, sf))


@_query("cache_ttl", f"WITH c AS (SELECT *, max(updated_at) OVER () AS now FROM ({_CACHE})) SELECT key, row_id FROM c WHERE epoch(now) - epoch(updated_at) < CASE WHEN record_count = 0 THEN 900 ELSE 86400 END")
def cache_ttl(spark, sf):
    c = _cache(spark, sf)
    now = c.agg(F.max("updated_at").alias("now"))
    seconds = lambda x: F.unix_micros(F.col(x).cast("timestamp")) / 1e6
    x = c.crossJoin(F.broadcast(now)).select("key", "row_id", "record_count", seconds("updated_at").alias("updated_at"), seconds("now").alias("now"))  # one row
    return cachetab.alive(x, F.col("now")).select("key", "row_id")


@_query("cache_prefix_counts", f"SELECT CASE WHEN key LIKE 'search:%' THEN 'search' WHEN key LIKE 'lookup:%' THEN 'lookup' ELSE 'other' END AS operation, count(*) AS n, min(updated_at) AS oldest, max(updated_at) AS newest FROM ({_CACHE}) GROUP BY operation")
def cache_prefix_counts(spark, sf):
    return cachetab.prefix_counts(_cache(spark, sf))


@_query("html_chunks")
def html_chunks(spark, sf):
    return extract.explode_with(A.table(spark, sf, "pages"), "page_id", "html", extract.html_chunks, "field string, chunk string")


@_query("window_chunks")
def window_chunks(spark, sf):
    return extract.explode_with(_docs(spark, sf), "doc_id", "text", extract.windows, "chunk string")


def _bibliography(spark, sf, style: str):
    c = A.corpus(spark, sf)
    if style == "bib":
        one = F.format_string('@string{v = "%s"}\n@article{k%s, title = {The {Nested} %s}, journal = v # " B", year = %s, doi = "%s"}\n', "venue", F.col("doc_id").cast("string"), "title", F.col("year").cast("string"), "doi")
    else:
        one = F.format_string("# Intro\ntext\n## References\n[1] %s.\n  %s, %s.\n[2] Another work, %s\n\n# Annex\n- no reference\n", "title", "venue", F.col("year").cast("string"), "doi")
    return c.select("doc_id", one.alias("text"))


@_query("bibtex_entries")
def bibtex_entries(spark, sf):
    return extract.explode_with(_bibliography(spark, sf, "bib"), "doc_id", "text", extract.bibtex_entries, "key string, title string, journal string, year string, doi string")


@_query("reference_lines")
def reference_lines(spark, sf):
    return extract.explode_with(_bibliography(spark, sf, "md"), "doc_id", "text", extract.reference_lines, "raw_text string")


@_query(
    "stream_sessions",
    """WITH e AS (SELECT *, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n_events FROM s GROUP BY user_id, k
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_sessions(spark, sf):
    """Sessions that the final watermark has closed; those still open are not emitted."""
    out = sessions.run_once(sessions.sessions(sessions.events_stream(spark, sf)), "sessions")
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n_events")


# ---- label provenance ----------------------------------------------------------------------------------------------


def _sidecar(spark, sf):
    """Two annotators for half of the cases, one for a quarter, none for the rest."""
    j = A.judged(spark, sf)
    k = F.col("case_id")
    who = F.when(k % 4 < 2, F.array(F.lit("x"), F.lit("y"))).when(k % 4 == 2, F.array(F.lit("x")))
    label = F.when((F.col("annotator") == "y") & (k % 8 == 1), F.col("pred")).otherwise(F.col("gold"))
    return j.select("case_id", "gold", "pred", F.explode(who).alias("annotator")).select("case_id", "annotator", label.alias("label"))


_ANNOTATED = f"""{_J}, a AS (SELECT case_id, annotator, CASE WHEN annotator = 'y' AND case_id % 8 = 1 THEN pred ELSE gold END AS label
  FROM (SELECT case_id, gold, pred, unnest(CASE WHEN case_id % 4 < 2 THEN ['x', 'y'] WHEN case_id % 4 = 2 THEN ['x'] ELSE [] END) AS annotator FROM j)),
m AS (SELECT case_id, count(*) AS annotators, CASE WHEN count(*) = 1 THEN 'single_annotator' WHEN count(DISTINCT label) = 1 THEN 'dual_annotator_agreed' ELSE 'conflict' END AS status,
  CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label, min(label) || '/' || max(label) AS seen FROM a GROUP BY case_id)"""


def _merged(spark, sf):
    return labels.merged(_sidecar(spark, sf))


@_query("annotation_merge", f"WITH {_ANNOTATED} SELECT * FROM m")
def annotation_merge(spark, sf):
    return _merged(spark, sf)


_SETTLED = f"""{_ANNOTATED}, d AS (SELECT m.case_id, annotators, CASE WHEN status = 'conflict' AND m.case_id % 3 <> 0 THEN 'dual_annotator_adjudicated' ELSE status END AS status, CASE WHEN status = 'conflict' AND m.case_id % 3 <> 0 THEN gold ELSE m.label END AS label FROM m JOIN j ON m.case_id = j.case_id)"""


def _settled(spark, sf):
    decisions = A.judged(spark, sf).select("case_id", F.when(F.col("case_id") % 3 != 0, F.col("gold")).alias("label"), "gold")
    return labels.adjudicated(_merged(spark, sf), decisions)


@_query("adjudication", f"WITH {_SETTLED} SELECT * FROM d")
def adjudication(spark, sf):
    return _settled(spark, sf)


_LABELLED = f"{_SETTLED}, l AS (SELECT j.*, coalesce(d.status, 'not_human_reviewed') AS status FROM j LEFT JOIN d USING (case_id))"


def _labelled(spark, sf):
    return labels.with_sidecar(A.judged(spark, sf), _settled(spark, sf).select("case_id", "status", "annotators"))


_MATURITY = f"""mt AS (SELECT count(*) AS n, {_n("status = 'not_human_reviewed'")} AS unreviewed, {_n("status = 'single_annotator'")} AS single, {_n("status IN ('dual_annotator_agreed', 'dual_annotator_adjudicated')")} AS dual,
  {_share(_n("status <> 'not_human_reviewed'"), "count(*)")} AS reviewed_rate, {_share(_n("status = 'dual_annotator_agreed'"), _n("status IN ('dual_annotator_agreed', 'dual_annotator_adjudicated')"))} AS agreement_rate FROM l)"""


@_query("review_maturity", f"WITH {_LABELLED}, {_MATURITY} SELECT * FROM mt")
def review_maturity(spark, sf):
    return labels.maturity(_labelled(spark, sf))


@_query("review_coverage", f"WITH {_LABELLED} SELECT lang, case_type, count(*) AS n, {_n(chr(115) + 'tatus <> ' + chr(39) + 'not_human_reviewed' + chr(39))} AS reviewed, round(CAST({_n('status <> ' + chr(39) + 'not_human_reviewed' + chr(39))} AS DOUBLE) / count(*), 4) AS rate FROM l GROUP BY ALL")
def review_coverage(spark, sf):
    return labels.coverage(_labelled(spark, sf))


@_query("label_gate", f"WITH {_LABELLED}, {_MATURITY} SELECT concat_ws(',', CASE WHEN reviewed_rate < 0.8 THEN 'reviewed_rate' END, CASE WHEN agreement_rate < 0.9 THEN 'agreement_rate' END, CASE WHEN dual < 10 THEN 'dual' END) AS failed, reviewed_rate >= 0.8 AND agreement_rate >= 0.9 AND dual >= 10 AS passed FROM mt")
def label_gate(spark, sf):
    return labels.gate(labels.maturity(_labelled(spark, sf)), {"reviewed_rate": 0.8, "agreement_rate": 0.9, "dual": 10})


@_query("dataset_validation", f"WITH {_J} SELECT 'duplicate_case_id' AS problem, CAST(case_id AS VARCHAR) AS value FROM j GROUP BY case_id HAVING count(*) > 1 UNION ALL SELECT 'missing_case_type', v FROM (SELECT unnest(['direct', 'weak', 'unrelated', 'metadata_only']) AS v) WHERE v NOT IN (SELECT case_type FROM j) UNION ALL SELECT 'missing_lang', v FROM (SELECT unnest(['en', 'zh']) AS v) WHERE v NOT IN (SELECT lang FROM j)")
def dataset_validation(spark, sf):
    return labels.validation(A.judged(spark, sf), "case_id", {"case_type": ("direct", "weak", "unrelated", "metadata_only"), "lang": ("en", "zh")})


@_query("source_health", "WITH c AS (SELECT event_type AS source, CASE WHEN user_id % 5 = 0 THEN 429 WHEN user_id % 7 = 0 THEN 503 ELSE 200 END AS code, CAST(user_id % 90 AS DOUBLE) AS ra FROM events), g AS (SELECT source, count(*) AS calls, count(*) FILTER (code >= 400) AS failures, count(*) FILTER (code = 429) AS rate_limited, max(ra) AS retry_after FROM c GROUP BY source) SELECT *, CASE WHEN failures = 0 THEN 'available' WHEN failures = calls THEN 'unavailable' WHEN rate_limited * 2 > failures THEN 'rate_limited' ELSE 'degraded' END AS status FROM g")
def source_health(spark, sf):
    u = F.col("user_id")
    calls = A.table(spark, sf, "events").select(F.col("event_type").alias("source"), F.when(u % 5 == 0, 429).when(u % 7 == 0, 503).otherwise(200).alias("status_code"), (u % 90).cast("double").alias("retry_after"))
    return labels.source_health(calls)


# the rest of the catalogue registers itself
from quillmark.plans import extended, reviews, searches, streams  # noqa: E402, F401
