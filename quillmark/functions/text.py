"""Text functions as Column expressions: everything stays in the JVM and inside code generation where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no weight in tokenization.
STOPWORDS = "a an and are as at be because by for from has have in is it of on or that the their to with".split()
CJK = "\\x{4E00}-\\x{9FFF}"

Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Text) -> Column:
    """Absent text is the empty string."""
    return F.coalesce(_col(c), F.lit(""))


def normalize_text(c: Text) -> Column:
    """Lower case; runs of anything but a-z, 0-9 and CJK ideographs (white space too) become one space.

    A class with ideographs makes the JVM's matcher several times slower, so only texts that hold some are matched with it.
    """
    x = F.lower(blank(c))
    plain, with_cjk = F.regexp_replace(x, "[^a-z0-9]+", " "), F.regexp_replace(x, f"[^a-z0-9{CJK}]+", " ")
    return F.trim(F.when(is_ascii(x) | ~x.rlike(f"[{CJK}]"), plain).otherwise(with_cjk))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def _pieces(chunk: Column) -> Column:
    """The Latin words and CJK bigrams of a chunk without spaces."""

    def of_run(x: Column) -> Column:
        n = F.length(x)
        pairs = F.when(n == 1, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))
        return F.when(x.rlike(f"^[{CJK}]"), pairs).when(x.isin(STOPWORDS), F.array().cast("array<string>")).otherwise(F.array(x))

    return F.flatten(F.transform(F.regexp_extract_all(chunk, F.lit(f"[{CJK}]+|[a-z0-9]+"), F.lit(0)), of_run))


def tokenize(c: Text) -> Column:
    """Latin words without stop words, and the character bigrams of CJK runs (a single character stays); order and repeats are kept."""
    norm = normalize_text(c)
    latin = F.filter(F.split(norm, " "), lambda x: (F.length(x) > 0) & ~x.isin(STOPWORDS))
    return F.when(is_ascii(norm), latin).otherwise(_pieces(norm))


def tokens(rows: DataFrame, text: Text, *keep: str) -> DataFrame:
    """``keep`` and token, a row for each token: as ``tokenize``, by generators inside code generation instead of lambdas. A text without tokens has a row with a null."""
    chunk = F.col("__chunk")
    plain = F.when((F.length(chunk) == 0) | chunk.isin(STOPWORDS), F.lit(None)).otherwise(chunk)
    x = rows.select(*keep, F.explode_outer(F.split(normalize_text(text), " ")).alias("__chunk"))
    return x.select(*keep, F.explode_outer(F.when(is_ascii(chunk), F.array(plain)).otherwise(_pieces(chunk))).alias("token"))


def bigrams(tokens: Text) -> Column:
    """Distinct pairs of neighbouring tokens, joined by a space."""
    t = _col(tokens)
    n = F.size(t)
    # neighbours by two slices: a lambda that indexes the array would build it again for each element
    m = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(F.slice(t, F.lit(1), m), F.slice(t, F.lit(2), m), lambda x, y: F.concat_ws(" ", x, y))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def collapse(c: Text) -> Column:
    """Runs of white space become one space. Single spaces, nearly all of the runs, are left where they are instead of being replaced by themselves."""
    return F.trim(F.regexp_replace(blank(c), "(?: \\s|[\\t\\n\\x0B\\f\\r])\\s*", " "))


def sentence_parts(whole: Text) -> Column:
    """A collapsed text, cut after .!? before a space."""
    # begins with the space, as most characters are none
    return F.filter(F.split(whole, " (?<=[.!?] )"), lambda x: F.length(x) > 0)


def with_whole(parts: Column, whole: Column) -> Column:
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).when(F.array_contains(parts, whole), parts).otherwise(F.concat(parts, F.array(whole)))


def split_sentences(c: Text) -> Column:
    """Sentences (cut after .!? before a space), then the whole text unless it is one of them."""
    whole = collapse(c)
    return with_whole(sentence_parts(whole), whole)


def snippet(c: Text, limit: int = 360) -> Column:
    whole = collapse(c)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, limit - 3)), F.lit("...")))


def strip_tags(c: Text) -> Column:
    """Tags go, the common entities are decoded (fixed values), spaces collapse."""
    text = blank(c)
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "\\s+", " "))


def slug(c: Text, limit: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(blank(c), "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", ""), 1, limit)


def clean_reference(c: Text) -> Column:
    """A reference from LaTeX source: comments go, commands are unwrapped, braces go, spaces collapse."""
    x = F.regexp_replace(blank(c), "%[^\\n]*", "")
    x = F.regexp_replace(x, "\\\\[a-zA-Z]+\\*?(?:\\[[^\\]]*\\])?\\{([^{}]*)\\}", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[{}]", ""), "\\s+", " "))


def cjk_share(c: Text) -> Column:
    """Share of CJK ideographs among the characters that are no white space."""
    solid = F.regexp_replace(blank(c), "\\s+", "")
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(solid, f"[^{CJK}]", "")) / F.length(solid))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))
