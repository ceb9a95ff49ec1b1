"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds: e-mail addresses, IP addresses, card and phone numbers are matched by expressions over whole texts, with
   their places in code points. They stay, whatever the method adds.
2. Every token that holds a digit or ``@`` is an occurrence; the two words before it are its lexical pattern, whatever they
   are. Patterns and instances (the token's core) form a bipartite graph, one weighted edge for each pair.
3. Rounds: an instance is believed if it is a seed, or as much as at least one of its patterns is right. Patterns that
   have MIN_SEEDS different believed instances become candidates, so those found in one round lead to new patterns in
   the next. A candidate scores the share of its occurrences, among *all* places of the corpus where its words stand
   before any token, that lead to believed instances; those that could not reach the confidence if all their instances
   were believed are left out.
4. Occurrences behind patterns of at least ``confidence`` become spans of kind ``id``, whatever their format.

Places are sums over the pieces of a text, folded in chunks of about the cube root of their number, so a text of very many
matches costs little more than its length. Rows are told apart by a row number, so repeated doc_ids (and null ones) are rows of their own. Null and
empty texts have no spans. Copies of a text are one piece of evidence: an instance counts once for a pattern. Ties need no
rule, as nothing is ranked. Empty tables give no rows; extra columns are ignored (kept by ``redact``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: What a seed looks like. Look-behinds and possessive quantifiers only keep the leftmost matches cheap.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TOKEN = r"(?<!\S)\S*[0-9@]\S*"
MIN_SEEDS, ROUNDS, CONFIDENCE = 3, 4, 0.7
#: Patterns (16 bytes each) that are broadcast at most; beyond, they are joined by key.
BROADCAST_PATTERNS = 100_000


def _q(pattern: str) -> str:
    """As a literal of SQL."""
    return "r'" + pattern.replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body``, in which ``value`` is evaluated once and has a name: a lambda would evaluate an expression again for each element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chunks(of: str) -> str:
    """An array (a name) in chunks, so many that appending to arrays of their size, and to one of their number, costs the same."""
    step = f"greatest(16, cast(ceil(1.26 * cbrt(size({of}))) AS int))"
    return f"transform(sequence(0, greatest(size({of}) - 1, 0), {step}), i -> slice({of}, i + 1, {step}))"


def _scan(chunks: str, value: str, join: str) -> str:
    """For each chunk (of x), what the values of all before it come to, from 0 by ``join`` of a and b."""
    return f"""aggregate(
        transform({chunks}, chunk -> aggregate(chunk, 0, (a, x) -> {join.replace("{b}", value).replace("{a}", "a")})),
        named_struct('at', 0, 'out', cast(array() AS array<int>)),
        (acc, t) -> named_struct('at', {join.replace("{b}", "t").replace("{a}", "acc.at")}, 'out', array_append(acc.out, acc.at)),
        acc -> acc.out)"""


def _spans(words: str, text: str, pattern: str, with_tail: bool) -> Column:
    """array<struct<start,end,word,tail>> of the matches ``words``: the lengths of what stands between them and their own add up to their places. ``tail`` is the last two words between a match and the one before."""
    tail = r"substring_index(trim(regexp_replace(g, r'\s+', ' ')), ' ', -2)" if with_tail else "''"
    pieces = f"zip_with(slice(split({text}, {_q(pattern)}, -1), 1, size({words})), {words}, (g, w) -> named_struct('n', char_length(g) + char_length(w), 'word', w, 'tail', {tail}))"
    span = "named_struct('start', acc.at + x.n - char_length(x.word), 'end', acc.at + x.n, 'word', x.word, 'tail', x.tail)"
    fold = f"""aggregate(chunk, named_struct('at', o, 'out', cast(array() AS array<struct<start:int,end:int,word:string,tail:string>>)),
        (acc, x) -> named_struct('at', acc.at + x.n, 'out', array_append(acc.out, {span})), acc -> acc.out)"""
    every = f"flatten(zip_with(chunks, {_scan('chunks', 'x.n', '{a} + {b}')}, (chunk, o) -> {fold}))"
    return F.expr(_let("pieces", pieces, _let("chunks", _chunks("pieces"), every)))


def _matches(rows: DataFrame, name: str, may: Column, pattern: str, with_tail: bool = False) -> DataFrame:
    empty, none = F.expr("cast(array() AS array<string>)"), F.expr("cast(array() AS array<struct<start:int,end:int,word:string,tail:string>>)")
    rows = rows.withColumn("__w", F.when(may, F.expr(f"regexp_extract_all(__text, {_q(pattern)}, 0)")).otherwise(empty))
    return rows.withColumn(name, F.when(F.size("__w") > 0, _spans("__w", "__text", pattern, with_tail)).otherwise(none)).drop("__w")


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(word: Column) -> Column:
    d = F.reverse(_digits(word))
    places = F.sequence(F.lit(1), F.length(d))

    def add(acc, i):
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = v * 2
        return acc + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    n = F.length(d)
    return (n >= 16) & (n <= 19) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def _valid(kind: str, word: Column) -> Column:
    n = F.length(_digits(word))
    return {"email": F.lit(True), "ip": word.rlike(f"^{IP_PART}(?:\\.{IP_PART}){{3}}$"), "card": _luhn(word), "phone": (n >= 8) & (n <= 15)}[kind]


def _found(rows: DataFrame) -> DataFrame:
    """Adds base (array of kind, start, end) and tokens (occurrences with their left context)."""
    text = F.col("__text")
    rows = rows.withColumn("__digit", text.rlike("[0-9]"))
    may = {"email": F.contains(text, F.lit("@")), "ip": F.col("__digit"), "card": F.col("__digit"), "phone": F.col("__digit") & F.contains(text, F.lit("+"))}
    for kind in KINDS:
        rows = _matches(rows, f"__{kind}", may[kind], PATTERNS[kind])
    rows = _matches(rows, "__tokens", may["email"] | may["ip"], TOKEN, with_tail=True)
    # the two words before a token: of what stands before it, the token before, what stands before that, and so on
    before = lambda k: f"slice(concat(transform(sequence(1, {k}), i -> cast(null AS struct<start:int,end:int,word:string,tail:string>)), __tokens), 1, size(__tokens))"
    left = r"substring_index(trim(regexp_replace(concat_ws(' ', ba.a.word, ba.b.tail, ba.b.word, c.tail), ' +', ' ')), ' ', -2)"
    pairs = f"zip_with({before(2)}, {before(1)}, (a, b) -> named_struct('a', a, 'b', b))"
    context = f"zip_with({pairs}, __tokens, (ba, c) -> named_struct('start', c.start, 'word', c.word, 'left', lower({left})))"
    rows = rows.withColumn("__tokens", F.expr(context))
    span = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    fine = lambda kind: lambda x: _valid(kind, x["word"])
    base = F.concat(*(F.transform(F.filter(f"__{kind}", fine(kind)), span(kind)) for kind in KINDS))
    rows = rows.withColumn("base", base)
    # a token's core, without quotes and punctuation around it
    lead = lambda x: F.regexp_extract(x["word"], r"^[\"'(\[<]*", 0)
    core = lambda x: F.regexp_extract(x["word"], r"^[\"'(\[<]*(.*?)[.,;:!?)\"'\]>]*$", 1)
    token = lambda x: F.struct((x["start"] + F.char_length(lead(x))).alias("start"), (x["start"] + F.char_length(lead(x)) + F.char_length(core(x))).alias("end"), F.lower(core(x)).alias("core"), x["left"].alias("left"))
    rows = rows.withColumn("tokens", F.filter(F.transform("__tokens", token), lambda x: F.contains(x["left"], F.lit(" ")) & (F.length(x["core"]) > 2)))
    return rows.drop("__digit", "__tokens", *(f"__{k}" for k in KINDS))


def _occurrences(rows: DataFrame) -> DataFrame:
    """row, start, end, core, left, seed: tokens in which no span begins earlier; seeds are those that meet one."""
    x = rows.where(F.size("tokens") > 0)
    alone = x.where(F.size("base") == 0).select("row", F.explode("tokens").alias("t")).select("row", "t.*", F.lit(False).alias("seed"))
    # tokens and spans of a text in one order; a token stands before the spans that begin with it
    none = F.lit(None).cast("string")
    both = x.where(F.size("base") > 0)
    tokens = both.select("row", F.explode("tokens").alias("t")).select("row", F.col("t.start").alias("start"), F.lit(0).alias("o"), F.col("t.end").alias("end"), "t.core", "t.left")
    spans = both.select("row", F.explode("base").alias("t")).select("row", F.col("t.start").alias("start"), F.lit(1).alias("o"), F.col("t.end").alias("end"), none.alias("core"), none.alias("left"))
    up, down = Window.partitionBy("row").orderBy("start", "o"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("o"))
    so_far = Window.unboundedPreceding, Window.currentRow
    of_span = lambda c: F.when(F.col("o") == 1, F.col(c))
    met = tokens.unionByName(spans).withColumn("reached", F.max(of_span("end")).over(up.rowsBetween(*so_far))).withColumn("next", F.min(of_span("start")).over(down.rowsBetween(*so_far)))
    met = met.where((F.col("o") == 0) & ~F.coalesce(F.col("reached") > F.col("start"), F.lit(False)))
    return alone.unionByName(met.select("row", "start", "end", "core", "left", F.coalesce(F.col("next") < F.col("end"), F.lit(False)).alias("seed")))


def _places(texts: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """(left, places): how often two words in a row are a pattern and have a word after them."""
    pairs = texts.select(F.expr(r"split(lower(__text), r'\s+')").alias("w"))
    pairs = pairs.select(F.explode(F.expr("zip_with(slice(w, 1, greatest(size(w) - 2, 0)), slice(w, 2, greatest(size(w) - 2, 0)), (a, b) -> concat(a, ' ', b))")).alias("left"))
    wanted = F.broadcast(patterns.select("left")) if n <= BROADCAST_PATTERNS else patterns.select("left")
    return pairs.join(wanted, "left", "left_semi").groupBy("left").agg(F.count(F.lit(1)).alias("places"))


def _with_room(work: Scratch, able: DataFrame, texts: DataFrame, n: int, confidence: float) -> DataFrame:
    """(left, room): of the candidates (left, kinds, hits) those that can reach the confidence. ``room`` is all their places, in the unit of different instances."""
    # how often the words of a pattern stand before a token of any sort: where the texts with identifiers alone rule
    # out that it reaches the confidence, all texts need not be asked
    for part in (texts.where(F.col("__text").rlike("[0-9@]")), texts):
        if n == 0:
            break
        places = work.write(_places(part, able, n), "places")
        room = F.col("kinds") / F.col("hits") * F.greatest(F.coalesce("places", "hits"), "hits")
        able = work.write(able.drop("room").join(places, "left", "left").withColumn("room", room).drop("places").where(F.col("kinds") >= confidence * (F.col("room") + 1)), "able")
        n = able.count()
    return able.select("left", F.lit(None).cast("double").alias("room")) if n == 0 else able.select("left", "room")


def learn_patterns(work: Scratch, occurrences: DataFrame, texts: DataFrame, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS, confidence: float = CONFIDENCE) -> DataFrame:
    """(left, score): patterns with enough believed instances, scored over the graph of patterns and instances, which grows from round to round."""
    edges = work.write(occurrences.groupBy("left", "core").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "edges")
    able = edges.groupBy("left").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("hits"))
    able = work.write(able.where(F.col("kinds") >= min_seeds), "patterns")
    graph = work.write(edges.join(able.select("left"), "left", "left_semi"), "able-edges")
    belief = edges.where("seed").select("core", F.lit(1.0).alias("belief")).distinct()
    known, tried, score = None, able.select("left").limit(0), able.select("left", F.lit(0.0).alias("score")).limit(0)
    for _ in range(rounds):
        sure = belief.where(F.col("belief") >= confidence).select("core")
        enough = graph.join(sure, "core", "left_semi").groupBy("left").agg(F.count(F.lit(1)).alias("sure")).where(F.col("sure") >= min_seeds).select("left")
        new = work.write(able.join(enough, "left", "left_semi").join(tried, "left", "left_anti"), "candidates")
        n = new.count()
        if n == 0 and known is None:
            return score
        if n:
            tried = work.write(tried.unionByName(new.select("left")), "tried")
            size = _with_room(work, new, texts, n, confidence).where("room is not null")
            known = work.write(size if known is None else known.unionByName(size), "known")
        score = graph.join(known.select("left"), "left", "left_semi").join(belief, "core").groupBy("left").agg(F.sum("belief").alias("s")).join(known, "left").select("left", (F.col("s") / (F.col("room") + 1)).alias("score"))
        score = work.write(score, "scores")
        doubt = F.sum(F.log(F.lit(1.0) - F.least(F.col("score"), F.lit(0.999))))
        found = graph.join(score, "left").groupBy("core").agg(F.max("seed").alias("seed"), doubt.alias("d")).where("not seed").select("core", (1 - F.exp("d")).alias("belief"))
        seeds = edges.where("seed").select("core", F.lit(1.0).alias("belief")).distinct()
        belief = work.write(seeds.unionByName(found.join(seeds, "core", "left_anti")), "beliefs")
    return score


def annotate(spark: SparkSession, docs: DataFrame, keep: list[str], confidence: float = CONFIDENCE, min_seeds: int = MIN_SEEDS, with_text: bool = False) -> DataFrame:
    """``keep`` and base, found: arrays of (kind, start, end), in code points, end exclusive; the text (null as empty) as __text, if asked for."""
    work = Scratch(spark, "pii")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    marked = work.write(_found(rows).drop(*([] if with_text else ["__text"])), "marked")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    occurrences = work.write(_occurrences(marked), "occurrences")
    patterns = learn_patterns(work, occurrences, texts, min_seeds, confidence=confidence).where(F.col("score") >= confidence).select("left")
    new = occurrences.where(~F.col("seed")).join(patterns, "left", "left_semi")
    new = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("found"))
    new = work.write(new, "found")
    none = F.expr("cast(array() AS array<struct<kind:string,start:int,end:int>>)")
    return marked.join(new, "row", "left").select(*keep, *(["__text"] if with_text else []), "base", F.coalesce("found", none).alias("found"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(spark: SparkSession, docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """The same columns, with ``<KIND>`` in place of each span (spans that overlap are one, named by the first) and n_chars, if there, counted anew."""
    names = docs.columns
    # other columns may have any name: they are numbered on the way
    other = {c: f"c{i}" for i, c in enumerate(names) if c != "text"}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in other.items()), "text", F.col("text").isNull().alias("no_text"))
    x = annotate(spark, plain, [*other.values(), "no_text"], confidence, with_text=True)
    x = x.withColumn("__m", F.expr("array_sort(transform(concat(base, found), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"))
    # chunk by chunk of the spans: the text from where those before end; of spans that overlap the first is named
    cut = "array(substring(said, acc.at - o + 1, s.start - acc.at), concat('<', upper(s.kind), '>'))"
    fold = f"""aggregate(chunk, named_struct('at', o, 'out', cast(array() AS array<string>)),
        (acc, s) -> named_struct('at', greatest(acc.at, s.end), 'out', CASE WHEN s.start < acc.at THEN acc.out ELSE concat(acc.out, {cut}) END), acc -> acc.out)"""
    said = "substring(__text, o + 1, greatest(array_max(transform(chunk, s -> s.end)) - o, 0))"
    clean = f"flatten(zip_with(chunks, {_scan('chunks', 'x.end', 'greatest({a}, {b})')}, (chunk, o) -> {_let('said', said, fold)}))"
    rest = "substring(__text, array_max(transform(__m, s -> s.end)) + 1)"
    clean = F.expr(f"concat(array_join({_let('chunks', _chunks('__m'), clean)}, ''), {rest})")
    some = F.size("__m") > 0
    x = x.withColumn("text", F.when(some, clean).when(~F.col("no_text"), F.col("__text")))
    if "n_chars" in names:
        n = F.col(other["n_chars"])
        x = x.withColumn(other["n_chars"], F.when(some, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(n))
    return x.select(*(F.col(other.get(c, c)).alias(c) for c in names))


def find(spark: SparkSession, docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    x = annotate(spark, docs.select("doc_id", "text"), ["doc_id"], confidence)
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "found")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
