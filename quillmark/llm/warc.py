"""WARC archives and a capture index that is merged externally.

Writing: every page becomes a WARC/1.1 record in a gzip member of its own; a task starts a new archive when
one reaches ROLL_BYTES. Among records with equal payloads of at least MIN_REVISIT bytes the one of least page_id is
a response, the others are revisits without a body that refer to it; shorter payloads are always responses.
Each task also sorts the captures it wrote by URL key and timestamp, run by run of at most RUN_ROWS, and writes every
run as an index file, cut at the boundaries of key ranges.

Merging: a task opens its range's slice of every run and merges them with a loser tree: one comparison per level
for a row, and one buffered piece per run in memory. Where a range has more than FAN_IN slices, they are merged in passes:
FAN_IN at a time become a longer run, until one merge is left, so open files and buffers are bounded. Ranges are bounded by keys of a bounded sample, with timestamp
and page_id as part of the key, so one URL with a third of all captures is still spread over many ranges. The
merged ranges in order are the globally ordered capture histories; ``capture`` numbers the captures of a URL key.

Files go to the shared folder through pyarrow's filesystems. A task that is tried again writes files of new
names, and only those named in the committed table of captures are ever read. Reading back goes through the
archives, dealt over as many tasks as there are archives (READERS at most), record by record, and checks each payload's
digest.

A null html is an empty payload, a null url an empty key. Rows with a null page_id are not written. Repeated rows
are captures of their own; rows that share the least page_id of their payload are all responses. Empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.scratch import Scratch

MIN_REVISIT = 100
ROLL_BYTES, RUN_ROWS = 64 << 20, 100_000
#: Keys that the range boundaries are taken from at most, and captures of a range about.
SAMPLE_KEYS, RANGE_ROWS = 10_000, 50_000
#: Runs that are merged at once, and bytes that are read of each at a time.
FAN_IN, PIECE = 256, 1 << 16
#: Tasks that read archives at most.
READERS = 20_000
#: Captures have no time of their own in the table: they are dated one second apart by page_id (fixed value: 2020-01-01).
EPOCH, DATED = 1_577_836_800, 1_000_000_000
CAPTURE = "page_id long, url_key string, ts long, archive string, offset long, size long, record_type string"


def url_key(url: str) -> str:
    """Host labels reversed, then port, path and query, lower-cased; scheme, ``www`` and fragment do not matter."""
    try:
        u = urlsplit(url if "//" in url else "//" + url)
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.lower()
    labels = host.lower().split(".")
    if labels[0] in ("www", "m") and len(labels) > 2:
        labels = labels[1:]
    tail = (u.path or "/") + ("?" + u.query if u.query else "")
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + tail.lower()


def stamp(ts: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(ts, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, ts: int) -> bytes:
    """One gzip member."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {stamp(ts)}",
        f"WARC-Target-URI: {''.join(c if c > ' ' else '%%%02X' % ord(c) for c in url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Bytes: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of an archive, with one record in memory."""
    with gzip.open(stream, "rb") as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                name, _, value = line.decode().partition(": ")
                head[name.lower()] = value
            body = f.read(int(head["content-length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("record is cut short")
            yield head, body


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class LoserTree:
    """Merges sorted iterators: the tree holds the losers of the last matches, so the next row costs one match per level."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = k = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * k
        for i in range(k):
            self._play(i)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (row := self.head[w := self.tree[0]]) is not None:
            yield row
            self.head[w] = next(self.runs[w], None)
            node, winner = (w + self.k) // 2, w
            while node > 0:
                other = self.tree[node]
                if self._less(other, winner):
                    self.tree[node], winner = winner, other
                node //= 2
            self.tree[0] = winner


def _write(root: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        names = [x.split()[0] for x in CAPTURE.split(", ")]
        for batch in batches:
            rows = []
            for page, url, html, digest, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page, url, refers = page.as_py(), url.as_py() or "", refers.as_py()
                if out is None or at > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page, url, (html.as_py() or "").encode("utf-8", "surrogatepass"), digest.as_py(), refers, EPOCH + page % DATED)
                out.write(data)
                rows.append((page, url_key(url), EPOCH + page % DATED, name, at, len(data), "revisit" if refers is not None else "response"))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)
        if out is not None:
            out.close()

    return run


def _line(key: tuple, rest: tuple) -> bytes:
    import json

    return (json.dumps([*key, *rest], ensure_ascii=True) + "\n").encode()


def _sort_runs(root: str, bounds) -> Callable:
    """Captures to sorted index files; one row for every slice of a run: range, file, start, end."""
    from bisect import bisect_right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        edges = bounds.value
        held: list[tuple] = []

        def flush():
            held.sort()
            name, at, slices = f"{uuid.uuid4().hex}.cdx", 0, {}
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                for key, rest in held:
                    line = _line(key, rest)
                    r = bisect_right(edges, key)
                    start = slices.get(r, (at, at))[0]
                    f.write(line)
                    at += len(line)
                    slices[r] = (start, at)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array([name] * len(slices)), pa.array([s for s, _ in slices.values()]), pa.array([e for _, e in slices.values()])], ["range", "file", "start", "stop"])

        for batch in batches:
            for r in batch.to_pylist():
                held.append(((r["url_key"], r["ts"], r["page_id"]), (r["archive"], r["offset"], r["size"], r["record_type"])))
                if len(held) >= RUN_ROWS:
                    yield flush()
        if held:
            yield flush()

    return run


def _slice(fs, path: str, start: int, stop: int) -> Iterator[tuple]:
    import json

    with fs.open_input_file(path) as f:
        f.seek(start)
        rest, left = b"", stop - start
        while left:
            chunk = f.read(min(left, PIECE))
            left -= len(chunk)
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                yield tuple(json.loads(line))


def _in_passes(fs, base: str, slices: list[tuple[str, int, int]], fan_in: int) -> Iterator[tuple]:
    """The rows of all slices in order; runs of an earlier pass go when they have been read."""
    made: list[str] = []
    while len(slices) > fan_in:
        longer = []
        for lo in range(0, len(slices), fan_in):
            name, at = f"{uuid.uuid4().hex}.pass", 0
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                for row in LoserTree([_slice(fs, f"{base}/{x}", a, b) for x, a, b in slices[lo : lo + fan_in]]):
                    line = _line(row[:3], row[3:])
                    f.write(line)
                    at += len(line)
            longer.append((name, 0, at))
            made.append(name)
        slices = longer
    yield from LoserTree([_slice(fs, f"{base}/{x}", a, b) for x, a, b in slices])
    for name in made:
        fs.delete_file(f"{base}/{name}")


def _merge(root: str, fan_in: int) -> Callable:
    """Slices to captures in order, with the number of the range and of the row in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        slices: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                slices.setdefault(r["range"], []).append((r["file"], r["start"], r["stop"]))
        names = ["range", "pos", "url_key", "ts", "page_id", "archive", "offset", "size", "record_type"]
        for rng in sorted(slices):
            rows = []
            for pos, x in enumerate(_in_passes(fs, base, sorted(slices[rng]), fan_in)):
                rows.append((rng, pos, *x))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)

    return run


def _read_back(root: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        names = ["archive", "nth", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with fs.open_input_file(f"{base}/{name}") as f:
                    for nth, (head, body) in enumerate(read_records(f)):
                        digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"{name}: record {nth} does not have its digest")
                        refers = head.get("warc-refers-to")
                        rows.append((name, nth, int(head["warc-record-id"][10:-1]), int(head["warc-payload-bytes"]), digest, kind, int(refers[10:-1]) if refers else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)], names)

    return run


class Archive:
    """Archives, their committed captures, and the merged index of a table of pages."""

    def __init__(self, spark: SparkSession, pages: DataFrame, least: int = MIN_REVISIT):
        self.spark, self.work = spark, Scratch(spark, "warc")
        self.files = self.work.path("archives")
        html = F.coalesce(F.col("html").cast("string"), F.lit(""))
        rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
        digests = self.work.write(rows.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("n")), "digests")
        # copies are joined by sorting: their number grows with the table, so none of it is broadcast
        first = self.work.write(digests.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1"), "copied")
        revisits = digests.join(first.hint("merge"), "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
        with_digest = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
        ready = with_digest.join(revisits.hint("merge"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
        self.captures = self.work.write(ready.mapInArrow(_write(self.files), CAPTURE), "captures")
        self.work.drop(digests, first)

    def history(self) -> DataFrame:
        """All captures in the order of URL key, timestamp and page_id: range, pos, capture (from 1, of its URL key) and where the record is."""
        key = F.struct("url_key", "ts", "page_id")
        n = self.captures.count()
        ranges = max(1, -(-n // RANGE_ROWS))
        sample = [tuple(r["k"]) for r in self.captures.select(key.alias("k"), F.xxhash64("page_id", "archive", "offset").alias("o")).orderBy("o").limit(SAMPLE_KEYS).collect()]
        sample.sort()
        edges = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
        root = self.work.path("runs")
        fs, base = _filesystem(root)
        fs.create_dir(base, recursive=True)
        slices = self.work.write(self.captures.mapInArrow(_sort_runs(root, self.spark.sparkContext.broadcast(edges)), "range int, file string, start long, stop long"), "slices")
        merged = slices.repartitionById(ranges, "range").mapInArrow(_merge(root, FAN_IN), "range long, pos long, url_key string, ts long, page_id long, archive string, offset long, size long, record_type string")
        merged = self.work.write(merged, "history")
        # captures of a key before a range: the ranges are few, and a key that spans several has one row for each
        per = merged.groupBy("url_key", "range").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = self.work.write(per.select("url_key", "range", "first", before.alias("before")), "keys")
        return merged.join(per.hint("merge"), ["url_key", "range"]).withColumn("capture", F.col("before") + F.col("pos") - F.col("first") + 1).drop("before", "first")

    def read_back(self) -> DataFrame:
        """Every record of every archive: archive, nth, page_id, payload_bytes, payload_digest, record_type, refers_to."""
        names = self.work.write(self.captures.select("archive").distinct(), "archives")
        tasks = max(1, min(READERS, names.count()))
        names = names.withColumn("nth", F.row_number().over(Window.orderBy("archive")) % tasks).repartitionById(tasks, "nth").select("archive")
        return names.mapInArrow(_read_back(self.files), "archive string, nth long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record as it was read back, with its place in the merged history: url_key, ts and capture (from 1, of its key)."""
    archive = Archive(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    history = archive.history().select("page_id", "archive", "offset", "url_key", "ts", "capture")
    back = archive.read_back()
    # equal page_ids in one archive are told apart by their order in it
    w = Window.partitionBy("archive", "page_id")
    left = back.withColumn("same", F.row_number().over(w.orderBy("nth")))
    right = history.withColumn("same", F.row_number().over(w.orderBy("offset")))
    return left.join(right, ["archive", "page_id", "same"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "capture")


_HOST = "string_split(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '.')"
_TAIL = "lower(CASE WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]*[?#]?$') THEN '/' ELSE regexp_extract(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://[^/?#]*(.*)$', 1) END)"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, {_HOST} AS host, {_TAIL} AS tail FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest),
k AS (SELECT *, array_to_string(list_reverse(CASE WHEN len(host) > 2 AND host[1] IN ('www', 'm') THEN host[2:] ELSE host END), ',') || ')' || tail AS url_key, {EPOCH} + page_id % {DATED} AS ts FROM d)
SELECT k.page_id, k.payload_bytes, k.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = k.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> k.page_id THEN f.first_id END AS refers_to,
  url_key, ts, row_number() OVER (PARTITION BY url_key ORDER BY ts, k.page_id) AS capture
FROM k LEFT JOIN f USING (payload_digest)
"""
