"""Packing: concatenate and cut.

Pass one tokenizes each whole document and adds the end id. A *segment* is a run of consecutive rows
of one input split; every document gets the number of tokens before it in its segment. The token
totals of the segments, in file order, are summed up to give each segment its global offset.
Pass two adds both numbers: document tokens [g, g + n) of one endless stream, which is cut every
``seq_len`` tokens. A document that crosses a cut becomes several pieces; the piece rows are the
boundary records. Nothing is shuffled but one row per segment, and no text is tokenized twice.

Null text counts as empty; an empty document is its end id alone. Repeated rows are packed as often
as they occur. An empty table gives no rows. Extra columns of the input are ignored. Documents keep
the order of the input files, so a preceding stage can decide it. Only the last sequence can be
short; it is padded to ``seq_len`` unless its length is a power of two (``padded_length``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.scratch import Scratch

SEQ_LEN = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
#: Up to so many segments their offsets (about 100 bytes each) are broadcast; beyond, they are joined by key.
BROADCAST_SEGMENTS = 200_000
#: The split before the merges that byte-level tokenizers files of this family use (fixed value).
PRE_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts on which both engines must agree before the faster one is used.
PROBES = ["", " ", "It's  a\n\n test\t of 1234 words, isn't it?  ", "çà été\u00a0\u3000漢字 🙂 a\r\n  b", "< |endoftext|> x" + "ab" * 300]


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to little-endian 32-bit ids, by the given tokenizers file.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, with the file as it is. Where it
    is a plain byte-level BPE whose ids follow the order of its merges, the same vocabulary runs in the
    faster engine (checked on probes in each worker) for texts without a string of an added token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tok = Tokenizer.from_file(path)
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters, special = _byte_letters(), {t["content"] for t in model.get("added_tokens", [])}
        self.added = sorted(special)
        try:
            ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
            fast = tiktoken.Encoding("file", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})
            same = all(fast.encode_ordinary(t) == self.tok.encode(t, add_special_tokens=False).ids for t in PROBES)
        except (KeyError, ValueError):  # no byte-level vocabulary, or holes in its ids
            return None
        return fast if same else None

    def batch(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        if self.fast:
            ids = [self.tok.encode(t, add_special_tokens=False).ids if any(a in t for a in self.added) else self.fast.encode_ordinary(t) for t in texts]
        else:
            ids = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        return [np.array(x, dtype="<u4").tobytes() for x in ids]


def _tokenize(tokenizer: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer)
        file, expected, start, at = None, None, 0, 0
        for batch in batches:
            files, rows = batch.column("__file").to_pylist(), batch.column("__row").to_pylist()
            keys = batch.column("doc_id")
            texts = batch.column("text")
            lo = 0
            while lo < len(files):
                hi, size, part = lo, 0, []
                while hi < len(files) and size < 1_000_000 and hi - lo < 1000:
                    part.append(texts[hi].as_py() or "")
                    size += len(part[-1])
                    hi += 1
                ids = [x + end for x in enc.batch(part)]
                seg_row, before, n = [], [], []
                for f, r, x in zip(files[lo:hi], rows[lo:hi], ids, strict=True):
                    if f != file or r != expected:
                        file, start, at = f, r, 0
                    expected = r + 1
                    seg_row.append(start)
                    before.append(at)
                    n.append(len(x) // 4)
                    at += n[-1]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array(files[lo:hi], pa.string()), pa.array(seg_row, pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "seg_file", "seg_row", "before", "doc_tokens", "ids"],
                )
                lo = hi

    return run


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and the place of the row in the input: file and row, or partition and row."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        return docs.select(*cols, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").cast("long").alias("__row"))
    except AnalysisException:  # not read from files
        return docs.select(*cols, F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("__file"), F.monotonically_increasing_id().alias("__row"))


def pack(spark: SparkSession, docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (and the ids, if asked for)."""
    work = Scratch(spark, "pack")
    schema = "doc_id long, seg_file string, seg_row long, before long, doc_tokens long, ids binary"
    tokens = work.write(_in_order(docs).mapInArrow(_tokenize(tokenizer, end_id), schema), "tokens")
    totals = tokens.groupBy("seg_file", "seg_row").agg(F.sum("doc_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    running = Window.orderBy("seg_file", "seg_row").rowsBetween(Window.unboundedPreceding, -1)
    offsets = work.write(totals.withColumn("base", F.coalesce(F.sum("n").over(running), F.lit(0))), "offsets")
    sized = offsets.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    where = offsets.select("seg_file", "seg_row", "base")
    if sized["segments"] <= BROADCAST_SEGMENTS:
        where = F.broadcast(where)
    return _cut(tokens.join(where, ["seg_file", "seg_row"]), seq_len, sized["total"], with_ids)


def _cut(placed: DataFrame, seq_len: int, total: int, with_ids: bool) -> DataFrame:
    size = F.lit(seq_len).cast("long")
    g = F.col("base") + F.col("before")
    first, last = F.expr(f"(base + before) div {seq_len}"), F.expr(f"(base + before + doc_tokens - 1) div {seq_len}")

    def piece(s):
        begin = F.greatest(s * size - g, F.lit(0).cast("long"))
        stop = F.least((s + 1) * size - g, F.col("doc_tokens"))
        part = F.substring(F.col("ids"), (begin * 4 + 1).cast("int"), ((stop - begin) * 4).cast("int"))
        fields = [begin.alias("start"), (stop - begin).alias("length"), F.crc32(part).alias("ids_crc32"), s.alias("sequence_id"), (g + begin - s * size).alias("offset")]
        return F.struct(*fields, *([part.alias("piece_ids")] if with_ids else []))

    pieces = placed.select("doc_id", "doc_tokens", F.transform(F.sequence(first, last), piece).alias("pieces"))
    rows = pieces.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")).select("doc_id", "p.*", "doc_tokens")
    fill = F.least(F.lit(total).cast("long") - F.col("sequence_id") * size, size)
    power = fill.bitwiseAND(fill - 1) == 0
    out = rows.withColumn("padded_length", F.when(power, fill).otherwise(size))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
    return out.select(*names, *(["piece_ids"] if with_ids else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
