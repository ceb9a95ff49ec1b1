"""Token ids as Arrow files of equal-length sequences.

A *dataset* is a table of files in order. Each file is an Arrow IPC file whose record batches hold BATCH sequences each (the last
one fewer): ``ids``, a fixed-size list of ``seq_len`` unsigned integers (16 bits if the vocabulary fits, else 32), and ``mask``, a
fixed-size list of booleans, false only where the end of a file is padded. Sequence i is row i % BATCH of batch i // BATCH, so a mapped file gives
any sequence and mask without copying. A second file beside it holds doc_id, first token and number of tokens of each of its documents; documents
do not cross files.

Writing is one range exchange of the texts by doc_id (copies of an id are told apart by a hash of the text, so that a hot id is
split), and each task tokenizes its range in order and streams its sequences to files of at least FILE_SEQUENCES. Prefix sums over
the files, one row each, place them. A task that is tried again writes files of new names; only those in the committed table of files are read.

Reading back maps the files, deals them over tasks and follows the documents.

Null text counts as empty; an empty document is its end id alone. Null doc_ids come first. Repeated rows are written as often as they
occur. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.scratch import Scratch

SEQ_LEN, BATCH, END_ID = 2048, 64, 2
TOKENIZER = "word_bpe_49k.json"
#: Sequences after which a file is closed at the end of a document.
FILE_SEQUENCES = 32_768
#: Chunks, and pieces of them, whose ids a worker remembers (about 200 bytes each, and as many older ones), the longest of them, and how many
#: new pieces are encoded in one call.
REMEMBERED, LONGEST, AT_ONCE = 300_000, 64, 1000
#: The splitter of the files whose texts are encoded by chunks (fixed value), and the same for plain text in lower case.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|\n|[^\n0-9{_LETTERS}]+")
#: Bytes of text that are encoded together, and tasks that read files at most.
ENCODED, READERS = 16 << 20, 20_000
FILES = "part int, nth int, file string, n_docs long, n_tokens long, n_sequences long"


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered:
    """Bytes of ids by key, of the ``most`` keys that came last and as many before them, as far as these are not met again."""

    def __init__(self, most: int):
        self.most, self.now, self.older = most, {}, {}

    def unknown(self, keys: set) -> list:
        """Those that must be found; the others are in ``now`` from here on."""
        if len(self.now) > self.most:
            self.now, self.older = {}, self.now
        keys = keys.difference(self.now)
        again = keys.intersection(self.older)
        self.now.update(zip(again, map(self.older.__getitem__, again), strict=True))
        return list(keys - again)


class Encoder:
    """Whole texts to ids by the tokenizers library, as ``encode(text, add_special_tokens=False)`` gives them.

    Where the file has the splitter and normalizers named here, which drop white space and do not look across it, a text's ids are
    those of its chunks between ASCII white space, one after another, and chunks are remembered. Chunks of plain letters (in composed
    form, each lower-cased on its own), digits and punctuation are split here and their pieces encoded many at a time by the model of the file; others go to ``encode``. Any
    other file encodes whole texts.
    """

    #: Texts on which both ways must agree before chunks are used.
    PROBES = ("", " \n", "It's  a\n\n test\t of 1234 words!? ", "çà été \u2003\u3000漢字 🙂 a\r\n b\u0301 \u0301c", "x\0y ΑΣ Σ <|endoftext|>a", "'S don't 'llama 1'2 ÀÉ's. --x")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() < 1 << 16 else "<u4")
        # the same model for pieces between blanks, which are in lower case and split as they should be
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([str(self.tok.id_to_token(i)).endswith("</w>") for i in range(self.tok.get_vocab_size())])
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known, self.pieces = Remembered(REMEMBERED), Remembered(REMEMBERED // 4)
        self.chunked = sys.byteorder == "little" and self._splits(path) and self._by_chunks(pa.array(self.PROBES)) == self._whole(list(self.PROBES))

    @staticmethod
    def _splits(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
        normal = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
        added = [t["content"] for t in told.get("added_tokens", [])]
        return (
            [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": SPLITTER}
            and (steps[0]["behavior"], steps[0]["invert"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("Removed", True, False, False)
            and normal == ["NFC", "Replace", "Lowercase"]
            and told["model"].get("end_of_word_suffix") == "</w>"
            and all(t.startswith("<|") and len(t.split()) == 1 for t in added)
        )

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _find_pieces(self, pieces: set[str]) -> list[str]:
        """Pieces that the splitter leaves, in lower case; the last token of each ends a word."""
        new, width = self.pieces.unknown(pieces), self.dtype.itemsize
        for lo in range(0, len(new), AT_ONCE):
            part = new[lo : lo + AT_ONCE]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            data = ids.tobytes()
            self.pieces.now.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        return new

    def _find_chunks(self, chunks: list[bytes]) -> list[str]:
        plain = []
        for chunk in chunks:
            text = chunk.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                plain.append((chunk, text))
            else:
                self.known.now[chunk] = array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = _SPLIT.findall("\n".join([t for _, t in plain]).lower())
        new = self._find_pieces(set(pieces) - {"\n"})
        found = self.pieces.now
        found["\n"] = b"\xff" * self.dtype.itemsize  # no id: a border
        joined = b"".join(map(found.__getitem__, pieces))
        cuts = (np.flatnonzero(np.frombuffer(joined, self.dtype) == np.iinfo(self.dtype).max) * self.dtype.itemsize).tolist()
        for (chunk, _), start, stop in zip(plain, [0, *(c + self.dtype.itemsize for c in cuts)], [*cuts, len(joined)], strict=False):
            self.known.now[chunk] = joined[start:stop]
        return new

    def _by_chunks(self, texts: pa.Array) -> list[bytes]:
        chunks = pc.ascii_split_whitespace(texts.cast(pa.string()))
        words = chunks.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        unknown = self.known.unknown(set(distinct))
        new_pieces = self._find_chunks(unknown)
        known = self.known.now
        ids = pa.array(list(map(known.__getitem__, distinct)), pa.binary()).take(words.indices)
        for kept, keys in ((known, unknown), (self.pieces.now, new_pieces)):
            for key in keys:
                if len(key) > LONGEST:
                    del kept[key]
        # offsets of words, then of texts, in the bytes of all ids
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        cuts = at[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()].tolist()
        data = ids.buffers()[2].to_pybytes() if len(ids) and ids.buffers()[2] else b""
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Of strings without nulls."""
        return self._by_chunks(texts) if self.chunked else self._whole(texts.to_pylist())


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each worker: what it remembers serves the tasks after this one too."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(tokenizer_path(name))
    return _ENCODERS[name]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _lists(values: pa.Array, seq_len: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(values, seq_len)


class SequenceFile:
    """Writes one file of sequences and the file of its documents."""

    def __init__(self, root: str, seq_len: int, dtype: np.dtype):
        fs, base = _filesystem(root)
        fs.create_dir(base, recursive=True)
        self.name, self.seq_len, self.dtype = uuid.uuid4().hex, seq_len, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))], metadata={"seq_len": str(seq_len), "batch": str(BATCH)})
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = [fs.open_output_stream(f"{base}/{self.name}.{x}", compression=None) for x in ("arrow", "docs.arrow")]
        self.writers = [pa.ipc.new_file(o, s) for o, s in zip(self.out, (self.schema, self.index), strict=True)]
        self.held, self.held_bytes, self.docs, self.n_docs, self.n_tokens, self.n_sequences = [], 0, [], 0, 0, 0

    def _write(self, data: bytes, real: int) -> None:
        ids = pa.Array.from_buffers(pa.from_numpy_dtype(self.dtype), len(data) // self.dtype.itemsize, [None, pa.py_buffer(data)])
        mask = pa.array(np.arange(len(ids)) < real)
        batch = pa.RecordBatch.from_arrays([_lists(ids, self.seq_len), _lists(mask, self.seq_len)], schema=self.schema)
        self.writers[0].write_batch(batch)
        self.n_sequences += batch.num_rows

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.n_tokens, n))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + n
        self.held.append(ids)
        self.held_bytes += len(ids)
        size = BATCH * self.seq_len * self.dtype.itemsize
        if self.held_bytes >= size:
            whole = b"".join(self.held)
            full = len(whole) // size * size
            for at in range(0, full, size):
                self._write(whole[at : at + size], BATCH * self.seq_len)
            self.held, self.held_bytes = [whole[full:]], len(whole) - full
        if len(self.docs) >= 10_000:
            self._list()

    def _list(self) -> None:
        if self.docs:
            self.writers[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=self.index))
            self.docs = []

    def close(self) -> None:
        if rest := b"".join(self.held):
            one = self.seq_len * self.dtype.itemsize
            self._write(rest + b"\0" * (-len(rest) % one), len(rest) // self.dtype.itemsize)
        self._list()
        for x in (*self.writers, *self.out):
            x.close()


class SequenceReader:
    """Sequences, masks and documents of one file; a file of a local filesystem is mapped, so nothing is copied."""

    def __init__(self, root: str, name: str):
        fs, base = _filesystem(root)
        opened = [pa.memory_map(p) if fs.type_name == "local" else fs.open_input_file(p) for p in (f"{base}/{name}.arrow", f"{base}/{name}.docs.arrow")]
        self.file, self.docs = map(pa.ipc.open_file, opened)
        told = self.file.schema.metadata
        self.seq_len, self.batch = int(told[b"seq_len"]), int(told[b"batch"])
        self._at, self._held = -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self._at:
            self._at, self._held = i, self.file.get_batch(i)
        return self._held

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``, as views."""
        batch, row = self._batch(i // self.batch), i % self.batch
        ids, mask = (batch.column(c).values.slice((batch.column(c).offset + row) * self.seq_len, self.seq_len) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Tokens [start, start + n) of the file, in views of one batch each."""
        size, stop = self.batch * self.seq_len, start + n
        while start < stop:
            column = self._batch(start // size).column(0)
            low, high = start % size, min(size, start % size + stop - start)
            yield column.values.slice(column.offset * self.seq_len + low, high - low).to_numpy(zero_copy_only=True)
            start += high - low

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for i in range(self.docs.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.docs.get_batch(i).columns), strict=True)


def _write(root: str, seq_len: int, tokenizer: str, end_id: int, file_sequences: int):
    names = [x.split()[0] for x in FILES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end, part, nth, out = np.array([end_id], enc.dtype).tobytes(), TaskContext.get().partitionId(), 0, None

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([out.name]), *(pa.array([x]) for x in (out.n_docs, out.n_tokens, out.n_sequences))], names)

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(keys):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + ENCODED, "right")))
                for key, ids in zip(keys[lo:hi], enc.batch(texts.slice(lo, hi - lo)), strict=True):
                    out = out or SequenceFile(root, seq_len, enc.dtype)
                    out.add(key, ids + end)
                    if out.n_tokens >= file_sequences * seq_len:
                        yield done()
                        nth, out = nth + 1, None
                lo = hi
        if out:
            yield done()

    return run


def _read_back(root: str):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader, rows = SequenceReader(root, name), []
                for doc_id, start, n in reader.documents():
                    crc = 0
                    for piece in reader.tokens(start, n):
                        crc = zlib.crc32(piece.astype("<u4"), crc)
                    rows.append((doc_id, base + start, n, crc))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


class SequenceDataset:
    """``docs`` (doc_id, text) written in ascending doc_id order. ``files``: part, nth, file, n_docs, n_tokens, n_sequences, base (tokens of all files before)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str = TOKENIZER, end_id: int = END_ID, file_sequences: int = FILE_SEQUENCES):
        self.spark, self.work = spark, Scratch(spark, "sequences")
        self.root = self.work.path("files")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
        ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        written = self.work.write(ranged.mapInArrow(_write(self.root, seq_len, tokenizer, end_id, file_sequences), FILES), "written")
        before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
        self.files = self.work.write(written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "files")

    def read_back(self) -> DataFrame:
        """Every document of every file: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
        tasks = max(1, min(READERS, self.files.count()))
        dealt = self.files.withColumn("to", F.row_number().over(Window.orderBy("part", "nth")) % tasks).repartitionById(tasks, "to")
        return dealt.select("file", "base").mapInArrow(_read_back(self.root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SequenceDataset(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).read_back()
