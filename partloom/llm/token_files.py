"""Token ids in Arrow files of fixed-size-list batches.

Layout.  A file holds the ids of a range of documents, in order, cut in sequences of ``seq_len``.  Its record batches have two
columns: ``tokens``, a fixed-size list of unsigned 16- or 32-bit ids, and ``mask``, a fixed-size list of booleans that is false only on the padding
behind the last id.  All batches but the last have ``BATCH_ROWS`` sequences, so sequence i lies in batch i // BATCH_ROWS: with the file mapped into memory a sequence
is a view, without copying.  Beside each file lies an index (document, first id, number of ids), in batches too.  A file ends with the document that fills ``FILE_BYTES`` of ids, so files don't grow with the data.

Writing.  Texts become ids before the one shuffle, which carries binary ids to the file of their document range, sorted by id within it.  The ranges'
edges come from a sample of the distinct ids by hash (``EDGE_SAMPLE`` expected at any size of table); they shape tasks only, each of which writes the files of its range.  A file is written under a task's own name and then
renamed, so that a task run again leaves one complete file.
"""

from __future__ import annotations

import bisect
import itertools
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import local_copy, new_folder, settle, shuffle_partitions, text_of, tokenizer_path

SEQ_LEN = 1024
BATCH_ROWS = 256
FILE_BYTES = 64 << 20
INDEX_ROWS = 65_536
EDGE_SAMPLE = 20_000
WORD_TABLE = 2_000_000


class WordEncoder:
    """ids of whole texts as bytes. White space splits words for this tokenizer whatever stands around it, and ASCII letters are lowered before anything looks at them, so
    each distinct lower-case word is encoded once by the library and kept in a table of bounded size.  A text that holds the string of an added token, which the library looks for first, goes to the library whole.  Marks at a word's end behind an ASCII letter or digit are a
    piece of their own, so the word without them and the marks are looked up apart."""

    MARKS = b".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.path, self.library = path, None
        self.tokenizer = Tokenizer.from_file(local_copy(path))
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # for words: lower-casing may make such a token's string of one that isn't
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.table: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        table, marks, whole, parts = self.table, self.MARKS, {}, []
        for w in words:
            if w not in table:
                core = w.rstrip(marks)
                if len(core) < len(w) and core[-1:].isalnum():
                    parts.append((w, core, w[len(core) :]))
                    whole[core] = whole[w[len(core) :]] = None
                else:
                    whole[w] = None
        new = [w for w in whole if w not in table]
        for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            table[w] = array(self.code, e.ids).tobytes()
        for w, core, end in parts:
            table[w] = table[core] + table[end]

    def _by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(local_copy(self.path))
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian."""
        table = self.table
        if len(table) > WORD_TABLE:
            table.clear()
        whole = {i: self._by_library(t) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        split = [() if i in whole else t.encode().lower().split() for i, t in enumerate(texts)]
        new: dict[bytes, None] = {}
        for words in split:
            new.update(dict.fromkeys(w for w in words if w not in table))
        if new:
            self._learn(list(new))
        return [whole[i] if i in whole else b"".join(map(table.__getitem__, words)) for i, words in enumerate(split)]

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _schemas(kind: np.dtype, seq_len: int, id_type: pa.DataType) -> tuple[pa.Schema, pa.Schema]:
    data = pa.schema([("tokens", pa.list_(pa.uint16() if kind.itemsize == 2 else pa.uint32(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
    return data, pa.schema([("doc_id", id_type), ("first", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """One file and its index, streamed: a batch leaves as soon as it is full."""

    def __init__(self, folder: str, name: str, kind: np.dtype, seq_len: int, id_type: pa.DataType):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.own = f"{base}/tokens-{name}", f"{base}/.{uuid.uuid4().hex}"
        self.kind, self.seq_len = kind, seq_len
        self.data, self.index = _schemas(kind, seq_len, id_type)
        self.sink = self.fs.open_output_stream(f"{self.own}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.data)
        self.index_sink = self.fs.open_output_stream(f"{self.own}.index")
        self.index_out = pa.ipc.new_file(self.index_sink, self.index)
        self.waiting, self.n_waiting, self.total, self.docs, self.rows = [], 0, 0, 0, ([], [], [])

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        for column, v in zip(self.rows, (doc, self.total, n), strict=True):
            column.append(v)
        self.total += n
        self.docs += 1
        if len(self.rows[0]) == INDEX_ROWS:
            self._flush_index()
        self.waiting.append(ids)
        self.n_waiting += n
        if self.n_waiting >= BATCH_ROWS * self.seq_len:
            self._flush(False)

    def _flush_index(self) -> None:
        self.index_out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.rows, self.index, strict=True)], schema=self.index))
        self.rows = ([], [], [])

    def full(self, most: int) -> bool:
        return self.total * self.kind.itemsize >= most

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.waiting), self.kind)
        size, at = BATCH_ROWS * self.seq_len, 0
        while len(flat) - at >= size:
            self._batch(flat[at : at + size], size)
            at += size
        if last and len(flat) > at:
            n = len(flat) - at
            padded = np.zeros(-(-n // self.seq_len) * self.seq_len, self.kind)
            padded[:n] = flat[at:]
            self._batch(padded, n)
            at = len(flat)
        self.waiting, self.n_waiting = [flat[at:].tobytes()], len(flat) - at

    def _batch(self, flat: np.ndarray, n: int) -> None:
        mask = np.arange(len(flat)) < n
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.data))

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self.out.close(), self.sink.close()
        self._flush_index()
        self.index_out.close(), self.index_sink.close()
        for end in ("arrow", "index"):
            self.fs.move(f"{self.own}.{end}", f"{self.final}.{end}")
        return self.final, self.total, self.docs


def write_token_files(
    docs: DataFrame, folder: str | None = None, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, seq_len: int = SEQ_LEN, files: int | None = None, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the ids of all texts, ``end_id`` after each, in ascending order of id (nulls first; rows that repeat an id in the order of
    their ids of tokens), and return the manifest: file (ascending in that order), path, first (ids of all files before), n_tokens, n_docs.

    Null text counts as empty: the end id alone. An empty table gives no file. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    path, files = path or tokenizer_path("word_bpe_49k.json"), files or shuffle_partitions(spark)
    kind = dict(docs.dtypes)[id_col]
    share = min(1.0, EDGE_SAMPLE / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    ids = sorted(r[0] for r in docs.select(docs[id_col].alias("id")).where(F.col("id").isNotNull() & chosen).distinct().collect())
    edges = sorted({ids[len(ids) * i // files] for i in range(1, files)}) if ids else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            places = [0 if i is None else bisect.bisect_right(edges, i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), batch.column(0), pa.array([ids + end for lo in range(0, batch.num_rows, 256) for ids in encoder.batch(batch.column(1).slice(lo, 256).to_pylist())], pa.binary())], ["file", "id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t")).mapInArrow(encode, f"file int, id {kind}, ids binary")
    rows = rows.repartition(files, "file").sortWithinPartitions("file", F.col("id").asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, made = None, None, []  # at: range and number of the open file in it
        kind = _encoder(path).kind

        def close() -> None:
            if out:
                made.append((at[0] << 32 | at[1], *out.close()))

        for batch in batches:
            for place, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or place != at[0] or out.full(file_bytes):
                    close()
                    at = (place, at[1] + 1 if at and place == at[0] else 0)
                    out = _Writer(folder, f"{at[0]:06d}-{at[1]:06d}", kind, seq_len, batch.schema.field("id").type)
                out.add(doc, ids)
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "path", "n_tokens", "n_docs"])

    manifest = settle(rows.mapInArrow(write, "file long, path string, n_tokens long, n_docs long"))
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.select("file", F.concat(F.lit(scheme), "path").alias("path"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("first"), "n_tokens", "n_docs")


class TokenFile:
    """Random access to one file: sequences, masks and documents as views on the mapped file (or on the batches read, from a remote store)."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        name = name.removesuffix(".arrow")
        opened = (lambda x: pa.memory_map(x)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.data = pa.ipc.open_file(opened(f"{name}.arrow"))
        self._index = pa.ipc.open_file(opened(f"{name}.index"))
        self.width = self.data.schema.field("tokens").type.list_size
        self._at, self._flat = -1, None

    @property
    def index(self) -> pa.Table:
        return self._index.read_all()

    def index_batches(self) -> Iterator[pa.RecordBatch]:
        """doc_id, first, n_tokens of the documents, in order."""
        return (self._index.get_batch(i) for i in range(self._index.num_record_batches))

    def __len__(self) -> int:
        n = self.data.num_record_batches
        return (n - 1) * BATCH_ROWS + self.data.get_batch(n - 1).num_rows if n else 0

    def _batch(self, i: int) -> np.ndarray:
        """The ids of batch i, padding included, as a view; the last one asked for is kept."""
        if i != self._at:
            self._at, self._flat = i, self.data.get_batch(i).column(0).values.to_numpy(zero_copy_only=True)
        return self._flat

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(tokens, mask) of sequence i; tokens is a view."""
        batch, row = i // BATCH_ROWS, i % BATCH_ROWS
        return self._batch(batch)[row * self.width : (row + 1) * self.width], self.data.get_batch(batch).column(1).values.slice(row * self.width, self.width)

    def views(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids start to start + n - 1, in views of a batch each."""
        per = BATCH_ROWS * self.width
        while n > 0:
            part = self._batch(start // per)[start % per : start % per + n]
            yield part
            start, n = start + len(part), n - len(part)

    def ids(self) -> np.ndarray:
        """All ids without padding, copied together."""
        parts = list(self.views(0, sum(self.index.column("n_tokens").to_pylist())))
        return np.concatenate(parts) if parts else np.empty(0, np.uint16)


def _crc(views: Iterator[np.ndarray]) -> int:
    out = 0
    for x in views:
        out = zlib.crc32(x.astype("<u4").tobytes(), out)
    return out


#: Ids that a batch of the reader holds at most beyond its last document, where ids are asked for.
READ_IDS = 1 << 20


def read_token_files(manifest: DataFrame, id_type: str = "long", *, digests: bool = True) -> DataFrame:
    """One row per document, read from the files, batch by batch: doc_id, start (ids of all documents before it), n_tokens, and ids_crc32 (of the ids as little-endian 32-bit integers) or, without ``digests``, ids."""
    last = "ids_crc32 long" if digests else "ids array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                for index in file.index_batches():
                    starts, sizes = index.column("first").to_numpy(), index.column("n_tokens").to_numpy()
                    cuts = [0, len(sizes)]
                    if not digests and len(sizes):
                        cuts = [*np.unique(np.cumsum(sizes) // READ_IDS, return_index=True)[1].tolist(), len(sizes)]
                    for lo, hi in itertools.pairwise(sorted({0, *cuts})):
                        docs = [file.views(s, n) for s, n in zip(starts[lo:hi].tolist(), sizes[lo:hi].tolist(), strict=True)]
                        values = pa.array(map(_crc, docs), pa.int64()) if digests else pa.array([np.concatenate([x.astype(np.int32) for x in d] or [np.empty(0, np.int32)]) for d in docs], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([index.column("doc_id").slice(lo, hi - lo), pa.array(starts[lo:hi] + first, pa.int64()), pa.array(sizes[lo:hi], pa.int64()), values], ["doc_id", "start", "n_tokens", last.split()[0]])

    files = manifest.select("path", "first").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return files.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, {last}")


def write_and_read(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **options) -> DataFrame:
    """Write the files and give what reading them back gives."""
    manifest = write_token_files(docs, None, path, id_col=id_col, text_col=text_col, **options)
    return read_token_files(settle(manifest), dict(docs.dtypes)[id_col]).withColumnRenamed("doc_id", id_col)
