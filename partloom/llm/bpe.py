"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut in halves down to leaves of ``leaf_chars`` characters.  The leaves are encoded, and
neighbours are joined pairwise up the tree.  An element of the monoid is ``(text span, ids)``; its product
re-encodes a window around the seam that grows to both sides until each of its ends is a *fixed point* of the
pre-tokenizer, i.e. a place between a character that isn't white space and one that is.  No alternative of the pattern can match
across such a place and no look-ahead before it sees beyond the one white-space character after it, so the pieces outside of the window
are the same in every context; each piece is encoded separately, hence the ids outside provably stay.
If a side holds no fixed point the window takes all of it, so the product is exact for every text.

Decoding is the other reduction: leaves of ids become bytes, which are concatenated pairwise up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import local_copy, text_of, tokenizer_path

LEAF_CHARS = 1024
LEAF_IDS = 512
#: White space of the pattern's \s; only these ASCII ones serve as fixed points, which is enough for the proof.
_ASCII_SPACE = frozenset(" \t\n\r\x0b\x0c")
WINDOW = 32
#: Bytes of text after which a worker hands on what it has encoded.
SLICE_BYTES = 1 << 20


class TreeCodec:
    """Encode and decode with one vocabulary. ``encode_leaf(text) -> list[int]``; ``token_bytes[id] -> bytes``."""

    def __init__(self, encode_leaf, token_bytes: list[bytes], leaf_chars: int = LEAF_CHARS):
        self.encode_leaf, self.token_bytes, self.leaf_chars = encode_leaf, token_bytes, max(2, leaf_chars)
        self.lengths = [len(t) for t in token_bytes]

    # -- encoding ---------------------------------------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.encode_leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        start, end = self._fixed_before(text, lo, mid), self._fixed_after(text, mid, hi)
        keep_left = self._count_from_end(left, len(text[start:mid].encode()))
        keep_right = self._count_from_start(right, len(text[mid:end].encode()))
        return left[:keep_left] + self.encode_leaf(text[start:end]) + right[keep_right:]

    @staticmethod
    def _fixed_before(text: str, lo: int, mid: int) -> int:
        """The last fixed point in (lo, mid), found in windows that double; lo if there is none."""
        width, top = WINDOW, mid
        while True:
            bottom = max(lo + 1, mid - width)
            for p in range(top - 1, bottom - 1, -1):
                if text[p] in _ASCII_SPACE and not text[p - 1].isspace():
                    return p
            if bottom == lo + 1:
                return lo
            width, top = 2 * width, bottom

    @staticmethod
    def _fixed_after(text: str, mid: int, hi: int) -> int:
        """The first fixed point in (mid, hi), hi if there is none."""
        width, bottom = WINDOW, mid + 1
        while True:
            top = min(hi, mid + width)
            for p in range(bottom, top):
                if text[p] in _ASCII_SPACE and not text[p - 1].isspace():
                    return p
            if top == hi:
                return hi
            width, bottom = 2 * width, top

    def _count_from_end(self, ids: list[int], n_bytes: int) -> int:
        i, lengths = len(ids), self.lengths
        while n_bytes > 0:
            i -= 1
            n_bytes -= lengths[ids[i]]
        if n_bytes:
            raise AssertionError("a fixed point inside a token")
        return i

    def _count_from_start(self, ids: list[int], n_bytes: int) -> int:
        i, lengths = 0, self.lengths
        while n_bytes > 0:
            n_bytes -= lengths[ids[i]]
            i += 1
        if n_bytes:
            raise AssertionError("a fixed point inside a token")
        return i

    # -- decoding ---------------------------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        return self._decode(ids, 0, len(ids))

    def _decode(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= LEAF_IDS:
            return b"".join(map(self.token_bytes.__getitem__, ids[lo:hi]))
        mid = (lo + hi) // 2
        return self._decode(ids, lo, mid) + self._decode(ids, mid, hi)


@lru_cache(maxsize=4)
def load_codec(path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeCodec:
    """A codec from a file of ranks (base64 token, rank), once per worker process."""
    import tiktoken

    with open(local_copy(path), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return TreeCodec(own.encode_ordinary, table, leaf_chars)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of pieces of a batch that end with the text that fills ``SLICE_BYTES``, so that ids of one piece only are held at a time."""
    lo = total = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
        total += n
        if total >= SLICE_BYTES:
            yield lo, i - lo
            lo, total = i, 0
    if lo < len(texts):
        yield lo, len(texts) - lo


def encode_decode(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    leaf_chars: int = LEAF_CHARS, with_ids: bool = True, digests: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, ``ids`` (array<int>, unless ``with_ids`` is false) and, with ``digests``, sha256 of the ids in decimal and of the bytes that decoding them gives.

    Null text counts as empty: no ids, the digests of nothing. A null id stays null; repeated rows give repeated
    rows; other columns are not read. Needs no shuffle; a worker holds one batch of texts and the ids of ``SLICE_BYTES`` of them, or of one longer text.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(path, pattern, leaf_chars)
        names = [str(i) for i in range(len(codec.token_bytes))] if digests else []
        for batch in batches:
            for lo, n in _slices(batch.column(1)):
                part = batch.slice(lo, n)
                counts, flat, sums, back = [], array("i"), [], []
                for text in part.column(1):
                    ids = codec.encode(text.as_py())
                    counts.append(len(ids))
                    if with_ids:
                        flat.extend(ids)
                    if digests:
                        sums.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                        back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                columns = [part.column(0), pa.array(counts, pa.int64())]
                if with_ids:
                    ends = np.cumsum([0, *counts]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))))
                columns += [pa.array(sums, pa.string()), pa.array(back, pa.string())] * digests
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", *["ids"] * with_ids, *["ids_sha256", "decoded_sha256"] * digests])

    return docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("__text")).mapInArrow(run, schema)
