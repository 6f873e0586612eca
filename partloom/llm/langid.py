"""Language identification with string kernels.

Kernel.  A text is the set of its n-grams of 1 to 4 characters (letters in lower case, anything else one space): a blended spectrum by presence, hashed into
``BUCKETS`` places per order.  k(x, y) = |x and y| / sqrt(|x| |y|).
Model.  ``LANDMARKS`` training texts give a Nyström map K_xl K_ll^(-1/2); one ridge regression per language (one against the rest) on the mapped training texts.
Scoring.  K_xl is linear in the presence vector of x but for its length, so landmarks, map and regression fold into one matrix of places by languages, and a batch of texts is
scored by one product of its sparse presence matrix with that matrix.  Whole texts are read.

The training texts are a sample of bounded size, ``TRAIN_ROWS`` in all, an equal number of each language, taken by least hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_of

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
TRAIN_ROWS = 1200
LANDMARKS = 192
RIDGE = 1e-2
UNKNOWN = "und"


class Presence:
    """The places of a text's n-grams; None if it has no letter."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.flags = np.zeros(len(ORDERS) * BUCKETS, bool)

    def __call__(self, text: str) -> np.ndarray | None:
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = self.letter[c]
        if not is_letter.any():
            return None
        c = np.where(is_letter, c, np.uint32(32))
        c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])].astype(np.uint64)
        code = np.zeros(len(c), np.uint64)
        for o, n in enumerate(ORDERS):
            if len(c) < n:
                break
            code = code[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)
            mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.flags[(mixed >> np.uint64(48)).astype(np.int64) + o * BUCKETS] = True
        places = np.flatnonzero(self.flags)
        self.flags[places] = False
        return places


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # places x languages

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """texts x languages: the batch's presence matrix times the folded weights, by the length of each text's vector."""
        sizes = np.array([len(t) for t in texts])
        sums = np.add.reduceat(self.weights[np.concatenate(texts)], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        return sums / np.sqrt(sizes)[:, None]


def fit(places: list[np.ndarray | None], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from each training text's places; those without a letter (None) are left out."""
    rows = [(p, label) for p, label in zip(places, labels, strict=True) if p is not None]
    languages = sorted({label for _, label in rows})
    if not rows:
        return Model([], np.zeros((len(ORDERS) * BUCKETS, 0), np.float32))
    # Landmarks: the first of each language in turn; rows come in hash order.
    by_language = [[i for i, (_, x) in enumerate(rows) if x == label] for label in languages]
    chosen = [x[r] for r in range(max(map(len, by_language))) for x in by_language if r < len(x)][:landmarks]
    marks = np.zeros((len(ORDERS) * BUCKETS, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[rows[i][0], j] = 1 / np.sqrt(len(rows[i][0]))
    kernel = np.stack([marks[p].sum(axis=0) / np.sqrt(len(p)) for p, _ in rows]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel @ root
    targets = np.array([[1.0 if label == x else -1.0 for x in languages] for _, label in rows])
    solved = np.linalg.solve(mapped.T @ mapped + ridge * len(rows) * np.eye(mapped.shape[1]), mapped.T @ targets)
    return Model(languages, (marks @ (root @ solved).astype(np.float32)).astype(np.float32))


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, train: Column, rows: int = TRAIN_ROWS) -> list[tuple[np.ndarray | None, str]]:
    """(places, label) of at most ``rows`` labelled rows, equally many of each language where it has as many, by least hash of id and text.

    Whole texts become presence vectors where they lie; what travels is one bit a place, so the driver's share is bounded whatever the texts' lengths.
    """
    labelled = docs.where(train & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(F.xxhash64(docs[id_col], docs[text_col]).alias("h"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return []
    share = max(1, rows // len(counts))
    # A language's hash bound lets through a little more than its share on average; the cut to the share follows.
    span = float(1 << 64)
    bound = {x: -(2.0**63) + span * min(1.0, (share + 4 * share**0.5 + 8) / n) for x, n in counts.items()}
    low = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for x in bound.items() for y in x]), F.col("lang")), F.lit(-(2.0**63)))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in batches:
            bits = [_bits(presence(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["h", "lang", "bits"])

    taken: dict[str, list[tuple[int, bytes]]] = {}
    for r in labelled.where(F.col("h").cast("double") <= low).mapInArrow(seen, "h long, lang string, bits binary").collect():
        taken.setdefault(r["lang"], []).append((r["h"], bytes(r["bits"])))
    merged = sorted((h, b, x) for x, found in taken.items() for h, b in sorted(found)[:share])
    return [(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))) if b else None, x) for _, b, x in merged]


def _bits(places: np.ndarray | None) -> bytes:
    """One bit a place; nothing for a text without a letter."""
    if places is None:
        return b""
    flags = np.zeros(len(ORDERS) * BUCKETS, bool)
    flags[places] = True
    return np.packbits(flags).tobytes()


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (0 to 1). ``und`` and 0 for null texts, texts without a letter, and if no language was learned."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if model.languages:
                for lo in range(0, len(texts), 64):
                    seen = [(i, p) for i in range(lo, min(lo + 64, len(texts))) if (p := presence(texts[i])) is not None]
                    if not seen:
                        continue
                    s = model.score([p for _, p in seen])
                    for (i, _), best, row in zip(seen, s.argmax(axis=1), s, strict=True):
                        labels[i], scores[i] = model.languages[best], float(0.5 + 0.5 * np.clip(row[best], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_column: Column) -> Column:
    """Of the evaluation fold: crc32 of the id as text is 2 modulo 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn_and_predict(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score. Learns only from rows that aren't held out and have a language."""
    sample = training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, train=~held_out(docs[id_col]), rows=rows)
    model = fit([p for p, _ in sample], [x for _, x in sample])
    out = predict(docs, model, id_col=id_col, text_col=text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
