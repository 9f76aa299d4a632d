"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_names, full_text

#: Terms are hashed: runs of three bytes, and runs of four character classes. The rest mark repetition.
BYTE_TERMS, SHAPE_TERMS = 512, 512
REPEAT_STEPS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4)
MARKS = 2 * (len(REPEAT_STEPS) + 1)
TERMS = BYTE_TERMS + SHAPE_TERMS + MARKS
BLOCKS = ((0, BYTE_TERMS, 1.0), (BYTE_TERMS, BYTE_TERMS + SHAPE_TERMS, 1.5), (BYTE_TERMS + SHAPE_TERMS, TERMS, 0.7))
#: Dimensions of the latent space.
DIMENSIONS = 64
#: Labelled documents that vote, at most, half of them of each label: what is broadcast is bounded by
#: 8192 x 64 numbers, whatever the size of the corpus.
REFERENCES = 8192
NEIGHBOURS = 24
#: Votes weigh the cosine to this power.
SHARPNESS = 4
#: Documents compared with all references at once, and bytes of a text read at once.
BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 20


def _classes() -> np.ndarray:
    """Upper case, lower case (with all bytes of other scripts), digits and white space as one class each."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"): ord("Z") + 1] = ord("A")
    table[ord("a"): ord("z") + 1] = ord("a")
    table[128:] = ord("a")
    table[ord("0"): ord("9") + 1] = ord("0")
    table[[9, 10, 11, 12, 13]] = ord(" ")
    return table


_CLASS = _classes()
_RUNS = np.isin(np.arange(256), [ord("A"), ord("a"), ord("0"), ord(" ")])


def _hashed(data: np.ndarray, length: int, size: int) -> np.ndarray:
    """How often each hash value occurs among the runs of ``length`` bytes."""
    if len(data) < length:
        return np.zeros(size, dtype=np.int64)
    h = np.zeros(len(data) - length + 1, dtype=np.uint32)
    for k in range(length):
        h = h * np.uint32(0x01000193) + data[k: len(data) - length + 1 + k]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount((h >> np.uint32(12)) % np.uint32(size), minlength=size)


def _repeat_mark(units: list, offset: int, out: np.ndarray) -> None:
    if len(units) > 1:
        share = sum(a == b for a, b in zip(units, units[1:])) / (len(units) - 1)
        out[offset + int(np.searchsorted(REPEAT_STEPS, share, side="right"))] = 1


def count_terms(text: str) -> np.ndarray:
    """Counts of the hashed terms of a whole text."""
    out = np.zeros(TERMS, dtype=np.float32)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    for start in range(0, len(data), BLOCK_BYTES):
        piece = data[start: start + BLOCK_BYTES + 2]
        out[:BYTE_TERMS] += _hashed(piece, 3, BYTE_TERMS)
        shape = _CLASS[piece]
        shape = shape[np.concatenate(([True], (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]))]
        out[BYTE_TERMS: BYTE_TERMS + SHAPE_TERMS] += _hashed(shape, 4, SHAPE_TERMS)
    words = text.split()
    _repeat_mark(words, BYTE_TERMS + SHAPE_TERMS, out)
    _repeat_mark(sorted(text.split("\n")), BYTE_TERMS + SHAPE_TERMS + MARKS // 2, out)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts times inverse document frequency, each block of terms scaled to its weight."""
    weighted = np.log1p(counts) * idf
    for start, end, weight in BLOCKS:
        block = weighted[:, start:end]
        norm = np.linalg.norm(block, axis=1, keepdims=True)
        np.divide(block * weight, norm, out=block, where=norm > 0)
    return weighted


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


@dataclass
class Model:
    """What a task needs: weights of the terms, axes of the latent space, and the labelled vectors."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    keys: dict
    prior: float

    def latent(self, texts: list[str]) -> np.ndarray:
        counts = np.stack([count_terms(t) for t in texts])
        return _unit(weigh(counts, self.idf) @ self.axes)

    def vote(self, texts: list[str], keys: list) -> np.ndarray:
        """Scores of a block of documents; a reference never votes for itself."""
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        vectors = self.latent(texts)
        cosine = vectors @ self.vectors.T
        own = [(i, self.keys[k]) for i, k in enumerate(keys) if k in self.keys]
        for i, j in own:
            cosine[i, j] = -1
        k = min(NEIGHBOURS, cosine.shape[1])
        nearest = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
        weight = np.clip(np.take_along_axis(cosine, nearest, 1), 0, 1).astype(np.float64) ** SHARPNESS * self.weights[nearest]
        total = weight.sum(axis=1)
        voted = (weight * self.labels[nearest]).sum(axis=1)
        # A share of the prior keeps a document without any similar reference at the prior.
        return np.clip((voted + 1e-9 * self.prior) / (total + 1e-9), 0.0, 1.0)


def _frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """Inverse document frequency of each term over all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen += count_terms(value.as_py() or "") > 0
                rows += 1
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(np.append(seen, rows))], names=["term", "n"])

    parts = docs.select(docs[f"`{text}`"].cast("string")).mapInArrow(counted, "term int, n long")
    sums = np.zeros(TERMS + 1, dtype=np.int64)
    for row in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():
        sums[row["term"]] = row["n"]
    return (np.log((1 + sums[TERMS]) / (1 + sums[:TERMS])) + 1).astype(np.float32)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    references: int = REFERENCES,
    dimensions: int = DIMENSIONS,
) -> Model:
    """Learn the space and choose the labelled documents that vote.

    Document frequencies cover all of ``docs``. The latent space and the voters come from a sample of ``labels``
    bounded by ``references``: up to half of each label, those with the smallest hash of the key, so that a rare label
    is known as well as a common one; votes are weighted back to the labels' true shares. Labels of null keys, null
    labels and keys without a document are not used; keys labelled several times count with the mean, rounded; of
    several documents with one key the one with the smallest text is used.
    """
    spark = docs.sparkSession
    idf = _frequencies(docs, text)
    marked = labels.select(labels[f"`{key}`"].alias("k"), labels[f"`{label}`"].cast("double").alias("y"))
    marked = marked.where("k is not null and y is not null").groupBy("k").agg(F.round(F.avg("y")).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(references // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(docs[f"`{key}`"].alias("key"), full_text(docs[f"`{text}`"]).alias("body"))
    texts = texts.join(F.broadcast(chosen), F.col("key") == F.col("k"))
    texts = texts.groupBy("key", "y").agg(F.min("body").alias("body"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.log1p(count_terms(t.as_py())).astype(np.float16).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["key", "y", "terms"])

    kind = docs.select(docs[f"`{key}`"].alias("key")).schema["key"].dataType.simpleString()
    found = texts.mapInArrow(described, f"key {kind}, y int, terms binary").orderBy("key").toArrow()
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    keys, ys = found.column("key").to_pylist(), np.array(found.column("y").to_pylist(), dtype=np.float64)
    if not len(keys):
        empty = np.zeros((0, 1), dtype=np.float32)
        return Model(idf, np.zeros((TERMS, 1), dtype=np.float32), empty, ys, ys, {}, prior)
    logs = np.frombuffer(b"".join(found.column("terms").to_pylist()), dtype=np.float16).reshape(len(keys), TERMS)
    weighted = weigh(np.expm1(logs.astype(np.float32)), idf)
    per_label = np.array([shares[y] / max(1, (ys == y).sum()) for y in (0, 1) if (ys == y).any()])
    present = [y for y in (0, 1) if (ys == y).any()]
    weights = np.zeros(len(keys))
    for y, w in zip(present, per_label):
        weights[ys == y] = w / total
    _, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions]).astype(np.float32)
    return Model(idf, axes, _unit(weighted @ axes), ys, weights, {k: i for i, k in enumerate(keys)}, prior)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with ``score``: how likely label 1 is, from 0 to 1.

    Every document is compared with every reference, in blocks. Texts with no terms, and null texts, get the share of
    label 1 among the labels, or 0.5 where there are none. An empty table gives an empty table.
    """
    keep = [c for c in (keep or docs.columns) if c.lower() != "score"]
    own, body = free_names([*keep, "score"], "_key", "_body")
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{key}`"].alias(own), full_text(docs[f"`{text}`"]).alias(body))
    schema = docs.select(*[docs[f"`{c}`"] for c in keep]).schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(start, BLOCK_ROWS)
                values = shared.value.vote(block.column(len(keep) + 1).to_pylist(), block.column(len(keep)).to_pylist())
                columns = [block.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(scored, schema)


def held_out(key: Column) -> Column:
    """Whether a document is kept out of training: CRC-32 of its key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
