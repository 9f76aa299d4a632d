"""Subword lattice likelihood: the probability of a text summed over all its segmentations into known pieces."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..session import settle
from .common import free_names, full_text

#: Written before each word, as in the vocabulary.
MARK = "▁"
#: A word is frequent if it makes up 1/FREQUENT of all tokens or more, so there are at most that many.
FREQUENT = 500_000
#: Passes that re-estimate the pieces' probabilities from the corpus.
PASSES = 1
#: What each piece counts before any text is seen.
SMOOTHING = 0.1
#: Pause of the rank in the first guess 1 / (rank + offset), Zipf's law as Mandelbrot wrote it.
ZIPF_OFFSET = 2.7
#: Words handled at once, and distinct words counted before a task hands them on.
CHUNK, FLUSH = 50_000, 200_000
#: Characters from which on a word is handled alone, and over how many its pieces are looked up at once.
LONG_WORD, STRETCH = 256, 1 << 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)
NEVER = -np.inf


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a public subword vocabulary in order of rank: texts with ``MARK`` first or none, and 256 bytes."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = sorted(range(model.get_piece_size()), key=lambda i: -model.get_score(i))
    ids = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    return [p for p in dict.fromkeys(pieces) if p and MARK not in p[1:]]


def _hash(points: np.ndarray) -> np.uint64:
    h = np.zeros(1, dtype=np.uint64)
    for p in points:
        h = h * _PRIME + np.uint64(p + 1)
    return h[0]


@dataclass
class Pieces:
    """Natural log probabilities of the pieces (by sorted hash), of single bytes, and of the end of a text."""

    hashes: np.ndarray
    logs: np.ndarray
    bytes_: np.ndarray
    end: float
    longest: int

    @classmethod
    def guess(cls, pieces: list[str]) -> Pieces:
        """Probabilities by rank, bytes as the last rank, before any text is seen."""
        hashes = np.array([_hash(np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        weight = np.append(1 / (np.arange(len(pieces)) + ZIPF_OFFSET), np.full(256, 1 / (len(pieces) + ZIPF_OFFSET)))
        logs = np.log(weight / weight.sum()) + math.log(0.999)
        return cls(hashes[order], logs[:-256][order], logs[-256:], math.log(0.001), max((len(p) for p in pieces), default=1))

    def learned(self, expected: np.ndarray, texts: int) -> Pieces:
        """Probabilities from expected counts of the pieces and bytes and the number of texts."""
        smooth = expected + SMOOTHING
        total = smooth.sum() + max(texts, SMOOTHING)
        logs = np.log(smooth / total)
        return Pieces(self.hashes, logs[:-256], logs[-256:], math.log(max(texts, SMOOTHING) / total), self.longest)

    def _by_bytes(self, points: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log probability of characters spelled as UTF-8 bytes, and the bytes (-1: none)."""
        p = points.astype(np.int64)
        cont = lambda shift: 0x80 | ((p >> shift) & 0x3F)
        none = np.full(len(p), -1)
        pick = lambda *cases: np.select([p < 0x80, p < 0x800, p < 0x10000], cases[:3], cases[3])
        spelled = [
            pick(p, 0xC0 | (p >> 6), 0xE0 | (p >> 12), 0xF0 | (p >> 18)),
            pick(none, cont(0), cont(6), cont(12)), pick(none, none, cont(0), cont(6)), pick(none, none, none, cont(0)),
        ]
        logs = sum(np.where(b >= 0, self.bytes_[np.clip(b, 0, 255)], 0.0) for b in spelled)
        return logs, spelled

    def marginals(self, words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each word's probability over all segmentations; with weights also the expected counts.

        Forward recursion in log space over all words of one length at once; words of ``LONG_WORD`` characters or more,
        which hardly share their length with others, one by one. An edge is a known piece, or any one character spelled in
        bytes, so every word has a probability above zero.
        """
        out = np.zeros(len(words))
        expected = np.zeros(len(self.logs) + 256) if weights is not None else None
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, members in by_length.items():
            if length >= LONG_WORD:
                for i in members:
                    out[i] = self._along(words[i], 1.0 if weights is None else weights[i], expected)
                continue
            rows = np.array(members)
            text = "".join(MARK + words[i] for i in members)
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(rows), length + 1)
            out[rows] = self._forward(points, None if weights is None else weights[rows], expected)
        return out, expected

    def _forward(self, points, weights, expected):
        many, size = points.shape
        alpha = np.full((size + 1, many), NEVER)
        alpha[0] = 0.0
        edges = []
        for s in range(size):
            spelled, raw = self._by_bytes(points[:, s])
            alpha[s + 1] = np.logaddexp(alpha[s + 1], alpha[s] + spelled)
            if expected is not None:
                edges.append((s, s + 1, None, spelled, raw))
            h = np.zeros(many, dtype=np.uint64)
            for e in range(s + 1, min(size, s + self.longest) + 1):
                h = h * _PRIME + (points[:, e - 1].astype(np.uint64) + np.uint64(1))
                at = np.searchsorted(self.hashes, h)
                at[at == len(self.hashes)] = 0
                hit = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, dtype=np.int64)
                if len(hit):
                    found = at[hit]
                    logs = self.logs[found]
                    alpha[e, hit] = np.logaddexp(alpha[e, hit], alpha[s, hit] + logs)
                    if expected is not None:
                        edges.append((s, e, hit, logs, found))
        total = alpha[size]
        if expected is None:
            return total
        beta = np.full((size + 1, many), NEVER)
        beta[size] = 0.0
        for s, e, hit, logs, found in reversed(edges):
            if hit is None:
                through = logs + beta[e]
                share = np.exp(alpha[s] + through - total) * weights
                for b in found:
                    real = b >= 0
                    expected[-256:] += np.bincount(b[real], weights=share[real], minlength=256)
                beta[s] = np.logaddexp(beta[s], through)
            else:
                through = logs + beta[e, hit]
                share = np.exp(alpha[s, hit] + through - total[hit]) * weights[hit]
                np.add.at(expected, found, share)
                beta[s, hit] = np.logaddexp(beta[s, hit], through)
        return total

    def _edges(self, points: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
        """Known pieces that start in ``low`` to ``high``: starts, ends, log probabilities, numbers; all lengths at once."""
        part = points[low: high + self.longest - 1].astype(np.uint64) + np.uint64(1)
        h, parts = np.zeros(min(high, len(points)) - low, dtype=np.uint64), []
        for length in range(1, self.longest + 1 if len(self.hashes) else 1):
            h = h[: len(part) - length + 1]
            h = h * _PRIME + part[length - 1: length - 1 + len(h)]
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            hit = np.flatnonzero(self.hashes[at] == h)
            parts.append((hit + low, hit + low + length, self.logs[at[hit]], at[hit]))
        if not parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _along(self, word: str, weight: float, expected: np.ndarray | None) -> float:
        """One long word: its pieces are looked up for whole stretches of it, then one pass along it adds them up.

        Sums are plain numbers, scaled up whenever they get small; of the pieces, one stretch is in memory at a time.
        """
        points = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = len(points)
        spelled, raw = self._by_bytes(points)
        single = np.exp(spelled).tolist()

        def passed(forward: bool) -> np.ndarray:
            """Log sums over all ways from the beginning to each place, or from each place to the end."""
            logs, sums, shift = np.zeros(size + 1), {0 if forward else size: 1.0}, 0.0
            lows = range(0, size, STRETCH)
            for low in lows if forward else reversed(lows):
                high = min(low + STRETCH, size)
                first = max(0, low - self.longest) if forward else low
                start, end, p, _ = self._edges(points, first, high)
                here = (end > low) & (end <= high) if forward else start >= low
                to, of, p = (end if forward else start)[here], (start if forward else end)[here], np.exp(p[here])
                order = np.argsort(to, kind="stable")
                places = np.arange(low + 1, high + 2) if forward else np.arange(low, high + 1)
                cuts = np.searchsorted(to[order], places).tolist()
                of, p = of[order].tolist(), p[order].tolist()
                steps = range(high - low) if forward else range(high - low - 1, -1, -1)
                for k in steps:
                    at = low + k + 1 if forward else low + k
                    total = sums[at - 1] * single[at - 1] if forward else sums[at + 1] * single[at]
                    for x in range(cuts[k], cuts[k + 1]):
                        total += sums[of[x]] * p[x]
                    if total < 1e-100:
                        sums = {i: v * 1e100 for i, v in sums.items() if abs(i - at) <= self.longest}
                        total, shift = total * 1e100, shift - 100 * math.log(10)
                    sums[at] = total
                    logs[at] = math.log(total) + shift
            return logs

        alpha = passed(True)
        if expected is None:
            return alpha[size]
        beta = passed(False)
        share = np.exp(alpha[:-1] + spelled + beta[1:] - alpha[size]) * weight
        for b in raw:
            real = b >= 0
            expected[-256:] += np.bincount(b[real], weights=share[real], minlength=256)
        for low in range(0, size, STRETCH):
            start, end, p, found = self._edges(points, low, min(low + STRETCH, size))
            np.add.at(expected, found, np.exp(alpha[start] + p + beta[end] - alpha[size]) * weight)
        return alpha[size]


def _in_training(key, modulus: int) -> bool:
    return key is None or zlib.crc32(str(key).encode()) % modulus != 0


def _split(text: str | None) -> list[bytes]:
    """Words of a text, ASCII letters in lower case: splitting bytes knows ASCII white space only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(docs: DataFrame, *, key: str, text: str, modulus: int) -> DataFrame:
    """Every word of the corpus with ``c``, how often the training texts have it (0: held-out texts only).

    The row with a null word counts the training texts.
    """

    def batch_of(counts):
        words = [None if w is None else w.decode("utf-8", "replace") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = _split(value.as_py())
                if _in_training(k, modulus):
                    counts.update(tokens)
                    counts[None] += 1
                else:
                    counts.update(dict.fromkeys(tokens, 0))
                if len(counts) > FLUSH:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    rows = docs.select(docs[f"`{key}`"].cast("string"), full_text(docs[f"`{text}`"]))
    return rows.mapInArrow(counted, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            yield part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)


def _expected(words: DataFrame, pieces: Pieces) -> np.ndarray:
    """Expected counts of the pieces over all training words; one number per piece reaches the driver."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.logs) + 256)
        for tokens, counts in _chunks(batches):
            total += shared.value.marginals(tokens, counts.astype(np.float64))[1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

    sums = np.zeros(len(pieces.logs) + 256)
    rows = words.where("c > 0").select("word", "c").mapInArrow(summed, "piece int, n double")
    for piece, n in rows.groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():
        sums[piece] = n
    return sums


def _word_scores(words: DataFrame, pieces: Pieces) -> DataFrame:
    """Each word with ``c`` and ``lp``, the log10 probability of the word over all segmentations."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, counts in _chunks(batches):
            logs = shared.value.marginals(tokens)[0] / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(counts), pa.array(logs)], names=["word", "c", "lp"])

    return words.select("word", "c").mapInArrow(scored, "word string, c bigint, lp double")


def score(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    modulus: int = 10,
    pieces: list[str] | None = None,
    passes: int = PASSES,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Score every text by a unigram model of subword pieces, and by a plain unigram model of words.

    Words are runs of anything but ASCII white space, ASCII letters in lower case; each text has one end token.
    Texts whose key's CRC-32 is no multiple of ``modulus`` are the training texts. The pieces are an existing
    vocabulary in the order of its scores (default: the public one), from which the first probabilities follow; each
    of ``passes`` over all distinct training words replaces them by the expected share of each piece, over all
    segmentations. ``score`` is the log10 probability of the text: the sum over its words of their marginal
    probability, with a mark before each word, and of the end. No piece reaches into a second word, so the product over
    the words is the marginal of the whole text. Each distinct word of the corpus is segmented once.

    ``base_score`` is log10 of the words' probability with 0.1 added to each count.

    Words that make up 1/``frequent`` of the training tokens or more, at most ``frequent`` of them, are broadcast with
    their counts and probabilities; the other words of each text meet theirs in a join, and come back as one sum.

    Returns ``keep`` (default: all columns), ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score``, one row per input row, in place of columns of those names. Null and empty texts have the end token
    only; null keys are training texts. Without training texts every count is 0.
    """
    made = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in (keep or docs.columns) if c.lower() not in made]
    spark = docs.sparkSession
    counted = settle(word_counts(docs, key=key, text=text, modulus=modulus))
    words = counted.where("word is not null")
    totals = counted.agg(
        F.sum("c").alias("n"), F.count(F.when((F.col("c") > 0) & F.col("word").isNotNull(), 1)).alias("v"),
        F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("texts")).first()
    tokens, texts = totals["n"] or 0, totals["texts"] or 0
    kinds = totals["v"] + (texts > 0)
    model = Pieces.guess(vocabulary() if pieces is None else pieces)
    for _ in range(passes):
        model = model.learned(_expected(words, model), texts)
    table = settle(_word_scores(words, model))
    known = table.where((F.col("c") > 0) & (F.col("c") * frequent >= tokens)).collect()
    weigh = lambda c: math.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
    shared = spark.sparkContext.broadcast({r["word"].encode(): (weigh(r["c"]), r["lp"]) for r in known})
    end_base, end_score = weigh(texts), model.end / math.log(10)

    row, body, own = free_names([*keep, *made], "_row", "_body", "_key")
    rows = docs.select(
        *[docs[f"`{c}`"] for c in keep], F.monotonically_increasing_id().alias(row),
        docs[f"`{key}`"].cast("string").alias(own), full_text(docs[f"`{text}`"]).alias(body))
    found = StructType.fromDDL(
        "held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:string,n:int>>")
    schema = StructType([*rows.drop(own, body).schema, *found])
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            values = [[] for _ in range(6)]
            for k, value in zip(batch.column(len(keep) + 1).to_pylist(), batch.column(len(keep) + 2)):
                found = _split(value.as_py())
                base, total, n_known, rare = end_base, end_score, int(texts > 0), []
                for word, n in Counter(found).items():
                    hit = common.get(word)
                    if hit is None:
                        rare.append({"word": word.decode("utf-8", "replace"), "n": n})
                    else:
                        base += n * hit[0]
                        total += n * hit[1]
                        n_known += n
                for column, v in zip(values, (not _in_training(k, modulus), len(found) + 1, n_known, base, total, rare)):
                    column.append(v)
            kinds_ = (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare_type)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep) + 1)], *[pa.array(v, t) for v, t in zip(values, kinds_)]],
                names=[f.name for f in schema])

    seen = settle(rows.mapInArrow(looked_up, schema))
    rare = seen.select(row, F.explode("rare").alias("r")).select(row, F.col("r.word").alias("rare_word"), F.col("r.n").alias("times"))
    rare = rare.join(table, F.col("rare_word") == F.col("word"))
    base = F.log10((F.col("c") + 0.1) / F.lit(tokens + 0.1 * (kinds + 1)))
    rare = rare.groupBy(F.col(row).alias("row_r")).agg(
        F.sum(F.col("times") * base).alias("more_base"), F.sum(F.col("times") * F.col("lp")).alias("more_score"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = seen.drop("rare").join(rare, F.col(row) == F.col("row_r"), "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select(
        *[F.col(f"`{c}`") for c in keep], "held_out", "n_tokens", plus("n_known", "more_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), plus("base_score", "more_base"), plus("score", "more_score"))
