"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import free_names, full_text, let

#: Tokens are runs of letters and digits in lower case, so changed punctuation and case do not hide a passage.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Tokens of a seed, and of the shortest tile.
MATCH = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: Seeds of the benchmark up to this number (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SEEDS = 200_000

_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_BASE = 1_000_003


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _seeds(words: Column, length: int) -> Column:
    """A hash of every run of ``length`` tokens, by position."""
    return F.transform(F.slice(words, length, F.size(words)), lambda last, i: F.xxhash64(
        *[words[i + k] for k in range(length - 1)], last))


def _rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` numbers, modulo 2 to the 64."""
    if len(ids) < length:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(ids) - length + 1, dtype=np.uint64)
    for k in range(length):
        out = out * np.uint64(_BASE) + ids[k: len(ids) - length + 1 + k]
    return out


def tile(document: list[str], item: list[str], length: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the document, place in the item, tokens) of non-overlapping tiles.

    The longest match of unmarked tokens is marked again and again, ties by place in the item and then in the
    document, until none of ``length`` tokens is left. Every match holds a run of ``length`` tokens whose rolling
    hashes agree; their tokens are compared before they count. An item's tokens are marked at most once, so there are
    at most len(item) / length rounds.
    """
    number = {}
    b = np.array([number.setdefault(w, len(number) + 1) for w in item], dtype=np.uint64)
    a = np.array([number.get(w, 0) for w in document], dtype=np.uint64)
    ha, hb = _rolling(a, length), _rolling(b, length)
    if not len(ha) or not len(hb):
        return []
    order = np.argsort(hb, kind="stable")
    low, high = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    hits = np.flatnonzero(high > low)
    count = (high - low)[hits]
    if not len(hits):
        return []
    da = np.repeat(hits, count)
    db = order[np.repeat(low[hits], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    same = np.ones(len(da), dtype=bool)
    for k in range(length):
        same &= a[da + k] == b[db + k]
    da, db = da[same], db[same]
    order = np.lexsort((da, da - db))
    da, db = da[order], db[order]
    marked_a, marked_b, out = np.zeros(len(a) + 1, dtype=np.int64), np.zeros(len(b) + 1, dtype=np.int64), []
    while len(da):
        # Neighbouring seeds on a diagonal make one longer match.
        new = np.concatenate(([True], (np.diff(da) != 1) | (np.diff(db) != 1)))
        starts = np.flatnonzero(new)
        runs = np.diff(np.append(starts, len(da)))
        best = min(np.flatnonzero(runs == runs.max()), key=lambda r: (db[starts[r]], da[starts[r]]))
        i, j, n = int(da[starts[best]]), int(db[starts[best]]), int(runs[best]) + length - 1
        out.append((i, j, n))
        marked_a[i: i + n] = 1
        marked_b[j: j + n] = 1
        before_a, before_b = np.append(0, np.cumsum(marked_a)), np.append(0, np.cumsum(marked_b))
        free = (before_a[da + length] == before_a[da]) & (before_b[db + length] == before_b[db])
        da, db = da[free], db[free]
    return out


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    length: int = MATCH,
    coverage: float = COVERAGE,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """Pairs of a document's text (its digest ``tk``) and a benchmark item that covers it, with the tiles.

    Seeds, the runs of ``length`` tokens that texts and items share, are joined. Tiles consist of seeds, so the item
    tokens under the shared seeds bound the coverage from above: pairs whose bound is under ``coverage`` are
    settled, the others are tiled in full. A tile may stand anywhere in the text, so reordered passages count.

    Returns ``tk``, ``item`` (the key), ``covered`` (share of the item's tokens under tiles, at least ``coverage``)
    and ``tiles``, one row for each distinct text and benchmark row. Items under ``length`` tokens, null and empty
    texts match nothing; null keys are allowed; a benchmark row given twice is found twice.
    """
    items = benchmark.select(
        F.monotonically_increasing_id().alias("row"), benchmark[f"`{item_key}`"].alias("item"),
        full_text(benchmark[f"`{item_text}`"]).alias("item_body"))
    items = settle(items)
    seeds = items.select("row", let(_tokens(F.col("item_body")), lambda w: F.struct(
        F.size(w).alias("size"), _seeds(w, length).alias("seeds"))).alias("s"))
    seeds = settle(seeds.select("row", F.col("s.size").alias("size"), F.posexplode("s.seeds").alias("place", "seed_r")))
    small = seeds.count() <= broadcast_seeds
    own = docs.select(full_text(docs[f"`{text}`"]).alias("body"))
    looked = own.select(
        F.md5(F.col("body").cast("binary")).alias("tk"),
        F.explode(F.array_distinct(let(_tokens(F.col("body")), lambda w: _seeds(w, length)))).alias("seed"))
    shared = looked.join(F.broadcast(seeds) if small else seeds, F.col("seed") == F.col("seed_r"))
    pairs = shared.groupBy("tk", "row").agg(F.array_sort(F.collect_set("place")).alias("places"), F.any_value("size").alias("size"))
    bound = F.aggregate(
        "places", F.struct(F.lit(-length).alias("at"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("at"), (s["n"] + F.least(p - s["at"], F.lit(length))).alias("n")), lambda s: s["n"])
    pairs = settle(pairs.where(bound >= coverage * F.col("size")).select(F.col("tk").alias("tk_r"), F.col("row").alias("row_r")))

    texts = own.withColumn("tk", F.md5(F.col("body").cast("binary"))).join(pairs, F.col("tk") == F.col("tk_r"))
    texts = texts.groupBy("tk", "row_r").agg(F.any_value("body").alias("body"))
    texts = texts.join(items, F.col("row_r") == F.col("row")).select("tk", "item", "body", "item_body")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, counts = [], []
            for body, item in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                wanted = tokens(item)
                found = tile(tokens(body), wanted, length)
                covered.append(sum(n for _, _, n in found) / max(1, len(wanted)))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(covered, pa.float64()), pa.array(counts, pa.int32())],
                names=["tk", "item", "covered", "tiles"])

    kind = items.schema["item"].dataType.simpleString()
    out = texts.mapInArrow(tiled, f"tk string, item {kind}, covered double, tiles int")
    return settle(out.where(F.col("covered") >= coverage))


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """``keep`` (default: all columns) with ``contaminated``, ``n_items``, and ``item_id``, ``covered`` and ``tiles``
    of the item covered most (ties: the smallest key), in place of columns of those names; one row per input row."""
    made = ("contaminated", "n_items", "item_id", "covered", "tiles")
    keep = [c for c in (keep or docs.columns) if c.lower() not in made]
    tk, tk_r = free_names([*keep, *made], "_tk", "_tk_r")
    found = matches(docs, benchmark, text=text, **options)
    place = F.struct((-F.col("covered")).alias("less"), F.col("item").isNull().alias("none"), "item", "tiles")
    found = found.groupBy(F.col("tk").alias(tk_r)).agg(F.count(F.lit(1)).cast("int").alias("n_items"), F.min(place).alias("best"))
    found = settle(found.select(
        tk_r, "n_items", F.col("best.item").alias("item_id"), (-F.col("best.less")).alias("covered"), F.col("best.tiles").alias("tiles")))
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], F.md5(full_text(docs[f"`{text}`"]).cast("binary")).alias(tk))
    rows = rows.join(found, rows[tk] == found[tk_r], "left")
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "covered", "tiles")


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, unchanged."""
    found = matches(docs, benchmark, text=text, **options).select(F.col("tk").alias("tk_r")).distinct()
    tk = free_names(docs.columns, "_tk")[0]
    rows = docs.withColumn(tk, F.md5(full_text(docs[f"`{text}`"]).cast("binary")))
    return rows.join(settle(found), rows[tk] == F.col("tk_r"), "left_anti").drop(tk)
