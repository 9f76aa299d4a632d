"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import free_names, full_text
from .graph import connected_components

WORDS = 5
THRESHOLD = 0.8
#: Chance that a pair at the threshold shares a band; more similar pairs share one more surely.
RECALL = 0.9999
MAX_HASHES = 128
#: N-grams of a block: at most the first number, and at least the second. In between a group of ``g`` n-grams has blocks of
#: sqrt(BALANCE * g): the number of blocks, which is how often a text is sent, and their size grow alike.
BLOCK_GRAMS, LEAST_BLOCK, BALANCE = 1_500_000, 30_000, 2_000
#: N-grams hashed at once, and words remembered by a task.
SLICE, MEMORY = 4096, 500_000


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) with which a pair at the threshold meets the recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        chance = threshold**rows
        bands = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding with so few hashes meets the recall")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(seed: int, count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class _Words(dict):
    """Hashes of words as signed numbers, each computed once."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


class Grams:
    """Sets of n-gram hashes; remembers word hashes up to a bound."""

    def __init__(self, words: int = WORDS):
        self.words, self.known, self.powers = words, _Words(), _numbers(7, words) | np.uint64(1)

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the runs of ``words`` words, ASCII letters in lower case.

        Words are told apart by ASCII white space, which is all that splitting bytes knows. A shorter text has one
        n-gram, all its words; a text without words has none.
        """
        tokens = text.encode("utf-8", "replace").lower().split()
        if not tokens:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > MEMORY:
            self.known.clear()
        ids = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens)).view(np.uint64)
        width = min(self.words, len(ids))
        total = np.zeros(len(ids) - width + 1, dtype=np.uint64)
        for k in range(width):
            total += ids[k: len(ids) - width + 1 + k] * self.powers[k]
        return np.unique(_mix(total + np.uint64(width)))


def _signature(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(grams), SLICE):
        part = grams[start: start + SLICE, None] * factors + offsets
        np.minimum(least, part.min(axis=0), out=least)
    return least


def _sketches(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """Per row: key, text digest ``tk``, digest ``gs`` of the n-gram set, its size and its band hashes."""
    own = docs.select(docs[f"`{key}`"].alias("key"), full_text(docs[f"`{text}`"]).alias("body"))
    schema = f"key {own.schema['key'].dataType.simpleString()}, tk binary, gs binary, n int, bands array<bigint>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, hashes = Grams(words), bands * rows
        factors, offsets = _numbers(1, hashes) | np.uint64(1), _numbers(2, hashes)
        place = _numbers(3, rows) | np.uint64(1)
        band_no = _numbers(4, bands)
        for batch in batches:
            tks, sets, sizes, keys = [], [], [], []
            for value in batch.column(1):
                body = value.as_py()
                found = grams.of(body)
                tks.append(hashlib.md5(body.encode("utf-8", "replace")).digest())
                sets.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                if len(found):
                    signature = _signature(found, factors, offsets).reshape(bands, rows)
                    keys.append(_mix((signature * place).sum(axis=1, dtype=np.uint64) + band_no).view(np.int64))
                else:
                    keys.append(np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tks, pa.binary()), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["key", "tk", "gs", "n", "bands"])

    return own.mapInArrow(sketch, schema)


class _Group:
    """Members of one verification task."""

    def __init__(self):
        self.sets, self.blocks, self.copies, self.grams = [], [], [], []

    def add(self, gs, block, copies, grams):
        self.sets.append(gs)
        self.blocks.append(block)
        self.copies.append(copies)
        self.grams.append(grams)

    def links(self, threshold: float, across: bool) -> Iterator[tuple[int, np.ndarray]]:
        """For each member, the members linked with it; from the other block only if the group is a pair of blocks."""
        sizes = np.array([len(g) for g in self.grams])
        owners = np.repeat(np.arange(len(sizes)), sizes)
        all_ = np.concatenate(self.grams)
        order = np.argsort(all_, kind="stable")
        ranked = all_[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        number = np.empty(len(all_), dtype=np.int64)
        number[order] = np.cumsum(first) - 1
        holders, starts = owners[order], np.append(np.flatnonzero(first), len(all_))
        blocks, at = np.array(self.blocks), 0
        for i, size in enumerate(sizes):
            mine = number[at: at + size]
            at += size
            counts = starts[mine + 1] - starts[mine]
            mine, counts = mine[counts > 1], counts[counts > 1]
            if not len(mine):
                yield i, mine
                continue
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            shared = np.bincount(holders[np.repeat(starts[mine], counts) + offset], minlength=len(sizes))
            near = (shared * (1 + threshold) >= threshold * (size + sizes) - 1e-9) & (shared > 0)
            near[i] = False
            if across:
                near &= blocks != blocks[i]
            yield i, np.flatnonzero(near)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _verify(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links of each member within its group, and the smallest set digest it hangs together with.

    ``members``: comp, i, j (blocks compared), block, gs, copies, body; a group's rows follow each other.
    """

    def groups(batches):
        grams, now, group = Grams(words), None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for comp, i, j, block, gs, copies, body in zip(*columns):
                if (comp, i, j) != now:
                    if group:
                        yield now, group
                    now, group = (comp, i, j), _Group()
                group.add(gs, block, copies, grams.of(body))
        if group:
            yield now, group

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[], [], []]
        for (_, i, j), group in groups(batches):
            parent, counts = list(range(len(group.sets))), [0] * len(group.sets)
            for a, near in group.links(threshold, i != j):
                for b in near:
                    counts[a] += group.copies[b]
                    ra, rb = _root(parent, a), _root(parent, b)
                    if ra != rb:
                        low, high = (ra, rb) if group.sets[ra] < group.sets[rb] else (rb, ra)
                        parent[high] = low
            out[0] += group.sets
            out[1] += [group.sets[_root(parent, k)] for k in range(len(parent))]
            out[2] += counts
            if len(out[0]) > 5000:
                yield _batch(out)
                out = [[], [], []]
        if out[0]:
            yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["gs", "label", "links"])

    return members.mapInArrow(verified, "gs binary, label binary, links bigint")


def classes(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per document: ``key``, text digest ``tk``, ``class_id``, ``n_links`` and ``first``.

    Two documents are linked if their sets of ``words``-word n-grams have a Jaccard similarity of ``threshold`` or
    more; ``n_links`` counts a document's links, copies included. Classes are the connected components; ``class_id``
    is the smallest key in the class, and ``first`` marks the row with the smallest (key, text digest), null last.

    Rows with the same set are one representative from the start: exact copies are counted, never paired. Bands of
    MinHash values (as many as ``recall`` asks for) connect representatives to the smallest one in their bucket; every
    linked pair lies in one component of that graph. Each representative's n-grams are then sent to its component once
    and all links inside are found from shared n-grams. A component is dealt into blocks of up to ``block_grams`` n-grams,
    smaller ones in smaller components, and compared pair of blocks by pair of blocks, in separate tasks.

    Texts without words have one empty set: they are copies of each other. Null texts are empty; null keys never give
    a class its id unless all are null. Repeated rows are linked copies. An empty table gives an empty table.
    """
    bands, rows = choose_bands(threshold, recall)
    sketches = settle(_sketches(docs, key, text, words, bands, rows))
    reps = sketches.groupBy("gs").agg(
        F.min("tk").alias("tk"), F.min("key").alias("low"), F.count(F.lit(1)).alias("copies"),
        F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    reps = settle(reps)
    dealt = reps.select("gs", F.posexplode("bands").alias("band", "bucket"))
    buckets = dealt.groupBy("band", "bucket").agg(F.min("gs").alias("low"), F.max("gs").alias("high"))
    buckets = settle(buckets.where("low != high").select(F.col("band").alias("band_r"), F.col("bucket").alias("bucket_r"), "low"))
    edges = dealt.join(buckets, (F.col("band") == F.col("band_r")) & (F.col("bucket") == F.col("bucket_r")))
    comps = connected_components(edges.select("gs", "low"), "gs", "low", node="node", root="comp")

    wanted = reps.select("gs", "tk", "copies", "n").join(comps, F.col("gs") == F.col("node")).drop("node")
    wanted = settle(wanted)
    grams = F.sum("n")
    wide = F.greatest(F.lit(min(LEAST_BLOCK, block_grams)), F.least(F.lit(block_grams), F.sqrt(BALANCE * grams)))
    blocks = settle(wanted.groupBy("comp").agg(F.ceil(grams / wide).cast("int").alias("parts"))
                    .withColumnRenamed("comp", "comp_r"))
    wanted = wanted.join(blocks, F.col("comp") == F.col("comp_r")).drop("comp_r")
    block = F.pmod(F.xxhash64("gs"), F.col("parts")).cast("int")
    wanted = settle(wanted.withColumn("block", F.when(F.col("parts") > 1, block).otherwise(0)).withColumnRenamed("tk", "tk_r"))
    bodies = docs.select(full_text(docs[f"`{text}`"]).alias("body"))
    bodies = bodies.join(wanted, F.unhex(F.md5(F.col("body").cast("binary"))) == F.col("tk_r"))
    bodies = bodies.groupBy("gs", "comp", "parts", "block", "copies").agg(F.any_value("body").alias("body"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = bodies.withColumn("other", other).select(
        "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "gs", "copies", "body")
    members = members.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    found = settle(_verify(members, words, threshold))

    # A component in one block is settled by its task; labels of several blocks meet in their own graph.
    joined = found.groupBy("gs").agg(
        F.sum("links").alias("links"), F.min("label").alias("label"), F.max("label").alias("last"), F.count(F.lit(1)).alias("times"))
    joined = settle(joined)
    if joined.where("times > 1").limit(1).count():
        split = found.join(joined.where("times > 1").select(F.col("gs").alias("gs_r")), F.col("gs") == F.col("gs_r"), "left_semi")
        roots = connected_components(split, "gs", "label", node="node", root="root")
        joined = joined.join(roots, F.col("gs") == F.col("node"), "left")
        joined = joined.withColumn("label", F.when(F.col("times") > 1, F.coalesce("root", "gs")).otherwise(F.col("label")))
    joined = joined.select(F.col("gs").alias("gs_r"), "label", "links")
    reps = reps.select("gs", "low", "copies").join(joined, F.col("gs") == F.col("gs_r"), "left")
    reps = settle(reps.select(
        "gs", F.coalesce("label", "gs").alias("label"), "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    ids = settle(reps.groupBy("label").agg(F.min("low").alias("class_id")).withColumnRenamed("label", "label_r"))
    reps = settle(reps.join(ids, F.col("label") == F.col("label_r")).select(F.col("gs").alias("gs_r"), "label", "class_id", "n_links"))
    out = sketches.select("key", "tk", "gs").join(reps, F.col("gs") == F.col("gs_r")).drop("gs_r", "gs")
    out = settle(out)
    place = F.struct(F.col("key").isNull().alias("none"), "key", "tk")
    firsts = settle(out.groupBy(F.col("label").alias("label_r")).agg(F.min(place).alias("rep")))
    out = out.join(firsts, F.col("label") == F.col("label_r"))
    return out.select("key", "tk", "class_id", "n_links", (place == F.col("rep")).alias("first"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near copies: one row of each class, the one with the smallest key, stays as it is."""
    found = settle(classes(docs, key=key, text=text, **options))
    firsts = found.where("first").groupBy(F.col("key").alias("key_r"), F.col("tk").alias("tk_r")).agg(F.count(F.lit(1)).alias("times_r"))
    firsts = settle(firsts)
    body, tk_l, key_r, tk_r, times = free_names(docs.columns, "_body", "_tk", "_key_r", "_tk_r", "_times")
    firsts = firsts.select(F.col("key_r").alias(key_r), F.col("tk_r").alias(tk_r), F.col("times_r").alias(times))
    rows = docs.withColumn(tk_l, F.unhex(F.md5(full_text(docs[f"`{text}`"]).cast("binary"))))
    rows = rows.join(firsts, rows[f"`{key}`"].eqNullSafe(firsts[key_r]) & (rows[tk_l] == firsts[tk_r]))
    once = rows.where(F.col(times) == 1)
    repeated = rows.where(F.col(times) > 1).dropDuplicates([key, tk_l])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
