"""Removal of long strings that occur twice, by column-wise construction over aligned pieces of many documents."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import free_names, full_text

#: Bytes of a string that must not occur twice, and of the anchors that bring its occurrences together.
LENGTH, ANCHOR = 400, 64
#: Different pieces with one anchor that a task sorts; an anchor with more is compared window by window.
LARGEST_GROUP = 20_000
#: Pieces of many anchors that a task sorts at once.
COLLECTION = 20_000

_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
NONE = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of the base and of its inverse modulo 2 to the 64, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            steps = np.ones(size, dtype=np.uint64)
            steps[1:] = _BASE
            self.up = np.cumprod(steps)
            steps[1:] = _INVERSE
            self.down = np.cumprod(steps)
        return self.up, self.down


def _prefix(data: np.ndarray, powers: _Powers) -> np.ndarray:
    up, _ = powers.upto(len(data) + 1)
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])))


def _digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic digest of each part: unlike the rolling hash, no text can be written to collide."""
    view = memoryview(data)
    parts = b"".join(blake2b(view[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), end.tolist()))
    return np.frombuffer(parts, dtype=np.uint64)


def _sliding(values: np.ndarray, width: int, func, pad) -> np.ndarray:
    """The least or largest of each ``width`` neighbours, with two running passes over blocks of that width."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    block = np.full(rows * width, pad, dtype=values.dtype)
    block[: len(values)] = values
    block = block.reshape(rows, width)
    ahead = func.accumulate(block, axis=1).ravel()
    back = func.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return func(back[:n], ahead[width - 1: width - 1 + n])


def anchors(data: np.ndarray, length: int, anchor: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of a text, their rolling hashes, and digests of the pieces around them.

    An anchor has the smallest hash in some window of ``length`` bytes. Equal windows have equal anchors at the same
    place, so occurrences of a string meet at an anchor, aligned. A piece reaches as far as such windows do. Different
    anchors with one rolling hash only meet in vain: digests and bytes of the pieces decide.
    """
    if len(data) < length:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    width = length - anchor + 1
    prefix = _prefix(data, powers)
    starts = np.arange(len(data) - anchor + 1)
    hashes = _mix((prefix[anchor:] - prefix[: len(starts)]) * powers.down[: len(starts)])
    least = _sliding(hashes, width, np.minimum, _TOP)
    side = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate((side, least, side)), width, np.maximum, np.uint64(0)) == hashes)
    begin, end = np.maximum(0, chosen - (length - anchor)), np.minimum(len(data), chosen + length)
    pieces = _mix(_digests(data, begin, end) + (chosen - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return chosen, hashes[chosen].view(np.int64), pieces.view(np.int64)


def repeated_windows(symbols: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which windows of aligned pieces occur in another piece of their group.

    ``symbols``: one row per piece, one column per place, NONE outside the text; ``group``: ascending. From the last
    column to the first, one symbol of every piece is put in front of its suffix in each round. The order of the
    suffixes then follows from the order before by one stable sort on the new symbol, and the common prefix of
    neighbours is one more than the least common prefix between their old places: the column-wise construction of a
    collection's Burrows-Wheeler transform with its common prefixes. Memory is a few numbers per piece; the columns
    before are not needed again. A suffix that shares ``length`` symbols with a neighbour begins a repeated window.
    """
    many, size = symbols.shape
    order = np.arange(many)
    common = np.zeros(many + 1, dtype=np.int32)
    starts = size - length + 1
    out = np.zeros((many, starts), dtype=bool)
    key_base = group.astype(np.int64) * (NONE + 1)
    for c in range(size - 1, -1, -1):
        symbol = symbols[order, c]
        key = key_base[order] + symbol
        if np.all(key[1:] >= key[:-1]):
            to, sorted_key = None, key
        else:
            to = np.argsort(key, kind="stable")
            sorted_key = key[to]
        old = np.arange(many) if to is None else to
        # The least common prefix between the old places of new neighbours.
        least = np.minimum.reduceat(common, old + 1)
        same = (sorted_key[1:] == sorted_key[:-1]) & (sorted_key[1:] % (NONE + 1) != NONE)
        common = np.zeros(many + 1, dtype=np.int32)
        common[1:many] = np.where(same, np.minimum(least[:-1] + 1, length), 0)
        if to is not None:
            order = order[to]
        if c < starts:
            near = common >= length
            out[order, c] = near[:-1] | near[1:]
    return out


def _sketches(docs: DataFrame, text: str, length: int, anchor: int) -> DataFrame:
    """Per row: number, text digest, anchors with place, hash and hash of the piece."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), full_text(docs[f"`{text}`"]).cast("binary").alias("body"))
    own = own.select("row", F.md5("body").alias("tk"), "body")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            lists = ([], [], [])
            for value in batch.column(2):
                data = np.frombuffer(value.as_buffer(), dtype=np.uint8)
                for to, found in zip(lists, anchors(data, length, anchor, powers)):
                    to.append(found)
            kinds = (pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[_lists(x, t) for x, t in zip(lists, kinds)]],
                names=["row", "tk", "place", "h", "s"])

    return own.mapInArrow(sketch, "row bigint, tk string, place array<int>, h array<bigint>, s array<bigint>")


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _pieces(bodies: DataFrame, length: int, anchor: int) -> DataFrame:
    """The bytes around each wanted anchor. ``bodies``: body, wanted (place, h, s, times, kinds)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [], [])
            for body, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in wanted:
                    at = w["place"]
                    begin = max(0, at - (length - anchor))
                    for to, v in zip(out, (w["h"], w["s"], w["times"], at - begin, body[begin: at + length], w["kinds"])):
                        to.append(v)
                if len(out[0]) > 5000:
                    yield _batch(out)
                    out = ([], [], [], [], [], [])
            if out[0]:
                yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, kinds)], names=["h", "s", "times", "ahead", "piece", "kinds"])

    return bodies.mapInArrow(cut, "h bigint, s bigint, times bigint, ahead int, piece binary, kinds bigint")


def _aligned(members: list[tuple], length: int, anchor: int) -> np.ndarray:
    symbols = np.full((len(members), 2 * length - anchor), NONE, dtype=np.int16)
    for i, (_, _, _, ahead, piece) in enumerate(members):
        at = length - anchor - ahead
        symbols[i, at: at + len(piece)] = np.frombuffer(piece, dtype=np.uint8)
    return np.asfortranarray(symbols)  # read by columns


def _compare(pieces: DataFrame, length: int, anchor: int) -> DataFrame:
    """Bytes of each piece, relative to its anchor, that lie in repeated windows: from, to (array of pairs)."""

    def collections(batches):
        members, now = [], None
        for batch in batches:
            for member in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if member[0] != now and len(members) >= COLLECTION:
                    yield members
                    members = []
                now = member[0]
                members.append(member)
        if members:
            yield members

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in collections(batches):
            symbols = _aligned(members, length, anchor)
            group = np.cumsum(np.concatenate(([0], [a[0] != b[0] for a, b in zip(members, members[1:])]))).astype(np.int64)
            found = repeated_windows(symbols, group, length)
            whole = np.array([m[2] > 1 for m in members])
            found[whole] = True  # windows of a piece that occurs as a whole elsewhere
            inside = (symbols[:, : found.shape[1]] != NONE) & (symbols[:, length - 1:] != NONE)
            yield _runs([m[:2] for m in members], found & inside, length, anchor)

    return pieces.mapInArrow(compared, "h bigint, s bigint, runs array<struct<a:int,b:int>>")


def _runs(names: list[tuple], found: np.ndarray, length: int, anchor: int) -> pa.RecordBatch:
    hs, ss, runs = [], [], []
    for (h, s, *_), row in zip(names, found):
        starts = np.flatnonzero(row)
        if len(starts):
            breaks = np.flatnonzero(np.diff(starts) > length)
            firsts = np.concatenate(([starts[0]], starts[breaks + 1])) - (length - anchor)
            lasts = np.concatenate((starts[breaks], [starts[-1]])) - (length - anchor) + length
            hs.append(h)
            ss.append(s)
            runs.append([{"a": int(a), "b": int(b)} for a, b in zip(firsts, lasts)])
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ss, pa.int64()), pa.array(runs, kind)], names=["h", "s", "runs"])


def _compare_windows(pieces: DataFrame, length: int, anchor: int) -> DataFrame:
    """The same for anchors with very many different pieces: every window by digest, spread over all tasks."""
    reach = length - anchor

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, s, times, ahead, piece in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                begin = np.arange(max(0, len(piece) - length + 1))
                begin = begin[begin <= ahead]
                if len(begin):
                    n = len(begin)
                    window = _digests(np.frombuffer(piece, dtype=np.uint8), begin, begin + length).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, h)), pa.array(np.full(n, s)), pa.array((begin - ahead + reach).astype(np.int32)),
                         pa.array(window), pa.array(np.full(n, times))], names=["h", "s", "at", "w", "times"])

    windows = pieces.mapInArrow(listed, "h bigint, s bigint, at int, w bigint, times bigint")
    twice = windows.groupBy("h", "at", "w").agg(F.sum("times").alias("n")).where("n > 1")
    twice = settle(twice.select(F.col("h").alias("h_r"), F.col("at").alias("at_r"), F.col("w").alias("w_r")))
    hit = windows.join(twice, (F.col("h") == F.col("h_r")) & (F.col("at") == F.col("at_r")) & (F.col("w") == F.col("w_r")))
    hit = hit.groupBy("h", "s").agg(F.collect_set("at").alias("at"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, reach + 1), dtype=bool)
            for row, places in zip(found, batch.column(2).to_pylist()):
                row[places] = True
            yield _runs(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), found, length, anchor)

    return hit.mapInArrow(gathered, "h bigint, s bigint, runs array<struct<a:int,b:int>>")


def _merged(spans: Column) -> Column:
    """Overlapping and touching spans, in order, as one."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    one = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def step(state, span):
        apart = span["start"] > state["end"]
        return F.struct(
            F.when(apart & (state["end"] >= 0), F.concat(state["done"], one(state))).otherwise(state["done"]).alias("done"),
            F.when(apart, span["start"]).otherwise(state["start"]).alias("start"),
            F.greatest(state["end"], span["end"]).alias("end"))

    start = F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return F.aggregate(spans, start, step, lambda s: F.when(s["end"] >= 0, F.concat(s["done"], one(s))).otherwise(s["done"]))


def remove_repeats(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    largest_group: int = LARGEST_GROUP,
) -> DataFrame:
    """Remove every byte inside a string of ``length`` bytes that also starts anywhere else in the corpus.

    Texts are UTF-8 bytes; matches stay inside a document, may overlap, and are judged on the input, so all
    occurrences go. Rows are documents of their own, also when repeated.

    Anchors (the smallest hash in each window) bring the occurrences of a string together at one place each, so
    only the pieces around anchors that occur twice are compared, and equal pieces once. The pieces of many anchors
    form a collection, sorted column by column; see ``repeated_windows``. An anchor with more than ``largest_group``
    different pieces is not sorted in one task: its windows are counted by digest instead, with the same result.
    All tables joined on the way grow with the corpus, so every join is a shuffle at every size.

    Returns ``keep`` (default: all columns), ``n_bytes``, ``spans`` (removed runs of bytes, end exclusive) and
    ``kept`` (the other bytes), in place of columns of those names. Null and empty texts have no bytes; an empty
    table gives an empty table.
    """
    made = ("n_bytes", "spans", "kept")
    keep = [c for c in (keep or docs.columns) if c.lower() not in made]
    sketches = settle(_sketches(docs, text, length, anchor))
    places = sketches.select("row", F.explode(F.arrays_zip("place", "h", "s")).alias("x")).select("row", "x.*")
    kinds = settle(places.groupBy("h", "s").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "place")).alias("at")))
    anchors_ = kinds.groupBy("h").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("kinds")).where("`all` > 1")
    anchors_ = settle(anchors_.select(F.col("h").alias("h_r"), "kinds"))
    kinds = settle(kinds.join(anchors_.hint("merge"), F.col("h") == F.col("h_r")).select("h", "s", "times", "at.row", "at.place", "kinds"))

    digests = sketches.select(F.col("row").alias("row_r"), "tk")
    wanted = kinds.where("kinds > 1").groupBy("row").agg(F.collect_list(F.struct("place", "h", "s", "times", "kinds")).alias("wanted"))
    wanted = wanted.join(digests.hint("merge"), F.col("row") == F.col("row_r")).select(F.col("tk").alias("tk_r"), "wanted")
    wanted = settle(wanted)
    bodies = docs.select(full_text(docs[f"`{text}`"]).cast("binary").alias("body"))
    # Copies become one text before the join: no hot digest is left that would be split and dealt once more.
    bodies = bodies.withColumn("tk", F.md5("body")).groupBy("tk").agg(F.any_value("body").alias("body"))
    bodies = bodies.join(wanted.hint("merge"), F.col("tk") == F.col("tk_r"))

    pieces = _pieces(bodies.select("body", "wanted"), length, anchor)
    large = F.col("kinds") > largest_group
    crowded = kinds.where(large).limit(1).count() > 0
    if crowded:  # both ways read the pieces: cut them once, or all texts are dealt out again for a few anchors
        pieces = settle(pieces)
    found = _compare(pieces.where(~large).drop("kinds").repartition("h").sortWithinPartitions("h"), length, anchor)
    if crowded:
        found = found.unionByName(_compare_windows(settle(pieces.where(large).drop("kinds")), length, anchor))
    # A piece that is the only one of its anchor and occurs twice is repeated as a whole.
    alone = kinds.where("kinds = 1").select("h", "s", F.lit(None).cast("array<struct<a:int,b:int>>").alias("runs"))
    found = settle(found.unionByName(alone).withColumnsRenamed({"h": "h_r", "s": "s_r"}))

    first = settle(sketches.groupBy("tk").agg(F.min("row").alias("row_r")).select("row_r"))
    once = sketches.join(first.hint("merge"), F.col("row") == F.col("row_r"), "left_semi")
    hits = once.select("tk", F.explode(F.arrays_zip("place", "h", "s")).alias("x")).select("tk", "x.*")
    hits = hits.join(found.hint("merge"), (F.col("h") == F.col("h_r")) & (F.col("s") == F.col("s_r")))
    # The ends of the text cut the reach of a whole piece; they are known when the text is.
    around = F.array(F.struct(F.lit(-(length - anchor)).alias("a"), F.lit(length).alias("b")))
    runs = F.transform(F.coalesce("runs", around), lambda r: F.struct(
        F.greatest(F.lit(0), F.col("place") + r["a"]).alias("start"), (F.col("place") + r["b"]).alias("end")))
    spans = hits.select("tk", F.explode(runs).alias("span")).groupBy("tk").agg(_merged(F.array_sort(F.collect_list("span"))).alias("spans"))
    spans = settle(spans.withColumnRenamed("tk", "tk_r"))

    body, tk, size = free_names([*keep, *made], "_body", "_tk", "_size")
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], full_text(docs[f"`{text}`"]).cast("binary").alias(body))
    rows = rows.withColumn(tk, F.md5(body))
    rows = rows.join(spans.hint("merge"), F.col(tk) == F.col("tk_r"), "left").withColumn(size, F.octet_length(body))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    clipped = F.transform(F.coalesce("spans", none), lambda s: F.struct(
        s["start"].alias("start"), F.least(s["end"], F.col(size)).alias("end")))
    rows = rows.withColumn("spans", clipped)
    left = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out")),
        lambda state, s: F.struct(s["end"].alias("at"), F.concat(
            state["out"], F.substring(F.col(body), state["at"] + 1, s["start"] - state["at"])).alias("out")),
        lambda state: F.concat(state["out"], F.substring(F.col(body), state["at"] + 1, F.col(size) - state["at"])))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], F.col(size).alias("n_bytes"), "spans",
        F.when(F.size("spans") == 0, F.col(body)).otherwise(left).alias("kept"))
