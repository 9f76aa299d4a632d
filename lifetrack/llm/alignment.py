"""Two tokenizers held against each other: shared cuts, linked tokens, and which links the corpus prefers.

Both tokenizers split the same bytes. Where a token of both ends, the text is cut into groups; an A token and a B token
whose bytes overlap are linked. How often a pair is linked in the corpus is counted outside memory:

1. Each task encodes its texts and collects pair-document records. As soon as it holds ``RECORDS`` links, it sorts them by
   pair and document, cuts them by radix of the B id, and writes each part as a run of zstd frames; a run belongs to the
   at most 65,536 documents it was made of.
2. The runs of a radix are dealt to slices of bounded size, so that a pair that nearly every document holds is spread over
   as many tasks as it needs. A k-way heap merge reads the frames of a slice in order and adds up each pair; the counts
   are runs themselves, merged in the same way until each radix has one.
3. Pairs stand in the order of the B id, so its largest count is known as soon as its pairs are read. Each slice streams
   its records once more past the counts and adds up, for each document of a run, what its links are worth; the parts of
   a run are then added to one another and meet its documents.

Runs and counts are tables in the shared folder; a task holds one slice, and of each run in it one frame unpacked.

Texts are encoded piecewise: no token of either side reaches across the cuts of ``CUT`` (see ``Pair``), so each distinct
piece is encoded and aligned once per task, as long as the task's memory of pieces (``PIECES``) holds it.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..session import settle

RADIXES = 32
#: Links that a task collects before it writes a run, pieces it remembers, characters it encodes at a time.
RECORDS, PIECES, BATCH_CHARS = 2_000_000, 250_000, 1_000_000
#: Records of a frame; bytes of the runs that one task merges; counts merged at a time.
FRAME, SLICE_BYTES, FAN_IN = 4096, 16 << 20, 16
#: Runs are streamed past the counts in slices of so many times the counts' size at least, so counts are not copied often.
COUNTS_RATIO = 4
#: Places that tokens of neither side reach across: before a single space that follows no space, and after a single line
#: feed between other characters.
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S\n)(?=\S)")
#: The pattern by which byte-level vocabularies split texts, and the first character whose class in it may depend on the
#: Unicode version.
BYTE_LEVEL, UNSETTLED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", "\u0250"
HEAD = struct.Struct("<IIQ")


def vocabulary_files() -> tuple[str, str]:
    """Where the public vocabularies of sides A and B are on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers of a worker, with the bytes of each of their entries.

    ``cut`` splits a text into pieces that can be encoded one by one. Side A first splits by a pattern whose matches hold
    white space only at their beginning, or nothing else: none reaches across a place between another character and a
    space that another character follows, nor across one after a single line feed between other characters. Side B marks
    spaces as U+2581; if no entry has that mark after another character, and none has a line feed, no entry reaches across
    those places either. Vocabularies for which this does not hold are given whole texts.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        n_a = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(letters[c] for c in self.a.id_to_token(i)) for i in range(n_a)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.feed = self.b.encode("\n")
        self.quick = _ranked(a_path, self.a_bytes)
        whole = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        apart = all("▁" not in p.lstrip("▁") and "\n" not in p for p in whole) and len(self.feed) == 2
        self.apart = apart

    def cut(self, text: str) -> list[str]:
        """A space and the text, in pieces."""
        if not self.apart:
            return [" " + text]
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        if len(words) == gaps + 1 and sum(map(len, words)) + gaps == len(text) and "\0" not in text:
            # All white space is single spaces and line feeds between words: every one of them is a cut.
            return (" " + text.replace(" ", "\0 ").replace("\n", "\n\0")).split("\0")
        return CUT.split(" " + text)

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides. A piece that begins with a space stands for its text after the space that side B adds itself."""
        slow = pieces if self.quick is None else [p for p in pieces if max(p) >= UNSETTLED]
        encoded = iter(self.a.encode_batch_fast(slow, add_special_tokens=False))
        a = [self.quick(p) if self.quick and max(p) < UNSETTLED else next(encoded).ids for p in pieces]
        spaced = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        b = [ids if p[0] == " " else ids[len(self.feed):] for p, ids in zip(pieces, spaced)]
        return a, b


def _ranked(a_path: str, entries: list[bytes]):
    """A quicker encoder of the same vocabulary, or None where it would not be the same.

    Where ids follow the merges, in order, merging by the least id is merging by the first rule that applies. Both split by
    the same pattern, but may know different versions of Unicode: it is used below ``UNSETTLED`` only.
    """
    import tiktoken

    with open(a_path, encoding="utf-8") as file:
        given = json.load(file)
    model, split = given["model"], given["pre_tokenizer"]
    special = {t["content"] for t in given.get("added_tokens", [])}
    letters = {i for i, x in enumerate(entries) if len(x) == 1}
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    same = (
        model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and given["normalizer"] is None
        and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        and made == list(range(len(letters), len(letters) + len(made))) and letters == set(range(256)))
    if not same:
        return None
    ranks = {entries[i]: i for name, i in model["vocab"].items() if name not in special}
    return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pieces:
    """What is known of each piece: counts of tokens and groups, its links, its groups as text."""

    def __init__(self, pair: Pair, radixes: int):
        self.pair = pair
        self.wide = -(-len(pair.b_bytes) // radixes)
        b = np.arange(len(pair.b_bytes), dtype=np.int64)
        #: B ids in the order of radix and id: pairs sorted by it are sorted by radix, then side-major.
        self.b_order = (b % radixes) * self.wide + b // radixes
        self.names = [f"{i}{end}" for n in (len(pair.a_bytes), len(pair.b_bytes)) for end in ",|;" for i in range(n)]
        self.at: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, whether the bytes are right
        self.starts, self.links, self.used = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def keep(self, most: int) -> None:
        """Forget all but the ``most`` pieces met most often, of late above all."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[:most])
        names = list(self.at)
        links, n = self.linked(kept)
        self.at = {names[i]: at for at, i in enumerate(kept.tolist())}
        self.texts = [self.texts[i] for i in kept.tolist()]
        self.counts, self.used = self.counts[kept], self.used[kept] // 2
        self.starts, self.links = np.concatenate([[0], np.cumsum(n)]), links

    def learn(self, pieces: list[str]) -> None:
        a, b = self.pair.encode(pieces)
        right = []
        for p, i, j in zip(pieces, a, b):
            octets = p.encode()
            right.append(b"".join([self.pair.a_bytes[x] for x in i]) == octets == b"".join([self.pair.b_bytes[x] for x in j]))
        none: list[int] = []
        a, b = [x if ok else none for x, ok in zip(a, right)], [x if ok else none for x, ok in zip(b, right)]
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        ids_a, ids_b = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.pair.a_sizes[ids_a]), np.cumsum(self.pair.b_sizes[ids_b])
        edges = np.union1d(ends_a, ends_b)
        link_a, link_b = np.searchsorted(ends_a, edges), np.searchsorted(ends_b, edges)
        shared = np.intersect1d(ends_a, ends_b)
        # Pieces end where their last token ends, on either side.
        upto = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        n_groups = np.diff(np.searchsorted(shared, upto, "right"), prepend=0)
        links = self.b_order[ids_b[link_b]] * len(self.pair.a_bytes) + ids_a[link_a]
        last = np.searchsorted(edges, upto, "right")
        # Groups as text: A tokens of a group, then its B tokens, each with what follows it.
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        name_a = ids_a + len(self.pair.a_bytes) * (shared[group_a] == ends_a)
        name_b = 3 * len(self.pair.a_bytes) + ids_b + 2 * len(self.pair.b_bytes) * (shared[group_b] == ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = [self.names[i] for i in np.concatenate([name_a, name_b])[order].tolist()]
        stops = np.cumsum(n_a + n_b).tolist()
        first = len(self.texts)
        self.texts.extend("".join(written[i:j]) for i, j in zip([0, *stops], stops))
        self.at.update(zip(pieces, range(first, first + len(pieces))))
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, np.array(right, np.int64)], 1)])
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int64)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + last])
        self.links = np.concatenate([self.links, links])

    def linked(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of the pieces one after another, and how many each has."""
        n = self.starts[at + 1] - self.starts[at]
        before = np.cumsum(n) - n
        return self.links[np.repeat(self.starts[at] - before, n) + np.arange(n.sum())], n


# Runs: frames of records sorted by pair ----------------------------------------------------------------------------


def pack(pairs: np.ndarray, *columns: np.ndarray) -> bytes:
    """A run: frames of up to ``FRAME`` records, each with its size and its first pair in front."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    out = []
    for i in range(0, len(pairs), FRAME):
        part = pairs[i:i + FRAME]
        steps = np.diff(part, prepend=part[0]).astype(np.uint32)
        octets = squeeze(steps.tobytes() + b"".join(c[i:i + FRAME].tobytes() for c in columns))
        out += [HEAD.pack(len(part), len(octets), int(part[0])), octets]
    return b"".join(out)


class Frames:
    """A run read frame by frame; ``kinds`` are the types of the columns beside the pair."""

    def __init__(self, run: bytes, kinds: tuple):
        self.run, self.kinds, self.at = memoryview(run), kinds, 0
        self.unpack = zstandard.ZstdDecompressor().decompress

    def first(self) -> int | None:
        """The first pair of the next frame."""
        return HEAD.unpack_from(self.run, self.at)[2] if self.at < len(self.run) else None

    def next(self) -> list[np.ndarray]:
        n, size, first = HEAD.unpack_from(self.run, self.at)
        start = self.at + HEAD.size
        octets, self.at = self.unpack(self.run[start:start + size]), start + size
        out, place = [first + np.cumsum(np.frombuffer(octets, np.uint32, n).astype(np.int64))], 4 * n
        for kind in self.kinds:
            out.append(np.frombuffer(octets, kind, n, place))
            place += out[-1].nbytes
        return out

    def __iter__(self) -> Iterator[list[np.ndarray]]:
        while self.first() is not None:
            yield self.next()


RECORD, COUNT = (np.uint16, np.uint32), (np.int64,)


def merged(runs: list[bytes], kinds: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs with their sums, in order, each once: a k-way merge by a heap of the runs' next frames.

    Frames are opened in the order of their first pair. Whatever lies before the first pair of the next one is complete;
    it is added up once at least half of what is open can be complete. The number is the last column of a record.
    """
    readers = [Frames(run, kinds) for run in runs]
    heap = [(r.first(), i) for i, r in enumerate(readers) if r.first() is not None]
    heapq.heapify(heap)
    pairs, sums, held, left = [], [], 0, 0
    while heap:
        _, i = heapq.heappop(heap)
        frame = readers[i].next()
        pairs.append(frame[0])
        sums.append(frame[-1].astype(np.int64))
        held += len(frame[0])
        if readers[i].first() is not None:
            heapq.heappush(heap, (readers[i].first(), i))
        if not heap or held >= max(2 * left, 16 * FRAME):
            p, n = np.concatenate(pairs), np.concatenate(sums)
            order = np.argsort(p, kind="stable")
            p, n = p[order], n[order]
            new = np.flatnonzero(np.diff(p, prepend=-1))
            p, n = p[new], np.add.reduceat(n, new)
            done = np.searchsorted(p, heap[0][0]) if heap else len(p)
            if done:
                yield p[:done], n[:done]
            pairs, sums = [p[done:]], [n[done:]]
            held = left = len(p) - done


def _merge_tasks(kinds: tuple):
    def merge(key, rows):
        parts = list(merged([r.as_py() for r in rows.column("run_bytes")], kinds))
        run = pack(np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts]))
        return pa.table({"radix": [key[0].as_py()], "slice": [key[1].as_py()], "run_bytes": [run]}, schema=_COUNTS)

    return merge


_COUNTS = pa.schema([("radix", pa.int32()), ("slice", pa.int64()), ("run_bytes", pa.binary())])
_COUNTS_DDL = "radix int, slice bigint, run_bytes binary"


def _counts(runs: DataFrame, slice_bytes: int) -> DataFrame:
    """One run of counts for each radix."""
    sizes = settle(runs.groupBy("radix").agg(F.ceil(F.sum(F.octet_length("run_bytes")) / slice_bytes).alias("slices")))
    level = _sliced(runs, sizes).groupBy("radix", "slice").applyInArrow(_merge_tasks(RECORD), _COUNTS_DDL)
    level, most = settle(level), sizes.agg(F.max("slices")).first()[0] or 1
    while most > 1:
        level = level.withColumn("slice", F.floor(F.col("slice") / FAN_IN))
        level = settle(level.groupBy("radix", "slice").applyInArrow(_merge_tasks(COUNT), _COUNTS_DDL))
        most = -(-most // FAN_IN)
    return level.drop("slice")


def _sliced(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs with the slice of their radix they are dealt to; ``sizes`` has a row for each radix, their number is fixed."""
    sizes = sizes.select(F.col("radix").alias("_radix"), "slices")
    rows = runs.join(F.broadcast(sizes), F.col("radix") == F.col("_radix")).select("radix", "run", "run_bytes", "slices")
    return rows.select("radix", F.pmod(F.xxhash64("run"), "slices").alias("slice"), "run", "run_bytes")


def _worth(n_a: int):
    """Contributions of one slice: for each run in it, what its documents' links are worth here."""

    def streamed(key, runs, counts):
        pairs, sums = (np.concatenate(x) for x in zip(*Frames(counts.column("run_bytes")[0].as_py(), COUNT)))
        side = np.flatnonzero(np.diff(pairs // n_a, prepend=-1))
        largest = np.repeat(np.maximum.reduceat(sums, side), np.diff(side, append=len(pairs)))
        best = (sums == largest).astype(np.int64)
        ids, values = [], []
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for run, octets in zip(runs.column("run"), runs.column("run_bytes")):
            worth = np.zeros((2, 1 << 16), np.int64)
            for pair, doc, n in Frames(octets.as_py(), RECORD):
                at = np.searchsorted(pairs, pair)
                np.add.at(worth[0], doc, n * best[at])
                np.add.at(worth[1], doc, n * sums[at])
            size = int(np.flatnonzero(worth[1])[-1]) + 1
            ids.append(run.as_py())
            values.append(squeeze(worth[:, :size].tobytes()))
        return pa.table({"run": ids, "worth": values}, schema=pa.schema([("run", pa.int64()), ("worth", pa.binary())]))

    return streamed


def _added(key, rows):
    """The parts of one run added up: a row for each of its documents."""
    total = np.zeros((2, 1 << 16), np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    for part in rows.column("worth"):
        part = np.frombuffer(unpack(part.as_py()), np.int64).reshape(2, -1)
        total[:, :part.shape[1]] += part
    docs = np.flatnonzero(total[1])
    return pa.table({
        "run": np.full(len(docs), key[0].as_py(), np.int64), "place": docs.astype(np.int32),
        "n_best": total[0][docs], "count_sum": total[1][docs]})


# Documents ------------------------------------------------------------------------------------------------------


def _encoded(files: tuple[str, str] | None, radixes: int, schema: StructType, n_keep: int, records: int, pieces: int):
    """Rows of documents, and rows of runs, of the texts of one task."""
    names = [f.name for f in schema]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(Pair(*(files or vocabulary_files())), radixes)
        n_a, task = len(known.pair.a_bytes), TaskContext.get().partitionId()
        run, docs, links = (task << 24), 0, []

        def spill() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate([k for k in links]))
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            times = np.diff(new, append=len(keys)).astype(np.uint32)
            pairs, places = keys[new] >> 16, (keys[new] & 0xFFFF).astype(np.uint16)
            radix = pairs // (n_a * known.wide)
            cuts = [*np.flatnonzero(np.diff(radix, prepend=-1)).tolist(), len(pairs)]
            parts = [pack(pairs[i:j], places[i:j], times[i:j]) for i, j in zip(cuts, cuts[1:])]
            yield _batch(schema, {
                "run": [run] * len(parts), "radix": radix[cuts[:-1]].astype(np.int32), "run_bytes": parts})

        for batch in batches:
            texts = batch.column(n_keep)
            for i, j in _portions(texts):
                whole = [x.as_py() for x in texts[i:j]]
                cut = [known.pair.cut(t) if t else [] for t in whole]
                flat = [p for ps in cut for p in ps]
                if len(known.at) > pieces:
                    known.keep(pieces // 2)
                unknown = list({p for p in flat if p not in known.at})
                for k in range(0, len(unknown), 10_000):
                    known.learn(unknown[k:k + 10_000])
                at = np.fromiter(map(known.at.__getitem__, flat), np.int64, len(flat))
                known.used += np.bincount(at, minlength=len(known.used))
                owner = np.repeat(np.arange(j - i), [len(ps) for ps in cut])
                wrong = np.zeros(j - i, bool)
                wrong[owner[known.counts[at, 3] == 0]] = True
                at, owner = at[~wrong[owner]], owner[~wrong[owner]]
                found, n = known.linked(at)
                sums = np.zeros((j - i, 4), np.int64)
                for c in range(3):
                    np.add.at(sums[:, c], owner, known.counts[at, c])
                np.add.at(sums[:, 3], owner, n)
                ends = np.searchsorted(owner, np.arange(j - i), "right").tolist()
                order = at.tolist()
                groups = ["".join([known.texts[x] for x in order[s:e]])[:-1] for s, e in zip([0, *ends], ends)]
                if docs + j - i > 1 << 16 or sum(map(len, links)) >= records:
                    if links:
                        yield from spill()
                    run, docs, links = run + 1, 0, []
                if len(found):
                    links.append((found << 16) | (docs + np.repeat(owner, n)))
                yield _batch(schema, {
                    **{names[c]: batch.column(c)[i:j] for c in range(n_keep)}, "run": [run] * (j - i),
                    "place": np.arange(docs, docs + j - i, dtype=np.int32), "n_a": sums[:, 0], "n_b": sums[:, 1],
                    "n_groups": sums[:, 2], "n_links": sums[:, 3], "groups": groups})
                docs += j - i
        if links:
            yield from spill()

    return rows


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of a batch of about ``BATCH_CHARS`` bytes, of one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= BATCH_CHARS or i - start >= 1 << 14:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _batch(schema: StructType, columns: dict) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    n = len(next(iter(columns.values())))
    arrays = []
    for field in schema:
        kind = to_arrow_type(field.dataType)
        values = columns.get(field.name)
        if values is None:
            arrays.append(pa.nulls(n, kind))
        else:
            arrays.append(values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])


def align(
    docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, files: tuple[str, str] | None = None,
    groups: Callable[[Column], Column] = lambda g: g, radixes: int = RADIXES, slice_bytes: int = SLICE_BYTES,
    records: int = RECORDS, pieces: int = PIECES,
) -> DataFrame:
    """Align both tokenizers on every whole text.

    Side A encodes a space and the text, side B the text, to which it adds the space; ``files`` are their vocabularies, a
    byte-level BPE file and a piece model with byte fallback (default: the public ones). Returns the columns ``keep``
    (default: all) with, in place of columns of those names, ``n_a`` and ``n_b`` (tokens), ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair is linked most often in the corpus of all pairs of its B id, ties included),
    ``count_sum`` (over the links, how often their pair is linked in the corpus) and ``groups``: the ids of both sides by
    group, as ``a1,a2|b1;a3|b2,b3``. ``groups`` may be given as what to keep of that text, such as a digest: it is a few
    times as long as the document, and the rows are written once before the corpus' counts are known.

    A null or empty text has no tokens, nor has one whose bytes the tokens of a side do not give back: zeros and empty
    groups. Repeated rows count each time. An empty table gives an empty table.
    """
    made = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    keep = [c for c in (keep or docs.columns) if c.lower() not in made]
    inner = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(
        *[docs[f"`{c}`"].alias(k) for c, k in zip(keep, inner)], F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("_text"))
    schema = StructType([*rows.drop("_text").schema, *StructType.fromDDL(
        "run bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, radix int, run_bytes binary")])
    for field in schema:
        field.nullable = True
    made_of = rows.mapInArrow(_encoded(files, radixes, schema, len(keep), records, pieces), schema)
    written = settle(made_of.withColumn("groups", groups(F.col("groups"))))
    runs = written.where(F.col("radix").isNotNull()).select("radix", "run", "run_bytes")
    counts = _counts(runs, slice_bytes)
    size = lambda of: of.groupBy("radix").agg(F.sum(F.octet_length("run_bytes")).alias("n"))
    wide = F.greatest(F.lit(slice_bytes), COUNTS_RATIO * F.col("m"))
    sizes = settle(size(runs).join(size(counts).withColumnsRenamed({"n": "m", "radix": "r"}), F.col("radix") == F.col("r")).select(
        "radix", F.ceil(F.col("n") / wide).alias("slices")))
    copied = counts.join(F.broadcast(sizes.withColumnRenamed("radix", "_radix")), F.col("radix") == F.col("_radix")).select(
        "radix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"), "run_bytes")
    n_a = _entries(files)
    worth = _sliced(runs, sizes).groupBy("radix", "slice").cogroup(copied.groupBy("radix", "slice")).applyInArrow(
        _worth(n_a), "run bigint, worth binary")
    worth = worth.groupBy("run").applyInArrow(_added, "run bigint, place int, n_best bigint, count_sum bigint")
    worth = worth.withColumnsRenamed({"run": "_run", "place": "_place"})
    documents = written.where(F.col("radix").isNull())
    out = documents.join(worth, (F.col("run") == F.col("_run")) & (F.col("place") == F.col("_place")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select(
        *[F.col(k).alias(c) for k, c in zip(inner, keep)], "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")


def _entries(files: tuple[str, str] | None) -> int:
    """How many entries side A has."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file((files or vocabulary_files())[0]).get_vocab_size(with_added_tokens=True)
