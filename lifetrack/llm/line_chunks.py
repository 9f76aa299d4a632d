"""Removal of multi-line passages that recur across the corpus, cut by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import digest, free_names, full_text, let

#: Chunkings of each text, lines that the rolling hash covers, and the classes into which it sorts lines.
SEEDS = 16
WINDOW = 1
MODULUS = 2
BASE = 1_000_003
PRIME = 2_147_483_647
#: Lines with a word that a chunk must have to be removed.
MIN_LINES = 2
HAS_WORD = r"[^\x20\x09-\x0D]"
_RUNS = "cast(array() as array<struct<start:int,n:int>>)"


def bases(seeds: int) -> list[int]:
    """The base of each chunking's rolling hash."""
    return [pow(BASE, seed + 1, PRIME) for seed in range(seeds)]


def _rolling(hashes: Column, base: Column, window: int, step: int, modulus: int) -> Column:
    """Class of each line: a polynomial of its hash and those of the next ``window - 1`` lines, back or ahead; no line is 0."""

    def at(code, i):
        value = F.lit(0).cast("bigint")
        for k in reversed(range(1, window)):
            value = (value + F.coalesce(F.get(hashes, i + step * k), F.lit(0))) * base % PRIME
        return (value + code if window > 1 else code) * base % PRIME % modulus

    return F.transform(hashes, at)


def chunks(text: Column, *, seeds: int, window: int, modulus: int, min_lines: int) -> Column:
    """The different chunks of a text in all its chunkings: ``start`` line, lines ``n`` and ``hash``."""

    def limits(hashes, fresh, base):
        """First line and line after the last of each long chunk, as one number each, which Spark can hash."""

        def part(behind, ahead):
            begins = F.filter(fresh, lambda k: (k == 0) | (ahead[k] == 0) | (F.get(behind, k - 1) == 1))
            return F.filter(let(begins, lambda all_: F.transform(all_, lambda k, j: (
                F.coalesce(F.get(all_, j + 1), F.size(hashes)).cast("bigint") * (1 << 32) + k))),
                lambda c: F.shiftright(c, 32) - c.bitwiseAND((1 << 32) - 1) >= min_lines)

        behind = _rolling(hashes, base, window, -1, modulus)
        if window == 1:
            return let(behind, lambda r: part(r, r))
        return let(behind, lambda r: let(_rolling(hashes, base, window, 1, modulus), lambda s: part(r, s)))

    def cut(lines):
        worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: lines[i].rlike(HAS_WORD))

        def seeded(at):
            code = lambda i: F.conv(F.substring(F.md5(lines[i].cast("binary")), 1, 7), 16, 10).cast("bigint")
            all_ = F.array(*[F.lit(base).cast("bigint") for base in bases(seeds)])
            # No boundary lies between equal lines.
            fresh = lambda hashes: F.filter(
                F.transform(at, lambda _, k: k), lambda k: (k == 0) | (hashes[k] != F.get(hashes, k - 1)))
            found = let(F.transform(at, code), lambda hashes: let(fresh(hashes), lambda k: F.array_distinct(F.flatten(
                F.transform(all_, lambda base: limits(hashes, k, base))))))
            last = lambda c: at[F.shiftright(c, 32).cast("int") - 1]
            first = lambda c: at[c.bitwiseAND((1 << 32) - 1).cast("int")]
            return F.transform(found, lambda c: F.struct(first(c).alias("start"), (last(c) - first(c) + 1).alias("n")))

        return let(let(worded, seeded), lambda found: F.transform(found, lambda c: F.struct(
            c["start"].alias("start"), c["n"].alias("n"),
            F.xxhash64(F.array_join(F.slice(lines, c["start"] + 1, c["n"]), "\n")).alias("hash"))))

    return let(F.split(text, "\n", -1), cut)


def _identified(docs: DataFrame, key: str, text: str, who: str, body: str) -> DataFrame:
    docs = docs.withColumn(body, full_text(docs[f"`{text}`"]))
    return docs.withColumn(who, F.struct(
        docs[f"`{key}`"].alias("key"), digest("line", docs[f"`{key}`"], F.md5(F.col(body).cast("binary"))).alias("digest")))


def _copies(docs: DataFrame, who: str, body: str, runs: Column) -> DataFrame:
    """``place``, lines ``n`` and the ``first`` place of every run of lines whose bytes stand at another place too."""
    runs = docs.select(who, F.explode(runs).alias("w"))
    runs = settle(runs.select(F.struct(F.col(who), F.col("w.start").alias("start")).alias("place"), "w.n", "w.hash"))
    twice = lambda df: df.where(F.col("first") != F.col("last"))
    hashes = runs.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    hashes = settle(twice(hashes).select(F.col("hash").alias("hash_r")))
    wanted = runs.join(hashes.hint("merge"), F.col("hash") == F.col("hash_r"), "left_semi")
    wanted = wanted.groupBy(F.col("place")[who]["digest"].alias(who + "_r")).agg(
        F.collect_set(F.struct("place.start", "n", "hash")).alias("wanted"))
    wanted = settle(wanted)

    # Only the texts of runs whose hash recurs are compared; whole texts meet their places by a shuffle at every size.
    seen = docs.select(who, body).join(wanted.hint("merge"), docs[who]["digest"] == wanted[who + "_r"])
    found = let(F.split(F.col(body), "\n", -1), lambda lines: F.transform("wanted", lambda w: F.struct(
        w["start"].alias("start"), w["n"].alias("n"), w["hash"].alias("hash"),
        F.array_join(F.slice(lines, w["start"] + 1, w["n"]), "\n").alias("piece"))))
    seen = seen.select(who, F.explode(found).alias("w"))
    seen = settle(seen.select(F.struct(F.col(who), F.col("w.start").alias("start")).alias("place"), "w.n", "w.hash", "w.piece"))
    same = seen.groupBy("hash", "piece").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    same = settle(twice(same).select(F.col("hash").alias("hash_r"), F.col("piece").alias("piece_r"), "first"))
    return seen.join(same.hint("merge"), (F.col("hash") == F.col("hash_r")) & (F.col("piece") == F.col("piece_r")))


def remove_repeated(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    seeds: int = SEEDS,
    window: int = WINDOW,
    modulus: int = MODULUS,
    min_lines: int = MIN_LINES,
) -> DataFrame:
    """Drop chunks of several lines that occur elsewhere in the corpus; the first occurrence stays.

    Each text is cut in ``seeds`` ways. A rolling hash over the hashes of ``window`` lines with a word, its base the
    seed's, cuts before a line where it is 0 modulo ``modulus`` over that line and those ahead, and after a line where it
    is 1 over that line and those behind; never between equal lines. So what stands around a passage moves no boundary
    inside it. With a window of one line and two classes a line either opens or closes a chunk: two lines in a row are a
    chunk of their own in one chunking of four, whatever is around them, and a repeated pair is missed by all 16 in one
    case of a hundred. Longer passages go by the union of their chunks. Blank lines belong to a chunk only between two
    of its lines with a word.

    The different chunks of all chunkings with ``min_lines`` lines with a word are compared: first by hash, then byte by
    byte. The first occurrence is the one with the smallest key, text digest and line; null keys come first. A line goes
    if it lies in any chunk that stands earlier, and still stands at an earlier place itself. Rows with the same key and
    text are one document and get the same result.

    Returns ``keep`` (default: all columns, the text as it is left), ``n_lines``, ``n_removed_chunks`` (different ones,
    which may overlap) and ``n_removed_lines``, in place of columns of those names. What is left of a text are its other
    lines, joined by line feeds; a null or empty text stays empty.
    """
    made = ("n_lines", "n_removed_chunks", "n_removed_lines")
    keep = [c for c in (keep or docs.columns) if c.lower() not in made]
    who, body, cut, gone = free_names([*docs.columns, *made], "_who", "_body", "_cut", "_gone")
    docs = _identified(docs, key, text, who, body)
    found = chunks(F.col(body), seeds=seeds, window=window, modulus=modulus, min_lines=min_lines)
    removed = _copies(docs, who, body, found).where(F.col("place") != F.col("first"))
    removed = settle(removed.groupBy(F.col("place")[who]["digest"].alias(who + "_r")).agg(
        F.collect_set(F.struct(F.col("place.start").alias("start"), "n")).alias(gone)))

    # Texts meet their removed lines by a shuffle at every size: the table of removed lines grows with the corpus.
    passed = docs.select(*[docs[f"`{c}`"] for c in keep if c != text], who, body)
    out = passed.join(removed.hint("merge"), passed[who]["digest"] == removed[who + "_r"], "left")
    lost = F.coalesce(F.col(gone), F.expr(_RUNS))
    out = out.withColumn(cut, let(F.split(F.col(body), "\n", -1), lambda lines: let(_rest(lines, lost), lambda rest: F.struct(
        F.size(lines).alias("lines"), (F.size(lines) - F.size(rest)).alias("lost"),
        F.array_join(F.transform(rest, lambda i: lines[i]), "\n").alias("text")))))
    values = [F.col(cut)["text"].alias(c) if c == text else F.col(f"`{c}`") for c in keep]
    return out.select(
        *values, F.col(cut)["lines"].alias("n_lines"), F.size(lost).alias("n_removed_chunks"),
        F.col(cut)["lost"].alias("n_removed_lines"),
    )


def _rest(lines: Column, gone: Column) -> Column:
    """Numbers of the lines outside all removed runs, which may overlap."""
    inside = F.flatten(F.transform(gone, lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1)))
    return F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), inside)


def windows(text: Column, *, min_lines: int) -> Column:
    """Every run from a line with a word to the ``min_lines``-th such line: ``start`` line, lines ``n`` and ``hash``."""

    def cut(lines):
        worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: lines[i].rlike(HAS_WORD))

        def one(at, start, k):
            n = F.get(at, k + (min_lines - 1)) - start + 1
            return F.struct(
                start.alias("start"), n.alias("n"), F.xxhash64(F.array_join(F.slice(lines, start + 1, n), "\n")).alias("hash"))

        return let(worded, lambda at: F.transform(
            F.slice(at, 1, F.greatest(F.size(at) - (min_lines - 1), F.lit(0))), lambda start, k: one(at, start, k)))

    return let(F.split(text, "\n", -1), cut)


def remove_passages(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    min_lines: int = MIN_LINES,
) -> DataFrame:
    """Drop every line inside a run of ``min_lines`` worded lines that stands earlier in the corpus, whatever is around it.

    A chunking whose boundaries depend on the two lines beside them finds a run when it cuts before and after it; the
    runs that any such chunking can find are all runs of ``min_lines`` lines with a word (and the blank lines between
    them), so those are compared, first by hash, then byte by byte. Longer passages are unions of such runs: none is
    missed, and a single line is never enough. Order is by key (null first), text digest and line. A run that overlaps
    its first occurrence is not a repeat. Every line that goes still stands at an earlier place. Rows with the same key
    and text are one document and get the same result.

    Returns ``keep`` (default: all columns, the text as it is left), ``n_lines``, ``n_removed_runs`` (touching runs are
    one) and ``n_removed_lines``, in place of columns of those names. What is left of a text are its other lines,
    joined by line feeds; a null or empty text stays empty.
    """
    made = ("n_lines", "n_removed_runs", "n_removed_lines")
    keep = [c for c in (keep or docs.columns) if c.lower() not in made]
    who, body, cut, gone = free_names([*docs.columns, *made], "_who", "_body", "_cut", "_gone")
    docs = _identified(docs, key, text, who, body)
    removed = _copies(docs, who, body, windows(F.col(body), min_lines=min_lines))
    own = F.col("place")[who]["digest"] == F.col("first")[who]["digest"]
    removed = removed.where(~(own & (F.col("place.start") < F.col("first.start") + F.col("n"))))
    removed = removed.groupBy(F.col("place")[who]["digest"].alias(who + "_r")).agg(
        _joined(F.array_sort(F.collect_set(F.struct("place.start", "n")))).alias(gone))
    removed = settle(removed)

    passed = docs.select(*[docs[f"`{c}`"] for c in keep if c != text], who, body)
    out = passed.join(removed.hint("merge"), passed[who]["digest"] == removed[who + "_r"], "left")
    out = out.withColumn(cut, let(F.split(F.col(body), "\n", -1), lambda lines: F.struct(
        F.size(lines).alias("lines"),
        F.when(F.col(gone).isNull(), F.col(body)).otherwise(_outside(lines, F.col(gone))).alias("text"))))
    lost = F.coalesce(F.col(gone), F.expr(_RUNS))
    values = [F.col(cut)["text"].alias(c) if c == text else F.col(f"`{c}`") for c in keep]
    return out.select(
        *values, F.col(cut)["lines"].alias("n_lines"), F.size(lost).alias("n_removed_runs"),
        F.aggregate(lost, F.lit(0), lambda s, g: s + g["n"]).alias("n_removed_lines"),
    )


def _joined(runs: Column) -> Column:
    """Overlapping and touching runs as one; starts and ends both rise."""
    end = lambda r: r["start"] + r["n"]

    def join(all_):
        firsts = F.filter(all_, lambda r, i: (i == 0) | (r["start"] > end(F.get(all_, i - 1))))
        lasts = F.filter(all_, lambda r, i: (i == F.size(all_) - 1) | (F.get(all_, i + 1)["start"] > end(r)))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["start"].alias("start"), (end(b) - a["start"]).alias("n")))

    return let(runs, join)


def _outside(lines: Column, gone: Column) -> Column:
    """The lines outside the removed runs, which are in order and apart."""
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get(gone, k - 1)["start"] + F.get(gone, k - 1)["n"])
    starts = F.concat(F.transform(gone, lambda r: r["start"]), F.array(F.size(lines)))
    parts = F.transform(starts, lambda start, k: F.slice(lines, begin(k) + 1, start - begin(k)))
    return F.array_join(F.flatten(parts), "\n")
