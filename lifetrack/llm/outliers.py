"""Quality rules by robust multivariate outliers: a minimum-covariance-determinant estimate per language and source."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .common import free_names, full_text, let, words

SYMBOLS = "#*$%&|<>"
#: The statistics after their transform, and the spread in each that is too small to mean anything: a document is
#: never an outlier for differences of about this size, also where most documents of a group have the same value.
FEATURES = {
    "x_words": (lambda c: F.log1p(c["n_words"]), 0.5),
    "x_length": (lambda c: F.log((1 + c["word_chars"]) / (1 + c["n_words"])), 0.15),
    "x_symbols": (lambda c: F.log1p(100 * c["n_symbols"] / (1 + c["word_chars"])), 0.25),
    "x_lines": (lambda c: F.log1p(100 * c["n_dup_lines"] / (1 + c["n_lines"])), 1.0),
    "x_repeats": (lambda c: F.log1p(100 * c["n_repeat_words"] / (1 + c["n_words"])), 0.5),
    "x_capitals": (lambda c: F.log1p(100 * c["n_capitals"] / (1 + c["word_chars"])), 0.35),
}
NAMES = list(FEATURES)
P = len(NAMES)
PAIRS = list(combinations_with_replacement(range(P), 2))
#: Share of a group that its estimate rests on.
SUPPORT = 0.75
#: Concentration steps at most; they stop earlier when no determinant moves.
STEPS = 12
#: Steps of the distance grid for each doubling.
GRID = 16
#: A smaller group is judged with its language, a smaller language with the corpus.
MIN_ROWS = 100
#: Up to this many groups (of about 60 numbers, 10 MB in all) their estimates are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 20_000
#: Chance that a row of a normal group is rejected.
TAIL = 1e-12


def _chi2_cdf(x: float, df: int) -> float:
    """Chi-squared distribution function for even degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, df // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1.0
    while _chi2_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, df) < p else (low, mid)
    return high


def _widening(share: float) -> float:
    """What the covariance of the innermost ``share`` of a normal sample is to be multiplied by."""
    return share / _chi2_cdf(chi2_quantile(share, P), P + 2)


def repeat_words(tokens: Column) -> Column:
    """Words covered by windows of three words that occur twice or more; n log n for any text.

    Windows of one text are told apart by 64-bit hashes.
    """

    def covered(s, i):
        # Each window covers up to the next one or its own three words, whichever is less.
        return F.struct(i.alias("at"), (s["n"] + F.least(i - s["at"], F.lit(3))).alias("n"))

    def twice(ordered):
        at = lambda i: F.get(ordered, i)["w"]
        places = F.transform(ordered, lambda x, i: F.when((x["w"] == at(i - 1)) | (x["w"] == at(i + 1)), x["i"]))
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(F.array_compact(places)), start, covered, lambda s: s["n"])

    def windows(w):
        hashes = F.transform(F.slice(w, 3, F.size(w)), lambda third, i: F.xxhash64(w[i], w[i + 1], third))
        placed = lambda all_: F.transform(all_, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        return let(hashes, lambda all_: F.when(
            F.size(F.array_distinct(all_)) < F.size(all_), let(F.sort_array(placed(all_)), twice)).otherwise(0))

    return F.when(F.size(tokens) < 4, 0).otherwise(let(tokens, windows)).cast("bigint")


def statistics(docs: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the statistics of each text as a struct ``stats``, read once."""
    body = full_text(docs[f"`{text}`"])
    named = free_names(keep, "stats")[0]
    only = lambda chars: F.length(F.regexp_replace(body, f"[^{chars}]+", "")).cast("bigint")
    lines = F.split(body, "\n", -1)
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("bigint")
    stats = let(words(body), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        only(SYMBOLS).alias("n_symbols"),
        dup.alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        only("A-Z").alias("n_capitals"),
    ))
    return docs.select(*[docs[f"`{c}`"] for c in keep], stats.alias(named))


def _sweep(matrix: Column) -> Column:
    """Inverse and determinant of a symmetric positive matrix (array of arrays), by Gauss-Jordan steps."""

    def step(s, k):
        pivot_row = s["m"][k]
        pivot = pivot_row[k]
        rows = F.transform(s["m"], lambda row, i: F.transform(row, lambda v, j: (
            F.when((i == k) & (j == k), 1 / pivot).when(i == k, v / pivot).when(j == k, -v / pivot)
            .otherwise(v - row[k] * pivot_row[j] / pivot))))
        return F.struct(rows.alias("m"), (s["det"] * pivot).alias("det"))

    start = F.struct(matrix.alias("m"), F.lit(1.0).alias("det"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), start, step)


def _estimate(sums: DataFrame, keys: list[str], widen: Column) -> DataFrame:
    """Centre, inverse scatter and determinant from counts and sums; ``f_j`` is the least spread of column j."""
    cols = {f"m_{j}": F.col(f"s_{j}") / F.col("n") for j in range(P)}
    with_means = sums.withColumns(cols)

    def entry(i, j):
        i, j = min(i, j), max(i, j)
        value = (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * widen
        return value + F.pow(F.col(f"f_{i}"), 2) if i == j else value

    matrix = F.array(*[F.array(*[entry(i, j) for j in range(P)]) for i in range(P)])
    swept = with_means.withColumn("swept", _sweep(matrix))
    inverse = [F.col("swept")["m"][i][j].alias(f"q_{i}_{j}") for i, j in PAIRS]
    return swept.select(*keys, *[f"f_{j}" for j in range(P)], *cols, *inverse, F.col("swept")["det"].alias("det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of the columns z_j from m_j under q_i_j."""
    gaps = [F.col(f"z_{j}") - F.col(f"m_{j}") for j in range(P)]
    terms = [gaps[i] * gaps[j] * F.col(f"q_{i}_{j}") * (1 if i == j else 2) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def _sums() -> list[Column]:
    first = [F.sum(f"z_{j}").alias(f"s_{j}") for j in range(P)]
    second = [F.sum(F.col(f"z_{i}") * F.col(f"z_{j}")).alias(f"s_{i}_{j}") for i, j in PAIRS]
    return [F.count(F.lit(1)).alias("n"), *first, *second]


def estimate(rows: DataFrame, *, support: float = SUPPORT, steps: int = STEPS, few: bool = False) -> DataFrame:
    """Robust location and scatter of the columns in ``NAMES`` for each ``cell``.

    Deterministic starts as in Hubert, Rousseeuw and Verdonck (2012), three of their six: the raw distances from the
    medians, the covariance of hyperbolic tangents, and that of spatial signs. From each, concentration steps: the
    ``support`` share nearest to the estimate gives the next one, until no determinant falls. The lowest determinant
    wins and is reweighted once. Distances are counted on a logarithmic grid, so one aggregate over the rows yields
    both the cut-off and the sums inside it; ties share a grid cell and are taken together. ``few``: there are at most
    ``BROADCAST_CELLS`` cells.
    """
    joined_with = lambda df, small: _join(df, small, few)
    # Medians and median deviations: exact for up to 10,000 rows a cell, within a ten-thousandth of the ranks beyond.
    middle = settle(rows.groupBy("cell").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"l_{j}") for j, x in enumerate(NAMES)]))
    joined = joined_with(rows, middle)
    off = [F.percentile_approx(F.abs(F.col(x) - F.col(f"l_{j}")), 0.5, 10_000).alias(f"d_{j}") for j, x in enumerate(NAMES)]
    scales = _join(middle, settle(joined.groupBy("cell").agg(*off)))
    floors = [floor for _, floor in FEATURES.values()]
    for j, floor in enumerate(floors):
        scales = scales.withColumn(f"c_{j}", F.greatest(1.4826 * F.col(f"d_{j}"), F.lit(floor))).drop(f"d_{j}")
        scales = scales.withColumn(f"f_{j}", F.lit(floor) / F.col(f"c_{j}"))
    scales = settle(scales)
    z = [((F.col(x) - F.col(f"l_{j}")) / F.col(f"c_{j}")).alias(f"z_{j}") for j, x in enumerate(NAMES)]
    f = [F.col(f"f_{j}") for j in range(P)]
    zs = joined_with(rows, scales).select("cell", *z, *f)

    norm = F.sqrt(sum([F.col(f"z_{j}") ** 2 for j in range(1, P)], F.col("z_0") ** 2))
    zero = [F.lit(0.0).alias(f"z_{j}") for j in range(P)]
    forms = (
        zero,
        [F.tanh(f"z_{j}").alias(f"z_{j}") for j in range(P)],
        [F.when(norm > 0, F.col(f"z_{j}") / norm).otherwise(0.0).alias(f"z_{j}") for j in range(P)],
    )
    fs = [f"f_{j}" for j in range(P)]
    current = None
    for number, form in enumerate(forms):
        shaped = zs.select("cell", *fs, *form)
        one = _estimate(shaped.groupBy("cell", *fs).agg(*_sums()), ["cell"], F.lit(1.0)).withColumn("start", F.lit(number))
        if number == 0:  # equal spread in every direction
            one = one.withColumns({f"q_{i}_{j}": F.lit(float(i == j)) for i, j in PAIRS})
        one = one.withColumns({f"m_{j}": F.lit(0.0) for j in range(P)})
        current = one if current is None else current.unionByName(one)
    current = settle(current)

    widen, before = F.lit(_widening(support)), None
    for _ in range(steps):
        graded = joined_with(zs.drop(*fs), current)
        grade = F.floor(GRID * F.log2(_distance() + 1e-6)).alias("grade")
        graded = graded.select("cell", "start", *fs, *[f"z_{j}" for j in range(P)], grade)
        counted = graded.groupBy("cell", "start", *fs, "grade").agg(*_sums())
        all_ = Window.partitionBy("cell", "start")
        nearer = F.coalesce(F.sum("n").over(all_.orderBy("grade").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = counted.withColumns({"nearer": nearer, "whole": F.sum("n").over(all_)})
        inner = inner.where(F.col("nearer") < F.ceil(F.col("whole") * support))
        sums = [c for c in counted.columns if c == "n" or c.startswith("s_")]
        inner = inner.groupBy("cell", "start", *fs).agg(*[F.sum(c).alias(c) for c in sums])
        current = settle(_estimate(inner, ["cell", "start"], widen))
        now = current.agg(F.sum(F.round(F.log(F.greatest("det", F.lit(1e-300))), 6))).first()[0]
        if now == before:
            break
        before = now
    best = current.groupBy("cell").agg(F.min_by(F.struct(*[c for c in current.columns if c != "cell"]), F.struct("det", "start")).alias("b"))
    best = settle(best.select("cell", "b.*"))

    near = joined_with(zs.drop(*fs), best).where(_distance() <= chi2_quantile(0.975, P))
    near = near.groupBy("cell", *fs).agg(*_sums())
    final = _estimate(near, ["cell"], F.lit(_widening(0.975)))
    return settle(_join(scales.drop(*fs), final.drop(*fs)))


def _join(rows: DataFrame, small: DataFrame, few: bool = False) -> DataFrame:
    """Rows with a settled table of one row (or one per start) for each cell.

    A few cells are broadcast; many are joined by a shuffle, where Spark splits hot cells.
    """
    other = small.withColumnRenamed("cell", "cell_r")
    other = F.broadcast(other) if few else other
    return rows.join(other, F.col("cell") == F.col("cell_r")).drop("cell_r")


def judge(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    keep: list[str] = ("doc_id",),
    failed=None,
    min_rows: int = MIN_ROWS,
    tail: float = TAIL,
    support: float = SUPPORT,
) -> DataFrame:
    """Statistics of each text, whether a plain rule fails it, and whether it is an outlier of its group.

    The transformed statistics of the texts that pass the plain rule ``failed`` (a column over ``stats``; default
    none) are described by a robust centre and scatter for each language and source. A text is kept if its squared
    Mahalanobis distance is below the point that a normal group exceeds with probability ``tail``. Groups under
    ``min_rows`` are judged by the estimate of their whole language, languages under it by that of all rows, and a
    smaller table by the plain rule alone (``distance`` is null).

    Returns ``keep``, ``stats`` (a struct), ``base_failed``, ``distance`` and ``kept``. Null languages and sources are
    groups of their own; null and empty texts have zero statistics. Repeated rows count each.
    """
    keep = list(keep)
    own, src = free_names([*keep, "stats", "base_failed", "distance", "kept", "cell"], "_lang", "_source")
    coded = lambda c: F.coalesce(F.concat(F.lit("="), docs[f"`{c}`"].cast("string")), F.lit("-"))
    rows = statistics(docs.withColumns({own: coded(lang), src: coded(source)}), text=text, keep=[*keep, own, src])
    rows = settle(rows.withColumn("base_failed", F.lit(False) if failed is None else failed(F.col("stats"))))

    usable = rows.where(~F.col("base_failed"))
    sized = usable.groupBy(own, src).agg(F.count(F.lit(1)).alias("n"))
    sized = settle(sized.withColumns({
        "by_lang": F.sum("n").over(Window.partitionBy(own)), "all": F.lit(usable.count()),
    }))
    level = F.when(F.col("n") >= min_rows, 0).when(F.col("by_lang") >= min_rows, 1).when(F.col("all") >= min_rows, 2)
    names = [F.concat_ws("\x1f", F.lit("0"), own, src), F.concat_ws("\x1f", F.lit("1"), own), F.lit("2")]
    cells = sized.select(own, src, level.alias("level"))
    cells = cells.withColumn("cell", F.when(F.col("level") == 0, names[0]).when(F.col("level") == 1, names[1]).when(F.col("level") == 2, names[2]))
    cells = settle(cells)
    judged_by = cells.where("cell is not null").select("cell").distinct()
    # A row counts in every cell that judges some row: its own group, and its language or the corpus where needed.
    feature = [build(F.col("stats")).alias(name) for name, (build, _) in FEATURES.items()]
    placed = usable.select(F.explode(F.array(*names)).alias("cell"), *feature)
    placed = placed.join(judged_by.withColumnRenamed("cell", "cell_r"), F.col("cell") == F.col("cell_r"), "left_semi")
    few = judged_by.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    table = estimate(placed, support=support, few=few)

    cells = cells.join(table.withColumnRenamed("cell", "cell_r"), F.col("cell") == F.col("cell_r"), "left").drop("cell_r", "cell")
    cells = settle(cells.withColumnsRenamed({own: own + "_r", src: src + "_r"}))
    cells = F.broadcast(cells) if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else cells
    out = rows.join(cells, (F.col(own) == F.col(own + "_r")) & (F.col(src) == F.col(src + "_r")), "left")
    z = {f"z_{j}": (build(F.col("stats")) - F.col(f"l_{j}")) / F.col(f"c_{j}") for j, (build, _) in enumerate(FEATURES.values())}
    out = out.withColumns(z).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    fine = F.coalesce(F.col("distance") <= chi2_quantile(1 - tail, P), F.lit(True))
    return out.select(*[F.col(f"`{c}`") for c in keep], "stats", "base_failed", "distance", (~F.col("base_failed") & fine).alias("kept"))
