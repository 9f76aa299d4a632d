"""Importance resampling towards a target: hashed n-gram gains, Gumbel noise, a cutoff found inside a bracket.

Every run of 1 to ``n`` words is a feature and falls into one of ``buckets``. A bucket's gain is the scaled logarithm of
its share in the target over its share in the corpus, both counted over all texts; a document's weight adds up the gains
of its features, looked up in one array. Weight plus noise hashed from the document's id is its score, and taking the
highest scores is sampling without replacement by weight.

Where the scores are cut is found without sorting them all. A quantile sketch brackets the cutoff; exact counts of the
rows above and inside the bracket either prove that it holds the cutoff, or it is widened until they do, at last to all
scores. Only the rows inside are sorted, and the row at the missing place is the cutoff. Numbers alone come to the driver.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import numbered
from ..session import settle
from .common import free_names, full_text

BUCKETS = 10_000
#: Scores are whole numbers, this many to one unit of the logarithm.
UNIT = 1000
MIN_WORDS = 20
#: Relative accuracy of the quantile sketch, and by how many times its error the first bracket is widened.
ACCURACY, SLACK = 1000, 2
OUTSIDE_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(word: Column) -> Column:
    """A to Z in lower case and nothing else; only words beyond ASCII need the slow way."""
    slow = F.translate(word, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(slow)


def plain_words(text: Column) -> Column:
    """Runs of digits, letters A to Z in lower case, and anything beyond ASCII."""
    return F.transform(F.filter(F.split(full_text(text), OUTSIDE_WORD), lambda w: w != ""), lower_ascii)


def feature_buckets(words: Column, n: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``n`` consecutive words, repeats included."""
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")
    found = F.transform(words, bucket)
    for size in range(2, n + 1):
        found = F.concat(found, _runs_of(words, size, bucket))
    return found


def _runs_of(words: Column, size: int, bucket) -> Column:
    starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: i <= F.size(words) - (size - 1))
    return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, size), " ")))


def _bucket_counts(texts: DataFrame, text: str, n: int, buckets: int, name: str) -> DataFrame:
    found = texts.select(F.explode(feature_buckets(plain_words(texts[f"`{text}`"]), n, buckets)).alias("bucket"))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def bucket_gains(corpus: DataFrame, target: DataFrame, *, text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row for each bucket: how often both sides hold it, and its gain. Each bucket counts once more on either side."""
    spark = corpus.sparkSession
    counted = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for side, name in ((corpus, "s"), (target, "t")):
        counted = counted.join(_bucket_counts(side, text, n, buckets, name), "bucket", "left").fillna(0, [name])
    counted = settle(counted)
    total = lambda name: counted.agg(F.sum(name)).scalar().cast("double")
    more = lambda name: (F.col(name) + 1).cast("double")
    ratio = more("t") * (total("s") + buckets) / (more("s") * (total("t") + buckets))
    return settle(counted.withColumn("gain", F.floor(UNIT * F.log(ratio)).cast("bigint")))


def score(
    docs: DataFrame, gains: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 1, seed: int = 2024,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all) with ``n_words``, ``n_features``, ``weight`` and ``score``, whole numbers.

    A text without words, also null, has weight 0. Noise depends on the key alone; a null key counts as an empty one.
    """
    made = ("n_words", "n_features", "weight", "score")
    keep = [c for c in (keep or docs.columns) if c.lower() not in made]
    words, found, noise = free_names([*keep, *made], "_words", "_found", "_noise")
    # One number for each bucket, of which there is a fixed number: a constant array of the plan.
    listed = [r["gain"] for r in gains.orderBy("bucket").select("gain").collect()]
    buckets = len(listed)
    gain = F.split(F.lit(",".join(map(str, listed))), ",").cast("array<bigint>")
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[f"`{key}`"].cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    rows = docs.select(
        *[docs[f"`{c}`"] for c in keep], plain_words(docs[f"`{text}`"]).alias(words),
        F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint").alias(noise))
    rows = rows.withColumn(found, feature_buckets(F.col(words), n, buckets))
    weight = F.aggregate(found, F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.get(gain, b))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], F.size(words).cast("bigint").alias("n_words"),
        F.size(found).cast("bigint").alias("n_features"), weight.alias("weight"), (weight + F.col(noise)).alias("score"))


def bracket(
    rows: DataFrame, order: str, wanted: Column, *, accuracy: int = ACCURACY, slack: float = SLACK
) -> tuple[int, int, int, int] | None:
    """Limits of ``order`` between which the last of the wanted highest rows lies: low, high, rows above, rows wanted.

    ``wanted`` is an aggregate over all rows. The sketch only proposes; counts of the rows outside decide.
    """
    n, wanted, least, most = rows.agg(F.count(F.lit(1)), wanted, F.min(order), F.max(order)).first()
    if not wanted:
        return None
    margin = slack / accuracy
    while True:
        share = wanted / n
        at = [max(0.0, 1 - share - margin), min(1.0, 1 - share + margin)]
        low, high = rows.agg(F.percentile_approx(order, at, accuracy)).first()[0]
        low, high = (least if at[0] == 0 else low), (most if at[1] == 1 else high)
        above, inside = rows.agg(F.count_if(F.col(order) > high), F.count_if(F.col(order).between(low, high))).first()
        if above < wanted <= above + inside:
            return low, high, above, wanted
        margin = max(4 * margin, 1 / accuracy)


def draw(
    scored: DataFrame, *, share: tuple[int, int] = (10, 100), min_words: int = MIN_WORDS, key: str = "doc_id",
    accuracy: int = ACCURACY, slack: float = SLACK,
) -> DataFrame:
    """All rows with ``rank``: 1, 2, ... for those drawn, by falling score and rising key, else null.

    Of the rows with ``min_words`` words or more, ``share`` (a numerator and a denominator, rounded down) is drawn.
    Null keys come last among equal scores; rows that share score and key follow their number of features. Shorter
    rows, and all rows where the share comes to none, keep a null rank. An empty table gives an empty table.

    Rows above the bracket are drawn whatever their order, rows below are not; those inside are numbered, and the first
    of them that make up the number are drawn. Rows above are numbered among themselves only to give their ranks.
    """
    scored = settle(scored)
    columns = [c for c in scored.columns if c.lower() != "rank"]
    can = F.col("n_words") >= min_words
    up, down = share
    limits = bracket(scored.where(can), "score", F.floor(F.count(F.lit(1)) * up / down).cast("bigint"), accuracy=accuracy, slack=slack)

    def rest(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast("bigint").alias("rank"))

    if limits is None:
        return rest(scored)
    low, high, above, wanted = limits

    def ranked(rows: DataFrame, before: int) -> DataFrame:
        # Inside a struct no column of the input can meet a name that numbering uses.
        own = rows.select(
            F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), (-F.col("score")).alias("order"),
            F.struct(F.col(f"`{key}`").isNull().alias("late"), F.col(f"`{key}`").alias("key"), "n_features").alias("tie"))
        at = before + F.col("place")
        return numbered(own, [], "order", "tie", "place").select(
            *[F.col("own").getField(c).alias(c) for c in columns], F.when(at <= wanted, at).alias("rank"))

    inside = ranked(scored.where(can & F.col("score").between(low, high)), above)
    return rest(scored.where(~can | (F.col("score") < low))).unionByName(inside).unionByName(
        ranked(scored.where(can & (F.col("score") > high)), 0))


def resample(
    docs: DataFrame, target: DataFrame, *, share: tuple[int, int] = (10, 100), min_words: int = MIN_WORDS, n: int = 1,
    buckets: int = BUCKETS, key: str = "doc_id", text: str = "text", seed: int = 2024, keep: list[str] | None = None,
) -> DataFrame:
    """Score ``docs`` by their likeness to ``target`` and draw a share of them: see ``score`` and ``draw``."""
    gains = bucket_gains(docs, target, text=text, n=n, buckets=buckets)
    return draw(score(docs, gains, key=key, text=text, n=n, seed=seed, keep=keep), share=share, min_words=min_words, key=key)
