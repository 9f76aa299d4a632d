"""Small document tables for the corpus operators."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use for results or on the way.
CLASHES = (
    "row", "tk", "gs", "word", "label", "item", "shard", "slot", "copy", "rate", "kept", "spans", "score", "stats", "_who", "_row", "cell",
    "key", "n", "_key", "contaminated", "n_lines", "held_out", "h", "s", "times", "distance",
)
PROSE = (
    "the quick brown fox jumps over the lazy dog while seven small birds sing in a tall green tree near our old stone house and "
    "nobody knows why they came so early this year because the winter was long and the river still carried ice toward the sea"
)


def docs(spark, rows):
    """Rows of (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], *(r[2:] or ("en", "src")), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows(long_words: int = 30_000):
    """Nulls in every column, empty and blank texts, ties, repeated rows, and one very long text."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(long_words))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (None, PROSE, "en", None), (None, None, None, None),
        (4, PROSE, "en", "a"), (4, PROSE, "en", "a"), (5, PROSE, "de", "b"), (6, long_text, "en", "b"), (7, "one", None, "b"),
        (8, "äöü ß 漢字 😀 " * 40, "de", "a"),
    ]


def odd(spark):
    return docs(spark, odd_rows())


def clashing(df):
    """The table with extra columns of names that operators use."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES if c not in df.columns})
