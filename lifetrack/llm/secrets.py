"""Secret scans judged by how many owners hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .common import free_names, full_text

#: Fixed names of settings that hold secrets, in either case.
NAMES = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


VALUE = "A-Za-z0-9+/_.=-"
ASSIGN = "(" + "|".join(map(_either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([""" + VALUE + "]+)"
#: kind, pattern, the group that holds the value, shortest value. The first three are the base rules, in their order;
#: ``owned`` spans are any long mixed token that only one owner has.
KINDS = (
    ("assign", ASSIGN, 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("owned", f"[{VALUE}]+", 0, 20),
)
BASE = 3
#: A cheap look that every match of a kind passes, so that most texts are read once.
HINTS = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{32}", "owned": f"[{VALUE}]{{20}}"}
#: Different characters that a token without a setting's name must have.
MIN_LETTERS = 10


def _matches(text: Column, pattern: str, group: int, hint: str) -> Column:
    """Gap before each match, its length (code points) and its value, in order."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pairs = F.zip_with(
        F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("m"), value.alias("v")),
        lambda gap, hit: F.struct(
            F.length(gap).alias("gap"), F.length(hit["m"]).alias("len"), F.length(hit["v"]).alias("vlen"),
            F.when(F.length(hit["v"]) >= 8, hit["v"]).alias("value"),
        ),
    )
    return F.when(text.rlike(hint), pairs)


def scan(
    docs: DataFrame,
    *,
    text: str = "text",
    owner: Column,
    repository: Column,
    keep: list[str] = ("doc_id",),
    max_owners: int = 1,
    max_repositories: int = 3,
) -> DataFrame:
    """Find secrets in every text and say which look live.

    A candidate value is what a base rule matches (``assign``: the value), or a token of 20 characters or more
    with a letter, a digit and 10 different characters. Over the whole corpus, the distinct owners and repositories of
    each value are counted. A value of at most ``max_owners`` owners and ``max_repositories`` repositories is
    ``live``; one that more of them hold is a copied example. Live tokens that do not end where a base span ends
    are added as spans of kind ``owned``; base spans always stay.

    Returns ``keep`` with ``spans`` (array of kind, start, end, base, live, in order; code points, end exclusive),
    one row per input row. Null and empty texts have none. A null owner or repository counts as one of its own.
    Repeated rows are scanned each, and share owner and repository.
    """
    keep = list(keep)
    row, found, own, repo = free_names([*keep, "spans"], "_row", "_found", "_own", "_repo")
    body = full_text(docs[f"`{text}`"])
    lists = []
    for number, (_, pattern, group, shortest) in enumerate(KINDS):
        hits = _matches(body, pattern, group, HINTS[KINDS[number][0]])
        lists.append(hits.alias(f"k{number}"))
    shown = docs.select(
        F.monotonically_increasing_id().alias(row), *[docs[f"`{c}`"] for c in keep],
        owner.cast("string").alias(own), repository.cast("string").alias(repo),
        F.struct(*lists).alias(found),
    )
    # Only candidates long enough matter, but gaps and lengths of all matches give the places. Runs of short matches
    # before a long one are summed here, so that the settled table holds long ones only.
    shown = shown.select(
        row, *[F.col(f"`{c}`") for c in keep], own, repo,
        F.concat(*[_placed(F.col(found)[f"k{n}"], n, kind[3]) for n, kind in enumerate(KINDS)]).alias(found),
    )
    shown = settle(shown)
    hits = shown.where(F.size(found) > 0).select(row, own, repo, F.explode(found).alias("h"))
    hits = hits.select(row, own, repo, "h.*")
    value = F.md5(F.col("value").cast("binary"))
    hits = hits.withColumn("value", value)
    owners = hits.groupBy("value", own, repo).agg(F.lit(1).alias("one"))
    text_or_null = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    owners = owners.groupBy("value").agg(
        F.count_distinct(text_or_null(own)).alias("owners"), F.count_distinct(F.struct(text_or_null(own), text_or_null(repo))).alias("repos"),
    )
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repositories)
    owners = settle(owners.select(F.col("value").alias("value_r"), live.alias("live")))
    hits = hits.join(owners, F.col("value") == F.col("value_r")).drop("value", "value_r", own, repo)
    base_ends = F.max((F.col("kind") < BASE).cast("int")).over(Window.partitionBy(row, "end"))
    hits = hits.withColumn("covered", base_ends == 1)
    hits = hits.where((F.col("kind") < BASE) | (F.col("live") & ~F.col("covered")))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    span = F.struct("start", F.col("kind").alias("place"), "end", "live")
    per_row = hits.groupBy(F.col(row).alias(row + "_r")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    spans = F.transform("spans", lambda s: F.struct(
        names[s["place"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        (s["place"] < BASE).alias("base"), s["live"].alias("live"),
    ))
    per_row = per_row.withColumn("spans", spans)
    left = shown.select(row, *[F.col(f"`{c}`") for c in keep])
    out = left.join(per_row, left[row] == per_row[row + "_r"], "left")
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,base:boolean,live:boolean>>)")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("spans", none).alias("spans"))


def _placed(hits: Column, number: int, shortest: int) -> Column:
    """The matches whose value is long enough, with start and end; one pass, growing by long matches only."""
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,value:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("all"))
    good = lambda h: (h["vlen"] >= shortest) & (_mixed(h["value"]) if number >= BASE else F.lit(True))

    def step(s, h):
        begin = s["at"] + h["gap"]
        end = begin + h["len"]
        one = F.struct(F.lit(number).alias("kind"), begin.alias("start"), end.alias("end"), h["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(good(h), F.concat(s["all"], F.array(one))).otherwise(s["all"]).alias("all"))

    return F.coalesce(F.aggregate(hits, start, step, lambda s: s["all"]), none)


def _mixed(value: Column) -> Column:
    letters = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (letters >= MIN_LETTERS)


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
