"""Gains, weights, scores and ranks in plain Python; the bracket on scores of every kind."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lifetrack.llm import resampling

from .tables import PROSE, clashing, docs, odd, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, share, min_words, n, buckets, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in features(text, n)[1]:
                side[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    scored = []
    for key, text, *_ in rows:
        words, found = features(text, n)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append((key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((r for r in scored if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = [r + (i,) for i, r in enumerate(can[:len(can) * share[0] // share[1]], 1)]
    return sorted(map(str, drawn + [r + (None,) for r in can[len(drawn):] + [r for r in scored if r[1] < min_words]]))


@pytest.mark.parametrize("n,buckets,share", [(1, 10_000, (10, 100)), (2, 97, (1, 3)), (1, 1, (1, 1))])
def test_equal_to_plain_python(spark, n, buckets, share):
    rng = random.Random(n)
    words = PROSE.split() + ["É", "École", "ÀB", "x1", "漢字", "İx"]
    rows = odd_rows(2000) + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(200)] + [(100, PROSE)] * 3
    target = [PROSE.upper(), "École x1!", None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    out = resampling.resample(docs(spark, rows), items, share=share, min_words=5, n=n, buckets=buckets, keep=["doc_id"])
    got = sorted(str((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in out.collect())
    assert got == plain(rows, target, share, 5, n, buckets)


@pytest.mark.parametrize("accuracy,slack", [(1000, 2), (3, 0.0), (50, 0.0)])
@pytest.mark.parametrize("kind", ["spread", "all equal", "two values", "one far out"])
def test_bracket_holds_the_cutoff(spark, kind, accuracy, slack):
    """A sketch too coarse, or a bracket of no width, is widened until the counts prove it."""
    make = {"spread": lambda i: i * 7919 % 1000, "all equal": lambda i: 5, "two values": lambda i: i % 2, "one far out": lambda i: -(10**9) if i == 3 else 0}[kind]
    data = [(i, 30, 1, 0, make(i)) for i in range(1000)]
    scored = spark.createDataFrame(data, "doc_id long, n_words long, n_features long, weight long, score long")
    for share in ((1, 10), (1, 1000), (999, 1000), (1, 1), (0, 1)):
        low_high = resampling.bracket(scored, "score", F.floor(F.count(F.lit(1)) * share[0] / share[1]).cast("bigint"), accuracy=accuracy, slack=slack)
        out = resampling.draw(scored, share=share, accuracy=accuracy, slack=slack)
        want = sorted(data, key=lambda r: (-r[4], r[0]))[:1000 * share[0] // share[1]]
        got = [(r.doc_id, r["rank"]) for r in out.where("rank is not null").orderBy("rank").collect()]
        assert got == [(r[0], i) for i, r in enumerate(want, 1)] and out.count() == 1000
        if low_high:
            low, high, above, wanted = low_high
            assert above == sum(r[4] > high for r in data) < wanted <= sum(r[4] >= low for r in data)


def test_odd_rows_and_clashing_names(spark):
    target = docs(spark, [(1, PROSE, "en", "a")])
    table = clashing(odd(spark)).withColumns({"_part": F.lit(1), "a.b": F.lit(2), "own": F.lit(3), "place": F.lit(4)})
    out = resampling.resample(table, target, min_words=1, share=(1, 2))
    assert out.count() == len(odd_rows()) and {"_part", "a.b", "own", "place", "_key"} <= set(out.columns)
    assert {r["a.b"] for r in out.select("`a.b`").collect()} == {2}
    empty = resampling.resample(odd(spark).limit(0), target.limit(0))
    assert empty.count() == 0 and "rank" in empty.columns
    assert {r["rank"] for r in resampling.resample(odd(spark), target.limit(0), min_words=10**6).collect()} == {None}


def test_scores_need_no_python(spark):
    target = docs(spark, [(1, PROSE, "en", "a")])
    text = resampling.score(odd(spark), resampling.bucket_gains(odd(spark), target))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
