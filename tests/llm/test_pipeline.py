"""The pipeline's stages, one by one and together."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from lifetrack.llm import decontamination, jaccard, neighbours, sharding
from lifetrack.session import settle

from .tables import docs, odd_rows
from .test_free import plain_classes, plain_tiles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    df, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        df = settle(stage(spark, df, FOLDER))
        out.append(df)
    return out


def test_columns(results):
    for df in results[:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    assert results[-1].columns == [*corpus_pipeline.COLUMNS, "shard", "slot"]


def test_clean_documents_stay(spark, results):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r.doc_id for r in results[0].collect()}
    good = [i in left for i, y in labels.items() if y == 1]
    assert sum(good) / len(good) > 0.97


def test_each_decision_takes_effect(spark, results):
    quality, near, clean, mixed, dealt = results
    once = jaccard.classes(near).collect()
    assert all(r.n_links == 0 for r in once)
    assert {r.class_id for r in jaccard.classes(quality).collect()} == {r.doc_id for r in near.collect()}
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    marked = decontamination.mark(near, items).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in marked if not r.contaminated}
    assert set(r.doc_id for r in mixed.collect()) <= {r.doc_id for r in clean.collect()}
    assert Counter(r.doc_id for r in dealt.collect()) == Counter(r.doc_id for r in mixed.collect())
    sizes = Counter(r.shard for r in dealt.collect())
    assert set(sizes) <= set(range(corpus_pipeline.SHARDS)) and max(sizes.values()) - min(sizes.values()) <= 1


def plain_digest(seed, row):
    coded = lambda v: "-" if v is None else f"={v}"
    text = hashlib.md5((row[1] or "").encode()).hexdigest()
    return hashlib.md5("\x1f".join([str(seed), coded(row[0]), coded(text)]).encode()).hexdigest()


def plain_quality(spark, rows):
    """Rows whose nearest labelled neighbours, one document at a time, vote for good quality."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    train = [tuple(r) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = neighbours.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.createDataFrame(train, labels.schema))
    kept = []
    for row in rows:
        cosine = model.vectors @ model.latent([row[1] or ""])[0]
        nearest = [i for i in np.argsort(-cosine, kind="stable") if model.keys.get(row[0]) != i][: neighbours.NEIGHBOURS]
        weight = [min(1.0, max(0.0, float(cosine[i]))) ** neighbours.SHARPNESS * model.weights[i] for i in nearest]
        voted = sum(w * model.labels[i] for w, i in zip(weight, nearest))
        if (voted + 1e-9 * model.prior) / (sum(weight) + 1e-9) >= 0.5:
            kept.append(row)
    return kept


def plain_near(rows):
    return [r for r, (_, class_id, _) in zip(rows, plain_classes(rows)) if r[0] == class_id]


def plain_clean(spark, rows):
    items = [decontamination.tokens(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(t[k:k + 5]) for k in range(len(t) - 4)}

    def holds(a, b):
        return grams(a) & grams(b) and sum(n for _, _, n in plain_tiles(a, b, 5)) >= decontamination.COVERAGE * len(b)

    return [r for r in rows if not any(holds(decontamination.tokens(r[1]), b) for b in items)]


def plain_mixed(rows):
    """Each row as often as the Poisson distribution of its source's rate, inverted at its digest, says."""
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode()) + 1
    roots = sum(math.sqrt(b) for b in sizes.values())
    out = []
    for r in rows:
        rate = math.sqrt(sizes[r[3]]) / roots * sum(sizes.values()) / sizes[r[3]]
        parts = max(1, math.ceil(rate / 16))
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{plain_digest(29, r)}:{part}".encode()).hexdigest()[:13], 16) / 16**13
            p = below = math.exp(-rate / parts)
            k = 0
            while below <= u:
                out.append(r)
                k += 1
                p *= rate / parts / k
                below += p
    return out


def plain_shards(rows, shards):
    by, placed = defaultdict(list), []
    for r in rows:
        by[r[3]].append((plain_digest(17, r), r))
    for source, group in by.items():
        for rank, (h, r) in enumerate(sorted(group, key=lambda x: x[0]), 1):
            placed.append((Fraction(2 * rank - 1, 2 * len(group)), source is not None, source or "", h, r))
    n, out = len(placed), []
    for p, (*_, r) in enumerate(sorted(placed, key=lambda x: x[:4])):
        shard = p * shards // n
        out.append((*r, shard, p - (shard * n + shards - 1) // shards))
    return out


def test_stages_equal_brute_force(spark, results):
    whole = lambda df: Counter(tuple(r) for r in df.collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    steps = (
        lambda rows: plain_quality(spark, rows), plain_near, lambda rows: plain_clean(spark, rows), plain_mixed,
        lambda rows: plain_shards(rows, corpus_pipeline.SHARDS))
    for (name, _), step, got in zip(corpus_pipeline.STAGES, steps, results):
        before, rows = rows, step(rows)
        assert whole(got) == Counter(rows), name
        assert rows and Counter(r[:5] for r in rows) != Counter(before) or name == "sharding", f"{name} changes nothing"


def test_run_equals_the_stages(spark, results):
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(results[-1])


def test_odd_rows_pass_every_stage(spark):
    for table in (docs(spark, odd_rows(3000)), docs(spark, []).limit(0)):
        df = settle(table)
        for _, stage in corpus_pipeline.STAGES:
            df = settle(stage(spark, df, FOLDER))
        assert set(df.columns) == {*corpus_pipeline.COLUMNS, "shard", "slot"}
