"""Suffix dedup, classifier, language model, decontamination and near copies against brute force, and odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifetrack.llm import decontamination, jaccard, lattice, neighbours, suffixes
from lifetrack.llm.graph import connected_components
from lifetrack.llm.queries import QUERIES

from .tables import PROSE, clashing, docs, odd, odd_rows

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# suffixes ----------------------------------------------------------------------------------------------------

def plain_repeats(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        lost = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                lost[i:i + length] = b"\x01" * length
        out.append((len(re.findall(b"\x01+", bytes(lost))), sum(lost), bytes(b for b, x in zip(d, lost) if not x)))
    return out


def repeat_texts(seed, size=60):
    rng = random.Random(seed)
    words = PROSE.split() + ["é", "漢字"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    passages = [make(n) for n in (8, 12, 20, 40)]
    texts = []
    for _ in range(size):
        parts = [make(rng.randrange(1, 25)) for _ in range(3)]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, 12)
            parts.insert(rng.randrange(len(parts) + 1), p[cut:] if rng.random() < 0.5 else p)
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], texts[1][:-1] + "!", "ab" * 150, "a" * 200, "xyz" * 11, "", None]
    return texts


@pytest.mark.parametrize("largest", [10_000, 1])
@pytest.mark.parametrize("length,anchor", [(40, 8), (64, 16)])
def test_repeats_equal_brute_force(spark, largest, length, anchor):
    texts = repeat_texts(length)
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = suffixes.remove_repeats(df, length=length, anchor=anchor, largest_group=largest)
    got = {r.doc_id: (len(r.spans), sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in got.collect()}
    for i, want in enumerate(plain_repeats(texts, length)):
        assert got[i] == want, (i, texts[i])


@pytest.mark.parametrize("largest", [10_000, 3, 1])
def test_texts_are_dealt_out_once_for_both_comparisons(spark, largest):
    """Anchors of many pieces were given all texts a second time: a shuffle of the corpus for a few anchors."""
    texts = repeat_texts(40)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    df = df.mapInArrow(count, df.schema)
    got = suffixes.remove_repeats(df, length=40, anchor=8, largest_group=largest).collect()
    assert seen.value == 3 * len(texts)  # sketches, pieces, result
    got = {r.doc_id: (len(r.spans), sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in got}
    assert got == dict(enumerate(plain_repeats(texts, 40)))


@pytest.mark.parametrize("largest", [10_000, 0])
def test_written_collisions_lose_nothing(spark, largest):
    """Two orders of the same letters that a polynomial modulo 2 to the 64 cannot tell apart, between equal texts."""
    parity = [bin(i).count("1") % 2 for i in range(512)]
    texts = []
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        before, after = ("".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(2))
        texts += [before + "".join("'u"[b ^ flip] for b in parity) + after for flip in (0, 1)]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = suffixes.remove_repeats(df, length=1200, anchor=64, largest_group=largest).collect()
    assert all(bytes(r.kept).decode() == texts[r.doc_id] for r in got) and len(got) == 6


def test_columnwise_construction(spark):
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 2, (60, 30)).astype(np.int16)
    symbols[40:, 10:25] = symbols[0, 10:25]
    symbols[7, 20:] = suffixes.NONE
    group = np.repeat(np.arange(6), 10)
    got = suffixes.repeated_windows(symbols, group, 6)
    for i in range(60):
        for a in range(25):
            window = symbols[i, a:a + 6]
            want = not (window == suffixes.NONE).any() and any(
                j != i and group[j] == group[i] and (symbols[j, a:a + 6] == window).all() for j in range(60))
            assert got[i, a] == want


def test_repeats_in_real_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = dict(zip(texts, plain_repeats(list(texts.values()), 400)))
    for r in QUERIES["op3_columnwise_repeats"](spark, FOLDER).collect():
        spans, lost, kept = want[r.doc_id]
        assert (r.n_spans, r.n_removed, r.kept_sha256) == (spans, lost, hashlib.sha256(kept).hexdigest())


# neighbours --------------------------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op4_neighbour_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(r.quality, got[r.doc_id]) for r in labels if got[r.doc_id].held_out]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == r.held_out for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    good = [r.predicted for y, r in held if y == 1]
    bad = [r.predicted for y, r in held if y == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for y, a in held if y for z, b in held if not z]
    assert np.mean(pairs) > 0.97


def test_a_reference_has_no_say_in_its_own_score(spark):
    rows = [(i, f"{PROSE} {i}", "en", "s") for i in range(40)]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(39)] + [(39, 0, 0)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in neighbours.score(table, neighbours.fit(table, labels)).collect()}
    assert scores[39] > 0.99  # all its neighbours are good; its own label does not count


def test_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    table = odd(spark)
    got = neighbours.score(table, neighbours.fit(table, labels)).collect()
    assert {r.score for r in got} == {0.5}


# lattice -----------------------------------------------------------------------------------------------------

def segmentations(text, pieces, bytes_):
    """The sum over all ways to cut the text, by plain recursion over characters."""
    if not text:
        return 1.0
    total = math.prod(bytes_[b] for b in text[0].encode()) * segmentations(text[1:], pieces, bytes_)
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            total += pieces[text[:n]] * segmentations(text[n:], pieces, bytes_)
    return total


@pytest.mark.parametrize("stretch", [1 << 16, 7])
def test_long_words_are_like_others(monkeypatch, stretch):
    """A word handled alone has the probability and the expected counts that it has among words of its length."""
    rng = random.Random(8)
    names = ["▁", "▁a", "a", "b", "ab", "aba", "bb", "漢", "é", "aaaaaaaa"]
    words = ["".join(rng.choice("abbaé漢😀x") for _ in range(rng.choice([1, 2, 9, 40, 300]))) for _ in range(60)] + ["a" * 400, "x" * 300]
    model, weights = lattice.Pieces.guess(names), np.array([rng.randrange(1, 5) for _ in words], float)
    monkeypatch.setattr(lattice, "LONG_WORD", 10**9)
    together, counted = model.marginals(words, weights)
    monkeypatch.setattr(lattice, "LONG_WORD", 1)
    monkeypatch.setattr(lattice, "STRETCH", stretch)
    alone, counted_alone = model.marginals(words, weights)
    assert np.allclose(together, alone, rtol=1e-10) and np.allclose(counted, counted_alone, rtol=1e-8)
    assert np.allclose(model.marginals(words)[0], alone)
    none = lattice.Pieces.guess([])
    assert np.isfinite(none.marginals(["abc" * 200])[0]).all()


def test_a_word_of_a_megabyte_takes_seconds():
    rng = random.Random(8)
    word = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    model, started = lattice.Pieces.guess(lattice.vocabulary()), time.perf_counter()
    log, counted = model.marginals([word], np.ones(1))
    assert np.isfinite(log[0]) and counted.sum() > 300_000
    assert time.perf_counter() - started < 90


def test_marginals_equal_enumeration():
    names = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "bb", "é"]
    model = lattice.Pieces.guess(names)
    by_hash = dict(zip(model.hashes.tolist(), np.exp(model.logs)))
    pieces = {p: by_hash[int(lattice._hash(np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)))] for p in names}
    words = ["a", "ab", "abab", "bbaab", "é", "éaé", "漢", "x", "abxab", "😀"]
    got, expected = model.marginals(words, np.ones(len(words)))
    for w, value in zip(words, got):
        assert math.exp(value) == pytest.approx(segmentations("▁" + w, pieces, np.exp(model.bytes_)), rel=1e-9)
    # Expected pieces spell exactly the characters there are.
    lengths = np.array([next(len(p) for p in names if lattice._hash(np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)) == h) for h in model.hashes])
    ascii_ = [w for w in words if w.isascii()]
    _, expected = model.marginals(ascii_, np.ones(len(ascii_)))
    mark_bytes = expected[-256:][128:].sum() / 3
    assert (expected[:-256] * lengths).sum() + expected[-256:][:128].sum() + mark_bytes == pytest.approx(sum(len(w) + 1 for w in ascii_))


def test_probabilities_sum_to_one():
    model = lattice.Pieces.guess(["▁", "a", "ab"]).learned(np.ones(3 + 256), 10)
    assert np.exp(model.logs).sum() + np.exp(model.bytes_).sum() + math.exp(model.end) == pytest.approx(1)


@pytest.mark.parametrize("frequent", [500_000, 10])
def test_base_score_equals_its_definition(spark, frequent):
    table = docs(spark, [r for r in odd_rows(3000)] + [(50 + i, f"Tok{i % 3} the The {i}", "en", "s") for i in range(30)])
    got = lattice.score(table, frequent=frequent).collect()
    rows = [(r.doc_id, WORD.findall((r.text or "").encode().lower())) for r in got]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter()
    for i, words in rows:
        if not held(i):
            counts.update([*words, "end"])
    total, kinds = sum(counts.values()), len(counts)
    for r, (i, words) in zip(got, rows):
        tokens = [*words, "end"]
        want = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert r.score < 0


def test_training_helps_held_out_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trained = lattice.score(table, keep=["doc_id"]).where("held_out").agg(F.sum("score")).first()[0]
    untrained = lattice.score(table, keep=["doc_id"], passes=0).where("held_out").agg(F.sum("score")).first()[0]
    assert trained > untrained


# decontamination ---------------------------------------------------------------------------------------------

def plain_tiles(a, b, length):
    marked_a, marked_b, out = set(), set(), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marked_a and j + n not in marked_b):
                    n += 1
                if n >= length and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        marked_a |= set(range(best[0], best[0] + best[2]))
        marked_b |= set(range(best[1], best[1] + best[2]))


def test_tiling_equals_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
        b = [rng.choice("abc") for _ in range(rng.randrange(0, 14))]
        assert decontamination.tile(a, b, 3) == plain_tiles(a, b, 3)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_reordered_passages_are_found(spark):
    w = ITEM.split()
    moved = " ".join([*w[10:], "between", *w[:10]])
    rows = [
        (1, f"{PROSE} {ITEM} {PROSE}", "en", "s"), (2, f"{PROSE}. {moved}", "en", "s"), (3, PROSE, "en", "s"),
        (4, " ".join(w[:9]) + " " + PROSE, "en", "s"), (5, "### ".join(x.upper() for x in w), "en", "s"),
        (6, " ".join(w[::-1]), "en", "s"), (7, None, "en", "s"),
    ]
    items = spark.createDataFrame([(10, ITEM), (11, None), (None, "too short"), (12, "other words " * 10)], "item_id long, text string")
    for bound in (200_000, 0):
        got = {r.doc_id: r for r in decontamination.mark(docs(spark, rows), items, broadcast_seeds=bound).collect()}
        assert {i for i, r in got.items() if r.contaminated} == {1, 2, 5}
        assert got[2].tiles == 2 and got[2].covered == 1.0 and got[2].item_id == 10
    left = decontamination.remove(docs(spark, rows), items).collect()
    assert {r.doc_id for r in left} == {3, 4, 6, 7}
    assert decontamination.remove(docs(spark, rows), items.limit(0)).count() == len(rows)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op8_string_tiling"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        a, found = decontamination.tokens(text), {}
        grams = {tuple(a[k:k + 5]) for k in range(len(a) - 4)}
        for j, item in items.items():
            b = decontamination.tokens(item)
            if sum(tuple(b[k:k + 5]) in grams for k in range(len(b) - 4)):
                covered = sum(n for _, _, n in decontamination.tile(a, b, 5)) / len(b)
                if covered >= decontamination.COVERAGE:
                    found[j] = covered
        assert got[i].contaminated == bool(found) and got[i].n_items == len(found)
        if found:
            assert got[i].covered == pytest.approx(max(found.values()), abs=1e-6)


# near copies -------------------------------------------------------------------------------------------------

def grams_of(text):
    words = [w for w in WORD.findall((text or "").encode().lower())]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_classes(rows):
    sets = [grams_of(r[1]) for r in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)].append(r[0])
    return [(r[0], min(low[root(i)], default=None), links[i]) for i, r in enumerate(rows)]


def near_rows(seed=0, groups=12):
    rng = random.Random(seed)
    make = lambda n: [rng.choice(PROSE.split()) + str(rng.randrange(50)) for _ in range(n)]
    rows = []
    for _ in range(groups):
        base = make(rng.randrange(20, 120))
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = make(1)[0]
            rows.append((len(rows), " ".join(words), "en", "s"))
            if rng.random() < 0.2:
                rows.append((len(rows), " ".join(words).upper(), "en", "s"))
    return rows


@pytest.mark.parametrize("block_grams", [1_500_000, 300])
def test_classes_equal_brute_force(spark, block_grams):
    rows = near_rows() + [(900 + i, *r[1:]) if r[0] is not None else r for i, r in enumerate(odd_rows(2000))]
    got = jaccard.classes(docs(spark, rows), block_grams=block_grams).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.key, r.class_id, r.n_links) for r in got), key=key) == sorted(plain_classes(rows), key=key)


def test_classes_of_real_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op10_minhash_join"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(plain_classes(rows))


def test_one_document_of_each_class_stays(spark):
    rows = near_rows(3)
    left = {r.doc_id for r in jaccard.keep_first(docs(spark, rows)).collect()}
    assert left == {c for _, c, _ in plain_classes(rows)}


def test_bands_meet_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.99), (0.5, 0.9)):
        bands, rows = jaccard.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= jaccard.MAX_HASHES


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}


# odd rows ----------------------------------------------------------------------------------------------------

def _scored(d):
    labels = d.sparkSession.createDataFrame([(4, 1), (5, 0), (6, 1), (None, 1), (8, None), (77, 0)], "doc_id long, quality int")
    return neighbours.score(d, neighbours.fit(d, labels)).withColumn("score", F.round("score", 4))


def _tiled(d):
    items = d.sparkSession.createDataFrame([(1, PROSE), (None, None), (2, "")], "item_id long, text string")
    return decontamination.mark(d, items)


FREE = {
    "suffixes": lambda d: suffixes.remove_repeats(d),
    "neighbours": _scored,
    "lattice": lambda d: lattice.score(d, pieces=["▁", "a", "▁the", "th", "e"]).withColumns({c: F.round(c, 6) for c in ("score", "base_score")}),
    "decontamination": _tiled,
    "near copies": lambda d: jaccard.keep_first(d),
}


@pytest.mark.parametrize("name", list(FREE))
def test_odd_rows(spark, name):
    run = FREE[name]
    table = odd(spark)
    got = run(table)
    if name != "near copies":
        assert got.count() == table.count()
    flat = lambda df: sorted(str([r[c] for c in got.columns]) for r in df.collect())
    plain = flat(got)
    assert flat(run(table.repartition(5))) == plain
    assert flat(run(clashing(table))) == plain
    assert run(table.limit(0)).count() == 0


def test_near_copies_of_odd_rows(spark):
    left = Counter((r.doc_id, r.text) for r in jaccard.keep_first(odd(spark)).collect())
    # Texts without words are one class, the prose another; of the repeated row one stays.
    assert {i for i, _ in left} == {1, 4, 6, 7, 8} and set(left.values()) == {1}
