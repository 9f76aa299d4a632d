"""Both tokenizers side by side: against whole-text encoding and a plain walk over both token lists."""

import random
from collections import Counter

import numpy as np
import pytest

from lifetrack.llm import alignment
from lifetrack.llm.queries import QUERIES

from .tables import PROSE, clashing, docs, odd, odd_rows


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.vocabulary_files())


def walked(pair, text):
    """Tokens, groups and links of one text, by two fingers on the two token lists."""
    octets = (" " + (text or "")).encode()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = pair.b.encode(text) if text else []
    if not text or b"".join(pair.a_bytes[i] for i in a) != octets or b"".join(pair.b_bytes[i] for i in b) != octets:
        return 0, 0, [], ""
    links, groups, i, j = [], [], 0, 0
    end_a, end_b, start_a, start_b = len(pair.a_bytes[a[0]]), len(pair.b_bytes[b[0]]), 0, 0
    while True:
        links.append((a[i], b[j]))
        if end_a == end_b:
            groups.append(",".join(map(str, a[start_a:i + 1])) + "|" + ",".join(map(str, b[start_b:j + 1])))
            start_a, start_b = i + 1, j + 1
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and i + 1 == len(a):
            return len(a), len(b), links, ";".join(groups)
        if step_a:
            i, end_a = i + 1, end_a + len(pair.a_bytes[a[i + 1]])
        if step_b:
            j, end_b = j + 1, end_b + len(pair.b_bytes[b[j + 1]])


def expected(pair, texts):
    found = [walked(pair, t) for t in texts]
    corpus = Counter(link for f in found for link in f[2])
    best = {}
    for (_, b), n in corpus.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (n_a, n_b, groups.count(";") + bool(groups), len(links), sum(corpus[x] == best[x[1]] for x in links), sum(corpus[x] for x in links), groups)
        for n_a, n_b, links, groups in found]


def strange_texts(seed, n=150):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "᠎", "\x1c", "\x85", " ", "▁", "</s>", "<s>", "<|endoftext|>", "<0x41>",
            "'s", "don't", "é", "é", "漢字", "😀", "﻿", "1234567", "a", "The", "ing", "ﬁ", "İ", "\x00", "...", "!?", "_x", "#"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_pieces_are_encoded_as_in_their_text(pair):
    for text in strange_texts(1, 3000) + [PROSE, PROSE.replace(" ", "\n")]:
        pieces = pair.cut(text)
        assert pieces == alignment.CUT.split(" " + text)
        a, b = pair.encode(pieces)
        assert [i for x in a for i in x] == pair.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        # A mark that stands in the text itself is a space to side B: its bytes are wrong in any case.
        assert "▁" in text or [i for x in b for i in x] == pair.b.encode(text), repr(text)


def test_the_quick_encoder_is_the_same(pair):
    """On every entry, and on all short strings of settled characters between letters and spaces."""
    entries = [x.decode() for x in pair.a_bytes if x.decode("utf-8", "replace").encode() == x]
    settled = [chr(i) for i in range(ord(alignment.UNSETTLED))]
    rng = random.Random(9)
    mixed = ["".join(rng.choice(settled) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    mixed += [x + y + z for x in settled for y in ("", " ", "a") for z in ("b", " ", "1")]
    for texts in (entries, mixed):
        slow = pair.a.encode_batch_fast(texts, add_special_tokens=False)
        assert [pair.quick(t) for t in texts] == [e.ids for e in slow]


@pytest.mark.parametrize("limits", [{}, {"records": 500, "slice_bytes": 300, "pieces": 40, "radixes": 3}])
def test_alignment_equals_a_plain_walk(spark, pair, limits, monkeypatch):
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    texts = [r[1] for r in odd_rows(3000)] + strange_texts(2) + [PROSE] * 40 + [PROSE.upper(), "word" * 5000, "\n".join([PROSE] * 30)]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df, keep=["doc_id"], **limits).collect()}
    assert [got[i] for i in range(len(texts))] == expected(pair, texts)


def test_merging_frames_keeps_order_and_sums(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 7)
    rng = np.random.default_rng(3)
    runs, total = [], Counter()
    for _ in range(20):
        pairs = np.sort(rng.integers(0, 400, rng.integers(1, 200))) * 10**7
        n = rng.integers(1, 9, len(pairs)).astype(np.uint32)
        for p, x in zip(pairs.tolist(), n.tolist()):
            total[p] += x
        runs.append(alignment.pack(pairs, np.zeros(len(pairs), np.uint16), n))
    blocks = list(alignment.merged(runs, alignment.RECORD))
    pairs, sums = (np.concatenate(x).tolist() for x in zip(*blocks))
    assert pairs == sorted(set(pairs)) and dict(zip(pairs, sums)) == dict(total)


def test_odd_rows_and_clashing_names(spark):
    out = alignment.align(clashing(odd(spark)))
    assert out.count() == len(odd_rows())
    assert {"n", "score", "_key", "doc_id", "text", "groups"} <= set(out.columns)
    none = odd(spark).limit(0)
    assert alignment.align(none).count() == 0
    silent = alignment.align(docs(spark, [(1, None, "en", "a"), (2, "", "en", "a")])).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert {tuple(r) for r in silent.collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_query_has_the_columns_of_its_contract(spark):
    out = QUERIES["op11_spilled_alignment"](spark, "/root/testdata/sf0.001")
    kinds = dict(out.dtypes)
    assert kinds.pop("groups_sha256") == "string"
    assert kinds == dict.fromkeys(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"], "bigint")
