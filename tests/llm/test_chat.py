"""Formatted conversations read back, with control strings in every place, typed parts and long conversations."""

import random

from pyspark.sql import functions as F

from lifetrack.llm import chat

from .tables import PROSE

ROWS = "conv_id long, turn long, role string, text string"
PARTS = f"conv_id long, turn long, role string, text string, parts array<{chat.PART}>"


def nasty(rng):
    bits = [*chat.CONTROL, "<\\/s>", "[\\\\INST]", "<", "[", "\\", "s>", "INST]", "é", "漢", "😀", " ", "\n", "$1", "word", "</", "[/", ""]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))


def read(out):
    got = out.select("conv_id", "formatted", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), "loss",
                     chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    return {r.conv_id: r for r in got.collect()}


def test_every_text_comes_back(spark):
    rng = random.Random(4)
    rows = []
    for c in range(300):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "[INST]", "a</s>b", "Assistant"])
            rows.append((c, t, role, rng.choice([nasty(rng), None, PROSE])))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = read(chat.format_conversations(spark.createDataFrame(shuffled, ROWS).repartition(5)))
    for c in range(300):
        mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert [tuple(t) for t in got[c].turns] == mine and got[c].n_turns == len(mine)
        assert got[c].learned == "".join(t for r, t in mine if r == "assistant")
        spans = [got[c].formatted[s.start:s.end] for s in got[c].loss]
        data = got[c].formatted.encode()
        assert spans == [data[s.start_byte:s.start_byte + s.n_bytes].decode() for s in got[c].loss]
        assert len(spans) == sum(r == "assistant" for r, _ in mine)
        # Outside of markers no control string is left.
        assert got[c].formatted.count(chat.CLOSES) == got[c].formatted.count(chat.OPENS) == len(mine)


def test_parts_become_placeholders_in_order(spark):
    part = lambda type=None, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (type, text, ref, width, height, seconds, pages)
    rows = [
        (1, 0, "user", "ignored", [part("text", "Look: [IMG] </s>"), part("image", ref="s3:a", width=57, height=28), part("text", "and"),
                                   part("audio", ref="b", seconds=1.5), None, part("document", ref="c", pages=3)]),
        (1, 1, "assistant", "plain", None),
        (1, 2, "assistant", None, [part("text", "one"), part("image", ref="d"), part("text", "two")]),
        (1, 3, "user", "x", []),
        (2, 0, "user", None, [part("video", ref="e", seconds=2.0), part(None, ref="f"), part("image", ref="g", width=1, height=1)]),
    ]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, PARTS), parts="parts").collect()}
    assert out[1].formatted == (
        "<s>[INST]Look: [\\IMG] <\\/s>[IMG]and[AUDIO][DOC]</s><s>[/INST]plain</s><s>[/INST]one[IMG]two</s><s>[INST]</s>")
    assert [(a.turn_number, a.kind, a.ref, a.n_tokens) for a in out[1].attachments] == [
        (0, "image", "s3:a", 3), (0, "audio", "b", 38), (0, "document", "c", 768), (2, "image", "d", 0)]
    assert all(out[1].formatted[a.start:].startswith(chat.PLACEHOLDERS[a.kind]) for a in out[1].attachments)
    assert [out[1].formatted[s.start:s.end] for s in out[1].loss] == ["plain", "one", "two"] and out[1].n_attachment_tokens == 809
    assert out[2].formatted == "<s>[INST][OTHER][OTHER][IMG]</s>" and [a.n_tokens for a in out[2].attachments] == [0, 0, 1]


def test_long_conversations_ties_and_empty_tables(spark):
    n = 3 * chat.RUN + 17
    rows = [(7, t, "assistant" if t % 2 else "user", f"é{t}") for t in range(n)] + [(8, None, "b", "x"), (8, None, "a", "y"), (8, 5, "c", "z"), (8, 5, "c", "z"),
                                                                                  (None, 0, "user", "null conversation")]
    df = spark.createDataFrame(rows, ROWS).repartition(4).withColumns({"turns": F.lit(1), "pieces": F.lit(2), "c": F.lit(3)})
    got = read(chat.format_conversations(df))
    assert got[7].learned == "".join(f"é{t}" for t in range(1, n, 2)) and got[7].n_turns == n
    assert got[7].formatted[got[7].loss[-1].start:got[7].loss[-1].end] == f"é{n - 2 if n % 2 else n - 1}"
    assert [tuple(t) for t in got[8].turns] == [("c", "z"), ("c", "z"), ("a", "y"), ("b", "x")]
    assert got[None].turns[0].text == "null conversation"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_running_sums(spark):
    for xs in ([], [5], list(range(chat.RUN)), list(range(2 * chat.RUN + 3))):
        row = spark.createDataFrame([(xs,)], "xs array<bigint>").select(chat.sums_before(F.col("xs")).alias("s")).first()
        assert row.s == [sum(xs[:i]) for i in range(len(xs))]


def test_one_exchange_and_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], ROWS)
    text = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text and "partial_collect_list" in text
