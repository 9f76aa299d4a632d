"""Conversations as training text: typed content parts, a reversible template, a loss mask [native].

A row is one turn: conversation, place, role and either a text or an array of typed parts. A visitor turns each part
into a piece of text: text parts are escaped, image, audio and document parts become one placeholder each, in order,
and leave an attachment record with their reference and the number of tokens the placeholder expands to.

A turn is written as ``<s>``, a role header, the pieces, ``</s>``. Headers are ``[INST]`` for the user, ``[/INST]`` for
the assistant, ``[ROLE]name[/ROLE]`` for anyone else. Every control string inside a text gets one backslash after its
first character, one that has backslashes there already gets one more: no control string of a text survives, and taking
one backslash away again gives the text back. A control string cannot form across the edge of a text, as each begins
with a character that none of them holds again.

Edge cases: a null text is an empty one, a null role an empty name; a null part is left out; a part of unknown type is
kept as ``[OTHER]`` with its reference and no tokens. Turns follow their place, unknown places last, equal places by
role and text; repeated rows are turns of their own. A null conversation is one like any other. An empty table gives an
empty one. A conversation is one row of the result, so its text must fit a row, as Spark's strings must (2 GB).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .common import full_text, let, pick

USER, ASSISTANT, OPENS, CLOSES, NAMES, NAMED = "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
OTHER = "[OTHER]"
CONTROL = (OPENS, CLOSES, USER, ASSISTANT, NAMES, NAMED, *PLACEHOLDERS.values(), OTHER)
_ENDS = "|".join(sorted({c[1:].replace("]", "\\]") for c in CONTROL}))
PLAIN = rf"([<\[])(\\*)({_ENDS})"
ESCAPED = rf"([<\[])\\(\\*)({_ENDS})"
#: Side of an image patch in pixels, tokens of a second of sound, tokens of a page: what a placeholder expands to.
PATCH, SECOND_TOKENS, PAGE_TOKENS = 28, 25, 256
#: Running sums are taken in runs of so many numbers, then over the runs.
RUN = 256

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _tokens(part: Column) -> dict[str, Column]:
    """The tokens that a placeholder of each kind expands to; unknown measures count as none."""
    patches = lambda side: F.ceil(part[side] / PATCH)
    return {
        "image": patches("width") * patches("height"),
        "audio": F.ceil(part["seconds"] * SECOND_TOKENS),
        "document": part["pages"].cast("bigint") * PAGE_TOKENS,
    }


def text_part(text: Column) -> Column:
    """A text as the only part of its turn."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()]))


def visit(part: Column, tokens: Callable[[Column], Mapping[str, Column]] = _tokens) -> Column:
    """What becomes of one part: its piece of text, and for attachments their kind, reference and tokens."""
    kinds = tokens(part)
    is_text = part["type"] == "text"
    placeholder, count = F.lit(OTHER), F.lit(0).cast("bigint")
    for kind, mark in PLACEHOLDERS.items():
        here = part["type"] == kind
        placeholder = F.when(here, F.lit(mark)).otherwise(placeholder)
        count = F.when(here, F.coalesce(kinds[kind].cast("bigint"), F.lit(0).cast("bigint"))).otherwise(count)
    is_text = F.coalesce(is_text, F.lit(False))
    return F.struct(
        F.when(is_text, escape(full_text(part["text"]))).otherwise(placeholder).alias("piece"),
        is_text.alias("is_text"), F.when(~is_text, part["type"]).alias("kind"), part["ref"].alias("ref"),
        F.when(is_text, F.lit(0).cast("bigint")).otherwise(count).alias("n_tokens"),
    )


def header(role: Column) -> Column:
    named = F.concat(F.lit(NAMES), escape(role), F.lit(NAMED))
    return F.when(role == "user", F.lit(USER)).when(role == "assistant", F.lit(ASSISTANT)).otherwise(named)


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it, without one pass per number over all of them."""
    zero, none = F.lit(0).cast("bigint"), F.expr("cast(array() as array<bigint>)")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)

    def inside(xs):
        start = F.struct(zero.alias("sum"), none.alias("sums"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["sums"], F.array(a["sum"])).alias("sums"))
        return F.aggregate(xs, start, step, lambda a: a["sums"])

    n_runs = F.ceil(F.size(numbers) / RUN).cast("int")
    runs = F.transform(F.filter(F.sequence(F.lit(0), n_runs), lambda i: i < n_runs), lambda i: F.slice(numbers, i * RUN + 1, RUN))
    return let(runs, lambda rs: F.flatten(F.zip_with(
        rs, inside(F.transform(rs, total)), lambda run, before: F.transform(inside(run), lambda x: x + before))))


def format_conversations(
    rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    parts: str | None = None, tokens: Callable[[Column], Mapping[str, Column]] = _tokens,
) -> DataFrame:
    """One row per conversation: its formatted text, what to learn from, what is attached.

    ``conversation``, ``n_turns``, ``formatted``; ``loss``: the spans of the assistant's text parts in order, as
    ``start`` and ``end`` in code points (end exclusive) and ``start_byte``, ``n_bytes`` in UTF-8; ``attachments``: in
    order, with ``turn_number`` from 0, ``kind``, ``ref``, ``start`` (the placeholder's code point) and ``n_tokens``;
    ``n_attachment_tokens``, their sum. ``parts`` names an array column of ``PART`` structs; where it is null or not
    given, the turn is its text. ``tokens`` gives the token counts of a part by kind.

    Turns are formatted where they are read; each task first gathers the turns it holds of a conversation, so a
    conversation that fills many tasks arrives as one row from each.
    """
    given = dict(c=conversation, t=turn, r=role, x=text) | ({"p": parts} if parts else {})
    turns = rows.select(*pick(rows, **given))
    content = text_part(F.col("x"))
    if parts:
        content = F.coalesce(F.col("p"), content)
    name = full_text(F.col("r"))
    pieces = F.transform(F.filter(content, lambda p: p.isNotNull()), lambda p: visit(p, tokens))
    turns = turns.select("c", "t", name.alias("r"), pieces.alias("pieces"))
    opening = F.concat(F.lit(OPENS), header(F.col("r")))
    plain = lambda text: F.struct(
        text.alias("piece"), F.lit(False).alias("is_text"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("n_tokens"))
    whole = F.concat(F.array(plain(opening)), F.col("pieces"), F.array(plain(F.lit(CLOSES))))
    key = F.array_join(F.transform("pieces", lambda p: F.concat_ws("\x1f", p["piece"], p["ref"])), "\x1e")
    row = F.struct(F.col("t").isNull().alias("late"), F.col("t").alias("t"), F.col("r").alias("r"), key.alias("key"), whole.alias("pieces"))
    gathered = turns.groupBy("c").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    numbered = F.flatten(F.transform("turns", lambda t, i: F.transform(t["pieces"], lambda p: F.struct(
        i.alias("turn_number"), p["piece"].alias("piece"), (p["is_text"] & (t["r"] == "assistant")).alias("learn"),
        p["kind"].alias("kind"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"), (~p["is_text"] & (p["piece"].isin(*PLACEHOLDERS.values(), OTHER))).alias("attached")))))
    flat = gathered.select("c", F.size("turns").cast("bigint").alias("n_turns"), numbered.alias("pieces"))
    chars = sums_before(F.transform("pieces", lambda p: F.char_length(p["piece"]).cast("bigint")))
    octets = sums_before(F.transform("pieces", lambda p: F.octet_length(p["piece"]).cast("bigint")))
    placed = flat.select("c", "n_turns", F.arrays_zip(F.col("pieces").alias("p"), chars.alias("at"), octets.alias("byte")).alias("z"))
    wanted = lambda field: F.filter("z", lambda z: z["p"][field])
    loss = F.transform(wanted("learn"), lambda z: F.struct(
        z["at"].alias("start"), (z["at"] + F.char_length(z["p"]["piece"])).alias("end"),
        z["byte"].alias("start_byte"), F.octet_length(z["p"]["piece"]).cast("bigint").alias("n_bytes")))
    attached = F.transform(wanted("attached"), lambda z: F.struct(
        z["p"]["turn_number"].alias("turn_number"), z["p"]["kind"].alias("kind"), z["p"]["ref"].alias("ref"),
        z["at"].alias("start"), z["p"]["n_tokens"].alias("n_tokens")))
    return placed.select(
        F.col("c").alias(conversation), "n_turns",
        F.array_join(F.transform("z", lambda z: z["p"]["piece"]), "").alias("formatted"),
        loss.alias("loss"), attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("bigint"), lambda n, a: n + a["n_tokens"]).alias("n_attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as role and text; placeholders stand in the text as they are."""
    written = F.filter(F.split(formatted, CLOSES, -1), lambda t: t != "")

    def turn(piece):
        said = F.substr(piece, F.lit(len(OPENS) + 1))
        after = lambda mark: F.substr(said, F.lit(len(mark) + 1))
        named = F.split(after(NAMES), NAMED.replace("[", "\\[").replace("]", "\\]"), 2)
        role = F.when(said.startswith(USER), "user").when(said.startswith(ASSISTANT), "assistant").otherwise(unescape(named[0]))
        text = F.when(said.startswith(USER), after(USER)).when(said.startswith(ASSISTANT), after(ASSISTANT)).otherwise(named[1])
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(written, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return let(formatted.cast("binary"), lambda octets: F.array_join(F.transform(loss, lambda s: unescape(F.substr(
        octets, (s["start_byte"] + 1).cast("int"), s["n_bytes"].cast("int")).cast("string"))), ""))
