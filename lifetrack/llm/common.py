"""Names, text rules and hashes that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

#: White space is the six ASCII characters only; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: 13 hexadecimal digits are 52 bits: every fraction made of them is an exact double.
FRACTION_DIGITS = 13


def free_names(taken: Iterable[str], *bases: str) -> list[str]:
    """A name for each base that no column has yet, so that any input columns can pass through."""
    used = {c.lower() for c in taken}
    out = []
    for base in bases:
        name = base
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def pick(df: DataFrame, **columns: str) -> list[Column]:
    """Columns of ``df`` under the names given as keywords, also where names contain dots."""
    return [df[f"`{old}`"].alias(new) for new, old in columns.items()]


def full_text(text: Column) -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Inside a lambda, a column that the optimizer replaces by its expression would be computed anew for
    every element; a lambda's own variable never is.
    """
    return F.transform(F.array(value), use)[0]


def digest(seed: str | int, *parts: Column) -> Column:
    """md5 of the parts, null apart from any text, as 32 hexadecimal digits."""
    coded = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *coded))


def fraction(hexadecimal: Column) -> Column:
    """A number from 0 to below 1 from the first digits of a digest."""
    whole = F.conv(F.substring(hexadecimal, 1, FRACTION_DIGITS), 16, 10).cast("bigint")
    return whole / F.lit(float(16**FRACTION_DIGITS))


def sql_digest(seed: str | int, *parts: str) -> str:
    coded = [f"coalesce('=' || cast({p} as varchar), '-')" for p in parts]
    return "md5('" + str(seed) + "' || chr(31) || " + " || chr(31) || ".join(coded) + ")"


def sql_fraction(hexadecimal: str) -> str:
    return f"(cast(('0x' || substr({hexadecimal}, 1, {FRACTION_DIGITS})) as bigint) / {float(16**FRACTION_DIGITS)!r})"


#: DuckDB has no CRC-32: its table by the polynomial's rule, then one step per byte.
SQL_CRC32 = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT cast(range AS bigint) AS i FROM range(256)))
)"""


def sql_crc32(text: str) -> str:
    """CRC-32 of a text's bytes; the query must also read ``crc_table``."""
    data = f"hex(encode({text}))"
    steps = (
        f"list_transform(range(strlen({text})), lambda i: cast('0x' || substr({data}, 2 * i + 1, 2) as bigint))"
    )
    run = (
        f"list_reduce(list_prepend(4294967295::bigint, {steps}), "
        "lambda c, b: xor(c >> 8, t[cast((xor(c, b) & 255) + 1 AS bigint)]))"
    )
    return f"xor({run}, 4294967295)"
