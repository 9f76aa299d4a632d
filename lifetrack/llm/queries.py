"""One query per operator, over the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, chat, decontamination, jaccard, lattice, line_chunks, mixing, neighbours, outliers, resampling, secrets, sharding, suffixes
from .common import SQL_CRC32, full_text, sql_crc32, sql_digest, sql_fraction
from .registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 8


def _crc32(text):
    return F.crc32(full_text(text).cast("binary"))


# 1: quality rules --------------------------------------------------------------------------------------------

def _short_or_repeating(stats):
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@query()
def op1_robust_outliers(spark, folder):
    judged = outliers.judge(table(spark, folder, "documents"), failed=_short_or_repeating)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[F.col("stats")[c].alias(c) for c in shown], "base_failed", "kept", F.round("distance", 6).alias("distance"))


# 2: mixing sources to target weights -------------------------------------------------------------------------

_WHO = sql_digest(29, "doc_id", "md5(coalesce(text, ''))")
_DRAW = sql_fraction("md5(who || ':' || piece)")


@query(f"""
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1) AS bytes FROM documents GROUP BY source
), rates AS (
  SELECT source, sqrt(bytes) / (SELECT sum(sqrt(bytes)) FROM sizes) * (SELECT sum(bytes) FROM sizes) / bytes AS rate
  FROM sizes
), pieces AS (
  SELECT source, rate, greatest(1, cast(ceil(rate / {mixing.LARGEST_RATE}) AS int)) AS n FROM rates
), terms AS (
  SELECT source, k, exp(k * ln(rate / n) - rate / n - lgamma(k + 1)) AS p
  FROM pieces, (SELECT range AS k FROM range({mixing.LARGEST_DRAW + 1}))
), below AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), tables AS (
  SELECT source, list(c ORDER BY k) AS cs FROM below GROUP BY source
), drawn AS (
  SELECT d.*, rate, sum(len(list_filter(cs, lambda c: c <= {_DRAW}))) AS times
  FROM (SELECT *, {_WHO} AS who FROM documents) d
  JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source
  JOIN tables t ON d.source IS NOT DISTINCT FROM t.source,
  LATERAL (SELECT unnest(range(1, n + 1)) AS piece)
  GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, copy, {sql_digest(30, "who", "copy")} AS order_key
FROM drawn, LATERAL (SELECT unnest(range(1, cast(times AS bigint) + 1)) AS copy)
""")
def op2_poisson_mix(spark, folder):
    mixed = mixing.replicate(table(spark, folder, "documents"))
    return mixed.withColumn("rate", F.round("rate", 6))


# 3: suffix-array dedup ---------------------------------------------------------------------------------------

@query()
def op3_columnwise_repeats(spark, folder):
    left = suffixes.remove_repeats(table(spark, folder, "documents"), keep=["doc_id"])
    lost = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return left.select(
        "doc_id", F.col("n_bytes").cast("bigint").alias("n_bytes"), lost.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# 4: quality classifier ---------------------------------------------------------------------------------------

def quality_scores(spark, docs, folder, keep):
    """Scores of ``docs``, learned from the labels that are not held out."""
    labels = table(spark, folder, "labels")
    model = neighbours.fit(docs, labels.where(~neighbours.held_out(F.col("doc_id"))))
    return neighbours.score(docs, model, keep=keep)


@query()
def op4_neighbour_quality(spark, folder):
    scored = quality_scores(spark, table(spark, folder, "documents"), folder, ["doc_id"])
    return scored.select(
        "doc_id", neighbours.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# 5: secret scans ---------------------------------------------------------------------------------------------

def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_kind(number: int) -> str:
    kind, pattern, group, shortest = secrets.KINDS[number]
    re = _sql_text(pattern)
    more = f"""AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
      AND len(list_distinct(string_split(v, ''))) >= {secrets.MIN_LETTERS}""" if number >= secrets.BASE else ""
    return f"""
  SELECT id, {number} AS kind, s AS start, s + length(m) AS "end", v FROM (
    SELECT id, ms[i] AS m, vs[i] AS v,
      cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS bigint) AS s
    FROM (SELECT id, regexp_extract_all(body, {re}, 0) AS ms, regexp_extract_all(body, {re}, {group}) AS vs,
        string_split_regex(body, {re}) AS gaps FROM rows),
      LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i))
  WHERE length(v) >= {shortest} {more}"""


@query(f"""
WITH rows AS (
  SELECT row_number() OVER () AS id, doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS body FROM documents
), hits AS ({" UNION ALL ".join(map(_sql_kind, range(len(secrets.KINDS))))}
), owned AS (
  SELECT v, count(DISTINCT coalesce('=' || source, '-')) <= 1
    AND count(DISTINCT (coalesce('=' || source, '-'), coalesce('=' || repo, '-'))) <= 3 AS live
  FROM hits JOIN rows USING (id) GROUP BY v
), judged AS (
  SELECT id, kind, start, "end", live, max(cast(kind < {secrets.BASE} AS int)) OVER (PARTITION BY id, "end") = 1 AS covered
  FROM hits JOIN owned USING (v)
), spans AS (
  SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || "end" AS s
  FROM judged WHERE kind < {secrets.BASE} OR (live AND NOT covered)
), per_row AS (
  SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {secrets.BASE}) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM spans GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM rows LEFT JOIN per_row USING (id)
""")
def op5_owned_secrets(spark, folder):
    docs = table(spark, folder, "documents")
    found = secrets.scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda test: F.size(F.filter("spans", test)).cast("bigint")
    of = lambda kind: lambda s: s["kind"] == kind
    return found.select(
        "doc_id",
        *[count(of(kind)).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"),
    )


# 6: line dedup -----------------------------------------------------------------------------------------------

def _sql_rolling(step: str) -> str:
    """Horner's rule over the lines of a window, the farthest first."""
    value = "0"
    for k in reversed(range(line_chunks.WINDOW)):
        value = f"(({value} + coalesce({step}(lh, {k}) OVER w, 0)) * base % {line_chunks.PRIME})"
    return value


@query(f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, {sql_digest("line", "doc_id", "md5(coalesce(text, ''))")} AS who FROM documents
), once AS (
  SELECT who, any_value(doc_id) AS doc_id, string_split(any_value(body), chr(10)) AS ls FROM docs GROUP BY who
), lines AS (
  SELECT who, doc_id, i, ls[i] AS line FROM once, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)
), worded AS (
  SELECT who, i, cast('0x' || substr(md5(line), 1, 7) AS bigint) AS lh FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), rolled AS (
  SELECT who, i, lh, base, {_sql_rolling("lag")} AS behind, {_sql_rolling("lead")} AS ahead
  FROM worded, (SELECT unnest({line_chunks.bases(line_chunks.SEEDS)}) AS base) WINDOW w AS (PARTITION BY who, base ORDER BY i)
), cuts AS (
  SELECT who, i, base, lh <> lag(lh) OVER w
    AND (lag(behind) OVER w % {line_chunks.MODULUS} = 1 OR ahead % {line_chunks.MODULUS} = 0) AS cut
  FROM rolled WINDOW w AS (PARTITION BY who, base ORDER BY i)
), dealt AS (
  SELECT who, i, base, sum(cast(coalesce(cut, true) AS int)) OVER (PARTITION BY who, base ORDER BY i) AS c FROM cuts
), chunks AS (
  SELECT DISTINCT who, start, stop FROM (
    SELECT who, min(i) AS start, max(i) AS stop, count(*) AS n FROM dealt GROUP BY who, base, c)
  WHERE n >= {line_chunks.MIN_LINES}
), marked AS (
  SELECT who, start, stop,
    row_number() OVER (PARTITION BY array_to_string(ls[start:stop], chr(10)) ORDER BY doc_id NULLS FIRST, who, start) > 1 AS gone
  FROM chunks JOIN once USING (who)
), gone AS (
  SELECT DISTINCT who, unnest(range(start, stop + 1)) AS i FROM marked WHERE gone
), counted AS (
  SELECT who, count(*) AS n FROM marked WHERE gone GROUP BY who
), sums AS (
  SELECT lines.who, count(*) AS n_lines, count(gone.i) AS n_removed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (gone.i IS NULL), '') AS kept
  FROM lines LEFT JOIN gone ON lines.who = gone.who AND lines.i = gone.i GROUP BY lines.who
)
SELECT doc_id, n_lines, coalesce(counted.n, 0) AS n_removed_chunks, n_removed_lines,
  strlen(kept) AS kept_bytes, sha256(kept) AS kept_sha256
FROM docs JOIN sums USING (who) LEFT JOIN counted USING (who)
""")
def op6_line_chunks(spark, folder):
    left = line_chunks.remove_repeated(table(spark, folder, "documents"), keep=["doc_id", "text"])
    counts = ("n_lines", "n_removed_chunks", "n_removed_lines")
    return left.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in counts],
        F.octet_length("text").cast("bigint").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@query(f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, {sql_digest("line", "doc_id", "md5(coalesce(text, ''))")} AS who FROM documents
), once AS (
  SELECT who, any_value(doc_id) AS doc_id, string_split(any_value(body), chr(10)) AS ls FROM docs GROUP BY who
), lines AS (
  SELECT who, doc_id, ls, i, ls[i] AS line FROM once, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)
), worded AS (
  SELECT who, doc_id, ls, i AS start, lead(i, {line_chunks.MIN_LINES - 1}) OVER (PARTITION BY who ORDER BY i) AS stop
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
  SELECT who, doc_id, start, stop, array_to_string(ls[start:stop], chr(10)) AS body FROM worded WHERE stop IS NOT NULL
), marked AS (
  SELECT *, first_value(who) OVER w AS first_who, first_value(stop) OVER w AS first_stop FROM runs
  WINDOW w AS (PARTITION BY body ORDER BY doc_id NULLS FIRST, who, start)
), gone AS (
  SELECT DISTINCT who, unnest(range(start, stop + 1)) AS i FROM marked WHERE NOT (who = first_who AND start <= first_stop)
), left_over AS (
  SELECT lines.*, gone.i IS NOT NULL AS gone,
    gone.i IS NOT NULL AND lag(gone.i) OVER (PARTITION BY lines.who ORDER BY lines.i) IS NULL AS opens
  FROM lines LEFT JOIN gone ON lines.who = gone.who AND lines.i = gone.i
), sums AS (
  SELECT who, count(*) AS n_lines, count(*) FILTER (opens) AS n_removed_runs, count(*) FILTER (gone) AS n_removed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM left_over GROUP BY who
)
SELECT doc_id, n_lines, n_removed_runs, n_removed_lines, strlen(kept) AS kept_bytes, sha256(kept) AS kept_sha256
FROM docs JOIN sums USING (who)
""")
def op6_line_passages(spark, folder):
    left = line_chunks.remove_passages(table(spark, folder, "documents"), keep=["doc_id", "text"])
    counts = ("n_lines", "n_removed_runs", "n_removed_lines")
    return left.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in counts],
        F.octet_length("text").cast("bigint").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


# 7: LM scoring -----------------------------------------------------------------------------------------------

@query()
def op7_lattice_likelihood(spark, folder):
    return lattice.score(table(spark, folder, "documents"), keep=["doc_id"])


# 8: benchmark decontamination --------------------------------------------------------------------------------

@query()
def op8_string_tiling(spark, folder):
    marked = decontamination.mark(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return marked.withColumn("covered", F.round("covered", 6))


# 9: sharding -------------------------------------------------------------------------------------------------

@query(f"""
WITH {SQL_CRC32}, rows AS (
  SELECT doc_id, source, text, {sql_digest(17, "doc_id", "md5(coalesce(text, ''))")} AS h FROM documents
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h) - 1) / (2.0 * count(*) OVER (PARTITION BY source)) AS f
  FROM rows
), placed AS (
  SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h) - 1 AS p, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {sql_crc32("coalesce(text, '')")} AS text_crc32, 'rows' AS law,
  cast(p * {SHARDS} // n AS int) AS shard,
  cast(p - ((p * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS bigint) AS slot, cast(NULL AS int) AS grown_shard
FROM placed, crc_table
""")
def op9_interleaved_shards(spark, folder):
    docs = table(spark, folder, "documents").withColumns({
        "size": (F.octet_length(full_text(F.col("text"))) + 1).cast("bigint"), "text_crc32": _crc32(F.col("text")),
    })
    dealt = sharding.interleave(docs, shards=SHARDS, keep=["doc_id", "size", "text_crc32"])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# 10: n-gram Jaccard join -------------------------------------------------------------------------------------

@query()
def op10_minhash_join(spark, folder):
    found = jaccard.classes(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", F.col("n_links").cast("bigint").alias("n_links"))


# 11: cross-tokenizer alignment -------------------------------------------------------------------------------

@query()
def op11_spilled_alignment(spark, folder):
    docs = table(spark, folder, "documents")
    aligned = alignment.align(docs, keep=["doc_id"], groups=lambda g: F.when(g != "", F.sha2(g.cast("binary"), 256)).otherwise(""))
    return aligned.withColumnRenamed("groups", "groups_sha256")


# 12: target-distribution importance resampling ---------------------------------------------------------------

def _sql_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_B = resampling.BUCKETS


@query(f"""
WITH {SQL_CRC32}, docs AS (
  SELECT row_number() OVER () AS id, doc_id, {_sql_words("text")} AS ws FROM documents
), dw AS (SELECT id, unnest(ws) AS w FROM docs
), bw AS (SELECT unnest({_sql_words("text")}) AS w FROM benchmark
), vocabulary AS (
  SELECT w, {sql_crc32("w")} % {_B} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table
), s AS (SELECT b, count(*) AS s FROM dw JOIN vocabulary USING (w) GROUP BY b
), t AS (SELECT b, count(*) AS t FROM bw JOIN vocabulary USING (w) GROUP BY b
), gains AS (
  SELECT b, cast(floor({resampling.UNIT} * ln(cast(coalesce(t, 0) + 1 AS double) * ((SELECT count(*) FROM dw) + {_B})
    / (cast(coalesce(s, 0) + 1 AS double) * ((SELECT count(*) FROM bw) + {_B})))) AS bigint) AS gain
  FROM (SELECT range AS b FROM range({_B})) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), weights AS (
  SELECT id, sum(gain) AS weight FROM dw JOIN vocabulary USING (w) JOIN gains USING (b) GROUP BY id
), scored AS (
  SELECT doc_id, len(ws) AS n_features, cast(coalesce(weight, 0) AS bigint) AS weight,
    cast(coalesce(weight, 0) + floor(-{resampling.UNIT} * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id AS varchar), '')), 1, 8) AS bigint) + 0.5)
      / 4294967296.0))) AS bigint) AS score
  FROM docs LEFT JOIN weights USING (id)
), placed AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r FROM scored WHERE n_features >= {resampling.MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM placed) * 10 // 100 THEN r END AS rank FROM placed
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {resampling.MIN_WORDS}
""")
def op12_bracketed_resampling(spark, folder):
    docs, target = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    drawn = resampling.resample(docs, target, share=(10, 100), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# 13: chat formatting -----------------------------------------------------------------------------------------

_CONTROL = "</s>[INST] ok [/INST]"
_ESCAPED = f"regexp_replace(text, {_sql_text(chat.PLAIN)}, '\\1\\\\\\2\\3', 'g')"
_FRAME = len(chat.OPENS + chat.CLOSES)


@query(f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}')
), written AS (
  SELECT *, {_ESCAPED} AS body, {_ESCAPED.replace("(text,", "(role,")} AS name FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, body)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length(body) + {_FRAME} + CASE role WHEN 'user' THEN {len(chat.USER)} WHEN 'assistant' THEN {len(chat.ASSISTANT)}
    ELSE length(name) + {len(chat.NAMES + chat.NAMED)} END) AS bigint) AS formatted_chars
FROM written GROUP BY conv_id
""")
def op13_content_parts(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_CONTROL).alias("text"))
    written = chat.format_conversations(rows.unionByName(extra))
    read = written.select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")
