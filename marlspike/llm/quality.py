"""Quality rules: a ledger of rule failures as bits, policies over it, and their ablations.

Every rule is evaluated once for each document. ledger() keeps its measurements and a bit for each
rule that failed; a policy is a mask of bits, so versions of it, and what each of its rules costs,
come from bitwise operations on the ledger, never from the texts again. Built-in expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_of, table

SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """fails: a SQL condition over the measurements. Its place in RULES is its bit, which is never used again."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("capitals", "100 * n_capitals > 30 * word_chars"),
    Rule("long_words", "word_chars > 40 * n_words"),
)
#: Versions of the policy: the rules that reject a document. "base" is the part that every policy holds.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "capitals", "long_words"),
}


def mask(policy: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.name in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of each whole text as columns of longs; a null text has no words.

    n_words, word_chars: words [^\\x20\\x09-\\x0D]+ and their code points. n_symbols: of [#*$%&|<>].
    n_capitals: upper-case letters. n_lines, n_dup_lines: lines with a word; those equal to an earlier
    one. n_repeat_words: words in three-word windows that occur twice or more in the text. Windows are
    compared by 64-bit hashes. The measurements replace columns of the same names.
    """
    # the row is one struct, so that no column of it clashes with what is computed beside it
    kept = docs.select(row_of(docs), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    trimmed = F.btrim("_text", F.lit(SPACES))
    rows = kept.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    rows = rows.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long")})
    # a window of three words at each place, sorted by hash: equal windows are neighbours
    at = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_windows", F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))))

    def twin(x: Column, k: Column) -> Column:
        return (F.get("_windows", k - 1)["h"] == x["h"]) | (F.get("_windows", k + 1)["h"] == x["h"])

    # windows that have a twin, in text order; each adds the words that the one before it has not covered
    rows = rows.withColumn("_starts", F.sort_array(F.transform(F.filter("_windows", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"])))
    covered = F.expr("aggregate(_starts, named_struct('n', 0L, 'last', -3), (a, s) -> named_struct('n', a.n + cast(least(3, s - a.last) AS bigint), 'last', s), a -> a.n)")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = rows.withColumns({"n_repeat_words": covered, "_lines": lines})
    found = {
        "n_words": F.col("n_words"), "word_chars": F.col("word_chars"), "n_repeat_words": F.col("n_repeat_words"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_capitals": F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long"),
    }
    # one row of a generator: a filter on a measurement stays above it, where pushed down it would repeat all that is measured, many times over
    return rows.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in found], F.stack(F.lit(1), *found.values()).alias(*found))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with measurements and fail_bits, a long with bit i set where RULES[i] fails."""
    bits = " | ".join(f"shiftleft(cast(coalesce({r.fails}, false) AS bigint), {i})" for i, r in enumerate(RULES))
    return measured(docs, text).withColumn("fail_bits", F.expr(bits))


def verdict(policy: str, bits: str = "fail_bits") -> Column:
    """True where the policy keeps the document of a ledger row."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents it fails, and those that no other rule of the policy fails
    (kept if the rule were taken out). The ledger is first summed by its bits, so at most 2^rules rows
    are looked at again."""
    of = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    out = [(F.lit(r.name), F.lit(1 << i)) for i, r in enumerate(RULES) if r.name in POLICIES[policy]]
    each = F.inline(F.array(*[F.struct(n.alias("rule"), b.cast("long").alias("bit")) for n, b in out]))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return of.select("bits", "n", each).groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~verdict("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), verdict("v1").alias("kept"), "n_lines", "n_capitals", "fail_bits")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that policy v1 keeps, unchanged."""
    return ledger(docs.select(row_of(docs), "text")).where(verdict("v1")).select("_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
l AS (SELECT w.*, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(rep.n, 0) AS r FROM w LEFT JOIN rep USING (rid)),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, r::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
 (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_capitals FROM l),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
 + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (100 * n_capitals > 30 * word_chars)::BIGINT + 32 * (word_chars > 40 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 fail_bits = 0 AS kept, n_lines, n_capitals, fail_bits FROM b
"""
