"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Counts are computed inside each row with array functions; nothing is exploded or shuffled. Each rule's cost (its work on
a row's words and characters, in units of one comparison) and selectivity are estimated on a bounded sample in one job,
and the rules are put in order of rejections per cost: a nested CASE then evaluates a rule only for rows that no earlier
rule has rejected. No clock is read, so the same table gives the same order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE_CLASS, SPACE_CLASS, documents, stored

#: Rows of the sample on which rules are measured.
SAMPLE_ROWS = 1_000


@dataclass(frozen=True)
class Rule:
    """rejects is true for a bad row; it may use the base counts, __n_lines and __words.

    work is what that costs on a row; a comparison of counts is 1.
    """

    name: str
    rejects: Callable[[], Column]
    work: Callable[[], Column] = lambda: F.lit(1.0)


def _share(pattern: str) -> Column:
    """Share of words that match a pattern."""
    return F.size(F.filter("__words", lambda w: w.rlike(pattern))) / F.greatest(F.col("n_words"), F.lit(1))


#: Work of a regular expression on each word, and on each character that it looks at, in comparisons of counts (about
#: 1 microsecond each); from 40 evaluations of each rule on 868 texts in one job, less a job without a rule.
PER_WORD, PER_CHAR = 0.4, 0.01


def _first_letters() -> Column:
    """Work of a pattern that mostly fails at a word's first letter."""
    return 1 + PER_WORD * F.col("n_words")


def _all_letters() -> Column:
    return _first_letters() + PER_CHAR * F.col("word_chars")


#: Shares above which (or below which) a text is taken for junk.
RULES = (
    Rule("mean_word_length", lambda: ~(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))).between(2.0, 14.0)),
    Rule("symbols_per_word", lambda: F.col("n_symbols") > 0.1 * F.col("n_words")),
    Rule("duplicate_lines", lambda: F.col("n_dup_lines") > 0.4 * F.col("__n_lines")),
    Rule("repeated_words", lambda: F.col("n_repeat_words") > 0.3 * F.col("n_words")),
    Rule("words_without_letter", lambda: _share("^[^\\p{L}]+$") > 0.3, _first_letters),
    Rule("capital_words", lambda: _share("^\\P{L}*\\p{Lu}[\\p{Lu}\\P{L}]+$") > 0.3, _first_letters),
    Rule("shouted_words", lambda: _share("[!?]{2,}$") > 0.3, _all_letters),
)


def base_counts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, the five base counts, base_failed and the helper columns of the rules."""
    df = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    df = df.withColumn("__words", F.array_remove(F.split("__text", SPACE_CLASS + "+"), ""))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(NOT_SPACE_CLASS)))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("__text") - F.length(F.regexp_replace("__text", "[#*$%&|<>]", ""))).cast("long"))
    df = df.withColumn("__n_lines", F.size("__lines").cast("long"))
    df = df.withColumn("n_dup_lines", (F.col("__n_lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    window = F.when(
        F.col("n_words") >= 3,
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__windows", window)
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    # windows sorted with their places: equal neighbours are the windows found twice or more
    df = df.withColumn("__sorted", F.when(repeated, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.lit(None)))
    last = F.size("__sorted") - 1
    twin = F.filter(
        "__sorted",
        lambda s, k: ((k > 0) & (F.get("__sorted", k - 1)["h"] == s["h"])) | ((k < last) & (F.get("__sorted", k + 1)["h"] == s["h"])),
    )
    df = df.withColumn("__places", F.sort_array(F.transform(twin, lambda s: s["i"])))
    steps = F.zip_with(F.col("__places"), F.slice("__places", 2, F.greatest(F.size("__places") - 1, F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.when(F.size("__places") > 0, F.aggregate(steps, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.drop("__windows", "__sorted", "__places", "__lines", "__text").withColumn("base_failed", failed)


def measured_rules(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, int, float]]:
    """Each rule with its rejections and mean work on a stored sample of counted rows that pass the base rules."""
    sums = [F.count(F.when(r.rejects(), 1)).alias(f"n{i}") for i, r in enumerate(rules)]
    work = [F.coalesce(F.avg(r.work()), F.lit(1.0)).alias(f"w{i}") for i, r in enumerate(rules)]
    row = counts.agg(*sums, *work).first()
    return [(r, row[f"n{i}"], row[f"w{i}"]) for i, r in enumerate(rules)]


def ordered_rules(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per work; one that rejects nothing counts as half a rejection, equal ones keep their order."""
    return [r for r, _, _ in sorted(measured_rules(counts, rules), key=lambda x: -(x[1] + 0.5) / x[2])]


def cascade(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects; a later rule runs only where the earlier ones let a row pass."""
    verdict = F.lit(True)
    for r in reversed(rules):
        verdict = F.when(F.coalesce(r.rejects(), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of each row.

    A null text has no words. Texts of any length are counted whole. Repeated rows and null keys give a row each;
    other columns are not read; an empty table gives no rows. The order of rules changes only the cost: kept is true if
    the base rules pass and no rule rejects.
    """
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64(F.lit("rules"), F.col(key)), F.lit(max(1, total // sample_rows))) == 0)
    # filtered after storing: a filter pushed below the projections would repeat their array functions
    sample = stored(base_counts(part, text, key), "rules-sample").where(~F.col("base_failed"))
    order = ordered_rules(sample, rules)
    df = base_counts(docs, text, key)
    df = df.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order)))
    return df.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_rules(spark, sf_dir):
    return apply_rules(documents(spark, sf_dir).select("doc_id", "text"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1
  ) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, words, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         NOT word_chars / (1e0 * greatest(n_words, 1)) BETWEEN 2e0 AND 14e0 OR n_symbols > 1e-1 * n_words OR n_dup_lines > 4e-1 * n_lines OR n_repeat_words > 3e-1 * n_words
         OR len(list_filter(words, lambda x: regexp_matches(x, '^[^\pL]+$'))) > 3e-1 * n_words
         OR len(list_filter(words, lambda x: regexp_matches(x, '^\PL*\p{Lu}[\p{Lu}\PL]+$'))) > 3e-1 * n_words
         OR len(list_filter(words, lambda x: regexp_matches(x, '[!?]{2,}$'))) > 3e-1 * n_words AS rejected
  FROM base
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged
"""
