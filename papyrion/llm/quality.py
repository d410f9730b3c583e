"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A word is a maximal run of characters other than the six ASCII white-space
characters. Everything is computed inside its row, so there is no shuffle and
no Python on the executors. Arrays that lambdas index are pinned by a one-row
``inline`` (a Generate node), which keeps the optimiser from pasting the
expression that makes them into the lambda, where it would run per element.

Defined results
* null text counts as empty: all counts 0, ``base_failed`` true;
* a text of white space only: the same;
* a null in any other column is carried through untouched;
* repeated rows are judged one by one and stay repeated;
* an empty table gives an empty table;
* extra columns stay; the result is one struct column, ``out``, which replaces
  a column of that name.
Equal 3-word windows are found by their 64-bit hash, so two different windows
of one text pass for equal with a chance of about (words ** 2) / 2 ** 65.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import pin

# Common words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the and of to in that is was for it with as on be at by this are or from an not but have they",
    "fr": "le la les de des du un une et en que qui dans pour par sur est au ce pas plus ne se avec sont",
    "de": "der die das und ist in den von zu mit sich des auf für ein eine dem nicht als auch es an werden aus er",
    "es": "el la los las de del que y en un una por con para es al lo como su se no más sus pero o",
}

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SPACE = "[ \\t-\\r]"
_WORD = "[^ \\t-\\r]"


@dataclass(frozen=True)
class Rule:
    """``count / per`` must lie in [low, high]; a null bound is open."""

    name: str
    count: str
    per: str
    low: float | None = None
    high: float | None = None


#: The production table, over the names in COUNTS.
RULES = (
    Rule("word length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.1),
    Rule("stop words per word", "n_stop_words", "n_words", 0.05, None),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", None, 0.3),
    Rule("shouted words per word", "n_shouted", "n_words", None, 0.3),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shouted")


def _compiled(rules: tuple[Rule, ...]) -> Column:
    """The array of names of the rules that fail; a ratio without words fails nothing."""
    failed = []
    for rule in rules:
        ratio = F.try_divide(F.col(rule.count), F.col(rule.per))
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (ratio < F.lit(rule.low))
        if rule.high is not None:
            bad = bad | (ratio > F.lit(rule.high))
        failed.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*failed))


def _judged(docs: DataFrame, names: list[str], text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``__row``, a struct of the columns ``names``, and ``verdict``; all columns travel as one, so no name of theirs can clash."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    df = docs.select(row, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    df = pin(
        df,
        __words=F.array_remove(F.split("__text", f"{_SPACE}+"), ""),
        __lines=F.filter(F.split("__text", "\\n"), lambda x: x.rlike(_WORD)),
    )
    window = F.when(
        F.size("__words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("__words") - 3),
            lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = pin(df, __windows=window)
    # Only a text with a repeated window is sorted.
    df = pin(
        df,
        __sorted=F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    again = F.filter(
        F.transform(
            "__sorted",
            lambda x, k: F.when(
                F.coalesce(F.get("__sorted", k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get("__sorted", k + 1)["h"] == x["h"], F.lit(False)),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2))))
    counts = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.length("__text") - F.length(F.translate("__text", SYMBOLS, "")),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.size(covered),
        "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(stop))),
        "n_shouted": F.size(F.filter("__words", lambda w: (F.length(w) > 2) & (F.upper(w) == w) & (F.lower(w) != w))),
    }
    df = pin(df, **{name: c.cast("long") for name, c in counts.items()})
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = pin(df, base_failed=base_failed, failed_rules=_compiled(rules))
    verdict = F.struct(
        *COUNTS, "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept")
    )
    return df.select("__row", verdict.alias("verdict"))


def with_quality(docs: DataFrame, text: str = "text", out: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a struct of the counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    judged = _judged(docs, [c for c in docs.columns if c != out], text, rules)
    return judged.select("__row.*", F.col("verdict").alias(out))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    return _judged(docs, docs.columns, text, rules).where("verdict.kept").select("__row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = with_quality(docs)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in fields])


#: DuckDB SQL of the same rows.
OP7_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS lines
  FROM base),
g AS (
  SELECT *, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM w),
gram AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT g.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN (STOP)))::BIGINT AS n_stop,
         len(list_filter(words, lambda x: length(x) > 2 AND upper(x) = x AND lower(x) <> x))::BIGINT AS n_shout
  FROM g LEFT JOIN hit ON hit.doc_id = g.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1
       AND n_stop / n_words >= 0.05 AND n_dup_lines / n_lines <= 0.3 AND n_shout / n_words <= 0.3 AS kept
FROM f
""".replace("STOP", ", ".join(sorted({f"'{w}'" for words in STOP_WORDS.values() for w in words.split()})))
