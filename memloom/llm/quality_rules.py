"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule bounds a ratio of two counted columns. Counting and judging use only
expressions of Spark SQL, and nothing is shuffled: a scan, one projection, a result.

Defined results: a null text counts as an empty one; texts without words fail the
base rule; repeated rows and null ids give one row each; columns of the input other
than the id and the text are ignored, so clashing names cannot matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, let

#: Frequent function words of the languages that a crawl mixes, lower case.
STOP_WORDS = (
    "the of and to in is that for with as on at by this are be from or it was not he she you we they have has an a "
    "de la le les et un une des du en que qui dans pour par sur avec est au aux ne pas ou ce se il elle "
    "der die das und zu den mit von dem ein eine ist im nicht auf für sich auch es werden aus wie bei als "
    "el los las y del se por con una para su al lo como más no"
).split()

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """at_least * of <= 100 * count <= at_most * of; a bound that is None is open."""

    name: str
    count: str
    of: str
    at_least: int | None = None
    at_most: int | None = None

    def failed(self) -> Column:
        count, of = F.col(self.count) * 100, F.col(self.of)
        low = F.lit(False) if self.at_least is None else count < of * self.at_least
        high = F.lit(False) if self.at_most is None else count > of * self.at_most
        return low | high


BASE_RULES = (Rule("too_few_words", "n_words", "one", at_least=1000), Rule("repetition", "n_repeat_words", "n_words", at_most=20))

#: In percent. Prose in any of the covered languages lies far inside each bound.
RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=200, at_most=1500),
    Rule("symbols", "n_symbols", "n_words", at_most=10),
    Rule("stop_words", "n_stop_words", "n_words", at_least=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", at_most=50),
)


def _windows(words: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), make)


def _covered(words: Column) -> Column:
    """Words that lie in a window found twice or more, by sorting the windows with their places."""
    pairs = _windows(words, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")))
    nothing = F.array().cast("array<int>")
    places = let(
        F.sort_array(pairs),
        lambda s: F.flatten(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(nothing))),
    )
    return let(
        F.sort_array(F.array_distinct(places)),
        lambda s: F.aggregate(
            F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0),
            lambda acc, x: acc + x,
        ),
    )


def _repeat_words(words: Column) -> Column:
    """Equal windows have equal hashes: where all hashes differ, nothing repeats and the sort is spared."""
    hashes = _windows(words, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < WINDOW + 1, 0).when(repeats, _covered(words)).otherwise(0)


def quality_rules(docs: DataFrame, rules=RULES, base_rules=BASE_RULES, stop_words=STOP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, failed rules and the verdict of every row; one row out for each row in."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = texts.select(
        "doc_id",
        "t",
        F.regexp_extract_all("t", F.lit(WORD_RE), F.lit(0)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\r\x0b\x0c", "")) > 0).alias("lines"),
    )
    w = F.col("w")
    counted = split.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\r\x0b\x0c", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.lit(1).cast("long").alias("one"),
    )
    base_failed = F.lit(False)
    for rule in base_rules:
        base_failed = base_failed | rule.failed()
    failed = F.concat_ws(",", *(F.when(r.failed(), F.lit(r.name)) for r in (*base_rules, *rules)))
    return counted.withColumns({"base_failed": base_failed, "failed_rules": failed}).withColumn("kept", F.col("failed_rules") == "").drop("one")


def oracle_sql() -> str:
    """The default rules in DuckDB's SQL."""
    words = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) u(i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({words})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN cov USING (r)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    concat_ws(',', CASE WHEN n_words < 10 THEN 'too_few_words' END, CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repetition' END,
      CASE WHEN 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words THEN 'word_length' END,
      CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END,
      CASE WHEN 100 * n_stop_words < 2 * n_words THEN 'stop_words' END,
      CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 'duplicate_lines' END) AS failed_rules
  FROM c)
SELECT *, failed_rules = '' AS kept FROM f
"""
