"""Operator 2: quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a Column that rejects. On a bounded sample each rule's cost (seconds a row) and rejections beside other rules' are measured, and the cascade
asks rules by rejection per cost, so most rejected documents never reach the dear ones. The order changes the cost of a verdict, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

#: Rows on which costs and rejections are measured, how often each rule is timed at most, within what ratio its two fastest runs must be to stop earlier, and the seed of the sample.
SAMPLE_ROWS, RUNS, STEADY, SEED = 2000, 3, 1.25, 11
#: Fixed bounds of the rules, in hundredths.
LEAST_WORDS, REPEATED, SYMBOLS, CAPITALS, DUPLICATE_LINES, WORDLIKE = 50, 50, 25, 50, 40, 50
SHORTEST_MEAN, LONGEST_MEAN = 200, 1500


@dataclass(frozen=True)
class Rule:
    """A rule rejects where its column is true."""

    name: str
    rejects: Column


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(r"[#*$%&|<>]")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(_text(text), "\n"), lambda line: line.rlike(common.NOT_SPACE))


def n_dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column) -> Column:
    """How many words of an array lie in a 3-word window that it has twice or more.

    Windows are told apart by 64-bit hashes. If some are equal, windows are sorted with their places, those with an equal
    neighbour are kept, and their places in order give the words they cover.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def equal_neighbours(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.try_element_at(s, k)["h"] == e["h"], F.lit(False))
            # places count from 0 and elements from 1: k is the one before, k + 2 the one after
            kept = F.filter(s, lambda e, k: F.when(k > 0, same(e, F.greatest(k, F.lit(1)))).otherwise(F.lit(False)) | same(e, k + 2))
            return F.sort_array(F.transform(kept, lambda e: e["i"]))

        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(let(placed, equal_neighbours), start, step, lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))).cast("long")


def base_features(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_lines (those with a word), n_dup_lines and n_repeat_words of a whole text, as a struct. Null or without a word: zeros, symbols apart."""

    def counted(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            n_symbols(text).alias("n_symbols"),
            lines["n_lines"].alias("n_lines"),
            lines["n_dup_lines"].alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return let(common.words(text), lambda w: let(let(lines_with_words(text), counted), lambda x: of(w, x)))


def verdict_rules(text: Column, known: Column | None = None) -> list[Rule]:
    """The rules beside the base ones; none looks at anything but the text, and none rejects an empty text. known: the text's base features where they are at hand, which no rule computes again then."""
    whole = _text(text)
    if known is None:
        n_words = F.regexp_count(whole, F.lit(common.NOT_SPACE + "+"))
        symbols = n_symbols(text)
        word_chars = F.length(F.regexp_replace(whole, common.SPACE, ""))
        lines = let(lines_with_words(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 100 > DUPLICATE_LINES * F.size(x))
    else:
        n_words, symbols, word_chars = known["n_words"], known["n_symbols"], known["word_chars"]
        lines = known["n_dup_lines"] * 100 > known["n_lines"] * DUPLICATE_LINES
    capitals = let(F.regexp_count(whole, F.lit(r"\p{Lu}")), lambda c: (c > 0) & (c * 100 > CAPITALS * F.regexp_count(whole, F.lit(r"\p{L}"))))
    mean = let(n_words, lambda n: let(word_chars * 100, lambda c: (c < n * SHORTEST_MEAN) | (c > n * LONGEST_MEAN)))
    # from a word's first letter to its end: one match for each word with a letter
    wordlike = let(n_words, lambda n: F.regexp_count(whole, F.lit(r"\p{L}" + common.NOT_SPACE + "*")) * 100 < n * WORDLIKE)
    return [Rule("symbols", symbols * 100 > n_words * SYMBOLS), Rule("capitals", capitals), Rule("duplicate_lines", lines), Rule("word_length", mean), Rule("wordlike", wordlike)]


def base_rules(text: Column, least_words: int = LEAST_WORDS) -> list[Rule]:
    words = common.words(text)
    few = F.regexp_count(_text(text), F.lit(common.NOT_SPACE + "+")) < least_words
    return [Rule("few_words", few), Rule("repeated_words", let(words, lambda w: repeated_words(w) * 100 > F.size(w) * REPEATED))]


@dataclass(frozen=True)
class Measured:
    """What a sample says of rules: seconds a row of each, and how many rows each set of rules rejects (bit k: the k-th rule)."""

    rules: list[Rule]
    costs: list[float]
    sets: dict[int, int]

    def ordered(self) -> list[Rule]:
        """Rules by rejection per cost, highest first, the rejection being that of rows which no earlier rule has rejected; cost and then name settle ties."""
        left, open_, out = dict(self.sets), list(range(len(self.rules))), []
        while open_:
            hits = {k: sum(n for bits, n in left.items() if bits >> k & 1) for k in open_}
            best = min(open_, key=lambda k: (-hits[k] / self.costs[k], self.costs[k], self.rules[k].name))
            out.append(self.rules[best])
            open_.remove(best)
            left = {bits: n for bits, n in left.items() if not bits >> best & 1}
        return out


def measure(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, known: Column | None = None) -> Measured:
    """Costs and rejections over one sample of about so many rows (with a column f of what known gives, if it is given).

    Each rule is run by itself, two times or until its two fastest runs are alike, but RUNS times at most; the fastest counts, less that of a run without a rule.
    """
    n = docs.count()
    sample = docs.select("text").sample(min(1.0, rows / max(n, 1)), SEED).limit(2 * rows)
    sample = common.stored(sample if known is None else sample.withColumn("f", known), "rule-sample")
    masks = sum((F.coalesce(r.rejects, F.lit(False)).cast("int") * (1 << k) for k, r in enumerate(rules)), F.lit(0))
    sets = {r["bits"]: r["count"] for r in sample.groupBy(masks.alias("bits")).count().collect()}  # a row for each set of rules at most

    def seconds(rejects: Column) -> float:
        took: list[float] = []
        while len(took) < 2 or (len(took) < RUNS and took[1] > STEADY * took[0]):
            began = time.perf_counter()
            sample.agg(F.count_if(rejects)).first()
            took = sorted([*took, time.perf_counter() - began])
        return took[0]

    idle = seconds(F.length("text") < 0)
    costs = [max(seconds(r.rejects) - idle, 1e-4) / max(sum(sets.values()), 1) for r in rules]
    common.discard(sample)
    return Measured(rules, costs, sets)


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't evaluated then."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects, rule.name) if out is None else out.when(rule.rejects, rule.name)
    return F.lit(None).cast("string") if out is None else out


def filter_documents(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows that no rule rejects, base rules with least_words included, with all their columns. A null text has no word and goes, unless least_words is 0."""
    return docs.where(cascade(measure(docs, base_rules(F.col("text"), least_words) + verdict_rules(F.col("text"))).ordered()).isNull())


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the base features, base_failed and kept of every row; repeated rows, null ids and null texts keep a row each."""
    features = base_features(F.col("text"))
    rules = measure(docs, verdict_rules(F.col("text"), F.col("f")), known=features).ordered()
    failed = (F.col("f.n_words") < LEAST_WORDS) | (100 * F.col("f.n_repeat_words") > REPEATED * F.col("f.n_words"))
    judged = docs.select("doc_id", "text", features.alias("f"))
    return judged.select("doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(cascade(rules).isNull()).alias("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judge_documents(common.table(spark, sf_dir, "documents"))


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{common.NOT_SPACE}+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), g AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS a, lead(w, 2) OVER o AS b FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, CASE WHEN b IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, a, b) > 1 THEN 1 ELSE 0 END AS r FROM g
), c AS (
  SELECT doc_id, sum(c) AS n_repeat_words FROM (
    SELECT doc_id, greatest(r, lag(r, 1, 0) OVER o, lag(r, 2, 0) OVER o) AS c FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  ) GROUP BY doc_id
), x AS (
  SELECT d.doc_id, t, len(ws) AS n_words, length(regexp_replace(t, '{common.SPACE}', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{common.NOT_SPACE}')) AS ls,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '\p{{L}}')) AS n_letters,
    len(list_filter(ws, lambda v: regexp_matches(v, '\p{{L}}'))) AS n_wordlike
  FROM d LEFT JOIN c USING (doc_id)
), y AS (
  SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM x
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > {SYMBOLS} * n_words OR (n_upper > 0 AND 100 * n_upper > {CAPITALS} * n_letters)
    OR 100 * n_dup_lines > {DUPLICATE_LINES} * len(ls) OR 100 * word_chars < {SHORTEST_MEAN} * n_words OR 100 * word_chars > {LONGEST_MEAN} * n_words
    OR 100 * n_wordlike < {WORDLIKE} * n_words) AS kept
FROM y
"""
