"""Operator 4, quality rules as a bitmask ledger.

Method: every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies are versioned masks over those bits, so that a new policy, or the question what one rule alone
costs, is bit arithmetic over the ledger and never reads a text again.

Words are maximal runs of characters other than the six ASCII white-space characters. Defined results: a null
or empty text has no words, measures 0 everywhere and fails few_words; repeated rows give repeated rows; an
empty table gives an empty ledger; columns besides doc_id and text are ignored, whatever their names. Memory:
one Arrow batch, and the word windows of one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import SPACES, arrow_types, bounded_batches, map_texts, plain_names, slim, table

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rules by bit. Each is a test of the measurements below; its place never changes once it is published.
RULES = ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "all_capitals", "short_words")
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules whose failure rejects a document.
POLICIES = {1: BASE, 2: (*BASE, "many_symbols", "repeated_lines", "all_capitals", "short_words")}
CURRENT = 2

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, capitals boolean"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of so many words that the text has twice or more."""
    windows = lambda: zip(*(words[i:] for i in range(size)))
    n = max(0, len(words) - size + 1)
    if len(set(windows())) == n:
        return 0
    seen, again = set(), set()
    for w in windows():
        (again if w in seen else seen).add(w)
    total, free = 0, 0  # free: the first word that no repeated window has covered yet
    for i, w in enumerate(windows()):
        if w in again:
            total += i + size - max(i, free)
            free = i + size
    return total


def measure(_, text: str | None) -> tuple:
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    white = sum(map(text.count, SPACES))
    return (
        len(words), len(text) - white, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
        repeated_words(words), text == text.upper() != text.lower(),
    )


def failures(at: str = "") -> Column:
    """The bits of the failed rules, from the measurements (at: "" or the struct that holds them, with a dot)."""
    c = lambda name: F.col(at + name)
    tests = {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "many_symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "all_capitals": c("capitals") & (c("n_words") >= 20),
        "short_words": c("word_chars") < 2 * c("n_words"),
    }
    bits = F.lit(0).cast("long")
    for rule, test in tests.items():
        bits = bits.bitwiseOR(F.when(test, F.lit(1 << RULES.index(rule))).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`, one bit for each failed rule."""
    return map_texts(docs, measure, MEASURES).withColumn("failed", failures())


def apply_policy(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a policy; reads bits only."""
    hit = lambda rules: F.col("failed").bitwiseAND(F.lit(mask(rules))) != 0
    return led.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit(tuple({*BASE, *POLICIES[version]})))


def ablations(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects. One aggregation."""
    rules = POLICIES[version]
    bits = F.col("failed").bitwiseAND(F.lit(mask(rules)))
    aggs = [F.count(F.lit(1)).alias("docs"), F.bit_or(bits).alias("seen"), F.count_if(bits != 0).alias("rejected")]
    for r in rules:
        one = F.lit(mask((r,)))
        aggs += [F.count_if(bits.bitwiseAND(one) != 0).alias(f"{r}_fails"), F.count_if(bits == one).alias(f"{r}_only")]
    rows = ", ".join(f"'{r}', {r}_fails, {r}_only" for r in rules)
    return led.agg(*aggs).selectExpr("docs", "rejected", f"stack({len(rules)}, {rows}) as (rule, fails, only)")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@plain_names
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the current policy keeps, with their columns. The decision and the row travel
    together through one pass, so that no join by doc_id is needed."""
    bounded_batches(spark)
    at = docs.columns.index("text")
    fields = arrow_types(MEASURES)
    names = [f"_m_{n}" for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(None, t) for t in b.column(at).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    more = ", ".join(f"_m_{x.strip()}" for x in MEASURES.split(","))
    out = docs.mapInArrow(slim(run), f"{schema}, {more}")
    held = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*[F.col(n).alias(n[3:]) for n in names]).alias("_m"))
    rejects = F.lit(mask(tuple({*BASE, *POLICIES[CURRENT]})))
    return held.filter(failures("_m.").bitwiseAND(rejects) == 0).drop("_m")


#: The same in SQL, for the rows of op4_quality_rules.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) > 1),
hit AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT win.rid, unnest(range(i, i + 5)) AS p FROM win JOIN again USING (rid, s)) GROUP BY rid),
ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT rid, unnest(ls) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(hit.n, 0)::BIGINT AS n_repeat_words, (t = upper(t) AND upper(t) <> lower(t)) AS capitals
  FROM d LEFT JOIN hit USING (rid) LEFT JOIN ln USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR (capitals AND n_words >= 20) OR word_chars < 2 * n_words) AS kept
FROM m
"""
