"""Rule bitmask ledger: every rule is evaluated once, and policies are read from the stored bits.

``measure`` reads each whole text once and gives its measurements; ``ledger`` adds one long of failure
bits, one bit a rule.  A policy is a version and a mask: ``judge`` rejects a row with a failure bit under
the mask, and ``ablations`` counts from the bits alone what each rule rejects, what it alone rejects and
what would be kept without it, so a new policy never reads the texts again.

Defined results: a null or empty text has no words and fails the word count; a line without a word is
never a repeated line; a text of fewer than five words has no windows; rows are judged one by one, so
repeated rows get equal verdicts.  Columns that the caller's table has besides are left out of the ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import place, table, unnamed

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: name and condition of failure; a rule's place is its bit and never changes.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeated_windows")),
        Policy("1", ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words")),
    )
}
PRODUCTION = "1"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in windows found twice or more, each word once, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # windows by rank: pairs of ranks are ranked again, so equal numbers mean equal windows
    window, k = ids, len(number)
    for i in range(1, size):
        _, window = np.unique(window[:-1] * k + ids[i:], return_inverse=True)
    counts = np.bincount(window)
    if len(counts) == n:
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[window] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The six measurements of a text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = len(lines) - len(set(lines))
    if len(words) < 2 * WINDOW and len(words) <= WINDOW:
        repeated = 0
    elif len(words) < 400 and len(set(zip(*[words[i:] for i in range(WINDOW)], strict=False))) == len(words) - WINDOW + 1:
        repeated = 0
    else:
        repeated = repeated_words(words)
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines), repeats, repeated


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the six measurements; one narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t.as_py()) for t in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["key", *MEASURES])

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return got.withColumnRenamed("key", key)


def _bits() -> str:
    return " | ".join(f"IF({condition}, {1 << i}L, 0L)" for i, (_, condition) in enumerate(RULES))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measurements and fail_bits: one bit for each rule that the row fails."""
    return measure(docs, key, text).withColumn("fail_bits", F.expr(_bits()))


def accepted(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows and columns of the table that the policy keeps, in one pass: whole rows are the ledger's keys."""
    plain, names = unnamed(docs)
    rows = plain.select(F.struct(*plain.columns).alias("row"), plain[f"_{place(names, text)}"].alias("text"))
    return judge(ledger(rows, "row", "text"), policy).filter("kept").select("row.*").toDF(*names)


def judge(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with base_failed and the policy's verdict; only bits are looked at."""
    hit = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return entries.withColumns({"base_failed": hit(BASE), "kept": ~hit(policy.mask | BASE), "policy": F.lit(policy.version)})


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """A row for each rule of the policy: rows failing it, rows that it alone rejects, rows kept with and without it.

    One aggregation by the masked bits gives at most 2 ** rules rows, whatever the input.
    """
    seen = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    each = seen.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    b, bit = F.col("bits"), F.col("bit")
    return each.groupBy("rule").agg(
        total(b.bitwiseAND(bit) != 0)("n_failing"), total(b == bit)("n_only"), total(b == 0)("n_kept"), total(b.bitwiseAND(F.bitwise_not(bit)) == 0)("n_kept_without")
    )


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(ledger(table(spark, sf_dir, "documents")), POLICIES[PRODUCTION])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "fail_bits", "policy")
