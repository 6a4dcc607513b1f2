"""Which of three plans answers a filtered vector search, from counts; cost estimates; learning thresholds."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.types import check_k


class Strategy(Enum):
    BRUTE_FORCE = "BruteForce"
    FILTER_FIRST = "FilterFirst"
    VECTOR_FIRST = "VectorFirst"


@dataclass(frozen=True)
class Plan:
    strategy: Strategy
    selectivity: float
    expansion: int | None = None


@dataclass
class Planner:
    """Below ``low`` the matches are scanned, above ``high`` the vectors come first, between them the filter does."""

    low: float = 0.01
    high: float = 0.5
    safety: float = 1.5
    cap: int = 10_000

    def expansion(self, k: int, selectivity: float) -> int:
        """How many nearest rows to take before filtering."""
        if selectivity < 0.001:
            return self.cap
        return min(math.ceil(k / selectivity * self.safety), self.cap)

    def plan(self, total: int, matches: int, k: int) -> Plan:
        check_k(k)
        s = matches / total if total else 0.0
        if s < self.low:
            return Plan(Strategy.BRUTE_FORCE, s)
        if s > self.high:
            return Plan(Strategy.VECTOR_FIRST, s, self.expansion(k, s))
        return Plan(Strategy.FILTER_FIRST, s)


def needs_fallback(found: int, k: int, share: float = 0.5) -> bool:
    return found < math.ceil(k * share)


# the same rules as columns, for tables of queries


def selectivity(total: Column, matches: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(matches / total)


def choice(s: Column, low: float = 0.01, high: float = 0.5) -> Column:
    return F.when(s < low, Strategy.BRUTE_FORCE.value).when(s > high, Strategy.VECTOR_FIRST.value).otherwise(Strategy.FILTER_FIRST.value)


def expansion(k: Column, s: Column, safety: float = 1.5, cap: int = 10_000) -> Column:
    return F.when(s < 0.001, cap).otherwise(F.least(F.ceil(k / s * safety), F.lit(cap))).cast("long")


#: fixed values: unit costs of a distance, of a graph search, of a mask check, and the penalties of sparse masks
COST_DISTANCE, COST_GRAPH, COST_CHECK = 1.0, 2.0, 0.01
PENALTIES = ((0.05, 3.0), (0.2, 1.5))


def cost_brute(s: Column, total: Column) -> Column:
    return s * total * COST_DISTANCE


def cost_filter_first(s: Column, total: Column) -> Column:
    penalty = F.when(s < PENALTIES[0][0], PENALTIES[0][1]).when(s < PENALTIES[1][0], PENALTIES[1][1]).otherwise(1.0)
    return 1 + COST_GRAPH * penalty + COST_CHECK * total


def cost_vector_first(k: Column, s: Column) -> Column:
    return COST_GRAPH + COST_CHECK * expansion(k, s)


# -- learning --------------------------------------------------------------------------------------


def summary(stats: DataFrame) -> DataFrame:
    """Queries, mean latency and mean recall of each strategy."""
    return stats.groupBy("strategy").agg(F.count("*").alias("queries"), F.avg("latency_ms").alias("avg_latency_ms"), F.avg("recall").alias("avg_recall"))


def recommend(stats: DataFrame, last: int, order: str = "seq", low: float = 0.01, high: float = 0.5) -> DataFrame:
    """Thresholds halfway between the upper medians of neighbouring strategies over the last queries; defaults where one is missing."""
    recent = stats.orderBy(F.desc(order)).limit(last)
    by = Window.partitionBy("strategy")
    ranked = recent.select("strategy", "selectivity", F.row_number().over(by.orderBy("selectivity")).alias("i"), F.count("*").over(by).alias("n"))
    medians = ranked.filter(F.col("i") == F.floor(F.col("n") / 2) + 1)
    of = lambda s: F.max(F.when(F.col("strategy") == s.value, F.col("selectivity")))
    m = medians.agg(of(Strategy.BRUTE_FORCE).alias("b"), of(Strategy.FILTER_FIRST).alias("f"), of(Strategy.VECTOR_FIRST).alias("v"))
    return m.select(F.coalesce((F.col("b") + F.col("f")) / 2, F.lit(low)).alias("low"), F.coalesce((F.col("f") + F.col("v")) / 2, F.lit(high)).alias("high"))


def best_by_selectivity(runs: DataFrame) -> DataFrame:
    """The fastest strategy of each selectivity, rounded to four places."""
    at = F.round("selectivity", 4).alias("selectivity")
    first = F.min(F.struct("latency_ms", "strategy"))
    return runs.groupBy(at).agg(first.alias("m")).select("selectivity", F.col("m.strategy").alias("strategy"), F.col("m.latency_ms").alias("latency_ms"))


STATISTICS = "seq long, strategy string, selectivity double, latency_ms double, recall double"


@dataclass
class SearchLog:
    """Statistics of real searches, the last ``keep`` of them, as the tables that ``summary`` and ``recommend`` read."""

    keep: int = 10_000
    rows: list[tuple] = field(default_factory=list)
    seq: int = 0

    def record(self, strategy: Strategy, selectivity: float, latency_ms: float, recall: float | None = None) -> None:
        self.seq += 1
        self.rows.append((self.seq, strategy.value, float(selectivity), float(latency_ms), recall))
        del self.rows[: -self.keep]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, STATISTICS)


@dataclass
class AdaptivePlanner:
    """A planner whose thresholds are learnt again after every so many plans."""

    planner: Planner = field(default_factory=Planner)
    update_interval: int = 1000
    planned: int = 0

    def plan(self, total: int, matches: int, k: int, stats: DataFrame | None = None) -> Plan:
        self.planned += 1
        if stats is not None and self.planned % self.update_interval == 0:
            row = recommend(stats, self.update_interval).first()
            self.planner.low, self.planner.high = row["low"], row["high"]
        return self.planner.plan(total, matches, k)
