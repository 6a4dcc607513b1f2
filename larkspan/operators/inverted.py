"""Inverted index as a table of distinct (term, doc_id), boolean queries over it, and its statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.functions.text import tag, words


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (term, doc_id): duplicates within a document go before the shuffle."""
    return docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term"), F.col(key).alias("doc_id")).distinct()


def tag_postings(docs: DataFrame, tags, key: str = "doc_id") -> DataFrame:
    """As ``postings`` for an array of tags; a tag with blanks stays one term."""
    return docs.select(F.explode(F.transform(tags, tag)).alias("term"), F.col(key).alias("doc_id")).filter("term <> ''").distinct()


def frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, doc_id, tf and the first position of the term."""
    each = docs.select(F.col(key).alias("doc_id"), F.posexplode(words(F.col(text))).alias("pos", "term"))
    return each.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.min("pos").cast("long").alias("first_pos"))


def positions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, doc_id, tf and all positions of the term, ascending."""
    each = docs.select(F.col(key).alias("doc_id"), F.posexplode(words(F.col(text))).alias("pos", "term"))
    return each.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


# -- a stored index --------------------------------------------------------------------------------


class Index:
    """An index in a folder: postings (term, doc_id, tf, positions) and lengths (doc_id, n), in segments.

    Postings are sorted by term in small row groups, so a search reads the row groups of its terms and
    nothing else.  Added documents are a new segment, removed ones a list that older segments are held against;
    ``optimize`` makes one segment of all.  A document that is added again replaces the older one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        self.segments = sorted(int(n.split("-")[1]) for n in names if n.startswith("lengths-"))
        self.removals = sorted(int(n.split("-")[1]) for n in names if n.startswith("removed-"))

    @property
    def _next(self) -> int:
        return max([*self.segments, *self.removals, 0]) + 1

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
        """Indexes documents; the segment counts once its lengths, which are written last, are there."""
        n = self._next
        ids = docs.select(F.col(key).alias("doc_id"))
        if self.segments:
            self.remove(ids)
            n = self._next
        rows = positions(docs, key, text).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        rows.write.mode("overwrite").option("parquet.block.size", 1 << 22).parquet(f"{self.path}/postings-{n}")
        lengths = docs.select(F.col(key).alias("doc_id"), F.size(words(F.col(text))).cast("long").alias("n"))
        lengths.write.mode("overwrite").parquet(f"{self.path}/lengths-{n}")
        return Index(self.spark, self.path)

    def remove(self, ids: DataFrame) -> Index:
        """Documents of the segments so far that don't count any more."""
        n = self._next
        ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct().write.mode("overwrite").parquet(f"{self.path}/removed-{n}")
        self.removals.append(n)
        return self

    def _live(self, kind: str) -> DataFrame | None:
        parts = []
        for n in self.segments:
            part = self.spark.read.parquet(f"{self.path}/{kind}-{n}")
            for r in self.removals:
                if r > n:
                    part = part.join(self.spark.read.parquet(f"{self.path}/removed-{r}"), "doc_id", "left_anti")
            parts.append(part)
        return reduce(DataFrame.unionByName, parts) if parts else None

    def postings(self) -> DataFrame:
        """term, doc_id, tf and positions; a condition on term reaches the files."""
        live = self._live("postings")
        return self.spark.createDataFrame([], "term string, doc_id long, tf long, positions array<int>") if live is None else live

    def lengths(self) -> DataFrame:
        """doc_id and its number of words."""
        live = self._live("lengths")
        return self.spark.createDataFrame([], "doc_id long, n long") if live is None else live

    def optimize(self) -> Index:
        """One segment of all; the older ones go."""
        old, n = [*self.segments, *self.removals], self._next
        self.postings().repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.block.size", 1 << 22).parquet(f"{self.path}/postings-{n}")
        self.lengths().write.mode("overwrite").parquet(f"{self.path}/lengths-{n}")
        for i in old:
            for kind in ("lengths", "postings", "removed"):
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{i}"), True)
        return Index(self.spark, self.path)


def upserted(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings after documents are added again: the old ones of these documents go."""
    return removed(index, fresh.select("doc_id").distinct()).unionByName(fresh)


def removed(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids, "doc_id", "left_anti")


def term(index: DataFrame, word: str) -> DataFrame:
    return index.filter(F.col("term") == word.lower()).select("doc_id")


def all_of(index: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with every term: one grouped pass over the terms' postings; no terms, no documents."""
    wanted = sorted({t.lower() for t in terms})
    hits = index.filter(F.col("term").isin(*wanted)) if wanted else index.filter(F.lit(False))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("doc_id")


def any_of(index: DataFrame, terms: list[str]) -> DataFrame:
    wanted = sorted({t.lower() for t in terms})
    return (index.filter(F.col("term").isin(*wanted)) if wanted else index.filter(F.lit(False))).select("doc_id").distinct()


def without(index: DataFrame, include: str, exclude: str) -> DataFrame:
    return term(index, include).join(term(index, exclude), "doc_id", "left_anti")


# -- set algebra over id tables --------------------------------------------------------------------


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersect_all(lists: list[DataFrame]) -> DataFrame:
    """Ids in every list, by one grouped pass instead of a chain of joins."""
    column = lists[0].columns[0]
    each = reduce(DataFrame.unionByName, [x.distinct() for x in lists])
    return each.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") == len(lists)).select(column)


def union_all(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lists).distinct()


# -- query trees -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    inner: object


def _words(tree) -> set[str]:
    if isinstance(tree, Term):
        return {tree.word.lower()}
    if isinstance(tree, Not):
        return _words(tree.inner)
    return set().union(*map(_words, tree.parts)) if tree.parts else set()


def _holds(tree):
    if isinstance(tree, Term):
        return F.array_contains("terms", tree.word.lower())
    if isinstance(tree, Not):
        return ~_holds(tree.inner)
    if not tree.parts:
        return F.lit(False)
    parts = [_holds(p) for p in tree.parts]
    return reduce(lambda a, b: a & b if isinstance(tree, And) else a | b, parts)


def matching(index: DataFrame, universe: DataFrame, tree) -> DataFrame:
    """Documents of the universe for which the tree holds; NOT is the complement in it.

    The tree's own postings are gathered per document once (at most the tree's words in a row), and the tree is one condition over them.
    """
    hits = index.filter(F.col("term").isin(*sorted(_words(tree)))).groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    each = universe.select("doc_id").distinct().join(hits, "doc_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return each.filter(_holds(tree)).select("doc_id")


# -- statistics ------------------------------------------------------------------------------------


def vocabulary(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def stats(index: DataFrame) -> DataFrame:
    """Terms, documents, postings and the average, upper median, longest and shortest list.

    The median comes from how many lists have each length, a small table, not from ranking all lists.
    """
    lengths = vocabulary(index).groupBy("df").agg(F.count("*").alias("n"))
    up = Window.orderBy("df").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    placed = lengths.select("df", "n", F.sum("n").over(up).alias("upto"), F.sum("n").over(total).alias("terms"))
    got = placed.agg(
        F.max("terms").alias("terms"),
        F.sum(F.col("df") * F.col("n")).alias("postings"),
        F.min(F.when(F.col("upto") > F.floor(F.col("terms") / 2), F.col("df"))).alias("median_length"),
        F.max("df").alias("max_length"),
        F.min("df").alias("min_length"),
    )
    docs = index.select(F.countDistinct("doc_id").alias("documents"))
    return got.crossJoin(F.broadcast(docs)).select("terms", "documents", "postings", (F.col("postings") / F.col("terms")).alias("avg_length"), "median_length", "max_length", "min_length")


def bm25(index: DataFrame, lengths: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id and the BM25 score for the terms; index has tf, lengths (doc_id, n) the words of each document."""
    wanted = sorted({t.lower() for t in terms})
    whole = lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    hits = index.filter(F.col("term").isin(*wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (whole["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(whole["mean"])))
    # at most one row for each wanted term
    return hits.join(F.broadcast(df), "term").join(lengths, "doc_id").groupBy("doc_id").agg(F.sum(idf * weight).alias("bm25"))
