"""Words, inverted index and boolean retrieval over ``documents``; tags are language and source."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions.text import STOPWORDS, words
from larkspan.operators import inverted as I
from larkspan.queries import query, table
from larkspan.sources.folders import fresh, kept

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS = f"""WITH raw AS (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS ws FROM documents),
tok AS (SELECT doc_id, w, pos FROM (SELECT doc_id, regexp_replace(regexp_replace(unnest(ws), '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '') AS w, generate_subscripts(ws, 1) AS pos FROM raw) WHERE w <> '' AND w NOT IN ({STOP})),
postings AS (SELECT DISTINCT w AS term, doc_id FROM tok)
"""
TAGS = "WITH tags AS (SELECT DISTINCT trim(lower(t)) AS term, doc_id FROM (SELECT doc_id, unnest([lang, source]) AS t FROM documents) WHERE trim(lower(t)) <> '')\n"


def docs(spark, d):
    return table(spark, d, "documents")


def stored(spark, d):
    """The index of the documents, written once per session and read from its files."""
    path = kept(spark, "text-index", [f"{d}/documents.parquet"], lambda p: I.Index(spark, p).add(docs(spark, d)))
    return I.Index(spark, path)


def index(spark, d):
    return stored(spark, d).postings().select("term", "doc_id")


def tags(spark, d):
    return I.tag_postings(docs(spark, d), F.array("lang", "source"))


@query("tokenize", TOKENS + "SELECT doc_id, count(*) AS words, count(DISTINCT w) AS terms FROM tok GROUP BY doc_id")
def tokenize(spark, d):
    w = words(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("terms")).filter("words > 0")


@query("inverted_index", TOKENS + "SELECT term, doc_id FROM postings")
def inverted_index(spark, d):
    return index(spark, d)


@query("term_frequency", TOKENS + ", o AS (SELECT doc_id, w AS term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM tok) SELECT term, doc_id, count(*) AS tf, min(p) AS first_pos FROM o GROUP BY term, doc_id")
def term_frequency(spark, d):
    return I.frequencies(docs(spark, d))


@query("term_positions", TOKENS + ", o AS (SELECT doc_id, w AS term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM tok) SELECT term, doc_id, p AS pos FROM o WHERE term IN ('that', 'this')")
def term_positions(spark, d):
    hits = stored(spark, d).postings().filter(F.col("term").isin("that", "this"))
    return hits.select("term", "doc_id", F.explode("positions").alias("pos")).withColumn("pos", F.col("pos").cast("long"))


@query("index_persist", TOKENS + "SELECT w AS term, doc_id, count(*) AS tf FROM tok WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY w, doc_id")
def index_persist(spark, d):
    """Written in two segments, documents removed, merged, and read back."""
    path = fresh(spark, "text-index")
    toxic = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    half = docs(spark, d).filter("doc_id % 2 = 0"), docs(spark, d).filter("doc_id % 2 = 1")
    I.Index(spark, path).add(half[0]).add(half[1]).remove(toxic)
    return I.Index(spark, path).optimize().postings().select("term", "doc_id", "tf")


@query("tag_index", TAGS + "SELECT term, doc_id FROM tags")
def tag_index(spark, d):
    return tags(spark, d)


@query("index_remove", TAGS + "SELECT term, doc_id FROM tags WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def index_remove(spark, d):
    return I.removed(tags(spark, d), table(spark, d, "labels").filter("toxic = 1").select("doc_id")).select("term", "doc_id")


@query("term_search", TOKENS + "SELECT doc_id FROM postings WHERE term = 'that'")
def term_search(spark, d):
    return I.term(index(spark, d), "That")


@query("search_and", TOKENS + "SELECT doc_id FROM postings WHERE term IN ('that', 'this') GROUP BY doc_id HAVING count(*) = 2")
def search_and(spark, d):
    return I.all_of(index(spark, d), ["that", "this"])


@query("search_or", TOKENS + "SELECT DISTINCT doc_id FROM postings WHERE term IN ('that', 'der', 'les')")
def search_or(spark, d):
    return I.any_of(index(spark, d), ["that", "der", "les"])


@query("search_not", TOKENS + "SELECT doc_id FROM postings WHERE term = 'that' EXCEPT SELECT doc_id FROM postings WHERE term = 'this'")
def search_not(spark, d):
    return I.without(index(spark, d), "that", "this")


def _lists(spark, d):
    t = tags(spark, d)
    return [I.term(t, "en"), I.term(t, "src3"), I.term(index(spark, d), "that")]


@query("set_intersect", TAGS + "SELECT doc_id FROM tags WHERE term = 'en' INTERSECT SELECT doc_id FROM tags WHERE term = 'src3'")
def set_intersect(spark, d):
    return I.intersect(*_lists(spark, d)[:2])


@query("set_union", TAGS + "SELECT doc_id FROM tags WHERE term = 'en' UNION SELECT doc_id FROM tags WHERE term = 'src3'")
def set_union(spark, d):
    return I.union(*_lists(spark, d)[:2])


@query("set_difference", TAGS + "SELECT doc_id FROM tags WHERE term = 'en' EXCEPT SELECT doc_id FROM tags WHERE term = 'src3'")
def set_difference(spark, d):
    return I.difference(*_lists(spark, d)[:2])


BOTH = TOKENS + ", " + TAGS.removeprefix("WITH ")


@query("multi_intersect", BOTH + "SELECT doc_id FROM tags WHERE term = 'en' INTERSECT SELECT doc_id FROM tags WHERE term = 'src3' INTERSECT SELECT doc_id FROM postings WHERE term = 'that'")
def multi_intersect(spark, d):
    return I.intersect_all(_lists(spark, d))


@query("multi_union", BOTH + "SELECT doc_id FROM tags WHERE term IN ('en', 'src3') UNION SELECT doc_id FROM postings WHERE term = 'that'")
def multi_union(spark, d):
    return I.union_all(_lists(spark, d))


@query("boolean_query", TOKENS + "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM postings WHERE term = 'that') AND doc_id NOT IN (SELECT doc_id FROM postings WHERE term = 'this') OR doc_id IN (SELECT doc_id FROM postings WHERE term = 'der')")
def boolean_query(spark, d):
    tree = I.Or((I.And((I.Term("that"), I.Not(I.Term("this")))), I.Term("der")))
    return I.matching(index(spark, d), docs(spark, d), tree)


@query("vocabulary", TOKENS + "SELECT term, count(*) AS df FROM postings GROUP BY term")
def vocabulary(spark, d):
    return I.vocabulary(index(spark, d))


@query(
    "index_stats",
    TOKENS + """, n AS (SELECT term, count(*) AS df FROM postings GROUP BY term), r AS (SELECT df, row_number() OVER (ORDER BY df) - 1 AS i, count(*) OVER () AS c FROM n)
SELECT count(*) AS terms, (SELECT count(DISTINCT doc_id) FROM postings) AS documents, sum(df)::BIGINT AS postings, round(avg(df), 6) AS avg_length, max(df) FILTER (WHERE i = c // 2) AS median_length, max(df) AS max_length, min(df) AS min_length FROM r""",
)
def index_stats(spark, d):
    return I.stats(index(spark, d)).withColumn("avg_length", F.round("avg_length", 6))
