"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct shingles of ``size`` words.  Minima of ``ROWS * BANDS`` hash functions give
band keys (from whole minima) and a signature of the lowest two bits of each minimum.  Documents with equal sets are one class and
meet again only at the end.  Classes that share a band key are candidates; bit counts over signatures
estimate their similarity, corrected for chance agreement, and drop those that are ``SLACK`` below the
limit (six standard deviations); what is left is confirmed on the whole sets of the texts.

Candidates are tested in rounds (``graph.linked``), so that a large group never becomes all its pairs, and
the rounds end with a full test of what is not connected by then.

Defined results: a null text or one without words has no shingles, is linked with nothing and is its own
component; one with fewer words than a shingle has its whole sequence as its only one; a null key never
is the smallest of a component with other keys; rows equal in key and text share all their values.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import bounded, place, steps, table, unnamed, written
from larkspan.llm.graph import linked

ROWS, BANDS, BITS = 5, 40, 2
HASHES = ROWS * BANDS
WORDS = -(-HASHES * BITS // 64)
LIMIT, SLACK, ROUNDS, BLOCK = 80, 20, 3, 256
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, in UTF-8."""
    return text.encode().translate(_LOWER).split() if text else []


def shingles_of(text: str | None, size: int = 2) -> frozenset:
    """The set of a text: tuples of words."""
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else frozenset([tuple(w)])


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 300_000:
            self.clear()
        self[word] = h
        return h


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, HASHES, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 64, HASHES, np.uint64, endpoint=False)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) ^ (x >> np.uint64(32))


def hashed_shingles(text: str | None, hashes: WordHashes, size: int = 2) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    w = words_of(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    size = min(size, len(w))
    n = len(h) - size + 1
    out = h[:n].copy()
    for i in range(1, size):
        out = _mix(out) + h[i : n + i]
    return np.unique(_mix(out + np.uint64(size)))


def minima(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    a, b = _functions()
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        low = np.minimum(low, (a[:, None] * shingles[None, i : i + block] + b[:, None]).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, different bands never meeting by design."""
    rows, key = low.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low two bits of each minimum, 32 to a long.  Minima are mixed first, as their own low bits follow from few of the shingle's."""
    bits = (_mix(low) & np.uint64(3)).astype(np.uint64)
    full = np.zeros(WORDS * 32, np.uint64)
    full[:HASHES] = bits
    return (full.reshape(WORDS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


def estimate(one: str, two: str) -> Column:
    """Similarity from the bit counts of two signatures, corrected for minima that agree in two bits by chance."""
    differing = None
    for i in range(WORDS):
        x = F.col(f"{one}.s{i}").bitwiseXOR(F.col(f"{two}.s{i}"))
        n = F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
        differing = n if differing is None else differing + n
    return ((1 - differing / HASHES) - 0.25) / 0.75


_SIG = ", ".join(f"s{i}: bigint" for i in range(WORDS))
_BASE = f"uid long, key {{}}, print long, n_shingles long, digest binary, sig struct<{_SIG}>, bands array<bigint>"


def signatures(docs: DataFrame, key: str, text: str, size: int = 2) -> DataFrame:
    """A row per document with its class digest, signature and band keys; whole texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, uid = WordHashes(), TaskContext.get().partitionId() << 40
        kind = pa.struct([(f"s{i}", pa.int64()) for i in range(WORDS)])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [hashed_shingles(t.as_py(), hashes, size) for t in part.column(2)]
                digests, sigs, bands = [], [], []
                for s in sets:
                    low = minima(s) if len(s) else None
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(packed(low) if len(s) else np.zeros(WORDS, np.int64))
                    bands.append(band_keys(low).tolist() if len(s) else None)
                table_ = np.array(sigs).reshape(-1, WORDS)
                sig = pa.StructArray.from_arrays([pa.array(table_[:, i]) for i in range(WORDS)], fields=list(kind))
                columns = [pa.array(range(uid, uid + part.num_rows), pa.int64()), part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), sig, pa.array(bands, pa.list_(pa.int64()))]
                uid += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, ["uid", "key", "print", "n_shingles", "digest", "sig", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("print"), docs[text].alias("text"))
    return written(rows.mapInArrow(run, _BASE.format(kind)), "signatures")


def confirm(pairs: DataFrame, texts: DataFrame, limit: int, size: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= limit * union of their whole sets.

    A bounded table of pairs goes to the texts, so only texts of pairs are shuffled; a larger one meets them
    by a, then by b, both sides of both joins being plain shuffles, so adaptive execution splits a hub's pairs.
    """
    pairs = bounded(pairs)
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(pairs, "a")
    wanted = texts.join(pairs.select(F.col("b").alias("node")), "node", "left_semi")
    both = one.join(wanted.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column(2), batch.column(3), strict=True):
                s, t = text_a.as_py(), text_b.as_py()
                if last[0] != t:
                    last = (t, shingles_of(t, size))
                x, y = shingles_of(s, size), last[1]
                common = len(x & y)
                keep.append(100 * common >= limit * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def exhaust(placed: DataFrame, top: DataFrame, known: DataFrame, limit: int, size: int) -> DataFrame:
    """Links between nodes of different components that share an open bucket.

    Buckets with the same most common component are one family; its outsiders meet all its members in
    blocks of ``BLOCK`` times ``BLOCK`` nodes, each text going once to a block, so pairs never are rows.
    Signatures go first and whole sets decide.  Small families share blocks.
    """
    family = written(placed.join(top, "bucket").groupBy(F.col("top_comp").alias("g"), "node").agg(F.max("comp").alias("comp")).withColumn("out", F.col("comp") != F.col("g")), "families")
    sizes = family.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("rows"), F.ceil(F.count_if("out") / BLOCK).alias("outs"))
    sizes = written(sizes, "family-sizes")
    shared = max(1, family.count() // BLOCK)
    at = family.join(sizes, "g")
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outs = at.filter("out").withColumn("i", number("outs")).withColumn("j", spread("rows")).withColumn("side", F.lit(0))
    rows = at.withColumn("j", number("rows")).withColumn("i", spread("outs")).withColumn("side", F.lit(1))
    block = F.when(F.col("rows") == 1, F.pmod(F.xxhash64("g"), F.lit(shared))).otherwise(F.xxhash64("g", "i", "j"))
    placed_ = written(outs.unionByName(rows).select(block.alias("block"), "g", "node", "comp", "side"), "blocks")
    full = placed_.join(known, "node").select("block", "g", "node", "comp", "side", "text", *[f"sig.s{i}" for i in range(WORDS)])
    least = HASHES * (0.25 + 0.75 * (limit - SLACK) / 100)

    def test(pdf):
        import pandas as pd

        found = []
        for _, family_ in pdf.groupby("g"):
            a, b = family_[family_["side"] == 0], family_[family_["side"] == 1]
            sig_a, sig_b = (x[[f"s{i}" for i in range(WORDS)]].to_numpy(np.int64).view(np.uint64) for x in (a, b))
            comp_a, comp_b, node_a, node_b = a["comp"].to_numpy(), b["comp"].to_numpy(), a["node"].to_numpy(), b["node"].to_numpy()
            sets: dict[int, frozenset] = {}
            texts = dict(zip([*node_a, *node_b], [*a["text"], *b["text"]], strict=True))
            for i in range(len(a)):
                x = sig_a[i][None] ^ sig_b
                agreeing = HASHES - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
                for j in np.flatnonzero((agreeing >= least) & (comp_b != comp_a[i])):
                    pair = []
                    for node in (node_a[i], node_b[j]):
                        if node not in sets:
                            sets[node] = shingles_of(texts[node], size)
                        pair.append(sets[node])
                    few, many = sorted(map(len, pair))
                    if 100 * few >= limit * many:
                        common = len(pair[0] & pair[1])
                        if 100 * common >= limit * (few + many - common):
                            found.append((max(node_a[i], node_b[j]), min(node_a[i], node_b[j])))
        return pd.DataFrame(found, columns=["a", "b"])

    return full.groupBy("block").applyInPandas(test, "a long, b long").distinct()


def classified(docs: DataFrame, key: str, text: str, size: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (digest, group, component_id) of all classes with words."""
    base = signatures(docs, key, text, size)
    classes = written(base.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("low"), F.min("uid").alias("node")), "classes")
    reps = written(base.drop("digest").join(classes.select("node"), F.col("uid") == F.col("node")).select("node", "key", "print", "sig", "bands"), "representatives")
    keyed = reps.select("node", F.explode("bands").alias("bucket"))
    shared = written(keyed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("bucket"), "shared-bands")
    members = written(keyed.join(shared, "bucket"), "members")
    known = written(reps.drop("bands").join(members.select("node").distinct(), "node"), "candidates")
    texts = _texts(docs, known, key, text)
    sigs = known.select("node", "sig")
    best_possible = (limit - SLACK) / 100

    def promising(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose estimate is high enough, with it."""
        one = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
        both = one.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        return both.select("a", "b", estimate("sig_a", "sig_b").alias("likeness")).filter(F.col("likeness") >= best_possible)

    comp = linked(members, promising, lambda pairs: confirm(pairs, texts, limit, size), lambda placed, top: exhaust(placed, top, texts.join(sigs, "node"), limit, size), ROUNDS)
    group = F.coalesce("component", "node")
    placed = classes.join(comp, "node", "left").select("digest", "low", group.alias("group"))
    lowest = written(placed.groupBy("group").agg(F.min("low").alias("component_id")), "lowest")
    return base, written(placed.join(lowest, "group").select("digest", "group", "component_id"), "by-digest")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2, limit: int = LIMIT) -> DataFrame:
    """key, n_shingles, component_id and kept for every row."""
    plain, names = unnamed(docs)
    with steps(docs.sparkSession):
        base, classes = classified(plain, f"_{place(names, key)}", f"_{place(names, text)}", size, limit)
        own = base.join(classes, "digest", "left").select("key", "n_shingles", F.coalesce("component_id", "key").alias("component_id"))
        own = written(own, "components", lasting=True).withColumnRenamed("key", key)
    return own.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, limit: int = LIMIT) -> DataFrame:
    """The rows and columns of the table with one row of each component: the one with the smallest key, null last; rows equal in key and text count as one."""
    plain, names = unnamed(docs)
    key_, text_ = f"_{place(names, key)}", f"_{place(names, text)}"
    with steps(docs.sparkSession):
        base, classes = classified(plain, key_, text_, size, limit)
        rows = base.join(classes.select("digest", "group"), "digest", "left").select("key", "print", "group")
        first = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min_by(F.struct("key", "print"), F.struct(F.col("key").isNull(), "key", "print")).alias("k")).select("k.*")
        stay = first.unionByName(rows.filter("group IS NULL").select("key", "print")).distinct()
        stay = written(stay, "staying", lasting=True).withColumnsRenamed({"key": "k_key", "print": "k_print"})
    found = plain.withColumn("print", F.xxhash64(text_)).join(stay, plain[key_].eqNullSafe(stay.k_key) & (F.col("print") == stay.k_print), "left_semi")
    return found.dropDuplicates([key_, "print"]).drop("print").toDF(*names)


def _texts(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """node and text of the candidate classes; a node's row is found by key and a hash of the text."""
    rows = docs.select(docs[key].alias("d_key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("d_print"))
    want = bounded(written(known.select("node", "key", "print"), "wanted"))
    got = rows.join(want, rows.d_key.eqNullSafe(want.key) & (rows.d_print == want["print"])).select("node", "text")
    return written(got.dropDuplicates(["node"]), "texts")


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
