"""Near-duplicates, lines, search, sharding and archives against brute force."""

import gzip
import hashlib
import heapq
import math
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import fuzzy_lines, graph, minhash, pivot_index, registry, sharding, warc

# -- shared ----------------------------------------------------------------------------------------


class Sets:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2040)]
    sets = Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in sets.up if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 10 --------------------------------------------------------------------------------------------


def plain_groups(rows, size):
    sets = [minhash.shingles_of(t, size) for _, t in rows]
    u = Sets(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                u.join(i, j)
    return sets, [u.find(i) for i in range(len(rows))]


def family(rng, n, base=120, edits=12):
    words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(base)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(size)
    texts = family(rng, 60) + family(rng, 20, 40, 4) + ["Same Text here"] * 5 + ["one", "ONE", "", " \n", None, "é È", "É è"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets, groups = plain_groups(rows, size)
    low = {}
    for (i, _), g in zip(rows, groups, strict=True):
        low[g] = min(low.get(g, i), i)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, bands int")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, size=size).collect()}
    assert len(got) == len(rows)
    for (i, _), s, g in zip(rows, sets, groups, strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), low[g], low[g] == i)
    left = minhash.drop_near_duplicates(df.unionByName(df.limit(3)), size=size)
    assert sorted(r.doc_id for r in left.collect()) == sorted(low.values()) and left.columns == df.columns
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    rows = list(zip(docs.doc_id, docs.text, strict=True))
    sets, groups = plain_groups(rows, 2)
    got = {r.doc_id: r for r in registry.QUERIES["op10_bbit_minhash"](spark, sf).collect()}
    for (i, _), s, g in zip(rows, sets, groups, strict=True):
        assert (got[i].n_shingles, got[i].component_id) == (len(s), rows[g][0])


def test_estimate(spark):
    a, b = (minhash.hashed_shingles(t, minhash.WordHashes()) for t in (" ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(350))))
    row = [{f"s{i}": int(v) for i, v in enumerate(minhash.packed(minhash.minima(x)))} for x in (a, b)]
    kind = f"struct<{minhash._SIG}>"
    df = spark.createDataFrame([(row[0], row[1])], f"x {kind}, y {kind}")
    assert abs(df.select(minhash.estimate("x", "y")).first()[0] - 349 / 399) < 0.12


# -- 6 ---------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark):
    """Against all pairs by the edit rule: equal lines, a family of long lines with one word changed, odd texts and clashing names."""
    rng = random.Random(8)
    long = [f"w{rng.randrange(1000)}" for _ in range(120)]
    lines = [" ".join([*long[:i], "zz", *long[i + 1 :]]) for i in range(0, 120, 4)]
    docs = [(i, "\n".join([f"own line number {i} of {rng.random()}", lines[i], "", "The  same, LINE!" if i % 2 else "the same line"])) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "\n \n"), (103, "alone"), (None, "the same line\nkeyless"), (29, docs[29][1])]
    df = spark.createDataFrame([(*d, "x", 0, 1, 2, 3, 4) for d in docs], "doc_id long, text string, line string, n_chars long, gone int, d1 int, g_doc int, key int")
    norm = df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("doc_id", "line", fuzzy_lines.normalised(F.col("raw")).alias("norm")).filter("norm <> ''").collect()
    places = defaultdict(list)
    for r in norm:
        places[r.norm].append((r.doc_id is not None, r.doc_id or 0, r.line))
    distinct = list(places)
    u = Sets(range(len(distinct)))
    linked = 0
    for i in range(len(distinct)):
        for j in range(i):
            a, b = distinct[i], distinct[j]
            if 5 * abs(len(a) - len(b)) <= max(len(a), len(b)) and distance(a, b) <= max(len(a), len(b)) * 20 // 100:
                u.join(i, j)
                linked += 1
    assert linked
    groups = defaultdict(list)
    for i, n in enumerate(distinct):
        groups[u.find(i)] += places[n]
    stay = {min(g) for g in groups.values()}
    want = Counter()
    for i, t in docs:
        blank = lambda x: not any(c.isalnum() for c in x)
        kept = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if blank(x) or (i is not None, i or 0, j) in stay)
        want[(i, kept)] += 1
    got = fuzzy_lines.dedup_lines(df)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert got.columns == [*df.columns, "n_lines", "n_dropped"] and fuzzy_lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_query(spark, sf):
    """The registered query against all pairs of lines: it drops nothing that the edit rule keeps, and nearly all that edit distance in letters alone drops."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("norm", fuzzy_lines.normalised(F.col("raw"))).filter("norm <> ''").collect()
    distinct = sorted({r.norm for r in rows if len(r.norm) <= 3000})
    letters = sorted({c for x in distinct for c in x})
    counts = np.array([[x.count(c) for c in letters] for x in distinct], np.int16)
    size = np.array([len(x) for x in distinct])
    pairs = []
    for i in range(1, len(distinct)):
        # an edit of a letter changes a count of letters by one; a fifth of the pieces have at most so many letters
        most = np.maximum(size[:i], size[i]) * 26 // 100
        surplus = np.maximum(counts[i][None] - counts[:i], 0).sum(1)
        lack = np.maximum(counts[:i] - counts[i][None], 0).sum(1)
        pairs += [(i, int(j)) for j in np.flatnonzero((np.maximum(surplus, lack) <= most) & (5 * np.abs(size[:i] - size[i]) <= np.maximum(size[:i], size[i])))]
    number = {}
    code = lambda x: "".join(chr(number.setdefault(p, 0x4E00 + len(number))) for p in re.findall("[^ ]{1,4} ?", x))
    lines = spark.createDataFrame([(i, x, code(x)) for i, x in enumerate(distinct)], "i int, x string, c string")
    assert len(number) < 0xD800 - 0x4E00
    both = spark.createDataFrame(pairs, "i int, j int").join(lines, "i").join(lines.toDF("j", "y", "d"), "j")
    within = lambda a, b: F.levenshtein(a, b) <= F.expr(f"greatest(length({a}), length({b})) * 20 div 100")
    long_ = F.greatest(F.length("x"), F.length("y")) > fuzzy_lines.LETTERS
    got = both.select("i", "j", within("x", "y").alias("by_letters"), F.when(long_, within("c", "d")).otherwise(within("x", "y")).alias("by_rule")).collect()

    def staying(links):
        u, groups, at = Sets(range(len(distinct))), defaultdict(list), {x: i for i, x in enumerate(distinct)}
        for i, j in links:
            u.join(i, j)
        for r in rows:
            groups[u.find(at[r.norm]) if r.norm in at else r.norm].append((r.doc_id, r.line))
        return {min(g) for g in groups.values()}

    every = {(r.doc_id, r.line) for r in rows}
    by_letters, by_rule = (staying([(r.i, r.j) for r in got if r[c]]) for c in ("by_letters", "by_rule"))
    found = {r.doc_id: r for r in registry.QUERIES["op6_fuzzy_lines"](spark, sf).collect()}
    assert len(found) == docs.count() and sum(r.by_letters for r in got) > 10
    assert sum(r.n_dropped for r in found.values()) >= 0.98 * len(every - by_letters) > 0
    raw = defaultdict(list)
    for r in rows:
        raw[r.doc_id].append(r)
    for i, mine in raw.items():
        must = Counter(r.raw for r in mine if (r.doc_id, r.line) in by_rule)
        assert not must - Counter(found[i].text.split("\n")), i


def test_lines_by_edits(spark):
    """Pairs that only the edit rule makes: one and two changed words at several lengths, and one letter of tiny lines."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    lines = [("ab cd", "ab xd"), ("ab cd", "abcd"), ("thing", "thingy")]
    for n in (10, 20, 40, 80):
        for changes in (1, 2):
            for _ in range(15):
                w = [word() for _ in range(n)]
                v = list(w)
                for i in rng.sample(range(n), changes):
                    v[i] = word()
                lines.append((" ".join(w), " ".join(v)))
    lines = [(a, b) for a, b in lines if distance(a, b) <= max(len(a), len(b)) * 20 // 100]
    rows = [(2 * i + j, x) for i, pair in enumerate(lines) for j, x in enumerate(pair)]
    got = {r.doc_id: r.n_dropped for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[2 * i] for i in range(1, len(lines)) if lines[i][0] != lines[0][0])
    assert sum(got[2 * i + 1] for i in range(len(lines))) >= 0.97 * len(lines) > 100


def test_long_lines_by_letters(spark):
    """Long lines in which a letter of most short words is changed: a tenth of the letters, but a third of the pieces of four letters."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = []
    for i in range(6):
        w = [word(10 if j % 3 == 0 else 3) for j in range(60)]
        v = [x[0] + "é" + x[2] if len(x) == 3 and j % 8 else x for j, x in enumerate(w)]
        far = [word(len(x)) if j % 3 else x for j, x in enumerate(w)]  # short words are others: more than a fifth
        assert len(" ".join(w)) > fuzzy_lines.LETTERS and distance(" ".join(w), " ".join(v)) <= len(" ".join(w)) // 5 < distance(" ".join(w), " ".join(far))
        rows += [(3 * i + j, " ".join(x)) for j, x in enumerate((w, v, far))]
    got = {r.doc_id: r.n_dropped for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i % 3 == 1) for i in range(18)}


def test_lines_in_turns(spark, monkeypatch):
    """Near copies about a fifth apart that no hub links at once, and lines of several kinds that share a passage: links as of all pairs, a part of them compared."""
    rng = random.Random(17)
    word = lambda abc: "".join(rng.choices(abc, k=rng.randrange(3, 9)))
    base = [word("etaoinshrdlu") for _ in range(40)]
    passage = [word("etaoinshrdlu") for _ in range(24)]
    texts = []
    for _ in range(120):
        w = list(base)
        for i in rng.sample(range(40), 5):
            w[i] = word("etaoinshrdlu")
        texts.append(" ".join(w))
    texts += [" ".join([*(word(abc) for _ in range(20)), *passage]) for abc in ("etaoin", "bcdfgé") for _ in range(40)]
    compared, plain = [], fuzzy_lines.similar
    monkeypatch.setattr(fuzzy_lines, "similar", lambda pairs: (compared.append(pairs.count()), plain(pairs))[1])
    got = {r.doc_id for r in fuzzy_lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.n_dropped}
    lines = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    pairs = lines.join(lines.toDF("j", "y"), F.expr("i < j")).filter(f"levenshtein(x, y, cast(greatest(length(x), length(y)) * {100 - fuzzy_lines.PERCENT} div 100 as int)) >= 0").collect()
    u = Sets(range(len(texts)))
    for r in pairs:
        u.join(r.i, r.j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[u.find(i)].append(i)
    assert 1000 < len(pairs) < 6500 and got == set(range(len(texts))) - {min(g) for g in groups.values()}
    assert sum(compared) < 2500, compared


def test_components_by_turns(spark):
    """Further links change components as following all links anew does: among components, among lines without links, and between both."""
    rng = random.Random(19)
    some = lambda n, most: [tuple(sorted(rng.sample(range(most), 2), reverse=True)) for _ in range(n)]
    old, new = some(120, 300), some(60, 400)
    links = spark.createDataFrame(old, "a long, b long"), spark.createDataFrame(new, "a long, b long")
    comp = graph.components(links[0])
    rows = lambda df: sorted(tuple(r) for r in df.select("node", "component").collect())
    want = rows(graph.components(links[0].unionByName(links[1])))
    assert rows(fuzzy_lines.joined(comp, links[1])) == want and want != rows(comp)
    u = Sets(range(400))
    for a, b in old:
        u.join(a, b)
    assert {tuple(r) for r in fuzzy_lines.apart(links[1], comp).collect()} == {(a, b) for a, b in new if u.find(a) != u.find(b)}


def test_turns_share_joins(spark, monkeypatch):
    """Near copies that no hub links at once: the candidates of three turns are made by two joins, and components of all lines are followed once."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randrange(3, 9)))
    base = [word() for _ in range(40)]
    texts = []
    for _ in range(120):
        w = list(base)
        for i in rng.sample(range(40), 5):
            w[i] = word()
        texts.append(" ".join(w))
    names, plain, followed, whole = Counter(), fuzzy_lines.written, [], fuzzy_lines.components
    monkeypatch.setattr(fuzzy_lines, "written", lambda df, name, lasting=False: (names.update([name]), plain(df, name, lasting))[1])
    monkeypatch.setattr(fuzzy_lines, "components", lambda edges: (followed.append(edges.count()), whole(edges))[1])
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) > 100
    assert names["open-now"] == 2 and names["pair-texts"] == 1 and len(followed) > 1 and max(followed[1:]) <= followed[0], (names, followed)


def test_letter_counts(spark):
    """Counts of letters rule out no pair within the edit rule, at its edge too, and do rule out lines of other letters."""
    rng = random.Random(18)
    rows = []
    for n in (5, 20, 63, 200):
        for _ in range(60):
            a = rng.choices("abc deé1中\U0001f600", k=n)
            b = list(a)
            for _ in range(rng.randrange(n // 5 + 3)):
                i = rng.randrange(len(b))
                b[i : i + rng.randrange(2)] = rng.choices("abxyzé", k=rng.randrange(2))
            rows.append(("".join(a), "".join(b)))
    rows.append(("abcd " * 20, "efgh " * 20))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", *[f(c).alias(f"{c}_{n}") for c in "ab" for n, f in (("len", F.length), ("letters", lambda c: fuzzy_lines.letters(F.col(c))))])
    may = [r.may for r in df.select(fuzzy_lines.countable("a_", "b_").alias("may")).collect()]
    rule = [distance(a, b) * 100 <= max(len(a), len(b)) * (100 - fuzzy_lines.PERCENT) for a, b in rows]
    assert sum(rule) > 100 and all(m for m, r in zip(may, rule, strict=True) if r) and not may[-1]


def test_blocks(spark):
    """A changed word changes two blocks at most, in lines of any length; sums of repeated lines count them."""
    rng = random.Random(4)
    rows = []
    for n in (5, 30, 400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for changes in (0, 1, 2):
            v = list(w)
            for i in rng.sample(range(n), changes):
                v[i] = f"x{rng.randrange(10**6)}"
            rows.append((n * 10 + changes, " ".join(v)))
    df = spark.createDataFrame([*rows, *rows], "doc_id long, text string")
    occ = fuzzy_lines.occurrences(df, "doc_id", "text")
    got = {r.norm: r for r in fuzzy_lines.sketches(occ).join(occ.select("h1", "h2", "norm").distinct(), ["h1", "h2"]).collect()}
    assert all(r.n == 2 and r.len == len(r.norm) and r.words == len(r.norm.split()) for r in got.values())
    blocks = lambda r: [r[f"t{i}"] for i in range(fuzzy_lines.BLOCKS)]
    for i in range(0, len(rows), 3):
        a, *others = (blocks(got[x]) for _, x in rows[i : i + 3])
        for changes, b in enumerate(others, 1):
            assert sum(x != y for x, y in zip(a, b, strict=True)) <= 2 * changes


# -- 3 ---------------------------------------------------------------------------------------------


def plain_search(rows, k):
    scaled = lambda x: 256 * x if abs(256 * x) < 2**52 else max(min(256 * x, sys.float_info.max), -sys.float_info.max)
    good = [(i, [int(math.floor(scaled(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 50 == 0:
            cut = lambda x: min(max(x, -(1 << 63) + 1), (1 << 63) - 1)
            best = sorted((-cut(sum(a * b for a, b in zip(q, v, strict=False))), j) for j, v in good if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def test_search(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    monkeypatch.setattr(pivot_index, "CHUNK", 4)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(701 + i, [rng.choice([9e6, -3e15, 2.5e30, 1e306, 1.0, 0.0]) for _ in range(6)]) for i in range(50)] + [(800, [9e6, 0.5, 0.0, 0.0, 0.0, 0.0])]
    rows += [(400 + i, [1.0] * 6) for i in range(60)] + [(600, None), (601, [float("nan")] * 6), (602, [None] * 6), (None, [1.0] * 6), (650, [0.5, 0.5]), (700, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int").select("vec_id", "embedding", "id")
    got = {tuple(r) for r in pivot_index.search(df, "id % 50 = 0").collect()}
    assert got == plain_search(rows, 5)
    # a vector much longer than the others costs no memory in the rows beside it
    long_ = df.unionByName(spark.createDataFrame([(900, [0.25] * 100_000, 1)], df.schema))
    assert {tuple(r) for r in pivot_index.search(long_, "id % 50 = 0").collect()} == plain_search([*rows, (900, [0.25] * 100_000)], 5)
    assert pivot_index.search(df.filter("vec_id < 3"), "id % 50 = 0").count() == 2
    assert pivot_index.search(df.limit(0), "id % 50 = 0").count() == 0


# -- 5 ---------------------------------------------------------------------------------------------


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards(spark, sf):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.QUERIES["op5_ring_shards"](spark, sf).collect()
    check_shards(got, 16)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items())
    hot = spark.createDataFrame([(1, "same", 1)] * 500 + [(None, None, 2)] * 3 + [(i, f"t{i}", 3) for i in range(400)], "doc_id long, text string, size int")
    rows = sharding.ring_shards(hot, 7).collect()
    assert len(rows) == 903
    check_shards(rows, 7)
    assert sharding.ring_shards(hot.limit(0), 7).count() == 0


def test_ring_moves_little():
    counts = np.random.default_rng(1).poisson(0.5, sharding.CELLS)
    assert sharding.moved_share(counts, 16) < 0.15  # a new ring of 17 needs 0.06


# -- 9 ---------------------------------------------------------------------------------------------


def test_archives(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    big = "x" * 1500
    rows = [(p.page_id, p.url, p.html, "z") for p in pages] + [(9001, "http://b.org/", big, "z"), (9003, "http://www.A.org/p#f", big, "z"), (9002, None, big, "z"), (9004, "http://a.org:8080/", None, "z"), (9005, "http://a.org/", "small", "z"), (9006, "x", "small", "z"), (None, "http://n.org", big, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    from larkspan.llm._common import scratch

    folder = scratch(spark, "warc-test")
    monkeypatch.setattr(warc, "RUN_RECORDS", 5)
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "FAN", 4)
    runs = warc.read_runs(warc.write_archives(df.repartition(3), folder), folder)
    assert runs.select("file").distinct().count() > 8
    got = warc.merge_runs(runs, folder).collect()
    assert len({r.part for r in got}) > 1
    groups = defaultdict(list)
    for i, _, h, _ in rows:
        groups[h or ""].append(i)
    want = Counter()
    for i, _, h, _ in rows:
        h = h or ""
        top = max((x for x in groups[h] if x is not None), default=None)
        revisit = len(h.encode()) >= warc.SMALL and i != top
        want[(i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", top if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    merged = [(r.url_key, r.captured) for r in sorted(got, key=lambda r: (r.part, r.place))]
    assert merged == sorted(merged)
    empty = warc.write_archives(df.limit(0), folder)
    assert warc.merge_runs(warc.read_runs(empty, folder), folder).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    assert Counter((r.page_id, r.payload_digest) for r in registry.QUERIES["op9_archive_merge"](spark, sf).collect()) == Counter((r.page_id, hashlib.sha1((r.html or "").encode()).hexdigest()) for r in pages.collect())


def test_merge_streams(spark):
    """The tree takes from each run no more than it gives and one line, and a slice opens no block beyond its range."""
    taken = Counter()

    def counted(i):
        for x in range(i, 3000, 3):
            taken[i] += 1
            yield x

    tree = iter(warc.LoserTree([counted(0), counted(1), counted(2)], lambda x: x))
    assert [next(tree) for _ in range(30)] == list(range(30)) and max(taken.values()) <= 11


def test_loser_tree():
    rng = random.Random(7)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == list(heapq.merge(*runs))


def test_record_round_trip():
    import io

    raw = b"".join(gzip.compress(warc.record(i, "http://a/\n", b"p\r\n\r\nq" * i, "d", 7 if i == 2 else None)) for i in range(4))
    found = [warc.parse(x) for _, x in warc.members(io.BytesIO(raw), 7)]
    assert [p for _, _, p in found] == [b"", b"p\r\n\r\nq", b"", b"p\r\n\r\nq" * 3]
    with pytest.raises(ValueError, match="cut"):
        list(warc.members(io.BytesIO(raw[:-9])))
    assert warc.url_key("HTTPS://www.Ex.org:443/A?b#c") == "org,ex)/A?b" and warc.url_key(None) == ""
