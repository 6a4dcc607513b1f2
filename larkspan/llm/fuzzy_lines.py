"""Near-equal lines across documents, by SimHash, with DataFrame operations alone.

A line is normalised to its words in lower case; lines equal in that are one line.  Its SimHash is cut in
``BLOCKS`` blocks.  A word votes in one block only, which its hash picks, and its weight grows so steeply with
its length (then its hash) that the heaviest word of a block outvotes the others: the block's bits are
those of that word's hash, and a block without words is 0.  So an edit changes the blocks of its words and no
others, in lines of any length.

Candidates share two or three blocks (pigeonhole):

* lines of ``LONG`` words and more: three neighbours in the circle of blocks, which any two lines have that
  agree in seven of their ten blocks or more;
* lines of ``SHORT[0]`` to ``SHORT[1]`` words: any two of half as many blocks, each two of the former, which lines have
  that differ in two words;
* lines of up to ``FEW`` words: all words but one that holds at most 60 % of the letters; and lines of up
  to ``TINY`` characters: all characters but one.

Of these, lines are compared whose lengths fit and whose SimHashes (``BITS`` bits a block) agree in half of the blocks that have
words in either; lines of up to ``TINY`` characters always are.  Two are linked if the edit distance of the normalised lines is at most a
fifth of the longer one, in letters; counts of letters rule pairs out first, which loses none.  Of each connected group the first occurrence stays, by key, then line number.  Candidates are a matter of chance where edits touch nearly every word or block.

Defined results: a null text stays null and an empty one empty; lines without a word stay and are never
linked; rows equal in key and text count as one and keep the same lines; null keys come first; other
columns stay as they are, whatever their names, and a table without rows gives none.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import bounded, place, released, steps, table, unnamed, written
from larkspan.llm.graph import components

PERCENT = 80
BLOCKS, AGREE, BITS = 10, 0.5, 6
LONG, SHORT, FEW, TINY, LIGHT = 20, (8, 25), 10, 24, 3
#: letters of a piece at most, and characters that stand for pieces (the first and how many)
PIECE, CODES = 4, (0x100, 0xD400 - 0x100)
#: longer lines are compared by pieces first
LETTERS = 200
#: characters that are counted each by itself; what else a line has is counted together
COUNTED = " abcdefghijklmnopqrstuvwxyz"
#: pairs that hubs leave open are dealt into so many parts by hash; a turn ends before the part named, and links of a turn spare pairs of the next
PARTS, TURNS = 32, (1, 8, 32)
#: one join gives the pairs of all turns up to the one that ends here
JOINS = (8, 32)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line: key, two hashes of key and text, line number, two hashes of the normalised line and the line.

    What a document has once is computed before its lines are rows, so that no line carries its text.
    """
    rows = docs.select(docs[key].alias("key"), *_row(docs[key], docs[text]), F.split(docs[text], "\n").alias("lines"))
    rows = rows.select("key", "d1", "d2", F.posexplode("lines").alias("line", "raw")).withColumn("norm", normalised(F.col("raw")))
    return rows.select("key", "d1", "d2", "line", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), "norm")


def _row(key: Column, text: Column) -> list[Column]:
    return [F.xxhash64(key, text).alias("d1"), F.xxhash64(F.lit(1), key, text).alias("d2")]


def sketches(occ: DataFrame) -> DataFrame:
    """A row per distinct line: node, h1, h2, occurrences n, its length, words, and the heaviest word of each block as t0, t1 ..."""
    all_ = F.split("norm", " ")
    split = occ.select("h1", "h2", F.length("norm").alias("len"), F.size(all_).alias("words"), all_.alias("all"))
    words = split.select("h1", "h2", "len", "words", F.posexplode("all").alias("place", "word"))
    # the first word counts the occurrences; short ones can't be the heaviest but in lines that have hardly others
    words = words.filter(f"place = 0 OR length(word) > {LIGHT} OR len < words * {LIGHT + 1}").withColumn("h", F.xxhash64("word"))
    weight = F.shiftleft(F.least(F.length("word"), F.lit(31)), 26).bitwiseOR(F.col("h").bitwiseAND(F.lit((1 << 26) - 1)).cast("int"))
    block = F.shiftright(F.shiftrightunsigned("h", 56) * BLOCKS, 8)
    votes = words.select("h1", "h2", "len", "words", "place", weight.alias("vote"), block.alias("block"))
    most = [F.max(F.expr(f"if(block = {i}, vote, 0)")).alias(f"t{i}") for i in range(BLOCKS)]
    lines = votes.groupBy("h1", "h2").agg(F.sum(F.expr("if(place = 0, 1L, 0L)")).alias("n"), F.max("len").alias("len"), F.max("words").alias("words"), *most)
    bits = lambda i: F.expr(f"if(t{i} = 0, 0L, cast(t{i} % {(1 << BITS) - 1} + 1 AS long))")
    sim = reduce(Column.bitwiseOR, [F.shiftleft(bits(i), BITS * i) for i in range(BLOCKS)])
    return lines.withColumn("sim", sim).withColumn("node", F.monotonically_increasing_id())


def folded(sim: Column) -> Column:
    """The lowest bit of each block that has a bit."""
    any_ = reduce(Column.bitwiseOR, [F.shiftrightunsigned(sim, i) for i in range(1, BITS)], sim)
    return any_.bitwiseAND(F.lit(sum(1 << BITS * i for i in range(BLOCKS))))


def agreement(one: str, two: str) -> Column:
    """The share of blocks in which two SimHashes agree, of those with words in either."""
    a, b = F.col(one), F.col(two)
    either = folded(a.bitwiseOR(b))
    return 1 - F.bit_count(folded(a.bitwiseXOR(b))) / F.bit_count(either)


def buckets(occ: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, len, sim, bucket): the places where lines meet their candidates."""
    t = lambda i: F.col(f"t{i % BLOCKS}")
    half = [F.greatest(t(2 * i), t(2 * i + 1)) for i in range(BLOCKS // 2)]
    own = ["node", "len", "sim"]

    def shared(kind: int, those: list[tuple[Column, ...]]) -> Column:
        named = [F.when(reduce(Column.__and__, [c > 0 for c in x]), F.xxhash64(F.lit(kind * 1000 + i), *x)) for i, x in enumerate(those)]
        return F.explode(F.array(*named)).alias("bucket")

    long_ = lines.filter(F.col("words") >= LONG).select(*own, shared(1, [(t(i), t(i + 1), t(i + 2)) for i in range(BLOCKS)]))
    short = lines.filter(F.col("words").between(*SHORT)).select(*own, shared(2, list(combinations(half, 2))))
    few = lines.filter((F.col("words") <= FEW) | (F.col("len") <= TINY)).select(*own, "h1", "h2", "words")
    texts = occ.filter(f"length(norm) <= {TINY} OR substring_index(norm, ' ', {FEW}) = norm").select("h1", "h2", "norm").distinct()
    few = written(few.join(texts, ["h1", "h2"]).drop("h1", "h2"), "few-words")
    split = few.filter(F.col("words").between(2, FEW)).select(*own, F.split("norm", " ").alias("all"))
    parts = split.select(*own, "all", F.posexplode("all").alias("i", "word")).filter("length(word) * 10 <= len * 6")
    rest = F.array_join(F.concat(F.expr("slice(all, 1, i)"), F.expr("slice(all, i + 2, size(all))")), " ")
    without = parts.select(*own, F.xxhash64(F.lit(3), rest).alias("bucket")).distinct()
    whole = few.filter(F.col("words") <= FEW).select(*own, F.xxhash64(F.lit(3), "norm").alias("bucket"))
    places = few.filter(F.col("len") <= TINY).select(*own, "norm", F.expr("explode(sequence(0, length(norm)))").alias("i"))
    left = F.expr("if(i = 0, norm, concat(substring(norm, 1, i - 1), substring(norm, i + 1)))")
    letters = places.select(*own, F.xxhash64(F.lit(4), left).alias("bucket")).distinct()
    return reduce(DataFrame.unionByName, [long_, short, without, whole, letters]).filter("bucket IS NOT NULL")


def near(one: str, two: str) -> Column:
    """SimHashes and lengths that allow a link; a name is the beginning of a line's columns."""
    a, b = F.col(f"{one}len"), F.col(f"{two}len")
    fits = F.abs(a - b) * 100 <= F.greatest(a, b) * (100 - PERCENT)
    return fits & ((a <= TINY) | (agreement(f"{one}sim", f"{two}sim") >= AGREE))


def coded(texts: DataFrame) -> DataFrame:
    """Next to a line a character for each of its pieces, by hash: words cut every ``PIECE`` letters, with the blank behind them."""
    pieces = F.regexp_extract_all("norm", F.lit(f"[^ ]{{1,{PIECE}}} ?"), F.lit(0))
    digits = F.array_join(F.transform(pieces, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(CODES[1])) + CODES[0]), 4, "0")), "")
    return texts.withColumn("code", F.decode(F.unhex(digits), "UTF-16BE"))


def letters(norm: Column) -> Column:
    """How often a line has each of ``COUNTED``, and all others."""
    n = [F.length(norm) - F.length(F.replace(norm, F.lit(c))) for c in COUNTED]
    return F.array(*n, F.length(norm) - reduce(Column.__add__, n))


def countable(one: str, two: str) -> Column:
    """Letters and lengths that allow a link: an edit takes a letter of one kind, adds one or does both, so edits are at least the larger of surplus and lack."""
    a, b = F.col(f"{one}len"), F.col(f"{two}len")
    apart = F.aggregate(F.zip_with(f"{one}letters", f"{two}letters", lambda x, y: F.abs(x - y)), F.lit(0), lambda n, x: n + x)
    return (apart + F.abs(a - b)) * 50 <= F.greatest(a, b) * (100 - PERCENT)


def similar(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, and their coded lines) that meet the edit rule.

    Comparing letters costs the square of a line's length, so lines over ``LETTERS`` are compared by their pieces first: an edited
    piece is an edit of at most its letters and the blank behind them.  Pairs that are within the rule even so, with an edit to spare for
    pieces that are equal by hash alone, are links; all others are compared by letters.
    """
    most = f"cast(greatest(length(norm_a), length(norm_b)) * {100 - PERCENT} div 100 as int)"
    by_pieces = f"greatest(length(norm_a), length(norm_b)) > {LETTERS} AND levenshtein(code_a, code_b, cast({most} div {PIECE + 1} - 1 as int)) >= 0"
    return pairs.filter(f"abs(length(norm_a) - length(norm_b)) <= {most} AND if({by_pieces}, true, levenshtein(norm_a, norm_b, {most}) >= 0)").select("a", "b")


def ends_placed(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The components of both ends of pairs, as a_comp and b_comp; a node without one is its own."""
    for x in "ab":
        pairs = pairs.join(bounded(comp.select(F.col("node").alias(x), F.col("component").alias(f"{x}_comp"))), x, "left")
    return pairs.select("a", "b", *[F.coalesce(f"{x}_comp", x).alias(f"{x}_comp") for x in "ab"])


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    return ends_placed(pairs, comp).filter("a_comp <> b_comp").select("a", "b")


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, which are followed among the components alone."""
    roots = components(ends_placed(links, comp).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    moved = bounded(written(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "roots"))
    old = comp.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    # roots that had no component are lines without links so far
    return old.unionByName(roots.join(comp, "node", "left_anti").select("node", "component"))


def groups(occ: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, component) of the lines that have links.

    A bucket never becomes all its pairs at once: first every member meets the bucket's hub, its smallest
    node, and the links found are followed to components.  Then members outside a bucket's most common
    component meet its members of other components, each pair in one bucket of those that it shares, unless
    counts of letters rule it out.  They do so in turns: a small part of the pairs, picked by hash, finds most of the links that
    join components, and pairs within a component needn't be compared in the next turn.  The last turn has all that is left, so
    candidates that aren't compared are connected anyway or can't be linked.  Turns of one join share its pairs, and links of a
    turn are followed among components, not from the lines again.
    """
    spark = occ.sparkSession
    keyed = buckets(occ, lines)
    shared = written(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    released(spark)
    members = written(keyed.join(bounded(shared, 2_000_000), "bucket"), "members")
    released(spark)

    def texts(nodes: DataFrame) -> DataFrame:
        want = written(lines.select("node", "h1", "h2").join(bounded(nodes), "node"), "node-lines")
        return occ.select("h1", "h2", "norm").join(bounded(want), ["h1", "h2"]).dropDuplicates(["node"]).select("node", "norm")

    def ends(pairs: DataFrame) -> DataFrame:
        return written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "pair-nodes")

    def confirm(pairs: DataFrame, found: DataFrame) -> DataFrame:
        half = lambda x: found.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("norm", "code")])
        return written(similar(half("a").join(pairs, "a").join(half("b"), "b")), "line-links")

    def opened(rows: DataFrame, comp: DataFrame) -> DataFrame:
        """The rows in buckets of more than one component, with their own (comp) and the bucket's most common one (top)."""
        placed = rows.join(bounded(comp), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("size")).groupBy("bucket").agg(F.max_by("comp", "size").alias("top"), F.count("*").alias("comps"))
        return placed.join(written(sizes.filter("comps > 1").select("bucket", "top"), "open-buckets"), "bucket")

    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub_node"), *[F.min_by(c, "node").alias(f"hub_{c}") for c in ("len", "sim")])
    met = members.join(hubs, "bucket").filter((F.col("node") != F.col("hub_node")) & near("", "hub_"))
    pairs = written(met.select(F.col("node").alias("a"), F.col("hub_node").alias("b")).distinct(), "pairs")
    links = confirm(pairs, written(coded(texts(ends(pairs))), "pair-texts"))
    # buckets of two are done; members of others that the hub did not connect
    comp = written(components(links), "components")
    left = written(opened(members.filter("n > 2").drop("n"), comp).drop("comp", "top"), "open")
    nodes = written(left.groupBy("node").agg(F.collect_list("bucket").alias("every")), "open-nodes")
    known = written(texts(nodes.select("node")), "open-texts")
    left = written(left.join(nodes.join(known.select("node", letters(F.col("norm")).alias("letters")), "node"), "node"), "open-places")
    side = lambda x: [F.col(c).alias(f"{x}{c}") for c in ("node", "comp", "len", "sim", "every", "letters")]
    # buckets that two components share stay open, so the smallest one that a pair shares is the same in all turns
    once = F.expr("(b_comp = top OR a_node < b_node) AND bucket = array_min(array_intersect(a_every, b_every))")
    part = F.pmod(F.xxhash64(F.greatest("a_node", "b_node"), F.least("a_node", "b_node")), F.lit(PARTS))
    # few pairs of these turns are links, so pieces would seldom spare a comparison by letters
    plain = known.withColumn("code", F.lit(None).cast("string"))
    for start, stop in zip((0, *JOINS), JOINS, strict=False):
        placed = written(opened(left, comp), "open-now")
        outside = placed.filter("comp <> top").select("bucket", "top", *side("a_"))
        may = (F.col("a_comp") != F.col("b_comp")) & near("a_", "b_") & (part >= start) & (part < stop) & once & countable("a_", "b_")
        met = outside.join(placed.select("bucket", *side("b_")), "bucket").filter(may)
        met = written(met.select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b"), part.alias("part")), "met")
        for first, end in zip((0, *TURNS), TURNS, strict=False):
            if not start <= first < stop:
                continue
            pairs = met.filter(F.col("part").between(first, end - 1)).select("a", "b")
            pairs = written(pairs if first == start else apart(pairs, comp), "pairs")
            if pairs.isEmpty():
                continue
            found = confirm(pairs, plain.join(bounded(ends(pairs)), "node"))
            if not found.isEmpty():
                comp = written(joined(comp, found), "components")
    return comp


def repeated(occ: DataFrame) -> DataFrame:
    """(d1, d2, gone): the lines that go from each document."""
    lines = written(sketches(occ), "sketches")
    released(occ.sparkSession)
    comp = groups(occ, lines)
    group = F.coalesce("component", "node")
    placed = lines.select("node", "h1", "h2", "n").join(comp, "node", "left").filter("n > 1 OR component IS NOT NULL").select("h1", "h2", group.alias("group"))
    placed = written(occ.select("key", "d1", "d2", "line", "h1", "h2").join(written(placed, "repeated"), ["h1", "h2"]).drop("h1", "h2"), "placed-lines")
    stays = placed.groupBy("group").agg(F.min(F.struct("key", "d1", "d2", "line")).alias("stay")).select("group", "stay.d1", "stay.d2", "stay.line")
    stays = written(stays.withColumnsRenamed({"d1": "s1", "d2": "s2", "line": "s_line"}), "stays")
    gone = placed.join(stays, "group").filter("d1 <> s1 OR d2 <> s2 OR line <> s_line")
    # at most the lines of one document in a row; rows equal in key and text have equal lines
    return gone.groupBy("d1", "d2").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the lines that stay, and n_lines and n_dropped (lines before, lines dropped)."""
    plain, names = unnamed(docs)
    key, at = f"_{place(names, key)}", place(names, text)
    text = f"_{at}"
    with steps(docs.sparkSession):
        occ = written(occurrences(plain, key, text), "occurrences").filter("norm <> ''")
        gone = written(repeated(occ), "gone-lines", lasting=True).withColumnsRenamed({"d1": "g1", "d2": "g2"})
    # documents that lose lines are sent to the texts if they and their lines are few
    size = gone.agg(F.count("*").alias("rows"), F.sum(F.size("gone")).alias("lines")).first()
    gone = F.broadcast(gone) if size["rows"] <= 500_000 and (size["lines"] or 0) <= 4_000_000 else gone
    one, two = (c for c in _row(plain[key], plain[text]))
    joined = plain.join(gone, (one == F.col("g1")) & (two == F.col("g2")), "left")
    lines = F.split(text, "\n")
    stay = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    columns = [stay.alias(c) if c == text else F.col(c) for c in plain.columns]
    out = joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))
    return out.toDF(*names, "n_lines", "n_dropped")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.greatest(F.lit(0), F.col("n_dropped")).cast("long").alias("n_dropped"), "text")
