"""Personal data: base expressions, then contextual patterns bootstrapped from what they found.

``scan`` reads each whole text once.  It gives the base spans and the loose candidates: strings shaped
like an identifier that the base expressions did not take, and for both the words before them.
Patterns are those words (the last one, and the last two) with a kind.  ``bootstrap`` scores the graph
of patterns and instances in rounds until no pattern is added: a pattern's confidence is the share of its
kind in all that is known of what it precedes: seeds of all kinds, places where no identifier follows, and
candidates at the confidence that accepted patterns gave them.  Candidates of which nothing is known take
no part.  An instance's confidence is one less the chance that all its patterns are wrong; seeds keep 1.
Patterns of at least ``MIN_CONFIDENCE`` that stand before ``MIN_SEEDS`` different seeds in as many different texts
turn the candidates behind them into spans.  Graph edges are counted before any shuffle, so a word or an
identifier that a third of all rows share is one row a task.

Defined results: a null or empty text has no spans; spans count code points, the end exclusive; a found
span never removes or changes a base span and never overlaps one; repeated rows get equal spans and
count as one text for support; texts, words and identifiers are read whole; names of other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import bounded, place, steps, table, unnamed, written

KINDS = ("email", "ip", "card", "phone")
MIN_CONFIDENCE, MIN_SEEDS = 0.9, 5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a try inside a run of digits fails where the one at its start did, so only starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

#: shapes of identifiers that the base expressions leave out, by kind
_LOOSE = {
    "email": re.compile(r"(?<![^\s<(\[])[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)[A-Za-z0-9-]{1,63}){1,8}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}){1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z+.-])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z]|[\x20-][0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z]|[.-][0-9])"),
}
_WORD = re.compile(r"[^\W\d_]+")
_AT = re.compile(r"\(at\)|\[at\]|\{at\}", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of the base expressions, leftmost and non-overlapping for each kind, in order."""
    out = []
    if "@" in text:
        before = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            # a local part is all that may stand before its sign, back to the end of the match before
            while start > before and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                before = m.end()
    if not text.isalpha():
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NO_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that touch no base span; where two overlap, the earlier kind's and then the leftmost stays."""
    taken = sorted((s, e) for s, _, e in base)
    out: list[tuple[int, int, int]] = []
    digits = any(c in text for c in "0123456789")
    for k, kind in enumerate(KINDS):
        if kind != "email" and not digits or kind == "ip" and text.count(":") < 3 or kind == "email" and not _AT.search(text):
            continue
        # a kind's matches don't overlap each other, so only spans of earlier kinds are in the way
        free, i = [], 0
        for m in _LOOSE[kind].finditer(text):
            s, e = m.span()
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if i == len(taken) or taken[i][0] >= e:
                free.append((s, e))
        out += [(s, k, e) for s, e in free]
        taken = sorted(taken + free)
    return sorted(out)


def contexts(text: str, starts: list[int]) -> list[list[str]]:
    """For places in order, the last word and the last two words before each, in lower case."""
    out, last, at = [], [], 0
    for start in starts:
        # a word that a place cuts is read up to it, and from its beginning again for the next place
        found = list(_WORD.finditer(text, at, start))
        last = [*last, *((m.start(), m[0].lower()) for m in found)][-2:]
        out.append([" ".join(w for _, w in last[-n:]) for n in range(1, len(last) + 1)])
        if found and found[-1].end() == start:
            at, last = found[-1].start(), last[:-1]
        else:
            at = max(at, start)
    return out


def firsts(text: str, starts: list[int]) -> list[bool]:
    """Of places in order, whether a word stands between each and the place before."""
    return [_WORD.search(text, before, at) is not None for before, at in zip([0, *starts], starts, strict=False)]


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_MARK = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.bool_()), ("first", pa.bool_()), ("instance", pa.string()), ("before", pa.list_(pa.string()))])
_SCANNED = "row_id long, key {}, print long, n_email long, n_ip long, n_card long, n_phone long, base string, marks array<struct<kind int, start int, stop int, seed boolean, first boolean, instance string, before array<string>>>"


def plain_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print, text) under these names, print being a hash of the text."""
    plain, names = unnamed(docs)
    key_, text_ = plain[f"_{place(names, key)}"], plain[f"_{place(names, text)}"]
    return plain.select(key_.alias("key"), F.xxhash64(text_).alias("print"), text_.alias("text"))


def scan(rows: DataFrame) -> DataFrame:
    """A row per document (key, print, text): its base spans in words, their counts, and all marks (seeds and candidates) with their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = (TaskContext.get().partitionId() << 40), 0
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base_text, marks = [], []
            for value in batch.column(2):
                t = value.as_py() or ""
                base = base_spans(t)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                base_text.append(spell(base))
                both = sorted([(*x, True) for x in base] + [(*x, False) for x in loose_spans(t, base)])
                starts = [x[0] for x in both]
                marks.append([{"kind": k, "start": s, "stop": e, "seed": seed, "first": first, "instance": t[s:e].lower(), "before": before} for (s, k, e, seed), first, before in zip(both, firsts(t, starts), contexts(t, starts), strict=True)])
            numbers = pa.array(range(first + n, first + n + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [numbers, batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_text, pa.string()), pa.array(marks, pa.list_(_MARK))],
                ["row_id", "key", "print", "n_email", "n_ip", "n_card", "n_phone", "base", "marks"],
            )

    return written(rows.mapInArrow(run, _SCANNED.format(rows.schema["key"].dataType.simpleString())), "marks", lasting=True)


def occurrences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, places): how often each wanted word or pair of words following each other is in the texts."""
    words = texts.toDF("text").filter("text IS NOT NULL").select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0)).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.col("w").alias("x"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("y"))).alias("p"))
    each = pairs.select(F.explode(F.array("p.x", F.concat("p.x", F.lit(" "), "p.y"))).alias("pattern"))
    return each.join(bounded(wanted), "pattern").groupBy("pattern").agg(F.count("*").alias("places"))


def bootstrap(scanned: DataFrame, texts: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Accepted patterns: (pattern, kind, confidence).  texts has the text column that was scanned."""
    marks = scanned.select("row_id", F.explode("marks").alias("m")).select("row_id", "m.*")
    edges = written(
        marks.select("row_id", "kind", "instance", "seed", "first", F.explode("before").alias("pattern"))
        .groupBy("pattern", "kind", "instance")
        .agg(F.max("seed").alias("seed"), F.count("*").alias("n"), F.count_if("first").alias("firsts")),
        "pattern-edges",
    )
    often = edges.groupBy("pattern", "kind").agg(F.count_if("seed").alias("seeds")).filter(F.col("seeds") >= min_seeds)
    # and in as many texts, each counted once for a pattern before any are summed
    seen = scanned.select("print", F.explode("marks").alias("m")).filter("m.seed").select("print", "m.kind", F.explode("m.before").alias("pattern"))
    spread = seen.distinct().groupBy("pattern", "kind").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_seeds)
    able = written(often.join(spread.select("pattern", "kind"), ["pattern", "kind"]), "able-patterns")
    wanted = written(able.select("pattern").distinct(), "wanted-patterns")
    met = edges.groupBy("pattern").agg(F.sum("firsts").alias("met"))
    places = occurrences(texts, wanted).join(met, "pattern", "left")
    # places of a pattern with no identifier behind it count against each of its kinds
    plain = written(places.select("pattern", F.greatest(F.lit(0), F.col("places") - F.coalesce("met", F.lit(0))).alias("plain")), "plain-places")
    instance = edges.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("conf"))
    sure, many = None, 0
    while True:
        known = edges.join(instance.filter("conf > 0"), ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("conf")).alias("good"), F.sum("n").alias("n"))
        total = known.groupBy("pattern").agg(F.sum("n").alias("total"))
        scored = able.join(known, ["pattern", "kind"]).join(total, "pattern").join(plain, "pattern", "left")
        patterns = scored.select("pattern", "kind", (F.col("good") / (F.col("total") + F.coalesce("plain", F.lit(0)))).alias("confidence")).filter(F.col("confidence") >= min_confidence)
        # a pattern once accepted stays, so the rounds end
        sure = written(patterns if sure is None else sure.unionByName(patterns.join(sure, ["pattern", "kind"], "left_anti")), "sure-patterns")
        before, many = many, sure.count()
        if many == before:
            return sure
        wrong = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce(F.col("confidence"), F.lit(0.0))))))
        instance = written(
            edges.join(sure, ["pattern", "kind"], "left").groupBy("kind", "instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - wrong).alias("conf")),
            "instances",
        )


def discover(scanned: DataFrame, accepted: DataFrame) -> DataFrame:
    """row_id and the spans (start, kind, stop) of candidates behind an accepted pattern."""
    marks = scanned.select("row_id", F.explode("marks").alias("m")).filter("NOT m.seed")
    loose = marks.select("row_id", "m.kind", "m.start", "m.stop", F.explode("m.before").alias("pattern"))
    accepted = written(accepted, "accepted")
    hits = loose.join(accepted.select("pattern", "kind"), ["pattern", "kind"])
    return hits.groupBy("row_id").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("found"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of the base kinds, base (spans in words) and spans (base and found ones)."""
    rows = plain_rows(docs, key, text)
    with steps(docs.sparkSession):
        scanned = scan(rows)
        found = written(discover(scanned, bootstrap(scanned, rows.select("text"))), "found", lasting=True)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    word = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])
    own = F.transform(F.filter("marks", lambda m: m["seed"]), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["stop"].alias("stop")))
    every = F.sort_array(F.concat(own, F.coalesce(F.col("found"), F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))
    return (
        scanned.join(found, "row_id", "left")
        .select(F.col("key").alias(key), "n_email", "n_ip", "n_card", "n_phone", "base", F.array_join(F.transform(every, word), ",").alias("spans"))
    )


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the longest from the left."""
    out, at = [], 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with base and found spans masked in the text.

    Found spans come back to their rows by key and a hash of the text; rows equal in both have equal spans.
    """
    plain, names = unnamed(docs)
    at, key_, text_ = place(names, text), f"_{place(names, key)}", f"_{place(names, text)}"
    length_at = place(names, length) if length and length.lower() in [n.lower() for n in names] else -1
    rows = plain_rows(docs, key, text)
    with steps(docs.sparkSession):
        scanned = scan(rows)
        found = discover(scanned, bootstrap(scanned, rows.select("text")))
        by_row = written(scanned.join(found, "row_id").groupBy("key", "print").agg(F.first("found").alias("found")).withColumnsRenamed({"key": "f_key", "print": "f_print"}), "found", lasting=True)
    same = plain[key_].eqNullSafe(by_row.f_key) & (F.xxhash64(plain[text_]) == by_row.f_print)
    inner = plain.columns
    joined = plain.join(bounded(by_row), same, "left").select(*inner, "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fresh = []
            for value, more in zip(batch.column(at), batch.column(len(names)), strict=True):
                t = value.as_py()
                spans = base_spans(t) if t else []
                spans += [(f["start"], f["kind"], f["stop"]) for f in more.as_py() or ()]
                fresh.append(redact(t, spans) if spans else t)
            columns = [pa.array(fresh, batch.column(at).type) if i == at else batch.column(i) for i in range(len(names))]
            if length_at >= 0:
                columns[length_at] = pa.array([None if t is None else len(t) for t in fresh], batch.column(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, inner)

    return joined.mapInArrow(run, plain.schema).toDF(*names)


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
