"""Packing by minimum bin slack over the histogram of remaining lengths.

Documents are tokenised once and cut into whole windows and one remainder each.  What has to be packed is
then a multiset of at most ``window`` lengths, so the driver plans with a histogram: for the longest
remaining length a bitset subset-sum programme finds the multiset of other remaining lengths that fills the
window closest to its capacity, goes back through the bitsets for the count of each length, and repeats
the pattern as often as the counts allow.  Where no multiset fills the window, the longest piece left is cut to fill it
and what is cut off counts as a piece from then on; so only the last window has padding.  Pieces get their place from their
rank among the pieces of their length, a sum over input parts, and look up their pattern; no piece is moved to
the driver.  Documents with pieces that the plan cuts are encoded once more for the checksums of the parts.

Defined results: a null or empty text is the separator alone; repeated rows are packed each by itself; a
document longer than the window gives whole windows and a remainder; an empty table gives no pieces; column names don't matter.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm._common import bounded, place, table, unnamed, written
from larkspan.llm.token_counts import byte_symbols

WINDOW, SEPARATOR = 1024, 0
#: fixed values: the split pattern of byte-level vocabularies and its setting in their files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: blanks in a row that the pattern's look-ahead can't go back over; such runs are cut off before
RUN = regex.compile(r"\p{White_Space}{10000,}")
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Ids:
    """Token ids of texts as little-endian bytes.

    The tokenizers file gives vocabulary and special tokens; tiktoken runs them, several times as fast as
    the tokenizers library and with equal ids, since an id is also a merge's priority in such files.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbol = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(symbol[c] for c in v): i for v, i in spec["model"]["vocab"].items() if v not in special}
        if spec["normalizer"] is not None or spec["pre_tokenizer"] != PRE_TOKENIZER or sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError(f"{path} is not a byte-level vocabulary in merge order")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _some(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text.  A run of blanks is one word but for its last blank, unless it ends the text."""
        out, at = [], 0
        for run in RUN.finditer(text) if len(text) >= 10000 else ():
            end = run.end() - (run.end() < len(text))
            out += [self._some(text[at : run.start()]), np.array(self.encoding._encode_single_piece(text[run.start() : end]), "<u4").tobytes()]
            at = end
        return b"".join([*out, self._some(text[at:])])


@functools.lru_cache(maxsize=1)
def _ids(path: str) -> Ids:
    """One for all the tasks of a Python worker."""
    return Ids(path)


def pieces(rows: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Of rows (key, print, text) a row per piece: key, print, start, length, ids_crc32, doc_tokens, rank among the part's pieces of its length, and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ranks, part = _ids(tokenizer), [0] * (window + 1), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                at_row, start, length, crc, total, rank, raw = [], [], [], [], [], [], []
                for i, value in enumerate(batch.column(2).slice(at, 500), at):
                    data = document(ids, value.as_py())
                    n = len(data) // 4
                    for s in range(0, n, window):
                        piece = data[4 * s : 4 * (s + window)]
                        k = len(piece) // 4
                        at_row.append(i), start.append(s), length.append(k), crc.append(zlib.crc32(piece)), total.append(n), rank.append(ranks[k])
                        ranks[k] += 1
                        if with_ids:
                            raw.append(piece)
                names = ["start", "length", "ids_crc32", "doc_tokens", "rank"]
                columns = [*(batch.column(c).take(pa.array(at_row, pa.int64())) for c in (0, 1)), *(pa.array(c, pa.int64()) for c in (start, length, crc, total, rank)), pa.array([part] * len(start), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, ["key", "print", *names, "part"] + ["ids"] * with_ids)

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, print long, start long, length long, ids_crc32 long, doc_tokens long, rank long, part long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema)


def document(ids: Ids, text: str | None) -> bytes:
    return ids.encode(text or "") + SEPARATOR.to_bytes(4, "little")


def fill(counts: dict[int, int], room: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Bitset of the sums up to room of remaining lengths, and the steps (length, copies, bitset before) to go back by."""
    reach, most, steps = 1, (1 << (room + 1)) - 1, []
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, copies = min(counts[n], room // n), 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            steps.append((n, copies, reach))
            reach |= reach << n * copies & most
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    return reach, most, steps


def chosen(steps: list[tuple[int, int, int]], total: int) -> dict[int, int]:
    """How many of each length make up a reachable total."""
    out: dict[int, int] = {}
    for n, copies, before in reversed(steps):
        if not before >> total & 1:
            out[n] = out.get(n, 0) + copies
            total -= n * copies
    return out


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int], tuple[int, int] | None]]:
    """Patterns (times, copies of each length, a cut) that use every piece once.

    A cut (length, head) cuts one more piece in each window, of which the head is placed and the rest counts as a
    piece for later patterns.  Patterns are bounded by the lengths, not by the pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        reach, _, steps = fill({n: c for n, c in left.items() if c}, window - first)
        best = reach.bit_length() - 1
        used = chosen(steps, best)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        gap = window - first - best
        # what is left is longer than the gap, or it would have been placed
        rest = max((n for n, c in left.items() if c > used.get(n, 0)), default=0) if gap else 0
        cut = (rest, gap) if rest else None
        takes = {n: used.get(n, 0) + (cut is not None and n == rest) for n in {*used, *([rest] if cut else [])}}
        times = min(left[n] // k for n, k in takes.items())
        out.append((times, used, cut))
        for n, k in takes.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        if cut:
            left[rest - gap] = left.get(rest - gap, 0) + times
    return out


def laid_out(patterns: list[tuple[int, dict[int, int], tuple[int, int] | None]], counts: dict[int, int]) -> np.ndarray:
    """Rows (length, first rank, copies in a window, first sequence, offset of the first copy, head, rank of the first rest), sorted.

    head is 0 where pieces stay whole; rests have the ranks after those of the uncut pieces of their length.
    """
    rows, rank, known, sequence = [], {}, dict(counts), 0
    for times, used, cut in patterns:
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, rank.get(n, 0), k, sequence, offset, 0, 0))
            rank[n] = rank.get(n, 0) + k * times
            offset += n * k
        if cut:
            n, head = cut
            rows.append((n, rank.get(n, 0), 1, sequence, offset, head, known.get(n - head, 0)))
            rank[n] = rank.get(n, 0) + times
            known[n - head] = known.get(n - head, 0) + times
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 7)


def places(layout: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which piece, where its part starts in it, the part's length, sequence, offset) for pieces by length and rank."""
    at = layout[:, 0] * (1 << 48) + layout[:, 1]
    which, start, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
    while len(which):
        row = layout[np.searchsorted(at, length * (1 << 48) + rank, "right") - 1]
        n, cut = rank - row[:, 1], row[:, 5] > 0
        out.append((which, start, np.where(cut, row[:, 5], length), row[:, 3] + n // row[:, 2], row[:, 4] + n % row[:, 2] * length))
        which, start, length, rank = which[cut], (start + row[:, 5])[cut], (length - row[:, 5])[cut], (row[:, 6] + n)[cut]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (which, *[start] * 4)


def checksums(rows: DataFrame, parts: DataFrame, tokenizer: str) -> DataFrame:
    """ids_crc32 of the parts (key, print, start, length) of documents, which are encoded once more."""
    wanted = written(parts.groupBy("key", "print").agg(F.collect_set(F.struct("start", "length")).alias("parts")), "cut-documents")
    wanted = bounded(wanted.withColumnsRenamed({"key": "w_key", "print": "w_print"}), 100_000)
    found = rows.join(wanted, F.col("key").eqNullSafe(F.col("w_key")) & (F.col("print") == F.col("w_print"))).select("key", "print", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer)
        for batch in batches:
            at_row, start, length, crc = [], [], [], []
            for i in range(batch.num_rows):
                data = document(ids, batch.column(2)[i].as_py())
                for p in batch.column(3)[i].as_py():
                    at_row.append(i), start.append(p["start"]), length.append(p["length"]), crc.append(zlib.crc32(data[4 * p["start"] : 4 * (p["start"] + p["length"])]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at_row, pa.int64())) for c in (0, 1)), *(pa.array(c, pa.int64()) for c in (start, length, crc))], ["c_key", "c_print", "c_start", "c_length", "crc"])

    kind = rows.schema["key"].dataType.simpleString()
    # rows equal in key and text have equal parts
    found = found.mapInArrow(run, f"c_key {kind}, c_print long, c_start long, c_length long, crc long")
    return written(found.distinct(), "part-checksums")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset, and their ids as little-endian 32-bit numbers if wanted."""
    plain, names = unnamed(docs)
    key_, text_ = plain[f"_{place(names, key)}"], plain[f"_{place(names, text)}"]
    rows = plain.select(key_.alias("key"), F.xxhash64(text_).alias("print"), text_.alias("text"))
    cut = written(pieces(rows, tokenizer, window, with_ids), "pieces")
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-ranks")
    counts = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    layout = laid_out(plan(counts, window), counts)
    ranked = cut.join(firsts.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select("key", "print", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank")).alias("rank"), *["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy()
            which, start, part, sequence, offset = places(layout, length, batch.column(6).to_numpy())
            took = batch.take(pa.array(which))
            whole = part == length[which]
            crc, raw = took.column(4), []
            if with_ids:
                raw = [i.as_py()[4 * s : 4 * (s + n)] for i, s, n in zip(took.column(7), start.tolist(), part.tolist(), strict=True)]
                crc = pa.array([zlib.crc32(x) for x in raw], pa.int64())
            columns = [took.column(0), took.column(1), pa.array(took.column(2).to_numpy() + start), pa.array(part), crc, took.column(5), pa.array(sequence), pa.array(offset), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, ["key", "print", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "whole"] + ["ids"] * with_ids)

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, print long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, whole boolean" + ", ids binary" * with_ids
    out = ranked.mapInArrow(run, schema)
    if not with_ids and (layout[:, 5] > 0).any():
        sums = checksums(rows, out.filter("NOT whole").select("key", "print", "start", "length"), tokenizer)
        same = (F.col("print") == F.col("c_print")) & (F.col("start") == F.col("c_start")) & (F.col("length") == F.col("c_length")) & F.col("key").eqNullSafe(F.col("c_key"))
        out = out.join(bounded(sums), same, "left").withColumn("ids_crc32", F.coalesce("crc", "ids_crc32"))
    return out.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def op2_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
