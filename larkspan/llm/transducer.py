"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The machine is a cascade compiled from the model file: the normaliser (rewriting rules by the longest match, a
blank before the text, blanks as the mark), the pieces, and byte fallback for characters that no piece has.  Composed
with an input it is a lattice whose states are (place, last piece) and whose arcs are pieces and bytes ending at a
place.  Weights are of the tropical semiring: along a path they add up, of two paths the smaller stays, and
infinity is no path.  States are relaxed place by place, so the result is the shortest path.

* Unigram models: a piece weighs its negative score, a character by bytes what the library takes for an unknown one.
* Merge models: a piece weighs 1 if the merge rule lets it follow the state's piece and infinity otherwise.  So the only
  path of finite weight is the one that greedy merging by score gives, which plain sums of scores would not find.
  ``BYTE_WEIGHT`` keeps bytes for places that no piece reaches.

Inputs are cut where no piece reaches across: before runs of blanks and around line breaks.  A part's path
is found once per worker and kept, up to a bound of entries and of length.

Defined results: a null or empty text gives no pieces; blanks and line breaks all count unless the model's
normaliser drops them; a mark in the text is read as a blank, as by the library; very long parts take time in
proportion to their length; rows are independent, so repeated ones give equal rows; names of other columns don't matter.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import place, table, unnamed
from larkspan.llm.bpe import PairRule, history

MARK = "▁"
#: heavier than any number of pieces in a part that memory holds
INFINITY, BYTE_WEIGHT = float("inf"), float(1 << 32)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_PARTS = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


class _Parts(dict):
    """How each piece is merged from its characters, found when asked for; None for single characters."""

    def __init__(self, rank):
        super().__init__()
        self.rank = rank

    def get(self, piece):
        if len(piece) == 1:
            return None
        if piece not in self:
            row, parts = history(list(piece), self.rank, lambda a, b: a + b)
            self[piece] = parts[piece] if row == [piece] else None
        return self[piece]


class Normaliser:
    """The first machine: rewrites the longest match at each place, then blanks.

    The rules are read from the model's map: four bytes with the size of a double array, the array, and the
    replacements, each ended by a zero byte.  A cell of the array holds its label in the low eight bits, whether a
    rule ends there in the next, and where its children are in the others.
    """

    def __init__(self, spec):
        raw = spec.precompiled_charsmap
        size = int.from_bytes(raw[:4], "little") if raw else 0
        self.cells = np.frombuffer(raw[4 : 4 + size], "<u4").tolist()
        self.replacements = raw[4 + size :]
        self.prefix, self.trims = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.identity = not self.cells and not self.trims

    def _longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(length, place of the replacement) of the longest rule that matches at a place."""
        cells, found = self.cells, None
        children = lambda cell: (cell >> 10) << ((cell & 0x200) >> 6)
        node = children(cells[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(cells) or cells[node] & 0x800000FF != data[i]:
                break
            cell = cells[node]
            node ^= children(cell)
            if cell >> 8 & 1:
                found = i + 1 - at, cells[node] & 0x7FFFFFFF
        return found

    def rewritten(self, text: str) -> str:
        if not self.cells:
            return text
        data, out, at = text.encode(), [], 0
        while at < len(data):
            rule = self._longest(data, at)
            if rule:
                n, place = rule
                out.append(self.replacements[place : self.replacements.index(b"\0", place)])
            else:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                out.append(data[at : at + n])
            at += n
        return b"".join(out).decode()

    def apply(self, text: str) -> str:
        """The normalised text with blanks for marks, without the blank before it."""
        text = self.rewritten(text.replace(MARK, " "))
        return re.sub(" +", " ", text).strip(" ") if self.trims else text


class Transducer:
    def __init__(self, path: str, entries: int = 250_000):
        from sentencepiece import sentencepiece_model_pb2 as model

        m = model.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, kind = m.normalizer_spec, m.trainer_spec.model_type
        kinds = [p.type for p in m.pieces]
        if kind not in (m.trainer_spec.BPE, m.trainer_spec.UNIGRAM) or not n.escape_whitespaces or not n.add_dummy_prefix or not {*kinds} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{path}: only merge and unigram models with a blank before the text and without pieces of users are supported")
        self.normaliser = Normaliser(n)
        self.merges = kind == m.trainer_spec.BPE
        self.pieces = [p.piece for p in m.pieces]
        rank = {p.piece: -p.score for p in m.pieces if p.type == _NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == _BYTE}
        if len(self.byte) < 256 or any("\n" in p or MARK in p.lstrip(MARK) for p in rank):
            raise ValueError(f"{path}: pieces reach over blanks or lines, or bytes are missing")
        join = lambda a, b: rank.get(a + b)
        parts = _Parts(join)
        rule = PairRule(parts, join)
        self.fits = (lambda a, b: rule.decide(self.pieces[a], self.pieces[b])) if self.merges else (lambda a, b: True)
        self.known: dict[int, bool] = {}
        self.weight = [1.0 if self.merges else -p.score for p in m.pieces]
        # an unknown character scores ten less than the worst piece
        self.byte_weight = BYTE_WEIGHT if self.merges else max(rank.values(), default=0.0) + 10
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            # pieces that merging can't build from their characters are never on a path
            if kinds[i] == _NORMAL and (not self.merges or len(p) == 1 or parts.get(p)):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.characters = frozenset(p for i, p in enumerate(self.pieces) if kinds[i] == _NORMAL and len(p) == 1)
        self.lightest = min((self.weight[i] for i, k in enumerate(kinds) if k == _NORMAL), default=0.0)
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.entries = entries
        self.out = [p.replace(MARK, " ").encode() if k == _NORMAL else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        self.out[kinds.index(_UNKNOWN)] = m.trainer_spec.unk_surface.encode()
        self.sizes = np.array([len(x) for x in self.out])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.out), np.uint8)

    def path(self, part: str) -> list[int]:
        """Ids along the shortest path of a part, blanks already being marks: the pieces that end at each place are the arcs of the composition."""
        n, known, fits, weight = len(part), self.known, self.fits, self.weight
        if len(known) > 4 * self.entries:
            known.clear()
        # of each place the least weight, the last piece (-1 for a byte run, which any piece may follow) and where it came from
        least, last, came = [0.0] + [INFINITY] * n, [-1] * (n + 1), [0] * (n + 1)
        # most parts have no character that needs bytes; a path that even the lightest piece can't better is left early
        done, lightest, bytes_ = 0, self.lightest, not self.characters.issuperset(part)
        for end, (piece, size) in self.automaton.iter(part):
            to = end + 1
            j = to - size
            if bytes_ and done < end:
                self._bytes(part, least, last, came, done, end)
                done = end
            if least[j] + lightest >= least[to]:
                continue
            total = least[j] + weight[piece]
            if total >= least[to]:
                continue
            a = last[j]
            if a >= 0:
                key = a << 20 | piece
                ok = known.get(key)
                if ok is None:
                    ok = known[key] = fits(a, piece)
                if not ok:
                    continue
            least[to], last[to], came[to] = total, piece, j
        if bytes_:
            self._bytes(part, least, last, came, done, n)
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.byte[b] for b in reversed(part[at - 1].encode())]
            at = came[at]
        return out[::-1]

    def _bytes(self, part: str, least: list[float], last: list[int], came: list[int], start: int, stop: int) -> None:
        """The arcs of characters that are no piece by themselves: their bytes."""
        for i in range(start + 1, stop + 1):
            if part[i - 1] not in self.characters:
                total = least[i - 1] + self.byte_weight
                if total < least[i]:
                    least[i], last[i], came[i] = total, -1, i - 1

    def parts(self, text: str) -> list[str]:
        """Parts of a text: those with one blank before them without it, those after a line break with it, others whole."""
        if text[0] == " " or "  " in text:
            return [p[1:] if p[0] == " " and p[1:2] != " " else p for p in _PARTS.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def _part(self, p: str) -> bytes:
        if p[:1] == "\n":
            ids = [self.byte[10], *(self.path(p[1:].replace(" ", MARK)) if len(p) > 1 else ())]
        elif p[:1] == " ":
            ids = self.path(p.replace(" ", MARK))
        else:
            ids = self.path(MARK + p)
        return np.array(ids, np.int32).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers."""
        text = text and (text.replace(MARK, " ") if self.normaliser.identity else self.normaliser.apply(text))
        if not text:
            return b""
        rows, paths, older = self.parts(text), self.paths, self.older
        long = []
        for p in set(rows).difference(paths):
            found = older.get(p)
            paths[p] = self._part(p) if found is None else found
            if len(p) > 64:
                long.append(p)
        out = b"".join([paths[p] for p in rows])
        for p in long:
            del paths[p]
        if len(paths) > self.entries:
            # what is used again comes over from the older half
            self.paths, self.older = {}, paths
        return out

    def decode(self, ids: list[int]) -> str:
        """The inverse: pieces and bytes in a row, without the blank before the text."""
        out = self.out
        return b"".join([out[i] for i in ids]).decode(errors="replace").removeprefix(" ")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """As ``decode`` for many rows, whose ids end at the given places."""
        sizes = self.sizes[ids]
        to = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (to - sizes), sizes) + np.arange(to[-1] if len(to) else 0)
        raw = self.flat[at].tobytes()
        cuts = np.concatenate([[0], to])[ends].tolist()
        return [raw[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip([0, *cuts], cuts, strict=False)]


@functools.lru_cache(maxsize=1)
def _transducer(path: str) -> Transducer:
    """One for all the tasks of a Python worker."""
    return Transducer(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids and crc32 of the text for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [t.encode(x.as_py()) for x in part.column(1)]
                ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, part.column(2)], ["key", "ids", "text_crc32"])

    plain, names = unnamed(docs)
    key_, text_ = plain[f"_{place(names, key)}"], plain[f"_{place(names, text)}"]
    rows = plain.select(key_.alias("key"), text_.alias("text"), F.crc32(F.coalesce(text_, F.lit(""))).alias("text_crc32"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, text_crc32 long").withColumnRenamed("key", key)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The same rows with the text that their ids stand for."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(names.index(ids))
                sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = t.decode_all(column.flatten().to_numpy(), np.cumsum(sizes))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, text])

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{text}` string")


def op8_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, and whether decoding gives the text back (checksums of both)."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(table(spark, sf_dir, "documents"), model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", (F.crc32("text") == F.col("text_crc32")).alias("round_trip"))
