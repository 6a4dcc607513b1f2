"""Exact token counts at every prefix, by dynamic programming over a byte-pair vocabulary.

``PrefixCounter`` runs over a word's bytes once: for each prefix it keeps the last token of its exact
encoding and the number of tokens, as the beginning of a longer word and as a word of its own.  Words are
independent of each other, so a document's prefixes are sums over its words.  ``prefix_table`` stores them: for every
place where a run of letters ends before white space, the bytes and the tokens up to there.  Truncations and budgets
are look-ups in these two arrays (``within``), not new encodings; a place inside a run is counted by ``PrefixCounter.upto``.
The tokens that end at each position come from automata over the vocabulary.

Defined results: a null or empty text has 0 tokens; a text of white space only has 0; special strings
(such as the vocabulary's end-of-text) count as one token each; repeated rows each give a row; other
columns are not touched, whatever their names.  Very long words cost time in proportion to their length, as a token's length is bounded.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import place, table, unnamed
from larkspan.llm.bpe import PairRule

END = "</w>"
#: fixed values: the split pattern of such vocabularies and the steps before it in their files
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_PRETOKENS = regex.compile(PATTERN)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable, else the next one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class PrefixCounter:
    """Token counts of words, of texts and of all their prefixes."""

    def __init__(self, path: str, cache_entries: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [(spec[k] or {}).get(f"{k.split('_')[0]}{end}") for k, end in (("normalizer", "s"), ("pre_tokenizer", "tokenizers"))]
        if steps != [NORMALIZERS, PRE_TOKENIZERS] or spec["model"]["end_of_word_suffix"] != END or spec["model"]["continuing_subword_prefix"]:
            raise ValueError(f"{path} is not a vocabulary of lower-case words with ends")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ranks = {m: i for i, m in enumerate(merges)}
        parts = {}
        for (a, b), i in ranks.items():
            parts.setdefault(a + b, (a, b, i))
        rule = PairRule(parts, lambda a, b: ranks.get((a, b)))
        self.tokens = list(spec["model"]["vocab"])
        self.fits = lambda a, b: rule.decide(self.tokens[a], self.tokens[b])
        self.known: dict[int, bool] = {}
        # tokens that end a word are patterns with a line break, which no spelled word holds
        self.automaton = ahocorasick.Automaton()
        for n, v in enumerate(self.tokens):
            self.automaton.add_word(v[: -len(END)] + "\n" if v.endswith(END) else v, (n, len(v) - (len(END) - 1) * v.endswith(END)))
        self.automaton.make_automaton()
        # the same tokens without their end, to close any prefix
        self.closing = ahocorasick.Automaton()
        for n, v in enumerate(self.tokens):
            if v.endswith(END) and len(v) > len(END):
                self.closing.add_word(v[: -len(END)], (n, len(v) - len(END)))
        self.closing.make_automaton()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))))
        self.special_bytes = [s.encode() for s in self.specials]
        self.symbol = byte_symbols()
        self.words: dict[str, int] = {}
        self.chunks: dict[bytes, int] = {}
        self.cache_entries = cache_entries

    # -- one word -------------------------------------------------------------------------------

    def _states(self, s: str, ends: bool) -> tuple[list[int], list[int], list[int]]:
        """For each prefix of the spelled word: the last token and the number of tokens as the beginning of
        a longer word, and the number as a word of its own (only for the whole word unless ends)."""
        n, known, fits, first = len(s), self.known, self.fits, len(self.tokens)
        lasts, counts, closed = [first] + [-1] * n, [0] * (n + 1), [0] * (n + 1)
        if len(known) > self.cache_entries:
            known.clear()
        for end, (t, size) in self.automaton.iter(s + "\n"):
            if end == n:
                j, to = end + 1 - size, -1
                if j == n:
                    continue
            else:
                to = end + 1
                j = to - size
                if lasts[to] >= 0:
                    continue
            a = lasts[j]
            if a < 0:
                continue
            if a != first:
                key = a << 20 | t
                ok = known.get(key)
                if ok is None:
                    ok = known[key] = fits(a, t)
                if not ok:
                    continue
            if to < 0:
                closed[n] = counts[j] + 1
                break
            lasts[to] = t
            counts[to] = counts[j] + 1
        if ends:
            # of the closing tokens at each place the one that fits the prefix before it
            for end, (t, size) in self.closing.iter(s):
                a = lasts[end + 1 - size]
                if not closed[end + 1] and a >= 0 and (a == first or fits(a, t)):
                    closed[end + 1] = counts[end + 1 - size] + 1
        return lasts, counts, closed

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a pre-token, by bytes: entry i is the exact count of its first i bytes as a word."""
        return self._states(self.spell(word), True)[2]

    def spell(self, word: str) -> str:
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        symbol = self.symbol
        return "".join([symbol[b] for b in word.encode()])

    def count_words(self, words: set[str]) -> dict[str, int]:
        """Tokens of each pre-token."""
        spell, states = self.spell, self._states
        return {w: states(spell(w), False)[2][-1] for w in words}

    # -- texts ----------------------------------------------------------------------------------

    @staticmethod
    def normalise(text: str) -> str:
        """NFC and lower case of each character by itself (a final capital sigma stays medial)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pretokens(self, text: str) -> list[tuple[bool, str]]:
        """(special, pre-token) in order."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(False, t) for t in _PRETOKENS.findall(self.normalise(text[at : m.start()]))]
            out.append((True, m[0]))
            at = m.end()
        return out + [(False, t) for t in _PRETOKENS.findall(self.normalise(text[at:]))]

    def cumulative(self, text: str | None) -> list[int]:
        """Tokens up to and with each pre-token of the text; a token budget is a bisection of this list."""
        got = self.pretokens(text or "")
        known = self.count_words({t for special, t in got if not special})
        out, n = [], 0
        for special, t in got:
            n += 1 if special else known[t]
            out.append(n)
        return out

    def upto(self, text: str, characters: int) -> int:
        """Tokens of the text's first characters: those of the pre-tokens before, and the exact count inside the last one."""
        got = self.pretokens(text[:characters])
        if not got:
            return 0
        known = self.count_words({t for special, t in got[:-1] if not special})
        special, last = got[-1]
        return sum(1 if s else known[t] for s, t in got[:-1]) + (1 if special else self.prefix_counts(last)[-1])

    def fit(self, text: str | None, budget: int) -> int:
        """How many pre-tokens of the text fit into the budget."""
        import bisect

        return bisect.bisect_right(self.cumulative(text), budget)

    def _learn(self, chunks: set[bytes]) -> None:
        """Counts of pieces without ASCII white space, through the counts of their pre-tokens."""
        split: list[tuple[bytes, list[tuple[bool, str]]]] = []
        plain: list[bytes] = []
        for c in chunks:
            if b"<|" in c and any(s in c for s in self.special_bytes):
                split.append((c, self.pretokens(c.decode())))
            else:
                plain.append(c)
        if plain:
            # one pass of the pattern over all of them, as none reaches over a line break
            text = self.normalise(b"\n".join(plain).decode())
            if text.count("\n") == len(plain) - 1:
                split += [(c, [(False, t) for t in _PRETOKENS.findall(line)]) for c, line in zip(plain, text.split("\n"), strict=True)]
            else:
                split += [(c, self.pretokens(c.decode())) for c in plain]
        words = self.words
        fresh = {t for _, got in split for special, t in got if not special and t not in words}
        if len(words) + len(fresh) > self.cache_entries:
            words.clear()
            fresh = {t for _, got in split for special, t in got if not special}
        words.update(self.count_words(fresh))
        self.chunks.update((c, sum(1 if special else words[t] for special, t in got)) for c, got in split)

    def prefixes(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(runs of each text, bytes up to the end of each run, tokens up to there), texts being in UTF-8.

        Splitting at ASCII white space first is exact: the pattern drops white space and no pre-token holds any.
        """
        rows = [t.split() if t else [] for t in texts]
        chunks = self.chunks
        if len(chunks) > self.cache_entries:
            chunks.clear()
        fresh: set[bytes] = set()
        for row in rows:
            fresh.update(row)
        self._learn(fresh.difference(chunks))
        get = chunks.__getitem__
        sizes = np.array([len(r) for r in rows], np.int64)
        each = np.fromiter((x for row in rows for x in map(get, row)), np.int32, int(sizes.sum()))
        ends = np.concatenate([run_ends(t or b"") for t in texts] or [np.zeros(0, np.int32)])
        for c in fresh:
            if len(c) > 64:
                del chunks[c]
        return sizes, ends, sums(each, sizes)

    def count_texts(self, texts: list[bytes | None]) -> list[int]:
        """Tokens of each text, given in UTF-8."""
        sizes, _, tokens = self.prefixes(texts)
        return last_of(tokens, sizes).tolist()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def run_ends(text: bytes) -> np.ndarray:
    """The places after each run of bytes that are no ASCII white space."""
    blank = _SPACE[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(~blank & np.concatenate([blank[1:], np.ones(min(1, len(blank)), bool)])).astype(np.int32) + 1


def sums(each: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums within rows of the given sizes."""
    total = np.cumsum(each, dtype=np.int64)
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return (total - np.repeat(before, sizes)).astype(np.int32)


def last_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The last value of each row, 0 for rows without any."""
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, np.concatenate([values, [0]])[np.maximum(ends - 1, 0)], 0).astype(np.int64)


@functools.lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """One for all the tasks of a Python worker, so that what one task learnt serves the next."""
    return PrefixCounter(path)


def prefix_table(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", batch_bytes: int = 4 << 20) -> DataFrame:
    """Per row: key, n_bytes of the text in UTF-8, n_tokens, and the prefixes: prefix_bytes and prefix_tokens, ascending.

    One narrow pass, no shuffle; memory is bounded by the caches (cache_entries words, chunks of at most
    64 bytes) and by batch_bytes of text at a time, one text at least.
    """
    plain, names = unnamed(docs)
    rows = plain.select(plain[f"_{place(names, key)}"].alias("key"), plain[f"_{place(names, text)}"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            at = held = 0
            for i, t in enumerate(texts, 1):
                held += len(t or b"")
                if held >= batch_bytes or i == len(texts):
                    sizes, ends, tokens = counter.prefixes(texts[at:i])
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ends, tokens)]
                    n = pa.array([len(t or b"") for t in texts[at:i]], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i - at), n, pa.array(last_of(tokens, sizes)), *lists], ["key", "n_bytes", "n_tokens", "prefix_bytes", "prefix_tokens"])
                    at, held = i, 0

    kind = rows.schema["key"].dataType.simpleString()
    got = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, prefix_bytes array<int>, prefix_tokens array<int>")
    return got.withColumnRenamed("key", key)


def within(prefixes: DataFrame, budget: int, name: str) -> DataFrame:
    """The table with one more column: the bytes of each text's longest stored prefix that has at most ``budget`` tokens."""
    fits = f"size(filter(prefix_tokens, x -> x <= {int(budget)}))"
    return prefixes.withColumn(name, F.expr(f"if(n_tokens <= {int(budget)}, n_bytes, coalesce(cast(get(prefix_bytes, {fits} - 1) AS long), 0L))"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``prefix_table`` with over_limit, whether a text has more tokens than the limit, and bytes_at_limit, where it would be cut."""
    return within(prefix_table(docs, tokenizer, text, key), limit, "bytes_at_limit").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_at_limit", "prefix_bytes", "prefix_tokens")
