"""Quality rules, personal data, token counts, piece encoding and packing against plain Python and the libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import packing, pii, quality, registry, token_counts, transducer

tokenizers_files = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\n", "a", "a  b   c", "a\nb\n\nc ", "x" * 5000, "ab " * 3000, "ΑΣ ΣΑΣ İstanbul é ẛ̣", "日本語 テキスト。", "😀 👩‍👩‍👧!",
    "<|endoftext|> a <|startoftext|>", "<s> <unk> <0x41>", "it's I'LL 1234 ½", "\x00\x1c\x85 z", "tab\tx　y", "a.b@c.de, a.b@c.de", "same line\nsame line\n \nsame line",
]
#: names that operators and stages use themselves
CLASHING = "gone n_dropped n_lines g_doc _print f_key f_print found node uid row_id bucket start length ids whole rank part ids_crc32 n_tokens size crc shard slot comp d1 line _0 _1".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of all kinds, some twice, null keys, and columns with names that the operators use themselves."""
    rows = [(i, t, "en", "src", 0, 1, "x") for i, t in enumerate(ODD)] + [(None, "no key here", None, None, None, None, None), (3, ODD[3], "en", "src", 0, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, print string")
    for i, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(i))
    return df


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


# -- 1 ---------------------------------------------------------------------------------------------


def plain_measures(t):
    w = WORD.findall(t or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures(docs):
    for t in [*ODD, *docs.text, "a b c d e " * 50, "a a a a a a", "one two three four five one two three four five"]:
        assert quality.measures(t) == plain_measures(t)


def test_ledger(spark, odd, sf):
    got = quality.judge(quality.ledger(odd), quality.POLICIES["base"]).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)
    assert quality.ledger(odd.limit(0)).count() == 0
    entries = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    policy = quality.POLICIES[quality.PRODUCTION]
    rows, table = entries.collect(), {r.rule: r for r in quality.ablations(entries, policy).collect()}
    for rule in policy.rules:
        bit = quality.BIT[rule]
        assert table[rule].n_failing == sum(bool(r.fail_bits & bit) for r in rows)
        assert table[rule].n_only == sum(r.fail_bits & policy.mask == bit for r in rows)
        assert table[rule].n_kept_without == sum(not r.fail_bits & policy.mask & ~bit for r in rows)
    assert quality.accepted(odd, policy).columns == odd.columns


# -- 4 ---------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                total = sum(sum(map(int, str(int(c) * 2))) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
                ok = 12 <= len(digits) <= 19 and total % 10 == 0
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(docs):
    rng = random.Random(4)
    made = ["".join(rng.choices("0123456789.+-@ ()ab٠é", k=rng.randrange(60))) for _ in range(3000)]
    made += ["a@b.c@d.e", "x@y..z", "@a.b", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "+49 (30) 1234-5678", "+1+1234567890", "9" * 3000, "a" * 2000 + "@b.c"]
    for t in [*docs.text, *[x for x in ODD if x], *made]:
        assert pii.base_spans(t) == plain_spans(t), t[:80]


def test_bootstrap_finds_unseen(spark, odd):
    rng = random.Random(1)
    rows = [(i, f"Words {rng.random()} and call me under +1 (4{rng.randrange(10)}{rng.randrange(10)}) 555-{rng.randrange(1000, 9999)} then") for i in range(30)]
    rows += [(100, "please call me under 030 555 1234 today"), (101, "the year 1999 2000 2001 passed")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[100].spans == "phone:21:33" and got[100].n_phone == 0 and got[101].spans == ""
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[100] == "please call me under <PHONE> today" and "<PHONE>" in masked[0] and masked[101] == rows[-1][1]
    assert pii.find(odd).count() == len(ODD) + 2 and pii.find(odd.limit(0)).count() == 0
    assert pii.mask(odd).columns == odd.columns


@pytest.mark.parametrize("unseen", [5, 10, 25])
def test_bootstrap_with_many_unseen(spark, unseen):
    """Of 50 numbers behind a pattern 10 % to 50 % are unseen; a pattern that words mostly follow stays out."""
    rows = [(i, f"call me under +1 (444) 555-{1000 + i} then") for i in range(50 - unseen)]
    rows += [(100 + i, f"call me under 030 555 {1000 + i} today") for i in range(unseen)]
    rows += [(200 + i, f"we saw +1 (444) 666-{1000 + i}") for i in range(6)] + [(300 + i, f"we saw 030 777 {1000 + i}") for i in range(6)]
    rows += [(400 + i, "what we saw there") for i in range(20)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == "phone:14:26" for i in range(unseen)) and not any(got[300 + i] for i in range(6))


def test_bootstrap_precision_and_recall(spark):
    """Planted identifiers that no base expression takes, behind patterns that base ones show, and look-alikes behind other words."""
    rng = random.Random(12)
    rows, want = [], {}
    filler = lambda: " ".join(rng.choices("stone river market under light where seven paper".split(), k=rng.randrange(3, 12)))
    kinds = {
        "phone": ("reach us under", lambda: f"+49 30 {rng.randrange(10**6, 10**7)}", lambda: f"030 {rng.randrange(10**6, 10**7)}"),
        "email": ("write mail to", lambda: f"u{rng.randrange(10**6)}@ex.org", lambda: f"u{rng.randrange(10**6)} [at] ex [dot] org"),
        "ip": ("server address", lambda: f"10.{rng.randrange(256)}.{rng.randrange(256)}.7", lambda: f"fe80:0:0:{rng.randrange(1000)}:1:2:3:{rng.randrange(1000)}"),
    }
    for kind, (words, seed, unseen) in kinds.items():
        for i in range(60):
            before = f"{filler()} {words} "
            value = unseen() if i % 3 == 0 else seed()
            rows.append((len(rows), f"{before}{value} {filler()}"))
            want[rows[-1][0]] = f"{kind}:{len(before)}:{len(before) + len(value)}" if i % 3 == 0 else None
        for _ in range(20):  # the same shapes where mostly no identifier follows
            rows.append((len(rows), f"{filler()} number {unseen()} {filler()}"))
            want[rows[-1][0]] = ""
    rows += [(len(rows) + i, f"{filler()} number {filler()}") for i in range(100)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = [i for i, w in want.items() if w]
    found = sum(got[i] == want[i] for i in planted)
    wrong = sum(got[i] != "" for i, w in want.items() if w == "")
    assert found >= 0.95 * len(planted) and wrong == 0, (found, len(planted), wrong)


def test_support_is_by_texts(spark):
    """One text with many numbers, or copies of it, make no pattern."""
    many = " ".join(f"hot line +1 555 555 {1000 + i}" for i in range(20))
    rows = [(i, many) for i in range(8)] + [(100, "hot line 030 555 1234")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == ""


def test_loose_spans_are_linear():
    import time

    text = " ".join(f"no 030 {1000000 + i}" for i in range(40_000))
    at = time.perf_counter()
    assert len(pii.loose_spans(text, pii.base_spans(text))) == 40_000 and time.perf_counter() - at < 10


def test_pii_query(spark, sf, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op4_contextual_pii"](spark, sf).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        base = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(pii.spell(base).encode()).hexdigest()
        assert set(pii.spell(base).split(",")) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in base) for k in range(4)]


# -- 7 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    path = tokenizers_files.path("word_bpe_49k.json")
    return token_counts.PrefixCounter(path), Tokenizer.from_file(path)


def test_token_counts(spark, sf, docs, odd, word_bpe):
    _, library = word_bpe
    got = {r.doc_id: r for r in registry.QUERIES["op7_prefix_token_counts"](spark, sf).collect()}
    for i, t, e in zip(docs.doc_id, docs.text, library.encode_batch(list(docs.text), add_special_tokens=False), strict=True):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), len(e.ids), len(e.ids) > 2048)
    few = token_counts.token_counts(odd, tokenizers_files.path("word_bpe_49k.json")).collect()
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(ODD), (None, "no key here"), (3, ODD[3])])
    assert Counter((r.doc_id, r.n_tokens) for r in few) == want


def test_prefix_table(spark, odd, word_bpe):
    """Every stored prefix has the library's count, and budgets are looked up in the table."""
    _, library = word_bpe
    stored = token_counts.prefix_table(odd, tokenizers_files.path("word_bpe_49k.json"))
    texts = {i: (t or "").encode() for i, t in enumerate(ODD)}
    for r in token_counts.within(stored, 3, "cut").filter("doc_id IS NOT NULL").collect():
        count = lambda n, t=texts[r.doc_id]: len(library.encode(t[:n].decode(), add_special_tokens=False).ids)
        assert [count(n) for n in r.prefix_bytes[:20]] == r.prefix_tokens[:20]
        assert r.n_tokens == (r.prefix_tokens or [0])[-1] and r.n_bytes == len(texts[r.doc_id])
        assert r.cut == (r.n_bytes if r.n_tokens <= 3 else max([n for n, k in zip(r.prefix_bytes, r.prefix_tokens, strict=True) if k <= 3], default=0))


def test_prefixes(word_bpe):
    counter, library = word_bpe
    for word in ("thesatoring", "zzzzzz", "interreaction"):
        assert counter.prefix_counts(word)[1:] == [len(library.encode(word[:i]).ids) for i in range(1, len(word) + 1)]
    for i in range(9):
        assert counter.upto("It's Stra\u00dfe 12", i) == len(library.encode("It's Stra\u00dfe 12"[:i], add_special_tokens=False).ids)
    text = "The quick, brown <|endoftext|> fox's 12 jumps"
    upto = counter.cumulative(text)
    assert upto[-1] == len(library.encode(text, add_special_tokens=False).ids) and upto == sorted(upto)
    assert counter.fit(text, upto[2]) == 3 and counter.fit(text, 0) == 0


# -- 8 ---------------------------------------------------------------------------------------------


def test_transducer(spark, sf, docs, odd):
    import sentencepiece

    path = tokenizers_files.path("piece_bpe_32k.model")
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), transducer.Transducer(path)
    rng = random.Random(2)
    made = ["".join(rng.choices("ab e▁\n\té日😀<>0", k=rng.randrange(40))) for _ in range(2000)]
    for t in [*docs.text, *[x or "" for x in ODD], *made]:
        ids = np.frombuffer(mine.encode(t), np.int32).tolist()
        assert ids == library.encode(t), t[:80]
        assert mine.decode(ids) == library.decode(ids)
    got = registry.QUERIES["op8_piece_transducer"](spark, sf).collect()
    assert len(got) == len(docs) and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    few = transducer.decode(transducer.encode(odd, path), path).collect()
    assert Counter(r.text for r in few) == Counter((t or "") for t in [*ODD, "no key here", ODD[3]])


def variants(path):
    """Models made from the given one: unigram with scores of their own, and with the library's own normaliser map."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model

    given = model.ModelProto()
    with open(path, "rb") as f:
        given.ParseFromString(f.read())
    rng = random.Random(6)
    unigram = model.ModelProto()
    unigram.CopyFrom(given)
    unigram.trainer_spec.model_type = model.TrainerSpec.UNIGRAM
    for p in unigram.pieces:
        if p.type == 1:
            p.score = -rng.randrange(1, 4000) / 256
    rules = model.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    mapped = model.ModelProto()
    mapped.CopyFrom(given)
    mapped.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    mapped.normalizer_spec.remove_extra_whitespaces = True
    return {"unigram": unigram, "mapped": mapped}


@pytest.mark.parametrize("kind", ["unigram", "mapped"])
def test_transducer_variants(docs, tmp_path, kind):
    """Weights decide between paths, and the normaliser is composed before the pieces: a parse by the first fit fails here."""
    import sentencepiece

    path = str(tmp_path / "made.model")
    with open(path, "wb") as f:
        f.write(variants(tokenizers_files.path("piece_bpe_32k.model"))[kind].SerializeToString())
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), transducer.Transducer(path)
    rng = random.Random(2)
    made = ["".join(rng.choices("ab e\u2581\n\t\u00e9\u65e5\U0001f600<>0thin\uff21\ufb01\u2460\u3000\u0301\uff76\uff9e\u200b\x01", k=rng.randrange(40))) for _ in range(2000)]
    for t in [*docs.text[:50], *[x or "" for x in ODD], *made]:
        assert np.frombuffer(mine.encode(t), np.int32).tolist() == library.encode(t), t[:80]


# -- 2 ---------------------------------------------------------------------------------------------


def check_packed(pieces, ids_of, window=1024):
    """All ids once, gapless sequences of at most the window; gives padded ids."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids_of)
    for d, ps in by_doc.items():
        at, ids = 0, ids_of[d]
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        pad += window - at if at & (at - 1) else 0
    return pad


def test_packing(spark, sf, docs, odd):
    from tokenizers import Tokenizer

    path = tokenizers_files.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encode = lambda ts: [[*e.ids, 0] for e in library.encode_batch(ts, add_special_tokens=False)]
    got = registry.QUERIES["op2_slack_packing"](spark, sf).collect()
    ids = dict(zip(docs.doc_id, encode(list(docs.text)), strict=True))
    assert check_packed(got, ids) < 0.01 * sum(map(len, ids.values()))
    unique = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packed(packing.pack(unique, path).collect(), dict(enumerate(encode([t or "" for t in ODD]))))
    assert packing.pack(odd, path).agg(F.countDistinct("sequence_id")).first()[0] > 0
    assert packing.pack(odd.limit(0), path).count() == 0


def test_blank_runs():
    """Runs of blanks that the pattern's look-ahead can't go back over have the library's ids."""
    from tokenizers import Tokenizer

    path = tokenizers_files.path("byte_bpe_50k.json")
    library, ids = Tokenizer.from_file(path), packing.Ids(path)
    for t in (" " * 1_200_000 + "a", "x" + "\n" * 1_200_000, " \n" * 20000 + " b c" + "\t" * 30000 + "é" + " " * 10000 + "'s", "\x1c" * 20000 + "a", "\u3000" * 12000 + "z", "x" + " " * 9999 + "y"):
        assert np.frombuffer(ids.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_cut_pieces(spark):
    """Pieces are cut to fill windows; every window but the last is full, with or without ids."""
    path = tokenizers_files.path("byte_bpe_50k.json")
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["ab", "cde", "the"], k=600 + i % 3))) for i in range(40)] + [(7, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, with_ids = packing.pack(df, path).collect(), packing.pack(df, path, with_ids=True).collect()
    keyed = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset)
    assert Counter(map(keyed, plain)) == Counter(map(keyed, with_ids)) and len(plain) > len(rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in with_ids)
    full = Counter()
    for r in plain:
        full[r.sequence_id] += r.length
    assert sum(n < 1024 for n in full.values()) <= 1 and max(full.values()) <= 1024


def test_slack_is_minimal():
    rng = random.Random(3)
    for _ in range(50):
        counts = Counter(rng.randrange(1, 40) for _ in range(8))
        reach, _, steps = packing.fill(counts, 60)
        items, sums = list(counts.elements()), {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= 60}
        best = reach.bit_length() - 1
        assert best == max(sums)
        used = packing.chosen(steps, best)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())
    assert packing.plan({}) == [] and packing.plan({1024: 5}) == [(5, {1024: 1}, None)]
