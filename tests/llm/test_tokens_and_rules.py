"""Operators 4, 7 and 9 against plain versions of themselves."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from admitflow.llm import byte_bpe, curve_packing, quality_crf

TEXTS = [
    None,
    "",
    " ",
    "a",
    "Hello world, it's 2024!\nNew line  two  spaces\t\ttabs\r\n\r\nend ",
    "naïve café ÉÀ ß ẞ İstanbul Σίσυφος é 日本語 emoji 👩‍👩‍👧  nbsp em",
    "<|endoftext|> and <|startoftext|> we'll they've 'tis",
    "x\0y \x1c z\x1d\x85q",
    "word " * 3000,
    "tail space\n",
    "\n\nlead",
    "a \n b\n  c   d",
    "!!!??? ...--- 12345 ½ ² Ⅻ",
]


def table(spark, texts=TEXTS, extra=True):
    rows = [(i, t, "en", "s", len(t or ""), "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def test_bytes_are_encoded_as_by_the_rank_file(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip(table(spark), path).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), repr(t)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest(), repr(t)
    encoded = byte_bpe.encode_documents(table(spark), path)
    back = {r.doc_id: bytes(r.text_bytes) for r in byte_bpe.decode_documents(encoded, path).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert byte_bpe.round_trip(table(spark, []), path).count() == 0


def test_offsets_split_characters():
    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = np.frombuffer(bpe.encode(["日本"])[0], "<u4")
    off = bpe.offsets(ids)
    assert off[-1] == 6 and bpe.decode(ids).decode() == "日本"


def test_packing_is_gapless_and_right(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = TEXTS + ["word " * 3000] * 5
    rows = curve_packing.pack(table(spark, texts), path).collect()
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    pieces, seqs = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), repr(texts[r.doc_id])[:60]
        assert r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, total in [(pieces[i], len(want[i])) for i in want] + [(s, None) for s in seqs.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert total is None and at <= 2048 or at == total
    assert sum(sum(n for _, n in s) < 2048 for s in seqs.values()) <= 1
    assert curve_packing.pack(table(spark, []), path).count() == 0


def test_hilbert_neighbours_touch():
    n = 8
    grid = np.array([(a, b, c) for a in range(n) for b in range(n) for c in range(n)])
    keys = curve_packing.hilbert_keys(grid, bits=3)
    path = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(n**3))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, []
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.append(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed)


CLEAN = [" ".join("abcdefghij"[(i * 7 + k * 3 + i * k) % 10] * (1 + (i + k) % 4) + "klmnop"[(i + 2 * k) % 6] + "qrstuvw"[i * k % 7] for k in range(10)).capitalize() + "." for i in range(40)]
LOUD = ["SHOUT!! %s!!" % " ".join(f"W{i * 7 + k}#$%%" for k in range(9)) for i in range(40)]


def test_rules_base_and_verdict(spark):
    texts = TEXTS[:8] + ["w " * 60, "a b c a b c x y z", "same\nsame\n \n \nother\nsame", "\n".join(CLEAN), "\n".join(LOUD), " \x1f ".join("u%d\x1f" % i for i in range(60)), "\n".join(CLEAN[:20] + LOUD)]
    labelled = [("\n".join(CLEAN[i : i + 12]), 1) for i in range(20)] + [("\n".join(LOUD[i : i + 12]), 0) for i in range(20)]
    fit = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(labelled)] + [(None, 1), (3, None)], "doc_id long, quality int")
    crf = quality_crf.fit_line_crf(fit, labels)
    got = {r.doc_id: r for r in quality_crf.label_lines(table(spark, texts), crf).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(t), repr(t)[:80]
        assert not (r.base_failed and r.kept)
    assert got[len(texts) - 4].kept and not got[len(texts) - 3].kept
    empty = quality_crf.fit_line_crf(fit, labels.limit(0))
    assert quality_crf.label_lines(table(spark, []), empty).count() == 0


def test_distinct_share_is_of_the_whole_line():
    few, very_few = (quality_crf.FEATURES.index(x) for x in ("few_distinct", "very_few_distinct"))
    varied = ["w%d" % i for i in range(400)]
    poor = ["p%d" % (i * i % 40) for i in range(3000)]
    late, early = quality_crf.line_features([" ".join(varied + poor), " ".join(poor[:400] + ["v%d" % i for i in range(3000)])])
    assert few in late and very_few in late
    assert few not in early and very_few not in early
    exact = quality_crf.line_features([" ".join(varied), " ".join(varied[:250] + poor[:150])])
    assert few not in exact[0] and few not in exact[1]
    tail = quality_crf.line_features([" ".join(varied + poor[:1200]), " ".join(poor[:399] + varied[:2])])
    assert few in tail[0] and very_few in tail[1]


def test_fit_sees_the_ends_of_long_texts(spark):
    texts = [("\n".join((CLEAN * 2)[i : i + 60] + ["Copyright 2024 | all | rights | reserved"] * (1 - q)), q) for i in range(15) for q in (0, 1)]
    fit = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(texts)], "doc_id long, quality int")
    crf = quality_crf.fit_line_crf(fit, labels)
    gain = crf.weights[:, 1] - crf.weights[:, 0]
    assert gain[quality_crf.FEATURES.index("last")] != 0 and gain[quality_crf.FEATURES.index("pipes")] > 0
    footer = quality_crf.line_features(texts[0][0].split("\n"))
    assert crf.viterbi(footer)[-1] == 1


def test_fit_step_is_the_gradient_over_all_labellings():
    import itertools

    rng = np.random.default_rng(2)
    w, m = rng.normal(size=(len(quality_crf.FEATURES), 2)), rng.normal(size=(2, 2))
    feats = [[[0, *sorted(set(rng.integers(1, 18, size=2).tolist()))] for _ in range(n)] for n in (3, 1, 5, 5, 2, 0)]
    marks = [rng.integers(0, 2, size=len(f)) for f in feats]

    def counts(f, y):
        cw, cm = np.zeros_like(w), np.zeros_like(m)
        for ks, k in zip(f, y):
            cw[ks, k] += 1
        for a, b in zip(y, y[1:]):
            cm[a, b] += 1
        return cw, cm

    gw, gm = np.zeros_like(w), np.zeros_like(m)
    for f, y in zip(feats, marks):
        every = [counts(f, x) for x in itertools.product((0, 1), repeat=len(f))]
        p = np.exp([(cw * w).sum() + (cm * m).sum() for cw, cm in every])
        for (cw, cm), q in zip(every, p / p.sum()):
            gw, gm = gw - q * cw, gm - q * cm
        cw, cm = counts(f, y)
        gw, gm = gw + cw, gm + cm
    total = sum(map(len, feats))
    for block_lines in (1, 6, 1000):
        crf = quality_crf.LineCrf(w, m).fit([(np.array(quality_crf.coded(f)), y) for f, y in zip(feats, marks)], steps=1, rate=1.0, block_lines=block_lines)
        assert np.allclose(crf.weights - w, 10 * (gw / total - 1e-3 * w)) and np.allclose(crf.moves - m, gm / total - 1e-3 * m)


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    rng = np.random.default_rng(1)
    crf = quality_crf.LineCrf(rng.normal(size=(len(quality_crf.FEATURES), 2)), rng.normal(size=(2, 2))).ready()
    feats = [[0, int(rng.integers(1, 18))] for _ in range(7)]

    def score(y):
        return sum(crf.weights[f, k].sum() for f, k in zip(feats, y)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:]))

    best = max(itertools.product((0, 1), repeat=7), key=score)
    assert tuple(crf.viterbi(feats)) == best


def test_words_are_tokenised_as_by_the_library():
    """Random code points of all planes, with marks, case, combining characters and white space of all kinds between."""
    from random import Random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, words, proj = Tokenizer.from_file(path), curve_packing.WordTokens(path), curve_packing.projection()
    r = Random(3)
    pools = [range(0x20, 0x7F), range(0xC0, 0x250), range(0x250, 0x600), range(0x300, 0x370), range(0x1E00, 0x2100), range(0x3000, 0xD800), range(0x10000, 0x1FFFF), range(0x110000)]
    sign = lambda: chr(next(c for c in iter(lambda: r.choice(r.choice(pools)), None) if not 0xD800 <= c < 0xE000))
    glue = [" ", " ", " ", "\n", "\t", " ", "", ".", "'s", ",", "<|endoftext|>"]
    texts = ["".join("".join(sign() for _ in range(r.randrange(0, 6))) + r.choice(glue) for _ in range(30)) for _ in range(400)]
    texts += ["".join(chr(c) + r.choice(["", " ", "a ", ". "]) for c in range(k, k + 512) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 512)]
    texts += ["", " ", "word " * 5000, "a.", "é.", ".", "x" * 3000]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        ids, n, _ = curve_packing.encoded(pa.array(part), words, proj, 1)
        stop = 0
        for text, size in zip(part, n, strict=True):
            assert ids[stop : stop + size].tolist() == tok.encode(text, add_special_tokens=False).ids + [1], repr(text)[:200]
            stop += size


def test_pattern_and_library_offsets():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = "caf\u00e9 \u65e5\u672c  end"
    spans = bpe.spans(text)
    ids = np.array([i for i, _, _ in spans], "<u4")
    assert ids.tobytes() == bpe.encode([text])[0] and bpe.decode(ids).decode() == text
    starts = bpe.offsets(ids)[:-1]
    for (_, a, z), at in zip(spans, starts, strict=True):
        assert len(text[:a].encode()) <= at <= len(text[:z].encode())
