"""Operator 6 against a dictionary of all windows."""

import hashlib
from random import Random

import pytest

from admitflow.llm import run_length_dedup as D


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, b in enumerate(texts):
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (d, _), b in zip(rows, texts):
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopé") for _ in range(r.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30) for _ in range(3)]
    rows = [None, "", "short", "a" * 700, "ab" * 300, "the same line, again. " * 40, "é" * 200]
    for i in range(40):
        t = prose(r.randrange(1, 60))
        if i % 3:
            t += " " + r.choice(shared) + " " + prose(5)
        if i % 5 == 0:
            t += shared[0][r.randrange(40) : r.randrange(60, 150)]
        rows.append(t)
    rows += rows[10:14] + [rows[15][:-30] + "changed at the end of it", "x" + rows[16]]
    base = prose(60)
    for _ in range(12):
        k = r.randrange(len(base))
        rows.append(base[:k] + r.choice(("", "Q")) + base[k + 1 :])
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(5, rows[5]), (6, "another text under the same id " + shared[1]), (None, "no id " + shared[2])]


def result(spark, rows, length, watch=None):
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, key long, start long").repartition(3)
    return sorted((tuple(r)[:5] for r in D.report(df, length, watch).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_bytes_go_as_by_all_windows(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows, 64) == plain(rows, 64)


def test_large_groups_are_refined(spark, monkeypatch):
    monkeypatch.setattr(D, "GROUP", 1)
    monkeypatch.setattr(D, "CHUNK", 1)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    rows = corpus(3)
    assert result(spark, rows, 64) == plain(rows, 64)
    assert result(spark, [], 64) == []
    assert result(spark, [(1, "x"), (2, None)], 64) == plain([(1, "x"), (2, None)], 64)


def test_index_alone():
    r = Random(2)
    for _ in range(30):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 90))) for _ in range(6)]
        parts += [parts[0][5:], parts[1] + parts[2]]
        for length in (9, 17, 40):
            seen = {}
            for i, b in enumerate(parts):
                for p in range(len(b) - length + 1):
                    seen.setdefault(b[p : p + length], []).append((i, p))
            want = [bytearray(len(b)) for b in parts]
            for places in seen.values():
                if len(places) > 1:
                    for i, p in places:
                        want[i][p : p + length] = b"\1" * length
            got = [bytearray(len(b)) for b in parts]
            for g, spans in zip(got, D.repeated_ranges(parts, length)):
                for a, z in spans:
                    g[a:z] = b"\1" * (z - a)
            assert got == want


def test_strip_keeps_whole_characters(spark):
    shared = "\u00e9" * 40 + "tail one"  # é and ê share their first byte, so the repeat ends inside a character
    rows = [(1, "x\u00e9" + shared + "\u00e9", "en", "s", 51, "k"), (2, "\u00c9" + shared + "\u00ea", "en", "s", 50, "k"), (3, "clean", "en", "s", 5, "k"), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _af_x string")
    got = {r.doc_id: r for r in D.strip(df, 64).collect()}
    assert got[3].text == "clean" and got[3].n_chars == 5 and got[4].text is None
    plainly = {i: plain([(j, t) for j, t, *_ in rows[:2]], 64)[i - 1] for i in (1, 2)}
    for i in (1, 2):
        assert plainly[i][2] > 0 and got[i].n_chars == len(got[i].text) < rows[i - 1][4] and "\ufffd" not in got[i].text


def passages(rows, length, words):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for (d, _), b in zip(rows, texts):
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        edges = [i for i in range(len(b) + 1) if (i < len(b) and cover[i]) != (i > 0 and cover[i - 1])]
        out.append((d, sum(len(b[a:z].split()) > words for a, z in zip(edges[::2], edges[1::2]))))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [200, 1])
def test_shorter_passages_are_counted_and_stay(spark, monkeypatch, group):
    monkeypatch.setattr(D, "GROUP", group)
    monkeypatch.setattr(D, "PASSAGE_WORDS", 8)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in D.report(df, 96, 48).collect()]
    assert sorted((r[:5] for r in got), key=str) == plain(rows, 96)
    assert sorted(((r[0], r[5]) for r in got), key=str) == passages(rows, 48, 8)
    assert sum(r[5] for r in got) > sum(r[3] for r in got)
