"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from admitflow.llm import exact_whitening, prefix_trie, quotient_dedup
from admitflow.llm.quotient_dedup import QuotientFilter, merged_items

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 11: counting quotient filters


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**16 - 1), st.integers(1, 2**40)), max_size=60), st.sampled_from([16, 20, 56, 64]))
def test_filter_gives_its_items_back(pairs, bits):
    want = Counter()
    for v, c in pairs:
        want[v << (bits - 16)] += c
    values = np.array(sorted(want), np.uint64)
    counts = np.array([want[int(v)] for v in values], np.int64)
    back, n = QuotientFilter.from_bytes(QuotientFilter.of(values, counts, bits).to_bytes()).items()
    assert back.tolist() == values.tolist() and n.tolist() == counts.tolist()


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts, want = [], Counter()
    for size in (0, 1, 500, 3000):
        drawn = Counter(rng.integers(0, 2**12, size).tolist())
        want += drawn
        values = np.array(sorted(drawn), np.uint64)
        parts.append(QuotientFilter.of(values, np.array([drawn[int(v)] for v in values], np.int64), 40).items())
    values, counts = merged_items(parts)
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == dict(want)


def brute_dedup(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[WHITE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for plain, members in groups.items():
        best = min(members)
        for i, m in enumerate(sorted(members)):
            out.append((m[3], best[3], len(members), i == 0, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def dedup_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


DOCS = [
    (1, "a b c"), (2, "abc"), (3, " a\tb\r\nc "), (4, None), (5, ""), (6, " \x0b\x0c"), (7, "abd"), (None, "abc    d"), (8, "abcd"), (None, "abc    d"),
    (9, "é x"), (10, "é x"), (11, "éx"), (9, "é x"), (12, "𝒳 y" * 3), (13, "𝒳y " * 3), (-5, "long " * 200_000), (14, "long" * 200_000), (15, "x"),
]


@pytest.mark.parametrize("bits", [64, 3])
def test_dedup_equals_brute_force(spark, bits):
    """Three bits make nearly all fingerprints collide: the bytes decide."""
    docs = spark.createDataFrame([(i, t, "x", 1.0, "s", 7) for i, t in DOCS], "doc_id long, text string, row string, n double, Fingerprint string, TEXT_ int")
    assert dedup_rows(quotient_dedup.report(docs.repartition(3), bits)) == brute_dedup(DOCS)


def test_dedup_of_a_hot_text(spark):
    rows = [(i, "same  text" if i % 3 else f"t {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert dedup_rows(quotient_dedup.report(docs)) == brute_dedup(rows)


def test_dedup_of_an_empty_table_and_of_names_that_differ_in_case(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, sha string")
    assert quotient_dedup.report(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert quotient_dedup.report(empty).count() == 0
    two = spark.createDataFrame([(1, "a", "zz"), (2, "a ", "zz")], "doc_id long, text string, TEXT string")
    assert [(r.doc_id, r.kept) for r in quotient_dedup.report(two).orderBy("doc_id").collect()] == [(1, False), (2, True)]


def test_unique_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in DOCS], "doc_id long, text string, row long, kept string")
    got = quotient_dedup.unique_documents(docs)
    assert got.columns == docs.columns
    kept = Counter(r[0] for r in brute_dedup(DOCS) if r[3])
    assert Counter(r.doc_id for r in got.collect()) == kept


# ---- 12: prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, digest, role, text))
    for turns in convs.values():
        turns.sort()
    built = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = [t[3:] for t in convs.get(base, [])[:h] + convs[c][h:]]
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ms in members.items():
        d = len(node)
        below = [x for x in members if x[:d] == node]
        kids = [x for x in below if len(x) == d + 1]
        leaves = sum(1 for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below))
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in ms if len(built[c]) == d)
        out.append((ms[0], d, members[node[:-1]][0] if d else None, len(ms), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 90), 60):
        n = rng.choice([1, 1, 2, 3, 4, 5, 9])
        for t in range(n):
            text = None if rng.random() < 0.1 else rng.choice(["a", "a b", "hello  big world", ""])
            rows.append((c, rng.choice([None, t, t, 3]), rng.choice(["user", None, ""]), text))
    rows += [(None, 1, "user", "lost"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "z", 5) for r in rows], CONVERSATIONS + ", depth string, Digest int").repartition(5)
    got = prefix_trie.report(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert trie_rows(got) == brute_trie(rows)


def test_trie_of_a_popular_and_a_long_conversation(spark):
    rows = [(c * 20 + 7, t, "user", f"w {t}") for c in range(300) for t in range(3)]
    rows += [(3, t, "user", "v " * (t % 5)) for t in range(150)]
    rows += [(5, 0, "user", "only x" * 100_000)]
    old = prefix_trie.PIECE_IDS
    prefix_trie.PIECE_IDS = 7
    try:
        assert trie_rows(prefix_trie.report(spark.createDataFrame(rows, CONVERSATIONS))) == brute_trie(rows)
    finally:
        prefix_trie.PIECE_IDS = old


def test_trie_of_turnless_conversations_and_of_an_empty_table(spark):
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(turnless, 0, "user", "gone: its own first turn is dropped and there is no base")]
    assert trie_rows(prefix_trie.report(spark.createDataFrame(rows, CONVERSATIONS))) == brute_trie(rows)
    assert prefix_trie.report(spark.createDataFrame([], CONVERSATIONS)).count() == 0


# ---- 13: whitening


def whitened(spark, rows, schema="vec_id long, embedding array<float>"):
    return exact_whitening.report(spark.createDataFrame(rows, schema).repartition(3))


def check_whitening(got, kept):
    """kept: (vec_id, entries) rows in any order, with distinct ids."""
    x = {i: [int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v] for i, v in kept}
    n, d = len(x), len(kept[0][1])
    sums = [sum(v[j] for v in x.values()) for j in range(d)]
    centred = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in x.values()], object)
    cov = np.array((centred.T @ centred), float) / float(n) ** 3
    values = np.linalg.eigvalsh(cov)[::-1]
    z = defaultdict(dict)
    for r in got:
        z[r.vec_id][r.component] = r
    assert set(z) == set(x) and all(sorted(rs) == list(range(1, min(32, d) + 1)) for rs in z.values())
    for i, rs in z.items():
        exact = sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert all(r.n == n and r.deviation == exact and r.deviation_exact == exact for r in rs.values())
        for k, r in rs.items():
            assert abs(r.explained - values[k - 1] / cov.trace()) < 1e-9 and r.identity_error < 1e-9
    m = np.array([[z[i][k].whitened for k in sorted(z[i])] for i in x])
    assert np.abs(m.T @ m / n - np.eye(m.shape[1])).max() < 1e-9 and np.abs(m.mean(axis=0)).max() < 1e-9
    # each column is a linear image of the centred rows along an eigenvector
    inverse = np.linalg.lstsq(np.array(centred, float) / n, m, rcond=None)[0]
    for k in range(m.shape[1]):
        axis = inverse[:, k] * np.sqrt(values[k])
        assert abs(np.linalg.norm(axis) - 1) < 1e-6 and np.abs(cov @ axis - values[k] * axis).max() < 1e-6 * max(1, values[0])


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 40)) * np.linspace(0.3, 3, 40)
    kept = [(i, v.tolist()) for i, v in enumerate(base)]
    dropped = [(900, None), (901, []), (902, [float("nan")] + [0.0] * 39), (903, [None] + [0.0] * 39), (904, [float("inf")] * 40), (905, [1.0, 2.0])]
    rows = [(i, v, 3, "b") for i, v in kept + dropped]
    check_whitening(whitened(spark, rows, "vec_id long, embedding array<float>, n int, X string").collect(), kept)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(50, 3)) * 1e7 + 3e7)]
    got = whitened(spark, kept).collect()
    x = {i: [int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for i, v in kept}
    sums = [sum(v[j] for v in x.values()) for j in range(3)]
    for r in got:
        exact = sum((50 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert int(r.deviation_exact) == exact and r.deviation == (exact if exact < 2**63 else None)
    assert got[0].identity_error < 1e-9


def test_scatter_is_exact_whatever_the_batches(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**45), 2**45, (77, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(7)
    m = exact_whitening.moments(rows)
    centred = x.astype(object) * 77 - x.astype(object).sum(axis=0)
    assert (exact_whitening.exact_scatter(rows, m) == centred.T @ centred).all()
    assert m.reach == np.abs(centred).max()


def test_degenerate_tables(spark):
    same = whitened(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])]).collect()
    assert len(same) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)
    line = whitened(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(5)]).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-9
    huge = whitened(spark, [(i, [3e38 if i % 2 else -3e38, float(i)]) for i in range(4)]).collect()
    assert len(huge) == 8 and all(r.identity_error < 1e-6 for r in huge)
    assert whitened(spark, []).count() == 0 and whitened(spark, [(1, None)]).count() == 0
