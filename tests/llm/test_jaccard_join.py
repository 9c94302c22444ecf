"""Operator 5 against all pairs."""

import re
from random import Random

import numpy as np
import pytest

from admitflow.llm import jaccard_join as J


def plain(rows, n=3, percent=90):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows, n=3, percent=90):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n long, rep long").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df, n, percent).collect()), key=str)


def vary(r, words, k):
    words = list(words)
    for _ in range(k):
        i = r.randrange(len(words))
        words[i : i + r.choice((0, 1, 1))] = [f"x{r.randrange(10**6)}"] * r.choice((0, 1))
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_same_components_as_all_pairs(spark, seed):
    r = Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n ", "one", "One", "one two", "ONE  two", "a b c", "A\tb\nC d", "É b c", "é b c", "a\x1fb c\x85d e", "rep " * 50, "rep " * 90]
    for size, copies, most in ((9, 6, 1), (12, 8, 2), (30, 20, 4), (120, 60, 12), (150, 40, 3), (700, 10, 40)):
        base = [r.choice(vocab) for _ in range(size)]
        texts += [" ".join(vary(r, base, r.randrange(most + 1))) for _ in range(copies)]
    chain = [r.choice(vocab) for _ in range(200)]
    for _ in range(30):  # a chain of neighbours that ends far from its start
        chain = vary(r, chain, 1)
        texts.append(" ".join(chain))
    texts += texts[20:30]
    r.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9, "one two"), (9, "another row with its id"), (None, "one two"), (None, "alone it is, this one")]
    assert result(spark, rows) == plain(rows)


def test_blocks_and_other_thresholds(spark, monkeypatch):
    r = Random(4)
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 1)
    base = [f"w{r.randrange(300)}" for _ in range(100)]
    rows = [(i, " ".join(vary(r, base, r.randrange(14)))) for i in range(90)]
    assert result(spark, rows, percent=80) == plain(rows, percent=80)
    assert result(spark, rows, n=2, percent=95) == plain(rows, 2, 95)


def test_swaps_keep_every_link(spark, monkeypatch):
    """A segment that a whole band shares gives way to a one-deletion neighbourhood."""
    r = Random(6)
    monkeypatch.setattr(J, "PAIR_COST", 10**6)
    words, tops = J.WordHashes(), J.band_tops(90)
    band = J.own_bands(10, tops, 90)[0]
    cell = lambda w: int(J._cells(J.shingle_set(w, words, 1), band, J.segments_of(tops[band], 90))[0][0])
    fixed = [f"f{i}" for i in range(9)]
    own = [w for w in (f"v{i}" for i in range(200)) if cell(w) == 1][:40]
    rows = [(i, " ".join([*fixed, w])) for i, w in enumerate(own)]
    rows += [(100 + i, " ".join([*fixed[: i % 9], *fixed[i % 9 + 1 :], w])) for i, w in enumerate(own[::3])]
    r.shuffle(rows)
    swapped, real = [], J._allocate

    def seen(meets, *rest):
        out = real(meets, *rest)
        swapped.append(out[0] is not meets)
        return out

    monkeypatch.setattr(J, "_allocate", seen)
    assert result(spark, rows, n=1) == plain(rows, 1)
    assert swapped == [True]
    assert result(spark, [], n=1) == []


def test_pigeonhole():
    """Linked sets agree on a segment of a common band, however their difference falls."""
    rng = np.random.default_rng(1)
    tops = J.band_tops(90)
    for _ in range(400):
        size = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        d = int(rng.integers(0, J.allowed(len(a), 90) + 1))
        cut = int(rng.integers(0, d + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[cut:], rng.integers(0, 2**63, d - cut).astype(np.uint64)]))
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * inter < 90 * union:
            continue
        sig = [{int(x) for k in J.own_bands(len(s), tops, 90) for x, used in zip(*J.emitted(s, k, tops[k], 90)) if used} for s in (a, b)]
        assert sig[0] & sig[1]
        x, y = J.sketch(a), J.sketch(b)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= union - inter
