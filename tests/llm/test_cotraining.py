"""Operator 1: held-out accuracy, and its sums against plain numpy."""

from random import Random

import numpy as np

from admitflow.llm import cotraining as C
from admitflow.llm.common import WordHashes


def corpus(n=400, seed=1):
    r = Random(seed)
    docs, truth = [], {}
    for i in range(n):
        q = int(r.random() < 0.7)
        words = ["".join(r.choice("abcdeimnorst") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(40, 90))]
        if not q:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "***" for w in words]
        docs.append((i, " ".join(words), r.choice(("en", "de")), ("good%d" if q else "bad%d") % r.randrange(3) if r.random() < 0.8 else "mixed", 300 + r.randrange(99), 1))
        truth[i] = q
    return docs, truth


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, p_text int"


def test_held_out_accuracy_and_pseudo_labels(spark):
    docs, truth = corpus(1000)
    df = spark.createDataFrame(docs, SCHEMA)
    seen = {i for i in truth if i % 3 == 0}
    labels = spark.createDataFrame([(i, truth[i]) for i in seen] + [(None, 1), (1, None)], "doc_id long, quality int")
    features = C.featured(df).persist()
    model = C.fit(features, labels)
    got = {r.doc_id: r for r in C.score(features, model).collect()}
    rest = [i for i in truth if i not in seen]
    for name, least in (("p_quality", 0.97), ("p_text", 0.97), ("p_meta", 0.75)):
        assert np.mean([(got[i][name] >= 0.5) == truth[i] for i in rest]) >= least, name
    assert model.pseudo[0] == (0, 0) and max(map(max, model.pseudo[1:])) > 50
    assert min(map(min, model.pseudo[1:])) > 20  # both views teach in every round


def test_sums_are_those_of_all_rows(spark):
    docs, truth = corpus(60)
    rows = C.featured(spark.createDataFrame(docs, SCHEMA).repartition(5)).join(spark.createDataFrame([(i, float(q)) for i, q in truth.items() if i % 2], "doc_id long, quality double"), "doc_id", "left")
    (text, meta), _ = C._sums(rows, None)
    words = WordHashes()
    train = [d for d in docs if d[0] % 2 and not C._in_calibration(np.array([d[0]], np.int64))[0]]
    x = np.array([C.text_features(d[1], words) for d in train], np.float64)
    y = np.array([2 * truth[d[0]] - 1 for d in train])
    assert np.allclose(text[0], x.T @ x, atol=1e-6) and np.allclose(text[1], x.T @ y, atol=1e-6)
    assert np.isclose(meta[0][-1, -1], len(train))


def test_edges(spark):
    rows = [(1, None, None, None, None, 0), (1, "", "en", "s", 0, 0), (None, "word " * 9, "en", "s", -4, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.p_quality for r in C.classify(df, none).collect()] == [0.5] * 3
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert len(C.classify(df, one).collect()) == 3
    assert C.classify(df.limit(0), one).count() == 0


def test_confident_rows_are_the_ends_of_the_ranking():
    rng = np.random.default_rng(2)
    scores = np.clip(rng.normal(0, 0.6, 5000), -1.99, 1.99)
    cell = ((scores + 2) / 4 * C.BINS).astype(int)
    hist = np.zeros((3, C.BINS))
    hist[0, 3], hist[1, 300], hist[2] = 20, 80, np.bincount(cell, minlength=C.BINS)
    low, high = C._ends(hist)
    assert abs((scores <= low).mean() - C.SHARE * 0.2) < 0.01 and abs((scores >= high).mean() - C.SHARE * 0.8) < 0.01
    hist[2] = 0
    hist[2, 7] = 100
    assert C._ends(hist) == (-np.inf, np.inf)  # nothing is ranked
