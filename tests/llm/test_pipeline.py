"""The pipeline: what each stage keeps, and its result against a composition of plain versions."""

import hashlib
from random import Random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from test_jaccard_join import plain as plain_components
from test_run_length_dedup import plain as plain_dedup


def corpus():
    r = Random(8)
    word = lambda: "".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = line(90)
    docs = []
    for i in range(40):
        lines = [line(r.randrange(12, 25)) for _ in range(6)]
        if i % 4 == 0:
            lines.insert(3, passage)
        if i % 5 == 0:
            lines[2] += " token = \"%040x\" end." % r.getrandbits(160)
        docs.append("\n".join(lines))
    docs += [docs[1], docs[2].replace(docs[2].split()[7], "changed", 1)]
    docs += ["\n".join("SHOUT!! %s $$$ %%%%%%" % line(12).upper() for _ in range(6)) for _ in range(8)]
    return [(i, t, "en", "s%d" % (i % 3), len(t)) for i, t in enumerate(docs)] + [(90, None, None, None, None), (91, "too short", "en", "s", 9)]


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int("!!" not in t)) for i, t, *_ in rows[:50]], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(at))
        assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out[name] = {r.doc_id: r.text for r in docs.collect()}
    return str(at), dict((i, t) for i, t, *_ in rows), out


def test_stages(done):
    _, texts, out = done
    rules = out["quality_rules"]
    assert set(rules) == set(range(42)) and all(rules[i] == texts[i] for i in rules)
    near = out["near_duplicates"]
    want = {c for _, _, c in plain_components(sorted(rules.items()), 5, 80)}
    assert set(near) == want == set(range(40))
    cut = out["repeated_passages"]
    for (i, _, gone, _, digest), (j, text) in zip(sorted(plain_dedup(sorted(near.items()), corpus_pipeline.PASSAGE_BYTES)), sorted(cut.items()), strict=True):
        assert i == j and hashlib.sha256(text.encode()).hexdigest() == digest
        assert (gone > 0) == (i % 4 == 0)
    clean = out["secrets"]
    assert all("[assign]" in clean[i] if i % 5 == 0 else clean[i] == cut[i] for i in clean)


def test_run_packs_what_is_left(spark, done):
    from tokenizers import Tokenizer

    at, _, out = done
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, at).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in out["secrets"].items()}


def test_one_of_each_with_repeated_and_null_ids(spark):
    from admitflow.llm import jaccard_join

    t = " ".join(f"w{i}" for i in range(60))
    rows = [(2, t), (2, t), (None, t), (None, "alone in here with six words"), (7, "other text " + t[:90]), (1, ""), (1, None)]
    df = spark.createDataFrame([(i, x, "z") for i, x in rows], "doc_id long, text string, component_id string")
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, t), (None, "alone in here with six words"), (7, "other text " + t[:90]), (1, ""), (1, None)], key=str)
