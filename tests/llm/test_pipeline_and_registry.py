import sys
from collections import Counter
from pathlib import Path

import pytest

from .helpers import LOWER, documents
from .test_text_operators import brute_components, near_copies, rows

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture
def corpus(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(6)
    parts = {"en": ["the", "ing", "and", "wh", "th"], "fr": ["é", "eau", "ou", "à", "oi"]}
    data = [(i, " ".join("".join(rng.choice(parts[("en", "fr")[i % 2]], 2)) for _ in range(rng.integers(8, 80))), ("en", "fr")[i % 2], f"s{i % 3}") for i in range(120)]
    data += [(900 + k, t, "en", "s1") for k, (_, t, _, _) in enumerate(near_copies(3, 3, 5)[:15])]
    data += [(990, "12 34 56 !!", "en", "s0"), (991, None, "en", "s0"), (992, "the thing token=abcdefgh12 and the whing", "en", "s2")]
    folder = tmp_path / "sf"
    documents(spark, data).write.parquet(str(folder / "documents.parquet"))
    return str(folder), data


def test_stages_keep_their_promises(spark, corpus):
    import corpus_pipeline

    folder, data = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, folder)
        assert docs.columns == columns
        kept[name] = [(r["doc_id"], r["text"]) for r in rows(docs)]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {i for i, _ in kept["language_id"]} == {r[0] for r in data} - {990, 991}
    groups = brute_components([r for r in data if r[0] not in (990, 991)])
    assert sorted(i for i, _ in kept["near_duplicates"]) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert dict(kept["secret_scan"])[992] == "the thing [SECRET] and the whing"
    assert set(Counter(kept["source_mix"]).values()) <= {1, 2}
    assert {i for i, _ in kept["source_mix"]} <= {i for i, _ in kept["secret_scan"]}


def test_language_id_rejects_letter_junk_and_unlearned_languages(spark):
    import corpus_pipeline
    import numpy as np

    rng = np.random.default_rng(7)
    parts = {"en": ["the", "ing", "and", "wh", "th"], "fr": ["é", "eau", "ou", "à", "oi"]}
    data = [(i, " ".join("".join(rng.choice(parts[("en", "fr")[i % 2]], 2)) for _ in range(rng.integers(8, 80))), ("en", "fr")[i % 2], "s") for i in range(300)]
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n)) for n in (80, 400, 3000)] + ["съешь же ещё этих мягких французских булок " * 9, "\u6211\u80fd\u541e\u4e0b\u73bb\u7483\u800c\u4e0d\u4f24\u8eab\u4f53" * 20]
    odd = [(1000 + k, t, None, "s") for k, t in enumerate(junk)] + [(2000, "12 34", None, "s"), (2001, None, "en", "s"), (2002, "", "en", "s"), (None, data[0][1], "en", "s")]
    kept = Counter(r["doc_id"] for r in rows(corpus_pipeline.language_id(spark, documents(spark, data + odd), "")))
    assert kept == Counter([r[0] for r in data] + [None])
    none = documents(spark, [(1, "no language was learned", None, "s"), (2, "12", None, "s")])
    assert [r["doc_id"] for r in rows(corpus_pipeline.language_id(spark, none, ""))] == [1]
    assert rows(corpus_pipeline.language_id(spark, documents(spark, []), "")) == []


def test_near_duplicates_keep_every_clean_row(spark):
    import corpus_pipeline
    from tarn.llm import ngram_join

    one, two, three = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "a b c d e f g h i j")
    data = [(None, one, "en", "a"), (None, two, "en", "a"), (None, two, "fr", "a"), (5, three, "en", "a"), (5, "x y z u v w", "en", "a"), (7, three, "en", "a"), (8, one, "en", "a")]
    data += [(None, None, "en", "a"), (None, "", "en", "a"), (5, three, "en", "b")]
    docs = documents(spark, data)
    key = lambda x: (str(x[0]), str(x[1]))
    kept = [(r["doc_id"], r["text"]) for r in rows(corpus_pipeline.near_duplicates(spark, docs, ""))]
    assert sorted(kept, key=key) == sorted([(8, one), (None, two), (5, three), (5, "x y z u v w"), (None, None), (None, "")], key=key)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.join(docs)))
    assert got == Counter([(None, 3, 8), (8, 3, 8), (None, 3, None), (None, 3, None), (5, 6, 5), (5, 6, 5), (7, 6, 5), (5, 2, 5), (None, 0, None), (None, 0, None)])


def test_stages_take_empty_tables_and_clashing_names(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = ("_row", "_lang", "_score", "_foreign", "_read", "_copies", "_copy", "first", "token", "component_id")
    clash = lambda rows_: documents(spark, rows_).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    data = [(i, f"the thing number {i} and what it is with the rest of it {i * 7}", "en", f"s{i % 2}") for i in range(30)] + [(None, None, None, None)]
    for rows_ in ([], data):
        docs = clash(rows_)
        columns = docs.columns
        for name, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, "")
            got = docs.collect()
            if name != "best_fit_packing":
                assert docs.columns == columns and all(r[n] == k for r in got for k, n in enumerate(names))
            assert bool(got) == bool(rows_)
            docs = spark.createDataFrame(got, docs.schema)


def test_source_mix_takes_rows_that_share_an_id_each_for_itself(spark):
    import corpus_pipeline

    data = [((None, 5, k)[k % 3], f"text {k} " + "w " * (k % 7), "en", f"s{k % 2}") for k in range(90)]
    kept = Counter(r["text"] for r in rows(corpus_pipeline.source_mix(spark, documents(spark, data), "")))
    assert set(kept.values()) <= {1, 2} and set(kept) <= {t for _, t, _, _ in data} and len(kept) > 60


def test_run_equals_stages(spark, corpus):
    import corpus_pipeline

    folder, _ = corpus
    got = rows(corpus_pipeline.run(spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
    want = rows(docs)
    assert len({r["doc_id"] for r in want}) > 50
    same = lambda x: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in x)
    assert same(got) == same(want) and got


def test_every_operator_is_registered():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_lowercase_table_is_ascii_only():
    assert "ABCİ".translate(LOWER) == "abcİ"
