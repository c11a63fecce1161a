"""The corpus pipeline stage by stage against plain versions, and the registry."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from veilmark.llm import private, quality
from veilmark.llm.decontaminate import Matcher, normalized

from .test_operators import ODD, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    items = [words(30, 900 + i) for i in range(4)]
    texts: list[str | None] = [words(r.randint(60, 120), i) for i in range(30)]
    texts += [texts[0], texts[1], texts[1] + " x", words(40, 40) + " " + items[0] + " " + words(20, 41), items[1].upper() + "\n" + words(40, 42)]
    texts += [f"{words(50, 60 + i)} write to user{i}@mail.example.com {words(8, 70 + i)}" for i in range(4)]
    texts += [f"vilewo{x} {words(5, 80 + i)} Vilewo{x}, {words(70, 90 + i)}" for i, x in enumerate("abcdef")] + ["### %% $$ " * 40, *ODD]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, int("vilewo" in (t or ""))) for i, t in enumerate(texts)] + [(None, 1, 1), (3, 1, None), (10**6, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), texts, items


def test_stages_and_run(spark, folder):
    path, texts, items = folder
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = dict(enumerate(texts))
    lexicon = quality.learn_lexicon(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert "vilewo*" in lexicon and sum("vilewo" in (t or "") for t in texts) == 6
    measure = quality.Measure(lexicon)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == names
        docs = corpus_pipeline.written(docs, name)
        got = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            bad = lambda t: any(eval(rule.replace("AND", "and"), {}, dict(zip(quality.NAMES, measure(t or ""), strict=True))) for rule_name, rule in quality.RULES if rule_name in quality.POLICIES[quality.CURRENT])
            left = {i: t for i, t in left.items() if not bad(t)}
        elif name == "near_duplicates":
            # five-word shingles, similarity 0.8: copies here are near to the first of their kind, so no chains arise
            sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in left.items())}
            left = {i: t for i, t in left.items() if not any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in left)}
        elif name == "decontamination":
            m = Matcher([(i, normalized(t)) for i, t in enumerate(items)], 0.1)
            left = {i: t for i, t in left.items() if not m.matches(t)}
        else:
            left = {i: private.masked(t, private.base_spans(t)) for i, t in left.items()}
            assert all(got[i].n_chars == len(t) for i, t in left.items())
        assert {i: r.text for i, r in got.items()} == left
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    total: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, path).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == want and len(want) > 25


def test_registry():
    found, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(found)
    for n in range(1, 11):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in found and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op2_warc", "op3_quality_rules", "quality_ablations"])
def test_operator_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(repr([r[want.columns.index(c)] for c in order]) for r in want.fetchall())


def test_stages_and_run_by_similarity(spark, folder):
    path, texts, items = folder
    left = {r.doc_id: r.text for r in quality.kept_documents(spark.read.parquet(f"{path}/documents.parquet"), quality.learn_lexicon(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))).collect()}
    assert not any("vilewo" in t for t in left.values())
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in left.items())}
    near = {i for i in left if any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in left)}
    assert {30, 31, 32} <= near
    m = Matcher([(i, normalized(t)) for i, t in enumerate(items)], 0.1)
    left = {i: private.masked(t, private.base_spans(t)) for i, t in left.items() if i not in near and not m.matches(t)}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, path), name)
    assert {r.doc_id: r.text for r in docs.collect()} == left
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()} == set(left)
