"""Awkward tables: repeated rows and ids, null ids, clashing names, very long runs, very many shards."""

from __future__ import annotations

import hashlib
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from veilmark.llm import quality, substrings

from .test_operators import brute_removed, documents, words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def check_substrings(df, rows, span, **options):
    want = sorted((-1 if i is None else i, len(b), sum(g), hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()) for (i, _), (b, g) in zip(rows, brute_removed(rows, span), strict=True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(df, span=span, **options).collect())
    assert got == want


def test_substrings_with_repeated_ids_and_rows(spark):
    passage, other = words(60, 1), words(70, 2)
    rows = [(5, passage + " " + words(30, 3)), (5, passage + " " + words(30, 4)), (3, words(9, 5) + passage), (5, words(20, 6) + passage), (None, other), (None, other + " more"), (None, other), (7, other), (7, other), (9, words(10, 7) + other + words(4, 8))]
    rows += [(8, words(3, 9) + passage + other), (8, passage + other), (8, words(40, 12)), (8, words(40, 12)[:150] + words(30, 13)), (2, words(40, 12)[20:140] + "." + words(5, 14))]
    for parts in (1, 4):
        check_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), rows, 100)


def test_substrings_with_random_ids(spark):
    r = random.Random(3)
    base = [words(40, 50 + i) for i in range(6)]
    rows = []
    for _ in range(120):
        cut = r.randrange(0, 80)
        rows.append((r.choice([None, 1, 2, 3, 4]), r.choice(["", words(2, r.randrange(4)) + " "]) + r.choice(base)[cut:] + r.choice(["", " " + r.choice(base)])))
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 100, hot_floor=4, hot_share=0.0)


def test_substrings_with_a_long_span(spark):
    shared = words(9000, 1)[:34_000]
    rows = [(1, "a" + shared + words(20, 2)), (2, words(9, 3) + shared)]
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string"), rows, 33_000)
    with pytest.raises(ValueError):
        substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), span=1 << 21)


SHARDS = """
import resource
resource.setrlimit(resource.RLIMIT_NOFILE, (256, resource.getrlimit(resource.RLIMIT_NOFILE)[1]))
import numpy as np, os, sys, tempfile
from veilmark.llm import arrays
base = "file://" + tempfile.mkdtemp()
paths = [arrays.write_array(base, np.arange(i, i + 5, dtype="<u8")) for i in range(1200)]
held = [arrays.open_array(p, "<u8") for p in paths]
assert all(int(a[0]) == i for i, a in enumerate(held)) and len(arrays._open) <= arrays.OPEN
print(len(held))
"""


def test_arrays_take_no_handles():
    done = subprocess.run([sys.executable, "-c", SHARDS], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.stdout.strip() == "1200", done.stderr


def test_many_shards(spark):
    """More shards than a worker keeps arrays open, in both operators that have shards."""
    from veilmark.llm import ngram
    from veilmark.llm.arrays import OPEN

    rows = [(i, words(60, i % 20) + words(20, 100 + i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_substrings(df, rows, 100, shard_bytes=150)
    held = df.withColumn("held_out", df["doc_id"] < 0)
    few, many = (sorted((r.doc_id, round(r.score, 6)) for r in ngram.score(held, ngram.train(df, shard_tokens=n)).collect()) for n in (6_000_000, 40))
    assert few == many and sum(len(t) for _, t in rows) // 200 > OPEN


def test_clashing_names_substrings(spark):
    df = documents(spark, [words(40, 1), words(40, 1)]).selectExpr("doc_id", "text", "1 as tell", "2 as doc", "3 as spans")
    assert sorted(r.n_removed for r in substrings.dedup_substrings(df).collect()) == [0, len(words(40, 1).encode())]


def test_clashing_names_in_stages(spark):
    """Every row and every value of columns that bear the names which operators might use themselves."""
    from veilmark.llm import private, quality
    from veilmark.llm.simhash import one_of_each
    from veilmark.llm.similar import one_of_similar

    names = ["__id", "__tell", "__ledger", "__spans", "ledger", "ledger1", "own_id", "own_tell", "row", "kept", "m_id", "m_tell", "m_spans", "fp", "tell", "spans", "doc", "n", "start"]
    text = words(80, 1)
    df = spark.createDataFrame([(1, text, *range(7, 7 + len(names))), (2, words(80, 2), *range(50, 50 + len(names))), (3, text, *range(99, 99 + len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    want = sorted(tuple(r) for r in df.filter("doc_id < 3").collect())
    for stage in (one_of_each, one_of_similar):
        assert sorted(tuple(r) for r in stage(df).collect()) == want
    assert sorted(tuple(r) for r in quality.kept_documents(df.filter("doc_id < 3")).collect()) == want
    assert sorted(tuple(r) for r in private.mask_private(df.filter("doc_id < 3")).collect()) == want


@pytest.mark.parametrize("max_bits", [1, 2, 3, 4])
def test_links_at_other_distances(spark, max_bits):
    from veilmark.llm.components import components
    from veilmark.llm.simhash import links

    r, fps = random.Random(max_bits), {0x1234567890ABCDEF}
    while len(fps) < 120:
        x = r.choice(sorted(fps))
        for _ in range(r.randint(1, max_bits + 1)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    values = sorted(fps)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in values}
    root = {x: x for x in values}
    for i, x in enumerate(values):
        for y in values[:i]:
            if (x ^ y).bit_count() <= max_bits and root[x] != root[y]:
                old, new = root[x], root[y]
                root = {k: new if v == old else v for k, v in root.items()}
    edges = links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"), max_bits)
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= max_bits for e in edges.collect())
    found = {x.node: x.root for x in components(edges).collect()}
    groups = lambda of: sorted(sorted(x for x in values if of(x) == g) for g in {of(x) for x in values})
    assert groups(lambda x: root[x]) == groups(lambda x: found.get(signed[x], signed[x]))


def test_links_of_a_very_crowded_key(spark, monkeypatch):
    from veilmark.llm import simhash

    monkeypatch.setattr(simhash, "POINTS", 500)
    r = random.Random(1)
    import numpy as np

    members = np.array(sorted({0xAB << 40 | r.getrandbits(9) for _ in range(200)}), np.uint64)
    mask = simhash.key_masks(2)[0][1]
    got = set()
    for e in simhash.crowded_links(members, mask & ~0x1FF, 2):
        got |= {tuple(sorted(x)) for x in e.T.tolist()}
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    root = {int(x): int(x) for x in members}

    def find(x, of):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in got:
        root[find(a, root)] = find(b, root)
    assert all(find(int(a), root) == find(int(b), root) for a in members for b in members if (int(a) ^ int(b)).bit_count() <= 2)


def test_one_row_per_null_and_repeated_id(spark):
    """Operators that give a row each give one for null ids and for every repetition."""
    import public_tokenizers

    from veilmark.llm import ngram, private, quality
    from veilmark.llm.packing import pack
    from veilmark.llm.simhash import near_duplicates
    from veilmark.llm.token_counts import token_counts

    tok = public_tokenizers.path("byte_bpe_50k.json")
    text = "mail a@b.example.com " + words(60, 1)
    rows = [(None, text), (None, text), (None, None), (4, text), (4, text), (4, "other"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    ids = sorted([(i is None, i or 0) for i, _ in rows])
    for made in (quality.ledger(df), token_counts(df, tok), private.digest(private.find_private(df)), ngram.train_and_score(df), near_duplicates(df)):
        assert sorted(key(r) for r in made.collect()) == ids
    emails = sorted((key(r), r.n_email) for r in private.digest(private.find_private(df)).collect())
    assert emails == sorted(((i is None, i or 0), int("@" in (t or ""))) for i, t in rows)
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(None, 4), (None, 5), (4, 4), (5, 5)}
    assert sum(r.length for r in pack(df, tok).collect()) == sum(r.n_tokens + 1 for r in token_counts(df, tok).collect())
    assert {r.text for r in private.mask_private(df).collect()} == {"mail [EMAIL] " + words(60, 1), None, "other", ""}


def test_warc_of_few_and_of_repeated_rows(spark):
    from veilmark.llm import warc

    rows = [(1, "u", "abc"), (2, "u", "abc"), (2, "u", "abc"), (3, None, "")]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    for r in manifest.collect():
        data = open(r.path.removeprefix("file://"), "rb").read()
        magic, size = warc.struct.unpack_from("<II", data)
        assert magic == warc.MAGIC_DICTIONARY and size > 8
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(manifest).collect())
    assert got == [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None)]


def test_shared_folder(spark):
    from veilmark.llm import _common, arrays

    path = _common.fresh_dir(spark, "x")
    assert path.startswith("file:///")
    assert arrays.store_of(path)[1].startswith("/")
    for bad in ("/user/x", "dbfs://x/y"):
        with pytest.raises(ValueError):
            arrays.store_of(bad)
    kept = _common.written(spark.range(3), "y")
    _common.release(kept)
    assert not os.path.exists(kept.stored_at.removeprefix("file://"))


def test_identifier_runs_match_a_plain_pattern():
    """The linear scanner against the pattern that says what it looks for."""
    import re

    from veilmark.llm import private

    plain = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z._@+/=-]*[0-9])[A-Za-z0-9][A-Za-z0-9._@+/=-]{4,}[A-Za-z0-9=]")
    r = random.Random(8)
    for _ in range(4000):
        t = "".join(r.choices("ab1-._@+/= é\n", k=r.randint(0, 24)))
        assert private.runs(t) == [m.span() for m in plain.finditer(t)], t
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(4000):
        t = "".join(r.choices("12.. a", k=r.randint(0, 24)))
        assert [m.span() for m in private.IP.finditer(t)] == [m.span() for m in ip.finditer(t)], t


@pytest.mark.parametrize("unit", ["a", "7", "-", ".", "1.", "a-", "1-", "a@", "@", "+", "+1", "(1) ", "1 ", "f", "=", "a.", "0x"])
def test_private_data_in_long_runs(unit):
    """A million characters of one kind take less than two seconds."""
    import time

    from veilmark.llm import private

    for text in (unit * (1_000_000 // len(unit)), "x@y.zz 1.2.3.4 +1 " + unit * (1_000_000 // len(unit)) + " @ z"):
        began = time.process_time()
        private.candidates(text, private.base_spans(text))
        assert time.process_time() - began < 2


def test_short_items_are_matched_exactly(spark):
    from veilmark.llm.decontaminate import contaminated

    items = spark.createDataFrame([(1, "Who  wrote it?"), (2, "yes"), (3, ""), (4, None), (None, "no id here")], "item_id long, text string")
    texts = [(1, "so: who wrote it? He did."), (2, "who wrote its"), (3, "Yes"), (4, "eyes yesterday"), (5, "say YES, or"), (None, "there is no  ID\nhere"), (6, None), (7, "who wrote it"), (7, "who wrote it?")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.edits, r.start_char, r.end_char) for r in contaminated(docs, items).collect())
    assert got == [(0, 0, 0, 9, 20), (1, 1, 0, 4, 17), (3, 2, 0, 0, 3), (5, 2, 0, 4, 7), (7, 1, 0, 0, 13)]


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_lexicon_moves_only_labelled_texts(spark, tmp_path):
    """A text without a label, and a further copy of one with a label, stays where it is read."""
    r = random.Random(5)
    noise = lambda: "".join(r.choices("0123456789abcdef", k=20_000))
    rows = [(i, noise()) for i in range(1000)] + [(2000 + i, "same " + "copy " * 4000) for i in range(200)] + [(5, None), (None, noise())]
    marks = [(i, 1) for i in range(10)] + [(2000 + i, 0) for i in range(200)] + [(7, 0), (7, 0), (None, 1), (1001, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs, labels = spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame(marks, "doc_id long, toxic int")
    joined = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert quality.learn_lexicon(docs, labels) == frozenset()
        assert shuffled(spark) - before < 2_000_000  # the texts are 20 MB, and half of that when compressed
        named = docs.select(F.col("doc_id").alias("id"), "text").filter("text is not null")
        texts, _ = quality.labelled_texts(named, labels.filter("toxic in (0, 1)").withColumnRenamed("doc_id", "id"))
        got = sorted((x.text, x.toxic) for x in texts.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
    text = dict(rows[:1000])
    assert got == sorted([(text[i], 1) for i in range(10)] + [(text[7], 0), (rows[1000][1], 0)])


def test_filter_of_keys_lets_all_of_them_through(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    there = quality.met(keys, 20_000)
    others = spark.range(20_000, 60_000).select(F.xxhash64("id").alias("key"))
    assert keys.filter(there("key")).count() == 20_000
    assert others.filter(there("key")).count() < 4_000
