"""Quality scores and leaks against plain versions; rows of the pipeline judged one by one; windows that are kept."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import decontaminate, native, queries
from fleetlens.llm.ngram_join import window_keys
from fleetlens.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"
BUCKETS = 1 << 14


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def plain_buckets(text):
    tokens = [t.encode() for t in regex.findall(r"\p{L}+|\p{N}+|[^ \t\n\x0b\f\r\p{L}\p{N}]+", text or "")]
    one = [xxhash.xxh64_intdigest(t, 42) for t in tokens]
    two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, tokens[1:], strict=False)]
    return [h % BUCKETS for h in one + two]


def plain_scores(rows, trusted):
    raw, good = Counter(), Counter()
    for doc_id, text in rows:
        raw.update(plain_buckets(text))
        if doc_id in trusted:
            good.update(plain_buckets(text))
    all_raw, all_good = sum(raw.values()), sum(good.values())
    weight = {b: math.log((good[b] + 1) / (all_good + BUCKETS)) - math.log((raw[b] + 1) / (all_raw + BUCKETS)) for b in raw}
    for doc_id, text in rows:
        found = plain_buckets(text)
        yield doc_id, sum(weight[b] for b in found) / len(found) if found else 0.0


@pytest.mark.parametrize(("block_ids", "most_blocks"), [(500_000, 16), (7, 50), (7, 1)])
def test_scores_equal_a_plain_version(spark, monkeypatch, block_ids, most_blocks):
    from fleetlens.llm import quality_rules as module

    model = module.gram_model
    monkeypatch.setattr(module, "gram_model", lambda *a: model(*a, block_ids, most_blocks))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(900, None), (901, ""), (None, "a b"), (1, "again. One 1")]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    ids = spark.createDataFrame([(i,) for i in [*trusted, *trusted, None]], "doc_id long")
    got = quality_rules(docs_of(spark, rows), ids).collect()
    want = sorted(plain_scores(rows, trusted), key=str)
    assert len(got) == len(want)
    for r, (doc_id, score) in zip(sorted(((r.doc_id, r.score) for r in got), key=str), want, strict=True):
        assert r[0] == doc_id and abs(r[1] - score) < 1e-9
    assert all(r.kept == (not r.base_failed and r.score >= -0.3) for r in got)


def test_texts_are_not_shuffled_by_the_rules(spark):
    plan = queries.op8_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_leaks(docs, items, share=0.8):
    found = set()
    for d, text in docs:
        own = words_of(text)
        for i, item in items:
            want = words_of(item)
            width = min(len(want), 13)
            need = math.ceil(width * share - 1e-9)
            for shift in range(-len(want), len(own) + 1) if want else ():
                equal = [0 <= k + shift < len(own) and own[k + shift] == want[k] for k in range(len(want))]
                if len(want) < 13 and not 0 <= shift <= len(own) - len(want):
                    continue  # a short item lies in the document as a whole
                if any(sum(equal[k : k + width]) >= need for k in range(len(want) - width + 1)):
                    found.add((d, i))
                    break
    return found


@pytest.mark.parametrize("block_seeds", [200_000, 70])
def test_leaks_equal_all_alignments(spark, block_seeds):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(n, " ".join(rng.choices(vocabulary, k=n))) for n in [*range(1, 16), 20, 40]]
    docs = []
    for d in range(300):
        words = rng.choices(vocabulary, k=rng.choice((0, 3, 12, 40)))
        passage = words_of(rng.choice(items)[1])
        if rng.random() < 0.3:
            passage = passage[rng.randint(0, 3) : len(passage) - rng.randint(0, 3)]
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3))):
            if passage:
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
        at = rng.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + passage + words[at:]).title()))
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs_of(spark, docs), bench, block_seeds=block_seeds).collect()}
    assert got == plain_leaks(docs, items)


def test_short_items_keep_a_mask_whatever_is_replaced():
    import itertools

    for length in range(1, 13):
        masks = decontaminate.whole_masks(length, 0.8)
        allowed = length - math.ceil(0.8 * length - 1e-9)
        for bad in itertools.combinations(range(length), allowed):
            assert any(all(c == "0" or k not in bad for k, c in enumerate(m)) for m in masks)


def test_leaking_rows_go_one_by_one(spark):
    passage = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words_of(r.text)) >= 13)
    docs = docs_of(spark, [(None, passage), (None, "clean words only"), (1, "also clean"), (1, f"before {passage} after"), (2, None)])
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.leaks(spark, docs, SF).collect()), key=str)
    assert left == sorted([(None, "clean words only"), (1, "also clean"), (2, None)], key=str)


def test_windows_are_a_part_of_all(spark):
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(1, 1 << 62, 100).astype(np.uint64))
    found, owner = window_keys(keys, np.zeros(100, np.int64), np.array([100]), 80)
    assert len(found) == len(owner) == 61


def test_scratch_tables_go(spark):
    import os

    scratch = native.Scratch()
    one, two = (scratch.stored(spark.range(3), name) for name in "ab")
    paths = [p for _, p in scratch.paths]
    scratch.drop(keep_last=1)
    assert not os.path.exists(paths[0]) and two.count() == 3 and one is not two
    scratch.drop()
    assert not os.path.exists(paths[1]) and F is not None
