"""Merkle manifest, spelling variants and SimHash groups against brute force, on real texts and on edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import queries, simhash, spelling
from fleetlens.llm.merkle import manifest
from fleetlens.llm.ranks import ranked
from fleetlens.llm.simhash import gray_rank, near_links, simhash_groups
from fleetlens.llm.spelling import block_near, chain_ends, variants

SF = "/root/testdata/sf0.001"
CLASHES = ("digest", "forged", "tree", "lo", "hi", "kids", "ups", "code", "gray", "rank", "node", "word", "n", "p", "s", "run", "h", "id", "_at", "size", "root")
LONG = " ".join(f"word{i % 977} {i % 13} abcde{'fghij'[i % 5]}" for i in range(30_000))
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a row without id has some words in it"), (None, None), (4, "same words here"), (4, "same words here"),
    (4, "another text of the same id"), (5, LONG), (6, LONG + " tail"), (7, "A" * 3000), (8, "é" * 150 + "\n" + "É" * 150), (9, "one"), (10, "One"),
    (11, "Kolour kolour kolour color color color color color color color"), (12, "kolour. cölor"), (13, "x" * 70_000 + " " + "y" * 5),
]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Rows ``doc_id, source, lang, n_chars, text``; results sorted by their text form."""
    def leaf(r):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        """Root, and per leaf its steps (siblings before, siblings after)."""
        ups, place = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for leaf_steps, at in zip(ups, place, strict=True):
                run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
                leaf_steps.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            place = [at // 16 for at in place]
            nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        return nodes[0], ups

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    if not names:
        return []
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, tops, strict=True):
        for r, steps in zip(by[s], trees[s][1], strict=True):
            value = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                value = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            steps = steps + above
            for left, right in steps:
                value = h(left, value, right)
            out.append((r[0], leaf(r), trees[s][0], root, h(*(a + b for a, b in steps)), value, value == root))
    return sorted(out, key=str)


def manifest_rows(df):
    rows = manifest(df).withColumn("proof", F.sha2(F.array_join(F.transform("ups", lambda s: F.concat(s["left"], s["right"])), ""), 256))
    return sorted(map(tuple, rows.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()), key=str)


def as_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


@pytest.mark.parametrize("sizes", [(1,), (16,), (17,), (1, 2, 15, 16, 17, 31, 256, 257, 300), (3,) * 40])
def test_manifest_of_many_shapes(spark, sizes):
    rng = random.Random(3)
    rows, i = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            rows.append((i, None if k == 1 else f"s{k}é", rng.choice(["de", None]), rng.randint(0, 9), rng.choice(["", None, "Text A", "text b", f"Ü{i}"])))
            i += 1
    rng.shuffle(rows)
    assert manifest_rows(as_table(spark, rows)) == brute_manifest(rows)


def test_manifest_of_edge_rows(spark):
    rows = [(d, random.Random(i).choice(["a", None, "", "B"]), None, len(t or ""), t) for i, (d, t) in enumerate(EDGES)]
    rows += rows[:4] + [(None, None, None, None, None)]
    assert manifest_rows(as_table(spark, rows)) == brute_manifest(rows)
    assert manifest(as_table(spark, [])).count() == 0


def test_manifest_of_real_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted(map(tuple, queries.op11_merkle_manifest(spark, SF).collect()), key=str)
    assert got == brute_manifest(rows)
    assert {g[6] for g in got} == {True, False}


def test_ranks_follow_the_order_within_groups(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("g"), (F.col("id") * 37 % 1000).alias("v")).repartition(5)
    rows = ranked(df, "g", F.col("v").desc()).collect()
    assert len(rows) == 1000
    for g in range(7):
        own = sorted((r for r in rows if r.g == str(g)), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.size for r in own} == {len(own)}
        assert [r.v for r in own] == sorted((r.v for r in own), reverse=True)


# spelling variants


def brute_variants(rows, least=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and code % 97 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}
    gaps = {}
    for w in n:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            near[w] |= gaps[i, cut] - {w}
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        end = w
        while form[end] is not None:
            end = form[end]
        out.append((w, form[w], end, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variant_rows(df, **kw):
    return sorted(map(tuple, variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def with_clashes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


def test_variants_of_real_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_variants(rows)
    assert sorted(map(tuple, queries.op12_spelling_variants(spark, SF).collect())) == want
    assert len(want) > 100 and any(w[1] for w in want)


@pytest.mark.parametrize("tile", [3, 4096])
def test_variants_of_dense_words(spark, tile):
    """Words over two letters, so that keys are halved down to single open letters."""
    rng = random.Random(tile)
    made = ["".join(rng.choice("abÿ") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    rows = [(d, " ".join(rng.choices(made, weights=[1 << i % 7 for i in range(400)], k=60)).title()) for d in range(100)]
    want = brute_variants(rows)
    assert variant_rows(with_clashes(spark, rows), tile=tile) == want
    assert any(w[2] != w[1] for w in want if w[1])


def test_variants_of_edge_rows(spark):
    rows = EDGES + [(20 + i, ("x" * 69_999 + " ") * 3) for i in range(2)] + [(30, ("x" * 70_000 + " ") * 9)]
    assert variant_rows(with_clashes(spark, rows)) == brute_variants(rows)
    assert variants(with_clashes(spark, [])).count() == 0
    assert variants(with_clashes(spark, [(1, None), (2, "ab cd")])).count() == 0


def test_block_counts_each_pair_once():
    words = np.array(["abcde", "abcdf", "abcdef", "xbcde", "abde"], "<U6")
    counts = np.array([5, 9, 9, 1, 100])
    first = block_near(words[:4], counts[:4], 5, 2, 0, 1 << 30)
    rest = block_near(words[:4], counts[:4], 5, 0, 3, 2)
    assert dict(zip(first[0], first[1], strict=True)) == {"abcde": 2, "abcdf": 2, "abcdef": 2}
    assert dict(zip(rest[0], rest[1], strict=True)) == {"abcde": 1, "xbcde": 1}
    assert dict(zip(first[0], first[3], strict=True)) == {"abcde": "abcdef", "abcdf": "abcdef", "abcdef": "abcdf"}


def test_chains_are_followed_to_their_ends(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("side", "w5")]
    got = chain_ends(spark.createDataFrame(links, "word string, root string"), 3 * 2**37, 2).collect()
    assert {r.root for r in got} == {"w37"} and len(got) == 38


# simhash


def brute_code(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute_groups(rows, limit=2, code=brute_code):
    codes = [code(t) for _, t in rows]
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                parent[find(a)] = find(b)
    least = {}
    for (d, _), c in zip(rows, codes, strict=True):
        if d is not None:
            least[find(c)] = min(d, least.get(find(c), d))
    return sorted(((d, f"{c:016x}", least.get(find(c))) for (d, _), c in zip(rows, codes, strict=True)), key=str)


def group_rows(df, **kw):
    rows = simhash_groups(df, **kw).select("doc_id", simhash.hex_code(F.col("code")), "component_id")
    return sorted(map(tuple, rows.collect()), key=str)


def test_groups_of_real_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_simhash(spark, SF).collect()), key=str) == brute_groups(rows)


def test_groups_of_edge_rows(spark):
    long = [(d, t[:90_000] if t else t) for d, t in EDGES]
    assert group_rows(with_clashes(spark, long)) == brute_groups(long)
    assert simhash_groups(with_clashes(spark, [])).count() == 0


@pytest.mark.parametrize(("block", "limit"), [(4, 2), (50, 3)])
def test_groups_of_dense_fingerprints(spark, monkeypatch, block, limit):
    """Fingerprints around a few centres and at random, through trees of several levels."""
    rng = random.Random(block)
    codes = [rng.getrandbits(64) for _ in range(300)]
    centres = [rng.getrandbits(64) for _ in range(5)] + [0, (1 << 64) - 1]
    for _ in range(700):
        code = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            code ^= 1 << rng.randrange(64)
        codes.append(code)
    rows = [(i, str(c)) for i, c in enumerate(codes)]
    frame = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)], "doc_id long, code long")
    gray = (gray_rank(np.array(codes, np.uint64)) ^ np.uint64(1 << 63)).view(np.int64)
    frame = frame.join(spark.createDataFrame(list(zip(range(len(codes)), gray.tolist(), strict=True)), "doc_id long, gray long"), "doc_id")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    assert group_rows(frame, block=block, limit=limit) == brute_groups(rows, limit, int)


def test_gray_neighbours_differ_in_one_bit():
    place = np.arange(4096, dtype=np.uint64)
    code = place ^ (place >> np.uint64(1))
    assert (gray_rank(code) == place).all() and (np.bitwise_count(code[1:] ^ code[:-1]) == 1).all()


def test_links_between_blocks_connect_all_near_pairs():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    codes = codes[np.argsort(gray_rank(codes))]
    for a, b in ((codes, None), (codes[:100], codes[100:])):
        x, y = near_links(a, b, 2)
        assert len(x) < len(codes)
        label = {int(c): int(c) for c in codes}
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            label = {k: label[p] if v == label[q] else v for k, v in label.items()}
        for p in a.tolist():
            for q in (codes if b is None else b).tolist():
                if (p ^ q).bit_count() <= 2:
                    assert label[p] == label[q]


def test_plans_have_no_cross_join_or_single_task_sort(spark):
    plan = spelling.near_counts(spelling.keys_of(spark.createDataFrame([("abcdef", 3)], "word string, n long"), 10), 10)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "SinglePartition" not in plan
