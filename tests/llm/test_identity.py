"""Rows and classes that must not be taken for one another."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumen3d.llm import near_dedup, queries, quality, secret_scan
from lumen3d.llm.embedding_dedup import near_vectors
from lumen3d.llm.line_dedup import dedup_lines
from lumen3d.llm.near_dedup import near_duplicates
from lumen3d.llm.substring_dedup import remove_recurring
from lumen3d.llm.words import Words
from tests.llm.test_corpus import words_of


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize("words, part", [(("id585037", "id3112669"), slice(19, 64)), (("id1671180", "id15309917"), slice(0, 45)), (("id7731235", "id7738785"), None)])
def test_words_whose_hashes_agree_in_part_are_different_lines(spark, words, part):
    if part:  # 45 bits of 64, as order keys hold them, or as many others
        hashes = Words(pa.array([" ".join(words)]), lower=True).hashes
        assert len({int(h) >> part.start & (1 << part.stop - part.start) - 1 for h in hashes}) == 1
    one, two = words
    rows = [(0, one), (1, two), (2, f"{one} a b c\n{two} a b c"), (3, f"{one} {two} {one} {two}"), (4, f"{two} {one}")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), 4: ""}


def test_second_values_tell_words_apart():
    words = ["a", "b", "A", "ab", "abcdefgh", "abcdefghi", "xbcdefghi", "abcdefgh" * 3, "abcdefgh" * 2 + "abcdefgx", "é"]
    split = Words(pa.array(words), lower=True).checks
    assert split[0] == split[2] and len(set(split.tolist())) == len(words) - 1
    assert len(set(Words(pa.array(words), lower=False).checks.tolist())) == len(words)


def test_vectors_that_share_an_identifier(spark):
    rows = [(5, [1.0, 0.0, 0.0], 0), (5, [0.0, 1.0, 0.0], 0), (6, [1.0, 0.01, 0.0], 0), (7, [1.0, 0.02, 0.0], 0), (9, [0.0, 0.0, 1.0], 0), (8, [0.0, 0.01, 1.0], 0)]
    got = sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(5, 0, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (8, 1, 8, True), (9, 1, 8, False)]


def test_vectors_beside_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 0, 7, "x"), (2, [1.0, 0.1], 0, 7, "x")]
    got = sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cls int, digest string")).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False)]


def test_documents_that_share_an_identifier(spark):
    rng = random.Random(4)
    a, b = prose(rng, 120), prose(rng, 120)
    near = a.replace(a.split()[50], "edited")
    rows = [(1, a), (2, near), (2, b), (None, b), (None, prose(rng, 60))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in near_duplicates(frame).collect())
    assert got == [("1", "1"), ("2", "1"), ("2", "None"), ("None", "None"), ("None", "None")]
    cut = sorted((str(r["doc_id"]), r["n_removed"]) for r in remove_recurring(frame).collect())
    assert cut == [("1", 119), ("2", 119), ("2", 120), ("None", 0), ("None", 120)]
    lines = sorted((str(r["doc_id"]), r["n_removed_lines"]) for r in dedup_lines(frame).collect())
    assert lines == [("1", 0), ("2", 1), ("2", 1), ("None", 0), ("None", 0)]


def pipeline_rows(spark, rows):
    full = [(i, t, "en", s, len(t or ""), 1, "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _row int, _copies string, _times string")


def test_pipeline_keeps_rows_of_shared_identifiers(spark, sf_dir):
    rng = random.Random(5)
    a, alone = prose(rng, 100), prose(rng, 100)
    docs = pipeline_rows(spark, [(1, a, "s"), (2, a.replace(a.split()[30], "edited"), "s"), (2, alone, "s"), (3, a, "s"), (3, a, "s")])
    left = corpus_pipeline.near_copies(spark, docs, sf_dir)
    assert sorted((r["doc_id"], r["text"], r["_row"], r["_copies"], r["_times"]) for r in left.collect()) == sorted([(1, a, 1, "x", "y"), (2, alone, 1, "x", "y")])


def test_pipeline_mixes_rows_of_shared_identifiers(spark, sf_dir):
    rows = [(i % 3 if i % 4 else None, " ".join(f"w{i}" for _ in range(10)), "ab"[i % 10 == 0]) for i in range(200)]
    mixed = corpus_pipeline.mixture(spark, pipeline_rows(spark, rows), sf_dir)
    assert mixed.columns == pipeline_rows(spark, rows).columns
    taken = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    # 2000 words, of which 200 are of b: weights 5 and 2, b stops at 600
    assert abs(taken["b"] - 2000 * 2 / 7) <= 10 and abs(taken["a"] - 2000 * 5 / 7) <= 10
    assert {r["_times"] for r in mixed.collect()} == {"y"}


@pytest.mark.parametrize("block", [3, 8192])
def test_band_keys_in_blocks(spark, block):
    rng = random.Random(6)
    base = prose(rng, 150).split()
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(words_of(t)[k : k + 5]) for k in range(146)} for i, t in rows}
    home = {i: i for i in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                    home[x] = home[y] = min(home[x], home[y])
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == home


def test_templates_are_not_verified_pair_by_pair(spark, monkeypatch):
    """Documents that share about 0.6 of their shingles: few of their pairs reach the whole sets."""
    rng = random.Random(7)
    base, rows = prose(rng, 2500).split(), []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(2500), 120):
            words[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    asked = []
    whole = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *rest: (asked.append(pairs.count()), whole(pairs, *rest))[1])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 60
    assert sum(asked) <= 60


def test_wide_parities_bound_differences():
    rng = np.random.default_rng(8)
    for n in (300, 900, 5000):
        shingles = rng.integers(1, 1 << 62, n).astype(np.uint64)
        other = np.concatenate([shingles[: n * 9 // 10], rng.integers(1, 1 << 62, n // 20).astype(np.uint64)])
        values = np.concatenate([shingles, other])
        rows = np.repeat([0, 1], [len(shingles), len(other)])
        lists = near_dedup.set_parities(values, rows, np.array([len(shingles), len(other)]))
        wide = near_dedup.Parities(lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy())
        found = int(wide.differing(np.array([0]), np.array([1]))[0])
        real = n - n * 9 // 10 + n // 20
        assert found <= real and (n < 512 or found >= real * 0.7)


def test_learning_takes_the_least_text_of_an_identifier(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (3, "c")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "train", lambda texts, known, seed: sorted(zip(texts, known.tolist(), strict=True)))
    assert quality.fit_quality(docs, labels) == [(b"", 1.0), (b"c", 0.0)]


def test_quality_query(spark, sf_dir):
    """held_out and predicted follow from doc_id and score; the scores of rows never learned from tell the labels apart."""
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_quality"](spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1
    unseen = [(labels[i], r["score"]) for i, r in got.items() if r["held_out"] and i in labels]
    pairs = [(s, t) for y, s in unseen if y == 1 for z, t in unseen if z == 0]
    assert pairs and np.mean([s > t for s, t in pairs]) > 0.9


def test_gradients_do_not_depend_on_slices():
    net = quality.Network.fresh(2)
    chunks = np.concatenate([quality.chunks_of(bytes(range(30, 120)) * k) for k in (40, 3)])
    firsts = np.array([0, len(quality.chunks_of(bytes(range(30, 120)) * 40))])
    one, two = (quality.gradients(chunks, firsts, np.array([1.0, 0.0], "f4"), net.weights, chunks_at_once=k) for k in (1000, 3))
    assert all(np.allclose(one[k], two[k], atol=1e-6) for k in one)


def test_shards_query(spark, sf_dir):
    rows = queries.QUERIES["op6_sharding"](spark, sf_dir).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    slots, sizes = {}, [0] * 24
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_packing_query(spark, sf_dir):
    rows = queries.QUERIES["op2_packing"](spark, sf_dir).collect()
    total, bins = sum(r["length"] for r in rows), {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(bins) <= math.ceil(total / 4096) + 1
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096


def test_hex_dumps(spark):
    """Matches beyond one run of sums."""
    text = " ".join(f"{i:016x}" if i % 3 else "zz token: abcdefgh1234ABCD" for i in range(700))
    got = secret_scan.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["found"]
    want = []
    for order, rule in enumerate(secret_scan.BASE + secret_scan.MORE):
        want += [(m.start(), order, rule.kind, m.end()) for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.min_length]
    assert [(s["start"], s["kind"], s["end"]) for s in got] == [(a, k, b) for a, _, k, b in sorted(want)]
