"""Sizes that are awkward for the operators: hard lengths, texts heavier than a shard, very long texts."""

import random
import zlib

import numpy as np
import pytest

from lumen3d.llm import packing
from lumen3d.llm.line_dedup import dedup_lines
from lumen3d.llm.near_dedup import near_duplicates
from lumen3d.llm.sharding import shard_documents
from lumen3d.llm.substring_dedup import remove_recurring


def packed(spark, monkeypatch, lengths, rows_per_part):
    pieces = [(i, 0, 0, int(n), zlib.crc32(str(i).encode())) for i, n in enumerate(lengths)]
    monkeypatch.setattr(packing, "tokenised", lambda *_: spark.createDataFrame(pieces, packing.PIECES))
    docs = spark.createDataFrame([], "doc_id long, text string")
    rows = packing.pack_documents(docs, "", capacity=1000, rows_per_part=rows_per_part).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1000
    return len(bins)


@pytest.mark.parametrize("low, high, slack", [(501, 1000, 1.0), (1, 1000, 1.03), (200, 450, 1.1), (334, 500, 1.1), (251, 333, 1.1)])
def test_packing_of_hard_lengths(spark, monkeypatch, low, high, slack):
    """Within a tenth of the bound of all pieces, well under the 11 / 9 that best fit decreasing guarantees without partitions."""
    lengths = np.random.default_rng(low).integers(low, high + 1, 900)
    bound = packing.bin_bound(lengths, 1000)
    assert bound <= packed(spark, monkeypatch, lengths, 300) <= bound * slack + 2


def test_packing_partitions_do_not_grow(spark, monkeypatch):
    """Lengths whose bounds never certify: rounds stop instead of gathering what is left."""
    seen = []
    whole = packing.packer

    def watched(turn, last, capacity):
        seen.append((turn, last))
        return whole(turn, last, capacity)

    monkeypatch.setattr(packing, "packer", watched)
    monkeypatch.setattr(packing, "bin_bound", lambda lengths, capacity: 0)
    lengths = np.random.default_rng(1).integers(300, 400, 400)
    assert packed(spark, monkeypatch, lengths, 40) <= 400
    assert len(seen) == 2 and seen[-1] == (1, True)


def shards_of(spark, rows, n):
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=n, rows_per_run=50).collect()
    sizes, slots = [0] * n, {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, sizes


def test_a_text_heavier_than_a_shard(spark):
    rng = random.Random(1)
    rows = [(0, "x" * 100_000)] + [(i, "w" * rng.randrange(200)) for i in range(1, 800)]
    got, sizes = shards_of(spark, rows, 4)
    home = next(r["shard"] for r in got if r["doc_id"] == 0)
    others = [s for i, s in enumerate(sizes) if i != home]
    assert sizes[home] == 100_008 and max(others) - min(others) < 3 * 208


def test_copies_heavier_than_a_shard(spark):
    rng = random.Random(2)
    rows = [(i, "the same hot text") for i in range(2000)] + [(5000 + i, "w" * rng.randrange(60)) for i in range(300)]
    _, sizes = shards_of(spark, rows, 4)
    assert max(sizes) - min(sizes) < 0.06 * sum(sizes) / 4


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**7)}" for _ in range(24_000)]
    near = list(words)
    for k in rng.sample(range(24_000), 400):
        near[k] = f"e{rng.randrange(10**7)}"
    blob = "Q" * 300_000
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, blob), (4, blob + " tail"), (5, "\n".join(words[:12_000]) + "\n" + "\n".join(words[:12_000]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    links = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame).collect()}
    assert links[2] == (links[2][0], 1) and links[1] == (23_996, 1) and links[3] == (1, 3) and links[4] == (1, 4) and links[5][1] == 5
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_recurring(frame).collect()}
    assert cut[5] == (24_000, 24_000) and cut[3] == (1, 0) and cut[4] == (2, 0)
    same = np.array([a == b for a, b in zip(words, near, strict=True)])
    runs = [k for k in range(24_000 - 34) if same[k : k + 35].all()]
    covered = np.zeros(24_000, bool)
    for k in runs:
        covered[k : k + 35] = True
    assert cut[2] == (24_000, int(covered.sum()))
    lines = {r["doc_id"]: (r["n_lines"], r["n_removed_lines"]) for r in dedup_lines(frame).collect()}
    assert lines == {1: (1, 0), 2: (1, 1), 3: (1, 0), 4: (1, 0), 5: (24_000, 24_000 - len(set(words[:12_000])))}
