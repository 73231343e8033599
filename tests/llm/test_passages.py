"""Passages whose words are hard to tell apart."""

import numpy as np
import pyarrow as pa
import pytest

from lumen3d.llm import substring_dedup
from lumen3d.llm.substring_dedup import remove_recurring
from lumen3d.llm.words import _ODD, Words, mixed


def cut(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["n_removed"] for r in remove_recurring(rows).orderBy("doc_id").collect()]


def plainly(texts, width=35):
    places: dict[tuple, int] = {}
    split = [t.split() for t in texts]
    for words in split:
        for i in range(len(words) - width + 1):
            places[tuple(words[i : i + width])] = places.get(tuple(words[i : i + width]), 0) + 1
    gone = [{j for i in range(len(w) - width + 1) if places[tuple(w[i : i + width])] > 1 for j in range(i, i + width)} for w in split]
    return [len(g) for g in gone]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_of_the_same_letters_are_told_apart_in_many_shards(spark, monkeypatch, seed):
    """A window that several shards' automata seemed to hold was counted in each, and removed though it is there once."""
    monkeypatch.setattr(substring_dedup, "PHRASES_PER_SHARD", 5)
    words = [f"w{i}" for i in range(6000)]
    words = np.array(words)[(Words(pa.array([" ".join(words)]), lower=False).hashes & 255) == 7]
    draw = np.random.default_rng(seed)
    short = [draw.choice(words, 25) for _ in range(12)]  # less than a window, and there more than once
    texts = [" ".join(np.concatenate([x for s in draw.integers(0, 12, 4) for x in (short[s], draw.choice(words, 6))])) for _ in range(20)]
    assert cut(spark, [*texts, texts[0] + " end"]) == plainly([*texts, texts[0] + " end"])


def test_words_of_the_same_hash_are_told_apart(spark):
    """Both parts of a window's hash came from the same 64 bits of its words."""
    starts = np.random.default_rng(0).integers(97, 123, (30000, 8), np.uint8)
    first = mixed(starts.view("<u8").ravel() * _ODD[0] + np.uint64(16))
    low = first & np.uint64(0xE0E0E0E0E0E0E0E0)  # where these agree, the bytes differ in five bits that keep a letter printable
    order = np.argsort(low)
    at = np.flatnonzero(low[order][1:] == low[order][:-1])[0]
    i, j = order[at], order[at + 1]
    flip = int(first[i] ^ first[j]).to_bytes(8, "little")
    one = starts[i].tobytes() + b"@" * 8
    two = starts[j].tobytes() + bytes(64 ^ x for x in flip)
    assert one != two and len(set(Words(pa.array([f"{one.decode()} {two.decode()}"]), lower=False).hashes.tolist())) == 1
    text = [f"w{k}" for k in range(40)]
    texts = [" ".join([*text[:20], w.decode(), *text[20:]]) for w in (one, two)]
    assert cut(spark, texts) == [0, 0]
