"""A byte-level convolutional network for text quality, trained and applied with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumen3d.llm.common import whole_text
from lumen3d.llm.words import by_size

#: Bytes of a chunk, and of those that it shares with the next.
CHUNK, OVERLAP = 512, 32
EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 2, 32
#: Byte that fills chunks; it has an embedding as any other.
PAD = 0


@dataclass
class Network:
    """Byte embeddings, filters over WIDTH bytes at each STRIDE, and weights of a document's largest and mean chunk maxima."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        draw = np.random.default_rng(seed).normal
        return cls({
            "embed": draw(0, 0.5, (256, EMBED)).astype("f4"),
            "filters": draw(0, 1 / np.sqrt(EMBED * WIDTH), (WIDTH * EMBED, FILTERS)).astype("f4"),
            "bias": np.zeros(FILTERS, "f4"),
            "out": draw(0, 0.1, 2 * FILTERS).astype("f4"),
            "out_bias": np.zeros(1, "f4"),
        })


def chunks_of(text: bytes) -> np.ndarray:
    """All of the text in rows of CHUNK bytes, each sharing OVERLAP bytes with the one before; the last is filled up."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    data = np.full((n - 1) * step + CHUNK, PAD, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::step]


def windows_of(chunks: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """(chunks, places, WIDTH * EMBED): what the filters see at each place."""
    embedded = w["embed"][chunks].reshape(len(chunks), CHUNK * EMBED)
    seen = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)
    return seen[:, :: STRIDE * EMBED]


def chunk_maxima(chunks: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """The largest response of each filter in each chunk."""
    seen = windows_of(chunks, w)
    n, places, width = seen.shape
    answers = (np.ascontiguousarray(seen).reshape(n * places, width) @ w["filters"]).reshape(n, places, FILTERS)
    return np.tanh(answers.max(axis=1) + w["bias"])


def combined(maxima: np.ndarray, firsts: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Probabilities of documents whose chunks begin at firsts."""
    counts = np.diff(np.append(firsts, len(maxima)))[:, None]
    features = np.hstack([np.maximum.reduceat(maxima, firsts), np.add.reduceat(maxima, firsts) / counts])
    return 1 / (1 + np.exp(-np.clip(features @ w["out"] + w["out_bias"], -40, 40)))


def scores(texts: list[bytes], network: Network, chunks_at_once: int = 128) -> np.ndarray:
    """The probability of each whole text, some chunks at a time."""
    parts = [chunks_of(t) for t in texts]
    firsts = np.cumsum([0, *(len(p) for p in parts[:-1])])
    chunks = np.concatenate(parts)
    maxima = np.concatenate([chunk_maxima(chunks[i : i + chunks_at_once], network.weights) for i in range(0, len(chunks), chunks_at_once)])
    return combined(maxima, firsts, network.weights)


def gradients(chunks: np.ndarray, firsts: np.ndarray, labels: np.ndarray, w: dict[str, np.ndarray], chunks_at_once: int = 256) -> dict[str, np.ndarray]:
    """Of the mean cross entropy; each maximum sends its gradient to the place that gave it.

    Chunks are answered, and learned from, some at a time: a text may have any number of them.
    """
    n = len(chunks)
    at, top = np.empty((n, FILTERS), np.int64), np.empty((n, FILTERS), w["bias"].dtype)
    for i in range(0, n, chunks_at_once):
        seen = windows_of(chunks[i : i + chunks_at_once], w)
        some, places, width = seen.shape
        answers = (np.ascontiguousarray(seen).reshape(some * places, width) @ w["filters"]).reshape(some, places, FILTERS)
        at[i : i + some] = answers.argmax(axis=1)
        top[i : i + some] = np.tanh(answers.max(axis=1) + w["bias"])
    counts = np.diff(np.append(firsts, n))
    doc = np.repeat(np.arange(len(firsts)), counts)
    largest = np.maximum.reduceat(top, firsts)
    features = np.hstack([largest, np.add.reduceat(top, firsts) / counts[:, None]])
    p = 1 / (1 + np.exp(-np.clip(features @ w["out"] + w["out_bias"], -40, 40)))
    d = ((p - labels) / len(labels)).astype("f4")
    d_features = d[:, None] * w["out"][None]
    ties = top == largest[doc]
    d_top = d_features[doc, FILTERS:] / counts[doc][:, None] + ties / np.add.reduceat(ties, firsts, dtype=np.int64)[doc] * d_features[doc, :FILTERS]
    d_top = (d_top * (1 - top**2)).astype("f4")
    d_filters, d_embed = np.zeros_like(w["filters"]), np.zeros_like(w["embed"])
    for i in range(0, n, chunks_at_once):
        part = slice(i, i + chunks_at_once)
        some = len(chunks[part])
        bytes_at = chunks[part][np.arange(some)[:, None, None], at[part][:, :, None] * STRIDE + np.arange(WIDTH)]
        d_filters += np.einsum("nfw,nf->wf", w["embed"][bytes_at].reshape(some, FILTERS, WIDTH * EMBED), d_top[part])
        np.add.at(d_embed, bytes_at.ravel(), (d_top[part][:, :, None] * w["filters"].T[None]).reshape(-1, EMBED))
    return {"embed": d_embed, "filters": d_filters, "bias": d_top.sum(0), "out": (d[:, None] * features).sum(0), "out_bias": d.sum(keepdims=True)}


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0, epochs: int = 8, least_steps: int = 800, batch: int = 24, rate: float = 0.01) -> Network:
    """Adam over all chunks of the labelled texts, in a seeded order, for some epochs and least_steps at least."""
    network, rng = Network.fresh(seed), np.random.default_rng(seed)
    w = network.weights
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    parts, step = [chunks_of(t) for t in texts], 0
    per_epoch = max(1, -(-len(texts) // batch))
    epochs = max(epochs, -(-least_steps // per_epoch))
    steps = epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            own = [parts[i] for i in chosen]
            firsts = np.cumsum([0, *(len(p) for p in own[:-1])])
            step += 1
            for name, g in gradients(np.concatenate(own), firsts, labels[chosen], w).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                move = rate * (1 - step / (steps + 1)) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                w[name] = (w[name] - move).astype("f4")
    return network


def held_out(doc_id):
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 3000, seed: int = 0) -> Network:
    """A network fitted on at most sample_rows labelled rows, half of each class where there are as many, by a hash of the identifier.

    Identifiers whose CRC-32 leaves 2 by 4 are held out. Null identifiers and labels are left out; null texts
    count as empty; of rows that repeat an identifier, the least text is learned from. Without labelled rows the
    network is an untrained one.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out(F.col("id")))
    draw = F.xxhash64("id", F.lit(seed))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).dropDuplicates(["id"]).orderBy(draw, "id").limit(sample_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("body").alias("body"))
    rows = sorted((draw, i, bytes(body), label) for draw, i, body, label in found.select(draw, "id", F.col("body").cast("binary"), "label").collect())
    if not rows:
        return Network.fresh(seed)
    return train([r[2] for r in rows], np.array([r[3] for r in rows], "f4"), seed)


def score_quality(docs: DataFrame, network: Network, id_col: str | None = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """Each row's id and the network's score of its whole text (0 to 1; higher is better); with no id_col, all columns and the score.

    Null text counts as empty, and an empty text is scored as a chunk of padding. Every chunk of a text of any
    length takes part. Equal texts get equal scores. An empty table gives no rows. Other columns are ignored, or
    kept as they are where there is no id_col; a column that is called as the score is replaced.
    """
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(network.weights)
    kept = docs.drop(name) if id_col is None else docs.select(F.col(id_col).alias("doc_id"))
    body = whole_text(text_col).cast("binary")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(shared.value)
        for batch in by_size(batches, -1, 200_000):
            out = scores([x or b"" for x in batch.columns[-1].to_pylist()], model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out.astype("f8"))], names=[*batch.schema.names[:-1], name])

    given = docs.select(*[docs[c] for c in docs.columns if c != name], body.alias("\x00body")) if id_col is None else docs.select(F.col(id_col).alias("doc_id"), body.alias("\x00body"))
    return given.mapInArrow(apply, StructType([*kept.schema.fields, StructField(name, DoubleType())]))
