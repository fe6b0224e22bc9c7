"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sampling import fold, hash_sample, texts_of
from .textvec import blocks

#: Bytes of a block; a window is two blocks, and windows start at each block.
BLOCK = 4
#: Windows of a half chunk; a chunk is two half chunks, and chunks overlap by one.
HALF = 32
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Half chunks of a text that are held embedded at once: longer texts are scored in pieces.
PIECE = 1 << 12
#: A byte is embedded with a flag: whether the four bytes from it on stand as many bytes earlier, too.
LAGS = range(2, 21)


@dataclass
class Network:
    embed: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return list(vars(self).values())


def _new(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    wide = BLOCK * EMBED
    zeros = lambda n: np.zeros(n, np.float32)
    return Network(draw(512, EMBED, scale=0.5), draw(wide, FILTERS, scale=0.25), draw(wide, FILTERS, scale=0.25), zeros(FILTERS), draw(FILTERS, HIDDEN, scale=0.3), zeros(HIDDEN), draw(2 * HIDDEN, scale=0.3), zeros(1))


def _layout(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each text filled up with zero bytes to whole half chunks (one at least), and half chunks before each text."""
    length = np.diff(offs)
    halves = np.maximum(1, -(-length // (BLOCK * HALF)))
    at = np.concatenate(([0], np.cumsum(halves)))
    padded = np.zeros(int(at[-1]) * BLOCK * HALF + 3, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(at[:-1] * BLOCK * HALF - offs[:-1], length)] = raw
    four = padded[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        four |= padded[k : len(padded) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    again = np.zeros(len(four), bool)
    for lag in LAGS:
        again[lag:] |= four[lag:] == four[:-lag]
    starts = at[:-1] * BLOCK * HALF
    again[(starts[:, None] + np.arange(LAGS[-1])).ravel()] = False
    again[((at[1:] * BLOCK * HALF)[:, None] - np.arange(1, 4)).ravel()] = False
    padded = padded[:-3]
    return padded + np.uint16(256) * (again & (padded > 0)), at


def _pooled(net: Network, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedded blocks, filter outputs of each window, and their largest in each half chunk."""
    blocks_ = net.embed[padded].reshape(-1, BLOCK * EMBED)
    right = blocks_ @ net.second
    value = blocks_ @ net.first + net.bias
    value[:-1] += right[1:]
    last = at[1:] * HALF - 1
    value[last[:-1]] -= right[last[:-1] + 1]
    value[last] += np.tile(net.embed[0], BLOCK) @ net.second
    return blocks_, value, value.reshape(-1, HALF, FILTERS).max(1)


def _chunks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second half of each chunk, and chunks before each text; a text of one half is one chunk."""
    halves = np.diff(at)
    count = np.maximum(1, halves - 1)
    before = np.concatenate(([0], np.cumsum(count)))
    first = np.arange(before[-1]) + np.repeat(at[:-1] - before[:-1], count)
    return first, np.minimum(first + 1, np.repeat(at[1:] - 1, count)), before


def _forward(net: Network, padded: np.ndarray, at: np.ndarray) -> tuple:
    blocks_, value, top = _pooled(net, padded, at)
    first, second, before = _chunks(at)
    chunk = np.maximum(np.maximum(top[first], top[second]), 0)
    hidden = np.maximum(chunk @ net.hidden + net.hidden_bias, 0)
    most = np.maximum.reduceat(hidden, before[:-1])
    mean = np.add.reduceat(hidden, before[:-1]) / np.diff(before)[:, None]
    both = np.concatenate([most, mean], axis=1)
    return both @ net.out + net.out_bias, both, most, hidden, chunk, top, value, blocks_, first, second, before


def _gradients(net: Network, padded: np.ndarray, at: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    logit, both, most, hidden, chunk, top, value, blocks_, first, second, before = _forward(net, padded, at)
    d = ((1 / (1 + np.exp(-logit)) - wanted) * weight / len(wanted)).astype(np.float32)
    d_both = d[:, None] * net.out
    count = np.diff(before)
    d_hidden = np.repeat(d_both[:, HIDDEN:] / count[:, None], count, axis=0)
    is_most = hidden == np.repeat(most, count, axis=0)
    ties = np.add.reduceat(is_most, before[:-1], dtype=np.float32)
    d_hidden += is_most * np.repeat(d_both[:, :HIDDEN] / ties, count, axis=0)
    d_hidden *= hidden > 0
    d_chunk = (d_hidden @ net.hidden.T) * (chunk > 0)
    left = top[first] >= top[second]
    d_top = np.zeros_like(top)
    np.add.at(d_top, first, d_chunk * left)
    np.add.at(d_top, second, d_chunk * ~left)
    where = value.reshape(-1, HALF, FILTERS).argmax(1) + np.arange(len(top))[:, None] * HALF
    d_value = np.zeros_like(value)
    np.put_along_axis(d_value, where, d_top, axis=0) if len(top) == 1 else d_value.__setitem__((where, np.arange(FILTERS)), d_top)
    used = np.flatnonzero(d_value.any(1))
    g = d_value[used]
    inner = ~np.isin(used, at[1:] * HALF - 1)
    follows = np.where(inner, used + 1, 0)
    d_first, d_second = blocks_[used].T @ g, (blocks_[follows] * inner[:, None]).T @ g
    bytes_ = padded.reshape(-1, BLOCK)
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, bytes_[used].ravel(), (g @ net.first.T).reshape(-1, EMBED))
    np.add.at(d_embed, bytes_[follows[inner]].ravel(), (g[inner] @ net.second.T).reshape(-1, EMBED))
    return [d_embed, d_first, d_second, g.sum(0), chunk.T @ d_hidden, d_hidden.sum(0), both.T @ d, d.sum(keepdims=True)]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def fit_network(texts: list[bytes], wanted: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.006, seed: int = 5) -> Network:
    """Adam on the logistic loss, both classes with half of the weight; the same rows give the same network."""
    net, rng = _new(seed), np.random.default_rng(seed)
    share = min(max(float(wanted.mean()), 0.02), 0.98) if len(wanted) else 0.5
    weight = np.where(wanted > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    m, v, step = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    steps = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            grads = _gradients(net, *_layout(*_joined([texts[i] for i in pick])), wanted[pick], weight[pick])
            step += 1
            now = rate * (1 - step / (steps + 1))
            for w, g, a, b in zip(net.weights(), grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return net


def _score_in_pieces(net: Network, raw: np.ndarray) -> float:
    """The logit of one text, of which a piece of PIECE half chunks is embedded at once, with a half chunk before and after it."""
    unit, last, most, total = BLOCK * HALF, None, np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN)
    halves = -(-len(raw) // unit)
    for a in range(0, halves, PIECE):
        b, lead = min(halves, a + PIECE), min(a, 1)
        part = raw[(a - lead) * unit : (b + 1) * unit]
        top = _pooled(net, *_layout(part, np.array([0, len(part)])))[2][lead : lead + b - a]
        top = top if last is None else np.concatenate([last, top])
        last = top[-1:]
        chunk = np.maximum(np.maximum(top[:-1], top[1:]), 0)
        hidden = np.maximum(chunk @ net.hidden + net.hidden_bias, 0)
        most, total = np.maximum(most, hidden.max(0, initial=0)), total + hidden.sum(0, dtype=np.float64)
    return float(np.concatenate([most, total / (halves - 1)]) @ net.out + net.out_bias[0])


def score(net: Network, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Scores of texts that lie one after the other; memory for a text alone does not grow with its length."""
    long = len(offs) == 2 and len(raw) > PIECE * BLOCK * HALF
    logit = np.array([_score_in_pieces(net, raw)]) if long else _forward(net, *_layout(raw, offs))[0].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_chars: int = 30_000) -> Network:
    """Network fitted to labels.quality of rows whose crc32(doc_id as text) mod 3 is not 1.

    Fits on at most max_rows labelled documents of at most max_chars characters, chosen by hash: all that the driver
    holds. Null labels, null texts and ids without a document teach nothing; without any row the network is untrained.
    """
    marked = labels.where("quality is not null and doc_id is not null").where(fold(F.col("doc_id"), 3) != 1).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    chosen = hash_sample(marked, "doc_id", max_rows)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    table = texts_of(rows, max_chars)
    return fit_network([t.encode() for t in table["text"].to_pylist()], (table["quality"].to_numpy() > 0).astype(np.float32))


def quality_scores(docs: DataFrame, net: Network) -> DataFrame:
    """docs with score (0 to 1, higher: quality 1 likelier), for each row and over its whole text.

    A null or empty text scores as one chunk of zero bytes. Columns named score are replaced. Needs no shuffle.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(net)
    keep = [c for c in docs.columns if c.lower() != "score"]
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.zeros(b.num_rows)
            for first, raw, offs in blocks(b.column("text")):
                scores[first : first + len(offs) - 1] = score(model.value, raw, offs)
            yield b.append_column("score", pa.array(scores))

    return docs.select(*keep).mapInArrow(run, schema)
