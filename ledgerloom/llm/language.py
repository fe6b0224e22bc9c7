"""Language ID by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sampling import fold, hash_sample, texts_of
from .textvec import BYTE, U, blocks, small

CELLS = 1 << 12
#: A decision is ambiguous if the runner-up's probability is over this share of the winner's.
AMBIGUOUS = 0.5


@dataclass
class Codes:
    names: list[str]
    words: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # cell x bit
    bias: np.ndarray


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """Up to 6 languages: every split into two groups once. More: random words whose smallest distance is the best of 200 tries."""
    if n <= 6:
        splits = np.arange(1 << max(0, n - 1))[: (1 << max(0, n - 1)) - 1 or 1]
        return np.stack([np.ones(len(splits), int), *[np.where(splits >> k & 1, 1, -1) for k in range(n - 1)]])[:n]
    rng, bits, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        words = rng.choice([-1, 1], (n, bits))
        apart = (bits - words @ words.T) / 2
        np.fill_diagonal(apart, bits)
        if apart.min() > most and (np.abs(words.sum(0)) < n).all():
            best, most = words, apart.min()
    return best


def _features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte 2-grams and 3-grams; A-Z count as a-z; n-grams stay within a text."""
    n = len(offs) - 1
    rows = np.repeat(np.arange(n), np.diff(offs))
    code = BYTE[raw]
    counts = np.zeros(n * CELLS)
    for k in (2, 3):
        size = max(0, len(raw) - k + 1)
        if size:
            h = code[:size].copy()
            for j in range(1, k):
                h = h * U(0x9E3779B97F4A7C15) + code[j : j + size]
            inside = rows[:size] == rows[k - 1 :]
            cell = (h >> U(52)).astype(np.int64)[inside]
            counts += np.bincount(rows[:size][inside] * CELLS + cell, minlength=n * CELLS)
    counts = counts.reshape(n, CELLS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def fit_codes(texts: pa.Array, langs: list[str], steps: int = 150, rate: float = 20.0, decay: float = 1e-5) -> Codes:
    """One logistic classifier per bit, all by the same gradient steps; languages weigh alike."""
    names = sorted(set(langs))
    words = codewords(max(1, len(names)))
    if not names:
        return Codes([], words, np.zeros((CELLS, words.shape[1]), np.float32), np.zeros(words.shape[1], np.float32))
    x = np.concatenate([_features(raw, offs) for _, raw, offs in blocks(texts)])
    index = {name: k for k, name in enumerate(names)}
    y = np.array([index[name] for name in langs])
    wanted = words[y].astype(np.float32)
    weight = (1 / np.bincount(y, minlength=len(names)))[y].astype(np.float32)
    weight /= weight.sum()
    w, bias = np.zeros((CELLS, words.shape[1]), np.float32), np.zeros(words.shape[1], np.float32)
    speed, speed_bias = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(steps):
        g = -wanted / (1 + np.exp(wanted * (x @ w + bias))) * weight[:, None]
        speed = 0.9 * speed - rate * 0.1 * (x.T @ g + decay * w)
        speed_bias = 0.9 * speed_bias - rate * 0.01 * g.sum(0)
        w, bias = w + speed, bias + speed_bias
    return Codes(names, words, w, bias)


def decode(codes: Codes, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding: the language whose codeword has the smallest summed logistic loss; its probability; ambiguity."""
    loss = np.logaddexp(0, -margins[:, None, :] * codes.words[None]).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    top = np.sort(p, axis=1)
    runner_up = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return best, top[:, -1], runner_up > AMBIGUOUS * top[:, -1]


def fit_language(docs: DataFrame, max_rows: int = 6000, max_chars: int = 30_000) -> Codes:
    """Codes learnt from text and lang of rows whose crc32(doc_id as text) mod 4 is not 2.

    At most max_rows rows of at most max_chars characters, chosen by hash, reach the driver. Null lang, text or doc_id teach nothing.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id"), 4) != 2)
    table = texts_of(hash_sample(rows.select(F.col("doc_id").cast("long"), "text", "lang"), "doc_id", max_rows), max_chars)
    return fit_codes(table["text"], table["lang"].to_pylist())


def languages(docs: DataFrame, codes: Codes) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row of docs (doc_id, text), over whole texts.

    und with score 0 if the text is null or has no letter, or nothing was learnt. Repeated rows come out as often as
    they go in; needs no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value
        for b in small(batches):  # a row of features takes as much room for a short text as for a long one
            best, sure, vague = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for first, raw, offs in blocks(b.column("text")):
                if c.names:
                    at = slice(first, first + len(offs) - 1)
                    best[at], sure[at], vague[at] = decode(c, _features(raw, offs) @ c.weights + c.bias)
            known = b.column("letters").to_numpy(zero_copy_only=False).astype(bool) & bool(c.names)
            names = pa.array([c.names[k] if ok else "und" for k, ok in zip(best, known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), names, pa.array(np.where(known, sure, 0.0)), pa.array(vague & known)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
