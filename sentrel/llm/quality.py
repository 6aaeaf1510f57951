"""A byte-level convolutional quality classifier in numpy.

Filters of ``WIDTH`` bytes (a learned weight for each byte value at each place) slide over the whole text byte by byte. Their
responses are max-pooled in chunks of two blocks of ``BLOCK`` bytes that overlap by one block and cover the document; the chunks'
values are combined by their mean, maximum and minimum (a chunk in which few filters respond tells of repetition), and a logistic layer gives one probability.

It is fitted on the driver on a bounded sample of labelled rows: ``PER_CLASS`` ids of each label, those with the smallest hash, and the whole
text of each. Defined cases: null and empty texts are scored as one block of padding; a text's score doesn't depend on its neighbours;
with labels of fewer than two kinds the score is the known label's (else 0.5); null labels are unused; of contradicting labels of one
id the smaller counts; of several rows with a labelled id the smallest text counts; a column named as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sentrel.llm.common import batches

WIDTH, BLOCK, FILTERS = 8, 64, 24
#: The bound of the training sample, in rows of each label; and the bytes of text that one step learns from (one text at least).
PER_CLASS, STEP_BYTES = 1000, 1 << 21
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.01, 7


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each padded to whole blocks with room for what the last filter reads; and each text's blocks.

    Padding is byte 0 (which a text may hold too; it is one more byte value).
    """
    count = np.array([max(1, -(-(len(t) + WIDTH - 1) // BLOCK)) for t in texts], np.int64)
    flat = np.zeros(int(count.sum()) * BLOCK + WIDTH, np.uint8)
    at = 0
    for t, n in zip(texts, count, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * BLOCK
    return flat, count


class ByteCnn:
    def __init__(self, rng: np.random.Generator | None = None) -> None:
        rng = rng or np.random.default_rng(SEED)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = rng.normal(0, 0.3, 3 * FILTERS).astype(np.float32)
        self.out = np.zeros(1, np.float32)
        self.constant: float | None = None

    def blocks(self, flat: np.ndarray, count: np.ndarray, places: bool = False):
        """Max-pooled responses of each block, and where they are if asked for. Places at a text's end whose filters would reach into the next text
        are left out; they hold padding only."""
        n, last = (len(flat) - WIDTH) // BLOCK, np.cumsum(count) - 1
        pooled, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if places else None
        step = 512  # blocks at a time, to stay in the cache
        for i in range(0, n, step):
            m = min(step, n - i)
            at = flat[i * BLOCK : (i + m) * BLOCK + WIDTH]
            got = self.table[0][at[: m * BLOCK]]
            for k in range(1, WIDTH):
                got += self.table[k][at[k : k + m * BLOCK]]
            got = got.reshape(m, BLOCK, FILTERS)
            ends = last[np.searchsorted(last, i) : np.searchsorted(last, i + m)] - i
            got[ends, BLOCK - WIDTH + 1 :] = -np.inf
            pooled[i : i + m] = got.max(1)
            if places:
                where[i : i + m] = got.argmax(1) + (np.arange(i, i + m) * BLOCK)[:, None]
        return np.maximum(pooled + self.bias, 0), where

    @staticmethod
    def combine(pooled: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks (each block with the next one of its text; a last block alone only if it is the only one), and each text's mean, maximum and minimum of them."""
        start = np.cumsum(count) - count
        last = np.zeros(len(pooled), bool)
        last[start + count - 1] = True
        after = np.concatenate([pooled[1:], pooled[-1:]])
        before = np.concatenate([pooled[:1], pooled[:-1]])
        only = np.repeat(count == 1, count)
        chunks = np.where(only[:, None], pooled, np.maximum(pooled, np.where(last[:, None], before, after)))
        both = [np.add.reduceat(chunks, start, axis=0) / count[:, None], np.maximum.reduceat(chunks, start, axis=0), np.minimum.reduceat(chunks, start, axis=0)]
        return chunks, np.concatenate(both, 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        flat, count = laid_out(texts)
        values = self.combine(self.blocks(flat, count)[0], count)[1]
        # Row by row, so that a score doesn't depend on the batch.
        return 1 / (1 + np.exp(-((values.astype(np.float64) * self.weight).sum(1) + self.out[0])))

    def fit(self, texts: list[bytes], label: np.ndarray) -> ByteCnn:
        """Adam on the logistic loss; both labels weigh as often as they occur in the sample."""
        if len(set(label.tolist())) < 2:
            self.constant = float(label[0]) if len(label) else 0.5
            return self
        rng = np.random.default_rng(SEED)
        params = [self.table, self.bias, self.weight, self.out]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            for some in self.steps(rng.permutation(len(texts)), texts):
                grads = self.gradients([texts[j] for j in some], label[some])
                t += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    @staticmethod
    def steps(order: np.ndarray, texts: list[bytes]) -> Iterator[np.ndarray]:
        """``BATCH`` texts each, fewer where they are long."""
        held: list[int] = []
        for j in order.tolist():
            if held and (len(held) == BATCH or sum(len(texts[i]) for i in held) + len(texts[j]) > STEP_BYTES):
                yield np.array(held)
                held = []
            held.append(j)
        if held:
            yield np.array(held)

    def gradients(self, texts: list[bytes], label: np.ndarray) -> list[np.ndarray]:
        flat, count = laid_out(texts)
        pooled, where = self.blocks(flat, count, places=True)
        chunks, values = self.combine(pooled, count)
        error = (1 / (1 + np.exp(-(values @ self.weight + self.out[0]))) - label).astype(np.float32) / len(texts)
        text, start = np.repeat(np.arange(len(texts)), count), np.cumsum(count) - count
        weights = self.weight.reshape(3, FILTERS)
        d_chunk = (error / count)[text][:, None] * weights[0]
        for k in (1, 2):  # the maximum and the minimum; chunks that share it share the gradient
            leads = chunks == values[text, k * FILTERS : (k + 1) * FILTERS]
            d_chunk = d_chunk + np.where(leads, error[text][:, None] * weights[k], 0) / np.add.reduceat(leads.astype(np.float32), start, axis=0)[text]
        # A chunk's value is that of its own block or else of its neighbour: the next block, or for a text's last block the one before.
        d_block, other = np.where(chunks == pooled, d_chunk, 0), np.where(chunks != pooled, d_chunk, 0)
        last = np.zeros(len(pooled), bool)
        last[start + count - 1] = True
        d_block[1:] += np.where(last[:-1, None], 0, other[:-1])
        d_block[:-1] += np.where(last[1:, None], other[1:], 0)
        d_block *= pooled > 0
        d_table = np.zeros_like(self.table)
        block, kind = np.nonzero(d_block)
        for k in range(WIDTH):
            d_table[k] = np.bincount(flat[where[block, kind] + k].astype(np.int64) * FILTERS + kind, d_block[block, kind], 256 * FILTERS).reshape(256, FILTERS)
        return [d_table, d_block.sum(0), (error[:, None] * values).sum(0), error.sum(keepdims=True)]


def remainder(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> ByteCnn:
    """The classifier, from labelled rows that are not held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", 5) != 0)).groupBy("doc_id").agg(F.min(label).alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("label = 0").orderBy(*order).limit(per_class).unionAll(usable.where("label = 1").orderBy(*order).limit(per_class))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by the sample
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (str(r["doc_id"]), r["text"]))
    return ByteCnn().fit([r["text"].encode() for r in rows], np.array([r["label"] for r in rows], np.float32))


def score(docs: DataFrame, model: ByteCnn, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name) if name != text else docs
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4 << 20):
            texts = [(t.as_py() or "").encode() for t in b.column(names.index(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(texts), pa.float64())], [*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
