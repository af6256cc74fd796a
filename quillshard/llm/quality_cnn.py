"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - CHUNK_STEP`` and cover all of
it. Bytes are embedded, ``FILTERS`` learned filters of ``WIDTH`` bytes slide over each chunk by ``STEP`` bytes, and
each filter keeps its largest response in the chunk (max-pooling). The mean and the maximum of the chunk responses
over the document go through one logistic unit to the probability of label 1.

Training is on the driver, over a sample bounded by ``TRAIN_DOCS`` labelled documents (chosen by a hash of the
id), each with its whole text; labels of held-out documents are never read. Scoring is one scan of whole texts without a shuffle; the model is a few kilobytes.

Null and empty texts are one chunk of padding and get the score of that. Rows without an id are scored and not held
out. A document that is labelled twice counts once with its larger label; labels other than 0 and 1 are not used. With no
labelled rows of both classes every score is the smoothed share of label 1. Repeated rows get equal scores, an empty
table an empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshard.llm.common import table, text_batches

CHUNK, CHUNK_STEP = 512, 448
WIDTH, STEP = 16, 8
EMBED, FILTERS = 8, 64
PAD = 256
TRAIN_DOCS = 12_000
EPOCHS, BATCH_DOCS, RATE = 5, 32, 4e-3
DECAY = 0.02
# A small sample is gone over more often, until this many batches have been seen.
LEAST_STEPS = 1000
FOLDS = 5
THRESHOLD = 0.3
SEED = 11
# Chunks that are worked on at a time, forwards and backwards.
AT_ONCE, BACK_AT_ONCE = 1024, 256


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float

    @staticmethod
    def fresh(seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32)
        embed[PAD] = 0
        filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        head = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        return Network(embed, filters, np.zeros(FILTERS, np.float32), head, 0.0)

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and the position where it is."""
        blocks = self.embed[chunks].reshape(len(chunks), CHUNK // STEP, STEP * EMBED)
        half = STEP * EMBED
        r = blocks[:, :-1] @ self.filters[:half] + blocks[:, 1:] @ self.filters[half:]
        at = r.argmax(axis=1)
        best = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + self.bias
        return np.maximum(best, 0), at

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for any number of chunks, some at a time."""
        found = [self.responses(chunks[at : at + AT_ONCE]) for at in range(0, len(chunks), AT_ONCE)]
        return np.concatenate([r for r, _ in found]), np.concatenate([at for _, at in found])

    def logits(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Logits of documents from the mean and the largest of their chunks' responses."""
        return np.concatenate([mean, top], axis=1) @ self.head + self.offset


def n_chunks(text: bytes) -> int:
    return max(1, -(-max(0, len(text) - CHUNK) // CHUNK_STEP) + 1)


def chunks_of(text: bytes, first: int = 0, most: int | None = None) -> np.ndarray:
    """The chunks of a text, or some of them; the last one is padded, an empty text is one chunk of padding."""
    n = min(n_chunks(text) - first, n_chunks(text) if most is None else most)
    padded = np.full((n - 1) * CHUNK_STEP + CHUNK, PAD, np.int16)
    own = text[first * CHUNK_STEP : first * CHUNK_STEP + len(padded)]
    padded[: len(own)] = np.frombuffer(own, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::CHUNK_STEP]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities. Chunks are cut and reduced to a sum and a maximum for each document some at a time, so beside the texts memory does not grow with their length."""
    if not texts:
        return np.empty(0)
    sums, tops = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS), np.float32)
    held, owners, waiting = [], [], 0

    def reduce() -> None:
        pooled, _ = net.responses(np.concatenate(held))
        starts = np.flatnonzero(np.concatenate(([True], np.diff(np.repeat(*np.array(owners).T)) != 0)))
        own = np.repeat(*np.array(owners).T)[starts]
        sums[own] += np.add.reduceat(pooled, starts, axis=0)
        # responses are not below zero
        tops[own] = np.maximum(tops[own], np.maximum.reduceat(pooled, starts, axis=0))

    for row, text in enumerate(texts):
        for first in range(0, n_chunks(text), AT_ONCE):
            held.append(chunks_of(text, first, AT_ONCE))
            owners.append((row, len(held[-1])))
            waiting += len(held[-1])
            if waiting >= AT_ONCE:
                reduce()
                held, owners, waiting = [], [], 0
    if held:
        reduce()
    counts = np.array([n_chunks(t) for t in texts])[:, None]
    return sigmoid(net.logits((sums / counts).astype(np.float32), tops).astype(np.float64))


def gradients(net: Network, chunks: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of a batch and its gradients; through the pools only the largest responses count."""
    pooled, at = net.pooled(chunks)
    counts = np.diff(np.append(starts, len(chunks)))
    owner = np.repeat(np.arange(len(starts)), counts)
    mean = np.add.reduceat(pooled, starts, axis=0) / counts[:, None]
    top = np.maximum.reduceat(pooled, starts, axis=0)
    features = np.concatenate([mean, top], axis=1)
    p = sigmoid(features @ net.head + net.offset)
    loss = -float(np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-12)))
    d_logit = ((p - labels) / len(labels)).astype(np.float32)
    d_mean, d_top = np.outer(d_logit, net.head[:FILTERS]), np.outer(d_logit, net.head[FILTERS:])
    is_top = pooled == top[owner]
    ties = np.maximum(np.add.reduceat(is_top, starts, axis=0, dtype=np.float32), 1)
    d_pool = (d_mean / counts[:, None])[owner] + is_top * (d_top / ties)[owner]
    d_pool = (d_pool * (pooled > 0)).astype(np.float32)
    d_filters, d_embed = np.zeros(net.filters.shape), np.zeros((PAD + 1, EMBED))
    for some in (slice(start, start + BACK_AT_ONCE) for start in range(0, len(chunks), BACK_AT_ONCE)):
        bytes_at = np.take_along_axis(chunks[some, None, :], (at[some] * STEP)[:, :, None] + np.arange(WIDTH), axis=2)
        windows = net.embed[bytes_at].reshape(len(bytes_at), FILTERS, WIDTH * EMBED)
        d_filters += np.einsum("nf,nfw->wf", d_pool[some], windows, optimize=True)
        d_windows = (d_pool[some][:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
        flat = bytes_at.ravel()
        d_embed += np.stack([np.bincount(flat, d_windows[:, e], PAD + 1) for e in range(EMBED)], axis=1)
    d_filters, d_embed = d_filters.astype(np.float32), d_embed.astype(np.float32)
    d_embed[PAD] = 0
    return loss, {
        "embed": d_embed, "filters": d_filters, "bias": d_pool.sum(axis=0),
        "head": features.T @ d_logit, "offset": d_logit.sum(),
    }


def train(documents: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over batches of documents, each cut into all its chunks."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(documents) // BATCH_DOCS)))
    names = ("embed", "filters", "bias", "head", "offset")
    first, second = ({n: np.zeros_like(np.asarray(getattr(net, n), np.float32)) for n in names} for _ in range(2))
    steps, total = 0, epochs * -(-len(documents) // BATCH_DOCS)
    for _ in range(epochs):
        order = rng.permutation(len(documents))
        for at in range(0, len(order), BATCH_DOCS):
            batch = [chunks_of(documents[i]) for i in order[at : at + BATCH_DOCS]]
            starts = np.cumsum([0] + [len(d) for d in batch[:-1]])
            _, d = gradients(net, np.concatenate(batch), starts, labels[order[at : at + BATCH_DOCS]])
            steps += 1
            rate = RATE * (1 - 0.9 * steps / total)
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * d[n]
                second[n] = 0.99 * second[n] + 0.01 * np.square(d[n])
                move = rate * (first[n] / (1 - 0.9**steps)) / (np.sqrt(second[n] / (1 - 0.99**steps)) + 1e-6)
                if n in ("filters", "head"):
                    move = move + rate * DECAY * getattr(net, n)
                setattr(net, n, (getattr(net, n) - move).astype(np.float32) if n != "offset" else float(net.offset - move))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS) -> Network | float:
    """A network from at most ``most`` labelled documents outside the held-out fold, or a constant."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("raw"))
    sample = rows.join(F.broadcast(chosen), "doc_id")
    # one text per id, so that repeated ids cannot outgrow the bound
    found = sample.groupBy("doc_id").agg(F.min(F.struct("tie", "label", "raw")).alias("s")).select("doc_id", "s.label", "s.raw").collect()
    found.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in found], np.float32)
    if len(set(y.tolist())) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    return train([bytes(r["raw"] or b"") for r in found], y)


def _scorer(model: Network | float):
    def score(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("raw").to_pylist()]
            p = np.full(len(texts), model) if isinstance(model, float) else score_texts(model, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return score


def score_documents(docs: DataFrame, model: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row."""
    text_batches(docs.sparkSession)
    raw = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    scored = raw.mapInArrow(_scorer(model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
