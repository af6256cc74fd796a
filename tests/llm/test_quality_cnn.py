import random
import zlib

import numpy as np
import pytest

from quillshard.llm import quality_cnn as q
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents, odd_rows, prose


def brute_score(net, text):
    """One document, one chunk, one window and one filter at a time."""
    pooled = []
    at = 0
    while True:
        chunk = list(text[at : at + q.CHUNK]) + [q.PAD] * (q.CHUNK - len(text[at : at + q.CHUNK]))
        best = np.zeros(q.FILTERS)
        for start in range(0, q.CHUNK - q.WIDTH + 1, q.STEP):
            window = np.concatenate([net.embed[b] for b in chunk[start : start + q.WIDTH]])
            best = np.maximum(best, window @ net.filters + net.bias)
        pooled.append(best)
        if at + q.CHUNK >= len(text):
            break
        at += q.CHUNK_STEP
    features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    return 1 / (1 + np.exp(-(features @ net.head + net.offset)))


def test_scores_equal_brute_force():
    rng = random.Random(1)
    net = q.Network.fresh(3)
    net.bias += np.linspace(-1, 1, q.FILTERS, dtype=np.float32)
    texts = [b"", b"x", b"y" * 512, b"z" * 513, prose(rng, 700).encode(), bytes(rng.randrange(256) for _ in range(3000))]
    assert q.score_texts(net, texts) == pytest.approx([brute_score(net, t) for t in texts], abs=1e-4)
    assert q.score_texts(net, texts[4:5])[0] == pytest.approx(q.score_texts(net, texts)[4], abs=1e-5)


def test_chunks_cover_every_byte_and_overlap():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(i % 251 for i in range(n))
        cut = q.chunks_of(data)
        joined = bytearray()
        for c in cut:
            joined = joined[: len(joined) - (q.CHUNK - q.CHUNK_STEP)] if joined else joined
            joined += bytes(x for x in c.tolist() if x != q.PAD)
        assert bytes(joined) == data and len(cut) == 1 + max(0, -(-(n - q.CHUNK) // q.CHUNK_STEP))


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    net = q.Network.fresh(4)
    for name in ("embed", "filters", "bias", "head"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    chunks = rng.integers(0, 256, (7, q.CHUNK)).astype(np.int16)
    starts, labels = np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    _, d = q.gradients(net, chunks, starts, labels)
    for name, at in (("embed", (int(chunks[0, 8]), 3)), ("filters", (17, 5)), ("bias", (2,)), ("head", (1,)), ("head", (q.FILTERS + 4,))):
        value, step = getattr(net, name), 1e-5
        losses = []
        for sign in (1, -1):
            value[at] += sign * step
            losses.append(q.gradients(net, chunks, starts, labels)[0])
            value[at] -= sign * step
        assert d[name][at] == pytest.approx((losses[0] - losses[1]) / (2 * step), abs=2e-5, rel=2e-2)


def labelled(spark, n=240):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(f"{w}###" for w in prose(rng, 60).upper().split()), "en", "s", 1) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id bigint, quality int, toxic int")
    return documents(spark, rows), labels


def test_learns_and_never_reads_held_out_labels(spark):
    docs, labels = labelled(spark)
    model = q.learn(docs, labels)
    got = {r["doc_id"]: r for r in q.score_documents(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == int(i % 3 > 0) for i, r in got.items())
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality", "toxic")
    again = {r["doc_id"]: r["score"] for r in q.score_documents(docs, q.learn(docs, turned)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_learns_from_the_middle_of_long_texts():
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(60):
        words = prose(rng, 3000).split()
        # one mark, somewhere in the text, is all that tells the classes apart
        at = rng.randrange(300, 2700)
        words[at : at + 20] = ["##%%##%%##%%##"] * 20 if i % 2 else words[at : at + 20]
        texts.append(" ".join(words).encode())
        labels.append(1 - i % 2)
    net = q.train(texts[:40], np.array(labels[:40], np.float32))
    assert ((q.score_texts(net, texts[40:]) >= 0.5).astype(int) == labels[40:]).mean() >= 0.9


def test_odd_rows_and_constant_models(spark):
    docs = documents(spark, odd_rows(6))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in q.score_documents(docs, q.learn(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1), (3, 0)], "doc_id bigint, quality int")
    assert q.learn(docs, odd) == pytest.approx(2 / 3) or zlib.crc32(b"3") % 5 == 0
    rows = q.score_documents(docs, q.Network.fresh()).collect()
    assert len(rows) == len(odd_rows(6)) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert q.score_documents(documents(spark, []), q.Network.fresh()).count() == 0


def test_registered_query(spark):
    out = q.op1_byte_cnn(spark, SF_SMALL)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
