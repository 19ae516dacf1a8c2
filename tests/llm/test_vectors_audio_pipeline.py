import io
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import chroma, embedding_dedup
from lodestar.llm.components import components


def brute(rows):
    good = [i for i, (a, v, k) in enumerate(rows) if a is not None and k is not None and v and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, a in enumerate(good):
        for b in good[:p]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    up[find(a)] = find(b)
    least = {}
    for i, (a, _, _) in enumerate(rows):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return sorted((a, links[i], least[find(i)], a == least[find(i)]) for i, (a, _, _) in enumerate(rows) if a is not None)


@pytest.mark.parametrize(("cell", "block"), [(8192, 2048), (60, 16)])
def test_vectors_link_as_all_pairs_do(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 8))[r.integers(0, 40, 250)] + 0.06 * r.normal(size=(250, 8))
    rows = [(i * 3 + 1, [float(np.float32(y)) for y in v], int(r.integers(0, 3))) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[7][1], rows[7][2]) for i in range(30)]
    rows += [(6000, None, 1), (6001, [0.0] * 8, 1), (6002, [math.nan] * 8, 1), (6003, [1.0, None] * 4, 1), (6004, rows[7][1], None), (6005, [1.0, 2.0], 1), (6006, [2.0, 4.0], 1), (6007, [], 1), (None, rows[7][1], 1)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = embedding_dedup.dedup_vectors(df)
    assert sorted(tuple(x) for x in got.where("vec_id IS NOT NULL").collect()) == brute(rows)
    assert got.where("vec_id IS NULL").collect()[0].n_links == 0
    assert embedding_dedup.dedup_vectors(df.where("false")).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 380)] + [(500, 500 + i) for i in range(50)] + [(1, None), (9, 9)]
    up = list(range(1000))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    nodes = {n for a, b in edges if b is not None and a != b for n in (a, b)}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def wav(x, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32000).astype("<i2").tobytes())
    return out.getvalue()


def test_shifted_and_noisy_recordings_align(spark):
    rate, hop, r = 8000, 256, np.random.default_rng(3)

    def tune(seed):
        notes = np.random.default_rng(seed).integers(0, 36, 60)
        return np.concatenate([0.5 * np.sin(2 * np.pi * 110 * 2 ** (n / 12) * np.arange(2000) / rate) for n in notes])

    a, b = tune(1), tune(2)
    noisy = a[40 * hop :] + 0.002 * r.normal(size=len(a) - 40 * hop)
    rows = [(100, wav(a, rate)), (200, wav(b, rate)), (1, wav(noisy, rate)), (2, wav(b, rate)), (3, wav(tune(5), rate)), (4, b""), (5, None), (None, wav(a, rate))]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "rec_id long, audio binary"), "audio", rate=rate, frame=1024, hop=hop)
    got = {x.rec_id: x for x in chroma.align(prints, overlap=60).collect()}  # tunes that share a note are alike for some codes
    assert (got[1].query_id, got[1].offset) == (100, -40) and got[1].bit_errors < 0.1
    assert (got[2].query_id, got[2].bit_errors) == (200, 0.0)
    assert got[3].query_id is None and got[4].n_codes == 0 and got[5].n_codes == 0 and got[None].n_matches == 0
    assert chroma.align(prints.where("false")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    from lodestar.llm import language_id, quality
    from lodestar.llm.common import staged
    from test_ngram_join import brute as groups

    sf = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        before = docs
        docs = staged(stage(spark, before, sf), f"stage{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            clean = before.join(labels.where("quality = 1"), "doc_id")
            assert docs.join(clean.select("doc_id"), "doc_id", "left_semi").count() >= 0.95 * clean.count()
            model = quality.fit(before, labels.where(language_id.remainder(F.col("doc_id"), 5) != 0))
            want = {r.doc_id for r in before.collect() if model.score(r.text) >= 0.3}
            assert {r.doc_id for r in docs.collect()} == want
        if k == 1:
            assert sizes[1] == sizes[0]
        if k == 2:
            found = groups([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in found.items() if i == c}
    assert docs.columns == ["doc_id", "source", "n_tokens", "token_ids", "decoded_sha256"]
    assert docs.where("size(token_ids) <> n_tokens").count() == 0
