import base64
import hashlib
import random

import duckdb
import public_tokenizers as P
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from lodestar.llm import byte_bpe, language_id, license_scan, line_dedup, mixing, quality, token_counts

DATA = "/root/testdata/sf0.001"


def odd_texts():
    r = random.Random(1)
    alphabet = " \n\tabething'sdr.,!1é日🙂 \x1c"
    fixed = ["", None, " ", " a", "a ", "a  b", "\n\n a\n", "x\t y z", "don't  we'll 'S", "a<|endoftext|>b <|endoftext|>", "日本語 テキスト🙂", "\x1c a \x85b　 c", "a" * 3000, " " * 999, "!?" * 500, "١٢٣ 4５6"]
    return fixed + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)]


def test_byte_bpe_equals_the_library(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    out = byte_bpe.encode(df, path, P.PATTERN, digests=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    for row in out.collect():
        want = library.encode_ordinary(row.text or "")
        assert row.ids == want and row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert byte_bpe.encode(df.where("false"), path, P.PATTERN).count() == 0


def test_any_bytes_merge_as_in_the_library():
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library, own, r = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Merges(ranks), random.Random(2)
    for _ in range(4000):
        raw = bytes(r.choice(b"abcdeinthersto \xc3\xa9\xe2\x80\x99\xe6\x97\x00") for _ in range(r.randint(1, 30)))
        assert own.encode(raw) == library._core_bpe.encode_single_piece(raw)


def test_token_counts_equal_the_library(spark):
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    for row in token_counts.count_tokens(df, path).collect():
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((row.text or "").encode()), n, n > 512)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = language_id.remainder(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held))
    out = language_id.identify(docs.where(held), model)
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * n
    edge = spark.createDataFrame([(None, "x"), ("", "x"), ("12 !!", "x"), ("THE the and that", "x"), ("the " * 600_000, "x")], "text string, score string")
    got = [(r.lang_pred, r.score) for r in language_id.identify(edge, model).select("lang_pred", "score").collect()]
    assert [g[0] for g in got] == ["und", "und", "und", "en", "en"] and all(0 <= g[1] <= 1 for g in got)
    empty = language_id.fit(docs.where("false"))
    assert language_id.identify(edge, empty).where("lang_pred <> 'und'").count() == 0


def test_filters_report_every_language_that_has_a_gram():
    import numpy as np

    grams = {"a": np.arange(1, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), "b": np.arange(500, 1400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)}
    m = language_id.LanguageFilters.of(grams, 1 << 16, 3)
    assert (m.masks(grams["a"])[0] & 1).all() and (m.masks(grams["b"])[0] & 2).all()
    assert (m.masks(grams["a"][:400])[0] & 2).sum() <= 2


def test_quality_of_held_out_texts(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = language_id.remainder(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels.where(~held))
    rows = quality.classify(docs, model, keep=["doc_id"]).join(labels.where(held), "doc_id").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)
    edge = spark.createDataFrame([(None,), ("",), ("x" * 300_000,)], "text string")
    assert all(0 <= r.score <= 1 for r in quality.classify(edge, model).collect())
    assert quality.classify(edge, quality.fit(docs, labels.where("false"))).where("score <> 0.5").count() == 0
    assert 0.9 < quality.classify(edge, quality.fit(docs, labels.where("quality = 1"))).first().score <= 1


def test_mix_reaches_its_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 40 + 1)), s) for i, s in enumerate(["a"] * 500 + ["b"] * 60 + [None] * 40 + ["c"] * 3)]
    rows += [(None, "x y", "a"), (7, "w " * 8, "a"), (9001, None, "d"), (9002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, mixing.mix(df).drop("copies").collect()), key=str)
    con = duckdb.connect()
    documents = df.toPandas().astype({"doc_id": "Int64"})  # noqa: F841  the name in the SQL
    want = con.execute(mixing.SQL).fetchall()
    assert got == sorted(want, key=str)
    by = {}
    for _, size, own, target, taken in got:
        by.setdefault((own, target), [0, 0])
        by[own, target][0] += taken
        by[own, target][1] += size
        assert taken <= 3 * size
    assert abs(sum(t for _, t in by) - sum(s for _, s in by.values())) < 1e-6
    assert all(abs(taken - target) <= 40 and target <= 3 * own for (own, target), (taken, _) in by.items())
    assert mixing.mix(df.where("false")).count() == 0


def test_line_dedup_against_brute_force(spark):
    r = random.Random(4)
    pool = [[f"line {r.random()}" for _ in range(r.randint(1, 12))] for _ in range(12)]
    rows = [(i, "\n".join(sum((r.choice(pool) if r.random() < 0.6 else [f"own {r.random()}"] for _ in range(r.randint(0, 9))), []))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "one line"), (903, "same\n" * 500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string").repartition(3)
    codes = {x[0]: x[1] for x in df.where("text IS NOT NULL").select("doc_id", line_dedup.chunk_codes(F.col("text"))).collect()}
    seen, want = set(), {}
    for i, t in rows:
        if t is None or "\n" not in t:
            want[i] = t
            continue
        kept, lines = [], t.split("\n")
        for c in codes[i]:
            chunk = "\n".join(lines[c >> 31 : (c >> 31) + c % (1 << 31)])
            assert c % (1 << 31) >= 2
            if chunk not in seen:
                kept.append(chunk)
            seen.add(chunk)
        want[i] = "\n".join(kept)
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert {x.doc_id: x.text for x in out.collect()} == want
    assert out.agg(F.sum("n_removed")).first()[0] > 200
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
    assert all(x.n_removed == len((x.text0 or "").split("\n")) - (len(x.text.split("\n")) if x.text else 0) for x in out.join(df.select("doc_id", F.col("text").alias("text0")), "doc_id").where("n_removed > 0").collect())


def test_line_dedup_of_repeated_rows_and_nulls(spark):
    first, tail = "\n".join(f"shared {k}" for k in range(40)), "\nown a\nown b"
    rows = [(1, first), (2, first + tail), (2, first + tail), (2, first + tail), (None, first + tail), (None, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    twos = [x for x in out if x.doc_id == 2]
    assert next(x.text for x in out if x.doc_id == 1) == first and len(twos) == 3 and len(set(twos)) == 1
    assert twos[0].n_removed == 42 - len(twos[0].text.split("\n")) > 20
    gone = next(x for x in out if x.doc_id is None and x.text is not None)
    assert gone.text == "" and gone.n_removed == 42


def test_license_spans(spark):
    mit = license_scan.TEMPLATES["MIT"].split()
    edited = " ".join(["lead"] * 7 + mit[:20] + ["changed", "words"] + mit[22:] + ["tail"])
    rows = [(1, "x Licensed under the Apache License, Version 2.0. y"), (2, edited), (3, None), (4, ""), (None, "all rights RESERVED!"), (5, "under the same sky")]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, coverage double")
    got = {(x.doc_id, x.license): x for x in license_scan.scan(df).collect()}
    assert set(got) == {(1, "Apache-2.0"), (2, "MIT"), (None, "all-rights-reserved")}
    assert (got[1, "Apache-2.0"].start_word, got[1, "Apache-2.0"].end_word) == (1, 8)
    m = got[2, "MIT"]
    assert m.matched == len(mit) - 2 and (m.start_word, m.end_word) == (7, 7 + len(mit))
    assert license_scan.scan(df.where("false")).count() == 0
