"""Nulls, ties, repeated rows, empty tables, clashing columns, and brute force where a library or SQL can't stand in."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import unicodedata
from pyspark.sql import functions as F

from lodestar.llm import language_id, license_scan, ngram_join, quality, registry, token_counts

DATA = "/root/testdata/sf0.01"


def plain_language(docs, rows):
    """Languages by sets of n-grams in place of filters: the share of a text's n-grams that each language has."""

    def grams(text):
        words = "".join(c.lower() if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else c if unicodedata.category(c)[0] == "L" else " " for c in text or "").split()
        return [w[i : i + n] for x in words for w in (f" {x} ",) for n in language_id.LENGTHS for i in range(len(w) - n + 1) if not (w[i] == " " and w[i + n - 1] == " ")]

    counts, texts = {}, Counter()
    for text, lang in {(t, k) for t, k in docs if t is not None and k is not None}:
        texts[lang] += 1
        counts.setdefault(lang, Counter()).update(set(grams(text)))
    known = {k: {g for g, n in c.items() if n >= 0.01 * texts[k] and (n >= 2 or texts[k] < 10)} for k, c in counts.items()}
    out = {}
    for i, text in rows:
        g = grams(text)
        shares = {k: sum(x in own for x in g) / len(g) for k, own in known.items()} if g else {}
        out[i] = max(sorted(shares), key=shares.get) if g else "und"
    return out


def test_op2_decides_as_sets_of_ngrams_do(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    learn = [(d.text, d.lang) for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 != 2]
    want = plain_language(learn, [(d.doc_id, d.text) for d in docs])
    got = {r.doc_id: r for r in registry.op2_language_id(spark, DATA).collect()}
    assert len(got) == len(docs) and np.mean([got[i].lang_pred == k for i, k in want.items()]) >= 0.995
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)


def test_more_languages_than_a_word_has_bits_ties_and_repeated_rows(spark):
    letters = [chr(0x4E00 + i) for i in range(70)]
    rows = [(f"{c}{c}{c} {c}{c}", f"l{i:02d}") for i, c in enumerate(letters) for _ in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 70 and len(model.tables) == 2
    ask = spark.createDataFrame([(c * 3, 1, "x") for c in letters] + [(letters[5] * 3, 2, "y")] * 2 + [(f"{letters[3] * 3} {letters[2] * 3}", 3, "tie")], "text string, score int, lang_pred string")
    got = language_id.identify(ask, model)
    assert got.columns == ["text", "lang_pred", "score"] and got.count() == 73
    by = {r.text: r.lang_pred for r in got.collect()}
    assert all(by[c * 3] == f"l{i:02d}" for i, c in enumerate(letters)) and by[f"{letters[3] * 3} {letters[2] * 3}"] == "l02"
    few = language_id.fit(spark.createDataFrame(rows + [("zz zz", "more")] * 9, "text string, lang string"), most_languages=1)
    assert few.languages == ["more"]


def test_op9_repeated_rows_empty_tables_clashes_and_the_bound_in_bytes(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs.unionByName(docs.limit(50)), labels)
    odd = spark.createDataFrame([("some words here", "a", 1), ("some words here", "a", 1), (None, "b", 2), ("", "c", 3)], "text string, score string, predicted int")
    got = quality.classify(odd, model)
    assert got.columns == ["text", "score", "predicted"] and len({r.score for r in got.where("text = 'some words here'").collect()}) == 1
    assert got.count() == 4 and quality.classify(odd.where("false"), model).count() == 0
    nothing = quality.fit(docs.where("false"), labels)
    assert quality.classify(odd, nothing).where("score IS NULL OR score < 0 OR score > 1").count() == 0
    tight = quality.fit(docs, labels, sample_bytes=200_000)
    assert tight.good and tight.bad and len(tight.good) + len(tight.bad) <= 400_000


def test_op10_empty_table_and_clashing_columns(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("a b", 1, 7), ("a b", 1, 7), (None, 2, 8)], "text string, n_tokens int, other int")
    got = token_counts.count_tokens(df, path)
    assert sorted(c for c in got.columns if c != "text") == ["n_bytes", "n_tokens", "other", "over_limit"] and [r.n_bytes for r in got.orderBy("other").collect()] == [3, 3, 0]
    assert token_counts.count_tokens(df.where("false"), path).count() == 0


def plain_matches(words, template, coverage):
    """Whether some window of words has that share of the template's words in order, by a full longest common subsequence."""
    need, width = coverage * len(template), len(template) + 2 * license_scan.BAND
    for at in range(0, max(1, len(words) - len(template) // 2)):
        window = words[at : at + width]
        row = [0] * (len(window) + 1)
        for a in template:
            last = 0
            for j, b in enumerate(window, 1):
                row[j], last = (last + 1 if a == b else max(row[j], row[j - 1])), row[j]
        if row[-1] >= need:
            return True
    return False


def test_op5_finds_each_template_wherever_it_is_put(spark):
    """Random placements of whole and slightly changed templates: every place is reported, with its span, and nothing where none is."""
    r = random.Random(11)
    names = sorted(license_scan.TEMPLATES)
    filler = [f"w{i}" for i in range(400)]
    rows, want = [], {}
    for i in range(120):
        text, places = [], []
        for _ in range(r.randrange(0, 4)):
            text += r.choices(filler, k=r.choice([0, 1, 3, 9, 40, 400]))
            name = r.choice(names)
            words = license_scan.TEMPLATES[name].split()
            if len(words) >= 20:
                for _ in range(len(words) // 20):
                    words[r.randrange(1, len(words) - 1)] = r.choice(filler)
            places.append((name, len(text), len(text) + len(words)))
            text += words
        text += r.choices(filler, k=r.randrange(0, 30))
        rows.append((i, " ".join(text)))
        want[i] = places
    got = {}
    for m in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(m.doc_id, []).append((m.license, m.start_word, m.end_word))
    for i, places in want.items():
        found = got.get(i, [])
        assert len(found) == len(places), (places, found)
        for (name, a, z), (seen, x, y) in zip(places, sorted(found, key=lambda m: m[1])):
            # A changed word may be found among the words before or after.
            assert seen == name and a - license_scan.BAND <= x and y <= z + license_scan.BAND and y - x >= 0.75 * (z - a), (places, found)


def test_op5_reports_no_text_that_a_full_alignment_does_not(spark):
    docs = [d for d in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if d.text and len(d.text) < 1500][:150]
    short = {n: t for n, t in license_scan.TEMPLATES.items() if len(t.split()) <= 12}
    df = spark.createDataFrame([(d.doc_id, d.text) for d in docs], "doc_id long, text string")
    got = {(m.doc_id, m.license) for m in license_scan.scan(df, templates=short).collect()}
    clean = lambda t: [w.strip(license_scan._EDGES.decode()) or w for w in t.lower().split()]
    best = Counter(i for i, _ in got)
    for d in docs:
        full = {n for n, t in short.items() if plain_matches(clean(d.text), clean(t), 0.75)}
        assert {n for i, n in got if i == d.doc_id} <= full
        assert bool(best[d.doc_id]) or not any(plain_matches(clean(d.text), clean(short[n]), 1.0) for n in full)
    long = "x " * 400_000 + license_scan.TEMPLATES["MIT"] + " y" * 100_000
    (m,) = license_scan.scan(spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert (m.doc_id, m.license, m.start_word) == (1, "MIT", 400_000)


@pytest.mark.parametrize("most", [4_000, 60_000])
def test_op8_blocks_bounded_by_bytes_with_long_texts_and_many_near_copies(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "TILE", 100)
    monkeypatch.setattr(ngram_join, "TILE_BYTES", most)
    r = random.Random(5)
    rows, base = [], [f"b{r.randrange(5000)}" for _ in range(160)]
    for i in range(900):  # near copies of one text, each with its own changes; a few are like some of them only
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"own{i}"
        rows.append((i, " ".join(w)))
    long = [f"l{r.randrange(10**6)}" for _ in range(20_000)]
    rows += [(2000, " ".join(long)), (2001, " ".join(long[:-300])), (2002, " ".join(long[9000:])), (2003, " ".join(long) + " end")]
    rows += [(3000 + k, " ".join(base[:40])) for k in range(300)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kinds = {}
    for i in ids:
        kinds.setdefault(frozenset(sets[i]), []).append(i)
    heads = [own[0] for own in kinds.values()]
    for own in kinds.values():
        for x in own:
            up[find(x)] = find(own[0])
    for a, x in enumerate(heads):
        for y in heads[a + 1 :]:
            if min(len(sets[x]), len(sets[y])) * 100 >= 75 * max(len(sets[x]), len(sets[y])) and find(x) != find(y):
                n = len(sets[x] & sets[y])
                if 100 * n >= 75 * (len(sets[x]) + len(sets[y]) - n):
                    up[find(y)] = find(x)
    least = {}
    for i in ids:
        least[find(i)] = min(i, least.get(find(i), i))
    got = ngram_join.group_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == {i: (len(sets[i]), least[find(i)]) for i in ids}


def test_op3_rows_without_an_id_are_spread(spark):
    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    from lodestar.llm import mixing

    more = spark.range(500).select((F.col("id") + 10).alias("doc_id"), F.lit("x y z").alias("text"), F.lit("b").alias("source"))
    out = mixing.mix(rows.unionByName(more)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.countDistinct("taken").alias("kinds")).collect()
    assert all(abs(x.taken - x.target) <= 3 for x in out)
