import random
import re
from collections import Counter, defaultdict

import pytest

from lodestar.llm import ngram_join


def brute(rows):
    """Links by counting common shingles of all pairs that have any; groups by union-find."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for own in holders.values():
        common.update((a, b) for k, a in enumerate(own) for b in own[:k])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    r = random.Random(3)
    rows = [(i * 7 + 3, t) for i, t in enumerate([None, "", " \n", "a b c", "A B C", "a b c d e f", "x" * 10000] * 2)]
    common = [f"common{i}" for i in range(60)]
    for b in [[r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(r.randrange(3, 200))] for _ in range(25)]:
        for _ in range(r.choice([1, 2, 5, 30])):
            w = list(b)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.03, 0.05, 0.06]))):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            if r.random() < 0.4:
                at = r.randrange(len(w))
                w[at:at] = common
            rows.append((1000 + len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("tile", [2048, 16])
def test_same_groups_as_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = corpus()
    got = ngram_join.group_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    t = "one two three four five six"
    rows = [(5, t, 1), (5, t, 2), (9, t, 3), (None, t, 4), (7, None, 5), (8, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(map(tuple, ngram_join.group_similar(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 0 + 2, None), (7, 0, 7), (8, 0, 8)], key=str)
    kept = ngram_join.keep_one(df)
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(r[2] for r in kept.collect()) == [1, 2, 4, 5, 6]
    assert ngram_join.group_similar(df.where("false")).count() == 0
