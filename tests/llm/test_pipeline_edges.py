import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PROSE = " ".join(f"word{i % 37} of the text{i % 11}" for i in range(60))


def edge_rows():
    lines = "\n".join(f"a line that stands here {i}" for i in range(30))
    return [
        (1, PROSE, "en", "a", 9, 0.1), (1, PROSE, "en", "a", 9, 0.2), (2, PROSE, None, None, None, 0.3), (None, PROSE, "en", "a", 9, 0.4), (None, None, None, None, None, None),
        (3, None, "en", "b", 0, 0.5), (4, "", "en", "b", 0, 0.6), (5, " \n\t", "de", "b", 3, 0.7), (6, lines, "en", "a", 1, 0.8), (7, lines + "\nend", "en", "c", 1, 0.9),
        (8, "long " * 200_000, "en", "a", 1_000_000, 1.0), (9, "日本 🙂 " * 50, "ja", "d", 1, 1.1),
    ]


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_takes_odd_rows(spark, empty):
    import corpus_pipeline as cp

    from lodestar.llm.common import staged

    kind = "doc_id long, text string, lang string, source string, n_chars long, score double"
    docs = spark.createDataFrame([] if empty else edge_rows(), kind).withColumnsRenamed({"score": "predicted"})
    for k, (_, stage) in enumerate(cp.STAGES):
        # Each stage on the odd rows themselves, and with columns of a result's name.
        out = staged(stage(spark, docs.withColumnsRenamed({"predicted": ["score", "n_removed", "component_id", "copies", "token_ids"][k]}), "/root/testdata/sf0.001"), f"edge{k}")
        rows = out.collect()
        assert out.columns == (COLUMNS if k < 4 else ["doc_id", "source", "n_tokens", "token_ids", "decoded_sha256"])
        if empty:
            assert not rows
            continue
        ids = sorted((r.doc_id for r in rows), key=str)
        if k in (1, 4):
            assert len(rows) == len(edge_rows())
        if k == 1:  # the chunks that 7 has in common with 6 go from 7; nothing else changes
            by = {r.doc_id: r.text for r in rows if r.doc_id is not None}
            assert by[6] == edge_rows()[8][1] and len(by[7]) < len(by[6]) and by[7].endswith("end")
        if k == 2:  # 2 equals 1; 5, 4 and 3 have no words; null ids stay; 7 is near 6
            assert ids == sorted([1, 1, 3, 4, 5, 6, 8, 9, None, None], key=str)
        if k == 4:
            assert all(len(r.token_ids) == r.n_tokens for r in rows)
            assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
