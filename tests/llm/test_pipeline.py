"""The pipeline's stages against brute force, on odd rows and on the smallest table."""

from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from sparkprep.llm import piece_dropout
from tests.llm.test_operators import brute_lines, brute_links, some


def test_stages_keep_columns_rows_and_empty_tables(spark, sf, docs, empty, raw):
    for _, stage in P.STAGES[:-1]:
        made = stage(spark, empty, sf)
        assert made.columns == empty.columns and made.count() == 0
    last = P.pieces(spark, empty, sf)
    assert {"copy", "n_pieces"} <= set(last.columns) and last.count() == 0
    cleaned = P.lines(spark, docs, sf)
    assert cleaned.columns == docs.columns
    assert some((r["doc_id"], r["text"]) for r in cleaned.collect()) == some(x[:2] for x in brute_lines(raw, 10))
    assert all(r["n_chars"] == len(r["text"]) and r["_row"] == "_row" for r in cleaned.collect())
    spoken = P.language(spark, docs, sf).collect()
    assert not any(r["text"] is None or not any(ch.isalpha() for ch in r["text"]) for r in spoken)
    assert sum(1 for r in spoken if r["doc_id"] in (1, 3, 4, 9, 100)) == 5
    left = Counter((r["doc_id"], r["text"]) for r in P.near_copies(spark, docs, sf).collect())
    links = brute_links([(r[0], r[1]) for r in raw])
    want = {(r[0], r[1]) for r, (_, low, _) in zip(raw, links, strict=True) if low == r[0]}
    assert set(left) == want and set(left.values()) == {1}


def test_mixture_and_pieces_follow_the_copies(spark, sf, docs):
    from sparkprep.llm.mixing import mix_sources

    copies = Counter()
    for r in mix_sources(docs).collect():
        copies[(r["doc_id"], r["text_key"])] += r["copies"]
    mixed = P.mixture(spark, docs, sf)
    assert mixed.columns == docs.columns
    got = Counter((r["doc_id"], r["k"]) for r in mixed.select("doc_id", F.xxhash64("text").alias("k")).collect())
    assert got == +copies
    out = P.pieces(spark, mixed.where("doc_id < 9 or doc_id is null"), sf).collect()
    codec = piece_dropout.PieceCodec(*piece_dropout.read_pieces(), 0.0, 0)
    assert out and all(codec.decode(list(r["ids"])) == r["text"] and r["n_pieces"] == len(r["ids"]) for r in out)


def test_run_gives_the_stages_in_order(spark, sf):
    out = P.run(spark, sf)
    assert {"doc_id", "text", "copy", "ids", "n_pieces"} <= set(out.columns)
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    cleaned = {i: t for i, t, _, _ in brute_lines([(r["doc_id"], r["text"]) for r in real if any(ch.isalpha() for ch in r["text"])], 10)}
    links = brute_links(list(cleaned.items()))
    kept = {i for i, low, _ in links if low == i}
    rows = out.select("doc_id", "text", "n_pieces").collect()
    assert rows and {r["doc_id"] for r in rows} <= kept and all(r["text"] == cleaned[r["doc_id"]] for r in rows)
