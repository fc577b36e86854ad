"""Substring dedup over a compacted de Bruijn graph of token k-mers.

1. Edges are the k-mers of ``length`` consecutive words; an edge leads from the node of its
   first to the node of its last ``length - 1`` words. Only edges around a *repeated sampled
   anchor* can be repeated: from each edge its run of ``k`` words of least digest is
   sampled, equal edges sample equal anchors, so an edge whose anchor is in one
   document only is left out without a shuffle of its own. Every repeated edge gets the smallest
   (document, position) it starts at as its source.
2. Degrees are counted by node. Where one repeated edge enters a node and one leaves it the path does
   not branch. Edges that follow each other so in their source document form a run; runs that
   follow each other over the texts of different sources are chained by pointer-jumping joins, in
   as many rounds as the logarithm of the longest chain. Chains are the compacted paths; a circle is
   left cut at its runs.
3. Every later occurrence of a repeated edge is found by one join and folded into spans: a span
   lies on one path, at an offset, and its segments have source coordinates.
4. Each segment is verified: the source's words at the source coordinates go, in blocks, to
   the documents that repeat them and are compared word by word. What is removed is the union of
   the verified words.

A hot edge, one that a third of all documents hold, is split: anchors carry a number of
salts by their counts, equal edges carry equal numbers, and the edge's source is given out
once a salt. Documents that are later copies of a whole text are told by the text's digest: all
their edges start in the first copy, so they make none.

Rows with a null id neither lose words nor are sources. Null and blank texts
have no words. Rows that share an id count as one document as a source; each is
cleaned by its own words. Equal documents go by their ids; the same edge twice in one document
is no repeat. Very long texts are read whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm import common as c


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span, m = 1, x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - span : width - span + n])


def _sampled(digests: np.ndarray, rows: np.ndarray, length: int, k: int):
    """(starts of the windows that lie in one row, their rows, digest of the sampled k-mer of each)."""
    n = len(digests)
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    if n < length:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64)
    starts = np.arange(n - length + 1)
    inside = row_of[starts] == row_of[starts + length - 1]
    at = np.arange(n - k + 1)
    kmers = c.mix(c.spans_digest(digests, at, at + k, c.word_base(1)))
    return starts[inside], row_of[starts[inside]], _window_minima(kmers, length - k + 1)[inside]


def sampled_kmers(docs: DataFrame, id_col: str, text_col: str, length: int, k: int) -> DataFrame:
    """(doc, text_key, kmer): the k-mers sampled from each text, once a run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, last, raw, at in c.text_slices(batch.column(2)):
                digests, rows = c.word_digests(raw, at)
                _, row, kmer = _sampled(digests, rows, length, k)
                if len(row):
                    new = np.ones(len(row), dtype=bool)
                    new[1:] = (row[1:] != row[:-1]) | (kmer[1:] != kmer[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[first:last][row[new]], keys[first:last][row[new]], kmer[new].view(np.int64))], ["doc", "text_key", "kmer"])

    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col)).where(F.col(id_col).isNotNull())
    return rows.mapInArrow(run, "doc long, text_key long, kmer long")


#: An anchor in more documents than this is dealt to several salts.
HOT = 4096
#: Words of a source that go to be compared together.
BLOCK = 64
#: Positions in a packed (document, position).
_PLACES = 1 << 31
_EDGE = "doc long, tag int, pos int, from long, to long, salts int"


def _edges(length: int, k: int, later_only: bool):  # noqa: ANN202
    """Edges of (doc, tag, text, listed, copy) whose anchor is among the repeated ones that the row lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(3)), pc.invert(batch.column(4))))
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, last, raw, at in c.text_slices(batch.column(2)):
                one, rows = c.word_digests(raw, at)
                starts, row, kmer = _sampled(one, rows, length, k)
                listed = batch.column(3).slice(first, last - first)
                flat = listed.flatten()
                if not len(starts) or not len(flat):
                    continue
                # an anchor counts in the row that lists it
                owner = np.repeat(np.arange(last - first), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
                anchor, salts = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("kmer", "salts"))
                if later_only:
                    wanted = flat.field("later").to_numpy(zero_copy_only=False)
                    owner, anchor, salts = owner[wanted], anchor[wanted], salts[wanted]
                    if not len(anchor):
                        continue
                have = c.mix(anchor.view(np.uint64) ^ c.mix(owner.astype(np.uint64) + np.uint64(1)))
                order = np.argsort(have)
                have, salts = have[order], salts[order]
                want = c.mix(kmer ^ c.mix(row.astype(np.uint64) + np.uint64(1)))
                place = np.minimum(np.searchsorted(have, want), len(have) - 1)
                hit = have[place] == want
                starts, row, place = starts[hit], row[hit], place[hit]
                nodes = [c.mix(c.spans_digest(one, starts + i, starts + i + length - 1, c.word_base(1))).view(np.int64) for i in (0, 1)]
                out = [ids[first:last][row], tags[first:last][row], (starts - rows[row]).astype(np.int32), *nodes, salts[place].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc", "tag", "pos", "from", "to", "salts"])

    return run


def anchored(docs: DataFrame, id_col: str, text_col: str, length: int, k: int) -> DataFrame:
    """(doc, tag, text, listed, copy): each row with the repeated anchors of its document, and whether it is a later copy of a whole text."""
    tag = F.xxhash64(text_col).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tag")
    rows = c.durable(docs.select(F.col(id_col).cast("long").alias("doc"), tag, F.md5(text_col).alias("whole")).where("doc is not null and whole is not null"))
    firsts = c.durable(rows.groupBy("whole").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").drop("high"))
    copies = c.join_hot_apart(rows, firsts, "whole", "n", "inner").where("doc > low").groupBy("doc").agg(F.collect_set("tag").alias("copies"))
    kmers = sampled_kmers(docs, id_col, text_col, length, k)
    repeated = kmers.groupBy("kmer").agg(F.min("doc").alias("low"), F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.count(F.lit(1)).alias("n")).where("a != b")
    repeated = repeated.select("kmer", "low", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    each = kmers.select("doc", "kmer").join(repeated, "kmer").select("doc", F.struct("kmer", (F.col("low") < F.col("doc")).alias("later"), "salts").alias("one"))
    listed = c.durable(each.groupBy("doc").agg(F.collect_set("one").alias("listed")).join(copies, "doc", "full"))
    return (
        docs.select(F.col(id_col).cast("long").alias("doc"), tag, F.col(text_col).alias("text"))
        .join(listed.hint("shuffle_merge"), "doc", "left")
        .select("doc", "tag", "text", "listed", F.coalesce(F.array_contains("copies", F.col("tag")), F.lit(False)).alias("copy"))
    )


def repeated_edges(keyed: DataFrame, length: int, k: int) -> DataFrame:
    """(from, to, salts, source_doc, source_pos, run, run_salts, inner): one row an edge that different documents hold, with its run in its source document."""
    place = F.col("doc").cast("decimal(38,0)") * _PLACES
    edges = keyed.mapInArrow(_edges(length, k, False), _EDGE)
    edges = edges.groupBy("from", "to").agg(F.min((place + F.col("pos")).cast("decimal(38,0)")).alias("source"), F.max(place.cast("decimal(38,0)")).alias("high"), F.max("salts").alias("salts"))
    edges = edges.where("high > source").select("from", "to", "salts", F.floor(F.col("source") / _PLACES).cast("long").alias("source_doc"), F.pmod("source", F.lit(_PLACES)).cast("int").alias("source_pos"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("from").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("to").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    inner = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out = 1 and into = 1").select("node")
    marked = edges.join(inner, F.col("from") == F.col("node"), "left").withColumn("inner", F.col("node").isNotNull()).drop("node")
    order = Window.partitionBy("source_doc").orderBy("source_pos", "from", "to")
    follows = F.col("inner") & (F.lag("source_pos").over(order) + 1 == F.col("source_pos")) & (F.lag("to").over(order) == F.col("from"))
    numbered = marked.withColumn("begins", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("begins").over(order).cast("int")).drop("begins")
    return numbered.withColumn("run_salts", F.max("salts").over(Window.partitionBy("source_doc", "run")))


def compact(edges: DataFrame) -> DataFrame:
    """(source_doc, run, run_pos, n_edges, run_salts, path_doc, path_run, base): each run with the nonbranching path it is part of and its offset there."""
    runs = edges.groupBy("source_doc", "run").agg(
        F.min("source_pos").alias("run_pos"), F.count(F.lit(1)).alias("n_edges"), F.max("run_salts").alias("run_salts"), F.min_by("from", "source_pos").alias("head"), F.max_by("to", "source_pos").alias("tail"), F.min_by("inner", "source_pos").alias("inner")
    )
    runs = c.durable(runs)
    before = runs.select(F.col("tail").alias("head"), F.col("source_doc").alias("up_doc"), F.col("run").alias("up_run"), F.col("n_edges").alias("ahead"))
    # the node is inner, so one run ends there
    links = runs.where("inner").join(before, "head").where("source_doc != up_doc or run != up_run").select("source_doc", "run", "up_doc", "up_run", "ahead", F.lit(True).alias("moved"))
    links = c.durable(links)
    for _ in range(links.count().bit_length() + 1):
        over = links.select(F.col("source_doc").alias("up_doc"), F.col("run").alias("up_run"), F.col("up_doc").alias("o_doc"), F.col("up_run").alias("o_run"), F.col("ahead").alias("more"))
        links = c.durable(
            links.join(over, ["up_doc", "up_run"], "left").select(
                "source_doc", "run", F.coalesce("o_doc", "up_doc").alias("up_doc"), F.coalesce("o_run", "up_run").alias("up_run"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"), F.col("o_doc").isNotNull().alias("moved")
            )
        )
        if links.where("moved").isEmpty():
            break
    links = links.where("not moved").drop("moved")  # what still moves is a circle
    return runs.join(links, ["source_doc", "run"], "left").select(
        "source_doc", "run", "run_pos", "n_edges", "run_salts", F.coalesce("up_doc", "source_doc").alias("path_doc"), F.coalesce("up_run", "run").alias("path_run"), F.coalesce("ahead", F.lit(0)).alias("base")
    )


def _salted(df: DataFrame, salts: str) -> DataFrame:
    """Each row once a salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(salts) - 1)))


def _salt(salts: str) -> Column:
    return F.pmod(F.xxhash64("doc"), F.col(salts)).cast("int")


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed documents, runs, spans).

    Spans: doc, tag (31 bits of a digest of the text, for rows that share an id), start,
    end (of the words covered), path_doc and path_run (the path's name), path_offset, and segments
    (source_doc, run, run_pos, run_salts, source_start, at, n: n words of doc from ``at`` on are the source's from ``source_start`` on).
    """
    keyed = anchored(docs, id_col, text_col, length, k)
    edges = c.durable(repeated_edges(keyed, length, k))
    runs = compact(edges)
    later = keyed.mapInArrow(_edges(length, k, True), _EDGE).withColumn("salt", _salt("salts")).drop("salts")
    found = later.join(_salted(edges, "salts"), ["from", "to", "salt"]).where("source_doc < doc").select("doc", "tag", "pos", "source_doc", "source_pos", "run", "run_salts")
    order = Window.partitionBy("doc", "tag").orderBy("pos")

    def same(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (F.col(n) == F.lag(n).over(order))
        return out

    follows = same("source_doc", "run") & (F.col("pos") == F.lag("pos").over(order) + 1) & (F.col("source_pos") == F.lag("source_pos").over(order) + 1)
    segments = (
        found.withColumn("begins", F.when(follows, 0).otherwise(1))
        .withColumn("span", F.sum("begins").over(order))
        .groupBy("doc", "tag", "span")
        .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("edges"), F.min("source_doc").alias("source_doc"), F.min("run").alias("run"), F.min("source_pos").alias("source_start"), F.max("run_salts").alias("run_salts"))
        .withColumn("salt", _salt("run_salts"))
    )
    placed = segments.join(_salted(runs, "run_salts").drop("run_salts", "n_edges"), ["source_doc", "run", "salt"]).withColumn("path_offset", F.col("base") + F.col("source_start") - F.col("run_pos"))
    onward = same("path_doc", "path_run") & (F.col("pos") == F.lag("pos").over(order) + F.lag("edges").over(order)) & (F.col("path_offset") == F.lag("path_offset").over(order) + F.lag("edges").over(order))
    segment = F.struct("source_doc", "run", "run_pos", "run_salts", "source_start", F.col("pos").alias("at"), (F.col("edges") + length - 1).alias("n"))
    spans = (
        placed.withColumn("begins", F.when(onward, 0).otherwise(1))
        .withColumn("path", F.sum("begins").over(order))
        .groupBy("doc", "tag", "path")
        .agg(
            F.min("pos").alias("start"), (F.max(F.col("pos") + F.col("edges")) + length - 1).alias("end"), F.min("path_doc").alias("path_doc"), F.min("path_run").alias("path_run"), F.min("path_offset").alias("path_offset"),
            F.collect_list(segment).alias("segments"),
        )
        .drop("path")
    )
    return keyed, runs, c.durable(spans)


def _source_words(length: int):  # noqa: ANN202
    """The words of each run of (doc, text, runs) by blocks of the source's positions; rows that share an id give theirs each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            batch = batch.filter(pc.is_valid(batch.column(2)))
            for doc, text, runs in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                words = (text or "").encode().split()
                for r in runs:
                    end = min(r["run_pos"] + r["n_edges"] + length - 1, len(words))
                    for b in range(r["run_pos"] // BLOCK, -(-end // BLOCK)):
                        part = words[max(b * BLOCK, r["run_pos"]) : min((b + 1) * BLOCK, end)]
                        for column, value in zip(out, (doc, r["run"], b, r["run_salts"], b" ".join(part).decode()), strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["source_doc", "run", "b", "run_salts", "words"])

    return run


def source_words(keyed: DataFrame, runs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(doc, checks): for each document the source's words that its segments have to equal."""
    by_doc = runs.groupBy(F.col("source_doc").alias("doc")).agg(F.collect_list(F.struct("run", "run_pos", "n_edges", "run_salts")).alias("runs"))  # no more than a text has words
    given = keyed.join(by_doc.hint("shuffle_merge"), "doc", "left").select("doc", "text", "runs").mapInArrow(_source_words(length), "source_doc long, run int, b int, run_salts int, words string")
    asked = spans.select("doc", "tag", F.explode("segments").alias("s")).select("doc", "tag", "s.*")
    last = F.col("source_start") + F.col("n")
    asked = asked.withColumn("b", F.explode(F.sequence(F.floor(F.col("source_start") / BLOCK).cast("int"), F.floor((last - 1) / BLOCK).cast("int"))))
    low = F.greatest(F.col("b") * BLOCK, "source_start")
    check = F.struct("tag", (F.col("at") + low - F.col("source_start")).cast("int").alias("at"), (low - F.greatest(F.col("b") * BLOCK, "run_pos")).cast("int").alias("skip"), (F.least((F.col("b") + 1) * BLOCK, last) - low).cast("int").alias("n"))
    asked = asked.withColumn("salt", _salt("run_salts")).select("doc", "source_doc", "run", "b", "salt", check.alias("check"))
    return asked.join(_salted(given, "run_salts"), ["source_doc", "run", "b", "salt"]).groupBy("doc").agg(F.collect_list(F.struct("check.*", "words")).alias("checks"))


def _clean(length: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, tag, text, copy, checks, n_paths in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                words = (text or "").encode().split()
                keep = np.full(len(words), not (copy and len(words) >= length))
                for x in checks or ():
                    if x["tag"] == tag and words[x["at"] : x["at"] + x["n"]] == x["words"].encode().split(b" ")[x["skip"] : x["skip"] + x["n"]]:
                        keep[x["at"] : x["at"] + x["n"]] = False
                left = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                for column, value in zip(out, (doc, len(words), len(words) - len(left), b" ".join(left).decode(), sum(p == tag for p in n_paths or ())), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())], ["doc", "n_words", "n_removed", "kept", "n_paths"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 24) -> DataFrame:
    """(id, n_words, n_removed, kept, n_paths): every text without the words it repeats, kept words joined by one space, and on how many stretches of compacted paths those lie."""
    keyed, runs, spans = repeated_paths(docs, id_col, text_col, length, k)
    checks = source_words(keyed, runs, spans, length).join(spans.groupBy("doc").agg(F.collect_list("tag").alias("paths")), "doc")
    joined = keyed.join(checks.hint("shuffle_merge"), "doc", "left").select("doc", "tag", "text", "copy", "checks", "paths")
    return joined.mapInArrow(_clean(length), "doc long, n_words long, n_removed long, kept string, n_paths long").withColumnRenamed("doc", id_col)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(c.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS p FROM w
), h AS (
  SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS d FROM win
), firsts AS (
  SELECT d, min(doc_id) AS low FROM h GROUP BY d
), gone AS (
  SELECT h.doc_id, list(h.p ORDER BY h.p) AS ps FROM h JOIN firsts USING (d) WHERE firsts.low < h.doc_id GROUP BY h.doc_id
), cut AS (
  SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 50)))) AS bad FROM gone
), marked AS (
  SELECT w.doc_id, len(words) AS n, words, i, g.i IS NULL AS keep
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0) w
  LEFT JOIN (SELECT doc_id, unnest(bad) AS i FROM cut) g USING (doc_id, i)
), agg AS (
  SELECT doc_id, count(*) FILTER (NOT keep) AS n_removed,
         coalesce(string_agg(words[i], ' ' ORDER BY i) FILTER (keep), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN agg USING (doc_id)
"""
