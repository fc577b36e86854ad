"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

1. Texts with the same word sequence form a class; one signature a class goes on.
2. A signature is ``trees`` x ``max_depth`` minima, a path down a prefix trie in each of
   ``trees`` trees. Subtrees at the shortest prefix that any document can need, those with
   two classes at least, are laid out in the trie's order: classes sorted by the rest of
   their paths, so that a class's longest matched prefix is the longer one of those it
   shares with its two neighbours.
3. Prefixes are shortened a class at a time. A class asks with prefixes of ``max_depth``,
   and by one minimum less until its own recall reaches the target: at that length it
   met others in as many trees as a pair at the threshold does on average, so a partner
   that is not met must miss both the class and those it met,
   ``1 - (1 - threshold**depth) ** (2 * trees) >= target_recall``. Where a class meets too few
   it goes on to the shortest prefix, at which a pair at the threshold meets by itself,
   ``1 - (1 - threshold**depth) ** trees >= target_recall``. All classes answer at every length.
4. Classes that meet and whose whole signatures agree nearly as much as the threshold
   asks (``margin`` standard deviations below it) are linked, and the links' connected
   components are the groups to verify. A subtree of more than ``bucket_block`` classes is
   dealt into blocks and every pair of blocks is compared, so the links are the same.
5. Within a group every pair's Jaccard similarity is computed exactly, from the
   whole texts' shingle sets. A group beyond ``block`` members or ``block_shingles``
   shingles is dealt into blocks, and pairs of blocks go to different tasks. Pairs
   are counted where they are verified; what leaves a task is one count a class
   and a tree of few branches over the classes it links, so nothing grows with the square of a group.

Shingles are ``shingle`` consecutive words, unchanged; a text of fewer words has its
whole word sequence as its one shingle. Texts without words (null, empty, blank)
link to nothing. Rows of one id and different texts are different documents; repeated
rows are copies of each other. A null id is no class's smallest id unless all are null.
A pair just at the threshold is linked. Very long texts are read whole, in 512 shingles at a
time where their minima are taken. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm import common as c


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[bytes, np.ndarray] | None]:
    """For each text the 128-bit digest of its word sequence and the sorted digests of its shingles; None without words."""
    for first, last, raw, at in c.text_slices(texts):
        one, rows = c.word_digests(raw, at)
        two, _ = c.word_digests(raw, at, 1)
        starts, ends = rows[:-1], rows[1:]
        whole = [c.mix(c.spans_digest(x, starts, ends, c.word_base(i)) ^ (ends - starts).astype(np.uint64)) for i, x in enumerate((one, two))]
        n = len(one)
        grams = c.mix(c.spans_digest(one, np.arange(n - size + 1), np.arange(size, n + 1), c.word_base(1))) if n >= size else np.zeros(0, dtype=np.uint64)
        for i in range(last - first):
            a, b = int(starts[i]), int(ends[i])
            if a == b:
                yield None
                continue
            own = np.unique(grams[a : b - size + 1]) if b - a >= size else whole[0][i : i + 1]
            yield whole[0][i].tobytes() + whole[1][i].tobytes(), own


def forest_depth(threshold: float, trees: int, max_depth: int, target_recall: float) -> int:
    """The shortest prefix that a document can need: the longest at which pairs at the threshold meet in some tree with the target recall."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target_recall:
        depth -= 1
    return depth


def enough_trees(threshold: float, trees: int, shortest: int, max_depth: int, target_recall: float) -> dict[int, int]:
    """prefix length -> in how many trees a class must have met others at that length to stop there."""
    return {d: math.ceil(trees * threshold**d) for d in range(max_depth, shortest, -1) if 1 - (1 - threshold**d) ** (2 * trees) >= target_recall}


def own_depths(met: DataFrame, shortest: int, max_depth: int, enough: dict[int, int]) -> DataFrame:
    """(print, depth): the prefix length down to which each class asks, from (bucket, part, branch, print)."""
    order = Window.partitionBy("bucket", "part").orderBy("branch")
    steps = range(max_depth - shortest, 0, -1)

    def shared(other: Column) -> Column:
        """How many minima of the branch are those of a neighbour."""
        out = F.lit(0)
        for k in reversed(steps):
            out = F.when(F.substring("branch", 1, 4 * k) == F.substring(other, 1, 4 * k), F.lit(k)).otherwise(out)
        return out

    longest = shortest + F.greatest(shared(F.lag("branch").over(order)), shared(F.lead("branch").over(order)))
    matched = met.select("print", longest.alias("longest")).groupBy("print").agg(*[F.count_if(F.col("longest") >= d).alias(f"at{d}") for d in enough])
    depth = F.lit(shortest)
    for d in sorted(enough):
        depth = F.when(F.col(f"at{d}") >= enough[d], F.lit(d)).otherwise(depth)
    return matched.select("print", depth.alias("depth"))


def _signatures(shingle: int, hashes: int):  # noqa: ANN202
    state = np.random.RandomState(20240607)
    a = state.randint(0, 1 << 32, size=(2, hashes), dtype=np.uint64)
    b = state.randint(0, 1 << 32, size=(2, hashes), dtype=np.uint64)
    times, plus = (a[0] << np.uint64(32) | a[1]) | np.uint64(1), b[0] << np.uint64(32) | b[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, signs = [], [], []
            for found in shingle_sets(batch.column(1), shingle):
                if found is None:
                    prints.append(None), sizes.append(0), signs.append(None)
                    continue
                low = None
                for i in range(0, len(found[1]), 512):
                    part = (found[1][i : i + 512, None] * times + plus).min(axis=0)
                    low = part if low is None else np.minimum(low, part)
                prints.append(found[0]), sizes.append(len(found[1])), signs.append((low >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())], ["id", "text_key", "print", "n_shingles", "sign"])

    return run


def branching(names: list[bytes], width: int = 32) -> list[tuple[bytes, bytes]]:
    """Edges of a tree over names in which no name has more than width + 1 edges: no hot key where edges are joined."""
    return [(names[(i - 1) // width], names[i]) for i in range(1, len(names))]


def _bucket_links(trees: int, max_depth: int, need: float):  # noqa: ANN202
    """Trees over the classes of each unit that meet, at a length that either asks with, and are alike by their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[bytes, bytes]] = []
        for unit in c.by_runs(batches, "unit"):
            prints = unit.column("print").to_pylist()
            signs = np.frombuffer(b"".join(unit.column("sign").to_pylist()), dtype=np.uint32).reshape(len(prints), trees * max_depth)
            depth = unit.column("depth").to_numpy()
            rest = np.arange(len(prints))
            while len(rest) > 1:
                queue, rest = [int(rest[0])], rest[1:]
                found = [queue[0]]
                while queue and len(rest):
                    now = queue.pop()
                    same = signs[rest] == signs[now]
                    linked = same.sum(axis=1) >= need
                    close = np.flatnonzero(linked)
                    path = np.logical_and.accumulate(same[close].reshape(-1, trees, max_depth), axis=2).sum(axis=2).max(axis=1, initial=0)
                    linked[close] = path >= np.minimum(depth[rest[close]], depth[now])
                    queue += rest[linked].tolist()
                    found += rest[linked].tolist()
                    rest = rest[~linked]
                if len(found) > 1:
                    edges += branching([prints[i] for i in found])
            if len(edges) > 5000:
                yield _edges(edges)
                edges = []
        yield _edges(edges)

    return run


def _edges(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], ["a", "b"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    (lv, lo), (rv, ro) = ((np.concatenate(x), np.repeat(np.arange(len(x)), list(map(len, x)))) for x in (left, right))
    # only shingles of both sides can add to an intersection
    both = np.intersect1d(lv, rv) if left is not right else np.unique(lv)
    if left is right:
        values, counts = np.unique(lv, return_counts=True)
        both = values[counts > 1]
    li, ri = np.searchsorted(both, lv), np.searchsorted(both, rv)
    lk, rk = (np.append(both, 0)[i] == v if len(both) else np.zeros(len(v), dtype=bool) for i, v in ((li, lv), (ri, rv)))
    lk, rk = lk & (li < len(both)), rk & (ri < len(both))
    li, lo, ri, ro = li[lk], lo[lk], ri[rk], ro[rk]
    for at in range(0, len(both), columns):
        width = min(columns, len(both) - at)
        x, y = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        k = (li >= at) & (li < at + width)
        x[lo[k], li[k] - at] = 1
        k = (ri >= at) & (ri < at + width)
        y[ro[k], ri[k] - at] = 1
        out += x @ y.T
    return out


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a class: equal rows, which the join brings to one task, once."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for name, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keep.append(n == 1 or name not in seen)
            if n > 1:
                seen.add(name)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _verify(shingle: int, threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in c.by_runs(batches, "unit"):
            members: dict[bytes, tuple] = {}
            texts = unit.column("text").combine_chunks()
            texts = texts if isinstance(texts, pa.Array) else texts.chunk(0)
            side, other = unit.column("block").to_pylist(), unit.column("other").to_pylist()
            for i, (name, found) in enumerate(zip(unit.column("print").to_pylist(), shingle_sets(texts, shingle), strict=True)):
                if found is not None and found[0] == name:  # another text of the same id is not the class's
                    members[name] = (found[1], unit.column("n")[i].as_py(), side[i] <= other[i], side[i] == other[i])
            names = list(members)
            within = all(m[3] for m in members.values())
            left = [n for n in names if within or members[n][2]]
            right = names if within else [n for n in names if not members[n][2]]
            if not left or not right or within and len(names) < 2:
                continue
            ls = [members[n][0] for n in left]
            rs = ls if within else [members[n][0] for n in right]
            same = _overlaps(ls, rs)
            total = np.array(list(map(len, ls)))[:, None] + np.array(list(map(len, rs)))[None, :]
            linked = same / (total - same) >= threshold
            if within:
                np.fill_diagonal(linked, False)
            links: dict[bytes, int] = {}
            rn, ln = np.array([members[n][1] for n in right], dtype=np.int64), np.array([members[n][1] for n in left], dtype=np.int64)
            for n, k in zip(left, (linked @ rn).tolist(), strict=True):
                links[n] = links.get(n, 0) + k
            if not within:
                for n, k in zip(right, (ln @ linked).tolist(), strict=True):
                    links[n] = links.get(n, 0) + k
            edges = _forest(left, right, linked, within)
            counted = [(n, None, k) for n, k in links.items() if k]
            a, b, k = zip(*counted, *((x, y, 0) for x, y in edges), strict=True) if counted or edges else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(k, pa.int64())], ["a", "b", "links"])

    return run


def _forest(left: list[bytes], right: list[bytes], linked: np.ndarray, within: bool) -> list[tuple[bytes, bytes]]:
    """A tree over each set of classes that the linked pairs connect."""
    n = len(left)
    names = left if within else left + right
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        for j in np.flatnonzero(linked[i]).tolist():
            a, b = find(i), find(j if within else j + n)
            root[max(a, b)] = min(a, b)
    parts: dict[int, list[bytes]] = {}
    for i, name in enumerate(names):
        parts.setdefault(find(i), []).append(name)
    return [e for part in parts.values() for e in branching(part)]


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    shingle: int = 5,
    trees: int = 16,
    max_depth: int = 6,
    target_recall: float = 0.999,
    margin: float = 4.0,
    bucket_block: int = 2048,
    block: int = 512,
    block_shingles: int = 1_000_000,
) -> DataFrame:
    """(id, text_key, class_id, n_copies, n_links): one row a row of docs.

    ``class_id`` is the smallest id of the documents linked with this one, directly or
    through others; ``n_copies`` the number of documents of the same words, this one
    included; ``n_links`` the number of other documents at or above the threshold, copies included;
    ``text_key`` a digest of the text, which tells rows of one id apart.
    """
    hashes = trees * max_depth
    shortest = forest_depth(threshold, trees, max_depth, target_recall)
    enough = enough_trees(threshold, trees, shortest, max_depth, target_recall)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = c.durable(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_signatures(shingle, hashes), "id long, text_key long, print binary, n_shingles int, sign binary"))
    classes = signed.where("print is not null").groupBy("print").agg(F.min("id").alias("rep"), F.min(F.struct("id", "text_key")).alias("held_by"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign"))
    classes = c.durable(classes)

    width = max_depth * 4
    paths = f"transform(sequence(0, {trees - 1}), t -> struct(xxhash64(t, substring(sign, t * {width} + 1, {shortest * 4})) AS bucket, substring(sign, t * {width} + 1 + {shortest * 4}, {width - shortest * 4}) AS branch))"
    members = classes.select("print", F.explode(F.expr(paths)).alias("at")).select("print", "at.bucket", "at.branch")
    same = Window.partitionBy("m", "leader", "all")  # at most a row a tree
    shared = (
        members.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("m"), F.min("print").alias("leader"), F.sum(F.xxhash64("print").cast("decimal(20,0)")).alias("all"))
        .where("m > 1")
        .select("bucket", F.ceil(F.col("m") / bucket_block).cast("int").alias("parts"), (F.min("bucket").over(same) == F.col("bucket")).alias("first"))
    )
    met = c.durable(members.join(shared, "bucket").withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")))
    asking = own_depths(met, shortest, max_depth, enough)
    need = threshold * hashes - margin * math.sqrt(threshold * (1 - threshold) * hashes)
    # subtrees of the same classes in several trees are compared once, whole signatures as they are
    compared = met.where("first").select("bucket", "part", "parts", "print").join(asking.join(classes.select("print", "sign"), "print"), "print")
    pairs = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("part")))
    units = compared.withColumn("other", F.explode(pairs)).withColumn("unit", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
    links = units.select("unit", "print", "sign", "depth").repartition("unit").sortWithinPartitions("unit").mapInArrow(_bucket_links(trees, max_depth, need), "a binary, b binary")
    groups = c.connected_components(links).withColumnRenamed("node", "print").withColumnRenamed("component", "grp")

    grouped = c.durable(groups.join(classes.drop("sign"), "print"))
    deal = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    deal = deal.select("grp", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("s") / block_shingles)).cast("int").alias("blocks"))
    dealt = grouped.join(deal, "grp").withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    wanted = dealt.select("print", "grp", "n", "blocks", "block", F.col("held_by.id").alias("held_id"), F.col("held_by.text_key").alias("held_key"))
    # rows that share an id, or have none, are told apart by their texts
    texts = wanted.join(rows.withColumn("key", F.xxhash64("text")), (F.col("held_key") == F.col("key")) & F.col("held_id").eqNullSafe(F.col("id"))).select("print", "grp", "n", "blocks", "block", "text")
    units = (
        texts.mapInArrow(_once, texts.schema)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("unit", F.concat_ws(":", F.hex("grp"), F.least("block", "other"), F.greatest("block", "other")))
        .select("unit", "print", "n", "block", "other", "text")
        .repartition("unit")
        .sortWithinPartitions("unit")
    )
    verified = c.durable(units.mapInArrow(_verify(shingle, threshold), "a binary, b binary, links long"))
    counts = verified.where("b is null").groupBy(F.col("a").alias("print")).agg(F.sum("links").alias("links"))
    joined = c.connected_components(verified.where("b is not null").select("a", "b")).withColumnRenamed("node", "print")
    named = joined.join(classes.select("print", "rep"), "print")
    smallest = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = named.join(smallest, "component").select("print", "class_id").join(counts, "print")
    found = classes.select("print", "rep", "n").join(named, "print", "left")
    found = c.durable(found.select("print", "n", F.coalesce("class_id", "rep").alias("class_id"), F.col("n").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    return (
        c.join_hot_apart(signed.select("id", "text_key", "print"), found, "print", "n", "left")
        .select(F.col("id").alias(id_col), "text_key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.read(spark, sf_dir, "documents")).drop("text_key")
