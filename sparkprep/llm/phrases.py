"""Phrase collocation mining by stripes: each prefix keys an associative counter of the words after it.

The stripe of ``a b`` says how often each word follows it inside a piece. The stripes of all
prefixes that begin with one word are nested in one: its elements are the ways to go on, ``b`` and
``b c`` and ``b c d``, so a prefix's stripe are the elements one word longer than its own. This one
structure gives all: an element is the count of a phrase, and of a longer prefix; the stripe of no prefix has the words'
own counts, and in an element without a word those that no frequent phrase can hold, so its sum is the number of all
words; the greatest element of a prefix's stripe is the most frequent longer phrase that begins with it, and the
same elements, read without the first word, give the most frequent one that ends with it. A phrase is never
more frequent than one inside it, so these two decide about all longer phrases.

Tasks build stripes of their own rows with numbered words, so a word that is everywhere
costs one stripe a task; stripes travel in shards by their prefixes and are merged element by element where they
meet. A stripe is cut into segments by its next words, and there are as many segments and shards as the
corpus's size calls for, so none grows past a bound.

Most phrases of a corpus occur once. A first pass counts all phrases of one to ``max_words`` words
in hashed buckets; a phrase whose bucket stays under the threshold cannot reach it and gets no
element. The bucket counts are merged block by block, only one bit a bucket is given to the tasks,
and there are about as many buckets as a sixteenth of the corpus's bytes, at most 2 ** MOST_BITS
(64 MB). Beyond the size that this serves more phrases pass the filter; the result is the same, as
elements are counted exactly.

A null text is empty, a null language is ``und``. A table without words has no phrases. Very long texts
are read whole, in slices of rows. Repeated rows count each time. Ties go by count, then phrase, in
byte order. Columns are read by name; others do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm import common as c

#: Buckets of the filter: 2 ** LEAST_BITS to 2 ** MOST_BITS; they are merged in blocks of 2 ** 16.
LEAST_BITS, MOST_BITS = 20, 29
#: Buckets, and stripes' elements, that a task holds before it passes them on.
HELD = 1 << 23
#: Bytes of text for one segment of a stripe, and shards for so many bytes.
SEGMENT_BYTES, SHARDS = 1 << 28, 512
#: A task numbers at most 2 ** _WORDS words before it starts anew: _PACKED numbers fit in one integer.
_WORDS, _PACKED = 20, 3
_STEP = np.uint64(0xD1342543DE82EF95)

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(x) for x in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, its texts) of a batch of (language, text)."""
    told = batch.column(0).dictionary_encode()
    for i, lang in enumerate(told.dictionary.to_pylist()):
        yield lang, batch.column(1).filter(pc.equal(told.indices, i))


def _grams(lang: str, texts: pa.Array, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Per slice: lower-cased bytes, word starts, word ends, and for each length the phrases' digests and whether they lie in one piece, by their first words."""
    salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    for _, _, raw, at in c.text_slices(texts):
        raw = _SMALL[raw]
        starts, ends, rows = c.word_spans(raw, at, _GAP)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
        piece = breaks[starts] + np.repeat(np.arange(len(rows) - 1), np.diff(rows)) * (len(raw) + 1)
        words = c.bytes_digest(raw, starts, ends)
        digests, inside = [c.mix(words ^ salt)], [np.ones(len(words), dtype=bool)]
        for m in range(1, max_words):
            after = np.zeros(len(words), dtype=np.uint64)
            after[:-m] = words[m:]
            digests.append(c.mix(digests[-1] * _STEP + after))
            same = np.zeros(len(words), dtype=bool)
            same[:-m] = piece[m:] == piece[:-m]
            inside.append(same)
        yield raw, starts, ends, digests, inside


def _blocks(buckets: np.ndarray, most: int) -> pa.RecordBatch:
    """Rows (block, n, counts) of the buckets seen: per block of 2 ** 16 the gaps between them and how often each was seen, up to ``most``."""
    buckets.sort()
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    seen = buckets[first]
    times = np.minimum(np.diff(np.append(first, len(buckets))), most).astype(np.uint8)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], seen[1:] >> 16 != seen[:-1] >> 16])), len(seen))
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        gaps = np.diff((seen[a:b] & 0xFFFF).astype(np.int64), prepend=0)
        told = np.concatenate([(gaps & 255).astype(np.uint8), (gaps >> 8).astype(np.uint8), times[a:b]])
        rows.append(pa.compress(told.tobytes(), codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array((seen[cuts[:-1]] >> 16).astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(rows, pa.binary())], ["block", "n", "counts"])


def _frequent_buckets(texts: DataFrame, bits: int, min_count: int, max_words: int) -> bytes:
    """A bit a bucket: whether phrases of it were seen ``min_count`` times or more in all."""
    most = min(min_count, 255)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for lang, of in _languages(batch):
                for *_, digests, inside in _grams(lang, of, max_words):
                    held += [(d[i] >> np.uint64(64 - bits)).astype(np.uint32) for d, i in zip(digests, inside, strict=True)]
                    if sum(map(len, held)) >= HELD:
                        yield _blocks(np.concatenate(held), most)
                        held = []
        if sum(map(len, held)):
            yield _blocks(np.concatenate(held), most)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(1 << 16, dtype=np.uint32)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= most, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, n, counts in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if block != now:
                    if now is not None:
                        yield told()
                    now, sums = block, np.zeros(1 << 16, dtype=np.uint32)
                part = np.frombuffer(pa.decompress(counts, decompressed_size=3 * n, codec="zstd", asbytes=True), dtype=np.uint8)
                at = np.cumsum(part[:n].astype(np.int64) + (part[n : 2 * n].astype(np.int64) << 8))
                sums[at] += np.minimum(part[2 * n :], most)
        if now is not None:
            yield told()

    counted = texts.mapInArrow(count, "block int, n int, counts binary")
    merged = counted.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    out = bytearray(1 << (bits - 3))
    with c.freed_shuffles(texts.sparkSession):
        for row in merged.collect():  # a bit a bucket, 64 MB at most
            out[row.block << 13 : (row.block + 1) << 13] = row.bits
    return bytes(out)


class _Stripes:
    """The stripes of one language that a task holds: numbered words, and per prefix length the prefixes and next words met."""

    def __init__(self, lang: str, max_words: int) -> None:
        self.lang, self.numbers, self.words = lang, {}, [None]
        self.met: list[list[np.ndarray]] = [[] for _ in range(max_words)]  # by length, the last with its last words apart
        self.last: list[np.ndarray] = []
        self.n = 0

    def add(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, alive: list[np.ndarray]) -> int:
        """Takes in the slice's words; returns how many elements that were."""
        self.n += len(starts)
        kept = np.flatnonzero(alive[0])
        if not len(kept):
            return 0
        edges = np.zeros(len(raw) + 1, dtype=np.int8)
        edges[starts[kept]] = 1
        np.subtract.at(edges, ends[kept], 1)
        data = raw[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(ends[kept] - starts[kept])]).astype(np.int32)
        told = pa.StringArray.from_buffers(len(kept), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        numbers = np.array([self._number(w) for w in told.dictionary.to_pylist()], dtype=np.uint64)
        at = np.zeros(len(starts), dtype=np.uint64)
        at[kept] = numbers[told.indices.to_numpy()]
        self.met[0].append(at[kept].astype(np.uint32))
        total = len(kept)
        for m in range(1, len(alive)):
            of = np.flatnonzero(alive[m])
            phrase = at[of]
            for k in range(1, min(m, _PACKED - 1) + 1):
                phrase = (phrase << np.uint64(_WORDS + 1)) | at[of + k]
            self.met[m].append(phrase)
            if m == _PACKED:
                self.last.append(at[of + m])
            total += len(of)
        return total

    def _number(self, word: str) -> int:
        found = self.numbers.get(word)
        if found is None:
            found = self.numbers[word] = len(self.words)
            self.words.append(word)
        return found

    def told(self, segments: int) -> Iterator[pa.RecordBatch]:
        """The stripes, packed by shards."""
        words = pa.array(self.words, pa.string())
        raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        at = np.frombuffer(words.buffers()[1], dtype=np.int32)[: len(words) + 1].astype(np.int64)
        digest = c.bytes_digest(raw, at[:-1], at[1:])
        digest[0] = 0  # what is no word
        own = np.bincount(np.concatenate(self.met[0]), minlength=len(words)) if self.met[0] else np.zeros(1, dtype=np.int64)
        own[0] = self.n - own.sum()
        shards = np.uint64(segments * SHARDS)
        yield from self._packed(None, np.zeros(len(own), dtype=np.int64), digest[: len(own)] % shards, words, own)
        low = np.uint64((2 << _WORDS) - 1)
        firsts, counts, paths, second = [], [], [], []
        for m, met in enumerate(self.met[1:], 1):
            phrase = np.concatenate(met) if met else np.zeros(0, dtype=np.uint64)
            if m < _PACKED:
                phrase, times = np.unique(phrase, return_counts=True)
                numbers = [phrase >> np.uint64((_WORDS + 1) * (m - k)) & low for k in range(m + 1)]
            else:
                prefixes, prefix = np.unique(phrase, return_inverse=True)
                element, times = np.unique((prefix.astype(np.uint64) << np.uint64(_WORDS + 1)) | (np.concatenate(self.last) if met else phrase), return_counts=True)
                of = prefixes[element >> np.uint64(_WORDS + 1)]
                numbers = [*(of >> np.uint64((_WORDS + 1) * (m - 1 - k)) & low for k in range(m)), element & low]
            numbers = [x.astype(np.int64) for x in numbers]
            firsts.append(numbers[0])
            second.append(numbers[1])
            counts.append(times)
            path = [words.take(pa.array(x)) for x in numbers[1:]]
            paths.append(pc.binary_join_element_wise(*path, " ") if m > 1 else path[0])
        if firsts:
            first, segment = np.concatenate(firsts), digest[np.concatenate(second)] % np.uint64(segments)
            yield from self._packed(words, first, c.mix(digest[first] + segment) % shards, pa.concat_arrays(paths), np.concatenate(counts))

    def _packed(self, prefixes: pa.Array | None, prefix: np.ndarray, shard: np.ndarray, nexts: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row a shard from elements: the prefixes of its stripes, their sizes, and all their elements."""
        order = np.lexsort((prefix, shard))
        order = order[counts[order] > 0]
        prefix, shard = prefix[order], shard[order].astype(np.int32)
        if not len(order):
            return
        new_shard = np.concatenate([[True], shard[1:] != shard[:-1]])
        stripes = np.append(np.flatnonzero(new_shard | np.concatenate([[True], prefix[1:] != prefix[:-1]])), len(prefix))
        rows = np.append(np.flatnonzero(new_shard), len(prefix))
        told = pa.nulls(len(stripes) - 1, pa.string()) if prefixes is None else prefixes.take(pa.array(prefix[stripes[:-1]]))
        of_rows, of_elements = pa.array(np.searchsorted(stripes, rows).astype(np.int32)), pa.array(rows.astype(np.int32))
        lists = [pa.ListArray.from_arrays(of_rows, told), pa.ListArray.from_arrays(of_rows, pa.array(np.diff(stripes).astype(np.int32)))]
        lists += [pa.ListArray.from_arrays(of_elements, x) for x in (nexts.take(pa.array(order)), pa.array(counts[order].astype(np.int64)))]
        yield pa.RecordBatch.from_arrays([pa.array([self.lang] * (len(rows) - 1)), pa.array(shard[rows[:-1]]), *lists], ["lang", "shard", "prefixes", "sizes", "nexts", "counts"])


def _stripe_batch(lang: pa.Array, shard: pa.Array, prefix: pa.Array, cuts: np.ndarray, nexts: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    cuts = pa.array(cuts.astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, nexts), pa.ListArray.from_arrays(cuts, counts)]
    return pa.RecordBatch.from_arrays([lang, shard, prefix, *lists], ["lang", "shard", "prefix", "nexts", "counts"])


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row a stripe."""
    lang, shard, prefixes, sizes, nexts, counts = batch.columns
    row = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(prefixes).to_numpy(zero_copy_only=False)))
    cuts = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())])
    return _stripe_batch(lang.take(row), shard.take(row), prefixes.flatten(), cuts, nexts.flatten(), counts.flatten())


def _merged(table: pa.Table) -> pa.RecordBatch:
    """Stripes of one prefix and shard added up element by element."""
    lang, shard, prefix, nexts, counts = (x.combine_chunks() for x in table.columns)
    named, begun = lang.dictionary_encode(), prefix.dictionary_encode()
    own = pc.fill_null(begun.indices, len(begun.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    key = (shard.to_numpy().astype(np.int64) * len(named.dictionary) + named.indices.to_numpy()) * (len(begun.dictionary) + 1) + own
    _, first, stripe = np.unique(key, return_index=True, return_inverse=True)
    told = nexts.flatten().dictionary_encode()
    code = pc.fill_null(told.indices, len(told.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(told.dictionary) + 1
    element, back = np.unique(np.repeat(stripe, pc.list_value_length(nexts).to_numpy(zero_copy_only=False)) * width + code, return_inverse=True)
    sums = np.zeros(len(element), dtype=np.int64)
    np.add.at(sums, back, counts.flatten().to_numpy())
    words = pa.concat_arrays([told.dictionary, pa.array([None], pa.string())])
    at = pa.array(first)
    return _stripe_batch(lang.take(at), shard.take(at), prefix.take(at), np.searchsorted(element, np.arange(len(first) + 1) * width), words.take(pa.array(element % width)), pa.array(sums))


def _summed(stripe: pa.RecordBatch, min_count: int) -> pa.RecordBatch:
    """Merged stripes with the sum of their elements of a word or none, ``total``, and of their elements the frequent ones, each with the greatest of those one word longer, ``right``."""
    nexts, counts = stripe.column(3).flatten(), stripe.column(4).flatten().to_numpy()
    row = np.repeat(np.arange(stripe.num_rows), pc.list_value_length(stripe.column(3)).to_numpy(zero_copy_only=False))
    longer = pc.fill_null(pc.match_substring(nexts, " "), False).to_numpy(zero_copy_only=False)
    totals = np.zeros(stripe.num_rows, dtype=np.int64)
    np.add.at(totals, row[~longer], counts[~longer])
    kept = np.flatnonzero((counts >= min_count) & pc.is_valid(nexts).to_numpy(zero_copy_only=False))
    paths, row, counts, longer = nexts.take(pa.array(kept)), row[kept], counts[kept], longer[kept]
    codes = pa.concat_arrays([paths, pc.replace_substring_regex(paths, " [^ ]*$", "")]).dictionary_encode()
    code, width = codes.indices.to_numpy().astype(np.int64), len(codes.dictionary) + 1
    own, above = row * width + code[: len(kept)], row * width + code[len(kept) :]
    order = np.argsort(own)
    at = order[np.searchsorted(own[order], above[longer])]  # a frequent phrase's prefix is frequent, and in the same segment
    right = np.zeros(len(kept), dtype=np.int64)
    np.maximum.at(right, at, counts[longer])
    cuts = pa.array(np.searchsorted(row, np.arange(stripe.num_rows + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, x) for x in (paths, pa.array(counts), pa.array(right))]
    return pa.RecordBatch.from_arrays([stripe.column(0), stripe.column(2), pa.array(totals), *lists], ["lang", "prefix", "total", "nexts", "counts", "right"])


def _merge_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges packed stripes sorted by (lang, shard) as they come; the last shard stays open."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_unpacked(batch))
        size += len(held[-1].column(3).values)
        if size >= HELD // 4:
            done = _merged(pa.Table.from_batches(held))
            last = pc.and_(pc.equal(done.column(0), batch.column(0)[-1]), pc.equal(done.column(1), batch.column(1)[-1]))
            yield done.filter(pc.invert(last))
            held = [done.filter(last)]
            size = len(held[0].column(3).flatten())
    if held:
        yield _merged(pa.Table.from_batches(held))


def stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, max_words: int = 4) -> DataFrame:
    """lang, prefix, total, nexts, counts, right: the merged stripes, nested by their first word (``prefix``), and that of no prefix (null), whose totals add up to the number of words.

    nexts has the one to ``max_words`` - 1 words that go on from the prefix at least ``min_count`` times, for no prefix
    the words themselves; counts how often they do, right how often the most frequent phrase one word longer does.
    """
    if not 2 <= max_words <= _PACKED + 1:
        raise ValueError(f"phrases have 2 to {_PACKED + 1} words")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size // 16).bit_length(), LEAST_BITS), MOST_BITS)
    segments = size // SEGMENT_BYTES + 1
    filtered = docs.sparkSession.sparkContext.broadcast(_frequent_buckets(texts, bits, min_count, max_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(filtered.value, dtype=np.uint8)
        held: dict[str, _Stripes] = {}
        size = 0
        for batch in batches:
            for lang, of in _languages(batch):
                for raw, starts, ends, digests, inside in _grams(lang, of, max_words):
                    alive: list[np.ndarray] = []
                    for digest, whole in zip(digests, inside, strict=True):
                        at = digest >> np.uint64(64 - bits)
                        found = (((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) == 1) & whole
                        if alive:
                            found[:-1] &= alive[-1][:-1] & alive[-1][1:]
                        alive.append(found)
                    size += held.setdefault(lang, _Stripes(lang, max_words)).add(raw, starts, ends, alive)
                    if size >= HELD or len(held[lang].words) >= 1 << _WORDS:
                        for one in held.values():
                            yield from one.told(segments)
                        held, size = {}, 0
        for one in held.values():
            yield from one.told(segments)

    packed = texts.mapInArrow(build, "lang string, shard int, prefixes array<string>, sizes array<int>, nexts array<string>, counts array<long>")
    merge = lambda batches: (_summed(x, min_count) for x in _merge_stripes(batches) if x.num_rows)
    merged = packed.repartition("lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(merge, "lang string, prefix string, total long, nexts array<string>, counts array<long>, right array<long>")
    return merged.where((F.size("nexts") > 0) | F.col("prefix").isNull())


def _exact(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, max_words: int = 4, subsumed_percent: int = 80, scale: int = 2_000_000, per_language: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to ``max_words`` words by their weakest cut.

    a, l and r count the phrase and the parts of its weakest cut, n the language's words, score is floor(scale * a / (l + r)).
    Phrases of which a longer one has ``subsumed_percent`` of the occurrences or more are left out.
    """
    found = c.durable(stripes(docs, text_col, lang_col, min_count, max_words))
    sizes = found.where("prefix IS NULL").groupBy("lang").agg(F.sum("total").alias("n"))
    prefixes = found.where("prefix IS NOT NULL")
    keyed = lambda phrase: F.concat("lang", F.lit("\t"), phrase)  # noqa: E731  (no word holds a tab)
    words = found.where("prefix IS NULL").select("lang", F.explode(F.arrays_zip("nexts", "counts")).alias("x")).select(keyed(F.col("x.nexts")).alias("key"), F.col("x.counts").alias("f"))
    longer = prefixes.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts", "right")).alias("x"))
    longer = longer.select("lang", F.concat("prefix", F.lit(" "), F.col("x.nexts")).alias("phrase"), F.col("x.counts").alias("a"), F.col("x.right").alias("right_most"))
    longer = c.durable(longer.withColumn("words", F.split("phrase", " ", -1)).withColumn("key", keyed(F.col("phrase"))))
    tails = longer.where(F.size("words") > 2).groupBy(keyed(F.array_join(F.slice("words", F.lit(2), F.size("words")), " ")).alias("key")).agg(F.max("a").alias("left_most"))
    met = longer.join(tails, "key", "left")
    most = F.coalesce(F.greatest("right_most", "left_most"), F.lit(0))
    kept = c.durable(met.where(100 * _exact(most) < subsumed_percent * _exact("a")).select("key", "lang", "phrase", "words", "a"))
    cut = kept.where("size(words) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    side = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("of")), F.struct(F.lit("r").alias("side"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("of"))))
    asked = cut.select("key", "lang", "phrase", "a", "k", side.alias("x")).select(F.col("key").alias("whole"), "lang", "phrase", "a", "k", "x.side", keyed(F.col("x.of")).alias("key"))
    known = words.unionByName(longer.select("key", F.col("a").alias("f")))
    answers = c.durable(known.join(asked.groupBy("key").agg(F.count("*").alias("asked")), "key"))
    told = c.join_hot_apart(asked, answers, "key", "asked", "inner")
    counts = {f"{s}{k}": F.max(F.when((F.col("side") == s) & (F.col("k") == k), F.col("f"))) for k in range(1, max_words) for s in "lr"}
    scored = told.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *[v.alias(n) for n, v in counts.items()])
    cuts = []
    for k in range(1, max_words):
        score = F.expr(f"cast(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0))) as bigint)")
        cuts.append(F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    scored = scored.withColumn("weakest", F.array_min(F.array(*cuts))).select("lang", "phrase", "a", "weakest.score", "weakest.l", "weakest.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language may have nearly all phrases
    some = some.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_nth") <= per_language)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= per_language)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return phrases(c.read(spark, sf_dir, "documents").select("text", "lang"))


ORACLE_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS ws FROM piece
), g AS (
  SELECT lang, m, ws[i:i + m - 1] AS p, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m)
  GROUP BY ALL HAVING count(*) >= 30
), size AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), inner_of AS (
  SELECT lang, p[i:i + k - 1] AS p, max(f) AS f
  FROM (SELECT lang, p, f, m, k, unnest(range(1, m - k + 2)) AS i FROM g CROSS JOIN (SELECT unnest([2, 3]) AS k) WHERE k < m)
  GROUP BY ALL
), kept AS (
  SELECT g.* FROM g LEFT JOIN inner_of o ON g.lang = o.lang AND g.p = o.p WHERE g.m > 1 AND 100 * coalesce(o.f, 0) < 80 * g.f
), cut AS (
  SELECT lang, p, f AS a, unnest(range(1, m)) AS k FROM kept
), scored AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, c.k, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cut c JOIN g x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN g y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
       array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM weakest JOIN size USING (lang)
QUALIFY rank <= 2000
"""
