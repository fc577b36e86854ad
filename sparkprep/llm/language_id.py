"""Language ID: word-first backoff.

A model holds, per language, the log frequency of its words and of the character
n-grams (``max_n`` down to 1) of its words. A word that the model knows
scores by its word frequencies; an unknown word is read left to right by its longest
known n-grams, falling back to shorter ones where a longer one is unknown. A text
scores the mean over its words, and the languages' shares of ``exp(sharpness * mean)``
are its scores, so a score does not depend on the text's length. Equal scores go to the
first language by code point.

Training reads a bounded sample of the labelled rows: about ``max_docs_per_language``
different texts of each language at most, by digest of the text, of at most the
``max_languages`` languages of the most rows. The model has every word and n-gram of
that sample, each with the languages that have it, so its size is that of the sample's
counts, however many languages there are. Prediction reads whole texts, many at a time: words are known by
64-bit digests, looked up in sorted arrays; only words that are unknown are spelt out,
each once a worker.

Words are runs of letters (Unicode's), lower-cased. A null text, or one without a letter, is
``und`` with score 0. So is every text if nothing could be learned, as from an empty
table. Rows whose language or text is null teach nothing. An empty table has no
predictions. Very long texts are read in pieces that end at a word's end. Extra columns
are kept, whatever their names; one that is called like an output is replaced. Repeated
rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import common as c

UNDETERMINED = "und"
#: Characters that are looked at together (fewer with many languages), unknown words that a worker keeps, and how many of their numbers.
_PIECE, _KEPT, _KEPT_NUMBERS = 1 << 18, 50_000, 1 << 22
#: A character that ends every word.
_OUTSIDE = re.compile(r"[\W\d_]")


@cache
def _letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@cache
def _letters() -> re.Pattern:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _letter_table(), [False]]).astype(np.int8)))
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in edges.reshape(-1, 2).tolist()) + "]+")


def _digests(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return c.mix(c.spans_digest(points.astype(np.uint64) + np.uint64(1), starts, ends, c.word_base(0)) ^ (ends - starts).astype(np.uint64))


def _points(texts: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words_digest(words: list[str]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return _digests(_points(words), ends - [len(w) for w in words], ends) if words else np.zeros(0, dtype=np.uint64)


class Frequencies:
    """Log frequencies of items in the languages that have them; a language that lacks an item gives it its floor."""

    def __init__(self, items: np.ndarray, langs: np.ndarray, logs: np.ndarray, n_items: int, floors: np.ndarray) -> None:
        """items, langs, logs: one entry an item and language, in any order."""
        order = np.lexsort((langs, items))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(items, minlength=n_items))]).astype(np.int64)
        self.langs, self.logs, self.floors = langs[order].astype(np.int32), logs[order].astype(np.float64), floors
        #: Whole rows too, where they take no more than eight numbers an entry, as with few languages.
        self.rows = None
        if n_items * len(floors) <= 8 * len(self.logs):
            self.rows = np.tile(floors, (n_items, 1))
            self.rows[items[order], self.langs] = self.logs

    @classmethod
    def of_rows(cls, rows: list[tuple], n_languages: int) -> Frequencies:
        """Of items that all languages have."""
        n = len(rows)
        return cls(np.repeat(np.arange(n), n_languages), np.tile(np.arange(n_languages), n), np.array(rows, dtype=float).ravel(), n, np.zeros(n_languages))

    def sums(self, items: np.ndarray, owners: np.ndarray, n_owners: int, weights: np.ndarray | None = None) -> np.ndarray:
        """For each owner and language the (weighted) sum over its items."""
        if self.rows is not None:
            rows = self.rows[items] if weights is None else self.rows[items] * weights[:, None]
            return np.stack([np.bincount(owners, weights=rows[:, j], minlength=n_owners) for j in range(len(self.floors))], axis=1).astype(float) if len(self.floors) else np.zeros((n_owners, 0))
        sizes, wide = self.starts[items + 1] - self.starts[items], len(self.floors)
        at = np.repeat(self.starts[items] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cell = np.repeat(owners, sizes) * wide + self.langs[at]
        times = None if weights is None else np.repeat(weights, sizes)
        have = np.bincount(cell, weights=times, minlength=n_owners * wide).reshape(n_owners, wide)
        logs = np.bincount(cell, weights=self.logs[at] if times is None else self.logs[at] * times, minlength=n_owners * wide).reshape(n_owners, wide)
        return logs + self.floors * (np.bincount(owners, weights=weights, minlength=n_owners)[:, None] - have)

    def dense(self) -> np.ndarray:
        n = len(self.starts) - 1
        return self.sums(np.arange(n), np.arange(n), n)

    @property
    def nbytes(self) -> int:
        return self.starts.nbytes + (0 if self.rows is None else self.rows.nbytes) + self.langs.nbytes + self.logs.nbytes + self.floors.nbytes


class LanguageModel:
    """languages; words and grams: text -> log frequency in each language, or their texts and ``Frequencies``."""

    def __init__(self, languages: list[str], words: dict[str, tuple] | tuple[list[str], Frequencies], grams: dict[str, tuple] | tuple[list[str], Frequencies], max_n: int, sharpness: float) -> None:
        self.languages, self.max_n, self.sharpness = languages, max_n, sharpness
        (names, of_words), (texts, self.of_grams) = ((list(x), Frequencies.of_rows(list(x.values()), len(languages))) if isinstance(x, dict) else x for x in (words, grams))
        self.grams = {g: i for i, g in enumerate(texts)}
        keys = words_digest(names)
        #: Known words by digest, in order, and which of ``of_words`` they are.
        self.rows = np.argsort(keys)
        self.keys, self.of_words = keys[self.rows], of_words
        self.piece = max(64, _PIECE * 16 // max(16, len(languages)))
        self._memo: dict[int, np.ndarray] = {}

    @property
    def table(self) -> np.ndarray:
        """The words' log frequencies, a row a word in order of digests."""
        return self.of_words.dense()[self.rows]

    def _by_grams(self, words: list[str]) -> np.ndarray:
        """For unknown words the mean log frequencies of the longest known n-grams that cover them."""
        found, sizes, owners = [], [], []
        for k, word in enumerate(words):
            marked = f"<{word}>"
            at, n = 0, len(marked)
            while at < n:
                for size in range(min(self.max_n, n - at), 0, -1):
                    if (gram := self.grams.get(marked[at : at + size])) is not None:
                        found.append(gram), sizes.append(size), owners.append(k)
                        at += size
                        break
                else:
                    at += 1
        if not found:
            return np.zeros((len(words), len(self.languages)))
        weights, owners = np.array(sizes, dtype=float), np.array(owners)
        used = np.bincount(owners, weights=weights, minlength=len(words))
        return self.of_grams.sums(np.array(found), owners, len(words), weights) / np.maximum(used, 1.0)[:, None]

    def word(self, word: str) -> tuple:
        return tuple(self._sums(words_digest([word]), lambda i: word, np.zeros(1, dtype=np.int64), 1)[0].tolist())

    def _sums(self, digests: np.ndarray, spell: Callable[[int], str], owners: np.ndarray, n_owners: int) -> np.ndarray:
        """Log frequencies of many words, summed by owner and language; ``spell`` gives the word at a place, where it must be known."""
        place = np.minimum(np.searchsorted(self.keys, digests), max(len(self.keys) - 1, 0))
        known = self.keys[place] == digests if len(self.keys) else np.zeros(len(digests), dtype=bool)
        out = self.of_words.sums(self.rows[place[known]], owners[known], n_owners)
        lost = np.flatnonzero(~known)
        if len(lost):
            new, first, back = np.unique(digests[lost], return_index=True, return_inverse=True)
            if len(self._memo) > min(_KEPT, _KEPT_NUMBERS // max(1, len(self.languages))):
                self._memo.clear()
            names, at = new.tolist(), lost[first].tolist()
            unseen = [i for i, digest in enumerate(names) if digest not in self._memo]
            if unseen:
                self._memo.update(zip([names[i] for i in unseen], self._by_grams([spell(at[i]) for i in unseen]), strict=True))
            rows = np.array([self._memo[digest] for digest in names])
            for j in range(len(self.languages)):
                out[:, j] += np.bincount(owners[lost], weights=rows[back, j], minlength=n_owners)
        return out

    def _pieces(self, texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
        """(lower-cased pieces, the text of each), of about ``piece`` characters together."""
        held, owners, size = [], [], 0
        for i, text in enumerate(texts):
            rest = text.lower() if text else ""
            while rest:
                cut = _OUTSIDE.search(rest, self.piece) if len(rest) > self.piece else None
                piece, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
                held.append(piece), owners.append(i)
                size += len(piece)
                if size >= self.piece:
                    yield held, owners
                    held, owners, size = [], [], 0
        if held:
            yield held, owners

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        sums, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for pieces, owners in self._pieces(texts) if self.languages else ():
            points = _points(pieces)
            at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            letter = _letter_table()[points]
            edge = np.zeros(len(points) + 1, dtype=bool)  # a new piece begins here
            edge[at] = True
            before, after = np.ones(len(points), dtype=bool), np.ones(len(points), dtype=bool)
            before[1:], after[:-1] = ~letter[:-1], ~letter[1:]
            starts = np.flatnonzero(letter & (before | edge[:-1]))
            ends = np.flatnonzero(letter & (after | edge[1:])) + 1
            if not len(starts):
                continue
            spell = lambda i, p=points, a=starts, b=ends: p[a[i] : b[i]].tobytes().decode("utf-32-le", "surrogatepass")
            # the texts of one look lie side by side
            owner, low = np.array(owners)[np.searchsorted(at, starts, side="right") - 1], owners[0]
            span = owners[-1] - low + 1
            total[low : low + span] += np.bincount(owner - low, minlength=span)
            sums[low : low + span] += self._sums(_digests(points, starts, ends), spell, owner - low, span)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = sums.argmax(axis=1)  # the first of equals
        shares = np.exp(self.sharpness * (sums - sums.max(axis=1)[:, None]) / np.maximum(total, 1)[:, None])
        score = np.where(total > 0, 1.0 / shares.sum(axis=1), 0.0)
        return [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), total.tolist(), strict=True)], score


def _grams(max_n: int, most_held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of words (kind 0) and of their n-grams (kind 1) of a task's texts, by language."""

    def flush(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            grams: Counter = Counter()
            for word, n in words.items():
                marked = f"<{word}>"
                for size in range(1, max_n + 1):
                    for i in range(len(marked) - size + 1):
                        grams[marked[i : i + size]] += n
            for kind, found in ((0, words), (1, grams)):
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array([kind] * len(found), pa.int32()), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["lang", "kind", "item", "n"]
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(_letters().findall(text.lower()))
                if sum(map(len, counts.values())) > most_held:
                    yield from flush(counts)
                    counts = {}
        yield from flush(counts)

    return run


def fit_language_model(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    usable: Column | None = None,
    max_docs_per_language: int = 3000,
    max_languages: int = 1000,
    max_n: int = 4,
    sharpness: float = 3.0,
) -> LanguageModel:
    """The bounds on the sample of labelled rows are ``max_docs_per_language`` and ``max_languages``; what the driver gets is that sample's counts."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.lit(True) if usable is None else usable).alias("ok"))
    labelled = labelled.where("ok and text is not null and lang is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_languages)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(sizes, "lang").where(place < max_docs_per_language / F.col("rows")).withColumn("key", F.xxhash64("text")).dropDuplicates(["lang", "key"])
    counts = sample.select("lang", "text").mapInArrow(_grams(max_n, 50_000), "lang string, kind int, item string, n long")
    rows = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(rows.column("lang").unique().to_pylist())
    place = {x: i for i, x in enumerate(languages)}
    tables: list[tuple[list[str], Frequencies]] = []
    for kind in (0, 1):
        part = rows.filter(pc.equal(rows.column("kind"), kind)).combine_chunks()
        items, langs = (part.column(c).combine_chunks().dictionary_encode() for c in ("item", "lang"))
        lang = np.array([place[x] for x in langs.dictionary.to_pylist()], dtype=np.int64)[langs.indices.to_numpy()] if len(part) else np.zeros(0, dtype=np.int64)
        n = part.column("n").to_numpy().astype(float)
        totals = np.bincount(lang, weights=n, minlength=len(languages))
        floors = np.log(0.5 / np.maximum(totals, 1.0))
        tables.append((items.dictionary.to_pylist(), Frequencies(items.indices.to_numpy(), lang, np.log(n / totals[lang]), len(items.dictionary), floors)))
    return LanguageModel(languages, *tables, max_n, sharpness)


def _predictor(shared):  # noqa: ANN001, ANN202
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for series in texts:
            lang, score = model.predict(series.tolist())
            yield pd.DataFrame({"lang": lang, "score": score})

    return predict


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and its score."""
    predict = F.pandas_udf(_predictor(docs.sparkSession.sparkContext.broadcast(model)), "lang string, score double")
    sealed = c.Sealed(docs)
    found = sealed.df.withColumn("_found", predict(F.col(sealed[text_col])))
    return sealed.reopen(found, added={lang_out: F.col("_found.lang"), score_out: F.col("_found.score")})


def held_out(remainder: int, by: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % by == remainder, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    model = fit_language_model(docs, usable=~held_out(2, 4))
    out = identify_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
