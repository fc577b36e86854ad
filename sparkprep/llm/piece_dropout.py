"""SentencePiece encoding and decoding with seeded merge-dropout.

The pieces are those of a public merge-type model, read once on the driver and
shared with the tasks (a vocabulary is tens of thousands of short strings; its size
does not depend on the data). A text is cut into units, a run of spaces with the
word after it, which no piece crosses. In a unit, candidate merges wait in an
agenda by (rank, position); each candidate is skipped when a keyed digest of seed,
document, the unit's number in the document and the candidate's span is below
``dropout``: every occurrence draws for itself, and reruns agree. With ``dropout`` 0
the pieces are the library's own.

Workers keep no segmentations but the agendas' courses: in a unit's tree a node is an
agenda whose least candidate is to be judged, with one branch where it is skipped and
one where it merges. All occurrences of a batch go down their trees together, each by
its own draws. Courses that are rare have no nodes; occurrences that come to one run
their whole agenda, many at a time, with the same draws and so the same result.

Decoding joins the pieces' bytes and is exact for every text: characters that are
no piece, line ends and a literal U+2581 among them, are encoded as byte pieces.
A null text has null ids, an empty one none; repeated rows get the same pieces. Candidates of
equal rank go from left to right. An empty table has no pieces. A very long text is encoded whole;
so is a very long unit, by a heap, in a time that grows as n log n. Extra
columns are kept, whatever their names; one that is called like an output is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm import common as c

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A unit: a line end, spaces and a word, or spaces at a line's end.
_UNIT = re.compile(r"\n| *[^ \n]+| +")
#: Units up to this many characters find their next merge by looking at all; longer ones keep a heap.
_SHORT = 24
#: A batch's occurrences that come to a unit or branch without a node, from which on one is made.
_OFTEN = 4
#: Agendas that are run a step at a time.
_ROWS = 4096
#: Above every rank.
NEVER = 1 << 40
_ALL = (1 << 64) - 1
#: Odd multipliers of the keyed digest.
_START, _MIDDLE, _END, _SCATTER, _SEED = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def read_pieces(model_file: str = MODEL) -> tuple[dict[str, int], dict[str, int], list[bytes]]:
    """(merge rank of a piece, id of a piece, bytes of an id)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ranks: dict[str, int] = {}
    ids: dict[str, int] = {}
    raw: list[bytes] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            ids[piece] = i
            ranks[piece] = int(-model.get_score(i))
            raw.append(piece.replace(SPACE, " ").encode())
    return ranks, ids, raw


class PieceCodec:
    """Encodes and decodes texts, each occurrence of a unit by its own draws; keeps up to ``memo`` nodes of the units' trees."""

    def __init__(self, ranks: dict[str, int], ids: dict[str, int], raw: list[bytes], dropout: float, seed: int, memo: int = 200_000) -> None:
        self.ranks, self.ids, self.raw, self.memo = ranks, ids, raw, memo
        pieces = set(ids.values())
        self.byte_ids = {b[0]: i for i, b in enumerate(raw) if len(b) == 1 and i not in pieces}
        self.limit = int(dropout * (1 << 32))
        self.seed = seed
        self.pairs = _PairTable(ranks, ids)
        self.trees = _Trees(self)

    def _rank(self, unit: str, key: int, start: int, middle: int, end: int) -> int:
        """The rank of a candidate merge, or NEVER if there is no such piece or the keyed digest of its span skips it.

        The digest has the unit's key and the span only, so a candidate's fate does not hang on the agenda's order.
        """
        rank = self.ranks.get(unit[start:end], NEVER)
        if rank != NEVER and self.limit:
            x = (key + start * _START + middle * _MIDDLE + end * _END) & _ALL
            if (((x ^ (x >> 29)) * _SCATTER & _ALL) >> 32) < self.limit:
                return NEVER
        return rank

    def _parts(self, unit: str, key: int) -> list[str]:
        return self._by_scan(unit, key) if len(unit) <= _SHORT else self._by_heap(unit, key)

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for part in parts:
            found = self.ids.get(part)
            if found is None:  # a single character
                out += [self.byte_ids[b] for b in part.encode()]
            else:
                out.append(found)
        return out

    def _by_scan(self, unit: str, key: int) -> list[str]:
        """The agenda of a short unit: the least rank is looked for among all candidates."""
        rank = self._rank
        at = list(range(len(unit) + 1))
        agenda = [rank(unit, key, i, i + 1, i + 2) for i in range(len(unit) - 1)]
        while agenda and (low := min(agenda)) != NEVER:
            i = agenda.index(low)
            del at[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(unit, key, at[i], at[i + 1], at[i + 2])
            if i:
                agenda[i - 1] = rank(unit, key, at[i - 1], at[i], at[i + 1])
        return [unit[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _by_heap(self, unit: str, key: int) -> list[str]:
        n = len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of a part that starts here: the next start, the previous start
        agenda = []

        def offer(start: int) -> None:
            middle = after[start]
            if middle < n:
                rank = self._rank(unit, key, start, middle, after[middle])
                if rank != NEVER:
                    heapq.heappush(agenda, (rank, start, middle, after[middle]))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while agenda:
            _, start, middle, end = heapq.heappop(agenda)
            if not alive[start] or after[start] != middle or not alive[middle] or after[middle] != end:
                continue
            alive[middle] = False
            after[start] = end
            if end < n:
                before[end] = start
                offer(start)
            if before[start] >= 0:
                offer(before[start])
        out, at = [], 0
        while at < n:
            out.append(unit[at : after[at]])
            at = after[at]
        return out

    def encode_all(self, texts: list[str | None], keys: list[int]) -> list[bytes | None]:
        """Each text's ids as 32-bit little-endian integers."""
        units = [_UNIT.findall(" " + t) if t else [] for t in texts]
        ends = np.cumsum([len(u) for u in units])
        flat = list(chain.from_iterable(units))
        found = self.trees.follow(flat, np.concatenate([self.draws(k, len(u)) for k, u in zip(keys, units, strict=True)])) if flat else []
        return [None if t is None else b"".join(found[b - len(u) : b]) for t, u, b in zip(texts, units, ends.tolist(), strict=True)]

    def draws(self, key: int, n: int) -> np.ndarray:
        """The skip digest's key of each of a document's first n units."""
        own = c.mix(np.array([(key * _START + self.seed * _SEED) & _ALL], dtype=np.uint64))
        return c.mix(np.arange(n, dtype=np.uint64) + own)

    def drawn(self, unit: str, key: int) -> bytes:
        """One occurrence of any unit, without its tree; a literal U+2581 is written as bytes."""
        out: list[int] = []
        at = 0
        for i, piece in enumerate(unit.split(SPACE)):
            out += [self.byte_ids[b] for b in SPACE.encode()] if i else []
            out += self._ids(self._parts(piece.replace(" ", SPACE), (key + at * _SEED) & _ALL)) if piece else []
            at += len(piece) + 1
        return np.array(out, dtype=np.int32).tobytes()

    def encode(self, text: str, key: int) -> bytes:
        return self.encode_all([text], [key])[0]

    def run(self, units: list[str], key: np.ndarray) -> list[bytes]:
        """Short units of one length, spaces written as U+2581, each by its key."""
        n = len(units[0])
        chars = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
        sym = self.pairs.char_ids[chars]
        row = np.arange(len(units))
        at = np.broadcast_to(np.arange(n + 1), (len(units), n + 1)).copy()
        out: list[bytes] = [b""] * len(units)

        def offers(left: np.ndarray, right: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            made = self.pairs.find(left, right)
            rank = self.pairs.ranks[made]
            if self.limit:
                start, middle, end = (z.astype(np.uint64) for z in (start, middle, end))
                x = key + start * np.uint64(_START) + middle * np.uint64(_MIDDLE) + end * np.uint64(_END)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(_SCATTER)
                rank = np.where((x >> np.uint64(32)) < self.limit, NEVER, rank)
            return made, rank

        made, rank = offers(sym[:, :-1], sym[:, 1:], at[:, :-2], at[:, 1:-1], at[:, 2:], key[:, None])
        while len(row):
            if n > 1:
                i = rank.argmin(axis=1)
                over = rank[np.arange(len(row)), i] == NEVER
            else:
                over = np.ones(len(row), dtype=bool)
            if over.any():
                self._write(out, units, row[over], sym[over], at[over])
                on = ~over
                row, sym, at, key = row[on], sym[on], at[on], key[on]
                if n > 1:
                    made, rank, i = made[on], rank[on], i[on]
                if not len(row):
                    break
            own = np.arange(len(row))
            merged = made[own, i]
            col = np.arange(n - 1)
            past = col[None, :] > i[:, None]
            sym = np.where(past, sym[:, 1:], sym[:, :-1])
            sym[own, i] = merged
            at = np.where(np.arange(n)[None, :] > i[:, None], at[:, 1:], at[:, :-1])
            n -= 1
            if n > 1:
                past = past[:, :-1] | (col[:-1][None, :] == i[:, None])
                made, rank = np.where(past, made[:, 1:], made[:, :-1]), np.where(past, rank[:, 1:], rank[:, :-1])
                for shift in (-1, 0):
                    k = np.flatnonzero((i + shift >= 0) & (i + shift < n - 1))
                    j = i[k] + shift
                    made[k, j], rank[k, j] = offers(sym[k, j], sym[k, j + 1], at[k, j], at[k, j + 1], at[k, j + 2], key[k])
        return out

    def _write(self, out: list[bytes], units: list[str], row: np.ndarray, sym: np.ndarray, at: np.ndarray) -> None:
        known = (sym >= 0).all(axis=1)
        flat, size = sym[known].astype(np.int32).tobytes(), sym.shape[1] * 4
        for k, r in enumerate(row[known].tolist()):
            out[r] = flat[k * size : (k + 1) * size]
        for r, cuts in zip(row[~known].tolist(), at[~known].tolist(), strict=True):
            parts = [units[r][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            out[r] = np.array([i for p in parts for i in ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode()])], dtype=np.int32).tobytes()

    def decode(self, ids: bytes | list[int]) -> str:
        if isinstance(ids, bytes):
            ids = np.frombuffer(ids, dtype=np.int32).tolist()
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


class _Trees:
    """The courses that short units' agendas have taken, a tree a unit; grows as occurrences go down, begins anew above ``memo`` nodes."""

    def __init__(self, codec: PieceCodec) -> None:
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.roots: dict[str, int] = {}
        #: By node, of which 0 stands for no node: the ids where the agenda is done, else None; and (unit, cuts, ranks of the candidates) until both branches are made.
        self.ids: list[bytes | None] = [b""]
        self.states: list[tuple | None] = [None]
        self.spans = np.zeros(1024, dtype=np.uint64)
        #: By node and whether the candidate is skipped: the next node, -1 if not made; a node that is done is its own.
        self.next = np.full((1024, 2), -1, dtype=np.int64)
        self.next[0] = 0

    def _add(self, unit: str, at: list[int], agenda: list[int]) -> int:
        node = len(self.ids)
        if node == len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
        low = min(agenda, default=NEVER)
        if low == NEVER:
            self.ids.append(np.array(self.codec._ids([unit[a:b] for a, b in zip(at, at[1:], strict=False)]), dtype=np.int32).tobytes())
            self.states.append(None)
            self.next[node] = node
        else:
            i = agenda.index(low)
            self.ids.append(None)
            self.states.append((unit, at, agenda))
            self.spans[node] = (at[i] * _START + at[i + 1] * _MIDDLE + at[i + 2] * _END) & _ALL
        return node

    def _root(self, unit: str) -> int:
        unit = unit.replace(" ", SPACE)
        return self._add(unit, list(range(len(unit) + 1)), [self.codec.ranks.get(unit[i : i + 2], NEVER) for i in range(len(unit) - 1)])

    def _branch(self, node: int, skipped: int) -> None:
        unit, at, agenda = self.states[node]
        at, agenda = at.copy(), agenda.copy()
        i = agenda.index(min(agenda))
        if skipped:
            agenda[i] = NEVER
        else:
            rank = self.codec.ranks.get
            del at[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(unit[at[i] : at[i + 2]], NEVER)
            if i:
                agenda[i - 1] = rank(unit[at[i - 1] : at[i + 1]], NEVER)
        made = self._add(unit, at, agenda)  # may move the arrays
        self.next[node, skipped] = made
        if self.next[node, 1 - skipped] >= 0:
            self.states[node] = None

    def follow(self, units: list[str], draws: np.ndarray) -> list[bytes]:
        """The ids of each occurrence."""
        if len(self.ids) > self.codec.memo:
            self.clear()
        for unit, n in Counter(filterfalse(self.roots.__contains__, units)).items():
            if n >= _OFTEN and len(unit) <= _SHORT and SPACE not in unit:
                self.roots[unit] = self._root(unit)
        node = np.fromiter(map(self.roots.get, units, repeat(0)), dtype=np.int64, count=len(units))
        live = np.flatnonzero(self.next[node, 0] != node)
        limit = np.uint64(self.codec.limit)
        while len(live):
            now = node[live]
            x = draws[live] + self.spans[now]
            skipped = ((((x ^ (x >> np.uint64(29))) * np.uint64(_SCATTER)) >> np.uint64(32)) < limit).astype(np.int64)
            then = self.next[now, skipped]
            new = np.flatnonzero(then < 0)
            if len(new):
                ways, sizes = np.unique(now[new] * 2 + skipped[new], return_counts=True)
                for way in ways[sizes >= _OFTEN].tolist():
                    self._branch(way >> 1, way & 1)
                then[new] = np.maximum(self.next[now[new], skipped[new]], 0)
            node[live] = then
            live = live[self.next[then, 0] != then]
        found = list(map(self.ids.__getitem__, node.tolist()))
        by_length: dict[int, list[int]] = {}
        for i in np.flatnonzero(node == 0).tolist():
            unit = units[i]
            if len(unit) > _SHORT or SPACE in unit:
                found[i] = self.codec.drawn(unit, int(draws[i]))
            else:
                by_length.setdefault(len(unit), []).append(i)
        for group in by_length.values():
            for first in range(0, len(group), _ROWS):
                part = group[first : first + _ROWS]
                for i, ids in zip(part, self.codec.run([units[i].replace(" ", SPACE) for i in part], draws[part]), strict=True):
                    found[i] = ids
        return found


class _PairTable:
    """Which piece two pieces make: an open-addressing table in numpy arrays, looked up many at a time."""

    def __init__(self, ranks: dict[str, int], ids: dict[str, int]) -> None:
        self.char_ids = np.full(0x110000, -1, dtype=np.int64)
        keys, made = [], []
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right), made.append(i)
        self.bits = max(4, (len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.made = np.full(1 << self.bits, -1, dtype=np.int64)
        todo, value = np.array(keys, dtype=np.int64), np.array(made, dtype=np.int64)
        place = self._place(todo)
        while len(todo):
            free = self.keys[place] == -1
            self.keys[place[free]], self.made[place[free]] = todo[free], value[free]
            lost = self.keys[place] != todo
            todo, value, place = todo[lost], value[lost], (place[lost] + 1) & ((1 << self.bits) - 1)
        #: By piece; the last entry answers for "no piece".
        self.ranks = np.full(max(ids.values(), default=0) + 2, NEVER, dtype=np.int64)
        for piece, i in ids.items():
            self.ranks[i] = ranks[piece]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_START)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = np.where((left >= 0) & (right >= 0), left << 32 | right, -2)
        place = self._place(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.made[place], -1)
        more = np.nonzero((there != keys) & (there != -1))
        while len(more[0]):
            place[more] = (place[more] + 1) & ((1 << self.bits) - 1)
            there = self.keys[place[more]]
            out[more] = np.where(there == keys[more], self.made[place[more]], -1)
            on = (there != keys[more]) & (there != -1)
            more = tuple(m[on] for m in more)
        return out


def _shared(spark, model_file: str):  # noqa: ANN001, ANN202
    """(digest of the model, the model for the tasks)."""
    pieces = read_pieces(model_file)
    return hashlib.sha256(repr(pieces).encode()).hexdigest(), spark.sparkContext.broadcast(pieces)


_CODECS: dict[tuple, PieceCodec] = {}


def _codec(shared, dropout: float, seed: int) -> PieceCodec:  # noqa: ANN001
    """A worker's codec, kept from task to task with the trees it has grown; each model has its own."""
    digest, pieces = shared
    name = (digest, dropout, seed)
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = PieceCodec(*pieces.value, dropout, seed)
    return _CODECS[name]


def encode_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL, dropout: float = 0.1, seed: int = 17, ids_out: str = "ids", check_out: str | None = None
) -> DataFrame:
    """docs with ``ids_out`` array<int>; and, if ``check_out`` is given, the text decoded from them again."""
    shared = _shared(docs.sparkSession, model_file)
    sealed = c.Sealed(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, dropout, seed)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = codec.encode_all(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())
                sizes = np.array([len(x) // 4 if x else 0 for x in found], dtype=np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(x for x in found if x), dtype=np.int32))
                ids = pa.ListArray.from_arrays(offsets, values)
                if None in found:
                    ids = pc.if_else(pa.array([x is not None for x in found]), ids, pa.scalar(None, ids.type))
                back = pa.array([None if x is None or not check_out else codec.decode(x) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, back], [*part.schema.names[:-1], "_ids", "_back"])

    keyed = sealed.df.withColumn("_key", F.xxhash64(F.col(sealed[id_col]).cast("string")))
    schema = T.StructType([*sealed.df.schema, T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_back", T.StringType())])
    made = keyed.mapInArrow(run, schema)
    return sealed.reopen(made, added={ids_out: F.col("_ids")} | ({check_out: F.col("_back")} if check_out else {}))


def decode_pieces(encoded: DataFrame, ids_col: str = "ids", model_file: str = MODEL, text_out: str = "text") -> DataFrame:
    """encoded with the text of its ids."""
    shared = _shared(encoded.sparkSession, model_file)

    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in ids:
            codec = _codec(shared, 0.0, 0)
            yield pd.Series([None if x is None else codec.decode(list(x)) for x in series], dtype=object)

    return encoded.withColumn(text_out, F.pandas_udf(run, "string")(F.col(ids_col)))


def op2_piece_dropout(spark, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_pieces(docs, check_out="decoded").drop("text")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
