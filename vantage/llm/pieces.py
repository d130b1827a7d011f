"""SentencePiece (merge type) encoding and decoding with seeded merge-dropout."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import Vocabulary, chunks, ragged, small_batches, tidy
from vantage.llm.jaccard import mix

#: Share of candidate merges that are skipped, and seed.
DROPOUT, SEED = 0.1, 3
#: Units of at most so many characters are merged side by side; longer ones by a heap.
SIDE_BY_SIDE = 24
_WIDTHS = (2, 4, 6, 8, 11, 16, SIDE_BY_SIDE)
_SPACE = "▁"
_NONE = np.int32(2**31 - 1)
_UNIT = re.compile(r" *[^ \n]+| +|\n")
_C1, _C2, _C3, _C4 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def place(start, mid, end):
    """A number for the candidate merge of [start, mid) with [mid, end) in its unit."""
    return np.asarray(start, np.uint64) * _C1 + np.asarray(mid, np.uint64) * _C2 + np.asarray(end, np.uint64) * _C3


def limit_of(dropout: float) -> np.uint64:
    return np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))


class Tables:
    """What a merge-type model file holds, for encoding on executors without the file."""

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = m.get_piece_size()
        self.piece = [m.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        plain = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        text = {self.piece[i]: i for i in plain}
        if len(self.byte) != 256 or "\n" in text or any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in text):
            raise ValueError("needs byte pieces, and no piece that crosses a space or line break")
        order = sorted(plain, key=lambda i: (-m.get_score(i), i))
        self.rank = np.full(size, _NONE, np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.size = size
        pairs = {}
        for p, i in text.items():
            for k in range(1, len(p)):
                a, b = text.get(p[:k]), text.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = i
        # pairs that merge, in an open table of at least twice their number of places
        self.bits = max(4, int(2 * len(pairs)).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        todo, value, step = np.array(sorted(pairs), np.int64), np.array([pairs[k] for k in sorted(pairs)], np.int32), 0
        while len(todo):
            at = (self.home(todo) + step) & ((1 << self.bits) - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = first & (self.keys[at] < 0)
            self.keys[at[put]], self.merged[at[put]] = todo[put], value[put]
            todo, value, step = todo[~put], value[~put], step + 1
        self.probes = step
        self.pairs = pairs
        self.chars = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in text.items():
            if len(p) == 1 and p != _SPACE:
                self.chars[ord(p)] = i
        self.chars[0x20] = text[_SPACE]
        self.out = [b""] * size
        for i in plain:
            self.out[i] = self.piece[i].replace(_SPACE, " ").encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])

    def home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _C4) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging a and b; _NONE if there is no such piece."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -2
        at = self.home(key)
        rank, merged = np.full(key.shape, _NONE, np.int32), np.zeros(key.shape, np.int32)
        left = None  # all
        for _ in range(self.probes):
            here = self.keys[at]
            ok = here == key
            got = self.merged[at[ok]]
            if left is None:
                merged[ok], rank[ok] = got, self.rank[got]
                left = np.flatnonzero(~ok & (here >= 0) & (key >= 0))
                key, at = key.ravel()[left], at.ravel()[left]
            else:
                merged.ravel()[left[ok]], rank.ravel()[left[ok]] = got, self.rank[got]
                more = ~ok & (here >= 0)
                left, key, at = left[more], key[more], at[more]
            if not len(left):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
        return rank, merged

    def bytes_of(self, symbols: np.ndarray) -> list[int]:
        """Ids with characters outside the vocabulary as bytes."""
        out: list[int] = []
        for s in symbols.tolist():
            out += [s] if s >= 0 else [self.byte[b] for b in chr(-1 - s).encode()]
        return out

    def merge_long(self, sym: np.ndarray, key: int | None, dropout: float) -> tuple[np.ndarray, list[int]]:
        """One unit by an agenda: the best candidate first, the leftmost of equals.  With a
        key, a candidate is skipped when its keyed hash falls below dropout.  Also the
        places of the merges made."""
        n, size, pairs = len(sym), self.size, self.pairs
        sym, end = sym.tolist(), list(range(1, n + 1))
        before, alive, heap, places = list(range(-1, n - 1)), [True] * n, [], []
        rank, merged = self.candidates(np.array(sym[:-1], np.int32), np.array(sym[1:], np.int32))
        for i in np.flatnonzero(rank < _NONE).tolist():
            heap.append((int(rank[i]), i, i + 1, i + 2, int(merged[i])))
        heapq.heapify(heap)
        low, full = int(limit_of(dropout)), (1 << 64) - 1
        c1, c2, c3 = int(_C1), int(_C2), int(_C3)

        def add(i, j):
            if sym[i] >= 0 and sym[j] >= 0:
                m = pairs.get(sym[i] * size + sym[j])
                if m is not None:
                    heapq.heappush(heap, (int(self.rank[m]), i, j, end[j], m))

        while heap:
            _, i, j, e, m = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and end[i] == j and end[j] == e):
                continue
            where = (i * c1 + j * c2 + e * c3) & full
            if key is not None and int(mix(np.array([where ^ key], np.uint64))[0]) < low:
                continue
            places.append(where)
            sym[i], end[i], alive[j] = m, e, False
            if e < n:
                before[e] = i
            if before[i] >= 0:
                add(before[i], i)
            if e < n:
                add(i, e)
        return np.array([s for s, a in zip(sym, alive, strict=True) if a], np.int32), places

    def merge_many(self, sym: np.ndarray, lengths: np.ndarray, key: np.ndarray | None, dropout: float):
        """The same for many units side by side: sym [units, width].  Each round takes every
        unit's best candidate; places stay where they are, merged ones drop out.  Returns
        symbols, which places are left, and (unit, place) of all merges made."""
        units, width = sym.shape
        left = np.arange(width) < lengths[:, None]
        if width < 2 or not units:
            return sym, left, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sym, left = np.ascontiguousarray(sym).ravel(), left.ravel()
        column = np.arange(width, dtype=np.int64)
        rank, merged = self.candidates(sym.reshape(units, width)[:, :-1], sym.reshape(units, width)[:, 1:])
        grid = np.full((units, width), _NONE, np.int32)
        grid[:, :-1] = np.where(column[1:] < lengths[:, None], rank, _NONE)
        result = np.zeros((units, width), np.int32)
        result[:, :-1] = merged
        result = result.ravel()
        after = np.tile(column + 1, units)
        prior = np.tile(column - 1, units)
        rows = np.arange(units)
        limit, owners, places = limit_of(dropout), [], []
        flat = grid.ravel()
        while len(rows):
            i = grid[rows].argmin(1) if len(rows) < units else grid.argmin(1)
            base = rows * width
            go = flat[base + i] < _NONE
            if not go.all():
                rows, i, base = rows[go], i[go], base[go]
                if not len(rows):
                    break
            at = base + i
            j = after[at]
            e = after[base + j]
            where = place(i, j, e)
            if key is not None:
                skip = mix(where ^ key[rows]) < limit
                flat[at[skip]] = _NONE
                ok = ~skip
                i, j, e, at, base, mine = i[ok], j[ok], e[ok], at[ok], base[ok], rows[ok]
            else:
                mine = rows
                owners.append(mine)
                places.append(where)
            gone = base + j
            sym[at] = result[at]
            left[gone] = False
            flat[gone] = _NONE
            after[at] = e
            inner = e < width
            prior[(base + e)[inner]] = i[inner]
            more = e < lengths[mine]
            nxt = base + np.minimum(e, width - 1)
            before = prior[at]
            has = before >= 0
            prev = base + np.maximum(before, 0)
            r, m = self.candidates(sym[np.concatenate([at, prev])], sym[np.concatenate([nxt, at])])
            k = len(at)
            flat[at] = np.where(more, r[:k], _NONE)
            result[at] = m[:k]
            flat[prev[has]] = r[k:][has]
            result[prev[has]] = m[k:][has]
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        owners, places = (np.concatenate(owners), np.concatenate(places)) if owners else none
        return sym.reshape(units, width), left.reshape(units, width), owners, places

    def symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters of all units, one unit after another; their lengths."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        return self.chars[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)], lengths

    def merge(self, data: np.ndarray, first: np.ndarray, lengths: np.ndarray, key: np.ndarray | None, dropout: float):
        """Units data[first : first + length] merged: ids, one unit after another, how many
        each has; without keys also the places of their merges and how many each has."""
        done, single, size = [], {}, np.zeros(len(lengths), np.int64)
        owners, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for low, high in zip((0, *_WIDTHS), _WIDTHS, strict=False):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            for some in np.array_split(which, max(1, len(which) // 8_000)):
                if not len(some):
                    continue
                at = np.minimum(first[some][:, None] + np.arange(high), len(data) - 1)
                sym = np.where(np.arange(high) < lengths[some][:, None], data[at], -1).astype(np.int32)
                got, left, owner, where = self.merge_many(sym, lengths[some], None if key is None else key[some], dropout)
                owners.append(some[owner])
                places.append(where)
                odd = ((got < 0) & left).any(1)
                for i in np.flatnonzero(odd).tolist():
                    single[int(some[i])] = self.bytes_of(got[i][left[i]])
                done.append((some[~odd], got[~odd][left[~odd]]))
                size[some] = left.sum(1)
        for u in np.flatnonzero(lengths > SIDE_BY_SIDE).tolist():
            got, where = self.merge_long(data[first[u] : first[u] + lengths[u]], None if key is None else int(key[u]), dropout)
            single[u] = self.bytes_of(got)
            owners.append(np.full(len(where), u, np.int64))
            places.append(np.array(where, np.uint64))
        for u, ids in single.items():
            size[u] = len(ids)
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int32)
        for some, flat in done:
            out[ragged(start[some], size[some])] = flat
        for u, ids in single.items():
            out[start[u] : start[u] + len(ids)] = ids
        owners, places = np.concatenate(owners), np.concatenate(places)
        return out, size, places[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(lengths))

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes joined, without the blank put before the text."""
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8")[1:]


class Runs:
    """Arrays of different lengths by number, one after another."""

    def __init__(self, kind):
        self.flat, self.start, self.size = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[at], self.size[at])]


class Encoder:
    """Encodes texts.  Each occurrence of a unit has its own key, from its document's key and
    its place there.  What a unit becomes without a skip is kept, with the places of its
    merges: an occurrence of which none is skipped has these ids; others are merged anew."""

    def __init__(self, tables: Tables, dropout: float, limit: int = 120_000):
        self.tables, self.dropout, self.vocabulary = tables, dropout, Vocabulary(limit)
        self.clear()

    def clear(self) -> None:
        self.ids, self.places, self.symbols = Runs(np.int32), Runs(np.uint64), Runs(np.int32)

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units = [_UNIT.findall(" " + t) if t else [] for t in texts]
        count = np.fromiter(map(len, units), np.int64, len(units))
        at, found, fresh = self.vocabulary.number([u for x in units for u in x])
        if fresh:
            self.clear()
        if found:
            data, lengths = self.tables.symbols(found)
            ids, size, places, made = self.tables.merge(data, np.cumsum(lengths) - lengths, lengths, None, 0.0)
            self.ids.add(ids, size)
            self.places.add(places, made)
            self.symbols.add(data, lengths)
        first = np.cumsum(count) - count
        each = self.ids.size[at]
        other = np.zeros(0, np.int64)
        if self.dropout > 0 and len(at):
            place_in_text = np.arange(len(at)) - np.repeat(first, count)
            own = mix(np.repeat(keys, count) + place_in_text.astype(np.uint64) * _C2)
            made = self.places.size[at]
            skipped = np.zeros(len(at), bool)
            for s in range(0, len(at), 100_000):
                part = slice(s, s + 100_000)
                skip = mix(self.places.take(at[part]) ^ np.repeat(own[part], made[part])) < limit_of(self.dropout)
                skipped[s + np.repeat(np.arange(len(made[part])), made[part])[skip]] = True
            other = np.flatnonzero(skipped)
        size = each.copy()
        if len(other):
            ids, size[other], *_ = self.tables.merge(self.symbols.flat, self.symbols.start[at[other]], self.symbols.size[at[other]], own[other], self.dropout)
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int32)
        if len(other):
            same = np.flatnonzero(~skipped)
            out[ragged(start[same], size[same])] = self.ids.take(at[same])
            out[ragged(start[other], size[other])] = ids
        else:
            out = self.ids.take(at)
        sums = np.append(0, np.cumsum(size))
        return out, sums[first + count] - sums[first]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_file: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids and lossless (ids decode to the text) of all rows.

    Pieces are merged best score first; each candidate merge (a span and its cut within a
    unit of blanks and the characters after them) that comes up is skipped when a hash
    keyed by seed, document id and the unit's place in the text falls below dropout.  So
    every occurrence of a word is segmented for itself, and a document always alike.
    Without dropout the result equals the library's.  Characters outside the vocabulary,
    and the blank mark itself, are bytes.

    Null and empty texts give no ids and are lossless (null is read as empty); null
    doc_ids share one key; repeated rows give repeated results; texts of any length are
    encoded whole; other columns are ignored; an empty table gives no rows.  The model
    file is read on the driver and its tables are broadcast (about 10 MB).
    """
    small_batches(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(Tables(model_file or default_model()))
    schema = "doc_id long, n_pieces long, ids array<int>, lossless boolean"

    def run(batches):
        t = tables.value
        encoder = Encoder(t, dropout)
        for batch in batches:
            pdf = batch.to_pandas()
            for a, b in chunks(pdf):
                part = pdf.iloc[a:b]
                texts = [x or "" for x in part["text"]]
                ids, count = encoder.encode(texts, part["key"].to_numpy(np.int64).view(np.uint64))
                ends = np.cumsum(count)
                ok = [t.decode(ids[e - n : e].tolist()) == x for x, e, n in zip(texts, ends, count, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(count), lists, pa.array(ok, pa.bool_())], ["doc_id", "n_pieces", "ids", "lossless"])

    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key")).mapInArrow(tidy(run), schema)
