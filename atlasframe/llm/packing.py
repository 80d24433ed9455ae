"""Best-fit packing of tokenised documents into fixed-size sequences.

Only the histogram of piece lengths (at most ``capacity`` counters) decides which lengths share a
sequence, so it alone goes to the driver.  Martello and Toth's dominance criterion first fixes sets
of pieces that some optimal packing contains; best fit packs what is left, one pattern (and all its
repetitions) at a time.  The pieces then find their places by their rank within their length.

Null texts count as empty; an empty document is one piece that holds the closing id alone.  Equal or
repeated rows each get a place of their own.  An empty table gives an empty result.  Input columns
other than the id and the text are ignored, so their names can't clash.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, salts_for, slices, written

#: Entries that each of a worker's two caches holds at most.
CACHE_ENTRIES = 300_000
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Chunks(dict):
    """Ids (as little-endian unsigned 32-bit bytes) of a stretch of text without spaces.

    The pre-tokenizer never joins what white space separates, so a text's ids are those of its
    stretches.  A stretch of Latin-1 letters and closing ASCII punctuation goes straight to the
    library's model, word and punctuation apart; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.chars, self.words = self.tokenizer.model, _byte_chars(), {}

    def _piece(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word.encode().decode("latin-1").translate(self.chars)
            ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
            if len(self.words) < CACHE_ENTRIES and len(word) < 64:
                self.words[word] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            ids = b""
        elif m := _PLAIN.fullmatch(chunk):
            ids = self._piece(m[1].lower()) + (self._piece(m[2]) if m[2] else b"")
        else:
            ids = np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) < CACHE_ENTRIES and len(chunk) < 64:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 (and ids, if asked for).

    ``tokenizer`` is the path of a ``tokenizers`` file with the byte-level, word-end layout; every
    text is followed by id 0; only what is longer than ``capacity`` is cut.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    names = [f.name for f in fields] + ["ids"] * with_ids
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    size = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(tokenizer)
        for batch in slices(batches):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = chunks.ids(text or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names)

    return docs.select(id_col, text_col).mapInArrow(cut, T.StructType(fields))


class _Stock:
    """Counts by length, with the largest length that is left below a bound."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {k: n for k, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.remove(size)

    def largest(self, most: int) -> int:
        """The largest length of at most ``most``; 0 if there is none."""
        at = bisect_right(self.sizes, most)
        return self.sizes[at - 1] if at else 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest pieces, one piece of length ``without`` set aside."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.count[size] - (size == without))
            if len(out) == n:
                break
        return out


def _times(stock: _Stock, pattern: list[int]) -> int:
    return min(stock.count[s] // pattern.count(s) for s in set(pattern))


def reduce_instance(stock: _Stock, capacity: int) -> list[tuple[list[int], int]]:
    """Fix sets that dominate every other set with the same largest piece, with how often.

    A set dominates another if the other's pieces can be shared out so that each share fits in the
    place of one piece of the set; some optimal packing then holds it.
    """
    fixed: list[tuple[list[int], int]] = []

    def fix(pattern: list[int]) -> None:
        n = _times(stock, pattern)
        for size in pattern:
            stock.take(size, n)
        fixed.append((pattern, n))

    if capacity in stock.count:
        fix([capacity])
    for size in [s for s in stock.sizes if 2 * s <= capacity]:  # a pair that fills a sequence: all else fits in the partner's place
        other = capacity - size
        if size in stock.count and other in stock.count and (size != other or stock.count[size] > 1):
            fix([other, size])
    for size in stock.sizes[::-1]:
        while size in stock.count:
            room, least = capacity - size, stock.smallest(3, size)
            if not least or least[0] > room:  # nothing fits beside it
                fix([size])
                continue
            partner = stock.largest(room)
            if partner == size and stock.count[size] == 1:
                partner = stock.largest(size - 1)
            if len(least) == 1 or least[0] + least[1] > room:  # one more piece at most: the largest
                fix([size, partner])
                continue
            if len(least) == 3 and sum(least) <= room:
                break
            best = _best_pair(stock, size, room)  # two more at most: the largest single if no pair is worth more
            if partner < best[0] + best[1]:
                break
            fix([size, partner])
    return fixed


def _best_pair(stock: _Stock, size: int, room: int) -> tuple[int, int]:
    """The two pieces of the largest sum that fits in ``room``, one piece of ``size`` set aside."""
    best = (0, 0)
    left = {s: n - (s == size) for s, n in stock.count.items()}
    for a in stock.sizes:
        if 2 * a > room or not left[a]:
            continue
        b = stock.largest(room - a)
        while b and (left[b] - (a == b)) < 1:
            b = stock.largest(b - 1)
        if b and a + b > sum(best):
            best = (a, b)
    return best


def best_fit(stock: _Stock, capacity: int) -> list[tuple[list[int], int]]:
    """Fill one sequence after another from its largest piece: a piece, or two, that fill the rest
    exactly, else the largest piece that fits; each pattern is repeated while the stock lasts."""
    out: list[tuple[list[int], int]] = []
    while stock.sizes:
        pattern, used = [], {}
        room = capacity

        def left(s: int) -> int:
            return stock.count.get(s, 0) - used.get(s, 0)

        def put(s: int) -> None:
            nonlocal room
            pattern.append(s)
            used[s] = used.get(s, 0) + 1
            room -= s

        put(stock.sizes[-1])
        while room >= stock.sizes[0]:
            if left(room):
                put(room)
                break
            pair = next((a for a in stock.sizes[bisect_right(stock.sizes, room) - 1 :: -1] if 2 * a >= room and room > a and left(a) and left(room - a) and (2 * a != room or left(a) > 1)), 0)
            if pair:
                rest = room - pair
                put(pair)
                put(rest)
                break
            s = stock.largest(room)
            while s and not left(s):
                s = stock.largest(s - 1)
            if not s:
                break
            put(s)
        n = _times(stock, pattern)
        for s in pattern:
            stock.take(s, n)
        out.append((pattern, n))
    return out


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in their order) with how many sequences have each."""
    stock = _Stock(histogram)
    return reduce_instance(stock, capacity) + best_fit(stock, capacity)


def _slots(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first rank, sequence, offset and copies per sequence of each stretch of ranks."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in plan:
        offset = 0
        for size in dict.fromkeys(pattern):
            copies = pattern.count(size)
            rows.setdefault(size, []).append((used.get(size, 0), sequence, offset, copies))
            used[size] = used.get(size, 0) + n * copies
            offset += size * copies
        sequence += n
    return {size: tuple(np.asarray(c, dtype=np.int64) for c in zip(*r, strict=True)) for size, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (of ``token_pieces``) with sequence_id and offset.

    ``pieces`` is written to the shared folder first: tokenising happens once, the histogram and the
    placing both read the narrow table.  A length that a third of all pieces share is ranked in
    salted parts.  To the driver go at most ``capacity`` counters.
    """
    pieces = written(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan_packing(histogram, capacity))
    placed = ranked(pieces, ["length"], [F.col(id_col), F.col("piece"), F.col("ids_crc32")], salts_for(sum(histogram.values())), "_rank", [F.col(id_col), F.col("piece")])
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                at = np.nonzero(length == size)[0]
                first, base, place0, copies = slots[int(size)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[k]
                sequence[at] = base[k] + within // copies[k]
                offset[at] = place0[k] + within % copies[k] * size
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    return placed.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise whole documents and pack their pieces; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), capacity, id_col)
