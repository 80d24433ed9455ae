"""Byte-pair vocabularies for names: learning, encoding, decoding.

Spark counts words; the merge loop is sequential by nature and runs on the driver over the table of
distinct words, held in matrices of ids, updating pair counts where a merge changed them.
The table's size is checked before it is fetched.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import decode_tokens
from ..functions.text import name_words

UNKNOWN = "<unk>"
#: Distinct words that the driver learns from at most, and that a task remembers.
MOST_WORDS, MEMO_WORDS = 10_000_000, 20_000
#: Cells of a matrix of words that a merge compares at once.
CELLS = 1 << 20
Pair = tuple[int, int]


@dataclass(frozen=True)
class Vocabulary:
    """Token texts by id, and merges (left id, right id, new id) in the order they were learned."""

    tokens: tuple[str, ...]
    merges: tuple[tuple[int, int, int], ...]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word; characters that the vocabulary lacks are dropped."""
        letters, ranks = self._tables()
        ids = [letters[c] for c in word if c in letters]
        while len(ids) > 1:
            rank, at = min((ranks.get(pair, (len(ranks), 0))[0], k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == len(ranks):
                break
            ids[at : at + 2] = [ranks[ids[at], ids[at + 1]][1]]
        return ids

    def _tables(self) -> tuple[dict, dict]:
        if "_cached" not in self.__dict__:
            letters = {t: k for k, t in enumerate(self.tokens) if len(t) == 1}
            ranks: dict = {}
            for rank, (a, b, new) in enumerate(self.merges):
                ranks.setdefault((a, b), (rank, new))
            object.__setattr__(self, "_cached", (letters, ranks))
        return self._cached

    def memo(self) -> dict[str, list[int]]:
        if "_memo" not in self.__dict__:
            object.__setattr__(self, "_memo", {})
        return self.__dict__["_memo"]

    def __getstate__(self):
        return {"tokens": self.tokens, "merges": self.merges}


def corpus(*names: Column | tuple[DataFrame, str]) -> DataFrame:
    """All names of several (table, column) pairs under ``name``, repeats kept."""
    parts = [df.select(F.col(c).alias("name")) for df, c in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def word_counts(names: DataFrame, column: str = "name") -> DataFrame:
    """word and n: how often each word or punctuation run occurs."""
    return names.select(F.explode(name_words(F.col(column))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _matrices(ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words of two symbols or more as rows of matrices, a matrix for words of about one length, and their weights.
    At least one cell after a word is -1, so that no pair reaches into the next row."""
    starts = np.cumsum(lengths) - lengths
    widths = np.where(lengths < 32, 4 * (lengths // 4 + 1), 2 ** np.ceil(np.log2(lengths + 1)).astype(np.int64))
    out = []
    for width in np.unique(widths[lengths > 1]).tolist():
        every = np.flatnonzero((widths == width) & (lengths > 1))
        step = max(1, CELLS // width)
        for k in range(0, len(every), step):
            rows, cells = every[k : k + step], np.arange(width)
            at = np.minimum(starts[rows][:, None] + cells, len(ids) - 1)
            out.append((np.where(cells < lengths[rows][:, None], ids[at], -1).astype(ids.dtype), weights[rows]))
    return out


def _pair_sums(rows: np.ndarray, weights: np.ndarray, size: int) -> Iterator[tuple[Pair, int]]:
    """The pairs in ``rows`` and their weights' sums, which may be 0; symbols are below ``size``."""
    there = rows[:, 1:] >= 0
    codes = rows[:, :-1][there].astype(np.int64) * size + rows[:, 1:][there]
    each = np.repeat(weights, there.sum(axis=1))
    if size * size <= 16 * len(codes):
        sums = np.zeros(size * size, np.int64)
        np.add.at(sums, codes, each)
        found = np.flatnonzero(sums)
        sums = sums[found]
    else:
        found, where = np.unique(codes, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, where, each)
    return (((c // size, c % size), n) for c, n in zip(found.tolist(), sums.tolist(), strict=True))


def _join(rows: np.ndarray, pair: Pair, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace ``pair`` by ``new`` wherever it occurs in ``rows``; the rows with it, as they were, and as they are."""
    flat, width = rows.reshape(-1), rows.shape[1]
    at = np.flatnonzero((flat[:-1] == pair[0]) & (flat[1:] == pair[1]))
    if pair[0] == pair[1] and len(at):  # of overlapping ones the first, third, ...
        begins = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))) % 2 == 0]
    row = at // width
    hit = row[np.r_[True, np.diff(row) > 0]] if len(row) else row
    old = rows[hit]
    flat[at], flat[at + 1] = new, -2
    held = rows[hit]
    kept = held != -2
    now = np.full_like(held, -1)
    now[np.nonzero(kept)[0], (np.cumsum(kept, axis=1) - 1)[kept]] = held[kept]
    rows[hit] = now
    return hit, old, now


def train(counts: Iterable[tuple[str, int]], vocab_size: int = 1000) -> Vocabulary:
    """Learn a vocabulary: ``<unk>``, every character in code point order, then merges.

    Each step joins the most frequent adjacent pair, of equal ones that of the smallest ids; a joined
    text that is a token already keeps its id.  It ends at ``vocab_size`` tokens or without pairs.
    """
    kept = [(w, n) for w, n in counts if w]
    return train_words(pa.array([w for w, _ in kept], pa.string()), np.array([n for _, n in kept], np.int64), vocab_size)


def train_words(words: pa.StringArray, weights: np.ndarray, vocab_size: int = 1000) -> Vocabulary:
    """``train`` on words that aren't empty, in an Arrow array, and how often each occurs.

    Words are rows of matrices of ids.  A merge compares neighbouring cells of all of them at once; only rows
    that it touches take their old pairs back and add their new ones."""
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = np.flatnonzero(np.bincount(points))
    tokens = [UNKNOWN, *map(chr, letters.tolist())]
    ids = {t: k for k, t in enumerate(tokens)}
    size = max(vocab_size, len(tokens))
    code = np.zeros(int(letters.max(initial=0)) + 1, np.int16 if size < 1 << 15 else np.int32)
    code[letters] = np.arange(1, len(tokens))
    numbers = code[points]
    matrices = _matrices(numbers, pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64), weights)
    del text, points, numbers
    pairs: Counter = Counter()
    for rows, weight in matrices:
        for pair, n in _pair_sums(rows, weight, size):
            pairs[pair] += n
    heap = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int]] = []
    while heap and len(tokens) < vocab_size:
        n, pair = heapq.heappop(heap)
        if -n != pairs[pair] or not n:
            continue  # counted anew since
        text = tokens[pair[0]] + tokens[pair[1]]
        new = ids.get(text)
        if new is None:
            new = ids[text] = len(tokens)
            tokens.append(text)
        merges.append((*pair, new))
        touched = set()
        for rows, weight in matrices:
            hit, old, now = _join(rows, pair, new)
            if len(hit):
                for p, d in _pair_sums(np.concatenate([old, now]), np.concatenate([-weight[hit], weight[hit]]), size):
                    if d:
                        pairs[p] += d
                        touched.add(p)
        pairs.pop(pair, None)
        for p in touched - {pair}:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))
    return Vocabulary(tuple(tokens), tuple(merges))


def fetched(counts: DataFrame) -> tuple[pa.StringArray, np.ndarray]:
    """word and n of ``counts`` on the driver, partition by partition: a task packs each Arrow batch into one row."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"data": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    parts = [pa.ipc.open_stream(bytes(r["data"])).read_all() for r in counts.where("word != ''").select("word", "n").mapInArrow(packed, "data binary").toLocalIterator()]
    if not parts:
        return pa.array([], pa.string()), np.array([], np.int64)
    table = pa.concat_tables(parts)
    return table["word"].combine_chunks().cast(pa.string()), table["n"].to_numpy().astype(np.int64)


def learn(names: DataFrame, column: str = "name", vocab_size: int = 1000, least: int = 1, most_words: int = MOST_WORDS) -> Vocabulary:
    """Count words with Spark, then ``train`` on those that occur ``least`` times or more.

    More than ``most_words`` of these are an error, not a sample: raise ``least`` then.
    """
    words, weights = fetched(word_counts(names, column).where(F.col("n") >= least).limit(most_words + 1))
    if len(words) > most_words:
        raise ValueError(f"over {most_words} distinct words occur {least} times or more: raise least")
    return train_words(words, weights, vocab_size)


def encode(vocabulary: Vocabulary, name: Column) -> Column:
    """Token ids of ``name``: words by expression, ids by an Arrow UDF that remembers words for as long
    as its task runs."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(words: pa.Array) -> pa.Array:
        seen = vocabulary.memo()
        offsets, out = [], []
        for k in range(len(words)):
            found = words[k].as_py()  # a row at a time: the batch's words aren't all Python objects at once
            offsets.append(None if found is None else len(out))
            for w in found or ():
                if w not in seen:
                    if len(seen) >= MEMO_WORDS:
                        seen.clear()
                    seen[w] = vocabulary.encode_word(w)
                out += seen[w]
        return pa.ListArray.from_arrays(pa.array([*offsets, len(out)], pa.int32()), pa.array(out, pa.int32()))

    return ids(name_words(name))


def vocabulary_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    return spark.createDataFrame(pa.table({"token_id": pa.array(range(len(vocabulary.tokens)), pa.int32()), "token": pa.array(vocabulary.tokens, pa.string())}))


def merges_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    rows = [(k, *m) for k, m in enumerate(vocabulary.merges)]
    names = ("rank", "left_id", "right_id", "new_id")
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], pa.int32()) for k, name in enumerate(names)}))


def load_vocabulary(tokens: DataFrame, merges: DataFrame) -> Vocabulary:
    """From their tables, both bounded by the vocabulary's size."""
    return Vocabulary(tuple(r["token"] for r in tokens.orderBy("token_id").collect()), tuple((r["left_id"], r["right_id"], r["new_id"]) for r in merges.orderBy("rank").collect()))


def token_map(vocabulary: DataFrame) -> Column:
    """The vocabulary table as a map literal."""
    pairs = [F.lit(x) for r in vocabulary.collect() for x in (r["token_id"], r["token"])]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<int,string>")


def decode(ids: Column, vocabulary: DataFrame) -> Column:
    return decode_tokens(ids, token_map(vocabulary))


def decode_joined(df: DataFrame, row_id: str, ids: str, vocabulary: DataFrame) -> DataFrame:
    """row id and ``text``, by a join with the vocabulary instead of a map: for large vocabularies."""
    each = df.select(row_id, F.posexplode_outer(ids).alias("_at", "_token"))
    joined = each.join(vocabulary, each["_token"] == vocabulary["token_id"], "left")
    shown = F.when(F.col("_token").isNull(), F.lit("")).otherwise(F.coalesce(F.nullif("token", F.lit("")), F.concat(F.lit("<UNK:"), F.col("_token").cast("string"), F.lit(">"))))
    return joined.groupBy(row_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", shown.alias("s")))), lambda x: x["s"]), "").alias("text"))


def tokenize_table(df: DataFrame, vocabulary: Vocabulary, keep_original: bool = False, packing: str = "blob") -> DataFrame:
    """``df`` with every ``*_name`` column replaced by (or, if kept, followed by) ``*_name_tokens``."""
    from ..functions.codec import tokens_to_blob, tokens_to_csv

    pack = {"blob": tokens_to_blob, "csv": tokens_to_csv}[packing]
    out = []
    for name in df.columns:
        if not name.endswith("_name"):
            out.append(F.col(name))
            continue
        if keep_original:
            out.append(F.col(name))
        out.append(pack(encode(vocabulary, F.col(name))).alias(f"{name}_tokens"))
    return df.select(*out)
