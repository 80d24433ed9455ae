"""Sharding by balanced label propagation: linked documents gather, sizes stay even.

Documents start in shards by a hash of their id.  Links come as groups (here: equal texts); all
documents of a group are neighbours.  The documents of one group in one shard are interchangeable,
so the state is a table of blocks (group, shard, count), never the links.  Each round joins a group's
blocks: a block moves towards the shard where most of its neighbours are, among those that have room or
whose own blocks may leave, and the shards admit the moves that gain most until that is used up, the
last one in part.
Shards hold floor(n / shards) or one more row in the end: what is above the quota and all documents
without neighbours fill the rows that are left.

Null texts count as empty.  Repeated rows are documents of their own.  With fewer rows than shards
some shards are empty; an empty table gives an empty result.  Other columns are ignored.  Only
built-in functions are used; to the driver go one row per shard and round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, ranked, running, salts_for, text_or_empty, written

SHARDS, ROUNDS = 24, 6


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _loads(blocks: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """By shard: its rows, and those of blocks that aren't their group's largest; and how gathered all are."""
    own = F.struct(F.col("n"), (-F.col("shard")).alias("s"))
    marked = blocks.withColumn("best", F.max(own).over(Window.partitionBy("key")))
    loose = F.sum(F.when(F.col("best") > own, F.col("n")).otherwise(0))
    found = {r["shard"]: r for r in marked.groupBy("shard").agg(F.sum("n").alias("n"), loose.alias("loose"), F.sum(F.col("n").cast("double") ** 2).alias("gathered")).collect()}
    rows = [found.get(j) for j in range(shards)]
    return [r["n"] if r else 0 for r in rows], [r["loose"] if r else 0 for r in rows], sum(r["gathered"] for r in rows if r)


def _taken(moves: DataFrame, most: Column, falling: bool, by: str) -> DataFrame:
    """``moves`` with ``took``: each shard's moves are served in the order of ``by`` (as a power of
    two), until ``most`` is reached."""
    grade = F.floor(F.log2(F.col(by).cast("double"))).cast("int")
    parts = [("-_grade" if falling else "_grade", grade), ("_salt", F.pmod(F.xxhash64("key"), F.lit(64)).cast("int"))]
    queued = running(moves, ["at"], parts, [F.col("key"), F.col("shard")], F.col("n"), "_before")
    return queued.withColumn("took", F.greatest(F.lit(0), F.least(F.col("n"), most - F.col("_before")))).where("took > 0").drop("_before")


def _moved(blocks: DataFrame, taken: DataFrame) -> DataFrame:
    """``blocks`` after ``taken`` (key, shard, at, took) left ``shard`` for ``at``."""
    changes = taken.select("key", "shard", (-F.col("took")).alias("n")).union(taken.select("key", F.col("at").alias("shard"), F.col("took").alias("n")))
    return blocks.union(changes).groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def propagate(blocks: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """Blocks (key, shard, n) after label propagation, and the shards' loads; shard -1 holds what was
    above the quotas."""
    shards, of_group = len(quotas), Window.partitionBy("key")
    own = F.struct(F.col("n"), (-F.col("shard")).alias("s"))
    blocks = written(blocks)
    loads, loose, gathered = _loads(blocks, shards)
    for k in range(rounds):
        # What may leave a shard this round makes room too, but in the last round.
        room = _array([q - n + (out if k < rounds - 1 else 0) for q, n, out in zip(quotas, loads, loose, strict=True)])
        best = blocks.withColumn("best", F.max(F.when(F.element_at(room, F.col("shard") + 1) > 0, own)).over(of_group)).where(F.col("best") > own)
        moves = best.select("key", "shard", "n", (-F.col("best.s")).cast("int").alias("at"), F.col("best.n").alias("gain"))
        new = written(_moved(blocks, _taken(moves, F.element_at(room, F.col("at") + 1), True, "gain").select("key", "shard", "at", "took")))
        forget(blocks)
        blocks, before = new, (loads, gathered)
        loads, loose, gathered = _loads(blocks, shards)
        if before == (loads, gathered):
            break
    above = F.element_at(_array([n - q for q, n in zip(quotas, loads, strict=True)]), F.col("shard") + 1)
    surplus = _taken(blocks.withColumn("at", F.col("shard")), above, False, "n").select("key", "shard", F.lit(-1).alias("at"), "took")
    done = written(_moved(blocks, surplus))
    forget(blocks)
    return done, [min(q, n) for q, n in zip(quotas, loads, strict=True)]


def _pick(rank: Column, stops: list[int]) -> Column:
    """The first shard whose stop lies above ``rank``."""
    out = F.lit(None).cast("int")
    for shard in range(len(stops) - 1, -1, -1):
        out = F.when(rank < stops[shard], F.lit(shard)).otherwise(out)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot (gapless from 0) of every document; law ``rows``."""
    text = text_or_empty(text_col)
    rows = written(docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"), F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard")))
    counts = rows.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))
    linked = counts.withColumn("all", F.sum("n").over(Window.partitionBy("key"))).where("all > 1").select("key", "shard", "n")
    total = rows.count()
    quotas = [total // shards + (j < total % shards) for j in range(shards)]
    blocks, loads = propagate(linked, quotas, rounds)
    # A group's rows are dealt out by rank: each block takes the next n of them.
    stops = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("blocks"))
    salts, order = salts_for(total), [F.col(id_col), F.col("size")]
    placed = ranked(rows.drop("shard"), ["key"], order, salts, "_rank", [F.col(id_col)], stops)
    nothing = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("shard"))

    def step(acc: Column, b: Column) -> Column:
        upto = acc["upto"] + b["n"]
        return F.struct(upto.alias("upto"), F.when(acc["shard"].isNull() & (F.col("_rank") < upto), b["shard"]).otherwise(acc["shard"]).alias("shard"))

    placed = placed.withColumn("_label", F.coalesce(F.aggregate("blocks", nothing, step, lambda a: a["shard"]), F.lit(-1))).drop("blocks", "_rank", "key")
    # Rows without a label (alone, or above the quotas) fill what the shards have left.
    stop, free = 0, []
    for q, n in zip(quotas, loads, strict=True):
        stop += q - n
        free.append(stop)
    filled = ranked(placed, ["_label"], order, salts, "_rank", [F.col(id_col)])
    filled = filled.select(id_col, "size", "text_crc32", F.when(F.col("_label") < 0, _pick(F.col("_rank"), free)).otherwise(F.col("_label")).alias("shard"))
    return ranked(filled, ["shard"], order, salts, "slot", [F.col(id_col)])
