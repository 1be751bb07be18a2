"""Sharding by histogram sort, in DataFrame operations only. Law `bytes`: sizes near equal.

Rows are ordered by a hash of the text, then by doc_id: equal texts lie together. Groups of equal texts above WHOLE of a shard are
found by descending the hash's prefixes, counting exactly in each round and keeping those that hold so much: at most
shards / WHOLE prefixes a round. Each of them, the largest first, goes whole into the shard with the most room, as long as it fits
there; one that fits nowhere is cut at doc_ids, by the same search, as the law can't be held otherwise. All other texts fill the
room that is left, in order of the hash: splitters between shards are found by probing, each round counting, exactly and over all
partitions, the bytes below 2**BITS candidate keys in the interval of every splitter not yet settled, and narrowing it, until a
probe is within TOLERANCE of a shard's size or the interval holds one key. Groups up to WHOLE of a shard are therefore never cut.
Rows are exchanged once, by shard and fine range of keys, and numbered there; the ranges' counts give the offsets, so no shard
has to fit a task.

Edge cases. A null text has size 8, the crc32 of an empty text (0) and groups with other null and empty texts. Repeated rows have
slots of their own, next to each other in no fixed order. A null doc_id sorts first. An empty table gives an empty result. Shards
can be empty where there are fewer texts than shards. Further columns are not read.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import read, stored

SHARDS, BITS, TOLERANCE, WHOLE, FINE = 24, 6, 0.002, 0.05, 32
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def prefix(column: str, bits: int) -> F.Column:
    """The first bits of a signed number, in its order: those of the number with its sign bit turned, unsigned."""
    return F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(LOW)), 64 - bits)


def search(rows: DataFrame, column: str, targets: list[float], slack: float) -> list[tuple[int, int, int, int]]:
    """For each target of bytes: (lower key, bytes below it, upper key, bytes below it), with target between them.

    A round counts, for all open intervals at once, the bytes of their 2**BITS parts, all of them probes' intervals of one length:
    one aggregation to at most targets * 2**BITS rows. An interval is settled when an end is within slack of the target, or
    when it holds a single key. The upper key is one more than the interval's last.
    """
    state = {k: (0, 0, None) for k in range(len(targets))}  # prefix, bytes below, bytes in it
    done, bits = {}, 0
    while state and bits < 64:
        step = min(BITS, 64 - bits)
        part = prefix(column, bits + step).bitwiseAND(F.lit((1 << step) - 1))
        inside = rows.where(prefix(column, bits).isin([p for p, _, _ in state.values()])) if bits else rows
        key = prefix(column, bits) if bits else F.lit(0).cast("long")
        found = {(r["p"], r["q"]): r["b"] for r in inside.groupBy(key.alias("p"), part.alias("q")).agg(F.sum("size").alias("b")).collect()}
        bits += step
        for k, (p, b, _) in list(state.items()):
            filled = [q for q in range(1 << step) if (p, q) in found]
            if not filled:
                done[k] = (LOW, 0, LOW, 0)
                del state[k]
                continue
            for q in filled:
                more = found[p, q]
                if targets[k] < b + more or q == filled[-1]:
                    break
                b += more
            p = p << step | q
            state[k] = (p, b, more)
            if min(targets[k] - b, b + more - targets[k]) <= slack or bits == 64:
                done[k] = ((p << 64 - bits) + LOW, b, (p + 1 << 64 - bits) + LOW, b + more)
                del state[k]
    return [done[k] for k in range(len(targets))]


def heavy(rows: DataFrame, least: float) -> dict[int, int]:
    """key -> bytes of every key with more than `least` bytes; the caller bounds their number by the total over least."""
    alive, bits = {0: 0}, 0
    while alive and bits < 64:
        step = min(BITS, 64 - bits)
        inside = rows.where(prefix("key", bits).isin(list(alive))) if bits else rows
        bits += step
        found = inside.groupBy(prefix("key", bits).alias("p")).agg(F.sum("size").alias("b")).where(F.col("b") > least).collect()
        alive = {r["p"]: r["b"] for r in found}
    # prefix() turns the sign bit, so that 64 of its bits are the key with that bit turned, read as signed.
    return {p ^ LOW: b for p, b in alive.items()}


def dealt(groups: dict[int, int], shards: int, share: float, slack: float) -> tuple[dict[int, list[tuple[int, float]]], list[float]]:
    """key -> its (shard, bytes) in order, and the room left in each shard. The largest group goes first, into the shard with
    the most room; what doesn't fit there goes on as a group of its own. Ties go to the smaller key and shard."""
    room = [(-share, s) for s in range(shards)]
    queue = [(-b, k) for k, b in groups.items()]
    heapq.heapify(queue)
    out: dict[int, list[tuple[int, float]]] = {}
    while queue:
        size, key = heapq.heappop(queue)
        free, s = room[0]
        part = size if -size <= -free + slack or -free <= slack else free
        out.setdefault(key, []).append((s, -part))
        heapq.heapreplace(room, (free - part, s))
        if part != size:
            heapq.heappush(queue, (size - part, key))
    left = [0.0] * shards
    for free, s in room:
        left[s] = max(-free, 0.0)
    return out, left


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, whole: float = WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The largest key is kept free, as the end of the last interval.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.least(F.xxhash64(text), F.lit(HIGH - 1)).alias("key"))
    rows = stored(rows.withColumn("id", F.coalesce("doc_id", F.lit(LOW)).cast("long")), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    slack = tolerance * share
    groups = heavy(rows, whole * share) if total else {}  # fewer than shards / whole
    places, room = dealt(groups, shards, share, slack)
    light = rows.where(~F.col("key").isin(list(groups))) if groups else rows
    rest = total - sum(groups.values())
    scale = rest / sum(room) if sum(room) else 0.0
    targets = [scale * t for t in accumulate(room[:-1])]
    cuts = []  # a shard begins with the first key not below its cut
    for t, (lo, b, hi, e) in zip(targets, search(light, "key", targets, slack) if rest else [], strict=False):
        cuts.append(lo if t - b <= e - t else hi)
    pieces: dict[int, list[tuple[int, int]]] = {}  # (first id, shard) of what a group is cut into
    for key, at in places.items():
        if len(at) > 1:  # fewer than shards pieces besides the first of each
            ends = list(accumulate(b for _, b in at[:-1]))
            found = search(rows.where(F.col("key") == key), "id", ends, slack)
            starts = [lo if t - b <= e - t else hi for t, (lo, b, hi, e) in zip(ends, found, strict=True)]
            pieces[key] = list(zip(starts, (s for s, _ in at[1:]), strict=True))
    return exchanged(rows, cuts, {k: at[0][0] for k, at in places.items()}, pieces)


def exchanged(rows: DataFrame, cuts: list[int], groups: dict[int, int], pieces: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """The one exchange: by shard and fine range; slots from the row number there and the counts of the ranges before."""
    number = F.lit(0)
    for key in cuts:  # one comparison for each of a fixed number of shards
        number = number + (F.col("key") >= key).cast("int")
    if groups:
        at = F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*map(F.lit, groups.values())))
        number = F.when(F.col("key").isin(list(groups)), F.try_element_at(at, F.col("key"))).otherwise(number)
    for key, parts in pieces.items():
        for first, s in parts:
            number = F.when((F.col("key") == key) & (F.col("id") >= F.lit(min(first, HIGH))), F.lit(s)).otherwise(number)
    # Ranges of equal width in the hash, and parts by a hash of the id, so that a hot text's rows are numbered in several tasks.
    fine = F.floor((F.col("key") / 2.0**64 + 0.5) * FINE * 24)
    inner = F.pmod(F.xxhash64("id"), F.lit(FINE))
    placed = rows.withColumn("shard", number.cast("int")).withColumn("fine", fine).withColumn("inner", inner)
    w = Window.partitionBy("shard", "fine", "inner").orderBy("key", "id")
    counts = placed.groupBy("shard", "fine", "inner").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("fine", "inner").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    out = placed.withColumn("row", F.row_number().over(w)).join(F.broadcast(before), ["shard", "fine", "inner"])  # at most FINE * FINE * 25 rows and FINE for each group
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
