"""Packing items into containers of a fixed capacity: a grouping genetic algorithm on islands.

A solution is a set of containers; the first ones take the items in random
order.  Crossover takes whole well-filled containers of one parent into a copy
of the other, drops the containers that would hold an item twice, and puts the
displaced items back by best fit, largest first.  The fitness is the number of
containers, then the mean squared fill.  Items are cut into shards of about
``SHARD`` items; every shard evolves on ``ISLANDS`` islands, which send their
best solution to the next island between the rounds.  An island stops a few
generations after it reaches the least number of containers that the sizes
allow.  Containers left badly filled are opened and packed again across the
shards.

Defined results: items larger than the capacity fill whole containers and
leave one part for packing, no other item is split; items of size 0 (null and
empty texts) go into the first container of their shard; ties are broken by
id, and equal input gives equal output; an empty table gives no rows; items
that repeat an id are packed once per row, numbered by ``copy``.
"""

from __future__ import annotations

import bisect
import math
import random
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.encode import TOKENIZER_DIR, VOCABULARY, encoding
from gridloom.sources.tables import checkpoint, spread

CAPACITY = 2048
SHARD = 1000  # items of a shard on average
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 3, 2, 12, 6
GATHER = 2  # generations after the least number is reached, which gather the room left in few containers
WELL_FILLED = 0.97  # containers below are opened for the last pass


def token_sizes(df: DataFrame, key: str, field: str, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, size): tokens of each text, 0 for null and empty ones."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(folder, vocabulary)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    rows = spread(df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(field).cast("string"), F.lit("")).alias("text")))
    return rows.select("id", count("text").alias("size"))


def best_fit(items: Iterable[int], sizes: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Add items in their order to the fullest containers that hold them; opens new ones."""
    order = sorted((r, b) for b, r in enumerate(room))
    for i in items:
        at = bisect.bisect_left(order, (sizes[i], -1))
        if at == len(order):
            bins.append([i])
            room.append(capacity - sizes[i])
            bisect.insort(order, (room[-1], len(bins) - 1))
        else:
            r, b = order.pop(at)
            bins[b].append(i)
            room[b] = r - sizes[i]
            bisect.insort(order, (room[b], b))


def decreasing(items: Iterable[int], sizes: list[int]) -> list[int]:
    """Largest item first; ties by place."""
    return sorted(items, key=lambda i: (-sizes[i], i))


def fitness(room: list[int], capacity: int) -> float:
    return sum(((capacity - r) / capacity) ** 2 for r in room) / len(room) if room else 1.0


def _of_assignment(assign: list[int], sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(assign):
        bins.setdefault(b, []).append(i)
    out = [bins[b] for b in sorted(bins)]
    return out, [capacity - sum(sizes[i] for i in b) for b in out]


def crossover(a, b, sizes: list[int], capacity: int, rng: random.Random):
    """A child of ``a`` with some of the best filled containers of ``b``."""
    (bins_a, room_a), (bins_b, room_b) = a, b
    order = sorted(range(len(bins_b)), key=lambda k: (room_b[k], k))
    top = order[: max(1, len(order) // 2)]
    taken = rng.sample(top, max(1, len(top) // 2))
    gone = {i for k in taken for i in bins_b[k]}
    bins, room, loose = [list(bins_b[k]) for k in taken], [room_b[k] for k in taken], []
    for content, r in zip(bins_a, room_a):
        if gone.isdisjoint(content):
            bins.append(list(content))
            room.append(r)
        else:
            loose += [i for i in content if i not in gone]
    worst = max(range(len(bins)), key=lambda k: (room[k], k))  # mutation: open the emptiest container as well
    if len(bins) > 1:
        loose += bins.pop(worst)
        room.pop(worst)
    best_fit(decreasing(loose, sizes), sizes, bins, room, capacity)
    return bins, room


def search(sizes: list[int], capacity: int, guests: list[list[int]], seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> tuple[list[int], int]:
    """Container of each item after one round on one island, and the number of crossovers; ``guests`` are solutions that came from elsewhere.

    The first people take the items in random order.  Where half the
    generations do not reach the bound, best-fit decreasing joins them, so no
    island ends worse than that alone.
    """
    n = len(sizes)
    if n == 0:
        return [], 0
    rng = random.Random(seed)
    least = max(1, math.ceil(sum(sizes) / capacity))
    rank = lambda p: (len(p[0]), -fitness(p[1], capacity))
    people = sorted((_of_assignment(g, sizes, capacity) for g in guests), key=rank)

    def settle(items: list[int]) -> None:
        bins: list[list[int]] = []
        room: list[int] = []
        best_fit(items, sizes, bins, room, capacity)
        people.append((bins, room))

    while len(people) < population:
        settle(rng.sample(range(n), n))
    crossings = gathered = 0
    for turn in range(generations):
        people.sort(key=rank)
        del people[population:]
        if len(people[0][0]) <= least:
            if gathered == GATHER:
                break
            gathered += 1
        elif turn == generations // 2:
            settle(decreasing(range(n), sizes))
        a, b = people[rng.randrange(max(1, len(people) // 2))], people[rng.randrange(len(people))]
        people += [crossover(a, b, sizes, capacity, rng), crossover(b, a, sizes, capacity, rng)]
        crossings += 2
    people.sort(key=rank)
    out = [0] * n
    for k, content in enumerate(people[0][0]):
        for i in content:
            out[i] = k
    return out, crossings


def evolve(sizes: list[int], capacity: int, guests: list[list[int]], seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[int]:
    """The containers of :func:`search`."""
    return search(sizes, capacity, guests, seed, generations, population)[0]


def _evolved(state: DataFrame, capacity: int, turn: int) -> DataFrame:
    """One round on every island; ``own`` and ``guest`` are assignments or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = []
            for shard, island, sizes, mine, guest in zip(b["shard"], b["island"], b["sizes"], b["own"], b["guest"]):
                guests = [list(map(int, g)) for g in (mine, guest) if g is not None]
                own.append(evolve(list(map(int, sizes)), capacity, guests, hash((int(shard), int(island), turn)) & 0xFFFFFFFF))
            yield pd.DataFrame({"shard": b["shard"], "island": b["island"], "own": own})

    # small rows with much work each
    return spread(state.select("shard", "island", "sizes", "own", "guest")).mapInPandas(run, "shard bigint, island int, own array<int>")


def _pack_shards(items: DataFrame, capacity: int, islands: int, rounds: int) -> DataFrame:
    """(id, copy, part, size, shard, bin) for items (id, copy, part, size, shard)."""
    spark = items.sparkSession
    shards = items.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("id", "copy", "part", "size"))).alias("items"))
    shards = checkpoint(shards, spark)  # about SHARD items in a row
    sizes = shards.select("shard", F.col("items.size").alias("sizes"))
    none = F.lit(None).cast("array<int>")
    state = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("own", none).withColumn("guest", none)
    done = checkpoint(_evolved(state, capacity, 0), spark)
    for turn in range(1, rounds):
        guest = done.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("own").alias("guest"))
        done = checkpoint(_evolved(done.join(guest, ["shard", "island"]).join(sizes, "shard"), capacity, turn), spark)
    best = done.groupBy("shard").agg(F.min_by("own", F.struct(F.array_max("own"), "island")).alias("own"))
    flat = shards.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", F.col("own").alias("own"))).alias("z"))
    return flat.select("z.items.*", "shard", F.col("z.own").alias("bin"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """(id, copy, part, size, container, filled): every item, or part of an oversized one, in its container.

    ``sizes`` has id and size.  ``container`` is a text; ``filled`` is the
    container's content.  Part 0 is the whole item or what is left of an
    oversized one, parts 1, 2, ... fill whole containers.
    """
    spark = sizes.sparkSession
    numbered = sizes.where("id is not null").withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("size")) - 1)
    numbered = checkpoint(numbered.select("id", "copy", F.col("size").cast("int").alias("size")), spark)
    whole = numbered.where(F.col("size") >= capacity).select("id", "copy", F.explode(F.sequence(F.lit(1), F.floor(F.col("size") / capacity).cast("int"))).alias("part"))
    whole = whole.select("id", "copy", "part", F.lit(capacity).alias("size"), F.concat_ws("-", F.lit("w"), "id", "copy", "part").alias("container"), F.lit(capacity).cast("bigint").alias("filled"))
    rest = numbered.select("id", "copy", F.lit(0).alias("part"), F.pmod("size", F.lit(capacity)).alias("size"), (F.col("size") >= capacity).alias("large")).where("size > 0 or not large").drop("large")

    def sharded(items: DataFrame, n: int, salt: int) -> DataFrame:
        return items.withColumn("shard", F.pmod(F.xxhash64("id", "copy", F.lit(salt)), F.lit(max(1, math.ceil(n / shard)))))

    first = _pack_shards(sharded(rest, rest.count(), 0), capacity, islands, rounds)
    by_bin = Window.partitionBy("shard", "bin")
    first = checkpoint(first.withColumn("filled", F.sum("size").over(by_bin)), spark)
    good = first.where(F.col("filled") >= WELL_FILLED * capacity)
    open_ = first.where(F.col("filled") < WELL_FILLED * capacity).drop("shard", "bin", "filled")
    n = open_.count()
    second = _pack_shards(sharded(open_, n, 1), capacity, islands, rounds).withColumn("filled", F.sum("size").over(by_bin))
    name = lambda d, tag: d.select("id", "copy", "part", "size", F.concat_ws("-", F.lit(tag), "shard", "bin").alias("container"), F.col("filled").cast("bigint").alias("filled"))
    return whole.unionByName(name(good, "a")).unionByName(name(second, "b"))
