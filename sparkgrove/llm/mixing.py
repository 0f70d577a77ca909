"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words; a document is taken floor(f) times for sure, f = target / size of the source,
and once more with probability f - floor(f). The cube method moves these probabilities through the null space of two
balancing equations per source, words and documents, until each is 0 or 1 but for at most two. It runs in blocks of
bounded size, dealt by a hash of the document; the at most two undecided units of each block make up the blocks of the
next round, and so on until every source fits one block. Its last units are a landing problem that is solved by trying
all rounded combinations.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import ranked
from .common import WS, cut

#: Documents of a block of the flight phase.
BLOCK = 512
#: Rows of the table of sources that are broadcast at most; a larger one is joined by shuffle.
BROADCAST_SOURCES = 1_000_000
#: Equal rows that one task numbers at a time.
CHUNK = 65_536
WEIGHTS = (5, 2, 1)


def word_count(text) -> F.Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a string column; null: 0.

    Every word's start is a non-white code point behind a white one, so marking the white runs leaves word + 1 pieces.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " "))
    return F.when(bare == "", F.lit(0)).otherwise(F.length(bare) - F.length(F.translate(bare, " ", "")) + 1).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: share of all sizes dealt by the repeating weights over the sources by code point (null last).

    A target stops at `most` times its source's size; the excess is dealt again by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, active = share * sum(sizes.values()), {}, list(names)
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in active}
        for s in over:
            out[s] = most * sizes[s]
        left = max(0.0, left - sum(out[s] for s in over))
        active = [s for s in active if s not in out]
    return out


def flight(size: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """Cube flight over units in the given order: chances after it, all 0 or 1 but for at most two.

    Keeps the sums of size * chance and of chance.
    """
    out = list(chance)
    window = [i for i, x in enumerate(out) if 0 < x < 1]
    if len(window) < 3:
        return out
    rest = iter(window[3:])
    a, b, c = window[:3]
    while True:
        u, v, w = size[b] - size[c], size[c] - size[a], size[a] - size[b]  # null space of rows (size) and (1)
        if u == 0 and v == 0:  # three equal sizes: two of them are enough
            u, v, w = 1.0, -1.0, 0.0
        up = down = math.inf
        for x, d in ((out[a], u), (out[b], v), (out[c], w)):
            if d > 0:
                up, down = min(up, (1 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, -x / d), min(down, -(1 - x) / d)
        step = up if rng.random() * (up + down) < down else -down
        live = []
        near = []
        for i, d in ((a, u), (b, v), (c, w)):
            x = out[i] + step * d
            out[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            if 0 < out[i] < 1:
                live.append(i)
            near.append(i)
        if len(live) == 3:  # rounding kept all three inside; put the nearest one on its bound
            i = min(near, key=lambda k: min(out[k], 1 - out[k]))
            out[i] = float(round(out[i]))
            live.remove(i)
        while len(live) < 3:
            following = next(rest, None)
            if following is None:
                return out
            live.append(following)
        a, b, c = live


def landing(size: list[float], chance: list[float], goal: float) -> list[int]:
    """0 or 1 for each of the few units left, with the sum of sizes nearest goal, then the count nearest sum(chance)."""
    want = sum(chance)
    best = min(range(1 << len(size)), key=lambda m: (abs(sum(s for i, s in enumerate(size) if m >> i & 1) - goal), abs(m.bit_count() - want), m))
    return [best >> i & 1 for i in range(len(size))]


def aims(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (src, source_size, n; one row each) with `target`: what targets() gives, for any number of sources.

    A source stops at `most` times its size when size / weight is below a level; each pass over the sources raises that level until no
    further source stops.
    """
    at = ranked(sources, [F.col("src").isNull(), F.col("src")], "at")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    state = cut(at.select("src", "source_size", "n", F.get(turn, (F.col("at") % len(weights)).cast("int")).alias("w")))
    stops, count = F.lit(False), 0
    while True:
        over = F.when(stops, F.col("source_size")).otherwise(0)
        seen = state.agg(F.sum("source_size").alias("all"), F.sum(over).alias("over"), F.sum(F.when(stops, 0).otherwise(F.col("w"))).alias("w"), F.count_if(stops).alias("k")).first()
        left, total = max(0.0, share * (seen["all"] or 0) - most * (seen["over"] or 0)), float(seen["w"] or 0)
        if count and seen["k"] <= count or not total:
            break
        count = seen["k"]
        beyond = F.lit(left) * F.col("w") / F.lit(total) > F.lit(most) * F.col("source_size")
        if count == 0 and state.where(beyond).isEmpty():
            break
        stops = beyond
    open_ = F.lit(left) * F.col("w") / F.lit(total or 1.0)
    return state.select("src", "source_size", "n", F.when(stops, F.lit(most) * F.col("source_size")).otherwise(open_).alias("target"))


def told_apart(doc: DataFrame) -> DataFrame:
    """doc (id, src, size) with `nth`: equal rows are numbered from 0, the largest groups of them in chunks of their own."""
    same = doc.groupBy("id", "src", "size").agg(F.count(F.lit(1)).alias("c"))
    one = same.where("c = 1").select("id", "src", "size", F.lit(0).cast("long").alias("nth"))
    chunk = same.where("c > 1").select("id", "src", "size", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(CHUNK).cast("long"))).alias("from")).repartition("id", "src", "size", "from")
    many = chunk.select("id", "src", "size", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("c")) - 1)).alias("nth"))
    return one.unionByName(many)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """key, source, size, source_size, target and copies (0 up to `most`, rounded up) of every row of df.

    Null text: size 0. Null source: a source of its own, last in order. Keys may be null and of any type that can be grouped; rows that are
    equal in key, source and size are told apart by a number, so they may get different copies. Empty table: no rows. Sources whose
    words are all in empty texts have target 0. Blocks depend on the rows alone, so reruns agree however the input is partitioned.
    """
    doc = cut(told_apart(df.select(df[key].alias("id"), df[source].alias("src"), word_count(df[text]).alias("size"))))
    sources = cut(aims(doc.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most))
    seen = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("n")).first()
    plan = sources.select(F.col("src").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("f"), F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long").alias("blocks"))
    if seen["sources"] <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    unit = doc.join(plan, doc["src"].eqNullSafe(plan["s"])).select("id", "src", "size", "nth", "source_size", "target", F.floor("f").alias("sure"), (F.col("f") - F.floor("f")).alias("chance"), "blocks")

    def fly(last: bool):
        def one(group, table):
            size, chance = table.column("size").to_numpy().astype(float), table.column("chance").to_numpy()
            order = np.lexsort((table.column("tie").to_numpy(), -size))
            size, chance = size[order].tolist(), chance[order].tolist()
            out = flight(size, chance, random.Random(f"{seed}:{[k.as_py() for k in group]}:{len(size)}"))
            if last:
                open_ = [i for i, x in enumerate(out) if 0 < x < 1]
                goal = sum(s * x for s, x in zip(size, chance, strict=True)) - sum(size[i] for i, x in enumerate(out) if x == 1)
                for i, x in zip(open_, landing([size[i] for i in open_], [out[i] for i in open_], goal), strict=True):
                    out[i] = float(x)
            done = np.empty(len(out))
            done[order] = out
            return table.set_column(table.column_names.index("chance"), "chance", pa.array(done)).drop_columns(["deal", "tie"])

        return one

    done = unit.where((F.col("chance") <= 0) | (F.col("chance") >= 1))
    todo, level, blocks = unit.where((F.col("chance") > 0) & (F.col("chance") < 1)), 0, max(1, -(-(seen["n"] or 0) // block))
    while True:
        mixed = F.xxhash64(F.lit(seed + level), "id", "size", "nth")
        dealt = todo.withColumns({"deal": F.pmod(mixed, F.col("blocks")), "tie": mixed})
        flown = dealt.groupBy("src", "deal").applyInArrow(fly(blocks == 1), todo.schema)
        if blocks == 1:
            break
        flown = cut(flown)
        inside = (F.col("chance") > 0) & (F.col("chance") < 1)
        done = done.unionByName(flown.where(~inside))
        todo = flown.where(inside).withColumn("blocks", F.ceil(2 * F.col("blocks") / block).cast("long"))
        blocks, level = -(-2 * blocks // block), level + 1
    out = done.unionByName(flown)
    return out.select(F.col("id").alias(key), F.col("src").alias(source), "size", "source_size", "target", (F.col("sure") + F.round("chance")).cast("int").alias("copies"))
