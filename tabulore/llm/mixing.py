"""Mixing sources to target weights by the cube method.

Each source has a target, and so a share `target / size` of itself to take, up to `most`: its whole part is how often
every document is taken, the rest the probability with which it is taken once more. The cube method draws those:
the probabilities of three documents move along the null space of the constraints, (sizes, ones), until one of them is
0 or 1, so a source's totals of words and documents stay as they are. A source is cut into blocks of about BLOCK
documents by a hash of the id; a block leaves at most two documents undecided; they are gathered into blocks again,
until a source has one block. There the flight stops before the last LANDING documents, whose sizes halve from one to the next; these
and the at most two still open are the landing problem: of all their roundings the one nearest to the total of words is taken.

The draw depends on ids, sizes and the seed alone, so reruns agree, however the table is partitioned. Rows that repeat an
id are alike but for their sizes; those of an id with over BLOCK rows are counted by size and numbered, and so
dealt over the blocks.

Defined results: a null text has size 0; a null source is a source, the last. Repeated rows are drawn one by one. With
no words at all nothing is taken. An empty table gives no rows. Only the id column is kept by mix().
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulore.llm.common import LEAST_FREQUENT, cut, in_groups

BLOCK, LANDING, EPSILON = 20_000, 12, 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the total by weight; what is over `most` times a source's size is shared out again among the others."""
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        shares = {i: rest * weights[i] / total for i in free}
        over = {i for i in free if shares[i] > most * sizes[i]}
        if not over:
            for i, share in shares.items():
                out[i] = share
            break
        for i in over:
            out[i] = most * float(sizes[i])
            rest -= out[i]
        free -= over
    return out


def flight(sizes: list[float], chances: list[float], draw: random.Random, leave: int = 0) -> list[float]:
    """The chances after the flight phase: all 0 or 1 but two at most, and the last `leave` that were open."""
    out, active = list(chances), []
    left = [i for i, c in enumerate(chances) if EPSILON < c < 1 - EPSILON]
    left = left[len(left) - min(leave, len(left)) :]
    for i, chance in enumerate(chances[: left[0]] if left else chances):
        if EPSILON < chance < 1 - EPSILON:
            active.append(i)
        else:
            out[i] = float(round(chance))
        while len(active) == 3:
            a, b, c = active
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - out[k]) / x if x > 0 else out[k] / -x for k, x in zip(active, u) if x)
            down = min(out[k] / x if x > 0 else (1 - out[k]) / -x for k, x in zip(active, u) if x)
            by = up if draw.random() * (up + down) < down else -down
            for k, x in zip(active, u):
                out[k] += by * x
            settled = [k for k in active if not EPSILON < out[k] < 1 - EPSILON]
            for k in settled:
                out[k] = float(round(out[k]))
            active = [k for k in active if k not in settled]
    return out


def landing_last(sizes: np.ndarray) -> np.ndarray:
    """An order of documents: at its end LANDING of them at most, the largest no longer than half of the longest, the next no
    longer than a quarter, and so on, so that some of them make up for any total."""
    order, last = np.argsort(-sizes, kind="stable"), []
    for k in range(1, LANDING + 1 if len(sizes) else 1):
        at = max(int(np.searchsorted(-sizes[order], -sizes.max() / 2**k)), last[-1] + 1 if last else 0)
        if at >= len(order):
            break
        last.append(at)
    return np.concatenate([np.delete(order, last), order[last]]).astype(np.int64)


def land(sizes: list[float], chances: list[float], draw: random.Random) -> list[float]:
    """Whole numbers for the few that are left: the nearest total of sizes, then of documents, then a draw."""
    open_ = [i for i, c in enumerate(chances) if EPSILON < c < 1 - EPSILON]
    picks = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    moved = picks - np.array([chances[i] for i in open_])
    miss = np.round(np.abs(moved @ np.array([sizes[i] for i in open_])), 6)
    documents = np.round(np.abs(moved.sum(axis=1)), 6)
    best = np.flatnonzero(miss == miss.min())
    best = best[documents[best] == documents[best].min()]
    out = list(chances)
    for i, p in zip(open_, picks[best[draw.randrange(len(best))]].tolist()):
        out[i] = float(p)
    return out


def numbered(units: DataFrame) -> DataFrame:
    """units with `copy`: 0, but for ids with more than BLOCK rows, which a Misra-Gries summary (freqItems) names."""
    name = F.coalesce(F.concat(F.lit("="), "id"), F.lit("null"))
    units = units.withColumn("name", name)
    candidates = units.freqItems(["name"], 1 / LEAST_FREQUENT).select(F.explode("name_freqItems").alias("name")).distinct()
    often = cut(units.join(F.broadcast(candidates), "name").groupBy("name").count().filter(F.col("count") > BLOCK).select("name"))
    if often.isEmpty():
        return units.drop("name").withColumn("copy", F.lit(0).cast("long"))
    columns = [c for c in units.columns if c != "name"]
    alone = units.join(F.broadcast(often), "name", "left_anti").select(*columns, F.lit(0).cast("long").alias("copy"))
    counted = units.join(F.broadcast(often), "name").groupBy(*columns).count()
    parts = counted.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(BLOCK).cast("long")))).repartition("id", "size", "at")
    return alone.unionByName(parts.select(*columns, F.explode(F.sequence(F.col("at"), F.least(F.col("at") + BLOCK, F.col("count")) - 1)).alias("copy")))


def draws(units: DataFrame, documents: dict[int, int], seed: int) -> DataFrame:
    """units (id, source, size, chance) with `extra` 0 or 1. documents: how many units each source has."""
    units = numbered(units)
    schema = units.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    blocks, level, done = {s: -(-n // BLOCK) for s, n in documents.items()}, 0, None

    def run_at(level: int, last: set[int]):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            source, key = int(group["source"].iloc[0]), int(group["block"].iloc[0])
            draw = random.Random(f"{seed} {level} {key}")
            if source in last:
                group = group.iloc[landing_last(group["size"].to_numpy())]
            sizes = group["size"].astype(float).tolist()
            chances = flight(sizes, group["chance"].tolist(), draw, LANDING if source in last else 0)
            group = group.assign(chance=np.array(land(sizes, chances, draw) if source in last else chances))
            return group.drop(columns="block")

        return run

    while True:
        last = {s for s, n in blocks.items() if n <= 1}
        # a row for each source
        by_source = F.broadcast(units.sparkSession.createDataFrame([(s, max(1, n)) for s, n in blocks.items()], "source int, blocks long"))
        block = F.shiftleft(F.col("source").cast("long"), 32) + F.pmod(F.xxhash64("id", "copy", F.lit(level)), F.col("blocks"))
        dealt = units.join(by_source, "source").withColumn("block", block).select(*units.columns, "block")
        moved = cut(in_groups(dealt, "block", ["id", "size", "chance", "copy"], run_at(level, last), schema))
        whole = moved.filter(F.col("chance").isin(0.0, 1.0))
        done = whole if done is None else done.unionByName(whole)
        units = moved.filter(~F.col("chance").isin(0.0, 1.0))
        blocks = {s: -(-2 * n // BLOCK) for s, n in blocks.items() if s not in last}
        if not blocks:
            return done.withColumn("extra", F.col("chance").cast("int"))
        level += 1


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 0, max_sources: int = 100_000) -> DataFrame:
    """id, source_size, target, size, copies of every row. weights repeat over the sources in code-point order."""
    rows = cut(docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("_source"), (word_count(F.col("text")) if size is None else size).alias("size")))
    found = rows.groupBy("_source").agg(F.sum("size").alias("n"), F.count("*").alias("documents")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources")
    found.sort(key=lambda r: (r["_source"] is None, r["_source"]))
    aims = targets([r["n"] for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    table, documents = [], {}
    for i, (row, aim) in enumerate(zip(found, aims)):
        share = aim / row["n"] if row["n"] else 0.0
        whole = int(share + EPSILON)
        chance = share - whole if share - whole > EPSILON else 0.0
        table.append((row["_source"], i, int(row["n"]), aim, whole, chance))
        if chance:
            documents[i] = row["documents"]
    kind = docs.schema[source_col].dataType.simpleString()
    known = docs.sparkSession.createDataFrame(table, f"_key {kind}, source int, source_size long, target double, whole int, chance double")
    joined = rows.join(F.broadcast(known), F.col("_source").eqNullSafe(F.col("_key"))).drop("_key", "_source")
    sure = joined.filter("chance = 0").withColumn("copies", F.col("whole"))
    if documents:
        drawn = draws(joined.filter("chance > 0").select("id", "source", "size", "chance"), documents, seed)
        drawn = drawn.drop("chance").join(F.broadcast(known.drop("_key")), "source").withColumn("copies", F.col("whole") + F.col("extra"))
        sure = sure.select("id", "size", "source_size", "target", "copies").unionByName(drawn.select("id", "size", "source_size", "target", "copies"))
    return sure.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "size", "source_size", "target", "copies")
