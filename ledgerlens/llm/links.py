"""From band hashes to components: shared by the near-duplicate operators.

A bucket (all items with one band hash) is never expanded into all pairs. Its members meet its centre
first, the member that shares most buckets: of a group of copies that is the one nearest to all. Links
confirmed on whole sets join components. A member that the centre does not hold may still be linked to
another member y, and if so, both differ from the centre in much the same way: with d the symmetric
difference to the centre, |x ^ y| = |dx ^ dy|, so a link needs so many shared elements of dx and dy that
their rarest elements already meet. Only pairs that share one of those are checked, and no link that
could join two components is missed.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm import codes
from ledgerlens.llm.tables import small, stage


def buckets(bands: DataFrame) -> DataFrame:
    """bands (id, bands array<long>; an id may come more than once): the members (b, id) of every bucket with two ids or more."""
    rows = bands.select("id", F.explode("bands").alias("b"))
    shared = rows.groupBy("b").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("b")
    return rows.join(shared, "b").select("b", "id").distinct()


def centred(members: DataFrame) -> DataFrame:
    """Pairs (x, r) of each member with the centre of its bucket, the one with the most company."""
    sizes = members.groupBy("b").agg(F.count("*").alias("n"))
    company = members.join(sizes, "b").groupBy("id").agg(F.sum("n").alias("company"))
    centre = (members.join(company, "id").groupBy("b").agg(F.max(F.struct("company", (-F.col("id")).alias("low"))).alias("m"))
              .select("b", (-F.col("m.low")).alias("r")))
    return members.join(centre, "b").where("id != r").select(F.col("id").alias("x"), "r").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (x, y): (id, comp) for every id in an edge; comp is the smallest id reachable.

    Alternates two steps until nothing changes: every larger neighbour of an id, then every smaller one,
    is tied to the smallest neighbour known. Each round is a stage table; a chain halves per round."""
    cur = stage(edges.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), name)
    before = None
    while True:
        n, total = cur.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == before:
            return cur.select(F.col("x").alias("id"), F.col("y").alias("comp")).unionByName(
                cur.select(F.col("y").alias("id"), F.col("y").alias("comp"))).groupBy("id").agg(F.min("comp").alias("comp"))
        before = (n, total)
        both = cur.select("x", "y").unionByName(cur.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        floor = large.groupBy("x").agg(F.min("y").alias("m"))
        tied = large.join(floor, "x").where("y != m").select(F.greatest("y", "m").alias("x"), F.least("y", "m").alias("y"))
        cur = stage(tied.unionByName(floor.select("x", F.col("m").alias("y"))).distinct(), name)


def open_groups(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (x, r, cx, cr) of centres with several members of which some are in another component."""
    named = (pairs.join(comps.select(F.col("id").alias("x"), F.col("comp").alias("cx")), "x", "left")
             .join(comps.select(F.col("id").alias("r"), F.col("comp").alias("cr")), "r", "left")
             .select("x", "r", F.coalesce("cx", "x").alias("cx"), F.coalesce("cr", "r").alias("cr")))
    mixed = named.groupBy("r").agg(F.count("*").alias("n"), F.max((F.col("cx") != F.col("cr")).cast("int")).alias("open")).where("n > 1 and open = 1").select("r")
    return named.join(mixed, "r")


def alike(different: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different components, members of one centre, that may be linked.
    different: (x, r, cx, cr, nx, nr, delta), the elements in one of x and r only, their set sizes and components."""
    c = (100 - percent) / (100 + percent)
    size = F.size("delta")
    each = different.select("x", "r", "cx", "cr", "nx", "nr", size.alias("d"), F.explode("delta").alias("e"))
    often = each.groupBy("r", "e").agg(F.count("*").alias("often"))
    ranked = each.join(often, ["r", "e"]).withColumn("rank", F.row_number().over(W.partitionBy("x", "r").orderBy("often", "e"))).where("often > 1")
    # how many elements a link must share at least, whoever the other is
    as_left = F.greatest(F.lit(1), F.ceil(F.col("d") - c * F.col("nx") * (1 + 100 / percent) - 1e-9))
    as_right = F.greatest(F.lit(1), F.floor((F.col("d") - c * (F.col("nx") - F.col("nr")) - 1e-9) / 2) + 1)
    left = ranked.where((F.col("cx") != F.col("cr")) & (F.col("rank") <= F.col("d") - as_left + 1)).select("r", "e", "x", "cx", "nx", F.col("d").alias("dx"), F.col("rank").alias("i"))
    right = ranked.where(F.col("rank") <= F.col("d") - as_right + 1).select("r", "e", F.col("x").alias("y"), F.col("cx").alias("cy"), F.col("nx").alias("ny"), F.col("d").alias("dy"), F.col("rank").alias("j"))
    # what two may still share from the first common element on must be enough for their own sizes
    enough = F.least(F.col("dx") - F.col("i"), F.col("dy") - F.col("j")) + 1 >= (F.col("dx") + F.col("dy") - c * (F.col("nx") + F.col("ny"))) / 2 - 1e-9
    fits = (F.col("cx") != F.col("cy")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & enough
    return left.join(right, ["r", "e"]).where(fits).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def _sets(texts: list[str], width: int) -> dict[str, np.ndarray]:
    distinct = list(dict.fromkeys(texts))  # a centre meets many
    _, _, hashes, first, _ = codes.words(distinct)
    return {t: codes.shingles(hashes[a:b], width) for t, a, b in zip(distinct, first[:-1], first[1:])}


def _linked(width, percent):
    def run(batches):
        for batch in batches:
            tx, ty = batch.column("tx").to_pylist(), batch.column("ty").to_pylist()
            sets = _sets(tx + ty, width)
            keep = []
            for a, b in zip(map(sets.get, tx), map(sets.get, ty)):
                both = codes.shared(a, b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))
    return run


def _different(width):
    def run(batches):
        for batch in batches:
            tx, ty = batch.column("tx").to_pylist(), batch.column("ty").to_pylist()
            sets = _sets(tx + ty, width)
            delta = [np.setxor1d(sets[a], sets[b], assume_unique=True).view(np.int64) for a, b in zip(tx, ty)]
            ends = np.cumsum([0] + [len(d) for d in delta]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("x"), batch.column("y"), batch.column("cx"), batch.column("cr"),
                pa.array([len(sets[t]) for t in tx], pa.int64()), pa.array([len(sets[t]) for t in ty], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(delta) if delta else [], pa.int64()))],
                names=["x", "r", "cx", "cr", "nx", "nr", "delta"])
    return run


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (x, y, more) with both texts as tx and ty; texts has (id, text)."""
    return (pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x")
            .join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y"))


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (x, y) whose texts' shingle sets share `percent` of their union."""
    return with_texts(pairs, texts).select("x", "y", "tx", "ty").mapInArrow(_linked(width, percent), "x long, y long")


def different(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (x, r, cx, cr) with their set sizes nx, nr and delta, the shingles that only one of them has."""
    return (with_texts(pairs.withColumnRenamed("r", "y"), texts).select("x", "y", "cx", "cr", "tx", "ty")
            .mapInArrow(_different(width), "x long, r long, cx long, cr long, nx long, nr long, delta array<long>"))


def resolve(bands: DataFrame, percent: int, width: int, fetch: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """Components (id, comp) and confirmed links (x, y) of the items whose shingle sets share `percent` of their union.
    fetch gives the texts (id, text) of the ids of a DataFrame; only those of items that share a bucket are asked for."""
    members = stage(buckets(bands), f"{name}-buckets")
    texts = stage(fetch(small(stage(members.select("id").distinct(), f"{name}-wanted"))), f"{name}-texts")
    first = stage(centred(members), f"{name}-pairs")
    edges = stage(linked(first.withColumnRenamed("r", "y"), texts, width, percent), f"{name}-links")
    comps = stage(components(edges, f"{name}-cc"), f"{name}-first")
    apart = stage(different(stage(open_groups(first, comps), f"{name}-open"), texts, width), f"{name}-apart")
    more = stage(linked(stage(alike(apart, percent), f"{name}-alike"), texts, width, percent), f"{name}-more")
    if more.limit(1).count() == 0:
        return comps, edges
    # what is settled already goes in as one edge an id
    tied = comps.select(F.col("id").alias("x"), F.col("comp").alias("y")).where("x != y").unionByName(more)
    return stage(components(tied, f"{name}-cc"), f"{name}-all"), edges.unionByName(more)
