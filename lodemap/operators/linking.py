"""Linking the members of overlapping groups of any size without expanding groups into pairs.

Candidate groups (lists of a shingle, buckets of a hash) hold nodes that perhaps link. Where most of a
group is near copies of each other, a few comparisons tie it together: in each round every group
compares what lies outside its largest component with a few members of that component and with one
another member, and the links found are contracted. What rounds no longer shrink is compared exactly,
outsiders against all members, in blocks of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from lodemap.operators.graph import components
from lodemap.scratch import Scratch

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Members of the largest component that an outsider is compared with in a round.
CENTRES = 3
#: Rounds end when they leave more than this share of the pairs of an outsider and a member, or at most
#: FEW such pairs for each row of the groups.
SLOW, FEW = 0.5, 8
#: Members of a block that is compared whole.
BLOCK = 256
#: Sides of a block that a row is on: outsiders, members, or both.
OUT, ALL, BOTH = 0, 1, 2

Linked = Callable[[DataFrame, str], DataFrame]
#: Whether members of sizes n and m may link.
Fits = Callable[[Column, Column], Column]


def star_rounds(members: DataFrame, linked: Linked, scratch: Scratch, known: DataFrame | None = None, fits: Fits | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Components (node, comp), tables of links (src, dst), and what is left in torn groups.

    `members` (key, node) is a written table, one row for each group and node; `linked(pairs, name)`
    returns those of distinct pairs (src < dst) that link, written; `known` are links found before. With `fits`,
    members have their size `n`, and pairs of sizes that cannot link are not made. What is left, if
    anything, is (key, node, comp, main) and the members' other columns: all members of groups of more than one
    component, with the group's largest one.
    """
    size = [] if fits is None else ["n"]
    nodes = scratch.table(members.select("node").distinct(), "star-nodes")
    comps = nodes.withColumn("comp", F.col("node"))
    if known is not None:
        comps = scratch.table(components(nodes, known), "star-comps")
    links, before, rows = [], None, members.count()
    for number in count():
        placed = scratch.table(members.join(comps, "node").select("comp", *members.columns), f"star-placed{number}")
        drawn = [F.min(F.struct(F.xxhash64(F.lit(number * CENTRES + i), "node").alias("h"), "node", *size)).alias(f"c{i}") for i in range(CENTRES)]
        parts = scratch.table(placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), *drawn), f"star-parts{number}")
        # ties between components are broken alike in all groups, so that groups agree on a centre
        largest = F.max(F.struct("n", F.xxhash64("comp").alias("h"), "comp"))
        mains = parts.groupBy("key").agg(largest.alias("largest"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("m"))
        mains = scratch.table(mains.where("kinds > 1").select("key", "m", F.col("largest.comp").alias("main"), ((F.col("m") - F.col("largest.n")) * F.col("m")).alias("left")), f"star-mains{number}")
        open_pairs = mains.agg(F.sum("left")).first()[0] or 0
        if not open_pairs:
            return comps, links, None
        if number and (open_pairs > SLOW * before or open_pairs <= FEW * rows):
            return comps, links, placed.join(mains, "key").select(*placed.columns, "main")
        before = open_pairs
        inside = F.col("comp") == F.col("main")
        centres = [F.min(F.when(inside, F.struct(f"c{i}.h", f"c{i}.node", *(f"c{i}.{c}" for c in size), "comp"))).alias(f"s{i}") for i in range(CENTRES)]
        centres.append(F.min(F.when(~inside, F.struct("c0.h", "c0.node", *(f"c0.{c}" for c in size), "comp"))).alias("other"))
        stars = parts.join(mains, "key").groupBy("key", "main").agg(*centres)
        stars = scratch.table(stars.select("key", "main", F.array_distinct(F.array(*[f"s{i}" for i in range(CENTRES)], "other")).alias("centres")), f"star-centres{number}")
        pairs = placed.join(stars, "key").where(~inside).select("node", *size, "comp", F.explode("centres").alias("c")).where(F.col("comp") != F.col("c.comp"))
        if fits is not None:
            pairs = pairs.where(fits(F.col("n"), F.col("c.n")))
        pairs = pairs.select(F.least("node", "c.node").alias("src"), F.greatest("node", "c.node").alias("dst")).distinct()
        links.append(linked(scratch.table(pairs, f"star-pairs{number}"), f"star-links{number}"))
        joined = comps.select(F.col("node").alias("src"), F.col("comp").alias("dst")).unionByName(links[-1])
        comps = scratch.table(components(nodes, joined), f"star-comps{number}")
        for old in ("placed", "parts", "mains", "centres", "pairs"):
            scratch.drop(f"star-{old}{number}")


def across(left: DataFrame, payload: list[str], may_link: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]], node: str, held: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (src < dst) of one group and different components that `may_link` lets pass.

    `left` is what `star_rounds` leaves; `payload` names columns of it or of `held`, which has a row for each node.
    Each outsider meets every member of its group once, in blocks of about BLOCK by BLOCK; a group of one block has
    each member once. `may_link` gets the tables of two sides and returns positions of pairs. `node` is the type of nodes.
    """
    # groups by their size; outsiders and members are dealt apart, so a group with few outsiders is passed over once
    outside = F.col("comp") != F.col("main")
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(outside.cast("long")).alias("out"))
    dealt = left.join(sizes.select("key", F.ceil(F.col("out") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("m") / BLOCK).cast("int").alias("cols")), "key")
    at = F.xxhash64(F.lit("block"), "node")
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    row, col = F.pmod(at, "rows"), F.pmod(at, "cols")
    outs = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: place(row, j, OUT))
    alls = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: place(i, col, ALL))
    alone = (F.col("rows") == 1) & (F.col("cols") == 1)
    places = F.when(~outside, alls).when(alone, F.array(place(F.lit(0), F.lit(0), BOTH))).otherwise(F.concat(outs, alls))
    columns = ["key", "i", "j", "side", "node", "comp", *payload]
    # one pass: what is joined here is joined once
    both = (dealt if held is None else dealt.join(held, "node")).select("*", F.inline(places)).select(columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ("key", "i", "j")):
            side = table.column("side").to_numpy()
            a, b = table.filter(pa.array(side != ALL)), table.filter(pa.array(side != OUT))
            if a.num_rows and b.num_rows:
                i, j = may_link(a, b)
                x, y = np.array(a.column("node").to_pylist(), object)[i], np.array(b.column("node").to_pylist(), object)[j]
                c, d = np.array(a.column("comp").to_pylist(), object)[i], np.array(b.column("comp").to_pylist(), object)[j]
                apart = c != d
                kind = a.schema.field("node").type
                yield pa.RecordBatch.from_arrays([pa.array(x[apart].tolist(), kind), pa.array(y[apart].tolist(), kind)], ["src", "dst"])

    found = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, f"src {node}, dst {node}")
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys (numbers) of sorted batches, whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change)]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            if b == a:
                continue
            if held and any(held[-1].column(k)[0] != batch.column(k)[int(a)] for k in key):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
