"""A trie of conversation prefixes, with totals of its subtrees rolled up by bands of depth.

Turns are numbered by a sort that deals ranges, and only digests of them move. A sequence is cut into
bands of HEIGHT turns at the same depths everywhere. Inside a band, a node's id is chained from the
band's root; the ids of the roots are those of a trie over whole bands, which is HEIGHT times less
deep and made the same way. So a sequence of any length takes log(length) rounds, and no group holds
more than one band of one conversation.

Totals go the same way: a node adds to its ancestors inside its band only, at most HEIGHT of them,
the sums below each band root are rolled up in the trie of band roots, and what comes back for a
root passes to the band above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodemap.llm.common import numbered
from lodemap.scratch import Scratch

#: Levels of a band.
HEIGHT = 16
#: A conversation begins like the first one of its GROUP, for fewer than HEADS turns.
GROUP, HEADS = 5, 9
#: Conversation ids of one row on their way to a node's digest.
PACKED = 4096
ROOT = bytes(16)


def _digest(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of binary or string columns, one after the other."""
    return F.unhex(F.substring(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256), 1, 32))


def rebuilt(turns: DataFrame, scratch: Scratch, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, depth, digest, bytes, last) of rebuilt conversations, and (conv_id, length) of each.

    Turns are in the order of turn (null first), then role, then the digest of role and text.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    compact = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        _digest(F.sha2(role, 256), text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    own = numbered(compact, ["conv_id", F.asc_nulls_first("turn"), "role", "digest"], scratch, "numbered", within="conv_id")
    own = scratch.table(own.select("conv_id", "nth", "digest", "bytes"), "own")
    sizes = scratch.table(own.groupBy("conv_id").agg(F.max("nth").alias("n")), "sizes")
    first = own.where(F.col("nth") < heads).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "digest", "bytes"))).alias("head"))
    first = scratch.table(first, "heads")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    asked = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    plan = asked.join(first.withColumnRenamed("conv_id", "base"), "base", "left")
    plan = plan.withColumn("head", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1)).cast("int"))))
    plan = plan.withColumn("kept", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn("kept", F.greatest("kept", F.lit(0)))
    plan = plan.withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = scratch.table(plan.select("conv_id", "h", "kept", "length", "head"), "plan")
    copied = plan.select("conv_id", "length", F.inline("head")).select("conv_id", F.col("nth").alias("depth"), "digest", "bytes", "length")
    rest = own.join(plan.select("conv_id", "h", "kept", "length"), "conv_id").where("nth > h").select(
        "conv_id", (F.col("kept") + F.col("nth") - F.col("h")).alias("depth"), "digest", "bytes", "length")
    return copied.unionByName(rest).withColumn("last", F.col("depth") == F.col("length")).drop("length"), plan.select("conv_id", "length")


def _occurrences(scratch: Scratch, items: DataFrame, longest: int, level: int = 0) -> list[DataFrame]:
    """For each level of bands, its rows (conv_id, depth, id, parent, start, path) and what `items` hold besides.

    `items` has conv_id, depth and digest. `start` is the id of the band's root, `path` the ids from
    below it to the row's own.
    """
    others = [c for c in items.columns if c not in ("conv_id", "depth", "digest")]
    bands = items.groupBy("conv_id", F.floor((F.col("depth") - 1) / HEIGHT).cast("long").alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "digest", *others))).alias("items"))
    above = []
    if longest <= HEIGHT:
        bands = bands.withColumn("start", F.lit(ROOT)).withColumn("whole", F.lit(None).cast("binary"))
    else:
        bands = scratch.table(bands, f"bands{level}")
        joined = F.aggregate("items", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["digest"]))
        upper = bands.select("conv_id", (F.col("band") + 1).alias("depth"), _digest(joined).alias("digest"))
        above = _occurrences(scratch, upper, -(-longest // HEIGHT), level + 1)
        roots = above[0].select("conv_id", (F.col("depth") - 1).alias("band"), F.col("parent").alias("start"), F.col("id").alias("whole"))
        bands = bands.join(roots, ["conv_id", "band"])
    # a band's last node has the id that the trie above gives it, so that the next band starts from it
    chain = F.aggregate("items", F.array(F.col("start")), lambda ids, x: F.concat(ids, F.array(
        F.when((F.size(ids) == HEIGHT) & F.col("whole").isNotNull(), F.col("whole")).otherwise(_digest(F.element_at(ids, -1), x["digest"])))))
    rows = bands.select("conv_id", "start", F.col("items"), chain.alias("ids")).select(
        "conv_id", "start", "ids", F.posexplode("items").alias("i", "item"))
    rows = rows.select(
        "conv_id", "item.depth", *[f"item.{c}" for c in others], "start", F.col("ids")[F.col("i")].alias("parent"),
        F.col("ids")[F.col("i") + 1].alias("id"), F.slice("ids", F.lit(2), F.col("i") + 1).alias("path"))
    return [scratch.table(rows, f"rows{level}"), *above]


def _rolled(levels: list[DataFrame], values: DataFrame, columns: list[str]) -> DataFrame:
    """id and `columns` of every node summed over its subtree below the root of all, from values (id, `columns`)."""
    sums = [F.sum(c).alias(c) for c in columns]
    here = levels[0].join(values, "id")
    if len(levels) > 1:
        below = here.where(F.col("start") != F.lit(ROOT)).groupBy(F.col("start").alias("id")).agg(*sums)
        deep = _rolled(levels[1:], below, columns).select("id", *[F.col(c).alias(f"deep_{c}") for c in columns])
        here = here.join(deep, "id", "left").select("path", *[(F.col(c) + F.coalesce(f"deep_{c}", F.lit(0))).alias(c) for c in columns])
    return here.select(F.explode("path").alias("id"), *columns).groupBy("id").agg(*sums)


def _member_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """id, ends_sha256 of rows (id, conv_id). Runs are packed where they are sorted; one pass over the
    packs of a node feeds its digest, so that no list of members is ever held."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, convs = batch.column("id").to_pylist(), batch.column("conv_id").to_pylist()
            out, s = ([], [], []), 0
            while s < len(ids):
                e = s + 1
                while e < len(ids) and e - s < PACKED and ids[e] == ids[s]:
                    e += 1
                for column, value in zip(out, (ids[s], convs[s], ",".join(map(str, convs[s:e])))):
                    column.append(value)
                s = e
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["id", "first", "packed"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = ([], [])
            for name, packed in zip(batch.column("id").to_pylist(), batch.column("packed").to_pylist()):
                if name != node:
                    if state:
                        done[0].append(node)
                        done[1].append(state.hexdigest())
                    node, state = name, hashlib.sha256(packed.encode())
                else:
                    state.update(b"," + packed.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["id", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    ranged = ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    packs = scratch.table(ranged.mapInArrow(pack, "id binary, first long, packed string"), "packs")
    return packs.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digest, "id binary, ends_sha256 string")


def trie(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Conversation c takes the first h = crc32(c) % `heads` turns of c - c % `group` (all, if it has fewer;
    none, if there is no such conversation) and its own turns after its first h. Null roles and texts
    are empty. Turns of one number are ordered by role, then by digest; repeated rows are turns of
    their own. Rows without conv_id are left out, and a table without others has no nodes. Columns
    but conv_id, turn, role and text are not read. Nodes are told apart by 128 bits of SHA-256.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    sequences, lengths = rebuilt(turns, scratch, group, heads)
    convs, lowest, longest = lengths.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("length")).first()
    occurrences = _occurrences(scratch, sequences, longest or 0)
    levels = [occurrences[0].groupBy("id").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        *[F.first(c).alias(c) for c in ("depth", "parent", "bytes", "start", "path")])]
    levels += [upper.groupBy("id").agg(F.first("start").alias("start"), F.first("path").alias("path")) for upper in occurrences[1:]]
    levels = [scratch.table(level, f"level{k}") for k, level in enumerate(levels)]
    nodes = levels[0].select("id", "n_convs", "conv_id", "depth", "parent", "bytes")
    children = scratch.table(nodes.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    values = nodes.join(children, "id", "left").select(
        "id", F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    values = scratch.table(values, "values")
    paths = [level.select("id", "start", "path") for level in levels]
    totals = _rolled(paths, values, ["n_leaves", "saved_tokens"])
    whole = values.agg(F.lit(ROOT).alias("id"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"),
                       F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = turns.sparkSession.range(1 if convs else 0).select(
        F.lit(ROOT).alias("id"), F.lit(convs).cast("long").alias("n_convs"), F.lit(lowest).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"))
    every = scratch.table(nodes.drop("bytes").unionByName(root), "nodes")
    totals = scratch.table(totals.unionByName(whole), "totals")
    ends = occurrences[0].where("last").select("id", "conv_id").unionByName(lengths.where("length = 0").select(F.lit(ROOT).alias("id"), "conv_id"))
    digests = scratch.table(_member_digests(ends, scratch), "digests")
    parents = every.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = every.join(parents, "parent", "left")  # two scans: a node with very many children is split
    out = named.join(children, "id", "left").join(totals, "id").join(digests, "id", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
