"""N-gram Jaccard join by size: subsets for small sets, inverted lists for large ones.

A document's set is its distinct word shingles. Shingles have one global order, rarest first: by
the count of their rarest word, then by hash. Two sets that link share `overlap` shingles, so they
share one of the first |set| - overlap + 1 of each (its prefix), and two of a prefix one longer. Light
sets are keyed by all pairs out of the longer prefix, heavy ones by each shingle of the prefix; light
ones near the boundary are in the heavy ones' lists too. The boundary is the size with the least
cost, of keys to write and of list entries to scan, over the sizes of all documents.

Equal sets are one node of the graph. A list of up to SHORT sets gives its pairs that pass the size
and position filters. A longer list first gives a star around one set, since its sets are mostly
near copies of each other. Where that leaves a long list in more than one component, rounds of stars
around several members tie those outside its largest component to it, and what is left outside is
compared with the whole list in blocks, by parity bitmaps, which bound the overlap from above.
Pairs of different components that pass are compared by wide bitmaps, and what passes is verified. So no group is expanded into all pairs and
no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lodemap.llm.common import find, hash_words, mix, slices, tidy, words_of
from lodemap.operators.graph import components
from lodemap.operators.linking import across, star_rounds
from lodemap.scratch import Scratch

#: Words of a shingle, and the similarity in hundredths.
WORDS, LEAST = 4, 85
#: Words whose counts order the shingles; all others count as rarest.
COMMON = 1 << 16
#: Sets of a list that gives all its pairs.
SHORT = 32
#: Places of narrow bitmaps, of those for blocks and of wide ones: at least, and for each key in which linked sets
#: may differ. Blocks compare members of one list, of which many are a little less similar than linked ones.
NARROW, MIDDLE, WIDE = (128, 4), (512, 4), (2048, 16)
CLASS_BITS = 6
#: Bits for each id of a test, the most of them, and bits of a page of Spark's bitmaps.
FILTER_SHARE, FILTER_BITS, PAGE = 16, 1 << 25, 1 << 15


def overlap(a, b, least: int = LEAST):
    """Fewest common shingles of linked sets of these sizes."""
    return -(-least * (a + b) // (100 + least))


def prefix(n: int, least: int = LEAST) -> int:
    return n - -(-least * n // 100) + 1


def boundary(sizes: np.ndarray, counts: np.ndarray, scan: float, least: int = LEAST) -> int:
    """Size up to which sets are light, at the least total cost; `scan` is the mean length of a list."""
    if not len(sizes):
        return 0
    order = np.argsort(sizes)
    p = np.array([prefix(int(n), least) for n in sizes[order]])
    light = counts[order] * np.array([comb(int(x) + 1, 2) for x in p], float)
    heavy = counts[order] * p * (1 + scan)
    cost = np.concatenate([[0.0], np.cumsum(light)]) + np.concatenate([np.cumsum(heavy[::-1])[::-1], [0.0]])
    best = int(cost.argmin())
    return int(sizes[order][best - 1]) if best else 0


class Shingler:
    """Ordered shingle keys of texts: the class of the rarest word above a hash."""

    def __init__(self, words: int, common: np.ndarray, classes: np.ndarray):
        self.words, self.common, self.classes = words, common, classes

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Sorted distinct keys of each text; empty without words."""
        row, words = words_of(texts)
        coded = words.dictionary_encode()
        hashes = hash_words(pc.ascii_lower(coded.dictionary).to_pylist())
        at, known = find(self.common, hashes)
        rank = np.where(known, self.classes[at] if len(self.classes) else 0, 0).astype(np.uint64)
        index = coded.indices.to_numpy()
        word, rank = hashes[index], rank[index]
        key, low = word, rank
        k = self.words
        if len(word) >= k:
            key, low = word[: len(word) - k + 1], rank[: len(word) - k + 1]
            for i in range(1, k):
                end = len(word) - k + 1 + i
                key, low = mix(key, word[i:end]), np.minimum(low, rank[i:end])
            key = low << np.uint64(64 - CLASS_BITS) | key >> np.uint64(CLASS_BITS)
        ends = np.searchsorted(row, np.arange(len(texts)), side="right")
        start = 0
        for end in ends:
            if end - start >= k:
                yield np.unique(key[start : end - k + 1])
            elif end > start:
                yield np.array([xxhash.xxh3_64_intdigest(word[start:end].tobytes()) >> CLASS_BITS], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            start = end


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): counts of word hashes (kind 0), and of texts by their number of words (kind 1)."""
    hashes, counts, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(1, np.int64)

    def merged():
        keys, at = np.unique(np.concatenate(hashes), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)

    for batch in slices(batches):
        row, words = words_of(batch.column("text"))
        coded = words.dictionary_encode()
        hashes.append(hash_words(pc.ascii_lower(coded.dictionary).to_pylist()))
        counts.append(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
        sizes = np.bincount(np.bincount(row, minlength=batch.num_rows))
        lengths = np.pad(lengths, (0, max(0, len(sizes) - len(lengths))))
        lengths[: len(sizes)] += sizes
        if sum(map(len, hashes)) > 1_000_000:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), _signed(keys), pa.array(n)], ["kind", "key", "n"])
            hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    keys, n = merged()
    there = np.flatnonzero(lengths)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array([0, 1], np.int32), [len(keys), len(there)])), pa.array(np.concatenate([keys.view(np.int64), there])), pa.array(np.concatenate([n, lengths[there]]))],
        ["kind", "key", "n"])


def survey(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> tuple[Shingler, int]:
    """The order of shingles and the boundary, from counts of all documents.

    The driver gets COMMON words and a row for each length of text, which is short of a text's words.
    """
    counts = Scratch(docs.sparkSession, "survey").table(
        docs.select("text").mapInArrow(tidy(_survey), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    top = counts.where("kind = 0").orderBy(F.desc("n"), "key").limit(COMMON).toPandas()
    whole, kinds = counts.where("kind = 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    rest = ((whole or 0) - int(top["n"].sum())) / max(1, kinds - len(top))
    lengths = counts.where("kind = 1 AND key > 0").toPandas()
    sizes = np.maximum(1, lengths["key"].to_numpy(np.int64) - words + 1)
    common = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    classes = np.minimum(1 + np.floor(np.log2(np.maximum(top["n"].to_numpy(float), 1))), (1 << CLASS_BITS) - 1).astype(np.uint8)
    return Shingler(words, common[order], classes[order]), boundary(sizes, lengths["n"].to_numpy(float), rest, least)


def _identity(keys: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(keys.tobytes())).view(np.int64))


def _places(n: int, least: int, width: tuple[int, int]) -> int:
    return max(width[0], 1 << (width[1] * 2 * (n - overlap(n, n, least)) - 1).bit_length())


def _bitmap(keys: np.ndarray, least: int, width: tuple[int, int]) -> bytes:
    """Parity of the number of keys at each place; a power of two of places.

    Bitmaps of unrelated sets differ in about half of their places. In narrow ones that is at least twice
    what linked sets may differ in, which tells them apart; wide ones tell related sets from linked ones.
    """
    places = _places(len(keys), least, width)
    return np.packbits(np.bincount((keys % np.uint64(places)).astype(np.int64), minlength=places) & 1).tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap of `size` bytes: parities of places that fall together."""
    x = np.frombuffer(bitmap, np.uint64)
    while x.nbytes > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _allowed(a: list[bytes], b: list[bytes], i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray, least: int) -> np.ndarray:
    """Whether sets i of `a` and j of `b` may link: bitmaps differ in no more places than their sets, of sizes n and m, in keys."""
    size = np.minimum(np.fromiter(map(len, a), np.int64, len(a))[i], np.fromiter(map(len, b), np.int64, len(b))[j])
    need = overlap(n, m, least)
    out, most, fits = np.zeros(len(i), bool), n + m - 2 * need, need <= np.minimum(n, m)
    for width in np.unique(size[fits]):
        at = np.flatnonzero(fits & (size == width))
        left, u = np.unique(i[at], return_inverse=True)
        right, v = np.unique(j[at], return_inverse=True)
        x, y = (np.stack([_folded(side[k], width) for k in use]) for side, use in ((a, left), (b, right)))
        step = max(1, (4 << 20) // int(width))
        for s in range(0, len(at), step):
            part = at[s : s + step]
            differ = np.bitwise_count(x[u[s : s + step]] ^ y[v[s : s + step]]).sum(1, dtype=np.int64)
            out[part] = differ <= most[part]
    return out


def _middle(least: int):
    """Wide bitmaps of sets of `n` keys, folded to MIDDLE."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [_folded(wide, _places(n, least, MIDDLE) // 8).tobytes() for wide, n in zip(batch.column("wide").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(folded, pa.binary())], ["node", "bits"])

    return run


def _may_link(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                batch = whole.slice(s, 1024)
                n, m = (batch.column(c).to_numpy().astype(np.int64) for c in "nm")
                at = np.arange(batch.num_rows)
                yield batch.select(["src", "dst"]).filter(pa.array(_allowed(batch.column("a").to_pylist(), batch.column("b").to_pylist(), at, at, n, m, least)))

    return run


def _perhaps_among(ids: DataFrame, key: str) -> Column:
    """A test that every row with one of the written `ids` passes, and few others.

    About FILTER_SHARE bits for each id, up to FILTER_BITS (beyond, more rows pass), so that the texts of
    most other rows need not be shuffled.
    """
    bits = min(FILTER_BITS, max(PAGE, 1 << (FILTER_SHARE * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    pages = ids.select(F.floor(at / PAGE).alias("page"), (at % PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("set"))
    out = bytearray(bits // 8)
    for row in pages.collect():  # a row for each page of 4 KB
        out[row["page"] * PAGE // 8 : (row["page"] + 1) * PAGE // 8] = row["set"]
    byte = F.conv(F.hex(F.substr(F.lit(out), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def _keys(keys: np.ndarray, light: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set's lists, its place there, and whether the list is of single shingles."""
    n = len(keys)
    p = prefix(n, least)
    parts = []
    if 1 < n <= light:
        first = keys[: p + 1]
        i, j = np.triu_indices(len(first), 1)
        parts.append((mix(first[i], ~first[j]), np.zeros(len(i), np.int32), np.zeros(len(i), bool)))
    if n and (n > light or 100 * n >= least * (light + 1)):
        parts.append((keys[:p], np.arange(p, dtype=np.int32), np.ones(p, bool)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole lists of sorted rows (key, node, n, at, single), several at a time, each with one row a node."""
    columns = ("key", "node", "n", "at", "single")
    held: list[list[np.ndarray]] = []

    def distinct(rows):
        keep = np.ones(len(rows[0]), bool)
        keep[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        return tuple(c[keep] for c in rows)

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held and len(rows[0]) and rows[0][-1] == held[0][0][0] == rows[0][0]:
            held.append(rows)
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        done = [np.concatenate([h[i] for h in held] + [rows[i][:last]]) for i in range(len(columns))]
        if len(done[0]):
            yield distinct(done)
        held = [[c[last:] for c in rows]]
    if held:
        yield distinct([np.concatenate([h[i] for h in held]) for i in range(len(columns))])


def candidate_pairs(n: np.ndarray, at: np.ndarray, single: np.ndarray, light: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a list that may link by size and position."""
    i, j = np.triu_indices(len(n), 1)
    fits = list_fits(n[i], n[j], at[i], at[j], single[i], light, least)
    return i[fits], j[fits]


def list_fits(n: np.ndarray, m: np.ndarray, at: np.ndarray, to: np.ndarray, single: np.ndarray, light: int, least: int) -> np.ndarray:
    """Whether sets of sizes n and m, at these places in one list, may link."""
    need = overlap(n, m, least)
    fits = (need <= np.minimum(n, m)) & (~single | (n > light) | (m > light))
    return fits & (~single | (np.minimum(n - at, m - to) >= need))


def star(node: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs around one set for each band of sizes of a long list."""
    order, left, right = np.argsort(n, kind="stable"), [], []
    while len(order):
        band = order[100 * n[order[0]] >= least * n[order]]
        centre = band[np.argmin(mix(np.full(len(band), 7, np.uint64), node[band].view(np.uint64)))]
        others = band[band != centre]
        left.append(np.full(len(others), centre))
        right.append(others)
        order = order[len(band):]
    return np.concatenate(left), np.concatenate(right)


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])


def join(docs: DataFrame, words: int = WORDS, least: int = LEAST, key: str = "doc_id") -> DataFrame:
    """`key`, n_shingles, component_id: the smallest `key` that links reach, for every row of `docs`.

    Documents link when 100 * common >= `least` * united shingles of their sets, exactly. A text of
    fewer words than a shingle is one shingle; null texts and texts without words have none, link with
    nothing and are components of their own. Equal texts and repeated rows link. A row with a null
    key has its count, but links with nothing and has no component. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    order, light = survey(docs, words, least)
    held = spark.sparkContext.broadcast((order.words, order.common, order.classes))
    kind = docs.schema[key].dataType.simpleString()

    def sizes_and_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(*held.value), set()
        for batch in slices(batches):
            n, nodes, lists, bits, wide = [], [], [], [], []
            for named, keys in zip(pc.is_valid(batch.column(key)).to_pylist(), shingler.sets(batch.column("text"))):
                n.append(len(keys))
                nodes.append(_identity(keys) if named and len(keys) else None)
                new = nodes[-1] is not None and nodes[-1] not in seen  # copies in a task are listed once
                seen.add(nodes[-1])
                bits.append(_bitmap(keys, least, NARROW) if new else None)
                wide.append(_bitmap(keys, least, WIDE) if new else None)
                lists.append(_keys(keys, light, least) if new else _keys(keys[:0], light, least))
            where = [len(k) for k, _, _ in lists]
            ends = pa.array(np.concatenate([[0], np.cumsum(where)]).astype(np.int32))
            columns = [_signed(np.concatenate([k for k, _, _ in lists])), pa.array(np.concatenate([a for _, a, _ in lists])), pa.array(np.concatenate([s for _, _, s in lists]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n, pa.int32()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), *(pa.ListArray.from_arrays(ends, c) for c in columns)],
                [key, "n", "node", "bits", "wide", "keys", "at", "single"])

    marked = docs.select(key, "text").mapInArrow(tidy(sizes_and_keys), f"`{key}` {kind}, n int, node long, bits binary, wide binary, keys array<long>, at array<int>, single array<boolean>")
    marked = scratch.table(marked, "marks")
    entries = marked.where("n > 0 AND size(keys) > 0").select("node", "n", F.explode(F.arrays_zip("keys", "at", "single")).alias("e"))
    entries = entries.select(F.col("e.keys").alias("key"), "node", "n", F.col("e.at").alias("at"), F.col("e.single").alias("single"))
    lists = entries.repartition("key").sortWithinPartitions("key", "node")

    def list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(src, dst) of short lists and stars; rows of long lists have a null dst and their key."""
        for name, node, n, at, single in _runs(batches):
            begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            end = np.append(begin[1:], len(name))
            a, b, long = [], [], []
            for s, e in zip(begin[end - begin > 1], end[end - begin > 1]):
                if e - s <= SHORT:
                    i, j = candidate_pairs(n[s:e], at[s:e], single[s:e], light, least)
                else:
                    i, j = star(node[s:e], n[s:e], least)
                    long.append(np.arange(s, e))
                a.append(node[s:e][i])
                b.append(node[s:e][j])
            if a:
                pairs = np.concatenate(a), np.concatenate(b)
                out = _pairs_batch(*pairs)
                blank = pa.nulls(out.num_rows, pa.int64()), pa.nulls(out.num_rows, pa.int32()), pa.nulls(out.num_rows, pa.int32()), pa.nulls(out.num_rows, pa.bool_())
                yield pa.RecordBatch.from_arrays([*out.columns, *blank], ["src", "dst", "key", "n", "at", "single"])
            if long:
                rows = np.concatenate(long)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[rows]), pa.nulls(len(rows), pa.int64()), pa.array(name[rows]), pa.array(n[rows]), pa.array(at[rows]), pa.array(single[rows])],
                    ["src", "dst", "key", "n", "at", "single"])

    found = scratch.table(lists.mapInArrow(tidy(list_pairs), "src long, dst long, key long, n int, at int, single boolean"), "found")
    pairs = scratch.table(found.where("dst IS NOT NULL").select("src", "dst").distinct(), "pairs")
    long = scratch.table(found.where("dst IS NULL").select("key", F.col("src").alias("node"), "n", "at", "single"), "long")
    # only nodes of a pair or a long list are compared: their ids go to the marks, not all bitmaps to the ids
    nodes = scratch.table(pairs.select(F.explode(F.array("src", "dst")).alias("node")).union(long.select("node")).distinct(), "nodes")
    maps = marked.where("bits IS NOT NULL").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("bits").alias("bits"), F.first("n").alias("n"))
    maps = scratch.table(maps, "bitmaps")

    def allowed(pairs: DataFrame, maps: DataFrame, name: str) -> DataFrame:
        """The pairs whose bitmaps allow the overlap."""
        both = pairs.join(maps.select(F.col("node").alias("dst"), F.col("bits").alias("b"), F.col("n").alias("m")), "dst").join(
            maps.select(F.col("node").alias("src"), F.col("bits").alias("a"), "n"), "src")
        return scratch.table(both.mapInArrow(tidy(_may_link(least)), "src long, dst long"), name)

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs, allowed by narrow bitmaps, that wide ones allow too; only their nodes' wide ones are shuffled."""
        ends = scratch.table(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), f"{name}-ends")
        wide = marked.where(F.col("wide").isNotNull() & _perhaps_among(ends, "node")).join(ends, "node", "left_semi")
        wide = scratch.table(wide.groupBy("node").agg(F.first("wide").alias("bits"), F.first("n").alias("n")), f"{name}-wide")
        return allowed(pairs, wide, name)

    pairs = likely(allowed(pairs, maps, "allowed"), "likely")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(*held.value), set()
        for batch in slices(batches):
            sets = {_identity(s): s for s in shingler.sets(batch.column("text"))}
            sets = [(node, s) for node, s in sets.items() if node not in seen]
            seen.update(node for node, _ in sets)
            ends = pa.array(np.cumsum([0, *(len(s) for _, s in sets)]).astype(np.int32))
            flat = np.concatenate([np.zeros(0, np.uint64), *(s for _, s in sets)])
            yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in sets], pa.int64()), pa.ListArray.from_arrays(ends, _signed(flat))], ["node", "keys"])

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link, exactly: by the sets of their nodes, each made from one document."""
        ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        holders = marked.where("node IS NOT NULL").groupBy("node").agg(F.min(key).alias(key)).join(ends, "node", "left_semi").select(key)
        holders = scratch.table(holders, f"{name}-holders")
        chosen = docs.where(_perhaps_among(holders, key)).select(key, "text").join(holders, key, "left_semi").select("text")
        sets = scratch.table(chosen.mapInArrow(tidy(contents), "node long, keys array<long>"), f"{name}-sets")
        both = pairs.join(sets.select(F.col("node").alias("dst"), F.col("keys").alias("b")), "dst").join(
            sets.select(F.col("node").alias("src"), F.col("keys").alias("a")), "src")
        common = F.size(F.array_intersect("a", "b"))
        out = scratch.table(both.where(100 * common >= least * (F.size("a") + F.size("b") - common)).select("src", "dst"), name)
        scratch.drop(f"{name}-sets")
        return out

    edges = links(pairs, "links")
    if not long.isEmpty():
        def linked(pairs: DataFrame, name: str) -> DataFrame:
            return links(likely(allowed(pairs, maps, f"{name}-allowed"), f"{name}-likely"), name)

        def may_link(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            (n, at, single), (m, to, _) = ([t.column(c).to_numpy() for c in ("n", "at", "single")] for t in (a, b))
            i, j = np.divmod(np.arange(len(n) * len(m)), len(m))
            fits = list_fits(n[i], m[j], at[i], to[j], single[i], light, least)
            i, j = i[fits], j[fits]
            keep = _allowed(a.column("bits").to_pylist(), b.column("bits").to_pylist(), i, j, n[i].astype(np.int64), m[j].astype(np.int64), least)
            return i[keep], j[keep]

        def sizes_fit(n: Column, m: Column) -> Column:
            return 100 * F.least(n, m) >= least * F.greatest(n, m)

        _, found, left = star_rounds(long, linked, scratch, edges, sizes_fit)
        for more in found:
            edges = edges.unionByName(more)
        if left is not None:
            left = scratch.table(left, "left")
            torn = scratch.table(left.select("node").distinct(), "torn")
            middle = marked.where(F.col("wide").isNotNull() & _perhaps_among(torn, "node")).select("node", "wide", "n").mapInArrow(tidy(_middle(least)), "node long, bits binary")
            middle = scratch.table(middle.join(torn, "node", "left_semi").groupBy("node").agg(F.first("bits").alias("bits")), "middle")
            rest = across(left, ["n", "at", "single", "bits"], may_link, "long", middle)
            edges = edges.unionByName(links(likely(scratch.table(rest, "rest"), "rest-likely"), "links2"))
    comps = components(nodes, edges)
    # every node of the graph by its smallest document
    least_key = marked.where("node IS NOT NULL").groupBy("node").agg(F.min(key).alias("low"))
    placed = scratch.table(least_key.join(comps, "node", "left").select("node", "low", F.coalesce("comp", "node").alias("comp")), "placed")
    roots = scratch.table(placed.groupBy("comp").agg(F.min("low").alias("component_id")), "roots")
    named = scratch.table(placed.join(roots, "comp").select("node", "component_id"), "named")
    held.unpersist()
    return marked.select(key, "n", "node").join(named, "node", "left").select(
        key, F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", key).alias("component_id"))


def one_of_each(docs: DataFrame, joined: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose `key` names its component; of rows with one such key one stays.

    Rows with null keys stay. `joined` is what `join` returns for `docs`.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    again = joined.groupBy(key).agg(F.min("component_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    ids = scratch.table(again.where(F.col(key).isNotNull() & ((F.col("low") != F.col(key)) | (F.col("rows") > 1))), "ids")
    kept = docs.join(ids.select(key), key, "left_anti").select(docs.columns)
    repeated = ids.where(F.col("low") == F.col(key))
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated.select(key), key, "left_semi").dropDuplicates([key]).select(docs.columns))
