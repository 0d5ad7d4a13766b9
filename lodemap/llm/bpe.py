"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Documents are gathered, where they lie, in blocks of bounded size. A block's text is cut into
pre-tokens; each distinct one gets a number and each document becomes the positions of its
pre-tokens as such numbers. The words (block, number, word) are shuffled by word, so that equal
words of all blocks meet and are merged once by rank; their ids go back by block, where they
are put in the places of the pre-tokens. A word occurs once in a block at most, so that the
commonest word of the corpus is no hotter than any other. Texts are never shuffled.

Decoding looks every id up in the token-byte table, whose size the vocabulary fixes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodemap.llm.common import release, slices, tidy

#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: Encoded words that a task gathers before it hands them on, packed by block.
PACK_WORDS = 250_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The pattern whose matches `piece_starts` cuts, and what in it may follow an apostrophe as one pre-token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SUFFIXES = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for run in regex.finditer(pattern + "+", every):
            at = np.array([ord(run[0][0]), ord(run[0][-1])])
            out[at[0] : at[1] + 1] = kind
    return out


def piece_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of UTF-8 `data` start; `texts` are the starts of the texts in it.

    The cuts of the pattern of the rank files, made for all bytes at once: runs of letters, of
    numbers, of white space and of anything else; a single space before one of the others joins it;
    the last other white space before one is a piece of its own; an apostrophe that starts a run
    takes one of SUFFIXES with it.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    table = _classes()
    kind = table[:128][np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        code = first & np.where(more == 1, 0x1F, np.where(more == 2, 0x0F, 0x07))
        for k in (1, 2, 3):
            code = np.where(more >= k, code << 6 | data[np.minimum(lead + k, len(data) - 1)] & 0x3F, code)
        found = table[code]
        for k in (0, 1, 2, 3):
            kind[(lead + k)[more >= k]] = found[more >= k]
    head = data & 0xC0 != 0x80  # the first byte of a character
    new = np.zeros(len(data) + 1, bool)
    new[texts[texts < len(data)]] = new[-1] = True
    border = new.copy()
    border[1:-1] |= kind[1:] != kind[:-1]
    cut = border.copy()
    # white space before something else in the same text: its last character is on its own or joins what follows
    ends = np.flatnonzero(border[1:] & ~new[1:] & (kind == SPACE)) + 1
    ends = ends[ends < len(data)]
    last = ends - 1
    while len(at := np.flatnonzero(~head[last])):
        last[at] -= 1
    cut[last] = True
    cut[ends[data[last] == 0x20]] = False
    # apostrophes that start a run and are all of it
    quote = np.flatnonzero((data == 0x27) & cut[:-1] & border[1:] & ~new[1:])
    for suffix in SUFFIXES:
        fits = quote[quote + len(suffix) < len(data)]
        for k, byte in enumerate(suffix, 1):
            fits = fits[(data[fits + k] == byte) & ~new[fits + k]]
        cut[fits + 1] = False
        cut[fits + 1 + len(suffix)] = True
    return np.flatnonzero(cut[:-1])


def pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of pre-tokens of each text (null: none), and all pre-tokens in order."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    joined = pa.concat_arrays([texts])  # offsets from 0
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    buffer = (joined.buffers()[2] or pa.py_buffer(b"")).slice(int(offsets[0]), int(sizes.sum())) if len(joined) else pa.py_buffer(b"")
    data = np.frombuffer(buffer, np.uint8)
    begins = np.cumsum(sizes) - sizes
    starts = piece_starts(data, begins[sizes > 0])
    counts = np.searchsorted(starts, begins + sizes) - np.searchsorted(starts, begins)
    bounds = np.append(starts, len(data)).astype(np.int32)
    return counts, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), buffer])


def _blocks(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[tuple[int, pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """(block, keys, number of pre-tokens of each, distinct words, number of each pre-token's word).

    A block's id is a hash of its place and content, so a different deal of rows is noticed.
    """
    task, number, kept, size = TaskContext.get().partitionId(), 0, [], 0

    def close():
        keys = pa.concat_arrays([k for k, _, _ in kept])
        counts = np.concatenate([c for _, c, _ in kept])
        chunks = pa.chunked_array([w for _, _, w in kept]).unify_dictionaries().chunks
        where = np.concatenate([c.indices.to_numpy() for c in chunks]).astype(np.uint32)
        mark = xxhash.xxh3_64(f"{task}.{number}.{keys[0]}.{keys[-1]}".encode() + counts.tobytes()).intdigest() >> 1
        return mark, keys, counts, chunks[-1].dictionary, where

    for batch in slices(batches):
        counts, words = pieces(batch.column("text"))
        kept.append((batch.column(key), counts, words.dictionary_encode()))
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= limit:
            yield close()
            number, kept, size = number + 1, [], 0
    if kept:
        yield close()


def _packed(numbers: np.ndarray) -> bytes:
    """uint32 numbers as four planes of bytes, compressed."""
    return zstandard.ZstdCompressor(3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return planes.T.copy().view("<u4").ravel()


def _pack(block: np.ndarray, number: np.ndarray, ids: list[list[int]]) -> pa.RecordBatch:
    """A row for each block: the numbers of its words here, how many ids each has, and the ids."""
    sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
    flat = np.fromiter((i for word in ids for i in word), np.uint32, int(sizes.sum()))
    order = np.lexsort((number, block))
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    ends = np.cumsum(sizes[order], dtype=np.int64)
    flat = flat[np.repeat(starts[order] - (ends - sizes[order]), sizes[order]) + np.arange(len(flat))]
    names, first = np.unique(block[order], return_index=True)
    rows = []
    for a, b in zip(first, np.append(first[1:], len(order))):
        words = order[a:b]
        rows.append((_packed(number[words]), _packed(sizes[words]), _packed(flat[ends[a] - sizes[order[a]] : ends[b - 1]])))
    return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(c, pa.binary()) for c in zip(*rows))], ["block", "numbers", "sizes", "ids"])


def read_ranks(path: str) -> bytes:
    """The rank file; the driver reads it and tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(2)
def _token_bytes(ranks: bytes) -> pa.Array:
    """The token-byte table: what each id stands for, null where there is no such id."""
    table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines())}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())


def _bytes_of(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """What each list of ids stands for by the token-byte table; null for null. An id that it lacks is an error."""
    flat = lists.flatten()
    inside = not len(flat) or 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(tokens)
    found = tokens.take(flat) if inside else tokens
    if not inside or found.null_count:
        raise ValueError("an id is not in the token-byte table")
    at = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy(), dtype=np.int64)])
    ends = at[np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy()]))]
    text = _content(found)
    out = [text[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], pc.is_valid(lists).to_pylist())]
    return pa.array(out, pa.binary())


def encode(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", block_bytes: int | None = None, decoded: bool = False) -> DataFrame:
    """`key`, ids (array of int) for every row of `docs`, from its whole text; null and empty: no ids.

    With `decoded` also `bytes`, as `decode` makes them of the ids, by the workers that hold them already.

    `docs` must be dealt to tasks alike whenever it is read, as a scan of files is; where it
    isn't, this fails and says so. Repeated rows get a row each; other columns are not read.
    A block has about `block_bytes` of text: smaller ones need less memory and move more words.
    Pre-tokens are cut for PATTERN; another `pattern` is an error, never wrong ids.
    """
    if pattern != PATTERN:
        raise ValueError(f"pre-tokens are cut for the pattern {PATTERN!r}, not for {pattern!r}")
    block_bytes = block_bytes or BLOCK_BYTES
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    held = spark.sparkContext.broadcast(ranks)

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, words, _ in _blocks(batches, key, block_bytes):
            for start in range(0, len(words), 50_000):
                part = words.slice(start, 50_000)
                number = np.arange(start, start + len(part), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(number), part], ["block", "number", "word"])

    def list_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, counts, _, where in _blocks(batches, key, block_bytes):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (keys, pa.array(counts))]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([_packed(where)], pa.binary())], ["block", "keys", "counts", "places"])

    def encode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, last, ids = _encoding(held.value, pattern).encode_ordinary, None, []
        blocks, numbers, out, size = [], [], [], 0
        for batch in batches:
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, merge(word.decode())
                out.append(ids)
            blocks.append(batch.column("block").to_numpy())
            numbers.append(batch.column("number").to_numpy())
            if len(out) >= PACK_WORDS:
                yield _pack(np.concatenate(blocks), np.concatenate(numbers), out)
                blocks, numbers, out = [], [], []
        if out:
            yield _pack(np.concatenate(blocks), np.concatenate(numbers), out)

    def place(places: pa.Table, words: pa.Table) -> pa.Table:
        placed = put(places, words)
        if decoded:
            tokens, ids = _token_bytes(held.value), placed.column("ids").chunk(0)
            found = [_bytes_of(ids.slice(i, 500), tokens) for i in range(0, len(ids), 500)]
            placed = placed.append_column("bytes", pa.chunked_array(found, pa.binary()).combine_chunks())
        release()
        return placed

    def put(places: pa.Table, words: pa.Table) -> pa.Table:
        keys, counts = (places.column(c).combine_chunks().flatten() for c in ("keys", "counts"))
        where = _unpacked(places.column("places")[0].as_py()) if places.num_rows else np.zeros(0, np.uint32)
        numbers, sizes, flat = (np.concatenate([np.zeros(0, np.uint32), *map(_unpacked, words.column(c).to_pylist())]) for c in ("numbers", "sizes", "ids"))
        if places.num_rows != 1 or len(numbers) != (int(where.max()) + 1 if len(where) else 0):
            raise RuntimeError("rows were dealt differently in two passes: write the table first and pass its scan")
        order = np.empty(len(numbers), np.uint32)
        order[numbers] = np.arange(len(numbers), dtype=np.uint32)
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64) * 4]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(flat.astype("<i4"))])
        where = order[where]
        ends = np.concatenate([[0], np.cumsum(sizes[where], dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts.to_numpy())])]
        ids = np.frombuffer(_content(coded.take(pa.array(where))), "<i4")
        return pa.table({key: keys, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))})

    slim = docs.select(key, "text")
    words = slim.mapInArrow(tidy(list_words), "block long, number int, word binary")
    coded = words.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(encode_runs), "block long, numbers binary, sizes binary, ids binary")
    places = slim.mapInArrow(tidy(list_places), f"block long, keys array<{kind}>, counts array<long>, places binary")
    more = ", bytes binary" if decoded else ""
    return places.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(place, f"`{key}` {kind}, ids array<int>{more}")


def _content(binary: pa.Array) -> memoryview:
    """All bytes of a binary array, in order, as they lie in its buffer."""
    offsets = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1]
    return memoryview(binary.buffers()[2] or b"")[offsets[0] : offsets[-1]] if len(binary) else memoryview(b"")


def decode(encoded: DataFrame, ranks: bytes, key: str = "doc_id") -> DataFrame:
    """`encoded` (`key`, ids) with `bytes`, what the ids stand for; null ids stay null.

    Ids meet the token-byte table by position. An id that it lacks is an error.
    """
    held = encoded.sparkSession.sparkContext.broadcast(ranks)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(held.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column(key), lists, _bytes_of(lists, tokens)], [key, "ids", "bytes"])

    return encoded.select(key, "ids").mapInArrow(tidy(run), f"`{key}` {kind}, ids array<int>, bytes binary")


def digests(docs: DataFrame, ranks: bytes, pattern: str, *more: str, key: str = "doc_id", block_bytes: int | None = None) -> DataFrame:
    """`key`, n_tokens, SHA-256 of the ids and of the decoded bytes, and `more` of ids and bytes."""
    return encode(docs, ranks, pattern, key, block_bytes, decoded=True).select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"), *more)
