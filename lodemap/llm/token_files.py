"""Token ids in files with Elias-Fano coded document boundaries.

A file is one concatenated id array with the offsets of its documents and their keys, both as
Elias-Fano sequences: about 2 + log2(universe / n) bits each instead of 64, with select samples,
so that a reader finds any document without a table of offsets. Files follow each other in
ascending key order; a manifest, written by Spark, names the valid ones in order.

    magic  8 bytes   width of an id, 8   documents, 8   of these with null keys, 8   ids, 8
    then the offsets and the keys as sequences, then the ids, little-endian

    sequence:  values, 8   least, 8   low bits, 8   high bits, 8   sample bytes, 8
               low parts, then the unary high parts, then the places of every SAMPLE-th value
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F, Window

from lodemap.llm.bpe import _classes, _content
from lodemap.llm.common import slices
from lodemap.scratch import Scratch

MAGIC, SAMPLE = b"EFIDS\0\0\1", 64
#: Ids of a file; a longer document has one of its own.
FILE_IDS = 4 << 20
#: Pieces of text whose ids a worker remembers, the first it meets; strings that it encodes at once; bytes of text of a step.
KNOWN, AT_ONCE, STEP_BYTES = 200_000, 4000, 4 << 20
#: Shards for each shuffle partition: their keys' ranges follow each other.
SHARDS = 4
#: Documents of a file that a reader decodes at once.
READ = 2000
END = 1


class Sequence:
    """A non-decreasing sequence of integers, Elias-Fano coded."""

    def __init__(self, n: int, least: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.least, self.low_bits, self.low, self.high, self.samples = n, least, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        least = int(values[0])
        x = values.astype(np.int64).view(np.uint64) - np.uint64(least % (1 << 64))
        l = max(0, (int(x[-1]) // n).bit_length() - 1)
        bits = (x[:, None] >> np.arange(l, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        at = (x >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1, np.uint8)
        unary[at] = 1
        return cls(n, least, l, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def _place(self, i: int) -> int:
        """Bit of value i in the high parts: from the sample before it, bits are counted on."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:
            at += 1
            byte = int(self.high[at >> 3]) >> (at & 7)
            if byte.bit_count() < left:
                left -= byte.bit_count()
                at |= 7
            else:
                left -= byte & 1
        return at

    def select(self, i: int) -> int:
        """Value i; no other value is decoded."""
        return int(self.between(i, i + 1)[0])

    def values(self) -> np.ndarray:
        return self.between(0, self.n)

    def between(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1: two selections bound the bits that are decoded."""
        if i >= j:
            return np.zeros(0, np.int64)
        first, last, l = self._place(i), self._place(j - 1), self.low_bits
        unary = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")[first & 7 :]
        at = np.flatnonzero(unary)[: j - i] + first
        high = (at - np.arange(i, j)).astype(np.uint64) << np.uint64(l)
        bits = np.unpackbits(self.low[i * l >> 3 : (j * l + 7) >> 3], bitorder="little")[i * l & 7 :][: (j - i) * l].reshape(j - i, l).astype(np.uint64)
        low = (bits << np.arange(l, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (high + low + np.uint64(self.least % (1 << 64))).view(np.int64)

    def tobytes(self) -> bytes:
        head = struct.pack("<qqqqq", self.n, self.least, self.low_bits, len(self.high), self.samples.nbytes)
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[Sequence, int]:
        n, least, l, high, samples = struct.unpack_from("<qqqqq", data, at)
        at += 40
        low = (n * l + 7) // 8
        parts = [np.frombuffer(data, np.uint8, size, at + skip) for size, skip in ((low, 0), (high, low))]
        return cls(n, least, l, *parts, np.frombuffer(data, np.uint32, samples // 4, at + low + high)), at + low + high + samples


def pack(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A file of documents in order, null keys first."""
    named = np.array([k for k in keys if k is not None], np.int64)
    head = MAGIC + struct.pack("<qqqq", width, len(keys), len(keys) - len(named), len(ids))
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return head + Sequence.of(offsets).tobytes() + Sequence.of(named).tobytes() + ids.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> tuple[int, Sequence, Sequence, np.ndarray]:
    """Number of null keys, the other keys, offsets and ids of a file, the sequences as they are coded."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    width, _, nulls, n = struct.unpack_from("<qqqq", data, 8)
    offsets, at = Sequence.read(data, 40)
    named, at = Sequence.read(data, at)
    return nulls, named, offsets, np.frombuffer(data, f"<u{width}", n, at)


def documents(data: bytes, i: int, j: int) -> tuple[list[int | None], np.ndarray, list[np.ndarray]]:
    """Keys, offsets (one more) and ids of documents i to j - 1 of a file; only their bounds are decoded."""
    nulls, named, offsets, ids = unpack(data)
    cut = offsets.between(i, j + 1)
    keys = [None] * max(0, min(j, nulls) - i) + named.between(max(i - nulls, 0), max(j - nulls, 0)).tolist()
    return keys, cut, [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


@lru_cache(2)
def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


@lru_cache(2)
def _known(spec: str) -> dict[bytes, bytes]:
    """Ids of pieces that this worker has encoded, KNOWN of them at most."""
    return {}


def plain(texts: pa.Array) -> np.ndarray:
    """Texts that may be encoded piece by piece: Latin letters, ASCII, no control or special signs.

    Their characters are their own normal forms and lower-case one by one, and no added token
    can start in them.
    """
    odd = pc.match_substring_regex(texts, "[^\\x{21}-\\x{7E} \\t\\n\\r\\x{A1}-\\x{2FF}]|\\x{130}|<\\|")
    return ~pc.fill_null(odd, False).to_numpy(zero_copy_only=False)


def text_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Pieces of plain texts that can be encoded alone: runs of one class, not cut at an apostrophe."""
    low = pc.utf8_lower(texts)
    sizes = pc.binary_length(low).to_numpy().astype(np.int64)
    low = pa.concat_arrays([low])
    data = np.frombuffer(_content(low), np.uint8)
    if not len(data):
        return np.zeros(len(texts), np.int64), pa.array([], pa.binary())
    kind = _classes()[:128][np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _classes()[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    cut = np.zeros(len(data) + 1, bool)
    quote = data == 0x27
    cut[1:-1] = (kind[1:] != kind[:-1]) & ~((quote[1:] | quote[:-1]) & (kind[1:] != 3) & (kind[:-1] != 3))
    begins = np.cumsum(sizes) - sizes
    cut[begins] = cut[-1] = True
    starts = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
    keep = kind[starts[:-1]] != 3
    row = np.searchsorted(begins + sizes, starts[:-1], side="right")
    return np.bincount(row[keep], minlength=len(texts)), pieces.filter(pa.array(keep))


def id_width(spec: str, end: int) -> int:
    """Bytes of an id in a file."""
    return 2 if max(_tokenizer(spec).get_vocab_size(), end + 1) <= 1 << 16 else 4


def encode(docs: DataFrame, spec: str, end: int = END, key: str = "doc_id", bounds: list[int] = ()) -> DataFrame:
    """`key`, ids (binary, little-endian uint16 or uint32), shard for every row; `end` closes each document.

    Null texts count as empty. Each distinct piece of a step is encoded once; other texts than
    plain ones are encoded whole. The shard is the number of `bounds` up to the key; 0 for null.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec)
    width, limits = id_width(spec, end), np.array(bounds, np.int64)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(held.value), _known(held.value)

        def ids_of(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, f"<u{width}").tobytes() for at in range(0, len(texts), AT_ONCE)
                    for e in tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]

        for batch in slices(batches, limit=STEP_BYTES):
            texts = pc.fill_null(batch.column("text"), "")
            easy = plain(texts)
            counts, pieces = text_pieces(texts.filter(pa.array(easy)))
            coded = pieces.dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = [w for w in words if w not in known]
            fresh = dict(zip(new, ids_of([w.decode() for w in new])))
            table = pa.array([known.get(w) if w in known else fresh[w] for w in words], pa.binary())
            known.update(list(fresh.items())[: max(0, KNOWN - len(known))])
            flat = table.take(coded.indices)
            at = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(), dtype=np.int64)])
            ends = at[np.cumsum(counts)]
            content, last, out = _content(flat), np.array([end], f"<u{width}").tobytes(), []
            whole = iter(ids_of(texts.filter(pa.array(~easy)).to_pylist()))
            spans = iter(zip(np.concatenate([[0], ends[:-1]]), ends))
            for simple in easy:
                a, b = next(spans) if simple else (0, 0)
                out.append((content[a:b].tobytes() if simple else next(whole)) + last)
            keys = pc.fill_null(batch.column(key).cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
            shard = np.searchsorted(limits, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary()), pa.array(shard)], [key, "ids", "shard"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, ids binary, shard int")


def write(encoded: DataFrame, folder: str, width: int, key: str = "doc_id") -> DataFrame:
    """Write token files of `encoded` into `folder` in ascending key order; returns the manifest.

    file, shard, number, documents, ids, start (ids of all files before). A task writes under names
    of its own, so files of a failed attempt are in no manifest.
    """
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        shard, number, keys, ids, size = None, 0, [], [], 0

        def close():
            name = f"{shard:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
            flat = np.frombuffer(b"".join(ids), f"<u{width}")
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(pack(keys, np.fromiter(map(len, ids), np.int64, len(ids)) // width, flat, width))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, shard, number, len(keys), len(flat))], ["file", "shard", "number", "documents", "ids"])

        for batch in batches:
            for s, k, x in zip(*(batch.column(c).to_pylist() for c in ("shard", key, "ids"))):
                if keys and (s != shard or size + len(x) > FILE_IDS * width):
                    yield close()
                    number, keys, ids, size = number + 1 if s == shard else 0, [], [], 0
                shard, size = s, size + len(x)
                keys.append(k)
                ids.append(x)
        if keys:
            yield close()

    shards = encoded.repartition("shard").sortWithinPartitions("shard", F.col(key).asc_nulls_first())
    written = shards.select("shard", F.col(key).cast("long").alias(key), "ids").mapInArrow(run, "file string, shard long, number long, documents long, ids long")
    written = Scratch(encoded.sparkSession, "tokens").table(written, "files")
    before = Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """`key`, start, n_tokens, ids (binary, uint32) of every document, from the files."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest.select("file", "start"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, start = batch.column("content")[i].as_py(), batch.column("start")[i].as_py()
                whole = unpack(data)[2].n - 1
                for s in range(0, whole, READ):
                    keys, cut, ids = documents(data, s, min(s + READ, whole))
                    parts = [x.astype("<u4").tobytes() for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(cut[:-1] + start), pa.array(np.diff(cut)), pa.array(parts, pa.binary())], [key, "start", "n_tokens", "ids"])

    return named.select("content", "start").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids binary")


def write_corpus(docs: DataFrame, spec: str, end: int = END, key: str = "doc_id") -> tuple[DataFrame, str]:
    """Encode `docs` and write its token files to a new shared folder; returns the manifest and the folder.

    Shards are ranges of keys with about as many rows each; texts are encoded where they lie.
    """
    spark = docs.sparkSession
    folder = Scratch(spark, "token-files").path("ids")
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(F.col(key).cast("long"), [i / shards for i in range(1, shards)], 100 * shards)).first()[0] if shards > 1 else None
    return write(encode(docs, spec, end, key, sorted(set(cuts or []))), folder, id_width(spec, end), key), folder
