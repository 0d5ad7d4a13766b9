"""BPE and token files: against the libraries, by random texts, and by round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings, strategies as st

from lodemap.llm import bpe, queries, token_files as T

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
    SPEC = f.read()


def cut(texts):
    counts, pieces = bpe.pieces(pa.array(texts, pa.string()))
    pieces, out = [p.decode() for p in pieces.to_pylist()], []
    for n in counts:
        out.append(pieces[:n])
        pieces = pieces[n:]
    return out


def test_pieces_are_the_matches_of_the_pattern(odd_texts):
    assert cut(odd_texts) == [regex.findall(PATTERN, t or "") for t in odd_texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé'strelvmd \n\t!1²中́\x85 😀"), max_size=14), max_size=5))
def test_pieces_of_random_texts(texts):
    assert cut(texts) == [regex.findall(PATTERN, t) for t in texts]


def check(rows, got):
    encoding = bpe._encoding(RANKS, PATTERN)
    want = []
    for i, text, *_ in rows:
        ids = encoding.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=key) == sorted(want, key=key)


def test_op1_odd_texts_nulls_and_repeats(documents, odd_texts):
    rows = [(i, t, None, None) for i, t in enumerate(odd_texts)] + [(None, "no id", None, None), (3, "again", None, None), (3, "again", None, None)]
    check(rows, bpe.digests(documents(rows), RANKS, PATTERN).collect())


def test_op1_many_blocks(documents, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 200)
    monkeypatch.setattr(bpe, "PACK_WORDS", 7)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices(["tree", "Oak's", "été", "12", "re", "\n"], k=rnd.randrange(40))), None, None) for i in range(60)]
    assert len(rows) == bpe.encode(documents(rows).coalesce(1), RANKS, PATTERN).count()
    check(rows, bpe.digests(documents(rows).coalesce(1), RANKS, PATTERN).collect())


def test_op1_empty_table(documents):
    assert bpe.digests(documents([]), RANKS, PATTERN).count() == 0


def test_ids_are_decoded_by_the_workers_that_place_them(documents, odd_texts):
    """One Python worker a task after the shuffle: a second one for decoding took an executor over its memory."""
    df = bpe.digests(documents([(i, t, None, None) for i, t in enumerate(odd_texts)]), RANKS, PATTERN, "ids", "bytes")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert "MapInArrow" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
    got = {r.doc_id: (r.ids, r.bytes) for r in df.collect()}
    assert {i: bytes(b).decode() for i, (_, b) in got.items()} == {i: t or "" for i, t in enumerate(odd_texts)}
    again = bpe.decode(df.select("doc_id", "ids"), RANKS).collect()
    assert {r.doc_id: (r.ids, r.bytes) for r in again} == got


def test_decode_keeps_null_and_rejects_unknown_ids(spark):
    df = spark.createDataFrame([(1, [31373, 995]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.bytes and bytes(r.bytes) for r in bpe.decode(df, RANKS).collect()} == {1: b"hello world", 2: b"", 3: None}
    with pytest.raises(Exception, match="token-byte table"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), RANKS).collect()


def test_another_pattern_is_an_error(documents):
    assert bpe.PATTERN == public_tokenizers.PATTERN
    with pytest.raises(ValueError, match="pattern"):
        bpe.encode(documents([(1, "a b", None, None)]), RANKS, r"\S+|\s+")


def test_op1_whole_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(rows, queries.QUERIES["op1_bpe"](spark, folder).collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-2**62, 2**62), max_size=300), st.integers(0, 40))
def test_sequences(values, shrink):
    values = np.sort(np.array([v >> shrink for v in values], np.int64))
    data = T.Sequence.of(values).tobytes()
    back, end = T.Sequence.read(data + b"tail", 0)
    assert end == len(data) and (back.values() == values).all()
    assert [back.select(i) for i in range(len(values))] == values.tolist()
    for i, j in [(0, 0), (0, 1), (len(values) // 3, len(values)), (len(values) // 2, len(values) // 2 + 70)]:
        j = min(j, len(values))
        assert back.between(i, j).tolist() == values[i:j].tolist()


def test_documents_of_a_file_are_found_without_the_others(monkeypatch):
    lengths = np.random.default_rng(1).integers(1, 40, 900)
    ids = np.arange(lengths.sum())
    data = T.pack([None] * 3 + list(range(-50, 847)), lengths, ids, 4)
    monkeypatch.delattr(T.Sequence, "values")
    decoded = []
    between = T.Sequence.between
    monkeypatch.setattr(T.Sequence, "between", lambda self, i, j: decoded.append(j - i) or between(self, i, j))
    ends = np.cumsum(lengths)
    for i, j in [(0, 2), (2, 5), (0, 900), (899, 900), (400, 464), (7, 7)]:
        keys, cut, parts = T.documents(data, i, j)
        assert keys == ([None] * 3 + list(range(-50, 847)))[i:j]
        assert cut.tolist() == [0, *ends.tolist()][i : j + 1]
        assert [p.tolist() for p in parts] == [ids[b - n : b].tolist() for b, n in zip(ends[i:j], lengths[i:j])]
        assert max(decoded[-2:]) <= j - i + 1


def test_sequences_are_small():
    n = 10_000
    values = np.sort(np.random.default_rng(0).integers(0, 500 * n, n))
    assert len(T.Sequence.of(values).tobytes()) * 8 < n * (np.log2(500) + 3.5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBéÉ'sSTreLvm \n\t!1²ªµßÑŉ\"-."), max_size=14), max_size=5))
def test_pieces_encode_as_whole_texts_do(texts):
    tokenizer, texts = T._tokenizer(SPEC), pa.array(texts, pa.string())
    assert T.plain(texts).all()
    counts, pieces = T.text_pieces(texts)
    ids = [tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in pieces.to_pylist()]
    for text, n in zip(texts.to_pylist(), counts):
        assert sum(ids[:n], []) == tokenizer.encode(text, add_special_tokens=False).ids
        ids = ids[n:]


def check_files(rows, got):
    tokenizer, start, want = T._tokenizer(SPEC), 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_op7_odd_texts_and_small_files(spark, documents, odd_texts, monkeypatch):
    monkeypatch.setattr(T, "FILE_IDS", 50)
    rows = [(10 - i, t, None, None) for i, t in enumerate(odd_texts)] + [(None, "no id", None, None)]
    manifest, folder = T.write_corpus(documents(rows), SPEC)
    monkeypatch.setattr(T, "READ", 2)
    got = T.read(manifest, folder).selectExpr("doc_id", "start", "n_tokens", "crc32(ids)").collect()
    check_files(rows, got)
    assert manifest.count() > 1
    # a file that no manifest names is not read
    import pyarrow.fs as pafs
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{path}/999999-000000-stray.ids") as f:
        f.write(T.pack([99], np.array([1]), np.array([1]), 2))
    assert T.read(manifest, folder).count() == len(rows)


def test_op7_empty_table(documents):
    manifest, folder = T.write_corpus(documents([]), SPEC)
    assert T.read(manifest, folder).count() == 0


def test_op7_whole_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check_files(rows, queries.QUERIES["op7_token_files"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
