"""Quality classifier, importance resampling and the conversation trie."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from lodemap.llm import prefix_trie as P, quality as Q, queries, resampling as R


# --- quality ---------------------------------------------------------------------------

def slow_mean(text, vectors):
    """Mean vector of one text, feature by feature."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    rows, hashed = [], lambda w: int(Q.hash_words([w])[0])
    chain = lambda a, b: int(Q.mix(np.array([a], np.uint64), np.array([b], np.uint64))[0])
    before = 0
    for i, word in enumerate(words):
        rows.append(hashed(word))
        marked = f"<{word}>"
        for n in range(Q.SHORTEST, Q.LONGEST + 1):
            for s in range(len(marked) - n + 1):
                key = ord(marked[s])
                for c in marked[s + 1 : s + n]:
                    key = chain(key, ord(c))
                rows.append(key)
        near = [k for k in range(1, Q.RECENT + 1) if i >= k and words[i - k].lower() == word.lower()]
        sign = near[0] if near else hashed(word.lower())
        rows.append(chain(before, sign))
        before = sign
    return vectors[[r % Q.ROWS for r in rows]].astype(float).sum(0) / max(len(rows), 1)


def test_op11_means_and_bags_follow_the_definition(odd_texts):
    vectors = Q._start()[0]
    texts = [t for t in odd_texts if not t or len(t) < 1000] + ["Na na na ba NA na", "<a> a", "aß😀 b"]
    want = np.array([slow_mean(t, vectors) for t in texts])
    reader = Q.Reader(vectors)
    for _ in range(2):  # the second time from kept words
        assert np.allclose(reader.means(pa.array(texts, pa.string())), want, atol=1e-9)
    bags = list(Q.Features(pa.array(texts, pa.string())).bags())
    assert np.allclose([w @ vectors[r] for r, w in bags], want, atol=1e-5)


def test_op11_gradient_of_a_step():
    """One document, one step: what moves is the derivative of its loss."""
    vectors, out, bias = Q._start()
    bag, eps = (np.array([3, 9, 40], np.int32), np.array([0.5, 0.25, 0.25], np.float32)), 1e-4

    def loss(v, o, b):
        z = (bag[1].astype(float) @ v[bag[0]].astype(float)) @ o + b
        return float(np.log(np.exp(z - z[1]).sum()))

    new = Q._epoch((vectors, out, bias), [bag], np.array([1]), np.ones(1), 0.1, 0)
    for name, base, got, scale in (("vectors", vectors, new[0], Q.GAIN), ("out", out, new[1], 1.0), ("bias", bias, new[2], 1.0)):
        at = (9, 2) if name == "vectors" else (1, 0) if name == "out" else (0,)
        moved = base.astype(float).copy()
        moved[at] += eps
        args = {"vectors": (vectors, out, bias), "out": (vectors, out, bias), "bias": (vectors, out, bias)}[name]
        more = [moved if a is base else a.astype(float) for a in args]
        slope = (loss(*more) - loss(*[a.astype(float) for a in args])) / eps
        assert got[at] - base[at] == pytest.approx(-0.1 * scale * slope, rel=2e-2, abs=1e-6)


def test_op11_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op11_quality"](spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = rows["predicted"] == rows["quality"]
    assert (rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()
    assert right[rows["quality"] == 0].mean() >= 0.9 and right[rows["quality"] == 1].mean() >= 0.98
    assert found.count() == 1000


def test_op11_odd_rows(spark, documents, odd_texts):
    rows = [(i, f"{'junk | | |' if i % 2 else 'a plain line of words.'} {i} " * 5, "en", "s") for i in range(80)]
    docs = documents(rows + [(None, "junk | |", None, None), (5, "twice", "en", "s"), (5, "twice", "en", "s")])
    marks = [(i, int(i % 2 == 0)) for i in range(80)] + [(None, 1), (3, 1), (7, None), (8, 2), (4, 1), (4, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = Q.fit(docs, labels)
    odd = documents([(i, t, "en", "s") for i, t in enumerate(odd_texts)] + [(900, "junk | | | 17 junk | |", "en", "s"), (901, "a plain line of words. 17", "en", "s")])
    found = Q.quality(odd, model).toPandas()
    assert len(found) == len(odd_texts) + 2 and found["score"].between(0, 1).all()
    assert found.set_index("doc_id")["predicted"][[900, 901]].tolist() == [0, 1]
    assert found[found["doc_id"].isin([0, 1, 2, 3])]["score"].nunique() == 1  # no words: one score
    assert (found["predicted"] == (found["score"] >= Q.THRESHOLD)).all()
    kept = Q.good_enough(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == set(found[found["predicted"] == 1]["doc_id"])
    assert Q.quality(documents([]), model).count() == 0
    assert Q.fit(documents([]), labels) is None and Q.fit(docs, labels.where("quality = 1")) is None
    assert Q.quality(docs, None).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)
    again = Q.fit(docs, labels)
    assert all(np.array_equal(a, b) for a, b in zip(model, again))


# --- resampling --------------------------------------------------------------------------

def slow_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_resample(docs, target, longest, buckets, least, percent, seed):
    grams = lambda ws: [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for g in grams(slow_words(text)):
                counts[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        ws = slow_words(text)
        weight = sum(gain[bucket(g)] for g in grams(ws))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(ws), len(grams(ws)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return sorted((tuple(r[:1] + r[2:]) + (drawn.get(id(r)),) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_op12_equals_brute_force(spark, documents, odd_texts, longest):
    rnd = random.Random(3)
    rows = [(i, t) for i, t in enumerate(odd_texts)]
    rows += [(100 + i, " ".join(rnd.choice(["Ab", "cd-e", "ß9", "x_y", "Z"]) for _ in range(rnd.randrange(40)))) for i in range(200)]
    rows += [(100, "the same row again " * 6)] * 30 + [(None, "no id at all " * 9), (None, None)]
    docs = documents([(i, t, "en", "s") for i, t in rows])
    target = ["Ab cd e ß9", None, "", "x y z z"]
    found = R.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, n int"), longest, 97, 5, 40, "s")
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == slow_resample(rows, target, longest, 97, 5, 40, "s")


def test_op12_crcs_of_all_runs():
    text = "Éa  b,C9-d " + "long" * 300 + " z"
    ws = slow_words(text)
    count, row, crc = R.crcs([None, text, "", text], 4)
    want = [zlib.crc32(" ".join(ws[i : i + n]).encode()) for n in range(1, 5) for _ in range(2) for i in range(len(ws) - n + 1)]
    assert count.tolist() == [0, len(ws), 0, len(ws)] and sorted(crc.tolist()) == sorted(want) and set(row) == {1, 3}


def test_op12_empty_tables(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert R.resample(documents([]), none).count() == 0
    docs = documents([(i, "some words here " * 8, "en", "s") for i in range(20)])
    rows = R.resample(docs, none).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2]
    assert R.resample(documents([]), docs).count() == 0


# --- conversation trie -----------------------------------------------------------------------

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("id", "depth", "path", "n", "start")],
])


def slow_trie(rows, group, heads):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(ts, key=lambda t: (t[0], t[1], hashlib.sha256((hashlib.sha256(t[1].encode()).hexdigest() + t[2]).encode()).digest()))] for c, ts in by.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + own[c][h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[b] for b in below) or 1
        saved[k] = sum(saved[b] for b in below) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(made[c]) == len(k)))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], TURNS)


@pytest.mark.parametrize("height", [2, 16])
def test_op13_equals_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(P, "HEIGHT", height)
    rnd = random.Random(5)
    rows = []
    for c in [*range(0, 40), -7, -5, 10**12 + 3, 203]:
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", "bot", None]), rnd.choice(["a", "b", "", None, "Größe 😀"])))
    rows += [(c, t, "user", "deep" if t < 60 else f"{c % 2}") for c in (60, 61, 62) for t in range(70)]  # several levels of bands
    rows += [(70, 1, "bot", "same row")] * 25 + [(None, 1, "user", "no id"), (None, None, None, None)]
    rnd.shuffle(rows)
    found = P.trie(turns_of(spark, rows))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {f.dataType.simpleString() for f in found.schema.fields[:-1]} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=str) == slow_trie(rows, 5, 9)


def test_op13_hot_conversation_and_many_equal_ones(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(700)] + [(c, 0, "user", "hello") for c in range(1, 6000)]
    found = sorted(map(tuple, P.trie(turns_of(spark, rows)).collect()), key=str)
    assert found == slow_trie(rows, 5, 9)


def test_op13_empty_and_turnless(spark):
    assert P.trie(turns_of(spark, [])).count() == 0
    assert P.trie(turns_of(spark, [(None, 0, "user", "x")])).count() == 0
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)  # no such first conversation: no turns
    found = [tuple(r) for r in P.trie(turns_of(spark, [(lone, 0, "user", "gone")])).collect()]
    assert found == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
