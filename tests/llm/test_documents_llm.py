"""Mixing, Jaccard join, language ID, toxicity, licences, URL rules and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodemap.operators import linking
from lodemap.scratch import Scratch
from lodemap.llm import bpe, jaccard_join as J, langid, licenses as L, mixing as M, queries, toxicity as X, url_filter as U


# --- mixing --------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return full
        left = total - sum(full.values())
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= most * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in free}
        full |= {s: float(most * sizes[s]) for s in over}


def nearest_sum(sizes, target):
    """The sum of whole passes and some documents once more that is nearest to the target."""
    whole, reach = sum(sizes), 1
    passes = min(2, int(target // whole)) if whole else 0
    for n in sizes if passes < 2 else []:
        reach |= reach << n
    return min((abs(passes * whole + s - target) for s in range(reach.bit_length()) if reach >> s & 1))


def mixed(docs):
    sized = M.written_sizes(docs)
    return M.copies(sized, M.plan(sized))


def rows_to_mix():
    rnd = random.Random(8)
    rows = []
    for i in range(900):
        source = rnd.choice(["a", "b", "c", "Z", "é", None])
        rows.append((i, " ".join(["w"] * (7 if i % 3 == 0 else rnd.randrange(60))), "en", source))
    rows += [(900 + i, "same size here", "en", "hot") for i in range(600)]  # one source and length
    return rows + [(5, "again again", "en", "b")] * 40 + [(None, None, None, None), (7777, "", None, "empty")]


def test_op4_targets_and_sums(documents, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 50)
    rows = rows_to_mix()
    got = mixed(documents(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted((i is None, i, len((t or "").split())) for i, t, *_ in rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.copies in (0, 1, 2)
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= nearest_sum([len((t or "").split()) for _, t, _, o in rows if o == s], want[s]) + 1e-6, s


def test_op4_reruns_agree_and_mix_repeats_rows(documents):
    rows = rows_to_mix()
    one, two = (sorted(map(tuple, mixed(documents(d)).select("doc_id", "size", "copies").na.fill(-1).collect())) for d in (rows, rows[::-1]))
    assert one == two
    docs = documents(rows)
    out = M.mix(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(M.size())).first()[0] == sum(size * n for _, size, n in one)


def test_op4_empty(documents):
    assert mixed(documents([])).count() == 0 and M.mix(documents([])).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 7, 30, 98.4, 98.6, 99, 100, 1000])
def test_fit_is_the_nearest_sum(budget):
    length, count = np.array([0, 3, 10, 11]), np.array([4, 2, 3, 5])
    take = M.fit(length, count, budget)
    assert (take >= 0).all() and (take <= count).all()
    sums = {0}
    for size, n in zip(length, count):
        sums = {s + size * k for s in sums for k in range(n + 1)}
    assert abs(int((take * length).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_large():
    rng = np.random.default_rng(0)
    length, count = np.arange(1, 4000), rng.integers(0, 400, 3999)
    for budget in (12_345, 1_234_567, 300_000_001):
        assert (M.fit(length, count, budget) * length).sum() == budget


# --- Jaccard join ---------------------------------------------------------------------

def shingles(text, words=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute_join(rows, words=4, least=85):
    sets = [shingles(t, words) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)), key=lambda c: rows[c][0])
                    root[y] = x
    return sorted(((i, len(sets[k]), rows[find(k)][0]) for k, (i, *_) in enumerate(rows)), key=lambda r: (r[0] is None, r))


def near_rows():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["É", "a", "THE"]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, base, shared = [], make(90), make(60)
    for _ in range(70):  # near copies of one, some further apart than the threshold
        text = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append(" ".join(text))
    rows += [" ".join(make(rnd.randrange(1, 40)) + shared + make(rnd.randrange(1, 60))) for _ in range(60)]  # a common passage
    rows += ["the same short text"] * 50 + ["two words", "Two  WORDS", "three small words", None, "", " \n", "x" * 3000, "r " * 5000, "r " * 5100]
    for n in (6, 7, 8, 12, 20, 21, 30):
        t = make(n)
        rows += [" ".join(t), " ".join(t + ["tail"]), " ".join(["head"] + t)]
    rnd.shuffle(rows)
    return [(7 * i % 1009, t, None, None) for i, t in enumerate(rows)] + [(None, "the same short text", None, None), (3, "again here it is", None, None), (3, "again here it is", None, None)]


def joined(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(docs).collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("light", [None, 0, 15, 100])
def test_op5_components(documents, monkeypatch, light):
    if light is not None:
        monkeypatch.setattr(J, "boundary", lambda *a, **k: light)
    assert joined(documents(near_rows())) == brute_join(near_rows())


def test_op5_long_lists_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(J, "SHORT", 3)
    monkeypatch.setattr(linking, "BLOCK", 8)
    monkeypatch.setattr(linking, "SLOW", 0.0)  # one round of stars, then blocks
    monkeypatch.setattr(linking, "FEW", 0)
    assert joined(documents(near_rows())) == brute_join(near_rows())


def test_op5_bitmaps_never_allow_sizes_that_cannot_link():
    """A large set's bitmap folded to a small one's width differs from it in fewer places than the sizes do in keys."""
    rng = np.random.default_rng(3)
    small, large = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (200, 5000))
    maps = [[J._bitmap(keys, 85, J.NARROW)] for keys in (small, large)]
    one = np.zeros(1, np.int64)
    assert not J._allowed(*maps, one, one, np.array([200]), np.array([5000]), 85)[0]


def test_op5_blocks_tell_groups_just_below_the_threshold(documents, monkeypatch):
    """Near copies of one text that link with it but not with each other: few of their pairs go to exact checking."""
    rnd, table, checked = random.Random(4), Scratch.table, []
    base = [f"w{rnd.randrange(10**6)}" for _ in range(100)]

    def watch(self, df, name):
        out = table(self, df, name)
        if name == "rest":
            checked.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "table", watch)
    monkeypatch.setattr(linking, "SLOW", 0.0)
    monkeypatch.setattr(linking, "FEW", 0)
    rows = []
    for i in range(300):  # 97 shingles, of which two copies share about 70
        words = list(base)
        for at in rnd.sample(range(30, 95, 5), 4):
            words[at] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(words), "en", "s"))
    assert joined(documents(rows)) == brute_join(rows)
    assert sum(checked) < 4500


def test_op5_pairs_of_one_large_group_grow_in_proportion(documents, monkeypatch):
    """Documents that are all near copies of one: pairs that are checked follow their number, not its square."""
    rnd, table, checked = random.Random(9), Scratch.table, []
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]

    def watch(self, df, name):
        out = table(self, df, name)
        if name == "likely" or name == "rest" or name.endswith("-likely"):
            checked[-1] += out.count()
        return out

    monkeypatch.setattr(Scratch, "table", watch)
    for n in (400, 1200):
        rows = []
        for i in range(n):
            words = list(base)
            for at in rnd.sample(range(200), 2):
                words[at] = f"x{rnd.randrange(10**9)}"
            rows.append((i, " ".join(words), "en", "s"))
        checked.append(0)
        assert {r["component_id"] for r in J.join(documents(rows)).collect()} == {0}
    assert checked[1] < 20_000 and checked[1] < 4.5 * checked[0]


def test_op5_empty_and_one_of_each(documents):
    assert J.join(documents([])).count() == 0
    rows = near_rows()
    docs = documents(rows)
    kept = J.one_of_each(docs, J.join(docs))
    assert kept.columns == docs.columns
    want = sorted({c for i, _, c in brute_join(rows) if i is not None}) + [None]
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i)) == want


def test_boundary_balances_costs():
    sizes, counts = np.arange(2, 200), np.full(198, 10.0)
    ends = [J.boundary(sizes, counts, scan) for scan in (0.0, 3.0, 30.0)]
    assert ends == sorted(ends) and ends[0] < ends[-1]


# --- language ID ----------------------------------------------------------------------

def lang_rows():
    en, de, es = "the cat and the dog of the house with that", "der hund und die katze von dem haus mit einer", "el gato y la casa de los perros con una"
    rnd = random.Random(1)
    rows = []
    for i in range(120):
        lang, words = (("en", en), ("de", de), ("es", es))[i % 3]
        rows.append((i, " ".join(rnd.choices(words.split(), k=rnd.randrange(3, 30))), lang, None))
    return rows + [(200, None, "en", None), (201, "", "de", None), (202, "123 !! 45", "es", None), (203, "the house " * 20_000, None, None), (None, "der hund und die katze", None, None)]


def test_op10_learns_and_rejects(documents):
    docs = documents(lang_rows())
    got = {r.doc_id: r for r in langid.identify(docs, langid.split_fit(docs)).collect()}
    right = [got[i].lang_pred == lang for i, t, lang, _ in lang_rows() if i is not None and i < 200]
    assert sum(right) >= 0.97 * len(right)
    assert [got[i].lang_pred for i in (200, 201, 202, 203, None)] == ["und"] * 3 + ["en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.known_language(docs, langid.split_fit(docs))
    assert kept.columns == docs.columns and kept.count() == len(got) - 3


def test_op10_code_lengths_are_exact():
    """PPM by hand: one training text, contexts of up to three bytes, method C."""
    text = b"abracadabra"
    padded, counts = b"\0\0\0" + text, {}
    for at in range(3, len(padded)):
        g = int.from_bytes(padded[at - 3 : at + 1], "big")
        counts[g] = counts.get(g, 0) + 1
    keys = np.array(sorted(counts), np.uint32)
    trees = langid.Trees(["x"], {"x": (keys, np.array([counts[int(k)] for k in keys]))})

    def bits(history, byte):
        total = 0.0
        for k in range(3, -1, -1):
            seen = {}
            for g, n in counts.items():
                b = g.to_bytes(4, "big")
                if b[3 - k : 3] == history[3 - k :]:
                    seen[b[3]] = seen.get(b[3], 0) + n
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if byte in seen:
                return total - np.log2(seen[byte] / whole)
            total -= np.log2(len(seen) / whole)
        return total + 8
    tests = [(b"abr", ord("a")), (b"abr", ord("z")), (b"zzz", ord("b")), (b"\0\0\0", ord("a")), (b"cad", ord("c"))]
    codes = np.array([int.from_bytes(h + bytes([c]), "big") for h, c in tests], np.uint32)
    assert trees.cost(codes)[:, 0] == pytest.approx([bits(h, c) for h, c in tests], rel=1e-5)


def test_op10_nothing_to_learn(documents):
    docs = documents([(1, "text", None, None), (2, None, "en", None)])
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(docs)).collect()} == {("und", 0.0)}
    assert langid.identify(documents([]), langid.fit(documents([]))).count() == 0


def test_op10_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    held = got.where("held_out").select("doc_id", "lang", "lang_pred").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


# --- toxicity -------------------------------------------------------------------------

def test_op6_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op6_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert hit >= 0.75 * sum(r.toxic for r in got) and hit >= 0.9 * sum(r.predicted for r in got)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_op6_odd_texts_and_missing_classes(spark, documents, odd_texts):
    rows = [(i, t, None, None) for i, t in enumerate(odd_texts)] + [(None, "no id", None, None)]
    docs = documents(rows)
    schema = "doc_id long, toxic int, text string"
    assert X.fit(docs, spark.createDataFrame([(4, 1, "")], schema)) is None
    assert {r.score for r in X.toxicity(docs, None).collect()} == {0.0}
    plain = [(100 + i, f"good words here number {i % 7} and more", None, None) for i in range(60)]
    bad = [(200 + i, f"you vile idiot number {i % 7} and more", None, None) for i in range(60)]
    docs = documents(rows + plain + bad)
    marks = [(i, int(i >= 200), "") for i, *_ in plain + bad] + [(None, 1, ""), (3, None, ""), (2, 7, "")]
    model = X.fit(docs, spark.createDataFrame(marks, schema))
    got = {r.doc_id: r.predicted for r in X.toxicity(docs, model).collect()}
    assert all(got[i] == 1 for i, *_ in bad) and not any(got[i] for i, *_ in plain) and not any(got[i] for i in range(len(odd_texts)))
    kept = X.not_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) + len(plain)
    assert X.toxicity(documents([]), model).count() == 0


def brute_kneser_ney(marked, texts):
    """(class, before, word) -> probability, by the definition, for every context and every word of `texts`."""
    classes = {1: [t.split() for t, y in marked if y], 0: [t.split() for t, y in marked if not y]}
    pairs = {c: Counter(p for t in ts for p in {*zip([None, *t], t)}) for c, ts in classes.items()}
    inside = {c: Counter(w for t in ts for w in set(t)) for c, ts in classes.items()}
    kinds = {c: Counter(w for _, w in pairs[c]) for c in classes}

    def telling(counts):
        size = {c: sum(counts[c].values()) for c in counts}
        share, out = size[1] / (size[0] + size[1]), set()
        for x in {*counts[0], *counts[1]}:
            t, o = counts[1][x], counts[0][x]
            expected = (t + o) * share
            if max(t, o) > X.DISCOUNT and abs(t - expected) > X.TELLING * (expected * (1 - share)) ** 0.5:
                out.add(x)
        return out

    words, told = telling(inside), telling(pairs)
    every = Counter(w for t in texts for w in t.split())
    whole = sum(every.values()) + len(every) + 1
    shared = {w: (n + 1) / whole for w, n in every.items()} | {"never": 1 / whole}

    def level(counts, keep, below):
        size = sum(counts.values())
        own = {x: max(n - X.DISCOUNT, 0) / size for x, n in counts.items() if x in keep}
        rest = 1 - sum(own.values())
        return {w: own.get(w, 0) + rest * p for w, p in below.items()}

    out = {}
    for c in classes:
        low = level(kinds[c], words, shared)
        for v in [None, *every, "never"]:
            here = Counter({w: n for (b, w), n in pairs[c].items() if b == v})
            at = level(here, {w for b, w in told if b == v}, low) if here else low
            out |= {(c, v, w): p for w, p in at.items()}
    return out


def test_op6_is_kneser_ney_in_every_context(spark, documents, monkeypatch):
    monkeypatch.setattr(X, "FIT_SHARE", 1.0)  # no documents for the curve: all of them for the models
    rng = random.Random(6)
    common = [f"w{i}" for i in range(30)]
    text = lambda bad: " ".join(["you vile idiot" if bad and rng.random() < 0.2 else "a kind word" if rng.random() < 0.1 else rng.choice(common) for _ in range(rng.randint(1, 25))])
    marked = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(200)]
    texts = [t for t, _ in marked] + ["w1 idiot other", "vile vile vile", "w1"] * 5
    docs = documents([(i, t, None, None) for i, t in enumerate(texts)])
    model = X.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(marked)], "doc_id long, toxic int"))
    want = brute_kneser_ney(marked, texts)
    names = sorted({w for _, _, w in want})
    assert len(model.words) and len(model.contexts) and len(model.pairs)
    code = dict(zip([None, *names], np.concatenate([np.zeros(1, np.uint64), X.hash_words(names)])))
    for v in [None, *names]:
        for c in (0, 1):
            assert sum(want[c, v, w] for w in names) == pytest.approx(1)
        before, word = np.full(len(names), code[v]), np.array([code[w] for w in names])
        got = model.likelihoods(before, word, X.mix(before, word))
        plain = np.array([[want[1, v, w], want[0, v, w]] for w in names])
        expect = (1 - X.SHARED) * plain + X.SHARED * plain.mean(1, keepdims=True)
        # a word that no pair or class tells of has no entry: both its probabilities lack one factor, its count
        assert np.allclose(got[:, 0] / got[:, 1], expect[:, 0] / expect[:, 1])
        stored = X.find(model.words, word)[1]
        assert np.allclose(got[stored], expect[stored])
        assert got[stored].sum(0) + expect[~stored].sum(0) == pytest.approx(1)


# --- licences -------------------------------------------------------------------------

def test_op3_families(documents):
    rnd = random.Random(2)
    prose = lambda: " ".join(rnd.choices("thor erin with the of and license oush ation ble".replace("license ", "").split(), k=20)).capitalize() + "."
    rows = [(i, "\n".join(prose() for _ in range(3)), None, None) for i in range(300)]
    planted = {400: "mit", 401: "apache", 402: "gpl", 403: "cc-by-nc", 404: "bsd"}
    for i, family in planted.items():
        for k, notice in enumerate(L.NOTICES[family]):
            rows.append((10 * i + k, f"{prose()}\n{notice}\n{prose()}", None, None))
    rows.append((9000, prose() + " " + L.NOTICES["mit"][0] + " " + prose(), None, None))
    rows += [(9001, None, None, None), (9002, "", None, None), (9003, "He lost his license on the way to the library.", None, None), (None, "Licensed under CC BY-NC 4.0.", None, None)]
    docs = documents(rows)
    got = {r.doc_id: r for r in L.scan(docs, L.fit(docs)).collect()}
    assert len(got) == len(rows)
    for i, family in planted.items():
        for k in range(len(L.NOTICES[family])):
            assert got[10 * i + k].license == family, (family, k, got[10 * i + k])
    assert got[9000].license == "mit" and got[None].license == "cc-by-nc"
    assert all(got[i].license is None and got[i].families == [] for i in [*range(300), 9001, 9002])
    assert got[9003].license in (None, "unknown")


def test_op3_finds_every_notice_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.license for r in queries.QUERIES["op3_licenses"](spark, folder).collect()}
    lines = {"GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Apache License, Version 2.0.": "apache"}
    want = {r.doc_id: next((f for line, f in lines.items() if line in r.text), None) for r in docs.collect()}
    assert got == want


def test_op3_a_notice_in_a_third_of_all_documents(documents):
    rnd = random.Random(4)
    prose = lambda: " ".join(rnd.choices("thor erin with the of and oush ation ble under in to a".split(), k=20)).capitalize() + "."
    footer = "Licensed under CC BY-NC 4.0."
    rows = [(i, "\n".join([prose() for _ in range(20)] + [footer] * (10 if i % 3 == 0 else 0)), None, "hot" if i % 3 == 0 else "cold") for i in range(900)]
    docs = documents(rows + [(1000, f"{prose()}\nReleased under the MIT License.", None, None)])
    got = {r.doc_id: (r.license, r.families, r.n_paragraphs) for r in L.scan(docs, L.fit(docs)).collect()}
    assert got.pop(1000) == ("mit", ["mit"], 1)
    assert got == {i: ("cc-by-nc", ["cc-by-nc"], 10) if i % 3 == 0 else (None, [], 0) for i in range(900)}


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:""",
    "gpl": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or""",
}


def test_op3_wrapped_notices(documents):
    rnd = random.Random(5)
    prose = lambda: " ".join(rnd.choices("thor erin with the of and oush ation ble under in to a".split(), k=12)).capitalize() + "."
    rows = [(i, "\n".join(prose() for _ in range(9)), None, None) for i in range(200)]
    rows += [(1000, WRAPPED["mit"], None, None), (1001, f"{prose()}\n{WRAPPED['bsd']}\n{prose()}", None, None), (1002, f"{prose()}\r\n\r\n" + WRAPPED["gpl"].replace("\n", "\r\n"), None, None)]
    rows += [(1003, f"{WRAPPED['bsd']}\nReleased under the MIT License.\nLicensed under CC BY 4.0.\n\n{WRAPPED['gpl']}", None, None)]
    rows += [(1004, "\n".join(L.NOTICES["lgpl"][1].split()), None, None), (1005, "Released under\n\nthe MIT License.", None, None)]
    docs = documents(rows)
    got = {r.doc_id: (r.license, r.families, r.n_paragraphs) for r in L.scan(docs, L.fit(docs)).collect()}
    for i, family in ((1000, "mit"), (1001, "bsd"), (1002, "gpl"), (1004, "lgpl")):
        assert got[i] == (family, [family], 1), i
    assert got[1003][1:] == (["bsd", "cc-by", "gpl", "mit"], 4)
    assert got[1005][0] in (None, "unknown")
    assert all(got[i] == (None, [], 0) for i in range(200))


# --- URL rules ------------------------------------------------------------------------

def brute_url(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


@pytest.mark.parametrize("many", [False, True])
def test_op8_rules(spark, many):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/", "https://example.com/en", "http://x.net/es/?q", "http://x.net?/es/", "http://x.net#/fr/", "net/fr/", None, "",
            "://", "http://", "http://com", "http://com/", "http://.com/", "http://a..com/", "http://evilexample.com/en/", "ftp://É.COM/É", "http://x.net/fr/a/b://c", "http://a.net:80/fr/",
            "http://" + "a." * 200 + "net/es/" + "p" * 5000] + ["http://hot.example.org/p"] * 50 + [f"http://h{i}.example{i % 9}.com/en/{i}" for i in range(400)]
    rules = queries.URL_RULES + [U.Rule(f"example{i}.com", "/en/", "block") for i in range(5)] + [U.Rule(f"h{i}.example{i % 9}.com", f"/en/{i}", "allow") for i in range(0, 300, 2)] if many else queries.URL_RULES
    pages = spark.createDataFrame([(i, u, "h", "r", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, key int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(urls)}


def test_op8_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert U.judge(pages, []).first().verdict == "allow"
    assert U.judge(pages.limit(0), queries.URL_RULES).count() == 0


# --- pipeline -------------------------------------------------------------------------

def test_pipeline_stages(spark, folder):
    from lodemap.scratch import Scratch

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, scratch, counts = docs.columns, Scratch(spark, "test"), [docs.count()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.table(stage(spark, docs, folder), f"s{number}")
        counts.append(docs.count())
        if number < 4:
            assert docs.columns == columns
        if number == 2:
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for _, _, c in brute_join(rows, 5, 80)})
        if number == 3:
            sizes = {r.source: r.n for r in before.groupBy("source").agg(F.collect_list(M.size()).alias("n")).collect()}
            want = brute_targets({s: sum(n) for s, n in sizes.items()})
            got = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(M.size()).alias("n")).collect()}
            assert all(abs(got.get(s, 0) - t) <= nearest_sum(sizes[s], t) + 1e-6 for s, t in want.items())
    assert counts[0] == counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5]
    encoding = bpe._encoding(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert all(r.ids == encoding.encode_ordinary(texts[r.doc_id]) for r in docs.collect())


def test_pipeline_drops_near_copies_by_five_words_and_080(spark, documents, folder):
    base = [f"a{i}" for i in range(100)]
    far = [f"b{i}" for i in range(100)]
    texts = [base, base + [f"new{i}" for i in range(20)], far, far + [f"other{i}" for i in range(26)]]  # 96 of 116, 96 of 122
    docs = documents([(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()) == [0, 2, 3]
    rows = near_rows()
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(rows), folder).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({c for i, _, c in brute_join(rows, 5, 80) if i is not None})


def test_pipeline_of_odd_rows(spark, documents, odd_texts, tmp_path):
    rows = [(i, t, "en", None) for i, t in enumerate(odd_texts)] + [(None, "no id", None, "s")] + lang_rows()[:60]
    documents(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_common_slices_cover_all_rows():
    from lodemap.llm.common import slices

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n if n % 7 else None for n in range(60)]})
    parts = list(slices([batch], limit=100))
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 100 for p in parts)
