"""Operators 11 to 13 against plain versions, and at their edges."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import digest_tree, periodic_runs, queries, vector_codes

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- exact dedup


def plain_groups(rows, smallest=True):
    """{text: (keep_id, size)} of (id, text) rows."""
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    best = min if smallest else max
    return {t: (best((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("smallest", [True, False])
@pytest.mark.parametrize("slot_rows", [4, 16_384])
def test_exact_duplicates_against_groups(spark, smallest, slot_rows):
    rng = random.Random(5)
    texts = [f"Text {k} of ÄÖ" for k in range(60)] + ["", None, "HOT", "hot", "É", "é"]
    rows = [(i, rng.choice(texts + ["hot"] * 30)) for i in rng.sample(range(-500, 500), 400)] + [(None, "text 1 of ÄÖ"), (None, "nobody's"), (7000, "twice"), (7000, "TWICE")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, keep_id string, key string").repartition(7)
    got = digest_tree.exact_duplicates(docs, smallest=smallest, slot_rows=slot_rows).collect()
    want = plain_groups(rows, smallest)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in want.items()}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    assert all((r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]] for r in got)
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(by_sha) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = digest_tree.drop_duplicates(docs, smallest=smallest, slot_rows=slot_rows)
    assert left.columns == docs.columns
    lower = sorted((r["text"] or "").translate(LOWER) for r in left.collect())
    assert lower == sorted([*want, "twice"])  # rows alike in id and text stay together


def test_exact_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert digest_tree.exact_duplicates(docs).collect() == [] and digest_tree.drop_duplicates(docs).collect() == []


def test_runs_meet_in_rounds():
    """Every entry reaches the slot of its leading digits, whatever slot it sets out from, and keeps its order."""
    rng, bits, levels = random.Random(2), 2, 3
    keys = sorted(rng.randbytes(48) for _ in range(300))
    held = [(f, (k, n, n, 1)) for n, k in enumerate(keys) for f in (rng.randrange(64), rng.randrange(64))]
    slots = {f: sorted((e for g, e in held if g == f), key=lambda e: e[0]) for f in range(64)}
    for level in range(levels + 1):
        after = {}
        for slot, entries in slots.items():
            for run in digest_tree.sent(iter(entries), slot, level, levels, bits):
                after.setdefault(run["slot"], []).append(list(digest_tree.entries_of(run["keys"], run["ids"], run["places"], run["counts"])))
        slots = {slot: list(digest_tree.combined(digest_tree.heapq.merge(*runs, key=lambda e: e[0]), 1)) for slot, runs in after.items()}
    assert all(e[0][0] >> 2 == slot for slot, entries in slots.items() for e in entries)
    assert sorted((e[0], e[3]) for entries in slots.values() for e in entries) == [(k, 2) for k in keys]


def test_entries_of_other_lengths_are_not_combined():
    a, b = b"x" * 32 + bytes(16), b"x" * 32 + bytes(15) + b"\1"
    assert list(digest_tree.combined([(a, 3, 0, 1), (a, 2, 1, 1), (b, 1, 2, 1)], 1)) == [(a, 2, 1, 2), (b, 1, 2, 1)]


# -- vector codes


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    """{id: (code, error)} and the codebooks, by Python integers alone."""
    import math

    kept = sorted((i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v))
    dim = len(kept[0][1])
    ends = [p * dim // parts for p in range(parts + 1)]
    books = [[v[ends[p] : ends[p + 1]] for _, v in kept[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((x - c) ** 2 for x, c in zip(v[ends[p] : ends[p + 1]], entry)), e) for e, entry in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for _, v in kept:
            for p in range(parts):
                held[p][near(p, v)[1]].append(v[ends[p] : ends[p + 1]])
        books = [[[sum(c) // len(h) for c in zip(*h)] if h else entry for h, entry in zip(hs, book)] for hs, book in zip(held, books)]
    out = []
    for i, v in kept:
        found = [near(p, v) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return sorted(out), books


@pytest.mark.parametrize("dim", [32, 20, 5])
def test_codes_against_integers(spark, dim):
    rng = random.Random(dim)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in rng.sample(range(-100, 300), 150)] + [(1000 + k, [0.5] * dim) for k in range(40)]
    vectors += [(5000, None), (5001, [float("nan")] * dim), (5002, [None] * dim), (5003, [float("inf")] + [0.0] * (dim - 1))]
    odd = [(6000, [1.0] * (dim + 1)), (6001, [])]
    table = spark.createDataFrame([(i, v, "c") for i, v in vectors + odd], "id long, v array<double>, code string").repartition(5)
    rows, books = vector_codes.compress_vectors(table, id_col="id", vec_col="v")
    want, plain = plain_codes(vectors)
    assert sorted((r["id"], r["code"], r["error"]) for r in rows.collect()) == want
    assert [t.tolist() for t in books.tables] == plain
    assert books.sha256() == hashlib.sha256(",".join(str(x) for t in plain for e in t for x in e).encode()).hexdigest()


def test_codes_of_few_and_of_huge_vectors(spark):
    nothing, books = vector_codes.compress_vectors(spark.createDataFrame([(1, None)], "id long, v array<float>"), id_col="id", vec_col="v")
    assert nothing.collect() == [] and books is None
    rows, books = vector_codes.compress_vectors(spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], "id long, v array<float>"), id_col="id", vec_col="v", parts=2)
    assert sorted((r["id"], r["code"], r["error"]) for r in rows.collect()) == [(1, "0000", 0), (2, "0101", 0)] and books.tables[0].tolist() == [[1 << 24], [0]]


def test_first_of_equal_entries():
    books = vector_codes.Codebooks([np.array([[1, 1], [1, 1], [-1, -1]])])
    codes, error = books.assign(np.array([[1, 1], [0, 0], [-5, -5]]))
    assert codes.ravel().tolist() == [0, 0, 2] and error.tolist() == [0, 2, 32]
    assert books.moved({(0, 2, 0): (-7, 2), (0, 2, 1): (7, 2)}).tables[0].tolist() == [[1, 1], [1, 1], [-4, 3]]


@needs_tables
def test_op12_label_errors(spark):
    got = queries.op12_vector_codes(spark, SF).collect()
    rows = {r["vec_id"]: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want, plain = plain_codes([(i, r["embedding"]) for i, r in rows.items()])
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == want
    of = {}
    for i, _, e in want:
        of[rows[i]["label"]] = of.get(rows[i]["label"], 0) + e
    assert all(r["label_error"] == of[rows[r["vec_id"]]["label"]] for r in got)


# -- runs


def plain_runs(words, least=6, power=4):
    """All runs by their definition: stretches of each period, unless a smaller one holds there too."""
    n, found = len(words), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, power * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found)


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def test_runs_against_their_definition():
    rng = random.Random(1)
    for trial in range(400):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(4)):
            at, q, times = rng.randrange(len(words) + 1), rng.randrange(1, 14), rng.randrange(2, 8)
            part = [rng.choice(letters) for _ in range(q)]
            words[at:at] = (part * times)[: q * times - rng.randrange(q)]
        assert periodic_runs.find_runs(numbers(words)) == plain_runs(words), (trial, words)
        assert periodic_runs.find_runs(numbers(words), least=3, power=3) == plain_runs(words, 3, 3), (trial, words)


def test_long_runs_stay_linear():
    import time

    part = [f"w{i % 389}" for i in range(1000)]
    words = part * 60 + ["x"] * 60_000 + ["a", "b", "a"] * 20_000
    began = time.time()
    found = periodic_runs.find_runs(numbers(words))
    # The thousandth word is followed by the first again, so the inner numbering repeats only with the whole part.
    assert (0, 60_000, 1000) in found and (60_000, 60_000, 1) in found and (120_000, 60_000, 3) in found
    assert time.time() - began < 20


def test_runs_and_what_stays(spark):
    rows = [(1, "go go go go go go\tgo on"), (2, None), (3, ""), (4, "a b a b a b a b a"), (5, "a b a b a b a"), (6, "x x x x x"), (6, "x x x x x"), (None, "É é " * 6)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 8, [(0, 7, 1)], "go on"),
            (2, 0, [], ""),
            (3, 0, [], ""),
            (4, 9, [(0, 9, 2)], "a b"),
            (5, 7, [], "a b a b a b a"),
            (6, 5, [], "x x x x x"),
            (6, 5, [], "x x x x x"),
            (None, 6, [(0, 6, 1)], "É é"),
        ],
        key=str,
    )
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


@needs_tables
def test_op13_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert set(got) == set(texts)
    with_runs = 0
    for i, t in texts.items():
        words, h = (t or "").encode().split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        elif n > 3000:
            continue  # the plain version takes the square of a text
        runs = plain_runs(words)
        drop = {k for s, length, q in runs for k in range(s + q, s + length)}
        r = got[i]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        with_runs += bool(runs)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in drop)).hexdigest()
    assert with_runs >= 10


def test_made_periodic_handles_nulls(spark):
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in (None, "", "one", " a  b\tc d ")], "doc_id long, text string")
    for r in queries._made_periodic(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).collect():
        assert r["text"] is None or r["text"] == "" or r["h"] % 10 or " " not in r["text"] or len(r["text"].split(" ")) == 4
