"""The numbered queries on the driver's smallest tables, and the pipeline's stages on planted ones, against plain versions."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import quality_mil, queries, secret_scan
from tests.llm.test_ops import brute_components, brute_dedup, brute_fill, brute_hits, prose

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@needs_tables
def test_op1_counts_as_the_library_does(spark, texts):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = queries.op1_token_counts(spark, SF).collect()
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(texts)
    assert all(r["over_limit"] == (want[r["doc_id"]] > 512) and r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in got)


@needs_tables
def test_op3_reports_every_candidate(spark, texts):
    got = queries.op3_secret_scan(spark, SF).collect()
    want = {(i, b, e, k) for i, t in texts.items() for k, b, e, _ in secret_scan.candidates(t)}
    assert {(r["doc_id"], r["start"], r["end"], r["kind"]) for r in got} == want and len(got) == len(want)
    assert all(0 <= r["score"] <= 1 and r["is_secret"] == (r["score"] >= 0.5) for r in got)


@needs_tables
def test_op5_against_the_pages_own_articles(spark):
    """The driver's pages hold one article each: its blocks, by a few patterns."""
    import html
    import re

    got = {r["page_id"]: r for r in queries.op5_html_extract(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"(?s)<article>(.*)</article>", p["html"]).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"]) and got[p["page_id"]]["url"] == p["url"]


@needs_tables
def test_op6_against_brute_force(spark, texts):
    got = {r["doc_id"]: r["text"] for r in queries.op6_line_dedup(spark, SF).collect()}
    ids = sorted(texts)
    want = brute_dedup([texts[i] or "" for i in ids])
    assert [got[i] or "" for i in ids] == want and any(w != (texts[i] or "") for i, w in zip(ids, want, strict=True))


@needs_tables
def test_op7_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got, hits, asked = queries.op7_additive_ann(spark, SF).collect(), 0, [i for i in ids if i % 50 == 0]
    for q in asked:
        s = np.where(ids == q, -9, unit @ unit[np.flatnonzero(ids == q)[0]])
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r["score"] - s[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(asked) and len(got) == 5 * len(asked)


@needs_tables
def test_op10_holds_rows_out(spark, texts):
    got = {r["doc_id"]: r for r in queries.op10_quality_mil(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


@needs_tables
def test_op10_against_plain_scores(spark, texts):
    """The model fitted on a sample gathered here, and every document scored by itself, passage by passage."""
    marks = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["quality"] is not None and r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            marks[r["doc_id"]] = min(r["quality"], marks.get(r["doc_id"], 1))
    bags = []
    for i in sorted(marks):
        f = quality_mil.passage_features(texts[i])
        bags.append((f[np.linspace(0, len(f) - 1, 40).astype(np.int64)] if len(f) > 40 else f).astype(np.float16))
    model = quality_mil.GatedAttentionMIL().fit(bags, np.array([float(marks[i]) for i in sorted(marks)]))
    p, gate = model.p, lambda x: 1 / (1 + np.exp(-x))
    got = {r["doc_id"]: r["score"] for r in queries.op10_quality_mil(spark, SF).collect()}
    for i, text in texts.items():
        weights, held = 0.0, np.zeros(p["c"].shape)
        for passage in quality_mil.passage_features(text).astype(np.float64):
            h = np.tanh((passage - model.mean) / model.scale @ p["W"] + p["b"])
            weight = np.exp((np.tanh(h @ p["V"]) * gate(h @ p["U"])) @ p["w"])
            weights, held = weights + weight, held + weight * h
        assert abs(got[i] - gate(held / weights @ p["c"] + p["d"])[0]) < 1e-3


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark: junk, passages, near copies, benchmark passages, awkward rows."""
    at, rng = str(tmp_path_factory.mktemp("planted")), random.Random(30)
    items = [(i, prose(rng, 40, 5000)) for i in range(5)]
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(prose(rng, rng.randrange(20, 60), 3000) for _ in range(4))
        if i % 4 == 3:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        rows.append((i, text, rng.choice(["a", "b", None])))
        labels.append((i, int(i % 4 != 3)))
    passage = "\n".join(prose(rng, 12, 3000) for _ in range(6))
    rows += [(300 + i, f"{prose(rng, 30, 3000)}\n{passage}\n{prose(rng, 30, 3000)}", "a") for i in range(4)]
    base = prose(rng, 120, 3000).split()
    rows += [(310 + i, " ".join([*base[: 20 + i], "changed", *base[21 + i :]]), "b") for i in range(4)]
    rows += [(320 + i, f"{prose(rng, 60, 3000)} {items[i][1]} {prose(rng, 60, 3000)}", "c") for i in range(3)]
    rows += [(330, rows[0][1], "a"), (331, None, "a"), (332, "", None), (333, "word " * 30_000, "b"), (None, prose(rng, 50, 3000), "b"), (334, prose(rng, 50, 3000), "a"), (334, prose(rng, 50, 3000), "a")]
    table = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    table.repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (331, None)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_against_plain_versions(spark, planted, tmp_path_factory):
    handed, at = {}, str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, planted).write.parquet(f"{at}/{name}")
        handed[name] = docs = spark.read.parquet(f"{at}/{name}")
    rows = {name: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()] for name, df in handed.items() if name != "mix"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mix"]
    assert all(handed[n].columns == corpus_pipeline.COLUMNS for n in rows)

    # Quality: the classifier's decisions, and what they are worth on rows it has not seen.
    kept = {i for i, _, _ in rows["quality"]}
    unseen = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(i in kept) == (i % 4 != 3) for i in unseen]) > 0.9

    key = lambda r: (r[0] is not None, r[0] or 0)
    before = sorted((r for r in rows["quality"] if r[0] is not None and r[0] != 334), key=key)
    cleaned = zip(before, brute_dedup([t or "" for _, t, _ in before]), strict=True)
    want = {i: text for (i, t, _), text in cleaned if text == (t or "") or text.strip()}
    got = {i: t or "" for i, t, _ in rows["line_dedup"] if i is not None and i != 334}
    assert got == want and any(i in got and passage_gone(rows["quality"], got, i) for i in (301, 302, 303))

    parts = brute_components([r for r in rows["line_dedup"] if r[0] is not None and r[0] != 334], 5, 80)
    assert {i for i, _, _ in rows["near_duplicates"] if i is not None and i != 334} == {i for i, (_, c) in parts.items() if i == c}
    assert sum(i == 334 for i, _, _ in rows["near_duplicates"]) == min(1, sum(i == 334 for i, _, _ in rows["line_dedup"]))
    assert sum(i is None for i, _, _ in rows["near_duplicates"]) == sum(i is None for i, _, _ in rows["line_dedup"])

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()]
    assert sorted((str(i), t) for i, t, _ in rows["decontamination"]) == sorted((str(i), t) for i, t, _ in rows["near_duplicates"] if not brute_hits(t, items)[3])

    mixed = handed["mix"].collect()
    sizes = {i: len((t or "").split()) for i, t, _ in rows["decontamination"]}
    names = sorted({s for _, _, s in rows["decontamination"] if s is not None}) + [None]
    totals = [sum(sizes[i] for i, _, s in rows["decontamination"] if s == n) for n in names]
    targets = dict(zip(names, brute_fill(totals, [(1, 2, 3)[k % 3] for k in range(len(names))], 3), strict=True))
    assert {r["doc_id"]: r["size"] for r in mixed} == sizes
    assert all(abs(r["target"] - targets[r["source"]]) < 1e-6 and r["taken"] == r["size"] * len(r["copies"]) <= 3 * r["size"] for r in mixed)

    again = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, planted).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in mixed}


def passage_gone(before, after, i):
    return len(after[i]) < len(next(t for j, t, _ in before if j == i))


def test_stages_of_empty_tables(spark, planted, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
