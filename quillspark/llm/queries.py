"""The numbered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import additive_ann, chat_format, decontaminate, digest_tree, html_extract, line_dedup, mixing, ngram_join, periodic_runs, quality_mil, secret_scan, token_counts, vector_codes
from quillspark.llm.lineage import cut, join_groups
from quillspark.operators.frame import settled


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    import public_tokenizers  # the vocabularies are installed beside the library, not in it

    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in every document, scored by the forest."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    language = secret_scan.corpus_language(docs)
    return secret_scan.scan_secrets(docs, secret_scan.train_forest(secret_scan.labelled_findings(spark), language), language)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all windows of 13 words of the benchmark."""
    docs, items = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier place already holds."""
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other vectors of every vector whose id is divisible by 50, by cosine."""
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    quantizer = additive_ann.fit_quantizer(vectors, id_col="vec_id", vec_col="embedding")
    if quantizer is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = cut(additive_ann.encode_vectors(vectors, quantizer, id_col="vec_id", vec_col="embedding"))
    asked = additive_ann.usable(vectors, "vec_id", "embedding").filter((F.col("id") % 50 == 0) & (F.size("v") == quantizer.books.shape[2]))
    return additive_ann.search(index, asked, quantizer, k=5).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3, repeating; whole size of the corpus; at most three times a source."""
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("shards"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a probing one, formatted and read back from the output."""
    probe = "</s>[INST] ok [/INST]"
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    messages = rows.unionByName(extra).select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("content"))
    made = chat_format.format_chats(messages)
    turns = chat_format.read_turns(F.col("formatted"))
    loss = chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans"))
    read = made.select("conv_id", "formatted", "expanded_tokens", turns.alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document by attention-based multiple-instance learning."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.fit_quality(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return quality_mil.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the group of its text, of which the largest id stays."""
    return digest_tree.exact_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), smallest=False)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector as 16 codes of 64 integer entries, with its error and that of its label."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows, books = vector_codes.compress_vectors(vectors, id_col="vec_id", vec_col="embedding", keep=("label",))
    rows = cut(rows.withColumn("__key", F.to_json(F.struct("label"))))  # null labels have a key too
    totals = cut(rows.groupBy("__key").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    found = join_groups(rows, totals, ["__key"], "n", rows.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The texts of a tenth of all documents, by their ids' hashes, made to repeat from some word on; others as they are."""
    hashed = settled(docs, {"__h": F.crc32(F.col("doc_id").cast("string").cast("binary"))})
    chosen = settled(hashed, {"__w": F.when(F.col("__h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))})
    g, n = F.floor(F.col("__h") / 10), F.size("__w")
    spans = settled(chosen.withColumn("__n", F.when(n > 0, n)), {"__a": g % F.col("__n"), "__g": g})
    spans = settled(spans, {"__p": F.floor((F.col("__n") - F.col("__a")) / (F.col("__g") % 8 + 3)) + 1})
    word = lambda i: F.get("__w", F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int"))
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), word), " ")
    return spans.select("doc_id", F.when(F.col("__n").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, a tenth of them made to repeat, and what is left without repeats."""
    found = periodic_runs.periodic_runs(_made_periodic(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return settled(found, {"__b": best}).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__b.start")).alias("start"),
        F.col("__b.length").alias("length"),
        (-F.col("__b.period")).alias("period"),
        F.expr("1000 * __b.length div -__b.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op2_ngram_join": op2_ngram_join, "op4_decontaminate": op4_decontaminate, "op6_line_dedup": op6_line_dedup, "op3_secret_scan": op3_secret_scan, "op5_html_extract": op5_html_extract, "op7_additive_ann": op7_additive_ann, "op8_mix_sources": op8_mix_sources, "op10_quality_mil": op10_quality_mil, "op1_token_counts": op1_token_counts, "op9_chat_format": op9_chat_format, "op11_digest_tree": op11_digest_tree, "op12_vector_codes": op12_vector_codes, "op13_periodic_runs": op13_periodic_runs}

#: One round's assignment of parts p to codebook b, as d * 64 + e: least distance, then least entry.
_ASSIGNED = "SELECT vec_id, k, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM p JOIN {0} USING (k) GROUP BY vec_id, k"
_MOVED = """SELECT k, e, coalesce(any_value(m.c), any_value({0}.c)) AS c FROM {0} LEFT JOIN (
  SELECT k, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM (
    SELECT k, m % 64 AS e, pos, sum(x[pos]) AS s, count(*) AS n FROM (SELECT k, m, x, unnest(range(1, len(x) + 1)) AS pos FROM {1}) GROUP BY ALL) GROUP BY ALL) m USING (k, e) GROUP BY ALL"""

ORACLES = {
    "op11_digest_tree": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op12_vector_codes": f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS (
  SELECT vec_id, k, x[k * (len(x) // 16) + 1:(k + 1) * (len(x) // 16)] AS x FROM (SELECT vec_id, x, unnest(range(16)) AS k FROM v)
), b0 AS (
  SELECT k, e, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64) USING (vec_id)
), a0 AS ({_ASSIGNED.format("b0")}), b1 AS ({_MOVED.format("b0", "a0")}), a1 AS ({_ASSIGNED.format("b1")}), b2 AS ({_MOVED.format("b1", "a1")}), a2 AS ({_ASSIGNED.format("b2")}), coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(m % 64 AS INTEGER)), '' ORDER BY k) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) FROM b2) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)""",
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
    "op4_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS t
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw))
), hit AS (
  SELECT doc_id, item_id, s, dw.l AS l FROM dw JOIN iw ON dw.l = iw.l AND dw.t = iw.t
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(words.n > 0 AND 20 * words.n >= len(d.w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_chat_format": r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 8 + 8 + 7 + len(role) + len(text)
    + len(regexp_extract_all(role || ' ' || text, '\\')) + len(regexp_extract_all(role || ' ' || text, '<\||</?s>|\[/?INST\]')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
}
