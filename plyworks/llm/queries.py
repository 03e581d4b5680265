"""The queries of the corpus operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, langid, lexical, licenses, linededup, media, minhash, mixing, packing, simhash, substring, toxicity, turntrie
from .common import held_out, table


def op1_collision_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_unit_dedup(spark, sf_dir):
    # Passages of over 50 words; their first and last units may be cut differently in each text, so half of that is asked for.
    spans = substring.repeated_spans(table(spark, sf_dir, "documents"), min_words=25)
    return spans.select(F.col("doc").alias("doc_id"), F.col("first").alias("start"), F.col("last").alias("end"), "units", "words", F.col("keeper").alias("kept_in"))


def op3_simhash_trie(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op4_license_patience(spark, sf_dir):
    return licenses.license_hits(table(spark, sf_dir, "documents"))


def op5_byte_convnet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = langid.fit_languages(docs)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.predict_language(net, F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op7_jpeg_media(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.store_media(F.col("text")).alias("media"))
    read = stored.withColumn("read", media.read_media("media"))
    payload = F.col("read.payload")
    return read.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.col("read.feature").alias("feature"),
    )


def op8_low_discrepancy_mix(spark, sf_dir):
    shares = mixing.document_shares(mixing.plan_mix(table(spark, sf_dir, "documents")))
    return shares.select("doc_id", "size", "source_size", "target", "taken")


def op9_variable_best_fit(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_line_bitmaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_bbit_minhash(spark, sf_dir):
    return minhash.near_sets(table(spark, sf_dir, "documents"), width=2, least=0.8).select("doc_id", "n_shingles", "component_id", "kept")


def op12_prefix_trie(spark, sf_dir):
    turns = turntrie.numbered_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    turns, members = turntrie.grafted(turns, base=conv - conv % 5, head=F.crc32(conv.cast("string").cast("binary")) % 9)
    return turntrie.prefix_trie(turns, members)


def op13_bisected_search(spark, sf_dir):
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_collision_ann, op2_unit_dedup, op3_simhash_trie, op4_license_patience, op5_byte_convnet, op6_kneser_ney, op7_jpeg_media, op8_low_discrepancy_mix, op9_variable_best_fit, op10_line_bitmaps, op11_bbit_minhash, op12_prefix_trie, op13_bisected_search, pipeline)}

SQL = {
    "op10_line_bitmaps": r"""
WITH lines AS (
  SELECT doc_id, n, line, lower_ascii AS key FROM (
    SELECT doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents))
), often AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.n, l.line, coalesce(l.doc_id < o.top, false) AS gone FROM lines l LEFT JOIN often o USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_bbit_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT u AS doc_id, u AS low FROM links
  UNION
  SELECT l.v, r.low FROM reach r JOIN links l ON l.u = r.doc_id WHERE r.low < l.v
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, d.doc_id = coalesce(m.low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
""",
    "op12_prefix_trie": r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)
), rebuilt AS (
  SELECT v.c, 0 AS part, o.pos, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.pos < v.h
  UNION ALL SELECT v.c, 1, o.pos, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.pos >= v.h
), numbered AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, strlen(text) AS b, strlen(role) || ':' || role || strlen(text) || ':' || text AS turn FROM rebuilt
), prefixes AS (
  SELECT c, d, b, md5(string_agg(turn, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key FROM numbered
  UNION ALL SELECT c, 0, 0, '' FROM convs
), nodes AS (
  SELECT key, d, min(c) AS conv_id, count(*) AS n, min(b) AS b FROM prefixes GROUP BY key, d
), ups AS (
  SELECT n.*, p.key AS up FROM nodes n LEFT JOIN prefixes p ON p.c = n.conv_id AND p.d = n.d - 1
), children AS (
  SELECT up, count(*) AS n_children FROM ups GROUP BY up
), under AS (
  SELECT p.key AS top, p.d AS top_d, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((n.n - 1) * n.b) AS saved
  FROM ups n JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.d LEFT JOIN children k ON k.up = n.key GROUP BY p.key, p.d
), ends AS (
  SELECT p.key, p.d, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids
  FROM prefixes p JOIN (SELECT c, max(d) AS d FROM prefixes GROUP BY c) l ON l.c = p.c AND l.d = p.d GROUP BY p.key, p.d
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children,
  t.n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM ups n LEFT JOIN nodes u ON u.key = n.up AND u.d = n.d - 1 LEFT JOIN children k ON k.up = n.key
JOIN under t ON t.top = n.key AND t.top_d = n.d LEFT JOIN ends e ON e.key = n.key AND e.d = n.d
""",
    "op13_bisected_search": r"""
WITH terms AS (
  SELECT doc_id, row_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents)
), counts AS (SELECT row_no, doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT row_no, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY row_no),
totals AS (SELECT CAST(count(*) AS BIGINT) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT c.term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(N_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM counts c, totals WHERE c.term IN (SELECT term FROM asked) GROUP BY c.term
), scores AS (
  SELECT a.item_id, c.row_no, c.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * N_docs) // L)))) AS BIGINT) AS score
  FROM asked a JOIN weights USING (term) JOIN counts c USING (term) JOIN lengths USING (row_no), totals GROUP BY a.item_id, c.row_no, c.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""",
}
