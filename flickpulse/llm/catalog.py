"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flickpulse.llm import (
    ann, fingerprints, lexical, line_dedup, minhash_dedup, packing, quality_classifier, quality_rules, sentencepiece_codec, spelling,
    substring_dedup, url_filters, warc,
)
from flickpulse.llm.registry import query, table
from flickpulse.operators.scale import shared_root



def word_bpe() -> str:
    """Path of the word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    score = F.col("score")
    return quality_classifier.classify(docs, model).select(
        "doc_id", quality_rules.held_out("doc_id").alias("held_out"), score,
        (score >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_minhash_dedup", f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, least(len(w), 1)))) AS i FROM d),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS k FROM places),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    meets AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id
              GROUP BY ALL),
    links AS (SELECT a, b FROM meets JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
              WHERE 100 * inter >= 80 * (p.n + q.n - inter)),
    reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT doc_id, b FROM reach JOIN links ON a = other)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
    FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents, one row per document."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).select("doc_id", *quality_rules.COUNTS, "base_failed",
                                                   F.col("keep_").alias("kept"), "score")


@query("op6_substring_dedup", f"""
    WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
    win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS k FROM p WHERE i + 13 <= len(w)),
    least AS (SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM win JOIN least USING (k) WHERE first_doc < doc_id),
    kept AS (SELECT p.doc_id, string_agg(w[p.i + 1], ' ' ORDER BY p.i) FILTER (WHERE gone.i IS NULL) AS t,
                    count(gone.i) AS n_removed
             FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY p.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without the passages that earlier documents have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeated(docs).select(
        "doc_id", F.col("n_words_").alias("n_words"), F.col("n_removed_").alias("n_removed"),
        F.sha2("kept_text_", 256).alias("kept_sha256"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe())


@query("op1_line_dedup", r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                          unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
    worded AS (SELECT doc_id, i, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM lines),
    uniq AS (SELECT w, len(w) AS n, min(doc_id * 1000000 + i) AS place FROM worded WHERE len(w) > 0 GROUP BY w),
    long_ AS (SELECT * FROM uniq WHERE n >= 8),
    keyed AS (SELECT w, n, place, 'first' AS side, n + m AS longer, w[1:(n + m) // 2] AS half FROM long_, range(2) t(m)
              UNION ALL SELECT w, n, place, 'second', n + m, w[n - (n + m - (n + m) // 2) + 1:] FROM long_, range(2) t(m)),
    pairs AS (SELECT DISTINCT x.w AS w, x.place AS place, y.w AS v FROM keyed x JOIN keyed y USING (side, longer, half)
              WHERE y.place < x.place AND abs(x.n - y.n) <= 1),
    near AS (SELECT DISTINCT w FROM pairs WHERE CASE
        WHEN len(w) = len(v) THEN len(list_filter(range(1, len(w) + 1), lambda j: w[j] <> v[j])) <= 1
        WHEN len(w) > len(v) THEN len(list_filter(range(1, len(w) + 1), lambda j: w[:j - 1] || w[j + 1:] = v)) > 0
        ELSE len(list_filter(range(1, len(v) + 1), lambda j: v[:j - 1] || v[j + 1:] = w)) > 0 END),
    judged AS (SELECT doc_id, i, line, coalesce(place <> doc_id * 1000000 + i OR near.w IS NOT NULL, false) AS gone
               FROM worded LEFT JOIN uniq USING (w) LEFT JOIN near USING (w))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line, exactly or but for one word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_lines(docs).select("doc_id", F.col("n_lines_").alias("n_lines"),
                                                F.col("n_removed_").alias("n_removed"), F.sha2("kept_text_", 256).alias("kept_sha256"))


@query("op9_nearest_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


@query("op8_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    g AS (SELECT t, max(page_id) AS holder FROM p WHERE strlen(t) >= 1000 GROUP BY t)
    SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, sha1(p.t) AS payload_digest,
           CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN holder <> page_id THEN holder END AS refers_to
    FROM p LEFT JOIN g ON g.t = p.t""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    warc.register(spark)
    path = f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"
    records = warc.deduplicated(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    records.write.format("warc").option("path", path).mode("append").save()
    return warc.read_pages(spark, path)


@query("op2_url_filters")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; a page's labels are those of the document that the last number of its path names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = F.regexp_extract(url_filters.path_of(F.col("url")), r"(\d+)[^0-9]*$", 1).try_cast("long")
    bad = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.min("quality") == 0).alias("poor"), (F.max("toxic") == 1).alias("toxic"))
    labelled = pages.select("url", named.alias("doc_id")).join(bad, "doc_id").select("url", (F.col("poor") | F.col("toxic")).alias("bad"))
    judged = url_filters.judge(pages, url_filters.mine(labelled))
    return judged.select("page_id", F.col("host_").alias("host"), F.col("path_").alias("path"), F.col("rule_").alias("rule"),
                         F.col("verdict_").alias("verdict"), F.col("mined_rule_").alias("mined_rule"))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    coded = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = sentencepiece_codec.decode(coded, model)
    return back.select("doc_id", F.size("ids_").cast("long").alias("n_tokens"), F.xxhash64("ids_").alias("ids_hash"),
                       (F.col("decoded_") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("op11_document_fingerprints")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, as digests of their lanes, and how alike they are."""
    out = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.sha2("fingerprint_", 256).alias("fingerprint"),
                      F.sha2("edited_fingerprint_", 256).alias("edited_fingerprint"), "near_edited", "near_next")


TERMS_SQL = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op13_ranked_lexical_search", f"""
    WITH d AS (SELECT doc_id, {TERMS_SQL.format(LOWER_SQL)} AS ts FROM documents),
    whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
    q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL.format(LOWER_SQL)}) AS term FROM benchmark),
    tokens AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d),
    p AS (SELECT doc_id, n, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM p, whole GROUP BY term, n_docs),
    c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS c
          FROM p JOIN w USING (term), whole),
    s AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY ALL HAVING sum(c) > 0)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
    FROM s QUALIFY rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's ten best documents."""
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("query_id", "item_id")


@query("op12_spelling_variant_grouping", f"""
    WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
        FROM range(256) r(i))),
    tokens AS (SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
    runs AS (SELECT doc_id, run, count(*) AS k FROM tokens WHERE length(run) >= 5 GROUP BY ALL),
    bytes AS (SELECT doc_id, run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x:
        CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END)) AS b
        FROM runs),
    hashed AS (SELECT run, k, xor(list_reduce([4294967295] || b, lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) AS h
               FROM bytes, crc),
    spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k
              FROM hashed),
    v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt GROUP BY word HAVING sum(k) >= 3 AND length(word) >= 5),
    places AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
    cut AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS masked, left(word, i) || substr(word, i + 2) AS less FROM places),
    near AS (SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y USING (masked) WHERE x.word <> y.word
             UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = less
             UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = less),
    best AS (SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
             QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
    judged AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
                      CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
    lead AS (SELECT word, word AS root, 0 AS step FROM v
             UNION ALL SELECT lead.word, form, step + 1 FROM lead JOIN judged ON judged.word = root WHERE form IS NOT NULL),
    roots AS (SELECT word, arg_max(root, step) AS root FROM lead GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant groups of the words of all documents; one run in 97 loses a code point first."""
    runs = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"), least=5)
    h, size = F.col("h"), F.char_length("run_")
    cut = F.concat(F.substring("run_", F.lit(1), (h % size).cast("int")), F.substring("run_", (h % size + 2).cast("int"), size))
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run_")))
    words = hashed.select(F.when(h % 97 == 0, cut).otherwise(F.col("run_")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return spelling.variants(words.filter((F.char_length("word") >= 5) & (F.col("n") >= 3)))
