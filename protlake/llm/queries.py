"""One query per operator over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from protlake.llm import cotrain, minhash, mixing, multiprobe, ngram_ratio, packing, repair, spelling, suffixes, topk, url_lists, warc, wordpiece

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its scores and whether it is kept."""
    return cotrain.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with repeated passages, one row for each document that holds such a passage first; spans as 'start-end' word ranges."""
    found = suffixes.repeated_passages(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.explode("first_docs").alias("first_doc"), "repeated_words", spans.alias("spans"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures. The tables have no fetch time: page n was fetched on day n of 2024, modulo 366."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated block list and allow list over the hosts, domains and first path segments of the pages, chosen by md5."""
    named = pages.select(url_lists.host_of(F.col("url")).alias("host"), url_lists.path_of(F.col("url")).alias("path")).filter("host <> ''")
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    prefix = F.concat("host", F.lit("/"), F.lower(F.regexp_extract("path", "^/([^/]+)", 1)))

    def keys(column, name):
        key = named.select(column.alias("key")).filter(f"key <> '' and key not like '%/'").distinct()
        return key.withColumn("list", F.lit(name)).withColumn("n", F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int"))

    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    def entries(rows, action, verdict, dated):
        return rows.select("list", "key", F.lit(action).alias("action"), F.lit(verdict).alias("verdict"), day(dated).alias("dated"))

    hosts, domains, paths = keys(F.col("host"), "hosts").filter("n % 4 = 0"), keys(domain, "domains").filter("n % 5 = 0"), keys(prefix, "paths").filter("n % 3 = 0")
    return (entries(hosts, "add", "block", F.col("n") % 300).union(entries(hosts, "remove", "block", F.col("n") % 300 + 45))
            .union(entries(hosts, "add", "block", F.col("n") % 300 + 120)).union(entries(domains, "add", "block", F.col("n") % 200))
            .union(entries(paths, "add", "allow", F.col("n") % 250)))


def op5_url_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the verdict of the lists on its day of capture."""
    pages = _table(spark, sf_dir, "pages")
    return url_lists.judged(captures(pages), list_entries(pages))


def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return multiprobe.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of word pieces."""
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), *wordpiece.pieces_of_model(PIECE_MODEL))


def op8_exact_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_scores(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it and the shards it goes to, one for each time it is taken."""
    took = mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return (took.groupBy("row", F.col("payload.doc_id").alias("doc_id"), "size", "source_size", "target").agg(
        F.sum("words").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards")).select("doc_id", "size", "source_size", "target", "taken", "shards"))


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives."""
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with its faults, the cost and edits of its repair, and the hash of the repaired text."""
    return repair.repairs(_table(spark, sf_dir, "conversations"))


def op12_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the counts of the rules and whether it is kept."""
    return ngram_ratio.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its spelling variants."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_minhash_dedup, op2_best_fit_packing, op3_quality_cotraining, op4_suffix_dedup, op5_url_list_join, op6_multiprobe_neighbours, op7_wordpiece_counts,
    op8_exact_top_scores, op9_source_mixing, op10_warc_bundles, op11_conversation_repair, op12_ngram_ratio_rules, op13_spelling_variants, pipeline)}

ORACLES = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle, count(*) AS c FROM p GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, min(root) AS class_id, min(root) = doc_id AS kept FROM r GROUP BY doc_id""",
    "op4_suffix_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(ws) - 49)) AS s, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1:s + 50], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first_doc FROM h GROUP BY k),
d AS (SELECT h.doc_id, h.s, f.first_doc FROM h JOIN f USING (k) WHERE h.doc_id > f.first_doc),
g AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS fresh
      FROM (SELECT DISTINCT doc_id, s FROM d)),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM g),
m AS (SELECT doc_id, part, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY 1, 2),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS repeated_words, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM m GROUP BY 1)
SELECT DISTINCT d.doc_id, d.first_doc, t.repeated_words, t.spans FROM d JOIN t USING (doc_id)""",
    "op5_url_list_join": r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
k AS (SELECT 'hosts' AS list, host AS key FROM c UNION SELECT 'domains', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM c
      UNION SELECT 'paths', host || '/' || lower(regexp_extract(path, '^/([^/]+)', 1)) FROM c WHERE host <> ''),
n AS (SELECT list, key, ('0x' || substr(md5(key), 1, 4))::INTEGER AS n FROM k WHERE key <> '' AND key NOT LIKE '%/'),
e AS (SELECT list, key, 'add' AS action, 'block' AS verdict, DATE '2024-01-01' + n % 300 AS dated FROM n WHERE list = 'hosts' AND n % 4 = 0
      UNION ALL SELECT list, key, 'remove', 'block', DATE '2024-01-01' + (n % 300 + 45) FROM n WHERE list = 'hosts' AND n % 4 = 0
      UNION ALL SELECT list, key, 'add', 'block', DATE '2024-01-01' + (n % 300 + 120) FROM n WHERE list = 'hosts' AND n % 4 = 0
      UNION ALL SELECT list, key, 'add', 'block', DATE '2024-01-01' + n % 200 FROM n WHERE list = 'domains' AND n % 5 = 0
      UNION ALL SELECT list, key, 'add', 'allow', DATE '2024-01-01' + n % 250 FROM n WHERE list = 'paths' AND n % 3 = 0),
v AS (SELECT *, lead(dated) OVER (PARTITION BY list, key ORDER BY dated) AS until FROM e),
u AS (SELECT page_id, url, fetched, host, unnest(list_distinct(list_concat(
        [array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)],
        CASE WHEN trim(path, '/') <> '' THEN [host || '/' || lower(array_to_string(string_split(trim(path, '/'), '/')[1:i], '/'))
                                              FOR i IN range(1, len(string_split(trim(path, '/'), '/')) + 1)] ELSE [] END))) AS key FROM c WHERE host <> ''),
h AS (SELECT u.page_id, u.url, u.fetched, v.key, v.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(v.key) DESC, v.key DESC, v.verdict DESC) AS r,
        count(*) OVER (PARTITION BY u.page_id) AS active_entries
      FROM u JOIN v ON u.key = v.key AND v.action = 'add' AND v.dated <= u.fetched AND (v.until IS NULL OR u.fetched < v.until))
SELECT c.page_id, c.url, c.fetched, c.host, h.verdict, h.key AS matched, coalesce(h.active_entries, 0) AS active_entries FROM c LEFT JOIN h ON h.page_id = c.page_id AND h.r = 1""",
    "op8_exact_top_scores": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_warc_bundles": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY 1, 2)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to FROM p LEFT JOIN m ON m.d = p.d AND m.n = p.n""",
    "op11_conversation_repair": r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t FROM range(256) x(n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT k.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS h FROM k, tab),
r AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r FROM r),
q AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
      NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS (SELECT *, blank OR seen AS gone, CASE WHEN open AND NOT (blank OR seen) THEN 1 ELSE 0 END AS cut, chr(10) || role || ':' || text AS own,
      chr(10) || 'user:' || text AS as_u, chr(10) || 'assistant:' || text AS as_a FROM q),
d AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 'o': ''} AS st, {'c': 1000000000000::BIGINT, 'a': '', 'o': ''} AS ss,
    {'c': 1000000000000::BIGINT, 'a': '', 'o': ''} AS su, {'c': 1000000000000::BIGINT, 'a': '', 'o': ''} AS sa FROM conversations
  UNION ALL
  SELECT conv_id, i, {'c': st.c + 3, 'a': st.a || 'D', 'o': st.o},
    list_min([{'c': ss.c + 3, 'a': ss.a || 'D', 'o': ss.o}, {'c': st.c + CASE WHEN NOT gone AND r = 's' THEN cut ELSE 1000000000000 END, 'a': st.a || 'K', 'o': st.o || own}]),
    list_min([{'c': u.c + 3, 'a': u.a || 'D', 'o': u.o}] || list_concat(
      list_transform([st, ss, a], lambda x: {'c': x.c + CASE WHEN gone THEN 1000000000000 ELSE 2 + cut END, 'a': x.a || 'R', 'o': x.o || as_u}),
      list_transform([st, ss, a], lambda x: {'c': x.c + CASE WHEN NOT gone AND r = 'u' THEN cut ELSE 1000000000000 END, 'a': x.a || 'K', 'o': x.o || own}))),
    list_min([{'c': a.c + 3, 'a': a.a || 'D', 'o': a.o}, {'c': u.c + CASE WHEN gone THEN 1000000000000 ELSE 2 + cut END, 'a': u.a || 'R', 'o': u.o || as_a},
      {'c': u.c + CASE WHEN NOT gone AND r = 'a' THEN cut ELSE 1000000000000 END, 'a': u.a || 'K', 'o': u.o || own}])
  FROM (SELECT *, list_min([sa, {'c': u.c + 2, 'a': u.a || 'I', 'o': u.o || chr(10) || 'assistant:'}]) AS a FROM (
    SELECT d.conv_id, f.i, st, ss, sa, f.gone, f.cut, f.r, f.own, f.as_u, f.as_a,
      list_min([su] || list_transform([st, ss, sa], lambda x: {'c': x.c + 2, 'a': x.a || 'I', 'o': x.o || chr(10) || 'user:'})) AS u
    FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1))),
g AS (SELECT conv_id, arg_max(st, i) AS st, arg_max(sa, i) AS sa, arg_max(list_min([su] || list_transform([st, ss, sa], lambda x: {'c': x.c + 2, 'a': x.a || 'I', 'o': x.o || chr(10) || 'user:'})), i) AS u
      FROM d GROUP BY conv_id),
b AS (SELECT conv_id, list_min([st, sa, {'c': u.c + 2, 'a': u.a || 'I', 'o': u.o || chr(10) || 'assistant:'}]) AS z FROM g),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE seen AND NOT blank) AS duplicate,
      sum(cut)::BIGINT AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  z.c AS cost, z.a AS audit, sha256(substr(z.o, 2)) AS repaired_sha256 FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op13_spelling_variants": r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t FROM range(256) x(n)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, m, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM u, tab),
w AS (SELECT word, sum(m)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h)
      GROUP BY word HAVING length(word) >= 5 AND sum(m) >= 3),
d AS (SELECT word, n, unnest(range(length(word))) AS p FROM w),
k AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM d),
e AS (SELECT DISTINCT k.word AS a, w.word AS b FROM k JOIN w ON w.word = k.rest),
near AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT x.word, y.word FROM k x JOIN k y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word),
z AS (SELECT a, count(*) AS n_near, arg_min(b, (-w.n, b)) AS best, max(w.n) AS top FROM near JOIN w ON w.word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN best END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM w LEFT JOIN z ON z.a = w.word),
g AS (SELECT word, word AS root, 0 AS far FROM f UNION ALL SELECT g.word, f.form, far + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM f JOIN (SELECT word, arg_max(root, far) AS root FROM g GROUP BY word) USING (word)""",
}
