"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm import ann, conversations, decontaminate, fixity, html_text, near_dups, passages, quality, secret_scan, shallot, sharding, tokens, wavelet
from relspark.llm.common import stored, table


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def q_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).select("doc_id", "held_out", "score", "predicted")


def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: shard row counts differ by one at most."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def vocabulary_path() -> str:
    """The byte-level vocabulary file of the public tokenizers that the machines carry."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def q_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def q_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the pages' WARC archives, the second with altered, cut and lost records
    (by fixed rules on the page id), audited; one row for each record found to differ."""
    pages = table(spark, sf_dir, "pages")
    half = F.floor(F.length("html") / 2).cast("int")
    altered = F.concat(F.substring("html", F.lit(1), half), F.lit("~"), F.substring("html", half + 2, F.length("html")))
    html = F.when(F.pmod("page_id", F.lit(101)) == 7, altered).when(F.pmod("page_id", F.lit(103)) == 11, F.substring("html", F.lit(1), half)).otherwise(F.col("html"))
    lost = F.coalesce(F.pmod("page_id", F.lit(107)) == 13, F.lit(False))
    archive = F.coalesce(F.floor(F.col("page_id") / fixity.RECORDS_PER_ARCHIVE), F.lit(-1)).cast("long")
    content = [fixity.warc_bytes("resource", F.col("url"), F.col("page_id"), x) for x in (F.col("html"), html)]
    records = pages.select(
        archive.alias("archive"), F.col("page_id").alias("record_id"), lost.alias("lost"),
        *fixity.sealed(content[0]), *fixity.sealed(content[1], "_kept"),
    )
    both = stored(spark, fixity.with_offsets(records), "replicas")
    left = both.select("archive", "record_id", "offset", "length", "digest")
    right = both.where("not lost").select("archive", "record_id", "offset", F.col("length_kept").alias("length"), F.col("digest_kept").alias("digest"))
    return fixity.audit(left, right)


def q_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.clusters(spark, table(spark, sf_dir, "embeddings"))


def q_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return wavelet.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def q_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_near_dups": q_near_dups,
    "op2_quality": q_quality,
    "op3_html_text": q_html_text,
    "op4_secrets": q_secrets,
    "op5_neighbours": q_neighbours,
    "op6_sharding": q_sharding,
    "op7_tokens": q_tokens,
    "op8_decontamination": q_decontamination,
    "op9_passages": q_passages,
    "op10_fixity": q_fixity,
    "op11_clusters": q_clusters,
    "op12_wavelet": q_wavelet,
    "op13_conversations": q_conversations,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _rounds_of_means(rounds: int) -> str:
    """The assignments and moves of k-means as CTEs: ``m0`` to ``m<rounds>`` hold the centroids as one list."""
    nearest = """SELECT vec_id, v, list_min(list_transform(range(len(ms)), lambda j: {{'d':
    list_sum(list_transform(range(1, 65), lambda i: (v[i] - ms[j + 1][i]) * (v[i] - ms[j + 1][i])))::BIGINT, 'c': j}})) AS best
  FROM k, m{0}"""
    out = []
    for r in range(rounds):
        out.append(f"""a{r} AS ({nearest.format(r)}),
s{r} AS (SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY 1, 2),
t{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c),
m{r + 1} AS (SELECT list(coalesce(m, old) ORDER BY j) AS ms
  FROM (SELECT unnest(ms) AS old, generate_subscripts(ms, 1) - 1 AS j FROM m{r}) LEFT JOIN t{r} ON c = j)""")
    return ",\n".join([*out, f"a{rounds} AS ({nearest.format(rounds)})"])


def _repair_sql() -> str:
    """A turn a step, the cheapest way into each state of the grammar (0 nothing yet, 1 after s, 2 after u,
    3 after a) is kept as (cost, audit, lines)."""
    never = "{'c': 1000000000::BIGINT, 'a': '', 'l': []::VARCHAR[]}"

    def way(state, cost, initial, line):
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'l': {state}.l || {line}}}"

    def one(letter, source):
        """The turn taken as ``letter`` after ``source``: kept, or its role changed."""
        role = {"u": "user", "a": "assistant"}[letter]
        kept, changed = way(source, "cut", "K", "[line]"), way(source, "3 + cut", "R", f"['{role}:' || text]")
        return f"CASE WHEN code = 'x' THEN {never} WHEN code = '{letter}' THEN {kept} ELSE {changed} END"

    def closed(inner):
        """With the turns that may be put in after a step."""
        user = ", ".join(way(n, 3, "I", "['user:']") for n in ("n0", "n1", "n3"))
        assistant = way("m2", 3, "I", "['assistant:']")
        return (f"SELECT conv_id, idx, n0, n1, m2, list_min([n3, {assistant}]) AS m3 "
                f"FROM (SELECT *, list_min([n2, {user}]) AS m2 FROM ({inner}))")

    begin = closed(f"SELECT conv_id, 0::BIGINT AS idx, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS n0, "
                   f"{never} AS n1, {never} AS n2, {never} AS n3 FROM (SELECT DISTINCT conv_id FROM t)")
    gone = [way(f"w{i}", 4, "D", "[]::VARCHAR[]") for i in range(4)]
    system = f"CASE WHEN code = 's' THEN {way('w0', 'cut', 'K', '[line]')} ELSE {never} END"
    after = closed(f"""SELECT t.conv_id, t.idx, {gone[0]} AS n0, list_min([{gone[1]}, {system}]) AS n1,
    list_min([{gone[2]}, {one("u", "w0")}, {one("u", "w1")}, {one("u", "w3")}]) AS n2, list_min([{gone[3]}, {one("a", "w2")}]) AS n3
    FROM (SELECT conv_id AS c0, idx AS i0, n0 AS w0, n1 AS w1, m2 AS w2, m3 AS w3 FROM steps)
    JOIN t ON t.conv_id IS NOT DISTINCT FROM c0 AND t.idx = i0 + 1""")
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
    4294967295::BIGINT) % 20 AS kind FROM raw),
turned AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(copy)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx FROM turned),
judged AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, left(role, 1) AS ini,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY idx) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY idx) AS ini_before FROM ordered),
faulty AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM judged),
t AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'o' END AS code,
    CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut, role || ':' || text AS line FROM faulty),
steps AS (
  {begin}
  UNION ALL
  {after}),
ends AS (
  SELECT conv_id, list_min([n0, m3]) AS w FROM steps
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost,
  coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN ends ON o.conv_id IS NOT DISTINCT FROM ends.conv_id"""



ORACLE = {
    "op13_conversations": _repair_sql(),
    "op11_clusters": f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS (SELECT list(v ORDER BY h, v) AS ms FROM (SELECT v, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM k ORDER BY h, v LIMIT 16)),
{_rounds_of_means(3)},
f AS (SELECT vec_id, best.c AS c, best.d AS d FROM a3)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(ms[c + 1], ',')) AS centroid_sha256
FROM f, m3""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS t
       FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, l.n, i, array_to_string(w[i : i + l.n - 1], ' ') AS t
       FROM (SELECT DISTINCT n FROM bw) l, d, unnest(range(1, len(w) - l.n + 2)) AS u(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hit GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_fixity": r"""
WITH r AS (
  SELECT coalesce(floor(page_id / 1024), -1)::BIGINT AS archive, page_id, url, coalesce(html, '') AS a,
         CASE WHEN ((page_id % 101) + 101) % 101 = 7 THEN substr(html, 1, (length(html) // 2)) || '~' || substr(html, (length(html) // 2 + 2))
              WHEN ((page_id % 103) + 103) % 103 = 11 THEN substr(html, 1, (length(html) // 2))
              ELSE html END AS b,
         coalesce(((page_id % 107) + 107) % 107 = 13, false) AS lost
  FROM pages),
w AS (
  SELECT archive, page_id, lost, coalesce(b, '') AS b, url, a,
    replace('WARC/1.0|WARC-Type: resource|WARC-Record-ID: <urn:page:', '|', chr(13) || chr(10)) || coalesce(page_id::VARCHAR, '')
      || replace('>|WARC-Date: 2000-01-01T00:00:00Z|WARC-Target-URI: ', '|', chr(13) || chr(10)) || coalesce(url, '')
      || replace('|Content-Type: text/html|Content-Length: ', '|', chr(13) || chr(10)) AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM r),
s AS (
  SELECT archive, page_id, lost, head || strlen(a) || gap || a || gap AS ca, head || strlen(b) || gap || b || gap AS cb FROM w),
h AS (
  SELECT archive, page_id, lost, sha256(ca) AS da, sha256(cb) AS db, strlen(ca) AS n, strlen(cb) AS nb FROM s),
o AS (
  SELECT *, (sum(n) OVER (PARTITION BY archive ORDER BY page_id, da ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS "offset" FROM h)
SELECT archive, page_id AS record_id, "offset", CASE WHEN lost THEN 'lost' ELSE 'changed' END AS state,
       da AS digest_left, CASE WHEN NOT lost THEN db END AS digest_right
FROM o WHERE lost OR da <> db""",
    "op3_html_text": r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(t, '&amp;?', chr(1), 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), chr(1), '&') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d""",
}
