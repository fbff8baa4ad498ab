"""The registered queries of the operators, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry.llm import (
    compression,
    conversations,
    languages,
    minhash,
    packing,
    periodic,
    piece_codec,
    repeats,
    rules,
    sharding,
    suffixes,
    warc,
)
from inkferry.llm.common import crc_fold, table, vocabulary
from inkferry.llm.decontaminate import decontaminate, is_contaminated


def op1_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judge(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"])
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept posterior"
    return judged.select(*names.split())


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"]
    )
    return found.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("contamination.items"), ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle_words=2)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    names = "page_id payload_bytes payload_digest record_type refers_to"
    return warc.round_trip(table(spark, folder, "pages")).select(*names.split())


def op5_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_fold("doc_id", 3) == 1
    model = languages.train(docs.filter(~held_out))
    found = languages.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")


def op6_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    done = suffixes.remove_repeats(table(spark, folder, "documents"), keep=["doc_id"])
    return done.select(
        "doc_id",
        "removal.n_bytes",
        "removal.n_removed",
        F.size("removal.spans").cast("bigint").alias("n_spans"),
        F.sha2("removal.kept", 256).alias("kept_sha256"),
    )


def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    done = repeats.remove_seen_passages(table(spark, folder, "documents"), keep=["doc_id"])
    return done.select(
        "doc_id",
        "repeats.n_words",
        "repeats.n_removed",
        F.sha2(F.col("repeats.kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    written = sharding.write_shards(table(spark, folder, "documents"), n_shards=8)
    return written.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op9_compression(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = compression.train(docs, compression.training_rows(labels))
    scored = compression.score(docs, model, out="score", keep=["doc_id"])
    return scored.select(
        "doc_id",
        (crc_fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= compression.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    coded = piece_codec.encode(table(spark, folder, "documents"), model, keep=["doc_id"])
    read = piece_codec.decode(coded.select("doc_id", "pieces.*"), model)
    return read.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic.with_loops(table(spark, folder, "documents").select("doc_id", "text"))
    found = periodic.repeated_runs(docs, keep=["doc_id"]).withColumn("_best", periodic.longest_run())
    line = F.transform("periodic.runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    lines = F.array_join(F.concat(line, F.array(F.lit(""))), "\n")
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("bigint").alias("n_runs"),
        "_best.*",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_auction(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return conversations.summaries(turns, conversations.repair(conversations.damaged(turns)))


QUERIES = {
    "op1_rules": op1_rules,
    "op2_decontaminate": op2_decontaminate,
    "op3_minhash": op3_minhash,
    "op4_warc": op4_warc,
    "op5_languages": op5_languages,
    "op6_suffixes": op6_suffixes,
    "op7_repeats": op7_repeats,
    "op8_sharding": op8_sharding,
    "op9_compression": op9_compression,
    "op10_packing": op10_packing,
    "op11_pieces": op11_pieces,
    "op12_periods": op12_periods,
    "op13_auction": op13_auction,
}

NORMAL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# crc32 (reversed polynomial 0xEDB88320) of a string's bytes, bit by bit, before the final inversion
CRC32 = r"""xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
    string_split(regexp_replace(hex(encode({0})), '(..)', '\1,', 'g'), ',')[:-2], lambda h: ('0x' || h)::UBIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda k, z: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384::UBIGINT) ELSE k >> 1 END)))"""

ORACLE = {
    "op13_auction": rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32.format("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k
  FROM conversations),
broken AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE k <> 0),
places AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM broken),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen,
    lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] AS pair FROM places),
turns AS (
  SELECT *, CASE WHEN blank THEN 'b' WHEN seen THEN 'd'
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '' ELSE 't' END AS fault FROM marked),
inserts(s, letters, price, mid) AS (
  SELECT 0, '', 0, 0 UNION ALL SELECT 1, '', 0, 1 UNION ALL SELECT 2, '', 0, 2 UNION ALL SELECT 3, '', 0, 3
  UNION ALL SELECT s, letters || 'I', price + 3, CASE mid WHEN 2 THEN 3 ELSE 2 END FROM inserts WHERE length(letters) < 3),
kept(mid, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT c, i, mid, letter, price, after FROM (
    SELECT c, i, m.mid, 'D' AS letter, 4 AS price, m.mid AS after FROM turns, (VALUES (0), (1), (2), (3)) m(mid)
    UNION ALL SELECT c, i, mid, 'K', CASE WHEN fault = 't' THEN 3 ELSE 0 END, after
      FROM turns JOIN kept ON role[1] = initial WHERE fault IN ('', 't')
    UNION ALL SELECT c, i, m.mid, 'R', CASE WHEN fault = 't' THEN 6 ELSE 3 END, CASE m.mid WHEN 2 THEN 3 ELSE 2 END
      FROM turns, (VALUES (0), (1), (2), (3)) m(mid) WHERE fault IN ('', 't'))),
steps AS MATERIALIZED (
  SELECT c, i, s, n.letters || letter AS letters, n.price + e.price AS price, after FROM edits e JOIN inserts n USING (mid)),
paths AS (
  SELECT DISTINCT c, 0::BIGINT AS i, 0 AS s, {{'cost': 0, 'letters': ''}} AS best FROM turns
  UNION ALL
  SELECT p.c, p.i + 1, x.after, min({{'cost': p.best.cost + x.price, 'letters': p.best.letters || x.letters}})
  FROM paths p JOIN steps x ON x.c = p.c AND x.i = p.i + 1 AND x.s = p.s GROUP BY p.c, p.i, x.after),
sizes AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
ends AS (
  SELECT c, min({{'cost': best.cost + price, 'letters': best.letters || inserts.letters}}) AS best
  FROM paths JOIN sizes USING (c) JOIN inserts USING (s) WHERE i = n AND mid IN (0, 3) GROUP BY c),
letters AS (
  SELECT c, j, letter, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER w AS i,
    sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER w AS nth
  FROM (SELECT c, unnest(range(1, length(best.letters) + 1)) AS j, unnest(string_split(best.letters, '')) AS letter
        FROM ends WHERE best.letters <> '')
  WINDOW w AS (PARTITION BY c ORDER BY j)),
lines AS (
  SELECT l.c, j, letter, nth, role, text,
    max(CASE WHEN nth = 1 AND letter = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.c) AS lead
  FROM letters l LEFT JOIN turns t ON t.c = l.c AND t.i = l.i WHERE letter <> 'D'),
repaired AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM lines GROUP BY c),
facts AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY c)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.letters, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends USING (c) LEFT JOIN repaired USING (c)""",
    "op12_periods": rf"""
WITH texts AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    CAST({CRC32.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS BIGINT) AS h FROM documents),
shapes AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a, 3 + h // 10 % 8 AS m FROM texts),
words AS (
  SELECT d, i, w[1 + CASE WHEN h % 10 > 0 OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM shapes)),
steps AS (SELECT d, q, unnest(range(0, n - 2 * q, q)) AS i FROM (SELECT d, n, unnest(range(1, n // 4 + 1)) AS q FROM shapes)),
once AS MATERIALIZED (SELECT d, q, i, word FROM steps JOIN words USING (d, i)),
twice AS MATERIALIZED (
  SELECT o.* FROM once o JOIN words y ON y.d = o.d AND y.i = o.i + q AND y.word = o.word),
periods AS MATERIALIZED (
  SELECT DISTINCT o.d, q FROM twice o JOIN words z ON z.d = o.d AND z.i = o.i + 2 * q AND z.word = o.word),
placed AS MATERIALIZED (SELECT d, q, i, word FROM periods JOIN words USING (d)),
alike AS (
  SELECT x.d, q, x.i, x.i - row_number() OVER (PARTITION BY x.d, q ORDER BY x.i) AS island
  FROM placed x JOIN words y ON y.d = x.d AND y.i = x.i + q AND y.word = x.word),
stretches AS (
  SELECT d, q, min(i) AS s, count(*) + q AS size FROM alike GROUP BY d, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT d, s, size, min(q) AS q FROM stretches GROUP BY d, s, size),
sums AS (
  SELECT d, count(*) AS n_runs, min((-size, s, q)) AS best,
    string_agg(concat(s, ',', size, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM runs GROUP BY d),
gone AS (SELECT DISTINCT d, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (SELECT d, string_agg(word, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (d, i) GROUP BY d)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best[2] AS BIGINT) AS start,
  CAST(-best[1] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period,
  CAST(1000 * -best[1] // best[3] AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM texts LEFT JOIN sums USING (d) LEFT JOIN kept USING (d)""",
    "op3_minhash": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN [concat(w[i], ' ', w[i + 1]) FOR i IN range(1, len(w))]
    ELSE w END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (s)
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reached(d, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT d, b FROM reached JOIN links ON links.a = reached.r),
least AS (SELECT d, min(r) AS component_id FROM reached GROUP BY d)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN least ON least.d = docs.doc_id""",
    "op4_warc": """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
kept AS (SELECT body, max(page_id) AS last FROM payloads GROUP BY body)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  translate(array_to_string([to_base(CAST(concat('0x', substr(digest, 1 + 10 * i, 10)) AS BIGINT), 32, 8)
    FOR i IN range(0, 4)], ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM payloads JOIN kept USING (body)""",
    "op6_suffixes": """
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT d, i, md5(substr(h, 2 * i + 1, 800)) AS win
  FROM (SELECT d, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM docs WHERE len(h) >= 800)),
again AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
hits AS (SELECT d, i, i - lag(i) OVER (PARTITION BY d ORDER BY i) AS gap FROM starts JOIN again USING (win)),
islands AS (
  SELECT d, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY i) AS island FROM hits),
spans AS (SELECT d, min(i) AS a, max(i) + 400 AS z FROM islands GROUP BY d, island),
rests AS (
  SELECT d, lag(z, 1, 0) OVER (PARTITION BY d ORDER BY a) AS a, a AS z FROM spans
  UNION ALL SELECT d, max(z), max(len(h) // 2) FROM spans JOIN docs USING (d) GROUP BY d),
kept AS (
  SELECT d, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS k FROM rests JOIN docs USING (d) GROUP BY d),
sums AS (SELECT d, sum(z - a) AS removed, count(*) AS n FROM spans GROUP BY d)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN sums USING (d) LEFT JOIN kept USING (d)""",
    "op7_repeats": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT d, doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS win
  FROM (SELECT d, doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first_id FROM wins GROUP BY win),
hits AS (
  SELECT DISTINCT d, unnest(range(pos, pos + 13)) AS pos
  FROM wins JOIN firsts USING (win) WHERE first_id < doc_id),
gone AS (SELECT d, list(pos) AS cut FROM hits GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(
    [x[1] FOR x IN list_zip(w, range(1, len(w) + 1)) IF NOT list_contains(coalesce(cut, []), x[2])], ' '))
    AS kept_sha256
FROM docs LEFT JOIN gone USING (d)""",
    "op2_decontaminate": f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {NORMAL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item, array_to_string(w[pos:pos + 12], ' ') AS win, least(len(w), 13) AS size
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS pos
        FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, row_number() OVER () AS d, {NORMAL_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT d, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS win
  FROM (SELECT d, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM doc_words, sizes
        WHERE len(w) >= size)),
found AS (SELECT p.d, p.pos, p.size, x.item FROM places p JOIN windows x USING (size, win)),
hits AS (
  SELECT d, count(DISTINCT word) AS n_hit
  FROM (SELECT d, unnest(range(pos, pos + size)) AS word FROM (SELECT DISTINCT d, pos, size FROM found))
  GROUP BY d),
names AS (
  SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT d, item FROM found) GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (d) LEFT JOIN names USING (d)""",
}
