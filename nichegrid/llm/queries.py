"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.llm import chaining, conversations, lexical, linerules, media, minhash, mixing, packing, quality, sentencepiece_scan, suffixes, topk, urlrules
from nichegrid.llm.common import LOWER, UPPER, table

#: Vocabulary files of public tokenizers.
BPE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RULES = (
    urlrules.Rule("com", "/", "allow"),
    urlrules.Rule("example.com", "/en/", "block"),
    urlrules.Rule("www.example.com", "/en/", "allow"),
    urlrules.Rule("net", "/es/", "block"),
    urlrules.Rule("net", "/fr/", "block"),
)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"), within=False).drop("k")  # passages that documents share


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BPE_RANKS)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), RULES)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media(table(spark, sf_dir, "documents"), with_bytes=False)
    return rows.withColumn("n_embedded", F.size("embedded").cast("long")).drop("embedded")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"), 400, with_bytes=False)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.clean(table(spark, sf_dir, "documents"), with_text=False)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_token_packing": op4_token_packing,
    "op5_mixing": op5_mixing,
    "op6_url_filters": op6_url_filters,
    "op7_exact_topk": op7_exact_topk,
    "op8_media_columns": op8_media_columns,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_lexical_search": op11_lexical_search,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_repair": op13_conversation_repair,
}

_FOLD = f"'{UPPER}', '{LOWER}'"
_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_WORDS = r"'[^\x20\x09-\x0D]+'"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE_SQL: dict[str, str] = {
    # full sets, all pairs that share a shingle, and the closure of their links
    "op3_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, a FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other),
c AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op5_mixing": f"""WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
      / coalesce(greatest(0.05, length(translate(text, '|*$%&#@^~<>=+_{{}}[]!0123456789', '')) / nullif(CAST(length(text) AS DOUBLE), 0)), CASE WHEN text = '' THEN 0.05 ELSE 1.0 END) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS share, source_size * 2 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER p, 0)) / (sum(share) OVER () - coalesce(sum(share) OVER p, 0)) AS level
  FROM w WINDOW p AS (ORDER BY cap / share, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN cap <= level * share THEN cap ELSE max(CASE WHEN cap > level * share THEN level END) OVER () * share END AS target FROM l),
g AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, floor(g.target) - g.epochs * g.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(epochs * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM r""",
    "op6_url_filters": f"""WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_FOLD}) ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
rules(h, p, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
fits AS (SELECT p.*, h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || r.p) DESC) AS k
  FROM p LEFT JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1""",
    "op7_exact_topk": """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
    "op11_lexical_search": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {_FOLD}), {_TERMS}) AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_FOLD}), {_TERMS})) AS term FROM benchmark),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (r), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
    "op12_quality_rules": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, {_WORDS}) AS w FROM d),
windows AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeated, range(5) g(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d),
f AS (SELECT r, line, translate(line, {_FOLD}) AS low, len(regexp_extract_all(line, {_WORDS})) AS lw, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS lc,
    row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again, len(regexp_extract_all(line, {_literal(linerules.SYMBOLS)})) AS symbols,
    len(regexp_extract_all(line, {_literal(linerules.BORDER)})) AS borders, len(regexp_extract_all(line, {_literal(linerules.SHOUTS)})) AS shouts
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
v AS (SELECT *, CASE WHEN again THEN 'boilerplate'
    WHEN borders >= 2 AND 4 * borders >= lw OR lw <= 40 AND regexp_matches(low, {_literal(linerules.NAVIGATION)}) THEN 'navigation'
    WHEN lw <= 40 AND regexp_matches(low, {_literal(linerules.BOILERPLATE)}) THEN 'boilerplate'
    WHEN shouts >= 2 AND 4 * shouts >= lw OR CASE WHEN lw < 10 THEN NOT regexp_matches(line, {_literal(linerules.END)}) ELSE NOT regexp_matches(line, {_literal(linerules.PAUSE)}) END THEN 'punctuation' END AS rule FROM f),
s AS (SELECT r, sum(lc) AS word_chars, sum(symbols) AS n_symbols, count_if(again) AS n_dup_lines, count(*) AS n_lines, count_if(rule = 'punctuation') AS n_punctuation,
    count_if(rule = 'navigation') AS n_navigation, count_if(rule = 'boilerplate') AS n_boilerplate, sum(CASE WHEN rule IS NULL THEN 0 ELSE lc END) AS removed_chars FROM v GROUP BY r),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(coalesce(n_symbols, 0) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(w) AS base_failed, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_punctuation, 0) AS BIGINT) AS n_punctuation,
    CAST(coalesce(n_navigation, 0) AS BIGINT) AS n_navigation, CAST(coalesce(n_boilerplate, 0) AS BIGINT) AS n_boilerplate, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN s USING (r))
SELECT *, NOT base_failed AND 100 * removed_chars <= 50 * word_chars AS kept FROM o""",
    # crc32 bit by bit, and the cheapest edits row by row: of each state of the pattern the least (cost, audit)
    "op13_conversation_repair": f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(key) + 1), lambda i: CAST(ascii(decode(key[i:i])) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, 3988292384 * (x % 2)))), 4294967295) % 20 AS k FROM k),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) FROM c WHERE k <> 0),
r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r),
best(conv_id, i, q, b) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'turns': CAST([] AS VARCHAR[])}} FROM f
  UNION ALL
  SELECT conv_id, i, q, min({{'cost': cost, 'audit': audit, 'turns': turns}}) FROM (
    SELECT s.conv_id, f.i, CASE WHEN e = 'D' THEN p.q ELSE CASE WHEN p.q = 0 AND e = 'K' AND left(f.role, 1) = 's' THEN 1 WHEN p.q = 2 THEN 3 ELSE 2 END END AS q,
      s.b.cost + 3 * p.n + CASE e WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e <> 'D' AND fault = 't' THEN 3 ELSE 0 END AS cost, s.b.audit || repeat('I', p.n) || e AS audit,
      s.b.turns || p.turns || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE WHEN p.q = 2 THEN 'assistant' ELSE 'user' END || ':' || f.text] END AS turns
    FROM best s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
    JOIN (VALUES (0, 0, 0, CAST([] AS VARCHAR[])), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']), (3, 1, 2, ['user:']),
      (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 2, 3, ['user:', 'assistant:'])) p(q0, n, q, turns) ON p.q0 = s.q
    JOIN (VALUES ('D'), ('K'), ('R')) edits(e) ON e = 'D' OR fault NOT IN ('b', 'd') AND (e = 'R' OR left(f.role, 1) = CASE WHEN p.q = 2 THEN 'a' ELSE 'u' END OR p.q = 0 AND left(f.role, 1) = 's'))
  GROUP BY ALL),
n AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
    count_if(before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS i FROM f GROUP BY conv_id),
done AS (SELECT best.conv_id, min({{'cost': b.cost + 3 * len(t), 'audit': b.audit || repeat('I', len(t)), 'turns': b.turns || t}}) AS b FROM best JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id AND n.i = best.i
    JOIN (VALUES (0, CAST([] AS VARCHAR[])), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, [])) z(q0, t) ON z.q0 = q GROUP BY best.conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
