"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, jaccard, lm, neardup, packing, pii, quality, search, substring, trie, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.link_components(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.judge(_table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the table as they come, and conversation -7 as a record of messages: two layouts, found by their fingerprints."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(*(F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant"))).alias("messages"))
    rows = chat.records(_table(spark, sf_dir, "conversations")).unionByName(chat.records(own))
    return chat.digests(chat.formatted_records(rows))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(_table(spark, sf_dir, "conversations"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def tokenizer(name: str) -> str:
    """A public tokenizer's file, which is at this place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_substring, op3_fingerprint, op4_urls, op5_pii, op6_quality, op7_chat, op8_packing, op9_lm, op10_bpe, op11_jaccard, op12_trie, op13_search)}


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.g FROM s JOIN rare USING (g)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = w.doc_id
"""


WINDOW = 50
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM d, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)),
least AS (SELECT h, min(doc_id) AS m FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT w.doc_id, j FROM w JOIN least USING (h), unnest(range(i, i + {WINDOW})) AS t(j) WHERE m < w.doc_id),
kept AS (SELECT doc_id, string_agg(ws[i], ' ' ORDER BY i) AS text, count(*) AS n
         FROM (SELECT doc_id, ws, i FROM d, unnest(range(1, len(ws) + 1)) AS t(i)) p
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.j = p.i) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, s, a) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT page_id, max_by(h || s, length(h || s)) AS rule, max_by(a, length(h || s)) AS verdict
        FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)
"""

OP7_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, n, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(n, role)),
e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)', '\1\\\2\3', 'g') AS r2,
                regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)', '\1\\\2\3', 'g') AS t2 FROM r),
f AS (SELECT *, CASE role WHEN 'assistant' THEN '<s>' || t2 || '</s>' WHEN 'user' THEN '<s>[INST] ' || t2 || ' [/INST]</s>'
        WHEN 'system' THEN '<s><<SYS>>' || chr(10) || t2 || chr(10) || '<</SYS>></s>' ELSE '<s>[ROLE]' || r2 || '[/ROLE]' || t2 || '</s>' END AS out FROM e),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
             sum(length(out)) AS n FROM f GROUP BY conv_id)
SELECT conv_id, CAST(NULL AS VARCHAR) AS reason, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars FROM g
"""


_PHRASES = ", ".join("'" + x.replace("'", "''") + "'" for x in quality.BOILERPLATE)
_CLOSING = ", ".join("'" + x.replace("'", "''") + "'" for x in quality.CLOSING)
_SYMBOLS = "length(regexp_replace({0}, '[^#*$%&|<>]', '', 'g'))"
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM d, unnest(range(1, len(ws) - 1)) AS t(i)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) AS t(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, k, ls[k] AS line, regexp_extract_all(ls[k], '{WORD}') AS ws FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d) x, unnest(range(1, len(ls) + 1)) AS t(k)),
f AS (SELECT doc_id, line, len(ws) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS dup, right(ws[-1], 1) AS last FROM l WHERE len(ws) > 0),
b AS (SELECT doc_id, n, dup, dup OR {_SYMBOLS.format('line')} >= greatest(1, {quality.SYMBOLS} * n) OR length(regexp_replace(line, '[^!]', '', 'g')) >= greatest(2, {quality.SHOUT} * n)
      OR (n < {quality.SHORT_LINE} AND last NOT IN ({_CLOSING})) OR len(list_filter([{_PHRASES}], lambda p: contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p))) > 0 AS bad FROM f),
s AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM b GROUP BY doc_id),
o AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, {_SYMBOLS.format('text')}::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost FROM d LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT o.* EXCLUDE (lost), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - lost >= {quality.KEEP_SHARE} * n_words AS kept FROM o
"""


OP11_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {jaccard.WORDS} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.g FROM s JOIN rare USING (g)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {jaccard.PERCENT} * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = w.doc_id
"""

# crc32 by its definition: every byte is folded in, then eight steps of the polynomial
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT for i in range(8)]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))"
OP12_SQL = rf"""
WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, (xor({_CRC}, 4294967295) % 9)::BIGINT AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(f.ts[1:h.h], []), h.ts[h.h + 1:]) AS s FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(s) AS l, d::BIGINT AS depth, sha256(s[1:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(s[1:d - 1]::VARCHAR) END AS up, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS size FROM b, unnest(range(len(s) + 1)) AS x(d)),
n AS (SELECT k, depth, any_value(up) AS up, any_value(size) AS size, count(*) AS n, min(conv_id) AS c, coalesce(string_agg(CASE WHEN depth = l THEN conv_id END::VARCHAR, ',' ORDER BY conv_id), '') AS ends FROM p GROUP BY k, depth),
kids AS (SELECT up, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT x.k AS top, y.k AS k FROM p y JOIN p x ON x.conv_id = y.conv_id AND x.depth <= y.depth),
sums AS (SELECT top, count(*) FILTER (WHERE kids IS NULL) AS leaves, sum((n.n - 1) * n.size) AS saved FROM below JOIN n USING (k) LEFT JOIN kids ON kids.up = n.k GROUP BY top)
SELECT n.c AS conv_id, n.depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN n u ON u.k = n.up LEFT JOIN kids ON kids.up = n.k JOIN sums ON sums.top = n.k
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, ts, len(ts)::BIGINT AS n FROM (SELECT doc_id, {_TERMS} AS ts FROM documents) x WHERE len(ts) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) x GROUP BY ALL),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) x SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term, docs),
i AS (SELECT r, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)) AS impact FROM p JOIN d USING (r), a),
s AS (SELECT item_id, r, sum(q * w * impact)::BIGINT AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op2_substring": OP2_SQL, "op4_urls": OP4_SQL, "op6_quality": OP6_SQL, "op7_chat": OP7_SQL, "op11_jaccard": OP11_SQL, "op12_trie": OP12_SQL, "op13_search": OP13_SQL}
