"""The corpus queries opN_<name>, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.common import table

#: The rules of the URL query (action, host, path).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Target shares by characters; the rest is shared by the other sources in proportion to their size.
MIX_WEIGHTS = {"src0": 0.25, "src1": 0.1, "src2": 0.1, "src3": 0.05}
MIX_SEED = "mix-1"
TOKEN_LIMIT = 512


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ids AS (SELECT *, row_number() OVER () AS rid FROM cut),
hit AS (
  SELECT rid, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS k
  FROM ids JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM ids LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (rid)
""".format(rules=", ".join(str(r) for r in URL_RULES))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.embed_dedup import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
walk(id, c) AS (SELECT rid, vec_id FROM v WHERE vec_id IS NOT NULL UNION SELECT p.b, w.c FROM walk w JOIN pairs p ON p.a = w.id),
comp AS (SELECT id, min(c) AS c FROM walk GROUP BY 1),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, coalesce(vec_id = c, TRUE) AS kept FROM v LEFT JOIN comp ON rid = id LEFT JOIN links ON rid = a
"""


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), output="digest")


OP4_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
windows AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY 1),
hit AS (SELECT rid, i FROM windows JOIN firsts USING (k) WHERE d < doc_id),
gone AS (SELECT DISTINCT rid, i + j AS place FROM hit, (SELECT unnest(range(13)) AS j)),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY place) AS t FROM words ANTI JOIN gone USING (rid, place) GROUP BY 1),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid) LEFT JOIN removed USING (rid)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), TOKEN_LIMIT, path=tokenizer("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SEED).select("doc_id", "source", "copy", "shuffle_key", "text")


OP8_SQL = """
WITH w(source, weight) AS (VALUES {weights}),
sized AS (SELECT CASE WHEN source IN (SELECT source FROM w) THEN source END AS s, sum(length(text))::DOUBLE AS n FROM documents GROUP BY 1),
total AS (SELECT sum(n) AS t FROM sized),
rates AS (
  SELECT s, CASE WHEN n > 0 THEN coalesce(weight, 1 - (SELECT sum(weight) FROM w)) * t / n ELSE 0 END AS rate
  FROM sized LEFT JOIN w ON s = source, total),
terms AS (SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 100) AS r(k) WHERE rate > 0),
cdf AS (SELECT s, least(1.0, sum(p) OVER (PARTITION BY s ORDER BY k)) AS f, k FROM terms),
steps AS (SELECT s, list(f ORDER BY k) AS fs FROM cdf GROUP BY s),
drawn AS (
  SELECT doc_id, source, text, len(list_filter(fs, lambda f: f <= u)) AS n
  FROM (SELECT *, CASE WHEN source IN (SELECT source FROM w) THEN source END AS s,
               ('0x' || substr(md5('{seed}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents) d
  JOIN steps ON d.s IS NOT DISTINCT FROM steps.s)
SELECT doc_id, source, c::INT AS copy, ('0x' || substr(md5('{seed}:order:' || doc_id || ':' || c), 1, 15))::BIGINT AS shuffle_key, text
FROM drawn, LATERAL (SELECT unnest(range(1, n + 1)) AS c)
""".format(weights=", ".join(str(x) for x in MIX_WEIGHTS.items()), seed=MIX_SEED)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.chat import conversation_digests, with_probe

    return conversation_digests(with_probe(table(spark, sf_dir, "conversations")), tokenizer("byte_bpe_50k.json"))


OP9_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length(regexp_replace(role, '<(!*)\\|', '<!\\1|', 'g')) + length(regexp_replace(text, '<(!*)\\|', '<!\\1|', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.alignment import align

    out = align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM d),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeats AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT struct_pack(d := doc_id)) >= 3),
judged AS (SELECT rid, doc_id, line, place, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN repeats USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), min_count=100, top=2000)


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS piece FROM d)),
totals AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
phrases AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM starts, range(1, 6) AS r(m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM phrases GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM cand, range(1, 5) AS r(k) WHERE k < m),
scored AS (
  SELECT c.*, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a), k) AS best
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = p1 JOIN f y ON y.lang = c.lang AND y.phrase = p2 JOIN totals t ON t.lang = c.lang),
kept AS (
  SELECT * FROM scored s WHERE best = 1 AND NOT EXISTS (
    SELECT 1 FROM cand b WHERE b.lang = s.lang AND b.m > s.m AND b.a >= s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


QUERIES = {"op1_url_filter": op1_url_filter, "op2_minhash": op2_minhash, "op3_embedding": op3_embedding, "op4_substring": op4_substring, "op5_packing": op5_packing, "op6_toxicity": op6_toxicity, "op7_token_counts": op7_token_counts, "op8_mixing": op8_mixing, "op9_chat": op9_chat, "op10_ann": op10_ann, "op11_alignment": op11_alignment, "op12_line_dedup": op12_line_dedup, "op13_collocations": op13_collocations}
ORACLES = {"op1_url_filter": OP1_SQL, "op3_embedding": OP3_SQL, "op4_substring": OP4_SQL, "op8_mixing": OP8_SQL, "op9_chat": OP9_SQL, "op12_line_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
