"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import (
    host_rules, hyperdimensional, kneser_ney, lempel_ziv, order_minhash, packing, periodic_runs, prefix_trie, simhash,
    suffix_dedup, toxicity, viterbi, winnowing)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies, on the driver and on the workers alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare(_documents(spark, sf_dir))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encode(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return hyperdimensional.predict(docs, hyperdimensional.train(docs))


def op7_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv.digests(_documents(spark, sf_dir))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return kneser_ney.score(docs, kneser_ney.train(docs))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source",
        F.round("host_rate", 6).alias("host_rate"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_documents(spark, sf_dir))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_vector_packing": op2_vector_packing,
    "op3_simhash": op3_simhash,
    "op4_viterbi": op4_viterbi,
    "op5_toxicity": op5_toxicity,
    "op6_hyperdimensional": op6_hyperdimensional,
    "op7_lempel_ziv": op7_lempel_ziv,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_host_rules": op10_host_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_winnowing": op13_winnowing,
    "pipeline": pipeline,
}

#: Words of every document with their places; empty and null texts have none.
_WORDS = r"""texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
lists AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM lists)"""


def _windows(size: int) -> str:
    return f"""windows AS (SELECT *, CASE WHEN i + {size - 1} <= n THEN md5(array_to_string(
  list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING), ' ')) END AS run FROM words)"""


def _covered(mark: str, size: int) -> str:
    return f"""covered AS (SELECT *, max(({mark})::INT) OVER (
  PARTITION BY doc_id ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS hit FROM marked)"""


#: CRC-32 of the decimal form of ``c``, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1),
    lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

_LETTERS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op11_prefix_trie": f"""WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
  PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
heads AS (SELECT v.c, o.pos, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.pos < v.h),
taken AS (SELECT v.c, any_value(v.h) AS h, count(x.c) AS k FROM convs v LEFT JOIN heads x ON x.c = v.c GROUP BY v.c),
built AS (SELECT c, pos + 1 AS d, role, text FROM heads UNION ALL
  SELECT o.c, k + pos - h + 1, role, text FROM own o JOIN taken t ON t.c = o.c WHERE pos >= h),
paths AS (SELECT c, d, length(text) AS points, sha256(array_to_string(list(sha256(length(role) || ':' || role || text)) OVER (
    PARTITION BY c ORDER BY d), ',')) AS p FROM built UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT d, p, min(c) AS c, count(*) AS n, any_value(points) AS points FROM paths GROUP BY d, p),
above AS (SELECT o.d, o.p, u.c AS parent FROM nodes o JOIN paths a ON a.c = o.c AND a.d = o.d - 1 JOIN nodes u ON u.d = a.d AND u.p = a.p),
kids AS (SELECT d - 1 AS d, parent AS c, count(*) AS kids FROM above GROUP BY ALL),
sums AS (SELECT a.d, a.p, count(*) FILTER (coalesce(kids, 0) = 0) AS leaves, sum((u.n - 1) * u.points) AS saved
  FROM nodes u LEFT JOIN kids k ON k.d = u.d AND k.c = u.c JOIN paths a ON a.c = u.c AND a.d <= u.d GROUP BY ALL),
lasts AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
ends AS (SELECT d, p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM paths JOIN lasts USING (c, d) GROUP BY ALL)
SELECT o.c AS conv_id, o.d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes o LEFT JOIN above USING (d, p) LEFT JOIN kids k ON k.d = o.d AND k.c = o.c JOIN sums USING (d, p) LEFT JOIN ends USING (d, p)""",
    "op13_winnowing": f"""WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM benchmark),
cut AS (SELECT item, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0),
known AS (SELECT DISTINCT size, array_to_string(w[i:i + size - 1], ' ') AS run, item
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM cut)),
sizes AS (SELECT DISTINCT size FROM cut),
windows AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
found AS (SELECT doc_id, size, i, item FROM windows JOIN known USING (size, run)),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_lempel_ziv": f"""WITH {_WORDS}, {_windows(20)},
marked AS (SELECT *, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS again FROM windows),
{_covered('again', 20)}
SELECT l.doc_id, len(any_value(l.w))::BIGINT AS n_words, coalesce(sum(hit), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (hit = 0), '')) AS kept_sha256
FROM lists l LEFT JOIN covered c ON c.doc_id = l.doc_id GROUP BY l.doc_id""",
    "op10_host_rules": f"""WITH {_WORDS}, {_windows(5)},
marked AS (SELECT *, run IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, run) > 1 AS again FROM windows),
{_covered('again', 5)},
by_words AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(hit) AS n_repeat_words FROM covered GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
by_lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
measured AS (SELECT t.doc_id, t.source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM texts t LEFT JOIN by_words USING (doc_id) LEFT JOIN by_lines USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged WHERE source IS NOT NULL GROUP BY 1),
total AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(n * n) AS nn, sum(f * f / n) AS ff, (sum(f) + 0.5) / (sum(n) + 1) AS mean FROM hosts),
prior AS (SELECT mean, mean * (1 - mean) AS chance,
  CASE WHEN n - nn / n > 0 THEN (greatest(0, ff - f * f / n) - (k - 1) * mean * (1 - mean)) / (n - nn / n) ELSE 0 END AS spread FROM total),
strengths AS (SELECT mean, CASE WHEN spread > chance * 1e-6 THEN greatest(1.0, chance / spread - 1) ELSE 1e6 END AS strength FROM prior),
rates AS (SELECT source, (f + mean * strength) / (n + strength) AS rate FROM hosts, strengths)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept, source, round(rate, 6) AS host_rate
FROM judged LEFT JOIN rates USING (source)""",
}
