"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, exact_dedup, language_id, licenses, mixing, near_dedup, pii, quality_model, quality_rules, training_order
from termloom.llm.common import scratch_dir, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded="decoded")
    return done.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sequences of token ids at their places in training order, with digests of the records."""
    docs = table(spark, sf_dir, "documents")
    ordered = training_order.training_order(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, key=b"epoch-0")
    return ordered.select("slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", F.sha2("record", 256).alias("record_sha256"))


def training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every document written as shards, and read back from the files alone."""
    docs = table(spark, sf_dir, "documents")
    ordered = training_order.training_order(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, key=b"epoch-0")
    path = f"{scratch_dir(spark)}/termloom/{uuid.uuid4().hex}/shards"
    training_order.write_shards(ordered, path)
    return training_order.read_shards(spark, path).select("slot", "n_tokens", F.sha2("record", 256).alias("record_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts and whether it stays."""
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and expressions of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


LICENSE_BASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT doc_id, len(w) AS n_words, list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m, list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
  list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM d),
p AS (SELECT *, list_concat(list_concat(m, a), g) AS l FROM h)
SELECT doc_id, n_words, len(l) AS n_base, list_min(l) - 1 AS first_word, list_max(l) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM p
"""


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the licence scan: the places of the base phrases."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule failures and host verdicts of every document; its host is its source."""
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    rate = F.round("host_rate", 9).alias("host_rate")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed", rate, "host_rejected")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d),
g AS (SELECT doc_id, i, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM w)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
s AS (SELECT d.doc_id, source, len(l) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0) AS n_repeat_words FROM d JOIN w USING (doc_id) LEFT JOIN r USING (doc_id)),
q AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s),
f AS (SELECT *, CAST(base_failed AS INT) + CAST(10 * n_symbols > n_words AS INT) + CAST(n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines AS INT) + CAST(word_chars < 3 * n_words OR word_chars > 12 * n_words AS INT) AS n_failed FROM q),
o AS (SELECT source, count(*) AS n, count(*) FILTER (n_failed > 0) AS x FROM f GROUP BY source),
a AS (SELECT sum(n) AS n, sum(x) / sum(n) AS m, sum(n * (x / n) * (x / n)) / sum(n) AS sq, count(*) AS h FROM o),
b AS (SELECT m, CASE WHEN sq - m * m - m * (1 - m) * h / n > 0 THEN greatest(1, m * (1 - m) / (sq - m * m - m * (1 - m) * h / n)) ELSE n END AS k FROM a),
c AS (SELECT source, (x + m * k) / (n + k) AS rate FROM o, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (n_failed = 0 AND rate <= 0.5) AS kept, n_failed, round(rate, 9) AS host_rate, rate > 0.5 AS host_rejected
FROM f JOIN c ON f.source IS NOT DISTINCT FROM c.source
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out("doc_id", 4, 2)
    model = language_id.fit(docs.where(~out))
    found = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    mixed, sources = mixing.mix(docs, F.array("source"))
    found = mixed.join(F.broadcast(sources), F.col("names")[0].eqNullSafe(F.col("source")), "left")  # a row per source: bounded in mix()
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_id.held_out("doc_id", 5, 0)
    found = quality_model.score(docs, table(spark, sf_dir, "labels").where(~out).select("doc_id", "quality"))
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates."""
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i : i + 4], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 2))) AS i FROM w WHERE len(l) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id, min(reached) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, as counts, a digest of the rules' matches and all places."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.RULED]
    more = [F.size("spans").cast("long").alias("n_spans"), F.size("extra").cast("long").alias("n_extra")]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), *more)


def _pii_sql() -> str:
    """The rules in SQL: matches, the gaps before them, what each kind must pass."""
    shapes = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    luhn = "list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(r[i] AS INT) WHEN r[i] > '4' THEN 2 * CAST(r[i] AS INT) - 9 ELSE 2 * CAST(r[i] AS INT) END)) % 10 = 0"
    passes = {"email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN true ELSE CAST('0' || ltrim(p, '0') AS INT) > 255 END)) = 0", "card": f"CASE WHEN length(n) BETWEEN 12 AND 19 THEN {luhn} ELSE false END", "phone": "length(n) BETWEEN 9 AND 15"}
    kinds = [
        f"SELECT doc_id, '{k}' AS kind, {i} AS rank, s, e FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS n, reverse(n) AS r, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e, e - length(m) AS s"
        f" FROM (SELECT doc_id, unnest(l) AS m, unnest(g[1:len(l)]) AS gap, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{shapes[k]}') AS l, string_split_regex(t, '{shapes[k]}') AS g FROM d))) WHERE {passes[k]}"
        for i, k in enumerate(pii.RULED)
    ]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(kinds)}),
c AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.RULED)}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS said FROM m GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.RULED)}, sha256(coalesce(said, '')) AS base_sha256 FROM d LEFT JOIN c USING (doc_id)
"""


def pii_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of personal data: the rules' matches."""
    return op10_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.RULED), "base_sha256")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_training_order": op2_training_order,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_quality_model": op8_quality_model,
    "op9_near_dedup": op9_near_dedup,
    "op10_pii": op10_pii,
    "training_shards": training_shards,
    "license_base": license_base,
    "pii_rules": pii_rules,
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op5_quality_rules": OP5_SQL, "op9_near_dedup": OP9_SQL, "license_base": LICENSE_BASE_SQL, "pii_rules": _pii_sql()}
