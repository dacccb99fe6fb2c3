"""One query for each operator over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.config import STOP_WORDS, ExcludeConfig, ExtractConfig, KnownTerm
from termloom.functions import text as T
from termloom.operators import candidates as C
from termloom.operators import curate as R
from termloom.operators import events as E
from termloom.operators import intervals as I
from termloom.operators import keywords as K
from termloom.operators import render as N
from termloom.operators import search as H
from termloom.operators import validate as V
from termloom.scratch import scratch_dir
from termloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a corpus: file is the id, prose the text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("prose"))


STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS_SQL = f"""
t AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]+', '', 'g')), '\\s+')) AS term FROM documents
), u AS (SELECT CAST(doc_id AS VARCHAR) AS file, term FROM t WHERE strlen(term) >= 2 AND term NOT IN ({STOPS})),
c AS (SELECT file, term, count(*) AS n, sum(count(*)) OVER (PARTITION BY file) AS total FROM u GROUP BY file, term)
"""
TFIDF_SQL = f"""
{TOKENS_SQL}, d AS (SELECT term, count(*) AS df, max(n / total) AS m FROM c GROUP BY term),
r AS (SELECT term, df, m * ln((SELECT count(*) FROM documents) / df) AS raw FROM d),
k AS (SELECT * FROM r WHERE raw > 0 ORDER BY raw DESC, term LIMIT 500)
"""


@query(f"WITH {TOKENS_SQL} SELECT file, term, n, CAST(total AS BIGINT) AS total FROM c")
def tokenize_counts(spark, sf):
    return K.token_counts(corpus(spark, sf))


@query(f"WITH {TFIDF_SQL} SELECT term, round(raw / max(raw) OVER (), 9) AS score, df FROM k")
def tfidf_topk(spark, sf):
    return K.tfidf(corpus(spark, sf)).select("term", F.round("score", 9).alias("score"), "df")


@query(f"WITH {TOKENS_SQL} SELECT term, count(*) AS df, round(max(n / total), 9) AS max_tf FROM c GROUP BY term")
def document_frequency(spark, sf):
    return K.document_frequency(K.token_counts(corpus(spark, sf))).withColumn("max_tf", F.round("max_tf", 9))


PHRASES_SQL = "SELECT p_partkey AS id, concat('The ', p_name, CASE WHEN p_partkey % 3 = 0 THEN ' of' WHEN p_partkey % 3 = 1 THEN ' and the' ELSE '' END) AS phrase FROM part"


def phrases(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(PHRASES_SQL)


@query(f"""
WITH p AS ({PHRASES_SQL}), w AS (SELECT id, phrase, list_filter(regexp_split_to_array(phrase, '\\s+'), lambda x: x <> '') AS l FROM p),
k AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: lower(l[i]) NOT IN ({STOPS})) AS u FROM w)
SELECT id, CASE WHEN len(l) <= 1 OR len(u) = 0 THEN phrase ELSE array_to_string(l[list_min(u):list_max(u)], ' ') END AS trimmed FROM k
""")
def trim_stopwords(spark, sf):
    return phrases(spark, sf).select("id", T.trim_stopwords("phrase", STOP_WORDS).alias("trimmed"))


CONTEXT_SQL = """
  CASE WHEN hit > 0 THEN regexp_replace(CASE WHEN greatest(hit - 60, 1) > 1 THEN regexp_replace(cut, '^\\S*\\s+', '') ELSE cut END, '^\\s+|\\s+$', '', 'g') END
"""


@query(f"""
WITH {TFIDF_SQL},
h AS (SELECT CAST(doc_id AS VARCHAR) AS file, term, strpos(lower(text), lower(term)) AS hit, text FROM documents, k WHERE contains(lower(text), lower(term))),
s AS (SELECT *, substring(text, greatest(hit - 60, 1), least(hit + length(term) + 59, length(text)) - greatest(hit - 60, 1) + 1) AS cut FROM h)
SELECT term AS key, file, {CONTEXT_SQL} AS context FROM s
""")
def context_snippets(spark, sf):
    """Snippets of all terms of the top-k."""
    docs = corpus(spark, sf)
    return C.locate(K.tfidf(docs), docs)


def _exclude(match: str, case: str) -> None:
    terms = {"contains": ["Blue", "#4"], "exact": ["Part#0000001", "part#0000002"], "regex": ["^part#0+[12]", "([", "9$"]}[match]
    loose = case == "insensitive"
    shown, cased = ("lower(p_name)", [t.lower() for t in terms]) if loose and match != "regex" else ("p_name", terms)
    tests = {
        "contains": [f"contains({shown}, '{t}')" for t in cased],
        "exact": [f"{shown} = '{t}'" for t in cased],
        "regex": [f"regexp_matches(p_name, '{'(?i)' if loose else ''}{t}')" for t in C.usable_patterns(terms)],
    }[match]

    def run(spark, sf):
        rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"))
        return rows.where(~C.excluded("term", ExcludeConfig(terms, match, case)))

    run.__name__ = f"exclude_{match}_{case}"
    query(f"SELECT p_partkey AS id, p_name AS term FROM part WHERE NOT ({' OR '.join(tests)})")(run)


for _match, _case in product(("contains", "exact", "regex"), ("sensitive", "insensitive")):
    _exclude(_match, _case)


#: Candidates made of the parts: three spellings, one to three places each.
CANDIDATES_SQL = """
SELECT lower(term) AS key, score, term, file, context, loc_ord FROM (
  SELECT concat(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END, ' ', p_partkey) AS term, CAST(p_partkey * 37 % 100 AS DOUBLE) / 100 AS score,
    concat('d', (p_partkey * 7 + j * 13) % 50, '/f', j, '.md') AS file, concat('at ', p_name, ' ', j) AS context, j AS loc_ord
  FROM part CROSS JOIN (VALUES (0), (1), (2)) AS v(j) WHERE j <= p_partkey % 3
) AS w
"""


def of_parts(spark, sf, sql: str) -> DataFrame:
    """The rows of SQL over tables named in it."""
    for name in ("part", "nation", "region", "events"):
        if name in sql:
            table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def candidate_rows(spark, sf):
    rows = of_parts(spark, sf, CANDIDATES_SQL)
    return rows.groupBy("key", "score", "term").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("loc_ord", "file", "context"))), lambda x: F.struct(x["file"].alias("file"), x["context"].alias("context"))).alias("locations")
    )


def shown_places(c="locations"):
    return F.array_join(F.transform(c, lambda x: F.concat_ws("@", x["file"], x["context"])), ";")


KNOWN = [KnownTerm("Ring goods", ["small ring", "Red Ring"]), KnownTerm("Blue bolt", ["BLUE"]), KnownTerm("All goods", ["goods"]), KnownTerm("Absent", ["nothing like it"]), KnownTerm("widget 1", [])]


def _known_sql() -> str:
    """The known term that each candidate ends up in: a step for each entry, as a later one may take up an earlier one's."""
    steps = ["s0 AS (SELECT *, key AS now, CAST(NULL AS VARCHAR) AS known FROM v)"]
    for i, k in enumerate(KNOWN):
        hit = " OR ".join(f"contains(now, '{x.lower()}')" for x in (k.term, *k.variants))
        steps.append(f"s{i + 1} AS (SELECT * REPLACE (CASE WHEN {hit} THEN '{k.term.lower()}' ELSE now END AS now, CASE WHEN {hit} THEN '{k.term}' ELSE known END AS known) FROM s{i})")
    return ", ".join(steps)


CONSOLIDATED_SQL = f"""
v AS ({CANDIDATES_SQL}), {_known_sql()}, m AS (SELECT * FROM s{len(KNOWN)}),
f AS (SELECT *, CASE WHEN known IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY now, file ORDER BY score DESC, key, loc_ord) END AS n, max(score) OVER (PARTITION BY now) AS best FROM m),
o AS (SELECT now AS key, coalesce(known, term) AS term, best AS score, string_agg(file || '@' || context, ';' ORDER BY score DESC, key, loc_ord) AS places, count(DISTINCT file) AS files FROM f WHERE n = 1 GROUP BY now, coalesce(known, term), best)
"""


@query(f"WITH {CONSOLIDATED_SQL} SELECT key, term, score, places FROM o")
def known_terms_consolidation(spark, sf):
    return C.consolidate(candidate_rows(spark, sf), KNOWN).select("key", "term", "score", shown_places().alias("places"))


@query(f"WITH {CONSOLIDATED_SQL} SELECT key, term FROM o WHERE files / 150 <= 0.1")
def document_share(spark, sf):
    return C.document_share(C.consolidate(candidate_rows(spark, sf), KNOWN), 150, 0.1).select("key", "term")


YAKE_SQL = """
SELECT p_name AS key, concat('f', p_partkey % 17, '.md') AS file, p_partkey AS rank, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS term,
  CAST(p_partkey * 37 % 100 AS DOUBLE) / 100 AS score, concat('ctx ', p_partkey % 5) AS context FROM part
"""
PLACES_SQL = "SELECT DISTINCT p_name AS key, concat('f', p_partkey % 19, '.md') AS file, concat('ctx ', p_partkey % 5) AS context FROM part UNION SELECT lower(p_brand), 'f3.md', 'of a brand' FROM part"
IDF_SQL = "SELECT p_name AS term, CAST(max(p_partkey % 90) AS DOUBLE) / 100 AS score FROM part WHERE p_size > 10 GROUP BY p_name UNION ALL SELECT p_brand, CAST(max(p_size) AS DOUBLE) / 100 FROM part GROUP BY p_brand"


@query(f"""
WITH y AS ({YAKE_SQL}), i AS ({IDF_SQL}), p AS (SELECT * FROM ({PLACES_SQL}) WHERE key IN (SELECT lower(term) FROM i)), yk AS (SELECT DISTINCT key, file, context FROM y),
a AS (SELECT key, score, NULL AS t FROM y UNION ALL SELECT lower(term), score, term FROM i),
l AS (SELECT key, 1 AS o, file, rank AS q, context FROM y UNION ALL SELECT p.key, 2, p.file, 0, p.context FROM p ANTI JOIN yk USING (key, file, context)),
b AS (SELECT key, string_agg(file || '@' || context, ';' ORDER BY o, file, q, context) AS places FROM l GROUP BY key),
d AS (SELECT key, term FROM (SELECT key, term, row_number() OVER (PARTITION BY key ORDER BY score DESC, file, rank) AS n FROM y) WHERE n = 1)
SELECT a.key, max(a.score) AS score, coalesce(any_value(d.term), max(a.t)) AS term, coalesce(any_value(b.places), '') AS places FROM a LEFT JOIN b USING (key) LEFT JOIN d USING (key) GROUP BY a.key
""")
def candidates_merge(spark, sf):
    y, i, p = (of_parts(spark, sf, x) for x in (YAKE_SQL, IDF_SQL, PLACES_SQL))
    # a key whose TF-IDF score fell below the threshold has no TF-IDF places
    p = p.join(i.select(F.lower("term").alias("key")), "key", "left_semi")
    return C.merge_scored(y, i, p).select("key", "score", "term", shown_places().alias("places"))


@query(f"""
WITH {TFIDF_SQL}, s AS (SELECT term, raw / max(raw) OVER () AS score FROM k), g AS (SELECT * FROM s WHERE score >= 0.1),
h AS (SELECT g.term, g.score, count(*) AS files FROM g, documents WHERE contains(lower(text), g.term) GROUP BY g.term, g.score
      UNION ALL SELECT term, score, 0 FROM g WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), g.term)))
SELECT term, round(score, 9) AS score, files FROM h WHERE files / (SELECT count(*) FROM documents) <= 0.7 AND NOT contains(term, 'the') ORDER BY score DESC, term LIMIT 200
""")
def candidates_final(spark, sf):
    docs = corpus(spark, sf)
    best = K.tfidf(docs).where("score >= 0.1").select("term", "score").cache()
    none = spark.createDataFrame([], "key string, file string, rank long, term string, score double, context string")
    merged = C.merge_scored(none, best, C.locate(best, docs))
    kept = C.document_share(merged, docs.count(), 0.7).where(~C.excluded("term", ExcludeConfig(["the"])))
    return C.final_candidates(kept, 200).select("term", F.round("score", 9).alias("score"), F.size("locations").cast("long").alias("files"))


@query()
def yake_keywords(spark, sf):
    return K.yake_keywords(corpus(spark, sf), 3, 20).withColumn("score", F.round("score", 9))


@query(r"""
WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS sentence FROM documents),
l AS (SELECT file, sentence, regexp_extract_all(s, '[\p{L}\p{N}]+') AS l FROM s),
w AS (SELECT file, sentence, unnest(l) AS w, generate_subscripts(l, 1) AS idx FROM l)
SELECT file, lower(w) AS term, count(*) AS n, count(DISTINCT sentence) AS sentences, count(*) FILTER (idx > 1 AND regexp_matches(w, '^\p{Lu}')) AS capitalised FROM w GROUP BY ALL
""")
def yake_features(spark, sf):
    return K.yake_features(corpus(spark, sf))


@query()
def extract_candidates(spark, sf):
    """The whole extraction: both scorers, places, known terms, filters, top-k."""
    found = C.extract(corpus(spark, sf), ExtractConfig(max_candidates=200, known_terms=KNOWN))
    return found.select("term", F.round("score", 9).alias("score"), F.size("locations").alias("places"))


#: Curated terms made of every fifth part: a tree of parents, some missing; every other one has two aliases, one a candidate's name.
CURATED_SQL = """
SELECT p.p_partkey AS ord, concat(p.p_name, ' ', p.p_partkey) AS term, concat('About @', p.p_name, ' #', p.p_size, '.') AS definition,
  CASE WHEN p.p_partkey = 0 THEN NULL WHEN p.p_partkey % 35 = 30 THEN 'nowhere' ELSE concat(u.p_name, ' ', u.p_partkey) END AS parent,
  CASE WHEN p.p_partkey % 10 = 5 AND n.p_name IS NOT NULL THEN concat(upper(n.p_name), ' ', n.p_partkey, ',alias ', p.p_partkey) END AS alias_list,
  CASE WHEN p.p_partkey % 15 = 0 THEN concat(u.p_name, ' ', u.p_partkey, ',See ', p.p_brand) END AS see_list,
  CASE WHEN p.p_partkey % 10 = 0 THEN concat('f', p.p_partkey % 3, '.md') END AS main_list
FROM part AS p LEFT JOIN part AS u ON u.p_partkey = 5 * CAST(floor(p.p_partkey / 15.0) AS BIGINT) LEFT JOIN part AS n ON n.p_partkey = p.p_partkey + 1
WHERE p.p_partkey % 5 = 0
"""


def curated(spark, sf):
    made = of_parts(spark, sf, CURATED_SQL)
    lists = {n: F.coalesce(F.split(F.col(c), ","), F.array().cast("array<string>")) for n, c in (("aliases", "alias_list"), ("see_also", "see_list"), ("main_files", "main_list"))}
    return made.withColumns(lists).drop("alias_list", "see_list", "main_list")


LOCATED_SQL = f"""
v AS ({CANDIDATES_SQL}), c AS ({CURATED_SQL}),
f AS (SELECT term, 0 AS form_ord, lower(term) AS form FROM c UNION ALL
      SELECT term, generate_subscripts(string_split(alias_list, ','), 1), lower(unnest(string_split(alias_list, ','))) FROM c WHERE alias_list IS NOT NULL),
h AS (SELECT f.term, f.form_ord, v.loc_ord, v.file, v.context, row_number() OVER (PARTITION BY f.term, v.file ORDER BY f.form_ord, v.loc_ord) AS n FROM f JOIN v ON v.key = f.form),
g AS (SELECT term, row_number() OVER (PARTITION BY term ORDER BY form_ord, loc_ord) AS pos, file, context FROM h WHERE n = 1)
"""


@query(f"WITH {LOCATED_SQL} SELECT term, CAST(pos AS INTEGER) AS pos, file, context FROM g")
def curated_locations(spark, sf):
    return R.curated_locations(curated(spark, sf), candidate_rows(spark, sf))


@query(f"""
WITH {LOCATED_SQL} SELECT g.term, CAST(g.pos AS INTEGER) AS pos, g.file, coalesce(g.file = c.main_list OR ends_with(g.file, '/' || c.main_list), false) AS main FROM g JOIN c USING (term)
""")
def main_flags(spark, sf):
    return R.main_flags(R.curated_locations(curated(spark, sf), candidate_rows(spark, sf)), curated(spark, sf)).select("term", "pos", "file", "main")


#: Known terms and variants made of the parts: names of curated terms and of their aliases, and of neither.
KNOWN_SQL = """
SELECT p_partkey AS known_ord, CASE WHEN p_partkey % 2 = 0 THEN upper(concat(p_name, ' ', p_partkey)) ELSE concat('alias ', p_partkey) END AS term,
  concat('variant ', p_partkey, ',ALIAS ', p_partkey) AS variant_list FROM part WHERE p_partkey % 4 < 2
"""


def known_rows(spark, sf):
    return of_parts(spark, sf, KNOWN_SQL).select(F.col("known_ord").cast("int").alias("known_ord"), "term", F.split("variant_list", ",").alias("variants"))


ALIASES_SQL = f"""
c AS ({CURATED_SQL}), v AS (SELECT DISTINCT key, term AS name FROM ({CANDIDATES_SQL})), k AS ({KNOWN_SQL}),
own AS (SELECT term, unnest(string_split(alias_list, ',')) AS alias, generate_subscripts(string_split(alias_list, ','), 1) AS o FROM c WHERE alias_list IS NOT NULL),
forms AS (SELECT term, 0 AS o, lower(term) AS form FROM c UNION ALL SELECT term, o, lower(alias) FROM own),
first AS (SELECT term, 0 AS step, o, 0 AS p, alias FROM own UNION ALL SELECT f.term, 1, f.o, 0, v.name FROM forms f JOIN v ON v.key = f.form WHERE lower(v.name) <> lower(f.term)),
names AS (SELECT term, lower(alias) AS form FROM first UNION SELECT term, lower(term) FROM c),
kv AS (SELECT lower(term) AS form, known_ord, unnest(string_split(variant_list, ',')) AS alias, generate_subscripts(string_split(variant_list, ','), 1) AS p FROM k),
every AS (SELECT * FROM first UNION ALL SELECT n.term, 2, kv.known_ord, kv.p, kv.alias FROM names n JOIN kv USING (form)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY term, lower(alias) ORDER BY step, o, p) AS n FROM every)
"""


@query(f"WITH {ALIASES_SQL} SELECT c.term, coalesce((SELECT string_agg(alias, ',' ORDER BY step, o, p) FROM ranked r WHERE r.term = c.term AND (step = 0 OR n = 1)), '') AS aliases FROM c")
def alias_auto_add(spark, sf):
    return R.added_aliases(curated(spark, sf), candidate_rows(spark, sf), known_rows(spark, sf)).select("term", F.array_join("aliases", ",").alias("aliases"))


TREE_SQL = """
SELECT 'World' AS term, CAST(NULL AS VARCHAR(30)) AS parent UNION ALL SELECT r_name, 'World' FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'loop a', 'loop b' UNION ALL SELECT 'loop b', 'loop a' UNION ALL SELECT 'lost', 'nowhere'
"""


def tree(spark, sf):
    for name in ("region", "nation", "supplier"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(TREE_SQL.replace("VARCHAR(30)", "STRING"))


@query(f"WITH t AS ({TREE_SQL}) SELECT t.term, t.parent, coalesce((SELECT string_agg(x.term, ',' ORDER BY x.term) FROM t x WHERE x.parent = t.term), '') AS children FROM t")
def children_inversion(spark, sf):
    return R.children(tree(spark, sf)).select("term", "parent", F.array_join("children", ",").alias("children"))


@query(f"WITH t AS ({TREE_SQL}) SELECT term, parent FROM t WHERE parent IS NOT NULL AND parent NOT IN (SELECT term FROM t)")
def dangling_parents(spark, sf):
    return R.dangling(tree(spark, sf)).select("term", "parent")


@query(f"WITH t AS ({TREE_SQL}) SELECT term, CASE WHEN parent IN (SELECT term FROM t) THEN parent END AS parent FROM t")
def nullified_parents(spark, sf):
    return R.drop_dangling_parents(tree(spark, sf)).select("term", "parent")


@query(f"""
WITH RECURSIVE t AS ({TREE_SQL}), c(term, top, chain, seen) AS (
  SELECT term, parent, CASE WHEN parent IS NULL THEN CAST([] AS VARCHAR[]) ELSE [parent] END, [term, parent] FROM t
  UNION ALL SELECT c.term, t.parent, list_prepend(t.parent, c.chain), list_append(c.seen, t.parent) FROM c JOIN t ON t.term = c.top WHERE t.parent IS NOT NULL AND NOT list_contains(c.seen, t.parent))
SELECT term, array_to_string(arg_max(chain, len(chain)), '>') AS chain FROM c GROUP BY term
""")
def parent_chain(spark, sf):
    return N.parent_chains(tree(spark, sf)).select("term", F.array_join("chain", ">").alias("chain"))


VOCABULARIES_SQL = f"""
{TOKENS_SQL}, prior AS (SELECT DISTINCT term FROM c),
x AS (SELECT unnest(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]+', '', 'g')), '\\s+')) AS term FROM conversations),
fresh AS (SELECT DISTINCT term FROM x WHERE strlen(term) >= 2 AND term NOT IN ({STOPS})), named AS (SELECT term FROM prior UNION SELECT term || 's' FROM prior)
"""


def vocabularies(spark, sf):
    """Snapshots of whole tables: every term of the documents, each with a plural and a place, and every one of the conversations."""
    at = F.array(F.struct(F.col("file"), F.lit(False).alias("main"), F.lit("").alias("context")))
    terms = corpus(spark, sf).select("file", F.explode(T.tokens("prose", STOP_WORDS)).alias("term")).groupBy("term").agg(F.min("file").alias("file"))
    fresh = table(spark, sf, "conversations").select(F.explode(T.tokens("text", STOP_WORDS)).alias("term")).distinct()
    return terms.select("term", F.array(F.concat("term", F.lit("s"))).alias("aliases"), at.alias("locations")), fresh


@query(f"WITH {VOCABULARIES_SQL} SELECT term FROM fresh WHERE term NOT IN (SELECT term FROM named)")
def new_candidates(spark, sf):
    terms, fresh = vocabularies(spark, sf)
    return R.new_candidates(fresh, terms)


@query(f"WITH {VOCABULARIES_SQL} SELECT term FROM prior WHERE term NOT IN (SELECT term FROM fresh) AND term || 's' NOT IN (SELECT term FROM fresh)")
def stale_terms(spark, sf):
    terms, fresh = vocabularies(spark, sf)
    return R.stale_terms(terms, fresh).select("term")


@query(f"""
WITH {VOCABULARIES_SQL}, n AS (SELECT count(*) FILTER (term NOT IN (SELECT term FROM named)) AS new, count(*) AS total FROM fresh)
SELECT new, total, round(CASE WHEN total = 0 THEN 0 ELSE new / total END, 9) AS ratio, CASE WHEN new >= 0.7 * total THEN 'full rebuild advised' WHEN new >= 0.4 * total THEN 'many new candidates' END AS warning FROM n
""")
def diff_ratio(spark, sf):
    terms, fresh = vocabularies(spark, sf)
    ratio = R.new_ratio("new", "total")
    return R.new_counts(fresh, terms).select("new", "total", F.round(ratio, 9).alias("ratio"), R.ratio_warning(ratio).alias("warning"))


#: A prior snapshot and a model's changes to it. Some terms stand twice, in other spelling; some changes meet no term.
PRIOR_SQL = f"""
SELECT ord, term, definition, parent, alias_list, see_list, CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END AS placed FROM ({CURATED_SQL}) AS c
UNION ALL SELECT ord + 1000000000, upper(term), 'second', CAST(NULL AS VARCHAR(99)), CAST(NULL AS VARCHAR(99)), CAST(NULL AS VARCHAR(99)), 0 FROM ({CURATED_SQL}) AS d WHERE ord % 11 = 0
"""
ADDED_SQL = """
SELECT n_name AS term, 'a nation' AS definition, r_name AS parent, lower(n_name) AS alias_list, CAST(NULL AS VARCHAR(99)) AS see_list FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'lost', 'no parent', 'nowhere', CAST(NULL AS VARCHAR(99)), 'small ring 0'
"""
CHANGED_SQL = f"""
SELECT 2 * ord AS ord, upper(term) AS term, concat('new ', ord) AS definition, CAST(NULL AS VARCHAR(99)) AS parent, CAST(NULL AS VARCHAR(99)) AS alias_list, 'TLS' AS see_list FROM ({CURATED_SQL}) AS c WHERE ord % 3 = 0
UNION ALL SELECT 2 * ord + 1, term, CASE WHEN ord % 12 = 0 THEN 'newer' END, 'security', 'o1,o2', NULL FROM ({CURATED_SQL}) AS d WHERE ord % 6 = 0
UNION ALL SELECT 7, 'missing', 'm', NULL, NULL, NULL
"""
GONE_SQL = f"SELECT upper(term) AS term, 'unused' AS reason FROM ({CURATED_SQL}) AS c WHERE ord % 7 = 0 UNION ALL SELECT 'never', 'x'"
SUGGESTED_SQL = "SELECT r_name AS term, 'a region' AS definition, CAST(NULL AS VARCHAR(99)) AS parent FROM region"
MERGED_SQL = f"""
prior AS ({PRIOR_SQL}), gone AS (SELECT DISTINCT lower(term) AS k FROM ({GONE_SQL})), changed AS ({CHANGED_SQL}), added AS ({ADDED_SQL}), suggested AS ({SUGGESTED_SQL}),
stay AS (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY ord) AS n FROM prior WHERE lower(term) NOT IN (SELECT k FROM gone)),
patch AS (SELECT lower(term) AS k, arg_max(definition, ord) FILTER (definition IS NOT NULL) AS d, arg_max(parent, ord) FILTER (parent IS NOT NULL) AS p,
  arg_max(alias_list, ord) FILTER (alias_list IS NOT NULL) AS a, arg_max(see_list, ord) FILTER (see_list IS NOT NULL) AS s FROM changed GROUP BY lower(term)),
merged AS (
  SELECT term, coalesce(d, definition) AS definition, coalesce(p, parent) AS parent, coalesce(a, alias_list, '') AS aliases, coalesce(s, see_list, '') AS see_also, placed FROM stay LEFT JOIN patch ON k = lower(term) AND n = 1
  UNION ALL SELECT term, definition, parent, coalesce(alias_list, ''), coalesce(see_list, ''), 0 FROM added UNION ALL SELECT term, definition, parent, '', '', 0 FROM suggested)
"""


def delta(spark, sf):
    """Prior terms and a model's changes to them."""
    read = lambda sql: of_parts(spark, sf, sql.replace("VARCHAR(99)", "STRING"))
    listed = lambda df, null: df.withColumns({n: F.coalesce(F.split(c, ","), F.lit(None).cast("array<string>") if null else F.array().cast("array<string>")) for n, c in (("aliases", "alias_list"), ("see_also", "see_list"))}).drop("alias_list", "see_list")
    place = F.array(F.struct(F.lit("a.md").alias("file"), F.lit(True).alias("main"), F.lit("x").alias("context")))
    prior = listed(read(PRIOR_SQL), False).withColumn("locations", F.when(F.col("placed") == 1, place).otherwise(F.filter(place, lambda x: F.lit(False)))).drop("placed")
    return prior, {"additions": listed(read(ADDED_SQL), False), "modifications": listed(read(CHANGED_SQL), True), "removals": read(GONE_SQL), "suggested": read(SUGGESTED_SQL)}


@query(f"WITH {MERGED_SQL} SELECT term, definition, parent, aliases, see_also, CAST(placed AS INTEGER) AS places FROM merged")
def merge_delta(spark, sf):
    prior, d = delta(spark, sf)
    merged = R.merge_delta(prior, d["additions"], d["modifications"], d["removals"], d["suggested"])
    return merged.select("term", "definition", "parent", F.array_join("aliases", ",").alias("aliases"), F.array_join("see_also", ",").alias("see_also"), F.size("locations").alias("places"))


@query(f"""
WITH {MERGED_SQL} SELECT (SELECT count(*) FROM prior WHERE lower(term) IN (SELECT k FROM gone)) AS removed, (SELECT count(*) FROM changed WHERE lower(term) IN (SELECT lower(term) FROM stay)) AS modified,
  (SELECT count(*) FROM added) AS added, (SELECT count(*) FROM suggested) AS suggested
""")
def merge_log(spark, sf):
    prior, d = delta(spark, sf)
    return R.merge_log(prior, d["additions"], d["modifications"], d["removals"], d["suggested"])


@query(f"""
WITH {LOCATED_SQL} SELECT term, coalesce((SELECT string_agg(file || '@' || (file = 'd0/f0.md' AND c.ord % 4 = 0), ';' ORDER BY pos) FROM g WHERE g.term = c.term), '') AS places FROM c
""")
def remap_locations(spark, sf):
    old = F.array(F.struct(F.lit("d0/f0.md").alias("file"), (F.col("ord") % 4 == 0).alias("main"), F.lit("old").alias("context")), F.struct(F.lit("gone.md").alias("file"), F.lit(True).alias("main"), F.lit("").alias("context")))
    found = R.remap_locations(curated(spark, sf).withColumn("locations", old), candidate_rows(spark, sf))
    return found.select("term", F.array_join(F.transform("locations", lambda x: F.concat_ws("@", x["file"], x["main"].cast("string"))), ";").alias("places"))


@query(f"""
WITH c AS ({CURATED_SQL}), k AS (SELECT parent, string_agg(term, ', ' ORDER BY term) AS l FROM c WHERE parent IS NOT NULL GROUP BY parent)
SELECT c.term, c.term || ' | ' || coalesce(nullif(concat_ws(' | ', 'parent: ' || c.parent, 'children: ' || k.l, 'aliases: ' || replace(alias_list, ',', ', '), 'see_also: ' || replace(see_list, ',', ', ')), ''), '(top-level, no relationships)') AS line
FROM c LEFT JOIN k ON k.parent = c.term
""")
def compact_index(spark, sf):
    return R.compact_index(R.children(curated(spark, sf)))


@query(f"WITH v AS ({CANDIDATES_SQL}) SELECT term, term || ' | ' || printf('%.2f', CAST(score AS DOUBLE)) || ' | ' || string_agg(file, ', ' ORDER BY loc_ord) AS line FROM v GROUP BY term, score")
def compact_candidates(spark, sf):
    return R.compact_candidates(candidate_rows(spark, sf))


#: A log of model events, a turn of eight lines for each event; every third turn's result is cut off, every seventh has none.
LOG_SQL = """
SELECT CAST(user_id AS VARCHAR(20)) AS session, event_id * 10 + j AS seq, CASE
  WHEN j = 0 THEN concat('{"type":"stream_event","event":{"type":"message_start","message":{"usage":{"input_tokens":', event_id % 90, ',"cache_read_input_tokens":', event_id % 7, CASE WHEN event_id % 5 = 0 THEN ',"cache_creation_input_tokens":11' ELSE '' END, '}}}}')
  WHEN j = 1 THEN concat('{"type":"stream_event","event":{"type":"content_block_delta","delta":{"type":"thinking_delta","thinking":"hm', event_id, ' "}}}')
  WHEN j = 2 THEN CASE WHEN event_id % 7 = 0 THEN 'not json' ELSE concat('{"type":"stream_event","event":{"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":"{\\"', CASE WHEN event_id % 4 = 0 THEN 'names' ELSE 'terms' END, '\\": [{\\"term\\""}}}') END
  WHEN j = 3 THEN CASE WHEN event_id % 7 = 0 THEN '{"type":"system"}' ELSE concat('{"type":"stream_event","event":{"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":": \\"a', event_id, '\\"}]', CASE WHEN event_id % 3 = 0 THEN '' ELSE '}' END, '"}}}') END
  WHEN j = 4 THEN concat('{"type":"stream_event","event":{"type":"content_block_delta","delta":{"type":"text_delta","text":"t', event_id, ' "}}}')
  WHEN j = 5 THEN concat('{"type":"stream_event","event":{"type":"message_delta","usage":{"output_tokens":', event_id % 11, '},"delta":{"stop_reason":"tool_use"}}}')
  WHEN j = 6 THEN '{"type":"stream_event","event":{"type":"message_stop"}}' ELSE '{broken' END AS line
FROM events CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS v(j)
"""
TURNS_SQL = f"""
l AS ({LOG_SQL}), j AS (SELECT session, seq, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM l),
e AS (SELECT session, seq, j->>'$.event.type' AS kind, j->>'$.event.delta.thinking' AS thinking, j->>'$.event.delta.text' AS text, j->>'$.event.delta.partial_json' AS part FROM j WHERE j->>'$.type' = 'stream_event'),
n AS (SELECT *, sum(CASE WHEN kind = 'message_start' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS turn FROM e),
t AS (SELECT session, turn, coalesce(string_agg(part, '' ORDER BY seq), '') AS json, coalesce(string_agg(text, '' ORDER BY seq), '') AS text, coalesce(string_agg(thinking, '' ORDER BY seq), '') AS thinking FROM n GROUP BY session, turn),
g AS (SELECT *, CASE WHEN json_valid(json) THEN CASE WHEN json_extract(CAST(json AS JSON), '$.terms') IS NOT NULL THEN turn END END AS good FROM t)
"""


def log_lines(spark, sf, sql: str) -> DataFrame:
    """The lines that SQL makes of the events. A few bytes of an event become lines, so the events are dealt to all cores first."""
    K.spread(table(spark, sf, "events")).createOrReplaceTempView("events")
    return spark.sql(sql.replace("\\", "\\\\"))


def folded(spark, sf):
    log = log_lines(spark, sf, LOG_SQL)
    return E.fold_sessions(E.turns(E.parse_events(log)), "terms array<struct<term string>>", ["terms"])


@query(f"""
WITH {TURNS_SQL} SELECT session, CAST(max(turn) AS BIGINT) AS turns, CAST(max(good) AS BIGINT) AS last_valid_turn, arg_max(json, good) FILTER (good IS NOT NULL) AS output,
  string_agg(text, '' ORDER BY turn) AS text, string_agg(thinking, '' ORDER BY turn) AS thinking FROM g GROUP BY session
""")
def llm_event_fold(spark, sf):
    return folded(spark, sf).select("session", "turns", "last_valid_turn", "output", "text", "thinking")


@query(f"""
WITH {TURNS_SQL}, o AS (SELECT session, CAST(max(turn) AS BIGINT) AS turns, arg_max(json, good) FILTER (good IS NOT NULL) AS output, string_agg(text, '' ORDER BY turn) AS text FROM g GROUP BY session)
SELECT * FROM o
""")
def event_stream(spark, sf):
    """The same fold over the log as a stream of files, a state for each session."""
    from termloom.streaming.incremental import fold_events, read_log

    log = log_lines(spark, sf, LOG_SQL)
    folder, state, name = own_folder(spark, "log"), own_folder(spark, "state"), f"folded_{uuid.uuid4().hex}"
    whole = log.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("annotated"))
    files.write_annotated(whole.withColumn("file", F.concat("session", F.lit(".jsonl"))), folder)
    fold_events(read_log(spark, folder), ["terms"]).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("session", "turns", "output", "text")


#: A log whose turns give changes to terms; every third lacks what is removed, every fifth is cut off.
CHANGES_LOG_SQL = """
SELECT CAST(user_id AS VARCHAR(20)) AS session, event_id * 10 + j AS seq, CASE
  WHEN j = 0 THEN '{"type":"stream_event","event":{"type":"message_start"}}'
  WHEN j = 1 THEN concat('{"type":"stream_event","event":{"type":"content_block_delta","delta":{"partial_json":"{\\"additions\\": [{\\"term\\": \\"a', event_id, '\\"}], \\"modifications\\": []', CASE WHEN event_id % 3 = 0 THEN '' ELSE ', \\"removals\\": []' END, '"}}}')
  ELSE concat('{"type":"stream_event","event":{"type":"content_block_delta","delta":{"partial_json":"', CASE WHEN event_id % 5 = 0 THEN '' ELSE '}' END, '"}}}') END AS line
FROM events CROSS JOIN (VALUES (0), (1), (2)) AS v(j)
"""


@query(f"""
WITH l AS ({CHANGES_LOG_SQL}), j AS (SELECT session, seq, CAST(line AS JSON) AS j FROM l),
n AS (SELECT session, seq, j->>'$.event.delta.partial_json' AS part, sum(CASE WHEN j->>'$.event.type' = 'message_start' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS turn FROM j),
t AS (SELECT session, turn, coalesce(string_agg(part, '' ORDER BY seq), '') AS json FROM n GROUP BY session, turn),
g AS (SELECT *, CASE WHEN json_valid(json) THEN CASE WHEN json_extract(CAST(json AS JSON), '$.removals') IS NOT NULL THEN turn END END AS good FROM t)
SELECT session, CAST(max(turn) AS BIGINT) AS turns, CAST(max(good) AS BIGINT) AS last_valid_turn, arg_max(json, good) FILTER (good IS NOT NULL) AS output FROM g GROUP BY session
""")
def delta_event_fold(spark, sf):
    log = log_lines(spark, sf, CHANGES_LOG_SQL)
    shape = "additions array<struct<term string>>, modifications array<struct<term string>>, removals array<struct<term string>>"
    return E.fold_sessions(E.turns(E.parse_events(log)), shape, ["additions", "modifications", "removals"]).select("session", "turns", "last_valid_turn", "output")


@query(f"""
WITH l AS ({LOG_SQL}), j AS (SELECT session, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM l),
u AS (SELECT session, sum(coalesce(CAST(j->>'$.event.message.usage.input_tokens' AS BIGINT), 0)) AS i, sum(coalesce(CAST(j->>'$.event.usage.output_tokens' AS BIGINT), 0)) AS o,
  sum(coalesce(CAST(j->>'$.event.message.usage.cache_creation_input_tokens' AS BIGINT), 0)) AS w, sum(coalesce(CAST(j->>'$.event.message.usage.cache_read_input_tokens' AS BIGINT), 0)) AS r FROM j WHERE j->>'$.type' = 'stream_event' GROUP BY session)
SELECT session, m.model, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(w AS BIGINT) AS cache_write_tokens, CAST(r AS BIGINT) AS cache_read_tokens,
  round((i * m.pi + o * m.po + w * m.pw + r * m.pr) / 1e6, 9) AS cost
FROM u, (VALUES ('claude-opus', 15.0, 75.0, 18.75, 1.5), ('Sonnet-x', 3.0, 15.0, 3.75, 0.3), ('haiku', 0.8, 4.0, 1.0, 0.08), ('other', NULL, NULL, NULL, NULL)) AS m(model, pi, po, pw, pr)
""")
def token_usage_cost(spark, sf):
    rows = folded(spark, sf).withColumn("model", F.explode(F.array(*map(F.lit, ("claude-opus", "Sonnet-x", "haiku", "other")))))
    return rows.select("session", "model", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens", F.round(E.actual_cost("model"), 9).alias("cost"))


SPANS_SQL = "SELECT o_custkey AS file, o_orderkey % 97 AS s, o_orderkey % 97 + o_orderkey % 7 AS e FROM orders"


@query(f"""
WITH r AS ({SPANS_SQL}), m AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT file, min(s) AS s, max(e) AS e FROM n GROUP BY file, island
""")
def merge_ranges(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return I.merge_ranges(spark.sql(SPANS_SQL))


HALVES_SQL = r"""
p AS (SELECT doc_id, text, length(text) AS n, string_split(lower(text), 'tion') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM p),
h AS (SELECT doc_id, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) + 4 * (i - 1) AS s FROM u),
k AS (SELECT doc_id, s FROM h JOIN p USING (doc_id) WHERE i < len(l) AND (s + 4 <= n // 2 OR s >= n // 2) AND NOT regexp_matches(substring(text, CAST(s AS INTEGER) + 5, 2), '^\\.[A-Za-z]')),
m AS (SELECT doc_id, CAST(min(s) + 4 AS BIGINT) AS found FROM k GROUP BY doc_id)
"""


def halves(rows: DataFrame, text: str) -> DataFrame:
    """Ranges that cover each document: its two halves."""
    half = F.expr(f"cast(char_length({text}) div 2 as bigint)")
    of = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    return rows.withColumn("ranges", F.array(of(F.lit(0).cast("long"), half), of(half, F.char_length(text).cast("long"))))


@query(f"WITH {HALVES_SQL} SELECT doc_id, found FROM m")
def match_in_ranges(spark, sf):
    """The first hit in whole texts, within ranges that cover each document."""
    return H.first_in_ranges(halves(table(spark, sf, "documents"), "text"), "tion", "doc_id").where("found is not null")


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'tion') > 0 THEN CAST(strlen(substring(text, 1, strpos(lower(text), 'tion') + 3)) AS BIGINT) END AS after_bytes FROM documents")
def term_offsets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.byte_offset_after("text", F.lit("Tion")).alias("after_bytes"))


@query(f"WITH c AS ({CURATED_SQL}) SELECT term, CASE WHEN parent IS NULL THEN '#index[' || term || ']' ELSE '#index-main(\"' || parent || '\", \"' || term || '\")' END AS mark FROM c")
def markers(spark, sf):
    chain = F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent"))
    return curated(spark, sf).select("term", T.marker("term", chain, F.col("parent").isNotNull()).alias("mark"))


def render_terms(spark):
    place = lambda f, m=False: (f, m, "")
    rows = [("tion", "d", None, ["x"], [place("1"), place("2", True), place("3")]), ("an", "d", "tion", [], [place("1", True), place("9")]), ("nowhere-at-all", "d", None, ["the"], [place("1"), place("2")]), ("zzzz", "d", None, [], [place("3")])]
    return spark.createDataFrame(rows, f"term string, definition string, parent string, aliases array<string>, locations {R.LOCATIONS}")


def everywhere(spark, docs: DataFrame) -> DataFrame:
    """The terms to render, placed in every file that holds one of their forms besides the places they have.

    A row for each term and file, so that no list grows with the corpus.
    """
    terms = render_terms(spark)
    forms = terms.select("term", F.explode(F.concat(F.array("term"), F.col("aliases"))).alias("form")).withColumn("form", F.lower("form"))
    hits = C.locate(forms.select(F.col("form").alias("term")), docs.select("file", F.col("content").alias("prose")))
    found = hits.join(F.broadcast(forms), F.col("key") == F.col("form")).select("term", "file", F.lit(False).alias("main"))
    given = terms.select("term", F.explode("locations").alias("at")).select("term", "at.file", "at.main")
    places = found.unionByName(given).groupBy("term", "file").agg(F.max("main").alias("main"))
    at = F.array(F.struct("file", "main", F.lit("").alias("context"))).alias("locations")
    return places.join(F.broadcast(terms.drop("locations")), "term").select("term", "definition", "parent", "aliases", at)


def placed_everywhere(spark, docs: DataFrame) -> DataFrame:
    return N.place_terms(everywhere(spark, docs), docs)


def render_docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"), F.lit(None).cast("array<struct<s bigint, e bigint>>").alias("ranges"))


PLACED_SQL = """
d AS (SELECT CAST(doc_id AS VARCHAR) AS file, text, lower(text) AS low FROM documents),
t AS (SELECT * FROM (VALUES ('tion', ['tion', 'x'], ['1', '2', '3'], ['2']), ('an', ['an'], ['1', '9'], ['1']), ('nowhere-at-all', ['nowhere-at-all', 'the'], ['1', '2'], ['']), ('zzzz', ['zzzz'], ['3'], [''])) AS v(term, forms, given, mains)),
f AS (SELECT file, term, list_contains(mains, file) AS main, text, list_contains(given, file) AS given, list_filter(forms, lambda x: contains(low, x))[1] AS form, low FROM d, t),
p AS (SELECT file, term, main, form, CASE WHEN form IS NOT NULL THEN CAST(strlen(substring(text, 1, strpos(low, form) - 1 + length(form))) AS BIGINT) END AS off, text FROM f WHERE given OR form IS NOT NULL)
"""


@query(f"WITH {PLACED_SQL} SELECT file, term, main, off FROM p")
def placed_terms(spark, sf):
    """The terms wherever they stand, and where they were said to stand."""
    return placed_everywhere(spark, render_docs(spark, sf)).select("file", "term", "main", F.col("offset").alias("off"))


@query(f"WITH {PLACED_SQL} SELECT file, term, off FROM p WHERE main")
def placed_main_only(spark, sf):
    docs = render_docs(spark, sf)
    return N.place_terms(everywhere(spark, docs), docs, main_only=True).select("file", "term", F.col("offset").alias("off"))


MARKED_SQL = f"""
{PLACED_SQL}, q AS (SELECT file, off, term, CASE WHEN main THEN '#index-main' ELSE '#index' END || CASE WHEN term = 'an' THEN '("tion", "an")' ELSE '[' || term || ']' END AS mark FROM p WHERE off IS NOT NULL),
c AS (SELECT file, off, string_agg(mark, '' ORDER BY lower(term), term) AS marks, coalesce(lag(off) OVER (PARTITION BY file ORDER BY off), 0) AS before FROM q GROUP BY file, off),
e AS (SELECT file, max(off) AS last FROM c GROUP BY file)
"""


@query(f"""
WITH {MARKED_SQL}, b AS (SELECT file, off, before, marks, encode(text) AS data FROM c JOIN d USING (file)),
j AS (SELECT file, string_agg(decode(data[before + 1:off]) || marks, '' ORDER BY off) AS head FROM b GROUP BY file)
SELECT d.file, CASE WHEN j.head IS NULL THEN text ELSE CASE WHEN contains(text, 'in-dexter') THEN '' ELSE '#import "@preview/in-dexter:0.7.2": *' || chr(10) END || j.head || decode(encode(text)[e.last + 1:]) END AS annotated
FROM d LEFT JOIN j USING (file) LEFT JOIN e USING (file)
""")
def annotate(spark, sf):
    docs = render_docs(spark, sf)
    return N.annotate(docs, placed_everywhere(spark, docs))


@query(f"WITH {PLACED_SQL} SELECT count(DISTINCT file) FILTER (off IS NOT NULL) AS files, count(off) AS markers, count(*) FILTER (off IS NOT NULL AND main) AS main_markers, count(*) FILTER (off IS NULL) AS not_found FROM p")
def render_counters(spark, sf):
    return N.counters(placed_everywhere(spark, render_docs(spark, sf)))


@query(f"""
WITH RECURSIVE c AS ({CURATED_SQL}), g(path, depth, term, definition, see_list) AS (
  SELECT lower(term), 0, term, definition, see_list FROM c WHERE parent IS NULL UNION ALL SELECT g.path || '>' || lower(c.term), g.depth + 1, c.term, c.definition, c.see_list FROM g JOIN c ON c.parent = g.term)
SELECT path, CAST(depth AS INTEGER) AS depth, term, 'term-' || regexp_replace(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '-$', '') AS label,
  regexp_replace(definition, '([@#<$_*])', '\\\\\\1', 'g') || CASE WHEN see_list IS NULL THEN '' ELSE ' _See also: ' || array_to_string(list_transform(string_split(see_list, ','), lambda x: '#link(<term-' || regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g') || '>)[' || regexp_replace(x, '([@#<$_*])', '\\\\\\1', 'g') || ']'), ', ') || '_' END AS body
FROM g
""")
def glossary_entries(spark, sf):
    return N.glossary_entries(curated(spark, sf)).withColumn("path", F.array_join("path", ">"))


GLOSSARY_SQL = rf"""
WITH RECURSIVE c AS ({CURATED_SQL}), g(path, depth, term, definition, see_list) AS (
  SELECT [lower(term)], 0, term, definition, see_list FROM c WHERE parent IS NULL UNION ALL SELECT list_append(g.path, lower(c.term)), g.depth + 1, c.term, c.definition, c.see_list FROM g JOIN c ON c.parent = g.term),
n AS (SELECT *, coalesce(lead(depth) OVER (ORDER BY path), 0) AS next, regexp_replace(term, '([@#<$_*])', '\\\1', 'g') AS name, 'term-' || regexp_replace(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '-$', '') AS label,
  regexp_replace(definition, '([@#<$_*])', '\\\1', 'g') || CASE WHEN see_list IS NULL THEN '' ELSE ' _See also: ' || array_to_string(list_transform(string_split(see_list, ','), lambda x: '#link(<term-' || regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g') || '>)[' || regexp_replace(x, '([@#<$_*])', '\\\1', 'g') || ']'), ', ') || '_' END AS body FROM g),
e AS (SELECT path, repeat(' ', 2 + 4 * depth) || 'terms.item([' || name || ' <' || label || '>], [' || body || CASE WHEN next > depth THEN chr(10) || repeat(' ', 4 + 4 * depth) || '#terms(tight: true,' || chr(10)
  ELSE ']),' || chr(10) || array_to_string(list_transform(range(1, depth - next + 1), lambda k: repeat(' ', 4 + 4 * (depth - k)) || ')' || chr(10) || repeat(' ', 2 + 4 * (depth - k)) || ']),' || chr(10)), '') END AS line FROM n)
SELECT '// Generated by termloom' || chr(10) || chr(10) || '#terms(tight: false, spacing: 1em,' || chr(10) || string_agg(line, '' ORDER BY path) || ')' || chr(10) AS text FROM e
"""


@query(GLOSSARY_SQL)
def glossary_text(spark, sf):
    """The glossary as the renderer of its format writes it."""
    return spark.createDataFrame([(N.RENDERERS["typst"].glossary(curated(spark, sf), "1em"),)], "text string")


@query(f"WITH {LOCATED_SQL}, w AS (SELECT term FROM c UNION ALL SELECT r_name FROM region) SELECT term FROM w WHERE term NOT IN (SELECT term FROM g)")
def suggested_terms(spark, sf):
    """Terms that stand nowhere yet, once a model's output is put together."""
    made = R.post_process(curated(spark, sf), of_parts(spark, sf, SUGGESTED_SQL.replace("VARCHAR(99)", "STRING")), candidate_rows(spark, sf), known_rows(spark, sf), None)
    return V.without_places(made).select("term")


CHECKED_TERMS = [("thing unseen", []), ("qqq tions", []), ("ans", ["nope"]), ("the", []), ("nope", ["tion"])]
#: What each is tried as where it isn't found, and a file that isn't there.
_FORMS = {"thing unseen": ["unseen", "thing", "thing unseens"], "qqq tions": ["tions", "qqq", "qqq tion"], "ans": ["an"], "the": ["thes"], "nope": ["nopes"]}
_ROWS = ", ".join(f"('{t}', {[t, *a]!r}, {_FORMS[t]!r})" for t, a in CHECKED_TERMS)
CHECKED_SQL = f"""
d AS (SELECT CAST(doc_id AS VARCHAR) AS file, lower(text) AS low FROM documents), v AS (SELECT * FROM (VALUES {_ROWS}) AS v(term, names, forms)),
k AS (SELECT term, file, CASE WHEN low IS NULL THEN 'missing' WHEN len(list_filter(names, lambda x: contains(low, lower(x)))) > 0 THEN 'resolved' ELSE 'unresolved' END AS status, list_filter(forms, lambda x: contains(low, lower(x)))[1] AS first
      FROM (SELECT file, low FROM d UNION ALL SELECT 'gone', NULL), v),
c AS (SELECT term, file, status, CASE WHEN status = 'unresolved' THEN first END AS suggestion FROM k)
"""


def checked_terms(files: DataFrame) -> DataFrame:
    """A row for each of the terms and each file, which is its place."""
    terms = [F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, a)).cast("array<string>").alias("aliases")) for t, a in CHECKED_TERMS]
    at = F.array(F.struct("file", F.lit(False).alias("main"), F.lit("").alias("context"))).alias("locations")
    return files.withColumn("t", F.explode(F.array(*terms))).select("t.term", "t.aliases", at)


def checked(spark, sf):
    """Each term checked in every document, and in a file that isn't there; a row for each of them."""
    docs = render_docs(spark, sf)
    return V.check_locations(checked_terms(docs.select("file").unionByName(spark.createDataFrame([("gone",)], "file string"))), docs)


@query(f"WITH {CHECKED_SQL} SELECT count(*) AS checked, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status <> 'resolved') AS unresolved FROM c")
def validate_report(spark, sf):
    return V.report(checked(spark, sf))


@query(f"WITH {CHECKED_SQL} SELECT file, term, status, suggestion FROM c")
def validate_places(spark, sf):
    return checked(spark, sf).select("file", "term", "status", "suggestion")


@query(f"WITH {CHECKED_SQL} SELECT term, status, count(*) AS files FROM c WHERE file LIKE '%7' GROUP BY ALL")
def validate_by_extension(spark, sf):
    """Places in files of one extension alone; files are named so that their last digit is it."""
    docs = render_docs(spark, sf).withColumn("file", F.regexp_replace("file", "(.)$", "x.$1"))
    return V.check_locations(checked_terms(docs.select("file")), docs, ["7"]).groupBy("term", "status").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {HALVES_SQL} SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN found IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, CAST(strlen(substring(text, 1, found)) AS BIGINT) AS off FROM p LEFT JOIN m USING (doc_id)")
def in_prose_ranges(spark, sf):
    """A term checked and placed within ranges of every document."""
    docs = halves(render_docs(spark, sf), "content")
    at = F.array(F.struct("file", F.lit(False).alias("main"), F.lit("").alias("context")))
    terms = docs.select(F.lit("Tion").alias("term"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("parent"), at.alias("locations"))
    placed = N.place_terms(terms, docs).select("file", F.col("offset").alias("off"))
    return V.check_locations(terms, docs).select("file", "status").join(placed, "file")


@query(f"WITH {CHECKED_SQL} SELECT term, suggestion AS alias, min(file) AS file FROM c WHERE suggestion IS NOT NULL GROUP BY term, suggestion")
def alias_suggestions(spark, sf):
    return V.suggestions(checked(spark, sf))


def sources(spark, sf, ext: str) -> DataFrame:
    """Manuscripts put together around the documents' whole texts, whatever markup they hold."""
    start = F.coalesce("text", F.lit(""))
    md = F.concat(F.lit("---\ntitle: t\n---\n# Heading\n\n"), start, F.lit(" **bold** `code`\n\n- item\n\n```\nfenced\n```\n"))
    typ = F.concat(F.lit("= Heading <lab>\n\n"), start, F.lit(" *bold* $x^2$ @ref `raw`\n#block[inside]\n// note\n"))
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.lit(ext).alias("ext"), (typ if ext == "typ" else md).alias("content"))


@query()
def markdown_prose(spark, sf):
    from termloom.sources.files import with_prose

    return with_prose(sources(spark, sf, "md")).select("file", "prose")


@query()
def typst_prose(spark, sf):
    from termloom.sources.files import with_prose

    return with_prose(sources(spark, sf, "typ")).select("file", "prose", F.to_json("ranges").alias("ranges"))


PLAIN_SQL = r"""
t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[^\p{L} ]', '', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
"""


def plain_lines(spark, sf) -> DataFrame:
    """Every document's lines without anything but letters and single spaces."""
    line = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L} ]", ""), " +", " "))
    lines = F.filter(F.transform(F.split("text", "\n"), line), lambda x: x != "")
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), lines.alias("l"))


@query(f"WITH {PLAIN_SQL} SELECT CAST(doc_id AS VARCHAR) AS file, array_to_string(list_concat(l, ['last bold   end']), chr(10)) AS prose FROM t")
def markdown_plain(spark, sf):
    """Manuscripts whose prose SQL can tell: paragraphs of plain words between markup that isn't prose."""
    from termloom.sources.files import with_prose

    md = F.concat(F.lit("---\ntitle: t\n---\n# Heading\n\n"), F.array_join(F.concat("l", F.array(F.lit("last **bold** `code` end"))), "\n\n"), F.lit("\n\n```\nfenced\n```\n"))
    return with_prose(plain_lines(spark, sf).select("file", F.lit("md").alias("ext"), md.alias("content"))).select("file", "prose")


@query(f"WITH {PLAIN_SQL} SELECT CAST(doc_id AS VARCHAR) AS file, array_to_string(list_concat(l, ['last bold end']), chr(10)) AS prose FROM t")
def typst_plain(spark, sf):
    from termloom.sources.files import with_prose

    typ = F.concat(F.lit("= Heading <lab>\n\n"), F.array_join(F.concat("l", F.array(F.lit("last *bold* $x^2$ `raw` end"))), "\n\n"), F.lit("\n\n```\nfenced\n```\n"))
    return with_prose(plain_lines(spark, sf).select("file", F.lit("typ").alias("ext"), typ.alias("content"))).select("file", "prose")


@query("""
WITH f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'd' || doc_id % 7 || '/' END || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS file, text FROM documents)
SELECT file, text AS content, CAST(row_number() OVER (ORDER BY string_split(file, '/')) AS INTEGER) AS place FROM f WHERE file LIKE '%.md' AND file <> '0.md'
""")
def source_tree(spark, sf):
    """Every document written as a file of a tree and read again: kinds, an excluded name, order of paths."""
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"))), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt"))
    folder = own_folder(spark, "tree")
    files.write_annotated(table(spark, sf, "documents").select(name.alias("file"), F.col("text").alias("annotated")), folder)
    read = files.read_documents(spark, folder, ["md"], ["0.md"])
    return read.select("file", "content").join(files.numbered(files.listed(spark, folder, ["md"], ["0.md"])), "file")


def own_folder(spark, name: str) -> str:
    """A fresh folder for files, below the one that driver and executors share."""
    path = f"{scratch_dir(spark).removeprefix('file:')}/termloom/{uuid.uuid4().hex}/{name}"
    os.makedirs(path)
    return path


@query(f"WITH v AS ({CANDIDATES_SQL}) SELECT term, score, string_agg(file || '@' || context, ';' ORDER BY loc_ord) AS places FROM v GROUP BY term, score")
def candidates_table(spark, sf):
    """Candidates written as JSON and read again."""
    path = f"{own_folder(spark, 'tables')}/candidates.json"
    files.write_table(candidate_rows(spark, sf).drop("key"), path, "candidates", version=1)
    return files.read_candidates(spark, path).select("term", "score", shown_places().alias("places"))


@query(f"WITH {LOCATED_SQL} SELECT term, definition, parent, coalesce(alias_list, '') AS aliases, coalesce((SELECT string_agg(file || '@' || context, ';' ORDER BY pos) FROM g WHERE g.term = c.term), '') AS places FROM c")
def terms_table(spark, sf):
    """Curated terms written as YAML and read again."""
    path = f"{own_folder(spark, 'tables')}/terms.yaml"
    found = R.gather_locations(R.main_flags(R.curated_locations(curated(spark, sf), candidate_rows(spark, sf)), curated(spark, sf)))
    files.write_table(curated(spark, sf).drop("ord", "main_files").join(found, "term", "left"), path, "terms", version=1)
    return files.read_terms(spark, path).select("term", "definition", "parent", F.array_join("aliases", ",").alias("aliases"), shown_places().alias("places"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '---' || chr(10) || 'a: b' || chr(10) || text ELSE text END AS body FROM documents")
def frontmatter(spark, sf):
    head = F.when(F.col("doc_id") % 3 == 0, "---\na: b\n---\n").when(F.col("doc_id") % 3 == 1, " \n---\n---\n").otherwise("---\na: b\n")
    return table(spark, sf, "documents").select("doc_id", T.strip_frontmatter(F.concat(head, "text")).alias("body"))


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN ends_with(x, 's') THEN x[:-2] ELSE x || 's' END), ' ') AS toggled FROM w
""")
def plural_toggle(spark, sf):
    """Every word of every text, its plural toggled."""
    words = F.filter(F.split("text", " ", -1), lambda w: w != "")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(words, T.toggle_plural), " ").alias("toggled"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def timestamps(spark, sf):
    return table(spark, sf, "events").select("event_id", T.timestamp_text("ts").alias("stamp"))


@query("SELECT o_orderkey AS id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size FROM (SELECT o_orderkey, o_orderkey * 7 AS n FROM orders)")
def human_sizes(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.human_size(F.col("o_orderkey") * 7).alias("size"))


@query("SELECT n_name AS path, n_name = 'FRANCE' OR ends_with('docs/' || n_name, '/FRANCE') AS hit FROM nation")
def path_suffixes(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("path"), T.path_ends_with(F.concat(F.lit("docs/"), "n_name"), F.lit("FRANCE")).alias("hit"))


@query("SELECT p_partkey AS id, 'term-' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-$', '') AS label, regexp_replace(p_name, '([@#<$_*])', '\\\\\\1', 'g') AS escaped FROM part")
def labels_and_escapes(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.term_label("p_name").alias("label"), T.escape_markup("p_name").alias("escaped"))


CURATED_KEPT = 60


@query(f"""
WITH {LOCATED_SQL}, n AS (SELECT term, count(*) AS places FROM g GROUP BY term), w AS (SELECT term FROM c UNION ALL SELECT r_name FROM region)
SELECT term, CAST(coalesce(places, 0) AS INTEGER) AS places FROM w LEFT JOIN n USING (term) ORDER BY lower(term), term LIMIT {CURATED_KEPT}
""")
def curate_full(spark, sf):
    """Post-processing as a whole; the first terms by alphabet are kept."""
    made = R.post_process(curated(spark, sf), of_parts(spark, sf, SUGGESTED_SQL.replace("VARCHAR(99)", "STRING")), candidate_rows(spark, sf), known_rows(spark, sf), CURATED_KEPT)
    return made.select("term", F.size("locations").alias("places"))


@query(f"""
WITH {MERGED_SQL}, p AS (SELECT term, CASE WHEN parent IN (SELECT term FROM merged) THEN parent END AS parent FROM merged)
SELECT p.term, p.parent, coalesce((SELECT string_agg(x.term, ',' ORDER BY x.term) FROM p x WHERE x.parent = p.term), '') AS children FROM p ORDER BY lower(p.term), p.term LIMIT {CURATED_KEPT}
""")
def curate_incremental(spark, sf):
    """A delta merged, places mapped anew, children rebuilt, missing parents dropped; the first terms by alphabet are kept."""
    prior, d = delta(spark, sf)
    return R.incremental(prior, candidate_rows(spark, sf), d, CURATED_KEPT).select("term", "parent", F.array_join("children", ",").alias("children"))
