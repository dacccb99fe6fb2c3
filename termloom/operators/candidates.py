"""From scored keywords to candidates: places, merging, known terms, filters, top-k.

A candidate is a row (key, score, term, locations); locations is an ordered array of (file, context).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.batches import batch_of, map_arrow
from termloom.config import STOP_WORDS, ExcludeConfig, ExtractConfig, KnownTerm
from termloom.functions.text import WINDOW, fold
from termloom.operators.keywords import YAKE_BYTES, spread, tfidf, yake_all
from termloom.operators.search import Finder, folded
from termloom.scratch import materialise

#: Most bytes of the terms that are looked for at once; the automaton over them is held by each Python worker.
TERMS_LIMIT = 32 << 20


def snippet(text: str, at: int, size: int, window: int = WINDOW) -> str:
    """The text around a hit; see functions.text.context."""
    start, end = max(0, at - window), min(len(text), at + size + window)
    cut = text[start:end]
    if start > 0:
        moved = re.sub(r"\A\S*\s+(?=\S)", "", cut)
        cut = moved
    return cut.strip()


def locate(terms: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns key, file, context: where each term (column term) stands in the documents, case-insensitively.

    A term may be part of a word. One automaton over all terms reads each document once, so the work
    doesn't grow with terms times documents. Terms are few (a top-k); their size is checked before they are
    collected.
    """
    wanted = terms.select(fold("term").alias("term")).where("term != ''").distinct()
    size = wanted.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size > TERMS_LIMIT:
        raise ValueError(f"{size} bytes of terms to locate; the limit is {TERMS_LIMIT}")
    shared = docs.sparkSession.sparkContext.broadcast(Finder(r.term for r in wanted.collect()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for file, prose in zip(batch.column("file").to_pylist(), batch.column("prose").to_pylist(), strict=True):
            rows += [(t, file, snippet(prose, s, e - s, window)) for t, (s, e) in shared.value.first(prose).items()]
        return batch_of(pa.schema([("key", pa.string()), ("file", pa.string()), ("context", pa.string())]), rows)

    return map_arrow(spread(docs.select("file", "prose")), "key string, file string, context string", run)


def path_order(file: Column | str) -> Column:
    """Sorts paths as a depth-first walk with sorted names does."""
    return F.split(F.col(file) if isinstance(file, str) else file, "/")


def trimmed(phrase: str, stop: set[str]) -> str:
    """A phrase without stop words at its ends; see functions.text.trim_stopwords."""
    parts = phrase.split(" ")
    useful = [i for i, w in enumerate(parts) if w.lower() not in stop]
    return phrase if len(parts) <= 1 or not useful else " ".join(parts[useful[0] : useful[-1] + 1])


def yake_candidates(docs: DataFrame, config: ExtractConfig, stop_words=STOP_WORDS) -> DataFrame:
    """Rows (key, file, rank, term, score, context) of every document's keywords, trimmed of stop words.

    The context is taken while the text is at hand; a keyword that doesn't stand in it as such has an empty one.
    """
    stop, most, least, longest = set(stop_words), config.max_candidates, config.min_score, config.ngram_range[1]

    schema = pa.schema([("key", pa.string()), ("file", pa.string()), ("rank", pa.int64()), ("term", pa.string()), ("score", pa.float64()), ("context", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts = [], batch.column("prose").to_pylist()
        for file, prose, ranked in zip(batch.column("file").to_pylist(), texts, yake_all(texts, longest, most), strict=True):
            low, origin = folded(prose or "")
            for rank, (t, score) in enumerate(ranked):
                if score >= least and (term := trimmed(t, stop)):
                    key = term.lower()
                    rows.append((key, file, rank, term, score, context_of(prose, low, origin, key)))
        return batch_of(schema, rows)

    return map_arrow(spread(docs.select("file", "prose")), "key string, file string, rank long, term string, score double, context string", run, YAKE_BYTES)


def context_of(text: str, low: str, origin: list[int] | None, form: str) -> str:
    """The text around a form's first hit; empty without one. ``low`` and ``origin`` are the text folded."""
    at = low.find(form)
    if at < 0:
        return ""
    start, end = (at, at + len(form)) if origin is None else (origin[at], origin[at + len(form) - 1] + 1)
    return snippet(text, start, end - start)


def merged_scores(yake: DataFrame, tf_idf: DataFrame) -> DataFrame:
    """Columns key, score, term: the largest score of either scorer; as display form the best YAKE row's, else the term.

    ``yake``: key, file, rank, term, score. ``tf_idf``: term, score.
    """
    y = yake.groupBy("key").agg(F.max("score").alias("y_score"), F.min_by("term", F.struct(-F.col("score"), path_order("file"), "rank")).alias("y_term"))
    t = tf_idf.select(fold("term").alias("key"), F.col("term").alias("t_term"), F.col("score").alias("t_score"))
    return y.join(t, "key", "full").select("key", F.greatest("y_score", "t_score").alias("score"), F.coalesce("y_term", "t_term").alias("term"))


def merged_places(yake: DataFrame, places: DataFrame) -> DataFrame:
    """Columns key, step, o, rank, file, context: YAKE's places (step 0), then TF-IDF's (step 1), in their orders."""
    y = yake.select("key", F.lit(0).alias("step"), path_order("file").alias("o"), "rank", "file", "context")
    t = places.select("key", F.lit(1).alias("step"), path_order("file").alias("o"), F.lit(0).cast("long").alias("rank"), "file", "context")
    return y.unionByName(t)


def merge_scored(yake: DataFrame, tf_idf: DataFrame, places: DataFrame) -> DataFrame:
    """Candidates of both scorers by key: scores as of merged_scores, places gathered.

    YAKE places come first and aren't merged; TF-IDF ones follow unless the pair of file and context is there.
    Gathers every candidate's places, so it is for bounded inputs; ``extract`` gathers after its filters.
    """
    scores = merged_scores(yake, tf_idf).withColumn("into", F.col("key"))
    return gather(scores, merged_places(yake, places)).select("key", "score", "term", "locations")


def gather(members: DataFrame, places: DataFrame) -> DataFrame:
    """Columns key, score, term, locations. ``members``: into (the candidate), key (of its places), score, term; those of a
    known term have also known, a name. ``places``: as of merged_places, with the members' keys.

    Members of a known term come by score, then key, and give it their first place per file.
    """
    known = F.col("known") if "known" in members.columns else F.lit(None).cast("string")
    named = members.withColumn("known", known)
    heads = named.groupBy("into").agg(F.max("score").alias("score"), F.coalesce(F.max("known"), F.max("term")).alias("term"))
    at = named.select("into", "key", "known", (-F.col("score")).alias("first")).join(places, "key")
    ones = at.where("known is null").select("into", "key", "step", "o", "rank", "file", "context")
    # of a file's TF-IDF place and YAKE's place with the same context, YAKE's stays
    twice = ones.where("step = 0").select("into", "file", "context").distinct()
    fresh = ones.where("step = 1").join(twice, ["into", "file", "context"], "left_anti")
    ones = ones.where("step = 0").unionByName(fresh).select("into", F.struct(F.lit(0.0).alias("first"), "key", "step", "o", "rank").alias("order"), "file", "context")
    order = F.struct("first", "key", "step", "o", "rank")
    of_known = at.where("known is not null").groupBy("into", "file").agg(F.min(F.struct(order.alias("order"), "context")).alias("best")).select("into", "best.order", "file", "best.context")
    packed = F.array_sort(F.collect_list(F.struct("order", "file", "context")))
    lists = ones.unionByName(of_known).groupBy("into").agg(F.transform(packed, lambda x: F.struct(x["file"].alias("file"), x["context"].alias("context"))).alias("locations"))
    none = F.filter(F.array(F.struct(F.lit("").alias("file"), F.lit("").alias("context"))), lambda x: F.lit(False))
    return heads.join(lists, "into", "left").select(F.col("into").alias("key"), "score", "term", F.coalesce("locations", none).alias("locations"))


def known_as(key: Column | str, known: list[KnownTerm]) -> Column:
    """The name of the known term that a key ends up in; null: of none.

    Entries apply in order, and a later one may take up what an earlier one made; so the key goes through all
    entries, within its row.
    """
    key = F.col(key) if isinstance(key, str) else key
    if not known:
        return F.lit(None).cast("string")
    entries = F.array(*(F.struct(F.lit(k.term).alias("name"), F.array(*(F.lit(x.lower()) for x in (k.term, *k.variants))).alias("forms")) for k in known))
    start = F.struct(key.alias("key"), F.lit(None).cast("string").alias("name"))
    taken = lambda now, e: F.exists(e["forms"], lambda x: F.contains(now["key"], x))
    step = lambda now, e: F.struct(F.when(taken(now, e), F.lower(e["name"])).otherwise(now["key"]).alias("key"), F.when(taken(now, e), e["name"]).otherwise(now["name"]).alias("name"))
    return F.aggregate(entries, start, step)["name"]


def members_of(scores: DataFrame, known: list[KnownTerm]) -> DataFrame:
    """``scores`` (key, score, term) with known (null: none) and into, the key of the candidate that each ends up in."""
    return scores.withColumn("known", known_as("key", known)).withColumn("into", F.coalesce(F.lower("known"), F.col("key")))


def consolidate(candidates: DataFrame, known: list[KnownTerm]) -> DataFrame:
    """Candidates whose key holds a form of a known term become that term: best score, first place per file.

    Candidates are absorbed by score, then key, in one pass whatever the number of entries; see known_as.
    """
    rows = members_of(candidates, known)
    plain = rows.where("known is null").select("key", "score", "term", "locations")
    places = rows.where("known is not null").select("into", "known", "score", "key", F.posexplode_outer("locations").alias("pos", "at"))
    heads = places.groupBy("into").agg(F.max("score").alias("score"), F.max("known").alias("term"))
    order = F.struct((-F.col("score")).alias("first"), "key", "pos")
    firsts = places.where("at is not null").groupBy("into", F.col("at.file").alias("file")).agg(F.min(F.struct(order.alias("order"), F.col("at.context").alias("context"))).alias("best"))
    packed = F.array_sort(F.collect_list(F.struct("best.order", "file", F.col("best.context").alias("context"))))
    lists = firsts.groupBy("into").agg(F.transform(packed, lambda x: F.struct(x["file"].alias("file"), x["context"].alias("context"))).alias("locations"))
    none = F.filter(F.array(F.struct(F.lit("").alias("file"), F.lit("").alias("context"))), lambda x: F.lit(False))
    made = heads.join(lists, "into", "left").select(F.col("into").alias("key"), "score", "term", F.coalesce("locations", none).alias("locations"))
    return plain.unionByName(made)


def document_share(candidates: DataFrame, documents: int, max_doc_pct: float) -> DataFrame:
    """Without the candidates that stand in more than ``max_doc_pct`` of the documents; 1 or more turns it off."""
    if max_doc_pct >= 1.0 or documents == 0:
        return candidates
    files = F.size(F.array_distinct(F.transform("locations", lambda x: x["file"])))
    return candidates.where(files / F.lit(float(documents)) <= max_doc_pct)


def usable_patterns(patterns: list[str]) -> list[str]:
    """Patterns that compile; the others are skipped."""
    found = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        found.append(p)
    return found


def excluded(term: Column | str, config: ExcludeConfig) -> Column:
    """Whether a display term is to be left out: it contains, equals or matches one of the terms given."""
    term = F.col(term) if isinstance(term, str) else term
    loose = config.case == "insensitive"
    hit = F.lit(False)
    if config.match == "regex":
        for p in usable_patterns(config.terms):
            hit = hit | term.rlike(f"(?i){p}" if loose else p)
        return hit
    shown = fold(term) if loose else term
    for t in config.terms:
        t = F.lit(t.lower() if loose else t)
        hit = hit | (F.contains(shown, t) if config.match == "contains" else shown == t)
    return hit


def final_candidates(candidates: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` candidates, in order of their lower-case terms. Equal scores go by key."""
    best = candidates.orderBy(F.desc("score"), "key").limit(limit)
    return best.orderBy(fold("term"), "term")


def extract(docs: DataFrame, config: ExtractConfig | None = None, stop_words=STOP_WORDS) -> DataFrame:
    """Candidates of a corpus (file, prose): both scorers, known terms, filters and top-k, in this order.

    Documents without prose are left out first. The result has term, score, locations. Places stay rows until the
    filters have chosen the candidates, so that no list of a term that is everywhere is ever made.
    """
    config = config or ExtractConfig()
    docs = docs.where(F.coalesce(F.col("prose"), F.lit("")) != "").select("file", "prose")
    number = docs.count()
    yake = materialise(yake_candidates(docs, config, stop_words), "yake")
    best = materialise(tfidf(docs, config.max_candidates, stop_words).where(F.col("score") >= config.min_score).select("term", "score"), "tf_idf")
    places = merged_places(yake, materialise(locate(best, docs), "places"))
    members = materialise(members_of(merged_scores(yake, best), config.known_terms), "members")  # read three times
    heads = members.groupBy("into").agg(F.max("score").alias("score"), F.coalesce(F.max("known"), F.max("term")).alias("term"))
    if config.max_doc_pct < 1.0 and number:
        files = members.select("into", "key").join(places.select("key", "file").distinct(), "key").groupBy("into").agg(F.count_distinct("file").alias("files"))
        heads = heads.join(files, "into", "left").where(F.coalesce("files", F.lit(0)) / F.lit(float(number)) <= config.max_doc_pct)
    chosen = heads.where(~excluded("term", config.exclude)).orderBy(F.desc("score"), "into").limit(config.max_candidates).select("into")
    found = gather(members.join(F.broadcast(chosen), "into", "left_semi"), places)  # max_candidates rows at most
    return final_candidates(found, config.max_candidates).select("term", "score", "locations")
