"""The pipeline's stages: each takes (spark, docs, sf_dir) and gives the rows that the next one works on.

``docs`` has doc_id, text, lang and source, and any other columns, of whatever names. All stages but the last
give the columns of their input. An empty table passes all of them. Ids should be unique; what a stage does
with null texts, null ids, ties and repeated rows stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from termloom.llm.common import discard, materialise

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Most ids of rows to drop that are broadcast.
IDS_BROADCAST = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that is learned, go; null and empty texts among them.

    Learned from all rows of a language that aren't held out. A text is of no such language where the model has met
    less of it than of almost all held-out texts of a learned language (see least_familiar; all of them are looked at). Where no row has a language, letters suffice.
    Each row is judged by its text alone, repeated rows alike, whatever its id. Rows that go are known by id and hash
    of the text, so that texts are read twice, but go through no Python worker.
    """
    out = language_id.held_out("doc_id", 4, 2)
    model = language_id.fit(docs.where(~out), whole=True)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = out & F.col("lang").cast("string").isin(model.languages)
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), known.alias("known"), "text")
    found = materialise(language_id.predict(rows, model, familiar="familiar", keep=["id", "mark", "known"]), "found")
    least = language_id.least_familiar(found.where(F.col("known") & (F.col("lang_pred") != language_id.UNKNOWN)))
    gone = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("familiar") < least)
    lost = materialise(found.where(gone).select("id", "mark").distinct(), "lost")
    discard(found)
    lost = F.broadcast(lost) if lost.count() <= IDS_BROADCAST else lost
    same = docs["doc_id"].eqNullSafe(lost["id"]) & (F.xxhash64(docs["text"]) == lost["mark"])
    return docs.join(lost, same, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest id stays; null counts as empty.

    Rows that repeat id and text stay or go together, as do all rows of an id: they go where none of them stays.
    Rows of null id stay.
    """
    return exact_dedup.drop_copies(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    Null texts and texts without words are near nothing and stay, as do rows of null id. Rows of an id stay or go
    together: they go where none of them stays.
    """
    verdicts = near_dedup.near_dedup(docs).groupBy(F.col("doc_id").alias("lost_id")).agg(F.max("kept").alias("kept"))
    lost = materialise(verdicts.where("not kept").select("lost_id"), "lost")
    lost = F.broadcast(lost) if lost.count() <= IDS_BROADCAST else lost
    return docs.join(lost, docs["doc_id"] == lost["lost_id"], "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: a row for each time, none for none.

    A null source is a source. Texts without words add nothing to any source; they come as often as the rest of
    their bucket does. Rows that repeat id and text are taken equally often.
    """
    return mixing.mixed_documents(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: doc_id, lang, source, its number of tokens, digests of their ids and of what they decode to.

    A null text counts as empty: no tokens. Repeated rows are encoded each.
    """
    done = bpe.encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded="decoded")
    return done.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
