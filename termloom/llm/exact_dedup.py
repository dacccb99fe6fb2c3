"""Exact duplicates, by DataFrame operations alone.

Equal digests only nominate: rows count as copies when their whole normalised texts are equal. Copies
merge within each task first, then in groups of (digest, salt), then the salts' winners merge by
digest; each of these compares the full text. Texts whose digest no other row has are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ascii_lower, discard, materialise

#: Parts that a group of equal digests is dealt to before its winners meet.
SALTS = 32
#: Most row ids that are broadcast to pick the texts to compare (8 bytes each); more ids are joined by a shuffle.
IDS_BROADCAST = 1_000_000


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest (SHA-256, binary).

    ``normalise`` maps the text column to what is compared. Of equal texts the row with the largest id
    stays. A null text counts as empty, so null and empty rows form one group. Rows that repeat both id
    and text count in group_size and share one verdict. Other columns are neither read nor returned.
    A null id loses to any other; where a group has null ids alone, keep_id is null and the rows stay.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    norm: Column = normalise(F.col("text"))
    hashed = materialise(rows.select("id", F.unhex(F.sha2(norm, 256)).alias("digest")), "digests")

    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    counts = hashed.groupBy("digest", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.sum("n").alias("n"))
    repeated = materialise(counts.where("n > 1").select("digest"), "repeated")
    ids = materialise(hashed.join(repeated, "digest", "left_semi").select("id"), "ids")
    picked = F.broadcast(ids.distinct()) if ids.count() <= IDS_BROADCAST else ids.distinct()
    texts = rows.join(picked, rows["id"].eqNullSafe(picked["id"]), "left_semi").select("id", norm.alias("norm"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("norm", 256)))

    # The partial aggregate is the local merge; its key is the whole text, as at each later stage.
    winner = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    merge = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]

    def by_text(part: DataFrame) -> DataFrame:
        return part.groupBy("digest", "norm", salt.alias("salt")).agg(*winner).groupBy("digest", "norm").agg(*merge)

    classes = materialise(by_text(texts).drop("norm"), "classes")

    # A digest of one class stands for its text, as all its texts were found equal. Should two texts ever
    # share a digest, their rows are told apart by the text.
    per_digest = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    found = hashed.join(per_digest.where("n = 1").drop("n"), "digest", "left")
    clashing = materialise(per_digest.where("n > 1").select("digest"), "clashing")
    if not clashing.isEmpty():
        shared = texts.join(clashing, "digest", "left_semi")
        told = shared.join(by_text(shared), ["digest", "norm"])
        rest = found.join(clashing, "digest", "left_anti")
        found = rest.unionByName(told.select(*rest.columns))
    else:
        discard(repeated, ids, clashing)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Ids should be unique: rows of one id share a verdict, and go only where none of them stays. Rows of null id stay.
    """
    verdicts = exact_dedup(docs, id_col=id_col, text_col=text_col).groupBy(F.col(id_col).alias("lost_id")).agg(F.max("kept").alias("kept"))
    lost = materialise(verdicts.where("not kept").select("lost_id"), "lost")
    lost = F.broadcast(lost) if lost.count() <= IDS_BROADCAST else lost
    return docs.join(lost, docs[id_col] == lost["lost_id"], "left_anti")
