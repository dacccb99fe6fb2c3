"""Language by words first: known words score by their log frequency per language; an unseen word falls
back to its character n-grams, the longest size of which any is known.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import broadcast_value, discard, map_arrow, materialise, with_fields

#: Labelled documents of each language that the model is learned from at most, unless all are asked for: those of the smallest seeded hash.
SAMPLE_DOCS = 5_000
#: Words, and n-grams of each size, that the model keeps of each language, about: those seen most often there.
#: A word beyond is scored by its n-grams, an n-gram beyond by shorter ones, as unseen ones are.
WORDS_KEPT = 20_000
GRAMS_KEPT = 10_000
SIZES = (4, 3, 2, 1)
#: What each step back to shorter n-grams leaves of a word's say.
BACKOFF = 0.6
#: Most bytes of a model, which is collected and broadcast; a larger one is an error before it is collected.
MODEL_LIMIT = 256 << 20
#: Most ids of sampled rows that are broadcast.
IDS_BROADCAST = 1_000_000
#: Text that is counted at once; of words, a thirty-second part, as each has many n-grams.
COUNTED_BYTES = 2 << 20
#: Words whose scores a worker remembers.
SEEN = 60_000
UNKNOWN = "und"
NO_LETTERS = r"[^\p{L}]+"


def grams(word: str, size: int) -> list[str]:
    """N-grams of a word between boundary marks."""
    marked = f"<{word}>" if size > 1 else word
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


class Model:
    """Scores of words and n-grams: per language, log frequency less the languages' mean.

    ``tables``: by size (0: word), the row of ``scores`` of each word or n-gram. A worker holds one model, however
    many passes use it, and remembers the scores of up to SEEN words.
    """

    def __init__(self, counts: pa.Table, languages: list[str]):
        """``counts``: size (0: word), gram, lang, n; one row for each of them."""
        self.languages = languages
        self.tables: dict[int, dict[str, int]] = {}
        scored, first = [np.zeros((0, len(languages)), np.float32)], 0
        for size in sorted(pc.unique(counts["size"]).to_pylist()):
            part = counts.filter(pc.equal(counts["size"], size)).sort_by([("gram", "ascending"), ("lang", "ascending")]).combine_chunks()
            encoded = pc.dictionary_encode(part["gram"].combine_chunks())
            matrix = np.zeros((len(encoded.dictionary), len(languages)))
            at = pc.index_in(part["lang"], pa.array(languages, part["lang"].type)).to_numpy()
            np.add.at(matrix, (encoded.indices.to_numpy(), at), part["n"].to_numpy())
            self.tables[size] = {gram: first + i for i, gram in enumerate(encoded.dictionary.to_pylist())}
            scored.append(self._scored(matrix))
            first += len(matrix)
        self.scores = np.concatenate(scored)
        self._fresh()

    def _fresh(self) -> None:
        self.seen: dict[str, int] = {}
        self.known = np.zeros((0, len(self.languages) + 1), np.float32)
        self.own = None

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("languages", "tables", "scores")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._fresh()

    def shared(self, spark: SparkSession):
        """The model, broadcast once (size checked)."""
        if self.own is None:
            self.own = broadcast_value(spark, self, MODEL_LIMIT, check_size(sum(map(len, self.tables.values())), len(self.languages)))
        return self.own

    @staticmethod
    def _scored(matrix: np.ndarray) -> np.ndarray:
        share = np.log((matrix + 0.5) / (matrix.sum(0) + 0.5 * len(matrix)))
        return (share - share.mean(1, keepdims=True)).astype(np.float32)

    def word(self, word: str) -> np.ndarray:
        return self._look(word)[:-1]

    def _look(self, word: str) -> np.ndarray:
        """A word's scores, and how far the model has met it: 1, or the share of its longest n-grams that are known."""
        if (at := self.seen.get(word)) is not None:
            return self.known[at]
        if not len(self.known):
            self.known = np.zeros((SEEN, len(self.languages) + 1), np.float32)
        if len(self.seen) >= SEEN:
            self.seen.clear()
        at = self.seen[word] = len(self.seen)
        self.known[at, :-1], self.known[at, -1] = self._scores(word)
        return self.known[at]

    def _scores(self, word: str) -> tuple[np.ndarray | float, float]:
        if (row := self.tables.get(0, {}).get(word)) is not None:
            return self.scores[row], 1.0
        weight, met = BACKOFF, None
        for size in SIZES:
            table, own = self.tables.get(size, {}), grams(word, size)
            rows = [table[g] for g in own if g in table]
            if met is None and own:
                met = len(rows) / len(own)
            if rows:
                return weight * self.scores[rows].mean(0), met
            weight *= BACKOFF
        return 0.0, 0.0

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float], list[float]]:
        """Language, score and familiarity of each text: the distinct words of the batch are scored once."""
        low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
        split = pc.split_pattern_regex(low, NO_LETTERS)
        starts = split.offsets.to_numpy()
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        width = len(self.languages) + 1
        vectors = np.zeros((len(words), width), np.float32)
        for i, w in enumerate(words):
            if w:
                vectors[i] = self._look(w)
        letters = np.array([bool(w) for w in words], np.int64)
        at = flat.indices.to_numpy()
        sums = np.zeros((len(texts), width))
        counts = np.zeros(len(texts), np.int64)
        for i, (a, b) in enumerate(zip(starts[:-1] - starts[0], starts[1:] - starts[0], strict=True)):
            sums[i] = vectors[at[a:b]].sum(0, dtype=np.float64)
            counts[i] = letters[at[a:b]].sum()
        names, scores, familiar = [], [], []
        for (*total, met), n in zip(sums, counts.tolist(), strict=True):
            if not n or not self.languages:
                names.append(UNKNOWN), scores.append(0.0), familiar.append(0.0)
                continue
            total = np.array(total)
            best = int(total.argmax())
            # a word's say shrinks with their number, as neighbouring words aren't independent
            p = np.exp((total - total[best]) / math.sqrt(n))
            names.append(self.languages[best]), scores.append(float(1 / p.sum()))
            familiar.append(min(1.0, float(met) / n + 1.5 / math.sqrt(n)))
        return names, scores, familiar


def sample_by_language(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """Of each language the ``most`` rows (id, lang, text) of smallest seeded hash; of rows that repeat an id, the smallest text.

    Ids far above the hash that is to be expected for a language's last one are left out before they are ranked,
    so that no task holds a language.
    """
    ids = rows.select("id", "lang").distinct().withColumn("u", F.xxhash64(F.lit(seed), "id"))
    numbers = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("number")).withColumnRenamed("lang", "of")
    below = (F.col("u").cast("double") / 2.0**64 + 0.5) * F.col("number") < most + 10 * most**0.5 + 10
    close = ids.join(numbers, F.col("lang") == F.col("of")).where(below)
    ranked = close.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("u", "id")))
    picked = materialise(ranked.where(F.col("n") <= most).select("id", "lang"), "picked")
    chosen = F.broadcast(picked) if picked.count() <= IDS_BROADCAST else picked
    sample = materialise(rows.join(chosen, ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text")), "sample")
    discard(picked)
    return sample


def most_frequent(counts: DataFrame, most: Column) -> DataFrame:
    """Of the rows (size, gram, lang, n) the most frequent of each size and language, about ``most``.

    The count to be reached follows from how many have which count. Of those that just reach it, a share is
    chosen by hash, so nothing is sorted but counts of counts.
    """
    of_counts = counts.groupBy("size", "lang", "n").agg(F.count(F.lit(1)).alias("equals"))
    above = F.sum("equals").over(Window.partitionBy("size", "lang").orderBy(F.desc("n"))) - F.col("equals")
    share = (most - above) / F.col("equals")
    shares = of_counts.select(F.col("size").alias("of_size"), F.col("lang").alias("of_lang"), F.col("n").alias("of_n"), share.alias("share")).where("share > 0")
    same = (F.col("size") == F.col("of_size")) & (F.col("lang") == F.col("of_lang")) & (F.col("n") == F.col("of_n"))
    u = F.xxhash64(F.lit(1), "gram").cast("double") / 2.0**64 + 0.5
    return counts.join(shares, same).where(u < F.col("share")).select(*counts.columns)


def learning_rows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def once_each(rows: DataFrame) -> DataFrame:
    """Rows (id, lang, text), of those that repeat an id within a language the smallest text. Only these texts are moved."""
    often = materialise(rows.groupBy("id", "lang").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "lang"), "often")
    # ids may be null here, and such rows are one document
    spread = F.broadcast(often) if often.count() <= IDS_BROADCAST else often
    same = rows["id"].eqNullSafe(spread["id"]) & (rows["lang"] == spread["lang"])
    repeated = rows.join(spread, same, "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    return rows.join(spread, same, "left_anti").unionByName(repeated)


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 6, whole: bool = False) -> Model:
    """A model of the labelled rows (null language or text: left out): all of them if ``whole``, else at most SAMPLE_DOCS
    documents a language.

    Rows that repeat an id within a language count once. Counts are summed by Spark; the driver gets the words
    and n-grams that are kept, after their number was checked.
    """
    spark = labelled.sparkSession
    rows = learning_rows(labelled, id_col, text_col, lang_col)
    spread = spark.sparkContext.defaultParallelism
    sample = once_each(rows) if whole else sample_by_language(rows, SAMPLE_DOCS, seed)

    def count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        words: Counter = Counter()
        splits = pc.split_pattern_regex(pc.utf8_lower(batch.column("text")), NO_LETTERS).to_pylist()
        for lang, split in zip(batch.column("lang").to_pylist(), splits, strict=True):
            words.update((w, lang) for w in split if w)
        keys = list(zip(*words, strict=True)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(words.values(), pa.int64())], ["gram", "lang", "n"])

    def count_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for word, lang, n in zip(*(batch.column(c).to_pylist() for c in ("gram", "lang", "n")), strict=True):
            for size in SIZES:
                for gram in grams(word, size):
                    found[size, gram, lang] += n
        keys = list(zip(*found, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.string()), pa.array(found.values(), pa.int64())], ["size", "gram", "lang", "n"])

    words = map_arrow(sample if whole else sample.repartition(spread), "gram string, lang string, n long", count_words, COUNTED_BYTES).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    words = materialise(words, "words")
    counted = map_arrow(words.repartition(spread), "size int, gram string, lang string, n long", count_grams, COUNTED_BYTES // 32).groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    counts = materialise(counted.unionByName(words.select(F.lit(0).alias("size"), "gram", "lang", "n")), "counts")
    languages = sorted(r.lang for r in (rows if whole else sample).select("lang").distinct().limit(MODEL_LIMIT // 1000).collect())
    kept = materialise(most_frequent(counts, F.when(F.col("size") == 0, WORDS_KEPT).otherwise(GRAMS_KEPT)), "kept")
    check_size(kept.select("size", "gram").distinct().count(), len(languages))
    # a word kept for one language counts in all
    found = counts.join(F.broadcast(kept.select("size", "gram").distinct()), ["size", "gram"], "left_semi")
    model = Model(found.select("size", "gram", "lang", "n").toArrow(), languages)
    discard(*([] if whole else [sample]), words, counts, kept)
    return model


def check_size(entries: int, languages: int) -> int:
    """The bytes of a model of so many words and n-grams, about; beyond MODEL_LIMIT, an error."""
    if (size := entries * (200 + 4 * languages)) > MODEL_LIMIT:
        raise ValueError(f"a model of {entries} words and n-grams in {languages} languages takes {size} bytes; the limit is {MODEL_LIMIT}")
    return size


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", pred: str = "lang_pred", score: str = "score", familiar: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the predicted language and its score (0 to 1); columns of these names are replaced.

    ``keep`` names the columns that stay (null: all); texts that nobody needs afterwards aren't sent back.

    A text that is null or has no letter, or any text where nothing was learned, gets ``und`` and score 0.
    Of languages that tie, the first by name wins. Repeated rows are scored each, and alike. Only the text is
    looked at. ``familiar`` names a further column: how much of the text the model has met, 0 to 1, plus three
    standard errors, so that little is said against a short text.
    """
    names = [pred, score, *([familiar] if familiar else [])]
    rows = docs.drop(*(x for x in names if x != text_col))
    kept = rows.select(*(f"`{c}`" for c in rows.columns if c not in names and (keep is None or c in keep)))
    own = model.shared(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(own.value.predict(batch.column(text_col)), (pa.string(), pa.float64(), pa.float64()), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_names), *columns[: len(names)]], [*kept_names, *names])

    kept_names = kept.columns
    return map_arrow(rows, with_fields(kept, f"`{pred}` string, " + ", ".join(f"`{x}` double" for x in names[1:])), run)


def least_familiar(found: DataFrame) -> float:
    """How familiar a text of a learned language is at least: four fifths of what all but a thousandth of the texts reach.

    ``found``: id, mark (of the text), familiar, of all texts of a known language that the model hasn't learned from. Rows that
    repeat id and text count once. The thousandth's last one is found by rank, exactly. 0 without any."""
    texts = found.select("id", "mark", "familiar").distinct()
    rank = -(-texts.count() // 1000)
    return 0.8 * texts.orderBy("familiar").limit(rank).agg(F.max("familiar")).first()[0] if rank else 0.0


def held_out(id_col: str, of: int, remainder: int) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of)) == remainder
