"""Keyword scoring: corpus-wide TF-IDF in DataFrame operations, per-document YAKE in batches."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.batches import batch_of, map_arrow
from termloom.config import STOP_WORDS
from termloom.functions.text import tokens
from termloom.scratch import materialise

PRECISION = 9
#: Texts whose words are counted together; some dozen numbers for each word are held.
YAKE_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for all cores, where a small table's file gives fewer; large tables stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def token_counts(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """Columns file, term, n, total: how often a document has each token, and its tokens in all.

    A document's tokens are sorted and counted as runs within its row, so that nothing is shuffled.
    """
    # no condition on the tokens here: it would be put before them, and they would be made twice
    found = spread(docs.select("file", "prose")).select("file", F.sort_array(tokens("prose", stop_words)).alias("t"))
    starts = F.expr("filter(if(size(t) > 0, sequence(0, size(t) - 1), array()), i -> i = 0 or t[i] != t[i - 1])")
    found = found.select("file", "t", F.size("t").cast("long").alias("total"), starts.alias("starts"))
    runs = F.expr("transform(starts, (s, k) -> named_struct('term', t[s], 'n', cast(coalesce(get(starts, k + 1), size(t)) - s as bigint)))")
    return found.select("file", "total", F.inline(runs)).select("file", "term", "n", "total")


def document_frequency(counts: DataFrame) -> DataFrame:
    """Columns term, df, max_tf: documents with each token and its largest share of one."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(F.col("n") / F.col("total")).alias("max_tf"))


def tfidf(docs: DataFrame, k: int = 500, stop_words=STOP_WORDS) -> DataFrame:
    """The ``k`` best terms: term, score (0 to 1), df. Score: largest term frequency times ln(N / df), over the best.

    N counts all documents, those without tokens too. Terms of every document score nothing and go. Equal
    scores are ordered by term. The best are found by a top-k, so no full sort takes place.
    """
    n = docs.count()
    scored = document_frequency(token_counts(docs, stop_words)).select("term", "df", (F.col("max_tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("raw"))
    best = scored.where("raw > 0").orderBy(F.desc("raw"), "term").limit(k)
    most = F.max("raw").over(Window.partitionBy(F.lit(0)))  # over the k rows that are left
    return best.select("term", (F.col("raw") / most).alias("score"), "df")


SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n{2,}")
TOKEN = re.compile(r"[^\W_]+(?:['’\-.][^\W_]+)*|[^\w\s]")


def yake(text: str, max_n: int = 3, limit: int = 500, stop_words=STOP_WORDS, similar: float = 0.9) -> list[tuple[str, float]]:
    """Keywords of one text with scores of 0 to 1, best first (Campos et al., 2020).

    Words are judged by case, position, frequency, the variety of their neighbours and their spread over
    sentences; a phrase by its words. Low is good; scores are turned round against the worst returned.
    """
    stop = {w.lower() for w in stop_words}
    sentences = [[w for w in TOKEN.findall(s)] for s in SENTENCE_END.split(text) if s.strip()]
    tf, upper, acronym = Counter(), Counter(), Counter()
    where, left, right = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    is_word = lambda w: w[0].isalnum() and not w.replace(".", "").replace(",", "").isdigit()
    for at, sentence in enumerate(sentences):
        before = None
        for i, w in enumerate(sentence):
            if not w[0].isalnum():
                before = None
                continue
            low = w.lower()
            tf[low] += 1
            where[low].add(at)
            if w.isupper() and len(w) > 1:
                acronym[low] += 1
            elif w[0].isupper() and i > 0:
                upper[low] += 1
            if before is not None:
                left[low][before] += 1
                right[before][low] += 1
            before = low
    content = [n for w, n in tf.items() if w not in stop]
    if not content:
        return []
    mean = sum(content) / len(content)
    deviation = math.sqrt(sum((n - mean) ** 2 for n in content) / len(content))
    most = max(tf.values())
    score: dict[str, float] = {}
    for w, n in tf.items():
        case = max(upper[w], acronym[w]) / (1 + math.log(n))
        position = math.log(math.log(3 + median(sorted(where[w]))))
        frequency = n / (mean + deviation)
        variety = [len(c) / sum(c.values()) if c else 0.0 for c in (left[w], right[w])]
        relatedness = 1 + sum(variety) * n / most
        sentences_with = len(where[w]) / len(sentences)
        score[w] = relatedness * position / (case + frequency / relatedness + sentences_with / relatedness)
    phrases: Counter = Counter()
    shown: dict[str, str] = {}
    for sentence in sentences:
        for i in range(len(sentence)):
            for n in range(1, max_n + 1):
                part = sentence[i : i + n]
                if len(part) < n or not all(is_word(w) for w in part):
                    break
                if part[0].lower() in stop or part[-1].lower() in stop or len(part[0]) < 2 and n == 1:
                    continue
                key = " ".join(part).lower()
                phrases[key] += 1
                shown.setdefault(key, " ".join(part))
    ranked = []
    for key, n in phrases.items():
        product, total = 1.0, 0.0
        parts = key.split(" ")
        for i, w in enumerate(parts):
            if w in stop:  # a stop word inside a phrase weighs by how it ties its neighbours
                p = right[parts[i - 1]][w] / tf[parts[i - 1]] * left[parts[i + 1]][w] / tf[parts[i + 1]]
                product *= 1 + (1 - p)
                total -= 1 - p
            else:
                product *= score[w]
                total += score[w]
        ranked.append((product / (n * (1 + total)) if total > -1 else product / n, key))
    ranked.sort()
    kept: list[tuple[str, float]] = []
    by_length: dict[int, list[str]] = defaultdict(list)
    for value, key in ranked:
        if len(kept) == limit:
            break
        if not _has_like(key, by_length, similar):
            kept.append((key, value))
            by_length[len(key)].append(key)
    worst = max((v for _, v in kept), default=0.0)
    return [(shown[key], 1 - v / worst if worst > 0 else 1.0) for key, v in kept]


def yake_all(texts: Sequence[str | None], max_n: int = 3, limit: int = 500, stop_words=STOP_WORDS, similar: float = 0.9) -> list[list[tuple[str, float]]]:
    """``yake`` of each of many texts: the same keywords and scores.

    The words of all texts are numbered, and what ``yake`` counts word by word is counted here in arrays. Every
    number is worked out by the same steps in the same order, so that equal scores stay equal.
    """
    stop = {w.lower() for w in stop_words}
    words: list[str] = []
    sizes, owner = [], []  # of each sentence: its words, its text
    for d, text in enumerate(texts):
        for s in SENTENCE_END.split(text or ""):
            if s.strip():
                found = TOKEN.findall(s)
                words += found
                sizes.append(len(found))
                owner.append(d)
    made: list[list[tuple[str, float]]] = [[] for _ in texts]
    if not words:
        return made
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    forms = list(number)
    lows: defaultdict[str, int] = defaultdict()
    lows.default_factory = lows.__len__
    flag = lambda f: np.fromiter(map(f, forms), bool, len(forms))[word]
    low = np.fromiter((lows[w.lower()] for w in forms), np.int64, len(forms))[word]
    shown = list(lows)
    stops = np.fromiter((w in stop for w in shown), bool, len(shown))[low]
    counted = flag(lambda w: w[0].isalnum())
    is_word = flag(lambda w: w[0].isalnum() and not w.replace(".", "").replace(",", "").isdigit())
    acronym, capital, single = flag(lambda w: w.isupper() and len(w) > 1), flag(lambda w: w[0].isupper()), flag(lambda w: len(w) < 2)
    sizes, owner = np.array(sizes), np.array(owner)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    text_of = owner[sentence]
    number_of_sentences = np.bincount(owner, minlength=len(texts))
    first_sentence = np.concatenate(([0], np.cumsum(number_of_sentences)[:-1]))
    leads = np.concatenate(([True], sentence[1:] != sentence[:-1]))

    # a term is a text's word in lower case; ``term``: that of each word
    at = np.flatnonzero(counted)
    if not len(at):
        return made
    keys, begins, inverse, n = np.unique(text_of[at] * len(shown) + low[at], return_index=True, return_inverse=True, return_counts=True)
    size, term_text = len(keys), keys // len(shown)
    term = np.full(len(words), -1)
    term[at] = inverse
    tally = lambda mask: np.bincount(inverse, weights=mask[at], minlength=size)
    case = np.maximum(tally(capital & ~acronym & ~leads), tally(acronym)) / (1 + _each(n, math.log))
    # sentences of each term, in order
    held = np.unique(inverse * len(sizes) + sentence[at])
    places = held % len(sizes) - first_sentence[term_text[held // len(sizes)]]
    held_n = np.bincount(held // len(sizes), minlength=size)
    ends = np.cumsum(held_n)
    middle = ends - held_n + held_n // 2
    twice = np.where(held_n % 2 == 1, 2 * places[middle], places[np.maximum(middle - 1, 0)] + places[middle])
    position = _each(twice, lambda x: math.log(math.log(3 + x / 2)))
    # neighbours within a sentence
    near = np.flatnonzero((np.diff(at) == 1) & (sentence[at][1:] == sentence[at][:-1]))
    pairs, pair_n = np.unique(inverse[near] * size + inverse[near + 1], return_counts=True)
    variety = np.zeros(size)
    for side in (pairs % size, pairs // size):
        total = np.bincount(side, weights=pair_n, minlength=size)
        variety += np.divide(np.bincount(side, minlength=size), total, out=np.zeros(size), where=total > 0)
    # of each text: what its words' numbers spread around
    bounds = np.searchsorted(term_text, np.arange(len(texts) + 1))
    common, most = np.ones(len(texts)), np.ones(len(texts))
    plain = ~stops[at[begins]]
    for d in np.unique(term_text):
        part = slice(bounds[d], bounds[d + 1])
        most[d] = n[part].max()
        content = n[part][np.argsort(begins[part])][plain[part][np.argsort(begins[part])]].tolist()
        if content:
            mean = sum(content) / len(content)
            off = {x: (x - mean) ** 2 for x in set(content)}
            common[d] = mean + math.sqrt(sum(map(off.__getitem__, content)) / len(content))
    related = 1 + variety * n / most[term_text]
    spread_out = held_n / number_of_sentences[term_text]
    score = related * position / (case + n / common[term_text] / related + spread_out / related)

    # phrases: the first place, how often and the score of each
    starts, code = np.flatnonzero(is_word), term[is_word.nonzero()[0]]
    firsts, lengths, values = [], [], []
    for k in range(1, max_n + 1):
        if k > 1:
            fits = starts + k - 1 < len(words)
            starts, code = starts[fits], code[fits]
            fits = is_word[starts + k - 1] & (sentence[starts + k - 1] == sentence[starts])
            starts = starts[fits]
            code = np.unique(code[fits] * size + term[starts + k - 1], return_inverse=True)[1]
        use = ~stops[starts] & ~stops[starts + k - 1]
        if k == 1:
            use &= ~single[starts]
        _, index, times = np.unique(code[use], return_index=True, return_counts=True)
        p = starts[use][index]
        product, total = np.ones(len(p)), np.zeros(len(p))
        for j in range(k):
            t = term[p + j]
            weight, less = score[t], score[t]
            if 0 < j < k - 1 and (tied := stops[p + j]).any():
                before, after = term[p + j - 1][tied], term[p + j + 1][tied]
                count = lambda a, b: pair_n[np.searchsorted(pairs, a * size + b)]
                share = count(before, t[tied]) / n[before] * count(t[tied], after) / n[after]
                weight, less = weight.copy(), less.copy()
                weight[tied], less[tied] = 1 + (1 - share), -(1 - share)
            product, total = product * weight, total + less
        values.append(np.where(total > -1, product / np.where(total > -1, times * (1 + total), 1), product / times))
        firsts.append(p)
        lengths.append(np.full(len(p), k))
    p, k, value = np.concatenate(firsts), np.concatenate(lengths), np.concatenate(values)
    order = np.argsort(text_of[p], kind="stable")
    p, k, value = p[order], k[order], value[order]
    bounds = np.searchsorted(text_of[p], np.arange(len(texts) + 1))
    for d in np.unique(text_of[p]):
        part = slice(bounds[d], bounds[d + 1])
        ranked = _ranked(p[part], k[part], value[part], 64 + 3 * limit, lambda i, j: " ".join([shown[x] for x in low[i : i + j].tolist()]))
        made[d] = [(" ".join(words[i : i + j]), v) for v, i, j in _distinct(ranked, limit, similar)]
    return made


def _each(x: np.ndarray, f: Callable[[int], float]) -> np.ndarray:
    """``f`` of each of whole numbers; worked out once for equal ones."""
    found, inverse = np.unique(x, return_inverse=True)
    return np.array([f(v) for v in found.tolist()])[inverse]


def _ranked(p: np.ndarray, k: np.ndarray, value: np.ndarray, many: int, name: Callable[[int, int], str]) -> Iterator[tuple[float, str, int, int]]:
    """Value, key, place and length by value, then key. The first ``many`` or so are sorted before the others are looked at."""
    parts = [np.arange(len(value))]
    if len(value) > many:
        first = value <= np.partition(value, many)[many]
        parts = [np.flatnonzero(first), np.flatnonzero(~first)]
    for part in parts:
        rows = zip(value[part].tolist(), p[part].tolist(), k[part].tolist(), strict=True)
        yield from sorted((v, name(i, j), i, j) for v, i, j in rows)


def _distinct(ranked: Iterator[tuple[float, str, int, int]], limit: int, similar: float) -> list[tuple[float, int, int]]:
    """The first ``limit`` that aren't like one before, their values turned round to scores."""
    kept, by_length = [], defaultdict(list)
    for value, key, i, j in ranked if limit > 0 else ():
        if not _has_like(key, by_length, similar):
            kept.append((value, i, j))
            by_length[len(key)].append(key)
            if len(kept) == limit:
                break
    worst = max((v for v, _, _ in kept), default=0.0)
    return [(1 - v / worst if worst > 0 else 1.0, i, j) for v, i, j in kept]


def _has_like(key: str, others: dict[int, list[str]], similar: float) -> bool:
    """Whether one of ``others`` (by length) is likelier than ``similar``: one less the edit distance over the longer length.

    Of strings with at most d edits between them, one of d + 1 pieces of the one stands in the other unchanged;
    only where it does is the distance worked out.
    """
    n = len(key)
    most = _edits(n + int(n * (1 - similar)) + 1, similar)
    for m in range(n - most, n + most + 1):
        if m in others and (d := _edits(max(n, m), similar)) >= abs(n - m) and d:
            pieces = [key[i * n // (d + 1) : (i + 1) * n // (d + 1)] for i in range(d + 1)]
            for other in others[m]:
                for p in pieces:
                    if p in other:
                        if _within(key, other, d):
                            return True
                        break
    return False


@lru_cache(4096)
def _edits(n: int, similar: float) -> int:
    """The most edits that leave strings of length ``n`` likelier than ``similar``."""
    d = int(n * (1 - similar)) + 1
    while d and 1 - d / n <= similar:
        d -= 1
    return d


def _within(a: str, b: str, most: int) -> bool:
    """Whether ``most`` edits or fewer make a string the other. Ends that are the same need none."""
    if len(a) > len(b):
        a, b = b, a
    i, n, more = 0, len(a), len(b) - len(a)
    while i < n and a[i] == b[i]:
        i += 1
    while n > i and a[n - 1] == b[n - 1 + more]:
        n -= 1
    longer = n + more - i
    if longer <= most:
        return True
    if n == i or most == 1:
        return False
    return _distance(a[i:n], b[i : n + more], most) <= most


def _distance(a: str, b: str, most: int) -> int:
    """The edit distance, or more than ``most`` as soon as that is certain."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            break
    return row[-1]


def yake_keywords(docs: DataFrame, max_n: int = 3, limit: int = 500, stop_words=STOP_WORDS) -> DataFrame:
    """Columns file, rank, term, score: each document's keywords. Documents are independent, so no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        schema = pa.schema([batch.schema.field("file"), ("rank", pa.int64()), ("term", pa.string()), ("score", pa.float64())])
        found = yake_all(batch.column("prose").to_pylist(), max_n, limit, stop_words)
        return batch_of(schema, [(f, i, t, s) for f, ranked in zip(batch.column("file").to_pylist(), found, strict=True) for i, (t, s) in enumerate(ranked)])

    return map_arrow(spread(docs.select("file", "prose")), "file string, rank long, term string, score double", run, YAKE_BYTES)


#: Most repeated files that are sent to every executor.
REPEATED_BROADCAST = 1_000_000
SENTENCES, WORDS = r"(?<=[.!?])\s+", r"[\p{L}\p{N}]+"


def yake_features(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """Counts that the scores rest on, per document and word: n, sentences, capitalised (not first), of all words.

    A document's words are sorted and counted as runs within its row, so that none is shuffled; only the words of
    rows that repeat a file meet by a shuffle.
    """
    docs = spread(docs.select("file", "prose"))
    repeated = materialise(docs.groupBy("file").count().where("count > 1").select("file"), "repeated")
    number = repeated.count()
    if not number:
        return _row_features(docs)
    found = F.broadcast(repeated) if number <= REPEATED_BROADCAST else repeated
    same = lambda how: docs.join(found, docs["file"].eqNullSafe(found["file"]), how)
    return _row_features(same("left_anti")).unionByName(_file_features(same("left_semi")))


def _row_features(docs: DataFrame) -> DataFrame:
    word = lambda w, at, sentence: F.struct(F.lower(w).alias("term"), sentence.alias("sentence"), ((at > 0) & F.substring(w, 1, 1).rlike(r"\p{Lu}")).alias("capital"))
    of = lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(WORDS), F.lit(0)), lambda w, at: word(w, at, i))
    rows = docs.select("file", F.sort_array(F.flatten(F.transform(F.split("prose", SENTENCES), of))).alias("t"))
    rows = rows.select("file", "t", F.expr("filter(if(size(t) > 0, sequence(0, size(t) - 1), array()), i -> i = 0 or t[i].term != t[i - 1].term)").alias("starts"))
    parts = rows.select("file", F.inline(F.expr("transform(starts, (s, k) -> named_struct('term', t[s].term, 'part', slice(t, s + 1, coalesce(get(starts, k + 1), size(t)) - s)))")))
    sentences, capitals = F.array_distinct(F.col("part.sentence")), F.filter("part", lambda x: x["capital"])
    return parts.select("file", "term", F.size("part").cast("long").alias("n"), F.size(sentences).cast("long").alias("sentences"), F.size(capitals).cast("long").alias("capitalised"))


def _file_features(docs: DataFrame) -> DataFrame:
    sentences = docs.select("file", F.posexplode(F.split("prose", SENTENCES)).alias("sentence", "s"))
    found = sentences.select("file", "sentence", F.posexplode(F.regexp_extract_all("s", F.lit(WORDS), F.lit(0))).alias("at", "w"))
    low = F.lower("w")
    return found.groupBy("file", low.alias("term")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("sentence").alias("sentences"),
        F.count_if((F.col("at") > 0) & F.substring("w", 1, 1).rlike(r"\p{Lu}")).alias("capitalised"),
    )
