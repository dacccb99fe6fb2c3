"""Token ids as fixed-stride records in training order.

Documents become sequences of L tokens, numbered in order of the documents' ids. A keyed Feistel permutation
with cycle-walking sends each number to a global slot, so the order is random-like, needs no sort key to be
stored and follows from documents and key alone, however the input is split. Slots are dealt to shards by
range; a record's place is known from its slot alone, so a reader can go on from any slot.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import broadcast_value, cut, materialise

LENGTH = 512
#: Records of a shard; with LENGTH tokens of two bytes, 64 MiB and a little.
SHARD_RECORDS = 65_536
ROUNDS = 8
#: Most bytes of the vocabulary, which is broadcast.
LIMIT = 128 << 20
END = b"\n"
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def round_keys(key: bytes) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(bytes([i]), key=key[:64], digest_size=8).digest(), "little") for i in range(ROUNDS)]


def permute(numbers: np.ndarray, n: int, key: bytes) -> np.ndarray:
    """The slots of numbers in [0, n): a bijection of that range, different for each key.

    Balanced Feistel rounds permute the smallest 4**w >= n; what falls outside the range walks on.
    """
    if n < 0 or len(numbers) and not (0 <= int(numbers.min()) and int(numbers.max()) < n):
        raise ValueError("a number outside the range")
    w = max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << w) - 1), np.uint64(w)
    keys = [np.uint64(k) for k in round_keys(key)]
    out = numbers.astype(np.uint64)
    left_out = np.arange(len(out))
    while len(left_out):
        x = out[left_out]
        left, right = x >> shift, x & low
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, (left ^ (mixed >> np.uint64(29))) & low
        out[left_out] = x = left << shift | right
        left_out = left_out[x >= np.uint64(n)]
    return out.astype(np.int64)


@cache
def _library(data: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenised(docs: DataFrame, path: str, pattern: str, *, id_col: str, text_col: str, length: int) -> DataFrame:
    """A row per document with tokens: id, part, at, digest, n, ids.

    ``ids`` are compressed, ``digest`` is of them, ``n`` the number of sequences; ``part`` and ``at`` say which
    row of this run it is, which tells repeated rows apart.
    """
    with open(path, "rb") as file:
        data = file.read()
    shared = broadcast_value(docs.sparkSession, data, LIMIT, len(data))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text != ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, squeeze = _library(shared.value, pattern), zstandard.ZstdCompressor(level=3)
        kind = np.dtype("<u2" if encoding.max_token_value < 65_535 else "<u4")
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in cut(whole):
                ids, digests, counts = [], [], []
                for text in batch.column("text").to_pylist():
                    own = encoding.encode_to_numpy(text, disallowed_special=()).astype(kind)
                    ids.append(squeeze.compress(own.tobytes()))
                    digests.append(xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63)
                    counts.append(-(-len(own) // length))
                places = np.arange(at, at + len(ids))
                at += len(ids)
                columns = [batch.column("id"), pa.array([part] * len(ids), pa.int64()), pa.array(places), pa.array(digests, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "at", "digest", "n", "ids"])

    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, part long, at long, digest long, n long, ids binary")


def numbered(tokens: DataFrame) -> tuple[DataFrame, int]:
    """Tokens (id, first, ids) with the number of a document's first sequence, and how many sequences there are.

    Documents count in order of id, then digest, null ids first. Only ids and counts are sorted: by range, with a
    running sum in each range and the ranges' totals (as many as there are shuffle partitions) added up.
    Documents that are the same in both are interchangeable, and numbered by their places in this run.
    """
    spark, kind = tokens.sparkSession, dict(tokens.dtypes)["id"]
    groups = materialise(tokens.groupBy("id", "digest").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = total + np.cumsum(batch.column("n").to_numpy() * batch.column("copies").to_numpy())
            starts = np.concatenate(([total], sums[:-1]))
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "digest", "copies")), pa.array([part] * batch.num_rows, pa.int64()), pa.array(starts[: batch.num_rows]), pa.array(sums)], ["id", "digest", "copies", "range", "start", "end"])

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = groups.repartitionByRange(ranges, "id", "digest").sortWithinPartitions("id", "digest")
    ranked = materialise(sorted_.mapInArrow(run, f"id {kind}, digest long, copies long, range long, start long, end long"), "ranked")
    totals = ranked.groupBy("range").agg(F.max("end").alias("n")).orderBy("range").collect()
    offsets, total = [], 0
    for r in totals:
        offsets.append((r.range, total))
        total += r.n
    offset = F.broadcast(spark.createDataFrame(offsets, "range long, before long"))  # a row per shuffle partition
    numbers = ranked.join(offset, "range").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "copies", (F.col("start") + F.col("before")).alias("start"))
    found = tokens.join(numbers, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).drop("_id", "_digest")
    single = found.where("copies = 1").select("id", F.col("start").alias("first"), "ids")
    if groups.where("copies > 1").isEmpty():
        return single, total
    repeated = groups.where("copies > 1").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    rows = tokens.select("id", "digest", "part", "at").join(repeated, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    rows = materialise(rows, "copies")
    # copies of a task are numbered in it, then the tasks' counts are added up: no group meets in one task
    sums = rows.groupBy("id", "digest", "part").agg(F.count(F.lit(1)).alias("own"))
    sums = sums.withColumn("before", F.sum("own").over(Window.partitionBy("id", "digest").orderBy("part")) - F.col("own")).drop("own")
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy("id", "digest", "part").orderBy("at")) - 1)
    sums = sums.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("part").alias("_part"), "before")
    inside = inside.join(sums, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")) & (F.col("part") == F.col("_part")))
    inside = materialise(inside.select("part", "at", (F.col("before") + F.col("k")).alias("copy")), "places")
    several = found.where("copies > 1").join(inside, ["part", "at"])
    return single.unionByName(several.select("id", (F.col("start") + F.col("copy") * F.col("n")).alias("first"), "ids")), total


def training_order(docs: DataFrame, path: str, pattern: str, *, key: bytes, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """One row per sequence, each shard a partition in slot order: slot, shard, offset, id, seq_no, n_tokens, record.

    A record is n_tokens (32 bits), ``length`` ids (16 bits where the vocabulary allows, else 32; padded
    with the number after the last id) and a line feed, all little-endian; every record has the same size,
    and ``offset`` is its place within its shard. Null and empty texts have no sequences; an empty table
    gives an empty result. Repeated rows give sequences of their own. Slots follow from the key and the
    documents' ids and texts, not from how the input is split; other columns are neither read nor returned.
    """
    kind_of_id = dict(docs.dtypes)[id_col]
    tokens = materialise(tokenised(docs, path, pattern, id_col=id_col, text_col=text_col, length=length), "tokens")
    with open(path, "rb") as file:
        pad = 1 + max(int(line.split()[1]) for line in file if line.strip())
    kind = np.dtype("<u2" if pad < 65_536 else "<u4")
    done, total = numbered(tokens)
    stride = record_size(kind, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in cut(whole, 1 << 20):
                rows, seq, sizes, numbers, records = [], [], [], [], []
                for i, (first, ids) in enumerate(zip(batch.column("first").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                    own = np.frombuffer(loosen.decompress(ids), kind)
                    for k in range(-(-len(own) // length)):
                        piece = own[k * length : (k + 1) * length]
                        full = np.full(length, pad, kind)
                        full[: len(piece)] = piece
                        rows.append(i), seq.append(k), sizes.append(len(piece))
                        numbers.append(first + k)
                        records.append(len(piece).to_bytes(4, "little") + full.tobytes() + END)
                if rows:
                    slots = permute(np.array(numbers, np.int64), total, key)
                    columns = [slots, slots // shard_records, slots % shard_records * stride]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, columns), batch.column("id").take(pa.array(rows)), pa.array(seq, pa.int64()), pa.array(sizes, pa.int64()), pa.array(records, pa.binary())],
                        ["slot", "shard", "offset", "id", "seq_no", "n_tokens", "record"],
                    )

    made = done.mapInArrow(run, f"slot long, shard long, offset long, id {kind_of_id}, seq_no long, n_tokens long, record binary")
    shards = max(1, -(-total // shard_records))
    return made.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot").withColumnRenamed("id", id_col)


def record_size(kind: np.dtype, length: int = LENGTH) -> int:
    return 4 + kind.itemsize * length + len(END)


def write_shards(ordered: DataFrame, path: str) -> None:
    """Write each partition's records one after another, as one file per shard, through Spark's committer.

    The text writer puts a column's bytes as they are and the line feed that ends every record, so a file
    is its records' bytes and part-N holds shard N. A lost task is written again; no half file is kept.
    """
    ordered.select(F.expr("cast(substring(record, 1, octet_length(record) - 1) as string)").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard_records: int = SHARD_RECORDS, wide: bool = False, start: int = 0) -> DataFrame:
    """Records of written shards from slot ``start`` on, read from the files alone: slot, n_tokens, record."""
    stride = record_size(np.dtype("<u4" if wide else "<u2"), length)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract(F.col("path"), r"part-(\d+)", 1).cast("long").alias("shard"), "content").where(F.col("shard") >= start // shard_records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                for at in range(max(0, start - shard * shard_records) * stride, len(data), 4096 * stride):
                    records = [bytes(data[i : i + stride]) for i in range(at, min(at + 4096 * stride, len(data)), stride)]
                    slots = shard * shard_records + at // stride + np.arange(len(records))
                    sizes = [int.from_bytes(r[:4], "little") for r in records]
                    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sizes, pa.int64()), pa.array(records, pa.binary())], ["slot", "n_tokens", "record"])

    return files.mapInArrow(run, "slot long, n_tokens long, record binary")
