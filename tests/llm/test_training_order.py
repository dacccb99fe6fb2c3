import glob
import hashlib
import os

import numpy as np
import public_tokenizers
import pytest

from termloom.llm import training_order as to
from termloom.llm.bpe import Codec
from termloom.llm.queries import RANKS, op2_training_order, training_shards

PATH = public_tokenizers.path(RANKS)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(n):
    slots = to.permute(np.arange(n), n, b"key")
    assert sorted(slots.tolist()) == list(range(n))
    if n > 100:
        assert slots.tolist() != to.permute(np.arange(n), n, b"other").tolist()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.15
        assert (to.permute(np.arange(n)[50:60], n, b"key") == slots[50:60]).all()


def test_numbers_outside_are_refused():
    with pytest.raises(ValueError):
        to.permute(np.array([5]), 5, b"k")


def test_shards_are_read_back_from_any_slot(spark, tmp_path):
    texts = [(i, f"document {i} says " + "some words more " * (i % 40)) for i in range(120)] + [(500, None), (501, ""), (502, "x" * 30_000), (7, "document 7 says " + "some words more " * 7)]
    docs = spark.createDataFrame([(*r, "old") for r in texts], "doc_id long, text string, record string").repartition(5)
    ordered = to.training_order(docs, PATH, public_tokenizers.PATTERN, key=b"k", length=16, shard_records=100)
    rows = ordered.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    to.write_shards(ordered, f"{tmp_path}/shards")
    files = sorted(glob.glob(f"{tmp_path}/shards/part-*"))
    assert len(files) == -(-len(rows) // 100)
    stride = 4 + 2 * 16 + 1
    assert [os.path.getsize(f) for f in files] == [stride * min(100, len(rows) - 100 * i) for i in range(len(files))]
    codec = Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    parts = {}
    for r in rows:
        assert r.shard == r.slot // 100 and r.offset == r.slot % 100 * stride
        with open(files[r.shard], "rb") as file:
            file.seek(r.offset)
            record = file.read(stride)
        assert record == bytes(r.record) and record[-1:] == b"\n"
        assert int.from_bytes(record[:4], "little") == r.n_tokens
        parts.setdefault((r.doc_id, r.n_tokens if r.doc_id == 7 else 0), {})[r.seq_no] = np.frombuffer(record[4:-1], "<u2")[: r.n_tokens].astype("<u4").tobytes()
    for i, text in texts:
        if text and i != 7:
            own = parts[i, 0]
            assert codec.decode(b"".join(own[k] for k in sorted(own))) == text.encode()


def test_slots_do_not_depend_on_how_the_input_is_split(spark):
    rows = [(i, f"document {i} says " + "some words more " * (i % 9)) for i in range(90)] + [(7, "another of seven"), (None, "no id"), (None, "no id"), (91, None), (92, "")] + [(50, "hot row again and again")] * 60
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, record string")
    slots = []
    for split in (docs.repartition(1), docs.repartition(7), docs.orderBy("text").coalesce(3)):
        got = to.training_order(split, PATH, public_tokenizers.PATTERN, key=b"k", length=8, shard_records=50).collect()
        assert sorted(r.slot for r in got) == list(range(len(got)))
        slots.append({(r.slot, r.doc_id, r.seq_no, bytes(r.record)) for r in got})
    assert slots[0] == slots[1] == slots[2]
    other = to.training_order(docs, PATH, public_tokenizers.PATTERN, key=b"l", length=8, shard_records=50).collect()
    assert {(r.slot, r.doc_id, r.seq_no, bytes(r.record)) for r in other} != slots[0]


def test_reading_goes_on_from_any_slot(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} says " + "some words more " * (i % 9)) for i in range(90)], "doc_id long, text string")
    ordered = to.training_order(docs, PATH, public_tokenizers.PATTERN, key=b"k", length=8, shard_records=50)
    to.write_shards(ordered, f"{tmp_path}/shards")
    want = sorted((r.slot, r.n_tokens, bytes(r.record)) for r in ordered.collect())
    for start in (0, 49, 50, 137, 10**6):
        got = to.read_shards(spark, f"{tmp_path}/shards", 8, 50, start=start).collect()
        assert sorted((r.slot, r.n_tokens, bytes(r.record)) for r in got) == want[start:]


def test_shards_hold_what_the_order_says(spark):
    sf = "/root/testdata/sf0.001"
    want = {(r.slot, r.n_tokens, r.record_sha256) for r in op2_training_order(spark, sf).collect()}
    assert {tuple(r) for r in training_shards(spark, sf).collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert to.training_order(docs, PATH, public_tokenizers.PATTERN, key=b"k").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_training_order(spark, sf).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    codec = Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for r in rows:
        own = np.frombuffer(codec.encode(docs[r.doc_id]), "<u4")[r.seq_no * 512 : (r.seq_no + 1) * 512].astype("<u2")
        full = np.full(512, 50256, "<u2")
        full[: len(own)] = own
        assert r.record_sha256 == hashlib.sha256(len(own).to_bytes(4, "little") + full.tobytes() + b"\n").hexdigest()
    assert len(rows) == sum(-(-len(codec.encode(t)) // 2048) for t in docs.values())
