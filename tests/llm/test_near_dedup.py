import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tests.llm.helpers import same
from termloom.llm import components as cc
from termloom.llm import near_dedup as nd
from termloom.llm.common import materialise
from termloom.llm.components import components
from termloom.llm.queries import OP9_SQL, op9_near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    seen = set()
    for ks in where.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a][1] & sets[b][1])
                    if 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
                        x, y = sorted((root(sets[a][0]), root(sets[b][0])))
                        parent[y] = x
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def family(rng, n, size, edits, start):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        rows.append((start + i, " ".join(words)))
    return rows


def got(df):
    return {tuple(r) for r in df.collect()}


def test_sets_and_signatures():
    texts = [None, "", "  ", "A b\tC", "a b c d e", "a b c d e f", "a a a a a a a", "É é \x85x y z w"]
    sets = list(nd.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert list(nd.shingle_sets(pa.array(["a B c"])))[0].tolist() == sets[3].tolist()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64)
    agree = (nd.signature(x[:3500]) == nd.signature(x[500:])).mean()
    assert abs(agree - 3000 / 4000) < 0.2


def test_index_meets_all_pairs_within_the_threshold():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**16, nd.K).astype(np.uint16)
    for _ in range(300):
        other = base.copy()
        at = rng.choice(nd.K, nd.R, replace=False)
        other[at] ^= 1
        keys = nd.chunk_keys(np.stack([base, other]))
        assert (keys[0] == keys[1]).any()
    assert nd.R < 2 * (nd.CHUNKS - 1)


def test_components_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cc, "NODES_BROADCAST", 0)
    monkeypatch.setattr(cc, "SALTS", 5)
    links = [(1, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(20)] + [(5, 1000), (3000, 2005)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {5: 1} | {1000 + i: 1 for i in range(300)} | {2001 + i: 2000 for i in range(20)} | {3000: 2000}


@pytest.mark.parametrize("bucket,held,block", [(512, 2_000_000, 128), (4, 300, 2), (10**9, 2_000_000, 3)])
def test_equals_brute_force(spark, monkeypatch, bucket, held, block):
    monkeypatch.setattr(nd, "BUCKET", bucket)
    monkeypatch.setattr(nd, "HELD", held)
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(bucket + held + block)
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  B"), (4, "a b c"), (5, "word " * 30_000)]
    rows += family(rng, 40, 60, 3, 100) + family(rng, 40, 60, 6, 200) + family(rng, 30, 200, 12, 300)
    shared = " ".join(f"s{i}" for i in range(25))
    rows += [(400 + i, f"{shared} " + " ".join(f"u{i}_{k}" for k in range(30))) for i in range(40)]
    rows += [(500 + i, rows[10 + i % 3][1]) for i in range(20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    assert got(nd.near_dedup(df)) == brute(rows)


def test_each_pair_within_the_threshold_meets_once(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**16, nd.K).astype(np.uint16)
    signed = []
    for i in range(40):
        other = base.copy()
        other[rng.choice(nd.K, rng.integers(0, 16), replace=False)] = rng.integers(0, 2**16)
        signed.append(other)
    signed = np.stack(signed)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if (signed[i] != signed[j]).sum() <= nd.R and (i % 3 or j % 3)}
    reps = spark.createDataFrame([(i, bytearray(x.tobytes()), 1) for i, x in enumerate(signed)], "id long, signature binary, n_shingles long")
    members = nd.index(reps).withColumn("component", F.col("id")).join(reps, "id").withColumn("second", F.lit(-1).cast("long"))
    members = members.withColumn("component", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    whole = members.join(nd.unresolved(members, ["key"]), "key")
    again, plain = nd.grouped_again(whole, reps, materialise)
    for rows in (whole, again.unionByName(plain)):
        met = []
        for _, g in nd.meetings(nd.dealt(rows)).toPandas().groupby(nd.MEETING):
            ids = dict(zip(g["at"], g["id"]))
            met += [tuple(sorted((x, ids[y]))) for x, ys in zip(g["id"], g["partners"]) for y in ys]
        assert sorted(met) == sorted(want) and want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op9_near_dedup(spark, sf)) == brute(rows)


def test_empty_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(nd, "IDS_BROADCAST", 0)
    schema = "doc_id long, text string"
    assert nd.near_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "one two three four five six"), (7, "one two three four five six"), (None, "one two three four five six"), (9, "one two three four five six")]
    result = sorted((tuple(r) for r in nd.near_dedup(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert result == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 2, None, True), (9, 2, 7, False)], key=repr)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1, 40)] + [(100, 101 + i) for i in range(30)] + [(500, 500)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 131)}


def test_query_equals_sql(spark):
    assert same(spark, op9_near_dedup, OP9_SQL) == 200


def test_pivots_are_tried_again_only_where_they_are_of_use(spark, monkeypatch):
    """Alike but not linked, so that no pivot is of use: a text meets a pivot or two of each bucket, and links aren't gone through again."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"s{k}" for k in range(60)) + " " + " ".join(f"u{i}_{k}" for k in range(34))) for i in range(400)] + family(rng, 60, 80, 2, 1000)
    tried, steps = [], []
    near, large = nd.near_by_signature, cc._large_star
    monkeypatch.setattr(nd, "near_by_signature", lambda pairs, reps: (tried.append(pairs.count()), near(pairs, reps))[1])
    monkeypatch.setattr(cc, "_large_star", lambda edges: (steps.append(edges.count()), large(edges))[1])
    assert got(nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert tried[0] and sum(tried[1:]) < 1.2 * tried[0]  # four pivots a bucket at once: four times as many
    assert sum(steps[2:]) < steps[0]


def test_merged_components_are_those_of_all_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    some, more = (materialise(spark.createDataFrame(x, "a long, b long"), "links") for x in (links[:120], links[120:]))
    want = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {tuple(r) for r in cc.merged(components(some), more).collect()} == want
    assert cc.merged(found := components(some), more.limit(0)) is found
