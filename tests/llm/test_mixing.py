import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.llm import mixing
from termloom.llm.queries import op7_mixing


def test_targets_stop_at_twice_the_size():
    sizes = {"a": 100, "b": 1000, None: 10}
    got = mixing.targets(sizes, (3, 1, 2), 1.5 * 1110, 2)
    assert got["a"] == 200 and got[None] == 20
    assert got["b"] == pytest.approx(1665 - 220)
    assert mixing.targets({}, (3, 1, 2), 0, 2) == {}
    assert mixing.targets({"a": 0}, (3,), 0, 2) == {"a": 0.0}


def brute(patterns, quotas, repeats):
    """Least cost of the largest flow, by trying all ways to send a few words."""
    ways = []
    for names, words in patterns:
        ways.append([x for x in itertools.product(range(words * repeats + 1), repeat=len(names)) if sum(x) <= words * repeats])
    best = None
    for pick in itertools.product(*ways):
        into = defaultdict(int)
        for (names, _), x in zip(patterns, pick):
            for s, n in zip(names, x):
                into[s] += n
        if all(into[s] <= quotas[s] for s in into):
            flow = sum(into.values())
            cost = sum(r for (_, words), x in zip(patterns, pick) for r in range(repeats) for _ in range(min(words, max(0, sum(x) - r * words))))
            best = max(best or (0, -(10**9)), (flow, -cost))
    return best


@pytest.mark.parametrize("quotas", [{"a": 3, "b": 2}, {"a": 9, "b": 1}, {"a": 0, "b": 4}, {"a": 2, "b": 9}])
def test_route_is_a_least_cost_largest_flow(quotas):
    patterns = [(("a",), 2), (("a", "b"), 2), (("b",), 1)]
    got = mixing.route(patterns, quotas, 2)
    cost = sum(max(0, g - w) for g, (_, w) in zip(got, patterns))
    assert (sum(got), -cost) == brute(patterns, quotas, 2)


def test_query_meets_targets_and_reruns_agree(spark):
    sf = "/root/testdata/sf0.01"
    rows = op7_mixing(spark, sf).collect()
    again = {r.doc_id: r.taken for r in op7_mixing(spark, sf).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by, want = defaultdict(int), {}
    for r in rows:
        assert r.size == len(docs[r.doc_id].text.encode().split()) and 0 <= r.taken <= 2 * r.size and r.taken == again[r.doc_id]
        by[docs[r.doc_id].source] += r.taken
        want[docs[r.doc_id].source] = r.target
    assert sum(want.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert all(abs(by[s] - want[s]) <= 0.02 * want[s] for s in want)


def test_overlaps_nulls_and_ties(spark):
    rows = [(i, "w " * (1 + i % 7), ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else [None]) for i in range(300)] + [(900, None, ["a"]), (901, "", ["b", "b"]), (902, "x y", None), (903, "x y", []), (5, "w " * 6, [None])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, names array<string>, size int")
    mixed, sources = mixing.mix(docs, F.col("names"))
    got = mixed.collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    assert {r.doc_id: r.copies for r in got}[903] == 0
    of = {r.source: r for r in sources.collect()}
    assert set(of) == {"a", "b", None}
    assert sum(r.size * r.copies for r in got) == pytest.approx(sum(min(r.target, 1e9) for r in of.values()), rel=0.05)


def test_running_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 3)
    rows = [(p, b, (7 * b + len(p or "")) % 11) for p in ("a", "bb", None) for b in range(20)]
    got = mixing.running(spark.createDataFrame(rows, "pattern string, bucket long, words long")).collect()
    want = {(p, b): sum(w for q, c, w in rows if q == p and c < b) for p, b, _ in rows}
    assert len(got) == 60 and {(r.pattern, r.bucket): r.before for r in got} == want


def plain_mix(rows, repeats=2, seed=17):
    """Copies by id and text for one source a row, without Spark but for its hash."""
    hashes = {(i, t): u for i, t, _, u in rows}
    size = {k: sum(len((t or "").split()) for i, t, _, _ in rows if (i, t) == k) for k in hashes}
    by = defaultdict(list)
    for i, t, s, _ in rows:
        if (i, t) not in by[s]:
            by[s].append((i, t))
    words = {s: sum(size[k] for k in ks) for s, ks in by.items()}
    goal = mixing.targets(words, mixing.WEIGHTS, 1.5 * sum(words.values()), repeats)
    copies = {}
    for s, ks in by.items():
        base, rest = divmod(min(int(goal[s]), repeats * words[s]), words[s]) if words[s] else (0, 0)
        buckets = -(-sum(r[2] == s for r in rows) // mixing.BUCKET_DOCS)
        dealt = defaultdict(list)
        for k in ks:
            dealt[int((hashes[k] / 2.0**64 + 0.5) * buckets)].append(k)
        for b in sorted(dealt):
            own = sum(size[k] for k in dealt[b])
            extra = {k: 1 for k in dealt[b]} if rest >= own else {}
            if 0 < rest < own:
                order = sorted(dealt[b], key=lambda k: hashes[k])
                gap = rest
                for k in order:
                    if size[k] <= gap:
                        extra[k], gap = 1, gap - size[k]
                while gap:
                    swaps = [(size[o] - size[k], order.index(k), size[o], o, k) for k in order if extra.get(k) for o in order if not extra.get(o) and 0 < size[o] - size[k] <= gap]
                    if not swaps:
                        break
                    most = max(x[0] for x in swaps)
                    _, _, _, o, k = min((x for x in swaps if x[0] == most), key=lambda x: x[1])
                    extra[o], extra[k], gap = 1, 0, gap - most
            for k in dealt[b]:
                copies[k] = base + extra.get(k, 0)
            rest -= own
    return size, copies, words, goal


@pytest.mark.parametrize("bucket", [4096, 25])
def test_taken_words_equal_a_plain_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source, r.u) for r in docs.withColumn("u", F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text"))).collect()]
    size, copies, words, goal = plain_mix(rows)
    got = op7_mixing(spark, sf).collect()
    assert len(got) == len(rows)
    total, want = defaultdict(int), defaultdict(int)
    for r in got:
        (key,) = [k for k in copies if k[0] == r.doc_id]
        source = next(x[2] for x in rows if x[0] == r.doc_id)
        assert (r.size, r.source_size) == (size[key], words[source]) and abs(r.target - goal[source]) < 1e-6
        total[source] += r.taken
        want[source] += copies[key] * size[key]
    assert total == want


def test_repeated_rows_are_units_and_a_hot_one_is_not_gathered(spark):
    rows = [(1, "hot row of words", "a")] * 400 + [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(2, 300)] + [(1, "other text", "a"), (None, "no id here", "a"), (None, "no id here", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, F.array("source"))[0].collect()
    assert len(got) == len(rows) and len({r.copies for r in got if r.doc_id == 1 and r.size == 4}) == 1
    assert sum(r["count"] for r in mixing.mixed_documents(docs, F.array("source")).groupBy("doc_id").count().collect()) == sum(r.copies for r in got)


def test_columns_of_any_name(spark):
    names = ["_id", "_u", "_bucket", "u", "bucket", "pattern", "mark", "more", "extra", "row", "base", "id", "of"]
    rows = [(i, f"{'w ' * (1 + i % 5)}", f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(60)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names)}")
    got = mixing.mixed_documents(docs, F.array("source"))
    assert got.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.mix(docs, F.array("source"))[0].collect() if r.copies}
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == want
    assert all(tuple(r) in set(rows) for r in got.collect())


def test_empty_table(spark):
    mixed, sources = mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), F.array("source"))
    assert mixed.count() == 0 and sources.count() == 0


def test_mixed_documents_repeat_rows_and_keep_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGES_BROADCAST", 0)
    rows = [(i, f"{'w ' * (1 + i % 5)}", f"s{i % 3}", i) for i in range(90)] + [(500, None, None, 1), (501, "x y z", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    got = mixing.mixed_documents(docs, F.array("source"))
    assert got.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    mixed, _ = mixing.mix(docs, F.array("source"))
    assert counts == {r.doc_id: r.copies for r in mixed.collect() if r.copies}
