"""Extraction against a plain Python account of it."""

import math
import random
import time
from collections import Counter, defaultdict

from termloom.config import ExcludeConfig, ExtractConfig, KnownTerm
from termloom.operators import candidates as C
from termloom.operators.keywords import yake

STOP = ["the", "a", "of", "and", "is"]
WORDS = ["copper kettle", "lid", "spout", "tea leaf", "boil", "steam", "copper pot", "handle", "the stove", "water", "Kettle", "tea"]


def corpus(n=24):
    rng = random.Random(n)
    files = [f"{'notes/' if i % 3 else ''}n{i}.md" for i in range(n)]
    return {f: ". ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 9))) + f" item{i % 5}" for _ in range(rng.randrange(1, 6))) for i, f in enumerate(files)} | {"empty.md": "", "zz.md": "common"}


def plain_extract(texts, config):
    """Candidates as dictionaries: both scorers, merging, known terms, share, exclusion, top-k, in this order."""
    texts = {f: t for f, t in texts.items() if t}
    order = sorted(texts, key=lambda f: f.split("/"))
    found: dict[str, list] = {}  # key: score, term, places
    rows = []
    for f in order:
        for rank, (t, s) in enumerate(yake(texts[f], config.ngram_range[1], config.max_candidates)):
            if s >= config.min_score and (t := C.trimmed(t, set(STOP))):
                rows.append((t.lower(), f, rank, t, s, f.split("/")))
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[5], r[2]))
        best = min(own, key=lambda r: (-r[4], r[5], r[2]))
        found[key] = [best[4], best[3], [(r[1], C.snippet(texts[r[1]], i, len(r[3])) if (i := texts[r[1]].lower().find(r[0])) >= 0 else "") for r in own]]
    counts = {f: Counter(w for w in "".join(c for c in t.lower() if c.isalnum() or c.isspace()).split() if len(w.encode()) >= 2 and w not in STOP) for f, t in texts.items()}
    df = Counter(w for c in counts.values() for w in c)
    raw = {w: max(c[w] / c.total() for c in counts.values() if w in c) * math.log(len(texts) / n) for w, n in df.items()}
    top = sorted((w for w in raw if raw[w] > 0), key=lambda w: (-raw[w], w))[: config.max_candidates]
    for w in top:
        if (score := raw[w] / raw[top[0]]) >= config.min_score:
            entry = found.setdefault(w, [score, w, []])
            entry[0] = max(entry[0], score)
            for f in order:
                if (i := texts[f].lower().find(w)) >= 0 and (at := (f, C.snippet(texts[f], i, len(w)))) not in entry[2]:
                    entry[2].append(at)
    for known in config.known_terms:
        forms = [x.lower() for x in (known.term, *known.variants)]
        if not (taken := [k for k in found if any(x in k for x in forms)]):
            continue
        places, score = {}, 0
        for k in sorted(taken, key=lambda k: (-found[k][0], k)):
            s, _, at = found.pop(k)
            score = max(score, s)
            for f, c in at:
                places.setdefault(f, c)
        found[known.term.lower()] = [score, known.term, list(places.items())]
    keep = {k: v for k, v in found.items() if len({f for f, _ in v[2]}) / len(texts) <= config.max_doc_pct and not any(x in v[1] for x in config.exclude.terms)}
    best = sorted(keep, key=lambda k: (-keep[k][0], k))[: config.max_candidates]
    return {keep[k][1]: (round(keep[k][0], 9), keep[k][2]) for k in best}


def test_extraction_equals_a_plain_account(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "file string, prose string").repartition(5)
    configs = [
        ExtractConfig(max_doc_pct=1.0),
        ExtractConfig(max_doc_pct=0.4, max_candidates=12),
        ExtractConfig(max_doc_pct=0.9, known_terms=[KnownTerm("Kettle goods", ["kettle"]), KnownTerm("Tea", ["tea leaf"]), KnownTerm("absent thing", [])], exclude=ExcludeConfig(["steam"])),
    ]
    for config in configs:
        rows = C.extract(docs, config, STOP).collect()
        got = {r.term: (round(r.score, 9), [(x.file, x.context) for x in r.locations]) for r in rows}
        assert got == plain_extract(texts, config) and len(got) == len(rows) > 5
        assert [r.term.lower() for r in rows] == sorted(r.term.lower() for r in rows)


def test_later_entries_take_up_what_earlier_ones_made(spark):
    known = [KnownTerm("tea pot", ["pot"]), KnownTerm("Tea", ["tea "]), KnownTerm("lid", ["cap"])]
    keys = ["copper pot", "tea leaf", "tea", "lidless", "cap", "boil"]
    rows = spark.createDataFrame([(k, 0.1 * i, k, [(f"{j}.md", f"{k}{j}") for j in range(i)]) for i, k in enumerate(keys)], "key string, score double, term string, locations array<struct<file string, context string>>")
    got = {r.term: (round(r.score, 3), [tuple(x) for x in r.locations]) for r in C.consolidate(rows, known).collect()}
    assert got == {
        "Tea": (0.2, [("0.md", "tea0"), ("1.md", "tea1")]),
        "lid": (0.4, [(f"{j}.md", f"cap{j}") for j in range(4)]),
        "boil": (0.5, [(f"{j}.md", f"boil{j}") for j in range(5)]),
    }


def test_many_overlapping_entries_plan_quickly(spark):
    known = [KnownTerm(f"term {i}", [f"{i}", "kettle", f"x{i % 4}"]) for i in range(40)]
    rows = spark.createDataFrame([("kettle 1", 0.5, "kettle 1", [("a.md", "c")])], "key string, score double, term string, locations array<struct<file string, context string>>")
    C.consolidate(rows, known[:2]).explain()
    start = time.perf_counter()
    C.consolidate(rows, known)._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 2


def test_terms_too_large_to_locate_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(C, "TERMS_LIMIT", 10)
    terms = spark.createDataFrame([("kettles",), ("KETTLES",), ("lids",)], "term string")
    docs = spark.createDataFrame([("a", "İ kettles and lids")], "file string, prose string")
    try:
        C.locate(terms, docs)
        raise AssertionError("no error")
    except ValueError as e:
        assert "11 bytes" in str(e)
    monkeypatch.setattr(C, "TERMS_LIMIT", 11)
    assert {(r.key, r.context) for r in C.locate(terms, docs).collect()} == {("kettles", "İ kettles and lids"), ("lids", "İ kettles and lids")}


def test_trimming_equals_the_column_expression(spark):
    from termloom.functions.text import trim_stopwords

    rng = random.Random(2)
    phrases = sorted({" ".join(rng.choice(["The", "a", "kettle", "of", "Lid"]) for _ in range(rng.randrange(1, 5))) for _ in range(80)})
    rows = spark.createDataFrame([(p,) for p in phrases], "p string").select("p", trim_stopwords("p", STOP).alias("t")).collect()
    assert all(r.t == C.trimmed(r.p, set(STOP)) for r in rows)


def test_chains_of_any_depth_and_cycles(spark):
    from termloom.operators.render import glossary_entries, parent_chains

    rows = [(f"t{i}", f"t{i - 1}" if i else None) for i in range(150)] + [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("self", "self"), ("lost", "nowhere"), ("below", "lost")]
    terms = spark.createDataFrame([(t, p, f"of {t}", []) for t, p in rows], "term string, parent string, definition string, see_also array<string>")
    parent = dict(rows)
    want = defaultdict(list)
    for t in parent:
        seen, at = [t], parent[t]
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at)
        want[t] = seen[:0:-1]
    assert {r.term: r.chain for r in parent_chains(terms).collect()} == want
    got = {r.term: (r.path, r.depth) for r in glossary_entries(terms).collect()}
    assert got == {f"t{i}": ([f"t{j}" for j in range(i + 1)], i) for i in range(150)}
