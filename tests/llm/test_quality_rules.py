import re
from collections import Counter

from tests.llm.helpers import same
from termloom.llm import quality_rules as qr
from termloom.llm.queries import OP5_SQL, op5_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


CASES = [None, "", " \n\t", "a", "a b c", "a a a a", "a b c a b c", "x\ny\nx\n\n\nx ", "é è\x85é # * $", "a b c d " * 5000, "word\x0bword\x0c\rw", "# | <>\n# | <>\n"]


def test_counts_equal_brute_force():
    for text in CASES:
        got = qr.stats_of(text)
        assert (got[0], got[1], got[2], got[4], got[5]) == brute(text), text


def test_query_on_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_quality_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_prior_shrinks_small_hosts():
    mean, strength = qr.beta_prior(1000, 200, 10, 1000 * 0.2**2)
    assert mean == 0.2 and strength == 1000  # no spread beyond chance
    _, strength = qr.beta_prior(1000, 200, 10, 1000 * 0.15)
    assert 1 <= strength < 3
    assert qr.beta_prior(None, None, 0, None) == (0.0, 1.0)
    assert qr.beta_prior(10, 10, 2, 10.0) == (1.0, 10.0)


def test_bad_host_loses_all_and_small_host_is_spared(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good if i % 20 else "# # #", f"h{i % 5}") for i in range(400)] + [(1000 + i, "# # #" if i else good, "bad") for i in range(60)] + [(2000, None, None), (2001, "# #", "tiny"), (2002, good, "tiny")]
    got = {r.doc_id: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    assert got[1000].host_rejected and not got[1000].kept and not got[1000].base_failed
    assert got[2002].kept and not got[2001].kept and not got[2000].kept


def test_empty_table_and_hosts_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(qr, "HOSTS_BROADCAST", 0)
    rows = spark.createDataFrame([(1, "a", None, "x"), (2, None, "h", "y")], "doc_id long, text string, source string, host_rate string")
    assert qr.quality_rules(rows).count() == 2
    assert qr.quality_rules(rows.limit(0)).count() == 0


def test_query_equals_sql(spark):
    assert same(spark, op5_quality_rules, OP5_SQL) == 200
