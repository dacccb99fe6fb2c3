import hashlib
import random
import re

from tests.llm.helpers import same
from termloom.llm import pii
from termloom.llm.queries import ORACLES, op10_pii, pii_rules

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    found = []
    for kind in pii.RULED:
        for m in re.finditer(SHAPES[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), pii.KINDS.index(kind), m.end(), kind))
    return sorted(found)


def texts():
    rng = random.Random(10)
    made = [
        None, "", " ", "a@b.c", "x a@b.c.d, e@f.g@h.i", "a@b.cx%y@d.e", "é 1.2.3.4 256.1.1.1 001.0002.003.4 1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111x",
        "41111111111111111111111", "+1 (487) 555-7209.", "+12 34", "++1 234 567 890+1 222 333 4444", "🙂 a@b.co 🙂 +1 (487) 555-7209", "1" * 50_000, "a" * 50_000 + "@", "1.2.3." * 300, "a@b.c " * 200,
        "99999999999.1.1.1", "0000000000001.2.3.4", "1 2 3 4 5 6 7 8 9 0 1 2",
    ]
    return made + ["".join(rng.choice("01234567 -.+()@ab\né") for _ in range(rng.randrange(80))) for _ in range(400)]


def test_rules_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i] == brute(text), text


def test_rules_equal_sql(spark):
    assert same(spark, pii_rules, ORACLES["pii_rules"], "/root/testdata/sf0.01") == 1000


def test_query_on_all_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in pii.RULED]
        spans = [x for x in r.spans.split(",") if x]
        assert set(filter(None, said.split(","))) <= set(spans) and r.n_spans == len(spans) == len(want) + r.n_extra
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)


FILLER = [(1000 + i, f"plain words the report of day{chr(97 + i % 26)} is long and the end is near by the sea " * 4, "x") for i in range(60)]


def found(spark, rows):
    return {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()}


def test_contexts_discover_what_no_rule_knows(spark):
    rows = [(i, f"word{i} my email is user{i}@mail.example.com thanks", "x") for i in range(10)]
    rows += [(100, "well my email is jane55555@intranet now", "x"), (101, "we sold 123456 units", "x"), (102, "the number 987654", "x"), (103, None, "x"), (104, "", "x"), (3, rows[3][1], "x")]
    got = found(spark, rows + FILLER)
    assert [(x.kind, x.start, x.end) for x in got[100].extra] == [("email", 17, 35)]
    assert not got[101].extra and not got[102].extra and not got[103].spans and not got[104].spans
    assert len(got[3].base) == 1 and not got[3].extra


def test_many_unseen_identifiers_do_not_undo_a_pattern(spark):
    rows = [(i, f"x{i} email is user{i}@mail.example.com end", "x") for i in range(70)] + [(100 + i, f"x{i} email is user{i}xyz12345@intranet end", "x") for i in range(30)]
    got = found(spark, rows + FILLER)
    assert all([x.kind for x in got[100 + i].extra] == ["email"] for i in range(30))


def test_words_of_all_kinds_and_common_words_say_nothing(spark):
    mixed = ["a{i}@mail.example.com", "10.1.{i}.9", "+1 (487) 555-72{i:02}"]
    rows = [(i, f"then see {mixed[i % 3].format(i=i)} here", "x") for i in range(30)] + [(200, "then see bob77777@host here", "x"), (201, "then see 5551234567 here", "x")]
    rows += [(300 + i, f"the +1 (487) 555-72{i:02} rang", "x") for i in range(8)] + [(400, "the 5559876543 units", "x")]
    got = found(spark, rows + FILLER)
    assert not got[200].extra and not got[201].extra and not got[400].extra


def test_secrets_seed_and_discover_secrets(spark):
    rows = [(i, f'cfg{i} token = "{hashlib.sha1(bytes([i])).hexdigest()}"; go', "x") for i in range(8)]
    rows += [(50, 'other token = "sk_live_9f3kd02mxyzq8812" done', "x"), (51, 'version = "1.2.3-beta4" done', "x"), (52, "TOKEN = \"" + hashlib.sha1(b"up").hexdigest().upper() + '"!!', "x")]
    got = found(spark, rows + FILLER)
    text = rows[8][1]
    assert [(x.kind, text[x.start : x.end]) for x in got[50].extra] == [("secret", "sk_live_9f3kd02mxyzq8812")]
    assert all([x.kind for x in got[i].extra] == ["secret"] and got[i].extra[0].end - got[i].extra[0].start == 40 for i in (*range(8), 52))
    assert not got[51].extra


def test_failed_check_digits_are_no_cards(spark):
    good = [n for n in range(4000_0000_0000_0000, 4000_0000_0000_0200) if luhn(str(n))]
    bad = [n for n in range(4000_0000_0000_0000, 4000_0000_0000_0200) if not luhn(str(n))]
    rows = [(i, f"w{i} card number {n} x", "x") for i, n in enumerate(good)] + [(500 + i, f"w{i} card number {n} x", "x") for i, n in enumerate(bad[:5])] + [(600, f"card number {good[0]} {good[1]} x", "x")]
    got = found(spark, rows + FILLER)
    assert not any(got[500 + i].spans for i in range(5))
    assert [(x.kind, x.start, x.end) for x in got[600].extra] == [("card", 12, 28), ("card", 29, 45)]  # one run of 32 digits to the rule


def test_scores_equal_brute_force(spark):
    rng = random.Random(4)
    tokens = {f"t{i}": rng.choice([None, None, "email", "phone", "ip"]) for i in range(60)}
    fits = {t: rng.sample(["email", "phone", "ip"], rng.randrange(4)) for t in tokens}
    links = {(rng.choice(["L a", "L b", "LL a b", "R c", "S n9", "S a@a"]), rng.choice(list(tokens))) for _ in range(260)}
    words = {"L a": ["a"], "L b": ["b"], "LL a b": ["a", "b"], "R c": ["c"], "S n9": [], "S a@a": []}
    texts = [("a " * 40 + "b " * 3 + "c " * 25 + "z " * 900,), (None,), ("",)]
    edges = spark.createDataFrame([(p, words[p], t, tokens[t], fits[t]) for p, t in links], "pattern string, words array<string>, token string, kind string, fits array<string>")
    belief = {t: k for t, k in tokens.items() if k}
    known = spark.createDataFrame([(t, k, 1.0) for t, k in belief.items()], "token string, kind string, belief double")
    counts = {"a": 40, "b": 3, "c": 25}
    heard = pii.occurrences(edges, spark.createDataFrame(texts, "text string"))
    assert {(r.pattern, r.times, r.total) for r in heard.collect()} == {(p, min(counts[w] for w in ws), 968) for p, ws in words.items() if ws}
    want = {}
    for p, ws in words.items():
        own = {t for q, t in links if q == p}
        for kind in ("email", "phone", "ip"):
            mass = sum(belief.get(t) == kind for t in own)
            open_ = sum(t not in belief and kind in fits[t] for t in own)
            every = sum(t in belief for t in own)
            lift = mass * 968 / min(counts[w] for w in ws) / sum(k == kind for k in belief.values()) if ws else pii.LIFT
            if mass >= pii.SUPPORT and lift >= pii.LIFT:
                want[p, kind] = (mass, round(mass / (every + pii.UNKNOWN * open_ + pii.DOUBT), 9))
    scored = pii.pattern_scores(edges, known, heard)
    assert {(r.pattern, r.kind): (r.mass, round(r.trust, 9)) for r in scored.collect()} == want and want
    sure = {x: t for x, (_, t) in want.items()}
    best = {}
    for t in tokens:
        chances = {}
        for k in fits[t] if t not in belief else ():
            trusts = [sure[p, k] for p, u in links if u == t and (p, k) in sure]
            if trusts:
                miss = 1.0
                for x in trusts:
                    miss *= 1 - min(x, 0.999)
                chances[k] = 1 - miss
        if chances:
            best[t] = max((round(c, 6), k) for k, c in chances.items())
    told = pii.instance_scores(edges, scored.select("pattern", "kind", "trust"))
    assert {r.token: (round(r.confidence, 6), r.kind) for r in told.collect()} == best and best


def test_hidden_seeds_are_found_again(spark):
    rows = pii.hidden_seeds(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    assert {r.kind for r in rows} == set(pii.KINDS)
    assert all(r.hidden >= 20 and r.found >= 0.9 * r.hidden and r.found >= 0.9 * r.claimed for r in rows)


def test_empty_table_and_no_python_in_the_plan(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    plan = op10_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
