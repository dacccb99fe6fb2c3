import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import keywords
from termloom.operators.keywords import yake


@pytest.fixture(scope="module")
def value(spark):
    def get(expr, **columns):
        df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
        return df.select(expr.alias("v")).first().v

    return get


def test_tokens(value):
    assert value(T.tokens("x", ["das"]), x="Das well-worn Seil, m3 — é\u00a0x das") == ["wellworn", "seil", "m3", "é"]
    assert value(T.tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("term,want", [("the Copper kettle", "Copper kettle"), ("kettle is", "kettle"), ("of the kettle is", "kettle"), ("kettle", "kettle"), ("of the is", "of the is"), ("spout of kettle", "spout of kettle")])
def test_trim(value, term, want):
    assert value(T.trim_stopwords("x", ["the", "is", "of"]), x=term) == want


def test_context(value):
    long = "before " * 30 + "A Copper kettle stands there " + "behind " * 30
    got = value(T.context("x", F.lit("copper")), x=long)
    assert "Copper kettle" in got and got.startswith("before") and len(got) <= 126
    assert value(T.context("x", F.lit("missing")), x=long) is None
    assert value(T.context("x", F.lit("é🙂")), x="aé🙂b") == "aé🙂b"


def test_byte_offset(value):
    assert value(T.byte_offset_after("x", F.lit("Kettle")), x="Kettle stands") == 6
    assert value(T.byte_offset_after("x", F.lit("Kettle")), x="A kettle stands") == 8
    assert value(T.byte_offset_after("x", F.lit("lid")), x="é lid") == 6
    assert value(T.byte_offset_after("x", F.lit("no")), x="abc") is None


def test_aliases(value):
    assert value(T.alias_forms("x"), x="Copper kettle lids") == ["kettle lids", "lids", "Copper kettle", "Copper", "Copper kettle lid"]
    assert value(T.alias_forms("x"), x="lid") == ["lids"]
    assert value(T.suggest_alias("x", F.lit("Copper Kettle")), x="an old kettle") == "Kettle"


def test_labels_and_markers(value):
    assert value(T.term_label("x"), x="Kettle 1.5!") == "term-kettle-1-5"
    assert value(T.term_label("x"), x="@x") == "term--x"
    assert value(T.marker(F.lit("t"), F.array().cast("array<string>"), F.lit(False))) == "#index[t]"
    assert value(T.marker(F.lit("t"), F.array(F.lit("p"), F.lit("q")), F.lit(True))) == '#index-main("p", "q", "t")'
    assert value(T.escape_markup("x"), x="a@b #c <d> $e _f* g") == r"a\@b \#c \<d> \$e \_f\* g"
    assert value(T.see_also(F.array(F.lit("A b")))) == " _See also: #link(<term-a-b>)[A b]_"


def test_paths(value):
    assert value(T.path_ends_with(F.lit("notes/tea.md"), F.lit("tea.md"))) and not value(T.path_ends_with(F.lit("green-tea.md"), F.lit("tea.md")))


def test_yake():
    text = "Madder is a plant for dyeing. The Madder plant gives red roots. Red roots are ground finely. Madder growers dry roots."
    got = yake(text)
    assert got and any("madder" in t.lower() for t, _ in got) and all(0 <= s <= 1 for _, s in got)
    assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
    assert yake("") == [] and yake("the of and") == [] and [s for _, s in yake("Indigo")] == [0.0]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_likeness_equals_plain_edit_distances():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (5, 11, 12, 20, 21, 30, 45)]
    keys = []
    for b in base:
        for _ in range(40):
            x = list(b)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "y"])
            keys.append("".join(x) or "q")
    for similar in (0.9, 0.8):
        for k in keys:
            others = {}
            for o in keys[::3]:
                if o != k:
                    others.setdefault(len(o), []).append(o)
            want = any(1 - plain_distance(k, o) / max(len(k), len(o)) > similar for os in others.values() for o in os)
            assert keywords._has_like(k, others, similar) == want
