import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from termloom.llm import bpe
from termloom.llm.perfect_hash import PerfectHash
from termloom.llm.queries import RANKS, op1_byte_bpe

PATH = public_tokenizers.path(RANKS)
TEXTS = [
    None, "", " ", "  ", "   a", "a  b", "a   b  ", "a\n b", "a \n b", "a \nb", "\n\n  x", "don't we'll I'M", "x" * 5000, "é" * 700,
    "naïve café 12345 ½ ²", "日本語のテキスト", "a b c", "tab\tand\x1cfs", "🙂 ok 🙂🙂", "The quick brown fox.\nJumps, over!! the lazy dog", "word " * 3000, "<|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [f"key{i}".encode() for i in range(5000)]
    h = PerfectHash(keys, list(range(5000)))
    assert sorted(h.keys) == sorted(keys)
    assert all(h.get(k) == i for i, k in enumerate(keys))
    assert h.get(b"other") is None
    assert PerfectHash([], []).get(b"x") is None


def test_codec_equals_library(library):
    own = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = [x for x in TEXTS if x] + ["".join(rng.choice("ab é\n  ,.1'sß") for _ in range(rng.randrange(60))) for _ in range(3000)]
    import pyarrow as pa

    all_ids = own.encode_all(pa.array([*texts, None]))
    assert all_ids.to_pylist() == [own.encode(x) for x in [*texts, ""]]
    assert own.decode_all(all_ids).to_pylist() == [x.encode() for x in [*texts, ""]]
    for text in texts:
        ids = library.encode_ordinary(text)
        got = own.encode(text)
        assert got == b"".join(i.to_bytes(4, "little") for i in ids), text
        assert own.decode(got) == text.encode()


OTHER_PATTERNS = [r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+", r"\p{L}+ \p{L}+|.|\s"]


@pytest.mark.parametrize("pattern", [*bpe.SPACE_LED, *OTHER_PATTERNS])
def test_any_vocabulary_and_pattern(pattern):
    """White space of several bytes is in this vocabulary, so a cut in the wrong place gives other ids."""
    import pyarrow as pa

    more = [b"\n ", b" \n", b"  ", b" a", b"ab", b" ab", b"a b", b"\n\n", b"\t ", "\u00a0 ".encode(), " \u2003".encode(), b"\x1c ", b" \x1c", b"b a", b" .", b"\r\n"]
    tokens = [bytes([i]) for i in range(256)] + more + [" \u00a0".encode()[:2]]
    data = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(dict.fromkeys(tokens)))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(data, pattern)
    rng = random.Random(len(pattern))
    texts = ["a\n \nb", " ", "a ", " a", "a \u00a0b", "\x85 a\x85"] + ["".join(rng.choice("aabb1.   \n\n\t\r'é\u00a0\u2003\x85\x1c\x0b") for _ in range(rng.randrange(25))) for _ in range(4000)]
    want = [b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(x)) for x in texts]
    assert [own.encode(x) for x in texts] == want
    assert own.encode_all(pa.array(texts)).to_pylist() == want
    assert own.decode_all(own.encode_all(pa.array(texts))).to_pylist() == [x.encode() for x in texts]


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "TOKENS_KEPT", 50)
    monkeypatch.setattr(bpe, "PIECES_KEPT", 50)
    own = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    assert own.decode(own.encode(text := " ".join(f"w{i}x" for i in range(1000)))) == text.encode()
    assert max(map(len, (own.tokens.young, own.tokens.old, own.pieces.young, own.pieces.old))) <= 50


def test_nulls_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(i, x, "old") for i, x in enumerate(TEXTS)], "doc_id long, text string, token_ids string")
    done = bpe.decode(bpe.encode(rows, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in done.collect()}
    assert len(got) == len(TEXTS)
    assert all(bytes(got[i].decoded) == (x or "").encode() for i, x in enumerate(TEXTS))
    assert bpe.encode(rows.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op1_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
