"""BPE against the tokenizers library."""

import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reliefsignals.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "A", "It's WE'LL they'd 'SS ''s", "ΑΣ ΣΑΣ. İstanbul ǅ", "é é ﬁ 漢字 한국 ½²٣ 12345", "a\x1c\x85　b​",
    "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "e<|endoftext|>́", "!" * 5000 + "?!" * 3000, "ab" * 4000, "😀👍🏽 näive",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def ids(packed):
    return list(memoryview(packed).cast("I"))


def agrees(vocabulary, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    return ids(vocabulary.encode(text)) == want and vocabulary.decode(vocabulary.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_that_both_tables_know(vocabulary, library):
    old = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    for start in range(0, len(old), 500):
        block = old[start : start + 500]
        if not agrees(vocabulary, library, " ".join(f"a{c}b {c}{c}" for c in block)):
            assert not [hex(ord(c)) for c in block if not agrees(vocabulary, library, f"a{c}b {c}{c}")]


def test_random_and_odd_texts(vocabulary, library):
    rng = random.Random(4)
    signs = ["a", "A", "b", "s", "'", "t", "re", "ll", " ", "Σ", "İ", "é", "é", "漢", "😀", "1", "½", "\n", "\xa0", "!", "?.", "the", "tion", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choices(signs, k=rng.randrange(80))) for _ in range(2000)]
    assert [t for t in texts if not agrees(vocabulary, library, t)] == []


def test_forgetting_words_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    assert all(agrees(vocabulary, library, f"one two three four {i}") for i in range(20))


def test_stale_entries_are_skipped():
    """Hand-made merges: bc goes first, which makes the queued ab and cd stale."""
    symbols = bpe.byte_symbols()
    vocab = {s: i for i, s in enumerate(symbols)} | {s + "$": 256 + i for i, s in enumerate(symbols)} | {"bc": 600, "ab": 601, "cd$": 602, "abc": 603}
    import json

    merges = [["b", "c"], ["a", "b"], ["c", "d$"], ["a", "bc"]]
    one = bpe.Vocabulary(json.dumps({"added_tokens": [], "decoder": None, "model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "$"}}))
    assert [one.strings[i] for i in one.merged("abcd")] == ["abc", "d$"]
    assert [one.strings[i] for i in one.merged("abab")] == ["ab", "a", "b$"]


def test_digests_of_a_table(spark, library):
    texts = [None, *ODD]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    found = {r.doc_id: r for r in bpe.digests(spark, rows, PATH).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in want)
        decoded = library.decode(want, skip_special_tokens=False)
        assert found[i].n_tokens == len(want)
        assert found[i].ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_and_decode_are_columns(spark):
    encode, decode = bpe.codec(spark, PATH)
    row = spark.createDataFrame([("Hello there, world",)], "t string").select(decode(encode("t")).alias("d"), F.octet_length(encode("t")).alias("n")).first()
    assert row.d == "hello</w> there</w> ,</w> world</w>" and row.n == 16
