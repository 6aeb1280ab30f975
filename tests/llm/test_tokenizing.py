"""Ids of the word tokenizer against the library itself, over all code points and mixed texts."""

import unicodedata
import zlib

import numpy as np
import pytest

path = pytest.importorskip("public_tokenizers").path


@pytest.fixture(scope="module")
def tok():
    from affinigraph.llm.tokenizing import word_tokenizer

    return word_tokenizer(path("word_bpe_49k.json"))


def told(tok, text):
    return np.frombuffer(tok.encode(text.encode()), "<u4").tolist()


def library(tok, text):
    return tok.full.encode(text, add_special_tokens=False).ids


def test_every_code_point(tok):
    """U+0000 to U+2FFFF between letters, digits and spaces."""
    wrong = []
    for c in range(0x30000):
        if not 0xD800 <= c <= 0xDFFF:
            text = f"a{chr(c)}b {chr(c)} 1{chr(c)}É"
            if told(tok, text) != library(tok, text):
                wrong.append(hex(c))
    assert not wrong


def test_mixed_texts(tok):
    rng = np.random.default_rng(5)
    pools = [[chr(c) for c in range(0x80)], list("aeiouAEÓ̧̈   ÄÖσΣİıß"), [chr(c) for c in range(0x1100, 0x1200)] + ["가", "각"], [chr(c) for c in range(0xA0, 0x600)], ["😀", "‍", "️", "中", "　", "\x85", "\x1c", "\x1f"]]
    for _ in range(3000):
        text = "".join(rng.choice(pools[rng.integers(5)]) for _ in range(rng.integers(1, 30)))
        assert told(tok, text) == library(tok, text), text.encode("unicode_escape")
    assert unicodedata.normalize("NFC", "É") == "É"


def test_packed_ids_of_control_characters(spark, tok):
    """Through the operator: pieces, counts and checksums of texts with control characters and odd spaces."""
    from affinigraph.llm.packing import pack

    texts = ["a\0b", "tab\1le \x7f", "x\x1d \x1f y", "Å\x00 ǅ\x85z", "\x1c", "one\x0btwo\x0cthree", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pack(docs, path("word_bpe_49k.json"), end_id=2, window=4096).collect()}
    for i, text in enumerate(texts):
        want = np.array([*library(tok, text or ""), 2], "<u4")
        assert (got[i].doc_tokens, got[i].ids_crc32) == (len(want), zlib.crc32(want.tobytes())), text
