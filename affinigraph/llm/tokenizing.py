"""Whole-text tokenization with public vocabularies, at the speed of a dictionary look-up for known words."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: The longest a cache grows before it starts anew; bounds a worker's memory at about 250 MB.
CACHE_ENTRIES = 500_000

#: The word-splitting rule and normalisation of the word-end BPE vocabulary, as its file states them.
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PLAIN = re.compile(rb"[!-~]+")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable, else the next free code point from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    """Ids of a ``tokenizers`` vocabulary that drops white space.

    No token of such a vocabulary crosses white space, so ids are kept for each chunk between ASCII white space. A chunk of
    printable ASCII, or with characters that the library was seen to lower and to part as the rule here does, is split here;
    any other goes through the library. So do, whole, texts that name a special token, and vocabularies of another make.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        self.fast = [n["type"] for n in norm.get("normalizers", [])] == _NORMALIZERS and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == _WORD_RULE and steps[1]["type"] == "ByteLevel"
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        if self.fast:
            import regex

            self.rule = regex.compile(_WORD_RULE)
            self.ascii_rule = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
            self.safe: dict[str, bool] = {}
            self.letters = _byte_letters()
            self.model = self.full.model
            self.chunks: dict[bytes, bytes] = {}
            self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            spelled = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        return ids

    def _is_safe(self, c: str) -> bool:
        """Whether a character is a letter, number, sign or mark of punctuation that composes with none before it, and that
        the library lowers and parts from its neighbours as the rule here does (their versions of Unicode may differ)."""
        ok = self.safe.get(c)
        if ok is None:
            ok = unicodedata.category(c)[0] in "LNPS" and c not in "Σİ" and not "\u1100" <= c <= "\u11ff"
            low = unicodedata.normalize("NFC", c).lower()
            ok = ok and self.full.normalizer.normalize_str(c) == low
            if ok:
                around = f"a{low}a {low} 1{low}1 !{low}!"
                told = [around[i:j] for _, (i, j) in self.full.pre_tokenizer.pre_tokenize_str(around)]
                ok = told == [x for w in around.split(" ") for x in self.rule.findall(w)]
            self.safe[c] = ok
        return ok

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _PLAIN.fullmatch(chunk):
            found = self.ascii_rule.findall(text.lower())
        elif len(text) <= 10_000 and all(" " < c < "\x7f" or self._is_safe(c) for c in set(text)):
            found = self.rule.findall(unicodedata.normalize("NFC", text).lower())
        else:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self._piece(x) for x in found])

    def encode(self, raw: bytes) -> bytes:
        """Little-endian 32-bit ids of a UTF-8 text."""
        if not self.fast or any(s in raw for s in self.special):
            return np.array(self.full.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        chunks, out = self.chunks, []
        for w in raw.split():
            ids = chunks.get(w)
            if ids is None:
                ids = self._chunk(w)
                if len(w) <= 64:
                    if len(chunks) >= CACHE_ENTRIES:
                        chunks.clear()
                    chunks[w] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class ByteTokenizer:
    """Byte-level BPE by ranks; each token's length in bytes gives its place in the text."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(k) for k in ranks]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end byte of each token of the whole text."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        end = np.cumsum(self.lengths[ids])
        return end - self.lengths[ids], end


@lru_cache(maxsize=2)
def byte_tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)
