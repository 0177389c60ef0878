"""Fast exact encoding of short pieces of text with the vocabularies of public tokenizer files.

``tokenizers`` spends most of its time on alignment that token counts and ids don't need.  Both vocabularies
here merge by rank, so ``tiktoken``'s merge loop gives the same ids; pieces with any character whose case,
normal form or class might be treated differently go to ``tokenizers`` itself (see the tests).
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

#: Printable ASCII and Latin letters: what both libraries treat alike.
PLAIN = re.compile("[!-~¡-¬®-ɏ]+")
PLAIN_TEXT = re.compile("[\n -~¡-¬®-ɏ]*")
#: Stands behind the last letter of a word; no byte of UTF-8.
END = b"\xff"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the rest are numbered from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Library:
    """Ids by ``tokenizers`` itself; the special strings inside a text are handled as its default."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class ByteBpe:
    """Byte-level BPE whose pre-tokens may begin with a space."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        self.library = Library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        values = byte_values()
        ranks = {bytes(values[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("byte", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def count(self, text: str) -> int:
        if PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            return len(self.core.encode_ordinary(text))
        return len(self.library.ids(text))


class WordBpe:
    """BPE over lower-cased words with an end mark; white space only separates words."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        self.library = Library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        values = byte_values()
        ranks = {}
        for token, n in spec["model"]["vocab"].items():
            if token not in special:
                stem = token.removesuffix("</w>")
                ranks[bytes(values[c] for c in stem) + (END if stem != token else b"")] = n
        # The mark alone is no token of the vocabulary, but the merge loop wants every byte to have a rank.
        ranks[END] = 1 + max(ranks.values())
        self.core = tiktoken.Encoding("word", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def ids(self, chunk: str) -> list[int]:
        """Of a text without white space, as anywhere in a longer text between white space."""
        if not PLAIN.fullmatch(chunk) or "<|" in chunk:
            return self.library.ids(chunk)
        found: list[int] = []
        for word in self.words.findall(unicodedata.normalize("NFC", chunk).lower()):
            found += self.core.encode_single_piece(word.encode() + END)
        return found

    def packed(self, chunk: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        made = array("I", self.ids(chunk.decode("utf-8", "replace")))
        return made.tobytes()


#: Bytes of a piece that a cache keeps at most, so that its entries bound its memory.
KEPT = 64


class Cache(dict):
    """A worker's cache: ``make`` gives what is missing; over ``limit`` entries it starts again from ``base``."""

    def __init__(self, make, base: dict | None = None, limit: int = 400_000) -> None:
        super().__init__(base or {})
        self.make, self.base, self.limit = make, base or {}, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= KEPT:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.base)
            self[key] = value
        return value
