"""Pre-tokens of a tokenizers file, and a bounded memo.

Where the tokenizer drops white space (a Split that removes what lies between its matches), no pre-token
spans a run of ASCII white space, and neither does its normaliser look across one. Such texts are cut there
first, and each distinct run of other characters ("unit") is pre-tokenized on its own. For any other
tokenizer the whole text is one unit.
"""
from __future__ import annotations

import json
import re
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

DEFAULT = "word_bpe_49k.json"
#: Marks an added token among pre-tokens; byte-level pre-tokens never hold this character.
ADDED = "\x01"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PRINTABLE = re.compile(rb"[\x21-\x7e]+")
_PLAIN = re.compile(rb"[a-z]+")
#: Printable ASCII and the letters of Latin-1: composed already, and lower-cased one by one.
_LATIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def byte_characters() -> dict[int, int]:
    """The byte-level alphabet: a printable byte is its own character, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_BYTES = byte_characters()


def tokenizer_json(path: str | None = None) -> str:
    """The file's content; read on the driver, so that executors need no such file."""
    with open(path or public_tokenizers.path(DEFAULT), encoding="utf-8") as f:
        return f.read()


class Memo:
    """A dict of at most 2 * most entries: when the young half is full, it takes the place of the old."""

    def __init__(self, make, most: int = 200_000):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def __call__(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = got
        return got


class PreTokenizer:
    def __init__(self, content: str):
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_units = plain and kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        # The ASCII short cut below is this pattern over lower-cased printable ASCII.
        self.short = self.by_units and parts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.find_added = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        if not self.by_units and not plain:
            raise ValueError("added tokens that strip, match single words or are normalised aren't supported")

    def units(self, text: bytes) -> list[bytes]:
        return text.split() if self.by_units else [text]

    def of(self, unit: bytes) -> tuple[str, ...]:
        """The unit's pre-tokens as the model gets them; an added token is ADDED and its content."""
        if self.short:
            if _PLAIN.fullmatch(unit):
                return (unit.decode(),)
            if b"<|" not in unit and _PRINTABLE.fullmatch(unit):
                return tuple(_ASCII.findall(unit.decode().lower()))
        text = unit.decode("utf-8")
        if self.short and "<|" not in text and _LATIN.fullmatch(text):
            return tuple([p.encode().decode("latin-1").translate(_BYTES) for p in _LATIN_PARTS.findall(text.lower())])
        out: list[str] = []
        at = 0
        for m in self.find_added.finditer(text) if self.find_added else ():
            out += self._plain(text[at : m.start()]) + [ADDED + m[0]]
            at = m.end()
        return tuple(out + self._plain(text[at:]))

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        norm = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)] if self.library.pre_tokenizer else [norm]

    def pieces(self, pretoken: str) -> int:
        """How many tokens the model makes of a pre-token."""
        return 1 if pretoken[:1] == ADDED else len(self.library.model.tokenize(pretoken))


@lru_cache(maxsize=2)
def shared_pretokenizer(content: str) -> PreTokenizer:
    """One per Python worker."""
    return PreTokenizer(content)
