"""Token ids of whole texts, by the ``tokenizers`` library, with bounded caches of text segments and words.

A byte-level or word-level BPE never merges across the gap before a run of blanks, so a text is cut there and each
distinct segment is encoded once per worker. Segments of plain Latin letters are cut to words by the vocabulary's own
pattern and given to its BPE model; all others, and texts with other Unicode spaces, go through the whole tokenizer.
"""

from __future__ import annotations

import json
import re

CACHE_SEGMENTS, CACHE_WORDS = 500_000, 500_000
_SEGMENT = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+\Z")
_ODD_SPACE = re.compile("[" + "".join(map(chr, (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
_ODD_ASCII = re.compile("[\x0b\x0c\x1c-\x1f]")
#: Letters beyond this are left to the tokenizer, whose Unicode tables may be of another version.
_PLAIN_BELOW = "ɐ"
_ODD_PLAIN = re.compile(f"[\x0b\x0c\x1c-\x1f\x85\xa0{_PLAIN_BELOW}-\U0010ffff]")
#: The word patterns of byte-level BPE, with and without blanks.
_BLANK_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BARE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOADED: dict[str, SegmentEncoder] = {}


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself where printable, else the next free code from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Cache(dict):
    """Computes what is missing; empties itself when full."""

    def __init__(self, most: int, make):
        self.most, self.make = most, make

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class SegmentEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids. Memory is bounded by the two cache sizes."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = pre.get("pretokenizers") or [{}]
        self.keeps_spaces = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not norm
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        self.drops_spaces = (
            pre.get("type") == "Sequence" and (norm or {}).get("normalizers") == known and parts[0].get("pattern", {}).get("Regex") == _BARE_WORDS and parts[0].get("behavior") == "Removed"
        )
        self.words = regex.compile(_BLANK_WORDS if self.keeps_spaces else _BARE_WORDS)
        # _BARE_WORDS for lower-cased plain letters, the most frequent first, in the standard library's faster patterns
        letters, numbers = ("".join(c for c in map(chr, range(ord(_PLAIN_BELOW))) if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}"))
        self.plain_words = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^ \t\r\n{letters}{numbers}]+").findall
        self.special = tuple(t["content"] for t in spec.get("added_tokens") or [])
        self.special_start = re.compile("[" + re.escape("".join({t[0] for t in self.special})) + "]" if self.special else r"(?!)")
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.word_cache = _Cache(CACHE_WORDS, self._word)
        self.cache = _Cache(CACHE_SEGMENTS, self._segment)
        self.after_blank = _Cache(CACHE_SEGMENTS, lambda part: self._segment(" " + part))

        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.newline = self._whole("\n")

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, ids))

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.model.tokenize(shown)])

    def _segment(self, text: str) -> bytes:
        """A run of blanks, if kept, and the characters up to the next."""
        if not text:
            return b""
        bare = text[1:] if text[0] == " " and self.keeps_spaces else text
        if not (text.isascii() or max(text) < _PLAIN_BELOW):
            return self._whole(text)
        raw = text
        if not self.keeps_spaces:
            text = bare = text.lower()
        if bare.isalpha():  # one word, the usual case
            return self.word_cache[text]
        if bare[:-1].isalpha() and bare[-1] in ".,;:!?":
            return self.word_cache[text[:-1]] + self.word_cache[text[-1]]
        if self.special_start.search(raw) and any(s in raw for s in self.special):
            return self._whole(raw)
        return b"".join(map(self.word_cache.__getitem__, self.words.findall(text)))

    def segments(self, text: str) -> list[str] | None:
        if self.drops_spaces:
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if self.keeps_spaces and not (_ODD_ASCII if text.isascii() else _ODD_SPACE).search(text):
            return _SEGMENT.findall(text)
        return None

    def _lone_blanks(self, text: str) -> bool:
        """Every space and newline stands alone between other characters, and there is no other blank."""
        return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", "\n\n", " \n", "\n ", "\t", "\r"))

    def _bare_words(self, text: str) -> list[str] | None:
        """Words of a whole text of plain letters, without blanks; distinct words are fewer than distinct segments."""
        if any(s in text for s in self.special):
            return None
        if (_ODD_ASCII if text.isascii() else _ODD_PLAIN).search(text):
            return None
        return self.plain_words(text.lower())

    def _text(self, text: str) -> bytes:
        words = self._bare_words(text) if self.drops_spaces else None
        if words is not None:
            return b"".join(map(self.word_cache.__getitem__, words))
        segs = self.segments(text) if self.drops_spaces else None
        if segs is None and self.keeps_spaces and self._lone_blanks(text) and not (_ODD_ASCII if text.isascii() else _ODD_SPACE).search(text):
            first, after, out = self.cache.__getitem__, self.after_blank.__getitem__, []
            for line in text.split("\n"):
                parts = line.split(" ")
                out.append(first(parts[0]) + b"".join(map(after, parts[1:])))
            return self.newline.join(out)
        segs = self.segments(text) if segs is None else segs
        return self._whole(text) if segs is None else b"".join(map(self.cache.__getitem__, segs))

    def forget(self) -> None:
        """Give the caches' memory back, where a worker goes on to other work."""
        for cache in (self.cache, self.after_blank, self.word_cache):
            cache.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._text(t) for t in texts]


def encoder(path: str) -> SegmentEncoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = SegmentEncoder(path)
    return _LOADED[path]


def groups_of(texts: list[str], chars: int = 4_000_000):
    """Slices of a batch that hold about ``chars`` characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
