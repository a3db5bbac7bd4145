"""Token ids of whole texts by the tokenizers library, with ids of repeated pieces kept."""

from __future__ import annotations

import json
import os
import re
from array import array

from cadenza.llm.common import WORKER_CACHES

#: White space that a byte-level tokenizer may treat as such beyond plain spaces and line ends.
_RARE_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_LOOSE_STOP = re.compile(r"(?<![A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])[.,]")
_NEXT_TO_SPACE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", " \x0b", "\x0b ", " \x0c", "\x0c ")


def _kinds() -> bytes:
    """What the checks of a text tell apart in Latin-1: letters and digits, stops, spaces, line ends and the like, rare white space, others."""
    out = bytearray(b"-" * 256)
    for c in map(chr, range(256)):
        if c in " .,":
            out[ord(c)] = ord(" " if c == " " else ".")
        elif c in "\n\t\r\x0b\x0c":
            out[ord(c)] = ord("n")
        elif _RARE_SPACE.match(c):
            out[ord(c)] = ord("?")
        elif not _LOOSE_STOP.search(c + "."):
            out[ord(c)] = ord("a")
    return bytes(out)


_KINDS = _kinds()
_NOT_PLAIN = (b"  ", b" n", b"n ", b"?")
_LOOSE = (b" .", b"-.", b"..", b"n.")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to unsigned 32-bit ids in the machine's (little-endian) order.

    A byte-level pre-tokenizer always starts a new word at a space between two other characters
    that are not white space, at a full stop or comma that follows a letter or digit, and around a
    line end between two other characters, so the pieces cut there are encoded on their own and
    their ids joined. Texts where a space touches other white space, or with a special token's string, are
    encoded whole. Up to `keep` pieces stay in memory between calls, those met of late the longest.
    """

    def __init__(self, path: str | None = None, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        # A word alone goes to the model as it is: the byte-level step leaves it in one part.
        self.by_word = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and spec.get("normalizer") is None and spec.get("post_processor") is None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text, None if it is to be encoded whole."""
        if "\x00" in text or any(x in text for x in self.special):
            return None
        try:
            kinds = text.encode("latin-1").translate(_KINDS)
        except UnicodeEncodeError:
            plain, loose = self._plain(text), None
        else:
            plain = kinds[:1] != b" " != kinds[-1:] and not any(x in kinds for x in _NOT_PLAIN)
            loose = kinds[:1] == b"." or any(x in kinds for x in _LOOSE)
        if not plain:
            return None
        t = text.replace(" ", "\x00 ")
        if "\n\n" not in text and not (_LOOSE_STOP.search(t) if loose is None else loose):
            t = t.replace(",", "\x00,").replace(".", "\x00.").replace("\n", "\x00\n\x00")
        return t.split("\x00")

    def _plain(self, text: str) -> bool:
        return (
            not any(x in text for x in _NEXT_TO_SPACE)
            and not (text[:1] == " " or text[-1:] == " ")
            and (text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or not _RARE_SPACE.search(text))
        )

    def _word_ids(self, words: list[str]) -> list[bytes]:
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in _spelled(words)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known, from the older ones or the tokenizer."""
        out: dict[str, bytes] = {}
        if self.older:
            before = list(map(self.older.get, new))
            out = {x: ids for x, ids in zip(new, before, strict=True) if ids is not None}
            new = [x for x, ids in zip(new, before, strict=True) if ids is None]
        if self.by_word:
            words: list[str] = []
            rest: list[str] = []
            for x in new:
                (words if x.removeprefix(" ").isalpha() else rest).append(x)
            if words:
                out.update(zip(words, self._word_ids(words), strict=True))
            new = rest
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            out.update(zip(part, self._ids(part), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces: list[str] = []
        bounds: list[tuple[int, int, int]] = []
        for i, t in enumerate(texts):
            if t and (cut := self._cut(t)) is not None:
                start = len(pieces)
                pieces += cut
                bounds.append((i, start, len(pieces)))
        known = self.known
        ids = list(map(known.get, pieces))
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            known.update(self._learn(list({pieces[k] for k in missing})))
            for k in missing:
                ids[k] = known[pieces[k]]
        out = [b""] * len(texts)
        for i, a, b in bounds:
            out[i] = b"".join(ids[a:b])
        done = {i for i, _, _ in bounds}
        other = [i for i, t in enumerate(texts) if t and i not in done]
        for a in range(0, len(other), 64):
            part = other[a : a + 64]
            for i, own in zip(part, self._ids([texts[i] for i in part]), strict=True):
                out[i] = own
        if len(known) > self.keep // 2:
            self.known, self.older = {"": b""}, known
        return out


def _byte_names() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: those without a visible character, in order, as 256 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_NAMES = _byte_names()


def _spelled(words: list[str]) -> list[str]:
    """Words without line ends as a byte-level vocabulary writes their bytes: a name at a time through all of them, as most do not occur."""
    text = "\n".join(words).encode().decode("latin-1")
    for b, name in BYTE_NAMES.items():
        if b != 10 and chr(b) in text:
            text = text.replace(chr(b), name)
    return text.split("\n")


_ENCODERS: dict[tuple[str | None, int], Encoder] = {}
WORKER_CACHES.append(_ENCODERS.clear)


def encoder(path: str | None = None, keep: int = 400_000) -> Encoder:
    """One encoder for each Python worker, vocabulary and number of pieces kept."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS[path, keep] = Encoder(path, keep)
    return _ENCODERS[path, keep]
