"""Secret scans with a recursive decoding worklist.

A text is a layer. From each layer further layers are unwrapped: percent escapes, Unicode and
character escapes, base64 runs (also wrapped over lines, or with other characters of the alphabet
before or behind them), and compressed data inside those. New layers join the worklist
until there are none; a layer whose content has been seen before is not taken again, so the
worklist ends even for data that unpacks to itself. Every layer is scanned with the same patterns,
and each finding is mapped back to the span of the text that it was decoded from.

Kinds, each leftmost and without overlaps: `assign` (a name such as password or token, a sign, and
a value of 6 or more characters), `access` (AKIA key ids of 20 or more) and `hex` (24 or more lower-case
hex digits). Spans count code points, the end exclusive.

Null texts are empty. Compressed data is read to its end, member by member, as a stream of parts of
about PART characters, each of which is a layer; so memory does not grow with what it unpacks to, and
time does. Parts end where no finding, escape or base64 run can cross. Where a run goes on for a whole
part, or data asks for a larger window than WINDOW bytes, it cannot be read whole: `n_unread` counts
such payloads, and redaction takes the whole payload. A layer knows its place in the layer that it
comes from by segments, not by character. Chains of escapes inside escapes beyond CHAIN levels are
taken to their end at once.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from io import BytesIO
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import small_batches, texts_of

KINDS = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_unread long"
#: Characters of unpacked data that are a layer, bytes read at once, and the largest window of compressed data.
PART, READ, WINDOW = 1 << 20, 1 << 16, 1 << 26
CHAIN = 16

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Every assignment holds one of these, whatever the case of its letters.
_NAMES = (b"passw", b"secret", b"token", b"api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|(&#[^;]+;)")
#: An escape at the end of what has been read, and the most characters of one.
_ENDS = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)\Z")
_LONGEST = 10
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs on lines of their own, the last of which may be short.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+=*")
#: Characters that no finding, escape or run goes across.
_BREAK = re.compile(r"[^A-Za-z0-9+/_=.:'\"%\\&#;{} \t\r\n-]")
#: Readable text, of the length of the shortest finding at least.
_STRETCH = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]{12,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_PACKED = re.compile(r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")

Span = tuple[str, int, int]


class Unreadable(Exception):
    """Compressed data that cannot be read within the bounds of memory."""


def scan(text: str) -> list[Span]:
    """Findings of one layer."""
    out: list[Span] = []
    low = text.encode(errors="replace").lower()
    if any(n in low for n in _NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


@dataclass
class Layer:
    """Decoded text, and where it comes from in the layer that it was unwrapped from.

    Segment k begins at starts[k]; character i of it comes from width characters beginning at
    begin + (i - starts[k]) * width, or, with a width of 0, from all of begin to end.
    """

    text: str
    parent: Layer | None = None
    starts: list[int] = field(default_factory=list)
    segments: list[tuple[int, int, int]] = field(default_factory=list)  # begin, end, width
    chain: int = 0  # levels of escapes above

    def _place(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.starts, i) - 1
        begin, end, width = self.segments[k]
        return (begin + (i - self.starts[k]) * width, begin + (i - self.starts[k] + 1) * width) if width else (begin, end)

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that characters start to end come from."""
        layer: Layer = self
        while layer.parent is not None:
            start, end = layer._place(start)[0], layer._place(end - 1)[1]
            layer = layer.parent
        return start, end


def _within(layer: Layer, text: str, a: int, b: int) -> Layer:
    """A layer all of which comes from characters a to b."""
    return Layer(text, layer, [0], [(a, b, 0)])


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[str], list[tuple[str, int, int]]]) -> Layer | None:
    """The layer with every match decoded; decode gives (text, characters of the match behind it, and those behind each of its characters, or 0)."""
    parts: list[str] = []
    starts: list[int] = []
    segments: list[tuple[int, int, int]] = []
    at = n = 0

    def add(text: str, begin: int, end: int, width: int) -> None:
        nonlocal n
        if text:
            parts.append(text)
            starts.append(n)
            segments.append((begin, end, width))
            n += len(text)

    for m in pattern.finditer(layer.text):
        add(layer.text[at : m.start()], at, m.start(), 1)
        k = m.start()
        for text, size, width in decode(m.group()):
            add(text, k, k + size, width)
            k += size
        at = m.end()
    if not at:
        return None
    add(layer.text[at:], at, len(layer.text), 1)
    return Layer("".join(parts), layer, starts, segments, layer.chain + 1)


def _unpercent(run: str) -> list[tuple[str, int, int]]:
    raw = unquote_to_bytes(run)
    if raw.isascii():
        return [(raw.decode(), len(run), 3)]
    try:
        return [(raw.decode(), len(run), 0)]
    except UnicodeDecodeError:
        return [(raw.decode("latin-1"), len(run), 3)]


def _one(m: re.Match) -> str:
    """The character of one escape."""
    if m[3]:
        return html.unescape(m[3])
    code = int(m[1] or m[2], 16)
    return chr(code) if code < 0x110000 else "\ufffd"


def _unescape(run: str) -> list[tuple[str, int, int]]:
    joined: list[tuple[str, int, int]] = []
    for m in _ONE_ESCAPE.finditer(run):
        text, size = _one(m), len(m.group())
        # Two halves of a surrogate pair are one character.
        if joined and len(text) == 1 and "\udc00" <= text <= "\udfff" and len(joined[-1][0]) == 1 and "\ud800" <= joined[-1][0] <= "\udbff":
            high, before, _ = joined.pop()
            joined.append(((high + text).encode("utf-16", "surrogatepass").decode("utf-16"), before + size, 0))
        else:
            joined.append((text, size, 0))
    return joined


def settled(layer: Layer) -> Layer:
    """The layer with escapes decoded until none is left, also those that decoding makes.

    A decoded character is read again behind what comes before it, so each step costs no more than
    the longest escape, however deep the chain is.
    """
    text = layer.text
    chars: list[str] = []
    first, last = array("q"), array("q")
    for i, c in enumerate(text):
        a, b = i, i + 1
        while True:
            chars.append(c)
            first.append(a)
            last.append(b)
            if c not in "0123456789abcdefABCDEF;}" or not (m := _ENDS.search("".join(chars[-_LONGEST:]))):
                break
            n = len(m.group())
            a, b = first[len(first) - n], last[-1]
            del chars[-n:], first[-n:], last[-n:]
            one = m.group()
            c = chr(int(one[1:], 16)) if one[0] == "%" else _one(_ONE_ESCAPE.match(one))
            if len(c) != 1:
                chars.append("\ufffd")
                first.append(a)
                last.append(b)
                break
    starts, segments = [], []
    for k, (a, b) in enumerate(zip(first, last, strict=True)):
        if b - a == 1 and segments and segments[-1][2] == 1 and segments[-1][1] == a:
            segments[-1] = (segments[-1][0], b, 1)
        else:
            starts.append(k)
            segments.append((a, b, 1 if b - a == 1 else 0))
    return Layer("".join(chars), layer, starts, segments)


class _Latin:
    """The bytes of a text from a place to the first character that is none, as a file."""

    def __init__(self, text: str, at: int):
        self.text, self.start, self.at = text, at, at

    def read(self, n: int = READ) -> bytes:
        part = self.text[self.at : self.at + n]
        try:
            raw = part.encode("latin-1")
        except UnicodeEncodeError as e:
            raw = part[: e.start].encode("latin-1")
        self.at += len(raw)
        return raw

    def put_back(self, n: int) -> None:
        self.at -= n


class _Chunks:
    """An iterator of bytes as a file, with what has been looked at put back."""

    def __init__(self, chunks: Iterator[bytes], head: bytes):
        self.chunks, self.head = chunks, head

    def read(self, n: int = READ) -> bytes:
        out = self.head or next(self.chunks, b"")
        self.head = out[n:]
        return out[:n]


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"x" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=WINDOW + (16 << 20))
    return None


def _members(file) -> Iterator[bytes]:
    """What compressed data holds, member after member, in pieces of at most READ bytes; nothing where it is none."""
    size = 256  # most data that only looks compressed shows it early
    data = file.read(size)
    while len(data) > 5:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            try:
                with zstandard.ZstdDecompressor(max_window_size=WINDOW).stream_reader(_Chunks(iter(lambda: file.read(READ), b""), data), read_across_frames=True, closefd=False) as r:
                    while part := r.read(READ):
                        yield part
            except zstandard.ZstdError as e:
                if "memory" in str(e) or "window" in str(e).lower():
                    raise Unreadable from e
            return
        d = _decompressor(data)
        if d is None:
            break
        try:
            while True:
                if part := d.decompress(data, READ):
                    yield part
                if d.eof:
                    break
                data = getattr(d, "unconsumed_tail", b"")
                if not data and getattr(d, "needs_input", True) and not (data := file.read(size := min(READ, 4 * size))):
                    if not part:
                        return
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, MemoryError) as e:
            if "memory" in str(e).lower():
                raise Unreadable from e
            return
        data = d.unused_data
        if len(data) < 6:
            data += file.read(READ)
    if isinstance(file, _Latin):
        file.put_back(len(data))


def _content(file) -> Iterator[bytes]:
    """What compressed data holds in the end; data that is compressed again is unpacked again, unless it has been seen."""
    chunks = _members(file)
    seen: set[bytes] = set()
    while head := next(chunks, b""):
        key = hashlib.blake2b(head, digest_size=16).digest()
        if not _MAGIC.match(head) or key in seen:
            yield head
            yield from chunks
            return
        seen.add(key)
        inner = _members(_Chunks(chunks, head))
        if not (first := next(inner, b"")):
            yield head  # looked compressed, but is not
            yield from chunks
            return
        chunks = _joined(first, inner)


def _joined(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _parts(chunks: Iterator[bytes]) -> Iterator[tuple[str, bool]]:
    """(text, whether a run was cut at its end) of bytes, in parts of about PART characters."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    held: list[str] = []
    n = 0
    for c in chunks:
        held.append(decode(c))
        n += len(held[-1])
        if n < PART:
            continue
        text = "".join(held)
        at = next((m.end() for m in _BREAK.finditer(text[: PART // 2 - 1 : -1])), None)
        cut = len(text) if at is None else len(text) - at + 1
        yield text[:cut], at is None
        # A run that has been cut is taken up a little before.
        held = [text[cut - 4096 if at is None else cut :]]
        n = len(held[0])
    if n:
        yield "".join(held) + decode(b"", True), False


def _readable(raw: bytes) -> str | None:
    """Decoded bytes as text, if they are text."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    plain = sum(map(len, re.findall(r"[\t\n\r\x20-\x7e]+", text)))
    plain += sum(c.isprintable() for c in re.findall(r"[^\x00-\x7f]", text))
    return text if text and plain >= 0.9 * len(text) else None


def _unbase64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


@dataclass
class Run:
    """A base64 run, and where its lines begin in it and in the text."""

    text: str
    starts: list[int]
    places: list[int]

    def place(self, i: int) -> int:
        k = bisect_right(self.starts, i) - 1
        return self.places[k] + i - self.starts[k]


def _lines(found: list[re.Match]) -> Run:
    starts, n = [], 0
    for m in found:
        starts.append(n)
        n += len(m.group())
    return Run("".join(m.group() for m in found), starts, [m.start() for m in found])


def _runs(text: str) -> Iterator[Run]:
    """Every base64 run: on one line, or joined over lines.

    Joined are all lines that follow each other, and lines of one length with a shorter one behind.
    """
    for m in _BASE64.finditer(text):
        yield _lines([m])
    for m in _WRAPPED.finditer(text):
        found = [*_LINE.finditer(text, *m.span())]
        size = [len(x.group()) for x in found]
        yield _lines(found)
        i = 0
        while i < len(found):
            j = i + 1
            while j < len(found) and size[j] == size[i]:
                j += 1
            k = j + (j < len(found) and size[j] < size[i])
            if k - i > 1 and k - i < len(found):
                yield _lines(found[i:k])
            i = j


def _payloads(run: str) -> Iterator[tuple[Iterator[bytes] | str, int, int]]:
    """(content, first and last character of the run) of what the run decodes to.

    Where it is not content as a whole, other text may stand before or behind it, so each of the four
    alignments is searched for readable stretches and, where a run may begin, for compressed data.
    """
    raw = _unbase64(run) or b""
    if _MAGIC.match(raw):
        inner = _content(BytesIO(raw))
        if first := next(inner, b""):
            yield _joined(first, inner), 0, len(run)
            return
    if text := _readable(raw):
        yield text, 0, len(run)
        return
    begins = {0, 1, 2, 3}.union(m.end() for m in re.finditer(r"[/_+-]", run))
    for r in range(4):
        raw = raw if r == 0 else _unbase64(run[r:]) or b""
        for m in _MAGIC.finditer(raw):
            if m.start() % 3 == 0 and (at := r + m.start() // 3 * 4) in begins:
                file = BytesIO(raw)
                file.seek(m.start())
                inner = _content(file)
                if first := next(inner, b""):
                    yield _joined(first, inner), at, len(run)
        at = 0
        for m in _STRETCH.finditer(raw.decode("utf-8", "replace")):
            # Replaced bytes count as one or more; the stretch itself is found again behind the last one.
            part = m.group().encode()
            at = raw.index(part, at)
            yield m.group(), r + at // 3 * 4, min(len(run), r + -(-(at + len(part)) // 3) * 4)
            at += len(part)


def unwrap(layer: Layer, unread: set[tuple[int, int]]) -> Iterator[Layer]:
    """Every layer that this one holds, one after the other; unread gets the spans of payloads that cannot be read whole."""
    text = layer.text

    def parts(content: Iterator[bytes] | str, a: int, b: int) -> Iterator[Layer]:
        if isinstance(content, str):
            yield _within(layer, content, a, b)
            return
        try:
            for part, is_cut in _parts(content):
                if is_cut:
                    unread.add(layer.origin(a, b))
                yield _within(layer, part, a, b)
        except Unreadable:
            unread.add(layer.origin(a, b))

    escapes = [p for p, d in ((_PERCENT, "%" in text), (_ESCAPE, "\\" in text or "&#" in text)) if d and p.search(text)]
    if escapes and layer.chain >= CHAIN:
        yield settled(layer)
    else:
        for p in escapes:
            yield _replaced(layer, p, _unpercent if p is _PERCENT else _unescape)
    for run in _runs(text):
        try:
            for content, i, j in _payloads(run.text):
                yield from parts(content, run.place(i), run.place(j - 1) + 1)
        except Unreadable:
            unread.add(layer.origin(run.place(0), run.place(len(run.text) - 1) + 1))
    if layer.parent is not None:
        for m in _PACKED.finditer(text):
            file = _Latin(text, m.start())
            try:
                inner = _content(file)
                if first := next(inner, b""):
                    got = [*_parts(_joined(first, inner))] if len(first) < READ else None
                    if got is not None:  # read to its end, so its span is known
                        for part, _ in got:
                            yield _within(layer, part, m.start(), max(file.at, m.start() + 1))
                    else:
                        yield from parts(_joined(first, inner), m.start(), _end(text, m.start()))
            except Unreadable:
                unread.add(layer.origin(m.start(), _end(text, m.start())))


def _end(text: str, at: int) -> int:
    """Where the bytes that begin at `at` end."""
    file = _Latin(text, at)
    while file.read():
        pass
    return file.at


def findings(text: str) -> tuple[list[Span], list[Span], int, list[tuple[int, int]]]:
    """(base spans, all spans, layers scanned, payloads that could not be read whole) of a text."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(scan(text), key=order)
    found = set(base)
    unread: set[tuple[int, int]] = set()
    seen = {_key(Layer(text))}
    n_layers = 1
    work = [unwrap(Layer(text), unread)]
    while work:  # the layer unwrapped last goes first, so few are held at once
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        elif (key := _key(inner)) not in seen:
            seen.add(key)
            n_layers += 1
            found.update((kind, *inner.origin(a, b)) for kind, a, b in scan(inner.text))
            work.append(unwrap(inner, unread))
    return base, sorted(found, key=order), n_layers, sorted(unread)


def _key(layer: Layer) -> bytes:
    """A layer's content and place."""
    h = hashlib.blake2b(layer.text.encode(errors="replace"), digest_size=16)
    if layer.parent is not None and layer.text:
        h.update(b"%d" % layer.origin(0, 1)[0])
    return h.digest()


def joined_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of base findings, a hash of their spans, and all spans of all layers."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        for b in small_batches(batches):
            rows = []
            for text in b.column(1).to_pylist():
                base, spans, n_layers, unread = findings(text or "")
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined_spans(base).encode()).hexdigest(), joined_spans(spans), n_layers, len(unread)))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return texts_of(docs, id_col, text_col).mapInArrow(judge, SCHEMA)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every found span, of any layer, and every payload that could not be read whole, replaced by a mark."""
    _, spans, _, unread = findings(text)
    out: list[str] = []
    at = 0
    for a, b in sorted([*((a, b) for _, a, b in spans), *unread]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All documents and columns, secrets in the text replaced; length_col is set to the new length."""
    k = docs.columns.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [None if t is None else redacted(t, mark) for t in b.column(k).to_pylist()]
            yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

    out = docs.mapInArrow(replace, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
