"""Secret scans with a recursive decoding worklist.

A text is scanned as it is; then percent, Unicode, HTML and backslash escapes, base64 runs and what is compressed in them
are unwrapped, each layer is scanned again and unwrapped further until nothing new comes up. A layer seen before (the same
text from the same place) is not taken twice, which breaks cycles; escapes that only escape each other are taken in one
step. Each character of a layer remembers the span of the original text that it came from, so findings in any layer are
spans of the original. Rows stay in their partitions.

Edge cases: null or empty text has no findings; repeated rows are scanned each by itself; a null id is returned as null;
other columns are ignored. Base64 is decoded in all four alignments, over line ends too, of lines of any length, indented
or quoted by ``>``; what is no UTF-8 is scanned byte by byte without its NULs, which finds UTF-16 as well; so is text that
holds NULs. Percent escapes may stand for compressed bytes, as base64 may.

What is compressed is read as a stream, over all members and frames of any kind to its end; all its findings have the span
of the run. It is scanned in windows that overlap. A base64 run or percent escapes that go on at a window's end are decoded
as streams too, in all alignments, so nothing has to be held as a whole and nothing is cut off. Data that unpacks to its own
beginning again is not unpacked further. A task holds a window for each depth and alignment, besides the text itself with
some 20 bytes for each of its decoded characters.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .support import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("passw", "secret", "token", "api")

#: An escape of a byte, and of a character as some scripts write it, through escapes of the percent sign itself.
ESCAPE = re.compile(r"%(?:(?:25)++(?:[0-9A-Fa-f]{2})?+|[0-9A-Fa-f]{2})")
PERCENT = re.compile(rf"(?:{ESCAPE.pattern})++")
PERCENT_UNICODE = re.compile(r"%(?:25)*+u([0-9a-fA-F]{4})")
PACKED_PART = r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+-])"
PERCENT_PACKED = re.compile(rf"(?:%1[Ff]%8[Bb]|(?:x|%78)%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|BZh|%[Ff][Dd]7zXZ|(?:\(|%28)%[Bb]5(?:/|%2[Ff])%[Ff][Dd]){PACKED_PART}++")
PACKED_ON = re.compile(rf"{PACKED_PART}*+")
#: What a backslash or an ampersand may stand for itself before the escape that follows.
SLASH, AMPERSAND = r"(?<!\\)\\(?:\\|[uU]0{2,6}5[cC]|x5[cC]|u\{0*5[cC]\})*+", r"&(?:amp;|#0*38;|#[xX]0*26;)*+"
UNICODE = re.compile(
    rf"{SLASH}(?:u\{{([0-9a-fA-F]{{1,6}})\}}|u([0-9a-fA-F]{{4}})|U([0-9a-fA-F]{{8}})|x([0-9a-fA-F]{{2}})|([\"'/]))|{AMPERSAND}(?:#[xX]0*([0-9a-fA-F]{{1,6}});|#0*([0-9]{{1,7}});|(quot|apos|amp);)"
    r"|&(?:amp;|#0*38;|#[xX]0*26;)++"
)
NAMED = {"quot": '"', "apos": "'", "amp": "&"}
ALPHABET = "A-Za-z0-9+/_-"
BASE64 = re.compile(rf"[{ALPHABET}]{{18,}}+={{0,2}}")
#: From one line of a wrapped run to the next.
LINE_END = r"[ \t]*+\r?\n[ \t]*+(?:>[ \t]*+)*+"
WRAPPED = re.compile(rf"(?<![{ALPHABET}])[{ALPHABET}]++(?:{LINE_END}[{ALPHABET}]++)++={{0,2}}")
#: A run that goes on at the end of a window, and how it goes on in the next one.
OPEN_RUN = re.compile(rf"(?<![{ALPHABET}])[{ALPHABET}]++(?:{LINE_END}[{ALPHABET}]++)*+[ \t\r\n>]*\Z")
RUN_ON = re.compile(rf"[ \t\r\n>]*+[{ALPHABET}]*+(?:{LINE_END}[{ALPHABET}]++)*+(?:[ \t\r\n>]*\Z)?")
#: What no text has but for damage: control characters other than white space.
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f]")
URL_SAFE = str.maketrans("-_", "+/")
IN_BASE64 = re.compile(rf"[{ALPHABET}]+")
LEAST_RUN = 18
MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
#: Bytes of a compressed layer that are scanned at once, and by how many the next window overlaps.
WINDOW, OVERLAP = 1 << 20, 1 << 16
#: Bytes that are unpacked at once, that a frame of zstandard is fed with at once, and that tell a layer from others.
STEP, ZSTD_STEP, HEAD = 1 << 18, 1 << 8, 4096

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[int, int, int]  # start, kind, end: sorts as the contract says


def findings(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text and where the original's span begins and ends for each of its characters.

    Without begin and end it is the original itself; with fixed, all its characters come from that one span.
    """

    __slots__ = ("text", "begin", "end", "fixed")

    def __init__(self, text: str, begin: np.ndarray | None = None, end: np.ndarray | None = None, fixed: tuple[int, int] | None = None):
        self.text, self.begin, self.end, self.fixed = text, begin, end, fixed

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.fixed:
            return self.fixed
        return (a, b) if self.begin is None else (int(self.begin[a:b].min()), int(self.end[a:b].max()))


def _replaced(layer: Layer, pieces: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
    """layer with each (a, b, new text, the spans in layer of its characters) put in place of what is from a to b."""
    size = len(layer.text)
    texts, begins, ends, at = [], [], [], 0
    if not layer.fixed:
        begin = np.arange(size, dtype=np.int32) if layer.begin is None else layer.begin
        end = np.arange(1, size + 1, dtype=np.int32) if layer.end is None else layer.end
        ours = np.array([x for *_, spans in pieces for span in spans for x in span], dtype=np.int64)
        # every second result is of a span, and one more place lets a span end with the text
        firsts, lasts = (f.reduceat(np.append(x, rest), ours)[::2] if len(ours) else x[:0] for f, x, rest in ((np.minimum, begin, size), (np.maximum, end, 0)))
    done = 0
    for a, b, new, spans in pieces:
        texts += [layer.text[at:a], new]
        if not layer.fixed:
            begins += [begin[at:a], firsts[done : done + len(spans)]]
            ends += [end[at:a], lasts[done : done + len(spans)]]
            done += len(spans)
        at = b
    text = "".join([*texts, layer.text[at:]])
    return Layer(text, fixed=layer.fixed) if layer.fixed else Layer(text, np.concatenate([*begins, begin[at:]]), np.concatenate([*ends, end[at:]]))


def _percent(layer: Layer) -> Layer | None:
    """Runs of percent escapes as the UTF-8 text that they stand for."""
    pieces = []
    for m in PERCENT.finditer(layer.text):
        escapes = [(e.start(), e.end(), int(e[0][-2:], 16)) for e in ESCAPE.finditer(m[0])]
        raw, at, spans = bytes(code for _, _, code in escapes), 0, []
        new = raw.decode("utf-8", "replace")
        for c in new:  # a character may take several escapes
            n = 1 if c == "�" else len(c.encode())
            spans.append((m.start() + escapes[min(at, len(raw) - 1)][0], m.start() + escapes[min(at + n, len(raw)) - 1][1]))
            at += n
        pieces.append((m.start(), m.end(), new, spans))
    return _replaced(layer, pieces) if pieces else None


def _characters(layer: Layer) -> Layer | None:
    """Escapes of characters by their code, as scripts, JSON and HTML have them."""
    pieces = []
    for m in UNICODE.finditer(layer.text):
        kind, value = m.lastindex, m[m.lastindex] if m.lastindex else "amp"
        code = NAMED.get(value) or (value if kind == 5 else int(value, 10 if kind == 7 else 16))
        if isinstance(code, str) or code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            pieces.append((m.start(), m.end(), code if isinstance(code, str) else chr(code), [m.span()]))
    for m in PERCENT_UNICODE.finditer(layer.text) if "u" in layer.text else ():
        if not 0xD800 <= (code := int(m[1], 16)) <= 0xDFFF:
            pieces.append((m.start(), m.end(), chr(code), [m.span()]))
    return _replaced(layer, sorted(pieces)) if pieces else None


def _without_nuls(layer: Layer) -> Layer:
    return _replaced(layer, [(m.start(), m.end(), "", []) for m in re.finditer("\0+", layer.text)])


class _Zstd:
    """A zstandard frame, unpacked by small steps, as a few bytes may stand for many."""

    def __init__(self):
        import zstandard

        self.one = zstandard.ZstdDecompressor().decompressobj()

    def unpack(self, data: bytes) -> Iterator[bytes]:
        for at in range(0, len(data), ZSTD_STEP):
            yield self.one.decompress(data[at : at + ZSTD_STEP])
            if self.one.eof:
                self.rest = self.one.unused_data + data[at + ZSTD_STEP :]
                return
        self.rest = None


class _Zlib:
    """A gzip or zlib member."""

    def __init__(self, wbits: int):
        self.one = zlib.decompressobj(wbits)

    def unpack(self, data: bytes) -> Iterator[bytes]:
        while data and not self.one.eof:
            yield self.one.decompress(data, STEP)
            data = self.one.unconsumed_tail
        while not self.one.eof and (more := self.one.decompress(b"", STEP)):
            yield more
        self.rest = self.one.unused_data if self.one.eof else None


class _Blocks:
    """A bzip2 or xz stream."""

    def __init__(self, one):
        self.one = one

    def unpack(self, data: bytes) -> Iterator[bytes]:
        yield self.one.decompress(data, STEP)
        while not self.one.eof and not self.one.needs_input:
            yield self.one.decompress(b"", STEP)
        self.rest = self.one.unused_data if self.one.eof else None


def _member(head: bytes):
    """Unpacks the member that begins with head; None if nothing known does."""
    if head.startswith(b"\x28\xb5\x2f\xfd"):
        return _Zstd()
    if head.startswith(b"BZh"):
        return _Blocks(bz2.BZ2Decompressor())
    if head.startswith(b"\xfd7zXZ\x00"):
        return _Blocks(lzma.LZMADecompressor())
    return _Zlib(31 if head.startswith(b"\x1f\x8b") else 15) if head.startswith(MAGIC) else None


class Scan:
    """What the streams of one text share: the bytes of a window, and the kinds that windows seen before hold."""

    def __init__(self, window: int):
        self.window, self.overlap = window, min(OVERLAP, window // 2)
        self.seen: dict[bytes, set[int]] = {}


class Unpacker:
    """Takes compressed bytes piece by piece and hands on what its members hold, in order, as far as they are whole."""

    def __init__(self, scan: Scan, kinds: set[int], above: frozenset[bytes]):
        self.scan, self.kinds, self.above = scan, kinds, above
        self.rest, self.begun, self.over, self.member, self.sink = b"", False, False, None, None

    def feed(self, data: bytes, last: bool = False) -> None:
        if self.over:
            return
        data = self.rest + data
        if not self.begun:
            if len(data) < HEAD and not last:
                self.rest = data
                return
            head = hashlib.blake2b(data[:HEAD], digest_size=16).digest()
            self.begun, self.over = True, head in self.above or not data.startswith(MAGIC)
            self.sink = None if self.over else Sink(self.scan, self.kinds, self.above | {head})
        self.rest = b""
        while data and not self.over:
            if self.member is None:
                data = data.lstrip(b"\0")  # padding between members
                if len(data) < 6 and not last:
                    self.rest = data
                    return
                self.member = _member(data)
                if self.member is None:
                    self.over = True
                    break
            pieces = self.member.unpack(data)
            while (piece := self._next(pieces)) is not None:
                self.sink.feed(piece)
            data = (not self.over and self.member.rest) or b""
            if not self.over and self.member.rest is not None:
                self.member = None
        if self.sink and (self.over or last):
            self.over = True
            self.sink.close()

    def _next(self, pieces: Iterator[bytes]) -> bytes | None:
        """The next of pieces; None at their end, and where the data are damaged: what came before counts."""
        try:
            return next(pieces, None)
        except Exception:  # noqa: BLE001  each library raises its own errors
            self.over = True
            return None

    def close(self) -> None:
        self.feed(b"", last=True)


class Alignment:
    """Decodes a base64 run that comes piece by piece from one of its first four characters on."""

    #: Characters that are decoded ahead, to know what begins there.
    AHEAD = 8

    def __init__(self, scan: Scan, kinds: set[int], above: frozenset[bytes], shift: int):
        self.scan, self.kinds, self.above = scan, kinds, above
        self.skip, self.held, self.sink, self.packed = shift, "", Sink(scan, kinds, above), []

    def feed(self, chars: str, last: bool = False) -> None:
        chars, self.skip = chars[self.skip :], max(0, self.skip - len(chars))
        held = self.held + chars
        size = (len(held) if last else max(0, len(held) - self.AHEAD)) // 4 * 4
        ahead = held[: size + self.AHEAD]
        ahead = ahead[: len(ahead) - (len(ahead) % 4 == 1)]
        raw = base64.b64decode(ahead.translate(URL_SAFE) + "=" * (-len(ahead) % 4))
        done = raw if last else raw[: size // 4 * 3]
        self.sink.feed(done)
        for unpacker in self.packed:
            unpacker.feed(done)
        for m in re.finditer("[/_-]", held[:size]):
            if m.end() % 4 == 0 and raw.startswith(MAGIC, m.end() // 4 * 3):
                unpacker = Unpacker(self.scan, self.kinds, self.above)
                unpacker.feed(done[m.end() // 4 * 3 :])
                self.packed.append(unpacker)
        self.packed = [p for p in self.packed if not p.over]
        self.held = "" if last else held[size:]

    def close(self) -> None:
        self.feed("", last=True)
        for one in (self.sink, *self.packed):
            one.close()


class Escapes:
    """Decodes compressed bytes in percent escapes that come piece by piece; a plus may be a blank there."""

    def __init__(self, scan: Scan, kinds: set[int], above: frozenset[bytes]):
        self.packed, self.held = [Unpacker(scan, kinds, above) for _ in range(2)], ""

    def feed(self, chars: str, last: bool = False) -> None:
        held = self.held + chars
        cut = len(held) if last or "%" not in held[-2:] else held.rindex("%")
        self.held = held[cut:]
        for unpacker, plus in zip(self.packed, "+ "):
            unpacker.feed(unquote_to_bytes(held[:cut].replace("+", plus)))

    def close(self) -> None:
        self.feed("", last=True)
        for one in self.packed:
            one.close()


class Sink:
    """Takes the bytes of a layer piece by piece, adds the kinds found in it and in what it unwraps to; keeps a window."""

    def __init__(self, scan: Scan, kinds: set[int], above: frozenset[bytes] = frozenset()):
        self.scan, self.kinds, self.above = scan, kinds, above
        self.packed, self.held, self.open = Unpacker(scan, kinds, above), b"", []
        self.on, self.known = None, 0

    def feed(self, data: bytes) -> None:
        self.packed.feed(data)
        self.held += data.replace(b"\0", b"")
        while len(self.held) > self.scan.window:
            self._window(self.held[: self.scan.window].decode("latin-1"))
            self.held = self.held[self.scan.window - self.scan.overlap :]

    def close(self) -> None:
        self.packed.close()
        if self.held:
            self._window(self.held.decode("latin-1"), last=True)
            self.held = b""
        self._end()

    def _end(self) -> None:
        for one in self.open:
            one.close()
        self.open, self.on = [], None

    def _window(self, text: str, last: bool = False) -> None:
        """Scan a window, of which the first known characters were in the one before."""
        self.kinds |= kinds_in(text, self.scan, self.above)
        if self.open:
            end = self.on.match(text, self.known).end()
            if self.on is PACKED_ON and end >= len(text) - 2:  # an escape may be cut in two
                end = len(text)
            self._goes_on(text, self.known, end)
            if end < len(text):
                self._end()
        if not self.open and not last:
            if (m := OPEN_RUN.search(text)) and m.end() - m.start() >= LEAST_RUN:
                self.on, self.open = RUN_ON, [Alignment(self.scan, self.kinds, self.above, shift) for shift in range(4)]
                self._goes_on(text, *m.span())
            else:
                for m in PERCENT_PACKED.finditer(text):
                    if m.end() >= len(text) - 2:
                        self.on, self.open = PACKED_ON, [Escapes(self.scan, self.kinds, self.above)]
                        self._goes_on(text, m.start(), len(text))
        self.known = min(self.scan.overlap, len(text))

    def _goes_on(self, text: str, a: int, b: int) -> None:
        chars = "".join(IN_BASE64.findall(text, a, b)) if self.on is RUN_ON else text[a:b]
        for one in self.open:
            one.feed(chars)


def kinds_in(text: str, scan: Scan, above: frozenset[bytes]) -> set[int]:
    """The kinds of findings in a window, and in all that it unwraps to."""
    key = hashlib.blake2b(text.encode("latin-1"), digest_size=16).digest()
    if key not in scan.seen:
        scan.seen[key] = set()  # so a window does not wait for itself
        scan.seen[key] = {kind for _, kind, _ in _worklist(Layer(text, fixed=(0, 0)), scan, above)}
    return scan.seen[key]


def _unpacked(raw: bytes, scan: Scan, above: frozenset[bytes]) -> set[int]:
    kinds: set[int] = set()
    unpacker = Unpacker(scan, kinds, above)
    for at in range(0, len(raw), STEP):
        unpacker.feed(raw[at : at + STEP])
    unpacker.close()
    return kinds


def _percent_packed(layer: Layer, scan: Scan, above: frozenset[bytes]) -> Iterator[Span]:
    """Findings in what compressed bytes in percent escapes unfold to."""
    for m in PERCENT_PACKED.finditer(layer.text):
        for escaped in {m[0], m[0].replace("+", " ")}:
            a, b = layer.span(*m.span())
            yield from ((a, kind, b) for kind in _unpacked(unquote_to_bytes(escaped), scan, above))


def _runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], bool]]:
    """Each base64 run, in a line and over line ends: its characters, the stretches of text that they come from, and if it
    is to be read as text: the inner lines of a wrapped run are read with all of it."""
    inner = set()
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            if m.end() - m.start() >= LEAST_RUN:
                parts = [part.span() for part in IN_BASE64.finditer(text, *m.span())]
                inner.update(a for a, _ in parts[1:-2])
                yield "".join(text[a:b] for a, b in parts), parts, True
    for m in BASE64.finditer(text):
        body = m[0].rstrip("=")
        yield body, [(m.start(), m.start() + len(body))], m.start() not in inner


def _read(raw: bytes) -> tuple[str, bool]:
    """Bytes as text, and whether it is UTF-8; if not, or with control characters, byte by byte without NULs."""
    try:
        text = raw.decode()
        if text.isprintable() or not CONTROL.search(text):
            return text, True
    except UnicodeDecodeError:
        pass
    return raw.replace(b"\0", b"").decode("latin-1"), False


def _base64(layer: Layer, scan: Scan, above: frozenset[bytes]) -> Iterator[Layer | Span]:
    """What base64 runs decode to, and findings in what is compressed in them."""
    for run, stretches, as_text in _runs(layer.text):
        place = None if layer.fixed else np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in stretches])
        starts = [m.end() for m in re.finditer("[/_-]", run)]
        body = run.translate(URL_SAFE)
        for shift in range(4):
            part = body[shift:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            for at in {0, *((s - shift) // 4 * 3 for s in starts if s > shift and (s - shift) % 4 == 0)}:
                if raw.startswith(MAGIC, at):
                    a, b = layer.fixed or layer.span(int(place[shift + at // 3 * 4]), int(place[shift + len(part) - 1]) + 1)
                    yield from ((a, kind, b) for kind in _unpacked(raw[at:], scan, above))
            if not as_text:
                continue
            text, utf8 = _read(raw)
            if layer.fixed:
                yield Layer(text, fixed=layer.fixed)
                continue
            if utf8 and len(text) == len(raw):
                first = np.arange(len(raw), dtype=np.int32)
                stop = first + 1
            elif utf8:
                sizes = np.fromiter((len(c.encode()) for c in text), dtype=np.int32, count=len(text))
                stop = np.cumsum(sizes, dtype=np.int32)
                first = stop - sizes
            else:
                first = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8)).astype(np.int32)
                stop = first + 1
            # byte k comes from the base64 characters that hold its bits: from k * 8 // 6 on
            left, right = place[shift + first + first // 3], place[shift + stop - 1 + (stop - 1) // 3 + 1]
            yield Layer(text, left if layer.begin is None else layer.begin[left], right + 1 if layer.end is None else layer.end[right])


def _inner(layer: Layer, scan: Scan, above: frozenset[bytes]) -> Iterator[Layer | Span]:
    """What layer unwraps to by one step, and findings in what is compressed in it."""
    new = _percent(layer) if "%" in layer.text else None
    if new is None and ("\\" in layer.text or "&" in layer.text or "%" in layer.text):  # other escapes come when those are gone
        new = _characters(layer)
    if new:
        yield new
    if "%" in layer.text:
        yield from _percent_packed(layer, scan, above)
    if "\0" in layer.text:
        yield _without_nuls(layer)
    yield from _base64(layer, scan, above)


def _worklist(layer: Layer, scan: Scan, above: frozenset[bytes] = frozenset()) -> set[Span]:
    """Findings in layer and in all that it unwraps to, as spans of the original."""
    spans: set[Span] = set()
    seen, work = set(), [iter([layer])]
    while work:  # depth first, so that one layer of each depth is in memory
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if isinstance(layer, tuple):
            spans.add(layer)
            continue
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.span(0, len(layer.text)) if layer.text else None
        if not layer.text or key in seen:
            continue
        seen.add(key)
        for start, kind, end in findings(layer.text):
            a, b = layer.span(start, end)
            spans.add((a, kind, b))
        work.append(_inner(layer, scan, above))
    return spans


def scan(text: str, max_unfolded: int = WINDOW) -> tuple[list[Span], list[Span]]:
    """The spans in text itself, and all spans with those of decoded layers.

    max_unfolded: bytes of a compressed layer that are scanned at once, which bounds memory and changes no result.
    """
    return findings(text), sorted(_worklist(Layer(text), Scan(min(WINDOW, max_unfolded))))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_documents(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base findings, and all spans, for each (doc_id, text) row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = scan(text or "")
                counts = [sum(s[1] == k for s in base) for k in range(3)]
                out.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(step, SCHEMA)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
