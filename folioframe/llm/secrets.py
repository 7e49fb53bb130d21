"""Secret scans that unwrap nested encodings.

A worklist starts with the text itself.  Every layer is scanned with the base patterns,
and everything in it that decodes (URL escapes, Unicode escapes, base64, UTF-16, compressed bytes)
becomes a new layer, until nothing new turns up.  Layers already seen at the same place
(told by digest) are not taken up again, so cycles end.  Layers are taken depth first, so only
the ones above a layer are held.  Each layer knows for each of its characters from
where to where it stands in the original text; that maps what is found back.

An escape of an escape sign (%25 before two hex digits, \\u005c before u0041) is undone with what
it stands before, so a long chain of them is one layer.  Base64 may start at any of many places
of a run, but each of the four alignments is decoded once.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import append_columns

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?P<name>password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?P<value>[A-Za-z0-9+/_.=-]+)", re.I | re.A
)
#: Every assign match holds one of these.
ASSIGN_SIGN = re.compile("[:=]")
ACCESS = re.compile("AKIA[A-Z0-9]+")
#: Runs of hex digits don't overlap anyway, so the shorter ones needn't be matched to be dropped.
HEX = re.compile("[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

URL_ESCAPES = re.compile("(?:%(?:25)*[0-9A-Fa-f]{2})++")
UNICODE_ESCAPES = re.compile(r"\\(?:u005[cC]|x5[cC])*(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
NESTED_PERCENT = re.compile("%(?:25)+(?=[0-9A-Fa-f]{2})")
#: Bytes written with escapes between other characters, and the units that they are made of.
URL_RUN, URL_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2}|[^\s%\"'<>])++"), re.compile("%([0-9A-Fa-f]{2})|.", re.S)
HEX_RUN = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[nrt0abfv\\'\"]|[^\\\n\r])++")
HEX_UNIT = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\([nrt0abfv\\'\"])|.", re.S)
SHORT_ESCAPES = {"n": 10, "r": 13, "t": 9, "0": 0, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, "'": 39, '"': 34}
#: How compressed bytes begin, and how that looks in escapes.
PACKED = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00")
SIGNATURES = (b"\x1f\x8b", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00")


def spelled(escape: str) -> re.Pattern:
    """The signatures, each byte written with the escape or, if it is printable, as it is."""
    return re.compile(
        "|".join("".join(f"(?:{re.escape(chr(c))}|{escape}{c:02x})" if 32 < c < 127 else f"{escape}{c:02x}" for c in signature) for signature in SIGNATURES),
        re.I,
    )


URL_PACKED, HEX_PACKED = spelled("%"), spelled(r"\\(?:x|u00)")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines that end, and begin but for indentation, with digits of base64; and these digits, line by line.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE_DIGITS = re.compile("[A-Za-z0-9+/_-]++={0,2}")
SEPARATORS = re.compile("[/_+-]")
#: Bytes that are read, unfolded or decoded at once, and most bytes of a layer that are held in memory.
CHUNK, MOST_HELD = 3 << 16, 1 << 23
#: The patterns over bytes: they name ASCII alone, so they match UTF-8 as they match the text.
ASSIGN_BYTES, ACCESS_BYTES, HEX_BYTES, URL_BYTES, UNICODE_BYTES, BASE64_BYTES, WRAPPED_BYTES, LINE_BYTES, SEPARATOR_BYTES, NESTED_BYTES = (
    re.compile(p.pattern.encode(), p.flags & re.I)
    for p in (ASSIGN, ACCESS, HEX, URL_ESCAPES, UNICODE_ESCAPES, BASE64_RUN, WRAPPED, LINE_DIGITS, SEPARATORS, NESTED_PERCENT)
)
LEAST_BASE64 = 16
BREAKS = "\x20\t\r\n"
STANDARD_DIGITS = bytes.maketrans(b"-_", b"+/")


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, place of the kind) of every base match, in code points."""
    if ASSIGN_SIGN.search(text):
        for m in ASSIGN.finditer(text):
            if m.end("value") - m.start("value") >= LEAST_VALUE:
                yield m.start(), m.end(), 0
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                yield m.start(), m.end(), 1
    for m in HEX.finditer(text):
        yield m.start(), m.end(), 2


class Layer:
    """A text and, for each of its characters, the start and end in the original."""

    def __init__(self, text: str, starts: range | array, ends: range | array):
        self.text, self.starts, self.ends = text, starts, ends

    def original(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]

    def key(self) -> tuple[int, int, bytes]:
        return self.starts[0], self.ends[-1], hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with every match decoded; each new character covers its match."""
    text, starts, ends, last = [], array("q"), array("q"), 0
    for m in pattern.finditer(layer.text):
        new = decode(m)
        if new is None:
            continue
        a, b = layer.original(m.start(), m.end())
        text += [layer.text[last : m.start()], new]
        for held, own, value in ((starts, layer.starts, a), (ends, layer.ends, b)):
            held.extend(own[last : m.start()])
            held.extend(array("q", [value]) * len(new))
        last = m.end()
    if not last:
        return None
    starts.extend(layer.starts[last:])
    ends.extend(layer.ends[last:])
    return Layer("".join([*text, layer.text[last:]]), starts, ends)


def url_decoded(m: re.Match) -> str | None:
    return bytes.fromhex(NESTED_PERCENT.sub("%", m[0]).replace("%", "")).decode("utf-8", "replace")


def unicode_decoded(m: re.Match) -> str | None:
    code = int(m[1] or m[2] or m[3], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def url_unit(m: re.Match) -> bytes:
    return bytes([int(m[1], 16)]) if m[1] else m[0].encode("utf-8", "surrogatepass")


def hex_unit(m: re.Match) -> bytes:
    if m[1] or m[2]:
        return bytes([int(m[1], 16) if m[1] else SHORT_ESCAPES[m[2]]])
    return m[0].encode("utf-8", "surrogatepass")


def escaped_bytes(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of runs whose escapes may spell compressed bytes, from where these begin."""
    for sign, hint, run, unit, value in (("%", URL_PACKED, URL_RUN, URL_UNIT, url_unit), ("\\", HEX_PACKED, HEX_RUN, HEX_UNIT, hex_unit)):
        if sign not in text or not hint.search(text):
            continue
        for m in run.finditer(text):
            if sign not in m[0] or not hint.search(m[0]):
                continue
            sizes = array("q", [0])
            data = bytearray()
            for u in unit.finditer(m[0]):
                data += value(u)
                sizes.append(len(data))
            edges = [u.start() for u in unit.finditer(m[0])]
            begins = np.frombuffer(sizes, np.int64)
            whole = bytes(data)
            for p in PACKED.finditer(whole):
                at = int(np.searchsorted(begins, p.start(), "right")) - 1
                view = memoryview(whole)[p.start() :]
                behind = int(np.searchsorted(begins, p.start() + packed_end(view), "left"))
                yield m.start() + edges[at], m.start() + edges[behind] if behind < len(edges) else m.end(), view


class Spool:
    """Takes bytes in pieces; what exceeds ``MOST_HELD`` is kept in a nameless file of the task."""

    def __init__(self):
        self.held, self.file, self.size = bytearray(), None, 0

    def write(self, piece: bytes) -> None:
        self.held += piece
        self.size += len(piece)
        if len(self.held) > MOST_HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held = bytearray()

    def whole(self) -> bytes | mmap.mmap:
        if self.file is None:
            return bytes(self.held)
        self.file.write(self.held)
        self.file.flush()
        with self.file:
            return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)


def pieces(data: bytes | mmap.mmap, start: int, end: int) -> Iterator[bytes]:
    for at in range(start, end, CHUNK):
        yield data[at : min(at + CHUNK, end)]


def decompressor(head: bytes):
    """What unfolds bytes that begin like ``head`` (gzip, zlib, bzip2, xz); None for others."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def stream_end(stream, data: bytes | mmap.mmap, at: int, out: Spool) -> int | None:
    """Unfolds the stream that begins at ``at``, piece by piece, and tells where it ends; None if it breaks off."""
    try:
        while not stream.eof:
            feed = getattr(stream, "unconsumed_tail", b"")
            if not feed and getattr(stream, "needs_input", True):
                feed = data[at : at + CHUNK]
                at += len(feed)
            piece = stream.decompress(feed, CHUNK)
            out.write(piece)
            if not feed and not piece and at >= len(data):
                return None
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return None
    return at - len(stream.unused_data)


class Sink:
    """Takes bytes and drops them."""

    def write(self, piece: bytes) -> None:
        pass


def packed_end(data: memoryview) -> int:
    """Where the streams that ``data`` begins with end; the end of the data if one breaks off."""
    at = 0
    while at < len(data) and (stream := decompressor(bytes(data[at : at + 6]))):
        end = stream_end(stream, data, at, Sink())
        if end is None:
            return at or len(data)
        at = end
    return at


def unfolded(data: bytes | mmap.mmap) -> Iterator[tuple[bytes | mmap.mmap, bool]]:
    """What compressed bytes hold, all streams (members) of them joined, and then what follows the last stream.

    Each with whether it breaks off; a broken stream counts as far as it unfolds.  Nothing for bytes that aren't compressed.
    """
    out, at, size, size_before = Spool(), 0, 0, 0
    while at is not None and (stream := decompressor(data[at : at + 6])):
        last, size_before = at, size
        at = stream_end(stream, data, at, out)
        size = out.size
        while at is not None and data[at : at + 1] == b"\0":  # padding between streams
            at += 1
    if at == 0:
        return
    whole = out.whole()
    yield whole, at is None
    if at is None:
        if not last:
            return
        # What looked like one more stream may be something else: the streams before it, and it by itself.
        at = last
        before = Spool()
        for piece in pieces(whole, 0, size_before):
            before.write(piece)
        yield before.whole(), False
    if at < len(data):
        rest = Spool()
        for piece in pieces(data, at, len(data)):
            rest.write(piece)
        yield rest.whole(), False


def is_text(data: bytes | mmap.mmap, breaks_off: bool) -> bool:
    """Whether bytes are UTF-8; of those that break off the last character may be cut."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for piece in pieces(data, 0, len(data)):
            decoder.decode(piece)
        decoder.decode(b"", not breaks_off)
    except UnicodeDecodeError:
        return False
    return True


def base64_spans(text: str | bytes | mmap.mmap) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, starts): from where to where base64 may stand, in a line or wrapped, and from where on it may be read.

    A run may have been glued to a path or a key before it.
    """
    run, wrapped, separator = (BASE64_RUN, WRAPPED, SEPARATORS) if isinstance(text, str) else (BASE64_BYTES, WRAPPED_BYTES, SEPARATOR_BYTES)
    for m in run.finditer(text):
        starts = [m.start(), *(s.end() for s in separator.finditer(text, m.start(), m.end()))]
        yield m.start(), m.end(), [s for s in starts if m.end() - s >= LEAST_BASE64]
    for m in wrapped.finditer(text):
        for start, line_end, end in wrapped_spans(text, m.start(), m.end()):
            starts = [start, *(s.end() for s in separator.finditer(text, start, line_end))]
            yield start, end, [s for s in starts if end - s > LEAST_BASE64]


def wrapped_spans(text: str | bytes | mmap.mmap, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end of the first line, end) of blocks among lines of digits.

    A block has lines of one width.  A line of another width may stand before it (its first part is something else) and a
    shorter one may end it; as neither need belong to it, the block comes with and without them.
    """
    lead = block = None  # (start, end) of the line ahead of the block, and of the block's first line
    width = count = last = 0
    for m in (LINE_DIGITS if isinstance(text, str) else LINE_BYTES).finditer(text, start, end):
        size = m.end() - m.start()
        if block and size == width:
            count, last = count + 1, m.end()
            continue
        if block:
            for first in filter(None, (lead, block)):
                if count > 1 or first is lead:
                    yield *first, last
                if size < width:
                    yield *first, m.end()
        lead = block if count == 1 else None
        block, width, count, last = m.span(), size, 1, m.end()
    for first in filter(None, (lead, block)):
        if count > 1 or (first is lead and count):
            yield *first, last


def base64_data(text: str | bytes | mmap.mmap, start: int, end: int) -> bytes | mmap.mmap:
    """The bytes of a run, line breaks left out."""
    out, rest = Spool(), b""
    for at in range(start, end, CHUNK):
        digits = text[at : min(end, at + CHUNK)]
        digits = rest + (digits.encode() if isinstance(digits, str) else digits).translate(STANDARD_DIGITS, b"=" + BREAKS.encode())
        whole = len(digits) // 4 * 4
        rest = digits[whole:]
        out.write(base64.b64decode(digits[:whole]))
    if len(rest) > 1:
        out.write(base64.b64decode(rest + b"=" * (4 - len(rest))))
    return out.whole()


def text_from(data: bytes | mmap.mmap) -> int:
    """From which byte on everything is UTF-8; the length if nothing is."""
    end = len(data)
    while end:
        start = max(0, end - CHUNK)
        while start and start < end and data[start] & 0xC0 == 0x80:
            start -= 1
        part = data[start:end]
        try:
            part.decode("utf-8")
        except UnicodeDecodeError:
            wrong = [0]

            def note(e: UnicodeDecodeError, wrong: list[int] = wrong) -> tuple[str, int]:
                wrong[0] = e.end
                return "", e.end

            codecs.register_error("folioframe-note", note)
            part.decode("utf-8", "folioframe-note")
            return start + wrong[0]
        end = start
    return 0


def base64_reads(text: str | bytes | mmap.mmap) -> Iterator[tuple[int, int, memoryview | bytes | mmap.mmap, str]]:
    """(start, end, bytes, kind): what the base64 in a text may hold: "packed" (compressed), "text" (UTF-8) or "wide" (UTF-16) bytes.

    Starts of one alignment share what is decoded: compressed bytes begin at any of them, and of those from which
    on everything is text the first counts, as the others only leave out its beginning.  Of UTF-16 that is the
    first start at an even and at an odd byte.
    """
    for start, end, starts in base64_spans(text):
        digits = np.array(starts, np.int64)
        if not len(digits):
            continue
        for alignment in range(4):  # starts lie in the first line, so no break stands between them
            own = digits[(digits - start) % 4 == alignment]
            if not len(own):
                continue
            data = base64_data(text, int(own[0]), end)
            view, offsets = memoryview(data), (own - own[0]) // 4 * 3
            for s, at in zip(own.tolist(), offsets.tolist(), strict=True):
                if decompressor(bytes(view[at : at + 6])):
                    yield s, end, view[at:], "packed"
            able = np.flatnonzero(offsets >= text_from(data))
            for i in able:
                at = int(offsets[i])
                if at < len(data) and data[at] & 0xC0 != 0x80:
                    yield int(own[i]), end, view[at:] if at else data, "text"
                    break
            if any(b"\0" in piece for piece in pieces(data, 0, len(data))):
                for odd in (0, 1):
                    for i in np.flatnonzero(offsets % 2 == odd)[:1]:
                        yield int(own[i]), end, view[offsets[i] :], "wide"


def utf16_bytes(data: bytes | mmap.mmap | memoryview) -> Iterator[tuple[bytes | mmap.mmap, str]]:
    """(text as UTF-8, encoding) of bytes that are UTF-16 with ASCII characters in it; an odd last byte is left out."""
    if not any(b"\0" in bytes(piece) for piece in pieces(data, 0, len(data))):
        return
    for name in ("utf-16-le", "utf-16-be"):
        decoder, out = codecs.getincrementaldecoder(name)(), Spool()
        try:
            for piece in pieces(data, 0, len(data) // 2 * 2):
                text = decoder.decode(piece)
                if "\0" in text:
                    break
                out.write(text.encode())
            else:
                decoder.decode(b"", True)
                yield out.whole(), name
        except UnicodeError:
            continue


def url_unescaped(data: bytes | mmap.mmap) -> Iterator[bytes | mmap.mmap]:
    """Bytes of a text with URL escapes decoded, if there are any."""
    out, last = Spool(), 0
    for m in URL_BYTES.finditer(data):
        for piece in pieces(data, last, m.start()):
            out.write(piece)
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        run = NESTED_BYTES.sub(b"%", data[m.start() : m.end()])
        for piece in pieces(run, 0, len(run)):
            out.write(decoder.decode(bytes.fromhex(piece.replace(b"%", b"").decode())).encode())
        out.write(decoder.decode(b"", True).encode())
        last = m.end()
    if last:
        for piece in pieces(data, last, len(data)):
            out.write(piece)
        yield out.whole()


def unicode_unescaped(data: bytes | mmap.mmap) -> Iterator[bytes | mmap.mmap]:
    """Bytes of a text with Unicode escapes decoded, if there are any."""
    out, last = Spool(), 0
    for m in UNICODE_BYTES.finditer(data):
        if (new := unicode_decoded(m)) is None:
            continue
        for piece in pieces(data, last, m.start()):
            out.write(piece)
        out.write(new.encode())
        last = m.end()
    if last:
        for piece in pieces(data, last, len(data)):
            out.write(piece)
        yield out.whole()


def decoded(data: bytes | mmap.mmap) -> Iterator[tuple[bytes | mmap.mmap, bool]]:
    """Everything in a text, given as bytes, that decodes."""
    for found in chain(url_unescaped(data), unicode_unescaped(data), (view for _, _, view, _ in base64_reads(data))):
        yield found, False


def kinds_in(data: bytes | mmap.mmap) -> Iterator[int]:
    """Kinds of the base matches in a text, given as bytes."""
    if any(m.end("value") - m.start("value") >= LEAST_VALUE for m in ASSIGN_BYTES.finditer(data)):
        yield 0
    if any(m.end() - m.start() >= LEAST_ACCESS for m in ACCESS_BYTES.finditer(data)):
        yield 1
    if HEX_BYTES.search(data):
        yield 2


def digest(data: bytes | mmap.mmap) -> bytes:
    found = hashlib.blake2b(digest_size=16)
    for piece in pieces(data, 0, len(data)):
        found.update(piece)
    return found.digest()


def packed_kinds(data: bytes | mmap.mmap) -> set[int]:
    """Kinds of all base matches in what compressed bytes hold, and in everything that decodes from it.

    No stream is cut: layers are taken one at a time and depth first, large ones from a file.  A layer
    seen before, compressed or text, isn't taken up again, so bytes that unfold to themselves end.
    """
    kinds: set[int] = set()
    seen: set[tuple[bytes, bool]] = set()
    work = [unfolded(data)]
    while work and len(kinds) < len(KINDS):
        found = next(work[-1], None)
        if found is None:
            work.pop()
            continue
        layer, breaks_off = found
        if (key := (digest(layer), breaks_off)) in seen:
            continue
        seen.add(key)
        if is_text(layer, breaks_off):
            kinds.update(kinds_in(layer))
            work.append(decoded(whole_bytes(layer)))
        work.append(((text, False) for text, _ in utf16_bytes(layer)))
        work.append(unfolded(layer))
    return kinds


def whole_bytes(data: bytes | mmap.mmap | memoryview) -> bytes | mmap.mmap:
    """Bytes that have the patterns' and slices' usual kinds; a view is copied."""
    if not isinstance(data, memoryview):
        return data
    out = Spool()
    for piece in pieces(data, 0, len(data)):
        out.write(piece)
    return out.whole()


def taken(places: range | array, at: np.ndarray) -> np.ndarray:
    return places.start + at * places.step if isinstance(places, range) else np.frombuffer(places, np.int64)[at]


def byte_layer(layer: Layer, start: int, end: int, text: str, sizes: np.ndarray) -> Layer:
    """A layer of the text that base64 from start to end holds; ``sizes`` tells how many of its bytes each character is."""
    run = layer.text[start:end]
    if any(c in run for c in BREAKS):
        places = start + np.flatnonzero(~np.isin(code_points(run), [ord(c) for c in BREAKS]))
    else:
        places = np.arange(start, end)
    behind = np.cumsum(sizes)  # byte i stands in digits 4 * i // 3 to (4 * (i + 1) - 1) // 3
    last = len(places) - 1
    starts = taken(layer.starts, places[np.minimum((behind - sizes) * 4 // 3, last)])
    ends = taken(layer.ends, places[np.minimum((4 * behind - 1) // 3, last)])
    return Layer(text, array("q", starts.astype(np.int64).tobytes()), array("q", ends.astype(np.int64).tobytes()))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def base64_layers(layer: Layer, found: dict[tuple[int, int, int], bool]) -> Iterator[Layer]:
    """Layers of the base64 that holds text in UTF-8 or UTF-16; of what holds compressed bytes the matches go to ``found``."""
    for start, end, data, kind in base64_reads(layer.text):
        if kind == "packed":  # compressed bytes have no places of their own
            note_packed(layer, start, end, data, found)
        elif kind == "text" and (text := str(data, "utf-8")):
            codes = code_points(text)
            yield byte_layer(layer, start, end, text, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))
        for wide in (str(recoded, "utf-8") for recoded, _ in utf16_bytes(data) if kind == "wide"):
            yield byte_layer(layer, start, end, wide, 2 + 2 * (code_points(wide) > 0xFFFF).astype(np.int64))


def note_packed(layer: Layer, start: int, end: int, data: bytes | memoryview, found: dict[tuple[int, int, int], bool]) -> None:
    """Matches in compressed bytes cover all that spells these."""
    a, b = layer.original(start, end)
    for kind in packed_kinds(data):
        found.setdefault((a, kind, b), False)


def inner_layers(layer: Layer, found: dict[tuple[int, int, int], bool]) -> Iterator[Layer]:
    """Everything in a layer that decodes to text; matches in compressed bytes go to ``found``."""
    if "%" in layer.text and (inner := replaced(layer, URL_ESCAPES, url_decoded)):
        yield inner
    if "\\" in layer.text and (inner := replaced(layer, UNICODE_ESCAPES, unicode_decoded)):
        yield inner
    for start, end, data in escaped_bytes(layer.text):
        note_packed(layer, start, end, data, found)
    yield from base64_layers(layer, found)


def scan(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, place of the kind, whether base) in order of start and kind; a span found twice counts as base."""
    first = Layer(text, range(len(text)), range(1, len(text) + 1))
    found: dict[tuple[int, int, int], bool] = {(a, kind, b): True for a, b, kind in base_spans(text)}
    seen: set[tuple[int, int, bytes]] = set()
    work = [inner_layers(first, found)] if text else []
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        if not inner.text or (key := inner.key()) in seen:
            continue
        seen.add(key)
        for start, end, kind in base_spans(inner.text):
            a, b = inner.original(start, end)
            found.setdefault((a, kind, b), False)
        work.append(inner_layers(inner, found))
    return [(a, b, kind, base) for (a, kind, b), base in sorted(found.items())]


SPAN = StructType(
    [StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())]
)


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``secrets``: spans (kind, start, end, base) in order of start, then kind.

    ``base`` tells spans that the patterns match in the text as it stands from those that
    only show after decoding; these cover what was encoded.  Null and the empty text have
    none.  Texts of any length are scanned whole.
    """
    fields = StructType([StructField("secrets", ArrayType(SPAN))])

    def maker():
        return lambda texts: [
            [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, b, k, base in scan(t)] if t else [] for t in texts]
        ]

    return append_columns(docs, F.col(f"`{text_col}`"), fields, maker)
