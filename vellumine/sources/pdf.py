"""Reading and writing files of the portable document format: pure functions over bytes, and Spark scans on top.

Files are untrusted: every walk is bounded, nothing recurses without a limit, and what is odd is reported as a
(kind, detail) event instead of an exception.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = 64
DEPTH = 64
TAIL = 1024
INFLATED = 64 * 1024 * 1024
OBJECTS = 8_388_607
#: Dictionaries up to so many bytes are remembered.
SHORT = 512

_WHITE = b"\x00\t\n\x0c\r "
_REF = re.compile(rb"(\d+)\s+(\d+)\s+R\b")
_HEADER = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_HEADER_NEAR = re.compile(rb"\s{0,8}(\d+)\s+(\d+)\s+obj\b")
_SUBSECTION = re.compile(rb"\s*(\d+)\s+(\d+)\s*")
_ROW = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
_INTEGER = re.compile(rb"\s*(-?\d+)\s*$")
_NUMBER = re.compile(rb"\s*([-+]?(?:\d+\.?\d*|\.\d+))")
_ATOM = re.compile(rb"/?[^\s/<>\[\]()]*")
_SPACE = re.compile(rb"[\x00\t\n\x0c\r ]*")
#: What a walk over a dictionary, a string or an array stops at; everything between is passed over at once.
_NESTING = re.compile(rb"<<|>>|\(")
_IN_STRING = re.compile(rb"[()\\]")
_IN_ARRAY = re.compile(rb"[\[\](]")
_PLAIN_STRING = re.compile(rb"\([^()\\]*\)")
#: Bytes that go on with a name.
_NAME_BYTES = bytes(c for c in range(256) if chr(c).isalnum() or c in b"_-.")

Events = list[tuple[str, str]]
Fonts = dict[str, tuple[dict[int, str] | None, int]]

#: Shown text whose baselines differ by no more than this is one line (points).
SAME_LINE = 4.0
#: A gap in a shown array from this on (thousandths of the font size) is a blank.
BLANK = 250


class Entry:
    __slots__ = ("offset", "generation", "in_use", "container", "index")

    def __init__(self, offset: int, generation: int, in_use: bool, container: int | None = None, index: int | None = None):
        self.offset, self.generation, self.in_use, self.container, self.index = offset, generation, in_use, container, index


def find_startxref(data: bytes, events: Events) -> int | None:
    """The number after the last startxref, of the file's last KB or else of the whole file."""
    at = data.rfind(b"startxref", max(0, len(data) - TAIL))
    if at < 0:
        at = data.rfind(b"startxref")
        if at < 0:
            events.append(("startxref-missing", ""))
            return None
        events.append(("startxref-before-tail", str(at)))
    m = re.match(rb"startxref\s*(\d+)", data[at : at + 64])
    return int(m[1]) if m else None


def inflate(data: bytes, most: int = INFLATED) -> bytes:
    """zlib, else raw deflate; more than most bytes is an error."""
    for bits in (15, -15):
        try:
            d = zlib.decompressobj(bits)
            out = d.decompress(data, most + 1)
        except zlib.error:
            continue
        if len(out) > most:
            raise ValueError("stream inflates beyond its limit")
        return out
    raise ValueError("stream can't be inflated")


def unpredict(data: bytes, predictor: int, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes PNG predictors (10 to 15) and the TIFF one (2, 8 bits)."""
    width, step = (columns * colors * bits + 7) // 8, max(1, colors * bits // 8)
    if predictor < 2:
        return data
    if predictor == 2:
        rows = [bytearray(data[i : i + width]) for i in range(0, len(data), width)]
        for row in rows:
            for i in range(step, len(row)):
                row[i] = (row[i] + row[i - step]) & 255
        return b"".join(rows)
    if len(data) % (width + 1) == 0 and not data[:: width + 1].strip(b"\2"):  # every row is a difference from the one above
        return np.add.accumulate(np.frombuffer(data, np.uint8).reshape(-1, width + 1)[:, 1:], axis=0, dtype=np.uint8).tobytes()
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        if kind == 2:
            row = bytearray([(x + y) & 255 for x, y in zip(row, above)])
        for i in range(len(row)) if kind in (1, 3, 4) else ():
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            if kind == 4:
                guess = a + b - c
                near = min((abs(guess - a), 0, a), (abs(guess - b), 1, b), (abs(guess - c), 2, c))[2]
            else:
                near = a if kind == 1 else (a + b) // 2
            row[i] = (row[i] + near) & 255
        out += row
        above = bytes(row) + bytes(width - len(row))
    return bytes(out)


def dictionary(data: bytes, at: int) -> bytes:
    """The bytes of the dictionary that opens at or soon after at, nested ones included."""
    start = data.find(b"<<", at, at + 4096)
    if start < 0:
        return b""
    depth, i = 0, start
    while m := _NESTING.search(data, i):
        i = m.end()
        if m[0] == b"<<":
            depth += 1
        elif m[0] == b">>":
            depth -= 1
            if not depth:
                return data[start:i]
        else:
            i = string_end(data, m.start())
    return data[start:]


def string_end(data: bytes, at: int) -> int:
    """Just after the literal string that opens at at."""
    if m := _PLAIN_STRING.match(data, at):
        return m.end()
    depth, i = 0, at
    while m := _IN_STRING.search(data, i):
        i = m.end()
        if m[0] == b"\\":
            i += 1
        elif m[0] == b"(":
            depth += 1
        else:
            depth -= 1
            if not depth:
                return i
    return len(data)


@lru_cache(1024)
def _stops(key: str) -> re.Pattern[bytes]:
    """Nesting, or the key as a whole name."""
    return re.compile(_NESTING.pattern + b"|" + re.escape(b"/" + key.encode()) + b"(?![" + re.escape(_NAME_BYTES) + b"])")


def value(body: bytes, key: str) -> bytes | None:
    """The raw value of a key at the top level of a dictionary."""
    if b"/" + key.encode() not in body:
        return None
    return _short_value(body, key) if len(body) <= SHORT else _value(body, key)


def _value(body: bytes, key: str) -> bytes | None:
    depth, i, stops = 0, 0, _stops(key)
    while m := stops.search(body, i):
        i = m.end()
        if m[0] == b"<<":
            depth += 1
        elif m[0] == b">>":
            depth -= 1
        elif m[0] == b"(":
            i = string_end(body, m.start())
        elif depth == 1:
            return token(body, i)
        else:
            i = m.start() + 1
    return None


#: Short dictionaries recur, within a file and from file to file: what they hold is remembered, of the last ones asked.
_short_value = lru_cache(8192)(_value)


def token(data: bytes, at: int) -> bytes:
    at = _SPACE.match(data, at).end()
    m = _REF.match(data, at)
    if m:
        return m[0]
    if data[at : at + 2] == b"<<":
        return dictionary(data, at)
    first = data[at : at + 1]
    if first == b"(":
        return data[at : string_end(data, at)]
    if first == b"[":
        depth, i = 0, at
        while m := _IN_ARRAY.search(data, i):
            if m[0] == b"(":
                i = string_end(data, m.start())
                continue
            depth, i = depth + (1 if m[0] == b"[" else -1), m.end()
            if not depth:
                return data[at:i]
        return data[at:]
    if first == b"<":
        return data[at : data.find(b">", at) + 1]
    return _ATOM.match(data, at)[0]


def integer(raw: bytes | None, default: int | None = None) -> int | None:
    m = _INTEGER.match(raw or b"")
    return int(m[1]) if m else default


def number(raw: bytes | None, default: float = 0.0) -> float:
    m = _NUMBER.match(raw or b"")
    return float(m[1]) if m else default


def reference(raw: bytes | None) -> int | None:
    m = _REF.match(raw or b"")
    return int(m[1]) if m else None


def text(raw: bytes | None) -> str:
    """A literal or hexadecimal string as text: UTF-16 with its mark, else one byte a character."""
    if not raw:
        return ""
    if raw[:1] == b"(" and b"\\" not in raw:
        data = raw[1:-1]
    elif raw[:1] == b"(":
        out, i, end = bytearray(), 1, len(raw) - 1
        plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while i < end:
            c = raw[i]
            if c == 0x5C and i + 1 < end:
                m = re.match(rb"[0-7]{1,3}", raw[i + 1 : i + 4])
                if m:
                    out.append(int(m[0], 8) & 255)
                    i += 1 + len(m[0])
                    continue
                c = raw[i + 1]
                i += 2
                if c in b"\r\n":
                    i += c == 13 and raw[i : i + 1] == b"\n"
                    continue
                out.append(plain.get(c, c))
                continue
            out.append(c)
            i += 1
        data = bytes(out)
    elif raw[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        return raw.decode("latin-1")
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


class File:
    """Cross-reference table, objects and structure of one file."""

    def __init__(self, data: bytes):
        self.data, self.events = data, []
        self.sections: list[int] = []
        self.trailer = b""
        self.table: dict[int, Entry] = {}
        self.held: dict[int, dict[int, bytes]] = {}
        self.budget = INFLATED
        self._bodies: dict[int, bytes] = {}
        self._sections: dict[int, tuple[dict[int, Entry], bytes] | None] = {}
        self._pages: list[int] | None = None
        if not data.startswith(b"%PDF-"):
            self.events.append(("header-missing", ""))
        start = find_startxref(data, self.events)
        if start is None or not self._chain(start):
            self._rebuild()

    def _merge(self, entries: dict[int, Entry]) -> None:
        """Newer sections come first; a free entry of offset 0 leaves room for an older one."""
        for n, e in entries.items():
            if n not in self.table and (e.offset or e.in_use):
                self.table[n] = e

    def _chain(self, start: int) -> bool:
        at: int | None = start
        while at is not None and at not in self.sections and len(self.sections) < SECTIONS:
            got = self._section(at)
            if got is None:
                if not self.sections:
                    return False
                self.events.append(("section-unreadable", str(at)))
                break
            entries, trailer = got
            self.sections.append(at)
            self.trailer = self.trailer or trailer
            self._merge(entries)
            hybrid = integer(value(trailer, "XRefStm"))
            if hybrid is not None and (more := self._stream(hybrid)):
                self._merge(more[0])
            at = integer(value(trailer, "Prev"))
        return bool(self.table)

    def _section(self, at: int) -> tuple[dict[int, Entry], bytes] | None:
        """Entries and trailer of the section at at; one that is odd is read, and reported, each time."""
        if at in self._sections:
            return self._sections[at]
        before = len(self.events)
        got = self._classic(at) if self.data[at : at + 4] == b"xref" else self._stream(at)
        if len(self.events) == before:
            self._sections[at] = got
        return got

    def _classic(self, at: int) -> tuple[dict[int, Entry], bytes] | None:
        entries: dict[int, Entry] = {}
        i = at + 4
        while True:
            m = _SUBSECTION.match(self.data, i)
            if not m:
                break
            first, count, i = int(m[1]), int(m[2]), m.end()
            if first + count > OBJECTS:
                self.events.append(("subsection-out-of-range", str(first)))
                break
            for n in range(first, first + count):
                m = _ROW.match(self.data, i)
                if not m:
                    self.events.append(("entry-unreadable", str(n)))
                    break
                entries[n] = Entry(int(m[1]), int(m[2]), m[3] == b"n")
                i = m.end()
        m = re.compile(rb"\s*trailer").match(self.data, i)
        return (entries, dictionary(self.data, m.end())) if m else None

    def _stream(self, at: int) -> tuple[dict[int, Entry], bytes] | None:
        body = dictionary(self.data, at)
        if not _HEADER.match(self.data, at) or b"/XRef" not in body:
            return None
        try:
            raw = self.stream_at(at)
        except ValueError as e:
            self.events.append(("xref-stream-unreadable", str(e)))
            return None
        widths = [int(x) for x in re.findall(rb"\d+", value(body, "W") or b"")]
        if len(widths) != 3 or not 0 < sum(widths) <= 64:
            return None
        size = integer(value(body, "Size"), 0)
        spans = [int(x) for x in re.findall(rb"\d+", value(body, "Index") or b"")] or [0, size]
        entries, i = {}, 0
        if widths == [1, 4, 2]:
            rows = struct.iter_unpack(">BIH", raw[: len(raw) // 7 * 7])
            for first, count in zip(spans[::2], spans[1::2]):
                for n, (kind, a, b) in zip(range(first, min(first + count, OBJECTS)), rows):
                    entries[n] = Entry(0, 0, True, a, b) if kind == 2 else Entry(a, b, kind == 1)
            return entries, body
        for first, count in zip(spans[::2], spans[1::2]):
            for n in range(first, min(first + count, OBJECTS)):
                if i + sum(widths) > len(raw):
                    break
                fields = []
                for w in widths:
                    fields.append(int.from_bytes(raw[i : i + w], "big") if w else None)
                    i += w
                kind = 1 if fields[0] is None else fields[0]
                a, b = fields[1] or 0, fields[2] or 0
                entries[n] = Entry(0, 0, True, a, b) if kind == 2 else Entry(a, b, kind == 1)
        return entries, body

    def _rebuild(self) -> None:
        self.events.append(("xref-rebuilt", ""))
        self.table = {}
        self._bodies = {}
        for m in _HEADER.finditer(self.data):
            if int(m[1]) < OBJECTS:
                self.table[int(m[1])] = Entry(m.start(), int(m[2]), True)
        for m in re.finditer(rb"trailer", self.data):
            body = dictionary(self.data, m.end())
            if value(body, "Root"):
                self.trailer = body
        if not self.trailer:
            for n, e in self.table.items():
                if re.search(rb"/Type\s*/Catalog", self.object(n)):
                    self.trailer = b"<< /Root %d 0 R >>" % n

    def stream_at(self, at: int) -> bytes:
        body = dictionary(self.data, at)
        start = self.data.find(b"stream", self.data.find(body, at) + len(body))
        if start < 0:
            raise ValueError("no stream")
        start += 6
        start += 2 if self.data[start : start + 2] == b"\r\n" else 1
        length = integer(value(body, "Length"))
        if length is None and (n := reference(value(body, "Length"))):
            length = integer(self.object(n))
        end = start + length if length is not None and self.data[start + length : start + length + 20].lstrip(_WHITE).startswith(b"endstream") else self.data.find(b"endstream", start)
        return self.decoded(self.data[start : end if end >= 0 else len(self.data)], body)

    def decoded(self, raw: bytes, body: bytes) -> bytes:
        filters = re.findall(rb"/(\w+)", value(body, "Filter") or b"")
        if not filters:
            return raw
        if filters != [b"FlateDecode"]:
            raise ValueError("filter not supported")
        out = inflate(raw, self.budget)
        self.budget -= len(out)
        parms = value(body, "DecodeParms") or b""
        return unpredict(out, integer(value(parms, "Predictor"), 1), integer(value(parms, "Columns"), 1), integer(value(parms, "Colors"), 1), integer(value(parms, "BitsPerComponent"), 8)) if parms else out

    def object(self, number: int) -> bytes:
        """An object's body, empty where there is none; its header is checked."""
        if number in self._bodies:
            return self._bodies[number]
        e = self.table.get(number)
        if e is None or not e.in_use:
            return b""
        if e.container is not None:
            return self._members(e.container).get(number, b"")
        m = _HEADER_NEAR.match(self.data, e.offset)
        misplaced = not m or int(m[1]) != number
        if misplaced:
            self.events.append(("object-misplaced", str(number)))
            found = [x for x in re.finditer(rb"(?<!\d)%d\s+\d+\s+obj\b" % number, self.data)]
            if not found:
                return b""
            m = found[-1]
        end = self.data.find(b"endobj", m.end())
        body = self.data[m.end() : end if end >= 0 else len(self.data)].strip(_WHITE)
        if not misplaced:  # a misplaced one is reported each time
            self._bodies[number] = body
        return body

    def whole(self, number: int) -> bytes:
        """An object's body with its stream, whose bytes may look like an object's end."""
        e = self.table.get(number)
        body = self.object(number)
        if e is None or e.container is not None or body[:2] != b"<<":
            return body
        head = dictionary(body, 0)
        length = integer(self.resolved(value(head, "Length")))
        at = self.data.find(head, e.offset)
        m = re.compile(rb"\s*stream\r?\n").match(self.data, at + len(head)) if at >= 0 and head else None
        if not m or length is None or not self.data[m.end() + length : m.end() + length + 20].lstrip(_WHITE).startswith(b"endstream"):
            return body
        return head + b"\nstream\n" + self.data[m.end() : m.end() + length] + b"\nendstream"

    def _members(self, container: int) -> dict[int, bytes]:
        if container not in self.held:
            self.held[container] = {}
            e = self.table.get(container)
            if e is not None and e.container is None and e.in_use:
                try:
                    body, data = dictionary(self.data, e.offset), self.stream_at(e.offset)
                    first, count = integer(value(body, "First"), 0), integer(value(body, "N"), 0)
                    heads = [int(x) for x in re.findall(rb"\d+", data[:first])][: 2 * count]
                    places = heads[1::2] + [len(data) - first]
                    self.held[container] = {n: data[first + a : first + max(a, b)].strip(_WHITE) for n, a, b in zip(heads[::2], places, places[1:])}
                except ValueError as x:
                    self.events.append(("object-stream-unreadable", str(x)))
        return self.held[container]

    @property
    def root(self) -> int | None:
        return reference(value(self.trailer, "Root"))

    def resolved(self, raw: bytes | None) -> bytes:
        n = reference(raw)
        return self.object(n) if n is not None else raw or b""

    def pages(self) -> list[int]:
        """Leaves of the page tree in order; loops and too deep branches are left out and reported, once."""
        if self._pages is not None:
            return self._pages
        out: list[int] = []
        seen: set[int] = set()
        stack = [(reference(value(self.object(self.root or 0), "Pages")), 0)]
        while stack:
            n, depth = stack.pop()
            if n is None:
                continue
            if n in seen or depth > DEPTH:
                self.events.append(("page-tree-loop" if n in seen else "page-tree-too-deep", str(n)))
                continue
            seen.add(n)
            body = self.object(n)
            kids = value(body, "Kids")
            if kids is None:
                out.append(n)
            else:
                stack += [(int(m[1]), depth + 1) for m in reversed(list(_REF.finditer(self.resolved(kids))))]
        self._pages = out
        return out

    def attribute(self, page: int, key: str) -> bytes:
        """A page's value of a key, or that of the nearest node above it that has one."""
        node: int | None = page
        for _ in range(DEPTH + 1):
            body = self.object(node or 0)
            if (raw := value(body, key)) is not None:
                return self.resolved(raw)
            node = reference(value(body, "Parent"))
            if node is None:
                break
        return b""

    def box(self, page: int, key: str) -> tuple[float, float, float, float] | None:
        """left, bottom, right, top of a rectangle, whatever the order of its corners."""
        raw = self.attribute(page, key)
        got = [float(x) for x in re.findall(rb"[-+]?(?:\d+\.?\d*|\.\d+)", raw)] if not _REF.search(raw) else [number(self.resolved(m[0])) for m in _REF.finditer(raw)]
        return (min(got[0], got[2]), min(got[1], got[3]), max(got[0], got[2]), max(got[1], got[3])) if len(got) == 4 else None

    def page_metas(self) -> list[dict]:
        """index (from 0), width, height and rotation of each page, as it is seen.

        The crop box counts as far as the media box reaches; without any the page is a letter page. Rotations by
        other than quarter turns count as none, and width and height change places with the odd ones.
        """
        out = []
        for i, n in enumerate(self.pages()):
            media = self.box(n, "MediaBox") or (0.0, 0.0, 612.0, 792.0)
            crop = self.box(n, "CropBox") or media
            seen = (max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3]))
            if seen[0] >= seen[2] or seen[1] >= seen[3]:
                seen = media
            turn = integer(self.attribute(n, "Rotate"), 0) % 360
            turn = turn if turn % 90 == 0 else 0
            size = seen[2] - seen[0], seen[3] - seen[1]
            out.append({"index": i, "width": size[turn % 180 == 90], "height": size[turn % 180 == 0], "rotation": turn})
        return out

    def _destination(self, raw: bytes | None, names: int = 8) -> int | None:
        """The page object that a destination names: an array, a dictionary with one, or a name for either."""
        for _ in range(names):
            raw = self.resolved(raw)
            if raw[:1] == b"[":
                m = _REF.search(raw)
                return int(m[1]) if m else None
            if raw[:2] == b"<<":
                raw = value(raw, "D")
            elif raw[:1] == b"/":
                raw = value(self.resolved(value(self.object(self.root or 0), "Dests")), raw[1:].decode("latin-1"))
            elif raw[:1] in (b"(", b"<"):
                raw = self._named(raw_bytes(raw))
            else:
                return None
        return None

    def _named(self, name: bytes) -> bytes | None:
        """What the name tree of destinations holds under a name."""
        stack, seen = [(self.resolved(value(self.resolved(value(self.object(self.root or 0), "Names")), "Dests")), 0)], 0
        while stack and seen < 2000:
            node, depth = stack.pop()
            seen += 1
            pairs, i = self.resolved(value(node, "Names"))[1:-1], 0
            while i < len(pairs):
                key = token(pairs, i)
                i = pairs.find(key, i) + max(1, len(key))
                held = token(pairs, i)
                i = pairs.find(held, i) + max(1, len(held))
                if key[:1] in (b"(", b"<") and raw_bytes(key) == name:
                    return held
            if depth < 8:
                stack += [(self.object(int(m[1])), depth + 1) for m in _REF.finditer(self.resolved(value(node, "Kids")))]
        return None

    def outline(self, most: int = 100_000) -> list[dict]:
        """Bookmarks in reading order: ordinal, parent (an ordinal, None at the top), depth, title and page (from 0).

        A bookmark without a destination that can be followed points at the first page. Loops, branches that are too
        deep, and what goes beyond most bookmarks are left out and reported.
        """
        places = {n: i for i, n in enumerate(self.pages())}
        out: list[dict] = []
        seen: set[int] = set()
        root = self.resolved(value(self.object(self.root or 0), "Outlines"))
        stack: list[tuple[int | None, int | None, int]] = [(reference(value(root, "First")), None, 0)]
        while stack:
            n, parent, depth = stack.pop()
            if n is None:
                continue
            if n in seen or depth > DEPTH or len(out) >= most:
                self.events.append(("outline-loop" if n in seen else "outline-too-large", str(n)))
                continue
            seen.add(n)
            body = self.object(n)
            action = self.resolved(value(body, "A"))
            to = value(body, "Dest")
            if to is None and value(action, "S") == b"/GoTo":
                to = value(action, "D")
            out.append({"ordinal": len(out), "parent": parent, "depth": depth, "title": text(self.resolved(value(body, "Title"))), "page": places.get(self._destination(to), 0)})
            stack.append((reference(value(body, "Next")), parent, depth))
            stack.append((reference(value(body, "First")), len(out) - 1, depth + 1))
        return out

    def contents(self, page: int) -> bytes:
        """A page's content streams, one after another."""
        raw = value(self.object(page), "Contents") or b""
        if reference(raw) is not None and (listed := self.object(reference(raw) or 0))[:1] == b"[":
            raw = listed
        data = b""
        for m in _REF.finditer(raw):
            e = self.table.get(int(m[1]))
            if e is None or not e.in_use or e.container is not None:
                self.events.append(("content-missing", m[1].decode()))
                continue
            try:
                data += self.stream_at(e.offset) + b"\n"
            except ValueError as x:
                self.events.append(("content-unreadable", str(x)))
        return data

    def fonts(self, page: int) -> Fonts:
        """By name: the font's map to text, None where it has none, and the bytes of a code."""
        out: Fonts = {}
        names = self.resolved(value(self.attribute(page, "Resources"), "Font"))
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", names):
            body = self.object(int(n))
            entry, known = self.table.get(reference(value(body, "ToUnicode")) or 0), None
            if entry is not None and entry.container is None:
                try:
                    known = to_unicode(self.stream_at(entry.offset))
                except ValueError as e:
                    self.events.append(("cmap-unreadable", str(e)))
            out[name.decode("latin-1")] = (known, 2 if b"/Type0" in body else 1)
        return out

    def summary(self) -> dict:
        catalog = self.object(self.root or 0)
        tree = self.object(reference(value(catalog, "Pages")) or 0)
        form = self.resolved(value(catalog, "AcroForm"))
        names = self.resolved(value(catalog, "Names"))
        mark = self.resolved(value(catalog, "MarkInfo"))
        return {
            "page_count_declared": integer(value(tree, "Count"), 0), "page_count_walked": len(self.pages()), "has_acroform": bool(form), "has_xfa": value(form, "XFA") is not None,
            "has_js": b"/JS" in catalog or b"/JavaScript" in names, "is_tagged": value(mark, "Marked") == b"true" and value(catalog, "StructTreeRoot") is not None,
            "sig_count": sum(len(re.findall(rb"/FT\s*/Sig\b", self.object(n))) for n in self._fields(form)), "is_encrypted": value(self.trailer, "Encrypt") is not None,
            "objects": sum(e.in_use for e in self.table.values()), "revisions": len(self.revisions()), "leniency": [f"{k}:{d}" if d else k for k, d in self.events],
        }

    def _fields(self, form: bytes) -> list[int]:
        out, stack = [], [(int(m[1]), 0) for m in _REF.finditer(value(form, "Fields") or b"")]
        while stack and len(out) < 100_000:
            n, depth = stack.pop(0)
            if n in out or depth > 32:
                continue
            out.append(n)
            stack += [(int(m[1]), depth + 1) for m in _REF.finditer(value(self.object(n), "Kids") or b"")]
        return out

    def form_fields(self) -> list[dict]:
        """Leaves of the field tree: dotted name, type, value, flags."""
        form = self.resolved(value(self.object(self.root or 0), "AcroForm"))
        out: list[dict] = []
        stack = [(int(m[1]), "", b"", 0) for m in reversed(list(_REF.finditer(self.resolved(value(form, "Fields")))))]
        seen: set[int] = set()
        while stack:
            n, prefix, kind, depth = stack.pop()
            if n in seen or depth > 32:
                continue
            seen.add(n)
            body = self.object(n)
            own = text(value(body, "T"))
            name = ".".join(x for x in (prefix, own) if x)
            kind = value(body, "FT") or kind
            kids = [int(m[1]) for m in _REF.finditer(self.resolved(value(body, "Kids")))]
            named = [k for k in kids if value(self.object(k), "T")]
            if named:
                stack += [(k, name, kind, depth + 1) for k in reversed(named)]
            else:
                flags = integer(value(body, "Ff"), 0)
                out.append({"name": name, "type": kind.decode("latin-1").lstrip("/"), "value": text(value(body, "V")), "flags": flags, "read_only": bool(flags & 1), "required": bool(flags & 2)})
        return out

    def layers(self) -> list[dict]:
        """Optional-content groups; the base state says which list is asked."""
        props = self.resolved(value(self.object(self.root or 0), "OCProperties"))
        config = self.resolved(value(props, "D"))
        listed = lambda body, key: [int(m[1]) for m in _REF.finditer(self.resolved(value(body, key)))]
        on, off, base = set(listed(config, "ON")), set(listed(config, "OFF")), value(config, "BaseState") != b"/OFF"
        return [{"obj": n, "name": text(value(self.object(n), "Name")) or f"Layer {i}", "visible": n not in off if base else n in on} for i, n in enumerate(listed(props, "OCGs"), 1)]

    def attachments(self, most: int = 256 * 1024 * 1024) -> list[dict]:
        """Names of embedded files and their bytes (None where they can't be decoded)."""
        names = self.resolved(value(self.object(self.root or 0), "Names"))
        stack, out, seen = [(self.resolved(value(names, "EmbeddedFiles")), 0)], [], 0
        while stack and seen < 2000:
            node, depth = stack.pop()
            seen += 1
            if depth > 8:
                continue
            stack += [(self.object(int(m[1])), depth + 1) for m in reversed(list(_REF.finditer(self.resolved(value(node, "Kids")))))]
            pairs = self.resolved(value(node, "Names"))
            for m in re.finditer(rb"(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)\s*(\d+)\s+\d+\s+R", pairs):
                spec = self.object(int(m[2]))
                stream = reference(value(self.resolved(value(spec, "EF")), "F"))
                e = self.table.get(stream or 0)
                try:
                    data = self.stream_at(e.offset) if e and e.container is None else None
                except ValueError:
                    data = None
                out.append({"name": text(value(spec, "UF")) or text(value(spec, "F")) or text(m[1]), "data": data if data is None or len(data) <= most else None})
        return out

    def comments(self) -> list[dict]:
        """Annotations that say something, in page order; page counts from 1."""
        out = []
        for page, n in enumerate(self.pages(), 1):
            for m in _REF.finditer(self.resolved(value(self.object(n), "Annots"))):
                body = self.object(int(m[1]))
                kind = (value(body, "Subtype") or b"").decode("latin-1").lstrip("/")
                if kind and kind not in ("Link", "Popup", "Widget", "Screen"):
                    out.append({"page": page, "subtype": kind, "author": text(value(body, "T")), "contents": text(value(body, "Contents")), "modified": text(value(body, "M")), "is_reply": value(body, "IRT") is not None})
        return out

    def revisions(self) -> list[dict]:
        """Saved states, oldest first: where the section and the state end, bytes added and objects written."""
        out, before = [], 0
        for i, at in enumerate(sorted(self.sections), 1):
            mark = self.data.find(b"%%EOF", at)
            end = mark + 5 if mark >= 0 else len(self.data)
            got = self._section(at)
            written = sum(e.in_use and (e.offset != 0 or e.container is not None) for e in got[0].values()) if got else 0
            out.append({"number": i, "xref_offset": at, "end_offset": end, "bytes": end - before, "objects_written": written})
            before = end
        return out

    def shown(self) -> list[tuple[bytes, Fonts]]:
        """What page_texts() is read from: contents and fonts of each page."""
        return [(self.contents(n), self.fonts(n)) for n in self.pages()]

    def page_texts(self) -> list[list[str]]:
        """Lines of shown text of each page, in the order in which they are shown."""
        return [text_lines(self.contents(n), self.fonts(n), self.events) for n in self.pages()]


def to_unicode(cmap: bytes) -> dict[int, str]:
    """Codes to text from bfchar and bfrange parts of a character map."""
    out: dict[int, str] = {}
    wide = lambda h: bytes.fromhex((h + "0" * (-len(h) % 4))).decode("utf-16-be", "replace")
    clean = lambda b: re.sub(rb"\s", b"", b).decode("latin-1")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>", part):
            out[int(clean(code), 16)] = wide(clean(to))
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to, many in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(?:<([0-9A-Fa-f\s]+)>|\[(.*?)\])", part, re.S):
            first, last = int(clean(low), 16), min(int(clean(high), 16), int(clean(low), 16) + 0xFFFF)
            if to:
                start = wide(clean(to))
                for i in range(first, last + 1):
                    out[i] = start[:-1] + chr(min(ord(start[-1]) + i - first, 0x10FFFF))
            else:
                for i, one in enumerate(re.findall(rb"<([0-9A-Fa-f\s]+)>", many)):
                    if first + i <= last:
                        out[first + i] = wide(clean(one))
    return out


_OPERAND = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(/[^\s/<>\[\]()%]*|\([^()\\]*\)|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*][A-Za-z0-9'\"*]*|<<|\(|<|\[)")
_COMMENT_END = re.compile(rb"[\r\n]|$")
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|[-+]?(?:\d+\.?\d*|\.\d+)|\(", re.S)
_IMAGE_END = re.compile(rb"\sEI(?=[\s/]|$)")


def operations(content: bytes, events: Events) -> Iterator[tuple[bytes, list[bytes]]]:
    """Operators of a content stream with their operands. What is neither is passed over and reported, inline images are skipped."""
    operands: list[bytes] = []
    at, odd = 0, 0
    while at < len(content):
        m = _OPERAND.match(content, at)
        if not m:
            odd += not content[at : at + 1].isspace() and content[at] != 0x25
            end = _COMMENT_END.search(content, at) if content[at] == 0x25 else None
            at = max(at + 1, end.end()) if end else at + 1
            continue
        head, at = m[1], m.end()
        if head == b"<<":
            body = dictionary(content, m.start(1))
            operands.append(body)
            at = m.start(1) + max(2, len(body))
        elif head in (b"(", b"<", b"["):
            raw = token(content, m.start(1))
            operands.append(raw)
            at = m.start(1) + max(1, len(raw))
        elif head[:1] in b"/(0123456789+-.":
            operands.append(head)
        else:
            if head == b"ID" and (end := _IMAGE_END.search(content, at)):
                at = end.end()
            yield head, operands
            operands = []
    if odd:
        events.append(("content-odd", f"{odd} bytes"))


def strings(operand: bytes) -> Iterator[bytes]:
    """The strings of a shown operand; b" " where an array leaves a gap as wide as a blank."""
    if operand[:1] != b"[":
        yield operand
        return
    for m in _SHOWN.finditer(operand):
        if m[0] == b"(":
            continue
        if m[0][:1] in b"(<":
            yield m[0]
        elif float(m[0]) <= -BLANK:
            yield b" "


def decoded_text(raw: bytes, font: tuple[dict[int, str] | None, int]) -> tuple[str, bool]:
    """A shown string as text, and whether that is sure. font: map and bytes a code."""
    data, (known, size) = raw_bytes(raw), font
    if known is None and size == 1:
        return text(raw), data.isascii() or data[:2] == b"\xfe\xff"
    codes = [int.from_bytes(data[i : i + size], "big") for i in range(0, len(data), size)]
    return "".join((known or {}).get(c, "\ufffd") for c in codes), known is not None and all(c in known for c in codes)


def text_lines(content: bytes, fonts: Fonts, events: Events) -> list[str]:
    """Shown text, a line for each baseline. Baselines follow the text and page matrices as far as these don't turn or slant."""
    lines: list[str] = []
    font: tuple[dict[int, str] | None, int] = (None, 1)
    page, saved = (1.0, 0.0), []  # scale and shift of heights
    scale, y, leading = 1.0, 0.0, 0.0
    line_y, moved, lost = 0.0, False, 0

    def show(operand: bytes) -> None:
        nonlocal line_y, moved, lost
        here, shown = page[1] + page[0] * y, ""
        for piece in strings(operand):
            if piece == b" ":
                shown += " "
                continue
            part, sure = decoded_text(piece, font)
            lost += not sure and "\ufffd" in part
            shown += part
        if lines and abs(here - line_y) <= SAME_LINE:
            gap = moved and lines[-1] and shown and not lines[-1].endswith(" ") and not shown.startswith(" ")
            lines[-1] += " " * bool(gap) + shown
        else:
            lines.append(shown)
            line_y = here
        moved = False

    for head, args in operations(content, events):
        x = [number(a) for a in args] if head in (b"TL", b"Td", b"TD", b"Tm", b"cm") else []
        if head == b"BT":
            scale, y, moved = 1.0, 0.0, True
        elif head == b"Tf" and len(args) >= 2:
            font = fonts.get(args[-2].decode("latin-1").lstrip("/"), (None, 1))
        elif head == b"TL" and x:
            leading = x[-1]
        elif head in (b"Td", b"TD") and len(x) >= 2:
            y, moved = y + x[-1] * scale, True
            leading = -x[-1] if head == b"TD" else leading
        elif head == b"Tm" and len(x) >= 6:
            scale, y, moved = x[-3], x[-1], True
        elif head == b"cm" and len(x) >= 6:
            page = page[0] * x[-3], page[1] + page[0] * x[-1]
        elif head == b"q":
            saved.append(page)
        elif head == b"Q" and saved:
            page = saved.pop()
        elif head == b"T*":
            y, moved = y - leading * scale, True
        elif head in (b"'", b'"') and args:
            y, moved = y - leading * scale, True
            show(args[-1])
        elif head in (b"Tj", b"TJ") and args:
            show(args[-1])
    if lost:
        events.append(("text-undecodable", f"{lost} strings"))
    return lines


def marked_text(content: bytes, fonts: Fonts, events: Events | None = None) -> tuple[dict[int, str], bool]:
    """Text by marked-content id, and whether all of it could be decoded."""
    out: dict[int, str] = {}
    open_: list[int | None] = []
    font: tuple[dict[int, str] | None, int] = (None, 1)
    every = True
    for head, args in operations(content, events if events is not None else []):
        if head in (b"BDC", b"BMC"):
            open_.append(integer(value(args[-1], "MCID")) if head == b"BDC" and args and args[-1][:2] == b"<<" else None)
            if open_[-1] is not None:
                out.setdefault(open_[-1], "")
        elif head == b"EMC" and open_:
            open_.pop()
        elif head == b"Tf" and len(args) >= 2:
            font = fonts.get(args[-2].decode("latin-1").lstrip("/"), (None, 1))
        elif head in (b"Tj", b"TJ", b"'", b'"') and args:
            inside = next((i for i in reversed(open_) if i is not None), None)
            for piece in strings(args[-1]) if inside is not None else ():
                if piece != b" ":
                    part, sure = decoded_text(piece, font)
                    every = every and sure
                    out[inside] += part
    return out, every


def raw_bytes(raw: bytes) -> bytes:
    """The bytes of a string object, without any reading as text."""
    if raw[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if b"\\" not in raw:
        return raw[1:-1]
    mark = text(b"(" + b" " + raw[1:])  # the blank keeps a UTF-16 mark from being taken as one
    return mark[1:].encode("latin-1")


class Reader:
    """The reading order of a tagged file."""

    def __init__(self, file: File):
        self.file, self.pages = file, {n: i for i, n in enumerate(file.pages())}
        self.content: dict[int, dict[int, str]] = {}
        self.unreliable = False
        self.missing = 0

    def of(self, page: int) -> dict[int, str]:
        if page not in self.content:
            f = self.file
            self.content[page], sure = marked_text(f.contents(page), f.fonts(page), f.events)
            self.unreliable = self.unreliable or not sure
        return self.content[page]

    def blocks(self, depth: int = 128) -> list[dict]:
        """page (from 0), element and text in structure order; neighbours of one element occurrence are one block."""
        f = self.file
        root = f.resolved(value(f.object(f.root or 0), "StructTreeRoot"))
        out: list[dict] = []
        seen: set[int] = set()
        stack: list[tuple[bytes, str, int | None, int, object]] = [(value(root, "K") or b"", "", None, 0, None)]
        while stack:
            raw, tag, page, level, owner = stack.pop()
            raw = raw.strip()
            if level > depth:
                continue
            if raw[:1] == b"[":
                inner, i, items = raw[1:-1], 0, []
                while i < len(inner):
                    if inner[i] in _WHITE:
                        i += 1
                        continue
                    t = token(inner, i)
                    items.append(t)
                    i = inner.find(t, i) + max(1, len(t))
                stack += [(t, tag, page, level + 1, owner) for t in reversed(items)]
                continue
            n = reference(raw)
            if n is not None:
                if n in seen:
                    continue
                seen.add(n)
                raw, owner = f.object(n), n
            mcid = integer(raw)
            if mcid is None and value(raw, "MCID") is not None:
                mcid, page = integer(value(raw, "MCID")), reference(value(raw, "Pg")) or page
            if mcid is not None:
                held = self.of(page).get(mcid) if page in self.pages else None
                if held is None:
                    self.missing += 1
                elif held:
                    if out and out[-1]["owner"] == owner and out[-1]["page"] == self.pages[page]:
                        out[-1]["text"] += held
                    else:
                        out.append({"page": self.pages[page], "element": tag, "text": held, "owner": owner})
            elif raw[:2] == b"<<":
                own = (value(raw, "S") or b"").decode("latin-1").lstrip("/") or tag
                page = reference(value(raw, "Pg")) or page
                alt = text(value(raw, "Alt"))
                if alt:
                    out.append({"page": self.pages.get(page, 0), "element": own, "text": f"[{own}: {alt}]", "owner": owner})
                elif value(raw, "K") is not None:
                    stack.append((value(raw, "K"), own, page, level + 1, owner))
        return [{k: v for k, v in b.items() if k != "owner"} for b in out]


def signatures(file: File) -> list[dict]:
    """Signature dictionaries: byte range, contents, signer, reason, time and permission level (None where not said)."""
    out = []
    for n, e in sorted(file.table.items()):
        body = file.object(n) if e.in_use else b""
        if value(body, "Type") != b"/Sig" and not (value(body, "ByteRange") and value(body, "Contents")):
            continue
        level = re.search(rb"/DocMDP\b.*?/P\s+(\d)", body, re.S) or re.search(rb"/P\s+(\d).*?/DocMDP\b", body, re.S)
        out.append({
            "obj": n, "byte_range": [int(x) for x in re.findall(rb"\d+", value(body, "ByteRange") or b"")], "contents": raw_bytes(value(body, "Contents") or b"<>"),
            "name": text(value(body, "Name")), "reason": text(value(body, "Reason")), "time": text(value(body, "M")), "level": int(level[1]) if level else None,
        })
    return out


def literal(s: str) -> bytes:
    """A string object; UTF-16 where Latin-1 doesn't reach or where its mark could be misread."""
    try:
        data = s.encode("latin-1")
        if data[:2] == b"\xfe\xff":
            raise UnicodeError
    except UnicodeError:
        data = b"\xfe\xff" + s.encode("utf-16-be")
    return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def write(pages: list[list[str]], compress: bool = True) -> bytes:
    """A file with one text line per string."""
    bodies: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for lines in pages:
        content = b"BT /F1 10 Tf 12 TL 72 720 Td\n" + b"".join(literal(x) + b" Tj T*\n" for x in lines) + b"ET"
        data = zlib.compress(content) if compress else content
        bodies.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" * compress, data))
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R >>" % len(bodies))
        kids.append(len(bodies))
    bodies[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    return append(b"%PDF-1.7\n", dict(enumerate(bodies, 1)), b"/Root 1 0 R", None)


def append(data: bytes, objects: dict[int, bytes], trailer: bytes, prev: int | None) -> bytes:
    """The file with objects added, a section of consecutive runs, and a trailer that points back."""
    out, places = bytearray(data), {}
    for n in sorted(objects):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, objects[n])
    start = len(out)
    out += b"xref\n"
    numbers = sorted(places) if prev is not None else [0, *sorted(places)]
    runs: list[list[int]] = []
    for n in numbers:
        if runs and runs[-1][-1] == n - 1:
            runs[-1].append(n)
        else:
            runs.append([n])
    for run in runs:
        out += b"%d %d\n" % (run[0], len(run))
        for n in run:
            out += b"0000000000 65535 f \n" if n == 0 else b"%010d 00000 n \n" % places[n]
    size = max(places, default=0) + 1
    out += b"trailer\n<< /Size %d %s%s >>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, b" /Prev %d" % prev if prev is not None else b"", start)
    return bytes(out)


def compact(objects: dict[int, bytes], trailer: bytes) -> bytes:
    """A file whose plain objects stand in an object stream, and whose section is a stream of predicted rows."""
    inside = [n for n in sorted(objects) if b"endstream" not in objects[n]]
    holder, section = max(objects) + 1, max(objects) + 2
    head, body = b"", b""
    for n in inside:
        head += b"%d %d " % (n, len(body))
        body += objects[n] + b" "
    packed = zlib.compress(head + body)
    rest = {n: b for n, b in objects.items() if n not in inside}
    rest[holder] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(inside), len(head), len(packed), packed)
    out, rows = bytearray(b"%PDF-1.7\n"), {0: (0, 0, 65535)}
    for n in sorted(rest):
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, rest[n])
    rows |= {n: (2, holder, i) for i, n in enumerate(inside)}
    rows[section] = (1, len(out), 0)
    plain = b"".join([struct.pack(">BIH", *rows.get(n, (0, 0, 65535))) for n in range(section + 1)])
    steps = np.diff(np.frombuffer(plain, np.uint8).reshape(-1, 7), axis=0, prepend=np.zeros((1, 7), np.uint8))  # rows as differences from the one above
    table = zlib.compress(np.insert(steps, 0, 2, axis=1).tobytes())
    parms = b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>"
    start = len(out)
    out += b"%d 0 obj\n<< /Type /XRef /W [1 4 2] /Size %d %s %s /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (section, section + 1, trailer, parms, len(table), table, start)
    return bytes(out)


def incremental(data: bytes, objects: dict[int, bytes]) -> bytes:
    """An appended save of changed objects; encrypted files are refused."""
    f = File(data)
    if value(f.trailer, "Encrypt") is not None:
        raise ValueError("an encrypted file can't be saved")
    keep = b" ".join(b"/%s %s" % (k.encode(), v) for k in ("Root", "Info", "ID") if (v := value(f.trailer, k)))
    return append(data, objects, keep, max(f.sections) if f.sections else None)


def entries(body: bytes) -> list[tuple[bytes, bytes]]:
    """Keys and raw values at the top level of a dictionary, in order."""
    out, i = [], 2
    while (at := body.find(b"/", i)) >= 0:
        key = token(body, at)
        held = token(body, at + len(key))
        i = body.find(held, at + len(key)) + len(held) if held else at + len(key)
        out.append((key, held))
    return out


def squeezed(body: bytes) -> bytes:
    """A stream object whose data is deflated anew where that is shorter; anything else as it is."""
    head = dictionary(body, 0) if body[:2] == b"<<" and body.endswith(b"endstream") else b""
    if not head:
        return body
    filters, data = value(head, "Filter"), body[body.find(b"stream\n", len(head)) + 7 : -10]
    if filters not in (None, b"/FlateDecode") or (filters and value(head, "DecodeParms")):
        return body
    try:
        new = zlib.compress(inflate(data) if filters else data, 9)
    except ValueError:
        return body
    if len(new) + (0 if filters else 20) >= len(data):
        return body
    kept = b" ".join(k + b" " + v for k, v in entries(head) if k not in (b"/Filter", b"/Length"))
    return b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (kept, len(new), new)


def rewritten(data: bytes, discard_signatures: bool, change: Callable[[bytes], bytes], save: Callable[[dict[int, bytes], bytes], bytes]) -> bytes:
    """A copy of what the latest revision reaches, each object changed. Encrypted files are refused, and signed ones unless told otherwise."""
    f = File(data)
    if value(f.trailer, "Encrypt") is not None:
        raise ValueError("an encrypted file can't be rewritten")
    if b"/ByteRange" in data and not discard_signatures:
        raise ValueError("a rewrite would break the file's signatures")
    objects: dict[int, bytes] = {}
    roots = {k: v for k in ("Root", "Info") if (v := value(f.trailer, k))}
    open_ = [n for v in roots.values() if (n := reference(v)) is not None]
    while open_:
        n = open_.pop()
        if n in objects or not (body := f.whole(n)):
            continue
        objects[n] = change(body)
        head = dictionary(body, 0) if body[:2] == b"<<" and body.endswith(b"endstream") else body
        open_ += [int(m[1]) for m in _REF.finditer(head)]
    out = save(objects, b" ".join(b"/%s %s" % (k.encode(), v) for k, v in roots.items()))
    again = File(out)
    if len(again.revisions()) != 1 or (again.shown() != f.shown() and again.page_texts() != f.page_texts()):
        raise ValueError("the copy doesn't hold the latest revision and nothing else")
    return out


def plain_file(objects: dict[int, bytes], trailer: bytes) -> bytes:
    return append(b"%PDF-1.7\n", objects, trailer, None)


def latest_only(data: bytes, discard_signatures: bool = False) -> bytes:
    """A copy of only what the latest revision reaches, with its objects as they are."""
    return rewritten(data, discard_signatures, lambda body: body, plain_file)


#: Profiles, and whether they put objects into streams. Images are never resampled.
PROFILES = {"screen": True, "print": True, "archive": False, "custom": True}


def optimized(data: bytes, profile: str, discard_signatures: bool = False) -> bytes:
    """A rewrite with deflated streams, and with object streams where the profile wants them."""
    return rewritten(data, discard_signatures, squeezed, compact if PROFILES[profile] else plain_file)


SUMMARY = "page_count_declared int, page_count_walked int, has_acroform boolean, has_xfa boolean, has_js boolean, is_tagged boolean, sig_count int, is_encrypted boolean, objects int, revisions int, leniency array<string>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length and content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)


def summaries(files: DataFrame, key: str = "path", keep: Sequence[str] = ()) -> DataFrame:
    """files: key and content. One row of structure per file, with the columns to keep; unreadable files have zero pages and events, null ones nulls."""
    names, kept = [x.split()[0] for x in SUMMARY.split(", ")], [key, *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [None if c is None else File(bytes(c)).summary() for c in pdf["content"]]
            yield pd.concat([pdf[kept].reset_index(drop=True), pd.DataFrame([[None if r is None else r[x] for x in names] for r in rows], columns=names, dtype=object)], axis=1)

    kinds = dict(files.dtypes)
    return files.select(*kept, "content").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + f", {SUMMARY}")


def rows_of_files(files: DataFrame, key: str, schema: str, rows: Callable[[File], Iterable[Sequence]]) -> DataFrame:
    """files: key and content. key and what rows() gives for each file, in the columns of schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *row) for k, c in zip(pdf[key], pdf["content"]) for row in rows(File(bytes(c)))], columns=[key, *names])

    kind = dict(files.dtypes)[key]
    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, {schema}")


def texts(files: DataFrame, key: str = "path") -> DataFrame:
    """key, page, line_index, text: lines of shown text."""
    return rows_of_files(files, key, "page int, line_index int, text string", lambda f: [(p, i, t) for p, lines in enumerate(f.page_texts()) for i, t in enumerate(lines)])


def events(files: DataFrame, key: str = "path") -> DataFrame:
    """key, kind, detail: what was odd in reading the structure and all page texts."""
    return rows_of_files(files, key, "kind string, detail string", lambda f: (f.page_texts(), f.events)[1])


def page_metas(files: DataFrame, key: str = "path") -> DataFrame:
    """key, index, width, height, rotation, one row a page."""
    return rows_of_files(files, key, "index int, width double, height double, rotation int", lambda f: [tuple(m.values()) for m in f.page_metas()])


def outlines(files: DataFrame, key: str = "path") -> DataFrame:
    """key, ordinal, parent, depth, title, page, one row a bookmark."""
    rows = rows_of_files(files, key, "ordinal int, parent double, depth int, title string, page int", lambda f: [tuple(m.values()) for m in f.outline()])
    return rows.withColumn("parent", F.when(~F.isnan("parent"), F.col("parent")).cast("int"))


def outline_paths(files: DataFrame, key: str = "path", separator: str = "/") -> DataFrame:
    """The rows of outlines() with path, the titles from the top down to the bookmark; a file's tree is at hand where it is read."""

    def rows(f: File) -> list[tuple]:
        paths: list[str] = []
        out = []
        for m in f.outline():  # a parent comes before what is below it
            paths.append(m["title"] if m["parent"] is None else paths[m["parent"]] + separator + m["title"])
            out.append((*m.values(), paths[-1]))
        return out

    found = rows_of_files(files, key, "ordinal int, parent double, depth int, title string, page int, path string", rows)
    return found.withColumn("parent", F.when(~F.isnan("parent"), F.col("parent")).cast("int"))


def fields(files: DataFrame, key: str = "path") -> DataFrame:
    """key, name, type, value, flags, read_only, required, one row a form field."""
    return rows_of_files(files, key, "name string, type string, value string, flags int, read_only boolean, required boolean", lambda f: [tuple(m.values()) for m in f.form_fields()])


def comments(files: DataFrame, key: str = "path") -> DataFrame:
    """key, page (from 1), subtype, author, contents, modified, is_reply, one row a comment."""
    return rows_of_files(files, key, "page int, subtype string, author string, contents string, modified string, is_reply boolean", lambda f: [tuple(m.values()) for m in f.comments()])


def layers(files: DataFrame, key: str = "path") -> DataFrame:
    """key, obj, name, visible, one row a layer."""
    return rows_of_files(files, key, "obj int, name string, visible boolean", lambda f: [tuple(m.values()) for m in f.layers()])


def attachments(files: DataFrame, key: str = "path") -> DataFrame:
    """key, name, data (null where it can't be decoded), one row an embedded file."""
    return rows_of_files(files, key, "name string, data binary", lambda f: [tuple(m.values()) for m in f.attachments()])


def signed(files: DataFrame, key: str = "path") -> DataFrame:
    """key, obj, byte_range, contents, name, reason, time, level, one row a signature."""
    rows = rows_of_files(files, key, "obj int, byte_range array<long>, contents binary, name string, reason string, time string, level double", lambda f: [tuple(m.values()) for m in signatures(f)])
    return rows.withColumn("level", F.when(~F.isnan("level"), F.col("level")).cast("int"))


def reading_order(files: DataFrame, key: str = "path") -> DataFrame:
    """key, block, page (from 0), element, text: blocks of tagged files in the order of their structure."""
    return rows_of_files(files, key, "block int, page int, element string, text string", lambda f: [(i, b["page"], b["element"], b["text"]) for i, b in enumerate(Reader(f).blocks())])


def sanitized(files: DataFrame, key: str = "path", discard_signatures: bool = False) -> DataFrame:
    """key, revisions_before, bytes_before, content and refused: the rewritten file, or why there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, c in zip(pdf[key], pdf["content"]):
                try:
                    new, why = latest_only(bytes(c), discard_signatures), None
                except ValueError as e:
                    new, why = None, str(e)
                out.append((k, len(File(bytes(c)).revisions()), len(c), new, why))
            yield pd.DataFrame(out, columns=[key, "revisions_before", "bytes_before", "content", "refused"])

    kind = dict(files.dtypes)[key]
    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, revisions_before int, bytes_before long, content binary, refused string")


def optimizations(files: DataFrame, profile_of: Callable[[int], str], key: str = "path") -> DataFrame:
    """key, profile, shorter, in_streams, lines: the rewritten file read again once, with the lines that its pages show."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data in zip(pdf[key], pdf["content"]):
                profile = profile_of(k)
                new = optimized(bytes(data), profile)
                out.append((k, profile, len(new) < len(data), b"/ObjStm" in new, [t for lines in File(new).page_texts() for t in lines]))
            yield pd.DataFrame(out, columns=[key, "profile", "shorter", "in_streams", "lines"])

    kind = dict(files.dtypes)[key]
    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, profile string, shorter boolean, in_streams boolean, lines array<string>")


def written(docs: DataFrame) -> DataFrame:
    """docs: doc_id, pages (array of arrays of lines). doc_id and content of a file each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": [write([list(p) for p in pages]) for pages in pdf["pages"]]})

    return docs.select("doc_id", "pages").mapInPandas(run, "doc_id long, content binary")
