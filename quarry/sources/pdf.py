"""What a PDF file shows and where: runs of text with boxes and sizes, images and drawn paths of each page.

A file is read alone and is bounded; all that needs more than one run (lines, columns, blocks, headings) is
DataFrame work in `quarry.operators.layout`. Read are plain and packed streams, object streams, page trees, forms, simple
fonts and fonts of two-byte codes with their widths and Unicode maps. Codes without a map are taken as cp1252, or as UTF-16 where
they have two bytes. Coordinates are points from the upper left corner of the page.
"""

from __future__ import annotations

import re
import struct
import zlib
from binascii import unhexlify
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

MOST = 200 * 1024 * 1024
DEPTH = 12
#: Where no width is given: an average letter, in thousandths of the size.
WIDTH = 500
_END = rb"\x00\t\n\f\r ()<>\[\]{}/%"
_TOKEN = re.compile(
    rb"(?:[\x00\t\n\f\r ]++|%[^\r\n]*+)*+(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?![^" + _END + rb"])|<(?P<hex>[0-9A-Fa-f\x00\t\n\f\r ]*)>|(?P<open><<|[\[{])|(?P<close>>>|[\]}])"
    rb"|(?P<string>\()|/(?P<name>[^" + _END + rb"]*)|(?P<word>[^" + _END + rb"]+)|(?P<other>.))",
    re.S,
)
#: A line as most writers set it: font, place and one string of hexadecimal digits. Such lines are taken as a whole; values() reads the same from them.
_LINE = re.compile(
    rb"[\t\n\f\r ]*+/([0-9A-Za-z]++)[\t\n\f\r ]++(\d{1,15}+(?:\.\d*+)?)[\t\n\f\r ]++Tf[\t\n\f\r ]++1[\t\n\f\r ]++0[\t\n\f\r ]++0[\t\n\f\r ]++1"
    rb"[\t\n\f\r ]++(-?\d{1,15}+(?:\.\d*+)?)[\t\n\f\r ]++(-?\d{1,15}+(?:\.\d*+)?)[\t\n\f\r ]++Tm[\t\n\f\r ]*+<([0-9A-Fa-f]*+)>[\t\n\f\r ]*+Tj(?![^" + _END + rb"])"
)
_SHORT = re.compile(rb"(?<=[\s>])(?:endobj|stream)\b")
_STREAM = re.compile(rb"[\x00\t\n\f\r ]*stream\r?\n")
_ENDSTREAM = re.compile(rb"\s*endstream")
_KEYWORDS = {b"true": True, b"false": False, b"null": None}
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})[\x00\t\n\f\r ]+\d{1,5}[\x00\t\n\f\r ]+obj\b")
_NUMBERED = re.compile(rb"#([0-9A-Fa-f]{2})")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
PAINT = ("f", "F", "f*", "B", "B*", "b", "b*", "S", "s")


class PdfError(ValueError):
    """A file that is no PDF, is encrypted or is over a limit."""


class Name(str):
    __slots__ = ()


class Word(str):
    """An operator or keyword."""

    __slots__ = ()


@dataclass(slots=True)
class Ref:
    number: int


@dataclass(slots=True)
class Run:
    text: str
    size: float
    box: tuple[float, float, float, float]
    baseline: float


@dataclass
class Page:
    number: int
    width: float = 595.0
    height: float = 842.0
    images: int = 0
    drawings: int = 0
    runs: list[Run] = field(default_factory=list)


def _once(make: Callable[[bytes], object]) -> Callable[[bytes], object]:
    """The same function, whose results for short bytes are made once."""
    known = lru_cache(maxsize=4096)(make)
    return lambda said: known(said) if len(said) <= 64 else make(said)


@_once
def _name(said: bytes) -> Name:
    return Name(_NUMBERED.sub(lambda x: bytes([int(x[1], 16)]), said).decode("latin-1"))


@_once
def _word(said: bytes) -> Word:
    return Word(said.decode("latin-1"))


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose bracket opens at `at`, and where it ends."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            digits = _OCTAL.match(data, i + 1)
            if digits:
                out.append(int(digits[0], 8) & 255)
                i = digits.end()
                continue
            following = data[i + 1 : i + 2]
            if following not in (b"\r", b"\n"):
                out += _ESCAPES.get(following, following)
            elif data[i + 1 : i + 3] == b"\r\n":
                i += 1
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    return bytes(out), i


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """The values and operators of a stretch of PDF syntax, each with the place after it."""
    stack: list[list] = []
    match = _TOKEN.match
    while m := match(data, at):
        kind, at = m.lastgroup, m.end()
        if kind == "number":
            said = m[kind]
            value: object = float(said) if b"." in said else int(said)
        elif kind == "word":
            said = m[kind]
            if said == b"R" and stack and len(stack[-1]) > 2 and isinstance(stack[-1][-2], int):
                stack[-1][-2:] = [Ref(stack[-1][-2])]
                continue
            value = _KEYWORDS[said] if said in _KEYWORDS else _word(said)
        elif kind == "name":
            value = _name(m[kind])
        elif kind == "hex":
            digits = b"".join(m[kind].split())
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode().replace("\0", ""))
        elif kind == "open":
            stack.append([m[kind] == b"<<"])
            continue
        elif kind == "close":
            if not stack:
                continue
            pairs, *held = stack.pop()
            value = dict(zip(held[::2], held[1::2], strict=False)) if pairs else held
        elif kind == "string":
            value, at = _string(data, at - 1)
        else:
            continue
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


@lru_cache(maxsize=1024)
def _known(data: bytes) -> object:
    """The first value of a short stretch, with the place after it: files of one writer have most of their dictionaries in common, and nothing changes them."""
    return next(values(data), (None, 0))


class File:
    """The objects of a file, found by looking for them: damaged cross-reference tables do no harm."""

    def __init__(self, source: bytes) -> None:
        if not source.startswith(b"%PDF-"):
            raise PdfError("malformed")
        if re.search(rb"/Encrypt\s+(?:\d+\s+\d+\s+R|<<)", source):
            raise PdfError("encrypted")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, tuple[dict, bytes]] = {}
        self.unpacked = 0
        #: Fonts by the identity of what describes them, which is held so that it stays theirs.
        self.fonts: dict[int, tuple[dict, Font]] = {}
        at = 0
        while m := _OBJECT.search(source, at):
            at = self._take(source, int(m[1]), m.end())
        for head, raw in list(self.streams.values()):
            if head.get("Type") == "ObjStm":
                self._packed(head, self.unpack(head, raw))

    def _take(self, source: bytes, number: int, at: int) -> int:
        short = _SHORT.search(source, at, at + 256)
        value, end = _known(source[at : short.start()]) if short else (None, 0)
        if isinstance(value, dict):
            end += at
        else:  # long, or cut in a string
            value, end = next(values(source, at), (None, at))
        self.objects[number] = value
        start = _STREAM.match(source, end) if isinstance(value, dict) else None
        if not start:
            return end
        length = self.get(value.get("Length"))
        stop = start.end() + length if isinstance(length, int) and _ENDSTREAM.match(source, start.end() + length) else source.find(b"endstream", start.end())
        stop = stop if stop >= 0 else len(source)
        self.streams[number] = (value, source[start.end() : stop])
        return stop

    def _packed(self, head: dict, data: bytes) -> None:
        first, numbers = int(self.get(head.get("First")) or 0), []
        for value, _ in values(data[:first]):
            numbers.append(value)
        for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
            if isinstance(number, int) and isinstance(offset, int):
                self.objects.setdefault(number, next(values(data, first + offset), (None, 0))[0])

    def unpack(self, head: dict, raw: bytes) -> bytes:
        """The content of a stream; empty where its packing is not known."""
        names = self.get(head.get("Filter"))
        names = names if isinstance(names, list) else [names] if names else []
        for name in names:
            if name not in ("FlateDecode", "Fl"):
                return b""
            try:
                raw = zlib.decompressobj().decompress(raw, MOST - self.unpacked + 1)
            except zlib.error:
                return b""
            self.unpacked += len(raw)
            if self.unpacked > MOST:
                raise PdfError("limit")
        return raw

    def get(self, value: object) -> object:
        for _ in range(DEPTH):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(value.number)
        return value

    def dictionary(self, value: object) -> dict:
        found = self.get(value)
        return found if isinstance(found, dict) else {}

    def content(self, value: object) -> bytes:
        """The content of a stream or of several, which count as one."""
        if isinstance(value, list) or isinstance(self.get(value), list):
            return b"\n".join(self.content(v) for v in (value if isinstance(value, list) else self.get(value)))
        return self.unpack(*self.streams[value.number]) if isinstance(value, Ref) and value.number in self.streams else b""

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        root = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)

        def walk(node: dict, held: dict, depth: int) -> Iterator[dict]:
            held = held | {k: node[k] for k in ("MediaBox", "Resources") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and depth < DEPTH:
                for kid in kids:
                    yield from walk(self.dictionary(kid), held, depth + 1)
            elif node.get("Type") == "Page" or "Contents" in node:
                yield held | node

        if root is not None:
            yield from walk(self.dictionary(root.get("Pages")), {}, 0)


class Font:
    """How codes of a font read and how wide they are."""

    def __init__(self, file: File, about: dict) -> None:
        self.wide = about.get("Subtype") == "Type0"
        self.widths: dict[int, float] = {}
        self.map = _unicode_map(file.content(about.get("ToUnicode"))) if about.get("ToUnicode") else None
        self.default = float(WIDTH)
        if self.wide:
            below = self.dictionary_of(file, about)
            self.default = float(file.get(below.get("DW")) or 1000)
            listed = file.get(below.get("W")) or []
            i = 0
            while i + 1 < len(listed):
                first, second = listed[i], file.get(listed[i + 1])
                if isinstance(second, list):
                    self.widths |= {first + n: float(w) for n, w in enumerate(second)}
                    i += 2
                else:
                    self.widths |= {c: float(listed[i + 2]) for c in range(first, min(second, 65535) + 1)} if i + 2 < len(listed) else {}
                    i += 3
        else:
            first = file.get(about.get("FirstChar")) or 0
            self.widths = {first + n: float(w) for n, w in enumerate(file.get(about.get("Widths")) or []) if isinstance(w, int | float)}

    @staticmethod
    def dictionary_of(file: File, about: dict) -> dict:
        below = file.get(about.get("DescendantFonts"))
        return file.dictionary(below[0]) if isinstance(below, list) and below else {}

    def codes(self, raw: bytes) -> list[int]:
        return list(struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) // 2 * 2])) if self.wide else list(raw)

    def across(self, raw: bytes) -> tuple[int, float]:
        """How many codes there are, and how wide they are together."""
        if self.widths:
            codes = self.codes(raw)
            return len(codes), sum(self.widths.get(c, self.default) for c in codes)
        n = len(raw) // 2 if self.wide else len(raw)
        return n, n * self.default

    @property
    def plain(self) -> bool:
        """Whether codes have two bytes, all the same width, and read as UTF-16."""
        return self.wide and not self.widths and self.map is not None and self.map.even

    def text(self, raw: bytes) -> str:
        if self.wide and self.map is not None and self.map.even:
            return raw[: len(raw) // 2 * 2].decode("utf-16-be", "replace")
        if self.map is not None and (self.map.known or self.map.ranges):
            codes, known = self.codes(raw), self.map.known
            try:
                said = "".join([known[c] for c in codes])
            except KeyError:
                said = "".join(map(self.map.get, codes))
            return said if said.isascii() else said.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")
        if self.wide or raw.startswith(b"\xfe\xff"):
            return raw.removeprefix(b"\xfe\xff").decode("utf-16-be", "replace")
        return raw.decode("cp1252", "replace")


def _texts(digits: list[bytes]) -> list[str]:
    """UTF-16 strings from their hexadecimal digits."""
    if not any(len(d) % 4 for d in digits):
        said = unhexlify(b"".join(digits)).decode("utf-16-be", "replace")
        ends = list(accumulate(len(d) // 4 for d in digits))
        if ends[-1] == len(said):  # a character a code, so nothing met over an edge
            return [said[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    whole = (unhexlify(d + b"0" * (len(d) % 2)) for d in digits)
    return [raw[: len(raw) // 2 * 2].decode("utf-16-be", "replace") for raw in whole]


class UnicodeMap:
    """Code to text from the bfchar and bfrange sections of a map. Ranges stay ranges: a code is looked up when it is met."""

    def __init__(self, data: bytes) -> None:
        self.known: dict[int, str] = {}
        self.ranges: list[tuple[int, int, object]] = []
        held: list = []
        for value, _ in values(data):
            if not isinstance(value, Word):
                held.append(value)
                continue
            number = lambda b: int.from_bytes(b, "big")
            if value == "endbfchar":
                self.known |= {number(a): self._said(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif value == "endbfrange":
                self.ranges += [(number(a), number(b), to) for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
            held = []
        self.ranges.sort(key=lambda r: r[:2])
        self.firsts = [r[0] for r in self.ranges]
        #: Whether every two-byte code is the character of that number.
        self.even = self._is_even()

    def _is_even(self) -> bool:
        upto = 0
        for first, last, to in self.ranges:
            if first != upto or last < first or not isinstance(to, bytes) or len(to) != 2 or int.from_bytes(to, "big") != first:
                return False
            upto = last + 1
        return upto == 1 << 16 and not self.known

    @staticmethod
    def _said(raw: object) -> str:
        return raw.decode("utf-16-be", "surrogatepass") if isinstance(raw, bytes) else ""

    def get(self, code: int) -> str:
        if code not in self.known:
            at = bisect_right(self.firsts, code) - 1
            first, last, to = self.ranges[at] if at >= 0 else (0, -1, b"")
            n = code - first
            if code > last:
                said = ""
            elif isinstance(to, list):
                said = self._said(to[n]) if n < len(to) else ""
            else:
                unit = int.from_bytes(to[-2:], "big") + n if isinstance(to, bytes) else 1 << 16
                said = self._said(to[:-2]) + chr(unit) if unit < 1 << 16 else ""
            self.known[code] = said
        return self.known[code]


@lru_cache(maxsize=16)
def _unicode_map(data: bytes) -> UnicodeMap:
    """Files of one writer have the same map: it is read once for all of them."""
    return UnicodeMap(data)


def _times(a: tuple, b: tuple) -> tuple:
    """The matrix that applies a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Drawing:
    """Walks content streams with their graphics and text state and notes what they show on a page."""

    def __init__(self, file: File, page: Page) -> None:
        self.file, self.page = file, page

    def _font(self, resources: dict, name: str) -> Font:
        about = self.file.dictionary(self.file.dictionary(resources.get("Font")).get(name))
        key = id(about) if about else 0
        if key not in self.file.fonts:
            self.file.fonts[key] = (about, Font(self.file, about))
        return self.file.fonts[key][1]

    def walk(self, data: bytes, resources: dict, base: tuple = SAME, depth: int = 0) -> None:
        state = {"ctm": base, "font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0}
        kept: list[dict] = []
        matrix = line = SAME
        operands: list = []
        start = 0
        while True:
            for value, at in values(data, start):
                if not isinstance(value, Word):
                    operands.append(value)
                    continue
                op, given = str(value), operands
                operands = []
                numbers = [float(x) for x in given if isinstance(x, int | float) and not isinstance(x, bool)]
                if op == "q":
                    kept.append(dict(state))
                elif op == "Q" and kept:
                    state = kept.pop()
                elif op == "cm" and len(numbers) == 6:
                    state["ctm"] = _times(tuple(numbers), state["ctm"])
                elif op == "BT":
                    matrix = line = SAME
                elif op == "Tf" and len(given) == 2 and numbers:
                    state["font"], state["size"] = self._font(resources, str(given[0])), numbers[0]
                elif op in ("Tc", "Tw", "Tz", "TL", "Ts") and numbers:
                    state[op] = numbers[0]
                elif op in ("Td", "TD") and len(numbers) == 2:
                    state["TL"] = -numbers[1] if op == "TD" else state["TL"]
                    matrix = line = _times((1, 0, 0, 1, *numbers), line)
                elif op == "Tm" and len(numbers) == 6:
                    matrix = line = tuple(numbers)
                elif op in ("T*", "'", '"'):
                    if op == '"' and len(numbers) == 2:
                        state["Tw"], state["Tc"] = numbers
                    matrix = line = _times((1, 0, 0, 1, 0, -state["TL"]), line)
                elif op == "Do" and given and depth < DEPTH:
                    self._object(str(given[0]), resources, state["ctm"], depth)
                elif op in PAINT:
                    self.page.drawings += 1
                if op in ("Tj", "'", '"', "TJ") and given:
                    parts = given[-1] if isinstance(given[-1], list) else [given[-1]]
                    matrix = self._show(parts, matrix, state)
                if op in ("BT", "Tj") and _LINE.match(data, at):
                    start, line, matrix = self._lines(data, at, resources, state)
                    break
            else:
                return

    def _lines(self, data: bytes, at: int, resources: dict, state: dict) -> tuple[int, tuple, tuple]:
        """Shows each `_LINE` from `at` on; returns the place after them, the last one's line matrix and the text matrix after it."""
        found, match = [], _LINE.match
        while m := match(data, at):
            found.append(m.groups())
            at = m.end()
        fonts = {name: self._font(resources, name.decode()) for name in {f[0] for f in found}}
        ctm, top, add = state["ctm"], self.page.height, self.page.runs.append
        if ctm[:4] != SAME[:4] or state["Tc"] or state["Tw"] or not all(f.plain for f in fonts.values()):
            for name, size, left, up, digits in found:
                state["font"], state["size"] = fonts[name], float(size)
                line = (1.0, 0.0, 0.0, 1.0, float(left), float(up))
                matrix = self._show([unhexlify(digits + b"0" * (len(digits) % 2))], line, state)
            return at, line, matrix
        # what _show does with these fonts where the page is only shifted and nothing is set between letters
        rise, wide = state["Ts"], state["Tz"] / 100
        number = {f: float(f) for f in {n for f in found for n in f[1:4]}}
        for (name, size, left, up, digits), said in zip(found, _texts([f[4] for f in found]), strict=True):
            font, size, left, up = fonts[name], number[size], number[left], number[up]
            width = ((len(digits) + 1) // 4 * font.default) / 1000 * size * wide
            x, y = left + ctm[4], up + ctm[5]
            if said.strip():
                high, low = top - (0.8 * size + rise + y), top - (-0.2 * size + rise + y)
                add(Run(said, size, (x, high, width + x, low) if width >= 0 else (width + x, high, x, low), top - y))
        state["font"], state["size"] = font, size
        return at, (1.0, 0.0, 0.0, 1.0, left, up), (1.0, 0.0, 0.0, 1.0, width + left, up)

    def _object(self, name: str, resources: dict, ctm: tuple, depth: int) -> None:
        ref = self.file.dictionary(resources.get("XObject")).get(name)
        about = self.file.dictionary(ref)
        if about.get("Subtype") == "Form":
            own = self.file.get(about.get("Matrix"))
            self.walk(self.file.content(ref), self.file.dictionary(about.get("Resources")) or resources, _times(tuple(own), ctm) if isinstance(own, list) and len(own) == 6 else ctm, depth + 1)

    def _show(self, parts: list, matrix: tuple, state: dict) -> tuple:
        """One run from the strings and shifts of an operator; returns the text matrix after it."""
        font, size, wide = state["font"] or Font(self.file, {}), state["size"], state["Tz"] / 100
        said, at = "", 0.0
        for part in parts:
            if isinstance(part, bytes):
                codes, across = font.across(part)
                said += font.text(part)
                at += across / 1000 * size * wide + codes * state["Tc"] * wide
                at += (part.count(32) if not font.wide else 0) * state["Tw"] * wide
            elif isinstance(part, int | float):
                at -= part / 1000 * size * wide
                said += " " if part <= -200 and said and not said.endswith(" ") else ""
        whole = _times(matrix, state["ctm"])
        height = abs(size) * (whole[2] ** 2 + whole[3] ** 2) ** 0.5
        corners = [_times((1, 0, 0, 1, x, y + state["Ts"]), whole)[4:] for x in (0.0, at) for y in (-0.2 * size, 0.8 * size)]
        xs, ys = [c[0] for c in corners], [self.page.height - c[1] for c in corners]
        if said.strip():
            self.page.runs.append(Run(said, height, (min(xs), min(ys), max(xs), max(ys)), self.page.height - whole[5]))
        return _times((1, 0, 0, 1, at, 0), matrix)


def read_pages(source: bytes, most_pages: int = 500) -> Iterator[Page]:
    """The pages of a file. A file without a page tree gives a page for each stream with text."""
    file = File(source)
    found = list(file.pages())
    if len(found) > most_pages:
        raise PdfError("limit")
    for n, about in enumerate(found, 1):
        box = [float(x) for x in (file.get(v) for v in (file.get(about.get("MediaBox")) or [])) if isinstance(x, int | float)]
        page = Page(n, *((box[2] - box[0], box[3] - box[1]) if len(box) == 4 else ()))
        resources = file.dictionary(about.get("Resources"))
        page.images = sum(file.dictionary(x).get("Subtype") == "Image" for x in file.dictionary(resources.get("XObject")).values())
        Drawing(file, page).walk(file.content(about.get("Contents")), resources, (1, 0, 0, 1, -box[0], -box[1]) if len(box) == 4 else SAME)
        yield page
    if not found:
        n = 0
        for head, raw in file.streams.values():
            data = file.unpack(head, raw)
            if b"BT" in data or re.search(rb"(?<!\S)(?:re|l)(?!\S)", data):
                n += 1
                page = Page(n)
                Drawing(file, page).walk(data, {})
                yield page


#: Every two-byte code is the character of that number.
_EVEN = (
    b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 256 beginbfrange "
    + b" ".join(b"<%02X00> <%02XFF> <%02X00>" % (h, h, h) for h in range(256)) + b" endbfrange endcmap end"
)


def _stream(data: bytes) -> bytes:
    packed = zlib.compress(data, 1)
    return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed)


_EVEN_STREAM = _stream(_EVEN)


def write_pages(pages: list[list[tuple[float, float, float, str]]], width: float = 600.0, height: float = 800.0) -> bytes:
    """A file of pages with lines of text, each (left, baseline from above, size, text), in a font of even width and two-byte codes."""

    kids = " ".join(f"{6 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /MediaBox [0 0 {width:g} {height:g}] /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Even /Encoding /Identity-H /ToUnicode 4 0 R /DescendantFonts [5 0 R] >>",
        _EVEN_STREAM,
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Even /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW %d >>" % WIDTH,
    ]
    for i, lines in enumerate(pages):
        shown = ["/F1 %.6f Tf 1 0 0 1 %.6f %.6f Tm <%s> Tj" % (size, left, height - below, text.encode("utf-16-be", "replace").hex()) for left, below, size, text in lines]
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {7 + 2 * i} 0 R >>".encode(), _stream(("BT\n" + "\n".join(shown) + "\nET").encode())]
    out, places = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))
