"""A tolerant reader and a canonical writer of document object graphs."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from vellum.functions.codecs import DELIMITERS, SPACE, decode_filters, flate, name_form, real_form, string_form


class Name(str):
    __slots__ = ()


@dataclass(frozen=True, order=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Stream:
    dict: dict
    raw: bytes


class Operator(bytes):
    __slots__ = ()


_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z])")
_ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+[\r\n]?)*+")
_PLAIN = re.compile(rb"[^()\\]+")


@lru_cache(1 << 12)  # a file has few names, many times
def _name(raw: bytes) -> str:
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1")


class Lexer:
    """Values and operators from bytes, with the place of each."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True) -> None:
        self.data, self.at, self.references = data, at, references

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        """The next value; an Operator for a bare word; EOFError at the end."""
        if depth > 200:
            raise ValueError("values nest too deep")
        data = self.data
        at = self.at = _SKIP.match(data, self.at).end()
        if at >= len(data):
            raise EOFError
        c = data[at]
        if c == 47:
            return Name(self._key())
        if c == 60 and data.startswith(b"<<", at):
            self.at = at + 2
            out = {}
            while True:
                at = self.at = _SKIP.match(data, self.at).end()
                if data.startswith(b">>", at):
                    self.at = at + 2
                    return out
                if data[at : at + 1] == b"/" and depth < 200:
                    key = self._key()
                elif not isinstance(key := self.value(depth + 1), Name):
                    raise ValueError("a dictionary's key is no name")
                out[str(key)] = self.value(depth + 1)
        if c == 40:
            return self._literal()
        if c == 60:
            end = data.find(b">", self.at)
            if end < 0:
                raise EOFError
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 91:
            self.at += 1
            items = []
            while True:
                self.skip()
                if self.at < len(data) and data[self.at] == 93:
                    self.at += 1
                    return items
                items.append(self.value(depth + 1))
        if c in DELIMITERS:
            self.at += 1
            return Operator(bytes([c]))
        if self.references and 48 <= c <= 57 and (ref := _REF.match(data, self.at)):
            self.at = ref.end()
            return Ref(int(ref[1]), int(ref[2]))
        word = _WORD.match(data, at).group()
        self.at = at + len(word)
        if c < 58 and _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word))

    def _key(self) -> str:
        """The name that starts here, without its slash."""
        found = _WORD.match(self.data, self.at + 1)
        self.at = found.end() if found else self.at + 1
        return _name(found.group()) if found else ""

    def _literal(self) -> bytes:
        data, n, out, depth = self.data, len(self.data), bytearray(), 1
        at = self.at + 1
        while at < n:
            if plain := _PLAIN.match(data, at):
                out += plain.group()
                at = plain.end()
                continue
            c = data[at]
            at += 1
            if c == 92 and at < n:
                e = data[at]
                at += 1
                if 48 <= e <= 55:
                    digits = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2]).group()
                    at += len(digits) - 1
                    out.append(int(digits, 8) & 255)
                elif e == 13:
                    at += data[at : at + 1] == b"\n"
                elif e != 10:
                    out.append(_ESCAPES.get(e, e))
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                self.at = at
                return bytes(out)
            out.append(c)
        raise EOFError


@dataclass
class Document:
    objects: dict[Ref, object]
    trailer: dict
    sha256: str
    size: int
    problems: list[str] = field(default_factory=list)

    def get(self, value):
        """What a reference stands for; null for a missing one or a cycle."""
        met: set[Ref] = set()
        while isinstance(value, Ref):
            if value in met:
                return None
            met.add(value)
            value = self.objects.get(value)
        return value

    def dictionary(self, value) -> dict:
        value = self.get(value)
        return value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def filters(self, stream: Stream) -> tuple[list[str], list[dict]]:
        names, parms = self.get(stream.dict.get("Filter")), self.get(stream.dict.get("DecodeParms"))
        names = [names] if isinstance(names, Name) else [self.get(n) for n in names or []]
        parms = [parms] if isinstance(parms, dict) else [self.get(p) or {} for p in parms or []]
        return [str(n) for n in names], parms

    def decoded(self, stream: Stream) -> bytes:
        names, parms = self.filters(stream)
        return decode_filters(stream.raw, names, parms)

    def pages(self) -> list[tuple[Ref | None, dict]]:
        """Pages in order with inherited values; a tree's cycles end, and without a tree all pages count."""
        out: list[tuple[Ref | None, dict]] = []
        seen: set[Ref] = set()

        root = self.dictionary(self.trailer.get("Root"))
        ahead: list[tuple[object, dict]] = [(root["Pages"], {})] if root.get("Pages") is not None else []
        while ahead:  # the last is next: a node's kids go on in reverse
            ref, above = ahead.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            inherited = above | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if self.get(node.get(k)) is not None}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                ahead += [(kid, inherited) for kid in reversed(kids)]
            else:
                out.append((ref if isinstance(ref, Ref) else None, inherited | node))
        if not out:
            out = [(r, o) for r, o in sorted(self.objects.items()) if isinstance(o, dict) and o.get("Type") == "Page"]
        return out

    def content(self, page: dict) -> bytes:
        """A page's content streams, one after another."""
        found = self.get(page.get("Contents"))
        parts = found if isinstance(found, list) else [found]
        streams = [self.get(p) for p in parts]
        return b"\n".join(self.decoded(s) for s in streams if isinstance(s, Stream))


_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![A-Za-z])")


class Encrypted(ValueError):
    """The document asks for a key."""


def parse(data: bytes) -> Document:
    """Reads a document by scanning for its objects, later definitions winning, so that damaged
    cross-references don't matter. Objects in object streams come in under those written plainly."""
    if b"%PDF-" not in data[:1024] and b" obj" not in data:
        raise ValueError("no document")
    objects: dict[Ref, object] = {}
    doc = Document(objects, {}, hashlib.sha256(data).hexdigest(), len(data))
    at = 0
    while found := _OBJECT.search(data, at):
        ref = Ref(int(found[1]), int(found[2]))
        lexer = Lexer(data, found.end())
        try:
            value = lexer.value()
            lexer.skip()
            if isinstance(value, dict) and data.startswith(b"stream", lexer.at):
                start = lexer.at + 6
                start += 2 if data.startswith(b"\r\n", start) else data[start : start + 1] in (b"\n", b"\r")
                size = value.get("Length")
                end = start + size if isinstance(size, int) and data[start + size : start + size + 16].strip(SPACE).startswith(b"endstream") else -1
                if end < 0:
                    end = data.find(b"endstream", start)
                    end = len(data) if end < 0 else end
                    stop = end
                    while stop > start and data[stop - 1 : stop] in (b"\n", b"\r") and end - stop < 2:
                        stop -= 1
                    raw = data[start:stop]
                else:
                    raw = data[start:end]
                value, lexer.at = Stream(value, raw), end
            objects[ref] = value
            at = max(lexer.at, found.end())
        except (EOFError, ValueError) as error:
            doc.problems.append(f"object {ref.num}: {error or 'cut short'}")
            at = found.end()
    for start in (m.end() for m in re.finditer(rb"trailer", data)):
        try:
            value = Lexer(data, start).value()
            doc.trailer |= value if isinstance(value, dict) else {}
        except (EOFError, ValueError):
            doc.problems.append("trailer")
    packed: dict[Ref, object] = {}
    for value in list(objects.values()):
        if not isinstance(value, Stream):
            continue
        if value.dict.get("Type") == "XRef":
            doc.trailer |= {k: v for k, v in value.dict.items() if k in ("Root", "Info", "ID", "Encrypt")}
        elif value.dict.get("Type") == "ObjStm":
            try:
                body = doc.decoded(value)
                lexer, first = Lexer(body, references=False), int(doc.get(value.dict["First"]))
                heads = [(lexer.value(), lexer.value()) for _ in range(int(doc.get(value.dict["N"])))]
                for num, offset in heads:
                    packed[Ref(num, 0)] = Lexer(body, first + offset).value()
            except (EOFError, ValueError, KeyError, TypeError) as error:
                doc.problems.append(f"object stream: {error}")
    for ref, value in packed.items():
        objects.setdefault(ref, value)
    if "Encrypt" in doc.trailer:
        raise Encrypted("the document is encrypted")
    if "Root" not in doc.trailer:
        roots = [r for r, o in objects.items() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        doc.trailer |= {"Root": roots[-1]} if roots else {}
    return doc


def references(value, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Ref]]:
    """(key path, target) of every reference in a value, keys in order.

    What an array names ICCBased refers to has that name in its path, other items their place.
    """
    if isinstance(value, Ref):
        yield path, value
    elif isinstance(value, Stream):
        yield from references(value.dict, path)
    elif isinstance(value, dict):
        for key in sorted(value):
            yield from references(value[key], (*path, key))
    elif isinstance(value, list):
        profile = bool(value) and value[0] == "ICCBased" and isinstance(value[0], Name)
        for i, item in enumerate(value):
            yield from references(item, (*path, "ICCBased" if profile else str(i)))


@dataclass
class Instruction:
    op: str
    operands: list
    start: int
    end: int


def instructions(content: bytes) -> tuple[list[Instruction], bool]:
    """The operators of a content stream with operands and places, and whether all of it was read."""
    lexer, held, out, start = Lexer(content, references=False), [], [], None
    while True:
        lexer.skip()
        start = lexer.at if start is None else start
        try:
            value = lexer.value()
        except EOFError:
            return out, not held and lexer.at >= len(content)
        except ValueError:
            return out, False
        if not isinstance(value, Operator):
            held.append(value)
            continue
        if value == b"BI":
            try:
                found: dict = {}
                while (key := lexer.value()) != b"ID" or not isinstance(key, Operator):
                    found[str(key)] = lexer.value()
                begin = lexer.at + 1
                end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(content, begin)
                if not end:
                    return out, False
                held, lexer.at = [found, content[begin : end.start()]], end.end()
            except (EOFError, ValueError):
                return out, False
        out.append(Instruction(value.decode("latin-1"), held, start, lexer.at))
        held, start = [], None


def serialise(value, body: bool = True) -> bytes:
    """The canonical form of a value: dictionaries in key order."""
    kind = type(value)
    if kind is Ref:
        return b"%d %d R" % (value.num, value.gen)
    if kind is Name:
        return name_form(value)
    if value is None or kind is bool:
        return {None: b"null", True: b"true", False: b"false"}[value]
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, float):
        return real_form(value)
    if isinstance(value, Name):
        return name_form(value)
    if isinstance(value, bytes):
        return string_form(value)
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialise, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b"".join([name_form(k) + b" " + serialise(value[k]) for k in sorted(value)]) + b">>"
    if isinstance(value, Stream):
        head = serialise(value.dict | {"Length": len(value.raw)})
        return head + b"\nstream\n" + value.raw + b"\nendstream" if body else head
    raise TypeError(type(value).__name__)


def _targets(value, out: list[Ref]) -> None:
    """Adds what `references` yields, without paths."""
    kind = type(value)
    if kind is Ref:
        out.append(value)
    elif kind is dict:
        for key in sorted(value):
            _targets(value[key], out)
    elif kind is list:
        for item in value:
            _targets(item, out)
    elif kind is Stream:
        _targets(value.dict, out)


def reachable_objects(doc: Document) -> list[Ref]:
    """Objects that the trailer reaches, in the order in which they are met."""
    order: list[Ref] = []
    seen: set[Ref] = set()
    ahead: list[Ref] = []
    for k in ("Root", "Info"):
        _targets(doc.trailer.get(k), ahead)
    queue = deque(ahead)
    while queue:
        ref = queue.popleft()
        if ref in seen or ref not in doc.objects:
            continue
        seen.add(ref)
        order.append(ref)
        ahead = []
        _targets(doc.objects[ref], ahead)
        queue += ahead
    return order


def _renumbered(value, new: dict[Ref, Ref]):
    kind = type(value)
    if kind is Ref:
        return new.get(value)
    if kind is dict:
        return {k: _renumbered(v, new) for k, v in value.items()}
    if kind is list:
        return [_renumbered(v, new) for v in value]
    if kind is Stream:
        return Stream(_renumbered(value.dict, new), value.raw)
    return value


def write(doc: Document, packed: bool = False, level: int = 9, per_stream: int = 100) -> bytes:
    """The document's reachable objects, renumbered; with `packed` plain ones go to object streams.

    A table of offsets ends the classic form, a compressed cross-reference stream the packed one.
    """
    order = reachable_objects(doc)
    new = {ref: Ref(i + 1) for i, ref in enumerate(order)}
    values = {new[r]: _renumbered(doc.objects[r], new) for r in order}
    trailer = {k: _renumbered(doc.trailer[k], new) for k in ("Root", "Info") if k in doc.trailer}
    out, at, inside = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}, {}
    plain = [r for r, v in values.items() if packed and not isinstance(v, Stream)]
    groups = [plain[i : i + per_stream] for i in range(0, len(plain), per_stream)]
    for k, group in enumerate(groups):
        holder, heads, body = Ref(len(order) + 1 + k), b"", b""
        for i, ref in enumerate(group):
            heads += b"%d %d " % (ref.num, len(body))
            body += serialise(values[ref]) + b" "
            inside[ref] = (holder.num, i)
        raw = flate(heads + body, level)
        values[holder] = Stream({"Type": Name("ObjStm"), "N": len(group), "First": len(heads), "Filter": Name("FlateDecode")}, raw)
    for ref, value in values.items():
        if ref not in inside:
            at[ref] = len(out)
            out += b"%d %d obj\n" % (ref.num, ref.gen) + serialise(value) + b"\nendobj\n"
    start, size = len(out), len(values) + 1
    if packed:
        own = Ref(size)
        at[own] = start
        rows = b"\0" + bytes(6) + b"\xff"
        for num in range(1, size + 1):
            ref = Ref(num)
            rows += b"\2" + inside[ref][0].to_bytes(6, "big") + bytes([inside[ref][1]]) if ref in inside else b"\1" + at[ref].to_bytes(6, "big") + b"\0"
        stream = Stream(trailer | {"Type": Name("XRef"), "Size": size + 1, "W": [1, 6, 1], "Filter": Name("FlateDecode")}, flate(rows, level))
        out += b"%d 0 obj\n" % own.num + serialise(stream) + b"\nendobj\n"
    else:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % at[Ref(n)] for n in range(1, size))
        out += b"trailer\n" + serialise(trailer | {"Size": size}) + b"\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start
