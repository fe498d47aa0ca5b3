"""OPC packages: a checked ZIP reader with limits, content types and relationships, and atomic edits that copy unchanged payloads as they are."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import quoteattr

from quillgrid.errors import LimitError, SheetError


@dataclass(frozen=True)
class ZipLimits:
    entries: int = 10_000
    entry_bytes: int = 256 << 20
    total_bytes: int = 512 << 20
    ratio: int = 1_000


TYPES, RELS = "[Content_Types].xml", "application/vnd.openxmlformats-package.relationships+xml"


@dataclass(frozen=True)
class XmlLimits:
    chars: int = 64 << 20
    depth: int = 256
    elements: int = 1_000_000
    attributes: int = 512
    text: int = 32 << 20


#: Content types and relationships are small.
PACKAGE_XML = XmlLimits(64 << 20, 128, 100_000, 256, 8 << 20)


class Bounded(ET.TreeBuilder):
    """Builds a tree within limits."""

    def __init__(self, limits: XmlLimits):
        super().__init__()
        self.limits, self.depth, self.elements, self.text = limits, 0, 0, 0

    def start(self, tag, attrs):
        self.depth += 1
        self.elements += 1
        if self.depth > self.limits.depth or self.elements > self.limits.elements or len(attrs) > self.limits.attributes:
            raise LimitError("the XML is too deep or has too many elements or attributes")
        return super().start(tag, attrs)

    def end(self, tag):
        self.depth -= 1
        return super().end(tag)

    def data(self, data):
        self.text += len(data)
        if self.text > self.limits.text:
            raise LimitError("the XML has too much text")
        return super().data(data)

    def doctype(self, name, pubid, system):
        raise SheetError("xml-doctype", "a document type declaration is not allowed")


def xml(data: bytes, limits: XmlLimits = XmlLimits()) -> ET.Element:
    """The root element; document type declarations are refused, and what goes beyond the limits."""
    if len(data) > limits.chars:
        raise LimitError("the XML is too long")
    try:
        parser = ET.XMLParser(target=Bounded(limits))
        parser.feed(data)
        return parser.close()
    except (ET.ParseError, UnicodeDecodeError, ValueError) as e:
        raise SheetError("xml", str(e)) from None


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def children(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if local(c) == name]


def child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if local(c) == name), None)


def attribute(e: ET.Element, name: str, default=None):
    """An attribute by local name."""
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def check_part_name(name: str) -> str:
    """/a/b.xml: no empty, dot-ended or escaped separator segments."""
    parts = name.split("/")
    if not name.startswith("/") or any(not p or p.endswith(".") for p in parts[1:]) or re.search(r"%2f|%5c", name, re.I) or "\\" in name or re.search(r"[\x00-\x1f?#]", name):
        raise SheetError("part-name", f"invalid part name {name!r}")
    return name


def key_of(name: str) -> str:
    return unquote(name).lower()


@dataclass(frozen=True)
class Relationship:
    id: str
    type: str
    target: str
    external: bool = False


def rels_name(part: str) -> str:
    folder, name = posixpath.split(part)
    return posixpath.join(folder or "/", "_rels", f"{name}.rels")


def resolve(source: str, target: str) -> str:
    """The part an internal target names, relative to its source part (or / for the package)."""
    target = target.split("#")[0]
    return target if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(source) or "/", target))


class Package:
    """Parts by name, their content types and relationships."""

    def __init__(self, data: bytes, limits: ZipLimits = ZipLimits()):
        self.data, self.limits = data, limits
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, struct.error, OSError) as e:
            raise SheetError("zip", str(e)) from None
        # one disk, and nothing after the end record but the comment that it tells of
        end = data.rfind(b"PK\5\6")
        if end < 0 or len(data) < end + 22 or data[end + 4 : end + 8] != bytes(4) or end + 22 + struct.unpack_from("<H", data, end + 20)[0] != len(data):
            raise SheetError("zip", "the archive has several disks or data after its end")
        infos = self.zip.infolist()
        if len(infos) > limits.entries:
            raise LimitError("too many ZIP entries")
        total, spans = 0, []
        for i in infos:
            total += i.file_size
            if i.flag_bits & 1:
                raise SheetError("zip-encrypted", f"{i.filename} is encrypted")
            if i.compress_type not in (0, 8):
                raise SheetError("zip-method", f"{i.filename} has method {i.compress_type}")
            if i.file_size > limits.entry_bytes or total > limits.total_bytes or i.file_size > limits.ratio * max(1, i.compress_size):
                raise LimitError(f"{i.filename} is too large")
            spans.append((i.header_offset, i.header_offset + 30 + i.compress_size))
        spans.sort()
        if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
            raise SheetError("zip-overlap", "ZIP entries overlap")
        self.infos: dict[str, zipfile.ZipInfo] = {}
        seen: set[str] = set()
        for i in infos:
            if i.filename.endswith("/"):
                continue
            name = i.filename if i.filename == TYPES else check_part_name("/" + i.filename)
            if key_of(name) in seen:
                raise SheetError("part-duplicate", f"{name} is there twice")
            seen.add(key_of(name))
            self.infos[name] = i
        if TYPES not in self.infos:
            raise SheetError("content-types", "there is no [Content_Types].xml")
        root = xml(self.read(TYPES), PACKAGE_XML)
        self.defaults = {attribute(e, "Extension", "").lower(): attribute(e, "ContentType") for e in children(root, "Default")}
        self.overrides = {key_of(attribute(e, "PartName", "")): attribute(e, "ContentType") for e in children(root, "Override")}
        self.by_key = {key_of(n): n for n in self.infos}
        self.rels: dict[str, list[Relationship]] = {}
        for name in self.infos:
            folder, file = posixpath.split(name)
            if file.endswith(".rels") and posixpath.basename(folder) == "_rels":
                source = posixpath.join(posixpath.dirname(folder), file[:-5]) if file != ".rels" else "/"
                if source != "/" and key_of(source) not in self.by_key:
                    raise SheetError("relationship-orphan", f"{name} belongs to no part")
                self.rels[source] = self._relationships(source, name)

    def read(self, name: str) -> bytes:
        try:
            return self.zip.read(self.infos[name])
        except KeyError:
            raise SheetError("part-missing", f"{name} is not in the package") from None
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError) as e:
            raise SheetError("zip", str(e)) from None

    def part(self, name: str) -> bytes:
        return self.read(self.by_key.get(key_of(name), name))

    def content_type(self, name: str) -> str | None:
        return self.overrides.get(key_of(name)) or self.defaults.get(name.rpartition(".")[2].lower())

    def _relationships(self, source: str, name: str) -> list[Relationship]:
        out, ids = [], set()
        for e in children(xml(self.read(name), PACKAGE_XML), "Relationship"):
            r = Relationship(attribute(e, "Id", ""), attribute(e, "Type", ""), attribute(e, "Target", ""), attribute(e, "TargetMode", "Internal") == "External")
            if not r.id or r.id in ids:
                raise SheetError("relationship-id", f"{name} has a missing or repeated id")
            ids.add(r.id)
            if not r.external and key_of(resolve(source, r.target)) not in self.by_key:
                raise SheetError("relationship-target", f"{source} points to {r.target}, which is not there")
            out.append(r)
        return out

    def related(self, source: str, kind: str) -> list[tuple[Relationship, str]]:
        """Internal targets of relationships whose type ends in kind."""
        return [(r, self.by_key[key_of(resolve(source, r.target))]) for r in self.rels.get(source, []) if not r.external and r.type.rpartition("/")[2] == kind]

    @property
    def main_part(self) -> str:
        found = self.related("/", "officeDocument")
        if len(found) != 1:
            raise SheetError("main-part", "there must be exactly one main part")
        return found[0][1]

    @property
    def family(self) -> str:
        kind = self.content_type(self.main_part) or ""
        return next((f for f, word in (("spreadsheet", "spreadsheetml"), ("word", "wordprocessingml"), ("slides", "presentationml")) if word in kind), "unknown")

    def raw(self, name: str) -> bytes:
        """The compressed payload of an entry, as it is."""
        i = self.infos[name]
        n, m = struct.unpack_from("<HH", self.data, i.header_offset + 26)
        at = i.header_offset + 30 + n + m
        return self.data[at : at + i.compress_size]


class Transaction:
    """Staged edits of a package; commit gives the new bytes, or the old ones if nothing changed."""

    def __init__(self, package: Package):
        self.package, self.status = package, "active"
        self.replaced: dict[str, bytes] = {}
        self.added: dict[str, tuple[str, bytes]] = {}
        self.removed: set[str] = set()
        self.rels = {s: list(r) for s, r in package.rels.items()}

    def _open(self) -> None:
        if self.status != "active":
            raise SheetError("transaction", f"the transaction is {self.status}")

    def has(self, name: str) -> bool:
        return name in self.added or (name in self.package.infos and name not in self.removed)

    def part(self, name: str) -> bytes:
        return self.added[name][1] if name in self.added else self.replaced.get(name) or self.package.read(name)

    def replace_part(self, name: str, data: bytes) -> None:
        self._open()
        if not self.has(name) or name == TYPES or name.endswith(".rels"):
            raise SheetError("part-missing", f"{name} can't be replaced")
        if name in self.added:
            self.added[name] = (self.added[name][0], data)
        else:
            self.replaced[name] = data

    def add_part(self, name: str, content_type: str, data: bytes) -> None:
        self._open()
        check_part_name(name)
        if self.has(name):
            raise SheetError("part-duplicate", f"{name} is there already")
        self.added[name] = (content_type, data)

    def remove_part(self, name: str) -> None:
        self._open()
        if not self.has(name):
            raise SheetError("part-missing", f"{name} is not there")
        if self.added.pop(name, None) is None:
            self.removed.add(name)
        self.replaced.pop(name, None)
        self.rels.pop(name, None)

    def add_relationship(self, source: str, r: Relationship) -> None:
        self._open()
        if any(x.id == r.id for x in self.rels.get(source, [])):
            raise SheetError("relationship-id", f"{r.id} is there already")
        self.rels.setdefault(source, []).append(r)

    def remove_relationship(self, source: str, id: str) -> None:
        self._open()
        if not any(x.id == id for x in self.rels.get(source, [])):
            raise SheetError("relationship-id", f"there is no {id}")
        self.rels[source] = [x for x in self.rels[source] if x.id != id]

    def rollback(self) -> None:
        self._open()
        self.status = "rolled-back"

    def commit(self) -> bytes:
        self._open()
        changed = {n: d for n, d in self.replaced.items() if d != self.package.read(n)}
        rels_changed = {s for s in {*self.rels, *self.package.rels} if self.rels.get(s, []) != self.package.rels.get(s, [])}
        if not (changed or self.added or self.removed or rels_changed):
            self.status = "committed"
            return self.package.data
        for source, found in self.rels.items():
            for r in found:
                if not r.external and not any(self.has(n) for n in (resolve(source, r.target),)) and key_of(resolve(source, r.target)) not in {key_of(n) for n in self.package.infos if n not in self.removed} | {key_of(n) for n in self.added}:
                    raise SheetError("incoming-relationship", f"{source} still points to {r.target}")
        out: dict[str, bytes | None] = {n: None for n in self.package.infos if n not in self.removed and not any(n == rels_name(x) for x in self.removed)}
        out |= changed | {n: d for n, (_, d) in self.added.items()}
        for s in rels_changed:
            name = rels_name(s) if s != "/" else "/_rels/.rels"
            if self.rels.get(s):
                body = "".join(f"<Relationship Id={quoteattr(r.id)} Type={quoteattr(r.type)} Target={quoteattr(r.target)}{' TargetMode=\"External\"' if r.external else ''}/>" for r in self.rels[s])
                out[name] = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'.encode()
            else:
                out.pop(name, None)
        out[TYPES] = self._types()
        data = write_zip(self.package, out)
        Package(data, self.package.limits)
        self.status = "committed"
        return data

    def _types(self) -> bytes | None:
        extra = [(n, t) for n, (t, _) in self.added.items() if self.package.defaults.get(n.rpartition(".")[2].lower()) != t]
        gone = {key_of(n) for n in self.removed}
        text = self.package.read(TYPES).decode()
        new = re.sub(r"<(?:\w+:)?Override\b[^>]*?/>", lambda m: "" if key_of(re.search(r'PartName\s*=\s*["\']([^"\']*)', m[0])[1]) in gone else m[0], text)
        if extra:
            add = "".join(f"<Override PartName={quoteattr(n)} ContentType={quoteattr(t)}/>" for n, t in extra)
            new = re.sub(r"</(\w+:)?Types>", lambda m: add + m[0], new)
        return None if new == text else new.encode()


def write_zip(package: Package, parts: dict[str, bytes | None]) -> bytes:
    """A classic ZIP; None takes the payload of the package as it is."""
    out, central = io.BytesIO(), []
    order = [TYPES, *(n for n in parts if n != TYPES)]
    for name in order:
        data = parts[name]
        if data is None:
            i = package.infos[name]
            method, crc, size, payload = i.compress_type, i.CRC, i.file_size, package.raw(name)
        else:
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            method, crc, size, payload = 8, zlib.crc32(data), len(data), z.compress(data) + z.flush()
        raw = name.lstrip("/").encode()
        fields = struct.pack("<HHHHHIIIHH", 20, 0x800, method, 0, 0x21, crc, len(payload), size, len(raw), 0)
        central.append(b"PK\1\2" + struct.pack("<H", 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, out.tell()) + raw)
        out.write(b"PK\3\4" + fields + raw + payload)
    at = out.tell()
    body = b"".join(central)
    out.write(body + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(central), len(central), len(body), at, 0))
    return out.getvalue()
