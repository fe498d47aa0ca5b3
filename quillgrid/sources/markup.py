"""XML as it is written: edits that touch only the bytes they must, the view of a document for a reader that knows some namespaces, and core properties."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from quillgrid.errors import SheetError
from quillgrid.sources.package import Package, Relationship, Transaction, local, xml
from quillgrid.sources.workbook import PROPERTIES, W3CDTF, core_properties

TAG_END = re.compile(rb"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
ATTRIBUTE = re.compile(rb"""\s+([^\s=/>]+)\s*=\s*("[^"]*"|'[^']*')""")


@dataclass
class Element:
    """An element by the bytes it takes: begin of its tag, begin and end of what is inside (equal to the tag's end for <a/>), end."""

    name: str
    begin: int
    inner: int = 0
    close: int = 0
    end: int = 0
    children: list[Element] = field(default_factory=list)

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    def find(self, name: str) -> Element | None:
        """The first child with this local name."""
        return next((c for c in self.children if c.local == name), None)


class XmlEdit:
    """Staged edits of a document's bytes; two edits of the same bytes are refused, and the result must be well formed."""

    def __init__(self, data: bytes):
        xml(data)
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            data = re.sub(r"""(<\?xml[^>]*encoding\s*=\s*["'])[^"']*""", r"\1UTF-8", data.decode("utf-16")).encode()
        self.data, self.edits, self.status = data, [], "active"
        self.root = self._spans()

    def _spans(self) -> Element:
        parser, open_, root = expat.ParserCreate(), [], []

        def start(name, _):
            e = Element(name, parser.CurrentByteIndex)
            e.inner = TAG_END.match(self.data, e.begin + 1).end()
            (open_[-1].children if open_ else root).append(e)
            open_.append(e)

        def end(_):
            e = open_.pop()
            empty = self._empty(e)
            e.close = e.inner if empty else parser.CurrentByteIndex
            e.end = e.inner if empty else TAG_END.match(self.data, e.close + 1).end()

        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.Parse(self.data, True)
        return root[0]

    def _stage(self, begin: int, end: int, new: str | bytes) -> None:
        if self.status != "active":
            raise SheetError("xml-edit", f"the edit is {self.status}")
        new = new if isinstance(new, bytes) else new.encode()
        if any(begin < b and a < end or (begin, end) == (a, b) and begin < end for a, b, _ in self.edits):
            raise SheetError("xml-edit-overlap", "two edits touch the same markup")
        self.edits.append((begin, end, new))

    def _tag(self, e: Element) -> bytes:
        return self.data[e.begin : e.inner]

    def _empty(self, e: Element) -> bool:
        return self._tag(e).endswith(b"/>")

    def _fill(self, e: Element, markup: str) -> None:
        """Puts markup into an element that is written as <a/>."""
        self._stage(e.inner - 2, e.inner, f">{markup}</{e.name}>")

    def set_text(self, e: Element, text: str) -> None:
        if self._empty(e):
            self._fill(e, escape(text))
        else:
            self._stage(e.inner, e.close, escape(text))

    def _attribute(self, e: Element, name: str):
        return next((m for m in ATTRIBUTE.finditer(self.data, e.begin + 1 + len(e.name.encode()), e.inner) if m[1].decode() == name), None)

    def attribute(self, e: Element, name: str) -> str | None:
        """The value of an attribute by its qualified name, as it is written."""
        m = self._attribute(e, name)
        return None if m is None else m[2][1:-1].decode()

    def set_attribute(self, e: Element, name: str, value: str) -> None:
        """Replaces an attribute's value, or inserts the attribute."""
        m = self._attribute(e, name)
        if m is not None:
            self._stage(m.start(2), m.end(2), quoteattr(value))
            return
        at = e.inner - (2 if self._empty(e) else 1)
        self._stage(at, at, f" {name}={quoteattr(value)}")

    def remove_attribute(self, e: Element, name: str) -> None:
        m = self._attribute(e, name)
        if m is None:
            raise SheetError("xml-attribute", f"<{e.name}> has no {name}")
        self._stage(m.start(), m.end(), b"")

    def append(self, parent: Element, markup: str) -> None:
        if self._empty(parent):
            self._fill(parent, markup)
        else:
            self._stage(parent.close, parent.close, markup)

    def append_element(self, parent: Element, name: str, text: str = "", attributes: dict[str, str] | None = None) -> None:
        written = "".join(f" {k}={quoteattr(v)}" for k, v in (attributes or {}).items())
        self.append(parent, f"<{name}{written}>{escape(text)}</{name}>")

    def insert_before(self, e: Element, markup: str) -> None:
        self._stage(e.begin, e.begin, markup)

    def replace(self, e: Element, markup: str) -> None:
        self._stage(e.begin, e.end, markup)

    def remove(self, e: Element) -> None:
        if e is self.root:
            raise SheetError("xml-edit", "the root can't be removed")
        self._stage(e.begin, e.end, b"")

    def commit(self) -> bytes:
        """The new bytes; the old ones, unchanged, without edits."""
        if self.status != "active":
            raise SheetError("xml-edit", f"the edit is {self.status}")
        out, at = [], 0
        # insertions at one place stay in the order they were made
        for begin, end, new in sorted(self.edits, key=lambda x: (x[0], x[1])):
            out += [self.data[at:begin], new]
            at = end
        data = b"".join([*out, self.data[at:]])
        if self.edits:
            xml(data)
        self.status = "committed"
        return data


#: Fixed values of the format.
COMPATIBILITY = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"


class CompatibilityView:
    """A document as a reader sees it that understands some namespaces: of alternatives the first one it understands in full, without what may be ignored."""

    def __init__(self, data: bytes, understood: set[str]):
        self.root, self.understood, self.scope, self.ignorable, self.process = xml(data), set(understood), {}, {}, {}
        scopes = self._scopes(data)
        for e, scope in zip(self.root.iter(), scopes, strict=True):
            self.scope[e] = scope
        self._inherit(self.root, frozenset(), ())
        for e in self.root.iter():
            for prefix in e.attrib.get(f"{COMPATIBILITY}MustUnderstand", "").split():
                if self._namespace(e, prefix) not in self.understood:
                    raise SheetError("must-understand", f"{prefix} must be understood")
            if e.tag == f"{COMPATIBILITY}AlternateContent":
                self._chosen(e)

    @staticmethod
    def _scopes(data: bytes) -> list[dict[str, str]]:
        """The prefixes in force at each element, in document order."""
        parser, open_, out = expat.ParserCreate(), [{}], []

        def start(_, attributes):
            own = {k.partition(":")[2]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
            open_.append(open_[-1] | own)
            out.append(open_[-1])

        parser.StartElementHandler, parser.EndElementHandler = start, lambda _: open_.pop()
        parser.Parse(data, True)
        return out

    def _namespace(self, e: ET.Element, prefix: str) -> str:
        if prefix not in self.scope[e]:
            raise SheetError("xml-prefix", f"the prefix {prefix!r} is not bound")
        return self.scope[e][prefix]

    def _inherit(self, e: ET.Element, ignorable: frozenset, process: tuple) -> None:
        ignorable |= {self._namespace(e, p) for p in e.attrib.get(f"{COMPATIBILITY}Ignorable", "").split()}
        for name in e.attrib.get(f"{COMPATIBILITY}ProcessContent", "").split():
            prefix, _, name = name.partition(":")
            process += ((self._namespace(e, prefix), name),)
        self.ignorable[e], self.process[e] = ignorable, process
        for c in e:
            self._inherit(c, ignorable, process)

    def _chosen(self, e: ET.Element) -> ET.Element | None:
        names = [c.tag.removeprefix(COMPATIBILITY) for c in e]
        choices = [c for c, n in zip(e, names, strict=True) if n == "Choice"]
        if not choices or names != ["Choice"] * len(choices) + ["Fallback"] * (len(names) - len(choices)) or len(names) - len(choices) > 1:
            raise SheetError("alternate-content", "choices must come first, then at most one fallback")
        for c in choices:
            wanted = c.attrib.get("Requires", "").split()
            if not wanted:
                raise SheetError("alternate-content", "a choice must say what it requires")
            if all(self._namespace(c, p) in self.understood for p in wanted):
                return c
        return e[-1] if names[-1] == "Fallback" else None

    def children(self, parent: ET.Element) -> list[ET.Element]:
        out = []
        for c in parent:
            space = c.tag[1:].partition("}")[0] if c.tag.startswith("{") else ""
            if c.tag == f"{COMPATIBILITY}AlternateContent":
                branch = self._chosen(c)
                out += [] if branch is None else self.children(branch)
            elif space in self.understood or space not in self.ignorable[c]:
                out.append(c)
            elif any(space == s and name in ("*", local(c)) for s, name in self.process[c]):
                out += self.children(c)
        return out


#: Fixed values of the format: namespaces of core properties, by the names in each.
DC, TERMS, CORE = "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/", "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
IN_DC, IN_TERMS = ("creator", "description", "identifier", "language", "subject", "title"), ("created", "modified")
INSTANCE = "http://www.w3.org/2001/XMLSchema-instance"
CORE_TYPE = "application/vnd.openxmlformats-package.core-properties+xml"
CORE_REL = "http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties"


def edit_core_properties(data: bytes, changes: dict[str, str | None]) -> bytes:
    """The package with these core properties set, or removed where the value is None; the same bytes where nothing changes."""
    for name, value in changes.items():
        if name not in PROPERTIES or value is not None and name in ("created", "modified", "lastPrinted") and not W3CDTF.match(value):
            raise SheetError("core-properties", f"{name} can't be {value!r}")
    package = Package(data)
    old = core_properties(package)
    changes = {k: v for k, v in changes.items() if old.get(k) != v}
    if not changes:
        return data
    found, t = package.related("/", "core-properties"), Transaction(package)
    if not found:
        part = next(p for p in ("/docProps/core.xml", *(f"/docProps/core{i}.xml" for i in range(1, 10_000))) if p.lower() not in package.by_key)
        used = {r.id for r in package.rels.get("/", [])}
        empty = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><cp:coreProperties xmlns:cp="{CORE}"/>'
        t.add_part(part, CORE_TYPE, with_properties(empty.encode(), changes))
        t.add_relationship("/", Relationship(next(i for i in (f"rId{n}" for n in range(1, len(used) + 2)) if i not in used), CORE_REL, part))
    else:
        t.replace_part(found[0][1], with_properties(package.part(found[0][1]), changes))
    out = t.commit()
    core_properties(Package(out))
    return out


def with_properties(data: bytes, changes: dict[str, str | None]) -> bytes:
    edit = XmlEdit(data)
    scope = CompatibilityView._scopes(edit.data)[0]
    prefix_of, added = {v: k for k, v in scope.items()}, ""
    for name, value in changes.items():
        e = edit.root.find(name)
        if value is None:
            edit.remove(e)
        elif e is not None:
            edit.set_text(e, value)
        else:
            space = DC if name in IN_DC else TERMS if name in IN_TERMS else CORE
            for uri, wanted in ((space, {DC: "dc", TERMS: "dcterms", CORE: "cp"}[space]), *(((INSTANCE, "xsi"),) if space == TERMS else ())):
                if uri not in prefix_of or uri == INSTANCE and not prefix_of[uri]:
                    prefix_of[uri] = wanted if wanted not in scope else f"{wanted}{len(scope)}"
                    edit.set_attribute(edit.root, f"xmlns:{prefix_of[uri]}", uri)
            tag = f"{prefix_of[space]}:{name}".lstrip(":")
            kind = f' {prefix_of[INSTANCE]}:type="{prefix_of[space]}:W3CDTF"' if space == TERMS else ""
            added += f"<{tag}{kind}>{escape(value)}</{tag}>"
    if added and edit._empty(edit.root):
        # declarations and content of <a/> change the same end of its tag, one after the other
        edit = XmlEdit(edit.commit())
    if added:
        edit.append(edit.root, added)
    return edit.commit()
