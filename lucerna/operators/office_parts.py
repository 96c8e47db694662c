"""What cleaning does to one XML part of an office package, by namespace and local name, and an independent reading of it.

One part at a time: a walk over its elements gives edits of byte spans and counters.  The checks below do not
use that walk; they read the part with another parser.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections import Counter
from collections.abc import Mapping
from xml.etree import ElementTree
from xml.parsers import expat

from lucerna.sources.packages import NAMESPACES, STRICT, check_xml, kept_nodes_and_text
from lucerna.sources.xmlparts import Edits, Element, as_utf8, elements

# Part names, revision marks, account attributes, what settings lose, what replaces properties.
PERSONS = r"^(word/people|xl/persons/person|ppt/persons/person)\.xml$"
COMMENTS = r"^(word/comments(Extended|Ids|Extensible)?|xl/comments\d*|xl/comments/comment\d*|xl/threadedComments/threadedComment\d*|ppt/commentAuthors|ppt/comments/comment\d*)\.xml$"
REVISION_PARTS = r"^word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$"
FORMAT_CHANGES = {f"w:{x}Change": f"w:{x}" for x in ("pPr", "rPr", "tblPr", "trPr", "tcPr", "sectPr")}
ADDED, TAKEN = ("w:ins", "w:moveTo", "w:cellIns"), ("w:del", "w:moveFrom", "w:cellDel")
#: Marks that hold nothing and go with the changes that they tell of.
MARKERS = frozenset(
    "w:numberingChange w:tblGridChange w:customXmlInsRangeStart w:customXmlInsRangeEnd w:customXmlDelRangeStart w:customXmlDelRangeEnd "
    "w:moveFromRangeStart w:moveFromRangeEnd w:moveToRangeStart w:moveToRangeEnd".split()
)
OLD_TEXT = {"w:delText": b"t", "w:delInstrText": b"instrText"}
ACCOUNT = frozenset("displayname userid providerid initials author sip email alias".split())
SETTINGS = frozenset("w:trackRevisions w:saveThroughXslt w:attachedTemplate".split())
SESSIONS, DOCUMENT_IDS = frozenset(["w:rsid", "w:rsidRoot", "w:rsids"]), frozenset(["w14:docId", "w15:docId"])
PARAGRAPH_IDS = frozenset(["paraId", "paraIdParent", "textId"])
REFERENCES = frozenset(["w:commentRangeStart", "w:commentRangeEnd", "w:commentReference"])
#: Elements that go whole, and those that may point at a part that goes.
WHOLE, POINTING = SETTINGS | SESSIONS | DOCUMENT_IDS, frozenset(["ct:Override", "rel:Relationship"])
NS_CORE = 'xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:dcmitype="http://purl.org/dc/dcmitype/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
XML_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n'
EMPTY_CORE = f"{XML_HEAD}<cp:coreProperties {NS_CORE}/>"
MINIMAL_APP = f'{XML_HEAD}<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties" xmlns:vt="http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes"><Application>Microsoft Office Word</Application></Properties>'
REPLACED = {"docProps/core.xml": EMPTY_CORE, "docProps/app.xml": MINIMAL_APP}


def owner(name: str) -> str:
    """The folder that targets of a relationship part are relative to."""
    return posixpath.dirname(posixpath.dirname(name))


def target(base: str, ref: str) -> str:
    """A target as a part's name; rooted ones stand alone."""
    return posixpath.normpath(posixpath.join("/", base, ref)).lstrip("/")


def _settle(found: list[Element], edits: Edits, mode: str, stats: Counter) -> None:
    """Tracked changes accepted or rejected."""
    stay, go = (ADDED, TAKEN) if mode == "accept" else (TAKEN, ADDED)
    for el in found:
        if el.tag in go:
            edits.remove(el)
            stats["ins" if el.tag in ADDED else "del"] += 1
        elif el.tag in stay:
            edits.unwrap(el)
            stats["ins" if el.tag in ADDED else "del"] += 1
        elif el.tag in MARKERS:
            edits.remove(el)
        elif el.tag in FORMAT_CHANGES:
            stats["format"] += 1
            old = next((c for c in el.children if c.tag == FORMAT_CHANGES[el.tag]), None)
            if mode == "accept" or old is None or el.parent is None:
                edits.remove(el)
            elif old.close == old.end:
                edits.replace(el.parent.inner, el.parent.close)
            else:  # the old properties take the place of all that the parent holds
                edits.replace(el.parent.inner, old.inner)
                edits.replace(old.close, el.parent.close)
        elif mode == "reject" and el.tag in OLD_TEXT and el.within("w:del", "w:moveFrom"):
            edits.rename(el, OLD_TEXT[el.tag])


def _without_comments(found: list[Element], edits: Edits) -> None:
    for el in found:
        if el.tag in REFERENCES:
            run = el.parent
            edits.remove(run if run is not None and run.tag == "w:r" and all(c.tag in REFERENCES for c in run.children) else el)


def _anonymous_comments(found: list[Element], edits: Edits, stats: Counter) -> None:
    for el in found:
        if el.tag in ("w:comment", "tc:threadedComment"):
            stats["comments"] += 1
        if el.tag == "ss:author" and edits.data[el.inner : el.close].strip():
            edits.replace(el.inner, el.close)
            stats["comments"] += 1
        for a in el.attributes:
            if el.tag == "w:comment" and a.name == "w:initials" or el.tag == "p:cmAuthor" and a.name in ("name", "initials") and a.value:
                edits.blank(a)
                stats["comments"] += el.tag == "p:cmAuthor"
            elif el.tag == "p:cm" and a.local == "dt" or el.tag == "tc:threadedComment" and a.local == "dT":
                edits.drop(a)


#: Words, in lower case, one of which stands in every part that loses an element or attribute, whatever its name.
_WORDS = (b"rsid", b"paraid", b"textid", b"docid", b"trackrevisions", b"savethroughxslt", b"attachedtemplate")
_PLAIN = re.compile(rb"<(?!\?)|<\?xml version=(['\"])1\.0\1 encoding=(['\"])UTF-8\2[^>&]*\?>")


def _untouched(name: str, data: bytes, gone: set[str]) -> bool:
    """Whether a part surely stays as it is, told without its elements: plain UTF-8 that reads, holds no word of what goes and names no part that goes."""
    if re.match(REVISION_PARTS, name) or re.match(COMMENTS, name) or re.match(PERSONS, name) or not _PLAIN.match(data):
        return False
    lowered = data.lower()
    if any(word in lowered for word in _WORDS):
        return False
    if gone and (b"&" in data or any(posixpath.basename(x).encode() in data for x in gone)):
        return False
    try:
        check_xml(data)
    except (ValueError, expat.ExpatError):
        return False
    return True


def rewrite(name: str, data: bytes, gone: set[str], options: Mapping[str, object]) -> tuple[bytes, dict[str, int]]:
    """The part as it stays, and what was counted; ValueError or ExpatError where it is no safe XML."""
    if name in REPLACED:
        return REPLACED[name].encode(), {}
    if _untouched(name, data, gone):
        return data, {}
    data, _ = as_utf8(data)
    found, edits, stats = elements(data), Edits(data), Counter()
    revised = re.match(REVISION_PARTS, name) is not None
    if revised and options["changes"] != "keep":
        _settle(found, edits, str(options["changes"]), stats)
    if revised and options["comments"] == "delete":
        _without_comments(found, edits)
    if re.match(COMMENTS, name) and options["comments"] != "keep":
        _anonymous_comments(found, edits, stats)
    persons = re.match(PERSONS, name) is not None
    base = owner(name)
    for el in found:
        if el.tag in WHOLE and (name == "word/settings.xml" or el.tag not in SETTINGS):
            edits.remove(el)
            stats["rsid"] += el.tag in SESSIONS
            stats["docId"] += el.tag in DOCUMENT_IDS
            stats["settings"] += el.tag in SETTINGS
        elif gone and el.tag in POINTING:
            if el.tag == "ct:Override":
                dead = any(a.local == "PartName" and a.value.lstrip("/") in gone for a in el.attributes)
            else:
                told = {a.local: a.value for a in el.attributes}
                dead = told.get("TargetMode") != "External" and target(base, told.get("Target", "")) in gone
            if dead:
                edits.remove(el)
        for a in el.attributes:
            low = a.local.lower()
            if low.startswith("rsid"):
                edits.drop(a)
                stats["rsid"] += 1
            elif a.local in PARAGRAPH_IDS:
                edits.drop(a)
                stats["paraId"] += 1
            elif a.local == "docId":
                edits.drop(a)
                stats["docId"] += 1
            elif revised and a.name == "w:author":
                edits.blank(a)
                stats["authors"] += 1
            elif revised and a.name == "w:date":
                edits.drop(a)
                stats["dates"] += 1
            elif persons and low in ACCOUNT and a.value:
                edits.blank(a)
                stats["accounts"] += 1
    return edits.applied(), {k: v for k, v in stats.items() if v}


# An independent reading ------------------------------------------------------

_W = {NAMESPACES["w"], *(k for k, v in STRICT.items() if v == "w")}


def _w(tag: object) -> str:
    uri, _, local = tag[1:].partition("}") if isinstance(tag, str) and tag.startswith("{") else ("", "", tag)
    return str(local) if uri in _W else ""


class _Texts:
    """All text of a part, without its elements."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.data = self.pieces.append

    def close(self) -> str:
        return "".join(self.pieces)


def told_text(data: bytes | None, mode: str | None) -> str | None:
    """The text of a part: all of it, or what a reader of a Word part sees when changes are accepted or rejected.

    Null where the part cannot be read.
    """
    parser = ElementTree.XMLParser(target=_Texts()) if mode is None else ElementTree.XMLParser()
    try:
        parser.feed(data or b"")
        root = parser.close()
    except (ElementTree.ParseError, expat.ExpatError, ValueError, LookupError):
        return None
    if mode is None:
        return root
    hidden = {"accept": {"del", "moveFrom"}, "reject": {"ins", "moveTo"}}[mode]
    shown = {"t", "instrText"} | ({"delText", "delInstrText"} if mode == "reject" else set())
    out, stack = [], [root]
    while stack:
        el = stack.pop()
        local = _w(el.tag)
        if local in hidden:
            continue
        if local in shown:
            out.append(el.text or "")
        stack.extend(reversed(el))
    return "".join(out)


def _is_xml(name: str | None) -> bool:
    return name is not None and name.endswith((".xml", ".rels"))


def text_digest(name: str | None, data: bytes | None, mode: str | None) -> str | None:
    """The digest of a part's text; null where it cannot be read, and for parts whose text cleaning changes by itself."""
    settled = _is_xml(name) and re.match(REVISION_PARTS, name) is not None
    return _digest(told_text(data, mode if settled else None)) if _compares_text(name) else None


def _compares_text(name: str | None) -> bool:
    return _is_xml(name) and (re.match(REVISION_PARTS, name) is not None or not name.startswith("docProps/") and not re.match(COMMENTS, name))


def _digest(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


def checked(name: str | None, data: bytes | None, mode: str | None) -> tuple[str | None, bool, list[dict] | None]:
    """(digest of the text, whether the part is XML that cannot be read, its elements)."""
    if not _is_xml(name):
        return None, False, None
    try:
        nodes, whole = kept_nodes_and_text(name, data or b"")
    except (ValueError, expat.ExpatError):
        nodes = whole = None
    # One reading gives the text, too, where all of it counts.
    sha = _digest(whole) if whole is not None and mode is None and _compares_text(name) else text_digest(name, data, mode)
    # What this parser has read, the other one reads too; where it has not, the other one is asked.
    return sha, sha is None and nodes is None and told_text(data, None) is None, nodes
