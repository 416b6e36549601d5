"""Article XML: metadata, weighted sections, sections by role."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from datetime import date

from quillgraph.functions import constants as C

PUBLISHED = ("epub", "ppub", "collection", "pmc-release")
SPACE = re.compile(r"\s+")
DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", re.S)


def _text(node: ET.Element | None) -> str:
    return "" if node is None else SPACE.sub(" ", "".join(node.itertext())).strip()


def _heading(sec: ET.Element) -> str:
    return _text(sec.find("title"))


def _label(title: str) -> str:
    low = title.strip().lower()
    return next((label for needle, label in C.SECTION_NEEDLES if needle in low), "default")


def weighted_sections(root: ET.Element) -> list[dict]:
    """Title, abstract and the body's own sections with their weights."""
    found = [("title", _text(root.find(".//article-title"))), ("abstract", SPACE.sub(" ", " ".join(t for a in root.iter("abstract") if (t := _text(a)))).strip())]
    body = root.find(".//body")
    if body is not None:
        own = body.findall("sec")
        found += [(_label(_heading(s)), _text(s)) for s in own] if own else [("default", _text(body))]
    return [{"label": k, "text": t, "weight": C.SECTION_WEIGHTS.get(k, C.SECTION_WEIGHTS["default"])} for k, t in found if t]


def sections_by_role(root: ET.Element, most: int | None = None) -> dict[str, str]:
    """Text under each role; inner sections take their parent's role unless their own
    title has one.  A body without any role is all Discussion.  Texts are whole, or of
    ``most`` letters (the reference's is C.MAX_SECTION_CHARS)."""
    body = root.find(".//body")
    if body is None:
        return {}
    texts: dict[str, list[str]] = {}
    open_ = [(sec, "") for sec in reversed(body.findall("sec"))]  # a stack: document order, any depth
    while open_:
        sec, outer = open_.pop()
        role = C.SECTIONS.get(_heading(sec).lower(), outer)
        if role and (text := _text(sec)):
            texts.setdefault(role, []).append(text[:most])
        open_ += [(inner, role) for inner in reversed(sec.findall("sec"))]
    if not texts:
        whole = _text(body)[:most]
        return {"Discussion": whole} if whole else {}
    return {k: "\n\n".join(v)[:most] for k, v in texts.items()}


def read_article(xml: str | None, most: int | None = None) -> dict:
    """Columns of one article; ``{'ok': False}`` for what can't be parsed."""
    try:
        root = ET.fromstring(DOCTYPE.sub("", xml or "", count=1))
    except ET.ParseError:
        return {"ok": False}
    art = root if root.tag == "article" else root.find(".//article")
    if art is None:
        art = root
    ids = {n.get("pub-id-type", ""): _text(n) for n in art.iter("article-id")}  # the last of a kind counts
    names = []
    for person in art.iter("contrib"):
        if person.get("contrib-type") == "author":
            name = " ".join(x for x in (_text(person.find(".//surname")), _text(person.find(".//given-names"))) if x) or _text(person.find(".//collab"))
            if name:
                names.append(name)
    published = next((d for d in art.iter("pub-date") if d.get("pub-type") in PUBLISHED), None)
    year, month, day = ((int(t) if published is not None and (t := _text(published.find(k))).isdigit() else none) for k, none in (("year", 1900), ("month", 1), ("day", 1)))
    sections = weighted_sections(art)
    return {
        "ok": True,
        "title": _text(art.find(".//article-title")),
        "abstract": next((s["text"] for s in sections if s["label"] == "abstract"), ""),
        "journal": _text(art.find(".//journal-title")),
        "authors": names,
        "doi": ids.get("doi", ""),
        "pmcid": ids.get("pmcid", ids.get("pmc", "")),
        "pmid": ids.get("pmid", ""),
        "year": year,
        "date": date(year, min(max(month, 1), 12), min(max(day, 1), 28)),
        "kind": art.get("article-type", ""),
        "subjects": [t for s in art.iter("subject") if (t := _text(s))],
        "sections": sections,
        "by_section": list(sections_by_role(art, most).items()),
        "body": _text(art.find(".//body")),
    }
