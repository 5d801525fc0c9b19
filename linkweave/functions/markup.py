"""One pass over HTML text: the ``href`` values of anchors, of the whole page or of one element.

A small state machine; every character is read a bounded number of times, so a
page costs time in proportion to its length whatever its markup looks like.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

#: HTML void elements (never closed), and elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*|=[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);")


def decode_references(value: str) -> str:
    """Every character reference (named, decimal, hexadecimal) that ends in ``;`` decoded."""
    return _REFERENCE.sub(lambda m: _html.unescape(m.group()), value) if "&" in value else value


def _attributes(text: str, at: int, wanted: tuple[str, ...]) -> tuple[dict[str, str], int]:
    """(the first value of each wanted attribute, place after the tag); place -1 if the tag never ends."""
    found: dict[str, str] = {}
    while True:
        at = _GAP.match(text, at).end()
        if at >= len(text):
            return found, -1
        if text[at] == ">":
            return found, at + 1
        name = _ATTRIBUTE.match(text, at)
        at, value = name.end(), ""
        equals = _EQUALS.match(text, at)
        if equals:
            at = equals.end()
            quote = text[at : at + 1]
            if quote in ('"', "'") and quote:
                end = text.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = text[at + 1 : end], end + 1
            else:
                bare = _BARE.match(text, at)
                value, at = bare.group(), bare.end()
        key = name.group().lower()
        if key in wanted:
            found.setdefault(key, value)


def anchor_hrefs(text: str, scope_id: str | None = None) -> Iterator[str]:
    """Decoded ``href`` values of the anchors in order; with ``scope_id`` only inside the element of that id.

    Comments, scripts and styles hold no anchors; one that never ends hides the
    rest of the page, as does a tag that never ends.  An anchor without ``href``
    gives nothing, one with an empty or valueless ``href`` the empty string.
    """
    at, stack, count, depth = 0, [], Counter(), None
    wanted = ("href", "id") if scope_id is not None else ("href",)
    while True:
        at = text.find("<", at)
        if at < 0:
            return
        if text.startswith("<!--", at):
            at = text.find("-->", at + 4)
            if at < 0:
                return
            at += 3
        elif text.startswith("</", at):
            name = _NAME.match(text, at + 2)
            at = text.find(">", at + 2) if name else at + 2
            if at < 0:
                return
            tag = name.group().lower() if name else ""
            if count[tag]:
                while True:
                    top = stack.pop()
                    count[top] -= 1
                    if depth is not None and len(stack) < depth:
                        depth = None
                    if top == tag:
                        break
        else:
            name = _NAME.match(text, at + 1)
            if not name:
                at += 1
                continue
            tag = name.group().lower()
            found, at = _attributes(text, name.end(), wanted)
            if at < 0:
                return
            if tag == "a" and "href" in found and (scope_id is None or depth is not None):
                yield decode_references(found["href"])
            if scope_id is not None and tag not in VOID:
                stack.append(tag)
                count[tag] += 1
                if depth is None and found.get("id") == scope_id:
                    depth = len(stack)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(text, at)
                if not close:
                    return
                at = close.start()
