"""Elements of one name in text that comes in pieces, also where they nest in themselves or a tag is cut in two."""

from __future__ import annotations

import re

#: A start tag that goes on for more than so many characters is text.
LONGEST_TAG = 1 << 20


class ElementScanner:
    """Finds outermost ``<tag ...>...</tag>`` and ``<tag .../>`` by the depth of open tags. Its state is that depth, the
    number of the element and an unfinished tag."""

    def __init__(self, tag: str, depth: int = 0, number: int = 0, carry: str = "") -> None:
        self.heads = (f"<{tag}", f"</{tag}")
        self.token = re.compile(rf"<{re.escape(tag)}(?:\s[^<>]*)?/?>|</{re.escape(tag)}\s*>")
        self.depth, self.number, self.carry = depth, number, carry

    def _unfinished(self, text: str, after: int) -> int:
        """Where a tag begins that may go on in the next piece; else the end."""
        at = text.rfind("<", after)
        part = text[at:] if at >= 0 else ""
        if at < 0 or ">" in part or len(part) > LONGEST_TAG:
            return len(text)
        goes_on = (h.startswith(part) or (part.startswith(h) and (part[len(h)].isspace() or part[len(h)] == "/")) if part != h else True for h in self.heads)
        return at if any(goes_on) else len(text)

    def feed(self, text: str | None) -> list[tuple[int, str, bool]]:
        """What the next piece of text adds: ``(number of the element, text, whether it is whole now)``."""
        text = self.carry + (text or "")
        out, begin, last = [], 0, 0
        for m in self.token.finditer(text):
            tag, last = m.group(), m.end()
            if tag.startswith("</"):
                if not self.depth:
                    continue
                self.depth -= 1
            elif not tag.endswith("/>"):
                begin = begin if self.depth else m.start()
                self.depth += 1
            elif not self.depth:
                begin = m.start()
            if not self.depth:
                out.append((self.number, text[begin:last], True))
                self.number += 1
        end = self._unfinished(text, last)
        self.carry = text[end:]
        if self.depth and end > begin:
            out.append((self.number, text[begin:end], False))
        return out
