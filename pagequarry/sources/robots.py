"""Rules of robots.txt files, from captured bodies."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote, unquote, urlsplit

USER_AGENT = "pagequarry"
# The sitemaps taken of one file, the answers that mean there are no rules.
MAX_SITEMAPS = 20
ABSENT = (404, 410)


@dataclass
class Rules:
    """What a robots.txt allows; ``checked`` is whether there was one to look at."""

    url: str
    checked: bool = True
    default: bool = True
    lines: list[tuple[int, bool, re.Pattern]] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)
    warning: str | None = None

    def allowed(self, url: str) -> bool:
        """The longest line that matches decides, of equal ones the permission; without any, the default."""
        split = urlsplit(url)
        path = _escaped(split.path or "/") + (f"?{split.query}" if split.query else "")
        hits = [(length, permit) for length, permit, form in self.lines if form.match(path)]
        return max(hits)[1] if hits else self.default


def _escaped(path: str) -> str:
    return quote(unquote(path), safe="/*$?=&;:@!,'()+~-._%")


def _form(pattern: str) -> re.Pattern:
    anchored = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in _escaped(pattern.removesuffix("$")).split("*"))
    return re.compile(body + (r"\Z" if anchored else ""), re.S)


def parse(text: str, url: str = "", agent: str = USER_AGENT) -> Rules:
    """The group of the agent named most closely, else of ``*``."""
    groups: dict[str, list[tuple[int, bool, re.Pattern]]] = {}
    sitemaps: list[str] = []
    names: list[str] = []
    open_names = False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not open_names:
                names = []
            names.append(value.lower())
            groups.setdefault(value.lower(), [])
            open_names = True
        elif key == "sitemap":
            sitemaps.append(value)
        elif key in ("allow", "disallow"):
            open_names = False
            if value:
                for n in names:
                    groups[n].append((len(value), key == "allow", _form(value)))
        else:
            open_names = False
    own = max((n for n in groups if n != "*" and n and n in agent.lower()), key=len, default="*")
    return Rules(url, lines=groups.get(own, []), sitemaps=sitemaps[:MAX_SITEMAPS])


def rules(url: str, body: str | None, status: int | None = 200, error: str | None = None, enabled: bool = True, agent: str = USER_AGENT) -> Rules:
    """Rules of an origin whose robots.txt answered so. Without usable rules everything is
    refused, unless the answer says that there are none.
    """
    if not enabled:
        return Rules(url, checked=False)
    if error is None:
        low = (body or "").lower()
        known = not low.strip() or any(x.strip().startswith(("user-agent:", "sitemap:", "#")) for x in low.splitlines())
        if "<html" not in low and "<!doctype" not in low and known:
            return parse(body or "", url, agent)
        error = "malformed_robots"
    allow = status in ABSENT
    return Rules(url, default=allow, warning=f"robots.txt unavailable ({error}); {'allowing' if allow else 'skipping'} affected requests.")
