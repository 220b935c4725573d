"""A search as a value: fields, validation, and the query bar's grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from datetime import datetime

from certloom.errors import UsageError
from certloom.functions.when import format_when, parse_when

MODES = ("etld1", "suffix", "exact", "ip", "contains", "regex")
KINDS, STATUSES = ("precert", "final", "chain"), ("ok", "partial", "failed")


@dataclass(frozen=True)
class Group:
    columns: tuple[str, ...]
    sort: str
    key: str


GROUPS = {
    "names": Group(("name", "first_seen", "last_seen", "certs", "issuers"), "last_seen desc", "name"),
    "certs": Group(
        ("sha256", "cert_id", "kind", "issuer_cn", "not_before", "not_after", "names", "first_seen", "last_seen", "logs"), "first_seen desc", "cert_id"
    ),
    "issuances": Group(("issuance_key", "first_seen", "last_seen", "certs", "precert", "final", "issuers"), "first_seen desc", "issuance_key"),
}


@dataclass
class Query:
    """What search runs. mode and text name what to look for, the rest filters and shapes it."""

    mode: str = "etld1"
    text: str = ""
    issuer: str = ""
    issuer_org: str = ""
    issued_by: str = ""
    key_alg: str = ""
    kinds: list[str] = field(default_factory=list)
    parse_status: str = ""
    valid_at: datetime | None = None
    wildcard: bool = False
    log: str = ""
    since: datetime | None = None
    until: datetime | None = None
    by_not_before: bool = False
    group: str = "names"
    sort: str = ""
    fields: list[str] = field(default_factory=list)
    limit: int = 0
    filter: str = ""

    def checked(self) -> Query:
        """A copy with defaults filled in; UsageError if something is not allowed."""
        q = Query(**{f.name: getattr(self, f.name) for f in fields(self)})
        group = GROUPS.get(q.group)
        if not group:
            raise UsageError(f"unknown group {q.group!r}: {', '.join(GROUPS)}")
        if q.mode not in MODES:
            raise UsageError(f"unknown mode {q.mode!r}: {', '.join(MODES)}")
        q.kinds = q.kinds or ["precert", "final"]
        if bad := [k for k in q.kinds if k not in KINDS]:
            raise UsageError(f"unknown kind {bad[0]!r}: {', '.join(KINDS)}")
        if q.parse_status and q.parse_status not in STATUSES:
            raise UsageError(f"unknown parse status {q.parse_status!r}: {', '.join(STATUSES)}")
        q.sort = q.sort or group.sort
        words = q.sort.split()
        if not 1 <= len(words) <= 2 or words[0] not in group.columns or words[1:] not in ([], ["asc"], ["desc"]):
            raise UsageError(f"sort {q.sort!r}: one of {', '.join(group.columns)}, then asc or desc")
        if bad := [c for c in q.fields if c not in group.columns]:
            raise UsageError(f"{bad[0]!r} is not a column of group {q.group}: {', '.join(group.columns)}")
        if q.limit < 0:
            raise UsageError("the limit must not be negative")
        return q

    @property
    def columns(self) -> list[str]:
        return list(self.fields or GROUPS[self.group].columns)

    @property
    def order(self) -> tuple[str, bool]:
        """(sort column, descending) of a checked query."""
        words = self.sort.split()
        return words[0], words[1:] == ["desc"]

    @property
    def full_scan(self) -> bool:
        """Whether every name must be read."""
        return self.mode in ("contains", "regex")

    def bar(self) -> str:
        """The query bar's text for this search, filters in a fixed order."""
        terms = [_quoted(self.text) if self.mode == "etld1" else f"{self.mode}:{_quoted(self.text)}"]
        for key, name in _TEXT_TERMS:
            if value := getattr(self, name):
                terms.append(f"{key}:{_quoted(','.join(value) if name == 'kinds' else format_when(value) if isinstance(value, datetime) else value)}")
            if key == "valid-at" and self.wildcard:
                terms.append("wildcard")
        return " ".join(terms + ["by:not-before"] * self.by_not_before)


#: Filters of the bar and the fields they fill, in the order in which they are written.
_TEXT_TERMS = (
    ("issuer", "issuer"), ("org", "issuer_org"), ("issued-by", "issued_by"), ("key", "key_alg"), ("kind", "kinds"), ("status", "parse_status"),
    ("valid-at", "valid_at"), ("log", "log"), ("since", "since"), ("until", "until"),
)
_ALIASES = {"issuer-org": "org", "key-alg": "key", "parse-status": "status"}
_FIELD = dict(_TEXT_TERMS)
_TIMES = {"valid-at", "since", "until"}
_TERM = re.compile(r'(?:(?P<key>[^\s:"]*):)?+(?:"(?P<quoted>(?:\\.|[^"\\])*)"(?=[ \t]|$)|(?P<plain>[^ \t"][^ \t]*)|(?P<none>(?=[ \t]|$)))')


def _quoted(value: str) -> str:
    if value and value != "wildcard" and not re.search(r'[ \t":]', value):
        return value
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def parse_bar(text: str) -> Query:
    """The Query of a bar's text: one search term and any filters, as key:value or key:"quoted value"."""
    q, modes, at = Query(), 0, 0
    while rest := text[at:].lstrip(" \t"):
        at = len(text) - len(rest)
        m = _TERM.match(rest)
        if not m or not m[0]:
            raise UsageError(f"a quote is not closed, or does not end its term: {rest!r}")
        at += len(m[0])
        quoted = m["quoted"] is not None
        value = re.sub(r'\\(["\\])', r"\1", m["quoted"]) if quoted else m["plain"] or ""
        key = m["key"]
        if key is None or (key == "" and not quoted):
            if value == "wildcard" and not quoted:
                q.wildcard = True
                continue
            q.mode, q.text = "etld1", value if key is None else ":" + value
            modes += 1
            continue
        key = _ALIASES.get(key.lower(), key.lower())
        if not value and not quoted:
            raise UsageError(f"{key}: needs a value")
        if key in MODES and key != "etld1":
            q.mode, q.text = key, value
            modes += 1
        elif key == "by":
            if value not in ("not-before", "ct-ts"):
                raise UsageError(f"by:{value}: ct-ts or not-before")
            q.by_not_before = q.by_not_before or value == "not-before"
        elif key == "kind":
            q.kinds += [k.strip() for k in value.split(",") if k.strip()]
        elif key in _FIELD:
            setattr(q, _FIELD[key], parse_when(value) if key in _TIMES else value)
        else:
            raise UsageError(f"unknown term {key}:")
    if modes != 1:
        raise UsageError("give one search term: a domain, or suffix:, exact:, ip:, contains: or regex:")
    return q
