"""DNS names: normalisation, public suffixes, and rows of the names table."""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from certloom.errors import UsageError

#: Setting, and places, where the rules file of the public suffix list is looked for.
PSL_CONF = "spark.certloom.publicSuffixList"
PSL_PATHS = ("/usr/share/publicsuffix/public_suffix_list.dat", "/usr/share/publicsuffix/effective_tld_names.dat")
LABEL = r"[a-z0-9_-]{1,63}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)
_LABEL = re.compile(LABEL + r"\Z")


class PublicSuffixes:
    """Rules of a public suffix list, private ones included; names match the longest, else '*'."""

    def __init__(self, lines: list[str]):
        self.rules: set[str] = set()
        for line in lines:
            rule = line.split("//", 1)[0].strip().split(" ")[0].lower() if not line.startswith("//") else ""
            if rule:
                self.rules.add(_punycode(rule))
        self.version = hashlib.sha256("\n".join(sorted(self.rules)).encode()).hexdigest()

    def suffix(self, name: str) -> str:
        """The public suffix of a valid name."""
        labels = name.split(".")
        for i in range(len(labels)):
            tail = ".".join(labels[i:])
            if "!" + tail in self.rules:
                return ".".join(labels[i + 1 :])
            if tail in self.rules or i + 1 < len(labels) and "*." + ".".join(labels[i + 1 :]) in self.rules:
                return tail
        return labels[-1]

    def registrable(self, name: str, suffix: str | None = None) -> str | None:
        """The suffix with one label more; None if the name has none, or an empty label. suffix: the name's, where it is known."""
        if "" in name.split("."):
            return None
        suffix = self.suffix(name) if suffix is None else suffix
        if len(name) <= len(suffix):
            return None
        return name[: -len(suffix) - 1].rsplit(".", 1)[-1] + "." + suffix


def _punycode(rule: str) -> str:
    if rule.isascii():
        return rule
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in rule.split("."))


@functools.cache
def load_suffixes(path: str | None = None) -> PublicSuffixes:
    """The list at path, or at the first known place; without any, only the rule '*' holds."""
    for p in [path] if path else PSL_PATHS:
        if os.path.exists(p):
            with open(p, encoding="utf-8") as f:
                return PublicSuffixes(f.read().splitlines())
    if path:
        raise UsageError(f"no public suffix list at {path}")
    return PublicSuffixes([])


def session_suffixes(spark: SparkSession) -> PublicSuffixes:
    """The list that the session names, read on the driver and shipped to tasks."""
    return load_suffixes(spark.conf.get(PSL_CONF, None) or None)


def normalise(name: str) -> tuple[str, bool, bool, str]:
    """(name, valid, wildcard, base): ASCII lower case without one final dot.

    Valid names have labels of 1-63 letters, digits, - and _, 253 characters at most; a first label
    * before others makes a wildcard, and base is what follows it. A name with a backslash holds
    escaped bytes: it stays as it is and is not valid.
    """
    if "\\" in name:
        return name, False, False, ""
    name = name.translate(_TO_LOWER).removesuffix(".")
    base = name.removeprefix("*.")
    if len(name) > 253 or not all(_LABEL.match(x) for x in base.split(".")):
        return name, False, False, ""
    return name, True, base != name, base


def canonical_ip(text: str) -> str | None:
    """An IP literal in canonical form (an IPv4-mapped IPv6 address as ::ffff:a.b.c.d), or None."""
    if ":" not in text and not text.replace(".", "").isdigit():
        return None
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"::ffff:{a.ipv4_mapped}" + (f"%{a.scope_id}" if a.scope_id else "") if a.version == 6 and a.ipv4_mapped else str(a)


def name_rows(dns: list[str], ips: list[bytes], cns: list[str], psl: PublicSuffixes) -> Iterator[tuple]:
    """(source, name, dns_valid, is_wildcard, tld, etld1): DNS names, addresses, then new common names."""
    seen, found = set(), {}

    def dns_row(source: str, text: str) -> tuple:
        name, valid, wild, base = normalise(text)
        if not valid:
            return source, name, False, False, None, None
        if base not in found:  # a host and its wildcard have one base
            tld = psl.suffix(base)
            found[base] = tld, psl.registrable(base, tld)
        return source, name, True, wild, *found[base]

    for row in [*(dns_row("san_dns", x) for x in dns), *(("san_ip", _ip_name(x), False, False, None, None) for x in ips)]:
        seen.add(row[1])
        yield row
    for cn in cns:
        row = ("cn", cn, False, False, None, None)
        if "\\" not in cn:
            if ip := canonical_ip(cn):
                row = ("cn", ip, *row[2:])
            elif (n := normalise(cn))[1] and (n[2] or "." in n[3]):
                row = dns_row("cn", cn)
        if row[1] not in seen:
            seen.add(row[1])
            yield row


def _ip_name(raw: bytes) -> str:
    if len(raw) == 4:
        return ".".join(map(str, raw))
    return canonical_ip(str(ipaddress.ip_address(raw))) if len(raw) in (4, 16) else raw.hex()


# --- the same over columns ---


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def normalised(c: Column) -> Column:
    """struct<name, valid, wildcard, base> of normalise(), from built-in functions alone."""
    plain = F.regexp_replace(lower_ascii(c), r"\.\z", "")
    name = F.when(F.contains(c, F.lit("\\")), c).otherwise(plain)
    base = F.regexp_replace(plain, r"\A\*\.", "")
    valid = ~F.contains(c, F.lit("\\")) & (F.length(plain) <= 253) & base.rlike(rf"\A{LABEL}(?:\.{LABEL})*\z")
    return F.struct(name.alias("name"), valid.alias("valid"), (valid & (base != plain)).alias("wildcard"), F.when(valid, base).otherwise("").alias("base"))


def suffixes_udf(spark: SparkSession):
    """A pandas UDF base -> struct<tld, etld1>; the rules are broadcast once a session."""
    psl = spark.sparkContext.broadcast(session_suffixes(spark))

    @F.pandas_udf("tld string, etld1 string")
    def suffixes(base: pd.Series) -> pd.DataFrame:
        known = {x: (psl.value.suffix(x), psl.value.registrable(x)) for x in base.dropna().unique()}
        return pd.DataFrame([known.get(x, (None, None)) for x in base], columns=["tld", "etld1"])

    return suffixes
