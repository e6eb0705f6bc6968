"""Base spans of personal data: emails, IPv4 addresses, cards and phones, found by pattern in linear time."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Each try starts at a run's first digit and takes runs whole, so long runs are read once.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(text: str) -> bool:
    return 12 <= len(number := digits(text)) <= 19 and luhn(number)


def is_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of local characters before it and the domain after it; the run starts after the last span."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1
        if domain:
            out.append((start, domain.end()))
            low = domain.end()
        at = text.find("@", low)
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, end, kind) by start, then kind; and the (start, end) of matches that failed their check."""
    found = [(a, b, 0) for a, b in _emails(text)]
    failed = []
    if _DIGIT.search(text):
        for kind, pattern, good in (
            (1, _IP, lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())),
            (2, _CARD, lambda m: is_card(m.group())),
            (3, _PHONE, lambda m: is_phone(m.group())),
        ):
            for m in pattern.finditer(text):
                if good(m):
                    found.append((m.start(), m.end(), kind))
                elif kind != 2 or len(digits(m.group())) >= 12:
                    failed.append((m.start(), m.end()))
    return sorted(found, key=lambda s: (s[0], s[2])), failed
