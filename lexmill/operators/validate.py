"""Checks of requests, on the driver, before a plan is made. Each returns the value or raises ValueError."""

from __future__ import annotations

import re
import uuid
from datetime import date
from urllib.parse import urlsplit

from lexmill.operators.search import MOST_ITEMS, MOST_RESULTS, parse_day


def uuid4(text: str) -> str:
    try:
        ok = uuid.UUID(text).version == 4 and str(uuid.UUID(text)) == text.lower()
    except (ValueError, AttributeError, TypeError):
        ok = False
    if not ok:
        raise ValueError(f"not a version 4 UUID: {text!r}")
    return text


def batch(items: list[str], most: int = MOST_ITEMS) -> list[str]:
    """1 to ``most`` items, none empty, none twice."""
    if not 1 <= len(items) <= most:
        raise ValueError(f"1 to {most} items, not {len(items)}")
    if len(set(items)) != len(items) or not all(isinstance(x, str) and x.strip() for x in items):
        raise ValueError("items must be different and not empty")
    return items


def number(value: int, least: int = 1, most: int = MOST_RESULTS) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"a whole number from {least} to {most}, not {value!r}")
    return value


def day(text: str) -> date:
    got = parse_day(text)
    if got is None:
        raise ValueError(f"not a date as dd/mm/yyyy: {text!r}")
    return got


def one_of(value: str, domain: tuple[str, ...]) -> str:
    if value not in domain:
        raise ValueError(f"{value!r} is none of {', '.join(domain)}")
    return value


def https_url(text: str, hosts: tuple[str, ...] = ()) -> str:
    parts = urlsplit(text)
    if parts.scheme != "https" or not parts.hostname or (hosts and parts.hostname not in hosts):
        raise ValueError(f"not an https address of an allowed host: {text!r}")
    return text


def folder(text: str) -> str:
    """A relative path of slugs, without steps upwards."""
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*(?:/[a-z0-9]+(?:-[a-z0-9]+)*)*", text):
        raise ValueError(f"not a path of slugs: {text!r}")
    return text
