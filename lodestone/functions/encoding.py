"""Canonical text: JSON bytes for hashing, and opaque page cursors."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: Column) -> Column:
    """to_json of a struct, with <, > and & as escapes and without empty fields.

    Field order is the struct's; nulls are left out by to_json itself.
    """
    text = F.to_json(value)
    for plain, escape in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return text


def fingerprint(value: Column) -> Column:
    """SHA-256 of a struct's canonical JSON."""
    return F.sha2(canonical_json(value), 256)


def base64url(data: Column) -> Column:
    """Base64 with - and _, without padding."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(data), "\\s", ""), "+/", "-_"), F.lit("="))


def page_cursor(digest: str, graph: str, direction: str, root: str, size: int, last: str) -> str:
    """A cursor bound to everything that a page depends on."""
    body = json.dumps([digest, graph, direction, root, size, last], separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def cursor_last(cursor: str, digest: str, graph: str, direction: str, root: str, size: int) -> str:
    """The last key of a cursor; ValueError where it belongs to another query."""
    try:
        *bound, last = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("cursor cannot be read") from e
    if bound != [digest, graph, direction, root, size] or page_cursor(*bound, last) != cursor:
        raise ValueError("cursor belongs to another query")
    return last
