"""Stable identities: SHA-256 over length-prefixed segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identity domains. Fixed values.
NODE, EDGE, CONTAINMENT, SCC, CYCLE = (f"dependency-{x}-id/v1" for x in ("node", "edge", "containment", "scc", "cycle"))


def segment(value: Column, width: int = 8) -> Column:
    """The UTF-8 bytes of a value behind their number, as a big-endian integer of width bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 2 * width, "0")), F.encode(value, "UTF-8"))


def stable_id(domain: str, *parts: Column) -> Column:
    """domain:sha256:hex over the domain and all parts."""
    body = F.concat(segment(F.lit(domain)), *(segment(p) for p in parts))
    return F.concat(F.lit(f"{domain}:sha256:"), F.sha2(body, 256))


def stable_id_of_members(domain: str, first: Column, members: Column) -> Column:
    """stable_id over the domain, first, and the sorted members of an array."""
    seed = F.concat(segment(F.lit(domain)), segment(first))
    body = F.unhex(F.array_join(F.transform(F.array_sort(members), lambda x: F.hex(segment(x))), ""))  # joined once: a growing text would cost the square of the members
    return F.concat(F.lit(f"{domain}:sha256:"), F.sha2(F.concat(seed, body), 256))


def node_id(kind: Column, language: Column, name: Column, path: Column, resolution: Column) -> Column:
    return stable_id(NODE, kind, language, name, path, resolution)


def edge_id(graph: Column, kind: Column, from_id: Column, to_id: Column, resolution: Column) -> Column:
    return stable_id(EDGE, graph, kind, from_id, to_id, resolution)


def containment_id(kind: Column, parent: Column, child: Column) -> Column:
    return stable_id(CONTAINMENT, kind, parent, child)


def compact_identity(*parts: Column) -> Column:
    """SHA-256 over parts behind four-byte lengths, as bytes."""
    return F.unhex(F.sha2(F.concat(*(segment(p, 4) for p in parts)), 256))


def uuid_v8(digest: Column) -> Column:
    """A version-8 UUID from the first 16 bytes of a digest: version and variant bits replaced."""
    h = F.lower(F.hex(F.substring(digest, 1, 16)))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def length_tagged(*parts: Column) -> Column:
    """length:value of each part, joined by a bar."""
    return F.concat_ws("|", *(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))
