"""Font programs as tables: stripping what page rendering doesn't use, skeletons and dense glyph numbers."""

from __future__ import annotations

import hashlib
import struct

# Tables that serve editing and screen hinting only.
UNUSED_TABLES = ("BASE", "GDEF", "GPOS", "GSUB", "JSTF", "MATH", "kern", "vhea", "vmtx", "DSIG", "PCLT", "hdmx", "LTSH", "VDMX")


def tables(data: bytes) -> dict[str, bytes] | None:
    """A font program's tables by tag; None if it isn't one."""
    if len(data) < 12 or data[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
        return None
    out = {}
    for i in range(struct.unpack(">H", data[4:6])[0]):
        head = data[12 + 16 * i : 28 + 16 * i]
        if len(head) < 16:
            return None
        tag, _, at, size = struct.unpack(">4sIII", head)
        if at + size > len(data):
            return None
        out[tag.decode("latin-1")] = data[at : at + size]
    return out


def checksum(table: bytes) -> int:
    padded = table + bytes(-len(table) % 4)
    return sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF


def build(found: dict[str, bytes], version: bytes = b"\0\1\0\0") -> bytes:
    """A font program of the tables in tag order, with fresh checksums."""
    found = dict(found)
    if "head" in found and len(found["head"]) >= 12:
        found["head"] = found["head"][:8] + bytes(4) + found["head"][12:]
    n = len(found)
    power = 1 << max(0, n.bit_length() - 1)
    head = version + struct.pack(">HHHH", n, power * 16, max(0, n.bit_length() - 1), max(0, n - power) * 16)
    at, body = 12 + 16 * n, b""
    for tag in sorted(found):
        table = found[tag]
        head += struct.pack(">4sIII", tag.encode("latin-1"), checksum(table), at + len(body), len(table))
        body += table + bytes(-len(table) % 4)
    out = bytearray(head + body)
    if "head" in found and len(found["head"]) >= 12:
        place = next(struct.unpack(">I", out[12 + 16 * i + 8 : 12 + 16 * i + 12])[0] for i in range(n) if out[12 + 16 * i : 16 + 16 * i] == b"head")
        out[place + 8 : place + 12] = struct.pack(">I", 0xB1B0AFBA - checksum(bytes(out)) & 0xFFFFFFFF)
    return bytes(out)


def strip_unused(data: bytes) -> tuple[bytes, int] | None:
    """The program without unused tables and the bytes that went; None if nothing goes."""
    found = tables(data)
    if not found or not set(found) & set(UNUSED_TABLES):
        return None
    out = build({k: v for k, v in found.items() if k not in UNUSED_TABLES}, data[:4])
    return (out, len(data) - len(out)) if len(out) < len(data) else None


def strip_cmap(data: bytes) -> tuple[bytes, int] | None:
    """A TrueType program without its character map, for programs only used by glyph number."""
    found = tables(data)
    if not found or data[:4] != b"\0\1\0\0" or "cmap" not in found or not {"glyf", "head", "hhea", "hmtx", "loca", "maxp"} <= set(found):
        return None
    out = build({k: v for k, v in found.items() if k != "cmap"}, data[:4])
    return (out, len(data) - len(out)) if len(out) < len(data) else None


def skeleton_hash(data: bytes) -> str | None:
    """A digest of all but outlines and the whole-file checksum: equal for subsets of one font."""
    found = tables(data)
    if not found or "head" not in found or len(found["head"]) < 12:
        return None
    found["head"] = found["head"][:8] + bytes(4) + found["head"][12:]
    h = hashlib.sha256()
    for tag in sorted(found):
        if tag not in ("glyf", "loca"):
            h.update(tag.encode("latin-1") + struct.pack(">Q", len(found[tag])) + found[tag])
    return h.hexdigest()


def dense_numbers(used: list[int]) -> dict[int, int]:
    """New consecutive numbers of used glyphs in order, 0 staying first."""
    return {g: i for i, g in enumerate(sorted({0, *used}))}
