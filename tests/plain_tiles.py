"""Vector tiles read one integer at a time: what the columnar reader is held against."""

from __future__ import annotations

import gzip
import zlib

from rooftide.operators.buildings import ATTRIBUTES
from rooftide.sources.vector_tiles import EXTENT, KEYS, LAYER, MASK32, TileError, attribute, messages, tagged_value, varint, zigzag


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def polygon_rings(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Closed rings of a command stream; the cursor wraps at 32 bits."""
    rings: list[list[tuple[int, int]]] = []
    ring: list[tuple[int, int]] = []
    at = x = y = 0
    wrap = lambda v: (v + (1 << 31) & MASK32) - (1 << 31)
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command == 7:
            if ring and ring[0] != ring[-1]:
                ring.append(ring[0])
            rings.append(ring)
            ring = []
        elif command in (1, 2):
            for _ in range(count):
                if at + 2 > len(commands):
                    raise TileError("truncated geometry")
                if command == 1 and ring:
                    rings.append(ring)
                    ring = []
                x, y = wrap(x + zigzag(commands[at] & MASK32)), wrap(y + zigzag(commands[at + 1] & MASK32))
                ring.append((x, y))
                at += 2
        else:
            raise TileError(f"unknown command {command}")
    return [*rings, ring] if ring else rings


def decode_tile(data: bytes, wanted: list[str], layer: str = LAYER) -> tuple[int, list[dict]]:
    """Extent and features of the last layer of the name; gzip is undone."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as e:
            raise TileError(str(e)) from e
    extent, features = EXTENT, []
    for field, wire, body in messages(data):
        if field == 3 and wire == 2 and (found := _decode_layer(body, wanted, layer)) is not None:
            extent, features = found
    return extent, features


def _decode_layer(data: bytes, wanted: list[str], layer: str) -> tuple[int, list[dict]] | None:
    name, blobs, keys, values, extent = "", [], [], [], EXTENT
    for field, wire, v in messages(data):
        if field == 1 and wire == 2:
            name = v.decode("utf-8", "replace")
        elif field == 2 and wire == 2:
            blobs.append(v)
        elif field == 3 and wire == 2:
            keys.append(v.decode("utf-8", "replace"))
        elif field == 4 and wire == 2:
            values.append(tagged_value(v))
        elif field == 5 and wire == 0:
            extent = v & MASK32
    if name != layer:
        return None
    column_of = {KEYS.get(c, c): c for c in wanted}
    at = {i: column_of[k] for i, k in enumerate(keys) if k in column_of}
    out = [f for i, blob in enumerate(blobs) if (f := _decode_feature(blob, at, values, i)) is not None]
    return extent, out


def _decode_feature(data: bytes, column_at: dict[int, str], values: list, number: int) -> dict | None:
    fid, tags, kind, geometry = None, [], 0, b""
    for field, wire, v in messages(data):
        if field == 1 and wire == 0:
            fid = v
        elif field == 2 and wire == 2:
            tags = packed(v)
        elif field == 3 and wire == 0:
            kind = v
        elif field == 4 and wire == 2:
            geometry = v
    if kind != 3 or not (rings := polygon_rings(packed(geometry))):
        return None
    row = {"feature_id": fid, "rings": rings, "feat_idx": number}
    for k, v in zip(tags[::2], tags[1::2], strict=False):
        if k in column_at and v < len(values):
            c = column_at[k]
            row[c] = attribute(ATTRIBUTES[c], values[v], c)
    return row
