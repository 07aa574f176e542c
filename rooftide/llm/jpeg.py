"""Media columns as baseline JPEG: marker parsing, Huffman scans, DC-only luminance thumbnails.

The reader takes any baseline (SOF0, Huffman, 8-bit) stream: it parses the
markers, splits each scan at its restart markers, and decodes all segments of a
batch in lockstep with numpy, one symbol of every segment per step.  Only DC
terms are dequantised; they give one luminance sample per 8x8 block.

The writer stores bytes losslessly in that form: one byte is the DC term of one
block (quantiser 8, so the block mean is the byte itself), 64 blocks to a row,
one restart interval per row.  Payloads beyond the format's height limit go on
in further frames of the same stream, each with its own markers.

Cases: null is the empty payload; a payload is padded with zero bytes to a
positive multiple of 64; payloads of any length are kept whole; equal payloads
give equal streams; an empty table gives an empty result; a null stream gives
null features and no error; a stream that is damaged or not baseline JPEG gives
null features and says why in ``error``.  Long payloads and streams are worked
on frame by frame, which bounds what a task holds beside them.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

ROW = 64
#: Block rows of one frame: the height field is 16 bits of pixels.
FRAME_ROWS = 8184
#: Bytes of payloads or streams that are worked on at once.
WORK = 1 << 19
#: What a damaged stream raises.
DAMAGE = (ValueError, IndexError, KeyError, struct.error)
# The luminance DC table of ITU-T T.81 annex K, and an AC table with the end-of-block code alone.
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_COUNTS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)


def canonical(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a table given as counts by length and symbols in code order."""
    out, code, rest = [], 0, iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, next(rest)))
            code += 1
        code <<= 1
    return out


def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16-bit window the code's length * 256 + symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    for code, length, symbol in canonical(counts, symbols):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a whole block by DC difference + 255: DC code, DC bits, end of block."""
    dc = {s: (c, n) for c, n, s in canonical(DC_COUNTS, DC_SYMBOLS)}
    code, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = dc[size]
        code[d + 255] = (c << size | (d if d > 0 else d + (1 << size) - 1)) << 1
        bits[d + 255] = n + size + 1
    return code, bits


CODES, BITS = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    """All markers up to the scan data of a frame of ``rows`` x 64 blocks."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8]) + bytes([1]) * 63),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
        _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


HEADERS: dict[int, bytes] = {}


def pad(payload: bytes) -> bytes:
    return payload + bytes(max(ROW, -(-len(payload) // ROW) * ROW) - len(payload))


def write(payloads: list[bytes]) -> list[bytes]:
    """One stream per padded payload, in batches of frames."""
    size = FRAME_ROWS * ROW
    pieces = [(i, p[a : a + size]) for i, p in enumerate(payloads) for a in range(0, len(p), size)]
    streams: list[list[bytes]] = [[] for _ in payloads]
    for some in batched(pieces, lambda x: len(x[1])):
        for (i, _), stream in zip(some, write_frames([p for _, p in some]), strict=True):
            streams[i].append(stream)
    return [b"".join(x) for x in streams]


def batched(items: list, size: Callable[[Any], int]) -> Iterator[list]:
    """Runs of items of about WORK bytes together."""
    some, total = [], 0
    for x in items:
        if some and total + size(x) > WORK:
            yield some
            some, total = [], 0
        some.append(x)
        total += size(x)
    if some:
        yield some


def write_frames(payloads: list[bytes]) -> list[bytes]:
    """One stream of one frame for each payload of 64 to 64 * FRAME_ROWS bytes."""
    frames = [len(p) // ROW for p in payloads]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int64)
    before = np.concatenate([np.full((len(samples), 1), 128), samples[:, :-1]], axis=1)
    diff = (samples - before + 255).ravel()
    code, bits = CODES[diff], BITS[diff]
    row_bits = bits.reshape(-1, ROW).sum(1)
    row_bytes = -(-row_bits // 8)
    row_start = np.cumsum(row_bytes) - row_bytes
    ends = np.cumsum(bits.reshape(-1, ROW), axis=1)
    at = (ends - bits.reshape(-1, ROW) + 8 * row_start[:, None]).ravel()
    total = int(row_bytes.sum())
    window = code << (24 - bits - (at & 7))
    out = np.zeros(total + 3, np.int64)
    for k in range(3):  # codes do not overlap, so sums are unions
        out[: total + 3] += np.bincount((at >> 3) + k, weights=(window >> (16 - 8 * k)) & 255, minlength=total + 3).astype(np.int64)
    last = row_start + row_bytes - 1
    out[last] |= (1 << (8 * row_bytes - row_bits)) - 1  # a row ends in ones
    out = out[:total].astype(np.uint8)
    full = out == 255
    stuffed = np.cumsum(full)
    row_of = np.repeat(np.arange(len(row_bytes)), row_bytes)
    to = np.arange(total) + stuffed - full + 2 * row_of
    final = np.zeros(total + int(stuffed[-1]) + 2 * len(row_bytes), np.uint8)
    final[to] = out
    row_end = last + stuffed[last] + 1 + 2 * np.arange(len(row_bytes))
    frame_of = np.repeat(np.arange(len(frames)), frames)
    first = np.cumsum(frames) - frames
    final[row_end] = 255
    final[row_end + 1] = 0xD0 + (np.arange(len(row_bytes)) - first[frame_of]) % 8
    closing = row_end[first + frames - 1]
    final[closing + 1] = 0xD9
    data, ends = final.tobytes(), (closing + 2).tolist()
    return [HEADERS.setdefault(rows, header(rows)) + data[a:b] for rows, a, b in zip(frames, [0, *ends[:-1]], ends, strict=True)]


@dataclass
class Frame:
    """What the markers of one frame say; ``luma`` is filled by :func:`decode`."""

    width: int = 0
    height: int = 0
    restart: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, tuple] = field(default_factory=dict)
    #: (id, horizontal, vertical sampling, quantiser) in frame order
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    start: int = 0
    end: int = 0
    luma: np.ndarray | None = None


def parse(data: bytes, at: int, stop: int, marks: np.ndarray) -> tuple[Frame, int]:
    """The frame that begins at ``at`` and the offset behind it; ``marks``: offsets of markers that end a scan."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    f, at = Frame(), at + 2
    while at < stop:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return f, at + 2
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                f.quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                counts = tuple(body[1:17])
                n = sum(counts)
                f.tables[body[0]] = (counts, tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xC0:
            _, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            f.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif kind == 0xDD:
            f.restart = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            if f.scan:
                raise ValueError("more than one scan is not supported")
            f.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            f.start = at
            k = int(np.searchsorted(marks, at))
            f.end = at = int(marks[k]) if k < len(marks) else stop
        elif 0xC1 <= kind <= 0xCF:
            raise ValueError("only baseline JPEG is supported")
    return f, stop


def _layout(f: Frame) -> tuple[list[tuple[bool, int, int]], int, int]:
    """(is luminance, DC table, AC table) of each block of an MCU; MCUs across and down."""
    parts = {p[0]: p for p in f.parts}
    if len(f.scan) != len(f.parts):
        raise ValueError("all components must be in one scan")
    if len(f.scan) == 1:
        return [(True, f.scan[0][1], 0x10 | f.scan[0][2])], -(-f.width // 8), -(-f.height // 8)
    h, v = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    blocks = [(part == f.parts[0][0], dc, 0x10 | ac) for part, dc, ac in f.scan for _ in range(parts[part][1] * parts[part][2])]
    return blocks, -(-f.width // (8 * h)), -(-f.height // (8 * v))


def decode(data: bytes, bounds: list[tuple[int, int]]) -> list[list[Frame]]:
    """The frames of each stream ``data[a:b]``, with their luminance thumbnails."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    marks, resets, stuffed = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))], ff[(after >= 0xD0) & (after <= 0xD7)], ff[after == 0] + 1
    streams: list[list[Frame]] = []
    groups: dict[tuple, list[Frame]] = defaultdict(list)
    for a, b in bounds:
        streams.append([])
        while a < b:
            f, a = parse(data, a, b, marks)
            streams[-1].append(f)
            blocks, across, down = _layout(f)
            groups[tuple(blocks), f.restart, tuple(sorted(f.tables.items()))].append(f)
    keep = np.ones(len(raw), bool)
    keep[stuffed] = False
    clean = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint64)
    shift = np.concatenate([[0], np.cumsum(keep)])
    words = np.zeros(len(clean) - 8, np.uint64)
    for k in range(8):
        words |= clean[k : k + len(words)] << np.uint64(56 - 8 * k)
    for (blocks, restart, tables), frames in groups.items():
        _lockstep(frames, blocks, restart, dict(tables), words, shift, resets)
    return streams


def _lockstep(frames: list[Frame], blocks: tuple, restart: int, tables: dict, words: np.ndarray, shift: np.ndarray, resets: np.ndarray) -> None:
    """Decode the scans of frames that share tables, one symbol of every segment at a time."""
    names = sorted(tables)
    lut = np.stack([lookup(*tables[n]) for n in names])
    dc = np.array([names.index(b[1]) for b in blocks])
    ac = np.array([names.index(b[2]) for b in blocks])
    per = len(blocks)
    starts, sizes, totals = [], [], []
    for f in frames:
        _, across, down = _layout(f)
        n = across * down
        inner = resets[np.searchsorted(resets, f.start) : np.searchsorted(resets, f.end)] + 2
        step = restart or n
        count = -(-n // step)
        if len(inner) + 1 < count:
            raise ValueError("a restart marker is missing")
        starts.append(np.concatenate([[f.start], inner[: count - 1]]))
        sizes.append(np.minimum(step, n - step * np.arange(count)))
        totals.append(n)
    todo = np.concatenate(sizes) * per
    base = (np.cumsum(todo) - todo).astype(np.int64)
    terms = np.zeros(int(todo.sum()), np.int32)
    seg = np.arange(len(todo))
    bit = 8 * shift[np.concatenate(starts)].astype(np.int64)
    block, coef = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
    seen = np.zeros((len(todo), 1 if per == 1 else len({b[1:] for b in blocks}) + per), np.int64)
    part = np.zeros(per, np.int64) if per == 1 else np.cumsum([0, *(blocks[i] != blocks[i - 1] for i in range(1, per))])
    while len(seg):
        word = words[bit >> 3] << (bit & 7).astype(np.uint64)
        first = coef == 0
        turn = block % per if per > 1 else np.zeros_like(block)
        entry = lut[np.where(first, dc[turn], ac[turn]), (word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, symbol = entry >> 8, entry & 255
        if not length.all():
            raise ValueError("a code is not in its Huffman table")
        size = np.where(first, symbol, symbol & 15)
        extra = ((word << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        bit += length + size
        at = np.flatnonzero(first)
        value, width = extra[at], size[at]
        value = np.where((width > 0) & (value < (1 << np.maximum(width - 1, 0))), value - (1 << width) + 1, value)
        which = part[turn[at]]
        seen[at, which] += value
        terms[base[seg[at]] + block[at]] = seen[at, which]
        coef = np.where(first, 1, np.where(symbol == 0, 64, coef + (symbol >> 4) + 1))
        over = coef > 63
        block += over
        coef[over] = 0
        if over.any() and (done := block >= todo[seg]).any():
            go = ~done
            seg, bit, block, coef, seen = seg[go], bit[go], block[go], coef[go], seen[go]
    at = 0
    for f, n in zip(frames, totals, strict=True):
        own = terms[at : at + n * per].reshape(n, per)
        at += n * per
        _, across, down = _layout(f)
        own = own[:, [b[0] for b in blocks]]
        h, v = (f.parts[0][1], f.parts[0][2]) if per > 1 else (1, 1)
        grid = own.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        mean = np.clip(np.round(grid * f.quant[f.parts[0][3]] / 8 + 128), 0, 255).astype(np.uint8)
        f.luma = mean[: -(-f.height // 8), : -(-f.width // 8)]


def thumbnail_hash(luma: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 pooling are brighter than their mean."""
    rows, columns = (np.arange(8) * n // 8 for n in luma.shape)
    cells = np.add.reduceat(np.add.reduceat(luma, rows, 0, dtype=np.float64), columns, 1)
    tall, wide = (np.maximum(np.diff(np.append(x, n)), 1) for x, n in zip((rows, columns), luma.shape, strict=True))
    cells /= tall[:, None] * wide[None, :]
    return np.packbits(cells > cells.mean()).tobytes().hex()


def picture(frames: list[Frame]) -> tuple[int, int, str]:
    """Width, height and thumbnail hash of all frames of a stream, one below the other."""
    wide = max(f.luma.shape[1] for f in frames)
    luma = np.concatenate([np.pad(f.luma, ((0, 0), (0, wide - f.luma.shape[1]))) if f.luma.shape[1] < wide else f.luma for f in frames])
    return max(f.width for f in frames), sum(f.height for f in frames), thumbnail_hash(luma)


def store(docs: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """Padded payloads as JPEG streams: ``key``, ``n_bytes`` before padding, ``media``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1, 1 << 20):
            raw = [x or b"" for x in part.column(1).to_pylist()]
            media = write([pad(x) for x in raw])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, F.col(payload).cast("binary").alias(payload)), run, f"`{key}` {kind}, n_bytes bigint, media binary")


def frames_of(stream: bytes) -> Iterator[tuple[int, int]]:
    """Where each frame of a stream begins and ends."""
    raw = np.frombuffer(stream, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    marks = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
    at = 0
    while at < len(stream):
        _, end = parse(stream, at, len(stream), marks)
        yield at, end
        at = end


def read(streams: list[bytes]) -> list[tuple[int, int, int, bytes, str, None] | tuple[None, None, None, None, None, str]]:
    """(width, height, frames, thumbnail, hash, error) of each stream."""
    pieces, errors = [], {}
    for i, s in enumerate(streams):
        try:
            pieces += [(i, s[a:b]) for a, b in frames_of(s)]
        except DAMAGE as e:
            errors[i] = f"{type(e).__name__}: {e}"
    found: list[list[Frame]] = [[] for _ in streams]

    def add(some: list[tuple[int, bytes]]) -> None:
        ends = np.cumsum([len(p) for _, p in some]).tolist()
        for (i, _), f in zip(some, decode(b"".join(p for _, p in some), [(e - len(p), e) for (_, p), e in zip(some, ends, strict=True)]), strict=True):
            found[i] += f

    for some in batched([x for x in pieces if x[0] not in errors], lambda x: len(x[1])):
        try:
            add(some)
        except DAMAGE:
            for piece in some:  # find the damaged one
                try:
                    add([piece])
                except DAMAGE as e:
                    errors[piece[0]] = f"{type(e).__name__}: {e}"
    return [(None,) * 5 + (errors[i],) if i in errors else (*picture(f)[:2], len(f), b"".join(x.luma.tobytes() for x in f), picture(f)[2], None) for i, f in enumerate(found)]


def describe(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Read streams back: dimensions, frames, thumbnail samples and hash, all frames joined; ``error`` where that fails.

    All other columns of ``media`` stay as they are, but for the result's own names.
    """
    own = {"width": "int", "height": "int", "frames": "int", "thumbnail": "binary", "thumb_hash": "string", "error": "string"}
    kept = [c for c in media.columns if c.lower() not in own and c != column]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 0, 1 << 20):
            streams = part.column(0).to_pylist()
            some = iter(read([x for x in streams if x]))
            rows = [next(some) if x else (None,) * 5 + (None if x is None else "ValueError: not a JPEG stream",) for x in streams]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [column, *kept, *own])

    schema = ", ".join([f"`{column}` binary", *(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {t}" for c, t in own.items())])
    return map_arrow(media.select(column, *kept), run, schema)
