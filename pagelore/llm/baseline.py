"""Baseline JPEG pictures (sequential DCT, Huffman codes, 8 bits) decoded in numpy, the restart intervals of many in lockstep."""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

#: Blocks of 64 samples decoded at once, at most about.
BLOCKS = 1 << 16

_grid = np.arange(8)
#: Row u has the cosines of frequency u at the eight samples.
COSINES = np.where(_grid[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _grid[None, :] + 1) * _grid[:, None] * np.pi / 16)
#: Place in the block of each coefficient in the order of the file: along the diagonals, in turn up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


class Picture(NamedTuple):
    height: int
    width: int
    parts: tuple[tuple[int, int, int, int, int], ...]  # of each component: factors across and down, its three tables
    steps: dict[int, np.ndarray]
    codes: tuple[tuple[tuple[int, int], tuple, tuple], ...]  # (class and place, code counts, symbols) of each table
    interval: int
    coded: list[bytes]
    rgb: bool

    @property
    def factors(self) -> tuple[int, int]:
        return max(p[0] for p in self.parts), max(p[1] for p in self.parts)

    @property
    def units(self) -> tuple[int, int]:
        """How many of the smallest coded units there are down and across."""
        across, down = self.factors
        return -(-self.height // (8 * down)), -(-self.width // (8 * across))


def _intervals(scan: bytes) -> list[bytes]:
    """The coded bytes between restart marks, without stuffing; what follows the scan is left out."""
    rows, start, where = [], 0, scan.find(b"\xff")
    while where >= 0:
        mark = scan[where + 1] if where + 1 < len(scan) else 0xD9
        if 0xD0 <= mark <= 0xD7:
            rows.append(scan[start:where])
            start = where + 2
        elif mark not in (0, 0xFF):
            scan = scan[:where]
            break
        where = scan.find(b"\xff", where + (1 if mark == 0xFF else 2))
    return [r.replace(b"\xff\x00", b"\xff") for r in [*rows, scan[start:]]]


def parsed(data: bytes) -> Picture:
    """The parts of a picture; ValueError for what isn't one or is of another process."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    at, frame, steps, codes, interval, transform = 2, None, {}, {}, 0, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        if data[at + 1] == 0xFF:
            at += 1
            continue
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit samples")
            height, width, count = struct.unpack_from(">HHB", body, 1)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            if not height or not width or count not in (1, 3) or not all(1 <= f[1] <= 4 and 1 <= f[2] <= 4 for f in frame):
                raise ValueError("a frame of no size or of other than one or three components")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("neither a baseline nor a lossless picture")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
            transform = body[11]
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame):
                raise ValueError("a scan of some components only")
            tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            parts = tuple((h, v, q, *tables[name]) for name, h, v, q in frame)
            parts = parts if len(parts) > 1 else ((1, 1, *parts[0][2:]),)  # one component is coded block by block
            if any(q not in steps or (0, d) not in codes or (1, a) not in codes for _, _, q, d, a in parts):
                raise ValueError("a table isn't in the picture")
            return Picture(height, width, parts, steps, tuple((k, *codes[k]) for k in sorted(codes)), interval, _intervals(data[at + 2 + size :]), transform == 0 and len(parts) == 3)
        at += 2 + size
    raise ValueError("no scan")


def _lookup(counts: tuple, symbols: tuple) -> np.ndarray:
    """Symbol and code length (symbol * 32 + length) for every 16 bits that follow; length 0 where no code begins so."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[code << 16 - length : code + 1 << 16 - length] = symbols[k] * 32 + length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def coefficients(coded: list[bytes], blocks: np.ndarray, layout: list[tuple[int, int, int]], lookups: np.ndarray) -> np.ndarray:
    """(blocks of all streams one after the other, 64) in the order of the file. ``layout`` has (component, DC, AC look-up)
    of the blocks of a unit; ``blocks`` how many a stream has. Every stream decodes a symbol a step, until all have ended."""
    size = np.array([len(r) for r in coded], dtype=np.int64)
    data = np.frombuffer(b"".join(r + b"\0" * 8 for r in coded), np.uint8).astype(np.uint64)
    word = np.zeros(len(data) - 4, dtype=np.uint64)
    for k in range(5):
        word |= data[k : len(data) - 4 + k] << np.uint64(32 - 8 * k)
    word = word.astype(np.int64)
    begin = np.cumsum(size + 8) - size - 8
    at, end = begin * 8, (begin + size) * 8
    first = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), 64), dtype=np.int32)
    part, dc, ac = (np.array(x) for x in zip(*layout, strict=True))
    before = np.zeros((len(coded), int(part.max()) + 1), dtype=np.int64)
    block, place = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
    live = np.flatnonzero(blocks > 0)
    while len(live):
        here, k, slot = at[live], place[live], block[live] % len(part)
        held, left = word[here >> 3], 40 - (here & 7)
        is_dc = k == 0
        found = lookups[np.where(is_dc, dc[slot], ac[slot]), (held >> (left - 16)) & 0xFFFF]
        n, symbol = found & 31, found >> 5
        category = np.where(is_dc, symbol, symbol & 15)
        here = here + n + category
        if not n.all() or (category > 15).any() or (here > end[live]).any():
            raise ValueError("the coded samples are cut off or no code of their table")
        extra = (held >> (left - n - category)) & ((1 << category) - 1)
        value = np.where((category > 0) & (extra < (1 << category) >> 1), extra - (1 << category) + 1, extra)
        at[live] = here
        which = live[is_dc]
        before[which, part[slot[is_dc]]] += value[is_dc]
        value[is_dc] = before[which, part[slot[is_dc]]]
        to = np.where(is_dc, 0, k + (symbol >> 4))
        said = is_dc | (category > 0)
        if (to[said] > 63).any():
            raise ValueError("a coefficient after the last")
        out[first[live[said]] + block[live[said]], to[said]] = value[said]
        ended = ~is_dc & (symbol == 0)
        to = np.where(ended, 64, to + 1)
        full = to >= 64
        place[live] = np.where(full, 0, to)
        block[live] += full
        live = live[block[live] < blocks[live]]
    return out


def _samples(block: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Samples (blocks, 8, 8) of coefficients in the order of the file."""
    square = np.zeros((len(block), 64))
    square[:, ZIGZAG] = block * steps
    return np.clip(np.rint(COSINES.T @ square.reshape(-1, 8, 8) @ COSINES) + 128, 0, 255)


def _painted(picture: Picture, block: np.ndarray) -> np.ndarray:
    """Red, green and blue (height, width * 3) of a picture's blocks (units, blocks of a unit, 64)."""
    down, across = picture.units
    most = picture.factors
    planes, at = [], 0
    for h, v, q, _, _ in picture.parts:
        part = _samples(block[:, at : at + h * v].reshape(-1, 64), picture.steps[q]).reshape(down, across, v, h, 8, 8)
        at += h * v
        plane = part.transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
        rows = np.arange(picture.height) * v // most[1]
        columns = np.arange(picture.width) * h // most[0]
        planes.append(plane[rows][:, columns])
    if len(planes) == 1:
        planes *= 3
    elif not picture.rgb:
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
    return np.clip(np.rint(np.stack(planes, axis=2)), 0, 255).astype(np.uint8).reshape(picture.height, -1)


def painted(pictures: list[Picture]) -> list[np.ndarray]:
    """Red, green and blue samples (height, width * 3) of each picture. Those with the same tables and components are decoded
    together, at most about BLOCKS blocks at once, so memory doesn't grow with their number but for the samples returned."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(pictures)
    alike: dict[tuple, list[int]] = {}
    for i, p in enumerate(pictures):
        alike.setdefault((p.codes, p.parts), []).append(i)
    for (codes, parts), members in alike.items():
        place = {k: i for i, (k, _, _) in enumerate(codes)}
        lookups = np.stack([_lookup(counts, symbols) for _, counts, symbols in codes])
        layout = [(i, place[0, d], place[1, a]) for i, (h, v, _, d, a) in enumerate(parts) for _ in range(h * v)]
        lo = 0
        while lo < len(members):
            coded, blocks, hi = [], [], lo
            while hi < len(members) and (hi == lo or sum(blocks) < BLOCKS):
                p = pictures[members[hi]]
                units = p.units[0] * p.units[1]
                each = p.interval or units
                held = [min(each, units - k) for k in range(0, units, each)]
                if len(held) != len(p.coded):
                    raise ValueError("restart marks are missing")
                coded, blocks, hi = coded + p.coded, blocks + [n * len(layout) for n in held], hi + 1
            values, at = coefficients(coded, np.array(blocks), layout, lookups), 0
            for i in members[lo:hi]:
                n = pictures[i].units[0] * pictures[i].units[1]
                out[i] = _painted(pictures[i], values[at : at + n * len(layout)].reshape(n, len(layout), 64))
                at += n * len(layout)
            lo = hi
    return out
