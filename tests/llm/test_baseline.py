import math
import struct

import numpy as np
import pytest

from pagelore.llm import baseline, media

DC = list(range(12))
AC = [r * 16 + c for r in range(16) for c in range(1, 11)] + [0x00, 0xF0]


def zigzag():
    """The order of the file, walked step by step."""
    r = c = 0
    for _ in range(64):
        yield r * 8 + c
        if (r + c) % 2 == 0:
            r, c = (r + 1, c) if c == 7 else (r, c + 1) if r == 0 else (r - 1, c + 1)
        else:
            r, c = (r, c + 1) if r == 7 else (r + 1, c) if c == 0 else (r + 1, c - 1)


ORDER = list(zigzag())
BASIS = np.array([[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


def said(value):
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def block_bits(values, before):
    size, extra = said(values[0] - before)
    bits, run = format(DC.index(size), "04b") + extra, 0
    last = max((k for k in range(1, 64) if values[k]), default=0)
    for k in range(1, last + 1):
        if not values[k]:
            run += 1
            continue
        while run > 15:
            bits, run = bits + format(AC.index(0xF0), "08b"), run - 16
        size, extra = said(values[k])
        bits, run = bits + format(AC.index(run * 16 + size), "08b") + extra, 0
    return bits + (format(AC.index(0), "08b") if last < 63 else "")


def picture(rgb, factors=((1, 1), (1, 1), (1, 1)), step=1, interval=0):
    """A plain encoder of baseline pictures, gray where ``rgb`` has two dimensions, and the samples that it must give back."""
    height, width = rgb.shape[:2]
    if rgb.ndim == 2:
        planes, factors = [rgb.astype(float)], ((1, 1),)
    else:
        r, g, b = (rgb[..., i].astype(float) for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    hm, vm = max(f[0] for f in factors), max(f[1] for f in factors)
    down, across = -(-height // (8 * vm)), -(-width // (8 * hm))
    small = [np.pad(p[:: vm // v, :: hm // h], ((0, 64), (0, 64)), mode="edge") for p, (h, v) in zip(planes, factors, strict=True)]
    before, parts, bits = [0] * len(planes), [], ""
    for unit in range(down * across):
        if interval and unit and unit % interval == 0:
            parts, bits, before = [*parts, bits], "", [0] * len(planes)
        for i, (h, v) in enumerate(factors):
            for dv in range(v):
                for dh in range(h):
                    top, left = ((unit // across) * v + dv) * 8, ((unit % across) * h + dh) * 8
                    square = np.rint(BASIS @ (small[i][top : top + 8, left : left + 8] - 128) @ BASIS.T / step).astype(int).ravel()
                    values = [int(square[p]) for p in ORDER]
                    bits += block_bits(values, before[i])
                    before[i] = values[0]
    scan = b""
    for k, b in enumerate([*parts, bits]):
        b += "1" * (-len(b) % 8)
        scan += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + int(b, 2).to_bytes(len(b) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [step] * 64))
    out += seg(0xC4, bytes([0, 0, 0, 0, len(DC), *[0] * 12, *DC])) + seg(0xC4, bytes([0x10, *[0] * 7, len(AC), *[0] * 8, *AC]))
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h * 16 + v, 0]) for i, (h, v) in enumerate(factors)))
    out += (seg(0xDD, struct.pack(">H", interval)) if interval else b"") + seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    return out + scan + b"\xff\xd9"


def scene(height, width, shift=0):
    y, x = np.mgrid[:height, :width]
    return np.stack([120 + 80 * np.sin(x / 9 + shift), 120 + 70 * np.cos(y / 7), 100 + 60 * np.sin((x + y) / 11)], axis=2).astype(np.uint8)


def shown(rgb, h, v):
    """What a picture without any loss but that of colour at every ``h``-th and ``v``-th place shows."""
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb, cr = ((c - y)[::v, ::h].repeat(v, 0).repeat(h, 1)[: y.shape[0], : y.shape[1]] for c in (b, r))
    red, blue = y + cr, y + cb
    return np.clip(np.stack([red, (y - 0.299 * red - 0.114 * blue) / 0.587, blue], axis=2), 0, 255)


@pytest.mark.parametrize("factors", [((1, 1),) * 3, ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))])
@pytest.mark.parametrize("interval", [0, 3])
def test_pictures_of_any_size(factors, interval):
    for height, width in ((40, 56), (17, 33), (8, 8), (1, 1)):
        held = scene(height, width)
        (got,) = baseline.painted([baseline.parsed(picture(held, factors, 1, interval))])
        assert got.shape == (height, width * 3)
        assert np.abs(got.reshape(held.shape) - shown(held, *factors[0])).max() <= 4


def test_sharp_edges_grays_and_pictures_decoded_together():
    rng = np.random.default_rng(3)
    noisy, gray = rng.integers(0, 256, (24, 40, 3), dtype=np.uint8), rng.integers(0, 256, (19, 21), dtype=np.uint8)
    many = [picture(noisy), picture(gray), picture(scene(30, 30), interval=2), picture(noisy, interval=5), picture(gray, interval=1)]
    got = baseline.painted([baseline.parsed(p) for p in many])
    assert np.abs(got[0].reshape(noisy.shape).astype(int) - noisy).max() <= 4 and (got[0] == got[3]).all()
    assert np.abs(got[1].reshape(19, 21, 3).astype(int) - gray[..., None]).max() <= 2 and (got[1] == got[4]).all()
    alone = [baseline.painted([baseline.parsed(p)])[0] for p in many]
    assert all((a == b).all() for a, b in zip(got, alone, strict=True))


def test_broken_pictures_are_told():
    whole = picture(scene(32, 32), interval=3)
    for bad in (b"", b"\xff\xd8", whole[: len(whole) // 2], whole.replace(b"\xff\xc0", b"\xff\xc2"), whole.replace(b"\xff\xd0", b"")):
        with pytest.raises((ValueError, struct.error, IndexError, KeyError)):
            baseline.painted([baseline.parsed(bad)])


def test_clips_of_baseline_films_and_error_rows(spark):
    dark = [picture(scene(24, 32, i / 9) // 4, ((2, 2), (1, 1), (1, 1)), 4, 2) for i in range(5)]
    bright = [picture(255 - scene(24, 32, i / 9) // 4, ((2, 2), (1, 1), (1, 1)), 4, 2) for i in range(6)]
    film = media.movie_said([*dark, b"", *bright], 10, 24, 32)
    rows = [(1, film), (2, b"junk"), (3, None), (4, film[: len(film) // 2]), (5, media.movie_said([whole for whole in dark[:1]])), (6, media.movie_said([dark[0][:60]]))]
    got = media.clips(spark.createDataFrame(rows, "id long, content binary")).orderBy("id", "clip").collect()
    fine = [(r.id, r.first_frame, r.n_frames, r.start_s, r.end_s) for r in got if r.error is None]
    assert fine == [(1, 0, 6, 0.0, 0.6), (1, 6, 6, 0.6, 1.2), (5, 0, 1, 0.0, 0.04)]
    assert [r.id for r in got if r.error] == [2, 3, 4, 6] and all(r.clip is None for r in got if r.error)
    assert media.clips(spark.createDataFrame([], "id long, content binary")).count() == 0
