"""Motion-JPEG in AVI: writing payloads losslessly, parsing RIFF indexes, decoding intra frames, and finding shots."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm import baseline
from pagelore.llm.common import pieces

#: Bytes of a picture row (64 pixels of three 8-bit samples), rows in a whole frame, frames in a second.
ROW, FRAME_ROWS, RATE = 192, 32, 25
#: Histogram bins of a component; frames on each side that the adaptive threshold looks at; its share of deviation; floor.
BINS, AROUND, DEVIATIONS, LEAST_CHANGE = 16, 4, 1.5, 0.12
#: Pictures of a file that are decoded at once.
PICTURES = 32

#: Code lengths of the difference categories 0 to 8 in the written Huffman table: 4 bits for all but the commonest.
LENGTHS = {0: 3, 5: 3, 6: 3, 1: 4, 2: 4, 3: 4, 4: 4, 7: 4, 8: 4}


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), as the standard derives codes from a table of lengths."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _table() -> tuple[list[int], list[int]]:
    symbols = sorted(LENGTHS, key=lambda s: (LENGTHS[s], s))
    return [sum(v == n for v in LENGTHS.values()) for n in range(1, 17)], symbols


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_COUNTS, _SYMBOLS = _table()
_CODE = _codes(_COUNTS, _SYMBOLS)
#: For every difference -255..255: the bits that say it and how many they are.
_SAID, _SIZE = np.zeros(511, np.uint32), np.zeros(511, np.int64)
for _d in range(-255, 256):
    _category = abs(_d).bit_length()
    _code, _length = _CODE[_category]
    _SAID[_d + 255] = (_code << _category) | (_d if _d > 0 else _d + (1 << _category) - 1)
    _SIZE[_d + 255] = _length + _category


def rows_said(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each picture row (rows, ROW): lossless predictor 1 from 128, restarted at every row."""
    rows = len(samples)
    pixels = samples.reshape(rows, -1, 3).astype(np.int16)
    difference = np.diff(pixels, axis=1, prepend=np.int16(128)).reshape(rows, -1) + 255
    size, said = _SIZE[difference], _SAID[difference]
    end = np.cumsum(size, axis=1)
    width = int(end[:, -1].max(initial=0) + 7) // 8
    # every code's bits fall into at most three bytes
    at = end - size
    shifted = said.astype(np.uint32) << (24 - (at & 7) - size).astype(np.uint32)
    place = (np.arange(rows)[:, None] * (width + 3) + (at >> 3)).ravel()
    out = np.zeros(rows * (width + 3), dtype=np.float64)
    for k in range(3):
        out += np.bincount(place + k, weights=((shifted >> np.uint32(16 - 8 * k)) & np.uint32(255)).ravel(), minlength=len(out))
    packed = out.astype(np.uint8).reshape(rows, width + 3)
    bits = end[:, -1]
    last, spare = (bits - 1) >> 3, (-bits) & 7
    packed[np.arange(rows), last] |= ((1 << spare) - 1).astype(np.uint8)  # filled with ones
    return [packed[i, : last[i] + 1].tobytes().replace(b"\xff", b"\xff\x00") for i in range(rows)]


def frame_said(coded: list[bytes]) -> bytes:
    """A lossless JPEG picture of these coded rows, 64 pixels wide, with a restart after each row."""
    head = b"\xff\xd8" + _segment(0xC4, bytes([0, *_COUNTS, *_SYMBOLS]))
    head += _segment(0xC3, struct.pack(">BHHB", 8, len(coded), ROW // 3, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += _segment(0xDD, struct.pack(">H", ROW // 3)) + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 1, 0, 0]))
    body = b"".join(row + bytes([0xFF, 0xD0 + i % 8]) for i, row in enumerate(coded[:-1]))
    return head + body + coded[-1] + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def movie_said(frames: list[bytes], rate: int = RATE, height: int = FRAME_ROWS, width: int = ROW // 3) -> bytes:
    """An AVI file of these pictures: header list, movie list, and the index of its chunks. ``height`` is the tallest one's."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 3 * width * height, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    at, index, body = 4, [], []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def movie_read(data: bytes) -> tuple[float, list[bytes]]:
    """(microseconds a frame, pictures in the order of the index); ValueError if it isn't an AVI file with an index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micro, movie, index, at, end = 0, None, None, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            head = data.find(b"avih", at, at + 8 + size)
            micro = struct.unpack_from("<I", data, head + 8)[0] if head >= 0 else 0
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + (size & 1)
    if movie is None or index is None:
        raise ValueError("no movie or no index")
    frames = []
    for i in range(index[1] // 16):
        name, _, where, size = struct.unpack_from("<4sIII", data, index[0] + 16 * i)
        if name[2:4] in (b"dc", b"db"):
            start = movie + where if data[movie + where : movie + where + 4] == name else where  # from the list or the file
            frames.append(data[start + 8 : start + 8 + size])
    return float(micro), frames


def picture_parts(data: bytes) -> tuple[int, int, int, dict, list[bytes]]:
    """(height, width, components, Huffman table, coded bytes of each restart interval) of a lossless JPEG picture."""
    at, height, width, parts, tables, intervals = 2, 0, 0, 0, {}, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    while at + 4 <= len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = (tuple(counts), tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit samples")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only lossless pictures")
        elif marker == 0xDD:
            intervals = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if intervals != width or body[1 + 2 * body[0]] != 1:
                raise ValueError("only predictor 1 with a restart after each row")
            scan = data[at + 2 + size : data.rindex(b"\xff\xd9")]
            rows, start, where = [], 0, scan.find(b"\xff")
            while where >= 0:
                if 0xD0 <= scan[where + 1] <= 0xD7:
                    rows.append(scan[start:where])
                    start = where + 2
                where = scan.find(b"\xff", where + 2)
            return height, width, parts, tables[body[2] >> 4], [r.replace(b"\xff\x00", b"\xff") for r in [*rows, scan[start:]]]
        at += 2 + size
    raise ValueError("no scan")


_lookups: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Code length and category for every 16 bits that follow."""
    if table not in _lookups:
        length, category = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for symbol, (code, n) in _codes(list(table[0]), list(table[1])).items():
            length[code << 16 - n : code + 1 << 16 - n], category[code << 16 - n : code + 1 << 16 - n] = n, symbol
        _lookups[table] = length, category
    return _lookups[table]


def rows_read(coded: list[bytes], samples: int, table: tuple, components: int = 3) -> np.ndarray:
    """Samples (rows, samples) of coded rows of one Huffman table: all rows advance one symbol at a time together."""
    length, category = _lookup(table)
    size = np.array([len(r) + 8 for r in coded], dtype=np.int64)
    data = np.frombuffer(b"".join(r + b"\0" * 8 for r in coded), np.uint8).astype(np.uint64)
    word = np.zeros(len(data) - 4, dtype=np.uint64)
    for k in range(5):
        word |= data[k : len(data) - 4 + k] << np.uint64(32 - 8 * k)
    word = word.astype(np.int64)
    at = (np.cumsum(size) - size) * 8
    out = np.zeros((samples, len(coded)), dtype=np.int64)
    for t in range(samples):
        held = word[at >> 3]
        left = 40 - (at & 7)
        code = (held >> (left - 16)) & 0xFFFF
        n, c = length[code], category[code]
        extra = (held >> (left - n - c)) & ((1 << c) - 1)
        out[t] = np.where((c > 0) & (extra < (1 << c) >> 1), extra - (1 << c) + 1, extra)
        at += n + c
    pixels = out.reshape(samples // components, components, len(coded)).cumsum(axis=0) + 128
    return (pixels.reshape(samples, len(coded)).T & 255).astype(np.uint8)


def histograms(frame: np.ndarray) -> np.ndarray:
    """Shares of each component's bins in a picture (rows, samples)."""
    bins = (frame.reshape(-1, 3) >> 4) + np.arange(3, dtype=np.uint8) * BINS
    return np.bincount(bins.ravel(), minlength=3 * BINS) / max(1, len(bins))


def shots_of(h: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot, by the frames' histograms: a cut is where the difference to the frame
    before is the greatest near it and above mean plus DEVIATIONS deviations of those near it, and above LEAST_CHANGE."""
    if not len(h):
        return []
    change = np.abs(np.diff(h, axis=0)).sum(axis=1) / 6
    cuts = [0]
    for i, d in enumerate(change):
        near = change[max(0, i - AROUND) : i + AROUND + 1]
        if d >= LEAST_CHANGE and d >= near.max() and d >= near.mean() + DEVIATIONS * near.std() and (len(near) > 1 or d >= 2 * LEAST_CHANGE):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(h)], strict=True))


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    return shots_of(np.array([histograms(f) for f in frames]))


def lossless(data: bytes) -> bool:
    """Whether a picture is of the lossless process, by the first frame header that it has."""
    at = 2
    while at + 4 <= len(data) and not 0xC0 <= data[at + 1] <= 0xC3:
        if data[at + 1] == 0xDA:
            return False
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return at + 4 <= len(data) and data[at + 1] == 0xC3


def pictures_read(frames: list[bytes]) -> list[np.ndarray]:
    """Pictures as (rows, samples), lossless or baseline; rows of all lossless ones with one table are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(frames)
    exact = {i: picture_parts(f) for i, f in enumerate(frames) if lossless(f)}
    for kind in {(p[1], p[2], p[3]) for p in exact.values()}:
        which = [i for i, p in exact.items() if (p[1], p[2], p[3]) == kind]
        rows = rows_read([r for i in which for r in exact[i][4]], kind[0] * kind[1], kind[2], kind[1])
        at = 0
        for i in which:
            out[i] = rows[at : at + exact[i][0]]
            at += exact[i][0]
    others = [i for i in range(len(frames)) if i not in exact]
    for i, picture in zip(others, baseline.painted([baseline.parsed(frames[i]) for i in others]), strict=True):
        out[i] = picture
    return out


def decoded(movie: bytes) -> tuple[float, list[np.ndarray]]:
    """(microseconds a frame, pictures as (rows, samples))."""
    micro, frames = movie_read(movie)
    return micro, pictures_read(frames)


def described(movie: bytes) -> tuple[float, np.ndarray]:
    """(microseconds a frame, a histogram a frame). PICTURES pictures are decoded at once and only their histograms stay, so
    a long film takes no more memory than its file; an empty chunk shows the picture before once more."""
    micro, frames = movie_read(movie)
    out: list[np.ndarray] = []
    for lo in range(0, len(frames), PICTURES):
        some = frames[lo : lo + PICTURES]
        shown = iter(pictures_read([f for f in some if f]))
        for f in some:
            if not f and not out:
                raise ValueError("the first frame is empty")
            out.append(histograms(next(shown)) if f else out[-1])
    return micro, np.array(out)


def clips(media: DataFrame, column: str = "content") -> DataFrame:
    """(id, clip, first_frame, n_frames, start_s, end_s, error) of the shots of each AVI file in ``media`` (id, column).

    Pictures are lossless (predictor 1, a restart a row) or baseline JPEG with their tables. A null or unreadable file is one
    row with the reason in ``error`` and nulls else; a film without frames has no row. Equal ids are separate files, other
    columns are left out, an empty table gives an empty one. A task holds one file and PICTURES of its pictures.
    """
    names = ("id", "clip", "first_frame", "n_frames", "start_s", "end_s", "error")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if not data.is_valid:
                        raise ValueError("no content")
                    micro, seen = described(data.as_py())
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    rows.append((name, None, None, None, None, None, str(e) or type(e).__name__))
                    continue
                rows += [(name, k, a, b - a, a * micro / 1e6, b * micro / 1e6, None) for k, (a, b) in enumerate(shots_of(seen))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(names))

    return media.select(F.col("id").cast("long").alias("id"), F.col(f"`{column}`").alias("content")).mapInArrow(run, "id long, clip long, first_frame long, n_frames long, start_s double, end_s double, error string")


def _movies(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The AVI file of each text: its bytes, filled up with spaces to whole rows (one at least)."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // ROW))
    first = np.r_[0, np.cumsum(count)]
    samples = np.full(first[-1] * ROW, 32, dtype=np.uint8)
    samples[np.arange(len(data)) + np.repeat(first[:-1] * ROW - offsets[:-1], size)] = data
    coded = rows_said(samples.reshape(-1, ROW))
    return [movie_said([frame_said(coded[k : min(k + FRAME_ROWS, first[i + 1])]) for k in range(first[i], first[i + 1], FRAME_ROWS)], height=min(FRAME_ROWS, int(count[i]))) for i in range(len(size))]


def _all_decoded(movies: list[bytes]) -> list[list[np.ndarray]]:
    """Pictures of files that ``_movies`` made, decoded in lockstep over all of them."""
    parts = [[picture_parts(f) for f in movie_read(m)[1]] for m in movies]
    rows = rows_read([r for m in parts for p in m for r in p[4]], ROW, parts[0][0][3])
    at, out = 0, []
    for m in parts:
        out.append([])
        for p in m:
            out[-1].append(rows[at : at + p[0]])
            at += p[0]
    return out


def _timed(cuts: list[tuple[int, int]]) -> str:
    return json.dumps([{"clip": k, "first_frame": a, "n_frames": b - a, "start_s": a / RATE, "end_s": b / RATE} for k, (a, b) in enumerate(cuts)])


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips) of each row.

    Every text becomes an AVI file of lossless pictures whose samples are its bytes, is read back from it, and its shots
    are described: ``clips`` is JSON, a list of its timed clips. Null and empty texts are one row of spaces. Equal texts have
    equal values; long ones are films of as many pictures as they need, other columns are left out.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in pieces(batch.column("text"), 1 << 20):
                movies = _movies(data, offsets)
                rows = []
                for movie, frames in zip(movies, _all_decoded(movies), strict=True):
                    payload = b"".join(f.tobytes() for f in frames)
                    cuts = shots(frames)
                    mean = np.frombuffer(payload, np.uint8).mean()
                    said = f"frames={len(frames)};shots={len(cuts)};cuts={','.join(str(a) for a, _ in cuts[1:])};seconds={len(frames) / RATE:.2f};mean={mean:.3f}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(movie), hashlib.sha256(movie).hexdigest(), said, _timed(cuts)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(offsets)), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string"
    )


def op5_media(docs: DataFrame) -> DataFrame:
    """Every text as a film, read back, with its features and timed clips; see ``stored``."""
    return stored(docs)
