import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.llm import media
from tests.llm.fixtures import frame, odd_rows, row


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=4))
def test_round_trip_of_any_bytes(texts):
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    movies = media._movies(data, offsets)
    for text, movie in zip(texts, movies, strict=True):
        micro, frames = media.decoded(movie)
        assert micro == 40_000
        assert b"".join(f.tobytes() for f in frames) == text + b" " * (-len(text) % 192 if text else 192)


def test_query_of_odd_rows(spark):
    rows = odd_rows() + [row(90, "\x00ÿ" * 5000)]
    got = {(r.doc_id, r.n_bytes): r for r in media.op5_media(frame(spark, rows, ("feature",))).collect()}
    for d, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[d, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        # the stored form, the features and the clips, from one text at a time
        (movie,) = media._movies(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert (r.media_bytes, r.media_sha256) == (len(movie), hashlib.sha256(movie).hexdigest())
        n = -(-len(payload) // (192 * 32))
        timed = json.loads(r.clips)
        assert r.feature.startswith(f"frames={n};shots={len(timed)};") and r.feature.endswith(f"seconds={n / 25:.2f};mean={sum(payload) / len(payload):.3f}")
        assert [c["first_frame"] for c in timed] == [0] + [c["first_frame"] + c["n_frames"] for c in timed[:-1]] and sum(c["n_frames"] for c in timed) == n
    assert media.op5_media(frame(spark, [])).count() == 0


def test_shots_of_planted_scenes(spark):
    dark, bright = np.full((8, 192), 20, np.uint8), np.full((8, 192), 220, np.uint8)
    frames = [dark] * 6 + [bright] * 5 + [dark] * 4
    movie = media.movie_said([media.frame_said(media.rows_said(f)) for f in frames])
    found = media.clips(spark.createDataFrame([(1, movie), (2, b"junk"), (3, None)], "id long, content binary")).orderBy("clip").where("error is null").collect()
    assert [(r.id, r.first_frame, r.n_frames, r.start_s, r.end_s) for r in found] == [(1, 0, 6, 0.0, 0.24), (1, 6, 5, 0.24, 0.44), (1, 11, 4, 0.44, 0.6)]
    assert pa.array([movie]).nbytes < 15 * 8 * 192
