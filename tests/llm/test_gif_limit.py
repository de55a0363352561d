"""The limit of a canvas is the caller's."""

import pytest

from codequarry.llm import gif


def test_canvas_limit(spark):
    media = gif.payload_gif(bytes(64 * 10))
    rows = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(media[:40]))], "k int, media binary")
    for most, n in ((None, 1), (640, 1), (639, 0)):
        assert gif.gif_frames(rows, "k", most=most).count() == n
    with pytest.raises(ValueError):
        gif.read_gif(media, most=639)
    assert len(list(gif.composed(media, most=None))) == 1
