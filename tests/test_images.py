"""Headers of image files, manifests that hold what they say, and what encoders cost."""

import struct

import pytest
from pyspark.sql import functions as F

from heliograph.plans import evaluation
from heliograph.sources import images, readers


def png(width=3, height=2, depth=8, color=2):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", width, height, depth, color) + b"\0\0\0"


def jpeg(width=640, height=480, parts=3, frame=0xC0, before=b"\xff\xe0\x00\x06abcd\xff\xff\xc4\x00\x03x"):
    return b"\xff\xd8" + before + struct.pack(">BBHBHHB", 0xFF, frame, 8 + 3 * parts, 8, height, width, parts)


def bmp(width=5, height=-7, bits=24, size=40, alpha=0):
    return b"BM" + b"\0" * 12 + struct.pack("<IiiHH", size, width, height, 1, bits) + b"\0" * 36 + struct.pack("<I", alpha)


def webp(kind, body):
    return b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + body


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (png(), ("PNG", 3, 2, "RGB", None)),
        (png(color=6), ("PNG", 3, 2, "RGBA", None)),
        (png(color=0, depth=1), ("PNG", 3, 2, "1", None)),
        (png(color=0, depth=16), ("PNG", 3, 2, "I;16", None)),
        (jpeg(), ("JPEG", 640, 480, "RGB", None)),
        (jpeg(parts=1, frame=0xC2), ("JPEG", 640, 480, "L", None)),
        (jpeg(parts=4, before=b""), ("JPEG", 640, 480, "CMYK", None)),
        (bmp(), ("BMP", 5, 7, "RGB", None)),
        (bmp(bits=8), ("BMP", 5, 7, "P", None)),
        (bmp(bits=32, size=108, alpha=0xFF000000), ("BMP", 5, 7, "RGBA", None)),
        (b"BM" + b"\0" * 12 + struct.pack("<IHHHH", 12, 9, 8, 1, 1), ("BMP", 9, 8, "1", None)),
        (webp(b"VP8X", bytes([0x10, 0, 0, 0, 0x0F, 1, 0, 0x1F, 0, 0])), ("WEBP", 272, 32, "RGBA", None)),
        (webp(b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14)), ("WEBP", 100, 50, "RGB", None)),
        (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30, 20)), ("WEBP", 30, 20, "RGB", None)),
    ],
)
def test_headers(data, want):
    assert images.header(data) == want
    for cut in range(len(data) - (3 if want[0] == "PNG" else 40 if want[0] == "BMP" and len(data) > 30 else 0)):  # shorter ones have an error
        assert images.header(data[:cut])[4] is not None, cut


@pytest.mark.parametrize(
    ("data", "error"),
    [(None, "empty file"), (b"", "empty file"), (b"GIF89a", "no image"), (png(color=5), "no PNG header"), (png(width=0), "an image without pixels"), (jpeg(parts=2), "a JPEG of 2 components"), (b"\xff\xd8\xff\xd9", "a JPEG without a frame"), (b"\xff\xd8\xff\xe0\x00\x02xx", "no JPEG segment where one must be"), (bmp(bits=7), "a BMP of 7 bits"), (webp(b"ABCD", b""), "no WebP header")],
)
def test_files_that_are_no_images(data, error):
    assert images.header(data) == (None, None, None, None, error)


def test_manifests_hold_sizes_and_modes(spark, tmp_path):
    for name, data in {"1.jpg": jpeg(), "2.jpg": b"not one", "3.jpg": jpeg(width=8)}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "4.png").write_bytes(png())
    got = {r.relative_path: (r.width, r.height, r.mode, r.valid, r.error) for r in readers.scan_directory(spark, str(tmp_path), measured=True).collect()}
    assert got == {"1.jpg": (640, 480, "RGB", True, None), "2.jpg": (None, None, None, False, "no image"), "3.jpg": (8, 480, "RGB", True, None), "4.png": (3, 2, "RGB", True, None)}
    got = {r.item_id: (r.width, r.valid) for r in readers.scan_split(spark, str(tmp_path), "Val", measured=True).collect()}
    assert got == {"val-1": (640, True), "val-2": (None, False), "val-3": (8, True)}


def test_what_encoders_cost(spark, tmp_path):
    items = spark.range(40).select(F.col("id").alias("item_id"))
    queries = spark.createDataFrame([(1, 3), (2, 5)], "query_id long, at long")
    turn = lambda d: lambda df: df.select(df.columns[0], F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.cos(i * F.col(df.columns[-1]) + 0.1)).alias("vector"))
    ticks = iter(range(100))
    told = evaluation.encoder_costs(items, queries, {"small": (turn(4), turn(4)), "wide": (turn(16), turn(16))}, str(tmp_path), batch={"wide": 8}, clock=lambda: next(ticks))
    small, wide = told["encoders"]
    assert (small["dimension"], wide["dimension"], small["batch_size"], wide["batch_size"]) == (4, 16, None, 8)
    assert (small["build_seconds"], small["items_per_second"], small["mean_warm_query_seconds"]) == (1, 40, 0.5)
    assert 0 < small["index_bytes"] < wide["index_bytes"] and told["items"] == 40
    assert told["quality_claim_allowed"] is False and told["has_relevance_judgments"] is False
    best = {(r.encoder, r.query_id): r.item_id for r in told["top"].filter("rank = 1").collect()}
    assert best[("wide", 1)] == 3 and best[("wide", 2)] == 5
    half = lambda df: turn(4)(df.filter("item_id < 20")) if "item_id" in df.columns else turn(4)(df)
    with pytest.raises(ValueError, match="same items"):
        evaluation.encoder_costs(items, queries, {"a": (turn(4), turn(4)), "half": (half, turn(4))}, f"{tmp_path}/b")
    with pytest.raises(ValueError, match="needed"):
        evaluation.encoder_costs(items, queries, {}, str(tmp_path))
