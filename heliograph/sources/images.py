"""What an image file says about itself: format, width, height and mode, read from its header.

Only headers of PNG, JPEG, BMP and WebP are read, in Arrow batches; pixels aren't decoded. A file that ends inside its header,
or has none of these, has an error instead.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FACTS = StructType().add("format", "string").add("width", "integer").add("height", "integer").add("mode", "string").add("error", "string")
#: Modes of PNG's color types, and of JPEG's numbers of components.
_PNG, _JPEG = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}, {1: "L", 3: "RGB", 4: "CMYK"}


class Unreadable(ValueError):
    pass


def _at(data: bytes, form: str, offset: int):
    try:
        return struct.unpack_from(form, data, offset)
    except struct.error:
        raise Unreadable("the file ends inside its header") from None


def _png(data: bytes) -> tuple[int, int, str]:
    kind, width, height, depth, color = _at(data, ">4sIIBB", 12)
    if kind != b"IHDR" or color not in _PNG:
        raise Unreadable("no PNG header")
    return width, height, "1" if (color, depth) == (0, 1) else "I;16" if (color, depth) == (0, 16) else _PNG[color]


def _jpeg(data: bytes) -> tuple[int, int, str]:
    at = 2
    while True:
        mark, kind = _at(data, ">BB", at)
        if mark != 0xFF:
            raise Unreadable("no JPEG segment where one must be")
        if kind == 0xFF:  # filling
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame
            height, width, parts = _at(data, ">HHB", at + 5)
            if parts not in _JPEG:
                raise Unreadable(f"a JPEG of {parts} components")
            return width, height, _JPEG[parts]
        elif kind in (0xD9, 0xDA):
            raise Unreadable("a JPEG without a frame")
        else:
            alone = kind == 0x01 or 0xD0 <= kind <= 0xD8
            at += 2 if alone else 2 + _at(data, ">H", at + 2)[0]


def _bmp(data: bytes) -> tuple[int, int, str]:
    (size,) = _at(data, "<I", 14)
    width, height, _, bits = _at(data, "<HHHH", 18) if size == 12 else _at(data, "<iiHH", 18)
    if bits not in (1, 4, 8, 16, 24, 32):
        raise Unreadable(f"a BMP of {bits} bits")
    alpha = bits == 32 and size >= 56 and _at(data, "<I", 66)[0] != 0  # masks with one for alpha
    return width, abs(height), {1: "1", 4: "P", 8: "P"}.get(bits, "RGBA" if alpha else "RGB")


def _webp(data: bytes) -> tuple[int, int, str]:
    (kind,) = _at(data, "4s", 12)
    if kind == b"VP8X":
        flags, a, b, c, d, e, f = _at(data, "<B3x6B", 20)
        return 1 + a + (b << 8) + (c << 16), 1 + d + (e << 8) + (f << 16), "RGBA" if flags & 0x10 else "RGB"
    if kind == b"VP8L":
        sign, bits = _at(data, "<BI", 20)
        if sign != 0x2F:
            raise Unreadable("no WebP header")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "RGBA" if bits >> 28 & 1 else "RGB"
    if kind == b"VP8 ":
        start, width, height = _at(data, "<3sHH", 23)
        if start != b"\x9d\x01\x2a":
            raise Unreadable("no WebP header")
        return width & 0x3FFF, height & 0x3FFF, "RGB"
    raise Unreadable("no WebP header")


_FORMATS = ((b"\x89PNG\r\n\x1a\n", "PNG", _png), (b"\xff\xd8\xff", "JPEG", _jpeg), (b"BM", "BMP", _bmp))


def header(data: bytes | None) -> tuple[str | None, int | None, int | None, str | None, str | None]:
    """(format, width, height, mode, error)."""
    data = data or b""
    found = next(((name, read) for start, name, read in _FORMATS if data.startswith(start)), None)
    if found is None and data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        found = "WEBP", _webp
    if found is None:
        return None, None, None, None, "empty file" if not data else "no image"
    try:
        width, height, mode = found[1](data)
    except Unreadable as e:
        return None, None, None, None, str(e)
    if width <= 0 or height <= 0:
        return None, None, None, None, "an image without pixels"
    return found[0], width, height, mode, None


def facts(content: Column) -> Column:
    """struct(format, width, height, mode, error) of files' contents."""

    @F.pandas_udf(FACTS)
    def read(column: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([header(c) for c in column], columns=FACTS.names, dtype=object)
        return rows.astype({"width": "Int32", "height": "Int32"})

    return read(content)
