"""GeoTIFF files: one band of uncompressed or deflated strips or tiles, with its place and its coordinate system.

Fixed values: the tags, types and keys of the published TIFF and GeoTIFF formats.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_WIDTH, _HEIGHT, _BITS, _PACKING, _STRIPS, _BANDS, _STRIP_ROWS, _STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
_PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT = 317, 322, 323, 324, 325, 339
_SCALE, _TIE, _KEYS, _NODATA = 33550, 33922, 34735, 42113
_GEOGRAPHIC, _PROJECTED = 2048, 3072
_SAMPLES = {1: "u", 2: "i", 3: "f"}


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """The byte order, and the values of the first directory's tags."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (count,) = struct.unpack_from(order + "H", data, at)
    out = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in _TYPES:
            size = n * struct.calcsize(_TYPES[kind])
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            out[tag] = struct.unpack_from(f"{order}{n}{_TYPES[kind]}", data, place)
    return order, out


def epsg_of_keys(keys: tuple) -> int | None:
    """The EPSG code of a GeoKey directory: the projected system, else the geographic one; user-defined ones have none."""
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = found.get(_PROJECTED, found.get(_GEOGRAPHIC))
    return code if code not in (None, 0, 32767) else None


def epsg(data: bytes) -> int | None:
    return epsg_of_keys(tags(data)[1].get(_KEYS, ()))


def las_epsg(data: bytes) -> int | None:
    """The EPSG code of a LAS file's GeoKey record."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    (at,) = struct.unpack_from("<H", data, 94)
    (records,) = struct.unpack_from("<I", data, 100)
    for _ in range(records):
        user, number, size = struct.unpack_from("<16sHH", data, at + 2)
        if user.rstrip(b"\0") == b"LASF_Projection" and number == _KEYS:
            return epsg_of_keys(struct.unpack_from(f"<{size // 2}H", data, at + 54))
        at += 54 + size
    return None


def transform(data: bytes) -> tuple[float, float, float, float] | None:
    """West, north and the sizes of a cell, for a raster with a tie point and a scale; else None."""
    found = tags(data)[1]
    if _SCALE not in found or _TIE not in found:
        return None
    (sx, sy), (col, row, _, x, y, _) = found[_SCALE][:2], found[_TIE][:6]
    return x - col * sx, y + row * sy, sx, sy


def read(data: bytes) -> np.ndarray:
    """The first band as numbers, missing values as nan."""
    order, t = tags(data)
    one = lambda tag, default: t.get(tag, (default,))[0]
    width, height, bands = one(_WIDTH, 0), one(_HEIGHT, 0), one(_BANDS, 1)
    packing, predictor = one(_PACKING, 1), one(_PREDICTOR, 1)
    if packing not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"TIFF compression {packing} with predictor {predictor} is not read")
    kind = np.dtype(f"{order}{_SAMPLES[one(_FORMAT, 1)]}{one(_BITS, 8) // 8}")
    tiled = _TILES in t
    wide, high = (one(_TILE_WIDTH, width), one(_TILE_HEIGHT, height)) if tiled else (width, min(one(_STRIP_ROWS, height), height))
    out = np.full((height, width), np.nan)
    across = -(-width // wide)
    for k, (at, size) in enumerate(zip(t[_TILES if tiled else _STRIPS], t[_TILE_BYTES if tiled else _STRIP_BYTES])):
        raw = data[at : at + size]
        raw = raw if packing == 1 else zlib.decompress(raw)
        row, col = k // across * high, k % across * wide
        block = np.frombuffer(raw, kind, len(raw) // kind.itemsize)
        block = block[: len(block) // (wide * bands) * wide * bands].reshape(-1, wide, bands)
        block = np.cumsum(block, axis=1, dtype=kind) if predictor == 2 else block
        part = block[: height - row, : width - col, 0].astype(float)
        out[row : row + part.shape[0], col : col + part.shape[1]] = part
    text = b"".join(t.get(_NODATA, ())).strip(b"\0 ")
    return np.where(out == float(text), np.nan, out) if text else out


def write(v: np.ndarray, west: float, north: float, size: float, code: int, missing: float = -9999.0) -> bytes:
    """A deflated GeoTIFF of 32-bit floats in one strip, in the projected or geographic system of an EPSG code."""
    body = zlib.compress(np.where(np.isnan(v), missing, v).astype("<f4").tobytes())
    key = _GEOGRAPHIC if 4000 <= code < 5000 else _PROJECTED
    entries = [
        (_WIDTH, "I", (v.shape[1],)), (_HEIGHT, "I", (v.shape[0],)), (_BITS, "H", (32,)), (_PACKING, "H", (8,)), (_STRIPS, "I", (8,)), (_BANDS, "H", (1,)), (_STRIP_ROWS, "I", (v.shape[0],)), (_STRIP_BYTES, "I", (len(body),)),
        (_FORMAT, "H", (3,)), (_SCALE, "d", (size, size, 0.0)), (_TIE, "d", (0.0, 0.0, 0.0, west, north, 0.0)), (_KEYS, "H", (1, 1, 0, 1, key, 0, 1, code)), (_NODATA, "c", tuple(bytes([c]) for c in f"{missing:g}\0".encode())),
    ]
    kinds = {v: k for k, v in _TYPES.items()}
    start = 8 + len(body) + len(body) % 2
    extra, table = b"", struct.pack("<H", len(entries))
    after = start + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        raw = struct.pack(f"<{len(values)}{kind}", *values)
        if len(raw) > 4:
            place, extra = struct.pack("<I", after + len(extra)), extra + raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, kinds[kind], len(values)) + place
    return b"II*\0" + struct.pack("<I", start) + body + b"\0" * (len(body) % 2) + table + b"\0\0\0\0" + extra
