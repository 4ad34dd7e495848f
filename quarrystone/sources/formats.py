"""Encoders and decoders of single files' bytes, by numpy. Each is a small function over one file; Spark deals out files.

Compressed codecs (LAZ, Draco, meshopt, SPZ, KTX2, JPEG 2000) and E57 and FBX are not read.
"""

from __future__ import annotations

import json
import struct

import numpy as np

# The layouts of published file formats (LAS, PLY, SRTM, DTED, GLB, PNTS, quantized mesh).
_LAS_HEADER = 227
_LAS_POINT = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")])


def las_scale(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Scale so that a file's extent, at least 1, fills two thousand million steps."""
    return np.maximum(high - low, 1.0) / 2e9


def write_las(xyz: np.ndarray, intensity: np.ndarray, cls: np.ndarray, rgb: np.ndarray) -> bytes:
    """LAS 1.2, point format 2; the offset is the least corner."""
    low, high = xyz.min(0), xyz.max(0)
    scale = las_scale(low, high)
    points = np.zeros(len(xyz), _LAS_POINT)
    for k, a in enumerate("xyz"):
        points[a] = np.round((xyz[:, k] - low[k]) / scale[k])
    points["intensity"], points["cls"] = intensity, cls
    for k, a in enumerate("rgb"):
        points[a] = rgb[:, k].astype("<u2") << 8
    head = b"LASF" + struct.pack("<HH16sBB32s32sHHHIIBHI5I", 0, 0, b"", 1, 2, b"", b"quarrystone", 1, 2024, _LAS_HEADER, _LAS_HEADER, 0, 2, _LAS_POINT.itemsize, len(xyz), len(xyz), 0, 0, 0, 0)
    box = [v for k in range(3) for v in (high[k], low[k])]
    return head + struct.pack("<12d", *scale, *low, *box) + points.tobytes()


def read_las(data: bytes) -> dict[str, np.ndarray]:
    """Uncompressed LAS 1.0 to 1.4, point formats 0 to 3 and 6 to 8; colours are cut to 8 bits."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset = struct.unpack_from("<I", data, 96)[0]
    form, size, count = struct.unpack_from("<BHI", data, 104)
    if form & 0x80:
        raise ValueError("compressed LAS is not read")
    if data[25] >= 4 and not count:
        count = struct.unpack_from("<Q", data, 247)[0]
    scale, low = np.frombuffer(data, "<f8", 3, 131), np.frombuffer(data, "<f8", 3, 155)
    count = min(count, (len(data) - offset) // size)
    raw = np.frombuffer(data, np.uint8, count * size, offset).reshape(count, size)
    take = lambda at, kind: np.ascontiguousarray(raw[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
    out = {a: take(4 * k, "<i4") * scale[k] + low[k] for k, a in enumerate("xyz")}
    out |= {"intensity": take(12, "<u2").astype(np.int32), "cls": (take(16, "u1") if form >= 6 else take(15, "u1") & 31).astype(np.int32)}
    colour = {2: 20, 3: 28, 7: 30, 8: 30}.get(form)
    for k, a in enumerate("rgb"):
        out[a] = (take(colour + 2 * k, "<u2") >> 8).astype(np.int32) if colour else np.zeros(count, np.int32)
    return out


_PLY = {"char": "i1", "uchar": "u1", "int8": "i1", "uint8": "u1", "short": "i2", "ushort": "u2", "int16": "i2", "uint16": "u2", "int": "i4", "uint": "u4", "int32": "i4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_ply(data: bytes) -> np.ndarray:
    """The vertices of an ASCII or binary PLY as a structured array of all their scalar properties."""
    end = data.index(b"end_header\n") + 11
    lines = data[:end].decode("ascii", "replace").split("\n")
    if lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    form = next(x.split()[1] for x in lines if x.startswith("format"))
    count, fields, on = 0, [], False
    for x in map(str.split, lines):
        if x[:1] == ["element"]:
            if fields and not on:
                break
            on = x[1] == "vertex"
            count = int(x[2]) if on else count
        elif x[:1] == ["property"] and on:
            if x[1] == "list":
                raise ValueError("a vertex with a list is not read")
            fields.append((x[2], _PLY[x[1]]))
    if form == "ascii":
        rows = data[end:].split(b"\n")[:count]
        return np.array([tuple(float(v) for v in r.split()[: len(fields)]) for r in rows], [(n, "f8") for n, _ in fields])
    order = "<" if form == "binary_little_endian" else ">"
    return np.frombuffer(data, np.dtype([(n, order + t) for n, t in fields]), count, end)


def write_ply(columns: dict[str, np.ndarray]) -> bytes:
    head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(next(iter(columns.values())))}", *(f"property double {n}" for n in columns), "end_header\n"])
    return head.encode() + np.column_stack(list(columns.values())).astype("<f8").tobytes()


# The vertex properties that the training of Gaussian splats writes.
SPLAT = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
#: Higher coefficients of a splat of degree 0 to 3.
_REST = (0, 9, 24, 45)


def is_splat_ply(data: bytes) -> bool:
    """Whether a PLY's vertices have a property of Gaussian splats."""
    lines = data[: data.find(b"end_header")].decode("ascii", "replace").split("\n")
    names = [x.split()[-1] for x in lines if x.startswith("property")]
    return any(n in SPLAT[3:] or n.startswith("f_rest_") for n in names)


def read_splats(data: bytes) -> np.ndarray:
    """The splats of a binary little-endian PLY, values as stored: columns of SPLAT, then the higher coefficients in order.

    Other formats, missing or non-float properties, another number of coefficients and values that aren't finite raise.
    """
    if b"format binary_little_endian" not in data[: data.find(b"end_header")]:
        raise ValueError("splats are read from binary_little_endian PLY")
    v = read_ply(data)
    rest = sum(n.startswith("f_rest_") for n in v.dtype.names)
    names = SPLAT + [f"f_rest_{k}" for k in range(rest)]
    bad = [n for n in names if n not in v.dtype.names or v.dtype[n] != np.dtype("<f4")]
    if bad or rest not in _REST:
        raise ValueError(f"not the properties of splats: {', '.join(bad) or rest}")
    out = np.column_stack([v[n].astype(float) for n in names])
    if not np.isfinite(out).all():
        raise ValueError(f"splat {int(np.argmin(np.isfinite(out).all(1)))} has a value that is not finite")
    return out


def write_splats(values: np.ndarray) -> bytes:
    """Splats without higher coefficients: a column for each of SPLAT."""
    head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(values)}", *(f"property float {n}" for n in SPLAT), "end_header\n"])
    return head.encode() + np.ascontiguousarray(values, "<f4").tobytes()


def read_hgt(data: bytes) -> np.ndarray:
    """SRTM: a square of big-endian 16-bit heights, north up; voids (-32768) are nan."""
    side = round((len(data) // 2) ** 0.5)
    if side * side * 2 != len(data):
        raise ValueError("an SRTM file is a square")
    v = np.frombuffer(data, ">i2").astype(float).reshape(side, side)
    return np.where(v == -32768, np.nan, v)


def write_hgt(v: np.ndarray) -> bytes:
    """A square of heights; what is no square is filled up with voids in the south and east."""
    side = max(v.shape)
    v = np.pad(v, ((0, side - v.shape[0]), (0, side - v.shape[1])), constant_values=np.nan)
    return np.where(np.isnan(v), -32768, np.floor(v + 0.5)).astype(">i2").tobytes()


def read_dted(data: bytes) -> np.ndarray:
    """DTED: columns from the west, each from the south; heights are sign and magnitude; -32767 is nan. North up."""
    if data[:3] != b"UHL":
        raise ValueError("not a DTED file")
    columns, rows = int(data[47:51]), int(data[51:55])
    at, size = 80 + 648 + 2700, 12 + 2 * rows
    raw = np.frombuffer(data, np.uint8, columns * size, at).reshape(columns, size)[:, 8 : 8 + 2 * rows]
    v = np.ascontiguousarray(raw).view(">u2").astype(np.int64)
    v = np.where(v & 0x8000, -(v & 0x7FFF), v).astype(float)
    return np.where(v == -32767, np.nan, v).T[::-1]


def write_dted(v: np.ndarray) -> bytes:
    rows, columns = v.shape
    head = b"UHL1" + b" " * 43 + f"{columns:04d}{rows:04d}".encode()
    out = [head.ljust(80), b" " * 648, b" " * 2700]
    heights = np.where(np.isnan(v), -32767, np.floor(v + 0.5)).astype(np.int64)[::-1].T
    for k, column in enumerate(heights):
        body = np.where(column < 0, 0x8000 | -column, column).astype(">u2").tobytes()
        out.append(b"\xaa" + struct.pack(">I", k)[1:] + struct.pack(">HH", k, 0) + body + struct.pack(">I", 0))
    return b"".join(out)


def write_glb(positions: np.ndarray, indices: np.ndarray) -> bytes:
    """One mesh without compression."""
    p, i = positions.astype("<f4"), indices.astype("<u4")
    body = p.tobytes() + i.tobytes()
    tree = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}], "buffers": [{"byteLength": len(body)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": p.nbytes}, {"buffer": 0, "byteOffset": p.nbytes, "byteLength": i.nbytes}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(0).tolist(), "max": p.max(0).tolist()}, {"bufferView": 1, "componentType": 5125, "count": i.size, "type": "SCALAR"}],
    }
    text = json.dumps(tree, separators=(",", ":")).encode()
    text, body = text + b" " * (-len(text) % 4), body + b"\0" * (-len(body) % 4)
    chunks = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(body), 0x004E4942) + body
    return b"glTF" + struct.pack("<II", 2, 12 + len(chunks)) + chunks


def read_glb(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and indices of every primitive, nodes' transforms not applied."""
    if data[:4] != b"glTF":
        raise ValueError("not a GLB file")
    size = struct.unpack_from("<I", data, 12)[0]
    tree, body = json.loads(data[20 : 20 + size]), data[28 + size :]
    kinds = {5121: "u1", 5123: "<u2", 5125: "<u4", 5126: "<f4"}

    def accessor(n: int) -> np.ndarray:
        a = tree["accessors"][n]
        v = tree["bufferViews"][a["bufferView"]]
        width = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}[a["type"]]
        return np.frombuffer(body, kinds[a["componentType"]], a["count"] * width, v.get("byteOffset", 0) + a.get("byteOffset", 0)).reshape(-1, width)

    out = []
    for m in tree.get("meshes", []):
        for p in m["primitives"]:
            xyz = accessor(p["attributes"]["POSITION"])
            out.append((xyz, accessor(p["indices"]).ravel() if "indices" in p else np.arange(len(xyz))))
    return out


def write_pnts(xyz: np.ndarray, rgb: np.ndarray) -> bytes:
    """A point tile: 28 bytes of header, the first point as the centre, 32-bit offsets, colours; nothing for no points."""
    if not len(xyz):
        return b""
    table = json.dumps({"POINTS_LENGTH": len(xyz), "RTC_CENTER": xyz[0].tolist(), "POSITION": {"byteOffset": 0}, "RGB": {"byteOffset": 12 * len(xyz)}}, separators=(",", ":")).encode()
    table += b" " * (-(28 + len(table)) % 8)
    body = (xyz - xyz[0]).astype("<f4").tobytes() + rgb.astype(np.uint8).tobytes()
    body += b"\0" * (-len(body) % 8)
    return b"pnts" + struct.pack("<6I", 1, 28 + len(table) + len(body), len(table), len(body), 0, 0) + table + body


def read_pnts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    _, _, n_table, _, _, _ = struct.unpack_from("<6I", data, 4)
    table, body = json.loads(data[28 : 28 + n_table]), data[28 + n_table :]
    n = table["POINTS_LENGTH"]
    xyz = np.frombuffer(body, "<f4", 3 * n).reshape(n, 3).astype(float) + np.array(table["RTC_CENTER"])
    return xyz, np.frombuffer(body, np.uint8, 3 * n, table["RGB"]["byteOffset"]).reshape(n, 3)


def _zigzag(v: np.ndarray) -> bytes:
    d = np.diff(v, prepend=0)
    return ((d << 1) ^ (d >> 31)).astype("<u2").tobytes()


def _unzigzag(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.int32)
    return np.cumsum((raw >> 1) ^ -(raw & 1))


def write_quantized_mesh(u: np.ndarray, v: np.ndarray, height: np.ndarray, triangles: np.ndarray, center: np.ndarray, radius: float) -> bytes:
    """A terrain tile: u, v in 0..1 and heights in 15 bits, vertices in the order of first use, high-water-mark indices."""
    if len(u) > 1 << 16:
        raise ValueError("a tile of more than 65,536 vertices needs wider indices")
    flat = triangles.ravel()
    _, first = np.unique(flat, return_index=True)
    order = flat[np.sort(first)]
    place = np.zeros(len(u), np.int64)
    place[order] = np.arange(len(order))
    u, v, height, flat = u[order], v[order], height[order], place[flat]
    low, high = float(height.min()), float(height.max())
    span = high - low if high - low >= 1e-6 else 1.0
    q = [np.trunc(x * 32767).astype(np.int32) for x in (u, v, (height - low) / span)]
    top = np.concatenate([[0], np.maximum.accumulate(flat)[:-1] + 1])
    head = struct.pack("<3d2f3dd3d", *center, low, high, *center, radius, *center)
    out = [head, struct.pack("<I", len(order)), *map(_zigzag, q), struct.pack("<I", len(flat) // 3), (top - flat).astype("<u2").tobytes()]
    for edge in (q[0] == 0, q[1] == 0, q[0] == 32767, q[1] == 32767):
        at = np.flatnonzero(edge)
        out.append(struct.pack("<I", len(at)) + at.astype("<u2").tobytes())
    return b"".join(out)


def read_quantized_mesh(data: bytes) -> dict[str, np.ndarray]:
    low, high = struct.unpack_from("<2f", data, 24)
    (n,) = struct.unpack_from("<I", data, 88)
    u, v, h = (_unzigzag(np.frombuffer(data, "<u2", n, 92 + 2 * n * k)) for k in range(3))
    at = 92 + 6 * n
    (t,) = struct.unpack_from("<I", data, at)
    flat, top = [], 0
    for code in np.frombuffer(data, "<u2", 3 * t, at + 4).tolist():
        flat.append(top - code)
        top += code == 0
    return {"u": u / 32767, "v": v / 32767, "height": low + h / 32767 * (high - low), "triangles": np.array(flat).reshape(-1, 3)}
