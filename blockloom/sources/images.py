"""Image files as pixels: PNG, TIFF (uncompressed) and Radiance HDR, read with numpy and zlib."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


class Unreadable(ValueError):
    """A file that is damaged or of a kind that is not read."""


def rgba(samples: np.ndarray) -> np.ndarray:
    """(h, w, 1 to 4) bytes as RGBA: grey spread over the colours, opaque without alpha."""
    n = samples.shape[2]
    colour = np.repeat(samples[:, :, :1], 3, 2) if n < 3 else samples[:, :, :3]
    alpha = samples[:, :, n - 1 :] if n in (2, 4) else np.full((*samples.shape[:2], 1), 255, np.uint8)
    return np.concatenate([colour, alpha], 2)


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """PNG rows (a filter byte before each) as the bytes they stand for."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for y, row in enumerate(raw):
        kind, line = row[0], row[1:]
        if kind == 0:
            own = line.copy()
        elif kind == 1:
            own = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            own = line + above
        elif kind in (3, 4):
            own = line.copy()
            for x in range(len(own)):
                a, b, c = int(own[x - step]) if x >= step else 0, int(above[x]), int(above[x - step]) if x >= step else 0
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                own[x] = (int(own[x]) + guess) & 255
        else:
            raise Unreadable("png filter")
        out[y] = above = own
    return out


def read_png(data: bytes) -> np.ndarray:
    """RGBA of a PNG without interlace; palettes are looked up, 16-bit samples keep their high bytes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Unreadable("png signature")
    at, held, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            held.append(body)
    if head is None or head[6]:
        raise Unreadable("png header")
    w, h, depth, colour = head[:4]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    line = (w * n * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(held)), np.uint8)
    if len(raw) < h * (line + 1):
        raise Unreadable("png data")
    rows = _unfilter(raw[: h * (line + 1)].reshape(h, line + 1), max(1, n * depth // 8))
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, : w * n]
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
        samples = (values if colour == 3 else (values.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)).reshape(h, w, n)
    else:
        samples = rows.reshape(h, w, n, depth // 8)[:, :, :, 0]
    if colour == 3:
        if palette is None:
            raise Unreadable("png palette")
        out = rgba(palette[samples[:, :, 0]])
        if clear:
            table = np.full(256, 255, np.uint8)
            table[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[:, :, 3] = table[samples[:, :, 0]]
        return out
    out = rgba(samples)
    if clear and colour in (0, 2):
        wide = rows.reshape(h, w, n, 2).astype(int) @ [256, 1] if depth == 16 else values.reshape(h, w, n) if depth < 8 else samples
        out[:, :, 3] = np.where((wide == np.array(struct.unpack(f">{n}H", clear[: 2 * n]))).all(2), 0, 255)
    return out


# Bytes of a TIFF field's type, and the numbers of the fields read.
_TIFF_SIZE = {1: 1, 3: 2, 4: 4}
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 279: "counts", 284: "planar"}


def read_tiff(data: bytes) -> np.ndarray:
    """RGBA of an uncompressed strip TIFF of 8 or 16 bits; of the latter the high bytes."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise Unreadable("tiff signature")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[str, list[int]] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if tag in _TAGS and kind in _TIFF_SIZE:
            size, place = _TIFF_SIZE[kind] * n, at + 10 + 12 * i
            place = place if size <= 4 else struct.unpack(order + "I", data[place : place + 4])[0]
            tags[_TAGS[tag]] = list(struct.unpack(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data[place : place + size]))
    w, h, n, bits = tags["width"][0], tags["height"][0], tags.get("samples", [1])[0], tags.get("bits", [8])[0]
    if tags.get("compression", [1])[0] != 1 or tags.get("planar", [1])[0] != 1 or bits not in (8, 16) or not 1 <= n <= 4:
        raise Unreadable("tiff kind")
    body = b"".join(data[a : a + c] for a, c in zip(tags["offsets"], tags["counts"], strict=True))
    if len(body) < w * h * n * bits // 8:
        raise Unreadable("tiff data")
    samples = np.frombuffer(body, np.dtype("u1" if bits == 8 else order + "u2"), w * h * n).reshape(h, w, n)
    return rgba((samples >> (bits - 8)).astype(np.uint8))


def read_hdr(data: bytes) -> np.ndarray:
    """(h, w, 3) floats of a Radiance file, run lengths or plain."""
    head, _, body = data.partition(b"\n\n")
    if not head.startswith(b"#?"):
        raise Unreadable("hdr signature")
    size, _, body = body.partition(b"\n")
    words = size.split()
    if len(words) != 4 or words[0] != b"-Y" or words[2] != b"+X":
        raise Unreadable("hdr size")
    h, w, at = int(words[1]), int(words[3]), 0
    out = np.zeros((h, w, 4), np.uint8)
    raw = np.frombuffer(body, np.uint8)
    for y in range(h):
        if not (8 <= w < 1 << 15 and len(raw) >= at + 4 and raw[at] == 2 and raw[at + 1] == 2 and int(raw[at + 2]) << 8 | int(raw[at + 3]) == w):
            if len(raw) < at + 4 * w:
                raise Unreadable("hdr data")
            out[y] = raw[at : at + 4 * w].reshape(w, 4)
            at += 4 * w
            continue
        at += 4
        for c in range(4):
            x = 0
            while x < w:
                if at + 1 >= len(raw):
                    raise Unreadable("hdr data")
                n = int(raw[at])
                run = n > 128
                n = min(n - 128 if run else n, w - x)
                if n <= 0:
                    raise Unreadable("hdr data")
                out[y, x : x + n, c] = raw[at + 1] if run else raw[at + 1 : at + 1 + n]
                at += 2 if run else 1 + n
                x += n
    scale = np.where(out[:, :, 3] > 0, np.ldexp(1.0, out[:, :, 3].astype(int) - 136), 0.0)
    return (out[:, :, :3] * scale[:, :, None]).astype(np.float32)


# What a material's texture is, by the end of its name, and the classes it is encoded as.
ROLES = {"Color": "albedo", "NormalGL": "normal", "Roughness": "mask"}
ROLE_CLASSES = {"albedo": ("bc1", "bc7"), "normal": ("bc5u", "bc5s"), "mask": ("bc4u", "bc4s")}


def role(name: str) -> str | None:
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return next((r for end, r in ROLES.items() if stem.endswith((f"_{end}", f"-{end}"))), None)


READERS = {"png": read_png, "tif": read_tiff, "tiff": read_tiff, "hdr": read_hdr}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, role, width, height, rgba (LDR) or floats (RGB, HDR) of every file; a damaged or unknown one has an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                image = error = None
                try:
                    reader = READERS.get(name.rsplit(".", 1)[-1].lower())
                    image = reader(content.as_py()) if reader else None
                    error = None if reader else "UnsupportedFormat"
                except (Unreadable, KeyError, ValueError, IndexError, struct.error, zlib.error):
                    error = "InvalidField"
                hdr = image is not None and image.dtype == np.float32
                row = (name, role(name), *((None, None) if image is None else (image.shape[1], image.shape[0])), None if image is None or hdr else image.tobytes(), image.tobytes() if hdr else None, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()), strict=True)], ["path", "role", "width", "height", "rgba", "floats", "error"])

    return files.mapInArrow(run, "path string, role string, width long, height long, rgba binary, floats binary, error string")
