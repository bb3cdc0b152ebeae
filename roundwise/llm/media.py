"""Media columns: Netpbm and BMP, area-resized tiles and difference hashes.

A payload of bytes becomes a greyscale picture 64 samples wide (binary PGM, or
an 8-bit BMP with a grey palette; by default one or the other by a checksum of the
payload, as a media column holds both), which is decoded to a numpy array again. The
picture is resized by area means, read off an integral image interpolated at
fractional edges, to a tile written in the NPY format; its difference hash has a
bit for each pair of horizontal neighbours.

Defined results: null and empty texts are one row of 64 zero bytes; equal texts
give equal values; other columns don't matter; a row for each input row.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from roundwise.llm.common import pieces, table

WIDTH = 64


def write_netpbm(samples: np.ndarray) -> bytes:
    """Binary PGM of a (height, width) array, PPM of (height, width, 3)."""
    kind = b"P5" if samples.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def read_netpbm(data: bytes) -> np.ndarray:
    """Decodes P5 and P6 with comments in the header; 16-bit samples if the
    largest value is over 255."""
    fields, at = [], 2
    if data[:2] not in (b"P5", b"P6"):
        raise ValueError("not a binary PGM or PPM")
    while len(fields) < 3:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = fields
    shape = (h, w) if data[:2] == b"P5" else (h, w, 3)
    return np.frombuffer(data, np.uint8 if top < 256 else ">u2", int(np.prod(shape)), at + 1).reshape(shape)


def write_bmp(samples: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, or 24-bit BMP of (height, width, 3) RGB."""
    h, w = samples.shape[:2]
    grey = samples.ndim == 2
    rows = samples if grey else samples[:, :, ::-1].reshape(h, 3 * w)
    rows = np.pad(rows[::-1], ((0, 0), (0, -rows.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.empty(0, np.uint8)
    offset = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Decodes uncompressed 8-bit grey-palette and 24-bit BMPs, either way up."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    (offset,) = struct.unpack_from("<I", data, 10)
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (8, 24) or packed:
        raise ValueError("only uncompressed BMPs of 8 or 24 bits")
    wide = w * bits // 8
    rows = np.frombuffer(data, np.uint8, abs(h) * (wide + -wide % 4), offset).reshape(abs(h), -1)[:, :wide]
    rows = rows if h < 0 else rows[::-1]
    return rows if bits == 8 else rows.reshape(abs(h), w, 3)[:, :, ::-1]


def cell_sums(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Of a (height, width) grid laid over the picture, each cell's sum of samples
    times height * width: whole numbers, by the integral image."""
    h, w = samples.shape
    area = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.int64), axis=1, out=area[1:, 1:])

    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(np.arange(m + 1) * n // m, n - 1)
        return low, np.arange(m + 1) * n - low * m

    y, fy = edges(h, height)
    x, fx = edges(w, width)
    part = area[y] * height + fy[:, None] * (area[y + 1] - area[y])
    part = part[:, x] * width + fx * (part[:, x + 1] - part[:, x])
    return np.diff(np.diff(part, axis=0), axis=1)


def resized(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of a (height, width) picture."""
    return cell_sums(samples, height, width) / samples.size


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def dhash(samples: np.ndarray, side: int = 8) -> tuple[bytes, str]:
    """The NPY tile (side x side + 1 bytes) and the difference hash's hex digits."""
    tile = ((2 * cell_sums(samples, side, side + 1) + samples.size) // (2 * samples.size)).astype(np.uint8)  # halves up
    bits = tile[:, 1:] > tile[:, :-1]
    return npy(tile), np.packbits(bits).tobytes().hex()


CODECS = {"pgm": (write_netpbm, read_netpbm), "bmp": (write_bmp, read_bmp)}


def format_of(raw: bytes) -> str:
    """The format a payload is stored in: even checksums PGM, odd ones BMP."""
    return ("pgm", "bmp")[zlib.crc32(raw) & 1]


def decoded(media: bytes) -> np.ndarray:
    """The samples of a stored picture, by its first bytes."""
    return read_bmp(media) if media[:2] == b"BM" else read_netpbm(media)


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(max(WIDTH, len(raw) + -len(raw) % WIDTH) - len(raw)), len(raw)


def as_media(docs: DataFrame, kind: str | None = None, outputs: tuple[str, ...] = ("media", "tile", "dhash"), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns and, of each whole text: media (the stored picture), tile
    (NPY), dhash, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, as named in outputs. kind: "pgm", "bmp", or
    None for format_of."""
    kinds = {"media": "binary", "tile": "binary", "dhash": "string", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    arrow = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got: dict[str, list] = {o: [] for o in outputs}
            for value in batch.column(len(keep)):
                raw, n = payload(value.as_py())
                media = CODECS[kind or format_of(raw)][0](np.frombuffer(raw, np.uint8).reshape(-1, WIDTH))
                samples = decoded(media)
                back = samples.tobytes()
                tile, code = dhash(samples)
                found = {"media": media, "tile": tile, "dhash": code, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-WIDTH:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"{code}:{zlib.crc32(tile):08x}"}
                for o in outputs:
                    got[o].append(found[o])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(got[o], arrow[kinds[o]]) for o in outputs]], names=[*keep, *outputs])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"{o} {kinds[o]}" for o in outputs]])
    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text_")).mapInArrow(run, schema)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_media(table(spark, sf_dir, "documents"), None, ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"))
