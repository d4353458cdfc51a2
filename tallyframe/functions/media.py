"""Containers of media read and written as bytes: PNG, GIF, MP4 boxes, NPZ (survey A16, A19).

Each function handles one file's bytes inside a task and raises ValueError where they are
damaged or of a kind that is not read here.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np

#: Milliseconds of a GIF frame without a delay.
GIF_DEFAULT_DELAY_MS = 100
_PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != _PNG:
        raise ValueError("no PNG signature")
    at = 8
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + body) != int.from_bytes(crc, "big"):
            raise ValueError("a PNG chunk is damaged")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("the PNG does not end")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines of bytes with their filters undone; ``step`` bytes make a pixel."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(raw):
        kind, x = line[0], line[1:].copy()
        if kind == 1:
            for k in range(step):
                x[k::step] = np.cumsum(x[k::step], dtype=np.uint8)
        elif kind == 2:
            x += above
        elif kind in (3, 4):
            left, corner = [0] * step, [0] * step
            values, up = x.tolist(), above.tolist()
            for i, v in enumerate(values):
                k = i % step
                a, b, c = left[k], up[i], corner[k]
                if kind == 3:
                    near = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if pa <= pb and pa <= pc else b if pb <= pc else c
                values[i] = left[k] = (v + near) & 255
                corner[k] = b
            x = np.array(values, np.uint8)
        elif kind:
            raise ValueError("a PNG line has no known filter")
        out[y] = above = x
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of an 8-bit PNG without interlace; grey is spread to three
    channels, transparency is left out."""
    head, body, palette = None, [], None
    for kind, chunk in _png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None or head[2] != 8 or head[3] not in _SAMPLES or head[6]:
        raise ValueError("only 8-bit PNG without interlace is read")
    width, height, _, colour = head[:4]
    n = _SAMPLES[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError("the PNG's pixels are damaged") from e
    if raw.size != height * (1 + width * n):
        raise ValueError("the PNG has too few or too many pixels")
    x = _unfiltered(raw.reshape(height, -1), n).reshape(height, width, n)
    if colour == 3:
        if palette is None or int(x.max(initial=0)) >= len(palette):
            raise ValueError("the PNG lacks a colour of its palette")
        return palette[x[..., 0]]
    return np.repeat(x[..., :1], 3, axis=2) if n < 3 else x[..., :3]


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of (height, width) or (height, width, 3) pixels."""
    height, width = pixels.shape[:2]
    lines = np.zeros((height, 1 + pixels[0].size), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def probe_gif(data: bytes) -> dict:
    """Size of the canvas, number of frames, rate and duration. Where a frame has no delay,
    every frame counts as the default, and ``fps_source`` says so."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF signature")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, delay, delays = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), 0, []

    def blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += 1 + data[at]
        if at >= len(data):
            raise ValueError("the GIF does not end")
        return at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21 and at + 1 < len(data):
            if data[at + 1] == 0xF9 and at + 7 < len(data):
                delay = 10 * int.from_bytes(data[at + 4 : at + 6], "little")
            at = blocks(at + 2)
        elif data[at] == 0x2C and at + 10 < len(data):
            local = data[at + 9]
            at = blocks(at + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
            delays.append(delay)
            delay = 0
        else:
            raise ValueError("the GIF is damaged")
    if at >= len(data) or not delays:
        raise ValueError("the GIF does not end" if at >= len(data) else "the GIF has no frames")
    known = all(delays)
    seconds = (sum(delays) if known else len(delays) * GIF_DEFAULT_DELAY_MS) / 1000
    return {"width": width, "height": height, "fps": len(delays) / seconds, "frame_count": len(delays), "duration_s": seconds, "container": "gif", "fps_source": "container" if known else "gif_default_delay"}


def encode_gif(width: int, height: int, delays: list[int | None]) -> bytes:
    """A GIF of black frames; a delay in hundredths of a second each, None for a frame that
    says nothing about it."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80, 0, 0), b"\0\0\0\xff\xff\xff"]
    for d in delays:
        if d is not None:
            out.append(b"\x21\xf9\x04\0" + struct.pack("<H", d) + b"\0\0")
        # Clear before every pixel: codes of three bits, 4 clears, 0 is black, 5 ends.
        bits = "".join(f"{c:03b}"[::-1] for c in [4, 0] * (width * height) + [5])
        packed = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        data = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x02" + data + b"\0")
    return b"".join([*out, b"\x3b"])


def _boxes(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    at = 0
    while at + 8 <= len(data):
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            raise ValueError("an MP4 box is cut short")
        yield kind, data[at + head : at + size]
        at += size


def _box(data: memoryview, *path: bytes) -> memoryview:
    for name in path:
        data = next((body for kind, body in _boxes(data) if kind == name), None)
        if data is None:
            raise ValueError(f"the MP4 lacks {name.decode()}")
    return data


def probe_mp4(data: bytes) -> dict:
    """Size, exact number of frames, rate and duration of the first video track, from its
    tables of samples."""
    for kind, track in _boxes(_box(memoryview(data), b"moov")):
        if kind != b"trak" or bytes(_box(track, b"mdia", b"hdlr")[8:12]) != b"vide":
            continue
        head, media, times = _box(track, b"tkhd"), _box(track, b"mdia", b"mdhd"), _box(track, b"mdia", b"minf", b"stbl", b"stts")
        scale = int.from_bytes(media[20:24] if media[0] else media[12:16], "big")
        pairs = np.frombuffer(times[8:], ">u4").astype(np.int64).reshape(-1, 2)[: int.from_bytes(times[4:8], "big")]
        frames, ticks = int(pairs[:, 0].sum()), int((pairs[:, 0] * pairs[:, 1]).sum())
        if not scale or not ticks:
            raise ValueError("cannot determine the frame rate")
        width, height = (int.from_bytes(head[-8 + i : -4 + i or None], "big") >> 16 for i in (0, 4))
        return {"width": width, "height": height, "fps": frames * scale / ticks, "frame_count": frames, "duration_s": ticks / scale, "container": "mp4", "fps_source": "container"}
    raise ValueError("no video track")


def probe(name: str, data: bytes) -> dict:
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "gif":
        return probe_gif(data)
    if kind in ("mp4", "m4v", "mov"):
        return probe_mp4(data)
    raise ValueError(f"no probe for .{kind}")


def read_npz(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Members of an archive of arrays in their order; pickled objects are refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                yield name.removesuffix(".npy"), np.lib.format.read_array(io.BytesIO(z.read(name)), allow_pickle=False)
    except (zipfile.BadZipFile, EOFError, zlib.error) as e:
        raise ValueError("the archive is damaged") from e


def encode_npz(arrays: dict[str, np.ndarray]) -> bytes:
    """Equal arrays give equal bytes: members by name, stored, of one fixed time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, value in sorted(arrays.items()):
            body = io.BytesIO()
            np.lib.format.write_array(body, np.asarray(value), allow_pickle=False)
            z.writestr(zipfile.ZipInfo(f"{name}.npy", (1980, 1, 1, 0, 0, 0)), body.getvalue())
    return out.getvalue()
