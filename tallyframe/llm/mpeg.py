"""MPEG audio in a binary column: frames, tags, variable-bitrate tables, checksums,
exact durations and the offset of every frame.

The reader resynchronises wherever bytes are no frame. The writer stores any payload
losslessly as the ancillary bytes of silent Layer III frames of varying bitrate, with an
ID3v2 tag, a Xing table and an ID3v1 tag.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_arrow, fresh_path, text_or_empty

# Fixed values of the format: kbit/s by (MPEG 1?, layer) and index, Hz by version.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {"1": [44100, 48000, 32000], "2": [22050, 24000, 16000], "2.5": [11025, 12000, 8000]}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}
#: Bits of each subband's allocation in Layer II, by the format's table.
ALLOCATION = {
    "a": [4] * 11 + [3] * 12 + [2] * 4,
    "b": [4] * 11 + [3] * 12 + [2] * 7,
    "c": [4] * 2 + [3] * 6,
    "d": [4] * 2 + [3] * 10,
    "low rates": [4] * 4 + [3] * 7 + [2] * 19,
}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    mode: int
    extension: int
    size: int
    samples: int
    side: int


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes; None for anything else (free format included)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    index, hz = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or hz == 3 or four[3] & 3 == 2:
        return None
    one = version == "1"
    kbps, rate, padding, mode = BITRATES[one, layer][index], RATES[version][hz], four[2] >> 1 & 1, four[3] >> 6
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    size = (12_000 * kbps // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + padding
    channels = 1 if mode == 3 else 2
    side = 0 if layer != 3 else (17 if channels == 1 else 32) if one else (9 if channels == 1 else 17)
    return Header(version, layer, not four[1] & 1, kbps, rate, channels, mode, four[3] >> 4 & 3, size, samples, side)


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The format's checksum of the first ``bits`` (all): polynomial 0x8005, begun at all ones."""
    crc = 0xFFFF
    for k in range(8 * len(data) if bits is None else bits):
        bit = data[k >> 3] >> (7 - (k & 7)) & 1
        crc = (crc << 1 ^ 0x8005 if crc >> 15 ^ bit else crc << 1) & 0xFFFF
    return crc


def _layer2_bits(data: bytes, at: int, h: Header) -> int | None:
    """How many bits after its checksum a Layer II frame protects: the allocation of all
    subbands and two bits for each subband and channel that has one."""
    each = h.kbps // h.channels
    if h.version != "1":
        widths = ALLOCATION["low rates"]
    elif each >= 56 and (h.rate == 48000 or each <= 80):
        widths = ALLOCATION["a"]
    elif h.rate != 48000 and each >= 96:
        widths = ALLOCATION["b"]
    else:
        widths = ALLOCATION["c" if h.rate != 32000 else "d"]
    bound = min(4 * (h.extension + 1), len(widths)) if h.mode == 1 else len(widths)
    flat = data[at + 6 : at + h.size]
    value, left = int.from_bytes(flat[:64], "big"), 8 * len(flat[:64])
    used = chosen = 0
    for k, width in enumerate(widths):
        for _ in range(h.channels if k < bound else 1):
            if used + width > left:
                return None
            if value >> (left - used - width) & ((1 << width) - 1):
                chosen += 1 if k < bound else h.channels
            used += width
    return used + 2 * chosen if used + 2 * chosen <= 8 * len(flat) else None


def checksum_ok(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a frame has the checksum of the bits it protects; None where it has none."""
    if not h.protected:
        return None
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 2:
        bits = _layer2_bits(data, at, h)
        if bits is None:  # more allocated than the frame holds
            return False
    else:
        bound = 4 * (h.extension + 1) if h.mode == 1 else 32
        bits = 4 * (h.channels * bound + (32 - bound))
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + -(-bits // 8)]
    return crc16(covered, 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Media:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None
    crc_ok: int = 0
    crc_bad: int = 0
    junk: int = 0
    resyncs: int = 0

    @property
    def duration(self) -> Fraction:
        """Seconds of all frames, exactly."""
        samples: dict[int, int] = {}
        for h in self.headers:
            samples[h.rate] = samples.get(h.rate, 0) + h.samples
        return sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))

    def seek(self, seconds: Fraction | float) -> int | None:
        """Offset of the frame that plays at ``seconds``; None after the end."""
        at = Fraction(0)
        for offset, h in zip(self.offsets, self.headers, strict=True):
            at += Fraction(h.samples, h.rate)
            if seconds < at:
                return offset
        return None


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads an ID3v2 tag's text frames; returns the place after the tag."""
    major, size = data[at + 3], _synchsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    tags["id3v2"] = f"2.{major}"
    p = at + 10
    while major >= 3 and p + 10 <= end and data[p] != 0:
        name = data[p : p + 4].decode("latin-1")
        n = _synchsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        body = data[p + 10 : min(end, p + 10 + n)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0")
            if name == "TXXX":
                tags[f"TXXX:{key}"] = value.rstrip("\0")
            else:
                tags[name] = key
        p += 10 + n
    return at + 10 + size + (10 if data[at + 5] & 0x10 else 0)


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    p = at + 4 + h.side
    if h.layer == 3 and data[p : p + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(data[p + 4 : p + 8], "big")
        out, q = {"kind": data[p : p + 4].decode()}, p + 8
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = list(data[q : q + n]) if name == "toc" else int.from_bytes(data[q : q + n], "big")
                q += n
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        number = lambda i, n=2: int.from_bytes(data[p + i : p + i + n], "big")
        entries, scale, width = number(18), number(20), number(22)
        toc = [number(26 + i * width, width) * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": number(10, 4), "frames": number(14, 4), "frames_per_entry": number(24), "toc": toc}
    return None


def _tails(data: bytes, at: int) -> dict[int, tuple[str, int, int]]:
    """Where tags at the end of ``data`` may begin: kind, end, end of the place itself.
    Audio can hold the same bytes, so a place counts only if the frames lead to it."""
    out, ends = {}, [len(data)]
    if len(data) >= at + 128 and data[-128:-125] == b"TAG":
        ends.append(len(data) - 128)
        out[ends[-1]] = "id3v1", len(data), len(data)
    for end in ends:
        if end >= at + 32 and data[end - 32 : end - 24] == b"APETAGEX":
            size = int.from_bytes(data[end - 20 : end - 16], "little")
            begin = end - size - 32 * (data[end - 9] >> 7)
            if size >= 32 and begin >= at:
                out[begin] = "ape", end - size, end
    return out


def _ape(data: bytes, p: int, end: int, tags: dict[str, str]) -> None:
    for _ in range(int.from_bytes(data[end - 16 : end - 12], "little")):
        n, stop = int.from_bytes(data[p : p + 4], "little"), data.find(b"\0", p + 8, end)
        if stop < 0:
            return
        tags["APE:" + data[p + 8 : stop].decode("latin-1")] = data[stop + 1 : stop + 1 + n].decode("utf-8", "replace")
        p = stop + 1 + n


def parse(data: bytes) -> Media:
    """All frames and tags of ``data``. Bytes that are neither are skipped and counted; a
    frame counts if it is whole and another frame, a tag or the end follows it. A tag at
    the end counts where the frames before it end; the same bytes inside a frame are audio."""
    m, at, end = Media(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _id3v2(data, at, m.tags)
    tails, lost = _tails(data, at), False
    while at < end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        sure = h and after <= end and (after == end or after in tails or header(data[after : after + 4]))
        if not sure and at in tails:
            kind, body, after = tails[at]
            if kind == "ape":
                _ape(data, body, after, m.tags)
            else:
                m.tags["id3v1"] = data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1")
            at, lost = after, False
            continue
        if sure or h and after <= end and not lost and m.headers and not any(at < t < after for t in tails):
            if not m.headers and m.vbr is None and (table := _vbr(data, at, h)):
                m.vbr = table  # the table's frame plays nothing
            else:
                m.offsets.append(at)
                m.headers.append(h)
            ok = checksum_ok(data, at, h)
            m.crc_ok, m.crc_bad = m.crc_ok + (ok is True), m.crc_bad + (ok is False)
            at, lost = after, False
            continue
        if not lost:
            m.resyncs, lost = m.resyncs + 1, True
        nxt = data.find(b"\xff", at + 1, end)
        nxt = min([nxt if nxt >= 0 else end, *(t for t in tails if t > at)])
        m.junk += nxt - at
        at = nxt
    return m


_RATE_INDEX = 2  # 32 kHz: every bitrate gives whole frames without padding
_KBPS = BITRATES[True, 3][1:]
_SIZES = [144_000 * k // 32_000 for k in _KBPS]
_SIDE = 17
_ROOM = [n - 6 - _SIDE for n in _SIZES]


@lru_cache(64)
def _frame_head(index: int, protected: bool) -> bytes:
    head = bytes([0xFF, 0xFB - protected, (index + 1) << 4 | _RATE_INDEX << 2, 0xC0])
    return head + (crc16(head[2:] + bytes(_SIDE)).to_bytes(2, "big") if protected else b"") + bytes(_SIDE)


def store(payload: bytes) -> bytes:
    """``payload`` as an MPEG-1 Layer III stream; ``stored`` gives it back."""
    frames, at, last = [], 0, len(_ROOM) - 1
    while at < len(payload):
        rest = len(payload) - at
        index = last if rest >= _ROOM[last] else next(i for i, n in enumerate(_ROOM) if n >= rest)
        frames.append(_frame_head(index, True) + payload[at : at + _ROOM[index]].ljust(_ROOM[index], b"\0"))
        at += _ROOM[index]
    sizes = [len(f) for f in frames]
    total, n = sum(sizes) + _SIZES[0], len(frames)
    begins, here = [], _SIZES[0]
    for size in sizes:
        begins.append(here)
        here += size
    toc = bytes(min(255, 256 * (begins[k * n // 100] if n else 0) // total) for k in range(100))
    table = b"Xing" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc + (100).to_bytes(4, "big")
    first = (_frame_head(0, False) + table).ljust(_SIZES[0], b"\0")
    text = b"\x03payload\0" + str(len(payload)).encode()
    safe = lambda n: bytes(n >> s & 0x7F for s in (21, 14, 7, 0))
    frame = b"TXXX" + safe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + safe(len(frame)) + frame + first + b"".join(frames) + b"TAG" + b"payload".ljust(124, b"\0") + b"\xff"


def stored(data: bytes, media: Media | None = None) -> bytes:
    """The payload of ``store``, from the frames that ``parse`` finds."""
    m = media or parse(data)
    parts = [data[at + (6 if h.protected else 4) + h.side : at + h.size] for at, h in zip(m.offsets, m.headers, strict=True)]
    payload = b"".join(parts)[: int(m.tags["TXXX:payload"])]
    if len(payload) != int(m.tags["TXXX:payload"]) or m.crc_bad:
        raise ValueError("the stream has lost frames or fails its checksums")
    return payload


def feature(m: Media) -> str:
    d = m.duration
    seek = zlib.crc32(b"".join(x.to_bytes(8, "little") for x in m.offsets))
    kbps = sorted({h.kbps for h in m.headers})
    return f"frames={len(m.offsets)};seconds={d.numerator}/{d.denominator};kbps={kbps[0] if kbps else 0}-{kbps[-1] if kbps else 0};vbr={(m.vbr or {}).get('kind', '-')}:{(m.vbr or {}).get('frames', 0)};crc={m.crc_ok}/{m.crc_ok + m.crc_bad};junk={m.junk};seek={seek:08x}"


def with_media(docs: DataFrame, media: str = "media") -> DataFrame:
    """(doc_id, n_bytes, media, seconds_num, seconds_den, offsets): each whole text as UTF-8
    (null: empty), zero bytes up to a positive multiple of 64 after it, as a stream in a
    binary column, with its exact duration and the places of its frames.

    Null, equal and repeated ids give a row each, equal texts equal streams, a text of any
    length one stream, an empty table an empty one; other columns are not carried."""
    bounded_arrow(docs.sparkSession)
    names = ["doc_id", "n_bytes", media, "seconds_num", "seconds_den", "offsets"]
    long = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(1)]
            streams = [store(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")) for t in texts]
            found = [parse(s) for s in streams]
            times = [m.duration for m in found]
            columns = [pa.array([len(t) for t in texts], long), pa.array(streams, pa.binary()), pa.array([d.numerator for d in times], long), pa.array([d.denominator for d in times], long), pa.array([m.offsets for m in found], pa.list_(long))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, f"doc_id long, n_bytes long, {media} binary, seconds_num long, seconds_den long, offsets array<long>")


def write_media(docs: DataFrame, path: str) -> DataFrame:
    """``with_media`` as a table at ``path``, read from there."""
    table = with_media(docs)
    table.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(table.schema).parquet(path)


def seek(table: DataFrame, second: float, media: str = "media") -> DataFrame:
    """``table`` of ``write_media`` with ``frame`` and ``bytes``: number and bytes of the
    frame that sounds at ``second``, cut out by its stored place; null outside the stream."""
    n = F.size("offsets")
    at = F.floor(F.lit(float(second)) * F.col("seconds_den") * n / F.nullif(F.col("seconds_num"), F.lit(0))).cast("int")
    frame = F.when((at >= 0) & (at < n), at)
    begin, end = F.get("offsets", frame), F.get("offsets", frame + 1)
    length = F.coalesce(end - begin, F.octet_length(media) - begin)
    return table.withColumns({"frame": frame, "bytes": F.substring(F.col(media), (begin + 1).cast("int"), length.cast("int"))})


def described(table: DataFrame, media: str = "media") -> DataFrame:
    """``table`` without ``media`` and with the struct ``mpeg``: frames, samples, seconds,
    offsets of the frames, sizes and checksums. A null stream has no frame.

    Other columns are carried through, whatever their names (one named mpeg is replaced).
    """
    bounded_arrow(table.sparkSession)
    rest = [c for c in table.columns if c.lower() not in (media.lower(), "mpeg")]
    kind = "struct<frames:bigint,seconds_num:bigint,seconds_den:bigint,offsets:array<bigint>,crc_ok:bigint,crc_bad:bigint,junk:bigint,media_bytes:bigint,media_sha256:string,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,feature:string>"
    out = table.select(*(f"`{c}`" for c in rest)).withColumn("mpeg", F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                data = value.as_py() or b""
                m = parse(data)
                d = m.duration
                row = {"frames": len(m.offsets), "seconds_num": d.numerator, "seconds_den": d.denominator, "offsets": m.offsets, "crc_ok": m.crc_ok, "crc_bad": m.crc_bad, "junk": m.junk, "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature(m)}
                if "TXXX:payload" in m.tags:
                    p = stored(data, m)
                    row |= {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-64:])}
                rows.append(row)
            arrays = [batch.column(i).cast(schema.field(i).type) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows, schema.field(len(rest)).type)], schema=schema)

    return table.select(*(f"`{c}`" for c in rest), f"`{media}`").mapInArrow(run, out)


def query(docs: DataFrame) -> DataFrame:
    """Written as a table of media, read back, and described from the bytes that were read;
    these have to have the frames and the duration that are stored beside them."""
    fields = "payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    out, m = described(write_media(docs, fresh_path(docs.sparkSession, "media"))), F.col("mpeg")
    same = (m["offsets"] == F.col("offsets")) & (m["seconds_num"] == F.col("seconds_num")) & (m["seconds_den"] == F.col("seconds_den"))
    feature_ = F.when(same, m["feature"]).otherwise(F.raise_error(F.lit("stored frames and bytes differ")))
    return out.select("doc_id", "n_bytes", *((feature_ if f == "feature" else m[f]).alias(f) for f in fields))
