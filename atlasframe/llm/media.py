"""MPEG audio in columns: probing any stream, and carrying bytes losslessly in one.

``probe`` walks a stream frame by frame: it reads ID3v2 tags, finds the first header that a second
one confirms, follows the frame lengths, resynchronises where they lead nowhere, reads a Xing, Info or
VBRI table, recomputes the 16-bit checksum of protected frames (over the header's second half and what
its layer protects: Layer I's bit allocation, Layer II's with the scale factor selection, Layer III's
side information), and stops at ID3v1 or APE tags.  Durations are exact (samples over rate) and every frame's byte offset is kept for seeking.

``store`` puts a text's UTF-8 bytes, filled up with spaces to a multiple of 192, into the main data of
protected MPEG-1 Layer III mono frames: an ID3v2 tag with the payload's length, a frame with a Xing
table, 320 kbit/s frames, and a last one of the smallest rate that holds the rest.  ``read`` gets the
payload back from the stream alone.

Null texts count as empty and give one block of spaces.  A null or unreadable stream has no frames,
``ok`` false and a null payload.  Free-format frames aren't followed.  A table that is cut off, or whose
entries are no numbers of 1 to 4 bytes, gives no seek table, and its frame counts as a table all the
same.  Repeated rows get equal results and an empty table an empty one.  ``store`` ignores columns other
than the named ones; ``read`` keeps those of its input but replaces any that have a name of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCK = 192
# Fixed values of the MPEG audio header: kbit/s by (version 1?, layer), samples a second by version.
_KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Fixed values of Layer II: bits of a subband's allocation, as (bits, subbands) in order, by table.
_ALLOCATED = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low rates": ((4, 4), (3, 7), (2, 19)),
}
_RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
_VERSIONS = {0: "2.5", 2: "2", 3: "1"}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    joint: int | None = None

    @property
    def allocated(self) -> list[int]:
        """Bits of each subband's allocation in a channel, of a Layer I or II frame."""
        if self.layer == 1:
            return [4] * 32
        each = self.kbps if self.mono else self.kbps // 2
        if self.version != "1":
            table = "low rates"
        elif each <= 48:
            table = "d" if self.rate == 32000 else "c"
        else:
            table = "a" if each <= 80 or self.rate == 48000 else "b"
        return [bits for bits, n in _ALLOCATED[table] for _ in range(n)]

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == "1" else (9 if self.mono else 17)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header that ``four`` bytes are, if they are one."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = _VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    kbps, hertz, padding = _KBPS[version == "1", layer][bits], _RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != "1" else 1152
    length = (12000 * kbps // hertz + padding) * 4 if layer == 1 else samples * 125 * kbps // hertz + padding
    return Header(version, layer, not four[1] & 1, kbps, hertz, four[3] >> 6 == 3, length, samples, four[3] >> 4 & 3 if four[3] >> 6 == 1 else None)


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of protected frames, of the first ``bits`` bits: polynomial 0x8005 from 0xFFFF."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        crc ^= byte << 8
        for _ in range(min(8, left)):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
        left -= min(8, left)
        if not left:
            break
    return crc


def _bits(data: bytes, at: int, n: int) -> int:
    end = at + n
    return int.from_bytes(data[at // 8 : -(-end // 8)], "big") >> -end % 8 & (1 << n) - 1


def protected_bits(body: bytes, h: Header) -> int:
    """How many bits after the checksum it protects."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    shared = 32 if h.joint is None else 4 * (h.joint + 1)  # from this subband on, channels share an allocation
    at, selections = 0, 0
    for band, width in enumerate(h.allocated):
        told = [_bits(body, at + k * width, width) for k in range(channels if band < shared else 1)]
        at += len(told) * width
        selections += sum(map(bool, told)) if len(told) == channels else channels * bool(told[0])
    return at + 2 * selections * (h.layer == 2)


def checksum_holds(data: bytes, at: int, h: Header) -> bool:
    """Whether the protected frame at ``at`` has the checksum of its protected bits."""
    body = data[at + 6 : at + (6 + h.side if h.layer == 3 else h.length)]
    bits = protected_bits(body, h)
    if bits > 8 * len(body):
        return False
    kept = bytearray(data[at + 2 : at + 4] + body[: -(-bits // 8)])
    if bits % 8:
        kept[-1] &= 0xFF << 8 - bits % 8 & 0xFF
    return crc16(bytes(kept), 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Stream:
    """What a walk over a stream found."""

    first: Header | None = None
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    samples: int = 0
    table: str | None = None
    table_frames: int | None = None
    toc: list[int] = field(default_factory=list)
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _read_id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """The place after the tag that begins at ``at``; its text frames go to ``tags``."""
    version, end = data[at + 3], at + 10 + _synchsafe(data[at + 6 : at + 10])
    pos = at + 10
    while version >= 3 and pos + 10 <= min(end, len(data)) and data[pos]:
        name = data[pos : pos + 4].decode("latin-1")
        size = _synchsafe(data[pos + 4 : pos + 8]) if version == 4 else int.from_bytes(data[pos + 4 : pos + 8], "big")
        body = data[pos + 10 : pos + 10 + size]
        if name.startswith("T") and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text.rstrip("\0")
        pos += 10 + size
    return end + 10 * (version == 4 and bool(data[at + 5] & 0x10))


def _is_end(data: bytes, at: int) -> bool:
    return at >= len(data) or data[at : at + 3] == b"TAG" or data[at : at + 8] == b"APETAGEX"


def _sync(data: bytes, at: int) -> int:
    """The first place from ``at`` with a header that the next frame, or the end, confirms; -1 if none."""
    while (at := data.find(b"\xff", at)) >= 0:
        h = header(data[at : at + 4])
        if h and at + h.length <= len(data):
            after = header(data[at + h.length : at + h.length + 4])
            if _is_end(data, at + h.length) or after and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate):
                return at
        at += 1
    return -1


def _table(data: bytes, at: int, h: Header, found: Stream) -> bool:
    """Whether the frame at ``at`` is a table of a Xing, Info or VBRI encoder, which is then read."""
    for place in (at + 4 + h.side, at + 6 + h.side):
        if (kind := data[place : place + 4]) in (b"Xing", b"Info"):
            found.table, flags, pos = kind.decode(), int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
            if flags & 1:
                found.table_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            pos += 4 * bool(flags & 2)
            if flags & 4 and pos + 100 <= len(data):
                found.toc = list(data[pos : pos + 100])
            return True
    if data[at + 36 : at + 40] == b"VBRI":
        found.table = "VBRI"
        if at + 62 <= len(data):
            found.table_frames, entries, scale, width = struct.unpack(">IHHH", data[at + 50 : at + 60])
            if 1 <= width <= 4 and at + 62 + entries * width <= len(data):
                found.toc = [scale * int.from_bytes(data[p : p + width], "big") for p in range(at + 62, at + 62 + entries * width, width)]
        return True
    return False


def probe(data: bytes | None) -> Stream:
    """Walk a whole stream."""
    found = Stream()
    data = data or b""
    at = 0
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        at = _read_id3v2(data, at, found.tags)
    while not _is_end(data, at):
        h = header(data[at : at + 4])
        if not h or at + h.length > len(data) or not found.headers and not found.table and _sync(data, at) != at:
            to = _sync(data, at + bool(h))
            found.skipped += (to if to >= 0 else len(data)) - at
            if to < 0:
                break
            at = to
            continue
        if h.protected:
            found.checked += 1
            found.failed += not checksum_holds(data, at, h)
        if found.headers or found.table or not _table(data, at, h, found):
            found.offsets.append(at)
            found.headers.append(h)
        at += h.length
    if data[-128:-125] == b"TAG":
        for name, a, b in (("TIT2", -125, -95), ("TPE1", -95, -65), ("TALB", -65, -35)):
            if text := data[a:b].split(b"\0")[0].decode("latin-1").strip():
                found.tags.setdefault(name, text)
    found.first = found.headers[0] if found.headers else None
    found.samples = sum(h.samples for h in found.headers)
    by_rate: dict[int, int] = {}
    for h in found.headers:
        by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
    found.duration = sum((Fraction(n, r) for r, n in by_rate.items()), Fraction(0))
    return found


_OVERHEAD = 4 + 2 + 17
_STEPS = _KBPS[True, 3]
_ROOM = {k: 3 * kbps - _OVERHEAD for k, kbps in enumerate(_STEPS) if k}  # at 48 kHz a frame has 3 bytes for each kbit/s


@lru_cache(16)
def _begin(step: int) -> bytes:
    """Header, checksum and silent side information of a protected mono frame at 48 kHz."""
    four = bytes((0xFF, 0xFA, step << 4 | 1 << 2, 0xC0))
    return four + crc16(four[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


def _frame(step: int, body: bytes) -> bytes:
    return _begin(step) + body + bytes(_ROOM[step] - len(body))


def encode(payload: bytes) -> bytes:
    """A stream that holds ``payload``."""
    most = _ROOM[14]
    cut = len(payload) // most * most
    frames = [_frame(14, payload[at : at + most]) for at in range(0, cut, most)]
    if cut < len(payload):
        step = next(k for k in range(1, 15) if _ROOM[k] >= len(payload) - cut)
        frames.append(_frame(step, payload[cut:]))
    sizes, total = [3 * _STEPS[6], *map(len, frames)], 0
    ends = [total := total + s for s in sizes]
    toc = bytes(min(255, 256 * (0 if k == 0 else ends[k * len(frames) // 100]) // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\x03payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text  # below 128 bytes: equal as a synchsafe number
    return b"ID3\x04\0\0" + bytes((0, 0, len(tag) >> 7, len(tag) & 127)) + tag + _frame(6, table) + b"".join(frames)


def decode(data: bytes | None, found: Stream | None = None) -> bytes | None:
    """The payload of a stream that ``encode`` wrote; None if it is no such stream."""
    found = found or probe(data)
    length = found.tags.get("payload", "")
    if not length.isdigit() or found.failed:
        return None
    parts = [data[at + 6 + h.side : at + h.length] for at, h in zip(found.offsets, found.headers, strict=True)]
    payload = b"".join(parts)
    return payload[: int(length)] if len(payload) >= int(length) else None


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of ``text``, and the payload: these filled up with spaces to a multiple of 192."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (BLOCK - len(data) if not data else -len(data) % BLOCK)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes of the text, and ``media``: a stream that holds it."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            payloads = [padded(t) for t in batch.column(1).to_pylist()]
            media = pa.array([encode(p) for _, p in payloads], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in payloads], pa.int64()), media], [id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


_PROBED = "ok boolean, version string, layer int, rate int, channels int, frames long, samples long, seconds_num long, seconds_den long, kbps_mean double, vbr string, vbr_frames long, toc array<long>, checked long, failed long, skipped long, offsets array<long>, tags map<string,string>, payload binary"


def read(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """``rows`` with what their streams hold: see the fields of ``_PROBED``; ``offsets`` are the frames'."""
    names = [f.split()[0] for f in _PROBED.split(", ")]
    kept = [f for f in rows.schema.fields if f.name not in names]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + _PROBED
    held = [f.name for f in kept]
    kinds = [pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for data in batch.column(len(held)).to_pylist():
                s = probe(data)
                h, d = s.first, s.duration
                kbps = float(sum(8 * x.length for x in s.headers) / d / 1000) if d else None
                out.append((h is not None, h and h.version, h and h.layer, h and h.rate, h and 2 - h.mono, len(s.offsets), s.samples, d.numerator, d.denominator, kbps, s.table, s.table_frames, s.toc, s.checked, s.failed, s.skipped, s.offsets, list(s.tags.items()), decode(data, s)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*held, *names])

    return rows.select(*held, F.col(media_col).alias("_media")).mapInArrow(run, schema)
