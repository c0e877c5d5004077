"""Media columns: Ogg.

Bytes are stored as a stream of unsigned 8-bit samples in Ogg pages, next to a second logical stream that tells the
payload's size, and read back: page checksums are verified, packets are put together from the lacing values, logical
streams are told apart by serial number, and times follow from the granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vigilframe.llm.common import per_text

RATE = 8000
PACKET = 16_000
MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, most significant bit first, start 0: zlib's, with the bits of all bytes mirrored."""
    mirrored = zlib.crc32(page.translate(MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRRORED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    page = bytearray(head + body)
    page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def write_stream(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream. packets: bytes and the granule position at their end. The first has a page alone;
    a packet longer than a page goes on in the next."""
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), -1, 0

    def flush(more: int) -> None:
        nonlocal granule, flags
        pages.append(_page(flags | more | (FIRST if not pages else 0), granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule, flags = -1, 0

    for k, (data, position) in enumerate(packets):
        at, values = 0, [255] * (len(data) // 255) + [len(data) % 255]
        while values:
            room = 255 - len(lacing)
            if not room:
                flush(0)
                flags = CONTINUED if at else 0
                continue
            part, values = values[:room], values[room:]
            lacing += bytes(part)
            body += data[at : at + sum(part)]
            at += sum(part)
        granule = position
        if k == 0 or k == len(packets) - 1:
            flush(LAST if k == len(packets) - 1 else 0)
    return pages


def write(payload: bytes, rate: int = RATE) -> bytes:
    """The stored form. Both serial numbers come from the payload, so equal payloads are stored alike."""
    serial = zlib.crc32(payload)
    samples = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    sound = write_stream([(b"PCM-U8  " + struct.pack("<II", rate, 1), 0), *samples], serial)
    about = write_stream([(b"SIZES   " + struct.pack("<I", PACKET), 0), (struct.pack("<QI", len(payload), zlib.crc32(payload)), 1)], serial ^ 0xFFFFFFFF)
    # first pages of all streams come first, the others in turns
    rest = [page for pair in zip_longest(sound[1:], about[1:]) for page in pair if page]
    return b"".join([sound[0], about[0], *rest])


@dataclass
class Logical:
    """One demultiplexed stream: its packets, and for each page its last granule position (-1: no packet ends there)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


def pages_of(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise OggError("cut off in a page head")
        capture, version, flags, granule, serial, number, checksum, n = HEAD.unpack_from(media, at)
        if capture != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        if end > len(media) or len(lacing) < n:
            raise OggError("cut off in a page")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != checksum:
            raise OggError(f"wrong checksum of page {number} of stream {serial}")
        yield flags, granule, serial, number, lacing, view[at + HEAD.size + n : end]
        at = end


def read(media: bytes) -> dict[int, Logical]:
    """Logical streams by serial number, in the order of their first pages. Raises OggError on any damage."""
    streams: dict[int, Logical] = {}
    for flags, granule, serial, number, lacing, body in pages_of(media):
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial} starts twice or never")
        s = streams.setdefault(serial, Logical())
        if number != s.pages or s.ended or bool(flags & CONTINUED) != bool(s.open):
            raise OggError(f"page {number} of stream {serial} is out of order")
        s.pages += 1
        s.ended = bool(flags & LAST)
        at = run = 0
        for value in lacing:
            run += value
            if value < 255:
                s.open.append(bytes(body[at : at + run]))
                s.packets.append(b"".join(s.open))
                s.open, at, run = [], at + run, 0
        if run:
            s.open.append(bytes(body[at : at + run]))
        s.granules.append(granule)
    for serial, s in streams.items():
        if s.open or not s.ended:
            raise OggError(f"stream {serial} has no end")
    return streams


def times(s: Logical, rate: int) -> list[float]:
    """Seconds at the end of each page on which a packet ends."""
    return [g / rate for g in s.granules if g >= 0]


def payload_of(media: bytes) -> tuple[bytes, float, int, int]:
    """The payload, its seconds, pages and packets."""
    streams = read(media)
    sound = next(s for s in streams.values() if s.packets[0].startswith(b"PCM-U8  "))
    about = next(s for s in streams.values() if s.packets[0].startswith(b"SIZES   "))
    rate, _ = struct.unpack("<II", sound.packets[0][8:])
    size, checksum = struct.unpack("<QI", about.packets[1])
    payload = b"".join(sound.packets[1:])
    if len(payload) != size or zlib.crc32(payload) != checksum:
        raise OggError("the streams disagree about the payload")
    return payload, times(sound, rate)[-1], sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values())


def features(payload: bytes, seconds: float, pages: int, packets: int) -> str:
    """seconds|pages|packets|mean|deviation|loudest of 8 equal parts of the samples."""
    x = np.frombuffer(payload, np.uint8)
    loud = max(range(8), key=lambda i: int(x[len(x) * i // 8 : len(x) * (i + 1) // 8].sum()))
    return f"{seconds:.6f}|{pages}|{packets}|{x.mean():.6f}|{x.std():.6f}|{loud}"


def pad(raw: bytes, block: int = 64) -> bytes:
    return raw + bytes(max(block, -(-len(raw) // block) * block) - len(raw))


def store(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and media, the stored form of each padded text. A null text is stored as an empty one."""

    def make() -> Callable[[bytes | None], tuple]:
        return lambda raw: (write(pad(raw or b"")),)

    return per_text(docs, keys, text, [("media", T.BinaryType())], make)


def round_trip(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and describe both. The media stay in the task. A null text is stored as an empty
    one; repeated rows stay; other columns are ignored, whatever their names; empty input gives an empty result."""

    def make() -> Callable[[bytes | None], tuple]:
        def one(raw: bytes | None) -> tuple:
            raw = raw or b""
            media = write(pad(raw))
            payload, seconds, pages, packets = payload_of(media)
            hexes = [hashlib.sha256(b).hexdigest() for b in (payload, media)]
            return len(raw), len(payload), hexes[0], zlib.crc32(payload[-64:]), len(media), hexes[1], features(payload, seconds, pages, packets)

        return one

    kinds = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    return per_text(docs, keys, text, kinds, make)
