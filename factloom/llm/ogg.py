"""Media columns in Ogg: texts stored losslessly as 8-bit samples in pages of two multiplexed logical streams.

Writing: the padded payload is cut into packets of ``PACKET`` samples, dealt in turn to two logical streams; each stream
begins with a header packet of its own; pages hold up to ``LACES`` lacing values (about 4 kB), a granule position and a
checksum, so of three page ends two fall inside a packet.
Reading needs only the bytes: pages are found by their capture pattern, checksums are verified, packets are reassembled from
lacing values (across pages where a packet continues), logical streams are told apart by serial number, the end time
of each packet is derived from granule positions, and the payload is put together in the order of these times.

Nulls and edge cases: a null text counts as empty; every payload is at least one packet; equal texts give equal bytes;
a damaged page raises ``ValueError`` in ``read_ogg``; rows are independent, so ties, repeated rows and a null ``doc_id``
need no care. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import text_batches

PACKET = 576
RATE = 8000
STREAMS = 2
#: Lacing values of a page; not a multiple of the three that a packet takes.
LACES = 20
MAGIC = b"\x7fU8PCM\x00"
PAGE_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

#: Each byte with its bits in reverse order; Ogg's checksum is the reverse of the one in zlib.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, no reflection, start and end value 0."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 to a positive multiple of ``PACKET``; the number of bytes before padding."""
    data = (text or "").encode("utf-8", "replace")
    return data + b"\xff" * (-len(data) % PACKET or (0 if data else PACKET)), len(data)


def _pages(serial: int, header: bytes, packets: list[bytes]) -> Iterator[bytes]:
    """Pages of one logical stream: the header's own first page, then the packets."""

    def page(flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> bytes:
        made = bytearray(PAGE_HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
        made[22:26] = page_checksum(bytes(made)).to_bytes(4, "little")
        return bytes(made)

    yield page(FIRST | (0 if packets else LAST), 0, 0, bytes([len(header)]), header)
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body, number, samples, at, continued = b"".join(packets), 1, 0, 0, False
    for start in range(0, len(lacing), LACES):
        part = lacing[start : start + LACES]
        size = sum(part)
        done = sum(v < 255 for v in part)  # packets that end on this page
        samples += done * PACKET
        flags = (CONTINUED if continued else 0) | (LAST if start + LACES >= len(lacing) else 0)
        yield page(flags, samples if done else -1, number, part, body[at : at + size])
        at, number, continued = at + size, number + 1, part[-1] == 255


def write_ogg(payload: bytes, size: int) -> bytes:
    """The payload (``size`` bytes of it real) as an Ogg file of two multiplexed streams."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    base = zlib.crc32(payload)
    streams = []
    for k in range(STREAMS):
        header = MAGIC + struct.pack("<BBIQ", k, STREAMS, RATE, size)
        streams.append(_pages((base + k) & 0xFFFFFFFF, header, packets[k::STREAMS]))
    out, alive = [], list(streams)
    while alive:  # all first pages come before any other page, as the format asks
        alive = [s for s in alive if (p := next(s, None)) is not None and not out.append(p)]
    return b"".join(out)


def read_ogg(data: bytes) -> dict[int, dict]:
    """Logical streams by serial number: header, packets, end time in seconds of each packet, pages."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + PAGE_HEAD.size:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, checksum, count = PAGE_HEAD.unpack_from(data, at)
        lacing = data[at + PAGE_HEAD.size : at + PAGE_HEAD.size + count]
        start = at + PAGE_HEAD.size + count
        end = start + sum(lacing)
        if version or page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != checksum or end > len(data):
            raise ValueError(f"damaged page at byte {at}")
        stream = streams.setdefault(serial, {"packets": [], "times": [], "open": [], "next": 0, "pages": 0, "last": False})
        if number != stream["next"] or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != bool(stream["open"]):
            raise ValueError(f"page out of order at byte {at}")
        ended = []
        for length in lacing:
            stream["open"].append(data[start : start + length])
            start += length
            if length < 255:
                ended.append(b"".join(stream["open"]))
                stream["open"] = []
        if number and ended:
            # the granule position is that of the last packet ended here; those before end a packet earlier each
            stream["times"] += [(granule - PACKET * (len(ended) - 1 - i)) / RATE for i in range(len(ended))]
        stream["packets"] += ended
        stream |= {"next": number + 1, "pages": stream["pages"] + 1, "last": bool(flags & LAST)}
        at = end
    for serial, stream in streams.items():
        if not stream["last"] or stream["open"] or stream["packets"][0][: len(MAGIC)] != MAGIC:
            raise ValueError(f"stream {serial} is not complete")
        index, of, rate, size = struct.unpack("<BBIQ", stream["packets"].pop(0)[len(MAGIC) :])
        stream |= {"index": index, "of": of, "rate": rate, "size": size}
    return streams


def payload_from(streams: dict[int, dict]) -> tuple[bytes, int]:
    """Payload and real size: the packets of all streams by their times, those of one time by the streams' indexes."""
    timed = [(time, s["index"], packet) for s in streams.values() for time, packet in zip(s["times"], s["packets"], strict=True)]
    timed.sort(key=lambda t: t[:2])
    return b"".join(packet for _, _, packet in timed), next(iter(streams.values()))["size"]


def feature(streams: dict[int, dict], payload: bytes) -> str:
    """streams:pages:packets:duration in ms:mean sample in thousandths:share of padding samples in millionths."""
    duration = sum(s["times"][-1] for s in streams.values() if s["times"])
    pages, packets = sum(s["pages"] for s in streams.values()), sum(len(s["packets"]) for s in streams.values())
    return f"{len(streams)}:{pages}:{packets}:{round(duration * 1000)}:{sum(payload) * 1000 // len(payload)}:{payload.count(255) * 1_000_000 // len(payload)}"


def ogg_column(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): digests of the payload read back and of the stored form, and features; with
    ``keep_media`` also the stored bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                media = write_ogg(*payload_of(text))
                streams = read_ogg(media)
                payload, size = payload_from(streams)
                rows.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(streams, payload), *([media] if keep_media else [])))
            yield pd.DataFrame(rows, columns=columns)

    text_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    columns = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)
