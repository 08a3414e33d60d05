"""Media columns in Ogg: a lossless store for 8-bit samples and a reader that trusts nothing.

The writer multiplexes two logical streams. Stream A carries PCM: a header packet and data packets
of up to 4,096 samples; its granule position counts samples. Stream B carries one packet of text
about the content. Pages follow RFC 3533: capture pattern, version, flags, granule position, serial
number, sequence number, checksum, lacing values. The reader verifies every page's checksum and
sequence number, reassembles packets from lacing values (also over pages), demultiplexes the
streams by serial number and derives timestamps from granule positions.

Null texts count as empty, so that their payload is one block of spaces. Equal texts give equal
values. Empty tables give empty ones; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetsieve.llm.common import prepare, text_or_empty

BLOCK, RATE, PACKET = 192, 8000, 4096
PAGE_PACKETS = 15
FIRST, LAST, CONTINUED, NO_PACKET_ENDS = 2, 4, 1, 2**64 - 1
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7 from the highest bit on, start 0, no final inversion.

    zlib has the same polynomial from the lowest bit on; bits are reversed before and after.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(struct.pack("<I", crc).translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIII", b"OggS", 0, flags, granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing
    raw = head + body
    return raw[:22] + struct.pack("<I", page_checksum(raw)) + raw[26:]


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream; a packet comes with the granule position at its end."""
    out, lacing, body, granule, flags, whole = [], bytearray(), [], NO_PACKET_ENDS, FIRST, 0
    for k, (packet, end) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            room = 255 - len(lacing)
            now, values = values[:room], values[room:]
            size = sum(now)
            lacing += now
            body.append(packet[at : at + size])
            at += size
            if not values:
                granule, whole = end, whole + 1
            if values or whole == PAGE_PACKETS or k == 0 or k == len(packets) - 1:
                last = LAST if k == len(packets) - 1 and not values else 0
                out.append(page(flags | last, granule, serial, len(out), bytes(lacing), b"".join(body)))
                lacing, body, granule, whole = bytearray(), [], NO_PACKET_ENDS, 0
                flags = CONTINUED if values else 0
    return out


def store(text: str) -> tuple[bytes, int]:
    """The Ogg file of a text's payload, and the text's bytes before padding."""
    raw = text.encode()
    padding = BLOCK if not raw else -len(raw) % BLOCK
    payload = raw + b" " * padding
    serial = zlib.crc32(payload)
    packets = [(struct.pack("<8sIHHQ", b"PCM     ", RATE, 8, 1, len(payload)), 0)]
    packets += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    sound = pages_of(packets, serial)
    about = pages_of([(b"TEXT    bytes=%d" % len(raw), 0)], serial ^ 0xFFFFFFFF)
    return b"".join([sound[0], about[0], *sound[1:]]), len(raw)


class BadMedia(ValueError):
    """A file that breaks the container's rules."""


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """For each serial number its packets, each with the granule position of its page if it is the last that ends there."""
    streams: dict[int, list[tuple[bytes, int | None]]] = {}
    open_parts: dict[int, list[bytes]] = {}
    next_page: dict[int, int] = {}
    ended: dict[int, bool] = {}
    at = 0
    while at < len(media):
        if len(media) < at + 27 or media[at : at + 5] != b"OggS\0":
            raise BadMedia(f"no page at byte {at}")
        flags, granule, serial, sequence, checksum, n = struct.unpack_from("<BQIIIB", media, at + 5)
        lacing = media[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(lacing)
        if end > len(media) or len(lacing) < n:
            raise BadMedia(f"the page at byte {at} is cut short")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise BadMedia(f"the page at byte {at} fails its checksum")
        if sequence != next_page.get(serial, 0) or bool(flags & FIRST) != (sequence == 0):
            raise BadMedia(f"page {sequence} of stream {serial:08x} is out of order")
        if bool(flags & CONTINUED) != bool(open_parts.get(serial)):
            raise BadMedia(f"page {sequence} of stream {serial:08x} continues no packet, or fails to")
        if ended.get(serial):
            raise BadMedia(f"stream {serial:08x} goes on behind its end")
        next_page[serial], ended[serial] = sequence + 1, bool(flags & LAST)
        packets, parts, size = streams.setdefault(serial, []), open_parts.pop(serial, []), 0
        before = len(packets)
        for value in lacing:
            size += value
            if value < 255:
                parts.append(media[body_at : body_at + size])
                body_at += size
                packets.append((b"".join(parts), None))
                parts, size = [], 0
        if size or (n and lacing[-1] == 255):
            parts.append(media[body_at : body_at + size])
            open_parts[serial] = parts
        if granule != NO_PACKET_ENDS and len(packets) > before:
            packets[-1] = (packets[-1][0], granule)
        at = end
    if open_parts or not all(ended.values()):
        raise BadMedia("a packet or a stream has no end")
    return streams


def read_back(media: bytes) -> tuple[bytes, str]:
    """The payload and its features: seconds, timestamps, level, zero crossings, spectrum of byte classes."""
    streams = demultiplex(media)
    sound = next((p for p in streams.values() if p and p[0][0][:8] == b"PCM     "), None)
    if sound is None:
        raise BadMedia("no stream of samples")
    _, rate, _, _, total = struct.unpack("<8sIHHQ", sound[0][0])
    payload = b"".join([p for p, _ in sound[1:]])
    if not rate or not payload:
        raise BadMedia("no rate or no samples")
    stamps = [g / rate for _, g in sound[1:] if g is not None]
    if len(payload) != total or (sound[-1][1] or 0) != total:
        raise BadMedia("samples and granule positions differ")
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    level = int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    if not stamps:
        raise BadMedia("no granule positions")
    try:
        about = next((p[0][0][8:].decode() for p in streams.values() if p and p[0][0][:8] == b"TEXT    "), "")
    except UnicodeDecodeError as e:
        raise BadMedia("a stream of text isn't UTF-8") from e
    return payload, f"seconds={total / rate:.6f};pages={len(stamps)};last_stamp={stamps[-1]:.6f};rms={(level / total) ** 0.5:.4f};crossings={crossings};peak={int(np.abs(x).max())};{about}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of every document. No shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stored = [store(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [n for _, n in stored], "media": [m for m, _ in stored]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads a media column back; a file that is null or breaks the container's rules says so in ``error``, with no values."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, media in zip(batch["doc_id"].tolist(), batch["n_bytes"].tolist(), batch["media"]):
                try:
                    if media is None:
                        raise BadMedia("no media")
                    payload, feature = read_back(media)
                except (BadMedia, struct.error) as e:
                    rows.append((doc_id, n_bytes, None, None, None, None, None, None, str(e)))
                    continue
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])
            yield out.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
