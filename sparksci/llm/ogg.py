"""Media columns: Ogg streams written and read inside Arrow batches.

A document's payload becomes 8-bit mono samples in a PCM logical stream, next to
a second logical stream of time marks.  Reading verifies every page's checksum,
reassembles packets from the lacing values, separates the logical streams by
serial number and derives timestamps from granule positions.

Defined cases: null and empty texts store one block of padding; a null media value
or one that fails a check gives a row whose ``error`` says why and null features, be it
damaged or well checksummed but malformed; repeated rows are stored each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm.common import table

BLOCK = 192
RATE = 8000
PACKET = 4096
MARK_EVERY = 4 * RATE
# Fixed values of the Ogg page format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
MAX_SEGMENTS = 255
NO_PACKET_ENDS = -1
PCM_MAGIC = b"PCM     "
MARK_MAGIC = b"TIMEMARK"
PCM_HEAD, MARK_HEAD = struct.Struct("<8sHHIIBBHI"), struct.Struct("<8sII")

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, zero start and no final xor.

    zlib's is the same code with reflected bits, so bytes are reflected going in and the sum coming out.
    """
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    total = page_checksum(head + body)
    return head[:22] + total.to_bytes(4, "little") + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream with the granule each reaches: lacing of 255s, packets may span pages."""
    pages, lacing, body, granule, flags = [], bytearray(), [], NO_PACKET_ENDS, FIRST
    reached = 0

    def flush(extra: int = 0) -> None:
        nonlocal lacing, body, granule, flags
        pages.append((reached, _page(serial, len(pages), flags | extra, granule, bytes(lacing), b"".join(body))))
        lacing, body, granule, flags = bytearray(), [], NO_PACKET_ENDS, 0

    for k, (packet, end) in enumerate(packets):
        sizes = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while sizes:
            room = MAX_SEGMENTS - len(lacing)
            part, sizes = sizes[:room], sizes[room:]
            n = sum(part)
            lacing += part
            body.append(packet[at : at + n])
            at += n
            if not sizes:
                granule = reached = end
            if len(lacing) == MAX_SEGMENTS and (sizes or k + 1 < len(packets)):
                flush()
                flags = CONTINUED if sizes else 0
        if k == 0 and lacing:
            flush()  # the identification header has the first page to itself
    flush(LAST)
    return pages


def encode(payload: bytes) -> bytes:
    """One physical Ogg stream: PCM samples and time marks, multiplexed in order of time."""
    serial = zlib.crc32(payload)
    head = PCM_HEAD.pack(PCM_MAGIC, 0, 0, 1, RATE, 0, 1, PACKET, 0)
    sound = [(head, 0)] + [(payload[a : a + PACKET], min(a + PACKET, len(payload))) for a in range(0, len(payload), PACKET)]
    marks = [(MARK_HEAD.pack(MARK_MAGIC, RATE, MARK_EVERY), 0)]
    marks += [(f"{a / RATE:.3f}".encode(), a) for a in range(0, len(payload), MARK_EVERY)]
    a, b = stream_pages(serial, sound), stream_pages(serial ^ 0xFFFFFFFF, marks)
    order = [(i > 0, end, s, i, p) for s, pages in enumerate((a, b)) for i, (end, p) in enumerate(pages)]
    return b"".join(x[-1] for x in sorted(order, key=lambda x: x[:4]))


def logical_streams(media: bytes) -> dict[int, dict]:
    """Verify pages and reassemble packets, by serial number: packets, their end granules, page count."""
    at, streams = 0, {}
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise ValueError(f"truncated page header at byte {at}")
        capture, version, flags, granule, serial, number, total, n = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version != 0:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError(f"truncated page at byte {at}")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != total:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "ends": [], "pages": 0, "open": [], "closed": False})
        if number != s["pages"] or bool(flags & FIRST) != (number == 0) or s["closed"]:
            raise ValueError(f"page {number} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError(f"page {number} of stream {serial} does not continue its packet")
        s["pages"] += 1
        s["closed"] = bool(flags & LAST)
        body, size, finished = at + HEADER.size + n, 0, False
        for k in lacing:
            size += k
            if k < 255:
                s["packets"].append(b"".join([*s["open"], media[body : body + size]]))
                s["ends"].append(None)
                s["open"], body, size, finished = [], body + size, 0, True
        if size:
            s["open"].append(media[body : body + size])
        if finished != (granule != NO_PACKET_ENDS):
            raise ValueError(f"the granule position of page {number} of stream {serial} does not say whether a packet ends there")
        if finished:
            s["ends"][-1] = granule
        at = end
    if any(s["open"] or not s["closed"] for s in streams.values()):
        raise ValueError("a stream does not end")
    return streams


def packet_ends(durations: list[int], ends: list[int | None]) -> list[int]:
    """End of each packet in samples: a page's granule position is that of the last packet it ends, the others lie before it."""
    out: list[int] = [0] * len(ends)
    for i in reversed(range(len(ends))):
        own = ends[i]
        out[i] = out[i + 1] - durations[i + 1] if own is None else own
    return out


def _stream(streams: dict[int, dict], magic: bytes, head: struct.Struct) -> dict:
    for s in streams.values():
        if s["packets"] and s["packets"][0].startswith(magic):
            if len(s["packets"][0]) < head.size:
                raise ValueError(f"the header of stream {magic.decode().strip()} is too short")
            return s
    raise ValueError("a logical stream is missing")


def decode(media: bytes) -> dict:
    """Samples, timed packets and figures of a stored stream; raises ValueError where a check fails."""
    streams = logical_streams(media)
    sound, marks = _stream(streams, PCM_MAGIC, PCM_HEAD), _stream(streams, MARK_MAGIC, MARK_HEAD)
    rate, every = PCM_HEAD.unpack_from(sound["packets"][0])[4], MARK_HEAD.unpack_from(marks["packets"][0])[2]
    if rate == 0:
        raise ValueError("the sample rate is 0")
    payload = b"".join(sound["packets"][1:])
    if not payload:
        raise ValueError("there are no samples")
    sizes = [0, *map(len, sound["packets"][1:])]
    ends = packet_ends(sizes, sound["ends"])
    if any(end - before != size for before, end, size in zip(ends, ends[1:], sizes[1:], strict=False)) or ends[0]:
        raise ValueError("granule positions differ from the samples")
    at = packet_ends([0, 0, *[every] * (len(marks["packets"]) - 2)], marks["ends"])
    if any(f"{a / rate:.3f}".encode() != text for a, text in zip(at[1:], marks["packets"][1:], strict=True)):
        raise ValueError("a time mark differs from its granule position")
    x = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8)))) if len(x) > 1 else 0
    return {
        "payload": payload,
        "packets": [(PCM_MAGIC.decode().strip(), k, (end - size) / rate, end / rate, size) for k, (end, size) in enumerate(zip(ends, sizes, strict=True)) if k]
        + [(MARK_MAGIC.decode(), k, a / rate, a / rate, len(marks["packets"][k])) for k, a in enumerate(at) if k],
        "feature": f"rate={rate};seconds={ends[-1] / rate:.6f};pages={sum(s['pages'] for s in streams.values())};packets={len(sound['packets'])};"
        f"last_packet={(ends[-1] - sizes[-1]) / rate:.6f};marks={len(at) - 1};last_mark={at[-1] / rate:.6f};mean={x.mean():.6f};crossings={crossings}",
    }


def payload_of(text: bytes | None) -> bytes:
    data = text or b""
    return data + b" " * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media file as a binary column. Map-only; one document in memory at a time."""
    schema = "doc_id long, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def decode_media(df: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Read the ``media`` column back: digests and features, the payload itself on request, and any error."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string, payload binary"

    def one(doc_id, n_bytes, media):
        if media is None:
            return (doc_id, n_bytes, None, None, None, None, None, None, "no media", None)
        own = (len(media), hashlib.sha256(media).hexdigest())
        try:
            got = decode(media)
        except ValueError as e:
            return (doc_id, n_bytes, None, None, None, *own, None, str(e), None)
        p = got["payload"]
        return (doc_id, n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), *own, got["feature"], None, p if keep_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [one(*x) for x in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def packet_times(df: DataFrame) -> DataFrame:
    """doc_id, stream, packet, start_s, end_s and n_bytes of every packet of the ``media`` column, timed by granule positions.

    Media that are null or fail a check have no rows here; decode_media says why.
    """
    names = ["doc_id", "stream", "packet", "start_s", "end_s", "n_bytes"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, media in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                try:
                    rows = [(doc_id, *p) for p in decode(media)["packets"]] if media is not None else []
                except ValueError:
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.select("doc_id", "media").mapInArrow(run, "doc_id long, stream string, packet long, start_s double, end_s double, n_bytes long")


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an Ogg stream and read back from the stored bytes."""
    return decode_media(encode_media(table(spark, sf_dir, "documents"))).drop("payload", "error")
