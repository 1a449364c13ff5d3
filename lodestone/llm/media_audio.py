"""MPEG audio as a media column: a writer that carries any payload, and a tolerant reader.

The reader takes the text fields of ID3v2 tags and of an ID3v1 tag where frames or junk end; after junk it takes a
header again if the next one agrees or its CRC does. It reads Xing/Info and VBRI tables with their seek points and the
encoder's delay and padding, checks the CRC of protected frames of layers I and III (not of layer II, whose CRC covers
a length that its allocation tables give), and returns the exact duration as samples over rate, less delay and
padding, and one seek offset per frame. The writer makes MPEG-1 layer III
mono frames of silence whose ancillary bytes hold the payload, each protected by its CRC, at the smallest
bitrate that fits, behind an ID3v2 tag (with the payload's length) and a Xing frame with a 100-entry seek table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the MPEG audio header: kbit/s by (version 1?, layer) and index 1 to 14, Hz by version and index.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
#: Bytes from a frame's start to its ancillary bytes: header, CRC and the side information of one channel.
BODY = 4 + 2 + 17
UNIT = 64

PROBE = "struct<payload:binary,payload_bytes:bigint,frames:bigint,bad_crc:bigint,junk_bytes:bigint,samples:bigint,rate:int,duration_us:bigint,vbr:string,tag_bytes:bigint,frame_offsets:array<bigint>,seek_ok:boolean,skipped_samples:bigint,tags:map<string,string>>"


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1) ^ 0x8005 if r & 0x8000 else r << 1
        table.append(r & 0xFFFF)
    return table


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The CRC of a protected frame: polynomial 0x8005, from 0xFFFF, over half the header and the side information."""
    r = 0xFFFF
    for byte in data:
        r = ((r << 8) & 0xFFFF) ^ _CRC[(r >> 8) ^ byte]
    return r


@lru_cache(4096)
def header(head: bytes) -> tuple[int, int, int, int, bool, int] | None:
    """(frame bytes, samples, rate, side information bytes, protected, layer) of four header bytes, or None."""
    word = int.from_bytes(head, "big")
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate_index, bit_index = word >> 10 & 3, word >> 12 & 15
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate_index == 3 or bit_index in (0, 15) or word & 3 == 2:
        return None
    first = version == 3
    rate, kbits = RATES[version][rate_index], BITRATES[first, layer][bit_index - 1]
    pad, mono = word >> 9 & 1, word >> 6 & 3 == 3
    samples = SAMPLES[first, layer]
    size = (12000 * kbits // rate + pad) * 4 if layer == 1 else samples * 125 * kbits // rate + pad
    side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else (16 if mono else 32) if layer == 1 else 0
    return size, samples, rate, side, not word >> 16 & 1, layer


def _same_stream(a: bytes, b: bytes) -> bool:
    """Whether two headers agree in version, layer and rate."""
    return a[1] & 0xFE == b[1] & 0xFE and a[2] & 0x0C == b[2] & 0x0C


def _crc_holds(raw: bytes, at: int, side: int) -> bool:
    return crc16(raw[at + 2 : at + 4] + raw[at + 6 : at + 6 + side]) == int.from_bytes(raw[at + 4 : at + 6], "big")


@lru_cache(32)
def _frame_head(index: int) -> tuple[bytes, int]:
    """Header, CRC and empty side information of a protected mono frame at 32 kHz, and its size."""
    head = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))
    side = bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, header(head)[0]


def _frame(data: bytes) -> bytes:
    for index in range(1, 15):
        start, size = _frame_head(index)
        if size - BODY >= len(data):
            break
    return start + data.ljust(size - BODY, b"\0")


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsyncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes appended, to a positive multiple of ``unit``."""
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b"\0")


def write_mpeg(payload: bytes) -> bytes:
    """A stream whose ancillary bytes are ``payload``; equal payloads make equal bytes."""
    room = _frame_head(14)[1] - BODY
    frames = [_frame(payload[i : i + room]) for i in range(0, len(payload), room)]
    text = b"\0payload\0%d" % len(payload)
    tag_frame = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + _syncsafe(len(tag_frame)) + tag_frame
    xing_size = _frame_head(1)[1]  # the smallest frame holds the table
    audio = xing_size + sum(map(len, frames))
    ends, at = [], xing_size
    for f in frames:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * ends[min(len(ends) - 1, p * len(ends) // 100)] // audio) for p in range(100)) if ends else bytes(100)
    xing = _frame(b"Xing" + struct.pack(">III", 7, len(frames), audio) + toc)
    return tag + xing + b"".join(frames)


_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def id3v2_fields(tag: bytes) -> dict[str, str]:
    """The text frames of an ID3v2.3 or 2.4 tag by their four letters, own ones (TXXX) by their description."""
    out, at, end = {}, 10, 10 + _unsyncsafe(tag[6:10])
    if tag[5] & 0x40:  # an extended header
        at += _unsyncsafe(tag[10:14]) if tag[3] == 4 else 4 + int.from_bytes(tag[10:14], "big")
    while at + 10 <= min(end, len(tag)) and tag[at : at + 4].strip(b"\0"):
        name, size = tag[at : at + 4], _unsyncsafe(tag[at + 4 : at + 8]) if tag[3] == 4 else int.from_bytes(tag[at + 4 : at + 8], "big")
        body = tag[at + 10 : at + 10 + size]
        if name[:1] == b"T" and body and body[0] < 4:
            text = body[1:].decode(_ENCODINGS[body[0]], "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == b"TXXX" else (name.decode("latin-1"), "", text)
            out.setdefault(key.lstrip("\ufeff"), value.lstrip("\ufeff"))
        at += 10 + size
    return out


def id3v1_fields(tag: bytes) -> dict[str, str]:
    """Title, artist, album and year of the 128 bytes of an ID3v1 tag, under the names that ID3v2 gives them."""
    places = {"TIT2": (3, 33), "TPE1": (33, 63), "TALB": (63, 93), "TYER": (93, 97)}
    got = {k: tag[a:b].split(b"\0")[0].decode("latin-1").strip() for k, (a, b) in places.items()}
    return {k: v for k, v in got.items() if v}


_SYNC = re.compile(rb"\xff[\xe0-\xff]", re.S)


def read_mpeg(raw: bytes) -> dict:
    """What PROBE says. Damaged or foreign bytes never raise: they are counted as junk, and absent parts are zero."""
    at, end, tags, length, fields, skipped = 0, len(raw), 0, None, {}, 0
    while raw[at : at + 3] == b"ID3" and end - at >= 10:
        size = 10 + _unsyncsafe(raw[at + 6 : at + 10]) + (10 if raw[at + 5] & 0x10 else 0)
        if m := re.search(rb"TXXX.{6}\0payload\0(\d+)", raw[at : at + size], re.S):
            length = int(m[1])
        fields = id3v2_fields(raw[at : at + size]) | fields
        at, tags = min(end, at + size), tags + size
    # a tag only where no frame holds its place: a payload may have these letters there
    tag = end - 128 if end - at >= 128 and raw[end - 128 : end - 125] == b"TAG" else end
    lost = True
    offsets, data, junk, bad, samples, rate, vbr, table, last, audio_at, points, step, scale = [], [], 0, 0, 0, 0, "", None, b"", at, [], 0, 0
    while at + 4 <= end:
        head = raw[at : at + 4]
        h = header(head)
        ok = h is not None and at + h[0] <= end and (not last or _same_stream(last, head))
        if ok and lost and at + h[0] != tag and at + h[0] + 4 <= end:  # the first header, also after junk, needs one like it next or its CRC
            after = raw[at + h[0] : at + h[0] + 4]
            ok = header(after) is not None and _same_stream(head, after) or h[4] and h[5] != 2 and _crc_holds(raw, at, h[3])
        if not ok:
            if at == tag:
                fields = id3v1_fields(raw[tag:end]) | fields
                end, tags = tag, tags + 128
                break
            lost = True
            m = _SYNC.search(raw, at + 1, end)
            step = min(m.start() if m else end, tag if at < tag else end) - at
            junk += step
            at += step
            continue
        size, n, rate, side, protected, layer = h
        lost = False
        if protected and layer != 2 and not _crc_holds(raw, at, side):
            bad += 1
        body = at + 4 + 2 * protected + side
        first = at + 36 if raw[at + 36 : at + 40] == b"VBRI" else body  # 32 bytes behind the header, whatever the side information
        if not last and raw[first : first + 4] in (b"Xing", b"Info", b"VBRI"):
            body = first
            vbr = raw[body : body + 4].decode()
            if vbr == "VBRI":
                number = lambda p, n: int.from_bytes(raw[body + p : body + p + n], "big")  # noqa: B023, E731
                entries, scale, width, step = number(18, 2), number(20, 2), number(22, 2), number(24, 2)
                points = [number(26 + width * k, width) * scale for k in range(entries)] if 1 <= width <= 4 and step else []
                table = (number(14, 4), number(10, 4), b"")
            else:
                flags, p, got = int.from_bytes(raw[body + 4 : body + 8], "big"), body + 8, [None, None]
                for k in (0, 1):
                    if flags >> k & 1:
                        got[k], p = int.from_bytes(raw[p : p + 4], "big"), p + 4
                table = (*got, raw[p : p + 100] if flags & 4 else b"")
                p += 100 * bool(flags & 4) + 4 * bool(flags & 8)
                if raw[p : p + 4] in (b"LAME", b"Lavf", b"Lavc"):  # the encoder's own block
                    gap = int.from_bytes(raw[p + 21 : p + 24], "big")
                    skipped = (gap >> 12) + (gap & 0xFFF)
        else:
            offsets.append(at)
            data.append(raw[body : at + size])
            samples += n
        last, at = head, at + size
    junk += end - at
    payload = b"".join(data)
    audio = end - audio_at
    seek_ok = table is not None and table[0] == len(offsets) and table[1] == audio
    if seek_ok and len(table[2]) == 100 and offsets:
        seek_ok = all(abs(t - 256 * (offsets[p * len(offsets) // 100] - audio_at) // audio) <= 1 for p, t in enumerate(table[2]))
    if seek_ok and points and offsets:
        # each point is the bytes of ``step`` frames; together they lead to the frames' places
        reached, places = 0, [*offsets, end]
        for k, size in enumerate(points, 1):
            reached += size
            seek_ok = seek_ok and abs(reached - (places[min(len(offsets), k * step)] - offsets[0])) <= scale * k
    payload = payload[:length] if length is not None else payload
    skipped = min(skipped, samples)
    return {"payload": payload, "payload_bytes": len(payload), "frames": len(offsets), "bad_crc": bad, "junk_bytes": junk, "samples": samples, "rate": rate, "duration_us": (samples - skipped) * 1_000_000 // rate if rate else 0, "vbr": vbr, "tag_bytes": tags, "frame_offsets": offsets, "seek_ok": seek_ok, "skipped_samples": skipped, "tags": fields}


def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([write_mpeg(padded((t or "").encode())) for t in texts], dtype=object)


_PROBED = "payload payload_bytes frames bad_crc junk_bytes samples rate duration_us vbr tag_bytes frame_offsets seek_ok skipped_samples tags".split()


def _probe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for media in batches:
        yield pd.DataFrame([read_mpeg(m or b"") for m in media], columns=_PROBED)


_DIGEST = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,feature:string,duration_us:bigint,frame_offsets:array<bigint>>"


def _digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for media in batches:
        rows = []
        for m in media:
            r = read_mpeg(m or b"")
            seek = zlib.crc32(struct.pack(f"<{len(r['frame_offsets'])}Q", *r["frame_offsets"]))
            feature = f"{r['vbr'] or 'CBR'};frames={r['frames']};bad_crc={r['bad_crc']};junk={r['junk_bytes']};samples={r['samples']}/{r['rate']};tags={r['tag_bytes']};table={'ok' if r['seek_ok'] else 'bad'};seek={seek:08x}"
            rows.append((r["payload_bytes"], hashlib.sha256(r["payload"]).hexdigest(), zlib.crc32(r["payload"][-UNIT:]), feature, r["duration_us"], r["frame_offsets"]))
        yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature", "duration_us", "frame_offsets"])


def to_mpeg(text: Column) -> Column:
    """A text (null: empty) as MPEG audio that carries its padded UTF-8 bytes."""
    return F.pandas_udf(_encode, "binary")(text)


def probe_mpeg(media: Column) -> Column:
    """PROBE of a binary column; null or foreign bytes give no frames."""
    return F.pandas_udf(_probe, PROBE)(media)


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its text as a media column, and what the stored bytes give when read back.

    Works row by row: nulls count as empty texts, repeated rows give repeated results, an empty table none;
    other columns of ``df``, whatever their names, are not read. ``media`` is stored in the result's rows only
    as length and hash; use to_mpeg for the column itself.
    """
    stored = df.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_bytes"), to_mpeg(F.col(text_col)).alias("media"))
    read = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.pandas_udf(_digest, _DIGEST)("media").alias("r"))
    return read.select("doc_id", "n_bytes", "r.payload_bytes", "r.payload_sha256", "r.tail_crc32", "media_bytes", "media_sha256", "r.feature", "r.duration_us", "r.frame_offsets")
