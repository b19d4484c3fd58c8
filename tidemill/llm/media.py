"""Media columns: bytes kept in MPEG audio frames, and a reader of such streams.

``encode`` wraps a payload in a stream of MPEG-1 Layer III frames: an ID3v2 tag, an Info frame with the table for
seeking, then frames of silence whose ancillary data hold 576 payload bytes each, every header guarded by its CRC-16.
``probe`` reads any such stream: it skips tags, finds frame headers, resynchronises after damage, parses the
variable-bitrate table, verifies checksums and returns the exact duration and the seek offset of each frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_arrow

UNIT = 576
# Fixed values of the MPEG audio format: kbit/s by header index, Hz by header index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Fixed values of Layer II: bits of the allocation of each subband, by how much a channel may use; the last is MPEG-2's.
ALLOCATIONS = {"a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4,) * 2 + (3,) * 6, "d": (4,) * 2 + (3,) * 10, "2": (4,) * 4 + (3,) * 7 + (2,) * 19}
# Fixed values of ID3v2: encodings of text by their first byte.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
#: 224 kbit/s at 48 kHz, stereo, with a CRC: 672 bytes a frame, of which 4 + 2 + 32 come before the ancillary data.
HEADER = bytes([0xFF, 0xFA, 0xC4, 0x00])
FRAME, SIDE = 672, 32


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The CRC of MPEG audio over the first ``bits`` of ``data``: polynomial 0x8005, start 0xFFFF, no reflection."""
    crc = 0xFFFF
    for i in range(8 * len(data) if bits is None else bits):
        top = crc >> 15 ^ data[i >> 3] >> (7 - (i & 7)) & 1
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if top else crc << 1 & 0xFFFF
    return crc


@lru_cache(4096)
def header(h: bytes) -> tuple | None:
    """(frame bytes, samples, Hz, bit/s, side bytes, has CRC, version bits, layer, channels), or None if it is none. A frame of
    free format has no bytes and bit/s of its own."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hertz = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer == 4 or rate == 15 or hertz == 3:
        return None
    kbits, hz, pad, mono = KBITS[1 if version == 3 else 2, layer][rate], HERTZ[version][hertz], h[2] >> 1 & 1, h[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    pad *= 1 if rate else 0
    size = (12000 * kbits // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return size, samples, hz, kbits * 1000, side, not h[1] & 1, version, layer, 1 if mono else 2


def guarded_bits(frame: bytes, h: tuple) -> int:
    """How many bits after header and CRC the CRC covers: Layer III's side information, Layer I's allocations, Layer II's
    allocations and which scale factors follow."""
    channels, mode, extension = h[8], frame[3] >> 6, frame[3] >> 4 & 3
    if h[7] == 3:
        return 8 * h[4]
    bound = 4 * (extension + 1) if mode == 1 else 32
    if h[7] == 1:
        return 4 * (32 + (bound if channels == 2 else 0))
    rate, hz = h[3] // channels // 1000, h[2]
    name = "2" if h[6] != 3 else ("d" if hz == 32000 else "c") if rate <= 48 else "a" if hz == 48000 or rate <= 80 else "b"
    bits, at, used = int.from_bytes(frame[6:], "big"), 0, 0
    n = 8 * (len(frame) - 6)
    for k, wide in enumerate(ALLOCATIONS[name]):
        for _ in range(channels if k < bound else 1):
            if at + wide > n:
                return n
            used += bool(bits >> (n - at - wide) & ((1 << wide) - 1)) * (1 if k < bound else channels)
            at += wide
    return at + 2 * used


def guarded(side: bytes) -> bytes:
    return HEADER + struct.pack(">H", crc16(HEADER[2:] + side)) + side


PLAIN = guarded(bytes(SIDE))


def tag(frames: dict[str, str]) -> bytes:
    """An ID3v2.4 tag of text frames in UTF-8."""
    sync = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    body = b"".join(k.encode() + sync(len(v.encode()) + 1) + b"\0\0\x03" + v.encode() for k, v in frames.items())
    return b"ID3\x04\0\0" + sync(len(body)) + body


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def wrap(payload: bytes) -> bytes:
    """The stream that holds ``payload``, a positive multiple of 576 bytes."""
    n = len(payload) // UNIT
    front = tag({"TENC": "tidemill", "TLEN": str(n * 24)})
    toc = bytes(256 * (1 + i * n // 100) // (n + 1) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    rest = bytes(FRAME - len(PLAIN) - UNIT)
    parts = [front, PLAIN + info + bytes(FRAME - len(PLAIN) - len(info))]
    for i in range(n):
        parts += (PLAIN, payload[i * UNIT : (i + 1) * UNIT], rest)
    return b"".join(parts)


#: Where a search for the next frame, tag or table may stop: the first bytes of a header that ``header`` takes, or a mark.
MARK = re.compile(
    b"\xff[\xe2-\xe7\xf2-\xf7\xfa-\xff][" + b"".join(re.escape(bytes([x])) for x in range(0xF0) if x >> 2 & 3 != 3) + b"]|ID3|APETAGEX|LYRICSBEGIN", re.DOTALL
)
#: No frame is longer, so the next header of a frame of free format is looked for so far.
LONGEST = 8192


def free_size(data: bytes, at: int, h: tuple) -> int:
    """Bytes, without padding, of the frame of free format at ``at``: up to the next header that is like it, if another such
    header or the end follows as far behind that one; 0 if there is none."""
    slot = 4 if h[7] == 1 else 1
    pad = lambda p: (data[p + 2] >> 1 & 1) * slot
    like = lambda p: (x := header(data[p : p + 4])) is not None and x[0] == 0 and (x[2], x[4:8]) == (h[2], h[4:8])
    p = at + 6 + h[4]
    while (p := data.find(data[at : at + 2], p, at + LONGEST)) > 0:
        if like(p):
            size = p - at - pad(at)
            after = p + size + pad(p)
            if after == len(data) or like(after):
                return size
        p += 1
    return 0


def sized(data: bytes, at: int, free: dict | None) -> tuple | None:
    """The header at ``at`` with its frame's bytes, or None; ``free`` remembers those of free formats, and is None where the
    stream is known to have none."""
    h = header(data[at : at + 4])
    if h is None or h[0]:
        return h
    if free is None:
        return None
    kind = (h[2], *h[4:8])
    if kind not in free:
        size = free_size(data, at, h)
        if not size:
            return None
        free[kind] = size
    size = free[kind] + (data[at + 2] >> 1 & 1) * (4 if h[7] == 1 else 1)
    return (size, h[1], h[2], 8 * size * h[2] // h[1], *h[4:])


def sound(data: bytes, at: int, free: dict | None, before: tuple | None) -> tuple | None:
    """The header at ``at`` if its frame is whole, and its CRC is right or, without one, it is like the frame just ``before``,
    or another header, a tag or the end follows."""
    h = sized(data, at, free)
    if not h or at + h[0] > len(data):
        return None
    if h[5]:
        if h[0] < 6 + h[4]:
            return None
        bits = guarded_bits(data[at : at + h[0]] if h[7] == 2 else data[at : at + 4], h)
        good = struct.unpack(">H", data[at + 4 : at + 6])[0] == crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + (bits + 7) // 8], 16 + bits)
        return h if good else None
    like = before is not None and (before[2], before[6:]) == (h[2], h[6:])
    return h if like or follows(data, at + h[0]) else None


def follows(data: bytes, end: int) -> bool:
    return end == len(data) or header(data[end : end + 4]) is not None or data[end : end + 3] in (b"TAG", b"ID3", b"APE", b"LYR")


def ape(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(where the APE tag whose header stands at ``at`` ends, its items of text); one that isn't whole ends where it begins."""
    size, items, flags = struct.unpack("<III", data[at + 12 : at + 24]) if data[at : at + 8] == b"APETAGEX" and at + 32 <= len(data) else (0, 0, 0)
    end = at + 32 + size
    if not flags >> 29 & 1 or end > len(data):
        return at, {}
    return end, ape_items(data, at + 32, end - (32 if not flags >> 30 & 1 else 0), items)


def ape_items(data: bytes, p: int, end: int, items: int) -> dict[str, str]:
    out = {}
    while items and p + 8 < end:
        size, flags = struct.unpack("<II", data[p : p + 8])
        stop = data.find(b"\0", p + 8, end)
        if stop < 0 or stop + 1 + size > end:
            break
        if flags >> 1 & 3 == 0:
            out["APE." + data[p + 8 : stop].decode("ascii", "replace")] = data[stop + 1 : stop + 1 + size].decode("utf-8", "replace").replace("\0", "/")
        p, items = stop + 1 + size, items - 1
    return out


def lyrics(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(where the Lyrics3 tag at ``at`` ends, its fields), of both versions; one that isn't whole ends where it begins."""
    if data[at : at + 11] != b"LYRICSBEGIN":
        return at, {}
    p, out = at + 11, {}
    while data[p : p + 3].isalnum() and data[p + 3 : p + 8].isdigit():
        size = int(data[p + 3 : p + 8])
        out["LYRICS." + data[p : p + 3].decode()] = data[p + 8 : p + 8 + size].decode("latin-1")
        p += 8 + size
    if data[p : p + 6].isdigit() and int(data[p : p + 6]) == p - at and data[p + 6 : p + 15] == b"LYRICS200":
        return p + 15, out
    end = data.find(b"LYRICSEND", at, at + 5120)  # the first version is no longer
    return (end + 9, {"LYRICS.LYR": data[at + 11 : end].decode("latin-1")}) if end > 0 else (at, {})


def id3v1(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    if data[at : at + 3] != b"TAG" or len(data) - at != 128:
        return at, {}
    fields = {"ID3v1" + name: data[at + lo : at + hi].split(b"\0")[0].decode("latin-1").rstrip() for name, lo, hi in (("", 3, 33), (".artist", 33, 63), (".album", 63, 93), (".year", 93, 97))}
    return len(data), {k: v for k, v in fields.items() if v}


def bare_ape(data: bytes) -> tuple[int, int, dict[str, str]]:
    """(begin, end, items) of an APE tag without a header, which only its footer at the end tells of; else an empty range."""
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    if data[max(0, end - 15) : end][-9:] == b"LYRICS200" and data[end - 15 : end - 9].isdigit():
        end -= 15 + int(data[end - 15 : end - 9])
    foot = end - 32
    if foot < 0 or data[foot : foot + 8] != b"APETAGEX":
        return 0, 0, {}
    size, items, flags = struct.unpack("<III", data[foot + 12 : foot + 24])
    at = end - size
    return (at, end, ape_items(data, at, foot, items)) if at >= 0 and size >= 32 and not flags >> 31 & 1 else (0, 0, {})


def synchsafe(x: bytes) -> int:
    return sum((b & 127) << s for b, s in zip(x, range(7 * len(x) - 7, -1, -7), strict=True))


def id3_text(body: bytes) -> str:
    """The text of a frame: its encoding, then one string or several, which are put together by slashes."""
    text = body[1:].decode(ENCODINGS[body[0]], "replace") if body and body[0] < 4 else ""
    return "/".join(x.lstrip("\ufeff") for x in text.rstrip("\0").split("\0"))


def id3(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(where the ID3v2 tag at ``at`` ends, its text frames), of versions 2.2, 2.3 and 2.4; no tag ends where it begins. Frames
    that are compressed or encrypted, and a tag of another version, are passed over."""
    if data[at : at + 3] != b"ID3" or at + 10 > len(data):
        return at, {}
    version, flags, tags = data[at + 3], data[at + 5], {}
    end = min(len(data), at + 10 + synchsafe(data[at + 6 : at + 10]) + (10 if version == 4 and flags & 16 else 0))
    body, p = data[at + 10 : end], 0
    if version < 4 and flags & 128:
        body = body.replace(b"\xff\0", b"\xff")
    if version > 2 and flags & 64:
        p = synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name, head = (3, 6) if version == 2 else (4, 10)
    while 2 <= version <= 4 and p + head <= len(body) and body[p : p + name].isalnum():
        size = synchsafe(body[p + 4 : p + 8]) if version == 4 else int.from_bytes(body[p + name : p + head - 2 * (version > 2)], "big")
        own, form = body[p + head : p + head + size], body[p + 9] if version > 2 else 0
        if version == 4:
            own = own[(form >> 6 & 1) + 4 * (form & 1) :]
            own = own.replace(b"\xff\0", b"\xff") if form & 2 or flags & 128 else own
        elif version == 3:
            own = own[form >> 5 & 1 :]
        if body[p] == 84 and not form & (0x0C if version == 4 else 0xC0):
            tags[body[p : p + name].decode("ascii", "replace")] = id3_text(own)
        p += head + size
    return end, tags


def seek_table(frame: bytes, h: tuple) -> dict | None:
    """What a first frame tells of the stream, or None if it is one of sound: a Xing or Info table (positions for each percent
    of the time, the samples that the encoder put before and after), or a VBRI table (bytes to each entry)."""
    side = 4 + 2 * h[5] + h[4]
    if h[7] == 3 and frame[side : side + 4] in (b"Info", b"Xing") and len(frame) >= side + 8:
        flags, p, out = struct.unpack(">I", frame[side + 4 : side + 8])[0], side + 8, {"kind": frame[side : side + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc"] = list(frame[p : p + 100])
            p += 100
        p += 4 * (flags >> 3 & 1)
        if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
            both = int.from_bytes(frame[p + 21 : p + 24], "big")
            out["before"], out["after"] = both >> 12, both & 4095
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, wide, each = struct.unpack(">IIHHHH", frame[46:62])
        steps = [scale * int.from_bytes(frame[62 + wide * i : 62 + wide * (i + 1)], "big") for i in range(min(entries, (len(frame) - 62) // max(1, wide)))]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "each": each, "table": [sum(steps[:i]) for i in range(len(steps))]}
    return None


def read(data: bytes) -> dict:
    """Frames and tags of ``data``. Bytes that belong to no frame or tag are counted as skipped; a frame whose CRC is wrong is
    counted as bad and left out. ``offsets`` are the places of the frames of sound in ``data``; ``samples`` is what these hold,
    less what the table in front says the encoder put before and after, in all and by rate (``lengths``); ``hz`` is the rate of
    the last. No frame at all gives zeros and empty lists. Time is linear in the bytes, whatever they are."""
    at, tags = id3(data, 0)
    vbr, end, offsets, payload, lengths, skipped, bad, checked, rates, first = {}, len(data), [], [], [], 0, 0, 0, set(), True
    free: dict | None = {}
    before: tuple | None = None
    bare = bare_ape(data)
    while at < end:
        h = sound(data, at, free, before)
        if h is None:
            before = None
            after, more = next(((x, y) for f in (id3, id3v1, ape, lyrics) for x, y in (f(data, at),) if x > at), (at, {}))
            if at == bare[0] < bare[1]:
                after, more = bare[1], bare[2]
            if after > at:
                tags, at = {**more, **tags}, after
                continue
            weak = sized(data, at, free)
            if weak and at + weak[0] <= end and follows(data, at + weak[0]):
                bad += 1
                at += weak[0]
                continue
            mark = MARK.search(data, at + 1)
            nxt = mark.start() if mark else end
            for place in (bare[0], end - 128 if data[-128:-125] == b"TAG" else 0):
                nxt = place if at < place < nxt else nxt
            skipped += nxt - at
            at = nxt
            continue
        frame = data[at : at + h[0]]
        vbr = seek_table(frame, h) or {} if first else vbr
        checked += h[5]
        if not (first and vbr):
            side = 4 + 2 * h[5] + h[4]
            payload.append(frame[side : side + UNIT])
            offsets.append(at)
            if not lengths or lengths[-1][0] != h[2]:
                lengths.append([h[2], 0])
            lengths[-1][1] += h[1]
            rates.add(h[3])
        first, before = False, h
        free = free or None  # a stream is of free format from its first frame on, or not at all
        at += h[0]
    for places, cut in ((lengths, vbr.get("before", 0)), (lengths[::-1], vbr.get("after", 0))):
        for x in places:
            gone = min(cut, x[1])
            x[1], cut = x[1] - gone, cut - gone
    return {
        "tags": tags, "vbr": vbr, "offsets": offsets, "samples": sum(n for _, n in lengths), "hz": lengths[-1][0] if lengths else 0, "lengths": lengths, "seconds": sum(n / hz for hz, n in lengths),
        "skipped": skipped, "bad": bad, "checked": checked, "rates": sorted(rates), "payload": b"".join(payload),
    }


def feature(r: dict) -> str:
    """A short text of what ``read`` found: counts, exact duration in samples, bit rates and a digest of all seek offsets."""
    offsets = hashlib.sha256(struct.pack(f"<{len(r['offsets'])}q", *r["offsets"])).hexdigest()[:16]
    length = "+".join(f"{n}/{hz}" for hz, n in r["lengths"]) or "0/0"
    return (
        f"frames={len(r['offsets'])};samples={length};bps={','.join(map(str, r['rates']))};crc={r['checked']}"
        f";bad={r['bad']};skipped={r['skipped']};vbr={r['vbr'].get('kind', '')}:{r['vbr'].get('frames', 0)};seek={offsets}"
    )


def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [x or b"" for x in b.column(1).to_pylist()]
        for lo in range(0, len(data), 64):
            part = data[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 64), pa.array(map(len, part), pa.int64()), pa.array([wrap(padded(x)) for x in part], pa.binary())], ["id", "n_bytes", "media"])


def probe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for media in b.column(2).to_pylist():
            r = read(media)
            p = r["payload"]
            out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(r), r["seconds"], r["offsets"], r["bad"], r["skipped"]))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        cols = [pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * len(kinds), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], PROBED)


PROBED = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "offsets", "bad", "skipped"]


def encode(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, media) of every row: its text, or binary, as an MPEG audio stream. Null counts as empty; equal texts give
    equal streams; repeated rows are each encoded; other columns, whatever their names, are not read. An empty table gives an
    empty one."""
    return map_arrow(df.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("data")), __name__, "encode_batches", f"id {dict(df.dtypes)[key]}, n_bytes long, media binary").withColumnRenamed("id", key)


def probe(media: DataFrame, key: str, column: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """What ``read`` finds in each stream, with the payload's length and digests: exact ``seconds``, and ``offsets`` of the
    frames of sound. A damaged stream gives what its sound frames hold, a null or empty one zeros; repeated rows are each
    read; other columns, whatever their names, are not. An empty table gives an empty one."""
    rows = media.select(F.col(key).alias("id"), F.col(n_bytes).alias("n_bytes"), F.coalesce(column, F.lit(b"")).alias("media"))
    schema = f"id {dict(media.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, offsets array<long>, bad long, skipped long"
    return map_arrow(rows, __name__, "probe_batches", schema).withColumnRenamed("id", key)
