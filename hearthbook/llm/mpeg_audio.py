"""MPEG audio media columns: MPEG-1 Layer III streams that carry bytes, and a reader of MPEG audio.

The writer makes an ID3v2.4 tag (with the payload's length), a Xing frame with
frame count, byte count and seek table, and CRC-protected 48 kHz mono frames of
silence whose ancillary bytes hold the payload; the last frame has the smallest
bitrate that fits, so the stream is variable-bitrate.

The reader knows MPEG-1, 2 and 2.5 in Layers I, II and III.  It parses ID3v2 and
ID3v1 tags, resynchronises on frame headers (a header counts if another of the
same kind, or the end, follows it), reads Xing, Info and VBRI tables with their
seek points, verifies the CRCs of all layers (Layer II's covers a part whose
length follows from its allocations), and gives the exact duration as samples
over rate and each frame's byte offset for seeking.
A Layer III frame whose CRC fails gives zeros in place of its payload.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthbook.llm import _text

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by header index for each version and layer (2 and 2.5 share theirs), Hz by header index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
# Versions by header bits, samples a frame by layer (version 1; Layer III has half as many in 2 and 2.5), bytes of Layer III's side information (mono, stereo).
VERSIONS, SAMPLES_OF, SIDE = {3: 1, 2: 2, 0: 2.5}, {1: 384, 2: 1152, 3: 1152}, {1: (17, 32), 2: (9, 17), 2.5: (9, 17)}
# Layer II's allocation tables, as (bits of an allocation, number of subbands) from the lowest subband up.
WIDTHS = {
    "a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)),
    "lower rates": ((4, 4), (3, 7), (2, 19)),
}
BITRATES, SAMPLES, SIDE_MONO = KBITS[1, 3], 1152, 17
BLOCK = 64
_CRC = []
for _byte in range(256):
    _value = _byte << 8
    for _ in range(8):
        _value = (_value << 1 ^ 0x8005 if _value & 0x8000 else _value << 1) & 0xFFFF
    _CRC.append(_value)


def crc16(data: bytes, bits: int | None = None) -> int:
    """MPEG's CRC of the first bits, by default all: polynomial 0x8005, from 0xFFFF, high bit first."""
    whole, rest = divmod(8 * len(data) if bits is None else bits, 8)
    value = 0xFFFF
    for byte in data[:whole]:
        value = (value << 8 ^ _CRC[value >> 8 ^ byte]) & 0xFFFF
    for k in range(rest):
        top = value >> 15 ^ data[whole] >> 7 - k & 1
        value = (value << 1 ^ 0x8005 * top) & 0xFFFF
    return value


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _frame_header(kbits: int, protected: bool) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, BITRATES.index(kbits) << 4 | 1 << 2, 0xC0])


def _frame_start(kbits: int) -> bytes:
    """Header, CRC and silent side information of a 48 kHz mono frame, 3 bytes a kbit/s long."""
    head, side = _frame_header(kbits, True), bytes(SIDE_MONO)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_STARTS = {k: _frame_start(k) for k in BITRATES[1:]}
_LEAD = len(_STARTS[320])
_ROOM = 960 - _LEAD


def padded(text: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def encode(payload: bytes) -> bytes:
    """The stream that carries the payload."""
    full, rest = divmod(len(payload), _ROOM)
    frames = np.empty((full, 960), dtype=np.uint8)
    frames[:, :_LEAD] = np.frombuffer(_STARTS[320], np.uint8)
    frames[:, _LEAD:] = np.frombuffer(payload, np.uint8)[: full * _ROOM].reshape(full, _ROOM)
    audio = frames.tobytes()
    sizes = [960] * full
    if rest:
        kbits = next(k for k in BITRATES[1:] if 3 * k - _LEAD >= rest)
        audio += (_STARTS[kbits] + payload[full * _ROOM :]).ljust(3 * kbits, b"\0")
        sizes.append(3 * kbits)
    total = 192 + len(audio)
    starts = np.concatenate([[192], 192 + np.cumsum(sizes)])[: len(sizes)]
    seek = bytes(min(255, int(starts[k * len(sizes) // 100]) * 256 // total) for k in range(100)) if sizes else bytes(100)
    xing = _frame_header(64, False) + bytes(SIDE_MONO) + b"Xing" + (7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + xing.ljust(192, b"\0") + audio


class Frame(NamedTuple):
    """What a frame's header says; side is the length of what the CRC covers after it (0 in Layer II, see ``_layer2_sound``), body where the rest starts."""

    version: float
    layer: int
    size: int
    rate: int
    samples: int
    protected: bool
    side: int
    body: int


@lru_cache(maxsize=4096)
def _described(head: bytes) -> Frame | None:
    """The frame of a header's four bytes, None if they are none."""
    version, layer = VERSIONS.get(head[1] >> 3 & 3), 4 - (head[1] >> 1 & 3)
    index, rate = head[2] >> 4, head[2] >> 2 & 3
    if head[0] != 0xFF or head[1] < 0xE0 or version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbits, hertz, padding = KBITS[min(2, int(version)), layer][index], RATES[version][rate], head[2] >> 1 & 1
    samples = SAMPLES_OF[layer] // (2 if layer == 3 and version > 1 else 1)
    size = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padding
    mono, protected = head[3] >> 6 == 3, head[1] & 1 == 0
    if layer == 3:
        side = SIDE[version][not mono]
    elif layer == 1:  # four bits an allocation: of one channel, of both, or of both up to the bound and then shared
        bound = 4 * ((head[3] >> 4 & 3) + 1) if head[3] >> 6 == 1 else 32
        side = 16 if mono else (32 + bound) // 2
    else:
        side = 0
    return Frame(version, layer, size, hertz, samples, protected, side, 4 + 2 * protected + side)


@lru_cache(maxsize=4096)
def _allocations(head: bytes) -> tuple[tuple[int, int], ...]:
    """(bits, channels that share them) of each allocation of a Layer II frame, in stored order."""
    version, mode = VERSIONS[head[1] >> 3 & 3], head[3] >> 6
    channels = 1 if mode == 3 else 2
    kbits, hertz = KBITS[min(2, int(version)), 2][head[2] >> 4] // channels, RATES[version][head[2] >> 2 & 3]
    if version > 1:
        table = "lower rates"
    elif kbits <= 48:
        table = "d" if hertz == 32000 else "c"
    else:
        table = "a" if kbits <= 80 or hertz == 48000 else "b"
    widths = [bits for bits, bands in WIDTHS[table] for _ in range(bands)]
    # joint stereo stores one allocation for both channels from its bound on
    bound = 4 * ((head[3] >> 4 & 3) + 1) if mode == 1 else len(widths)
    return tuple(one for band, bits in enumerate(widths) for one in ([(bits, 1)] * channels if band < bound else [(bits, channels)]))


def _layer2_sound(frame: bytes) -> bool:
    """Whether a protected Layer II frame's CRC holds.

    It covers the header's last 16 bits, the allocations, and the two bits that choose
    the scale factors of each channel of a subband that is allocated any.
    """
    stored = frame[6:70].ljust(64, b"\0")  # at most 188 bits of allocations and 120 of choices
    number, at, chosen = int.from_bytes(stored, "big"), 0, 0
    for bits, channels in _allocations(frame[:4]):
        at += bits
        if number >> 512 - at & (1 << bits) - 1:
            chosen += 2 * channels
    return crc16(frame[2:4] + stored, 16 + at + chosen) == int.from_bytes(frame[4:6], "big")


def _frame(data: bytes, at: int) -> Frame | None:
    return _described(data[at : at + 4]) if at + 4 <= len(data) and data[at] == 0xFF else None


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(texts by name, start, end) of what stands between an ID3v2 and an ID3v1 tag."""
    tags, start, end = {}, 0, len(data)
    length = lambda b, by: sum(x << by * (3 - k) for k, x in enumerate(b))
    if data[:3] == b"ID3" and len(data) >= 10:
        start = min(len(data), 10 + length(data[6:10], 7))
        k = 10
        while k + 10 <= start and data[k : k + 4].strip(b"\0"):
            size = length(data[k + 4 : k + 8], 7 if data[3] >= 4 else 8)
            name, coding, text = data[k : k + 4], data[k + 10 : k + 11], data[k + 11 : min(start, k + 10 + size)]
            if name[:1] == b"T":
                text = text.decode({b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be"}.get(coding, "utf-8"), "replace")
                name, text = (text.partition("\0")[::2] if name == b"TXXX" else (name.decode("latin-1"), text))
                tags[name] = text.rstrip("\0")
            k += 10 + size
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + b].rstrip(b" \0").decode("latin-1"):
                tags.setdefault(name, text)
    return tags, start, end


def _table(data: bytes, at: int, frame: Frame) -> dict | None:
    """A Xing, Info or VBRI table in a frame: its kind, frames, bytes and the byte offsets of its seek points."""
    number = lambda k, size=4: int.from_bytes(data[k : k + size], "big")
    k = at + 4 + frame.side
    if data[k : k + 4] in (b"Xing", b"Info"):
        flags, out = number(k + 4), {"kind": data[k : k + 4].decode().lower(), "frames": None, "bytes": None, "seek": None}
        k += 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], k = number(k), k + 4
        if flags & 4 and out["bytes"] is not None and k + 100 <= at + frame.size:
            out["seek"] = [b * out["bytes"] // 256 for b in data[k : k + 100]]
        return out
    k = at + 36
    if data[k : k + 4] == b"VBRI":
        entries, scale, width = number(k + 18, 2), number(k + 20, 2), number(k + 22, 2)
        steps = [scale * number(k + 26 + width * e, width) for e in range(entries) if k + 26 + width * (e + 1) <= at + frame.size]
        return {"kind": "vbri", "frames": number(k + 14), "bytes": number(k + 10), "seek": [0, *np.cumsum(steps).tolist()]}
    return None


def decode(data: bytes) -> dict:
    """What a stream holds; bytes that are no stream give no frames.

    Keys: payload, version, layer, sample_rate, frames, samples, offsets (of the
    audio frames), crc_checked, crc_failed, resyncs (gaps skipped), table (of the
    first frame: kind, frames, bytes, seek) and tags.
    """
    tags, at, stop = _tags(data)
    out = {"payload": b"", "version": None, "layer": None, "sample_rate": 0, "frames": 0, "samples": 0, "offsets": [], "crc_checked": 0, "crc_failed": 0, "resyncs": 0, "table": None, "tags": tags}
    data = data[:stop]
    parts, seen, lost = [], {}, False
    while at < stop:
        frame = _frame(data, at)
        # a header is believed if a header of the same kind, or the end, follows its frame
        if frame and at + frame.size < stop:
            after = _frame(data, at + frame.size)
            frame = frame if after and (after.version, after.layer, after.rate) == (frame.version, frame.layer, frame.rate) else None
        if frame is None or at + frame.size > stop:
            at = data.find(b"\xff", at + 1)
            lost = True
            if at < 0:
                break
            continue
        out["resyncs"] += lost
        lost = False
        if not out["frames"] and out["table"] is None and frame.layer == 3 and (table := _table(data, at, frame)):
            out["table"] = table
        else:
            sound = True
            if frame.protected:
                lead = data[at + 2 : at + frame.body]
                sound = _layer2_sound(data[at : at + frame.size]) if frame.layer == 2 else seen.get(lead)
                if sound is None:
                    sound = seen[lead] = crc16(lead[:2] + lead[4:]) == int.from_bytes(lead[2:4], "big")
                out["crc_checked"] += 1
                out["crc_failed"] += not sound
            out["offsets"].append(at)
            out["frames"] += 1
            out["samples"] += frame.samples
            out["version"], out["layer"], out["sample_rate"] = frame.version, frame.layer, frame.rate
            if frame.layer == 3:
                parts.append(data[at + frame.body : at + frame.size] if sound else bytes(max(0, frame.size - frame.body)))
        at += frame.size
    out["payload"] = b"".join(parts)
    if (length := tags.get("payload_bytes", "")).isdigit():
        out["payload"] = out["payload"][: int(length)]
    return out


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, media: every text as a stream.

    Null counts as empty, which is 64 bytes of payload.  Repeated rows and doc_ids come
    back as often as they occur, null doc_ids too; equal texts give equal streams.  A text
    of any length is one stream, made whole in one task.  Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in _text.passes(whole, "text"):
                data, at = _text.utf8(batch.column("text"))
                media = [encode(padded(data[a:b].tobytes())) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def inspect(stored: DataFrame, payload: bool = False) -> DataFrame:
    """stored (media, ...) plus what decode finds: format, duration as samples and sample_rate (in seconds too), frame_offsets, checks, tables, tags, payload digests.

    Null media is an empty stream, whose duration is 0.  With payload, the carried
    bytes come too.  Columns of the names added are replaced, others are kept.
    """
    found = (
        "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, version double, layer int, frames long, samples long, sample_rate int, duration double, "
        "crc_checked long, crc_failed long, resyncs long, table_kind string, table_frames long, table_bytes long, seek_offsets array<long>, frame_offsets array<long>, tags map<string,string>"
    )
    added = [f.split()[0] for f in found.split(", ")]
    names = [c for c in stored.columns if c not in ("media", "payload", *added)]
    kinds = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in names)
    types = [
        pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64(),
        pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()),
    ]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, held = [], []
                for media in part.column("media"):
                    media = media.as_buffer().to_pybytes() if media.is_valid else b""
                    d = decode(media)
                    p = d["payload"]
                    held.append(p)
                    table = d["table"] or dict.fromkeys(("kind", "frames", "bytes", "seek"))
                    rows.append((
                        len(media), hashlib.sha256(media).hexdigest(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), d["version"], d["layer"], d["frames"], d["samples"], d["sample_rate"],
                        d["samples"] / d["sample_rate"] if d["sample_rate"] else 0.0, d["crc_checked"], d["crc_failed"], d["resyncs"], *table.values(), d["offsets"], list(d["tags"].items()),
                    ))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                more = [pa.array(held, pa.binary())] if payload else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns, *more], [*names, *added, *["payload"] * payload])

    return stored.mapInArrow(run, f"{kinds}, {found}" + ", payload binary" * payload)


def feature():
    """One string of what the stream's reader found."""
    return F.concat_ws(
        ";", F.lit("mpeg1-layer3"), F.concat(F.col("sample_rate"), F.lit("Hz")), F.concat(F.lit("samples="), F.col("samples")), F.concat(F.lit("frames="), F.col("frames")),
        F.concat(F.lit("vbr="), F.coalesce(F.col("table_frames").cast("string"), F.lit("none"))), F.concat(F.lit("crc="), F.col("crc_checked") - F.col("crc_failed"), F.lit("/"), F.col("crc_checked")),
        F.concat(F.lit("last="), F.coalesce(F.element_at(F.col("frame_offsets"), F.lit(-1)).cast("string"), F.lit("none"))),
    )
