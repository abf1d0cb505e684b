"""Media columns: signature sniffing, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass, at any
offset.  At each hit the format's validator walks its structure (chunks, segments,
blocks, checksums, stated lengths) and gives the exact extent, or refuses the hit.  A
declared type that differs from what stands at offset 0 is corrected; valid media at
other offsets are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.shared import map_rows, stored

UNKNOWN = "application/octet-stream"

#: Media type, magic bytes, and how far the magic lies from the start.
MAGIC = (
    ("audio/wav", b"WAVEfmt ", 8),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/bmp", b"BM", 0),
    ("application/pdf", b"%PDF-1.", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
    ("audio/ogg", b"OggS\x00\x02", 0),
    ("audio/flac", b"fLaC\x00", 0),
)


@dataclass(frozen=True)
class Found:
    """Valid media: type, where it lies, and what the validator read on its way."""

    kind: str
    start: int
    length: int
    about: dict = field(default_factory=dict)


def _wav(d: bytes, at: int) -> tuple[int, dict] | None:
    if d[at : at + 4] != b"RIFF" or d[at + 8 : at + 12] != b"WAVE" or at + 12 > len(d):
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d):
        return None
    pos, about = at + 12, {}
    while pos + 8 <= end:
        name, size = d[pos : pos + 4], struct.unpack_from("<I", d, pos + 4)[0]
        if pos + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            code, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", d, pos + 8)
            if not channels or align != channels * ((bits + 7) // 8) or per_second != rate * align:
                return None
            about |= {"format": code, "channels": channels, "rate": rate, "bits": bits}
        elif name == b"data":
            about |= {"data": pos + 8 - at, "size": size}
        pos += 8 + size + (size & 1)
    return (end - at, about) if {"bits", "data"} <= about.keys() and pos >= end else None


def _png(d: bytes, at: int) -> tuple[int, dict] | None:
    pos, about = at + 8, {}
    while pos + 12 <= len(d):
        size, name = struct.unpack_from(">I4s", d, pos)
        if pos + 12 + size > len(d) or zlib.crc32(d[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", d, pos + 8 + size)[0]:
            return None
        if (name == b"IHDR") != (not about):
            return None
        if name == b"IHDR":
            about = dict(zip(("width", "height"), struct.unpack_from(">II", d, pos + 8), strict=True))
        pos += 12 + size
        if name == b"IEND":
            return pos - at, about
    return None


def _blocks(d: bytes, pos: int) -> int | None:
    """Past a chain of length-prefixed blocks that ends with an empty one."""
    while pos < len(d):
        size = d[pos]
        pos += 1 + size
        if not size:
            return pos
    return None


def _gif(d: bytes, at: int) -> tuple[int, dict] | None:
    if at + 13 > len(d):
        return None
    width, height, flags = struct.unpack_from("<HHB", d, at + 6)
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos is not None and pos < len(d):
        mark = d[pos]
        if mark == 0x3B:
            return pos + 1 - at, {"width": width, "height": height}
        if mark == 0x21:
            pos = _blocks(d, pos + 2)
        elif mark == 0x2C and pos + 10 <= len(d):
            local = d[pos + 9]
            pos = _blocks(d, pos + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(d: bytes, at: int) -> tuple[int, dict] | None:
    pos, about = at + 2, {}
    while pos + 4 <= len(d) and d[pos] == 0xFF:
        mark = d[pos + 1]
        if mark == 0xD9:
            return (pos + 2 - at, about) if about else None
        size = struct.unpack_from(">H", d, pos + 2)[0]
        if size < 2 or pos + 2 + size > len(d):
            return None
        if mark in (0xC0, 0xC1, 0xC2) and size >= 8:
            about = dict(zip(("height", "width"), struct.unpack_from(">HH", d, pos + 5), strict=True))
        pos += 2 + size
        if mark == 0xDA:  # entropy-coded data runs to the next real marker
            while True:
                pos = d.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(d):
                    return None
                if d[pos + 1] == 0 or 0xD0 <= d[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
    if pos + 2 <= len(d) and d[pos : pos + 2] == b"\xff\xd9" and about:
        return pos + 2 - at, about
    return None


def _bmp(d: bytes, at: int) -> tuple[int, dict] | None:
    if at + 30 > len(d):
        return None
    size, spare, offset, header = struct.unpack_from("<IIII", d, at + 2)
    if spare or header not in (12, 40, 52, 56, 108, 124) or not 14 + header <= offset <= size or at + size > len(d):
        return None
    width, height = struct.unpack_from("<HH" if header == 12 else "<ii", d, at + 18)
    return (size, {"width": width, "height": abs(height)}) if width > 0 and height else None


def _pdf(d: bytes, at: int) -> tuple[int, dict] | None:
    end = d.find(b"%%EOF", at)
    if end < 0 or d.find(b"startxref", at, end) < 0:
        return None
    while 0 <= (more := d.find(b"%%EOF", end + 5)) and d.find(b"startxref", end, more) >= 0 and d.find(b"%PDF-", end, more) < 0:
        end = more
    return end + 5 - at, {"version": chr(d[at + 7])} if at + 7 < len(d) else {}


def _zip(d: bytes, at: int) -> tuple[int, dict] | None:
    end = d.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(d):
        files, size, offset, note = struct.unpack_from("<HIIH", d, end + 10)
        if at + offset + size == end and end + 22 + note <= len(d) and d[at + offset : at + offset + 4] == b"PK\x01\x02":
            return end + 22 + note - at, {"files": files}
        end = d.find(b"PK\x05\x06", end + 4)
    return None


def _gzip(d: bytes, at: int) -> tuple[int, dict] | None:
    unpack = zlib.decompressobj(31)
    size, pos = 0, at
    try:
        while pos < len(d) and not unpack.eof:
            size += len(unpack.decompress(unpack.unconsumed_tail or d[pos : pos + 65536], 1 << 20))
            pos += 0 if unpack.unconsumed_tail else 65536
    except zlib.error:
        return None
    return (min(pos, len(d)) - len(unpack.unused_data) - at, {"unpacked": size}) if unpack.eof else None


def _ogg(d: bytes, at: int) -> tuple[int, dict] | None:
    pos, pages, last = at, 0, False
    while not last and d[pos : pos + 5] == b"OggS\x00" and pos + 27 <= len(d):
        segments = d[pos + 26]
        size = 27 + segments + sum(d[pos + 27 : pos + 27 + segments])
        if pos + size > len(d):
            return None
        last = bool(d[pos + 5] & 4)
        pos, pages = pos + size, pages + 1
    return (pos - at, {"pages": pages}) if last else None


def _flac(d: bytes, at: int) -> tuple[int, dict] | None:
    pos, last, about = at + 4, False, {}
    while not last:
        if pos + 4 > len(d):
            return None
        last, kind, size = bool(d[pos] & 0x80), d[pos] & 0x7F, int.from_bytes(d[pos + 1 : pos + 4], "big")
        if (kind == 0) != (not about) or kind == 0 and size != 34 or pos + 4 + size > len(d):
            return None
        if kind == 0:
            about = {"rate": int.from_bytes(d[pos + 14 : pos + 17], "big") >> 4}
        pos += 4 + size
    # frames state no length: the stream runs to the end of the column
    return (len(d) - at, about) if d[pos : pos + 1] == b"\xff" else None


VALID: dict[str, Callable[[bytes, int], tuple[int, dict] | None]] = {
    "audio/wav": _wav,
    "image/png": _png,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "image/bmp": _bmp,
    "application/pdf": _pdf,
    "application/zip": _zip,
    "application/gzip": _gzip,
    "audio/ogg": _ogg,
    "audio/flac": _flac,
}


class Sniffer:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for kind, magic, before in MAGIC:
            self.automaton.add_word(magic.decode("latin-1"), (kind, len(magic) + before - 1))
        self.automaton.make_automaton()

    def find(self, data: bytes) -> list[Found]:
        """All valid media in order of their start, nested ones too."""
        out = []
        for end, (kind, back) in self.automaton.iter(data.decode("latin-1")):
            start = end - back
            if start >= 0 and (extent := VALID[kind](data, start)):
                out.append(Found(kind, start, *extent))
        return sorted(out, key=lambda f: (f.start, -f.length))


def corrected(declared: str | None, found: list[Found], size: int) -> str:
    """The type that holds: what stands at offset 0, if it is valid; a known type that is
    declared but not there becomes unknown; other declared types can't be judged."""
    whole = next((f.kind for f in found if f.start == 0), None)
    if whole:
        return whole
    return UNKNOWN if not declared or declared in VALID else declared


def sniff_media(df: DataFrame, data_col: str, id_col: str, declared_col: str | None = None) -> DataFrame:
    """Detect, correct and carve a binary column.

    Returns ``id, declared, media_type, corrected, embedded``; ``embedded`` lists the valid
    media at other offsets as ``kind, start, length, sha256``.  Null or empty data is of
    the unknown type and holds nothing.  Repeated rows and null identifiers pass through;
    an empty table gives an empty table; other columns are not read.
    """
    from pyspark.sql import functions as F

    def rows():
        sniffer = Sniffer()

        def apply(cols):
            out: dict[str, list] = {"id": cols["id"], "declared": cols["declared"], "media_type": [], "corrected": [], "embedded": []}
            for data, declared in zip(cols["data"], cols["declared"], strict=True):
                data = bytes(data or b"")
                found = sniffer.find(data)
                kind = corrected(declared, found, len(data))
                out["media_type"].append(kind)
                out["corrected"].append(kind != declared)
                inner = [f for f in found if f.start > 0]
                out["embedded"].append([{"kind": f.kind, "start": f.start, "length": f.length, "sha256": hashlib.sha256(data[f.start : f.start + f.length]).hexdigest()} for f in inner])
            return out

        return apply

    declared = df[declared_col].cast("string") if declared_col else F.lit(None).cast("string")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, declared string, media_type string, corrected boolean, embedded array<struct<kind:string,start:bigint,length:bigint,sha256:string>>"
    picked = df.select(df[id_col].alias("id"), df[data_col].alias("data"), declared.alias("declared"))
    return map_rows(picked, rows, schema).withColumnRenamed("id", id_col)


def padded(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """A text's bytes, filled with zeros to a positive multiple of ``unit``; its own size."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0"), len(raw)


def as_wav(samples: bytes, rate: int = 8_000) -> bytes:
    """Unsigned 8-bit mono samples in a WAV container."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + (len(samples) & 1), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) & 1)


def wav_samples(data: bytes, found: Found) -> bytes:
    at = found.start + found.about["data"]
    return data[at : at + found.about["size"]]


#: What a writer that knows nothing of its data says.
DECLARED = "application/octet-stream"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, declared, media``: each text as a media column, written to the shared
    folder.  The padded bytes are 8-bit samples of a WAV; the declared type is the one of
    unknown bytes, as stores often have it.  A null text is stored as 64 zeros; null
    identifiers, repeated rows and an empty table pass through; other columns are not read."""

    def rows():
        def apply(cols):
            made = [padded(t) for t in cols["text"]]
            return {"id": cols["id"], "n_bytes": [n for _, n in made], "declared": [DECLARED] * len(made), "media": [as_wav(p) for p, _ in made]}

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return stored(map_rows(picked, rows, f"id {kind}, n_bytes bigint, declared string, media binary"), "media", "zstd")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Store each text as a media column (:func:`store_texts`) and read it back from there
    through the sniffer, which finds and validates the WAV, corrects the declared type and
    gives the samples' place, from which they are carved.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature`` and, with ``with_media``, ``media`` itself.  A null text counts
    as empty and is stored as 64 zeros.  Equal texts give equal values; repeated rows and
    null identifiers pass through; an empty table gives an empty table.
    """

    def rows():
        sniffer = Sniffer()

        def apply(cols):
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            out: dict[str, list] = {"id": cols["id"], "n_bytes": cols["n_bytes"], "media": cols["media"]} | {n: [] for n in names}
            for media, declared in zip(cols["media"], cols["declared"], strict=True):
                found = sniffer.find(media)
                whole = next(f for f in found if f.start == 0 and f.kind == "audio/wav")
                back = wav_samples(media, whole)
                wave = np.frombuffer(back, np.uint8)
                inner = ",".join(f"{f.kind}@{f.start - whole.about['data']}+{f.length}" for f in found if f.start > 0)
                shown = f"{corrected(declared, found, len(media))};rate={whole.about['rate']};bits={whole.about['bits']};samples={len(back)}"
                shown += f";peak={int(wave.max())};sum={int(wave.sum(dtype=np.int64))};embedded={inner or 'none'}"
                made = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), shown)
                for name, value in zip(names, made, strict=True):
                    out[name].append(value)
            return out

        return apply

    kept = store_texts(docs, id_col, text_col)
    kind = kept.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    if with_media:
        schema += ", media binary"
    return map_rows(kept, rows, schema).withColumnRenamed("id", id_col)
