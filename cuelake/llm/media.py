"""Media columns: payloads stored as 8-bit media, told apart by their signatures and read back.

`store` writes texts as media blobs, `sniff` finds what a blob really is and what media lie inside it,
`carve` cuts those out, `features` reads the samples back. `stored_and_read` does all of it in one pass. Signatures are
located by an Aho-Corasick automaton over the whole blob, inside of media too; a hit counts only if its format's
validator follows the structure and lengths to the end.

Defined results: a null or empty blob has the type 'unknown' and nothing embedded; a blob that no single medium fills has
the type 'mixed' if any medium was found; of two media that overlap, and neither lies within the other, the left one
counts; samples are read from the first medium that is within no other, and are null where that is none, or a gif or
jpeg; extra columns pass through, but one that has the name of a result is replaced by it; repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import documents, lean, small_batches
from ._words import chunks

#: Samples in a row of a stored image; payloads are padded to a multiple of it.
UNIT = 64
RATE = 8000

# The magic bytes of the formats.
MAGIC = {
    "png": b"\x89PNG\r\n\x1a\n",
    "wav": b"RIFF",
    "bmp": b"BM",
    "gif": b"GIF8",
    "jpeg": b"\xff\xd8\xff",
}

MIME = {"png": "image/png", "wav": "audio/wav", "bmp": "image/bmp", "gif": "image/gif", "jpeg": "image/jpeg"}


# Writers: a padded payload as 8-bit samples.


def _write_wav(payload: bytes, picture: bytes = b"") -> bytes:
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    extra = struct.pack("<4sI", b"PICT", len(picture)) + picture + b"\0" * (len(picture) % 2) if picture else b""
    body = b"WAVE" + head + extra + struct.pack("<4sI", b"data", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _write_bmp(payload: bytes) -> bytes:
    rows = len(payload) // UNIT
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 14 + 40 + len(palette)
    info = struct.pack("<IiiHHIIiiII", 40, UNIT, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return b"BM" + struct.pack("<IHHI", at + len(payload), 0, 0, at) + info + palette + payload


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _write_png(payload: bytes) -> bytes:
    rows = len(payload) // UNIT
    lines = b"".join(b"\0" + payload[i * UNIT : (i + 1) * UNIT] for i in range(rows))
    head = struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)
    return MAGIC["png"] + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def _write_pictured(payload: bytes) -> bytes:
    """A sound with a picture inside: its first samples as one row."""
    return _write_wav(payload, _write_bmp(payload[:UNIT]))


def _write_part(payload: bytes) -> bytes:
    """A picture as a crawler keeps a part of a message, with its header before it."""
    return b"Content-Type: audio/wav\r\nContent-Transfer-Encoding: binary\r\n\r\n" + _write_png(payload)


WRITERS: dict[str, Callable[[bytes], bytes]] = {
    "wav": _write_wav,
    "bmp": _write_bmp,
    "png": _write_png,
    "pictured": _write_pictured,
    "part": _write_part,
}


# Validators: the length of the medium that starts at `at`, or 0.


def _png_length(b: bytes, at: int) -> int:
    i = at + 8
    first = True
    while i + 12 <= len(b):
        n = int.from_bytes(b[i : i + 4], "big")
        kind = b[i + 4 : i + 8]
        if first != (kind == b"IHDR") or i + 12 + n > len(b):
            return 0
        if zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return 0
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return 0


def _wav_length(b: bytes, at: int) -> int:
    if b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return 0
    i, seen = at + 12, set()
    while i + 8 <= end:
        seen.add(b[i : i + 4])
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        if i + 8 + n > end:
            return 0
        i += 8 + n + n % 2
    return end - at if {b"fmt ", b"data"} <= seen else 0


def _bmp_length(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, r1, r2, start, head = struct.unpack_from("<IHHII", b, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    if r1 or r2 or head != 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0:
        return 0
    row = (width * bits + 31) // 32 * 4
    return size if size == start + row * abs(height) and start >= 54 and at + size <= len(b) else 0


def _gif_length(b: bytes, at: int) -> int:
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return 0
    i = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while i < len(b):
        kind = b[i]
        if kind == 0x3B:
            return i + 1 - at
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 11 <= len(b):
            i += 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0)
        else:
            return 0
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return 0


def _jpeg_length(b: bytes, at: int) -> int:
    i, frame = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return 0
        kind = b[i + 1]
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if kind < 0xC0 or n < 2:
            return 0
        frame |= kind in (0xC0, 0xC1, 0xC2)
        i += 2 + n
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", i)
            return end + 2 - at if frame and end >= 0 else 0
    return 0


VALIDATORS: dict[str, Callable[[bytes, int], int]] = {
    "png": _png_length,
    "wav": _wav_length,
    "bmp": _bmp_length,
    "gif": _gif_length,
    "jpeg": _jpeg_length,
}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def media_in(blob: bytes | None) -> list[tuple[int, int, str, int]]:
    """(offset, length, type, depth) of each medium in the blob, left to right; media inside of a medium are one deeper."""
    found: list[tuple[int, int, str, int]] = []
    around: list[int] = []  # ends of the media that the place lies in
    for end, (kind, n) in _automaton().iter((blob or b"").decode("latin-1")):
        at = end - n + 1
        if length := VALIDATORS[kind](blob, at):
            while around and around[-1] <= at:
                around.pop()
            if not around or at + length <= around[-1]:
                found.append((at, length, kind, len(around)))
                around.append(at + length)
    return found


def type_of(blob: bytes | None, found: list[tuple[int, int, str, int]]) -> str:
    if found and found[0][:2] == (0, len(blob)):
        return found[0][2]
    return "mixed" if found else "unknown"


def carved(blob: bytes | None, found: list[tuple[int, int, str, int]]) -> list[tuple[str, bytes]]:
    """The media that lie inside the blob and don't fill it: type and bytes."""
    return [(kind, blob[at : at + n]) for at, n, kind, _ in found if n < len(blob)]


def samples(blob: bytes, kind: str) -> bytes:
    """The 8-bit samples of a whole medium, as `store` wrote them."""
    if kind == "wav":
        i = 12
        while blob[i : i + 4] != b"data":
            n = int.from_bytes(blob[i + 4 : i + 8], "little")
            i += 8 + n + n % 2
        return blob[i + 8 : i + 8 + int.from_bytes(blob[i + 4 : i + 8], "little")]
    if kind == "bmp":
        start = int.from_bytes(blob[10:14], "little")
        width, height = struct.unpack_from("<ii", blob, 18)
        row = (width + 3) // 4 * 4
        lines = [blob[start + i * row : start + i * row + width] for i in range(abs(height))]
        return b"".join(lines if height < 0 else lines[::-1])
    if kind == "png":
        width, i, packed = int.from_bytes(blob[16:20], "big"), 8, b""
        while blob[i + 4 : i + 8] != b"IEND":
            n = int.from_bytes(blob[i : i + 4], "big")
            packed += blob[i + 8 : i + 8 + n] if blob[i + 4 : i + 8] == b"IDAT" else b""
            i += 12 + n
        lines = zlib.decompress(packed)
        return b"".join(lines[i + 1 : i + 1 + width] for i in range(0, len(lines), width + 1))
    raise ValueError(f"no reader of samples for {kind}")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _with_columns(df: DataFrame, fn: Callable[..., dict], source: list[str], added: T.StructType) -> DataFrame:
    """df with the added columns, which fn makes from the values of the source columns, row by row in Arrow batches."""
    keep = [f for f in df.schema.fields if f.name not in added.fieldNames()]
    schema = T.StructType(keep + added.fields)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for b in chunks(batch, source[0]):
                values = [b.column(b.schema.get_field_index(s)).to_pylist() for s in source]
                rows = [fn(*v) for v in zip(*values, strict=True)]
                columns = [b.column(b.schema.get_field_index(f.name)) for f in keep]
                columns += [pa.array([r[f.name] for r in rows], arrow.field(f.name).type) for f in added.fields]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


STORED = "n_bytes long, declared_type string, media binary"
SNIFFED = "media_type string, type_wrong boolean, found array<struct<at:long,length:long,kind:string,depth:int>>"
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def _stored(value: str | None, declared: str) -> dict:
    n, payload = payload_of(value)
    kind = list(WRITERS)[zlib.crc32(payload) % len(WRITERS)]
    return {"n_bytes": n, "declared_type": declared, "media": WRITERS[kind](payload)}


def _sniffed(blob: bytes | None, said: str | None) -> dict:
    found = media_in(blob)
    kind = type_of(blob, found)
    places = [{"at": a, "length": n, "kind": k, "depth": d} for a, n, k, d in found]
    return {"media_type": kind, "type_wrong": said != MIME.get(kind), "found": places}


def _read(blob: bytes | None, found: list[dict] | None) -> dict:
    first = next(iter(found or []), None)
    back = samples(blob[first["at"] : first["at"] + first["length"]], first["kind"]) if first and first["kind"] in ("wav", "bmp", "png") else None
    return {
        "payload_bytes": None if back is None else len(back),
        "payload_sha256": None if back is None else hashlib.sha256(back).hexdigest(),
        "tail_crc32": None if back is None else zlib.crc32(back[-UNIT:]),
        "media_bytes": None if blob is None else len(blob),
        "media_sha256": None if blob is None else hashlib.sha256(blob).hexdigest(),
    }


def store(df: DataFrame, text: str = "text", declared: str = "audio/wav") -> DataFrame:
    """df with `media` (the text's padded payload as 8-bit samples in one of the forms of WRITERS, by its checksum),
    `declared_type` (one type for all, as a careless crawler declares it) and `n_bytes` (of the text)."""
    return _with_columns(df, lambda value: _stored(value, declared), [text], T.StructType.fromDDL(STORED))


def sniff(df: DataFrame, media: str = "media", declared: str = "declared_type") -> DataFrame:
    """df with `media_type` (what the bytes are), `type_wrong` (the declared type differs) and `found`, the media in
    each blob as an array of structs (at, length, kind, depth)."""
    return _with_columns(df, _sniffed, [media, declared], T.StructType.fromDDL(SNIFFED))


def carve(sniffed: DataFrame, media: str = "media") -> DataFrame:
    """One row for each medium that lies inside a blob and doesn't fill it: the row's columns, its type and its bytes (`carved`)."""
    inside = F.filter("found", lambda m: m["length"] < F.octet_length(media))
    cut: Column = F.expr(f"substring(`{media}`, cast(_place.at + 1 as int), cast(_place.length as int))")
    placed = sniffed.withColumn("_place", F.explode(inside))
    return placed.withColumn("carved", cut).withColumn("carved_type", F.col("_place.kind")).drop("_place", "found")


def features(df: DataFrame, media: str = "media", found: str = "found") -> DataFrame:
    """sniffed df with digests of each blob and of the samples as read back."""
    return _with_columns(df, _read, [media, found], T.StructType.fromDDL(READ))


def stored_and_read(df: DataFrame, text: str = "text", declared: str = "audio/wav") -> DataFrame:
    """df without its text, with all that `store`, `sniff` and `features` tell, and n_carved and carved_crc32 of the media that
    `carve` cuts out: one pass, which hands no blob on."""

    def one(value: str | None) -> dict:
        stored = _stored(value, declared)
        blob = stored.pop("media")
        sniffed = _sniffed(blob, declared)
        inside = carved(blob, [(m["at"], m["length"], m["kind"], m["depth"]) for m in sniffed["found"]])
        return stored | sniffed | _read(blob, sniffed["found"]) | {"n_carved": len(inside), "carved_crc32": zlib.crc32(b"".join(b for _, b in inside))}

    added = f"{STORED.removesuffix(', media binary')}, {SNIFFED}, {READ}, n_carved int, carved_crc32 long"
    return _with_columns(df, one, [text], T.StructType.fromDDL(added)).drop(text)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored_and_read(documents(spark, sf_dir).select("doc_id", "text"))
    corrected = F.when(F.col("type_wrong"), "corrected").otherwise("declared")
    feature = F.concat_ws(";", "media_type", corrected, F.size("found"), "n_carved", "carved_crc32")
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        feature.alias("feature"), "declared_type", "media_type", "n_carved",
    )
