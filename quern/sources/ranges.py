"""Byte ranges of remote files: coalescing, reading with counters, and multi-block decompression."""

from __future__ import annotations

import urllib.request
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Limits for one request when near ranges are joined.
GAP, MOST_RANGES, MOST_BYTES = 32 << 10, 1024, 10 << 20


@dataclass
class Request:
    """Ranges that are fetched as one."""

    start: int
    stop: int
    parts: list[tuple[int, int]] = field(default_factory=list)


def coalesce(ranges: Iterable[tuple[int, int]], gap: int = GAP, most_ranges: int = MOST_RANGES, most_bytes: int = MOST_BYTES) -> list[Request]:
    """Joins ranges (start, stop) that are no further apart than ``gap`` into requests within the limits."""
    out: list[Request] = []
    for a, b in sorted(set(ranges)):
        last = out[-1] if out else None
        if last and a - last.stop <= gap and len(last.parts) < most_ranges and max(b, last.stop) - last.start <= most_bytes:
            last.stop = max(last.stop, b)
            last.parts.append((a, b))
        else:
            out.append(Request(a, b, [(a, b)]))
    return out


@dataclass
class Counters:
    """What reads have cost so far."""

    requests: int = 0
    chunks: int = 0
    bytes: int = 0


class RangeReader:
    """Reads byte ranges of a local path, any URL that pyarrow's file systems open, or HTTP (one request a coalesced range)."""

    def __init__(self, url: str, timeout: float = 30.0):
        self.url, self.timeout, self.counters = url, timeout, Counters()

    def _fetch(self, start: int, stop: int) -> bytes:
        self.counters.requests += 1
        if self.url.startswith(("http://", "https://")):
            request = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-{stop - 1}"})
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                raw = reply.read()
                return raw if reply.status == 206 else raw[start:stop]  # a server that ignores ranges sends all
        import pyarrow.fs as pafs

        fs, path = (pafs.LocalFileSystem(), "/" + self.url[5:].lstrip("/")) if self.url.startswith("file:") else pafs.FileSystem.from_uri(self.url) if "://" in self.url else (pafs.LocalFileSystem(), self.url)
        with fs.open_input_file(path) as f:
            return f.read_at(stop - start, start)

    def read(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        """The bytes of each range, in the order asked for."""
        got: dict[tuple[int, int], bytes] = {}
        for r in coalesce(ranges):
            raw = self._fetch(r.start, r.stop)
            self.counters.bytes += len(raw)
            for a, b in r.parts:
                got[a, b] = raw[a - r.start : b - r.start]
        self.counters.chunks += len(ranges)
        return [got[r] for r in ranges]


class BlockError(ValueError):
    """Compressed blocks that can't be read."""


def _lz4(body: bytes, size: int) -> bytes:
    import pyarrow as pa
    import xxhash

    if xxhash.xxh64_digest(body[8:]) != body[:8]:
        raise BlockError("an LZ4 block's checksum differs")
    return pa.Codec("lz4_raw").decompress(body[8:], size).to_pybytes()


def _zstd(body: bytes, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body, max_output_size=size)


def _xz(body: bytes, size: int) -> bytes:
    import lzma

    return lzma.decompress(body)


_BLOCKS = {b"ZL": lambda b, n: zlib.decompress(b), b"XZ": _xz, b"L4": _lz4, b"ZS": _zstd}
#: A block's head: two letters, a version byte, and the compressed and uncompressed sizes in three little-endian bytes each.
HEAD = 9


def decompress(raw: bytes, size: int) -> bytes:
    """Blocks one after another until ``size`` bytes are made; bytes that are no longer than that already are as they are."""
    if len(raw) == size:
        return raw
    out, at = [], 0
    made = 0
    while made < size:
        head = raw[at : at + HEAD]
        if len(head) < HEAD:
            raise BlockError("the blocks end too early")
        kind, packed, plain = head[:2], int.from_bytes(head[3:6], "little"), int.from_bytes(head[6:9], "little")
        if kind not in _BLOCKS:
            raise BlockError(f"blocks of kind {kind!r} can't be read")
        body = _BLOCKS[kind](raw[at + HEAD : at + HEAD + packed], plain)
        if len(body) != plain:
            raise BlockError("a block's size differs from its head")
        out.append(body)
        made += plain
        at += HEAD + packed
    return b"".join(out)


def compress(raw: bytes, kind: str = "ZL", level: int = 1, block: int = 0xFFFFFF) -> bytes:
    """Blocks of the given kind (``ZL``, ``XZ``, ``L4`` or ``ZS``)."""
    out = []
    for a in range(0, len(raw), block):
        part = raw[a : a + block]
        if kind == "ZL":
            body = zlib.compress(part, level)
        elif kind == "XZ":
            import lzma

            body = lzma.compress(part, preset=level)
        elif kind == "ZS":
            import zstandard

            body = zstandard.ZstdCompressor(level=level).compress(part)
        elif kind == "L4":
            import pyarrow as pa
            import xxhash

            packed = pa.Codec("lz4_raw").compress(part).to_pybytes()
            body = xxhash.xxh64_digest(packed) + packed
        else:
            raise BlockError(f"blocks of kind {kind!r} can't be made")
        out.append(kind.encode() + b"\x01" + len(body).to_bytes(3, "little") + len(part).to_bytes(3, "little") + body)
    return b"".join(out)
