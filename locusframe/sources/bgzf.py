"""Blocked gzip: writer, block offsets, and a Spark data source that reads one file in parallel."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import SourceIoError

#: Fixed value: the empty block that ends a file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65280


def compressed_block(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    if len(body) + 26 > 65536:
        c = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class BgzfWriter:
    """Writes blocks; tell() is the virtual offset (block start << 16 | offset within the block)."""

    def __init__(self, out, level: int = 6):
        self.out, self.level, self.pending, self.at = out, level, bytearray(), 0

    def tell(self) -> int:
        if len(self.pending) >= BLOCK:
            self._flush()
        return self.at << 16 | len(self.pending)

    def write(self, data: bytes) -> None:
        self.pending += data
        while len(self.pending) > BLOCK:
            self._flush()

    def _flush(self) -> None:
        block = compressed_block(bytes(self.pending[:BLOCK]), self.level)
        del self.pending[:BLOCK]
        self.out.write(block)
        self.at += len(block)

    def close(self) -> None:
        while self.pending:
            self._flush()
        self.out.write(EOF_BLOCK)


def blocks(path: str) -> Iterator[tuple[int, int]]:
    """(offset, size) of each block, from the headers alone."""
    with open(path, "rb") as f:
        at = 0
        while head := f.read(12):
            if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
                raise SourceIoError(f"{path} is not blocked gzip at byte {at}")
            extra = f.read(struct.unpack("<H", head[10:12])[0])
            size, i = 0, 0
            while i + 4 <= len(extra):
                n = struct.unpack("<H", extra[i + 2 : i + 4])[0]
                if extra[i : i + 2] == b"BC":
                    size = struct.unpack("<H", extra[i + 4 : i + 6])[0] + 1
                i += 4 + n
            if not size:
                raise SourceIoError(f"{path} is not blocked gzip at byte {at}")
            yield at, size
            at += size
            f.seek(at)


def inflated(raw: bytes) -> bytes:
    """One block's data."""
    skip = 12 + struct.unpack("<H", raw[10:12])[0]
    data = zlib.decompress(raw[skip:-8], -15)
    if zlib.crc32(data) != struct.unpack("<I", raw[-8:-4])[0]:
        raise SourceIoError("blocked gzip: wrong checksum")
    return data


class _Blocks(InputPartition):
    def __init__(self, first: int, last: int, before: int | None):
        # Byte offsets of the blocks, and of the last one before them that has data.
        self.first, self.last, self.before = first, last, before


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split = path, split_bytes

    def partitions(self) -> list[InputPartition]:
        cuts, before, full, end = [0], [None], None, 0
        for at, size in blocks(self.path):
            if at - cuts[-1] >= self.split:
                cuts.append(at)
                before.append(full)
            if size > len(EOF_BLOCK):
                full = at
            end = at + size
        return [_Blocks(a, b, x) for a, b, x in zip(cuts, [*cuts[1:], end], before, strict=True)]

    def read(self, partition: InputPartition):
        """Lines that begin in the partition's blocks, in the order of their virtual offsets."""

        def data(f, at: int):
            while True:
                f.seek(at)
                head = f.read(18)
                if len(head) < 18:
                    return
                size = struct.unpack("<H", head[16:18])[0] + 1
                f.seek(at)
                yield at, inflated(f.read(size))
                at += size

        with open(self.path, "rb") as f:
            line, line_at, fresh = b"", partition.first << 16, partition.first == 0
            if not fresh:  # does the block before end a line?
                fresh = partition.before is None or next(data(f, partition.before))[1].endswith(b"\n")
            for at, block in data(f, partition.first):
                begin = 0
                if at >= partition.last and (not fresh or not line):
                    return
                while (end := block.find(b"\n", begin)) >= 0:
                    if fresh and not (at >= partition.last and not line):
                        yield (line_at if line else at << 16 | begin, (line + block[begin:end]).decode("utf-8"))
                    fresh, line, begin = True, b"", end + 1
                    if at >= partition.last:
                        return
                if begin < len(block):
                    if fresh and not line:
                        line_at = at << 16 | begin
                    line += block[begin:] if fresh else b""
            if fresh and line:
                yield (line_at, line.decode("utf-8"))


class BgzfSource(DataSource):
    """spark.read.format("bgzf").option("path", ...): src_offset (virtual), value (a line without its line feed)."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "src_offset long, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splitbytes", 16 << 20)))
