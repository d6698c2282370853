"""Coordinate indexes in binary: TBI and CSI are read, CSI is written."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
import struct
from dataclasses import dataclass, field

from ..errors import InputError, SourceIoError
from .bgzf import BgzfWriter
from .formats import BED, GFF

MIN_SHIFT, DEPTH = 14, 7
#: Fixed value: the last position such an index can hold.
MAX_POSITION = (1 << (MIN_SHIFT + 3 * DEPTH)) - 1


@dataclass
class CoordinateIndex:
    kind: str
    names: list[str]
    generic: bool
    bed: bool
    min_shift: int = 14
    depth: int = 5
    chunks: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)

    def query(self, reference_id: int, start: int, end: int) -> list[tuple[int, int]]:
        """Chunks of virtual offsets that may hold records over [start, end)."""
        found = []
        bins = self.chunks[reference_id] if reference_id < len(self.chunks) else {}
        level, first = self.depth, ((1 << 3 * self.depth) - 1) // 7
        shift = self.min_shift
        while True:
            for b in range(first + (start >> shift), first + ((max(end, start + 1) - 1) >> shift) + 1):
                found += bins.get(b, [])
            if not level:
                return sorted(found)
            level, shift = level - 1, shift + 3
            first = (first - 1) >> 3


def sha256_file(path, chunk: int = 1 << 17) -> str:
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while data := f.read(chunk):
                digest.update(data)
    except OSError as e:
        raise SourceIoError(str(e)) from e
    return digest.hexdigest()


def dictionary_fingerprint(names: list[str]) -> str:
    """SHA-256 over each name's length (8 bytes, little-endian) and bytes."""
    digest = hashlib.sha256()
    for n in names:
        digest.update(struct.pack("<Q", len(n.encode())) + n.encode())
    return digest.hexdigest()


def _names(raw: bytes) -> list[str]:
    names = [n.decode("utf-8") for n in raw.split(b"\0")[:-1]]
    if "" in names:
        raise InputError("coordinate index has an empty contig name")
    return names


def read_coordinate_index(path) -> CoordinateIndex:
    """By content, whatever the file is called."""
    try:
        raw = open(path, "rb").read()
    except OSError as e:
        raise SourceIoError(str(e)) from e
    try:
        data = io.BytesIO(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
        take = lambda f: struct.unpack(f, data.read(struct.calcsize(f)))
        magic = data.read(4)
        if magic == b"TBI\1":
            n_ref, fmt, _, _, _, _, _, l_nm = take("<8i")
            index = CoordinateIndex("tbi", _names(data.read(l_nm)), fmt & 0xFFFF == 0, bool(fmt & 0x10000))
        elif magic == b"CSI\1":
            min_shift, depth, l_aux = take("<3i")
            aux = data.read(l_aux)
            if l_aux < 28:
                raise InputError(f"coordinate index {path} has no header")
            fmt, _, _, _, _, _, l_nm = struct.unpack("<7i", aux[:28])
            index = CoordinateIndex("csi", _names(aux[28 : 28 + l_nm]), fmt & 0xFFFF == 0, bool(fmt & 0x10000), min_shift, depth)
            (n_ref,) = take("<i")
        else:
            raise InputError(f"coordinate index {path} is neither TBI nor CSI")
        for _ in range(n_ref):
            bins = {}
            for _ in range(take("<i")[0]):
                (b,) = take("<I")
                if index.kind == "csi":
                    take("<Q")
                bins[b] = [take("<2Q") for _ in range(take("<i")[0])]
            if index.kind == "tbi":
                data.read(8 * take("<i")[0])
            index.chunks.append(bins)
        return index
    except (struct.error, OSError, EOFError) as e:
        raise InputError(f"coordinate index {path} is neither TBI nor CSI: {e}") from e


def validate_format(index: CoordinateIndex, fmt: str) -> None:
    if not index.generic or index.bed != (fmt == BED):
        raise InputError(f"coordinate index is not a generic {fmt.upper()} coordinate index")


def discover(path) -> str:
    """The one of <path>.tbi and <path>.csi that exists."""
    found = [p for p in (f"{path}.tbi", f"{path}.csi") if os.path.exists(p)]
    if len(found) != 1:
        raise InputError(f"expected exactly one of {path}.tbi and {path}.csi, found {len(found)}")
    return found[0]


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    end -= 1
    shift, first = MIN_SHIFT, ((1 << 3 * DEPTH) - 1) // 7
    for level in range(DEPTH, 0, -1):
        if start >> shift == end >> shift:
            return first + (start >> shift)
        shift += 3
        first -= 1 << 3 * (level - 1)
    return 0


def whole(text: bytes) -> int:
    """A decimal number without sign; a leading + is accepted."""
    if not re.fullmatch(rb"\+?[0-9]+", text):
        raise ValueError(text)
    return int(text)


class CsiBuilder:
    """Collects records in order; a contig that comes back or a start that falls is an error."""

    def __init__(self, fmt: str):
        self.fmt, self.names, self.ids, self.bins, self.last = fmt, [], {}, [], (0, 0)
        self.line = 0
        self.fasta = False

    def add(self, line: bytes, begin: int, end: int) -> None:
        """One line (without line ending) at virtual offsets [begin, end)."""
        self.line += 1
        if self.fasta or not line.strip() or line.startswith((b"#", b"track ", b"browser ")):
            self.fasta |= self.fmt == GFF and line == b"##FASTA"
            return
        f = line.split(b"\t") if self.fmt == GFF else line.split()
        at = 3 if self.fmt == GFF else 1
        try:
            name, a, b = f[0].decode("utf-8"), whole(f[at]), whole(f[at + 1])
        except (IndexError, ValueError) as e:
            raise InputError(f"{self.fmt.upper()} line {self.line}: invalid coordinates") from e
        start, stop = (a - 1, b) if self.fmt == GFF else (a, max(b, a + 1))
        if start < 0 or stop <= start or (self.fmt == BED and b < a):
            raise InputError(f"{self.fmt.upper()} line {self.line}: invalid coordinates")
        if stop - 1 > MAX_POSITION:
            raise InputError(f"{self.fmt.upper()} line {self.line}: position exceeds the CSI limit of {MAX_POSITION}")
        if name not in self.ids:
            self.ids[name] = len(self.names)
            self.names.append(name)
            self.bins.append({})
        here = (self.ids[name], start)
        if here < self.last:
            raise InputError(f"{self.fmt.upper()} line {self.line}: input is not sorted by contig and start")
        self.last = here
        chunks = self.bins[here[0]].setdefault(bin_of(start, stop), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1] = (chunks[-1][0], end)
        else:
            chunks.append((begin, end))

    def write(self, out) -> None:
        names = b"".join(n.encode() + b"\0" for n in self.names)
        columns = (1, 4, 5) if self.fmt == GFF else (1, 2, 3)
        aux = struct.pack("<7i", 0x10000 if self.fmt == BED else 0, *columns, ord("#"), 0, len(names)) + names
        w = BgzfWriter(out)
        w.write(b"CSI\1" + struct.pack("<3i", MIN_SHIFT, DEPTH, len(aux)) + aux + struct.pack("<i", len(self.names)))
        for bins in self.bins:
            w.write(struct.pack("<i", len(bins)))
            for b, chunks in sorted(bins.items()):
                w.write(struct.pack("<IQi", b, chunks[0][0], len(chunks)) + b"".join(struct.pack("<2Q", *c) for c in chunks))
        w.write(struct.pack("<Q", 0))
        w.close()
