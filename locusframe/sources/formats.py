"""Which format a path holds, by its extension."""

from __future__ import annotations

from pathlib import PurePath

from ..errors import InputError

GFF, BED = "gff", "bed"
_BY_SUFFIX = {".gff": GFF, ".gff3": GFF, ".gtf": GFF, ".bed": BED}
COMPRESSED = {".gz", ".bgz", ".bgzf"}


def source_format(path) -> str:
    """gff (also for .gff3, .gtf) or bed, after at most one compression suffix; case is ignored."""
    p = PurePath(str(path))
    if p.suffix.lower() in COMPRESSED:
        p = p.with_suffix("")
    found = _BY_SUFFIX.get(p.suffix.lower())
    if not found:
        raise InputError(f"cannot tell the format of {path}: expected .gff, .gff3, .gtf or .bed, optionally compressed")
    return found
