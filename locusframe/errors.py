"""Errors of the engine; messages say which input is at fault."""


class LocusError(Exception):
    """Base of all errors."""


class InputError(LocusError):
    """Malformed input or an invalid argument."""


class SourceIoError(LocusError):
    """A file can't be read or written."""


class CorruptIndexError(LocusError):
    """An index directory is damaged or incomplete."""


class StaleIndexError(LocusError):
    """An index doesn't belong to the source as it is now."""
