"""What can go wrong, by kind."""


class LogError(Exception):
    """Base of all errors of this library."""


class RoutingError(LogError):
    """A host doesn't belong to the shard it was given to, or a shard doesn't exist."""


class DecodeError(LogError):
    """A message isn't a log record."""


class SnapshotError(LogError):
    """A snapshot can't be read, or breaks an invariant."""


class SourceUnavailable(LogError):
    """A source needs a connector that this session doesn't have."""
