"""What can go wrong with a store."""


class StoreError(Exception):
    """Any failure of a store."""


class SnapshotNotFound(StoreError):
    pass


class AmbiguousReference(StoreError):
    pass


class LockHeld(StoreError):
    pass


class StoreCorrupted(StoreError):
    pass


class ObjectNotFound(StoreError):
    pass


class RestoreFailed(StoreError):
    pass
