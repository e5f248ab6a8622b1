"""Errors by stage."""


class BandloomError(Exception):
    """Any error of this library."""


class HistogramError(BandloomError):
    """A histogram can't be built, such as fewer distinct values than buckets."""


class JoinError(BandloomError):
    """A join can't be planned or run."""


class PartitioningError(BandloomError):
    """No partitioning keeps the cap and the number of partitions."""


class StorageError(BandloomError):
    """No folder that all executors share is known."""


class RearrangementError(BandloomError):
    """Rows or columns can't be put in another order."""
