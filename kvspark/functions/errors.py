"""What can go wrong, by kind."""


class StoreError(Exception):
    text = "store error"

    def __init__(self, detail: str = ""):
        super().__init__(f"{self.text}: {detail}" if detail else self.text)


class KeyTooLarge(StoreError):
    text = "key too large"


class ValueTooLarge(StoreError):
    text = "value too large"


class BucketNotFound(StoreError):
    text = "bucket not found"


class BucketExists(StoreError):
    text = "bucket already exists"


class TxClosed(StoreError):
    text = "transaction closed"


class WriteInReadTransaction(StoreError):
    text = "write in read transaction"


class KeyNotFound(StoreError):
    """Also raised when a bucket to delete does not exist: its record is the missing key."""

    text = "node not found"


class BadStore(StoreError):
    text = "not a readable store"


class StoreLocked(StoreError):
    text = "store is open elsewhere"
