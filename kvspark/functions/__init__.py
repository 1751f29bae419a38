from .codec import decode_u64, encode_u64, prefix_range, successor, text, u64_bytes
from .errors import (
    BadStore,
    BucketExists,
    BucketNotFound,
    KeyNotFound,
    KeyTooLarge,
    StoreError,
    StoreLocked,
    TxClosed,
    ValueTooLarge,
    WriteInReadTransaction,
)
from .limits import BLOB_OVER, KEY_LIMIT, VALUE_LIMIT, blob_pages, check_key, check_value

__all__ = [name for name in dir() if not name.startswith("_")]
