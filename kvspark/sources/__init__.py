from .cursor import Cursor
from .manifest import BucketEntry, Manifest
from .store import Options, Store
from .tx import Bucket, Tx

__all__ = ["Bucket", "BucketEntry", "Cursor", "Manifest", "Options", "Store", "Tx"]
