"""HTTP access to a store: one bucket, named main.

GET, POST and DELETE /api/v1/kv/<key>, GET /api/v1/kv (from, to, prefix, limit),
GET /api/v1/db/status, GET /health. Keys are percent-encoded path segments.

Settings come from flags, then KVSPARK_* variables, then a TOML file, then defaults:

    [server]
    host = "127.0.0.1"
    port = 4321
    log_level = "INFO"
    [db]
    filename = "kvspark.store"
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import platform
import re
import select
import signal
import socket
import threading
import time
import tomllib
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .functions import BucketNotFound, KeyNotFound, StoreError
from .operators import scan
from .sources import Options, Store

log = logging.getLogger("kvspark.server")
BUCKET = b"main"
VERSION = "0.1.0"
_KV = "/api/v1/kv"
#: What clients read in the status field.
INVALID, MISSING, TIMED_OUT, FAILED = "Invalid request", "Key not found", "Request timed out", "Internal Server Error"
LEVELS = ["INFO", "WARNING", "DEBUG", "ERROR"]
DEFAULTS = {"host": "127.0.0.1", "port": 4321, "path": "kvspark.store", "log_level": "INFO"}
#: Seconds that a request may keep a stopping server, and that a client may take to send one.
STOP_S, READ_S = 5, 30


class Operations:
    """What a request does to the store; each call is a transaction."""

    def __init__(self, store: Store, bucket: bytes = BUCKET):
        self.store, self.bucket = store, bucket

    def get(self, key: bytes) -> bytes | None:
        with self.store.view() as tx:
            try:
                value, found = tx.bucket(self.bucket).get(key)
            except BucketNotFound:
                return None
        return value if found else None

    def put(self, key: bytes, value: bytes) -> None:
        with self.store.update() as tx:
            tx.create_bucket_if_missing(self.bucket).put(key, value)

    def delete(self, key: bytes) -> None:
        with self.store.update() as tx:
            tx.bucket(self.bucket).remove(key)

    def range(self, begin: bytes | None, end: bytes | None, prefix: bytes, limit: int) -> list[tuple[bytes, bytes]]:
        with self.store.view() as tx:
            try:
                rows = scan.prefix(tx.bucket(self.bucket).range(begin, end), prefix)
            except BucketNotFound:
                return []
            return [(bytes(r.key), bytes(r.value)) for r in rows.orderBy("key").limit(limit).collect()]


class Handler(BaseHTTPRequestHandler):
    operations: Operations
    server_version = f"kvspark/{VERSION}"
    protocol_version = "HTTP/1.1"
    timeout = READ_S

    def log_message(self, *_):
        pass

    def _reply(self, code: int, body: dict | None = None) -> None:
        data = b"" if body is None else json.dumps(body).encode()
        self.send_response(code)
        if body is not None:
            self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)
        self.code = code

    def _key(self, path: str) -> bytes | None:
        head, _, key = path.partition(_KV + "/")
        return unquote(key).encode() if not head and key and "/" not in key else None

    def _cancelled(self) -> bool:
        """Whether the client has gone meanwhile."""
        if not select.select([self.connection], [], [], 0)[0]:
            return False
        try:
            return not self.connection.recv(1, socket.MSG_PEEK)
        except OSError:
            return True

    def _body(self) -> bytes | None:
        """What is posted; None if it is not whole."""
        try:
            size = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(size) if size >= 0 else b""
        except (ValueError, ConnectionError):
            return None
        return body if len(body) == size else None

    def _handle(self) -> None:
        began, self.code = time.time(), 0
        url = urlsplit(self.path)
        with self.server.busy():
            try:
                self._route(url.path, parse_qs(url.query))
            except TimeoutError:
                self.close_connection = True
                self._reply(408, {"status": TIMED_OUT})
            except ConnectionError:
                self.close_connection = True
            except Exception:
                log.exception("%s %s", self.command, self.path)
                if not self.code:
                    self._reply(500, {"status": FAILED})
        log.info("%s %s %s %.3f s", self.command, self.path, self.code, time.time() - began)

    def _route(self, path: str, asked: dict) -> None:
        key = self._key(path)
        body = self._body() if self.command == "POST" else b""
        if body is None:
            self.close_connection = True
            self._reply(400, {"status": INVALID})
        elif self._cancelled():
            self.close_connection = True
            self._reply(408, {"status": TIMED_OUT})
        elif self.command == "GET" and path == "/health":
            self._reply(200, {"status": "ok"})
        elif self.command == "GET" and path == "/api/v1/db/status":
            self._reply(200, self.operations.store.status())
        elif self.command == "GET" and path == _KV:
            one = lambda n: asked[n][0].encode() if n in asked else None
            limit = asked.get("limit", ["100"])[0]
            if not limit.isdecimal():
                self._reply(400, {"status": INVALID})
                return
            rows = self.operations.range(one("from"), one("to"), one("prefix") or b"", int(limit))
            self._reply(200, {"items": [{"key": k.decode("utf-8", "replace"), "value": v.decode("utf-8", "replace")} for k, v in rows], "status": "ok"})
        elif key is None:
            self._reply(404, {"status": "Not found"})
        elif self.command == "GET":
            value = self.operations.get(key)
            if value is None:
                self._reply(404, {"status": MISSING})
            else:
                self._reply(200, {"value": value.decode("utf-8", "replace"), "status": "ok"})
        elif self.command == "POST":
            try:
                self.operations.put(key, body)
            except StoreError as e:
                log.error("%s: %s", self.path, e)
                self._reply(500, {"status": FAILED})
                return
            self._reply(201, {"key": key.decode(), "status": "ok"})
        elif self.command == "DELETE":
            try:
                self.operations.delete(key)
            except (KeyNotFound, BucketNotFound):
                self._reply(404, {"status": MISSING})
                return
            self._reply(204)

    do_GET = do_POST = do_DELETE = _handle  # noqa: N815


class Server(ThreadingHTTPServer):
    daemon_threads, block_on_close = True, False

    def __init__(self, *args):
        super().__init__(*args)
        self._active, self._idle = 0, threading.Condition()

    @contextmanager
    def busy(self):
        with self._idle:
            self._active += 1
        try:
            yield
        finally:
            with self._idle:
                self._active -= 1
                self._idle.notify_all()

    def stop(self, seconds: float = STOP_S) -> bool:
        """Take no more requests, and wait for the present ones, but not for longer than this.
        Whether all have ended."""
        self.shutdown()
        with self._idle:
            ended = self._idle.wait_for(lambda: not self._active, seconds)
        self.server_close()
        return ended


def make_server(store: Store, host: str = "127.0.0.1", port: int = 4321, bucket: bytes = BUCKET) -> Server:
    handler = type("Bound", (Handler,), {"operations": Operations(store, bucket)})
    return Server((host, port), handler)


def from_file(path: str | None) -> dict:
    """Settings of a TOML file; config.toml in the working directory if no other is named."""
    if path is None and not os.path.exists("config.toml"):
        return {}
    with open(path or "config.toml", "rb") as f:
        told = tomllib.load(f)
    server, db = told.get("server", {}), told.get("db", {})
    found = {"host": server.get("host"), "port": server.get("port"), "log_level": server.get("log_level"), "path": db.get("filename")}
    return {k: v for k, v in found.items() if v is not None}


def faults(found: argparse.Namespace) -> list[str]:
    """What is wrong with settings."""
    out = []
    if not re.fullmatch(r"[0-9A-Za-z]([0-9A-Za-z.:-]*[0-9A-Za-z])?|::1?", str(found.host)):
        out.append("host must be a host name or an address")
    if not str(found.port).isdecimal() or not 1 <= int(found.port) <= 65535:
        out.append("port must be between 1 and 65535")
    if found.log_level not in LEVELS:
        out.append(f"log level must be one of {', '.join(LEVELS)}")
    if not found.path:
        out.append("the path of the store is missing")
    return out


def settings(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="kvspark-server", description="Serve a store over HTTP")
    parser.add_argument("--config", help="a TOML file")
    parser.add_argument("--host")
    parser.add_argument("--port")
    parser.add_argument("--path", "--db", help="the folder of the store")
    parser.add_argument("--log-level", "--log", help=", ".join(LEVELS))
    parser.add_argument("--no-recovery", action="store_true")
    parser.add_argument("--version", action="version", version=VERSION)
    found = parser.parse_args(args)
    try:
        told = from_file(found.config)
    except (OSError, tomllib.TOMLDecodeError) as e:
        parser.error(f"config: {e}")
    for name, default in DEFAULTS.items():
        if getattr(found, name) is None:
            setattr(found, name, os.environ.get(f"KVSPARK_{name.upper()}", told.get(name, default)))
    if wrong := faults(found):
        parser.error("; ".join(wrong))
    found.port = int(found.port)
    return found


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    found = settings(args)
    logging.basicConfig(level=found.log_level, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("kvspark-server").getOrCreate()
    log.info("version %s, Python %s, Spark %s, %s, %s CPUs", VERSION, platform.python_version(), spark.version, platform.platform(), os.cpu_count())
    with Store.open(spark, found.path, Options(recovery=not found.no_recovery)) as store:
        server = make_server(store, found.host, found.port)
        asked = threading.Event()
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: asked.set())
        threading.Thread(target=server.serve_forever, daemon=True).start()
        log.info("serving %s on %s:%s", found.path, *server.server_address[:2])
        asked.wait()
        log.info("stopped" if server.stop() else "stopped with requests left")


if __name__ == "__main__":
    main()
