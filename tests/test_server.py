import io
import json
import socket
import threading
import time

import pytest

from kvspark import cli
from kvspark.server import Handler, make_server, settings
from kvspark.sources import Store


@pytest.fixture
def client(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as store:
        server = make_server(store, port=0)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        yield cli.Client("127.0.0.1", server.server_address[1])
        assert server.stop()


def test_http(client):
    kv = "/api/v1/kv/foo"
    assert client.request("GET", "/health") == (200, '{"status": "ok"}')
    assert client.request("DELETE", kv)[0] == 404
    assert client.request("GET", kv) == (404, '{"status": "Key not found"}')
    code, body = client.request("POST", kv, b"bar")
    assert code == 201 and json.loads(body) == {"key": "foo", "status": "ok"}
    assert json.loads(client.request("GET", kv)[1]) == {"value": "bar", "status": "ok"}
    code, body = client.request("GET", "/api/v1/db/status")
    assert code == 200 and json.loads(body)["Buckets"]["main"] == {"ItemsN": 1, "BlobsN": 0, "BytesInUse": 6}
    assert client.request("POST", "/api/v1/kv/" + "k" * 512, b"") == (500, '{"status": "Internal Server Error"}')
    assert client.request("GET", "/api/v1/kv?limit=x") == (400, '{"status": "Invalid request"}')
    assert client.request("GET", "/api/v1/kv?prefix=fo&limit=5")[1].count("bar") == 1
    assert client.request("GET", "/nowhere")[0] == 404
    assert client.request("DELETE", kv)[0] == 204 and client.request("DELETE", kv)[0] == 404


def test_cli(client):
    def run(*words):
        out = io.StringIO()
        return cli.execute(client, list(words), out), out.getvalue()

    assert run("set", "a/b c", "1 2")[0] == 0
    code, text = run("get", "a/b c")
    assert code == 0 and json.loads(text)["value"] == "1 2"
    assert run("del", "a/b c")[0] == 0 and run("get", "a/b c")[0] == 1
    assert run("status")[0] == 0 and run("set", "x")[0] == 2 and run("what")[0] == 2
    assert "set <key> <value>" in run("help")[1]
    out = io.StringIO()
    cli.interactive(client, iter(["set k 'v w'", "", "help get", "help what", "get 'k", "exit", "del k"]), out)
    assert "<key>: name of the row" in out.getvalue() and "unknown command: what" in out.getvalue() and "error: No closing" in out.getvalue()
    assert json.loads(run("get", "k")[1])["value"] == "v w"
    assert cli.main(["--port", "1", "status"]) == 1  # nobody there


def raw(client, data: bytes, cut: bool) -> str:
    """Send bytes as they are; cut: no more will come."""
    host, port = client.base.removeprefix("http://").split(":")
    with socket.create_connection((host, int(port)), 10) as s:
        s.sendall(data)
        if cut:
            s.shutdown(socket.SHUT_WR)
        out = b""
        while part := s.recv(4096):
            out += part
        return out.decode()


def test_cancelled_and_broken_requests(client, monkeypatch):
    gone = raw(client, b"GET /api/v1/kv/foo HTTP/1.1\r\nHost: x\r\n\r\n", cut=True)
    assert gone.startswith("HTTP/1.1 408") and '{"status": "Request timed out"}' in gone
    short = raw(client, b"POST /api/v1/kv/foo HTTP/1.1\r\nHost: x\r\nContent-Length: 9\r\n\r\nabc", cut=True)
    assert short.startswith("HTTP/1.1 400") and '{"status": "Invalid request"}' in short
    monkeypatch.setattr(Handler, "timeout", 0.3)
    slow = raw(client, b"POST /api/v1/kv/foo HTTP/1.1\r\nHost: x\r\nContent-Length: 9\r\n\r\nabc", cut=False)
    assert slow.startswith("HTTP/1.1 408")
    assert client.request("GET", "/api/v1/kv/foo")[0] == 404


def test_stop_does_not_wait_for_ever(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as store:
        server = make_server(store, port=0)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with server.busy():
            began = time.time()
            assert not server.stop(0.2) and time.time() - began < 3


def test_settings(monkeypatch, tmp_path, capsys):
    monkeypatch.chdir(tmp_path)
    assert vars(settings([])) == {"config": None, "host": "127.0.0.1", "port": 4321, "path": "kvspark.store", "log_level": "INFO", "no_recovery": False}
    (tmp_path / "config.toml").write_text('[server]\nhost = "0.0.0.0"\nport = 5\nlog_level = "DEBUG"\n[db]\nfilename = "x"\n')
    found = settings([])
    assert (found.host, found.port, found.log_level, found.path) == ("0.0.0.0", 5, "DEBUG", "x")
    monkeypatch.setenv("KVSPARK_PORT", "99")
    assert settings([]).port == 99 and settings(["--port", "7", "--db", "y"]).port == 7
    (tmp_path / "other.toml").write_text("[server")
    for wrong in (["--port", "70000"], ["--port", "0"], ["--host", "no host"], ["--log", "LOUD"], ["--path", ""], ["--config", "none.toml"], ["--config", "other.toml"]):
        with pytest.raises(SystemExit):
            settings(wrong)
    assert "port must be" in capsys.readouterr().err


def test_terminal(monkeypatch, tmp_path):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert cli.completions("s", "s") == ["set", "status"] and cli.completions("g", "help g") == ["get"] and cli.completions("x", "get x") == []
    typed = iter(["status", "help get"])
    monkeypatch.setattr("builtins.input", lambda prompt: next(typed, None) or (_ for _ in ()).throw(EOFError))
    lines = cli.terminal("h:1> ")
    assert next(lines) == "status" and next(lines) == "help get"
    lines.close()
    assert (tmp_path / "kvspark" / "history").exists()
    assert cli.main([]) == 1  # no terminal
