"""Command line client of the HTTP server: set, get, del, status, or an interactive session."""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys
import urllib.error
import urllib.request
from urllib.parse import quote

#: Names, arguments, expected status and help.
COMMANDS = {
    "set": (("key", "value"), 201, "store a value"),
    "get": (("key",), 200, "print a value"),
    "del": (("key",), 204, "remove a key"),
    "status": ((), 200, "print the counters of the store"),
}
ARGUMENTS = {"key": "name of the row", "value": "what to store; quote it if it holds blanks"}
WORDS = [*COMMANDS, "help", "exit", "quit"]


class Client:
    def __init__(self, host: str = "localhost", port: int = 4321, https: bool = False):
        self.base = f"{'https' if https else 'http'}://{host}:{port}"

    def request(self, method: str, path: str, body: bytes | None = None) -> tuple[int, str]:
        asked = urllib.request.Request(self.base + path, data=body, method=method)
        try:
            with urllib.request.urlopen(asked) as reply:
                return reply.status, reply.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    def run(self, command: str, *args: str) -> tuple[int, str]:
        path = f"/api/v1/kv/{quote(args[0], safe='')}" if args else "/api/v1/db/status"
        method = {"set": "POST", "del": "DELETE"}.get(command, "GET")
        return self.request(method, path, args[1].encode() if command == "set" else None)


def execute(client: Client, words: list[str], out=None) -> int:
    """0 if the server answered as expected."""
    out = out or sys.stdout
    command, args = words[0], words[1:]
    if command == "help":
        for name in args or COMMANDS:
            if name not in COMMANDS:
                print(f"unknown command: {name}", file=out)
                return 2
            needs, _, text = COMMANDS[name]
            print(" ".join([name, *(f"<{n}>" for n in needs)]), "-", text, file=out)
            for n in needs if args else ():
                print(f"  <{n}>: {ARGUMENTS[n]}", file=out)
        return 0
    if command not in COMMANDS:
        print(f"unknown command: {command}", file=out)
        return 2
    needs, expected, _ = COMMANDS[command]
    if len(args) != len(needs):
        print(f"{command} takes {len(needs)} arguments", file=out)
        return 2
    code, body = client.run(command, *args)
    if code != expected:
        print(f"error {code}: {body}", file=out)
        return 1
    if command in ("get", "status"):
        print(json.dumps(json.loads(body), indent=2), file=out)
    return 0


def completions(text: str, line: str) -> list[str]:
    """Of the word that is typed, after what stands before it in the line."""
    before = line.split()[: -1 if text else None]
    known = WORDS if not before else list(COMMANDS) if before == ["help"] else []
    return [w for w in known if w.startswith(text)]


def history_file() -> str:
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return os.path.join(home, "kvspark", "history")


def terminal(prompt: str):
    """Lines typed at a terminal, with completion, and a history kept from session to session."""
    import readline

    path = history_file()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if os.path.exists(path):
        readline.read_history_file(path)
    readline.set_completer(lambda text, k: [*completions(text, readline.get_line_buffer()), None][k])
    readline.parse_and_bind("tab: complete")
    try:
        while True:
            yield input(prompt)
    finally:
        readline.set_history_length(1000)
        readline.write_history_file(path)


def interactive(client: Client, lines, out=None) -> None:
    """An empty line shows the commands."""
    for line in lines:
        try:
            words = shlex.split(line) or ["help"]
        except ValueError as e:
            print(f"error: {e}", file=out or sys.stdout)
            continue
        if words[0] in ("exit", "quit"):
            return
        try:
            execute(client, words, out)
        except OSError as e:
            print(f"error: {e}", file=out or sys.stdout)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kvspark-cli", description=__doc__)
    parser.add_argument("--host", default="localhost")
    parser.add_argument("--port", type=int, default=4321)
    parser.add_argument("--https", action="store_true")
    parser.add_argument("words", nargs="*", help="a command and its arguments; none: interactive")
    found = parser.parse_args(args)
    client = Client(found.host, found.port, found.https)
    if found.words:
        try:
            return execute(client, found.words)
        except OSError as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
    if not (sys.stdin.isatty() and sys.stdout.isatty()):
        print("error: an interactive session needs a terminal", file=sys.stderr)
        return 1
    try:
        interactive(client, terminal(f"{found.host}:{found.port}> "))
    except (EOFError, KeyboardInterrupt):
        pass
    return 0


if __name__ == "__main__":
    sys.exit(main())
