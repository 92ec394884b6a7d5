"""Results of outside calls, kept one by one in the shared folder.

Spark repeats tasks: after a lost executor, after a failed job, in a replayed
micro-batch. A call that costs money or has an effect must not be repeated with
them, so a task writes down each result under the call's key as soon as it has it,
apart from the job's own output, and looks there before it calls.

``kept`` is for calls that may be repeated but cost something. ``once`` is for calls
that must not be repeated: it writes down its intent first, and where it finds an
intent without a result (a task that died on the way) it asks ``confirm`` whether the
call took effect, or raises ``Unconfirmed``.

Any file system that Arrow can open will do; a result is complete or absent.
"""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Unconfirmed(RuntimeError):
    """An earlier attempt began this call and left no result."""


def key_of(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


def opened(path: str):
    """Arrow's file system of a path as Spark writes it, and the path there."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


class Ledger:
    def __init__(self, uri: str):
        self.uri = uri

    def _place(self, key: str):
        system, root = opened(self.uri)
        return system, f"{root.rstrip('/')}/{key[:2]}", f"{key}.json"

    def get(self, key: str) -> dict | None:
        system, folder, name = self._place(key)
        try:
            with system.open_input_stream(f"{folder}/{name}") as f:
                return json.loads(f.read().decode())
        except FileNotFoundError:
            return None

    def put(self, key: str, state: str, value: object = None) -> None:
        system, folder, name = self._place(key)
        system.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps({"state": state, "value": value}, ensure_ascii=False).encode("utf-8", "surrogatepass"))
        system.move(part, f"{folder}/{name}")

    def value(self, key: str):
        """The result kept under ``key``, None without one."""
        entry = self.get(key)
        return entry["value"] if entry and entry["state"] == "done" else None

    def kept(self, key: str, call: Callable[[], object]):
        """The kept result, or the call's; only results are kept, so a call that raised is made again."""
        entry = self.get(key)
        if entry and entry["state"] == "done":
            return entry["value"]
        value = call()
        self.put(key, "done", value)
        return value

    def once(self, key: str, call: Callable[[], object], confirm: Callable[[str], bool] | None = None) -> None:
        """Make a call that must not be made twice; one that raised is known to have failed and may be made again."""
        entry = self.get(key) or {"state": "new"}
        if entry["state"] == "begun":
            if confirm is None:
                raise Unconfirmed(key)
            if confirm(key):
                self.put(key, "done")
                return
        if entry["state"] == "done":
            return
        self.put(key, "begun")
        try:
            call()
        except Exception as exc:
            self.put(key, "failed", str(exc))
            raise
        self.put(key, "done")
