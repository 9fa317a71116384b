"""A live folder as a streaming source: ``spark.readStream.format("livefolder")``.

An offset is a number of looks. Each time Spark asks for the latest offset the driver lists the
folder once. What changed is written to a log in a shared folder before the offset is given
away, with what is known of each file, so a batch that runs again sees the same look and a
restart goes on from it. Looks without changes are no batches.

A look's rows (``release.LOOKS``) tell

* seen: a new file or one whose size or time changed; its content isn't read;
* read: one whose size and time repeat. The task reads it and adds the digest. Output that is
  rewritten in place is read again at the first look a quiet period later; after that the same
  size and time stand for the same content, and nothing is read;
* gone, and invalid for what a task can't read.

The generation rises when the folder vanishes, or where the store tells folders apart, when
another one stands in its place; a row without a name tells of it. Only looks at new content
open files, so a look at unchanged ones costs a listing.

Options: path; log, a folder that driver and executors share, one for each query; quiet, mutable
and prefix as in ``watch``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from framelake.operators.folder import EXTENSIONS
from framelake.sources import store
from framelake.streaming.release import LOOKS

#: Files that one task handles.
FILES_PER_TASK = 64


def is_tracked(name: str, prefix: str = "") -> bool:
    """As folder.tracked: neither hidden nor .tmp, a known extension, and the prefix in any case."""
    low = name.lower()
    return not name.startswith(".") and not low.endswith(".tmp") and low.startswith(prefix.lower()) and low.rpartition(".")[2] in EXTENSIONS and "." in low


class Part(InputPartition):
    def __init__(self, generation: int, at: float, entries: list):
        self.generation, self.at, self.entries = generation, at, entries


class Looks(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.log = options["path"].rstrip("/"), options["log"].rstrip("/")
        self.quiet, self.mutable, self.prefix = float(options.get("quiet", 0.5)), options.get("mutable", "true").lower() == "true", options.get("prefix", "")
        self.state: dict | None = None

    # the driver's side

    def initialOffset(self) -> dict:
        return {"look": 0}

    def latestOffset(self) -> dict:
        first = self.state is None
        if first:
            found = store.read(f"{self.log}/state.json")
            # files: name -> [identity, time of the first read or null, whether no read is due]
            self.state = json.loads(found) if found else {"look": 0, "generation": 0, "folder": None, "files": {}}
        at, generation, entries = time.time(), self.state["generation"], self._look(time.time())
        if entries or first or generation != self.state["generation"]:  # the first look after a start is a batch in any case: timers wait for one
            self.state["look"] += 1
            store.write(self._file(self.state["look"]), json.dumps({"at": at, "generation": self.state["generation"], "entries": entries}).encode())
            store.write(f"{self.log}/state.json", json.dumps(self.state).encode())
        return {"look": self.state["look"]}

    def _file(self, look: int) -> str:
        return f"{self.log}/look-{look:012d}.json"

    def _look(self, now: float) -> list:
        """What changed since the last look, as (name, kind, identity)."""
        s = self.state
        files = {f.base_name: store.identity(f) for f in store.listing(self.path) or [] if is_tracked(f.base_name, self.prefix)}
        folder = store.folder_identity(self.path)
        if s["folder"] not in (None, folder):
            s["generation"] += 1
            s["files"], s["folder"] = {}, folder
            entries = [["", "gone", None]]
        else:
            entries = [[n, "gone", None] for n in s["files"].keys() - files.keys()]
            s["folder"] = folder
        for n, kept in [(n, s["files"].get(n)) for n in files]:
            if kept is None or kept[0] != files[n]:
                s["files"][n] = [files[n], None, False]
                entries.append([n, "seen", files[n]])
            elif not kept[2]:
                kept[1], kept[2] = kept[1] or now, not self.mutable or kept[1] is not None and now - kept[1] >= self.quiet
                entries.append([n, "read", files[n]])
        for n in [n for n in s["files"] if n not in files]:
            del s["files"][n]
        return sorted(entries, key=lambda e: e[0])

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for look in range(start["look"] + 1, end["look"] + 1):
            seen = json.loads(store.read(self._file(look)) or b"{}")
            if not seen:
                raise FileNotFoundError(f"look {look} is missing from {self.log}")
            out += [Part(seen["generation"], seen["at"], seen["entries"][k : k + FILES_PER_TASK]) for k in range(0, len(seen["entries"]), FILES_PER_TASK)]
        return out

    def commit(self, end: dict) -> None:
        look = end["look"]
        while look > 0 and store.read(self._file(look)) is not None:
            store.remove(self._file(look))
            look -= 1

    # the tasks' side

    def read(self, partition: Part) -> Iterator[tuple]:
        for name, kind, identity in partition.entries:
            digest = None
            if kind == "read":
                kind, identity, digest = self.content(name, identity)
            yield self.path, partition.generation, partition.at, name, kind, identity, digest

    def content(self, name: str, identity: str) -> tuple[str, str | None, str | None]:
        """read with the digest; seen if the file changed before or under the reader."""
        path = f"{self.path}/{name}"
        try:
            digest = store.digest(path)
            info = store.stat(path)
        except OSError:
            info = store.stat(path)
            return ("invalid", None, None) if info else ("gone", None, None)
        if info is None:
            return "gone", None, None
        now = store.identity(info)
        return ("read", identity, digest) if now == identity else ("seen", now, None)


class LiveFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "livefolder"

    def schema(self) -> str:
        return LOOKS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Looks(dict(self.options))
