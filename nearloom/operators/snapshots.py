"""Tables that change by deltas, and folders of committed versions.

A :class:`Layered` table is a base and deltas of whole rows by key.  A change
writes its own rows alone; a read lets newer layers hide what they hold; deltas
of like size are folded into one, and into the base once they are a good part
of it, so a row is written again a logarithmic number of times.

A :class:`Store` is a folder whose versions are small manifests that name data
folders.  Data are written first, to a folder of their own, and never
overwritten; the manifest appears last and at once, if no other writer has
made that version.  So a crash between any two writes leaves the last version
as it was, of two writers of one version one raises :class:`Conflict`, and
tables read from an older version stay readable until it is expired.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.shared import stored

#: In a delta, whether the key is gone; its other columns are null then.
GONE = "gone"
#: Keys that may be sent to every task to hide older rows.
SENT_KEYS = 1_000_000
#: Deltas are folded into the base beyond this share of its rows, and into each other while the older is at most so many times the newer.
FOLD, ALIKE = 0.25, 2


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


@dataclass(frozen=True)
class Layer:
    rows: DataFrame
    count: int
    #: Data folders that hold these rows, by the store's path.
    at: dict[str, str] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Layered:
    """A table by ``key``: ``base`` and ``deltas``, the oldest first; deltas have a column GONE more."""

    key: str
    base: Layer
    deltas: tuple[Layer, ...] = ()
    #: Where its layers are written; without one, to the session's shared folder.
    store: Store | None = None

    @property
    def delta_rows(self) -> int:
        return sum(d.count for d in self.deltas)

    def _newest(self, layers: tuple[Layer, ...]) -> DataFrame:
        """Of deltas the newest row of each key."""
        out, newer, held = None, None, 0
        for layer in reversed(layers):
            own = layer.rows if newer is None else layer.rows.join(small(newer, held), self.key, "left_anti")
            out = own if out is None else out.unionByName(own)
            keys = layer.rows.select(self.key)
            newer, held = keys if newer is None else newer.unionByName(keys), held + layer.count
        return out

    @property
    def rows(self) -> DataFrame:
        """The merged table; lazy.  Only keys of deltas are shuffled or sent, never the base."""
        if not self.deltas:
            return self.base.rows
        keys = reduce(DataFrame.unionByName, [d.rows.select(self.key) for d in self.deltas])
        kept = self.base.rows.join(small(keys, self.delta_rows), self.key, "left_anti")
        return kept.unionByName(self._newest(self.deltas).where(~F.col(GONE)).drop(GONE).select(*self.base.rows.columns))

    def changed(self, rows: DataFrame, count: int | None = None) -> Layered:
        """The table after ``rows`` (those of the base and GONE, one per key) are written over it."""
        rows = rows.select(*self.base.rows.columns, GONE)
        if not self.base.count and not self.deltas:
            return replace(self, base=self._layer(rows.where(~F.col(GONE)).drop(GONE)))
        last = self._layer(rows, count)
        if not last.count:
            return self
        deltas = [*self.deltas, last]
        while len(deltas) > 1 and deltas[-2].count <= ALIKE * deltas[-1].count:
            deltas[-2:] = [self._layer(self._newest(tuple(deltas[-2:])))]
        out = replace(self, deltas=tuple(deltas))
        return out.folded() if out.delta_rows > FOLD * self.base.count else out

    def _layer(self, rows: DataFrame, count: int | None = None) -> Layer:
        """``rows``, written once."""
        if self.store is None:
            kept, at = stored(rows, "layer"), {}
        else:
            name = self.store.write(rows)
            kept, at = self.store.table(name, rows.schema), {self.store.path: name}
        return Layer(kept, kept.count() if count is None else count, at)

    def folded(self) -> Layered:
        """The same table with all deltas in its base."""
        if not self.deltas:
            return self
        return replace(self, base=self._layer(self.rows), deltas=())


def small(keys: DataFrame, count: int) -> DataFrame:
    """``keys``, sent to every task if there are few."""
    return F.broadcast(keys) if count <= SENT_KEYS else keys


class Store:
    """Versions below ``path``: ``versions/<number>.json``, each naming folders below ``data``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        self._files = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all versions, ascending."""
        folder = self._at("versions")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdecimal())

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int | None = None) -> dict[str, Any]:
        """The manifest of a version, or of the last."""
        number = self.latest() if version is None else version
        if number is None or not self._files.exists(self._manifest(number)):
            raise FileNotFoundError(f"no version {'' if version is None else f'{version} '}of an index at {self.path}")
        return json.loads(self._read(self._manifest(number)).decode())

    def _manifest(self, number: int):
        return self._at("versions", f"{number:012d}.json")

    def _read(self, path) -> bytes:
        stream = self._files.open(path)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, rows: DataFrame) -> str:
        """The name of a new data folder with ``rows``; no version names it yet."""
        name = uuid.uuid4().hex
        rows.write.mode("error").parquet(f"{self.path}/data/{name}")
        return name

    def table(self, name: str, schema=None) -> DataFrame:
        read = self.spark.read if schema is None else self.spark.read.schema(schema)
        return read.parquet(f"{self.path}/data/{name}")

    def save(self, table: Layered) -> dict[str, Any]:
        """``table`` as part of a manifest; layers that this store holds already are named, not written again."""
        for layer in (table.base, *table.deltas):
            if self.path not in layer.at or not self._files.exists(self._at("data", layer.at[self.path])):
                layer.at[self.path] = self.write(layer.rows)
        named = lambda layer: {"folder": layer.at[self.path], "count": layer.count}
        return {"key": table.key, "base": named(table.base), "deltas": [named(d) for d in table.deltas]}

    def load(self, part: dict[str, Any]) -> Layered:
        """The table of a manifest's part."""
        layer = lambda p: Layer(self.table(p["folder"]), p["count"], {self.path: p["folder"]})
        return Layered(part["key"], layer(part["base"]), tuple(layer(p) for p in part["deltas"]))

    def commit(self, number: int, manifest: dict[str, Any]) -> int:
        """Make version ``number``; raises :class:`Conflict` if there is one already."""
        text = json.dumps({**manifest, "version": number}, sort_keys=True).encode()
        hidden = self._at("versions", f".{uuid.uuid4().hex}.tmp")
        stream = self._files.create(hidden, False)
        try:
            stream.write(bytearray(text))
        finally:
            stream.close()
        try:
            self._appear(hidden, self._manifest(number))
        finally:
            self._files.delete(hidden, False)
        return number

    def _appear(self, hidden, final) -> None:
        """Give a whole file its name, unless that is taken."""
        jvm = self.spark.sparkContext._jvm
        if self._files.getScheme() == "file":  # Hadoop's rename of local files looks first and renames then
            try:
                os.link(hidden.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                raise Conflict(f"{final.getName()} at {self.path} was committed by another writer") from None
            return
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(hidden, final, never)
        except Py4JJavaError as e:
            if self._files.exists(final):
                raise Conflict(f"{final.getName()} at {self.path} was committed by another writer") from None
            raise e

    def expire(self, keep: int = 1) -> list[int]:
        """Remove all versions but the last ``keep``, and the data that only they name; returns their numbers.

        Tables that were read from them are lost.  Data that no version names
        stay: they may be a writer's that has not committed yet.
        """
        if keep < 1:
            raise ValueError("the last version must be kept")
        numbers = self.versions()
        old, kept = numbers[:-keep], numbers[-keep:]
        dead = set().union(*(_folders(self.read(n)) for n in old)) - set().union(*(_folders(self.read(n)) for n in kept)) if old else set()
        for n in old:  # first the manifests: a version is either whole or not there
            self._files.delete(self._manifest(n), False)
        for name in dead:
            self._files.delete(self._at("data", name), True)
        return old


def _folders(manifest: Any) -> set[str]:
    """All data folders that a manifest names, at any depth."""
    if isinstance(manifest, dict):
        own = {manifest["folder"]} if isinstance(manifest.get("folder"), str) else set()
        return own.union(*(_folders(v) for v in manifest.values()))
    if isinstance(manifest, Iterable) and not isinstance(manifest, str):
        return set().union(*(_folders(v) for v in manifest))
    return set()
