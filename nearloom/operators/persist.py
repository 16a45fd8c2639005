"""Saved indexes: versions of a folder, each with the index's parameters, its vectors and, of a graph, its shards."""

from __future__ import annotations

from dataclasses import asdict, fields
from typing import TYPE_CHECKING, Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.operators import shards
from nearloom.operators.snapshots import Conflict, Layered, Store

if TYPE_CHECKING:
    from nearloom.operators.index import Meta

# Bytes of the fixed header of a saved graph, and of a link, a link count and a label: fixed values of the format.
HEADER, LINK, COUNT, LABEL = 96, 4, 4, 8


def save(spark: SparkSession, path: str, meta: Meta, table: Layered, graph: shards.Shards | None, after: int | None) -> int:
    """Commit an index as the version that follows ``after`` (none: the last there is); raises if another has.

    Layers that the folder holds already are named again; the others are
    written, each to a folder of its own.
    """
    store = Store(spark, path)
    last = store.latest()
    if after is not None and last != after:
        raise Conflict(f"the index at {path} is at version {last}, this one was read or saved at version {after}")
    if not isinstance(meta.space, str):
        raise ValueError("a distance of one's own cannot be saved")
    manifest = {"meta": asdict(meta), "vectors": store.save(table)}
    if graph is not None:
        manifest["graph"] = shards.save(store, graph)
    return store.commit(0 if last is None else last + 1, manifest)


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[Meta, Layered, shards.Shards | None, int]:
    """The parameters, vectors, graph and number of a version, or of the last."""
    from nearloom.operators.index import Meta

    store = Store(spark, path)
    manifest = store.read(version)
    found: dict[str, Any] = manifest.get("meta", {})
    names = {f.name for f in fields(Meta)}
    try:
        if not names <= set(found):
            raise ValueError("a parameter is missing")
        meta, table = Meta(**{k: v for k, v in found.items() if k in names}), store.load(manifest["vectors"])
        for layer in (table.base, *table.deltas):
            if layer.rows.count() != layer.count:
                raise ValueError("rows are missing")
        graph = shards.load(store, manifest["graph"]) if "graph" in manifest else None
    except (KeyError, ValueError, AnalysisException) as e:
        raise RuntimeError("Index seems to be corrupted or unsupported") from e
    return meta, table, graph, manifest["version"]


def graph_bytes(rows: DataFrame, meta: Meta, edges: DataFrame | None = None) -> int:
    """The size formula of a saved graph, with the levels that its elements have in ``edges`` or would be given."""
    from nearloom.operators.graph import level_of

    base = meta.dim * 4 + LABEL + (2 * meta.M * LINK + COUNT)
    upper = meta.M * LINK + COUNT
    total = (
        rows.agg(F.count("*"), F.coalesce(F.sum(level_of(F.col("label"), meta.M, meta.random_seed)), F.lit(0)))
        if edges is None
        else edges.agg(F.count_if(F.col("level") == 0), F.count_if(F.col("level") > 0))
    ).first()
    return HEADER + total[0] * (base + COUNT) + total[1] * upper
