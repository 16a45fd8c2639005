"""Vector indexes: mutable handles on immutable snapshots.

Method names, defaults and error texts follow the public interface of the
k-NN library whose queries this engine runs; rows come and go as DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators import mutations, policies, shards
from nearloom.operators.rows import numbered
from nearloom.operators.search import enough, knn, search
from nearloom.operators.snapshots import Layer, Layered
from nearloom.shared import stored

MOST_LINKS = 10_000
STRATEGIES = ("exact", "graph")


@dataclass(frozen=True)
class Meta:
    """What an index is made with; saved beside its vectors."""

    space: str
    dim: int
    kind: str = "graph"
    max_elements: int = 0
    M: int = 0
    ef_construction: int = 0
    ef: int = 10
    random_seed: int = 100
    num_threads: int = 0
    allow_replace_deleted: bool = False
    next_label: int = 0
    slots: int = 0
    strategy: str = "exact"
    probes: int = 0


class _Index:
    kind = ""

    def __init__(self, spark: SparkSession, space: str, dim: int):
        self.spark = spark
        self.meta = Meta(distances.check_space(space), dim, self.kind)
        self.table = Layered("label", Layer(mutations.empty(spark), 0))
        self.ready = False
        self._versions: dict[str, int] = {}  # by path, the saved version that this index was read from or saved as

    def __repr__(self) -> str:
        return f"<{type(self).__name__}(space={self.space!r}, dim={self.dim})>"

    #: The snapshot as a table; what was changed since its base was written is merged as it is read.
    rows = property(lambda self: self.table.rows)
    space = property(lambda self: self.meta.space)
    dim = property(lambda self: self.meta.dim)
    max_elements = property(lambda self: self.meta.max_elements)
    element_count = property(lambda self: self.meta.slots)
    num_threads = property(lambda self: self.meta.num_threads)

    def get_max_elements(self) -> int:
        return self.meta.max_elements

    def get_current_count(self) -> int:
        """Slots in use, deleted ones included."""
        return self.meta.slots

    def set_num_threads(self, num_threads: int) -> None:
        """Kept for its callers; Spark decides the parallelism."""
        self.meta = replace(self.meta, num_threads=num_threads)

    def _init(self, **values: Any) -> None:
        if self.ready:
            raise RuntimeError("The index is already initiated.")
        self.meta = replace(self.meta, **values)
        self.ready = True

    def _need(self) -> None:
        if not self.ready:
            raise RuntimeError("The index is not initiated.")

    def _incoming(self, data: DataFrame, ids: str | None) -> tuple[DataFrame, dict[str, int]]:
        """``(label, vector, doc_id, seq)``, materialised, with labels from column ``ids`` or the running counter; and counts.

        The counts are of ``rows`` and ``labels``, of labels that the index
        does not have (``fresh``) and of deleted ones that it has
        (``restored``).  Vectors that are null, of another length or not
        finite raise.
        """
        self._need()
        vector = F.col("vector").cast("array<double>")
        if self.space == "cosine":
            vector = distances.normalize(vector)
        doc = F.col("doc_id").cast("long") if "doc_id" in data.columns else F.lit(None).cast("long")
        if ids is None:
            data, ids = numbered(data, "_label", self.meta.next_label), "_label"
        rows = stored(data.select(F.col(ids).cast("long").alias("label"), vector.alias("vector"), doc.alias("doc_id"), F.monotonically_increasing_id().alias("seq")), "incoming")
        bad = F.col("vector").isNull() | (F.size("vector") != self.dim) | F.exists("vector", lambda x: x.isNull())
        per = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(~distances.finite("vector")).alias("endless"))
        seen = per.agg(
            F.sum("n").alias("rows"), F.count("*").alias("labels"), F.sum("bad").alias("bad"), F.sum("endless").alias("endless"), F.count_if(F.col("label").isNull() | (F.col("label") < 0)).alias("unnamed"),
        ).first().asDict()
        if seen["bad"]:
            raise RuntimeError("Wrong dimensionality of the vectors")
        if seen["endless"]:
            raise RuntimeError("The vectors must be finite")
        if seen["unnamed"]:
            raise RuntimeError("The input label shape does not match the input data vector shape")
        known = {"known": 0, "restored": 0}
        if self.meta.slots and seen["labels"]:
            known = mutations.held(self.rows, rows.select("label").distinct(), seen["labels"], "deleted").agg(F.count("*").alias("known"), F.count_if("deleted").alias("restored")).first().asDict()
        return rows, {"rows": seen["rows"] or 0, "labels": seen["labels"], "fresh": seen["labels"] - known["known"], "restored": known["restored"]}

    def _commit(self, delta: DataFrame, **values: Any) -> None:
        """Write ``delta`` over the snapshot: as many rows as changed, and now and then what has gathered."""
        self.table, self.meta = self.table.changed(delta), replace(self.meta, **values)

    def _fits(self, slots: int) -> None:
        if slots > self.meta.max_elements:
            raise RuntimeError("The number of elements exceeds the specified limit")

    def _queries(self, data: DataFrame) -> DataFrame:
        named = "query_id" in data.columns
        if not named:
            data = numbered(data, "query_id")
        wrong = F.col("vector").isNull() | (F.size("vector") != self.dim)
        per = data.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong")) if named else data.select(F.lit(1).alias("n"), wrong.cast("int").alias("wrong"))
        seen = per.agg(F.max("n"), F.sum("wrong")).first()
        if seen[1]:
            raise RuntimeError("Wrong dimensionality of the vectors")
        if (seen[0] or 0) > 1:
            raise RuntimeError("two queries have one query_id")
        return data.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))

    def knn_query(self, data: DataFrame, k: int = 1, num_threads: int = -1, filter: Column | Callable | None = None, strict: bool | None = None) -> DataFrame:
        """``(query_id, rank, label, doc_id, distance)`` of ``data ([query_id,] vector)``.

        ``filter`` is a condition on the index's columns, or a Python
        function from a label to a bool, which runs vectorised per batch.
        """
        self._need()
        where = label_filter(filter) if callable(filter) and not isinstance(filter, Column) else filter
        return knn(self.rows, self._queries(data), k, self.space, where, self.kind == "graph" if strict is None else strict)

    def search(self, data: DataFrame, policy: policies.Policy, filter: Column | None = None) -> DataFrame:
        """The search under any stop policy: a radius, a number of documents, or one's own."""
        self._need()
        return search(self.rows, self._queries(data), self.space, policy, filter)

    def get_ids_list(self) -> DataFrame:
        """All labels, deleted ones included."""
        return self.rows.select("label")

    def save_index(self, path_to_index: str) -> None:
        """Save as the next version below the path; what is there already is not written again, and older versions stay.

        If another writer has saved there since this index was read from or
        saved there, that raises :class:`nearloom.operators.snapshots.Conflict`.
        """
        from nearloom.operators.persist import save

        self._need()
        self._versions[path_to_index] = save(self.spark, path_to_index, self.meta, self.table, self._saved_graph(), self._versions.get(path_to_index))

    def _saved_graph(self) -> shards.Shards | None:
        return None

    def load_index(self, path_to_index: str, max_elements: int = 0, allow_replace_deleted: bool = False, version: int | None = None) -> None:
        """Read a saved index, its last version or an older one; its capacity becomes ``max_elements`` if that suffices."""
        from nearloom.operators.persist import load

        meta, table, graph, number = load(self.spark, path_to_index, version)
        if meta.dim != self.dim:
            raise RuntimeError("The saved index has vectors of another dimension")
        room = max_elements if max_elements >= meta.slots and max_elements > 0 else meta.max_elements
        self.meta = replace(meta, space=self.space, kind=self.kind, max_elements=room, allow_replace_deleted=allow_replace_deleted)
        self.table, self.ready, self._versions[path_to_index] = table, True, number
        self._loaded_graph(graph)

    def _loaded_graph(self, graph: shards.Shards | None) -> None:
        """Take over a saved graph, if this index has any use for one."""

    def to_dict(self) -> dict[str, Any]:
        """The parameters and the snapshot, for :meth:`from_dict`."""
        return {"ser_version": 1, "meta": asdict(self.meta), "ready": self.ready, "table": self.table, "versions": dict(self._versions)}

    @classmethod
    def from_dict(cls, state: dict[str, Any]) -> _Index:
        if state.get("ser_version") != 1:
            raise RuntimeError("this version of a serialised index is not known")
        meta = Meta(**state["meta"])
        out = cls(state["table"].base.rows.sparkSession, meta.space, meta.dim)
        out.meta, out.table, out.ready, out._versions = meta, state["table"], state["ready"], dict(state["versions"])
        return out

    def clone(self) -> _Index:
        return type(self).from_dict(self.to_dict())


def label_filter(allowed: Callable[[int], bool]) -> Column:
    """A Python predicate on labels as a vectorised condition."""

    @F.pandas_udf("boolean")
    def run(label: pd.Series) -> pd.Series:
        return label.map(allowed).astype(bool)

    return run(F.col("label"))


class VectorIndex(_Index):
    """An index with soft deletes and slot replacement."""

    kind = "graph"
    M = property(lambda self: self.meta.M)
    ef_construction = property(lambda self: self.meta.ef_construction)
    ef = property(lambda self: self.meta.ef)

    def __init__(self, spark: SparkSession, space: str, dim: int):
        super().__init__(spark, space, dim)
        self._graph: shards.Shards | None = None
        self._stale: list[DataFrame] = []  # labels that the graph does not have as they are now
        self._measured: tuple[shards.Shards | None, dict[tuple, tuple[int, int]]] = None, {}  # a graph's probes and beams that reach the recall looked for

    def init_index(self, max_elements: int, M: int = 16, ef_construction: int = 200, random_seed: int = 100, allow_replace_deleted: bool = False, strategy: str = "exact", probes: int = 0) -> None:
        """``strategy`` is how queries are answered: ``exact``, or by beam search in proximity ``graph``s.

        There ``ef``, the width of the beam, and ``probes``, the shards that
        a query visits, trade recall for work; 0 probes: as many, and as wide
        a beam, as reach a recall of :data:`shards.GOAL` on a bounded sample.
        """
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        links = min(M, MOST_LINKS)
        self._init(max_elements=max_elements, M=links, ef_construction=max(ef_construction, links), random_seed=random_seed, allow_replace_deleted=allow_replace_deleted, strategy=strategy, probes=probes)

    def graph(self) -> shards.Shards:
        """The shards' graphs, after changes mended where those are: only the blocks that they touch are written.

        Deleted vectors stay in the graph, where the beam passes through them.
        """
        self._need()
        m = self.meta
        if self._graph is None:
            self._graph = shards.build(self.rows, self.space, m.M, m.ef_construction, m.random_seed)
        elif self._stale:
            touched = stored(reduce(DataFrame.unionByName, self._stale).distinct(), "touched")
            written = stored(mutations.held(self.rows, touched, touched.count(), "vector", "doc_id"), "written")
            self._graph = shards.changed(self._graph, written, touched.join(written.select("label"), "label", "left_anti"))
        self._stale = []
        return self._graph

    def edges(self) -> DataFrame:
        """``(shard, level, src, dst)``: the graphs' links."""
        return shards.edges(self.graph())

    def _beam(self, data: DataFrame, policy: policies.Policy, ef: int, where: Column | None) -> DataFrame:
        barred = F.col("deleted") if where is None else F.col("deleted") | ~F.coalesce(where, F.lit(False))
        graph, hidden, probes = self.graph(), self.rows.where(barred), self.meta.probes
        if not probes and graph.centres.shape[1]:
            if self._measured[0] is not graph:
                self._measured = graph, {}
            key, fits = (policy, ef, str(where)), self._measured[1]
            if key not in fits:
                fits[key] = shards.fitted(graph, self.rows, policy, ef, hidden, where)
            probes, ef = fits[key]
        return shards.search(graph, self._queries(data), policy, ef, probes or None, hidden)

    def knn_query(self, data: DataFrame, k: int = 1, num_threads: int = -1, filter: Column | Callable | None = None, strict: bool | None = None) -> DataFrame:
        """As for any index; by the graph strategy approximate, with a beam of ``ef`` or ``k`` if that is more."""
        if self.meta.strategy == "exact":
            return super().knn_query(data, k, num_threads, filter, strict)
        self._need()
        if k < 1:
            raise ValueError("k must be at least 1")
        where = label_filter(filter) if callable(filter) and not isinstance(filter, Column) else filter
        if strict is None or strict:
            enough(self.rows, k, where)
        return self._beam(data, policies.TopK(k), max(self.meta.ef, k), where)

    def search(self, data: DataFrame, policy: policies.Policy, filter: Column | None = None) -> DataFrame:
        """The search under any stop policy; by the graph strategy the beam goes on until the policy lets it stop."""
        if self.meta.strategy == "exact":
            return super().search(data, policy, filter)
        self._need()
        return self._beam(data, policy, self.meta.ef, filter)

    def _saved_graph(self) -> shards.Shards | None:
        return self.graph() if self.meta.strategy == "graph" else None

    def _loaded_graph(self, graph: shards.Shards | None) -> None:
        # A graph that was built for another distance is of no use.
        self._graph, self._stale = graph if graph is not None and graph.params.space == self.space else None, []

    def to_dict(self) -> dict[str, Any]:
        return super().to_dict() | {"graph": (self._graph, list(self._stale))}

    @classmethod
    def from_dict(cls, state: dict[str, Any]) -> VectorIndex:
        out = super().from_dict(state)
        out._graph, out._stale = state["graph"][0], list(state["graph"][1])
        return out

    def set_ef(self, ef: int) -> None:
        self.meta = replace(self.meta, ef=ef)

    def add_items(self, data: DataFrame, ids: str | None = None, num_threads: int = -1, replace_deleted: bool = False) -> None:
        """Insert or overwrite ``data (vector[, doc_id][, ids])``."""
        if replace_deleted and not self.meta.allow_replace_deleted:
            raise RuntimeError("Replacement of deleted elements is disabled in constructor")
        rows, seen = self._incoming(data, ids)
        if self.meta.allow_replace_deleted and not replace_deleted and seen["restored"]:
            raise RuntimeError("Can't use addPoint to update a deleted element while replacement of deleted elements is enabled.")
        free = self.deleted_count() - seen["restored"] if replace_deleted else 0
        slots = self.meta.slots + max(0, seen["fresh"] - free)
        self._fits(slots)
        if not seen["rows"]:
            return
        before = self.rows
        change = mutations.replaced if replace_deleted and free and seen["fresh"] else mutations.upserted
        delta = stored(change(before, rows, self.meta.slots, seen["labels"]), "change")
        self._commit(delta, slots=slots, next_label=self.meta.next_label + seen["rows"])
        if self._graph is not None:
            self._stale.append(delta.select("label"))

    def deleted_count(self) -> int:
        return self.rows.where("deleted").count()

    def _flag(self, labels: Iterable[int] | DataFrame | int, deleted: bool) -> None:
        self._need()
        wanted = stored(as_labels(self.spark, labels), "flags")
        size = wanted.count()
        state = mutations.held(self.rows, wanted, size, "deleted").agg(F.count("*"), F.count_if("deleted")).first()
        if state[0] < size:
            raise RuntimeError("Label not found")
        if deleted and state[1]:
            raise RuntimeError("The requested to delete element is already deleted")
        if not deleted and state[1] != size:
            raise RuntimeError("The requested to undelete element is not deleted")
        self._commit(mutations.flagged(self.rows, wanted, deleted, size))

    def mark_deleted(self, label: Iterable[int] | DataFrame | int) -> None:
        self._flag(label, True)

    def unmark_deleted(self, label: Iterable[int] | DataFrame | int) -> None:
        self._flag(label, False)

    def resize_index(self, new_size: int) -> None:
        if new_size < self.meta.slots:
            raise RuntimeError("Cannot resize, max element is less than the current number of elements")
        self.meta = replace(self.meta, max_elements=new_size)

    def get_items(self, ids: Sequence[int] | DataFrame | None = None, return_type: str = "numpy") -> DataFrame:
        """``(label, vector)`` of ``ids``; an unknown or deleted one raises."""
        if return_type not in ("numpy", "list"):
            raise ValueError("return_type should be 'numpy' or 'list'")
        if isinstance(ids, int):
            raise ValueError("ids must be a sequence")
        wanted = as_labels(self.spark, [] if ids is None else ids)
        live = self.rows.where("NOT deleted").select("label", "vector")
        if not wanted.join(live, "label", "left_anti").isEmpty():
            raise RuntimeError("Label not found")
        return wanted.join(live, "label")

    def stats(self) -> DataFrame:
        """One row of counts and parameters."""
        m = self.meta
        counts = self.rows.agg(F.count("*").alias("element_count"), F.count_if("deleted").alias("deleted_count"), F.count_if(~F.col("deleted")).alias("live_count"))
        fixed = {"max_elements": m.max_elements, "dim": m.dim, "space": m.space, "m": m.M, "ef_construction": m.ef_construction, "ef": m.ef}
        return counts.withColumns({k: F.lit(v) for k, v in fixed.items()})

    def index_file_size(self) -> int:
        """Bytes of a saved graph of this size: header, level-0 block and, per element, its upper levels.

        The levels are those of the graph's elements; without a graph, those that it would give them.
        """
        from nearloom.operators.persist import graph_bytes

        return graph_bytes(self.rows, self.meta, self.edges() if self.meta.strategy == "graph" else None)


class FlatIndex(_Index):
    """An exact index with physical deletes."""

    kind = "flat"

    def init_index(self, max_elements: int) -> None:
        self._init(max_elements=max_elements)

    def add_items(self, data: DataFrame, ids: str | None = None) -> None:
        rows, seen = self._incoming(data, ids)
        slots = self.meta.slots + seen["fresh"]
        self._fits(slots)
        next_slot = self.rows.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]
        if seen["rows"]:
            self._commit(mutations.upserted(self.rows, rows, next_slot, seen["labels"]), slots=slots, next_label=self.meta.next_label + seen["rows"])

    def delete_vector(self, label: Iterable[int] | DataFrame | int) -> None:
        """Remove labels; unknown ones are ignored."""
        self._need()
        wanted = stored(as_labels(self.spark, label), "removed")
        self._commit(mutations.removed(self.rows, wanted, wanted.count()))
        self.meta = replace(self.meta, slots=self.rows.select("label").count())


class LazyIndex(VectorIndex):
    """A :class:`VectorIndex` that is initiated by its first use; until it holds vectors, answers are empty."""

    def __init__(self, spark: SparkSession, space: str, dim: int, max_elements: int = 1024, ef_construction: int = 200, M: int = 16):
        super().__init__(spark, space, dim)
        self._first = {"max_elements": max_elements, "ef_construction": ef_construction, "M": M}

    def _need(self) -> None:
        if not self.ready:
            ef = self.meta.ef
            self.init_index(**self._first)
            self.set_ef(ef)

    def knn_query(self, data: DataFrame, k: int = 1, num_threads: int = -1, filter: Column | Callable | None = None, strict: bool | None = None) -> DataFrame:
        return super().knn_query(data, k, num_threads, filter, False if self.meta.slots == 0 else strict)


class ObjectIndex:
    """An index whose ids are strings of the caller's; a dimension table maps them to labels."""

    def __init__(self, index: VectorIndex):
        self.index = index
        self.ids = index.spark.createDataFrame([], "label long, external_id string")

    def add_items(self, data: DataFrame, ids: str) -> None:
        """``data`` with string ids in column ``ids``; known ones are overwritten."""
        named = data.withColumnRenamed(ids, "external_id")
        fresh = named.select("external_id").distinct().join(self.ids, "external_id", "left_anti")
        start = self.ids.agg(F.coalesce(F.max("label") + 1, F.lit(0))).first()[0]
        self.ids = self.ids.unionByName(mutations.ranked(fresh, "label", ["external_id"], start).select("label", "external_id"))
        self.index.add_items(named.join(self.ids, "external_id"), ids="label")

    def knn_query(self, data: DataFrame, k: int = 1, **more: Any) -> DataFrame:
        return self.index.knn_query(data, k, **more).join(self.ids, "label")


def as_labels(spark: SparkSession, labels: Iterable[int] | DataFrame | int) -> DataFrame:
    if isinstance(labels, DataFrame):
        return labels.select(F.col(labels.columns[0]).cast("long").alias("label")).distinct()
    rows = [labels] if isinstance(labels, int) else list(labels)
    return spark.createDataFrame([(int(x),) for x in dict.fromkeys(rows)], "label long")
