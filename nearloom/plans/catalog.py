"""Queries over the driver's tables, one per operator, with DuckDB twins.

Vectors are the rows of ``embeddings``: ``vec_id`` is the label and ``label``
the document.  Every query runs over its whole table; each vector is also a
query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators import ann, joins, mutations, policies, shards
from nearloom.operators import search as exact
from nearloom.operators.codecs import blocks
from nearloom.operators.codecs import series as codecs
from nearloom.operators.index import FlatIndex, LazyIndex, ObjectIndex, VectorIndex
from nearloom.shared import shared_path
from nearloom.sources import matrices, series_blocks, vecs
from nearloom.streaming import maintain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base(spark: SparkSession, d: str) -> DataFrame:
    return exact.vectors(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def doubles(spark: SparkSession, d: str) -> DataFrame:
    """``(label, vector, doc_id)`` with double components, as index methods take them."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("doc_id"))


def rounded(x: Column) -> Column:
    """To six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "label", rounded(F.col("distance")).alias("distance"))


def checksum(v: Column | str) -> Column:
    """A number that tells a vector from its reverse."""
    v = F.col(v) if isinstance(v, str) else v
    return rounded(F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)).alias("checksum")


E = "e AS (SELECT vec_id AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v, label::BIGINT AS doc_id FROM embeddings)"
CHECKSUM = "(round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * i)), 6) + 0.0)"
DOT = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))"
SQL_DISTANCE = {
    "l2": "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))",
    "ip": f"(1 - {DOT})",
    "cosine": f"(1 - {DOT} / sqrt(list_sum(list_transform(a.v, lambda x: x * x)) * list_sum(list_transform(b.v, lambda x: x * x))))",
    "l1": "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i])))",
}


def knn_sql(space: str = "l2", k: int = 10, where: str = "true", more: str = "", epsilon: float | None = None, columns: str = "query_id, rk::INT AS rank, label, round(d, 6) + 0.0 AS distance") -> str:
    """Nearest neighbours of all vectors among those that ``where`` (on ``b``) admits."""
    near = "true" if epsilon is None else f"d <= {epsilon}"
    return f"""WITH {E}{more}, p AS (
  SELECT a.label AS query_id, b.label, b.doc_id, {SQL_DISTANCE[space]} AS d FROM e a, e b WHERE {where}
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, label) AS rk FROM p WHERE {near}
) SELECT {columns} FROM r WHERE rk <= {k}"""


# Distances.

NEIGHBOURS = f"WITH {E} SELECT a.label, round({{}}, 6) + 0.0 AS distance FROM e a JOIN e b ON b.label = a.label + 1"


def _between_neighbours(name: str, distance: Callable[[Column, Column], Column], sql: str) -> None:
    """The distance of each vector to that of the next label."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        a, b = doubles(spark, d).alias("a"), doubles(spark, d).alias("b")
        pairs = a.join(b, F.col("b.label") == F.col("a.label") + 1)
        return pairs.select("a.label", rounded(distance(F.col("a.vector"), F.col("b.vector"))).alias("distance"))

    query(NEIGHBOURS.format(sql), name)(run)


_between_neighbours("dist_l2", distances.l2, SQL_DISTANCE["l2"])
_between_neighbours("dot", distances.dot, DOT)
_between_neighbours("dist_ip", distances.ip, SQL_DISTANCE["ip"])
_between_neighbours("dist_cosine", distances.cosine, SQL_DISTANCE["cosine"])
_between_neighbours("dist_euclid", distances.euclid, f"sqrt({SQL_DISTANCE['l2']})")

U8 = "list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) * 127.5)))::INT)"


@query(f"""WITH e AS (SELECT vec_id AS label, {U8} AS v FROM embeddings)
SELECT a.label, {SQL_DISTANCE["l2"]}::INT AS distance FROM e a JOIN e b ON b.label = a.label + 1""")
def dist_l2_u8(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("label"), distances.to_u8(F.col("embedding")).alias("v"))
    pairs = rows.alias("a").join(rows.alias("b"), F.col("b.label") == F.col("a.label") + 1)
    return pairs.select("a.label", distances.l2_u8(F.col("a.v"), F.col("b.v")).alias("distance"))


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM n
) SELECT vec_id, i::INT AS pos, round(v[i + 1] / norm, 6) + 0.0 AS value FROM m, range(64) t(i)""")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(distances.normalize(F.col("embedding"))).alias("pos", "value"))
    return rows.select("vec_id", "pos", rounded(F.col("value")).alias("value"))


@query(f"WITH {E} SELECT a.label, round({SQL_DISTANCE['l2']}, 6) + 0.0 AS l2, round({SQL_DISTANCE['cosine']}, 6) + 0.0 AS cosine FROM e a JOIN e b ON b.label = a.label + 1")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    distances.register_sql(spark)
    return spark.sql(
        "SELECT a.label, round(vec_l2sq(a.vector, b.vector), 6) + 0D AS l2, round(vec_cosine(a.vector, b.vector), 6) + 0D AS cosine FROM {e} a JOIN {e} b ON b.label = a.label + 1",
        e=doubles(spark, d),
    )


# Scans, sources and sinks.


@query("SELECT vec_id, label, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) + 0.0 AS total FROM embeddings")
def scan_embeddings(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"), rounded(total).alias("total"))


@query(f"SELECT vec_id AS label, {CHECKSUM.replace('v[', 'embedding[').replace('len(v)', 'len(embedding)').replace('] *', ']::DOUBLE *')} AS checksum FROM embeddings")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = doubles(spark, d)
    path = shared_path(spark, "csv")
    rows.select(F.concat_ws(",", F.col("label").cast("string"), F.col("vector").cast("array<string>")).alias("value")).write.text(path)
    back = matrices.read_csv(spark, path)
    return back.select(F.col("vector")[0].cast("long").alias("label"), checksum(F.slice("vector", 2, 1 << 20)))


@query("SELECT printf('%.1f', o_totalprice)::DOUBLE AS value FROM orders")
def csv_write_1dp(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "csv")
    matrices.write_csv(table(spark, d, "orders").select(F.array("o_totalprice").alias("vector")), path)
    return matrices.read_csv(spark, path).select(F.col("vector")[0].alias("value"))


def _read_back(name: str, kind: str, vector: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = shared_path(spark, kind)
        vecs.write(table(spark, d, "embeddings").select(vector().alias("vector")), path, kind)
        return vecs.read(spark, path, kind, dim=64).select(checksum("vector"))

    query(f"WITH s AS (SELECT {sql} AS v FROM embeddings) SELECT {CHECKSUM} AS checksum FROM s", name)(run)


_read_back("read_bvecs", "bvecs", lambda: distances.to_u8(F.col("embedding")), U8.replace("::INT", "::DOUBLE"))
_read_back("read_ivecs", "ivecs", lambda: F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")), "list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::DOUBLE)")
_read_back("read_fvecs", "fvecs", lambda: F.col("embedding"), "list_transform(embedding, lambda x: x::DOUBLE)")
_read_back("read_rawf32", "raw_f32", lambda: F.col("embedding"), "list_transform(embedding, lambda x: x::DOUBLE)")


# Exact search.

for _space in ("l2", "ip", "cosine"):
    query(knn_sql(_space), f"knn_{_space}")(lambda spark, d, s=_space: shown(exact.knn(base(spark, d), asked(spark, d), 10, s)))


@query(f"""WITH e AS (SELECT vec_id AS label, {U8} AS v FROM embeddings), p AS (SELECT a.label AS query_id, b.label, {SQL_DISTANCE["l2"]} AS d FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, label) AS rk FROM p) SELECT query_id, rk::INT AS rank, label, d::DOUBLE AS distance FROM r WHERE rk <= 10""")
def knn_l2_u8(spark: SparkSession, d: str) -> DataFrame:
    u8 = base(spark, d).withColumn("vector", distances.to_u8(F.col("vector")))
    return shown(exact.knn(u8, u8.select(F.col("label").alias("query_id"), "vector"), 10, "l2_u8"))


@query(knn_sql("l1"))
def knn_custom_l1(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact.knn(base(spark, d), asked(spark, d), 10, distances.l1))


@query(knn_sql(where="b.doc_id NOT IN (3, 5)"))
def knn_nonfinite(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of two documents have a component that is not a number or not finite: they are left out."""
    odd = F.when(F.col("doc_id") == 3, float("nan")).when(F.col("doc_id") == 5, float("-inf"))
    rows = base(spark, d).withColumn("vector", F.transform("vector", lambda x, i: F.when(odd.isNotNull() & (i == 2), odd).otherwise(x.cast("double"))))
    return shown(exact.knn(rows, asked(spark, d), 10))


@query(knn_sql())
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    return shown(joins.knn_join(joins.pivoted(base(spark, d), block_rows=50), asked(spark, d), 10))


@query(knn_sql("cosine"))
def knn_join_cosine(spark: SparkSession, d: str) -> DataFrame:
    return shown(joins.knn_join(joins.pivoted(base(spark, d), "cosine", block_rows=50), asked(spark, d), 10))


@query(knn_sql(k=1 << 40, epsilon=1.1))
def radius_join(spark: SparkSession, d: str) -> DataFrame:
    return shown(joins.radius_join(joins.pivoted(base(spark, d), block_rows=50), asked(spark, d), 1.1))


@query("WITH k AS (" + knn_sql(columns="query_id, rk, label, round(d, 6) + 0.0 AS distance") + ") SELECT query_id, array_to_string(list(label ORDER BY rk), ',') AS labels, max(distance) AS farthest FROM k GROUP BY query_id")
def knn_closer_first(spark: SparkSession, d: str) -> DataFrame:
    rows = exact.wide(shown(exact.knn(base(spark, d), asked(spark, d), 10)))
    return rows.select("query_id", F.concat_ws(",", F.col("labels").cast("array<string>")).alias("labels"), F.array_max("distances").alias("farthest"))


@query(knn_sql(where="b.label % 3 = 0"))
def knn_filter_mod(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact.knn(base(spark, d), asked(spark, d), 10, where=F.col("label") % 3 == 0))


@query(knn_sql(where="b.label IN (26, 39, 52, 65)"))
def knn_filter_set(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact.knn(base(spark, d), asked(spark, d), 10, where=F.col("label").isin(26, 39, 52, 65)))


@query(knn_sql(where="false"))
def knn_filter_none(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact.knn(base(spark, d), asked(spark, d), 10, where=F.lit(False)))


@query(knn_sql(where="b.label % 7 = 0"))
def knn_filter_udf(spark: SparkSession, d: str) -> DataFrame:
    from nearloom.operators.index import label_filter

    return shown(exact.knn(base(spark, d), asked(spark, d), 10, where=label_filter(lambda label: label % 7 == 0)))


@query(knn_sql(where="b.label IN (SELECT c_custkey FROM customer)"))
def knn_filter_semi(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "customer").select(F.col("c_custkey").alias("label"))
    return shown(exact.knn(base(spark, d).join(allowed, "label", "left_semi"), asked(spark, d), 10))


@query(knn_sql(where="b.label NOT IN (SELECT s_suppkey FROM supplier)"))
def knn_filter_anti(spark: SparkSession, d: str) -> DataFrame:
    denied = table(spark, d, "supplier").select(F.col("s_suppkey").alias("label"))
    return shown(exact.knn(base(spark, d).join(denied, "label", "left_anti"), asked(spark, d), 10))


@query(knn_sql(k=1 << 40, epsilon=1.3))
def range_search(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact.search(base(spark, d), asked(spark, d), "l2", policies.Radius(1.3)))


@query(knn_sql(k=3, epsilon=1.5))
def range_search_capped(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact.search(base(spark, d), asked(spark, d), "l2", policies.Radius(1.5, most=3)))


@query(knn_sql(k=1 << 40, epsilon=1.4, where="b.label % 2 = 1"))
def range_filtered(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact.search(base(spark, d), asked(spark, d), "l2", policies.Radius(1.4), F.col("label") % 2 == 1))


def _documents_sql(space: str, count: int) -> str:
    return f"""WITH {E}, p AS (
  SELECT a.label AS query_id, b.label, b.doc_id, {SQL_DISTANCE[space]} AS d FROM e a, e b
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY d, label) AS nth, row_number() OVER (PARTITION BY query_id ORDER BY d, label) AS rk FROM p
), s AS (
  SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY d, label ROWS UNBOUNDED PRECEDING) AS docs FROM r
) SELECT query_id, rk::INT AS rank, label, doc_id, round(d, 6) + 0.0 AS distance FROM s WHERE docs <= {count}"""


def _documents(name: str, space: str, count: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = exact.search(base(spark, d), asked(spark, d), space, policies.Documents(count))
        return found.select("query_id", "rank", "label", "doc_id", rounded(F.col("distance")).alias("distance"))

    query(_documents_sql(space, count), name)(run)


_documents("multivector_docs", "l2", 3)
_documents("multivector_ip", "ip", 4)


def indexed(spark: SparkSession, d: str, space: str = "l2", **more: int | bool) -> VectorIndex:
    """An index of all vectors, under their own labels."""
    rows = doubles(spark, d)
    index = VectorIndex(spark, space, 64)
    index.init_index(max_elements=2 * rows.count() or 1, **more)
    index.add_items(rows, ids="label")
    return index


@query(knn_sql())
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return shown(indexed(spark, d).knn_query(asked(spark, d), k=10, strict=True))


@query("SELECT vec_id AS query_id, vec_id AS label, 0.0::DOUBLE AS distance FROM embeddings")
def self_knn(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact.knn(base(spark, d), asked(spark, d), 1)).drop("rank")


@query(knn_sql(k=5, where="a.label <> b.label"))
def knn_self_join(spark: SparkSession, d: str) -> DataFrame:
    found = exact.knn(base(spark, d), asked(spark, d), 6).where(F.col("query_id") != F.col("label"))
    return shown(policies.TopK(5).choose(found.drop("rank")))


@query("SELECT 10 * count(*) AS matched, 10 * count(*) AS total, 1.0::DOUBLE AS recall FROM embeddings")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    by_product = exact.knn(base(spark, d), asked(spark, d), 10, "l2")
    by_pair = exact.knn(base(spark, d), asked(spark, d), 10, distances.l2)
    return exact.recall(by_product, by_pair)


RECALL_FLOOR = 0.95
AT_FLOOR = "SELECT count(*) * 10 AS total, true AS at_floor FROM embeddings"


def at_floor(found: DataFrame, truth: DataFrame) -> DataFrame:
    return exact.recall(found, truth).select("total", (F.col("recall") >= RECALL_FLOOR).alias("at_floor"))


@query(AT_FLOOR)
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    found = ann.ivf_knn(base(spark, d), asked(spark, d), 10, cells=16, probes=14)
    return at_floor(found, exact.knn(base(spark, d), asked(spark, d), 10))


@query(AT_FLOOR)
def ann_graph_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d)
    graph = shards.build(rows, ef_construction=80, shard_rows=500)
    probes, ef = shards.fitted(graph, rows, policies.TopK(10), 100)
    found = shards.knn(graph, asked(spark, d), 10, ef=ef, probes=probes)
    return at_floor(found, exact.knn(rows, asked(spark, d), 10))


@query("SELECT count(*) AS nodes, 0::BIGINT AS loops, 0::BIGINT AS repeated, 0::BIGINT AS strangers, 0::BIGINT AS without_inbound FROM embeddings")
def graph_integrity(spark: SparkSession, d: str) -> DataFrame:
    return ann.graph_integrity(shards.edges(shards.build(base(spark, d), ef_construction=80, shard_rows=500))).select("nodes", "loops", "repeated", "strangers", "without_inbound")


def graphed(spark: SparkSession, d: str, ef: int = 100) -> VectorIndex:
    """An index that is answered by beam search."""
    index = indexed(spark, d, ef_construction=80, strategy="graph")
    index.set_ef(ef)
    return index


@query(AT_FLOOR)
def index_graph_recall(spark: SparkSession, d: str) -> DataFrame:
    return at_floor(graphed(spark, d).knn_query(asked(spark, d), k=10), exact.knn(base(spark, d), asked(spark, d), 10))


@query("SELECT count(*) * 10 AS total, true AS at_floor, 0::BIGINT AS strangers FROM embeddings")
def index_graph_filter(spark: SparkSession, d: str) -> DataFrame:
    """The beam passes through deleted vectors and those that a filter excludes, and returns neither."""
    index = graphed(spark, d)
    index.mark_deleted(doubles(spark, d).where("doc_id = 3").select("label"))
    where = F.col("label") % 2 == 0
    found = index.knn_query(asked(spark, d), k=10, filter=where)
    strangers = found.agg(F.count_if((F.col("label") % 2 != 0) | (F.col("doc_id") == 3)).alias("strangers"))
    return at_floor(found, exact.knn(index.rows, asked(spark, d), 10, where=where)).join(F.broadcast(strangers))  # one row each


@query("SELECT true AS at_floor, 0::BIGINT AS beyond FROM embeddings LIMIT 1")
def index_graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the three nearest documents, by a beam that goes on until it knows where they end."""
    policy = policies.Documents(3)
    found = graphed(spark, d, 10).search(asked(spark, d), policy)
    beyond = found.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n")).agg(F.count_if(F.col("n") > 3).alias("beyond"))
    return at_floor(found, exact.search(base(spark, d), asked(spark, d), "l2", policy)).select("at_floor").join(F.broadcast(beyond))  # one row each


COPIES = 8


@query(f"SELECT count(*) * {COPIES * 10} AS total, true AS at_floor, true AS a_fifth_visited, true AS a_quarter_computed FROM embeddings")
def routed_recall(spark: SparkSession, d: str) -> DataFrame:
    """Each vector and slightly moved copies of it, in many small shards: the recall of visiting a fifth of them."""
    moved = F.transform("vector", lambda x, i: x + 0.02 * F.sin(F.col("copy") * 37 + F.col("label") * 11 + i * 5))
    rows = doubles(spark, d).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    rows = rows.select((F.col("label") * COPIES + F.col("copy")).alias("label"), F.when(F.col("copy") == 0, F.col("vector")).otherwise(moved).alias("vector"), "doc_id", F.lit(False).alias("deleted"))
    queries = rows.select(F.col("label").alias("query_id"), "vector")
    graph, seen = shards.build(rows, ef_construction=50, shard_rows=100), Observation()
    found = shards.knn(graph, queries, 10, ef=30, metrics=seen)
    out = at_floor(found, exact.knn(rows, queries, 10)).first()
    asked_, held = rows.count(), len(graph.held)
    shares = (seen.get["visits"] <= asked_ * -(-held // 5), seen.get["computed"] <= asked_ * asked_ / 4)
    return spark.createDataFrame([(out["total"], out["at_floor"], *shares)], "total long, at_floor boolean, a_fifth_visited boolean, a_quarter_computed boolean")


@query("SELECT count(*) * 10 AS total, true AS at_floor FROM embeddings")
def graph_updates(spark: SparkSession, d: str) -> DataFrame:
    """A graph that is mended after a tenth of its vectors moved, answers as well as one that is built anew."""
    index = graphed(spark, d)
    index.graph()
    index.add_items(_reversed(doubles(spark, d).where("doc_id = 3")), ids="label")
    return at_floor(index.knn_query(asked(spark, d), k=10), exact.knn(index.rows, asked(spark, d), 10))


# Lookups and metadata.


@query(f"WITH {E} SELECT label, {CHECKSUM} AS checksum FROM e")
def get_items(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).get_items(doubles(spark, d).select("label")).select("label", checksum("vector"))


@query("SELECT vec_id AS label FROM embeddings")
def get_ids_list(spark: SparkSession, d: str) -> DataFrame:
    index = indexed(spark, d)
    index.mark_deleted(doubles(spark, d).where("doc_id = 3").select("label"))
    return index.get_ids_list()


@query("""SELECT count(*) AS element_count, count(*) FILTER (label = 3) AS deleted_count, count(*) FILTER (label <> 3) AS live_count,
  (2 * count(*))::INT AS max_elements, 64 AS dim, 'l2' AS space, 16 AS m, 200 AS ef_construction, 50 AS ef FROM embeddings""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    index = indexed(spark, d)
    index.set_ef(50)
    index.mark_deleted(doubles(spark, d).where("doc_id = 3").select("label"))
    return index.stats()


# Mutations.


def _reversed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", F.reverse("vector"))


def state(index: VectorIndex | FlatIndex) -> DataFrame:
    return index.rows.select("label", "deleted", checksum("vector"))


UPSERTED = f"WITH {E}, u AS (SELECT label, CASE WHEN doc_id = 3 THEN list_reverse(v) ELSE v END AS v FROM e) SELECT label, false AS deleted, {CHECKSUM} AS checksum FROM u"


@query(UPSERTED)
def upsert(spark: SparkSession, d: str) -> DataFrame:
    index = indexed(spark, d)
    index.add_items(_reversed(doubles(spark, d).where("doc_id = 3")), ids="label")
    return state(index)


@query(UPSERTED)
def upsert_undelete(spark: SparkSession, d: str) -> DataFrame:
    index, third = indexed(spark, d), doubles(spark, d).where("doc_id = 3")
    index.mark_deleted(third.select("label"))
    index.add_items(_reversed(third), ids="label")
    return state(index)


@query(f"""WITH {E}, s AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS slot FROM e),
free AS (SELECT slot, row_number() OVER (ORDER BY slot) AS n FROM s WHERE doc_id = 3),
fresh AS (SELECT label + 1000000 AS label, v, row_number() OVER (ORDER BY label) AS n FROM s WHERE doc_id = 4),
z AS (SELECT fresh.label, v, coalesce(free.slot, (SELECT count(*) FROM s) + fresh.n - 1 - (SELECT count(*) FROM free)) AS slot FROM fresh LEFT JOIN free USING (n)),
u AS (SELECT label, v, slot, doc_id = 3 AS deleted FROM s WHERE slot NOT IN (SELECT slot FROM z) UNION ALL SELECT label, v, slot, false FROM z)
SELECT label, slot, deleted, {CHECKSUM} AS checksum FROM u""")
def replace_deleted(spark: SparkSession, d: str) -> DataFrame:
    index = indexed(spark, d, allow_replace_deleted=True)
    index.mark_deleted(doubles(spark, d).where("doc_id = 3").select("label"))
    index.add_items(doubles(spark, d).where("doc_id = 4").withColumn("label", F.col("label") + 1_000_000), ids="label", replace_deleted=True)
    return index.rows.select("label", "slot", "deleted", checksum("vector"))


@query("SELECT vec_id AS label, label = 3 AS deleted FROM embeddings")
def mark_deleted(spark: SparkSession, d: str) -> DataFrame:
    index = indexed(spark, d)
    index.mark_deleted(doubles(spark, d).where("doc_id = 3").select("label"))
    return index.rows.select("label", "deleted")


@query("SELECT vec_id AS label, label = 5 AS deleted FROM embeddings")
def unmark_deleted(spark: SparkSession, d: str) -> DataFrame:
    index, rows = indexed(spark, d), doubles(spark, d)
    index.mark_deleted(rows.where("doc_id IN (3, 5)").select("label"))
    index.unmark_deleted(rows.where("doc_id = 3").select("label"))
    return index.rows.select("label", "deleted")


@query(knn_sql(where="b.doc_id <> 3"))
def knn_after_delete(spark: SparkSession, d: str) -> DataFrame:
    index = indexed(spark, d)
    index.mark_deleted(doubles(spark, d).where("doc_id = 3").select("label"))
    return shown(index.knn_query(asked(spark, d), k=10))


@query("SELECT vec_id AS label FROM embeddings WHERE label <> 3")
def bf_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = doubles(spark, d)
    index = FlatIndex(spark, "l2", 64)
    index.init_index(max_elements=rows.count() or 1)
    index.add_items(rows, ids="label")
    index.delete_vector(rows.where("doc_id = 3").select("label").unionByName(rows.select((F.col("label") + 10**9).alias("label"))))
    return index.get_ids_list()


@query("SELECT count(*) AS element_count, (3 * count(*))::INT AS max_elements FROM embeddings")
def resize(spark: SparkSession, d: str) -> DataFrame:
    index = indexed(spark, d)
    index.resize_index(3 * index.get_current_count())
    return index.stats().select("element_count", "max_elements")


@query("SELECT event_id, count(*) AS n FROM events GROUP BY event_id")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A stream that repeats all events, in later micro-batches too; of each one row is kept while the watermark remembers it."""
    path = shared_path(spark, "stream")
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in (rows, rows.where("event_id % 2 = 0"), rows):
        part.coalesce(2).write.mode("append").parquet(f"{path}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/rows")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/kept/batch={n}")
    kept = maintain.deduplicated(stream, ["event_id"], "ts", "4000 days")
    kept.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/kept").groupBy("event_id").agg(F.count("*").alias("n"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """All vectors added, three documents deleted, one of them restored and one written anew."""
    rows = doubles(spark, d)
    of = lambda docs, op, at, v: rows.where(F.col("doc_id").isin(docs)).select((F.col("label") + at).alias("seq"), F.lit(op).alias("op"), "label", v.alias("vector"))
    none, own = F.lit(None).cast("array<double>"), F.col("vector")
    return (
        rows.select(F.col("label").alias("seq"), F.lit("add").alias("op"), "label", "vector")
        .unionByName(of([3, 5, 7], "delete", 10**8, none))
        .unionByName(of([5], "undelete", 2 * 10**8, none))
        .unionByName(of([7], "add", 3 * 10**8, F.reverse(own)))
    )


LOG_STATE = f"WITH {E}, u AS (SELECT label, doc_id = 3 AS deleted, CASE WHEN doc_id = 7 THEN list_reverse(v) ELSE v END AS v FROM e) SELECT label, deleted, {CHECKSUM} AS checksum FROM u"


@query(LOG_STATE)
def mutation_log_state(spark: SparkSession, d: str) -> DataFrame:
    return mutations.from_log(_log(spark, d)).select("label", "deleted", checksum("vector"))


@query(LOG_STATE)
def stream_mutations(spark: SparkSession, d: str) -> DataFrame:
    """The same log as a stream of several micro-batches."""
    path = shared_path(spark, "stream")
    log = _log(spark, d)
    for i in range(4):
        log.where((F.col("seq") / 10**8).cast("int") == i).coalesce(1).write.mode("append").parquet(f"{path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    run = maintain.maintain(stream, f"{path}/state").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return maintain.read_version(spark, f"{path}/state", run.lastProgress["batchId"]).select("label", "deleted", checksum("vector"))


@query(knn_sql())
def stream_knn(spark: SparkSession, d: str) -> DataFrame:
    """All queries as a stream against the static base."""
    path = shared_path(spark, "stream")
    rows, stored = asked(spark, d), base(spark, d)
    rows.repartition(2).write.parquet(f"{path}/asked")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/asked")
    sink = lambda found, n: found.write.mode("overwrite").parquet(f"{path}/found/batch={n}")
    maintain.answer(stream, stored, 10, sink).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return shown(spark.read.parquet(f"{path}/found"))


# Persistence.


def _saved(spark: SparkSession, d: str, space: str) -> str:
    path = shared_path(spark, "index")
    indexed(spark, d, space).save_index(path)
    return path


@query(knn_sql("ip"))
def save_load_knn(spark: SparkSession, d: str) -> DataFrame:
    index = VectorIndex(spark, "ip", 64)
    index.load_index(_saved(spark, d, "ip"))
    return shown(index.knn_query(asked(spark, d), k=10))


def _saved_again(spark: SparkSession, d: str) -> str:
    """An index that was saved, loaded, changed and saved over itself."""
    path = _saved(spark, d, "l2")
    index = VectorIndex(spark, "l2", 64)
    index.load_index(path)
    index.save_index(path)
    index.mark_deleted(doubles(spark, d).where("doc_id = 3").select("label"))
    index.save_index(path)
    return path


@query(knn_sql(where="b.doc_id <> 3"))
def save_over_own_path(spark: SparkSession, d: str) -> DataFrame:
    index = VectorIndex(spark, "l2", 64)
    index.load_index(_saved_again(spark, d))
    return shown(index.knn_query(asked(spark, d), k=10))


@query(knn_sql())
def load_older_version(spark: SparkSession, d: str) -> DataFrame:
    index = VectorIndex(spark, "l2", 64)
    index.load_index(_saved_again(spark, d), version=0)
    return shown(index.knn_query(asked(spark, d), k=10))


@query(knn_sql("ip"))
def load_other_space(spark: SparkSession, d: str) -> DataFrame:
    index = VectorIndex(spark, "ip", 64)
    index.load_index(_saved(spark, d, "l2"))
    return shown(index.knn_query(asked(spark, d), k=10))


@query(knn_sql())
def bf_save_load(spark: SparkSession, d: str) -> DataFrame:
    rows, path = doubles(spark, d), shared_path(spark, "index")
    index = FlatIndex(spark, "l2", 64)
    index.init_index(max_elements=rows.count() or 1)
    index.add_items(rows, ids="label")
    index.save_index(path)
    back = FlatIndex(spark, "l2", 64)
    back.load_index(path)
    return shown(back.knn_query(asked(spark, d), k=10))


@query(knn_sql())
def clone_index(spark: SparkSession, d: str) -> DataFrame:
    index = indexed(spark, d)
    copy = index.clone()
    index.mark_deleted(doubles(spark, d).select("label"))
    return shown(copy.knn_query(asked(spark, d), k=10))


@query(f"""WITH u AS (SELECT (vec_id + 101) * {0.6180339887498949!r}::DOUBLE AS turn FROM embeddings),
l AS (SELECT floor(-ln(1.0::DOUBLE - (turn - floor(turn))) / ln(16.0::DOUBLE)) AS level FROM u)
SELECT (96 + count(*) * (4 + 64 * 4 + 8 + 2 * 16 * 4 + 4) + sum(level) * (16 * 4 + 4))::BIGINT AS bytes FROM l""")
def index_file_size(spark: SparkSession, d: str) -> DataFrame:
    """Counted from the links of a graph that was built, saved and loaded."""
    path = shared_path(spark, "index")
    graphed(spark, d).save_index(path)
    index = VectorIndex(spark, "l2", 64)
    index.load_index(path)
    return spark.createDataFrame([(index.index_file_size(),)], "bytes long")


@query("WITH k AS (" + knn_sql() + ") SELECT query_id, rank, 'item-' || label AS external_id, distance FROM k")
def knn_object_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = doubles(spark, d).select(F.concat(F.lit("item-"), "label").alias("name"), "vector")
    index = VectorIndex(spark, "l2", 64)
    index.init_index(max_elements=rows.count() or 1)
    named = ObjectIndex(index)
    named.add_items(rows, ids="name")
    return named.knn_query(asked(spark, d), k=10).select("query_id", "rank", "external_id", rounded(F.col("distance")).alias("distance"))


@query("SELECT vec_id AS query_id, vec_id AS label FROM embeddings")
def lazy_index(spark: SparkSession, d: str) -> DataFrame:
    rows = doubles(spark, d)
    index = LazyIndex(spark, "l2", 64, max_elements=rows.count() or 1)
    index.add_items(rows, ids="label")
    return index.knn_query(asked(spark, d), k=1).select("query_id", "label")


# Codecs.


def series(spark: SparkSession, d: str) -> DataFrame:
    """Order totals, customer balances, and event values per user."""
    one = lambda name, sid, pos, value: table(spark, d, name).select(sid.alias("series_id"), F.col(pos).alias("pos"), F.col(value).alias("value"))
    return (
        one("orders", F.lit("orders"), "o_orderkey", "o_totalprice")
        .unionByName(one("customer", F.lit("customer"), "c_custkey", "c_acctbal"))
        .unionByName(one("events", F.concat(F.lit("events/"), "user_id"), "event_id", "value"))
    )


SERIES = """s AS (
  SELECT 'orders' AS series_id, o_orderkey AS pos, o_totalprice AS value FROM orders
  UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer
  UNION ALL SELECT 'events/' || user_id, event_id, value FROM events)"""


GORILLA_SQL = """b AS (
  SELECT series_id, pos, value::DOUBLE::BIT AS b, lag(value::DOUBLE::BIT) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM s
), x AS (
  SELECT series_id, pos, p IS NULL AS first, coalesce(b = p, false) AS same, CASE WHEN p IS NOT NULL THEN xor(b, p)::VARCHAR END AS x FROM b
), z AS (
  SELECT *, instr(x, '1') - 1 AS l, instr(reverse(x), '1') - 1 AS t FROM x WHERE NOT first AND NOT same
), w AS (
  SELECT *, coalesce(lag(l) OVER (PARTITION BY series_id ORDER BY pos), 0) AS pl, coalesce(lag(t) OVER (PARTITION BY series_id ORDER BY pos), 0) AS pt FROM z
), c AS (
  SELECT series_id, CASE WHEN l >= pl AND t >= pt THEN 66 - pl - pt ELSE 77 - least(l, 31) - t END AS bits FROM w
  UNION ALL SELECT series_id, CASE WHEN first THEN 64 ELSE 1 END FROM x WHERE first OR same
)"""
# Sizes in SQL hold for values of at most four decimals, which no codec here takes for an exception; the tables have two, and the
# components of vectors are rounded to four.
DECIMALS = """n AS (
  SELECT series_id, pos, value, round(value * 10000)::BIGINT AS v4, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS nth FROM s
)"""
CAMEL_SQL = f"""{DECIMALS}, places AS (
  SELECT *, CASE WHEN v4 % 1000 = 0 THEN 1 WHEN v4 % 100 = 0 THEN 2 WHEN v4 % 10 = 0 THEN 3 ELSE 4 END AS p, floor(value)::BIGINT AS whole FROM n
), parts AS (
  SELECT *, whole - lag(whole) OVER (PARTITION BY series_id ORDER BY pos) AS step, (v4 - whole * 10000) // [1000, 100, 10, 1][p] AS rest FROM places
), cut AS (
  SELECT *, rest // [5, 25, 125, 625][p] AS head, rest % [5, 25, 125, 625][p] AS tail FROM parts
), c AS (
  SELECT series_id, CASE WHEN nth = 1 THEN 64 WHEN abs(step) >= 65536 THEN 84 ELSE
    CASE WHEN abs(step) <= 1 THEN 2 WHEN abs(step) < 8 THEN 7 ELSE 20 END + 3 + CASE WHEN head > 0 THEN p ELSE 0 END
    + CASE p WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN tail < 8 THEN 4 ELSE 6 END
      WHEN 3 THEN CASE WHEN tail < 2 THEN 3 WHEN tail < 8 THEN 5 WHEN tail < 32 THEN 7 ELSE 9 END
      ELSE CASE WHEN tail < 16 THEN 6 WHEN tail < 64 THEN 8 WHEN tail < 256 THEN 10 ELSE 12 END END END AS bits FROM cut
)"""
ELF_SQL = f"""{DECIMALS}, places AS (
  SELECT *, CASE WHEN v4 % 10000 = 0 THEN 0 WHEN v4 % 1000 = 0 THEN 1 WHEN v4 % 100 = 0 THEN 2 WHEN v4 % 10 = 0 THEN 3 ELSE 4 END AS p, (value::DOUBLE::BIT)::VARCHAR AS raw FROM n
), spared AS (
  SELECT *, 52 - ([0, 4, 7, 10, 14][p + 1] + ('0b' || raw[2:12])::INT - 1023) AS spare FROM places
), erased AS (
  SELECT *, nth > 1 AND v4 <> 0 AND spare > 4 AND spare < 64 AND instr(raw[65 - greatest(least(spare, 64), 0):], '1') > 0 AS cut FROM spared
), kept AS (
  SELECT series_id, pos, nth, cut, (CASE WHEN cut THEN raw[:64 - spare] || repeat('0', spare::INT) ELSE raw END)::BIT AS b FROM erased
), x AS (
  SELECT *, xor(b, lag(b) OVER (PARTITION BY series_id ORDER BY pos))::VARCHAR AS x FROM kept
), z AS (
  SELECT *, CASE WHEN nth = 1 THEN 0 WHEN instr(x, '1') = 0 THEN 7 ELSE least(instr(x, '1') - 1, 7) END AS l, CASE WHEN nth = 1 THEN 0 WHEN instr(x, '1') = 0 THEN 64 ELSE instr(reverse(x), '1') - 1 END AS t FROM x
), w AS (
  SELECT *, lag(l) OVER (PARTITION BY series_id ORDER BY pos) AS pl, lag(t) OVER (PARTITION BY series_id ORDER BY pos) AS pt FROM z
), c AS (
  SELECT series_id, CASE WHEN nth = 1 THEN 64 ELSE CASE WHEN cut THEN 5 ELSE 1 END + CASE WHEN t = 64 THEN 2 WHEN l = pl AND t >= pt THEN 66 - pl - pt
    WHEN 64 - l - t > 16 THEN 75 - l - t ELSE 73 - l - t END END AS bits FROM w
)"""


def dexor_sql(buffer_bits: int = 0) -> str:
    """Sizes of DeXOR with the last ``2**buffer_bits`` values at hand."""
    before = ", ".join(f"coalesce(lag(v4, {i}) OVER (PARTITION BY series_id ORDER BY pos), 0)" for i in range(1, (1 << buffer_bits) + 1))
    tens = ", ".join(str(10**i) for i in range(19))
    cut = lambda v: f"(sign({v})::BIGINT * (abs({v}) // [{tens}][least(place + d, 18) + 1]))"
    zeros = " ".join(f"WHEN v4 % {10**k} = 0 THEN {k}" for k in range(13, 0, -1))
    return f"""{DECIMALS}, placed AS (
  SELECT *, CASE WHEN v4 = 0 THEN 4 {zeros} ELSE 0 END AS place, [{before}] AS known FROM n
), tried AS (
  SELECT series_id, pos, v4, place, min(d) AS delta FROM (SELECT *, unnest(range(0, 16)) AS d, unnest([known for _ in range(0, 16)]) AS own FROM placed)
  WHERE len(list_filter(own, lambda k: {cut("k")} = {cut("v4")})) > 0 GROUP BY ALL
), w AS (
  SELECT *, coalesce(lag(place) OVER (PARTITION BY series_id ORDER BY pos), 4) AS pp, coalesce(lag(delta) OVER (PARTITION BY series_id ORDER BY pos), 0) AS pd, delta AS d FROM tried
), c AS (
  SELECT series_id, {2 + buffer_bits} + CASE WHEN place = pp AND delta = pd THEN 0 WHEN place = pp THEN 4 ELSE 9 END
    + CASE WHEN {cut("v4")} = 0 THEN 1 ELSE 0 END + [0, 4, 7, 10, 14, 17, 20, 24, 27, 30, 34, 37, 40, 44, 47, 50][delta + 1] AS bits FROM w
)"""


SIZE_SQL = {"gorilla": GORILLA_SQL, "elf": ELF_SQL, "camel": CAMEL_SQL, "dexor": dexor_sql(), "dexor_buffered": dexor_sql(3), "dexor_skip": dexor_sql()}


def sized_sql(name: str) -> str:
    return f"WITH {SERIES}, {SIZE_SQL[name]} SELECT series_id, count(*) AS n_values, sum(bits)::BIGINT AS n_bits FROM c GROUP BY series_id"


@query(sized_sql("gorilla"))
def gorilla_bits(spark: SparkSession, d: str) -> DataFrame:
    return codecs.gorilla_bits(series(spark, d))


#: Rows of a micro-batch, about.
STREAMED = 2_000_000


def _streamed(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """The same sizes from a stream: the codec's state is kept per series."""
        path = shared_path(spark, "stream")
        rows = series(spark, d)
        # A file a micro-batch, in order of pos, so that no batch grows with the table: it is held by a task, if all is of one series.
        parts = max(3, -(-rows.count() // STREAMED))
        dealt = rows.repartitionByRange(parts, "pos").withColumn("part", F.spark_partition_id())
        dealt.write.partitionBy("part").parquet(f"{path}/parts")
        for part in range(parts):
            own = spark.read.schema(dealt.schema).parquet(f"{path}/parts").where(F.col("part") == part).drop("part")
            own.coalesce(1).write.mode("append").parquet(f"{path}/rows")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/rows")
        sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/sizes/batch={n}")
        sizes = maintain.codec_sizes(stream, *SIZED[name])
        sizes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
        last = spark.read.parquet(f"{path}/sizes")
        return last.groupBy("series_id").agg(F.max("n_values").alias("n_values"), F.max("n_bits").alias("n_bits"))

    query(sized_sql(name), f"stream_{name}_bits")(run)


SIZED = {
    "gorilla": ("Gorilla", None),
    "elf": ("Elf", None),
    "camel": ("Camel", None),
    "dexor": ("DeXOR", None),
    "dexor_buffered": ("DeXOR", {"buffer_bits": 3}),
    "dexor_skip": ("DeXOR", {"skip_available": 4}),
}


def _codec(name: str) -> None:
    codec, config = SIZED[name]

    def bits(spark: SparkSession, d: str) -> DataFrame:
        blocks = codecs.compress(series(spark, d), codec, config)
        return blocks.groupBy("series_id").agg(F.sum("n_values").alias("n_values"), F.sum("n_bits").alias("n_bits"))

    def roundtrip(spark: SparkSession, d: str) -> DataFrame:
        return codecs.decompress(codecs.compress(series(spark, d), codec, config), codec, config)

    if name != "gorilla":
        query(sized_sql(name), f"{name}_bits")(bits)
    query(f"WITH {SERIES} SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS idx, value FROM s", f"{name}_roundtrip")(roundtrip)


for _name in SIZED:
    _codec(_name)
for _name in ("gorilla", "elf", "camel", "dexor_buffered"):
    _streamed(_name)


ROUNDED = "s AS (SELECT (i - 1)::VARCHAR AS series_id, vec_id AS pos, round(embedding[i]::DOUBLE, 4) + 0.0 AS value FROM embeddings, range(1, 65) t(i))"


@query(" UNION ALL ".join(f"(WITH {ROUNDED}, {sql} SELECT '{name}' AS algorithm, count(*) AS n_values, sum(bits)::BIGINT AS n_bits FROM c)" for name, sql in SIZE_SQL.items()))
def codec_bits_total(spark: SparkSession, d: str) -> DataFrame:
    """Total bits of every dimension of the vectors, per codec."""
    rows = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("series_id", "value"), F.col("vec_id").alias("pos"))
    return codecs.total_bits(rows.select(F.col("series_id").cast("string"), "pos", F.round(F.col("value").cast("double"), 4).alias("value")), SIZED)


EXCEPTIONS = "s AS (SELECT (i - 1)::VARCHAR AS series_id, vec_id AS pos, embedding[i]::DOUBLE * 1e-30::DOUBLE AS value FROM embeddings, range(1, 65) t(i))"


def exceptions_sql(marks: str, rho: int = 8) -> str:
    """Sizes of DeXOR's exceptions: the width of exponent differences as it grows and shrinks, value by value."""
    return f"""WITH RECURSIVE {EXCEPTIONS}, n AS (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY series_id) AS n, ('0b' || substr((value::BIT)::VARCHAR, 2, 11))::INT AS exponent FROM s
), run(series_id, nth, exponent, width, small, bits) AS (
  SELECT DISTINCT series_id, 0::BIGINT, 1023, 1, 0, 0::BIGINT FROM n
  UNION ALL
  SELECT r.series_id, v.nth, v.exponent,
    CASE WHEN abs(v.exponent - r.exponent) > (1 << (r.width - 1)) - 1 THEN least(10, r.width + 1)
      WHEN r.width > 1 AND abs(v.exponent - r.exponent) <= (1 << (r.width - 2)) - 1 AND r.small + 1 = {rho} THEN r.width - 1 ELSE r.width END,
    CASE WHEN abs(v.exponent - r.exponent) > (1 << (r.width - 1)) - 1 OR r.width = 1 THEN CASE WHEN r.width = 1 AND v.exponent = r.exponent THEN r.small ELSE 0 END
      WHEN abs(v.exponent - r.exponent) > (1 << (r.width - 2)) - 1 OR r.small + 1 = {rho} THEN 0 ELSE r.small + 1 END,
    r.bits + r.width + CASE WHEN abs(v.exponent - r.exponent) <= (1 << (r.width - 1)) - 1 THEN 53 ELSE 64 END
  FROM run r JOIN n v ON v.series_id = r.series_id AND v.nth = r.nth + 1
) SELECT r.series_id, n.n AS n_values, (r.bits + 2 * {marks})::BIGINT AS n_bits FROM run r JOIN n ON n.series_id = r.series_id AND n.nth = r.nth AND n.nth = n.n"""


def _exceptions(name: str, config: dict[str, int], marks: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Values too small for any decimal form: all are exceptions."""
        rows = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("series_id", "value"), F.col("vec_id").alias("pos"))
        rows = rows.select(F.col("series_id").cast("string").alias("series_id"), "pos", (F.col("value").cast("double") * F.lit(1e-30)).alias("value"))
        return codecs.compress(rows, "DeXOR", config).groupBy("series_id").agg(F.sum("n_values").alias("n_values"), F.sum("n_bits").alias("n_bits"))

    query(exceptions_sql(marks), name)(run)


_exceptions("dexor_exceptions", {}, "n.n")
_exceptions("dexor_exceptions_skip", {"skip_available": 4}, "least(n.n, 4)")


@query(f"WITH {SERIES} SELECT series_id, pos, value FROM s")
def series_blocks_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "blocks")
    series_blocks.write(series(spark, d), path)
    return series_blocks.read(spark, path)


@query(f"WITH {SERIES} SELECT series_id, pos, value FROM s WHERE pos BETWEEN 1000 AND 3000 AND value > 100")
def series_blocks_range(spark: SparkSession, d: str) -> DataFrame:
    """A range of positions and values: of the stored blocks those that may hold any are decoded."""
    path = shared_path(spark, "blocks")
    series_blocks.write(series(spark, d), path, rows=500)
    return series_blocks.read(spark, path).where("pos BETWEEN 1000 AND 3000 AND value > 100")


@query(f"WITH {SERIES} SELECT count(*) AS n_values, true AS smallest FROM s")
def codec_trial(spark: SparkSession, d: str) -> DataFrame:
    """No block is larger than any codec alone would make it."""
    sizes = blocks.sizes(blocks.compress(series(spark, d), 2000))
    return sizes.agg(F.sum("n_values").alias("n_values"), F.bool_and(F.col("n_bits") <= F.array_min("each")).alias("smallest"))


@query("""WITH b AS (SELECT o_orderkey, (o_totalprice::DOUBLE::BIT)::VARCHAR AS b FROM orders)
SELECT o_orderkey, (instr(b, '1') - 1)::INT AS lead, (instr(reverse(b), '1') - 1)::INT AS trail, length(replace(b, '0', ''))::INT AS ones FROM b""")
def float_bits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", codecs.double_bits(F.col("o_totalprice")).alias("b"))
    lead, trail = codecs._zeros(F.col("b"))
    return rows.select("o_orderkey", lead.cast("int").alias("lead"), trail.cast("int").alias("trail"), F.bit_count("b").alias("ones"))
