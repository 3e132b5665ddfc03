"""Views of the tables that the queries share, for Spark and as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vector as V


class Tables:
    """The tables below one folder, and views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    def kg_nodes(self) -> DataFrame:
        part = self.part
        sets = [
            self.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("Artwork").alias("label"), F.concat(F.lit("order "), "o_orderkey").alias("name")),
            self.customer.select(F.concat(F.lit("c"), "c_custkey"), F.lit("Artist"), "c_name"),
            self.orders.select(F.concat(F.lit("style:"), "o_orderpriority"), F.lit("Style"), "o_orderpriority").distinct(),
            self.orders.select(F.concat(F.lit("genre:"), "o_orderstatus"), F.lit("Genre"), "o_orderstatus").distinct(),
            part.select(F.concat(F.lit("media:"), "p_type"), F.lit("Media"), "p_type").distinct(),
            part.select(F.concat(F.lit("tag:"), "p_brand"), F.lit("Tag"), "p_brand").distinct(),
        ]
        out = sets[0]
        for s in sets[1:]:
            out = out.unionAll(s)
        return out

    def kg_edges(self) -> DataFrame:
        o, head = self.orders, F.concat(F.lit("o"), "o_orderkey")
        lines = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        item = F.concat(F.lit("o"), "l_orderkey")
        return (
            o.select(head.alias("head"), F.lit("createdBy").alias("rel"), F.concat(F.lit("c"), "o_custkey").alias("tail"))
            .unionAll(o.select(head, F.lit("hasStyle"), F.concat(F.lit("style:"), "o_orderpriority")))
            .unionAll(o.select(head, F.lit("hasGenre"), F.concat(F.lit("genre:"), "o_orderstatus")))
            .unionAll(lines.select(item, F.lit("madeOf"), F.concat(F.lit("media:"), "p_type")).distinct())
            .unionAll(lines.select(item, F.lit("about"), F.concat(F.lit("tag:"), "p_brand")).distinct())
        )

    def vec(self) -> DataFrame:
        return self.embeddings.select("vec_id", V.double(F.col("embedding")).alias("v"), "label")

    def mv(self) -> DataFrame:
        return self.vec().select(F.expr("vec_id div 5").alias("doc_id"), F.expr("vec_id % 5").alias("tok"), "v")

    def centroids(self) -> DataFrame:
        from ..operators import retrieval

        return retrieval.centroids(self.vec(), "label", "v").withColumnRenamed("label", "cid").withColumnRenamed("v", "c")

    def paras(self) -> DataFrame:
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))

    def tree(self) -> DataFrame:
        """(parent, child, kind) over region, nation, customer and order."""
        key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        return (
            self.nation.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"), F.lit("category").alias("kind"))
            .unionAll(self.customer.select(key("n", "c_nationkey"), key("c", "c_custkey"), F.lit("category")))
            .unionAll(self.orders.select(key("c", "o_custkey"), key("o", "o_orderkey"), F.lit("page")))
        )


#: DuckDB: view -> SELECT; a view may use those before it.
SQL = {
    "kg_nodes": "SELECT 'o' || o_orderkey AS id, 'Artwork' AS label, 'order ' || o_orderkey AS name FROM orders UNION ALL SELECT 'c' || c_custkey, 'Artist', c_name FROM customer UNION ALL SELECT DISTINCT 'style:' || o_orderpriority, 'Style', o_orderpriority FROM orders UNION ALL SELECT DISTINCT 'genre:' || o_orderstatus, 'Genre', o_orderstatus FROM orders UNION ALL SELECT DISTINCT 'media:' || p_type, 'Media', p_type FROM part UNION ALL SELECT DISTINCT 'tag:' || p_brand, 'Tag', p_brand FROM part",
    "kg_edges": "SELECT 'o' || o_orderkey AS head, 'createdBy' AS rel, 'c' || o_custkey AS tail FROM orders UNION ALL SELECT 'o' || o_orderkey, 'hasStyle', 'style:' || o_orderpriority FROM orders UNION ALL SELECT 'o' || o_orderkey, 'hasGenre', 'genre:' || o_orderstatus FROM orders UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'madeOf', 'media:' || p_type FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'about', 'tag:' || p_brand FROM lineitem JOIN part ON l_partkey = p_partkey",
    "vec": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    "mv": "SELECT vec_id // 5 AS doc_id, vec_id % 5 AS tok, v FROM vec",
    "elems": "SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM vec",
    "centroids": "SELECT label AS cid, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM elems GROUP BY ALL) GROUP BY label",
    "paras": "SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)",
    "tree": "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, 'category' AS kind FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'category' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'page' FROM orders",
}
_NEEDS = {"mv": ["vec"], "elems": ["vec"], "centroids": ["vec", "elems"]}


def with_views(names: list[str], body: str) -> str:
    """body after the named views, and before them those that they need."""
    wanted = {n for x in names for n in (*_NEEDS.get(x, ()), x)}
    ctes = [f"{n} AS ({SQL[n]})" for n in SQL if n in wanted]
    if not ctes:
        return body
    joined = ", ".join(ctes)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {joined}, {body[15:]}"
    return f"WITH {joined}, {body[5:]}" if body.startswith("WITH ") else f"WITH {joined} {body}"
