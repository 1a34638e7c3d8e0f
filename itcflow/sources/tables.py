"""Table scans (S1) and the GST model over a folder of parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, settings, shared_dir
from . import bridge

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


#: The stored entities with their column types.
ENTITIES = {
    "ca_partners": "id int, name string, ca_number string, email string, phone string, plan string, white_label_name string, "
                   "is_active boolean, created_at timestamp",
    "users": "id int, phone string, business_name string, gstin string, state_code string, ca_id int, created_at timestamp",
    "invoices": "id bigint, user_id bigint, seller_gstin string, invoice_no string, date timestamp, taxable_amt decimal(18,2), "
                "cgst decimal(18,2), sgst decimal(18,2), igst decimal(18,2), status string, ai_category string, "
                "ai_confidence double, created_at timestamp",
    "transactions": "user_id bigint, date timestamp, type string, gst_rate double, amount decimal(18,2)",
    "gst_ledger": "user_id bigint, period string, total_purchases decimal(18,2), itc_available decimal(18,2)",
    "filing_history": "user_id bigint, return_type string, period string, filed_at timestamp, penalty double",
    "gstr2b_cache": "user_id bigint, period string, supplier_gstin string, invoice_no string, itc_amount decimal(18,2), "
                    "filing_status string",
    "alerts": "id int, user_id int, type string, trigger_date timestamp, message_hi string, message_en string, "
              "sent_at timestamp, status string",
}


def entity(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Typed scan of a stored entity: the schema is given, not inferred."""
    return spark.read.schema(ENTITIES[name]).parquet(f"{folder.rstrip('/')}/{name}")


def load(spark: SparkSession, sf_dir: str, name: str, schema=None) -> DataFrame:
    """Typed scan of one table. Column pruning and filter pushdown are left
    to Catalyst: callers select/filter, the parquet reader sees only that."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: How tables are staged: the shuffles behind one go from the disks as soon as it is
#: written, and a join whose smaller side is that small in every task sorts nothing.
STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m"}
#: Bytes of the largest input of a job in slices that one of them may shuffle.
SLICE = 1 << 30


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: for a job that reads
    the result of a join or a parse several times."""
    return staged_slices([df], name)


def staged_slices(dfs, name: str) -> DataFrame:
    """``staged`` for the rows of several frames of one schema, written one after the other:
    the disks hold the shuffles of one of them at a time."""
    path, df = None, None
    for df in dfs:
        path = path or shared_dir(df.sparkSession, f"itcflow-staged/{uuid.uuid4().hex}/{name}")
        with settings(df.sparkSession, STAGING):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes the staged tables that ``df`` reads: no frame may read them any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/itcflow-staged/" in folder:
            remove(df.sparkSession, folder)


def slices(df: DataFrame) -> int:
    """In how many slices to shuffle a table: one for each ``SLICE`` bytes of it."""
    return 1 + int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SLICE


def in_slice(key: str, i: int, n: int):
    """The rows of slice ``i`` of ``n`` by a key, null included."""
    return F.pmod(F.xxhash64(key), F.lit(n)) == i


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over at least as many tasks as there are cores, for work that costs
    far more than the shuffle: a file with one row group is else read, and worked on, by one task."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


class Model:
    """Lazy DataFrames of the GST model (FIXTURES.md bridge views) over one folder.

    Nothing is computed here: every attribute is a logical plan, so a report
    that needs three columns of ``invoices`` scans three-plus-key columns.
    ``materialize`` writes the fact tables once (partitioned by month) to the
    shared folder for the jobs that read them many times.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in DRIVER_TABLES:
                self._frames[name] = load(self.spark, self.sf_dir, name)
            elif name == "ledger":
                from ..operators.aggregates import build_ledger
                self._frames[name] = build_ledger(self.table("invoices"), basis="saved")
            elif name == "invoices":
                self._frames[name] = self._invoices(self._invoice_rows())
            elif name in bridge.VIEWS:
                sql, deps = bridge.VIEWS[name]
                frames = {d: self.table(d) for d in deps}
                self._frames[name] = self.spark.sql(bridge.render(sql, "spark"), **frames)
            else:
                raise KeyError(name)
        return self._frames[name]

    def _invoice_rows(self, i: int = 0, n: int = 1) -> DataFrame:
        """The five tables of the ``invoices`` view, or slice ``i`` of ``n`` of them by order. Spark joins
        them as they are written: the lines meet the parts while they are narrow, orders meet
        their customers before the lines (they are fewer), and the texts of the suppliers come last."""
        on = lambda a, b: F.col(a) == F.col(b)
        orders, lines = self.table("orders"), self.table("lineitem")
        if n > 1:
            orders, lines = orders.filter(in_slice("o_orderkey", i, n)), lines.filter(in_slice("l_orderkey", i, n))
        orders = orders.join(self.table("customer"), on("o_custkey", "c_custkey"))
        return (lines.join(self.table("part"), on("l_partkey", "p_partkey"))
                    .join(orders, on("l_orderkey", "o_orderkey")).join(self.table("supplier_gstin"), on("l_suppkey", "s_suppkey")))

    def _invoices(self, rows: DataFrame) -> DataFrame:
        df = self.spark.sql(bridge.render(bridge.INVOICE_FIELDS, "spark") + "FROM {rows}", rows=rows)
        # canonical money type of the model: DECIMAL(18,2)
        money = ["taxable_amt", "cgst", "sgst", "igst"]
        return df.select(*[F.col(c).cast("decimal(18,2)").alias(c) if c in money else c for c in df.columns])

    def stage(self, name: str, *cols: str) -> "Model":
        """``staged`` for a table of the model (or some of its columns): the views on it read
        what was written. Large invoices are joined in slices of orders."""
        if name == "invoices" and name not in self._frames:
            n = slices(self.table("lineitem"))
            parts = (self._invoices(self._invoice_rows(i, n)) for i in range(n))
        else:
            parts = [self.table(name)]
        return self.replace(name, staged_slices((p.select(*cols) if cols else p for p in parts), name))

    def replace(self, name: str, df: DataFrame) -> "Model":
        """From now on the views on a table read ``df``."""
        self._frames[name] = df
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "sf_dir"):
            raise AttributeError(name)
        try:
            return self.table(name)
        except KeyError as e:
            raise AttributeError(name) from e

    def materialize(self, out_dir: str, names=("invoices", "users", "ledger"), files: int | None = None) -> "Model":
        """Write the named tables as parquet and re-read them (cuts lineage).
        ``files`` is the number of files of the tables that aren't partitioned:
        a small table that came as one row group can then be read by many tasks.

        ``invoices`` is partitioned by the month of its date, so the filing
        month filter becomes partition pruning.
        """
        for n in names:
            df = self.table(n)
            path = f"{out_dir.rstrip('/')}/{n}"
            if n == "invoices":
                # range on (month, id): a month holding a third of all rows is
                # cut over many tasks instead of landing in one writer
                (df.withColumn("date_month", F.date_format("date", "yyyy-MM"))
                   .repartitionByRange("date_month", "id")
                   .write.mode("overwrite").partitionBy("date_month").parquet(path))
                self._frames[n] = self.spark.read.parquet(path)
            else:
                (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)
                self._frames[n] = self.spark.read.parquet(path)
        return self
