"""The logical tables over a folder of sales-schema Parquet files.

Orders and their lines play monthly tax facts, customers play payers. ``VIEW_SQL`` states
the same tables as plain SQL; it is the yardstick for the DataFrame versions below, which
are arranged for large inputs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.operators import paging
from fiscus.schemas import MONTHLY_TAX, TAXPAYER
from fiscus.session import materialize
from fiscus.sources import files, ranked, tables
from fiscus.sources.store import Store

#: The tables that payers and facts are made of.
BASES = ("customer", "nation", "region", "orders", "lineitem")

LAST_REAL_YEAR = 2000
PREDICTED_YEAR = 2001
ECON_FROM_YEAR = 1998

VIEW_SQL = {
    "taxpayer": """
        select c_custkey as taxpayer_id, c_name as full_name,
          cast(1000000000 + c_custkey as string) as passport_number,
          cast(100000000000 + c_custkey as string) as inn,
          c_mktsegment as taxpayer_type, r_name as activity_type,
          n_name as registration_district,
          (c_mktsegment <> 'HOUSEHOLD' and c_custkey % 2 = 1) as has_employees,
          case when c_mktsegment <> 'HOUSEHOLD' and c_custkey % 2 = 1
               then cast(1 + c_custkey % 20 as int) end as employees_count
        from customer join nation on c_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
    "tax_all": """
        select o_custkey as taxpayer_id, cast(year(o_orderdate) as int) as yr,
          cast(month(o_orderdate) as int) as mon, o_orderpriority as tax_type,
          sum(round(cast(l_extendedprice as decimal(18,2))
                    * (1 - cast(l_discount as decimal(4,2))), 2)) as income,
          sum(round(cast(l_extendedprice as decimal(18,2))
                    * (1 - cast(l_discount as decimal(4,2)))
                    * cast(l_tax as decimal(4,2)), 2)) as tax,
          count(*) as transactions
        from orders join lineitem on o_orderkey = l_orderkey group by 1, 2, 3, 4""",
    "monthly_tax": "select * from tax_all where yr <= 2000",
    "predict": """
        select a.*, t.inn, t.full_name, t.taxpayer_type, t.activity_type,
          t.registration_district, t.has_employees, t.employees_count
        from tax_all a join taxpayer t on a.taxpayer_id = t.taxpayer_id where a.yr = 2001""",
    "econ": """
        select yr, mon, cast(sum(transactions) as double) as core_cpi,
          case when mon <> 6 then cast(count(*) as double) end as cpi_yoy,
          cast(null as double) as retail_sales
        from tax_all where yr >= 1998 group by yr, mon""",
    "preds": """
        select l_orderkey, l_linenumber,
          case when l_linenumber = 1 then 0.0e0 else l_extendedprice end as y_test,
          l_extendedprice * (1 - l_discount) as y_pred
        from lineitem""",
}
VIEW_NEEDS = {
    "taxpayer": (),
    "tax_all": (),
    "monthly_tax": ("tax_all",),
    "predict": ("tax_all", "taxpayer"),
    "econ": ("tax_all",),
    "preds": (),
}


def with_views(sql: str, *views: str) -> str:
    """``sql`` preceded by the views it names and the views those need."""
    needed: list[str] = []

    def add(view: str) -> None:
        for other in VIEW_NEEDS[view]:
            add(other)
        if view not in needed:
            needed.append(view)

    for view in views:
        add(view)
    if not needed:
        return sql
    heads = ", ".join(f"{view} as ({VIEW_SQL[view]})" for view in needed)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {heads}, {body[5:]}"
    return f"with {heads} {body}"


def _jan_first(year: int) -> Column:
    return F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")


def _cents(name: str) -> Column:
    """Hundredths of an amount or rate that has two decimals, as a whole number."""
    return F.rint(F.col(name) * 100).cast("long")


def _money(cents: Column) -> Column:
    """Whole cents as decimal(18,2); eighteen digits keep the product in a machine word."""
    return cents.cast("decimal(15,0)") * F.lit(0.01).cast("decimal(2,2)")


class Warehouse:
    """Lazy logical tables; nothing runs until a query over them does."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def taxpayer(self) -> DataFrame:
        employs = (F.col("c_mktsegment") != "HOUSEHOLD") & (F.col("c_custkey") % 2 == 1)
        places = self.base("nation").join(
            self.base("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.base("customer")
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("taxpayer_id"),
                F.col("c_name").alias("full_name"),
                (F.col("c_custkey") + 1000000000).cast("string").alias("passport_number"),
                (F.col("c_custkey") + 100000000000).cast("string").alias("inn"),
                F.col("c_mktsegment").alias("taxpayer_type"),
                F.col("r_name").alias("activity_type"),
                F.col("n_name").alias("registration_district"),
                employs.alias("has_employees"),
                F.when(employs, (F.col("c_custkey") % 20 + 1).cast("int")).alias(
                    "employees_count"
                ),
            )
        )

    def facts(self, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
        """Monthly facts, one row per payer, month and regime.

        Lines are added up per order before the join: that shrinks what is shuffled,
        leaves one row for an order however many lines it has, and its hashing on the
        order key is the one the join needs. The years become a range on the order date,
        which the Parquet scan can use. Line amounts are rounded half up to cents in whole
        numbers, several times cheaper than decimals and just as exact.
        """
        orders = self.base("orders")
        if start_year is not None:
            orders = orders.where(F.col("o_orderdate") >= _jan_first(start_year))
        if end_year is not None:
            orders = orders.where(F.col("o_orderdate") < _jan_first(end_year + 1))
        per_order = (
            self.base("lineitem")
            .select(
                "l_orderkey",
                (_cents("l_extendedprice") * (100 - _cents("l_discount"))).alias("net"),
                _cents("l_tax").alias("tax"),
            )
            .selectExpr(
                "l_orderkey",
                "(net + cast(signum(net) as bigint) * 50) div 100 as income",
                "(net * tax + cast(signum(net * tax) as bigint) * 5000) div 10000 as tax",
            )
            .groupBy("l_orderkey")
            .agg(
                F.sum("income").alias("income"),
                F.sum("tax").alias("tax"),
                F.count(F.lit(1)).alias("transactions"),
            )
        )
        return (
            orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(
                F.col("o_custkey").alias("taxpayer_id"),
                F.year("o_orderdate").alias("yr"),
                F.month("o_orderdate").alias("mon"),
                F.col("o_orderpriority").alias("tax_type"),
            )
            .agg(
                _money(F.sum("income")).alias("income"),
                _money(F.sum("tax")).alias("tax"),
                F.sum("transactions").alias("transactions"),
            )
        )

    def recorded(self, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
        """Recorded facts of some years; the range reaches the scan of the orders."""
        last = LAST_REAL_YEAR if end_year is None else min(end_year, LAST_REAL_YEAR)
        return self.facts(start_year, last)

    def of_payer(self, inn: str) -> OnePayer:
        """The same tables of one payer."""
        return OnePayer(self.spark, self.folder, inn)

    @cached_property
    def version(self) -> str:
        """Changes with the files of the tables; they are listed, not read."""
        return files.data_version(self.spark, *[f"{self.folder}/{t}.parquet" for t in BASES])

    def _kept(self, kind: str, write) -> str:
        store = Store(self.spark)
        return store.get(store.place(kind, self.folder, self.version), write)

    @cached_property
    def worked_out(self) -> DataFrame:
        """Facts of all years as they come, worked out once for each version of the tables.

        What is stored by year and the economy are made from these, so the lines are read and joined once.
        """
        path = self._kept("worked-out", lambda path: self.facts().select(*MONTHLY_TAX.names).write.parquet(path))
        return tables.read_table(self.spark, path, MONTHLY_TAX)

    @cached_property
    def facts_folder(self) -> str:
        """Where the recorded facts are stored by year; stored once for each version of the tables."""
        return self._kept("facts", lambda path: tables.write_facts(self.worked_out.where(F.col("yr") <= LAST_REAL_YEAR), path))

    @cached_property
    def predicted_folder(self) -> str:
        """The same for the predicted year."""

        def write(path: str) -> None:
            coming = self.worked_out.where(F.col("yr") == PREDICTED_YEAR)
            known = coming.join(self.taxpayer.select("taxpayer_id"), "taxpayer_id")
            tables.write_facts(known.select(*MONTHLY_TAX.names), path)

        return self._kept("predicted", write)

    @cached_property
    def stored_facts(self) -> DataFrame:
        return tables.read_table(self.spark, self.facts_folder, MONTHLY_TAX).select(*MONTHLY_TAX.names)

    @cached_property
    def stored_predicted(self) -> DataFrame:
        return tables.read_table(self.spark, self.predicted_folder, MONTHLY_TAX).select(*MONTHLY_TAX.names)

    @cached_property
    def stored_payers(self) -> DataFrame:
        """Payers by INN, for look-ups."""
        path = self._kept("payers", lambda path: tables.write_payers(self.taxpayer, path))
        return tables.read_table(self.spark, path, TAXPAYER)

    def payer_page(self, page: int, page_size: int, sort_by: str = "taxpayer_id", sort_order: str = "asc") -> DataFrame:
        """A page of the whole list of payers; the list is sorted once for each version of the tables."""
        rows, order = self.taxpayer.select(*paging.SORTABLE), paging.order_columns(sort_by, sort_order)
        path = self._kept(f"pages-{sort_by}-{sort_order.lower()}", lambda path: ranked.write_ranked(rows, order, path))
        return ranked.ranked_page(self.spark, path, rows.schema, page, page_size)

    @cached_property
    def tax_all(self) -> DataFrame:
        return self.facts()

    @cached_property
    def monthly_tax(self) -> DataFrame:
        return self.facts(end_year=LAST_REAL_YEAR)

    @cached_property
    def predict(self) -> DataFrame:
        payers = self.taxpayer.drop("passport_number")
        return self.facts(PREDICTED_YEAR, PREDICTED_YEAR).join(payers, "taxpayer_id")

    @cached_property
    def econ(self) -> DataFrame:
        return self._economy(self.facts(start_year=ECON_FROM_YEAR))

    @cached_property
    def stored_econ(self) -> DataFrame:
        """The same from the facts that are kept, for those who need these anyway."""
        return self._economy(self.worked_out.where(F.col("yr") >= ECON_FROM_YEAR))

    @staticmethod
    def _economy(facts: DataFrame) -> DataFrame:
        return facts.groupBy("yr", "mon").agg(
            F.sum("transactions").cast("double").alias("core_cpi"),
            F.count(F.lit(1)).cast("double").alias("n"),
        ).select(
            "yr",
            "mon",
            "core_cpi",
            F.when(F.col("mon") != 6, F.col("n")).alias("cpi_yoy"),
            F.lit(None).cast("double").alias("retail_sales"),
        )

    @cached_property
    def preds(self) -> DataFrame:
        return self.base("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            F.when(F.col("l_linenumber") == 1, 0.0)
            .otherwise(F.col("l_extendedprice"))
            .alias("y_test"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y_pred"),
        )

    @cached_property
    def tax_objects(self) -> DataFrame:
        """Asset lines of payers: an order line is an object, its return flag the kind."""
        lines = self.base("lineitem").join(
            self.base("orders").select("o_orderkey", "o_custkey"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        return lines.select(
            F.col("o_custkey").alias("taxpayer_id"),
            F.col("l_returnflag").alias("object_type"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("taxable_base"),
            F.to_date("l_shipdate").alias("acquisition_date"),
        )


class OnePayer(Warehouse):
    """The logical tables of one payer, for look-ups that must not shuffle everybody's lines.

    The payer's orders are stored first. Spark then knows how few they are, and their order ids
    bound the scan of the lines and pick from it before anything is shuffled.
    """

    def __init__(self, spark: SparkSession, folder: str, inn: str):
        super().__init__(spark, folder)
        self.inn = inn
        # What is kept is kept of all payers.
        self.whole = Warehouse(spark, folder)

    @cached_property
    def taxpayer(self) -> DataFrame:
        return self.whole.stored_payers.where(F.col("inn") == F.lit(self.inn))

    def _kept(self, kind: str, write) -> str:
        raise ValueError("ask the whole warehouse for stored tables")

    @cached_property
    def _orders(self) -> DataFrame:
        ids = self.taxpayer.agg(F.min("taxpayer_id").alias("lo"), F.max("taxpayer_id").alias("hi"))
        orders = super().base("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        own = orders.where(F.col("o_custkey") >= ids.select("lo").scalar())
        return materialize(own.where(F.col("o_custkey") <= ids.select("hi").scalar()), "payer-orders")

    def base(self, name: str) -> DataFrame:
        if name == "orders":
            return self._orders
        if name != "lineitem":
            return super().base(name)
        ends = self._orders.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).first()
        if ends["lo"] is None:
            return super().base(name).limit(0)
        lines = super().base(name).where(F.col("l_orderkey").between(ends["lo"], ends["hi"]))
        keys = self._orders.select(F.col("o_orderkey").alias("l_orderkey"))
        return lines.join(keys, "l_orderkey", "left_semi")
