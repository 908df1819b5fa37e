"""The canonical fleet model derived from the star-schema tables.

``events`` are the fleet's signals: views and clicks are sensor readings, signups
inspections, errors failures, purchases maintenance and the orders for it.  ``part``
describes the components; each of the nations is a depot, whose capacity its
suppliers give.  All derivations are plain arithmetic, so they run inside code
generation and push filters on the event type down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.sources.store import materialize
from upkeep.sources.warehouse import Warehouse, listing_digest

SEVERITIES = "array('low', 'medium', 'high', 'critical')"
REPORTED = "array('wheel scan', 'brake thermal', 'bogie acoustic', 'pantograph camera', 'general')"
KINDS = "array('wheel_profile', 'brake_disc', 'bogie_frame', 'pantograph_head', 'door_actuator')"

DEPOTS = 25  # the nations of the star schema, a table of fixed size


#: Setting of the session that names a folder where marts are kept between queries.
MARTS = "upkeep.marts"
INPUTS = ("events", "part", "supplier", "nation", "orders", "lineitem", "customer", "region")


class Fleet:
    """Lazy tables of one data folder."""

    @classmethod
    def over(cls, spark: SparkSession, path: str) -> Fleet:
        """The fleet of a folder; where the session's setting MARTS names a folder, marts are found there again while inputs and code stay the same."""
        marts = spark.conf.get(MARTS, None)
        return cls(spark, path, Warehouse(spark, marts, listing_digest(spark, path, INPUTS)) if marts else None)

    def __init__(self, spark: SparkSession, path: str, warehouse: Warehouse | None = None):
        """warehouse: where marts are kept and found again; without one they are written anew for this object."""
        self.spark, self.path, self.warehouse = spark, path, warehouse
        self._stored: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def stored(self, name: str, build: Callable[[], DataFrame], by: str | None = None, order: Sequence[str] = ()) -> DataFrame:
        """A mart that several steps read: built and written once; by, order: in sorted buckets of a column."""
        if self.warehouse:
            return self.warehouse.table(name, build, by=by, order=order)
        if name not in self._stored:
            self._stored[name] = materialize(build(), name, by, order)
        return self._stored[name]

    def has(self, name: str) -> bool:
        """Whether a mart is there, or will be kept for others once it is built."""
        return bool(self.warehouse) or name in self._stored

    def shared(self, name: str, build: Callable[[], DataFrame], by: str | None = None, order: Sequence[str] = ()) -> DataFrame:
        """A mart kept in the warehouse if there is one, else just its plan."""
        return self.stored(name, build, by, order) if self.warehouse else build()

    @cached_property
    def signals(self) -> DataFrame:
        return self.table("events").selectExpr("event_id", "ts", "cast(ts as date) as day", "user_id as component_id", "user_id div 8 as unit_id", "event_type", "value")

    @cached_property
    def kept(self) -> Fleet:
        """The same fleet over its signals written once, with their days and sorted by type, so that each type's rows are read without the others': for marts that read them many times."""
        other = type(self)(self.spark, self.path, self.warehouse)
        other._stored = self._stored
        other.signals = self.stored("signals", lambda: self.signals.sortWithinPartitions("event_type"))
        other.kept = other
        return other

    @cached_property
    def members(self) -> DataFrame:
        """(component_id, unit_id, reads): each component seen, with its unit and whether it has readings, from one pass over the events; units, components and lines all come of it."""
        seen = lambda: self.signals.groupBy("component_id", "unit_id").agg(F.coalesce(F.max(F.col("event_type").isin("view", "click")), F.lit(False)).alias("reads"))
        return self.stored("members", seen)

    @cached_property
    def read_members(self) -> DataFrame:
        """(component_id, unit_id) of the readings."""
        return self.members.where("reads").select("component_id", "unit_id")

    @cached_property
    def readings(self) -> DataFrame:
        return self.signals.where(F.col("event_type").isin("view", "click")).selectExpr(
            "event_id as reading_id", "ts", "day", "unit_id", "component_id", "value", "20 + (event_id % 100) / 2 as temperature", "cast(event_id % 13 as double) as vibration", "cast(event_id % 150 as double) as wear", "(50 + event_id % 50) / 100 as load"
        )

    @cached_property
    def inspections(self) -> DataFrame:
        return self.signals.where("event_type = 'signup'").selectExpr(
            "event_id as inspection_id", "ts", "day", "unit_id", "component_id", "least(100.0D, value) as score", "case when value >= 60 then 1 else 0 end as defect", "(50 + event_id % 50) / 100 as confidence", f"element_at({SEVERITIES}, cast(event_id % 4 as int) + 1) as severity", f"element_at({REPORTED}, cast(event_id % 5 as int) + 1) as reported"
        )

    @cached_property
    def failures(self) -> DataFrame:
        return self.signals.where("event_type = 'error'").selectExpr(
            "event_id as failure_id", "ts", "day", "unit_id", "component_id", "cast(1 + event_id % 5 as int) as severity", "1 + value / 50 as downtime_h", "cast(event_id % 2 as int) as repeated", "concat('mode_', event_id % 3) as mode"
        )

    @cached_property
    def alerts(self) -> DataFrame:
        return self.readings.where("value > 80").selectExpr(
            "reading_id as alert_id", "ts", "day", "unit_id", "component_id", "case when reading_id % 3 != 0 then 1 else 0 end as early", "cast(reading_id % 2 as int) as attended", f"element_at({SEVERITIES}, cast(reading_id % 4 as int) + 1) as severity", "case when reading_id % 5 < 3 then 'sensor' else 'inspection' end as origin"
        )

    @cached_property
    def maintenance(self) -> DataFrame:
        return self.signals.where("event_type = 'purchase'").selectExpr(
            "event_id as maintenance_id", "ts", "day", "unit_id", "component_id", f"unit_id % {DEPOTS} as depot_id", "case when event_id % 3 = 0 then 1 else 0 end as corrective", "case when event_id % 3 = 1 then 1 else 0 end as condition_based", "case when event_id % 3 = 2 then 1 else 0 end as planned", "1 + value / 100 as hours", "value * 20 as cost"
        )

    @cached_property
    def span(self) -> DataFrame:
        """One row: first and last day."""
        return self.stored("span", lambda: self.signals.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")))

    @cached_property
    def calendar(self) -> DataFrame:
        return self.span.selectExpr("explode(sequence(first_day, last_day)) as day")

    @cached_property
    def backlog(self) -> DataFrame:
        """Open orders at each weekly snapshot from their day on."""
        weeks = self.span.selectExpr("explode(sequence(first_day, last_day, interval 7 days)) as snapshot")
        orders = self.signals.where("event_type = 'purchase'")
        open_ = orders.join(F.broadcast(weeks), F.col("snapshot") >= F.col("day"))
        return open_.selectExpr(
            "snapshot as day", "event_id as order_id", f"unit_id % {DEPOTS} as depot_id", "unit_id", "component_id", "datediff(snapshot, day) as age_days", f"element_at({SEVERITIES}, cast(event_id % 4 as int) + 1) as severity", "least(100.0D, datediff(snapshot, day) * 2 + value / 5) as risk"
        )

    @cached_property
    def units(self) -> DataFrame:
        return self.members.select("unit_id").distinct().selectExpr(
            "unit_id", "unit_id % 6 as fleet_id", f"unit_id % {DEPOTS} as depot_id", "unit_id % 16 as line_id", "concat(3 + unit_id % 4, '_cars') as configuration", "(5 + unit_id % 6) / 2 as service_criticality"
        )

    @cached_property
    def components(self) -> DataFrame:
        seen = self.members.select("component_id").distinct()
        parts = self.table("part").join(seen, F.col("p_partkey") == F.col("component_id"), "left_semi")
        return parts.selectExpr(
            "p_partkey as component_id", "p_partkey div 8 as unit_id", "p_type as system", f"element_at({KINDS}, cast(p_partkey % 5 as int) + 1) as kind", "cast(1 + p_size % 5 as double) as criticality", "p_size / 40 as age_ratio", "(p_retailprice - 900) / 100 as cycles_ratio"
        )

    @cached_property
    def depots(self) -> DataFrame:
        wealth = self.table("supplier").groupBy("s_nationkey").agg(F.round(F.avg(F.abs("s_acctbal")), 2).alias("wealth"))
        nations = self.table("nation").join(wealth, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        return nations.selectExpr(
            "cast(n_nationkey as long) as depot_id", "n_name as depot_name", "50 + coalesce(wealth, 0.0D) / 200 as capacity", f"concat(element_at({KINDS}, cast(n_nationkey % 5 as int) + 1), ' ', element_at({KINDS}, cast((n_nationkey + 2) % 5 as int) + 1)) as speciality"
        )

    @cached_property
    def service(self) -> DataFrame:
        """Unit days: hours planned, lost and left."""
        lost = self.failures.groupBy("day", "unit_id").agg(F.sum("downtime_h").alias("d"))
        shop = self.maintenance.groupBy("day", "unit_id").agg(F.sum("hours").alias("h"))
        days = self.units.crossJoin(F.broadcast(self.calendar)).join(lost, ["day", "unit_id"], "left").join(shop, ["day", "unit_id"], "left")
        days = days.withColumn("unavailable_h", F.expr("least(20.0D, coalesce(d, 0.0D) + coalesce(h, 0.0D) * 13 / 20)"))
        return days.selectExpr(
            "day", "unit_id", "fleet_id", "line_id", "20.0D as planned_h", "20 - unavailable_h as available_h", "unavailable_h", "floor(unavailable_h / 4) as cancellations", "unavailable_h / 20 as punctuality_hit", "case when unavailable_h > 8 then 1 else 0 end as substitution"
        )

    @cached_property
    def context(self) -> DataFrame:
        lines = self.units.select("line_id").distinct()
        return lines.crossJoin(F.broadcast(self.calendar)).selectExpr(
            "day", "line_id", "cast(10 + (line_id * 3 + dayofmonth(day)) % 25 as double) as ambient", "cast(40 + (line_id + dayofmonth(day)) % 30 as double) as humidity", "(10 + line_id % 5) / 10 as intensity", "(line_id % 5) / 5 as congestion"
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """People's reviews of the last day's decisions: each order is one, of the component with its customer's number, in the four weeks that follow."""
        last = self.span.select("last_day")
        return self.table("orders").crossJoin(F.broadcast(last)).selectExpr(
            "o_orderkey as review_id", "o_custkey as component_id", "case o_orderstatus when 'F' then 'approved' when 'O' then 'rejected' else 'escalated' end as approval_status", "concat('reviewer_', substr(o_orderpriority, 1, 1)) as reviewer_id", "timestampadd(HOUR, cast(o_orderkey % 660 as int), cast(date_add(last_day, 1) as timestamp)) as reviewed_at"
        )
