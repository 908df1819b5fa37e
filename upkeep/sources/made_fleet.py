"""A made fleet of 15 canonical tables, on which every mart runs; no inputs but sizes and a seed.

Wear is a recursion over the days of a component: it grows with the line's stress and
with shocks, a failure or a visit to the workshop restores it, and what happens depends
on how worn it is.  All draws come from hashes of (seed, stream, keys), so components
are made in parallel, come out the same whatever the partitions, and are made again
after a lost executor.  Everything but the recursion is Column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.sources.fleet import Fleet
from upkeep.sources.synthetic import choice, normal, uniform
from upkeep.sources.warehouse import Warehouse

#: Lines, depots and fleets are few and fixed; units, their components and days grow.
LINES, DEPOT_COUNT, FLEETS, REGIONS = 16, 10, 6, 4
STRATEGIES = ("mixed", "preventive", "condition")
#: Kind of component: system, inspected as, sensors, criticality, days of life, answer to vibration.
KIND_TABLE = {
    "motor": ("traction", "wheel", ("temperature", "current", "vibration"), 4.8, 2200, 1.2), "gearbox": ("traction", "bogie", ("vibration", "temperature", "noise"), 4.5, 1900, 1.3),
    "wheelset": ("running gear", "wheel", ("vibration", "wear", "temperature", "noise"), 4.6, 1400, 1.6), "brake": ("braking", "brake", ("pressure", "wear", "temperature", "vibration"), 4.9, 1000, 1.4),
    "suspension": ("suspension", "bogie", ("vibration", "temperature", "noise"), 4.4, 2400, 1.2), "pantograph": ("current collection", "pantograph", ("current", "vibration", "temperature", "pressure"), 4.3, 1150, 1.3),
    "door": ("doors", "other", ("current", "noise", "vibration"), 3.5, 1200, 0.9), "climate": ("auxiliaries", "other", ("temperature", "current", "pressure"), 3.2, 1600, 1.0),
}
KIND_NAMES = tuple(KIND_TABLE)
FAMILIES = ("wheel", "brake", "bogie", "pantograph")

#: The recursion: highest wear, chance and mean of a shock, least and worn-out hazard of a day, wear that is noticed and how often, wear kept by a restoration of each kind.
TOP, SHOCK, SHOCK_MEAN, HAZARD, WORN_HAZARD, NOTICED, NOTICE = 1.42, 0.006, 0.02, 0.0002, 0.02, 0.85, 0.05
CORRECTIVE, CONDITION, PLANNED = 1, 2, 3
KEPT = (1.0, 0.25, 0.4, 0.55)
#: Component days that a task holds at once before it hands them on.
CHUNK = 65_536

STATE = "component_id long, k int, wear double, failed int, restored int"


def mixed(seed: int, stream: int, ids: np.ndarray, k: int) -> np.ndarray:
    """A value in [0, 1) for each id on day k: two rounds of a 64-bit finaliser over seed, stream, day and id."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((seed * 1_000_003 + stream) * 1_000_003 + k) % (1 << 64))
        for _ in range(2):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def wear_over_days(seed: int, days: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Components (with their line's stress of each day) to their days; the wear of a day is that before its restoration."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f.component_id.to_numpy()
            wear, stress = f.start.to_numpy(dtype=float), np.stack(f.stress.to_numpy()) if len(f) else np.empty((0, days))
            rate, repeats, phase, every = (f[c].to_numpy() for c in ("rate", "repeats", "phase", "every"))
            by_condition, by_calendar, kept, held = f.by_condition.to_numpy(), f.by_calendar.to_numpy(), np.array(KEPT), []
            for k in range(days):
                shock = np.where(mixed(seed, 0, ids, k) < SHOCK * (1 + repeats), -SHOCK_MEAN * np.log1p(-mixed(seed, 1, ids, k)), 0.0)
                wear = np.minimum(wear + rate * stress[:, k] + shock, TOP)
                failed = mixed(seed, 2, ids, k) < HAZARD + WORN_HAZARD * wear**4 * (1 + repeats)
                noticed = by_condition & (wear > NOTICED) & (mixed(seed, 3, ids, k) < NOTICE)
                due = by_calendar & ((k + phase) % every == 0)
                restored = np.where(failed, CORRECTIVE, np.where(noticed, CONDITION, np.where(due, PLANNED, 0)))
                held.append((ids, np.full(len(ids), k), wear, failed, restored))
                wear = wear * kept[restored]
                if len(held) * len(ids) >= CHUNK or k == days - 1:
                    yield pd.DataFrame(dict(zip(("component_id", "k", "wear", "failed", "restored"), map(np.concatenate, zip(*held, strict=True)), strict=True))).astype({"k": "int32", "failed": "int32", "restored": "int32"})
                    held = []

    return run


def gamma(shape: Column, scale: float, z: Column) -> Column:
    """About a gamma value for a standard normal one (the cube of a normal), at least 0."""
    return F.greatest(shape * F.pow(1 - 1 / (9 * shape) + z / (3 * F.sqrt(shape)), 3), F.lit(0.0)) * scale


def within(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c))


def among(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), index.cast("int") + 1)


def by_kind(values: list) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("kind_id") + 1)


class MadeFleet(Fleet):
    """units x 8 components over days; ``tables`` gives all 15, and the marts take it as any fleet."""

    def __init__(self, spark: SparkSession, units: int = 144, days: int = 730, first_day: str = "2023-01-01", seed: int = 42, warehouse: Warehouse | None = None):
        super().__init__(spark, "", warehouse)
        self.n_units, self.n_days, self.first_day, self.seed = units, days, first_day, seed

    def table(self, name: str) -> DataFrame:
        raise ValueError(f"a made fleet has no input table {name}")

    def day(self, k: Column) -> Column:
        return F.date_add(F.lit(self.first_day).cast("date"), k)

    def u(self, stream: str, *keys: str) -> Column:
        return uniform(self.seed, stream, F.xxhash64(*keys))

    def z(self, stream: str, *keys: str) -> Column:
        return normal(self.seed, stream, F.xxhash64(*keys))

    @cached_property
    def span(self) -> DataFrame:
        return self.spark.range(1).select(self.day(F.lit(0)).alias("first_day"), self.day(F.lit(self.n_days - 1)).alias("last_day"))

    @cached_property
    def fleets(self) -> DataFrame:
        f = self.spark.range(FLEETS).withColumnRenamed("id", "fleet_id")
        return f.select("fleet_id", F.format_string("Fleet %d", "fleet_id").alias("fleet_name"), (F.col("fleet_id") % REGIONS).alias("region_id"), among(STRATEGIES, F.col("fleet_id") % 3).alias("strategy"), F.round(0.78 + 0.16 * self.u("intensity", "fleet_id"), 3).alias("use_intensity"), F.round(3.8 + self.u("criticality", "fleet_id"), 2).alias("criticality"))

    @cached_property
    def depots(self) -> DataFrame:
        d = self.spark.range(DEPOT_COUNT).withColumnRenamed("id", "depot_id")
        special = F.concat_ws(" ", among(KIND_NAMES, F.col("depot_id") % 8), among(KIND_NAMES, (F.col("depot_id") + 3) % 8))
        return d.select("depot_id", F.format_string("Depot %02d", "depot_id").alias("depot_name"), F.round(45 + 50 * self.u("capacity", "depot_id"), 1).alias("capacity"), special.alias("speciality"), (F.col("depot_id") % REGIONS).alias("region_id"))

    @cached_property
    def _units(self) -> DataFrame:
        u = self.spark.range(self.n_units).withColumnRenamed("id", "unit_id").withColumn("fleet_id", F.col("unit_id") % FLEETS)
        u = u.join(F.broadcast(self.fleets), "fleet_id").withColumn("choices", F.ceil((DEPOT_COUNT - F.col("region_id")) / REGIONS))
        return u.withColumns({
            "depot_id": F.col("region_id") + REGIONS * F.floor(self.u("depot", "unit_id") * F.col("choices")), "line_id": F.col("region_id") + REGIONS * F.floor(self.u("line", "unit_id") * (LINES // REGIONS)),
            "configuration": F.concat((3 + F.floor(self.u("cars", "unit_id") * 4)).cast("string"), F.lit("_cars")), "service_criticality": F.round(within(F.col("criticality") + 0.4 * self.z("unit criticality", "unit_id"), 2.5, 5), 2),
            "years": 1.2 + 12.8 * self.u("years", "unit_id"),
        })

    @cached_property
    def units(self) -> DataFrame:
        return self._units.select("unit_id", "fleet_id", "depot_id", "line_id", "configuration", "service_criticality", F.round(F.col("years") * 150_000 * (0.7 + 0.6 * self.u("km", "unit_id"))).cast("long").alias("kilometres"))

    @cached_property
    def _components(self) -> DataFrame:
        c = self._units.select("unit_id", "line_id", "depot_id", "strategy", F.explode(F.sequence(F.lit(0), F.lit(len(KIND_NAMES) - 1))).alias("kind_id"))
        c = c.withColumn("component_id", F.col("unit_id") * len(KIND_NAMES) + F.col("kind_id"))
        of = list(KIND_TABLE.values())
        c = c.withColumns({"kind": by_kind(list(KIND_NAMES)), "system": by_kind([v[0] for v in of]), "family": by_kind([v[1] for v in of]), "sensors": F.split(by_kind([",".join(v[2]) for v in of]), ","), "base": by_kind([v[3] for v in of]), "life_days": by_kind([v[4] for v in of]), "shake": by_kind([v[5] for v in of])})
        every = within(F.col("life_days") * (0.24 + 0.1 * self.u("every", "component_id")), 110, 320).cast("int")
        return c.withColumns({
            "age_days": (120 + F.floor(self.u("age", "component_id") * 1880)).cast("int"), "repeats": (self.u("repeats", "component_id") < 0.12).cast("int"), "criticality": F.round(F.col("base") + 0.25 * self.z("criticality", "component_id"), 2),
            "every": every, "phase": (1 + F.floor(self.u("phase", "component_id") * 320)).cast("int"), "rate": (0.8 + 0.4 * self.u("rate", "component_id")) / F.col("life_days"),
        })

    @cached_property
    def components(self) -> DataFrame:
        age = F.round(F.col("age_days") / F.col("life_days"), 4)
        return self._components.select("component_id", "unit_id", "system", "kind", F.col("family").alias("inspected_as"), "criticality", F.col("age_days").alias("installed_days"), "life_days", age.alias("age_ratio"), F.round(age * (0.7 + 0.6 * self.u("cycles", "component_id")), 4).alias("cycles_ratio"))

    @cached_property
    def context(self) -> DataFrame:
        """Line days: weather with a season, service with weekdays."""
        c = self.spark.range(LINES * self.n_days).select((F.col("id") % LINES).alias("line_id"), F.floor(F.col("id") / LINES).cast("int").alias("k")).withColumn("day", self.day(F.col("k")))
        season = lambda shift: F.sin(2 * math.pi * F.dayofyear("day") / 365.25 + shift)
        c = c.withColumns({"ambient": F.round(14 + 10 * season(self.u("warm", "line_id") - 0.5) + 1.2 * self.z("ambient", "line_id", "k"), 2), "humidity": F.round(within(58 + 15 * season(self.u("wet", "line_id") + 0.5) + 3 * self.z("humidity", "line_id", "k"), 20, 95), 2)})
        busy = 0.9 + 0.05 * (F.col("line_id") % 5) + F.when(F.dayofweek("day").isin(1, 7), -0.06).otherwise(0.06) + 0.07 * self.z("intensity", "line_id", "k")
        c = c.withColumn("intensity", F.round(within(busy, 0.55, 1.45), 3))
        return c.withColumn("congestion", F.round(within(0.36 + 0.42 * F.col("intensity") + 0.08 * self.z("congestion", "line_id", "k"), 0.1, 0.98), 3)).drop("k")

    @cached_property
    def state(self) -> DataFrame:
        """Component days, written once: wear, failures and restorations.

        Stress goes to the components as one array a line: 16 arrays of a value a day.
        """
        k = F.datediff("day", self.day(F.lit(0)))
        stress = (0.75 + 0.35 * F.col("intensity") + 0.2 * F.col("congestion")) * (1 + 0.08 * within((F.col("ambient") - 18) / 20, -0.5, 1.5) + 0.04 * within((F.col("humidity") - 60) / 20, -1, 1.5))
        lines = self.context.groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), stress.alias("s")))), lambda x: x["s"]).alias("stress"))
        start = within(F.col("age_days") / F.col("life_days") * (0.4 + 0.4 * self.u("start", "component_id")), 0.03, 1.1)
        asked = self._components.join(F.broadcast(lines), "line_id").select("component_id", start.alias("start"), "rate", "repeats", "phase", "every", (F.col("strategy") != "preventive").alias("by_condition"), (F.col("strategy") != "condition").alias("by_calendar"), "stress")
        days = asked.mapInPandas(wear_over_days(self.seed, self.n_days), STATE)
        about = self._components.select("component_id", "unit_id", "line_id", "depot_id", "kind", "kind_id", "family", "shake", "repeats", "sensors", F.col("criticality").alias("component_criticality"))
        return self.stored("state", lambda: days.withColumn("day", self.day(F.col("k"))).join(about, "component_id").join(F.broadcast(self.context), ["day", "line_id"]))

    def key(self, per_day: int = 1, number: Column | int = 0) -> Column:
        """One number for each component, day and number of the day."""
        return (F.col("component_id") * self.n_days + F.col("k")) * per_day + number

    @cached_property
    def _signals(self) -> DataFrame:
        noise = lambda name: self.z(name, "component_id", "k")
        s = self.state.withColumn("load", F.round(within(0.5 + 0.32 * F.col("intensity") + 0.12 * F.col("congestion") + 0.05 * noise("load"), 0.35, 1.45), 4))
        return s.withColumns({
            "temperature": F.round(38 + 30 * F.col("wear") + 5 * F.col("intensity") + 0.25 * F.col("ambient") + 2 * noise("temperature"), 4), "vibration": F.round(F.greatest(F.lit(0.0), 1 + 2.5 * F.col("wear") * F.col("shake") + 1.5 * F.col("load") + 0.3 * noise("vibration")), 4),
            "pressure": F.round(4.5 + 0.7 * F.col("intensity") - 1.3 * F.col("wear") + 0.2 * noise("pressure"), 4), "worn": F.round(within(100 * F.col("wear") + 3 * noise("worn"), 0, 145), 4), "current": F.round(70 + 90 * F.col("load") + 65 * F.col("wear") + 5 * noise("current"), 4), "noise": F.round(44 + 10 * F.col("wear") + 12 * F.col("intensity") + 1.5 * noise("noise"), 4),
        })

    @cached_property
    def readings(self) -> DataFrame:
        """A row for each sensor of a component's day."""
        s = self._signals.select("*", F.posexplode("sensors").alias("number", "sensor"))
        value = F.coalesce(*(F.when(F.col("sensor") == name, F.col("worn" if name == "wear" else name)) for name in ("temperature", "vibration", "pressure", "wear", "current", "noise")))
        at = F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.lit(12))
        return s.select(self.key(8, F.col("number")).alias("reading_id"), at.alias("ts"), "day", "unit_id", "component_id", "sensor", value.alias("value"), "temperature", "vibration", F.col("worn").alias("wear"), "load")

    @cached_property
    def failures(self) -> DataFrame:
        keys = ("component_id", "k")
        f = self.state.where("failed = 1").withColumn("severity", within(F.round(1 + 2.1 * F.col("wear") + 0.6 * F.col("repeats") + 0.7 * self.z("severity", *keys)), 1, 5).cast("int"))
        mode = F.concat(F.lit("mode_"), F.col("kind"), F.lit("_"), F.floor(self.u("mode", *keys) * 3).cast("string"))
        hours = F.round(within(gamma(1.8 + 0.5 * F.col("severity"), 1.7, self.z("downtime", *keys)), 0.5, 72), 3)
        return f.select(self.key().alias("failure_id"), F.col("day").cast("timestamp").alias("ts"), "day", "unit_id", "component_id", "severity", hours.alias("downtime_h"), F.col("repeats").alias("repeated"), mode.alias("mode"))

    @cached_property
    def inspections(self) -> DataFrame:
        """Every 42 days, and at times when much worn; kinds without a family of inspection have none."""
        keys = ("component_id", "k")
        s = self.state.where(F.col("family").isin(*FAMILIES) & ((((F.col("k") + F.col("component_id")) % 42) == 0) | ((F.col("wear") > 0.82) & (self.u("look", *keys) < 0.04))))
        s = s.withColumn("score", F.round(within(15 + 60 * F.col("wear") + 12 * self.z("score", *keys), 0, 100), 3))
        defect = (self.u("defect", *keys) < within(0.7 / (1 + F.exp((60 - F.col("score")) / 12)) + 0.02, 0.02, 0.82)).cast("int")
        severity = F.when(F.col("score") <= 35, "low").when(F.col("score") <= 55, "medium").when(F.col("score") <= 75, "high").otherwise("critical")
        sure = F.round(within(0.9 - 0.28 * F.abs(F.col("ambient") - 20) / 55 + 0.05 * self.z("sure", *keys), 0.45, 0.99), 4)
        return s.select(self.key().alias("inspection_id"), F.col("day").cast("timestamp").alias("ts"), "day", "unit_id", "component_id", "family", "score", defect.alias("defect"), sure.alias("confidence"), severity.alias("severity"), F.col("family").alias("reported"))

    @cached_property
    def alerts(self) -> DataFrame:
        """From sensors (hot, shaking or worn), from inspections that found a defect, and from failures."""
        keys = ("component_id", "k")
        hot, shaking, worn = ((F.col(c) > top) & (self.u(f"alert {c}", *keys) < share) for c, top, share in (("temperature", 80.0, 0.12), ("vibration", 6.4, 0.1), ("worn", 92.0, 0.16)))
        level = F.when(F.col("wear") > 0.95, "critical").when(F.col("wear") > 0.8, "high").otherwise("medium")
        seen = self._signals.where(hot | shaking | worn).select(self.key(3, 0).alias("alert_id"), "day", "unit_id", "component_id", F.lit(1).alias("early"), (self.u("attended", *keys) < 0.58).cast("int").alias("attended"), level.alias("severity"), F.lit("sensor").alias("origin"))
        found = self.inspections.where("defect = 1 AND severity IN ('high', 'critical')").select((F.col("inspection_id") * 3 + 1).alias("alert_id"), "day", "unit_id", "component_id", F.lit(1).alias("early"), (self.u("attended", "inspection_id") < 0.65).cast("int").alias("attended"), "severity", F.lit("inspection").alias("origin"))
        failed = self.failures.select((F.col("failure_id") * 3 + 2).alias("alert_id"), "day", "unit_id", "component_id", F.lit(0).alias("early"), F.lit(1).alias("attended"), F.when(F.col("severity") >= 4, "critical").otherwise("high").alias("severity"), F.lit("failure").alias("origin"))
        return seen.unionByName(found).unionByName(failed).withColumn("ts", F.col("day").cast("timestamp"))

    @cached_property
    def maintenance(self) -> DataFrame:
        """The restorations: after failures, on condition, and by calendar."""
        keys = ("component_id", "k")
        kind = F.col("restored")
        z = self.z("hours", *keys)
        hours = F.round(F.when(kind == CORRECTIVE, within(gamma(F.lit(3.2), 2.1, z), 1.8, 48)).when(kind == CONDITION, within(5.2 + 1.4 * z, 2, 13)).otherwise(within(4.8 + 1.6 * z, 1.5, 12)), 3)
        m = self.state.where("restored > 0").withColumn("hours", hours)
        cost = F.round(F.col("hours") * (75 + 60 * self.u("rate of work", *keys)) + 120 + 600 * self.u("material", *keys), 2)
        flag = lambda k: (kind == k).cast("int")
        return m.select(self.key().alias("maintenance_id"), F.col("day").cast("timestamp").alias("ts"), "day", "unit_id", "component_id", "depot_id", flag(CORRECTIVE).alias("corrective"), flag(CONDITION).alias("condition_based"), flag(PLANNED).alias("planned"), "hours", cost.alias("cost"))

    @cached_property
    def interventions(self) -> DataFrame:
        """The plan behind each restoration, done or not, and one for each early alert that nobody attended."""
        key = ("maintenance_id",)
        lead = F.when(F.col("corrective") == 1, F.floor(self.u("lead", *key) * 3)).otherwise(1 + F.floor(self.u("lead", *key) * 11))
        u, z = self.u("status", *key), self.z("priority", *key)
        done = self.maintenance.withColumns({"priority": F.when(F.col("corrective") == 1, within(F.round(4.7 + 0.4 * z), 3, 5)).when(F.col("condition_based") == 1, within(F.round(3.9 + 0.8 * z), 2, 5)).otherwise(within(F.round(3 + 0.7 * z), 1, 4)).cast("int"), "status": F.when(F.col("corrective") == 1, "done").when(F.col("condition_based") == 1, choice(u, (("done", 0.64), ("deferred", 0.85), ("pending", 1.0)))).otherwise(choice(u, (("done", 0.72), ("pending", 0.92), ("cancelled", 1.0))))})
        done = done.select((F.col("maintenance_id") * 4 + 3).alias("intervention_id"), "unit_id", "component_id", "depot_id", F.date_sub("day", lead.cast("int")).alias("day"), "priority", "status", (self.u("window", *key) < 0.76).cast("int").alias("window_open"), F.round(within(F.col("priority") * 16 + F.col("hours") * 1.8 + 7 * self.z("impact", *key), 8, 100), 3).alias("impact"))
        late = self.alerts.where("attended = 0 AND early = 1").join(self._units.select("unit_id", "depot_id"), "unit_id")
        late = late.select((F.floor(F.col("alert_id") / 3) * 4 + F.col("alert_id") % 3).alias("intervention_id"), "unit_id", "component_id", "depot_id", F.date_add("day", (2 + F.floor(self.u("later", "alert_id") * 18)).cast("int")).alias("day"), F.when(F.col("severity") == "critical", 5).otherwise(4).alias("priority"), choice(self.u("status", "alert_id"), (("pending", 0.58), ("deferred", 1.0))).alias("status"), (self.u("window", "alert_id") < 0.64).cast("int").alias("window_open"), F.round(within(78 + 14 * self.z("impact", "alert_id"), 35, 100), 3).alias("impact"))
        return done.unionByName(late).where(F.col("day").between(self.day(F.lit(0)), self.day(F.lit(self.n_days - 1))))

    @cached_property
    def backlog(self) -> DataFrame:
        """At each weekly snapshot the interventions that are due, until done (pending within 120 days, deferred within 240)."""
        due = self.interventions.where("status IN ('pending', 'deferred')").withColumnRenamed("day", "planned")
        first, last = self.day(F.lit(0)), self.day(F.lit(self.n_days - 1))
        wait = F.when(F.col("status") == "pending", 120).otherwise(240)
        begin = F.date_add(first, (F.ceil(F.datediff("planned", first) / 7) * 7).cast("int"))
        end = F.least(F.date_add("planned", wait), last)
        rows = due.withColumn("day", F.explode(F.when(begin <= end, F.sequence(begin, end, F.expr("interval 7 days")))))
        rows = rows.withColumn("age_days", F.datediff("day", "planned"))
        severity = F.when(F.col("priority") >= 5, "critical").when(F.col("priority") >= 4, "high").otherwise("medium")
        return rows.select("day", F.col("intervention_id").alias("order_id"), "depot_id", "unit_id", "component_id", "age_days", severity.alias("severity"), F.round(within(F.col("impact") + F.col("age_days") * 0.5 + 3 * self.z("risk", "intervention_id", "age_days"), 0, 180), 3).alias("risk"))

    @cached_property
    def _unit_days(self) -> DataFrame:
        """Unit days: service planned, lost to failures and to the workshop."""
        lost = self.failures.groupBy("day", "unit_id").agg(F.sum("downtime_h").alias("down"))
        shop = self.maintenance.groupBy("day", "unit_id").agg(F.sum("hours").alias("shop"))
        days = self._units.select("unit_id", "fleet_id", "line_id", "use_intensity").join(F.broadcast(self.context), "line_id").join(lost, ["day", "unit_id"], "left").join(shop, ["day", "unit_id"], "left")
        keys = ("unit_id", "day")
        days = days.withColumn("planned_h", F.round(within(16 * (0.8 + 0.3 * F.col("intensity")) * (0.88 + 0.18 * F.col("use_intensity")) + 0.9 * self.z("planned", *keys), 6, 22), 3))
        out = F.coalesce("down", F.lit(0.0)) + 0.65 * F.coalesce("shop", F.lit(0.0)) + F.greatest(F.lit(0.0), F.col("congestion") - 0.75) * 1.8 + F.greatest(F.lit(0.0), 0.1 + 0.3 * self.z("lost", *keys))
        days = days.withColumn("unavailable_h", F.round(F.least(out, "planned_h"), 3)).withColumn("cancellations", F.round(F.greatest(F.lit(0.0), F.col("unavailable_h") - 1.3) * (0.7 + F.col("congestion"))).cast("long"))
        services = F.greatest(F.lit(2), F.round(F.col("planned_h") * (1.9 + 0.3 * F.col("intensity"))).cast("int"))
        days = days.withColumns({"available_h": F.round(F.col("planned_h") - F.col("unavailable_h"), 3), "planned_services": services, "reserve": (self.u("reserve", *keys) < 0.1).cast("int"), "punctuality_hit": F.round(within(F.col("unavailable_h") / F.col("planned_h") * 55 + 34 * F.col("congestion") + 2 + 3 * self.z("late", *keys), 0, 100), 3)})
        days = days.withColumn("done_services", F.greatest(F.lit(0), F.col("planned_services") - F.col("cancellations") - (F.col("unavailable_h") > 4).cast("int")))
        return days.withColumn("substitution", ((F.col("done_services") < 0.84 * F.col("planned_services")) & (F.col("reserve") == 0)).cast("int"))

    @cached_property
    def service(self) -> DataFrame:
        return self._unit_days.select("day", "unit_id", "fleet_id", "line_id", "planned_h", "available_h", "unavailable_h", "cancellations", "punctuality_hit", "substitution")

    @cached_property
    def assignment(self) -> DataFrame:
        return self._unit_days.select("day", "unit_id", "line_id", "planned_services", "done_services", "reserve", "substitution")

    @cached_property
    def scenarios(self) -> DataFrame:
        """Days by scenario: indices of service, backlog, resources and cost; a day takes the backlog of the last snapshot."""
        served = self.context.groupBy("day").agg(F.avg("intensity").alias("intensity"))
        snapshot = F.date_sub("day", F.datediff("day", self.day(F.lit(0))) % 7)
        waiting = self.backlog.groupBy(F.col("day").alias("snapshot")).agg(F.avg("risk").alias("waiting"))
        base = served.withColumn("snapshot", snapshot).join(waiting, "snapshot", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0.0)))
        factors = (("reactive", 1.08, 1.20, 0.82, 1.18), ("preventive", 1.00, 0.92, 0.90, 1.02), ("condition", 0.97, 0.78, 1.08, 0.93))
        rows = base.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), *(F.lit(x).alias(c) for c, x in zip("isrc", v, strict=True))) for n, *v in factors))).alias("f")).select("day", "intensity", "waiting", "f.*")
        e = lambda name: 0.03 * self.z(name, "day", "scenario")
        rows = rows.withColumns({"intensity_index": F.round(within(F.col("intensity") * F.col("i") + e("i"), 0.5, 1.7), 4), "backlog_index": F.round(within(F.col("waiting") / 100 * F.col("s") + e("s"), 0.05, 2.3), 4)})
        return rows.select("day", "scenario", "intensity_index", "backlog_index", F.round(within((0.95 - 0.32 * F.col("backlog_index")) * F.col("r") + e("r"), 0.1, 1.4), 4).alias("resources_index"), F.round(within((0.68 * F.col("intensity_index") + 0.42 * F.col("backlog_index")) * F.col("c") + e("c"), 0.2, 2.5), 4).alias("cost_index"))

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLES}

    def write(self, folder: str) -> None:
        """All 15 tables as Parquet folders."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


#: The tables of a canonical fleet and the keys of their rows.
TABLES = {
    "fleets": ("fleet_id",), "units": ("unit_id",), "depots": ("depot_id",), "components": ("component_id",), "readings": ("reading_id",), "inspections": ("inspection_id",), "maintenance": ("maintenance_id",), "failures": ("failure_id",),
    "alerts": ("alert_id",), "interventions": ("intervention_id",), "service": ("day", "unit_id"), "assignment": ("day", "unit_id"), "backlog": ("day", "order_id"), "context": ("day", "line_id"), "scenarios": ("day", "scenario"),
}
#: (table, column, table that it names a row of).
REFERENCES = (
    ("units", "fleet_id", "fleets"), ("units", "depot_id", "depots"), ("components", "unit_id", "units"), *((t, "component_id", "components") for t in ("readings", "inspections", "maintenance", "failures", "alerts", "interventions", "backlog")),
    *((t, "unit_id", "units") for t in ("failures", "maintenance", "service", "assignment")), ("maintenance", "depot_id", "depots"), ("interventions", "depot_id", "depots"), ("service", "fleet_id", "fleets"),
)


class CanonicalFleet(Fleet):
    """A fleet whose 15 tables lie ready in a folder, made or supplied; the marts read them as they are."""

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def span(self) -> DataFrame:
        return self.context.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))

    @property
    def kept(self) -> Fleet:
        """Itself: its tables lie ready."""
        return self

    @cached_property
    def read_members(self) -> DataFrame:
        return self.readings.select("component_id", "unit_id").distinct()


def _read(name: str) -> cached_property:
    prop = cached_property(lambda self: self.table(name))
    prop.__set_name__(CanonicalFleet, name)
    return prop


for _name in TABLES:
    setattr(CanonicalFleet, _name, _read(_name))


#: Bounds of what a made fleet should look like.
BOUNDS = {
    "history_days": (730, math.inf), "orphans": (0, 0), "repeated_keys": (0, 0), "hours_unreconciled": (0, 0.01), "inspection_families": (4, math.inf), "temperature_outside": (0, 0), "downtime_not_positive": (0, 0),
    "severe_failure_share": (0.05, 0.45), "failures_per_unit_year": (2, 30), "wear_outside": (0, 0),
}


def fleet_report(f: Fleet) -> DataFrame:
    """(check, value, low, high, status) of a canonical fleet; missing values are implausible."""
    t = {n: getattr(f, n) for n in TABLES}
    union = lambda parts: reduce(DataFrame.union, parts)
    orphans = union([t[a].select(F.col(c).alias("k")).where("k IS NOT NULL").join(t[b].select(F.col(c).alias("k")), "k", "left_anti").agg(F.count("*").alias("n")) for a, c, b in REFERENCES])
    repeated = union([t[n].groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")) for n, keys in TABLES.items()])
    length = t["context"].agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("n"))
    out = [
        ("history_days", length), ("orphans", orphans.agg(F.sum("n"))), ("repeated_keys", repeated.agg(F.sum("n"))),
        ("hours_unreconciled", t["service"].agg(F.avg(F.abs(F.col("planned_h") - F.col("available_h") - F.col("unavailable_h"))))),
        ("inspection_families", t["inspections"].agg(F.countDistinct(F.when(F.col("family").isin(*FAMILIES), F.col("family"))))),
        ("temperature_outside", t["readings"].agg(F.count_if(~F.col("temperature").between(-20, 170)))), ("downtime_not_positive", t["failures"].agg(F.count_if(F.col("downtime_h") <= 0))),
        ("severe_failure_share", t["failures"].agg(F.avg((F.col("severity") >= 4).cast("double")))),
        ("failures_per_unit_year", t["failures"].agg(F.count("*").alias("n")).crossJoin(t["units"].agg(F.count("*").alias("u"))).crossJoin(length.withColumnRenamed("n", "d")).select(F.col("n") / F.col("u") / (F.col("d") / 365.25))),
        ("wear_outside", t["readings"].agg(F.count_if(~F.col("wear").between(0, 145)))),
    ]
    values = union([df.select(F.lit(name).alias("check"), F.col(f"`{df.columns[0]}`").cast("double").alias("value"), F.lit(float(BOUNDS[name][0])).alias("low"), F.lit(float(BOUNDS[name][1])).alias("high")) for name, df in out])
    return values.withColumn("status", F.when(F.col("value").between(F.col("low"), F.col("high")), "plausible").otherwise("implausible"))


def require_plausible(f: Fleet) -> None:
    if odd := fleet_report(f).where("status = 'implausible'").collect():
        raise ValueError("implausible: " + ", ".join(f"{r['check']} = {r['value']}" for r in odd))
