"""Port fuel availability, shore power and grid carbon by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bunkerline import dims
from bunkerline import reference as ref
from bunkerline.functions.expr import bool_int, piecewise_linear
from bunkerline.operators import emissions

FOREVER = 9999


def step_intervals(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Declared (year, status) steps to half-open [year, until) intervals."""
    following = F.lead("year").over(Window.partitionBy(*keys).orderBy("year"))
    return steps.select(
        *keys, F.col("year").alias("_from"), F.coalesce(following, F.lit(FOREVER)).alias("_until"),
        F.col("status").alias("_status"),
    )


def _as_of(df: DataFrame, steps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Latest declared status at or before the row's year; none before the first or if undeclared.

    An equi-join on the keys with the year range as an extra condition: a broadcast hash join.
    """
    table = step_intervals(steps, keys).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = (F.col("year") >= F.col("_from")) & (F.col("year") < F.col("_until"))
    for k in keys:
        on = on & (df[k] == table[f"_k_{k}"])
    joined = df.join(F.broadcast(table), on, "left")
    return joined.withColumn(name, F.coalesce("_status", F.lit("none"))).drop(
        "_from", "_until", "_status", *[f"_k_{k}" for k in keys]
    )


def with_availability(df: DataFrame, steps: DataFrame | None = None, name: str = "availability") -> DataFrame:
    """Step lookup of (port, fuel, year)."""
    steps = dims.availability(df.sparkSession) if steps is None else steps
    return _as_of(df, steps, ["port", "fuel"], name)


def with_shore_status(df: DataFrame, steps: DataFrame | None = None, name: str = "shore_status") -> DataFrame:
    steps = dims.shore_power(df.sparkSession) if steps is None else steps
    return _as_of(df, steps, ["port"], name)


def usable(status: Column | str) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return status.isin(ref.USABLE_STATUS)


def can_bunker(df: DataFrame) -> DataFrame:
    """Planned infrastructure does not count."""
    return with_availability(df).withColumn("can_bunker", usable("availability"))


def _port_statuses(fuel: Column, year: Column, port: Column) -> Column:
    """Status of one (port, fuel, year) as an expression over a constant nested map."""
    table: dict[str, list] = {}
    for p, f, y, status in ref.AVAILABILITY:
        table.setdefault(f"{p}|{f}", []).append((y, status))
    entries = []
    for key, steps in table.items():
        entries += [F.lit(key), F.array(*[
            F.struct(F.lit(y).alias("y"), F.lit(s).alias("s")) for y, s in sorted(steps)
        ])]
    steps = F.element_at(F.create_map(*entries), F.concat(port, F.lit("|"), fuel))
    held = F.filter(steps, lambda s: s["y"] <= year)
    return F.coalesce(F.when(F.size(held) > 0, F.element_at(held, -1)["s"]), F.lit("none"))


def route_status(df: DataFrame, ports: str = "ports") -> DataFrame:
    """Feasibility of (ports, fuel, year) rows: every port must be able to supply the fuel.

    A route lists a handful of ports, so the lookup runs inside the row over the port array;
    nothing is exploded and no row is shuffled.
    """
    statuses = F.transform(
        F.col(ports),
        lambda p: F.struct(p.alias("port"), _port_statuses(F.col("fuel"), F.col("year"), p).alias("status")),
    )
    out = df.withColumn("_statuses", F.when(F.size(ports) > 0, statuses).otherwise(
        F.raise_error(F.lit("a route must name at least one port"))))
    blocking = F.filter("_statuses", lambda s: ~s["status"].isin(ref.USABLE_STATUS))
    out = out.withColumn(
        "blocking_ports", F.transform(blocking, lambda s: F.concat(s["port"], F.lit(" ("), s["status"], F.lit(")")))
    ).withColumn("route_feasible", F.size("blocking_ports") == 0)
    return out.withColumn(
        "blocking_reason",
        F.when(~F.col("route_feasible"), F.concat(
            F.col("fuel"), F.lit(" cannot be bunkered in "), F.col("year").cast("string"), F.lit(" at "),
            F.array_join("blocking_ports", ", "), F.lit(" on "), F.array_join(ports, " > "))),
    ).drop("_statuses")


def fuels_on_route(df: DataFrame, ports: str = "ports") -> DataFrame:
    """Add the sorted fuels usable on the whole route in the row's year."""
    candidates = F.array(*[F.lit(f) for f in sorted({fuel for _, fuel, _, _ in ref.AVAILABILITY})])
    usable_fuels = F.filter(candidates, lambda f: F.forall(
        F.col(ports), lambda p: _port_statuses(f, F.col("year"), p).isin(ref.USABLE_STATUS)))
    return df.withColumn("route_fuels", usable_fuels)


def earliest_years(spark, horizon: tuple[int, int] = (2024, 2050)) -> DataFrame:
    """First bunkerable year per declared (port, fuel) inside the horizon, or null."""
    pairs = dims.availability(spark).select("port", "fuel").distinct()
    years = pairs.withColumn("year", F.explode(F.sequence(F.lit(horizon[0]), F.lit(horizon[1]))))
    return can_bunker(years).groupBy("port", "fuel").agg(
        F.min(F.when(F.col("can_bunker"), F.col("year"))).alias("earliest_year")
    )


def grid_factor(year: Column, include_losses: bool = True) -> Column:
    """tCO2 per MWh: linear between milestones, flat outside, delivered through the losses."""
    factor = piecewise_linear(year, ref.GRID_FACTORS)
    return factor / (1.0 - ref.GRID_LOSS_FRACTION) if include_losses else factor


def port_matrix(df: DataFrame) -> DataFrame:
    """Status of every (port, fuel) seen at the milestone years, one column per year."""
    pairs = df.groupBy("port", "fuel").agg(F.count(F.lit(1)).alias("calls"))
    years = pairs.withColumn("year", F.explode(F.array(*[F.lit(y) for y in ref.MILESTONE_YEARS])))
    looked = with_availability(years)
    return looked.groupBy("port", "fuel", "calls").pivot("year", list(ref.MILESTONE_YEARS)).agg(
        F.first("availability")
    ).select("port", "fuel", "calls", *[F.col(str(y)).alias(f"status_{y}") for y in ref.MILESTONE_YEARS])


def shore_power(calls: DataFrame, auxiliary: str = "mgo") -> DataFrame:
    """Assess berth calls: shore power needs the port and the vessel fitted."""
    rows = with_shore_status(calls)
    ready, fitted = usable("shore_status"), F.col("vessel_equipped")
    quoted = F.concat(F.lit("'"), F.col("shore_status"), F.lit("'"))
    reason = (
        F.when(~ready & ~fitted, F.concat(F.lit("neither fitted: port status "), quoted, F.lit(", vessel not equipped")))
        .when(~ready, F.concat(F.lit("port status "), quoted, F.lit(", not operational")))
        .when(~fitted, F.lit("vessel not equipped"))
        .otherwise(F.lit("both fitted"))
    )
    available = ready & fitted
    grid = grid_factor(F.col("year"))
    rows = rows.withColumns({
        "available": available, "reason": reason, "grid_factor_t_per_mwh": grid,
        "auxiliary_t": F.col("energy_mj") * F.lit(emissions.total_per_mj(auxiliary, "fossil")),
        "grid_t": F.when(available, F.col("energy_mj") * emissions.electric_per_mj(grid)).otherwise(0.0),
    })
    saving = F.when(F.col("available"), F.col("auxiliary_t") - F.col("grid_t")).otherwise(0.0)
    return rows.withColumn("saving_t", saving).withColumn(
        "saving_fraction",
        F.when(F.col("available") & (F.col("auxiliary_t") > 0), F.col("saving_t") / F.col("auxiliary_t")).otherwise(0.0),
    )


def crossover(df: DataFrame, horizon: tuple[int, int] = (2024, 2050), fuel: str = "mgo") -> DataFrame:
    """Per row: first year its work is cleaner on battery than on the fuel, or null.

    Both sides are linear in the work, so the search runs over the year sequence inside the row.
    """
    base = F.col("energy_mj") * F.lit(emissions.total_per_mj(fuel, "fossil"))
    years = F.filter(
        F.sequence(F.lit(horizon[0]), F.lit(horizon[1])),
        lambda y: F.col("energy_mj") * emissions.electric_per_mj(grid_factor(y)) < base,
    )
    return df.withColumn("crossover_year", F.try_element_at(years, F.lit(1)))


def electrification_series(df: DataFrame, key: str, first: int = 2024, last: int = 2047, fuel: str = "mgo") -> DataFrame:
    """Per key and year: battery and fuel emissions of the key's total work, the year in which the battery gets
    cleaner (null if none is near enough), and the local pollutants a battery keeps out of the port.

    Work is summed per key first, so the explode over years runs on the small result.
    """
    work = df.groupBy(key).agg(F.sum("energy_mj").alias("energy_mj"))
    # a null engine: pollutants depend on the fuel only
    burnt = emissions.local_pollutants(work.withColumns({"fuel": F.lit(fuel), "engine": F.lit(None).cast("string")}))
    for name in ("nox_kg", "sox_kg", "pm_kg"):
        burnt = burnt.withColumnRenamed(name, f"avoided_{name}")
    years = crossover(burnt, fuel=fuel).withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return years.drop("fuel").withColumns({
        "electric_t": F.col("energy_mj") * emissions.electric_per_mj(grid_factor(F.col("year"))),
        "baseline_t": F.col("energy_mj") * F.lit(emissions.total_per_mj(fuel, "fossil")),
    })


def port_filters(df: DataFrame) -> DataFrame:
    """Per port: programme membership and, per year of the rows, shore-power readiness."""
    table = dims.ports(df.sparkSession)
    rows = with_shore_status(df).join(F.broadcast(table), "port")
    return rows.groupBy("port", "demo_site", "hydrogen_hub", "gttp").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(bool_int(usable("shore_status")).cast("bigint")).alias("calls_with_shore_power"),
        F.min(F.when(usable("shore_status"), F.col("year"))).alias("first_ready_year_seen"),
    )
