"""Photovoltaic output by the published PVWatts formulas (Dobos, NREL/TP-6A20-62641), as column expressions.

It is an approximation: no shading, no horizon, the isotropic sky model for diffuse light.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.functions.values import clamp, kelvin_to_celsius, let
from tsengine.operators.domain import KEYS

#: Weather variable -> what the physics calls it.
NAMES = {"dswrf": "ghi", "vbdsf": "dni", "vddsf": "dhi", "t": "temp_air", "gust": "wind_speed"}


@dataclass(frozen=True)
class System:
    """The published defaults of the method."""

    capacity_kw: float = 6.4
    tilt: float = 20.0
    azimuth: float = 180.0
    losses: float = 14.0757
    dc_ac: float = 1.15
    inverter_efficiency: float = 96.0
    gamma: float = -0.0047
    albedo: float = 0.2
    noct_rise: float = 0.0325


def prepare(df: DataFrame) -> DataFrame:
    """Weather under its physical names: Celsius, irradiance not negative, direct at most 1200."""
    named = df.withColumnsRenamed(NAMES)
    return named.withColumns({"dni": clamp(F.col("dni"), 0.0, 1200.0), "dhi": clamp(F.col("dhi"), 0.0), "ghi": clamp(F.col("ghi"), 0.0), "temp_air": kelvin_to_celsius(F.col("temp_air"))})


def sun(ts: Column, latitude: Column, longitude: Column) -> Column:
    """struct(cos_z, azimuth): the cosine of the zenith, and the azimuth in radians from north, in UTC.

    By the usual series for the declination and the equation of time.
    """

    def series(x: Column) -> Column:
        a = x["day"]
        eot = 229.18 * (0.000075 + 0.001868 * F.cos(a) - 0.032077 * F.sin(a) - 0.014615 * F.cos(2 * a) - 0.040849 * F.sin(2 * a))
        decl = 0.006918 - 0.399912 * F.cos(a) + 0.070257 * F.sin(a) - 0.006758 * F.cos(2 * a) + 0.000907 * F.sin(2 * a) - 0.002697 * F.cos(3 * a) + 0.00148 * F.sin(3 * a)
        minutes = F.hour(ts) * 60 + F.minute(ts) + eot + 4 * longitude
        return let(place, angle=F.radians(minutes / 4 - 180), decl=decl, lat=F.radians(latitude))

    def place(x: Column) -> Column:
        angle, decl, lat = x["angle"], x["decl"], x["lat"]
        cos_z = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(angle)
        azimuth = F.atan2(F.sin(angle), F.cos(angle) * F.sin(lat) - F.tan(decl) * F.cos(lat)) + math.pi
        return F.struct(F.least(F.greatest(cos_z, F.lit(-1.0)), F.lit(1.0)).alias("cos_z"), azimuth.alias("azimuth"))

    return let(series, day=2 * math.pi * (F.dayofyear(ts) - 1 + (F.hour(ts) - 12) / 24) / 365)


def output_watts(at: Column, system: Column) -> Column:
    """AC output of a system (a struct of its parameters) under the sun and weather in ``at``; generation is negative."""
    tilt = F.radians(system["tilt"])
    cos_z = at["cos_z"]
    incidence = cos_z * F.cos(tilt) + F.sin(F.acos(cos_z)) * F.sin(tilt) * F.cos(at["azimuth"] - F.radians(system["azimuth"]))
    beam = F.when(cos_z > 0, at["dni"] * F.greatest(incidence, F.lit(0.0))).otherwise(0.0)
    plane = beam + at["dhi"] * (1 + F.cos(tilt)) / 2 + at["ghi"] * system["albedo"] * (1 - F.cos(tilt)) / 2

    def power(x: Column) -> Column:
        cell = at["temp_air"] + x["plane"] * system["noct_rise"] / (1 + 0.1 * at["wind_speed"])
        dc = system["capacity_kw"] * x["plane"] / 1000 * (1 + system["gamma"] * (cell - 25)) * (1 - system["losses"] / 100)
        ac = F.least(dc * system["inverter_efficiency"] / 100, system["capacity_kw"] / system["dc_ac"])
        return F.greatest(ac, F.lit(0.0)) * -1000

    return let(power, plane=plane)


def read_systems(spark: SparkSession, paths: dict[str, list[str]]) -> dict[str, list[System]]:
    """location -> its systems, each from a small JSON file of System's fields (what is missing is the default) by a path that Spark can read."""
    out = {}
    for location, files in paths.items():
        out[location] = [System(**json.loads(spark.read.text(f, wholetext=True).first()[0])) for f in files]
    return out


def forecast(weather: DataFrame, sites: DataFrame, systems: dict[str, list[System]], name: str = "pv_physics", solver: Callable[[Column, Column], Column] = output_watts) -> DataFrame:
    """(location, date_time, pv_physics): a location's systems added up; null where an input is, or where there are no systems.

    solver: a function of the sun and weather (a struct) and of a system's parameters (a struct) to watts.
    """
    df = prepare(weather).join(sites.select("location", "latitude", "longitude"), "location", "left")
    rows = [(location, [tuple(asdict(s).values()) for s in found]) for location, found in systems.items() if found]
    fields = ", ".join(f"{f}: double" for f in asdict(System()))
    known = df.sparkSession.createDataFrame(rows, f"location string, systems array<struct<{fields}>>")
    inputs = ["dni", "dhi", "ghi", "temp_air", "wind_speed"]
    whole = F.lit(True)
    for c in [*inputs, "latitude", "longitude"]:
        whole = whole & F.col(c).isNotNull()
    at = df.join(known, "location", "left").withColumn("sun", sun(F.col("date_time"), F.col("latitude"), F.col("longitude")))
    at = at.withColumn("at", F.struct(F.col("sun.cos_z").alias("cos_z"), F.col("sun.azimuth").alias("azimuth"), *inputs))
    total = F.aggregate("systems", F.lit(0.0), lambda a, s: a + solver(F.col("at"), s))
    return at.select(*KEYS, F.when(whole, total).alias(name))
