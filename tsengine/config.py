"""JSON with tags for intervals, lists of intervals, PV systems and hour functions. Unknown tags are errors; nothing is unpickled."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict

from tsengine.operators.pv import System

HOUR_FUNCTIONS = ("hour_pick", "hour_difference", "hour_sum")


def hour_function(name: str, *args: int) -> dict:
    if name not in HOUR_FUNCTIONS:
        raise ValueError(f"unknown hour function {name!r}")
    return {"$type": "hour_function", "name": name, "args": list(args)}


def _default(x):
    if isinstance(x, dt.timedelta):
        return {"$type": "interval", "seconds": x.total_seconds()}
    if isinstance(x, System):
        return {"$type": "pv_system", **asdict(x)}
    raise ValueError(f"can't be written: {type(x).__name__}")


def _object(d: dict):
    kind = d.get("$type")
    if kind is None:
        return d
    rest = {k: v for k, v in d.items() if k != "$type"}
    if kind == "interval":
        return dt.timedelta(seconds=rest["seconds"])
    if kind == "pv_system":
        return System(**rest)
    if kind == "hour_function":
        return hour_function(rest["name"], *rest["args"])
    raise ValueError(f"unknown tag {kind!r}")


def encode(value) -> str:
    return json.dumps(value, default=_default)


def decode(text: str):
    return json.loads(text, object_hook=_object)
