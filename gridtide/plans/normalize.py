"""From a loose query dictionary to a checked ``Query``.

A query's parts are read one by one, each by a rule of its own; what a rule rejects is a ``ValueError``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from typing import Any

from ..config import Settings
from ..functions.calendar import TIME_UNITS
from ..model import AGGREGATIONS, FUNCTIONS, PREDICATES, Operation, Product, Query, Region, Selection, Test

#: How times may be written, finest first, and how long each lasts (a month: until the next one begins).
TIME_FORMS = (("%Y-%m-%dT%H", timedelta(hours=1)), ("%Y-%m-%d %H", timedelta(hours=1)), ("%Y-%m-%d", timedelta(days=1)), ("%Y-%m", None))


class Reader:
    """Fields of a raw query; one that is absent or null has to be asked for with a default."""

    def __init__(self, raw: dict[str, Any]) -> None:
        self.raw = raw

    def __call__(self, name: str, rule: Callable[[Any], Any], *default: Any) -> Any:
        value = self.raw.get(name)
        if value is None:
            if default:
                return default[0]
            raise ValueError(f"the query has no {name}")
        try:
            return rule(value)
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"{name}: {value!r} can't be used ({e})") from e


def one_of(allowed: Iterable[str], spell: Callable[[str], str] = str) -> Callable[[Any], str]:
    names = set(allowed)

    def rule(value: Any) -> str:
        if not isinstance(value, str):
            raise TypeError("not a name")
        if (found := spell(value)) not in names:
            raise ValueError(f"known are {', '.join(sorted(names))}")
        return found

    return rule


def whole_number(value: Any) -> int:
    if isinstance(value, bool) or int(value) != float(value):
        raise ValueError("not a whole number")
    return int(value)


def finite_number(value: Any) -> float:
    if isinstance(value, bool) or not math.isfinite(number := float(value)):
        raise ValueError("not a finite number")
    return number


def normalize_time(text: Any, end: bool = False) -> datetime:
    """The beginning of a month, day or hour; as an end, the last hour within."""
    for form, lasts in TIME_FORMS if isinstance(text, str) else ():
        try:
            start = datetime.strptime(text.strip(), form)
        except ValueError:
            continue
        if start.strftime(form) != text.strip():  # every part in full, with its zeros
            continue
        if not end:
            return start
        stop = start + lasts if lasts else (start.replace(day=28) + timedelta(days=4)).replace(day=1)
        return stop - timedelta(hours=1)
    raise ValueError(f"{text!r} is no month, day or hour")


def region_of(box: Any) -> Region:
    return Region.of(**{side: finite_number(box[side]) for side in ("west", "east", "south", "north")})


def selection_of(read: Reader, settings: Settings) -> Selection:
    """Names have to be known where they stand: a dataset in its repository, a variable in what is left."""
    repository = read("repository", one_of(settings.names()["repositories"]), None)
    dataset = read("dataset", one_of(settings.names(repository)["datasets"]), None)
    known = settings.names(repository, dataset)
    (values,) = known["parameters"]

    def parameters(given: dict[str, str]) -> tuple[tuple[str, str], ...]:
        if given and dataset is None:
            raise ValueError("they belong to a dataset, and none is named")
        for name, value in given.items():
            if value not in values.get(name, ()):
                raise ValueError(f"the dataset has no {name} {value!r}")
        return tuple(sorted(given.items()))

    return Selection(read("variable", one_of(known["variables"])), repository, dataset, read("additional_parameters", parameters, ()))


def operation_of(read: Reader) -> Operation:
    """A test goes with the two ``find`` functions, and with no other."""
    function = read("function", one_of(FUNCTIONS, lambda x: x.lower().replace("_", "-")))
    aggregation = read("aggregation", one_of(AGGREGATIONS, str.lower))
    if function.startswith("find-"):
        return Operation(function, aggregation, Test(read("predicate", PREDICATES.__getitem__), read("filter_value", finite_number)))
    if any(read(name, lambda x: x, None) is not None for name in ("predicate", "filter_value")):
        raise ValueError(f"{function} looks for nothing, so it takes neither predicate nor filter_value")
    return Operation(function, aggregation)


def normalize_query(raw: dict[str, Any], settings: Settings) -> Query:
    """Check every field of ``raw``; all faults are ``ValueError``."""
    read = Reader(raw)
    factor = read("coarseness_factor", whole_number)
    if factor not in settings.coarseness_factors:
        raise ValueError(f"there are no products of coarseness_factor {factor}")
    when = read("time_start", normalize_time), read("time_end", lambda x: normalize_time(x, end=True))
    if when[0] > when[1]:
        raise ValueError("the query ends before it starts")
    product = Product(read("time_unit", one_of(TIME_UNITS, str.title)), factor)
    return Query(selection_of(read, settings), when, read("region", region_of), product, operation_of(read))
