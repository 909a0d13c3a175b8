"""Host-side helpers: retries and time limits, registries, log tables and results."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as _Late
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EngineError(Exception):
    """An error with what is known about it."""

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


@dataclass(frozen=True)
class Result:
    """What became of an operation: a value, or errors."""

    value: object = None
    errors: tuple[str, ...] = ()
    seconds: float = 0.0

    @property
    def ok(self) -> bool:
        return not self.errors


def each(items, f: Callable, at_once: int = 4) -> list:
    """f of every item, at most `at_once` at a time, in order; the first error is raised after all have ended."""
    with ThreadPoolExecutor(at_once) as pool:
        return [x.result() for x in [pool.submit(f, item) for item in items]]


def with_retry(f: Callable, tries: int = 3, first_wait: float = 1.0, on=(Exception,), sleep=time.sleep):
    """f(), again after waits that double; the last error is raised."""
    if tries < 1:
        raise ValueError("at least one try")
    for k in range(tries):
        try:
            return f()
        except on:
            if k == tries - 1:
                raise
            sleep(first_wait * 2**k)


def with_timeout(f: Callable, seconds: float):
    """f(), or TimeoutError after `seconds`; the call itself isn't stopped."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(f).result(seconds)
    except _Late:
        raise TimeoutError(f"took longer than {seconds} s") from None
    finally:
        pool.shutdown(wait=False)


def timed(f: Callable) -> Result:
    """f's value or error, and how long it took."""
    began = time.perf_counter()
    try:
        return Result(f(), (), time.perf_counter() - began)
    except Exception as error:  # handed on as a result
        return Result(None, (str(error),), time.perf_counter() - began)


class Registry:
    """Factories by name; creating an unknown one raises, registering twice too."""

    def __init__(self, kind: str):
        self.kind, self.factories = kind, {}

    def register(self, name: str, factory: Callable, replace: bool = False) -> None:
        if name in self.factories and not replace:
            raise EngineError(f"{self.kind} {name} is registered already", name=name)
        self.factories[name] = factory

    def create(self, name: str, *args, **kw):
        if name not in self.factories:
            raise EngineError(f"unknown {self.kind}: {name}", known=sorted(self.factories))
        return self.factories[name](*args, **kw)


#: Codecs (name -> DataFrame transformations), rule sets (name -> function of columns) and losses (name -> aggregate of two columns).
CODECS, VALIDATORS, LOSSES = Registry("codec"), Registry("validator"), Registry("loss")
LOSSES.register("l1", lambda: lambda x, y: F.avg(F.abs(x - y)))
LOSSES.register("mse", lambda: lambda x, y: F.avg((x - y) * (x - y)))


def register_functions(spark: SparkSession, functions: dict[str, tuple[Callable, str]]) -> None:
    """Name -> (Python function, result type), usable from SQL."""
    for name, (f, kind) in functions.items():
        spark.udf.register(name, f, kind)


def errors_of(rows: DataFrame, key: str, rules: Registry, name: str) -> DataFrame:
    """key and the broken rules of a registered validator (a function without arguments that gives name -> condition)."""
    conditions = rules.create(name)
    return rows.select(key, F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()])).alias("errors"))


@dataclass
class Diagnostics:
    """Log lines, errors and module calls, kept for a table; `modules` limits what is kept, `enabled` False makes every call a no-op."""

    enabled: bool = True
    modules: frozenset[str] | None = None
    step: int = 0
    lines: list = field(default_factory=list)
    clock: Callable[[], float] = time.time

    def next_step(self) -> None:
        self.step += 1

    def tracks(self, module: str) -> bool:
        return self.enabled and (self.modules is None or module in self.modules)

    def log(self, message: str, module: str = "", level: str = "info", seconds: float = 0.0) -> None:
        if self.tracks(module) or self.enabled and not module:
            self.lines.append((self.clock(), self.step, level, module, message, float(seconds)))

    def error(self, message: str, module: str = "") -> None:
        self.log(message, module, "error")

    def clear(self) -> None:
        self.lines.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.lines, "at double, step int, level string, module string, message string, seconds double")


def module_summary(lines: DataFrame) -> DataFrame:
    """module, calls, total, mean, most of the logged module calls, the longest total first; modules without calls are left out."""
    calls = lines.where("module <> '' and level = 'info'")
    return calls.groupBy("module").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most")).orderBy(F.desc("total"), "module")


def gradient_summary(norms: DataFrame) -> DataFrame:
    """(module, step, values array) -> module, steps, mean_norm, max_norm, the largest mean first."""
    norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x))
    return norms.select("module", norm.alias("norm")).groupBy("module").agg(F.count("*").alias("steps"), F.avg("norm").alias("mean_norm"), F.max("norm").alias("max_norm")).orderBy(F.desc("mean_norm"), "module")
