"""Registry of queries over the given tables, each with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkgrade.plans.fixtures import BASE, FIXTURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


# The JIT compiler skips methods above 8000 bytes of bytecode, and the wide score expressions exceed
# that when a whole stage is generated as one method. With the limit at 8000, as the Spark configuration
# text advises for HotSpot, such stages are split instead and run compiled.
HUGE_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


# A task's share of the work stays the same however large the tables are: files are read in pieces of 16 MB, there is a
# shuffle partition for every MB of files, and adaptive execution joins partitions up to 2 MB only, as rows of small
# numbers take up to two hundred times their compressed size when widened, sorted and grouped. Sizes set by the user stay.
PIECES = {
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16m"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "2m"),
}
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
BYTES_PER_PARTITION = 1 << 20
# Queries that neither widen nor gather rows take larger shares. Two shuffles in a row make a piece for every pair of their
# partitions; between thousands of them a piece holds a few rows and hardly compresses, and a stream, whose partitions are
# never joined, keeps a state store and open files for each.
FLAT_BYTES = 4 << 20
RAISED, OWN = "inkgrade.shuffle.partitions.raised", "inkgrade.shuffle.partitions.own"  # what was set here, and before


class Tables:
    """Base tables of a data directory and the tables derived from them, as attributes."""

    def __init__(self, spark: SparkSession, base: str, flat: bool = False):
        if spark.conf.get(HUGE_METHOD_LIMIT) == "65535":
            spark.conf.set(HUGE_METHOD_LIMIT, "8000")
        for name, (default, pieces) in PIECES.items():
            if spark.conf.get(name) == default:
                spark.conf.set(name, pieces)
        if flat and spark.conf.get(RAISED, None) == spark.conf.get(SHUFFLE_PARTITIONS):
            spark.conf.set(SHUFFLE_PARTITIONS, spark.conf.get(OWN))
        self.spark, self.base, self._flat, self._seen, self._bytes = spark, base, flat, {}, 0

    def _read(self, path: str) -> DataFrame:
        """A given table; the number of shuffle partitions is raised to match the size of all that were read."""
        files = self.spark.read.format("binaryFile").load(path)
        self._bytes += files.agg(F.sum("length")).first()[0] or 0  # lengths only, no file is opened
        wanted = -(-self._bytes // (FLAT_BYTES if self._flat else BYTES_PER_PARTITION))
        conf, now = self.spark.conf, self.spark.conf.get(SHUFFLE_PARTITIONS)
        if wanted > int(now):
            if conf.get(RAISED, None) != now:
                conf.set(OWN, now)
            conf.set(SHUFFLE_PARTITIONS, str(wanted))
            conf.set(RAISED, str(wanted))
        return self.spark.read.parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self._read(f"{self.base}/{name}.parquet")
            else:
                text = _dialect(FIXTURES[name], 0)
                deps = {d: getattr(self, d) for d in set(_REF.findall(text))}
                self._seen[name] = self.spark.sql(text, **deps)
        return self._seen[name]


def _dialect(text, which: int) -> str:
    """Resolve the few spots where the two SQL dialects differ: ``<<spark|duckdb>>``."""
    return re.sub(r"<<(.*?)\|(.*?)>>", lambda m: m.group(1 + which), text, flags=re.S)


def _duck(text: str) -> str:
    """Standalone DuckDB statement: every table named in braces becomes a CTE, dependencies first."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in done or name in BASE:
            return
        body = FIXTURES[name] if name in FIXTURES else ORACLES_RAW[name]
        body = _dialect(body, 1)
        for dep in dict.fromkeys(_REF.findall(body)):
            visit(dep)
        done[name] = body

    text = _dialect(text, 1)
    for dep in dict.fromkeys(_REF.findall(text)):
        visit(dep)
    plain = lambda s: _REF.sub(r"\1", s).replace("{{", "{").replace("}}", "}")
    ctes = ",\n".join(f"{n} AS ({plain(b)})" for n, b in done.items())
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?(.*)", plain(text), flags=re.S)
    if own:
        ctes, body = (ctes + ",\n" if ctes else "") + own.group(2), ""
        return f"WITH RECURSIVE {ctes}"
    return f"WITH RECURSIVE {ctes}\n{plain(text)}" if ctes else plain(text)


ORACLES_RAW: dict[str, str] = {}


def query(name: str, sql: str | None = None, flat: bool = False):
    """Register a function of :class:`Tables` under ``name``, with its SQL twin; ``flat`` as at ``FLAT_BYTES``."""

    def add(fn):
        QUERIES[name] = lambda spark, base: fn(Tables(spark, base, flat))
        if sql is not None:
            ORACLES_RAW[name] = sql
        return fn

    return add


def oracle_statements() -> dict[str, str]:
    return {name: _duck(text) for name, text in ORACLES_RAW.items() if name in QUERIES}
