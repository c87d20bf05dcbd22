"""The stored build with its freshness, its current version and its removal.

Below one root folder, which driver and executors share::

    builds/<id>/...          the tables of one build, never changed once written
    builds/<id>/manifest     what they are, from which files, and what was counted
    current/<n>_<id>_<time>  empty files; the one with the largest n names the build
                             in force and when its sources were last seen unchanged
    leases/<id>_<reader>_<until>   empty files; a build with one not yet expired is read

A build is switched to by making one more file in ``current``, after its manifest is
written; making a file that exists fails, so of two builders one wins.  Readers keep
the build they opened.  ``refresh`` serves the build in force while it is younger than
``max_age`` (the result cache's lifetime), and after that as long as no source file has
changed; otherwise it builds anew.  ``prune`` removes builds that are neither in force
nor leased.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from tranche import config as C
from tranche.plans.tables import Tables
from tranche.sources import files
from tranche.sources.tables import table_path

SOURCES = ("region", "nation", "customer", "orders", "lineitem")
MAX_AGE = 3_600.0            # seconds
LEASE = 24 * 3_600.0         # seconds a reader may hold a build
UNFINISHED = 24 * 3_600.0    # seconds after which a build without a manifest is given up


@dataclass(frozen=True)
class Manifest:
    build: str
    source: str
    version: str             # of the source files
    params: str
    created: float
    tables: dict

    def counts(self) -> list[tuple[str, int, int | None]]:
        """(table, rows, rows without a company) as counted while the tables were written."""
        out = []
        for name, entry in self.tables.items():
            seen = [p["counted"] for p in entry["parts"].values()]
            nulls = [s["null_keys"] for s in seen if "null_keys" in s]
            out.append((name, sum(s["rows"] for s in seen), sum(nulls) if nulls else None))
        return out

    def warnings(self) -> list[str]:
        """What a build of sound sources would not have."""
        out = [f"{name}: no rows" for name, rows, _ in self.counts() if not rows]
        return out + [f"{name}: {nulls} of {rows} rows without a company" for name, rows, nulls in self.counts() if rows and nulls == rows]


def source_version(spark: SparkSession, sf_dir: str) -> str:
    return files.version(spark, [table_path(sf_dir, n) for n in SOURCES])


class Store:
    """Builds of one source under ``root``."""

    def __init__(self, spark: SparkSession, root: str, clock=time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    def _pointers(self) -> list[tuple[int, str, float]]:
        """(number, build, time its sources were seen) in order."""
        names = [n.split("_") for n in files.names(self.spark, f"{self.root}/current")]
        return sorted((int(n[0]), n[1], float(n[2])) for n in names if len(n) == 3)

    def _point(self, build: str) -> bool:
        last = max((n for n, _, _ in self._pointers()), default=0)
        return files.create(self.spark, f"{self.root}/current/{last + 1:09}_{build}_{self.clock():.3f}")

    def manifest(self, build: str) -> Manifest:
        return Manifest(**json.loads(files.read_text(self.spark, f"{self.root}/builds/{build}/manifest")))

    def current(self) -> Manifest | None:
        """The build in force (None: there is none yet)."""
        pointers = self._pointers()
        return self.manifest(pointers[-1][1]) if pointers else None

    def is_fresh(self, src: str, params: C.Params = C.DEFAULT, max_age: float = MAX_AGE) -> bool:
        """Whether the build in force may be served as it is; sources seen unchanged renew it."""
        pointers = self._pointers()
        if not pointers:
            return False
        held = self.manifest(pointers[-1][1])
        if (held.source, held.params) != (src, repr(params)):
            return False
        if self.clock() - pointers[-1][2] <= max_age:
            return True
        if held.version != source_version(self.spark, src):
            return False
        self._point(held.build)
        return True

    def refresh(self, src: str, params: C.Params = C.DEFAULT, max_age: float = MAX_AGE, buckets: int | None = None) -> Manifest:
        """The build in force if it is fresh, else a new one, switched to when all its tables are written."""
        if self.is_fresh(src, params, max_age):
            return self.current()
        version = source_version(self.spark, src)          # before reading: a file changed meanwhile makes the next refresh build
        build = f"{self.clock():.0f}-{uuid.uuid4().hex}"
        t = Tables(self.spark, src, params).materialize(f"{self.root}/builds/{build}", buckets=buckets)
        made = Manifest(build, src, version, repr(params), self.clock(), t.written)
        files.write_text(self.spark, f"{self.root}/builds/{build}/manifest", json.dumps(asdict(made)))
        while not self._point(build):                      # another builder took this number
            pass
        return made

    def tables(self, m: Manifest, params: C.Params = C.DEFAULT) -> Tables:
        return Tables.opened(self.spark, m.source, m.tables, params)

    @contextmanager
    def reading(self, params: C.Params = C.DEFAULT):
        """The tables of the build in force, kept from removal until the block ends (at most ``LEASE`` seconds)."""
        while True:
            held = self.current()
            if held is None:
                raise FileNotFoundError(f"no build under {self.root}")
            lease = f"{self.root}/leases/{held.build}_{uuid.uuid4().hex}_{self.clock() + LEASE:.0f}"
            files.create(self.spark, lease)
            if self.current().build == held.build:         # else it may have been removed before the lease was seen
                break
            files.remove(self.spark, lease)
        try:
            yield self.tables(held, params)
        finally:
            files.remove(self.spark, lease)

    def prune(self) -> list[str]:
        """Remove builds that are neither in force nor read, and return their ids."""
        pointers, now = self._pointers(), self.clock()
        keep = {pointers[-1][1]} if pointers else set()
        for name in files.names(self.spark, f"{self.root}/leases"):
            build, _, until = name.split("_")
            if float(until) > now:
                keep.add(build)
            else:
                files.remove(self.spark, f"{self.root}/leases/{name}")
        gone = []
        for build in files.names(self.spark, f"{self.root}/builds"):
            finished = files.exists(self.spark, f"{self.root}/builds/{build}/manifest")
            pointed = any(build == b for _, b, _ in pointers)
            waits = not (finished and pointed) and now - float(build.split("-")[0]) < UNFINISHED      # being written, or not yet pointed to
            if build not in keep and not waits:
                files.remove(self.spark, f"{self.root}/builds/{build}")
                gone.append(build)
        for n, build, seen in pointers:
            if build in gone:
                files.remove(self.spark, f"{self.root}/current/{n:09}_{build}_{seen:.3f}")
        return gone
