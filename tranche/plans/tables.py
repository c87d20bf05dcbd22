"""The derived tables T1-T13 of one source folder (S3: the dashboard bundle).

Each table is a lazy ``DataFrame`` memoised on the instance, so a query that uses T1
twice hands Spark one logical subtree (and one set of exchanges to reuse).
``materialize`` writes them once and reads them back (S8), cutting lineage before the
many downstream reports; how each is laid out is told at ``_LAYOUT``.

``for_companies`` and ``region_agreements`` are the drill-downs' way in: they name
companies by literals, which reach the scans of the sources or of the stored tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tranche import config as C
from tranche.operators import alerts as AL
from tranche.operators import companies as CO
from tranche.operators import grouped as G
from tranche.operators import lookup as LK
from tranche.operators import receipts as RC
from tranche.operators import recovery as RV
from tranche.operators import series as SE
from tranche.operators import summary as SU
from tranche.operators.skew import MAX_BROADCAST_KEYS, PLAIN, SMALL, Hot, count_hot
from tranche.session import ensure_checkpoint_dir
from tranche.sources import store, testdata

KEY = store.KEY

#: How a table is stored.  "company": bucketed by company, the rows of hot companies and those without
#: a company beside it; "unique": bucketed by company as a whole (few rows a company); "region", "year":
#: partitioned by that column; others plain.
_LAYOUT = {"agreements": "company", "receipts": "company", "alerts": "company",
           "company_rollup": "unique", "companies": "unique", "scores": "unique",
           "agreements_by_region": "region", "series": "year"}
_PARTITION = {"region": "cd_gerfe", "year": "ano_pedido"}


class Tables:
    """T1-T13, lazy until ``materialize``."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: C.Params = C.DEFAULT):
        self.spark, self.sf_dir = spark, sf_dir
        self.params = params
        self._memo: dict[str, DataFrame | Hot | str] = {}
        self._stored: set[str] = set()
        self._parts: dict[str, store.Parts] = {}
        self.written: dict[str, dict] = {}

    def _get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    @property
    def hot(self) -> Hot:
        """Hot customers, counted once and shared by every company-keyed join."""
        return self._get("hot", lambda: testdata.hot_customers(self.spark, self.sf_dir, self.params))

    @property
    def hot_customers(self) -> DataFrame:
        return self.hot.keys

    @property
    def hot_companies(self) -> Hot | str:
        """The same as company keys (in a view of few companies: that they are few)."""
        def find():
            p = self._parts.get("agreements")
            if p is not None and "hot" not in self._memo:         # opened from a store
                return count_hot(p.frame if p.rest is None else p.rest, KEY, self.params.skew)
            return testdata.hot_companies(self.hot)

        return self._get("hot_companies", find)

    @property
    def agreements(self):
        return self._get("agreements", lambda: testdata.agreements(
            self.spark, self.sf_dir, self.params, hot_cust=self.hot))

    @property
    def agreements_core(self):
        """T1 minus company attributes (no orders -> customer join)."""
        return self._get("agreements_core", lambda: testdata.agreements_core(self.spark, self.sf_dir))

    @property
    def agreements_by_region(self):
        """J1's columns of T1 with the region, stored by region and value."""
        return self._get("agreements_by_region", lambda: self.agreements.select(*LK.J1_COLUMNS, KEY, "cd_gerfe"))

    @property
    def company_rollup(self):
        return self._get("company_rollup", lambda: CO.company_rollup(self.agreements, self.params))

    @property
    def companies(self):
        return self._get("companies", lambda: CO.companies(self.agreements, self.params, self.company_rollup))

    @property
    def scores(self):
        return self._get("scores", lambda: CO.company_scores(self.companies))

    def keep(self, name: str) -> None:
        """Write a table now to the shared folder, for a query that reads it several times."""
        if name not in self._stored:
            place = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/kept-{name}-{uuid.uuid4().hex}"
            self._memo[name] = store.write_and_reload(getattr(self, name), place)
            self._stored.add(name)

    def _sides(self) -> list[tuple[DataFrame, Hot | str]]:
        """T1 with the way its company joins go: as one, or as its stored parts."""
        p = self._parts.get("agreements")
        if p is None:
            return [(self.agreements_core, self.hot_companies)]
        return [(p.keyed, PLAIN)] + ([] if p.rest is None else [(p.rest, self.hot_companies)])

    def _receipts(self, side: tuple[DataFrame, Hot | str]) -> DataFrame:
        return RC.expected_receipts(side[0], self.scores, self.params, hot=side[1])

    def _alerts(self, side: tuple[DataFrame, Hot | str]) -> DataFrame:
        return AL.alerts(side[0], self.scores, self.params, hot=side[1])

    def _joined(self, build) -> DataFrame:
        first, *others = [build(side) for side in self._sides()]
        return first.unionByName(others[0]) if others else first

    @property
    def receipts(self):
        return self._get("receipts", lambda: self._joined(self._receipts))

    @property
    def series(self):
        return self._get("series", lambda: SE.monthly_series(self.agreements_core))

    def series_of(self, year: int | None = None) -> DataFrame:
        """T5 for one year (None: all).  Stored, the year's folder is read; else the year's agreements."""
        if "series" in self._stored or year is None:
            return SE.filter_year(self.series, year)
        return SE.monthly_series(SE.requested_in(self.agreements_core, year))

    @property
    def region(self):
        return self._get("region", lambda: G.region_metrics(
            self.agreements, self.scores, self.params, self.company_rollup))

    @property
    def sector(self):
        return self._get("sector", lambda: G.sector_metrics(
            self.agreements, self.scores, self.params, self.company_rollup))

    @property
    def activity(self):
        return self._get("activity", lambda: G.activity_metrics(
            self.agreements, self.scores, self.params, self.company_rollup))

    @property
    def band(self):
        return self._get("band", lambda: G.band_metrics(self.agreements_core, self.scores, self.params))

    @property
    def programme(self):
        return self._get("programme", lambda: G.programme_metrics(self.agreements_core, self.scores, self.params))

    @property
    def recovery(self):
        return self._get("recovery", lambda: RV.recovery_agreements(self.agreements_core, self.params))

    @property
    def alerts(self):
        return self._get("alerts", lambda: self._joined(self._alerts))

    @property
    def summary(self):
        return self._get("summary", lambda: SU.executive_summary(
            self.agreements_core, self.companies, self.params, sides=self._sides()))

    PER_COMPANY = ("agreements", "agreements_core", "company_rollup", "companies", "scores",
                   "receipts", "alerts")

    def for_companies(self, roots: list[str]) -> "Tables":
        """A view of at most ``testdata.MAX_WANTED`` companies, named by literals.

        Every per-company table (companies, scores, receipts, alerts) is read, or
        computed, for those companies only, which is exact: each depends on its own
        company's agreements alone.  Aggregates across companies (region, series,
        summary) are not meaningful on the view."""
        wanted = testdata.Wanted(testdata.customers_of(roots))
        if len(roots) > testdata.MAX_WANTED:
            raise ValueError(f"a drill-down takes at most {testdata.MAX_WANTED} companies")
        sub = Tables(self.spark, self.sf_dir, self.params)
        sub._memo["hot_companies"] = SMALL
        among = F.col(KEY) == roots[0] if len(roots) == 1 else F.col(KEY).isin(list(roots)) if roots else F.lit(False)
        for n in self.PER_COMPANY:
            if n in self._stored:
                sub._memo[n] = self._memo[n].where(among)
                sub._stored.add(n)
        if "agreements" not in self._stored:
            base = self._memo.get("agreements") if self._derived else None
            rows = base if base is not None else testdata.agreements(self.spark, self.sf_dir, self.params, wanted=wanted)
            sub._memo["agreements"] = sub._memo["agreements_core"] = rows.where(among)
        return sub

    _derived = False      # T1 was given, not built from the sources (it cannot be narrowed at their scans)

    def with_agreements(self, agreements: DataFrame) -> "Tables":
        """The same tables over another T1."""
        out = Tables(self.spark, self.sf_dir, self.params)
        out._memo["hot"] = self.hot
        out._memo["agreements"] = out._memo["agreements_core"] = agreements
        out._derived = True
        return out

    def region_agreements(self, cd_gerfe: int, limit: int = 500) -> DataFrame:
        """A region's ``limit`` largest agreements with their companies' scores.

        Stored, they are the first of the region's folder.  Else they are found from
        few columns first, then read with their lines and companies."""
        here = F.col("cd_gerfe") == F.lit(cd_gerfe)
        if limit > testdata.MAX_WANTED:
            raise ValueError(f"a drill-down takes at most {testdata.MAX_WANTED} agreements")
        if "agreements_by_region" in self._stored or self._derived:
            rows = self.agreements_by_region.where(here).orderBy(*LK.j1_order()).limit(limit).drop("cd_gerfe").collect()   # at most limit
            top = self.spark.createDataFrame(rows, self.agreements_by_region.drop("cd_gerfe").schema)
            roots = sorted({r[KEY] for r in rows if r[KEY] is not None})
        else:
            wanted = testdata.top_orders(self.spark, self.sf_dir, cd_gerfe, limit, self.params, self.hot)
            top = testdata.agreements(self.spark, self.sf_dir, self.params, wanted=wanted).where(here).select(*LK.J1_COLUMNS, KEY)
            roots = [testdata.root_of(c) for c in wanted.customers]
        return LK.region_agreements(top, self.for_companies(roots).scores)

    TABLE_NAMES = ("agreements", "agreements_by_region", "agreements_core", "company_rollup", "companies", "scores", "receipts",
                   "series", "region", "sector", "activity", "band", "programme", "recovery", "alerts",
                   "summary")

    def materialize(self, out_dir: str | None = None, names=TABLE_NAMES, buckets: int | None = None,
                    options: dict[str, str] | None = None) -> "Tables":
        """Write each table once (in dependency order) and read it back.

        ``out_dir`` defaults to a new folder of this build under the session's
        shared checkpoint directory, so a lost executor never loses a finished
        table, and builds of other sources or runs never overwrite each other.
        ``buckets`` (default: the shuffle partitions) cut the tables by company;
        ``options`` go to the parquet writer of those.  ``written`` tells, for each
        table, its layout and what was counted while it was written."""
        base = out_dir or f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        n_buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for n in names:
            if n == "agreements_core" and "agreements" in names:
                self._memo[n] = self._memo["agreements"]   # the stored T1 is a superset
                self._stored.add(n)
                continue
            layout = _LAYOUT.get(n, "plain")
            if layout == "company" and n == "agreements":
                self._write_agreements(base, n_buckets, options)
            elif layout == "company" and "agreements" in self._parts:
                build = {"receipts": self._receipts, "alerts": self._alerts}[n]
                keyed, *rest = [build(side) for side in self._sides()]
                self._write_parts(n, base, keyed, rest[0] if rest else None, n_buckets, options)
            elif layout in ("company", "unique"):
                self._memo[n] = self._write(n, n, getattr(self, n), base, n_buckets, options)
            else:
                self._memo[n] = self._write(n, n, getattr(self, n), base, partition=_PARTITION.get(layout))
            self._stored.add(n)
        return self

    def _write(self, name: str, folder: str, df: DataFrame, base: str, buckets: int | None = None,
               options: dict[str, str] | None = None, partition: str | None = None) -> DataFrame:
        path, order = f"{base}/{folder}", ["cd_gerfe", *LK.j1_order()]
        if partition == "cd_gerfe":        # by region and value: a large region is many files, its top agreements the first
            df = df.repartitionByRange(*order)
        counted, seen = store.observed(df)     # after a dealing by ranges, which reads its input twice
        if buckets:
            out = store.write_bucketed(counted, path, buckets, options)
        else:
            out = store.write_and_reload(counted, path, order if partition == "cd_gerfe" else None, [partition] if partition else None)
        entry = {"path": path, "schema": df.schema.json(), "buckets": buckets, "counted": seen.get()}
        self.written.setdefault(name, {"parts": {}})["parts"][folder] = entry
        return out

    def _write_agreements(self, base: str, buckets: int, options: dict[str, str] | None) -> None:
        t1, hot = self.agreements, self.hot_companies
        if not hot.rows and not hot.null_rows:
            return self._write_parts("agreements", base, t1, None, buckets, options)
        t1 = store.write_and_reload(t1, f"{base}/agreements_as_built", [])        # read twice below
        listed = F.broadcast(hot.keys.select(KEY)) if hot.rows <= MAX_BROADCAST_KEYS else hot.keys.select(KEY)
        keyed = t1.where(F.col(KEY).isNotNull()).join(listed, KEY, "left_anti").select(*t1.columns)
        rest = t1.where(F.col(KEY).isNull()).unionByName(t1.join(listed, KEY, "left_semi").select(*t1.columns))
        self._write_parts("agreements", base, keyed, rest, buckets, options)

    def _write_parts(self, name: str, base: str, keyed: DataFrame, rest: DataFrame | None, buckets: int,
                     options: dict[str, str] | None) -> None:
        stored = self._write(name, name, keyed, base, buckets, options)
        if rest is not None:       # a hot company over many files, each with some of its agreements
            rest = self._write(name, f"{name}_hot", rest.repartitionByRange(KEY, "num_parcelamento"), base)
        parts = store.Parts(stored, rest)
        if name == "agreements":
            self._parts[name] = parts
        self._memo[name] = parts.frame

    @staticmethod
    def opened(spark: SparkSession, sf_dir: str, written: dict[str, dict], params: C.Params = C.DEFAULT) -> "Tables":
        """The stored tables that ``written`` describes, perhaps of another session."""
        out = Tables(spark, sf_dir, params)
        out.written = written
        for name, entry in written.items():
            frames = []
            for part in entry["parts"].values():
                schema = StructType.fromJson(json.loads(part["schema"]))
                frames.append(store.open_bucketed(spark, part["path"], schema, part["buckets"]) if part["buckets"]
                              else store.read_table(spark, part["path"], schema))
            parts = store.Parts(frames[0], frames[1] if len(frames) > 1 else None)
            if name == "agreements":
                out._parts[name] = parts
                out._memo["agreements_core"] = parts.frame
                out._stored.add("agreements_core")
            out._memo[name] = parts.frame
            out._stored.add(name)
        return out
