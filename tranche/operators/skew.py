"""Join helpers that stay safe when one key holds a large share of the rows.

``lookup_join`` joins a fact table to a dimension that is unique per key
(agreements -> company scores, orders -> customers).  A plain shuffle join
sends every row of a hot key to one task; here the hot keys are found first
(``count_hot``: a partial-aggregated count, so the count itself is skew-safe, run
once per build), and only their fact rows are spread over a number of buckets
proportional to the key's row count while the matching dimension rows are
replicated to each bucket.  The list of hot keys is a table in the shared folder, as
a low threshold makes it grow with the keys: up to ``MAX_BROADCAST_KEYS`` of them, the
hottest, are broadcast; the others, each a small part of the rows, are looked up by a
shuffle join.  Rows whose key is null match nothing and are spread
by a hash of their row id.  Salts come from that hash, never from ``rand()``, so
a recomputed task after an executor loss routes the same rows to the same
buckets.  The list's length is counted while it is written, so a join whose list is
empty is a plain one, and planning a join starts no job.

Two sides need no list: ``PLAIN`` is for facts that hold neither hot nor null keys
(the stored part that is bucketed by company), ``SMALL`` for a dimension of a
bounded set of keys, which is broadcast.

``bounded_broadcast`` broadcasts a side only after checking it has at most
``max_rows`` rows; beyond that the join is left to the shuffle planner.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.config import SkewParams
from tranche.session import ensure_checkpoint_dir
from tranche.sources.store import Counted, write_and_reload

_SALT = "_salt"
_HOT = "_hot"
MAX_BROADCAST_KEYS = 100_000

#: Ways of ``lookup_join`` for sides known to be safe (see above).
PLAIN, SMALL = "plain", "small"


@dataclass(frozen=True)
class Hot:
    """The hot keys of a fact (``key``, ``_n``), their number, and the fact's rows without a key."""

    keys: DataFrame
    rows: int
    null_rows: int

    def renamed(self, keys: DataFrame) -> "Hot":
        return Hot(keys, self.rows, self.null_rows)


def hot_keys(fact: DataFrame, key: str, skew: SkewParams) -> DataFrame:
    """(``key``, ``_n``): every key of ``fact`` with at least ``rows_per_bucket`` rows."""
    counts = (fact.select(key).where(F.col(key).isNotNull())
              .groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    return counts.where(F.col("_n") >= F.lit(skew.rows_per_bucket))


def _shared(df: DataFrame, what: str) -> DataFrame:
    return write_and_reload(df, f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}")


def count_hot(fact: DataFrame, key: str, skew: SkewParams) -> Hot:
    """The hot keys, counted now in one pass and kept as a table in the shared folder (no key reaches the driver)."""
    if not skew.enabled:
        none = fact.sparkSession.createDataFrame([], fact.select(key, F.lit(0).cast("long").alias("_n")).schema)
        return Hot(none, 0, 0)
    seen, null = Counted(rows=0, nulls=0), F.col(key).isNull()
    counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= F.lit(skew.rows_per_bucket)) | null)
    listed = counts.observe(seen.seen, F.count_if(~null).alias("rows"), F.sum(F.when(null, F.col("_n"))).alias("nulls"))
    stored = _shared(listed, "hot-keys")
    got = seen.get()
    return Hot(stored.where(~null), got["rows"], got["nulls"])


def find_hot(fact: DataFrame, key: str, skew: SkewParams) -> DataFrame:
    """The table of ``count_hot``."""
    return count_hot(fact, key, skew).keys


def salt_buckets(n, skew: SkewParams):
    """Buckets for a hot key with ``n`` rows: ceil(n / rows_per_bucket)."""
    return F.ceil(n / F.lit(float(skew.rows_per_bucket))).cast("int")


def _with_buckets(fact: DataFrame, hot: DataFrame, key: str, few: bool | None = None) -> DataFrame:
    """``fact`` with the buckets of its key (``_HOT``; null: not hot); ``few``: the list can be broadcast, None: not known."""
    if row_count_at_most(hot, MAX_BROADCAST_KEYS) if few is None else few:
        return fact.join(F.broadcast(hot), key, "left")
    top = F.broadcast(_shared(hot.orderBy(F.desc(_HOT), key).limit(MAX_BROADCAST_KEYS), "hottest-keys"))
    marked = fact.join(top, key, "left")
    told = F.col(_HOT).isNotNull() | F.col(key).isNull()            # neither the hottest nor null keys are shuffled by key
    rest = marked.where(~told).drop(_HOT).join(hot.join(top, key, "left_anti"), key, "left")
    return marked.where(told).unionByName(rest)


def lookup_join(fact: DataFrame, dim: DataFrame, key: str, row_id: list[str],
                skew: SkewParams, how: str = "left", hot: Hot | DataFrame | str | None = None) -> DataFrame:
    """Join ``fact`` to ``dim`` (unique per ``key``) with hot keys salted.

    ``row_id`` columns identify a fact row; their hash picks the salt.
    ``hot`` (``count_hot``, or a table of ``key`` and ``_n``) can be passed in when
    the hot keys are already known, e.g. shared by every company-keyed join of a
    run; salting a key that is not hot, or missing one, never changes the result.
    ``PLAIN`` and ``SMALL`` say that no list is needed."""
    if hot == SMALL:
        return fact.join(F.broadcast(dim), key, how)
    if hot == PLAIN or not skew.enabled:
        return fact.join(dim, key, how)
    if hot is None:
        hot = count_hot(fact, key, skew)
    spread = F.xxhash64(*[F.col(c) for c in row_id])
    if isinstance(hot, Hot) and not hot.rows:
        if not hot.null_rows:
            return fact.join(dim, key, how)
        salted = fact.withColumn(_SALT, F.when(F.col(key).isNull(), F.hash(spread)).otherwise(F.lit(0)))
        none = dim.withColumn(_SALT, F.explode(F.array(F.lit(0))))     # a literal would be no join key
        return salted.join(none, [key, _SALT], how).drop(_SALT)
    few = hot.rows <= MAX_BROADCAST_KEYS if isinstance(hot, Hot) else None
    nb = F.col(_HOT)
    listed = (hot.keys if isinstance(hot, Hot) else hot).select(key, salt_buckets(F.col("_n"), skew).alias(_HOT))
    if few is None:
        few = row_count_at_most(listed, MAX_BROADCAST_KEYS)
    f = (_with_buckets(fact, listed, key, few)
         .withColumn(_SALT, F.when(nb.isNotNull(), F.pmod(spread, nb).cast("int"))
                     .when(F.col(key).isNull(), F.hash(spread)).otherwise(F.lit(0)))
         .drop(_HOT))
    d = (dim.join(F.broadcast(listed) if few else listed, key, "left")
         .withColumn(_SALT, F.explode(
             F.when(nb.isNotNull(), F.sequence(F.lit(0), nb - 1))
             .otherwise(F.array(F.lit(0)))))
         .drop(_HOT))
    return f.join(d, [key, _SALT], how).drop(_SALT)


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise plain (shuffle) join."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df
