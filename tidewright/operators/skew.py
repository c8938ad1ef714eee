"""Equi-joins that survive a key holding a large share of all rows, and cutting of lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import ensure_checkpoint_dir

#: A key counts as hot beyond this share of the rows, so there are at most 1 / SHARE hot keys.
SHARE, LEAST = 0.005, 2000


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared checkpoint folder: computed once, and safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(df: DataFrame, key: str, share: float = SHARE, least: int = LEAST) -> list:
    """Keys that hold more than ``share`` of the rows (and more than ``least`` rows): at most ``1 / share`` values.

    The count is pre-aggregated on the map side; only the ``1 / share`` most frequent keys reach the driver, and all rows
    are counted only if one of them is frequent at all. NULL is no key.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.where(F.col("__n") > least).orderBy(F.col("__n").desc()).limit(int(1 / share)).collect()
    if not top:
        return []
    total = df.count()
    return [r[key] for r in top if r["__n"] > share * total]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None, hashed: bool = True) -> DataFrame:
    """``left`` joined to ``right``, whose key is unique, on one equal key.

    Rows of hot keys of ``left`` stay where they are: the few matching rows of ``right`` are broadcast to them. All
    other rows take the shuffle join, a hash join on the rows of ``right``, or (not ``hashed``) what the optimizer takes for
    their size. ``hot`` is the bounded list from :func:`hot_keys`, counted here if not given.
    NULL keys match nothing (``left`` pads them). An empty side gives an empty (inner) or padded (left) result.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    hot = hot_keys(left, key) if hot is None else hot
    rest = (lambda df: df.hint("shuffle_hash")) if hashed else (lambda df: df)
    if not hot:
        return left.join(rest(right), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    one = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how)
    return one.unionByName(left.where(~is_hot).join(rest(right.where(~F.col(key).isin(hot))), key, how))
