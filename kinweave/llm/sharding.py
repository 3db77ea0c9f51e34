"""Sharding by histogram sort.

The order is (64-bit hash of the text, doc_id), so equal texts lie side by
side. Splitters of that order are found without moving a text: each round
counts exact bytes and rows between candidate boundaries, one histogram per
partition, summed; the interval that holds a wanted byte position is probed
more finely in the next round until a boundary meets the tolerance. Then the
documents are exchanged once.

Law: bytes. Splitters fall between groups of equal texts wherever such a place
is within `group_tolerance` of a shard's share; only a group too large for that
is cut, between two of its documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWEST, OWN, stage, utf8_size, without

LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_ADDED = ("size", "shard", "slot")


def bucket_of(h: np.ndarray, d: np.ndarray, bh: np.ndarray, bd: np.ndarray) -> np.ndarray:
    """Number of boundaries (bh, bd), sorted, that are at most the key (h, d) of each row."""
    left = np.searchsorted(bh, h, "left")
    right = np.searchsorted(bh, h, "right")
    out = left
    for i in np.unique(left[left < right]):
        rows = np.flatnonzero((left == i) & (right > i))
        to = right[rows[0]]
        out[rows] = i + np.searchsorted(bd[i:to], d[rows], "right")
    return out


def _histogram(slim: DataFrame, bh: np.ndarray, bd: np.ndarray) -> pd.DataFrame:
    """Exact bytes, rows and least and greatest keys of every interval between the boundaries."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["bucket"] = bucket_of(pdf["h"].to_numpy(), pdf["d"].to_numpy(), bh, bd)
            g = pdf.groupby("bucket")
            yield pd.DataFrame({"bytes": g["size"].sum(), "n": g["size"].size(), "h0": g["h"].min(), "h1": g["h"].max(), "d0": g["d"].min(), "d1": g["d"].max()}).reset_index()

    parts = slim.mapInPandas(count, "bucket long, bytes long, n long, h0 long, h1 long, d0 long, d1 long")
    out = parts.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("h0").alias("h0"), F.max("h1").alias("h1"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    return out.toPandas().set_index("bucket").reindex(range(len(bh) + 1), fill_value=0)  # whole numbers stay whole


def find_splitters(slim: DataFrame, shares: int, per_shard: int, tolerance: float, group_tolerance: float, probes: int, rounds: int) -> dict[str, np.ndarray]:
    """Boundaries at every multiple of total / (shares * per_shard) bytes, with the rows below each."""
    total = int(slim.agg(F.sum("size")).first()[0])
    shard = total / shares
    wanted = [(i * total / (shares * per_shard), i % per_shard == 0) for i in range(1, shares * per_shard)]
    bh, bd = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for last in range(rounds, -1, -1):
        x = _histogram(slim, bh, bd)
        size, n = x["bytes"].to_numpy(np.int64), x["n"].to_numpy(np.int64)
        below, rows = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(n)])
        keys = {(int(h), int(d)) for h, d in zip(bh, bd, strict=True)}
        chosen, more = [], set()
        for target, main in wanted:
            k = int(np.searchsorted(below[1:-1], target, "right"))
            # interval k lies between boundary k - 1 and boundary k
            ends = [(abs(target - below[j + 1]), j) for j in (k - 1, k) if 0 <= j < len(bh)]
            edges = [e for e in ends if bd[e[1]] == LOW]
            slack = tolerance * shard if main else shard / per_shard / 4
            if edges and min(edges)[0] <= slack:
                chosen.append(min(edges)[1])
                continue
            one_group = n[k] > 0 and x["h0"][k] == x["h1"][k]
            if one_group:
                h, d0, d1 = int(x["h0"][k]), int(x["d0"][k]), int(x["d1"][k])
                around = [(h, LOW)] + ([(h + 1, LOW)] if h < HIGH else [])
                known = [e for e in around if e not in keys]
                if not known and edges and min(edges)[0] <= max(slack, group_tolerance * shard):
                    chosen.append(min(edges)[1])
                    continue
                if ends and min(ends)[0] <= slack:
                    chosen.append(min(ends)[1])
                    continue
                step = max(1, (d1 - d0) // (probes + 1))
                new = known + ([(h, d0 + step * i) for i in range(1, probes + 1) if d0 + step * i <= d1] + [(h, d1)] if not known and d0 < d1 else [])
            else:
                h0, h1 = (int(x["h0"][k]), int(x["h1"][k])) if n[k] else (0, 0)
                step = max(1, (h1 - h0) // (probes + 1))
                new = [(h0 + step * i, LOW) for i in range(1, probes + 1) if h0 + step * i <= h1] + [(h1, LOW)] if n[k] else []
            new = [p for p in new if p not in keys]
            more.update(new)
            if ends:
                chosen.append(min(ends)[1])
            if (not new or not last) and not ends:
                chosen.append(-1)
        if not more or not last:
            break
        order = sorted(keys | more)
        bh, bd = (np.array([p[i] for p in order], dtype=np.int64) for i in (0, 1))
    at = np.maximum.accumulate(np.array(chosen, dtype=np.int64)) if chosen else np.zeros(0, np.int64)
    at_rows = np.where(at < 0, 0, rows[at + 1])
    return {"h": np.where(at < 0, LOW, bh[at] if len(bh) else LOW), "d": np.where(at < 0, LOW, bd[at] if len(bd) else LOW), "rows": at_rows}


def histogram_sort(docs: DataFrame, shards: int = 24, tolerance: float = 0.005, group_tolerance: float = 0.05, task_bytes: int = 256 << 20, probes: int = 16, rounds: int = 40) -> DataFrame:
    """All columns of docs with size (UTF-8 bytes of the text plus 8), shard and slot (gapless from 0 in each shard).

    A shard is dealt to several tasks of about task_bytes each, for whose
    boundaries a loose tolerance suffices; what is broadcast is one boundary
    per task. Null texts form one group of size 8; a null doc_id sorts first;
    rows equal in text and doc_id stay together, in any order; an empty table
    gives an empty result; columns of docs named like the added ones are replaced.
    """
    docs = without(docs, _ADDED).withColumns({f"{OWN}h": F.xxhash64("text"), f"{OWN}d": F.coalesce("doc_id", F.lit(LOWEST)), "size": utf8_size(F.col("text")) + 8})
    slim = stage(docs.select(F.col(f"{OWN}h").alias("h"), F.col(f"{OWN}d").alias("d"), "size"), "keys")
    total = slim.agg(F.sum("size")).first()[0]
    if total is None:
        return docs.drop(f"{OWN}h", f"{OWN}d").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    per_shard = max(1, math.ceil(total / shards / task_bytes))
    s = find_splitters(slim, shards, per_shard, tolerance, group_tolerance, probes, rounds)
    bh, bd, starts = s["h"], s["d"], np.concatenate([[0], s["rows"]])
    base = starts - starts[(np.arange(len(starts)) // per_shard) * per_shard]
    held = docs.sparkSession.sparkContext.broadcast((bh, bd, base))

    @F.pandas_udf("range int, base long")
    def place(h: pd.Series, d: pd.Series) -> pd.DataFrame:
        bh, bd, base = held.value
        r = bucket_of(h.to_numpy(), d.to_numpy(), bh, bd)
        return pd.DataFrame({"range": r.astype(np.int32), "base": base[r]})

    out = docs.withColumn(f"{OWN}p", place(f"{OWN}h", f"{OWN}d")).withColumn(f"{OWN}r", F.col(f"{OWN}p.range"))
    # range number k is partition k: no two ranges meet in a task
    out = out.repartitionById(len(bh) + 1, F.col(f"{OWN}r"))
    w = Window.partitionBy(f"{OWN}r").orderBy(f"{OWN}h", f"{OWN}d")
    out = out.withColumn("slot", F.row_number().over(w) - 1 + F.col(f"{OWN}p.base"))
    return out.withColumn("shard", (F.col(f"{OWN}r") / per_shard).cast("int")).drop(*[c for c in out.columns if c.startswith(OWN)])
