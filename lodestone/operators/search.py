"""Exact cosine search of a stated query set: blocks of queries meet chunks of items as matrices, in tasks that Spark deals out."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

QUERIES, CHUNK = 4096, 32768  #: about as many queries and items meet in a task
CELLS = 1 << 22  #: scores that a task holds at a time
BUCKETS = 64  #: parts into which rows go by what must match
NEAR = 2e-6  #: scores by matrices that are apart by less may be equal when rounded


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places as Spark rounds: half up by the shortest decimal of a number."""
    with np.errstate(invalid="ignore"):
        scaled = np.abs(x) * 1e6
        out = np.copysign(np.floor(scaled + 0.5) / 1e6, x) + 0.0
        for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
            out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return out


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pc.list_flatten(column).combine_chunks()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _exact(q: np.ndarray, x: np.ndarray, qn: np.ndarray, xn: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded cosines of the pairs (i, j), element after element as ``V.dot`` adds them; vectors stand in columns."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for a in range(0, len(i), CELLS):
            p, r = i[a : a + CELLS], j[a : a + CELLS]
            total = np.zeros(len(p))
            for own, other in zip(q, x, strict=True):
                total += own[p] * other[r]
            by = qn[p] * xn[r]
            out[a : a + CELLS] = rounded(np.where(by == 0, -np.inf, total / by))
    return out


def _meet(queries: pa.Table, items: pa.Table, k: int | None, by: list[str], match: list[str], itself: bool) -> pa.Table:
    """The pairs asked for of one block of queries and one chunk of items."""
    if not len(queries) or not len(items):
        return pa.table({"query_id": queries["query_id"].slice(0, 0), "id": items["id"].slice(0, 0)} | {c: items[c].slice(0, 0) for c in by} | {"score": pa.array([], pa.float64())})
    order = items.append_column("__at", pa.array(np.arange(len(items)))).sort_by([("id", "ascending")])["__at"].to_numpy()
    nulls = items["id"].null_count
    items = items.take(np.concatenate([order[len(order) - nulls :], order[: len(order) - nulls]]))  # nulls first, as Spark has them
    n, m = len(queries), len(items)
    q, x = _matrix(queries["__vector"], n), _matrix(items["__vector"], m)
    qn, xn = queries["__norm"].to_numpy(), items["__norm"].to_numpy()
    part, inside = np.zeros(m, int), [(np.arange(n), np.arange(m))]
    if by:
        part = items.select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy()
    if match:
        own = pd.concat([queries.select(match).to_pandas(), items.select(match).to_pandas()]).groupby(match, dropna=False, sort=False).ngroup().to_numpy()
        left, right = pd.Series(np.arange(n)).groupby(own[:n]).indices, pd.Series(np.arange(m)).groupby(own[n:]).indices
        inside = [(left[c], right[c]) for c in left.keys() & right.keys()]
    # Equal vectors of a part are scored once, and of their items only the first few by id can be among the best.
    same = pd.DataFrame({"v": [v.tobytes() for v in x], "part": part})
    if match:
        same["match"] = own[n:]
    same = same.groupby(list(same.columns), sort=False).ngroup().to_numpy()
    own_pair, spare = np.zeros(0, int), 0
    if not itself:
        side = lambda c, name: pa.table({"id": c, name: pa.array(np.arange(len(c)))}).filter(pc.is_valid(c))
        pairs = side(queries["query_id"], "i").join(side(items["id"], "j"), "id", join_type="inner")
        own_pair = pairs["i"].to_numpy() * m + pairs["j"].to_numpy()
        spare = int(np.bincount(pairs["i"].to_numpy()).max()) if len(pairs) else 0
    qt, out = np.ascontiguousarray(q.T), []
    qu, safe = q / qn[:, None], queries["__least"].to_numpy() if k is None else None
    for rows, cols in inside:
        for c in np.unique(part[cols]):
            own = cols[part[cols] == c]
            code, first, index = np.unique(same[own], return_index=True, return_inverse=True)
            xt, norms = np.ascontiguousarray(x[own[first]].T), xn[own[first]]
            held = np.argsort(index, kind="stable")  # items by vector, by id within
            counts = np.bincount(index, minlength=len(code))
            starts = np.cumsum(counts) - counts
            step = max(1, CELLS // len(code))
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                near = (qu[some] @ xt) / norms
                near[np.isnan(near)] = np.inf
                if k is None:
                    limit = safe[some]
                elif len(code) <= k + spare:
                    limit = np.full(len(some), -np.inf)
                else:
                    limit = np.partition(near, len(code) - k - spare, axis=1)[:, len(code) - k - spare]
                i, j = np.nonzero(near >= (limit - NEAR)[:, None])
                score = _exact(qt[:, some], xt, qn[some], norms, i, j)
                kept = score != -np.inf
                if k is None:
                    kept &= ~(score < limit[i])
                i, j, score = i[kept], j[kept], score[kept]
                size = counts[j] if k is None else np.minimum(counts[j], k + spare)
                pair = np.repeat(np.arange(len(i)), size)
                item = own[held[starts[j][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)]]
                asked, score = some[i][pair], score[pair]
                if len(own_pair):
                    kept = ~np.isin(asked * m + item, own_pair)
                    asked, item, score = asked[kept], item[kept], score[kept]
                if k is not None and len(asked):
                    o = np.lexsort((item, np.where(np.isnan(score), -np.inf, -score), asked))
                    asked, item, score = asked[o], item[o], score[o]
                    begin = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]])
                    kept = np.arange(len(asked)) - np.repeat(begin, np.diff(np.r_[begin, len(asked)])) < k
                    asked, item, score = asked[kept], item[kept], score[kept]
                out.append((asked, item, score))
    asked, item, score = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in enumerate((int, int, float)))
    found = {"query_id": queries["query_id"].take(asked), "id": items["id"].take(item)} | {c: items[c].take(item) for c in by}
    return pa.table(found | {"score": pa.array(score)})


def _bucketed(rows: DataFrame, match: list[str], like: DataFrame) -> DataFrame:
    """With ``__bucket`` by the ``match`` columns; by the types of ``like``, so that equal values of two types go to one."""
    if not match:
        return rows.withColumn("__bucket", F.lit(0))
    kinds = {f.name: f.dataType for f in like.schema}
    return rows.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(c).try_cast(kinds[c]) for c in match]), F.lit(BUCKETS)).cast("int"))


def _parts(rows: DataFrame, most: int) -> int:
    """How many parts of about ``most`` rows the largest bucket has."""
    return -(-(rows.groupBy("__bucket").count().agg(F.max("count")).first()[0] or 0) // most) or 1


def _found(queries: DataFrame, items: DataFrame, k: int | None, by: list[str], match: list[str], itself: bool, least: Column | None) -> DataFrame:
    usable = lambda c: (V.norm(F.col(c)) > 0) & ~F.exists(c, lambda x: x.isNull())
    present = lambda rows: _bucketed(rows.dropna(subset=match) if match else rows, match, items)
    asked = present(queries).filter(usable("query")).select("query_id", *match, "__bucket", F.col("query").alias("__vector"), V.norm(F.col("query")).alias("__norm"), F.size("query").alias("__dim"), *([] if least is None else [least.cast("double").alias("__least")]))
    own = present(items).filter(usable("vector")).select("id", *dict.fromkeys([*by, *match]), "__bucket", F.col("vector").alias("__vector"), V.norm(F.col("vector")).alias("__norm"), F.size("vector").alias("__dim"))
    blocks, chunks = _parts(present(queries), QUERIES), _parts(present(items), CHUNK)
    spread = lambda rows, c, mine, n, other, m: rows.withColumns({mine: F.pmod(F.xxhash64(c), F.lit(n)), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    left = spread(asked, "query_id", "__block", blocks, "__chunk", chunks)
    right = spread(own, "id", "__chunk", chunks, "__block", blocks)
    key = ["__dim", "__bucket", F.col("__block").cast("long"), F.col("__chunk").cast("long")]
    kinds = {"query_id": queries.schema["query_id"].dataType, "id": items.schema["id"].dataType} | {c: items.schema[c].dataType for c in by}
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds.items()) + ", score double"
    run: Callable[[pa.Table, pa.Table], pa.Table] = lambda a, b: _meet(a, b, k, by, match, itself)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def best(queries: DataFrame, items: DataFrame, k: int, *by: str, match: tuple[str, ...] = (), itself: bool = True) -> DataFrame:
    """Of every query (``query_id, query``) the ``k`` items (``id, vector``) of largest cosine, for each ``by``: ``query_id, id, score, rank`` and ``by``.

    Exact: cosines are rounded to 6 places, ties go by id, zero vectors and those of another length are left
    out, ``match`` columns must be equal, and without ``itself`` the item of the query's own id is left out.
    Every query meets every item once, in a task for a block of queries and a chunk of items (of one bucket
    of what must match, so that no others are sent there): a matrix product finds whose scores may be among
    the first, and these are added up as ``V.cosine`` would.
    """
    from .retrieval import ranked

    found = _found(queries, items, k, list(by), list(match), itself, None)
    return ranked(found, "score", k, "rank", *by)


def above(queries: DataFrame, items: DataFrame, least: Column, itself: bool = True) -> DataFrame:
    """Every pair (``query_id, id, score``) of a cosine of at least ``least``, an expression over ``queries``; otherwise as ``best``."""
    return _found(queries, items, None, [], [], itself, least)
