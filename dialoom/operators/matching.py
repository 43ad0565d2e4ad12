"""Optimal matching of generated to reference turns inside a window of frames.

Rows are frames where something is generated, columns all frames of the sample. A pair inside the window costs its text
cost plus a distance cost; each row takes one column so that the sum is least. The problem is a band: a row
meets at most as many columns as the window is wide. Rows are placed one after the other along shortest
augmenting paths, found on a heap over the band's edges, with prices of rows and columns that stay
feasible; memory is the band, rows times window. The prices prove the result: no pair costs less than its
row's and column's price, and all placed pairs together cost as much as all prices.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.session import written

#: Costs of the pairs of two lists of texts.
TextCost = Callable[[list[str], list[str]], np.ndarray]

#: What a row without a free column costs; such rows stay unplaced.
UNPLACED = 5e5
SCHEMA = "sample_idx long, kind string, gen_idx long, ref_idx long, cost double, score double"
PRICED = "sample_idx long, row_pos long, col_pos long, cost double, price double, column_prices array<struct<pos: long, price: double>>"


def place(first: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """(Column of each row, prices of rows, prices of columns other than 0) of a least-cost placement of a band.

    Row i meets the columns first[i] + k at cost[i, k]; infinite costs are no edges. Every row is placed if it can be; -1 where it cannot.
    """
    n, width = cost.shape
    price, column_price = np.zeros(n), {}
    owner: dict[int, int] = {}
    column = np.full(n, -1, np.int64)
    edges = [[(int(first[i]) + k, float(cost[i, k])) for k in range(width) if np.isfinite(cost[i, k])] for i in range(n)]
    for i in range(n):
        edges[i].append((-1 - i, UNPLACED))  # a column of its own
    for start in range(n):
        best: dict[int, float] = {}
        via: dict[int, int] = {}
        done: list[tuple[int, float]] = []
        closed = set()
        heap: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for j, c in edges[row]:
                if j in closed:
                    continue
                reach = base + max(c - price[row] - column_price.get(j, 0.0), 0.0) if row != start else c - column_price.get(j, 0.0)
                if reach < best.get(j, np.inf):
                    best[j], via[j] = reach, row
                    heapq.heappush(heap, (reach, j))
            while True:
                base, j = heapq.heappop(heap)
                if j not in closed and base == best[j]:
                    break
            if j not in owner:
                break
            closed.add(j)
            done.append((j, base))
            row = owner[j]
        price[start] = base
        for k, reach in done:
            price[owner[k]] += base - reach
            column_price[k] = column_price.get(k, 0.0) - (base - reach)
        while True:  # along the path back to the start
            row = via[j]
            owner[j], column[row], j = row, j, column[row]
            if row == start:
                break
    return np.where(column < 0, -1, column), price, {j: p for j, p in column_price.items() if p and j >= 0}


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a placement of all rows of least total; infinite entries are no edges, an unplaceable row gets -1."""
    return place(np.zeros(len(cost), np.int64), cost)[0]


def band_costs(rows: np.ndarray, gen: list[str], ref: dict[int, str], n: int, left: int, right: int, text_cost: TextCost | None, factor: float, power: float) -> tuple[np.ndarray, np.ndarray]:
    """(Costs, text costs) of rows by window: 1 for a silent column, the text cost for a speaking one, plus the distance cost."""
    reach = max(abs(left), right)
    shift = np.arange(left, right + 1)
    at = rows[:, None] + shift[None, :]
    text = np.ones(at.shape)
    spoken = np.isin(at, np.fromiter(ref, np.int64, len(ref))) if ref else np.zeros(at.shape, bool)
    i, k = np.nonzero(spoken)
    text[i, k] = text_cost([gen[a] for a in i], [ref[int(j)] for j in at[i, k]]) if text_cost and len(i) else 0.0
    distance = np.abs(shift) ** power * (factor / reach**power) if reach else np.zeros(len(shift))
    return np.where((at >= 0) & (at < n), text + distance[None, :], np.inf), text


def match_positions(rows: np.ndarray, gen: list[str], ref: dict[int, str], n: int, left: int, right: int, text_cost: TextCost | None = None, factor: float = 0.3, power: float = 1.5) -> list[tuple]:
    """Rows (kind, gen, ref, cost, score) of one sample of n frames: texts ``gen`` at ``rows``, and ``ref`` by frame."""
    cost, text = band_costs(rows, gen, ref, n, left, right, text_cost, factor, power)
    columns, _, _ = place(rows + left, cost)
    out, taken = [], set()
    for a, (i, j) in enumerate(zip(rows.tolist(), columns.tolist(), strict=True)):
        k = j - i - left
        if j >= 0 and j in ref:
            taken.add(j)
            out.append(("matched", i, j, float(cost[a, k]), 1.0 - float(text[a, k])))
        else:
            out.append(("redundant", i, None, float(cost[a, k]) if j >= 0 else None, None))
    return out + [("missed", None, j, None, None) for j in sorted(ref) if j not in taken]


def match_sample(gen: list[str], ref: list[str], left: int, right: int, text_cost: TextCost | None = None, factor: float = 0.3, power: float = 1.5) -> list[tuple]:
    """As ``match_positions`` of the frames' texts; '' is silence."""
    rows = np.array([i for i, g in enumerate(gen) if g], np.int64)
    return match_positions(rows, [g for g in gen if g], {j: r for j, r in enumerate(ref) if r}, len(ref), left, right, text_cost, factor, power)


def _speaking(frames: DataFrame) -> DataFrame:
    """The frames that speak, with their place and the number of frames of their sample; silent ones do not travel to the solver."""
    by = Window.partitionBy("sample_idx")
    placed = frames.select("sample_idx", "frame_idx", F.coalesce("gen", F.lit("")).alias("gen"), F.coalesce("ref", F.lit("")).alias("ref"))
    placed = placed.withColumn("pos", F.row_number().over(by.orderBy("frame_idx")) - 1).withColumn("n", F.count("*").over(by))
    return placed.where((F.col("gen") != "") | (F.col("ref") != ""))


def _sample(group: pd.DataFrame) -> tuple[np.ndarray, list[str], dict[int, str], int]:
    group = group.sort_values("pos")
    said, told = group[group["gen"] != ""], group[group["ref"] != ""]
    return said["pos"].to_numpy(np.int64), said["gen"].tolist(), dict(zip(told["pos"].tolist(), told["ref"].tolist(), strict=True)), int(group["n"].iloc[0])


def find_matches(frames: DataFrame, left: int, right: int, text_cost: TextCost | None = None, factor: float = 0.3, power: float = 1.5) -> DataFrame:
    """Matches of every sample from frames (sample_idx, frame_idx, gen, ref); one Arrow group of speaking frames for each sample."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        idx = dict(zip(group["pos"].tolist(), group["frame_idx"].tolist(), strict=True))
        rows = match_positions(*_sample(group), left, right, text_cost, factor, power)
        out = [(int(group["sample_idx"].iloc[0]), k, None if i is None else idx[i], None if j is None else idx[j], c, s) for k, i, j, c, s in rows]
        frame = pd.DataFrame(out, columns=["sample_idx", "kind", "gen_idx", "ref_idx", "cost", "score"])
        return frame.astype({"gen_idx": "Int64", "ref_idx": "Int64", "cost": "float64", "score": "float64"})

    return _speaking(frames).groupBy("sample_idx").applyInPandas(run, SCHEMA)


def priced_matches(frames: DataFrame, left: int, right: int, text_cost: TextCost | None = None, factor: float = 0.3, power: float = 1.5) -> DataFrame:
    """(sample_idx, row_pos, col_pos, cost, price, column_prices): the placement of every speaking row and the prices that prove it; a sample's column prices stand at its first row."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, gen, ref, n = _sample(group)
        cost, _ = band_costs(rows, gen, ref, n, left, right, text_cost, factor, power)
        columns, prices, column_prices = place(rows + left, cost)
        listed = [{"pos": j, "price": p} for j, p in sorted(column_prices.items())]
        own = [float(cost[a, j - i - left]) if j >= 0 else UNPLACED for a, (i, j) in enumerate(zip(rows.tolist(), columns.tolist(), strict=True))]
        return pd.DataFrame({"sample_idx": int(group["sample_idx"].iloc[0]), "row_pos": rows, "col_pos": columns, "cost": own, "price": prices, "column_prices": [listed if a == 0 else [] for a in range(len(rows))]})

    return _speaking(frames).groupBy("sample_idx").applyInPandas(run, PRICED)


def proven(frames: DataFrame, left: int, right: int, factor: float = 0.3, power: float = 1.5, slack: float = 1e-6) -> DataFrame:
    """(sample_idx, n_gen, total, optimal) for each sample in which something is generated, with the plain text cost.

    ``optimal`` is checked on the results by joins: no column is taken twice, no pair of the band costs less than its two prices, column prices
    are not above 0, and the placed pairs cost as much as all prices together.
    """
    found = written(priced_matches(frames, left, right, None, factor, power))
    columns = found.select("sample_idx", F.explode("column_prices").alias("c")).select("sample_idx", F.col("c.pos").alias("pos"), F.col("c.price").alias("column_price"))
    spoken = written(_speaking(frames)).select("sample_idx", "pos", "n", (F.col("ref") != "").alias("told"))
    reach = float(max(abs(left), right)) ** power
    pairs = found.join(spoken.groupBy("sample_idx").agg(F.first("n").alias("n")), "sample_idx").withColumn("pos", F.explode(F.sequence(F.greatest(F.col("row_pos") + left, F.lit(0)), F.least(F.col("row_pos") + right, F.col("n") - 1))))
    told = spoken.where("told").select("sample_idx", "pos", F.lit(0.0).alias("text"))
    cost: Column = F.coalesce("text", F.lit(1.0)) + F.pow(F.abs(F.col("row_pos") - F.col("pos")).cast("double"), F.lit(power)) * F.lit(factor / reach)
    over = pairs.join(told, ["sample_idx", "pos"], "left").join(columns, ["sample_idx", "pos"], "left")
    over = over.groupBy("sample_idx").agg(F.max(F.col("price") + F.coalesce("column_price", F.lit(0.0)) - cost).alias("excess"))
    priced = columns.groupBy("sample_idx").agg(F.sum("column_price").alias("low"), F.max("column_price").alias("high"))
    whole = found.groupBy("sample_idx").agg(F.count("*").alias("n_gen"), F.count_distinct("col_pos").alias("n_col"), F.sum("cost").alias("total"), F.sum("price").alias("prices"))
    good = (F.col("n_gen") == F.col("n_col")) & (F.col("excess") < slack) & (F.coalesce("high", F.lit(0.0)) <= 0) & (F.abs(F.col("total") - F.col("prices") - F.coalesce("low", F.lit(0.0))) < slack * F.col("n_gen"))
    return whole.join(over, "sample_idx").join(priced, "sample_idx", "left").select("sample_idx", "n_gen", F.round("total", 6).alias("total"), good.alias("optimal"))
