"""K-means with several runs for each of few scopes, over stored blocks of packets.

Standardised packets are written once.  A row holds up to ``BLOCK`` packets of one scope, their numbers and their
coordinates (d x n) as bytes, so a scan copies bytes rather than numbers, and a packet is read once whatever the number of
runs.  A job hands each task the centres of all scopes and runs (their number is checked before); each task adds up its
blocks, and one row per scope, run and cluster comes back.

One matrix product per block tells which centres may be nearest; where rounding might decide, packets are
measured anew, feature by feature in the order of ``kmeans.nearest``, so both agree on ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.operators import blocks
from packetweave.operators.bounded import ROUNDING, races
from packetweave.operators.kmeans import CENTRE_PLACES, COST_PLACES, SAME_POINT, TOLERANCE
from packetweave.operators.scaling import ABSENT
from packetweave.storage import scratch_path

BLOCK = 4096
# Readers fill batches up to the end of a row group, so these are kept to some blocks.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "8"}
# Packet numbers that are hashed at a time.
HASHED = 8192

Centres = np.ndarray  # scopes x runs x k x d, ABSENT for absent centres


def points(stored: DataFrame, names: tuple[str, ...], held: list, by: tuple[str, ...]) -> DataFrame:
    """(scope, numbers, z) of the stored features, written once; ``scope`` is the place in ``held``, other packets drop out."""
    d, keys = len(names), len(by)
    scopes = blocks.Scopes([r.asDict() | {"centres": None} for r in held], by, d, 1)
    scales = np.array([r["scales"] for r in held], float).reshape(-1, d)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = scopes.of(batch.columns[:keys], batch.num_rows)
            order = np.argsort(at, kind="stable")
            at, numbers = at[order], batch.column(keys).to_numpy(zero_copy_only=False)[order]
            x = np.stack([c.to_numpy(zero_copy_only=False)[order] for c in batch.columns[keys + 1 :]])
            found = []
            for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
                for first in range(0, len(rows) if len(rows) and at[rows[0]] >= 0 else 0, BLOCK):
                    own, scope = rows[first : first + BLOCK], int(at[rows[0]])
                    z = (x[:, own] - scopes.means[scope][:, None]) / scales[scope][:, None]
                    found.append((scope, numbers[own].tobytes(), z.tobytes()))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["scope", "numbers", "z"])

    kinds = "scope int, numbers binary, z binary"
    path = scratch_path(stored.sparkSession, "points")
    number = F.coalesce("packet_number", F.lit(0)).cast("bigint").alias("packet_number")
    stored.select(*by, number, *blocks.doubles(names)).mapInArrow(cut, kinds).write.options(**ROW_GROUPS).parquet(path)
    return stored.sparkSession.read.schema(kinds).parquet(path)


def _z(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """Scope and coordinates (d x n) of each block."""
    for scope, z in zip(batch.column("scope").to_pylist(), batch.column("z"), strict=True):
        yield scope, np.frombuffer(z.as_buffer(), float).reshape(d, -1)


def squares(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, k x n, summed feature by feature; infinite where they are unknown."""
    found = np.stack([np.square(z - c[:, None]).sum(axis=0) for c in centres])
    return np.where(np.isnan(found), np.inf, found)


def members(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Whether a packet's nearest centre (lowest on ties) in a run is this one: runs x k x n, from centres runs x k x d."""
    runs, k, d = centres.shape
    flat = centres.reshape(-1, d)
    half = np.square(flat).sum(axis=1) / 2
    there = half < ABSENT
    with np.errstate(invalid="ignore", over="ignore"):
        found = flat @ z
        np.subtract(half[:, None], found, out=found)
        found = found.reshape(runs, k, -1)
        slack = ROUNDING * (d + 8) * np.finfo(float).eps * (np.square(z).sum(axis=0) + 2 * half[there].max(initial=0.0))
        own = found <= (found.min(axis=1) + slack)[:, None, :]
    for run, rows in _places(own.sum(axis=1) != 1):
        own[run][:, rows] = squares(z[:, rows], centres[run]).argmin(axis=0) == np.arange(k)[:, None]
    return own


def _places(marked: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows with marks, and where these are."""
    for row in np.flatnonzero(marked.any(axis=1)).tolist():
        yield row, np.flatnonzero(marked[row])


def _drawn(rows: DataFrame, chosen: Centres, seed: int, step: int) -> dict[tuple[int, int], list[float]]:
    """(scope, run) to the packet drawn next to the first ``step`` centres; none where all packets lie at these."""
    d, label = chosen.shape[3], str(step)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
        for batch in batches:
            held = [(scope, np.frombuffer(n.as_buffer(), np.int64), z) for (scope, z), n in zip(_z(batch, d), batch.column("numbers"), strict=True)]
            if not held:
                continue
            numbers = np.concatenate([n for _, n, _ in held])
            ends = np.cumsum([len(n) for _, n, _ in held])
            for run in range(chosen.shape[1]):
                race = np.concatenate([races(seed, run, label, numbers[at : at + HASHED]) for at in range(0, len(numbers), HASHED)])
                for (scope, _, z), keys in zip(held, np.split(race, ends[:-1]), strict=True):
                    at = np.arange(len(keys))
                    if step:
                        gap = np.stack([np.square(z - c[:, None]).sum(axis=0) for c in chosen[scope, run, :step]]).min(axis=0)
                        at = np.flatnonzero(~(gap <= SAME_POINT))
                        keys = np.nan_to_num(keys[at] / gap[at], nan=np.inf, posinf=np.inf)
                    if len(at):
                        won = int(keys.argmin())
                        if (scope, run) not in best or keys[won] < best[scope, run][0]:
                            best[scope, run] = float(keys[won]), z[:, at[won]].copy()
        columns = [[s for s, _ in best], [r for _, r in best], [key for key, _ in best.values()], [z for _, z in best.values()]]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["scope", "run", "key", "z"])

    raced = rows.mapInArrow(first, "scope int, run int, key double, z array<double>")
    won = raced.groupBy("scope", "run").agg(F.min_by("z", "key").alias("z"))
    rounded = F.transform("z", lambda x: F.round(x, CENTRE_PLACES))
    return {(r["scope"], r["run"]): r["z"] for r in won.select("scope", "run", rounded.alias("z")).collect()}


def drawn(rows: DataFrame, scopes: int, d: int, k: int, runs: int, seed: int) -> Centres:
    """``k`` centres per scope and run, drawn one by one: k jobs."""
    chosen = np.full((scopes, runs, k, d), ABSENT)
    for step in range(k):
        for place, z in _drawn(rows, chosen, seed, step).items():
            chosen[place][step] = z
    return chosen


def _means(rows: DataFrame, centres: Centres, moving: dict[int, list[int]]) -> list:
    """Rounded means of the clusters of moving runs (scope to runs), as rows ``scope, run, cluster, centre``."""
    _, _, k, d = centres.shape
    names = [f"s{j}" for j in range(d)]
    held = {scope: (runs, centres[scope][runs]) for scope, runs in moving.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for scope, z in _z(batch, d):
                if scope not in held:
                    continue
                own = members(z, held[scope][1]).reshape(-1, z.shape[1]).astype(float)
                found = np.column_stack([own.sum(axis=1), own @ z.T])
                totals[scope] = totals[scope] + found if scope in totals else found
        keys, sums = [], []
        for scope, found in totals.items():
            for at in np.flatnonzero(found[:, 0]).tolist():
                keys.append((scope, held[scope][0][at // k], at % k))
                sums.append(found[at])
        table = np.array(sums).reshape(len(keys), d + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in keys], pa.int32()) for i in range(3)] + [pa.array(table[:, j]) for j in range(d + 1)],
            names=["scope", "run", "cluster", "n", *names])

    if len(moving) < len(centres):
        rows = rows.filter(f"scope in ({', '.join(map(str, moving))})")
    summed = rows.select("scope", "z").mapInArrow(add, "scope int, run int, cluster int, n double, " + ", ".join(f"{s} double" for s in names))
    total = F.sum("n")
    return summed.groupBy("scope", "run", "cluster").agg(F.array(*[F.round(F.sum(s) / total, CENTRE_PLACES) for s in names]).alias("centre")).collect()


def converged(rows: DataFrame, centres: Centres, steps: int) -> Centres:
    """Steps of all runs together until each moves by at most ``TOLERANCE`` in all; a centre without packets stays."""
    centres = centres.copy()
    moving = {scope: list(range(centres.shape[1])) for scope in range(len(centres))}
    for _ in range(steps):
        shift: dict[tuple[int, int], float] = {}
        for found in _means(rows, centres, moving):
            place, new = (found["scope"], found["run"]), np.array(found["centre"], float)
            shift[place] = shift.get(place, 0.0) + float(np.square(centres[place][found["cluster"]] - new).sum())
            centres[place][found["cluster"]] = new
        moving = {}
        for scope, run in sorted(place for place, moved in shift.items() if moved > TOLERANCE):
            moving.setdefault(scope, []).append(run)
        if not moving:
            break
    return centres


def costs(rows: DataFrame, centres: Centres) -> dict[tuple[int, int], float]:
    """Summed squared distance to the nearest centre per scope and run, rounded."""
    d = centres.shape[3]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], float] = {}
        for batch in batches:
            for scope, z in _z(batch, d):
                for run, own in enumerate(centres[scope]):
                    totals[scope, run] = totals.get((scope, run), 0.0) + float(squares(z, own).min(axis=0).sum())
        columns = [[s for s, _ in totals], [r for _, r in totals], list(totals.values())]
        kinds = (pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["scope", "run", "cost"])

    summed = rows.select("scope", "z").mapInArrow(add, "scope int, run int, cost double").groupBy("scope", "run")
    return {(r["scope"], r["run"]): r["cost"] for r in summed.agg(F.round(F.sum("cost"), COST_PLACES).alias("cost")).collect()}


def trained(
    stored: DataFrame, names: tuple[str, ...], held: list, by: tuple[str, ...], k: int, runs: int, seed: int, steps: int,
) -> list[tuple]:
    """Keys, means, scales and the centres of the cheapest run, the earlier one on ties, of each scope.

    ``held`` has keys, means and scales; scopes with null keys match nothing, as in a join.
    """
    held = [r for r in held if all(r[c] is not None for c in by)]
    if not held:
        return []
    rows = points(stored, names, held, by)
    ended = converged(rows, drawn(rows, len(held), len(names), k, runs, seed), steps)
    cost, best = costs(rows, ended), []
    for scope, row in enumerate(held):
        if (scope, 0) not in cost:
            continue
        # Unknown costs (of values that are no numbers) come last.
        at = min(range(runs), key=lambda run: (np.nan_to_num(cost[scope, run], nan=np.inf, posinf=np.inf), run))
        centres = [None if (c == ABSENT).all() else c.tolist() for c in ended[scope, at]]
        best.append((*(row[c] for c in by), row["means"], row["scales"], centres))
    return best
