"""K-means of a whole input over blocks of packets: all runs in one scan, most distances skipped by bounds.

Standardised packets are stored once, as arrays.  A job hands each task the centres
of all runs (R x k x d numbers, whatever the input) and NumPy goes over blocks of
rows; what comes back is one row of sums per run and cluster.

Bounds follow from the triangle inequality.  A bound table has, per packet and run, the nearest
centre, the distance to it and the distance to the second nearest, at some
earlier step.  A later step knows how far each centre has moved since: a packet whose
upper bound stays below its lower bound, or below half the distance from its centre to the next,
keeps its label without a distance.  The table is written anew when too many
packets fail the test, not at every step.

Start centres are drawn one by one with weights of squared distance (``drawn``), or by
oversampling (``oversampled``): a few rounds draw about 2k packets each, all
candidates get the number of packets nearest to them as weight, and the
few weighted candidates are drawn from again.  Draws are exponential races with keys hashed from
seed, run, round and packet number, so any engine can repeat them.

Packets at one place count as one: fewer different packets than centres leave
centres absent (null).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.operators.kmeans import CENTRE_PLACES, COST_PLACES, MOST_STEPS, SAME_POINT, TOLERANCE
from packetweave.storage import materialize

ROUNDS, OVERSAMPLING = 5, 2
# A bound table is written when more than this share of distances had to be computed, at least so many steps after the last.
RECOMPUTED, STEPS_APART = 0.25, 4
# Bounds are compared with this relative slack, so that rounding never hides a tie.
SLACK = 1e-9
# Up to so many centres are measured directly; of more, rows whose products are held at a time, and how many
# roundings per feature may separate these from squared differences.
FEW, SLICE, ROUNDING = 8, 2048, 8

# MD5 over columns of messages: its constants and rotations, and the powers of ten that tell a number's digits.
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_LEFT = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_POWERS = np.array([10**i for i in range(1, 19)], np.int64)

Centres = np.ndarray  # runs x k x d, NaN for absent centres


def points(stored: DataFrame, names: tuple[str, ...], means: list[float], scales: list[float]) -> DataFrame:
    """(packet_number, z) of the stored features, written once."""
    z = [((F.col(f"`{n}`").cast("double") - F.lit(m)) / F.lit(s)) for n, m, s in zip(names, means, scales, strict=True)]
    return materialize(stored.select("packet_number", F.array(*[F.coalesce(c, F.lit(0.0)) for c in z]).alias("z")), "points")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def squares(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, k x n; infinite to absent centres."""
    found = np.stack([((z - c) ** 2).sum(axis=1) for c in centres]) if len(centres) else np.empty((0, len(z)))
    return np.where(np.isnan(found), np.inf, found)


def nearest(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label (lowest on ties) and squared distance, both as by ``squares``.

    One matrix product tells the nearest centre of nearly all rows; those where rounding might decide are measured anew.
    """
    if len(centres) <= FEW:
        found = squares(z, centres)
        return found.argmin(axis=0), found.min(axis=0)
    label, least = np.zeros(len(z), np.int64), np.full(len(z), np.inf)
    there = np.flatnonzero(~np.isnan(centres).any(axis=1))
    if not len(there):
        return label, least
    near = centres[there]
    length, slack = (near**2).sum(axis=1), ROUNDING * (z.shape[1] + 8) * np.finfo(float).eps
    for at in range(0, len(z), SLICE):
        part = z[at : at + SLICE]
        with np.errstate(invalid="ignore", over="ignore"):
            found = part @ near.T
            found *= -2
            found += length
            rows, first = np.arange(len(part)), found.argmin(axis=1)
            limit = found[rows, first] + slack * ((part**2).sum(axis=1) + length.max())
            found[rows, first] = np.inf
            open_ = np.flatnonzero(~(found.min(axis=1) > limit))
            own = there[first]
            gap = ((part - centres[own]) ** 2).sum(axis=1)
        if len(open_):
            exact = squares(part[open_], centres)
            own[open_] = exact.argmin(axis=0)
            gap[open_] = exact.min(axis=0)
        label[at : at + SLICE], least[at : at + SLICE] = own, gap
    return label, least


def nearest_two(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label (lowest on ties), distance, and distance to the second nearest centre."""
    found = squares(z, centres)
    label = found.argmin(axis=0)
    rows = np.arange(len(z))
    least = found[label, rows]
    found[label, rows] = np.inf
    return label.astype(np.int32), np.sqrt(least), np.sqrt(found.min(axis=0))


def relabelled(z: np.ndarray, centres: np.ndarray, base: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels by ``centres`` from bounds that held for ``base``, and how many packets needed their distances."""
    moved = np.nan_to_num(np.sqrt(((centres - base) ** 2).sum(axis=1)))
    most = moved.argmax() if len(moved) else 0
    others = np.where(np.arange(len(moved)) == most, np.delete(moved, most).max(initial=0.0), moved.max(initial=0.0))
    apart = np.sqrt(np.array([np.delete(squares(c[None], centres)[:, 0], i).min(initial=np.inf) for i, c in enumerate(np.nan_to_num(centres))]))
    safe = (upper + moved[label]) * (1 + SLACK) < np.maximum(lower - others[label], apart[label] / 2)
    label = label.copy()
    rest = np.flatnonzero(~safe)
    if len(rest):
        label[rest] = nearest(z[rest], centres)[0]
    return label, len(rest)


@dataclass
class Bounds:
    """Rows with bounds per run, and the centres for which they hold."""

    rows: DataFrame
    base: Centres


@dataclass
class Told:
    """What a fit did: jobs over all packets, distances asked for (packets times runs times steps) and computed."""

    jobs: int = 0
    asked: int = 0
    computed: int = 0
    tables: int = 0
    notes: dict = field(default_factory=dict)


def with_bounds(rows: DataFrame, centres: Centres, told: Told) -> Bounds:
    """A new bound table at these centres."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(0))
            parts = [nearest_two(z, c) for c in centres]
            held = [np.stack([p[i] for p in parts], axis=1) if len(z) else np.empty((0, len(parts))) for i in range(3)]
            kinds = (pa.int32(), pa.float64(), pa.float64())
            offsets = pa.array(np.arange(len(z) + 1) * len(parts), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(h.ravel(), kind)) for h, kind in zip(held, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["z", "label", "upper", "lower"])

    told.tables += 1
    marked = rows.select("z").mapInArrow(mark, "z array<double>, label array<int>, upper array<double>, lower array<double>")
    return Bounds(materialize(marked, "bounds"), centres.copy())


def _sums(rows: DataFrame, runs: list[int], centres: Centres, bounds: Bounds | None, told: Told) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(run, cluster) to count and sums of its packets, in one job whose rows are added up before they come back."""
    d = centres.shape[2]
    names = [f"s{j}" for j in range(d)]
    base = bounds.base if bounds else None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(0))
            held = [_matrix(batch.column(i)) for i in (1, 2, 3)] if base is not None and len(z) else None
            keys, counts, sums, needed = [], [], [], []
            for run in runs if len(z) else ():
                if held is None:
                    label, computed = nearest(z, centres[run])[0], len(z)
                else:
                    label, computed = relabelled(z, centres[run], base[run], held[0][:, run], held[1][:, run], held[2][:, run])
                for i in np.unique(label):
                    own = label == i
                    keys.append((run, int(i)))
                    counts.append(int(own.sum()))
                    sums.append(z[own].sum(axis=0))
                    needed.append(computed)
                    computed = 0
            table = np.array(sums).reshape(len(keys), d)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in keys], pa.int32()) for i in (0, 1)] + [pa.array(counts, pa.int64()), pa.array(needed, pa.int64())]
                + [pa.array(table[:, j]) for j in range(d)], names=["run", "cluster", "n", "computed", *names])

    source = bounds.rows.select("z", "label", "upper", "lower") if bounds else rows.select("z")
    kinds = "run int, cluster int, n bigint, computed bigint, " + ", ".join(f"{n} double" for n in names)
    summed = source.mapInArrow(add, kinds).groupBy("run", "cluster").agg(*(F.sum(c).alias(c) for c in ("n", "computed", *names)))
    found = summed.collect()
    told.jobs += 1
    told.asked += sum(r["n"] for r in found)
    told.computed += sum(r["computed"] for r in found)
    return {(r["run"], r["cluster"]): (r["n"], np.array([r[c] for c in names])) for r in found}


def converged(rows: DataFrame, centres: Centres, told: Told, bounded: bool = True, steps: int = MOST_STEPS) -> Centres:
    """Steps of all runs together until each moves by at most ``TOLERANCE`` in all; a centre without packets stays."""
    centres, moving, bounds, since = centres.copy(), list(range(len(centres))), None, 0
    for _ in range(steps):
        before = told.asked, told.computed
        shift = dict.fromkeys(moving, 0.0)
        for (run, i), (n, total) in _sums(rows, moving, centres, bounds, told).items():
            new = np.array([round(x, CENTRE_PLACES) for x in (total / n).tolist()])
            shift[run] += float(((centres[run, i] - new) ** 2).sum())
            centres[run, i] = new
        moving = [run for run in moving if shift[run] > TOLERANCE]
        if not moving:
            break
        since += 1
        share = (told.computed - before[1]) / max(told.asked - before[0], 1)
        if bounded and since >= STEPS_APART and share > RECOMPUTED:
            bounds, since = with_bounds(rows, centres, told), 0
    return centres


def cheapest(rows: DataFrame, centres: Centres, told: Told) -> int:
    """The run with the smallest summed squared distance, the earlier one on ties."""
    costs = potentials(rows, centres, told)
    return min(range(len(centres)), key=lambda run: (round(costs.get(run, 0.0), COST_PLACES), run))


def potentials(rows: DataFrame, centres: Centres, told: Told) -> dict[int, float]:
    """Summed squared distance to the nearest centre, per run."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(0))
            sums = [float(nearest(z, c)[1].sum()) if len(z) else 0.0 for c in centres]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.float64())], names=["run", "cost"])

    told.jobs += 1
    found = rows.select("z").mapInArrow(add, "run int, cost double").groupBy("run").agg(F.sum("cost").alias("cost"))
    return {r["run"]: r["cost"] for r in found.collect()}


# Start centres.


def _blocks(head: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """Padded messages of ``head`` and numbers of that many digits: 16 words of 32 bits for each."""
    size = len(head) + digits
    block = np.zeros((len(numbers), 64), np.uint8)
    block[:, : len(head)] = np.frombuffer(head, np.uint8)
    rest = numbers.copy()
    for at in range(size - 1, len(head) - 1, -1):
        rest, last = np.divmod(rest, 10)
        block[:, at] = last + ord("0")
    block[:, size] = 0x80
    block[:, 56:58] = (8 * size & 255, 8 * size >> 8)
    return np.ascontiguousarray(block.view("<u4").T)


def _md5_heads(block: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the MD5 of many messages of one block each, as big-endian numbers."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(block.shape[1], x, np.uint32) for x in start)
    for i in range(64):
        turn, (factor, offset) = i // 16, ((1, 0), (5, 1), (3, 5), (7, 0))[i // 16]
        if turn == 0:
            f = c ^ d
            f &= b
            f ^= d
        elif turn == 1:
            f = b ^ c
            f &= d
            f ^= c
        elif turn == 2:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += block[(factor * i + offset) % 16]
        f += _SINES[i]
        left = np.uint32(_LEFT[turn][i % 4])
        low = f >> np.uint32(32 - left)
        f <<= left
        f |= low
        f += b
        a, d, c, b = d, c, b, f
    pair = np.stack([a + start[0], b + start[1]], axis=1).astype("<u4")
    return pair.view(">u8")[:, 0].astype(np.uint64)


def races(seed: int, run: int, label: str, numbers: list[int] | np.ndarray) -> np.ndarray:
    """Exponential numbers of packets: -ln of ``restarts.uniform``."""
    head, numbers = f"{seed}:{run}:{label}:".encode(), np.asarray(numbers, np.int64)
    heads = np.empty(len(numbers), np.uint64)
    digits = np.searchsorted(_POWERS, numbers, side="right") + 1
    digits[(numbers < 0) | (len(head) + digits > 55)] = 0
    for size in np.unique(digits).tolist():
        at = np.flatnonzero(digits == size)
        if size:
            heads[at] = _md5_heads(_blocks(head, numbers[at], size))
        else:
            digests = [hashlib.md5(head + str(n).encode(), usedforsecurity=False).digest()[:8] for n in numbers[at].tolist()]
            heads[at] = np.frombuffer(b"".join(digests), ">u8")
    return -np.log(((heads >> np.uint64(12)).astype(np.float64) + 1.0) / float(1 << 52))


def _raced(batch: pa.RecordBatch, sets: list[np.ndarray], run: int, seed: int, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the packets that may be drawn next to the run's centres, the squared distances of all, and the places of the former."""
    z = _matrix(batch.column(1))
    race = races(seed, run, label, batch.column(0).to_numpy(zero_copy_only=False))
    if not len(sets[run]):
        return race, np.zeros(len(z)), np.arange(len(z))
    gap = nearest(z, sets[run])[1]
    at = np.flatnonzero(gap > SAME_POINT)
    return race[at] / gap[at], gap, at


def _winners(rows: DataFrame, sets: list[np.ndarray], seed: int, label: str, told: Told) -> list[np.ndarray | None]:
    """The drawn packet of each run."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for run in range(len(sets)) if len(batch) else ():
                keys, _, at = _raced(batch, sets, run, seed, label)
                if len(keys):
                    won = int(keys.argmin())
                    found.append((run, float(keys[won]), batch.column(1)[int(at[won])].as_py()))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.list_(pa.float64()))], names=["run", "key", "z"])

    told.jobs += 1
    raced = rows.select("packet_number", "z").mapInArrow(first, "run int, key double, z array<double>")
    won = {r["run"]: r["z"] for r in raced.groupBy("run").agg(F.min_by("z", "key").alias("z")).collect()}
    return [np.array([round(x, CENTRE_PLACES) for x in won[run]]) if run in won else None for run in range(len(sets))]


def drawn(rows: DataFrame, d: int, k: int, runs: int, seed: int, told: Told) -> Centres:
    """``k`` centres per run, drawn one by one: k jobs."""
    sets: list[np.ndarray] = [np.empty((0, d)) for _ in range(runs)]
    for step in range(k):
        for run, z in enumerate(_winners(rows, sets, seed, str(step), told)):
            sets[run] = np.vstack([sets[run], z]) if z is not None else sets[run]
    return np.stack([np.vstack([s, np.full((k - len(s), d), np.nan)]) for s in sets])


def _round(rows: DataFrame, sets: list[np.ndarray], numbers: list[list[int]], seed: int, step: int, limits: list[float], told: Told) -> list[float]:
    """Adds the packets whose key lies below the run's limit, in order of their keys; returns the potentials before that."""

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for run in range(len(sets)) if len(batch) else ():
                keys, gap, at = _raced(batch, sets, run, seed, f"r{step}")
                out.append((run, float(gap.sum()), None))
                for i in np.flatnonzero(keys < limits[run]):
                    out.append((run, None, {"key": float(keys[i]), "number": batch.column(0)[int(at[i])].as_py(), "z": batch.column(1)[int(at[i])].as_py()}))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            entry = pa.struct([("key", pa.float64()), ("number", pa.int64()), ("z", pa.list_(pa.float64()))])
            kinds = (pa.int32(), pa.float64(), entry)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["run", "gap", "entry"])

    told.jobs += 1
    found = rows.select("packet_number", "z").mapInArrow(below, "run int, gap double, entry struct<key:double,number:bigint,z:array<double>>")
    # About OVERSAMPLING * k entries per run are expected, whatever the input.
    told_rows = found.groupBy("run").agg(F.sum("gap").alias("potential"), F.array_sort(F.collect_list("entry")).alias("entries")).collect()
    potentials = [0.0] * len(sets)
    for row in told_rows:
        run = row["run"]
        potentials[run] = row["potential"]
        for entry in row["entries"]:
            sets[run] = np.vstack([sets[run], [round(x, CENTRE_PLACES) for x in entry["z"]]])
            numbers[run].append(entry["number"])
    return potentials


def _weights(rows: DataFrame, sets: list[np.ndarray], told: Told) -> dict[tuple[int, int], int]:
    """(run, candidate) to the number of packets nearest to it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(s), np.int64) for s in sets]
        for batch in batches:
            z = _matrix(batch.column(0))
            for run in range(len(sets)) if len(z) else ():
                totals[run] += np.bincount(nearest(z, sets[run])[0], minlength=len(sets[run]))
        found = [(run, i, int(n)) for run, counts in enumerate(totals) for i, n in enumerate(counts) if n]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["run", "cluster", "n"])

    counted = rows.select("z").mapInArrow(count, "run int, cluster int, n bigint").groupBy("run", "cluster").agg(F.sum("n").alias("n"))
    found = {(r["run"], r["cluster"]): r["n"] for r in counted.collect()}
    told.jobs += 1
    told.asked += sum(found.values())
    told.computed += sum(found.values())
    return found


def weighted_draw(candidates: np.ndarray, weights: np.ndarray, numbers: list[int], k: int, seed: int, run: int) -> np.ndarray:
    """``k`` of a few weighted candidates, one by one, by races with weight times squared distance."""
    chosen, gap = np.full((k, candidates.shape[1]), np.nan), np.ones(len(candidates))
    for step in range(k):
        open_ = [i for i in range(len(candidates)) if weights[i] > 0 and gap[i] > SAME_POINT]
        if not open_:
            break
        race = races(seed, run, f"w{step}", [numbers[i] for i in open_])
        best = min(zip(race / (weights[open_] * gap[open_]), [numbers[i] for i in open_], open_, strict=True))[2]
        chosen[step] = candidates[best]
        new = ((candidates - candidates[best]) ** 2).sum(axis=1)
        gap = new if step == 0 else np.minimum(gap, new)
    return chosen


def oversampled(rows: DataFrame, d: int, k: int, runs: int, seed: int, told: Told, total: int, rounds: int = ROUNDS) -> Centres:
    """``k`` centres per run from some weighted candidates: rounds + 2 jobs, whatever k.

    A round draws with chance ``OVERSAMPLING * k`` times squared distance over the potential.  The potential is that
    before the last round's draws, as the scan that draws is also the one that measures it; the first round takes
    total times d, about that of standardised packets around their mean.
    """
    sets: list[np.ndarray] = [np.empty((0, d)) for _ in range(runs)]
    for run, z in enumerate(_winners(rows, sets, seed, "0", told)):
        sets[run] = np.vstack([sets[run], z]) if z is not None else sets[run]
    # The first candidate has the number 0, which no packet has.
    numbers: list[list[int]] = [[0] * len(s) for s in sets]
    potentials = [float(total * d)] * runs
    for step in range(rounds):
        limits = [OVERSAMPLING * k / p if p > 0 else 0.0 for p in potentials]
        potentials = _round(rows, sets, numbers, seed, step, limits, told)
    counts = _weights(rows, sets, told)
    told.notes["candidates"] = [len(s) for s in sets]
    return np.stack([
        weighted_draw(s, np.array([counts.get((run, i), 0) for i in range(len(s))]), numbers[run], k, seed, run) for run, s in enumerate(sets)])


# Labels.


def labelled(stored: DataFrame, names: tuple[str, ...], means: list[float], scales: list[float], centres: list, distances: bool = False) -> DataFrame:
    """``stored`` with ``cluster_id`` and ``distance`` for any number of centres, or with ``distances`` to each centre."""
    fixed = np.array([c if c is not None else [np.nan] * len(names) for c in centres])
    extra = "distances array<double>" if distances else "cluster_id int, distance double"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(batch.num_columns - 1))
            if distances:
                found = np.sqrt(squares(z, fixed)).T if len(z) else np.empty((0, len(fixed)))
                offsets = pa.array(np.arange(len(z) + 1) * len(fixed), pa.int32())
                new = [pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))]
            else:
                new = [pa.array(x) for x in nearest_two(z, fixed)[:2]] if len(z) else [pa.array([], pa.int32()), pa.array([], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *(["distances"] if distances else ["cluster_id", "distance"])])

    z = F.array(*[F.coalesce((F.col(f"`{n}`").cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)) for n, m, s in zip(names, means, scales, strict=True)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    return stored.withColumn("_z", z).mapInArrow(label, f"{kinds}, {extra}")


def trained(
    stored: DataFrame, names: tuple[str, ...], means: list[float], scales: list[float], total: int, k: int, runs: int, seed: int,
    starts: str = "drawn", bounded: bool = True, steps: int = MOST_STEPS,
) -> tuple[list[list[float] | None], Told]:
    """Centres of the cheapest of ``runs`` runs, and what it took."""
    told, rows = Told(), points(stored, names, means, scales)
    if starts == "oversampled":
        begun = oversampled(rows, len(names), k, runs, seed, told, total)
    else:
        begun = drawn(rows, len(names), k, runs, seed, told)
    ended = converged(rows, begun, told, bounded, steps)
    best = ended[cheapest(rows, ended, told)]
    return [None if np.isnan(c).any() else [float(x) for x in c] for c in best], told
