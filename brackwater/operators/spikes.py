"""Implausible spikes in measurements: impossible readings, spikes and stuck runs, judged per series and channel.

Method: to every stretch of a channel a robust autoregression of order one is fitted (the coefficient from the signs of
neighbours about the median, so that outliers cannot move it; near one it counts as a unit root).  Its residuals are
tested at every reading for an additive outlier of one to three readings and for a level shift; the strongest effects are
taken out of the series and the residuals are formed and tested again until nothing stands out.  An exact check follows
where a test stood out: levels before and after are medians of five readings without the outliers, the usual scatter is
the robust scale of the first differences of the whole series (1.4826 MAD / sqrt 2), and an excursion counts if it departs
to one side from both levels.  Stuck runs and physical limits are judged apart.

Execution: one shuffle brings each (series, shard) together in time order; numpy works on whole buffers of complete
shards, never per reading.  A shard is a stretch of time; where that holds too many rows it is cut further, at whole
minutes, by counts taken beforehand, and rows sent again there are collapsed to one row with map-side aggregation, so that
neither a fast source nor a reading sent a million times fills one task.  A shard yields its findings that need no
neighbour, a histogram of differences, and its outermost readings.  These summaries are put together per series: the
histograms give the scatter of the whole series, the outermost readings are judged across shard borders.  Findings on
collapsed rows go back to all their copies by an equi-join on series and time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.shared import DAY_S, epoch_us, floor_div, written

NO_ID = -(1 << 63)  # stands for a missing row_id, which comes before all others

CHANNELS = ["temp", "humid", "p1", "p2", "p3", "p4", "p5", "p6"]
# Physical limits and least departures of a spike, by channel.
LIMITS = {"temp": (-10.0, 60.0), "humid": (0.0, 100.0), **{f"p{i}": (0.0, 4095.0) for i in range(1, 7)}}
FLOOR = {"temp": 1.5, "humid": 3.0, **{f"p{i}": 30.0 for i in range(1, 7)}}
FACTOR, LONGEST, STUCK, USUAL_CHANGE = 12.0, 3, 40, 0.5
SHARD_S = 4 * DAY_S
SHARD_ROWS, MOST_PARTS = 500_000, 128  # rows of a shard before it is cut, parts of it at most
CRITICAL, ROUNDS, HORIZON, UNIT_ROOT = 3.5, 8, 4, 0.95  # of the tests on residuals; readings by which a level shift is told
EDGE, KEEP = 40, 112  # readings of a shard's ends that are judged across borders; readings kept there for that
BUFFER_ROWS = 150_000
_OCTAVE, _LOW, _BINS = 16, -8, 16 * 22  # histogram of |difference|: 16 bins an octave from 2^-8 to 2^14


def median5(x: np.ndarray) -> np.ndarray:
    """Running median of five, by a fixed network of minima and maxima; the ends repeat."""
    p = np.concatenate([x[:1], x[:1], x, x[-1:], x[-1:]])
    n = len(x)
    a, b, c, d, e = (p[i:i + n] for i in range(5))
    a, b = np.minimum(a, b), np.maximum(a, b)
    d, e = np.minimum(d, e), np.maximum(d, e)
    a, d = np.minimum(a, d), np.maximum(a, d)  # the least of four is out: a
    b, e = np.minimum(b, e), np.maximum(b, e)  # the greatest of four is out: e
    return np.maximum(np.minimum(b, d), np.minimum(np.maximum(b, d), c))


def _sides(x: np.ndarray, seg: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level before and after each reading: the median of up to five readings that are not `bad`, of its own segment."""
    n = len(x)
    good = np.flatnonzero(~bad)
    y, s = x[good], seg[good]
    before, after = np.full(n, np.nan), np.full(n, np.nan)
    if not len(good):
        return before, after
    m = median5(y)
    left = np.searchsorted(good, np.arange(n), "left")   # good readings before i
    right = np.searchsorted(good, np.arange(n), "right")  # first good reading after i
    lo, hi = left - 5, right + 4
    ok = lo >= 0
    ok[ok] = s[lo[ok]] == seg[ok]
    before[ok] = m[left[ok] - 3]
    for i in np.flatnonzero(~ok & (left > 0)):
        w = y[max(0, left[i] - 5):left[i]][s[max(0, left[i] - 5):left[i]] == seg[i]]
        if len(w):
            before[i] = np.median(w)
    ok = hi < len(y)
    ok[ok] = s[hi[ok]] == seg[ok]
    after[ok] = m[right[ok] + 2]
    for i in np.flatnonzero(~ok & (right < len(y))):
        w = y[right[i]:right[i] + 5][s[right[i]:right[i] + 5] == seg[i]]
        if len(w):
            after[i] = np.median(w)
    return before, after


def autoregression(x: np.ndarray) -> float:
    """Robust coefficient of order one: the sine law on how often neighbours lie on the same side of the median."""
    side = np.sign(x - np.median(x)) if len(x) else x
    both = side[1:] * side[:-1]
    both = both[both != 0]
    if len(both) < 20:
        return 1.0
    phi = float(np.sin(np.pi / 2 * both.mean()))
    return 1.0 if phi > UNIT_ROOT else max(phi, -UNIT_ROOT)


def residual_tests(e: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per reading and effect (outlier of 1, 2, 3 readings, level shift): its size and its weight against the residuals' scale."""
    n, c = len(e), 1 - phi
    pad = np.concatenate([e, np.zeros(HORIZON + 1)])
    later = [pad[k:k + n] for k in range(HORIZON + 1)]
    size, weight = np.empty((LONGEST + 1, n)), np.empty((LONGEST + 1, n))
    inner = np.zeros(n)
    for k in range(1, LONGEST + 1):  # an outlier of k readings: enters at once, then by 1 - phi, leaves by -phi
        norm = 1 + (k - 1) * c * c + phi * phi
        size[k - 1] = (e + c * inner - phi * later[k]) / norm
        weight[k - 1] = np.sqrt(norm)
        inner = inner + later[k]
    norm = 1 + HORIZON * c * c
    size[LONGEST] = (e + c * (inner + later[HORIZON])) / norm
    weight[LONGEST] = np.sqrt(norm)
    return size, weight


def outliers(x: np.ndarray, seg: np.ndarray, floor: float, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Readings in additive outliers, and readings at which any effect stands out of the residuals of the autoregression."""
    n = len(x)
    cut = np.flatnonzero(np.r_[True, np.diff(seg) != 0])
    stop = np.r_[cut[1:], n]
    last = np.repeat(stop, stop - cut)
    middle, phi = np.empty(n), np.empty(n)
    for a, b in zip(cut, stop, strict=True):
        middle[a:b], phi[a:b] = np.median(x[a:b]), autoregression(x[a:b])
    z = x - middle
    head = np.zeros(n, bool)
    head[cut] = True
    scale = np.zeros(n)
    out, marked, done = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    for turn in range(ROUNDS):
        e = np.r_[0.0, z[1:] - phi[1:] * z[:-1]]
        e[head] = 0.0
        if not turn:
            for a, b in zip(cut, stop, strict=True):
                scale[a:b] = 1.4826 * np.median(np.abs(e[a:b]))
            scale = np.maximum(np.minimum(scale, 2 * guess), floor / FACTOR)
        at = np.flatnonzero((np.abs(e) > scale) & ~done)  # no effect starts where the residual itself is small
        if not len(at):
            break
        size, weight = residual_tests(e, phi)
        ratio = np.abs(size[:, at]) * weight[:, at] / scale[at]
        kind, top = ratio.argmax(0), ratio.max(0)
        strong = top > CRITICAL
        at, kind, top = at[strong], kind[strong], top[strong]
        if not len(at):
            break
        taken = np.zeros(n + LONGEST + 2, bool)
        shift = np.zeros(n)
        for j in np.lexsort((at, -top)):
            i, k = int(at[j]), int(kind[j]) + 1
            level = k > LONGEST
            end = i + 1 if level else min(i + k, int(last[i]))
            if taken[i:end + 1].any():
                continue
            taken[i:end + 1] = True
            done[i] = marked[i] = True
            if level:
                shift[i] = size[LONGEST, i]
            else:
                out[i:end] = marked[i:end] = True
                z[i:end] = z[i - 1]
        if shift.any():
            total = np.cumsum(shift)
            z = z - (total - np.repeat(total[cut] - shift[cut], stop - cut))
    return out, marked


def excursions(x: np.ndarray, seg: np.ndarray, floor: float, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, inner, outer) of every excursion of at most LONGEST readings that departs by more than `floor`.

    inner is the least departure of its readings from both levels, outer the greatest departure of the two readings next
    to it to the same side: the excursion counts at every threshold between outer and inner.  guess: a scatter for each
    reading, used only to leave likely outliers out of the levels.
    """
    n = len(x)
    out: list[tuple[np.ndarray, ...]] = []
    if n < 3:
        return tuple(np.zeros(0) for _ in range(4))  # type: ignore[return-value]
    bad, marked = outliers(x, seg, floor, guess)
    if not marked.any():
        return tuple(np.zeros(0) for _ in range(4))  # type: ignore[return-value]
    reach = np.cumsum(np.r_[0, marked])  # an excursion is looked at if a test stood out in it or beside it
    for _ in range(ROUNDS):
        before, after = _sides(x, seg, bad)
        out = []
        for size in range(1, LONGEST + 1):
            i = np.arange(1, n - size)
            i = i[reach[np.minimum(i + size + 1, n)] > reach[i - 1]]
            if not len(i):
                continue
            b, a = before[i], after[i + size - 1]
            high, low = np.fmax(a, b), np.fmin(a, b)
            least = np.minimum.reduce([x[i + k] for k in range(size)])
            most = np.maximum.reduce([x[i + k] for k in range(size)])
            up, down = least - high, low - most
            inner = np.maximum(up, down)
            hit = (inner > floor) & ~np.isnan(a) & ~np.isnan(b) & (seg[i - 1] == seg[i + size])
            i, up, down, inner, high, low = i[hit], up[hit], down[hit], inner[hit], high[hit], low[hit]
            near, far = x[i - 1], x[i + size]
            outer = np.where(up > down, np.maximum(near, far) - high, low - np.minimum(near, far))
            keep = inner > np.maximum(outer, floor)
            out.append((i[keep], np.full(keep.sum(), size), inner[keep], outer[keep]))
        left_out = np.zeros(n, bool)
        for first, length, inner, outer in out:
            limit = np.maximum(floor, FACTOR * guess[first]) if len(first) else first
            sure = (inner > limit) & (outer <= limit)
            left_out[_spread(first[sure], length[sure])] = True
        if (left_out == bad).all():
            break
        bad = left_out
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(4))  # type: ignore[return-value]


def histogram(x: np.ndarray, seg: np.ndarray, channel: str) -> tuple[np.ndarray, int, int]:
    """Counts of |difference| by bin (bin 0: no difference), pairs that could change, pairs that changed."""
    if len(x) < 2:
        return np.zeros(_BINS + 1, np.int64), 0, 0
    pair = seg[1:] == seg[:-1]
    d = np.abs(np.diff(x))
    pressure = channel[0] == "p"
    loaded = pair & (x[1:] != 0) & (x[:-1] != 0) if pressure else pair
    v = d[loaded]
    bins = np.zeros(len(v), np.int64)
    some = v > 0
    bins[some] = np.clip(np.floor((np.log2(v[some]) - _LOW) * _OCTAVE), 0, _BINS - 1) + 1
    able = pair & ~((d == 0) & ((x[1:] == 0) | (x[1:] == 4095))) if pressure else pair
    return np.bincount(bins, minlength=_BINS + 1), int(able.sum()), int((d[able] > 0).sum())


def scatter_of(counts: np.ndarray) -> float:
    """Robust scale of the noise from the counts: the median |difference|, read at the middle of its bin."""
    total = counts.sum()
    if not total:
        return 0.0
    k = int(np.searchsorted(np.cumsum(counts), (total + 1) // 2))
    return 0.0 if k == 0 else 1.4826 / np.sqrt(2) * 2.0 ** ((k - 0.5) / _OCTAVE + _LOW)


def runs(x: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First reading and length of every run of equal readings."""
    first = np.flatnonzero(np.r_[True, (np.diff(x) != 0) | (np.diff(seg) != 0)]) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(x)])


def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the given runs, in one array."""
    length = length.astype(np.int64)
    if not len(first):
        return np.zeros(0, np.int64)
    start = np.repeat(first.astype(np.int64) - np.r_[0, np.cumsum(length)[:-1]], length)
    return start + np.arange(length.sum())


_FINDINGS = pa.schema([("sid", pa.int64()), ("sid2", pa.int32()), ("shard", pa.int64()), ("row_id", pa.int64()), ("many", pa.bool_()), ("us", pa.int64()), ("value", pa.float64()),
                       ("channel", pa.int8()), ("kind", pa.string()), ("inner", pa.float64()), ("outer", pa.float64()), ("summary", pa.binary())])
FINDINGS = "sid bigint, sid2 int, shard bigint, row_id bigint, many boolean, us bigint, value double, channel tinyint, kind string, `inner` double, `outer` double, summary binary"


def _judge_buffer(t: pa.Table) -> pa.RecordBatch:
    sid, sid2, shard, us = (t[c].to_numpy() for c in ("sid", "sid2", "shard", "us"))
    rid = t["row_id"].to_numpy()
    many = np.asarray(t["many"])
    n = len(us)
    new = np.r_[True, (np.diff(sid) != 0) | (np.diff(sid2) != 0) | (np.diff(shard) != 0)]
    seg = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    moment = np.cumsum(np.r_[True, new[1:] | (np.diff(us) != 0)]) - 1
    found: list[tuple[np.ndarray, int, str, np.ndarray, np.ndarray]] = []
    ends: list[dict] = [{} for _ in heads]
    for c, name in enumerate(CHANNELS):
        v = t[name].cast(pa.float64()).fill_null(np.nan).to_numpy()
        low, high = LIMITS[name]
        impossible = (v < low) | (v > high)
        if impossible.any():
            at = np.flatnonzero(impossible)
            found.append((at, c, "impossible", np.zeros(len(at)), np.zeros(len(at))))
        rows = np.flatnonzero(~np.isnan(v) & ~impossible)
        if not len(rows):
            continue
        first = np.r_[True, np.diff(moment[rows]) != 0]
        rep = rows[first]  # the reading of a time: the first row that has one
        x, s = v[rep], seg[rep]
        judged = np.full(moment[-1] + 1, np.nan)
        judged[moment[rep]] = x
        group_first = np.searchsorted(moment[rows], moment[rep], "left")
        group_last = np.searchsorted(moment[rows], moment[rep], "right")

        def copies(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # rows of these readings, and which reading each is
            size = group_last[at] - group_first[at]  # noqa: B023
            all_rows = rows[_spread(group_first[at], size)]  # noqa: B023
            which = np.repeat(np.arange(len(at)), size)
            same = v[all_rows] == judged[moment[all_rows]]  # noqa: B023
            return all_rows[same], which[same]

        cut = np.flatnonzero(np.r_[True, np.diff(s) != 0])
        stop = np.r_[cut[1:], len(x)]
        position = np.arange(len(x)) - np.repeat(cut, stop - cut)
        inside = (position >= EDGE) & (np.repeat(stop - cut, stop - cut) - position > EDGE)
        hists = []
        for a, b in zip(cut, stop, strict=True):
            counts, able, changed = histogram(x[a:b], s[a:b], name)
            hists.append((s[a], counts, able, changed))
        guess = np.repeat([scatter_of(h[1]) for h in hists], stop - cut)
        e_first, e_size, inner, outer = excursions(x, s, FLOOR[name], guess)
        if len(e_first):
            e_first = e_first.astype(np.int64)
            ok = inside[e_first] & inside[e_first + e_size.astype(np.int64) - 1]
            at = _spread(e_first[ok], e_size[ok])
            all_rows, which = copies(at)
            per = np.repeat(np.arange(ok.sum()), e_size[ok].astype(np.int64))[which]
            found.append((all_rows, c, "spike", inner[ok][per], outer[ok][per]))
        r_first, r_size = runs(x, s)
        long = r_size >= STUCK
        if name[0] == "p":
            long &= (x[r_first] != 0) & (x[r_first] != 4095)
        if long.any():
            all_rows, _ = copies(_spread(r_first[long], r_size[long]))
            found.append((all_rows, c, "stuck", np.zeros(len(all_rows)), np.zeros(len(all_rows))))
        for (k, counts, able, changed), a, b in zip(hists, cut, stop, strict=True):
            at = np.r_[a:b] if b - a <= 2 * KEEP else np.r_[a:a + KEEP, b - KEEP:b]
            all_rows, which = copies(at)
            hit = np.flatnonzero(counts)
            ends[k][c] = (hit.astype(np.int16), counts[hit], able, changed, int(b - a), x[at], us[rep[at]], rid[all_rows], many[all_rows], which.astype(np.int32))
    at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    m = len(heads)
    value = np.full(len(at), np.nan)
    channel = np.concatenate([np.full(len(f[0]), f[1], np.int8) for f in found]) if found else np.zeros(0, np.int8)
    for c, name in enumerate(CHANNELS):
        mine = channel == c
        if mine.any():
            value[mine] = t[name].cast(pa.float64()).fill_null(np.nan).to_numpy()[at[mine]]
    kind = np.concatenate([np.full(len(f[0]), f[2], object) for f in found]) if found else np.zeros(0, object)
    both = np.concatenate([at, heads])
    pad = lambda a, fill: np.concatenate([a, np.full(m, fill)])
    columns = [
        pa.array(sid[both]), pa.array(sid2[both]), pa.array(shard[both]), pa.array(rid[both]), pa.array(many[both]), pa.array(us[both]),
        pa.array(pad(value, np.nan)), pa.array(pad(channel, -1).astype(np.int8)), pa.array(list(kind) + ["summary"] * m, pa.string()),
        pa.array(np.concatenate([*[f[3] for f in found], np.zeros(m)])), pa.array(np.concatenate([*[f[4] for f in found], np.zeros(m)])),
        pa.array([None] * len(at) + [pickle.dumps(e, 5) for e in ends], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_FINDINGS)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shards only: rows are sorted by shard, the last shard of a buffer waits for the next batch."""
    held: list[pa.RecordBatch] = []
    rows = 0
    before: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(i).to_numpy() for i in range(3)]
        if rows >= BUFFER_ROWS:
            fresh = np.r_[tuple(k[0] for k in key) != before, (np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0)]
            change = np.flatnonzero(fresh)
            if len(change):
                at = int(change[-1])
                yield _judge_buffer(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held, rows, batch = [], 0, batch.slice(at)
        held.append(batch)
        rows += batch.num_rows
        before = tuple(k[-1] for k in key)
    if rows:
        yield _judge_buffer(pa.Table.from_batches(held))


_DECIDED = "sid bigint, sid2 int, channel tinyint, scatter double, lively boolean, row_id bigint, many boolean, us bigint, value double, kind string"


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one series, from its shard summaries: scatter and liveliness of each channel, and what lies across borders."""
    pdf = pdf.sort_values("shard")
    ends = [pickle.loads(b) for b in pdf["summary"]]
    sid, sid2 = pdf["sid"].iloc[0], pdf["sid2"].iloc[0]
    out = []
    for c, name in enumerate(CHANNELS):
        parts = [e[c] for e in ends if c in e]
        if not parts:
            continue
        counts = np.zeros(_BINS + 1, np.int64)
        for p in parts:
            counts[p[0]] += p[1]
        scatter = scatter_of(counts)
        able, changed = sum(p[2] for p in parts), sum(p[3] for p in parts)
        lively = able > 0 and changed > USUAL_CHANGE * able
        out.append((sid, sid2, c, scatter, lively, None, None, None, None, None))
        x, us = np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts])
        # A shard of more readings than it keeps has a hole in the middle: there a new segment starts.
        piece, judged, base, part_base = [], [], 0, []
        for p in parts:
            size = len(p[5])
            part_base.append(base)
            hole = p[4] > size
            i = np.arange(size)
            piece.append((i >= KEEP).astype(int) if hole else np.zeros(size, int))
            place = np.where(i < KEEP, i, p[4] - (size - i)) if hole else i
            judged.append((place < EDGE) | (p[4] - place <= EDGE))
            base += size
        flat = np.concatenate(piece)
        seg = np.cumsum(np.r_[0, np.diff(flat) > 0])
        edge = np.concatenate(judged)
        theta = max(FLOOR[name], FACTOR * scatter)
        first, size, inner, outer = excursions(x, seg, FLOOR[name], np.full(len(x), scatter))
        hit = (inner > theta) & (outer <= theta)
        spots = {"spike": _spread(first[hit], size[hit])}
        # An excursion is judged here if any of its readings lies at an end of its shard.
        if len(first):
            near = [bool(edge[int(a):int(a + b)].any()) for a, b in zip(first[hit], size[hit], strict=True)]
            spots["spike"] = _spread(first[hit][near], size[hit][near])
        if lively:
            f, s = runs(x, seg)
            long = s >= STUCK
            if name[0] == "p":
                long &= (x[f] != 0) & (x[f] != 4095)
            spots["stuck"] = _spread(f[long], s[long])
        for kind, at in spots.items():
            if not len(at):
                continue
            wanted = np.zeros(len(x), bool)
            wanted[at] = True
            for p, start in zip(parts, part_base, strict=True):
                rows = np.flatnonzero(wanted[start + p[9]]) if len(p[9]) else []
                for r in rows:
                    i = start + p[9][r]
                    out.append((sid, sid2, c, scatter, lively, int(p[7][r]), bool(p[8][r]), int(us[i]), float(x[i]), kind))
    frame = pd.DataFrame(out, columns=["sid", "sid2", "channel", "scatter", "lively", "row_id", "many", "us", "value", "kind"])
    return frame.astype({"row_id": "Int64", "many": "boolean", "us": "Int64", "value": "float64", "scatter": "float64"})


def _sharded(keyed: DataFrame, shard_s: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with `shard` and `many`, the rows of dense shards): shards of shard_s, cut where they hold over shard_rows rows.

    `many` marks a row that stands for several equal ones; its row_id is the smallest of theirs.
    """
    slot = ["sid", "sid2", "slot"]
    keyed = keyed.withColumn("slot", floor_div(F.col("us"), shard_s * 1_000_000))
    dense = keyed.groupBy(*slot).agg(F.count("*").alias("_rows")).where(F.col("_rows") > shard_rows)
    dense = written(dense.select(*[F.col(k).alias(f"_{k}") for k in slot], "_rows"), "spike-shards")  # small: its size is known to the planner
    meets = (F.col("sid") == F.col("_sid")) & (F.col("sid2") == F.col("_sid2")) & (F.col("slot") == F.col("_slot"))
    crowded = keyed.join(dense, meets).withColumn("_minute", floor_div(F.col("us"), 60_000_000))
    minutes = crowded.groupBy(*slot, "_rows", "_minute").agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy(*slot).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1))
    part = F.floor(F.coalesce(so_far, F.lit(0)) / F.greatest(F.lit(shard_rows), F.col("_rows") / MOST_PARTS))
    minutes = minutes.withColumn("_part", part).withColumn("shard", F.min("_minute").over(Window.partitionBy(*slot, "_part")) * 60_000_000)
    minutes = minutes.select(F.col("sid").alias("_s"), F.col("sid2").alias("_s2"), F.col("_minute").alias("_m"), "shard")
    placed = crowded.join(minutes, (F.col("sid") == F.col("_s")) & (F.col("sid2") == F.col("_s2")) & (F.col("_minute") == F.col("_m")))
    once = (placed.groupBy("sid", "sid2", "shard", "us", *CHANNELS).agg(F.min("row_id").alias("row_id"), F.count("*").alias("_n"))
            .select("sid", "sid2", "shard", "us", "row_id", (F.col("_n") > 1).alias("many"), *CHANNELS))
    plain = keyed.join(dense, meets, "left_anti").select("sid", "sid2", (F.col("slot") * (shard_s * 1_000_000)).alias("shard"), "us", "row_id", F.lit(False).alias("many"), *CHANNELS)
    return plain.unionByName(once), crowded


def found(sensor: DataFrame, shard_s: int = SHARD_S, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(row_id, channel, kind) of every flagged reading.

    Defined cases: rows without ts are no cases; NaN counts as no reading, infinities as impossible; of rows with the same
    series and ts the reading is that of the smallest row_id that has one, and every row with that value is flagged with
    it; null series keys are series of their own; rows without row_id count as readings, before all others of their time,
    but can be no cases; a series whose usual scatter is 0 is judged by the least departures alone.
    """
    keyed = sensor.where(F.col("ts").isNotNull()).select(
        F.xxhash64("subject_id", F.col("subject_id").isNull(), "device_id", F.col("device_id").isNull()).alias("sid"),
        F.hash("device_id", F.col("device_id").isNull(), "subject_id", F.col("subject_id").isNull()).alias("sid2"),
        epoch_us(F.col("ts")).alias("us"), F.coalesce(F.col("row_id").cast("long"), F.lit(NO_ID)).alias("row_id"), *CHANNELS)
    rows, crowded = _sharded(keyed, shard_s, shard_rows)
    shards = rows.repartition("sid", "sid2", "shard").sortWithinPartitions("sid", "sid2", "shard", "us", "row_id")
    raw = written(shards.select("sid", "sid2", "shard", "us", "row_id", "many", *CHANNELS).mapInArrow(_judge, FINDINGS), "spikes")
    decided = raw.where("kind = 'summary'").select("sid", "sid2", "shard", "summary").groupBy("sid", "sid2").applyInPandas(_across, _DECIDED)
    decided = written(decided, "spike-levels")
    scale = decided.where("kind is null").select(F.col("sid").alias("_s"), F.col("sid2").alias("_s2"), F.col("channel").alias("_c"), "scatter", "lively")
    floor = F.element_at(F.array(*[F.lit(FLOOR[c]) for c in CHANNELS]), F.col("channel") + 1)
    candidates = raw.where("kind in ('spike', 'stuck')").drop("summary")
    limit = F.greatest(floor, FACTOR * F.col("scatter"))
    held = (candidates.join(scale, (F.col("sid") == F.col("_s")) & (F.col("sid2") == F.col("_s2")) & (F.col("channel") == F.col("_c")))
            .where(F.when(F.col("kind") == "stuck", F.col("lively")).otherwise((F.col("inner") > limit) & (F.col("outer") <= limit))))
    columns = ["sid", "sid2", "us", "row_id", "many", "value", "channel", "kind"]
    flags = (raw.where("kind = 'impossible'").select(*columns).unionByName(held.select(*columns))
             .unionByName(decided.where("kind is not null").select(*columns)))
    marked = flags.where("many").select(F.col("sid").alias("_s"), F.col("sid2").alias("_s2"), F.col("us").alias("_u"), F.col("value").alias("_v"), "channel", "kind").distinct()
    copies = crowded.join(marked, (F.col("sid") == F.col("_s")) & (F.col("sid2") == F.col("_s2")) & (F.col("us") == F.col("_u")))
    value = F.element_at(F.array(*[F.col(c).cast("double") for c in CHANNELS]), F.col("channel") + 1)
    every = flags.where("not many").select("row_id", "channel", "kind").unionByName(copies.where(value == F.col("_v")).select("row_id", "channel", "kind"))
    name = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel") + 1)
    return every.where(F.col("row_id") != NO_ID).select("row_id", name.alias("channel"), "kind").distinct()
