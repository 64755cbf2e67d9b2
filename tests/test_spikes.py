import math
import random
from datetime import datetime, timedelta
from statistics import median

import numpy as np
import pytest

from brackwater.operators import spikes
from brackwater.shared import table

SCHEMA = "row_id long, subject_id string, device_id string, ts timestamp_ntz, p1 int, p2 int, p3 int, p4 int, p5 int, p6 int, temp double, humid double, kind string, sid int"


def brute(rows):
    """The definition, reading by reading."""
    out = set()
    series = {}
    for r in rows:
        if r["ts"] is not None:
            series.setdefault((r["subject_id"], r["device_id"]), []).append(r)
    for group in series.values():
        for c in spikes.CHANNELS:
            low, high = spikes.LIMITS[c]
            by = {}
            for r in sorted(group, key=lambda r: (r["ts"], r["row_id"])):
                v = r[c]
                if v is None or math.isnan(v):
                    continue
                if not low <= v <= high:
                    out.add((r["row_id"], c, "impossible"))
                else:
                    by.setdefault(r["ts"], []).append((v, r["row_id"]))
            x = [v[0][0] for v in by.values()]
            ids = [[i for y, i in v if y == v[0][0]] for v in by.values()]
            p = c[0] == "p"
            d = [abs(b - a) for a, b in zip(x, x[1:]) if not (p and 0 in (a, b))]
            able = [b != a for a, b in zip(x, x[1:]) if not (p and a == b and a in (0, 4095))]
            limit = max(spikes.FLOOR[c], 12 * 1.4826 * median(d) / math.sqrt(2)) if d else spikes.FLOOR[c]
            bad = set()
            for _ in range(2):
                hits = set()
                for size in (1, 2, 3):
                    for i in range(1, len(x) - size):
                        a = median(([x[k] for k in range(i) if k not in bad] or [math.nan])[-5:])
                        b = median(([x[k] for k in range(i + size, len(x)) if k not in bad] or [math.nan])[:5])
                        if math.isnan(a) or math.isnan(b):
                            continue
                        hi, lo, part = max(a, b), min(a, b), x[i:i + size]
                        near = (x[i - 1], x[i + size])
                        if (min(part) - hi > limit and max(near) - hi <= limit) or (lo - max(part) > limit and lo - min(near) <= limit):
                            hits.update(range(i, i + size))
                bad = hits
            out.update((j, c, "spike") for i in hits for j in ids[i])
            if able and sum(able) > len(able) / 2:
                i = 0
                while i < len(x):
                    k = i
                    while k + 1 < len(x) and x[k + 1] == x[i]:
                        k += 1
                    if k - i + 1 >= 40 and not (p and x[i] in (0, 4095)):
                        out.update((j, c, "stuck") for m in range(i, k + 1) for j in ids[m])
                    i = k + 1
    return out


def made(seed, n=600):
    rng = random.Random(seed)
    rows, t, level = [], datetime(2024, 1, 1, 20), 20.0
    for i in range(n):
        t += timedelta(seconds=rng.choice([5, 5, 6, 400 if i % 90 == 0 else 5]))
        level += 6 if i == 300 else 0
        temp = round(level + rng.gauss(0, 0.1), 2)
        temp += {50: 9, 120: -8, 121: -8, 200: 7, 201: 7, 202: 7, 250: 7, 251: 7, 252: 7, 253: 7, 203 + 5: 9}.get(i, 0)
        temp = 21.0 if 400 <= i < 445 else temp
        temp = {500: -11.0, 510: None, 511: math.nan, 512: math.inf}.get(i, temp)
        p1 = 0 if 100 <= i < 160 else 1_000 + rng.randrange(-8, 9)
        p1 = {30: 2_000, 130: 700, 131: 700, 555: 4_095, 560: -5}.get(i, p1)
        rows.append((i + 1, "u", None, t, p1, 0, None, 4_095, 0, 0, temp, 50.0, "clash", 1))
    rows += [(10_000 + r[0], *r[1:]) for r in rows[45:60] + rows[410:420]] + [(20_000, "u", None, None, 9_999, 0, 0, 0, 0, 0, 99.0, 1.0, "x", 1), (None, *rows[50][1:])]
    return rows


def as_dicts(rows):
    return [dict(zip(("row_id", "subject_id", "device_id", "ts", *spikes.CHANNELS[2:], "temp", "humid"), r[:12], strict=True)) for r in rows]


@pytest.mark.parametrize("settings", [{}, {"shard_s": 600}, {"shard_s": 1_800, "shard_rows": 2}, {"shard_s": 86_400, "shard_rows": 100}])
def test_made_series(spark, settings):
    rows = made(4)
    want = {x for x in brute([r for r in as_dicts(rows) if r["row_id"]]) if x[0]}
    got = [tuple(r) for r in spikes.found(spark.createDataFrame(rows, SCHEMA), **settings).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kinds = {k for _, _, k in want}
    assert kinds == {"impossible", "spike", "stuck"} and (251 not in {i for i, c, k in want if c == "temp" and k == "spike"})


def test_driver_rows_like_brute_force(spark, sf):
    df = table(spark, sf, "sensor_rows")
    rows = [r.asDict() for r in df.collect()]
    got = {tuple(r) for r in spikes.found(df).collect()}
    assert got == brute(rows)


def test_conflicting_copies_at_every_size(spark):
    at = datetime(2024, 1, 1)
    base = [(1_000 + i, "u", "d", at + timedelta(seconds=5 * i), 0, 0, 0, 0, 0, 0, 20.0 + 0.01 * (i % 3), 50.0, "x", 1) for i in range(120)]
    for order in ((20.0, 31.0, 45.0), (31.0, 20.0, 45.0), (45.0, 31.0, 20.0)):
        copies = [(1 + k, *base[60][1:10], order[min(k, 2) if k < 2 else 1 + k % 2], *base[60][11:]) for k in range(60)]
        df = spark.createDataFrame(base[:60] + base[61:] + copies + [(None, *base[30][1:10], 33.0, *base[30][11:])], SCHEMA)
        got = [{tuple(r) for r in spikes.found(df, shard_rows=n).collect()} for n in (2, 10, 20_000)]
        want = {(1 + k, "temp", "spike") for k in range(60) if order[0] != 20.0 and copies[k][10] == order[0]}
        assert got[0] == got[1] == got[2] == want


def test_autoregression_and_its_tests():
    rng = np.random.default_rng(3)
    e = rng.normal(size=4_000)
    for phi in (0.0, 0.5, 0.8):
        x = np.zeros(4_000)
        for i in range(1, 4_000):
            x[i] = phi * x[i - 1] + e[i]
        x[::50] += 40
        assert abs(spikes.autoregression(x) - phi) < 0.1
    x = 0.1 * e[:400]
    x[100:102] += 9
    x[200:] += 7
    out, marked = spikes.outliers(x, np.zeros(400, int), 1.5, np.full(400, 0.1))
    assert out[100] and out[101] and out.sum() < 8 and marked[200] and not out[200]


def test_empty(spark):
    assert spikes.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running_median():
    x = np.random.default_rng(1).normal(size=400)
    p = np.concatenate([x[:1], x[:1], x, x[-1:], x[-1:]])
    assert np.array_equal(spikes.median5(x), np.median(np.lib.stride_tricks.sliding_window_view(p, 5), axis=1))


def close_pair(gap, lead=60):
    return [20.0 + 0.01 * (i % 3) for i in range(lead)] + [30.0] * 3 + [20.0] * gap + [30.0] * 3 + [20.0 + 0.01 * (i % 3) for i in range(60)]


@pytest.mark.parametrize("gap", [1, 2, 3])
def test_close_excursions_do_not_shield_each_other(gap):
    x = np.array(close_pair(gap, 10)[:26 + gap])
    first, size, inner, outer = spikes.excursions(x, np.zeros(len(x), int), 1.5, np.full(len(x), 0.01))
    hit = (inner > 1.5) & (outer <= 1.5)
    assert sorted(zip(first[hit].astype(int), size[hit].astype(int), strict=True)) == [(10, 3), (13 + gap, 3)]


@pytest.mark.parametrize("lead", [20, 58, 60, 62, 95])
def test_close_excursions_across_shards(spark, lead):
    at = datetime(2024, 1, 1)
    rows = [(i + 1, "u", "d", at + timedelta(seconds=5 * i), 0, 0, 0, 0, 0, 0, v, 50.0, "x", 1) for i, v in enumerate(close_pair(2, lead))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(lead + k, "temp", "spike") for k in (1, 2, 3, 6, 7, 8)}
    assert {tuple(r) for r in spikes.found(df, shard_s=300).where("kind = 'spike'").collect()} == want
