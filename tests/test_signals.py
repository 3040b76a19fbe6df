"""Signals as rows come: each row against the whole past afresh, and a stream against a table."""

from __future__ import annotations

import random

import pytest

from tidemark.operators.extrema import Limits, prune, turning_marks
from tidemark.operators.order import Order
from tidemark.operators.signals import Called, Caller, Rules, call, call_stream

ORDER = Order("g", "t")
RULES = [
    Rules(Limits(2)), Rules(Limits(2), start=4, window=9), Rules(Limits(3, min_val=2.0), start=3), Rules(Limits(1), start=2),
    Rules(Limits(2), Called(pct=(0.05, 9), other_gap=1), Called(dif=(0.5, 50), pct=None, other_dif=1.0), start=5),
    Rules(Limits(2), Called(gap=(50, 60), sure_dif=1.0, sure_pct=0.01, now=55), Called(gap=(50, 60), sure_gap=3, past=45, other_pct=9, other_sure_gap=4), start=5)]


def series(seed: int, n: int = 60):
    rng = random.Random(seed)
    x = [50.0]
    for _ in range(n - 1):
        x.append(max(1.0, x[-1] + rng.choice((-4, -2, -1, 0, 1, 2, 4)) + rng.choice((0, 0.25))))
    return x


def afresh(values, rules: Rules):
    """The rules, with all labels, snapshots and distances made anew at every row."""
    snapshots, out, last = [], [], None
    start = 4 * rules.limits.t_min if rules.start is None else rules.start
    for t in range(len(values)):
        if t < start:
            out.append((0, ""))
            continue
        first = 0 if rules.window is None else max(0, t - rules.window)
        part = values[first : t + 1]
        labels = dict(enumerate(prune(part, turning_marks(part), rules.limits), first))
        snapshots.append({k for k, m in labels.items() if m})
        marked = [k for k in sorted(labels) if labels[k]]
        earlier = [k for k in marked if k < t]
        if not earlier:
            out.append((0, ""))
            continue
        pre, kind = labels[earlier[-1]], ""
        signal, at = 0, None
        if last and last[1] == "normal" and last[2] != 0:
            with_it = [last[2] in s for s in snapshots]
            if True in with_it and not all(with_it[with_it.index(True) :]):
                signal, kind, at = -last[0], "reversed", earlier[-1]
        if not labels[t] and not (last and last[0] == pre):
            away = {}
            for m in (1, -1):
                k = max((k for k in earlier if labels[k] == m), default=None)
                lo, hi = (None, None) if k is None else sorted((k, t), key=lambda r: (r == t) == (m == -1))
                away[m] = (None,) * 4 if k is None else (t - k, values[hi] - values[lo], values[hi] / values[lo] - 1, values[k])
            rule = rules.peak if pre == 1 else rules.trough
            if rule.holds(pre, away[pre][:3], away[-pre][:3], values[t], away[pre][3]):
                signal, kind, at = pre, "normal", earlier[-1]
        if not signal and last and last[0] == -pre and (values[t] > last[3] if last[0] == 1 else values[t] < last[3]):
            signal, kind, at = pre, "normal", earlier[-1]
        if signal:
            last = (signal, kind, at, values[at])
        out.append((signal, f"{kind}_{'max' if signal == 1 else 'min'}" if signal else ""))
    return out


@pytest.mark.parametrize("rules", RULES)
def test_state_is_enough(rules):
    kinds = set()
    for seed in range(30):
        values = series(seed)
        want, caller, got = afresh(values, rules), Caller(rules), []
        for k, x in enumerate(values):
            if k % 7 == 3:
                caller = Caller.load(rules, caller.save())
            got.append(caller.step(x))
        assert got == want
        kinds |= {kind for _, kind in got}
    assert {"normal_max", "normal_min"} <= kinds


def test_called():
    rule = Called(gap=(1, 4), dif=(2, 9), pct=None, now=10.0)
    assert rule.holds(-1, (2, 3.0, 0.1), (5, 1.0, 0.1), 9.0, 6.0) and not rule.holds(-1, (2, 3.0, 0.1), (5, 1.0, 0.1), 10.0, 6.0)
    assert not rule.holds(-1, (4, 3.0, 0.1), (5, 1.0, 0.1), 9.0, 6.0) and not rule.holds(-1, (2, 2.0, 0.1), (5, 1.0, 0.1), 9.0, 6.0)
    assert not rule.holds(-1, (5, 3.0, 0.1), (5, 1.0, 0.1), 9.0, 6.0) and not rule.holds(-1, (2, 3.0, 0.1), (None,) * 3, 9.0, 6.0)


def test_stream_in_many_batches_is_the_table(spark, tmp_path):
    rows = [(g, t, x) for g in range(5) for t, x in enumerate(series(g, 40))]
    schema = "g int, t int, x double"
    for first in range(0, 40, 8):
        spark.createDataFrame([r for r in rows if first <= r[1] < first + 8], schema).repartition(2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(0, 3, 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # late
    rules = RULES[0]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = (call_stream(stream, ORDER, "x", rules).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(query.recentProgress) >= 5
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    want = [tuple(r) for r in call(spark.createDataFrame(rows, schema), ORDER, "x", rules).collect()]
    assert sorted(r for r in got if r[2] != 1.0 or r[1] != 3) == sorted(want) and any(r[3] for r in want)
    assert [r[3:] for r in got if r[:3] == (0, 3, 1.0)] == [(None, None)]


def test_no_rows(spark):
    assert call(spark.createDataFrame([], "g int, t int, x double"), ORDER, "x").count() == 0
