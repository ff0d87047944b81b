"""Stateful streams against plain loops: late, repeated and out-of-order events over several batches."""

from __future__ import annotations

import datetime
import random

import pytest
from docloom.streaming import state

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "doc string, event_id long, value string, at timestamp"


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def run(spark, folder, make, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder / "in"))
        out = state.drain(make(stream), str(folder / "out"), str(folder / "check"), spark)
    return out.collect()


@pytest.fixture
def batches():
    rng = random.Random(4)
    events = [(f"d{rng.randrange(4)}", i, rng.choice(["load", "split", "embed", "index"]), at(i * 3 + rng.randrange(-20, 20))) for i in range(120)]
    one, two = events[:60], events[60:]
    # repeated within a batch; late but within the watermark; far behind it
    two = [*two, *two[:10], ("d0", 900, "late", one[-1][3] - datetime.timedelta(minutes=15)), ("d0", 901, "lost", T0 - datetime.timedelta(days=1)), (None, 902, "no key", at(100)), ("d1", 903, "no time", None)]
    return [one, two, [("end", 999, "x", at(5000))]]


def test_steps(spark, tmp_path, batches):
    got = run(spark, tmp_path, lambda s: state.step_sequence(s, "doc", "1 hour"), batches)
    events = sorted({(e[0], e[3], e[1], e[2]) for b in batches[:2] for e in b if e[0] and e[3] and e[1] != 901})
    want, step, last, seen = [], {}, {}, {}
    for doc, when, i, stage in events:
        step[doc] = step.get(doc, 0) + 1
        seen.setdefault(doc, set()).add(stage)
        want.append((doc, step[doc], i, stage, (when - last[doc]).total_seconds() * 1000 if doc in last else None, len(seen[doc])))
        last[doc] = when
    assert sorted((r.key, r.step, r.event_id, r.stage, r.latency_ms, r.stages) for r in got) == sorted(want)


def test_cache(spark, tmp_path, batches):
    got = run(spark, tmp_path, lambda s: state.cache_log(s, "doc", 0.5, "1 hour"), batches)
    ends, hits, want = {}, {}, []
    for doc, when, i, _ in sorted({(e[0], e[3], e[1], e[2]) for b in batches[:2] for e in b if e[0] and e[3] and e[1] != 901}):
        hit = doc in ends and when < ends[doc]
        hits[doc] = hits[doc] + 1 if hit else 0
        ends[doc] = ends[doc] if hit else when + datetime.timedelta(minutes=30)
        want.append((doc, i, hit, hits[doc]))
    assert sorted((r.key, r.event_id, r.hit, r.hits) for r in got) == sorted(want)
    assert any(w[2] for w in want) and sum(not w[2] for w in want) > 8


def test_settings_come_back(spark, tmp_path):
    name = next(iter(state.STATE_STORE))
    before = spark.conf.get(name, None)
    assert run(spark, tmp_path, lambda s: state.step_sequence(s, "doc"), [[("a", 1, "x", at(0))]]) == []  # still waiting
    assert spark.conf.get(name, None) == before
