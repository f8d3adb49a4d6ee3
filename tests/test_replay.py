"""Replay operators against plain simulations of the rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from promptledger.operators import budget, ordered
from promptledger.operators.budget import replay_admissions
from promptledger.operators.policy import enforce
from promptledger.operators.ratelimit import RateLimits, demand, replay_limits
from promptledger.plans.streams import collected, collected_in_waves, fed, out_of_order
from promptledger.streaming.budgets import replay_budget_stream
from promptledger.streaming.limits import _Budget, budget_stream, limit_stream

START = datetime(2024, 3, 1)
LIMITS = RateLimits(burst=3, per_minute=5, per_hour=20)


def make_requests(seed, n=600, hours=30):
    """A hot key that is mostly over its limits, one in bursts, some quiet ones, ties included."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            key, at = "hot", rng.uniform(0, 5 * 3600)
        elif kind < 0.7:
            key, at = "bursty", rng.choice([0, 4, 9, 20]) * 3600 + rng.uniform(0, 90)
        else:
            key, at = f"quiet-{rng.randrange(4)}", rng.uniform(0, hours * 3600)
        if rng.random() < 0.2:
            at = round(at / 60) * 60
        rows.append((key, f"r{i:05d}", START + timedelta(microseconds=int(at * 1e6))))
    return rows


def simulate_limits(rows, limits, rpm_of=lambda key: None):
    accepted, out = {}, {}
    for key, rid, at in sorted(rows, key=lambda r: (r[2], r[1])):
        seen = accepted.setdefault(key, [])
        caps = [limits.burst, rpm_of(key) or limits.per_minute, limits.per_hour]
        counts = [sum(1 for t in seen if (at - t).total_seconds() < w) for w in (10, 60, 3600)]
        hit = next((n for n, c, cap in zip(("burst", "minute", "hour"), counts, caps) if c >= cap), None)
        wait = None
        if hit:
            w = {"burst": 10, "minute": 60, "hour": 3600}[hit]
            oldest = min(t for t in seen if (at - t).total_seconds() < w)
            wait = max(0.1, w - (at - oldest).total_seconds())
        else:
            seen.append(at)
        out[rid] = (hit is None, hit, None if wait is None else round(wait, 4), *counts)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_limiter_replay_is_exact(spark, seed):
    rows = make_requests(seed, 600, 12 if seed == 3 else 30)
    want = simulate_limits(rows, LIMITS)
    df = spark.createDataFrame(rows, "key string, request_id string, start_ts timestamp").repartition(5)
    got = {
        r.request_id: (
            r.allowed, r.limit_hit, None if r.retry_after is None else round(r.retry_after, 4),
            r.burst_count, r.minute_count, r.hour_count,
        )
        for r in replay_limits(df, LIMITS).collect()
    }
    assert got == want
    assert sum(not v[0] for v in got.values()) > 50


def test_limiter_override_zero_is_unset(spark):
    rows = make_requests(3, 300)
    rpm = {"hot": 2, "bursty": 0}
    want = simulate_limits(rows, LIMITS, lambda k: rpm.get(k))
    df = spark.createDataFrame(
        [(*r, rpm.get(r[0])) for r in rows], "key string, request_id string, start_ts timestamp, rpm_override int"
    )
    got = {r.request_id: (r.allowed, r.limit_hit) for r in replay_limits(df, LIMITS).collect()}
    assert got == {k: v[:2] for k, v in want.items()}


def test_denied_requests_do_not_occupy_the_window(spark):
    rows = [("k", f"r{i}", START + timedelta(seconds=i * 4)) for i in range(12)]
    df = spark.createDataFrame(rows, "key string, request_id string, start_ts timestamp")
    limits = RateLimits(burst=2, per_minute=100, per_hour=100)
    got = {r.request_id: r.allowed for r in replay_limits(df, limits).collect()}
    counted = {r.request_id: r.burst_demand <= 2 for r in demand(df, limits).collect()}
    assert got == {k: v[0] for k, v in simulate_limits(rows, limits).items()}
    assert sum(got.values()) > sum(counted.values())


def make_budget(seed, n=400):
    rng = random.Random(seed)
    tiers = {"gold": (15.0, 600), "silver": (2.9, 1500), "plain": (1.0, None), None: (5.0, None)}
    rows = []
    for i in range(n):
        tier = rng.choice(list(tiers))
        start = START + timedelta(seconds=rng.randrange(0, 3 * 86400))
        end = start + timedelta(seconds=rng.choice([0, 0, 5, 600, 7200]))
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}"
        tokens = rng.choice([0, 10, 60, 333])
        rows.append((f"r{i:04d}", key, tier, tiers[tier][1], tiers[tier][0], tokens, rng.choice([0, 0, 20, 500]), start, end))
    return rows


BUDGET_SCHEMA = (
    "request_id string, key string, tier string, tier_daily_limit bigint, cost_multiplier double, tokens int, "
    "estimated_tokens int, start_ts timestamp, end_ts timestamp"
)


def simulate_budget(rows, limit):
    moves = []
    for r in rows:
        moves.append((r[7], r[0], 0, r))
        moves.append((r[8], r[0], 1, r))
    used, tiers, out = {}, {}, {}
    for at, rid, kind, r in sorted(moves, key=lambda m: m[:3]):
        _, key, tier, cap, mult, tokens, estimate, _, _ = r
        day = at.date()
        if kind == 0:
            if limit > 0 and used.get((key, day), 0) + int(estimate * mult) > limit:
                out[rid] = "daily_key_limit"
            elif cap and tiers.get((tier, day), 0) + estimate > cap:
                out[rid] = f"daily_tier_limit:{tier}"
            else:
                out[rid] = None
        elif out[rid] is None and tokens > 0:
            used[key, day] = used.get((key, day), 0) + int(tokens * mult)
            if tier:
                tiers[tier, day] = tiers.get((tier, day), 0) + tokens
    return out


@pytest.mark.parametrize("seed,limit", [(5, 12_000), (6, 0)])
def test_budget_replay_is_exact(spark, seed, limit):
    rows = make_budget(seed)
    want = simulate_budget(rows, limit)
    df = spark.createDataFrame(rows, BUDGET_SCHEMA).repartition(3)
    got = {r.request_id: r.budget_type for r in replay_admissions(df, limit).collect()}
    assert got == want
    assert any(v and v.startswith("daily_tier") for v in want.values())


def test_budget_replay_over_midnights_and_long_requests(spark, monkeypatch):
    """Open requests that are charged days later join the accounts of several days; the number of passes never changes."""
    passes = []
    used = budget._used_at_start
    monkeypatch.setattr(budget, "_used_at_start", lambda *a: passes.append(1) or used(*a))
    for seed, n in ((8, 60), (9, 700)):
        rng = random.Random(seed)
        rows = []
        for r in make_budget(seed, n):
            start = r[7].replace(hour=23, minute=50) + timedelta(minutes=rng.randrange(30), days=rng.randrange(4)) if rng.random() < 0.5 else r[7]
            rows.append((*r[:7], start, start + timedelta(hours=rng.choice([0, 0, 1, 30, 70]), seconds=rng.randrange(9))))
        df = spark.createDataFrame(rows, BUDGET_SCHEMA)
        for limit in (900, 12_000):
            assert {r.request_id: r.budget_type for r in replay_admissions(df, limit).collect()} == simulate_budget(rows, limit)
    assert len(passes) == 4 * (budget.ROUNDS + 2)


def test_tier_caps_in_a_stream_with_late_rows(spark):
    rows = [r for r in make_budget(11, 300)]
    df = spark.createDataFrame(rows, BUDGET_SCHEMA)
    waves = out_of_order(df, "start_ts")
    path = fed(spark, waves, "tier-caps-test", lambda stream, path: replay_budget_stream(stream, path, 9_000))
    got = spark.read.parquet(f"{path}/decisions").collect()
    want = simulate_budget(rows, 9_000)
    assert len(got) == len(want) and {r.request_id: r.budget_type for r in got} == want
    assert {v.split(":")[0] for v in want.values() if v} == {"daily_key_limit", "daily_tier_limit"}
    assert spark.read.parquet(f"{path}/late").isEmpty()


def test_budget_key_check_can_be_off(spark):
    rows = make_budget(7, 150)
    df = spark.createDataFrame(rows, BUDGET_SCHEMA)
    got = {r.request_id: r.budget_type for r in replay_admissions(df, 3000, enforce_pre_request=False).collect()}
    assert got == simulate_budget(rows, 0)


def test_budget_rejects_requests_that_end_before_they_start(spark):
    row = ("r1", "k", None, None, 1.0, 50, 40, START + timedelta(hours=1), START)
    df = spark.createDataFrame([row], BUDGET_SCHEMA)
    with pytest.raises(ValueError):
        replay_admissions(df, 60).collect()


def test_policy_chain_order(spark):
    """One request per rule; the first violated rule is named, and the rate slot stays used."""
    base = dict(
        task="chat", model="m", endpoint="e", tier=None, tier_daily_limit=None, cost_multiplier=1.0,
        allowed_models=None, allowed_endpoints=None, tokens=10, max_tokens=10,
    )
    cases = [
        ("ok", {}),
        ("tokens", {"max_tokens": 99_999}),
        ("model", {"allowed_models": ["x*"]}),
        ("endpoint", {"allowed_endpoints": ["other"]}),
        ("budget", {"max_tokens": 900}),
        ("provider", {"task": "embeddings"}),
    ]
    rows = []
    for i, (name, change) in enumerate(cases):
        at = START + timedelta(seconds=i)
        rows.append({"request_id": name, "key": name, "start_ts": at, "end_ts": at, **base, **change})
    for i in range(4):
        at = START + timedelta(seconds=20 + i)
        rows.append({"request_id": f"rate{i}", "key": "rate", "start_ts": at, "end_ts": at, **base, "max_tokens": 99_999})
    schema = (
        "request_id string, key string, start_ts timestamp, end_ts timestamp, task string, model string, endpoint string, "
        "tier string, tier_daily_limit bigint, cost_multiplier double, allowed_models array<string>, "
        "allowed_endpoints array<string>, tokens int, max_tokens int"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    policies = spark.createDataFrame(
        [("embeddings", [], ["e"])], "task string, allowed_providers array<string>, denied_providers array<string>"
    )
    got = {r.request_id: (r.violation, r.violation_code) for r in enforce(df, policies, LIMITS, daily_limit=500).collect()}
    assert got["ok"] == (None, None)
    assert got["tokens"] == ("token_limit", "token_limit_exceeded")
    assert got["model"] == ("model_not_allowed", "model_not_allowed")
    assert got["endpoint"] == ("endpoint_not_allowed", "endpoint_not_allowed")
    assert got["budget"] == ("token_budget_exceeded", "token_budget_exceeded")
    assert got["provider"] == ("provider_task", "provider_denied_for_task")
    assert [got[f"rate{i}"][0] for i in range(4)] == ["token_limit"] * 3 + ["rate_limit"]


def test_stream_limiter_equals_batch(spark):
    rows = make_requests(8, 250)
    df = spark.createDataFrame(rows, "key string, request_id string, start_ts timestamp")
    got = collected_in_waves(spark, out_of_order(df, "start_ts"), "limits-out", lambda stream: limit_stream(stream, LIMITS))
    want = simulate_limits(rows, LIMITS)
    assert {r.request_id: (r.allowed, r.limit_hit) for r in got.collect()} == {k: v[:2] for k, v in want.items()}


def test_stream_budget_resets_at_midnight(spark):
    rng = random.Random(9)
    rows = [
        (f"k{i % 3}", f"r{i:04d}", START + timedelta(minutes=11 * i), rng.choice(["a", "b"]), rng.choice([5, 40]), rng.choice([0, 30]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "key string, request_id string, start_ts timestamp, tier string, cost bigint, estimate bigint")
    got = collected_in_waves(spark, out_of_order(df, "start_ts"), "budget-out", lambda stream: budget_stream(stream, 300))
    used, want = {}, {}
    for key, rid, at, _, cost, estimate in rows:
        slot = (key, at.date())
        want[rid] = used.get(slot, 0) + estimate <= 300
        if want[rid]:
            used[slot] = used.get(slot, 0) + cost
    assert {r.request_id: r.admitted for r in got.collect()} == want


def test_stream_limiter_decides_late_rows_in_their_place(spark):
    """Three batches, the second brings rows from before the first: each is decided by what came before it in time."""
    import time

    from promptledger.plans.streams import closing_row
    from promptledger.session import scratch_path

    limits = RateLimits(burst=2, per_minute=1000, per_hour=1000)
    path, schema = scratch_path(spark, "waves"), "key string, request_id string, start_ts timestamp"
    waves = [[100], [95, 96], [106]]
    for wave in waves:
        spark.createDataFrame([("k", f"r{s}", START + timedelta(seconds=s)) for s in wave], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.1)
    closing_row(spark.read.parquet(path), "start_ts").write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.request_id: r.allowed for r in collected(spark, limit_stream(stream, limits), "waves-out").collect()}
    assert got == {"r95": True, "r96": True, "r100": False, "r106": True}


def test_dense_demand_is_linear(spark):
    """All requests of one key in one hour: four times the rows take about four times as long."""
    import time

    spent = []
    for n in (20_000, 80_000):
        df = spark.range(n).selectExpr("'k' as key", "cast(id as string) as request_id", f"timestamp_micros(1704067200000000 + id * {3_599_000_000 // n}) as start_ts")
        begin = time.perf_counter()
        top = demand(df, LIMITS).agg(F.max("hour_demand"), F.max("minute_demand")).first()
        spent.append(time.perf_counter() - begin)
        assert top[0] == n and abs(top[1] - n / 60) < n / 600
    assert spent[1] < 10 * max(spent[0], 1) and spent[1] < 40


def test_a_wave_reads_its_own_folder(spark):
    """Waves are written once; taking one in prunes all others, so feeding them takes time in proportion to the rows."""
    df = spark.createDataFrame(make_requests(4), "key string, request_id string, start_ts timestamp")
    *waves, closing = out_of_order(df, "start_ts", wave_rows=100)
    assert len(waves) == 6 and closing.count() == 1
    for k, wave in enumerate(waves):
        plan = wave._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "(_wave#" in plan.split("PartitionFilters: [")[1].split("]")[0] and f"= {k})" in plan
    assert sorted(r.request_id for wave in waves for r in wave.collect()) == sorted(r.request_id for r in df.collect())


def test_budget_state_is_written_for_days_that_later_rows_see():
    """Every call on state is a round trip to the JVM, so days that are over are neither stored nor given a timer."""

    class Days(dict):
        iterator = dict.items
        removeKey = dict.pop

        def updateValue(self, key, value):
            self[key] = value

    day = 86_400_000_000
    state = _Budget(300)
    state.by_tier, timers = Days(), []
    state.handle = type("Handle", (), {"registerTimer": lambda self, ms: timers.append(ms)})()
    out = state.decided("k", [(d * day + i, f"r{d}-{i}", "t", 200, 0) for d in range(5) for i in range(3)], 4 * day + 10)
    assert out["used_before"].tolist() == [0, 200, 400] * 5 and out["admitted"].tolist() == [True, True, False] * 5
    assert dict(state.by_tier) == {(4, "t"): (400,)} and timers == [5 * day // 1000]


@pytest.mark.parametrize("together", [100_000, 3])
def test_replay_looks_for_dense_buckets_once(spark, monkeypatch, together):
    """Passes that cut dense buckets run only where there are any; both ways give the same decisions."""
    flags, running = [], budget.running
    monkeypatch.setattr(ordered, "ROWS_TOGETHER", together)
    monkeypatch.setattr(budget, "running", lambda *a, **k: flags.append(k["dense"]) or running(*a, **k))
    rows = make_budget(13, 120)
    got = {r.request_id: r.budget_type for r in replay_admissions(spark.createDataFrame(rows, BUDGET_SCHEMA), 9_000).collect()}
    assert got == simulate_budget(rows, 9_000) and set(flags) == {together == 3}
