"""Sessions over a stream: several micro-batches, restarts, and what the state store holds afterwards."""

import random
from datetime import datetime, timedelta

import pytest

from factlake.streaming import sessions as S

SCHEMA = "user_id bigint, event_id bigint, ts timestamp, event_type string"
START = datetime(2024, 1, 1)


def plain(events, ttl, forget):
    """One event after another. events: (user, id, time, type), in order for each user."""
    state, out = {}, {}
    for user, event, ts, kind in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        s = state.get(user)
        if s and (ts - s["last"]).total_seconds() > forget:
            s = state.pop(user) and None
        expired = bool(s) and (ts - s["last"]).total_seconds() > ttl
        if kind in ("delete", "stats"):
            turns = s["history"] if s and not expired else []
            out[event] = ({"delete": "deleted", "stats": "stats"}[kind], s["session"] if s else 0, len(turns), s["turns"] if s else 0, ",".join(turns[-5:]) if kind == "stats" else "", expired)
            if kind == "delete":
                state.pop(user, None)
            continue
        if s is None or expired or kind == "reset":
            s = {"session": (s["session"] if s else 0) + 1, "turns": s["turns"] if s else 0, "history": []}
        s["history"], s["turns"], s["last"] = [*s["history"], kind], s["turns"] + 1, ts
        state[user] = s
        out[event] = ("turn", s["session"], len(s["history"]), s["turns"], ",".join(s["history"][-5:]), expired)
    return out


def random_events(seed, users=4, days=6):
    r = random.Random(seed)
    times = sorted(r.uniform(0, days * 24 * 60) for _ in range(150))
    return [(r.randint(1, users), i, START + timedelta(minutes=round(m, 2)), r.choice(["view", "view", "click", "reset", "delete", "stats"])) for i, m in enumerate(times)]


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{path}/in/*")


def put(spark, path, name, events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.parquet(f"file://{path}/in/{name}")


@pytest.mark.parametrize("seed", [1, 2])
def test_micro_batches_and_a_restart_give_what_one_pass_gives(spark, tmp_path, seed):
    ttl, forget = 3 * 3600, 24 * 3600
    events = random_events(seed)
    run = lambda: S.drain(S.session_states(source(spark, tmp_path), ttl, forget), f"file://{tmp_path}/run")
    for i in range(3):
        put(spark, tmp_path, i, events[i * 30 : (i + 1) * 30])
    assert run().count() == 90
    for i in range(3, 5):
        put(spark, tmp_path, i, events[i * 30 : (i + 1) * 30])
    got = {r.event_id: (r.kind, r.session_no, r.turn_no, r.turns, r.history, r.expired) for r in run().collect()}
    assert got == plain(events, ttl, forget)


def test_state_follows_the_users_seen_lately(spark, tmp_path):
    """Fifty users, each seen for an hour and never again: the store keeps those within the time to forget."""
    forget = 6 * 3600
    for i in range(10):
        put(spark, tmp_path, i, [(i * 5 + u, i * 100 + u * 10 + k, START + timedelta(hours=4 * i, minutes=9 * k), "view") for u in range(5) for k in range(4)])
    done = S.drain(S.session_states(source(spark, tmp_path), 1800, forget), f"file://{tmp_path}/run")
    assert done.count() == 200
    left = S.stored_sessions(spark, f"file://{tmp_path}/run")
    assert 5 <= left.count() <= 20
    assert {r.session_no for r in left.collect()} == {1}
    total = S.statistics(left).first()
    assert total.users == left.count() and total.active_sessions <= 10 and total.turns == 4 * total.users


def test_a_deleted_user_is_gone_from_the_store(spark, tmp_path):
    rows = [(1, 1, START, "view"), (2, 2, START, "view"), (1, 3, START + timedelta(minutes=1), "delete"), (None, 4, START, "view"), (3, 5, None, "view"), (2, 6, START, None)]
    put(spark, tmp_path, 0, rows)
    out = S.drain(S.session_states(source(spark, tmp_path)), f"file://{tmp_path}/run")
    assert {(r.event_id, r.kind) for r in out.collect()} == {(1, "turn"), (2, "turn"), (3, "deleted"), (6, "turn")}
    assert [r.user_id for r in S.stored_sessions(spark, f"file://{tmp_path}/run").collect()] == [2]
