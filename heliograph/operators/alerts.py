"""Alert evaluation: conditions, the state machine, missing series, notification retries."""

from __future__ import annotations

import hashlib
import json
import operator
from collections.abc import Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"greater": operator.gt, "greater_equal": operator.ge, "less": operator.lt, "less_equal": operator.le, "equal": operator.eq, "not_equal": operator.ne}
MAX_PER_CYCLE = 100


def condition(value: Column, comparison: str, threshold: float) -> Column:
    """Whether a value fires, IEEE style: NaN compares as false, but differs from everything."""
    nan = F.isnan(value)
    test = COMPARE[comparison](value, F.lit(threshold))
    return F.when(nan, comparison == "not_equal").otherwise(test)


@dataclass(frozen=True)
class Rule:
    project: str
    rule_id: str
    hold_seconds: int = 0
    no_data: str = "unknown"
    mute_until: int | None = None


@dataclass(frozen=True)
class State:
    alert_id: str
    phase: str = "inactive"
    active: bool = False
    episode: int = 0
    pending_since: int | None = None
    evaluated: int = 0
    event_cursor: int = 0
    notified: int = 0
    mute_until: int | None = None
    reason: str | None = None


@dataclass(frozen=True)
class Seen:
    """One observation: kind is condition, event, no_data or unknown."""

    kind: str
    truth: bool = False
    cursor: int = 0
    reason: str = ""


def alert_id(rule_id: str, labels: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps([rule_id, dict(sorted(labels.items()))], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def observe(rule: Rule, state: State, seen: Seen, now: int) -> tuple[State, str | None]:
    """The next state, and the transition to tell of (firing, resolved) if there is one.

    What is unknown keeps the episode and never resolves; an episode is told of
    once; only one that was told of resolves; a mute holds news back.
    """
    if now < state.evaluated:
        raise ValueError("the clock moved backwards")
    state = replace(state, evaluated=now)
    if seen.kind == "unknown" or (seen.kind == "no_data" and rule.no_data == "unknown"):
        return replace(state, phase="unknown", reason=seen.reason or "no data", pending_since=None), None
    event = seen.kind == "event"
    if event:
        holds = seen.cursor > state.event_cursor
        if holds:
            state = replace(state, event_cursor=seen.cursor, active=False, pending_since=None)
    else:
        holds = rule.no_data == "firing" if seen.kind == "no_data" else seen.truth
    state, news = replace(state, reason=None), None
    if not holds:
        if state.active and not event and state.notified == state.episode:
            news = "resolved"
        state = replace(state, phase="inactive", pending_since=None, active=False)
    elif state.active:
        state = replace(state, phase="firing")
        news = "firing" if state.notified < state.episode else None
    else:
        since = now if state.pending_since is None else state.pending_since
        if now - since >= rule.hold_seconds:
            state, news = replace(state, phase="firing", active=True, episode=state.episode + 1, pending_since=since), "firing"
        else:
            state = replace(state, phase="pending", pending_since=since)
    muted = any(m is not None and m > now for m in (rule.mute_until, state.mute_until))
    if news is None or muted:
        return state, None
    return (replace(state, notified=state.episode) if news == "firing" else state), news


def notification_id(project: str, alert: str, episode: int, transition: str) -> str:
    return hashlib.sha256(f"{project}:{alert}:{episode}:{transition}".encode()).hexdigest()


def fold(rule: Rule, alert: str, rows: Iterable[tuple[int, Seen]], state: State | None = None) -> list[tuple[int, str, int, str | None]]:
    """(time, phase, episode, transition) after each observation."""
    state, out = state or State(alert), []
    for now, seen in rows:
        state, news = observe(rule, state, seen, now)
        out.append((now, state.phase, state.episode, news))
    return out


def run(observations: DataFrame, rule: Rule) -> DataFrame:
    """The state machine over (series, t, kind, truth, cursor) rows: a fold by series in time order."""

    def by_series(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        seen = ((int(t), Seen(k, bool(x), int(c))) for t, k, x, c in zip(pdf["t"], pdf["kind"], pdf["truth"], pdf["cursor"]))
        out = fold(rule, alert_id(rule.rule_id, {"series": key[0]}), seen)
        return pd.DataFrame([(key[0], *r) for r in out], columns=["series", "t", "phase", "episode", "transition"])

    return observations.groupBy("series").applyInPandas(by_series, "series string, t long, phase string, episode long, transition string")


def with_missing(observed: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Observations and a no_data one for each known series that is absent."""
    absent = known.select(*by).distinct().join(observed.select(*by).distinct(), by, "left_anti")
    return observed.select(*by, "kind", "truth").unionByName(absent.select(*by, F.lit("no_data").alias("kind"), F.lit(False).alias("truth")))


def retry_seconds(attempts: Column) -> Column:
    """Wait before the next attempt: powers of two up to five minutes."""
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(8))), F.lit(300.0)).cast("long")


def due(outbox: DataFrame, now: int, most: int = MAX_PER_CYCLE) -> DataFrame:
    """Notifications to send now, the oldest first: at most 100 a cycle, which is the feature."""
    return outbox.where(F.col("delivered_at").isNull() & (F.col("next_attempt") <= now)).orderBy("next_attempt", "id").limit(most)
