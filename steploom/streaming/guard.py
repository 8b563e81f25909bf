"""A stateful guard over a stream of agent steps.

Per run the guard keeps its last WINDOW targets. It fires when a target of the current step fills at
least REPEATS of them. A warning run is warned once, a hard-stop run is stopped; after that, and in
other runs, the event is only observed. State is a few strings per run, whatever the stream's length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, REPEATS = 5, 3
WARN_ARM, STOP_ARM = "WARN_REPLAN_GUARD", "HARD_STOP_GUARD"
EVENT_SCHEMA = "run_id string, arm string, step int, target string, times int, decision string"
STATE_SCHEMA = "recent string, warned boolean, stopped boolean"


def observe(recent: list[str], warned: bool, stopped: bool, arm: str, targets: Iterable[str], window: int = WINDOW, repeats: int = REPEATS):
    """One step of the guard: (recent, warned, stopped, event or None); an event is (target, times, decision)."""
    targets = list(targets) or ["<no-target>"]
    recent = [*recent, *targets][-window:]
    for target in reversed(targets):
        times = recent.count(target)
        if times >= repeats:
            decision = "guard_trigger_observed"
            if arm == WARN_ARM and not warned:
                warned, decision = True, "warn_replan"
            elif arm == STOP_ARM:
                stopped, decision = True, "hard_stop"
            return recent, warned, stopped, (target, times, decision)
    return recent, warned, stopped, None


def _update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    recent, warned, stopped = state.get if state.exists else ("[]", False, False)
    recent = json.loads(recent)
    events = []
    steps = pd.concat(list(pdfs)).sort_values("step", kind="stable")
    for r in steps.itertuples():
        if stopped:
            break
        recent, warned, stopped, event = observe(recent, warned, stopped, r.arm, [t for t in r.targets if t])
        if event:
            events.append((key[0], r.arm, int(r.step), *event))
    state.update((json.dumps(recent), warned, stopped))
    yield pd.DataFrame(events, columns=["run_id", "arm", "step", "target", "times", "decision"])


def guard_stream(steps: DataFrame) -> DataFrame:
    """Guard events of a stream (or table) with run_id, arm, step and targets array<string>.

    Rows of a run must arrive in step order across micro-batches; inside one they are sorted.
    """
    return steps.groupBy("run_id").applyInPandasWithState(_update, EVENT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
