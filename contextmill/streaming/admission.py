"""Note admission under session caps, one state per session."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.notes import Limits

OUTPUT = "ref string, session_id string, pos long, token_est long, admitted boolean"
STATE = "notes long, tokens long"


def admit_stream(notes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Admits notes in order of arrival within each micro-batch and across them. The state per session
    is two numbers; maxFilesPerTrigger of the source bounds what a session brings into one batch."""
    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, used = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("pos", kind="stable")
        admitted = []
        for size in rows["token_est"]:
            ok = count < limits.session_notes and used + size <= limits.session_tokens
            count, used = (count + 1, used + int(size)) if ok else (count, used)
            admitted.append(ok)
        state.update((count, used))
        yield rows.assign(admitted=admitted)

    return notes.select("ref", "session_id", "pos", "token_est").groupBy("session_id").applyInPandasWithState(
        fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
