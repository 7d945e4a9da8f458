"""The take-once cache over a stream of operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_MICROS = 30 * 60 * 1_000_000
OUTCOME = "key long, op_id long, outcome string"
STATE = "at long, encoder long, held boolean"


def replay(ops: DataFrame, ttl_micros: int = TTL_MICROS) -> DataFrame:
    """(key, op_id, outcome) of every take in rows (key, op_id, at, kind, encoder).

    A key's state is what its last put stored. A take removes it, whatever the
    outcome: ``missing`` without an entry, ``expired`` if it is older than the
    time to live, ``encoder_mismatch`` if another encoder stored it, else
    ``hit``. Operations of a batch are replayed in the order of (at, op_id);
    batches must come in the order of time, as the stream's source gives them.
    Only keys that hold an entry keep state.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, encoder, held = state.get if state.exists else (0, 0, False)
        out = []
        for op in pd.concat(list(parts)).sort_values(["at", "op_id"]).itertuples():
            if op.kind == "put":
                at, encoder, held = int(op.at), int(op.encoder), True
                continue
            if not held:
                outcome = "missing"
            elif op.at - at > ttl_micros:
                outcome = "expired"
            else:
                outcome = "hit" if op.encoder == encoder else "encoder_mismatch"
            held = False
            out.append((key[0], op.op_id, outcome))
        if held:
            state.update((at, encoder, held))
        elif state.exists:  # a taken key needs no state
            state.remove()
        yield pd.DataFrame(out, columns=["key", "op_id", "outcome"])

    return ops.groupBy("key").applyInPandasWithState(fold, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)
