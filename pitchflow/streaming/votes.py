"""Team votes of tracks as keyed state: a track's first votes until it is locked, then its team and a count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitchflow.operators.chunks import CLIP
from pitchflow.schema import VOTES

KEY = [CLIP, "track_id"]
OUT = f"{CLIP} string, track_id bigint, seq bigint, team int, locked boolean"
#: A track's votes while it is open, then its team and how many sightings it had; when it was last seen, in milliseconds.
STATE = "votes array<int>, team int, sightings bigint, seen bigint"
#: Keeps the state of many tracks out of the executors' heap.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A vote for no team.
NONE = -1


def commonest(votes: list[int]) -> int:
    """Ties go to the earliest."""
    return max(dict.fromkeys(votes), key=votes.count)


def team_vote_stream(sightings: DataFrame, votes: int = VOTES, expire_seconds: float | None = None) -> DataFrame:
    """``team_votes`` of a stream ``sightings(clip_id, track_id, seq, label)`` whose micro-batches come in order of seq.

    State is a vote for each sighting of an open track and two numbers for a locked one; with ``expire_seconds`` that of
    a track that wasn't seen for so long is dropped, and the track votes anew if it comes back. The states of a task's tracks go
    to Python and back in batches, with their rows. PROVIDER is for sessions of many tracks.
    """
    expire_ms = None if expire_seconds is None else max(1, int(expire_seconds * 1000))

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, labels = (np.concatenate(x) for x in zip(*((p["seq"].to_numpy(), p["label"].to_numpy(float, na_value=np.nan)) for p in parts), strict=True))
        order = np.argsort(seqs, kind="stable")
        seqs, labels = seqs[order], labels[order]
        now = 0 if expire_ms is None else state.getCurrentProcessingTimeMs()
        open_, team, sightings, seen = state.get if state.exists else ([], None, 0, now)
        if expire_ms is not None and now - seen >= expire_ms:
            open_, team, sightings = [], None, 0
        open_, teams = list(open_ or []), np.full(len(seqs), NONE)
        first = 0 if sightings else min(len(seqs), votes - len(open_))
        for k, label in enumerate(labels[:first].tolist()):
            open_.append(NONE if label != label else int(label))
            teams[k] = team = commonest(open_)
        teams[first:] = NONE if team is None else team
        locked = np.full(len(seqs), bool(sightings))
        if not sightings and len(open_) >= votes:
            locked[first - 1 :] = True
        if sightings or len(open_) >= votes:
            state.update(([], int(team), int(sightings + len(seqs) if sightings else len(open_) + len(seqs) - first), now))
        else:
            state.update((open_, None, 0, now))
        if expire_ms is not None:
            state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame({CLIP: key[0], "track_id": key[1], "seq": seqs, "team": pd.arrays.IntegerArray(teams.astype("int32"), teams == NONE), "locked": locked})

    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return sightings.groupBy(*KEY).applyInPandasWithState(fold, OUT, STATE, "append", timeout)
