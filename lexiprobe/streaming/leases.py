"""Leases on resources as keyed state of a stream: requests come in, answers go out, and each resource remembers who holds it.

A lease is held from its last heartbeat on for ``stale_after`` seconds unless it was released; times are those
of the requests, so that answers do not depend on when a batch runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame

#: Requests: seq orders those of one moment; action is acquire, heartbeat or release; at is in seconds.
REQUEST = "resource string, holder string, action string, at double, seq long"
ANSWER = "resource string, holder string, action string, at double, seq long, granted boolean, reason string, held_by string, heartbeat double"
_STATE = "holder string, heartbeat double, released boolean"
STALE_AFTER = 600.0


@dataclass(frozen=True)
class Lease:
    holder: str
    heartbeat: float
    released: bool = False

    def held(self, at: float, stale_after: float) -> bool:
        return not self.released and at - self.heartbeat < stale_after


def answer(lease: Lease | None, holder: str, action: str, at: float, stale_after: float = STALE_AFTER) -> tuple[Lease | None, bool, str | None]:
    """(the lease after a request, whether it was granted, why not).

    Anyone may acquire what nobody holds, and its holder again. A heartbeat needs the holder's own lease, which may
    have gone stale but not been released; a release is refused only while another one holds the lease.
    """
    held = lease is not None and lease.held(at, stale_after)
    if action == "acquire":
        return (lease, False, f"held by {lease.holder}") if held and lease.holder != holder else (Lease(holder, at), True, None)
    if action == "heartbeat":
        why = "no lease" if lease is None else "released" if lease.released else f"now of {lease.holder}" if lease.holder != holder else None
        return (lease, False, why) if why else (replace(lease, heartbeat=at), True, None)
    if action == "release":
        if lease is None:
            return None, False, "no lease"
        return (lease, False, f"held by {lease.holder}") if held and lease.holder != holder else (replace(lease, released=True, heartbeat=at), True, None)
    return lease, False, f"no action {action}"


def lease_answers(requests: DataFrame, stale_after: float = STALE_AFTER) -> DataFrame:
    """A stream of REQUEST to a stream of ANSWER: requests of a resource in order of (at, seq) within a batch, batches in theirs.

    State is a row for each resource ever asked for.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lease = Lease(*state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "seq"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            lease, granted, why = answer(lease, r.holder, r.action, r.at, stale_after)
            out.append((key[0], r.holder, r.action, r.at, r.seq, granted, why, lease.holder if lease and not lease.released else None, lease.heartbeat if lease else None))
        if lease is not None:
            state.update((lease.holder, lease.heartbeat, lease.released))
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in ANSWER.split(", ")])

    return requests.groupBy("resource").applyInPandasWithState(run, ANSWER, _STATE, "append", "NoTimeout")


def stream_leases(spark, source: str, target: str, checkpoint: str, stale_after: float = STALE_AFTER) -> None:
    """Answers all files of requests under ``source`` that were not answered yet, into ``target`` (parquet); a restart goes on from the state."""
    answers = lease_answers(spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(source), stale_after)
    answers.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
