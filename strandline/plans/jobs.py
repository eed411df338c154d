"""A document's preparation as a job of named stages that tells what it does."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Store
from . import stored

#: The stages of a preparation, in order.
STAGES = ("preserve", "inspect", "extract", "normalise", "layout", "segment", "recognise")
EVENT = "document_id string, stage string, status string, index int, total int, detail string"


def prepare(store: Store, document_id: str, actions: dict[str, Callable[[], str | None]], run_id: str, stages: tuple[str, ...] = STAGES) -> Iterator[dict]:
    """Events of a job, as it goes: each stage started, then completed or failed; a failure ends the job.

    A stage's action returns a detail to tell, or none; a stage without an action has nothing to do.
    The run is logged in ``processing_runs``, and the document is held while the job lasts, so a
    second one of the same document is ``Busy``.
    """
    unknown = set(actions) - set(stages)
    if unknown:
        raise KeyError(f"no stage {', '.join(sorted(unknown))}")
    with store.job(document_id):
        stored.start_run(store, {"id": run_id, "document_id": document_id, "stage": "prepare"})
        end = "failed"
        try:
            for i, stage in enumerate(stages, 1):
                event = {"document_id": document_id, "stage": stage, "index": i, "total": len(stages), "detail": None}
                yield event | {"status": "started"}
                try:
                    said = actions.get(stage, lambda: None)()
                except Exception as e:  # told, and the end of the job
                    yield event | {"status": "failed", "detail": f"{type(e).__name__}: {e}"}
                    return
                yield event | {"status": "completed", "detail": said}
            end = "completed"
        finally:
            stored.finish_run(store, run_id, end)


def states(events: DataFrame) -> DataFrame:
    """(document_id, stage, status, detail): how far each stage came, of a log of events (``EVENT`` and ordinal)."""
    last = F.max_by(F.struct("status", "detail"), "ordinal").alias("r")
    return events.groupBy("document_id", "stage").agg(last).select("document_id", "stage", "r.*")
