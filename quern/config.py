"""Settings that queries take explicitly. Clocks are arguments: nothing here or below reads the current time."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

#: Layers, their folders, states of tasks and extensions of texts.
LAYERS = ("always", "when", "topic", "knowledge")
LAYER_DIRS = {"always": "always", "when": "when", "topic": "topics", "knowledge": "knowledge"}
INDEXED_DIRS = ("always", "when", "topics", "knowledge", "feedback")
#: Types of notes written by other tools, and of older stores; the two maps differ on purpose.
HARNESS_LAYERS = {"user": "always", "feedback": "when", "project": "topic", "reference": "knowledge"}
LEGACY_LAYERS = {"feedback": "when", "project": "topic", "reference": "topic", **{x: x for x in LAYERS}}
TASK_STATES = ("open", "in_progress", "blocked", "done")
TEXT_EXTENSIONS = ("md", "txt", "log", "csv", "tsv", "json", "py", "sh", "xml", "yaml", "yml")


@dataclass(frozen=True)
class Settings:
    """Defaults of ranking, recall, import and review; fixed values, but for the clocks."""

    today: dt.date = dt.date(2026, 6, 1)
    now: dt.datetime = dt.datetime(2026, 6, 1, 12, 0, 0)
    k: int = 5
    chunk_bytes: int = 1500
    recency_weight: float = 0.03
    recency_days: float = 180.0
    exempt_layers: tuple[str, ...] = ("always", "knowledge")
    confirm_days: int = 180
    invalidated_penalty: float = 1000.0
    capture_similarity: float = 0.85
    recall_similarity: float = 0.80
    per_probe: int = 5
    recall_most: int = 50
    user_weight: float = 1.5
    length_floor: int = 200
    length_scale: float = 2000.0
    length_penalty: float = 0.5
    scope_days: int = 90
    scope_sessions: int = 200
    import_bytes: int = 10 << 20
    always_bytes: int = 8192
    resume_delay_minutes: int = 60
    resume_age_days: int = 2
    nudge_percent: float = 60.0
    confidence_most: int = 6
    dim: int = 384

    @property
    def overfetch(self) -> int:
        return max(5 * self.k, 25)


DEFAULTS = Settings()
