"""Parameters that define results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    source_language: str = "ja"
    quality_tier: str = "fast"
    scene_max_cues: int = 35
    scene_max_seconds: int = 150
    context_cues: int = 4
    review_context_cues: int = 8
    retries: int = 3

    def normalized(self) -> Config:
        """Values out of range take their defaults; the review context is clamped to 0..16."""
        base = Config()
        return Config(
            (self.source_language or "").strip().lower() or base.source_language,
            tier if (tier := (self.quality_tier or "").strip().lower()) in ("fast", "quality") else base.quality_tier,
            self.scene_max_cues if self.scene_max_cues >= 10 else base.scene_max_cues,
            self.scene_max_seconds if self.scene_max_seconds >= 30 else base.scene_max_seconds,
            self.context_cues if self.context_cues >= 0 else base.context_cues,
            min(max(self.review_context_cues, 0), 16),
            self.retries if self.retries >= 1 else base.retries,
        )


# Scenes
PAUSE_MS, PAUSE_CUES = 4000, 12
# Repeat clusters
REPEAT_GAP_MS, CLUSTER_CUES, SEVERE_CUES = 4000, 3, 5
SEVERE_VOCAL_MS, SEVERE_TEXT_MS = 6000, 15000
# Overlaps, retries and recognition segments
OVERLAP_MS, SHORTEST_MS = 200, 200
PAD_MS, MERGE_MS, PIECE_MS, RETRY_REGIONS, FINAL_REGIONS = 1500, 1000, 30000, 48, 12
SEGMENT_MS, SEGMENT_OVERLAP_MS = 300_000, 1250
# Terms
TERM_LIMIT, LINES_PER_TERM, CONTEXT_LINES, LINE_CHARS, PROMPT_CHARS = 30, 3, 80, 120, 120
# Review
REVIEW_SCENES, REPAIR_BATCH = 6, 24
REQUEST_LIMIT, TOKEN_LIMIT, REQUEST_CHARS, TOTAL_CHARS, TIME_LIMIT_MS = 10, 49152, 60_000, 480_000, 180_000
THINKING_TOKEN_LIMIT, THINKING_TIME_LIMIT_MS = 131_072, 480_000
# Live sessions
INACTIVE_MS, INBOX_TTL_MS, COOLDOWN_MS, LAUNCH_ATTEMPTS, RECENT_PATHS, LIBRARY_ROWS = 2000, 120_000, 5000, 3, 30, 100
