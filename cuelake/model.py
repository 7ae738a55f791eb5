"""Schemas of the tables that the operators share, as DDL."""

from __future__ import annotations

CUES = "media_id long, cue_id int, pos int, start_ms long, end_ms long, text string"
SCENES = "media_id long, scene_idx int, start_pos int, end_pos int"
RANGES = "media_id long, piece int, start_ms long, end_ms long"
TRANSLATIONS = "media_id long, cue_id int, target string"
TERMS = "source string, target string, variants array<string>"
ISSUES = "media_id long, kind string, severity string, start_ms long, end_ms long, cue_ids array<int>, preview string"
