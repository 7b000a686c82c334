"""Schemas of the tables."""

from __future__ import annotations

SCHEMA_VERSION = 5

DIALOGS = "id long, kind string, access_hash long, title string, username string, archived boolean, msg_count long"
MESSAGES = (
    "dialog_id long, msg_id int, date long, from_id long, outgoing boolean, reply_to int, grouped_id long, "
    "fwd_from string, media_type string, file_path string, text string, protected boolean"
)
RULES = "axis string, rule_id string, weight double, kind string, pattern string"
HITS = "dialog_id long, msg_id int, axis string, rule_id string, term string, surface string, layer string, tier string, priority double, protected boolean"
TRANSCRIPTS = "dialog_id long, msg_id int, text string, model string"
TRIAGE_RUNS = (
    "dialog_id long, window_from int, window_to int, model string, prompt_id string, raw string, "
    "prompt_tokens long, completion_tokens long, cost double, passes int, created_at long"
)
PLAN = "dialog_id long, msg_id int, reason string, axis string, confidence double, approved boolean"
DELETIONS = "dialog_id long, msg_id int, batch_id string, state string, attempted_at long, error string"

#: Keys by which a later row takes an earlier one's place.
KEYS = {
    "dialogs": ["id"],
    "messages": ["dialog_id", "msg_id"],
    "hits": ["dialog_id", "msg_id", "rule_id", "term"],
    "transcripts": ["dialog_id", "msg_id"],
    "triage_runs": ["dialog_id", "window_from", "window_to", "model", "prompt_id"],
    "plan": ["dialog_id", "msg_id"],
    "deletions": ["dialog_id", "msg_id"],
}
ALL = {"dialogs": DIALOGS, "messages": MESSAGES, "hits": HITS, "transcripts": TRANSCRIPTS, "triage_runs": TRIAGE_RUNS, "plan": PLAN, "deletions": DELETIONS}
