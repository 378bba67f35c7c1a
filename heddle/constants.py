"""Values that results depend on."""

# Enumerations and words that classify, as the source formats and metrics define them.
AUTOMATED_ORIGINS = ("exec", "cron", "subagent")
ORIGINS = ("interactive", "exec", "cron", "subagent", "unknown")
FAILED_STATUSES = ("error", "failed", "failure", "fail")
OK_STATUSES = ("success", "succeeded", "ok", "completed", "complete", "passed")
SUCCESS_MARKERS = ("done", "complete", "completed", "fixed", "passing", "resolved", "implemented")
FAILURE_MARKERS = ("error", "failed", "cannot", "unable", "blocked", "not working")
MEMORY_KINDS = ("fact", "decision", "todo", "snippet", "link", "lesson", "note")
MEMORY_STATUSES = ("candidate", "confirmed", "rejected")
CONTEXT_KINDS = ("lesson", "decision", "fact", "link")
RETIRED_MARKERS = ("OBSOLETE", "SUPERSEDED", "RETIRED")

# Limits and thresholds.
RRF_K, FUSION_WINDOW = 60, 200
SESSION_CUTOFF, MESSAGE_CUTOFF, RECALL_FLOOR, DUPLICATE_FLOOR = 0.88, 0.72, 0.60, 0.85
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
PRIOR_VOTES, PRIOR_WEIGHT = 3, 0.5
TOOL_EVENTS, REASONING_CHARS, SESSION_REASONING_CHARS = 50, 20_000, 200_000
CHUNK_CHARS, TOOL_RUN = 12_000, 5
RULE_CHARS, RULES = (20, 180), 30
MESSAGE_CAP, EXCERPT_CHARS, CANDIDATE_SESSIONS = 100, 400, 50
