"""Values the registered queries and their SQL share."""

from __future__ import annotations

from attestra.functions import hashing

SNAPSHOT_ID = "snap_live"
SNAPSHOT_HASH = hashing.sha256_text("snap_live")
SERVED_DIMENSION = 64
SINCE, UNTIL = "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z"
ALLOWED_HOSTS = ["thther.example.org", "blog.tionsh.example.net", "blog.ththan.example.net"]

# Event types as ledger entry type and outcome.
ENTRY_TYPES = {
    "view": ("query.answered", "answered"),
    "click": ("replay.passed", "replay-success"),
    "error": ("query.refused_out_of_corpus", "refused-out-of-corpus"),
    "signup": ("operator.login.success", "operator-login-success"),
    "purchase": ("query.blocked_uncited", "blocked-uncited"),
}
