"""Profiles and texts shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from attestra.functions.hashing import sha256_text

# Fixed values.
DEFAULT_EMBEDDING_MODEL = "bge-m3@1024-v1"
DEFAULT_SEED = 42


@dataclass(frozen=True)
class ProviderProfile:
    id: str
    name: str
    model_version: str
    replay_capability: str
    supports_seed: bool

    @property
    def config_hash(self) -> str:
        return sha256_text(self.model_version)

    @property
    def seed(self) -> int | None:
        return DEFAULT_SEED if self.supports_seed else None


@dataclass(frozen=True)
class PromptTemplate:
    id: str
    version: str
    body: str

    @property
    def sha256(self) -> str:
        return sha256_text(f"{self.id}:{self.version}")


# The German instruction text asks for one marker per statement and a refusal
# where evidence is missing; the operator messages are shown as they are.
PROMPT_BODY = "\n".join(
    (
        "Beantworte nur mit belegten Aussagen.",
        "Jede Aussage muss mindestens eine Markierung im Format [chunk:<chunk_id>] enthalten.",
        "Wenn die Evidenz nicht reicht, verweigere die Antwort.",
    )
)
MESSAGE_ANSWERED = "Die Antwort wurde mit belegten Aussagen erstellt."
MESSAGE_REFUSED = "Keine ausreichend relevante Evidenz im Korpus gefunden."
MESSAGE_BLOCKED = "Die generierte Antwort wurde wegen fehlender Zitate blockiert."

DEFAULT_PROMPT = PromptTemplate("cited-answer", "1.0.0", PROMPT_BODY)
EXTRACTIVE_PROFILE = ProviderProfile(
    "deterministic-extractive",
    "Deterministic Extractive Answerer",
    "deterministic-extractive@1.0.0",
    "bit_equal",
    True,
)
