"""An embedding service over HTTP, as the callable that the embedding operators take."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

# Limits in seconds.
AVAILABLE_S, EMBED_S = 2.0, 15.0


@dataclass(frozen=True)
class HttpEmbedder:
    """`url` answers GET /api/tags when it is up, and POST /api/embeddings {model, prompt} with {embedding}.

    Called with a text it gives the vector, or null on any failure; it is sent to workers as it is.
    """

    url: str
    model: str

    def available(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=AVAILABLE_S) as answer:
                return 200 <= answer.status < 300
        except (OSError, ValueError):
            return False

    def __call__(self, text: str) -> list[float] | None:
        body = json.dumps({"model": self.model, "prompt": text}).encode()
        try:
            asked = urllib.request.Request(f"{self.url}/api/embeddings", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(asked, timeout=EMBED_S) as answer:
                got = json.load(answer).get("embedding")
            return None if got is None else [float(x) for x in got]
        except (OSError, ValueError, TypeError, AttributeError):
            return None
