"""An embedding service over HTTP: what it is, vectors of texts, token counts.

Wire format (fixed values): GET /handshake; POST /embed with `inputs` and `kind` (query or passage), answered with `dense`
and `sparse` (indices and values) per input; POST /tokenize with `inputs`, answered with `counts`.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any
from urllib.error import HTTPError
from urllib.parse import urlparse
from urllib.request import Request, urlopen

from noteloom.schemas import EmbedderMismatch, Handshake

__all__ = ["EmbedderMismatch", "Refused", "Service", "ServiceError"]

#: Other names of precisions.
PRECISIONS = {"float32": "fp32", "float16": "fp16", "bfloat16": "bf16"}
KINDS = ("query", "passage")


class ServiceError(OSError):
    """The embedder answered with a failure of its own; asking again may help."""


class Refused(ValueError):
    """The embedder refused a request, or its answer does not fit it; asking again changes nothing."""


@dataclass(frozen=True)
class Service:
    endpoint: str
    timeout: float = 60.0
    attempts: int = 3
    delay: float = 0.5

    def __post_init__(self) -> None:
        parts = urlparse(self.endpoint)
        if parts.scheme not in ("http", "https") or not parts.netloc:
            raise ValueError(f"the embedder's address {self.endpoint!r} is no http(s) address with a host")

    def _call(self, path: str, data: dict[str, Any] | None = None) -> dict[str, Any]:
        body = None if data is None else json.dumps(data).encode()
        request = Request(self.endpoint.rstrip("/") + path, body, {"Content-Type": "application/json"})
        try:
            with urlopen(request, timeout=self.timeout) as answer:  # noqa: S310 - http(s) only, see above
                return json.load(answer)
        except HTTPError as e:
            if e.code >= 500:
                raise ServiceError(f"the embedder answered {e.code} to {path}") from e
            raise Refused(f"the embedder refused {path}: {e.code} {e.read(300).decode(errors='replace')}") from e

    def handshake(self) -> Handshake:
        """The seven settings, in the words that an index uses; one that is absent is empty and so matches nothing."""
        said = self._call("/handshake")
        normalized = said.get("normalized")
        sparse = ",".join(f"{k}={v}" for k, v in sorted((said.get("sparse") or {}).items()))
        precision = said.get("precision", "")
        return Handshake(
            said.get("model_revision", ""), said.get("tokenizer_revision", ""), int(said.get("dense_dim", 0)),
            "" if normalized is None else "l2" if normalized else "none", said.get("pooling", ""), PRECISIONS.get(precision, precision), sparse,
        )

    def embed(self, texts: Sequence[str], kind: str) -> list[tuple[list[float], dict[int, float]]]:
        """A dense vector and sparse weights of each text."""
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        said = self._call("/embed", {"inputs": list(texts), "kind": kind})
        dense, sparse = said.get("dense") or [], said.get("sparse") or []
        if not len(dense) == len(sparse) == len(texts):
            raise Refused(f"the embedder returned {len(dense)} dense and {len(sparse)} sparse vectors for {len(texts)} texts")
        if any(len(s["indices"]) != len(s["values"]) for s in sparse):
            raise Refused("the embedder returned a sparse vector with indices and values of different length")
        return [(list(map(float, d)), dict(zip(map(int, s["indices"]), map(float, s["values"]), strict=True))) for d, s in zip(dense, sparse, strict=True)]

    def count(self, texts: Sequence[str]) -> list[int]:
        """Tokens of each text; tried a few times, since a run waits for it."""
        for last in range(self.attempts):
            try:
                counts = self._call("/tokenize", {"inputs": list(texts)})["counts"]
                break
            except OSError:
                if last == self.attempts - 1:
                    raise
                time.sleep(self.delay)
        if len(counts) != len(texts):
            raise Refused(f"the embedder counted {len(counts)} of {len(texts)} texts")
        return [int(c) for c in counts]
