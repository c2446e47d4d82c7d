"""Model-backed encoders and rerankers, loaded in the workers that use them.

The model libraries are optional: without them these names can be registered and configured,
and only their first use fails.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Characters of a passage that a listwise model reads.
PASSAGE = 2048


class SentenceEncoder:
    def __init__(self, model: str, prompt: str, adapter: str | None, batch: int):
        from sentence_transformers import SentenceTransformer

        self.prompt, self.batch = prompt, batch
        self.model = SentenceTransformer(model)
        if adapter:
            self.model.load_adapter(adapter)

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.encode(texts, batch_size=self.batch, normalize_embeddings=True), np.float32)


def sentence_encoder(model: str, prompt: str, adapter: str | None, batch: int) -> Callable[[], SentenceEncoder]:
    return lambda: SentenceEncoder(model, prompt, adapter, batch)


class PairModel:
    """Scores of (claim, document) pairs by a cross-encoder."""

    def __init__(self, model: str, max_length: int):
        from sentence_transformers import CrossEncoder

        self.model = CrossEncoder(model, max_length=max_length)

    def score(self, claims: list[str], documents: list[str]) -> list[float]:
        return [float(s) for s in self.model.predict(list(zip(claims, documents, strict=True)))]


class ListwiseModel:
    """Scores of all candidates of a claim at once."""

    def __init__(self, model: str):
        from transformers import AutoModel

        self.model = AutoModel.from_pretrained(model, trust_remote_code=True).eval()

    def rank(self, claim: str, documents: list[str]) -> list[tuple[int, float]]:
        return [(int(r["index"]), float(r["relevance_score"])) for r in self.model.rerank(claim, documents)]
