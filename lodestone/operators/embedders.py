"""Embedders that a configuration names: a model in a local folder, or a hosted one."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

#: Dimensions that vectors of a known local model are shortened to, and what its inputs begin with: documents, queries.
LOCAL = {"nomic-ai/nomic-embed-text-v1.5": (512, "search_document: ", "search_query: ")}
HOSTED = {"gemini-embedding-001": 3072}
ENDPOINT = "https://generativelanguage.googleapis.com/v1beta"


class Unavailable(RuntimeError):
    """The embedder can't be had here; an index then does without vectors."""


def unit(vector: Sequence[float], dimensions: int) -> list[float]:
    """The first dimensions at length 1; a vector of length 0 stays as it is."""
    cut = [float(x) for x in vector[:dimensions]]
    size = sum(x * x for x in cut) ** 0.5
    return [x / size for x in cut] if size else cut


@dataclass
class LocalEmbedder:
    """An ONNX model and its tokenizer in a folder. Each worker loads them once; token vectors are averaged, at length 1, then shortened."""

    folder: str
    name: str
    dimensions: int
    document: str = ""
    asked: str = ""
    batch: int = 32
    longest: int = 8192
    _loaded: tuple | None = field(default=None, repr=False, compare=False)

    @property
    def id(self) -> str:
        return f"local:{self.name}"

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def _model(self) -> tuple:
        if self._loaded is None:
            try:
                import onnxruntime
                from tokenizers import Tokenizer

                tokenizer = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
                tokenizer.enable_truncation(self.longest)
                tokenizer.enable_padding()
                session = onnxruntime.InferenceSession(f"{self.folder}/model.onnx", providers=["CPUExecutionProvider"])
            except Exception as e:
                raise Unavailable(f"the model in {self.folder} can't be loaded: {e}") from e
            self._loaded = tokenizer, session
        return self._loaded

    def _embed(self, texts: Sequence[str]) -> list[list[float]]:
        import numpy as np

        tokenizer, session = self._model()
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for at in (order[i : i + self.batch] for i in range(0, len(order), self.batch)):
            coded = tokenizer.encode_batch([texts[i] for i in at])
            mask = np.array([c.attention_mask for c in coded], np.int64)
            given = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            states = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0]
            mean = (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]
            for i, v in zip(at, mean):
                out[i] = unit(unit(v.tolist(), len(v)), self.dimensions)
        return out

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return self._embed([self.document + t for t in texts])

    def embed_query(self, text: str) -> list[float]:
        return self._embed([self.asked + text])[0]


@dataclass
class HostedEmbedder:
    """A model behind the batch interface of a hosted service; documents and queries are told apart."""

    name: str
    dimensions: int
    key: str = field(repr=False)
    endpoint: str = ENDPOINT
    batch: int = 100

    @property
    def id(self) -> str:
        return f"gemini:{self.name}"

    def _embed(self, texts: Sequence[str], task: str) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            body = {"requests": [{"model": f"models/{self.name}", "content": {"parts": [{"text": t}]}, "embedContentConfig": {"taskType": task}} for t in texts[i : i + self.batch]]}
            asked = urllib.request.Request(f"{self.endpoint}/models/{self.name}:batchEmbedContents", json.dumps(body).encode(), {"content-type": "application/json", "x-goog-api-key": self.key})
            with urllib.request.urlopen(asked, timeout=120) as answer:
                got = [e["values"] for e in json.load(answer)["embeddings"]]
            if len(got) != len(texts[i : i + self.batch]):
                raise ValueError(f"{self.id} gave {len(got)} vectors for {len(texts[i : i + self.batch])} texts")
            out += got
        return out

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return self._embed(texts, "RETRIEVAL_DOCUMENT")

    def embed_query(self, text: str) -> list[float]:
        return self._embed([text], "RETRIEVAL_QUERY")[0]


def described(embedding: dict) -> tuple[str, int]:
    """(id, dimensions) of what create() would give, without loading anything."""
    if embedding["provider"] == "gemini":
        name = embedding.get("model", "gemini-embedding-001")
        return f"gemini:{name}", HOSTED.get(name, 3072)
    name = embedding.get("model", next(iter(LOCAL)))
    return f"local:{name}", int(embedding.get("dimensions", LOCAL.get(name, (0,))[0]))


def create(embedding: dict) -> LocalEmbedder | HostedEmbedder:
    """The embedder of a configuration's block: provider "local" (model, folder, dimensions) or "gemini" (model, apiKeyEnv, endpoint)."""
    id_, dimensions = described(embedding)
    name = id_.partition(":")[2]
    if embedding["provider"] == "gemini":
        variable = embedding.get("apiKeyEnv", "GEMINI_API_KEY")
        key = os.environ.get(variable) or os.environ.get("GEMINI_API_KEY")
        if not key:
            raise Unavailable(f"a hosted embedder needs a key in {variable}")
        return HostedEmbedder(name, dimensions, key, embedding.get("endpoint", ENDPOINT))
    if not dimensions:
        raise ValueError(f"unknown local model {name}: give its dimensions")
    folder = Path(embedding.get("folder") or Path(os.environ.get("LODESTONE_MODELS", Path.home() / ".cache/lodestone")) / name)
    if not all((folder / f).is_file() for f in ("model.onnx", "tokenizer.json")):
        raise Unavailable(f"no model.onnx and tokenizer.json in {folder}")
    _, document, asked = LOCAL.get(name, (0, "", ""))
    return LocalEmbedder(str(folder), name, dimensions, document, asked)
