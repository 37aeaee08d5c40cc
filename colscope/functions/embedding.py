"""Text to vectors: any encoder behind one protocol, wrapped in an Arrow function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.errors import EncodingError


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class LetterCounts:
    """Counts of a to z: deterministic, and expressible in SQL."""

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], np.float64).reshape(len(texts), 26)


class TransformerMean:
    """Mean of a transformer's last states over the attended tokens, scaled to length one; needs torch and transformers."""

    def __init__(self, model: str = "paraphrase-multilingual-MiniLM-L12-v2", device: str = "auto", longest: int = 128, tokenizer=None, network=None):
        self.name, self.device, self.longest = model, device, longest
        self.tokenizer, self.network = tokenizer, network

    def load(self) -> None:
        if self.network is not None:
            return
        try:
            import torch
            from transformers import AutoModel, AutoTokenizer
        except ImportError as e:
            raise EncodingError("torch and transformers are needed for this encoder") from e
        if self.device == "auto":
            self.device = "cuda" if torch.cuda.is_available() else "mps" if torch.backends.mps.is_available() else "cpu"
        self.tokenizer = AutoTokenizer.from_pretrained(self.name)
        self.network = AutoModel.from_pretrained(self.name).to(self.device).eval()

    def unload(self) -> None:
        self.tokenizer = self.network = None

    def encode(self, texts: list[str], batch: int = 32) -> np.ndarray:
        if not texts:
            return np.zeros((0, 0), np.float32)
        self.load()
        out = []
        try:
            for i in range(0, len(texts), batch):
                tokens = self.tokenizer(texts[i : i + batch], padding=True, truncation=True, max_length=self.longest, return_tensors="pt")
                states = np.asarray(self.network(**tokens).last_hidden_state.detach().cpu())
                out.append(masked_mean(states, np.asarray(tokens["attention_mask"])))
        except EncodingError:
            raise
        except Exception as e:
            raise EncodingError(f"encoding failed: {e}") from e
        return np.concatenate(out).astype(np.float32)

    def encode_single(self, text: str) -> np.ndarray:
        return self.encode([text])[0]


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens that the mask keeps, as unit rows."""
    weight = mask[..., None].astype(np.float64)
    mean = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def encoder(make: Callable[[], Embedder]):
    """A column function from text to array<double>; the encoder is made once per worker."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for texts in batches:
            yield pd.Series(list(np.asarray(embedder.encode(texts.fillna("").tolist()), np.float64)))

    return encode


def encode_distinct(df: DataFrame, text: str, make: Callable[[], Embedder], out: str) -> DataFrame:
    """Rows with the vector of their text; each distinct text is encoded once."""
    vectors = df.select(text).distinct().withColumn(out, encoder(make)(F.col(text)))
    return df.join(vectors, text, "left")


def letter_counts(text: Column) -> Column:
    """The vector of ``LetterCounts`` without Python."""
    return F.array(*[(F.length(F.lower(text)) - F.length(F.replace(F.lower(text), F.lit(chr(97 + i)), F.lit("")))).cast("double") for i in range(26)])
