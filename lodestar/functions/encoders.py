"""Encoders of text: pooling of token states, and a column function over any encoder, one per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefixes and pooling that the public models were trained with (fixed values).
MODELS = {"multilingual-e5-small": ("query: ", "passage: ", "mean"), "bge-m3": ("", "", "first")}


def pool(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Token states (texts, tokens, size) -> unit vectors: the mean over a text's tokens, or its first token."""
    if how == "first":
        vectors = states[:, 0]
    else:
        weight = mask[:, :, None].astype(states.dtype)
        vectors = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


@cache
def onnx_encoder(folder: str, how: str, most_tokens: int) -> Callable[[Sequence[str]], np.ndarray]:
    """An encoder from a folder with model.onnx and tokenizer.json; raises if they are not there."""
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(Path(folder) / "tokenizer.json"))
    tokenizer.enable_truncation(most_tokens)
    tokenizer.enable_padding()
    session = onnxruntime.InferenceSession(str(Path(folder) / "model.onnx"))
    wanted = {i.name for i in session.get_inputs()}

    def encode(texts: Sequence[str]) -> np.ndarray:
        rows = tokenizer.encode_batch(list(texts))
        ids, mask = np.array([r.ids for r in rows], dtype=np.int64), np.array([r.attention_mask for r in rows], dtype=np.int64)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return pool(session.run(None, {k: v for k, v in feed.items() if k in wanted})[0], mask, how)

    return encode


def embedding(make: Callable[[], Callable[[Sequence[str]], np.ndarray]], prefix: str = "", at_once: int = 16):
    """A column function; ``make`` gives each worker its encoder. Texts are encoded ``at_once`` at a time."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        encode = make()
        rows = [prefix + (t or "") for t in texts]
        vectors = [v for k in range(0, len(rows), at_once) for v in encode(rows[k : k + at_once])]
        return pd.Series([v.astype(np.float32) for v in vectors], index=texts.index, dtype=object)

    return embed
