"""Dense vectors of texts, images or both, from a pluggable encoder that runs on batches in the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("text", "image", "multimodal")
# The longest text, in tokens, that a multimodal encoder takes, and the query prefix of one text encoder.
MOST_TOKENS = 8192
PASSAGE_QUERY = "Represent this sentence for searching relevant passages: "


@dataclass(frozen=True)
class Encoder:
    """``load`` makes, once for each task, a function from a list of inputs to a matrix with a row for each.

    Inputs are texts, image paths, or dicts of both. ``truncate`` cuts a text to a number of tokens before the model sees
    it, so that no cut falls into an image's placeholders.
    """

    load: Callable[[], Callable[[list], np.ndarray]]
    batch: int = 32
    query_prefix: str = ""
    document_prefix: str = ""
    truncate: Callable[[str, int], str] | None = None
    most_tokens: int = MOST_TOKENS


def encoder_inputs(rows: DataFrame, key: str, text: Column | None = None, image: Column | None = None, mode: str = "text") -> DataFrame:
    """(id, text, image) for one of MODES; in those with images, a row without one raises when it is read."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    none = F.lit(None).cast("string")
    said = none if mode == "image" or text is None else F.coalesce(text, F.lit(""))
    missing = F.raise_error(F.concat(F.lit("no image for "), F.col(key).cast("string"))).cast("string")
    shown = none if mode == "text" or image is None else F.when(image.isNull(), missing).otherwise(image)
    return rows.select(F.col(key).alias("id"), said.alias("text"), shown.alias("image"))


def encode(inputs: DataFrame, encoder: Encoder, query: bool = False) -> DataFrame:
    """(id, v): vectors of unit length for rows of encoder_inputs; a vector of zeros stays one."""
    prefix = encoder.query_prefix if query else encoder.document_prefix

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder.load()
        for rows in batches:
            for at in range(0, len(rows), encoder.batch):
                part = rows.iloc[at : at + encoder.batch]
                items = []
                for t, i in zip(part["text"], part["image"]):
                    if t is not None:
                        t = prefix + (encoder.truncate(t, encoder.most_tokens) if encoder.truncate else t)
                    items.append(i if t is None else t if i is None else {"text": t, "image": i})
                v = np.asarray(model(items), np.float32)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "v": list(v / np.where(norm == 0, 1, norm))})

    return inputs.mapInPandas(run, f"id {dict(inputs.dtypes)['id']}, v array<float>")
