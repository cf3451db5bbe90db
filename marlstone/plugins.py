"""Interfaces of models and deterministic stand-ins. A model is built once per Python worker."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.bind import let
from .functions.text import tokens
from .functions.vector import l2_normalize


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


_factories: dict[tuple[str, str], Callable[[], object]] = {}
_made: dict[tuple[str, str], object] = {}


def register(kind: str, name: str, factory: Callable[[], object]) -> None:
    """kind: embedder, scorer or generator."""
    if kind not in ("embedder", "scorer", "generator"):
        raise ValueError(f"unknown kind of plugin: {kind}")
    _factories[kind, name] = factory


def get(kind: str, name: str):
    """The plugin, made once in this process."""
    if (kind, name) not in _factories:
        raise ValueError(f"no {kind} named {name}")
    if (kind, name) not in _made:
        _made[kind, name] = _factories[kind, name]()
    return _made[kind, name]


def embed(df: DataFrame, text_col: str, factory: Callable[[], Embedder], batch: int = 32, out: str = "embedding") -> DataFrame:
    """Adds a normalised vector per row, in batches, the model loaded once per worker; a vector of the wrong width is an error."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            made: list[list[float]] = []
            for k in range(0, len(texts), batch):
                made += model.embed([t or "" for t in texts.iloc[k:k + batch]])
            if any(len(v) != model.dimension for v in made):
                raise ValueError(f"expected vectors of width {model.dimension}")
            yield pd.Series(made, index=texts.index)

    # the model's output first: higher-order functions can't hold Python
    return df.withColumn(out, run(F.col(text_col))).withColumn(out, l2_normalize(F.col(out)).cast("array<float>"))


def generate(df: DataFrame, prompt_col: str, factory: Callable[[], Generator], batch: int = 8, out: str = "response") -> DataFrame:
    """Adds the model's response per row, in batches, the model made once per worker; a blank response is NULL."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            made: list[str] = []
            for k in range(0, len(prompts), batch):
                made += model.generate([p or "" for p in prompts.iloc[k:k + batch]])
            yield pd.Series([r if r and r.strip() else None for r in made], index=prompts.index)

    return df.withColumn(out, run(F.col(prompt_col)))


class Echo:
    """Stand-in generator: a JSON response that answers with the first line of the first source's text, at most 300 characters of it."""

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            source = re.search(r"\n\[SOURCE 1\] [^\n]*\n([^\n]*)", p)
            text = source[1][:300] if source else ""
            out.append(json.dumps({"short_answer": text, "classification": None, "reasoning": f"As source 1 says: {text}", "risk_flags": []}, ensure_ascii=False))
        return out


register("generator", "echo", Echo)


def hash_embedding(c: Column, bits: int = 4) -> Column:
    """Stand-in embedding: token counts in 2**bits buckets by the first hex digit(s) of the token's md5, at unit length."""
    if bits not in (4, 8):
        raise ValueError("bits must be 4 or 8")
    width = bits // 4
    # the buckets of all tokens as one text, a bar before each; what is left out of it when a bucket is taken away counts it
    marks = F.array_join(F.transform(tokens(c), lambda t: F.concat(F.lit("|"), F.substring(F.md5(t), 1, width))), "")
    count = lambda x, k: (F.length(x) - F.length(F.replace(x, F.lit(f"|{k:0{width}x}"), F.lit("")))) / F.lit(width + 1)
    counts = let(marks, lambda x: F.array(*(count(x, k).cast("double") for k in range(2 ** bits))))
    return l2_normalize(counts)
