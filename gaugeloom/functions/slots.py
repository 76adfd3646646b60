"""Places for callers' own functions: similarities, evaluators, runners, embedders.

They get Arrow batches as pandas data, never single rows; defaults are Spark functions or, for embedders, derived from hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import pair_similarity

EVALS: dict[str, Callable[[pd.Series, pd.Series], pd.Series]] = {}


def register_eval(name: str):
    """Names an evaluator of (inputs, outputs); its scores are held within 0 and 1."""

    def add(f):
        EVALS[name] = f
        return f

    return add


def custom_eval(name: str, given: Column, output: Column) -> Column:
    f = EVALS[name]

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return f(a, b).astype(float).clip(0, 1)

    return run(given, output)


def similarity(f: Callable[[pd.Series, pd.Series], pd.Series], a: Column, b: Column) -> Column:
    """A caller's similarity of two columns, within 0 and 1."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return f(x, y).astype(float).clip(0, 1)

    return run(a, b)


Similarity = Callable[[pd.Series, pd.Series], pd.Series]


def _some(f: Similarity, a: pd.Series, b: pd.Series) -> pd.Series:
    """f's similarities within 0 and 1; where it fails for the whole batch, row by row, missing where it fails there."""
    def clean(x: pd.Series) -> pd.Series:
        return pd.to_numeric(x, errors="coerce").astype(float).clip(0, 1)

    try:
        made = clean(pd.Series(f(a, b)))
        if len(made) != len(a):
            raise ValueError("as many similarities as rows are wanted")
        return made.set_axis(a.index)
    except Exception:
        if len(a) == 1:
            return pd.Series([np.nan], index=a.index)
    return pd.concat([_some(f, a.iloc[i : i + 1], b.iloc[i : i + 1]) for i in range(len(a))])


def by_embedding(f: Callable[[pd.Series], pd.Series]) -> Similarity:
    """Cosine of an embedder's vectors; missing where one has no length."""
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        def cosine(x, y) -> float:
            size = float(np.linalg.norm(x) * np.linalg.norm(y))
            return float(np.dot(x, y)) / size if size > 0 else np.nan

        return pd.Series([cosine(x, y) for x, y in zip(f(a), f(b), strict=True)])

    return similarity


def similarity_chain(df: DataFrame, a: str, b: str, caller: Similarity | None = None, engine: Similarity | None = None, embedder: Callable[[pd.Series], pd.Series] | None = None, out: str = "similarity") -> DataFrame:
    """df with `out` and `<out>_by`: of the caller's function, else the engine's, else the embedder's cosine, else TF-IDF in Spark's own functions (`tfidf`).

    A function that fails, or gives nothing, for some rows leaves those rows alone to the next; without any, no Python runs.  A null text has no tokens, and
    goes to TF-IDF at once."""
    steps = [(name, f) for name, f in (("caller", caller), ("engine", engine), ("embedding", by_embedding(embedder) if embedder else None)) if f]
    native = pair_similarity(F.col(a), F.col(b))
    if not steps:
        return df.withColumns({out: native, f"{out}_by": F.lit("tfidf")})
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            found, by = pd.Series(np.nan, index=batch.index), pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for name, f in steps:
                left = batch.index[found.isna() & batch[a].notna() & batch[b].notna()]
                if len(left):
                    made = _some(f, batch.loc[left, a], batch.loc[left, b])
                    found.loc[left] = made
                    by.loc[made.index[made.notna()]] = name
            yield batch.assign(**{"_made": found, "_by": by})

    made = df.mapInPandas(run, f"{kinds}, _made double, _by string").withColumn("_made", F.when(F.isnan("_made"), F.lit(None)).otherwise(F.col("_made")))
    return made.withColumns({out: F.when(F.col("_made").isNull(), native).otherwise(F.col("_made")), f"{out}_by": F.coalesce("_by", F.lit("tfidf"))}).drop("_made", "_by")


def hashed_embedding(texts: pd.Series, size: int = 64) -> pd.Series:
    """Vectors of length 1 that depend on the text alone, alike on every worker."""
    import hashlib

    def one(t: str | None) -> np.ndarray:
        v = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little"))).standard_normal(size)
        return v / np.linalg.norm(v)

    return texts.map(one)


def embed(text: Column, f: Callable[[pd.Series], pd.Series] = hashed_embedding) -> Column:
    """array<double>; f may load its model when it is first called on a worker."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield f(batch)

    return run(text)


def run_agent(df: DataFrame, prompt: str, f: Callable[[pd.Series], pd.Series], runs: int = 1, out: str = "output") -> DataFrame:
    """df with each row `runs` times, run_idx from 0, and the agent's output for its prompt."""
    each = df.withColumn("run_idx", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in each.schema)

    def run(batches):
        for batch in batches:
            yield batch.assign(**{out: f(batch[prompt])})

    return each.mapInPandas(run, f"{schema}, `{out}` string")
