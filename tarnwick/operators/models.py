"""Model hooks: embedder, reranker, generator. Each is a callable on columns; the stand-ins here are deterministic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.text import tokenize


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Stand-in embedder: signed counts of hashed tokens, of unit length (zeros for a text without tokens)."""
    h = F.transform(tokenize(text), lambda t: F.xxhash64(t))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.aggregate(F.filter(h, lambda x: F.pmod(x, F.lit(dims)) == k), F.lit(0.0), lambda a, x: a + F.when(x % 2 == 0, 1.0).otherwise(-1.0)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in reranker: share of the query's distinct tokens that the text has, on -5 to 5."""
    own, other = F.array_distinct(tokenize(query)), F.array_distinct(tokenize(text))
    return F.round(10 * F.size(F.array_intersect(own, other)) / F.greatest(F.size(own), F.lit(1)) - 5, 6)


def query_text(q: Column, model: str, instruction: str = "Represent this sentence for searching relevant passages: ") -> Column:
    """Queries of models of the bge family begin with an instruction."""
    return F.concat(F.lit(instruction), q) if "bge" in model.lower() else q


def batched(load: Callable[[], Callable[[list[str]], list]], result: str):
    """A column function from a model: load() runs once a Python worker, its result once an Arrow batch."""

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series(model(s.fillna("").tolist()), index=s.index)

    apply.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(apply, result)


def generate(prompts: DataFrame, load: Callable[[], Callable[[str], str]], column: str = "prompt") -> DataFrame:
    """Adds `answer` and `error` (null where all went well): a failed call is a row of the error side, not a lost one."""

    def apply(batches):
        model = load()
        for pdf in batches:
            answers, errors = [], []
            for p in pdf[column]:
                try:
                    answers.append(model(p))
                    errors.append(None)
                except Exception as e:  # the hook may raise anything; the row keeps the reason
                    answers.append(None)
                    errors.append(str(e))
            yield pdf.assign(answer=answers, error=errors)

    from pyspark.sql import types as T

    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    return prompts.mapInPandas(apply, schema)


#: Own prompts by source and generation: what to use, how to cite, what not to do.
PROMPTS = {
    ("3gpp", 1): "You answer questions about specifications.\nUse the passages alone and name the clause that each statement comes from.\n\nPassages:\n{evidence}\n\nQuestion: {query}\n\nAnswer:",
    ("hedex", 1): "You answer questions about parameters of network elements.\nUse the passages alone. Give each parameter's name, object, default and range where they stand there.\n\nPassages:\n{evidence}\n\nQuestion: {query}\n\nAnswer:",
    ("3gpp", 2): "You answer questions about specifications.\nUse the numbered evidence alone. After each statement put the mark of its evidence, such as [E1], and cite clauses only as they stand there, word for word. Say so if the evidence does not answer.\n\nEvidence:\n{evidence}\n\nQuestion: {query}\n\nAnswer:",
    ("hedex", 2): "You answer questions about parameters of network elements.\nUse the numbered evidence alone. For each parameter give name, object path, default, range and unit as they stand there, with the mark of the evidence, such as [E1]. Leave out what it does not say.\n\nEvidence:\n{evidence}\n\nQuestion: {query}\n\nAnswer:",
}
#: Own prompt for any other corpus.
PROMPT = "You answer questions about one {kind} corpus.\nUse the evidence alone. Cite only references that stand in it, word for word. Say so if it does not answer.\n\nEvidence:\n{evidence}\n\nQuestion: {query}\n\nAnswer:"


def prompt(kind: Column, query: Column, evidence: Column, generation: int | None = None) -> Column:
    """The prompt of `kind` ("3gpp" or "hedex") and generation; the general one for other kinds or without a generation."""
    out = F.lit(PROMPT)
    for (name, of), text in PROMPTS.items():
        if of == generation:
            out = F.when(kind == name, F.lit(text)).otherwise(out)
    for name, c in (("kind", kind), ("query", query), ("evidence", evidence)):
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out
