"""Where models and other Python callables plug in: tokenizers, generators, translators, encoders, classifiers."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Texts = Callable[[list[str]], list]


def memoised_apply(df: DataFrame, column: str, function: Texts, output: str, kind: str = "string") -> DataFrame:
    """function over the distinct texts of a column, joined back: an expensive model sees each text once. Nulls stay null."""
    distinct = df.select(F.col(column).alias("_text")).filter("_text IS NOT NULL").distinct()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{output: function(batch["_text"].tolist())})

    done = distinct.mapInPandas(rows, f"_text string, {output} {kind}")
    return df.join(done, df[column] == done["_text"], "left").drop("_text")


def classify(df: DataFrame, column: str, function: Texts) -> DataFrame:
    """yes/no labels of a model that takes a batch of texts."""
    return memoised_apply(df, column, function, "label")


def embed(df: DataFrame, column: str, function: Texts) -> DataFrame:
    """Vectors of a model that takes a batch of texts."""
    return memoised_apply(df, column, function, "vector", "array<float>")


def generate(df: DataFrame, prompt: str, function: Texts) -> DataFrame:
    """Responses of a model; every row gets its own, as sampling may differ."""

    @F.pandas_udf("string")
    def answered(prompts: pd.Series) -> pd.Series:
        return pd.Series(function(prompts.tolist()))

    return df.withColumn("response", answered(F.col(prompt)))


def token_count(df: DataFrame, column: str, tokenizer: Texts, output: str = "n_tokens") -> DataFrame:
    """Lengths by a tokenizer that gives a list of ids for each text."""
    return memoised_apply(df, column, lambda texts: [len(ids) for ids in tokenizer(texts)], output, "int")


_STEPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def value_of(expression: str, variables: dict[str, float] | None = None) -> float | None:
    """The value of an arithmetic expression over named variables; None if it is none."""

    def walk(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return float(node.value)
        if isinstance(node, ast.Name) and variables and node.id in variables:
            return variables[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _STEPS:
            a, b = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Pow) and abs(b) > 64:
                raise ValueError("exponent")
            return _STEPS[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _STEPS:
            return _STEPS[type(node.op)](walk(node.operand))
        raise ValueError("no arithmetic")

    try:
        return walk(ast.parse(expression.replace("^", "**").replace(",", "."), mode="eval").body)
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


def same_value(reference: Column, generated: Column) -> Column:
    """yes if both are expressions that agree at two points of their variables; null if one is no expression, for the next comparison to decide."""

    @F.pandas_udf("string")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        points = [dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 0.7) | {"v": 31.0, "s": 17.0}, dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 2.3) | {"v": 53.0, "s": 5.0}]
        out = []
        for x, y in zip(a, b):
            values = [(value_of(x or "", p), value_of(y or "", p)) for p in points]
            known = all(p is not None and q is not None for p, q in values)
            out.append(("yes" if all(abs(p - q) < 1e-9 * max(1, abs(p)) for p, q in values) else "no") if known else None)
        return pd.Series(out, dtype="object")

    return compared(reference, generated)


def reduced(rows: DataFrame, reducer: Callable, id_column: str = "id", vector: str = "v") -> DataFrame:
    """(id, x, y): vectors brought to two dimensions by a reducer from outside, a function of a matrix that returns one of two columns.

    Reducers such as t-SNE place all points at once, so a stated set of points goes to one call, here to one for each task of the plan;
    callers of such reducers hand over one partition.
    """
    import numpy as np

    def each(batches):
        for frame in batches:
            places = np.asarray(reducer(np.stack(frame[vector].to_list()).astype(float))) if len(frame) else np.empty((0, 2))
            yield frame[[id_column]].assign(x=places[:, 0], y=places[:, 1])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, vector).mapInPandas(each, f"{id_column} {kind}, x double, y double")
