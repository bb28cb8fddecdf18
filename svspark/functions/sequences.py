"""Edit distances by bit-parallel columns and longest common subsequences, as Arrow-batched functions: they have no built-in form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def last_row(pattern: str, text: str, anywhere: bool) -> list[int]:
    """Edit distance of the pattern to text[:j] for every j; ``anywhere``: to the best substring that ends at j."""
    m, masks = len(pattern), _masks(pattern)
    full = (1 << m) - 1
    up, down, score = full, 0, m
    row = [m]
    for j, c in enumerate(text, 1):
        if not m:
            row.append(0 if anywhere else j)
            continue
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        gain, loss = (down | ~(diagonal | up)) & full, up & diagonal
        score += (gain >> (m - 1) & 1) - (loss >> (m - 1) & 1)
        gain, loss = (gain << 1 | (not anywhere)) & full, loss << 1 & full
        up, down = (loss | ~((eq | down) | gain)) & full, gain & (eq | down)
        row.append(score)
    return row


def infix(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the substring of text nearest to the pattern: the first best end, and the shortest such substring."""
    row = last_row(pattern, text, True)
    best = min(row)
    end = row.index(best)
    back = last_row(pattern[::-1], text[:end][::-1], False)
    return best, end - back.index(best), end


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks, rows = _masks(a), (1 << len(a)) - 1
    state = rows
    for c in b:
        hit = state & masks.get(c, 0)
        state = (state + hit | state - hit) & rows
    return len(a) - state.bit_count()


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("distance", "lo", "hi")]))
def infix_distance(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
    """infix form; null where either text is."""
    got = [infix(p, t) if p is not None and t is not None else (None,) * 3 for p, t in zip(pattern, text)]
    return pd.DataFrame(got, columns=["distance", "lo", "hi"]).astype("Int64")


@F.pandas_udf(T.LongType())
def prefix_distance(pattern: pd.Series, text: pd.Series) -> pd.Series:
    """least distance of the pattern to a beginning of the text."""
    return pd.Series([min(last_row(p, t, False)) if p is not None and t is not None else None for p, t in zip(pattern, text)], dtype="Int64")


@F.pandas_udf(T.LongType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """F8."""
    return pd.Series([common_length(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int64")
