"""Heap numbering of tree nodes: the root is 1, the children of i are 2i and 2i+1.

Every function takes a Python int or a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left(node):
    return node * 2


def right(node):
    return node * 2 + 1


def parent(node):
    return F.shiftright(node, 1) if isinstance(node, Column) else node >> 1


def level(node):
    """Depth of a node, the root being level 0."""
    if isinstance(node, Column):
        # The length of the binary text is exact where a floating logarithm may round.
        return F.length(F.bin(node)) - 1
    return node.bit_length() - 1


def is_left(node):
    return node % 2 == 0


def first_at(depth: int) -> int:
    return 1 << depth


def max_at(depth: int) -> int:
    return 1 << depth


def ancestor(node, target_level):
    """The node on the path to ``node`` at ``target_level`` (the node itself when it is shallower)."""
    if isinstance(node, Column):
        lift = F.greatest(level(node) - target_level, F.lit(0))
        return F.floor(node / F.pow(F.lit(2.0), lift)).cast("bigint")
    return node >> max(level(node) - target_level, 0)


def path(node: int) -> list[int]:
    """Node ids from the root down to ``node``."""
    return [node >> k for k in range(level(node), -1, -1)]
