"""Rules as data: groups of (conditions, text), of which the first that holds speaks."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamstat.functions.numeric import at_least

Condition = tuple[str, str, float]  # input, comparison, threshold
Rule = tuple[Sequence[Condition], str]  # all conditions must hold; without any, always

COMPARE = {
    ">=": at_least,
    ">": operator.gt,
    "<": operator.lt,
    "<=": operator.le,
    "=": operator.eq,
}


def holds(conditions: Sequence[Condition], inputs: Mapping[str, Column]) -> Column:
    tests = [COMPARE[sign](inputs[name], threshold) for name, sign, threshold in conditions]
    return reduce(operator.and_, tests, F.lit(True))


def first_text(rules: Sequence[Rule], inputs: Mapping[str, Column]) -> Column:
    """The text of the first rule that holds, else null."""
    return F.coalesce(*[F.when(holds(conditions, inputs), text) for conditions, text in rules])
