"""Entity subsets picked by predicted class, and the level-by-level run."""

from __future__ import annotations

import json
import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from roamlens.operators.label_model import LabelModel, argmax, fit_converged, predict_proba
from roamlens.operators.scope import KEY
from roamlens.operators.vote_stats import patterns
from roamlens.operators.votes import LF, class_ids, label_matrix
from roamlens.session import durable


def derive_entities(
    entities: DataFrame, preds: DataFrame | None = None, label_filter: dict | str | None = None,
    classes: list[int] = (), mode: str = "softmax", key: str = KEY, exclude: list[int] = (),
) -> DataFrame:
    """Entities of a parent set that pass a label filter.

    ``label_filter`` is {"labels": {"<class id>": {"min_confidence": x}}}, as a
    dict or JSON text. softmax: probability >= x (no x: every prediction that
    has the class); argmax: the class is the first maximum. Several classes
    are united. No filter passes everyone; unknown classes are skipped.
    ``exclude`` then takes out entities whose first maximum is one of these
    classes: a set of all but one class needs no list of the others.
    """
    if exclude and preds is not None:
        out = [list(classes).index(int(c)) for c in exclude if int(c) in classes]
        entities = entities.join(preds.where(argmax("probs").isin(out)).select(key), key, "left_anti")
    if isinstance(label_filter, str):
        label_filter = json.loads(label_filter)
    if preds is None or not label_filter or "labels" not in label_filter:
        return entities
    tests = []
    for class_id, rule in label_filter["labels"].items():
        if int(class_id) not in classes:
            continue
        i = list(classes).index(int(class_id))
        wanted = F.size("probs") > i
        if mode == "argmax":
            wanted = wanted & (argmax("probs") == i)
        elif isinstance(rule, dict) and rule.get("min_confidence") is not None:
            wanted = wanted & (F.get("probs", F.lit(i)) >= F.lit(float(rule["min_confidence"])))
        tests.append(wanted)
    passed = preds.where(reduce(operator.or_, tests) if tests else F.lit(False))
    return entities.join(passed.select(key), key, "left_semi")


@dataclass
class Level:
    """One classification level: LFs over metric tables of its entities.

    ``metrics(entities)`` gives [(metric table, LFs)]; ``filters`` names the
    entity subsets it produces, ``parent`` the subset it starts from.
    """

    name: str
    metrics: object
    filters: dict[str, dict | None]
    parent: str | None = None
    mode: str = "softmax"
    epochs: int = 100


@dataclass
class LevelResult:
    entities: DataFrame
    votes: DataFrame
    model: LabelModel
    preds: DataFrame
    classes: list[int]
    lfs: list[LF]
    subsets: dict[str, DataFrame] = field(default_factory=dict)


def run_level(entities: DataFrame, level: Level, key: str = KEY) -> LevelResult:
    """Votes, model, probabilities and subsets of one level."""
    sources = level.metrics(entities)
    lfs = [lf for _, group in sources for lf in group]
    classes = class_ids(lfs)
    votes = durable(label_matrix(entities, sources, key))
    model = fit_converged(patterns(votes), len(lfs), len(classes), level.epochs)
    preds = predict_proba(votes, model)
    result = LevelResult(entities, votes, model, preds, classes, lfs)
    everyone = votes.select(key)  # stored, so the next level does not replan this one
    for name, rule in level.filters.items():
        result.subsets[name] = derive_entities(everyone, preds, rule, classes, level.mode, key)
    return result


def run_hierarchy(entities: DataFrame, levels: list[Level], key: str = KEY) -> dict[str, LevelResult]:
    """Run levels in order; a level starts from a subset an earlier one made."""
    sets: dict[str, DataFrame] = {}
    results: dict[str, LevelResult] = {}
    for level in levels:
        if level.parent is not None and level.parent not in sets:
            raise ValueError(f"level '{level.name}' needs subset '{level.parent}', which no earlier level made")
        start = entities if level.parent is None else sets[level.parent]
        results[level.name] = run_level(start, level, key)
        sets |= results[level.name].subsets
    return results
