"""Named steps over a corpus, run in order, with failures as data.

A corpus is a dict of tables keyed by ``func_id``. A step gives back the corpus and, optionally, a table ``(func_id, reason)`` of the
functions it cannot handle: these keep the step as their ``failure_origin`` and no later step sees them; all others go on.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tributary.fixpoint import GROUP
from tributary.tables import keep

Corpus = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Corpus], tuple[Corpus, DataFrame | None]]
    needs: tuple[str, ...] = ()


def choose(names: Sequence[str], known: Mapping[str, Stage]) -> list[Stage]:
    """The stages of these names, unknown ones left out with a warning; fails before any job if one comes before what it needs."""
    chosen: list[Stage] = []
    for name in names:
        if name not in known:
            warnings.warn(f"no stage named {name}", stacklevel=2)
            continue
        missing = set(known[name].needs) - {s.name for s in chosen}
        if missing:
            raise ValueError(f"stage {name} needs {', '.join(sorted(missing))} before it")
        chosen.append(known[name])
    return chosen


def run_stages(corpus: Corpus, functions: DataFrame, stages: Sequence[Stage]) -> tuple[Corpus, DataFrame]:
    """(corpus of the functions that went through, functions with ``failure_origin`` and ``reason``, null if none)."""
    failed: DataFrame | None = None
    for stage in stages:
        corpus, bad = stage.run(corpus)
        if bad is None:
            continue
        bad = keep(bad.groupBy(GROUP).agg(F.min("reason").alias("reason")).withColumn("failure_origin", F.lit(stage.name)))
        corpus = {name: df.join(bad, GROUP, "left_anti") for name, df in corpus.items()}
        failed = bad if failed is None else failed.unionByName(bad)
    if failed is None:
        none = F.lit(None).cast("string")
        return corpus, functions.withColumn("failure_origin", none).withColumn("reason", none)
    return corpus, functions.join(failed, GROUP, "left")
