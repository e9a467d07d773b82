"""Any set of registered plug-ins over all samples, with one exchange of each side.

The sides of a sample (annotations, predictions, queries) are gathered into arrays by sample_id, one aggregate and one
exchange a side, joined to the samples, and kept (in memory, then on disk; what a lost executor held is made again).
Plug-ins read long views of these rows: unnesting keeps the partitioning, so their own groups, windows and joins on
sample_id need no exchange; losses join by query, too, and need none only under
`spark.sql.requireAllClusterKeysForCoPartition` = false, which is the caller's to set. Each plug-in function is a branch
of a union, so a task runs one after the other and holds the sorts of one; the results of a sample are brought together
by sample_id, without an exchange where Spark sees that all branches are partitioned alike. A sample's arrays are bounded
by the caps of ground truth and predictions.

Metrics, confusion elements and metadata have a second form that takes whole samples in Arrow batches (sample_batches) and
gives the same. Samples whose numbers that form can't take as they are (a null, NaN or huge one) go through the long views.

The result has a row a sample: a column for each metric and metadata field, and an array of rows for plug-ins that give
many rows a sample (confusion elements, overlays).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import registry
from .operators import gt as gts
from .operators import losses, matching, metrics, overlay, preds, profile, sample_batches, samples
from .operators.samples import CATEGORIES, categories


@dataclass
class Sides:
    """What an evaluation reads. samples: sample_id, width, height, and what else is known of it; annotations as ground_truth
    takes them; predictions as top_predictions does; queries (optional): query_idx, logits, cx, cy, w, h."""

    samples: DataFrame
    annotations: DataFrame
    predictions: DataFrame
    queries: DataFrame | None = None
    rows: tuple = CATEGORIES

    def _odd(self, side: DataFrame, fields: tuple):
        """Whether a row holds what sample_batches doesn't take."""
        kinds = dict(side.dtypes)
        whole = ("tinyint", "smallint", "int", "bigint")
        if any(kinds.get(f) not in (whole if f in sample_batches.WHOLE else (*whole, "float", "double")) for f in fields):
            return F.lit(True)
        plain = lambda f: F.abs(F.col(f).cast("double")) < (2.0**31 if f in sample_batches.WHOLE else 1e100)
        return ~reduce(lambda x, y: x & y, [F.coalesce(plain(f), F.lit(False)) for f in fields])

    def _gathered(self, side: DataFrame, name: str) -> DataFrame:
        fields = sample_batches.FIELDS.get(name.removeprefix("__"))
        odd = [F.max(self._odd(side, fields)).alias(f"{name}_odd")] if fields else []
        return side.groupBy("sample_id").agg(F.collect_list(F.struct(*[c for c in side.columns if c != "sample_id"])).alias(name), *odd)

    @cached_property
    def _whole(self) -> DataFrame:
        """sample_id, the sample as a struct, each side as an array, null where it is empty, and __odd (see _odd)."""
        size = self._odd(self.samples, ("width", "height")) | F.coalesce(F.least("width", "height") < 1, F.lit(True))
        whole = self.samples.repartition("sample_id").select("sample_id", F.struct(*[c for c in self.samples.columns if c != "sample_id"]).alias("__sample"), size.alias("__size_odd"))
        sides = {"__annotations": self.annotations, "__predictions": self.predictions} | ({"__queries": self.queries} if self.queries is not None else {})
        for name, side in sides.items():
            whole = whole.join(self._gathered(side, name), "sample_id", "left")
        if len({c for c, *_ in self.rows}) < len(self.rows) or not self.rows:
            odd = F.lit(True)
        else:
            odd = reduce(lambda x, y: x | y, [F.coalesce(f"{name}_odd", F.lit(False)) for name in ("__annotations", "__predictions")], F.col("__size_odd"))
        whole = whole.withColumn("__odd", odd).drop("__annotations_odd", "__predictions_odd", "__size_odd")
        whole = whole.persist(StorageLevel.MEMORY_AND_DISK)
        whole.count()  # the partitioning of what is kept is known once it is there
        return whole

    def close(self) -> None:
        """Let go of what is kept; results that were not collected are made anew."""
        if "_whole" in self.__dict__:
            self._whole.unpersist()

    @cached_property
    def views(self) -> dict[str, DataFrame]:
        """Long views by the name that a plug-in's inputs have."""
        return self._views(self._whole)

    @cached_property
    def odd_views(self) -> dict[str, DataFrame]:
        """Those of the samples that sample_batches doesn't take."""
        return self._views(self._whole.where("__odd"))

    def batches(self, wanted: dict[str, str], schema: str) -> DataFrame:
        """sample_id and columns by sample_batches.evaluated of the samples that it takes."""
        fields = [F.col(f"__{side}.{f}").cast("array<bigint>" if f in sample_batches.WHOLE else "array<double>").alias(f"{side}_{f}") for side, fs in sample_batches.FIELDS.items() for f in fs]
        rows, plain = self.rows, self._whole.where(~F.col("__odd"))
        return plain.select("sample_id", *[F.col(f"__sample.{c}").cast("double").alias(c) for c in ("width", "height")], *fields).mapInArrow(lambda batches: sample_batches.evaluated(batches, wanted, rows), schema)

    def _views(self, whole: DataFrame) -> dict[str, DataFrame]:
        spark = self.samples.sparkSession
        view = lambda name: whole.select("sample_id", F.inline(name))
        s = whole.select("sample_id", "__sample.*")
        cats = categories(spark, self.rows)
        out = {"samples": s, "annotations": view("__annotations"), "cats": cats}
        out["gt"] = gts.ground_truth(s, out["annotations"], cats)
        out["pred"] = preds.top_predictions(view("__predictions"))
        if self.queries is not None:
            out["queries"] = view("__queries")
            out["matches"] = matching.assignments(matching.match_costs(out["queries"], out["gt"]))
        return out


#: Inputs of each function that an evaluation can run, by view.
INPUTS = {
    metrics.sample_metrics: ("samples", "gt", "pred"), metrics.confusion_elements: ("samples", "gt", "pred"), profile.sample_profile: ("samples", "annotations", "cats"), overlay.overlay_boxes: ("gt", "pred"),
    losses.criterion: ("samples", "queries", "gt", "matches"), preds.packed: ("samples", "pred"),
}
#: Functions with many rows a sample.
MANY = (metrics.confusion_elements, overlay.overlay_boxes)
#: Functions that sample_batches has, too.
BATCHED = (metrics.sample_metrics, metrics.confusion_elements, profile.sample_profile)


def evaluate(sides: Sides, wanted: list[tuple[str, str]] | None = None) -> DataFrame:
    """sample_id and a column for each wanted plug-in (kind, name); all that the sides suffice for, by default.

    A plug-in without a column of its name in its function's result gives all columns of it, as a struct. A wanted
    plug-in that no evaluation can run, or whose side is missing, is a KeyError.
    """
    able = lambda f: f in INPUTS and all(i in sides.views for i in INPUTS[f])
    if wanted is None:
        wanted = [(e.kind, e.name) for e in registry.entries() if able(e.function) and e.kind != "encoder"]
    entries = [registry.get(*w) for w in wanted]
    for e in entries:
        if not able(e.function):
            raise KeyError(f"{e.kind} {e.name}: not run by sample, or its side is missing")
    functions = list(dict.fromkeys(e.function for e in entries))
    found, fields = {}, {}
    batched = [f for f in functions if f in BATCHED]
    for k, f in enumerate(functions):
        views = sides.odd_views if f in batched else sides.views
        rows = f(*[views[i] for i in INPUTS[f]])
        fields[f] = [c for c in rows.columns if c != "sample_id"]
        row = F.struct(*fields[f])
        found[f] = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(row)).alias(f"__{k}")) if f in MANY else rows.select("sample_id", row.alias(f"__{k}"))
    branches = [sides.views["samples"].select("sample_id"), *found.values()]
    if batched:
        kinds = ", ".join(f"{c} {found[f].schema[c].dataType.simpleString()}" for f in batched for c in found[f].columns if c != "sample_id")
        branches[0] = sides.odd_views["samples"].select("sample_id")  # the batches have a row for each of the others
        named = {f"__{functions.index(f)}": f.__name__ for f in batched}
        branches.append(sides.batches(named, f"sample_id {sides.samples.schema['sample_id'].dataType.simpleString()}, {kinds}"))
    each = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), branches)
    out = each.groupBy("sample_id").agg(*[F.first(f"__{k}", ignorenulls=True).alias(f"__{k}") for k in range(len(functions))])
    columns: dict = {}
    for e in entries:
        key = F.col(f"__{functions.index(e.function)}")
        value = key[e.name] if e.function not in MANY and e.name in fields[e.function] else key
        columns[e.name if e.name not in columns else f"{e.kind} {e.name}"] = value
    return out.select("sample_id", *[v.alias(n) for n, v in columns.items()])


def data_types(samples_: DataFrame) -> DataFrame:
    """sample_id, data_type of samples with a run_config."""
    return samples_.select("sample_id", samples.data_type(F.col("run_config")).alias("data_type"))


def exchanges(df: DataFrame) -> int:
    """Shuffles that a run of df executed, those of what is kept included, each once. df must have run."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    run = [below for above, below in zip(lines, lines[1:], strict=False) if "ShuffleQueryStage" in above]
    return len({re.search(r"plan_id=(\d+)", x).group(1) for x in run if "ReusedExchange" not in x})
