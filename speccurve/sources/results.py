"""Saving results, tables and settings, and reading them back."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from speccurve.functions.labels import path_label
from speccurve.job import ORDERS, SpecCurveJob
from speccurve.operators.grid import control_layout, model_grid
from speccurve.operators.solve import RESULT_FIELDS

LISTS = {
    "controls_test": RESULT_FIELDS["controls_test"],
    "controls_all": RESULT_FIELDS["controls_all"],
    "control_stats": RESULT_FIELDS["control_stats"],
}
KEYS = ["y", "x", "spec_name", "spec_tag", "bits", "grouping_variable", "group_value"]
# The saved result columns: those of a result that are not its keys, in order.
SAVED = [name for name in RESULT_FIELDS if name not in (*KEYS, "status")]


def to_saved(results: DataFrame) -> DataFrame:
    """The flat form: sets as sorted JSON arrays, statistics as JSON."""
    columns = [c for c in KEYS if c in results.columns]
    flat = {
        "controls_test": F.to_json(F.sort_array("controls_test")),
        "controls_all": F.to_json(F.sort_array("controls_all")),
        "control_stats": F.to_json("control_stats"),
    }
    return results.withColumns(flat).select(*columns, *SAVED)


def from_saved(flat: DataFrame) -> DataFrame:
    """Typed results; absent optional columns become null, bad JSON empty."""
    out = flat
    for name in SAVED:
        if name not in out.columns:
            if name in ("adj_r2", "within_r2", "f_stat", "control_stats"):
                out = out.withColumn(name, F.lit(None).cast("string"))
            else:
                raise ValueError(f"saved results lack {name}")
    typed = {}
    for name in SAVED:
        if name in LISTS:
            empty = F.array().cast(LISTS[name])
            typed[name] = F.coalesce(F.from_json(name, LISTS[name]), empty)
        else:
            typed[name] = F.col(name).cast(RESULT_FIELDS[name])
    out = out.withColumns(typed)
    return out.withColumn("status", F.when(F.col("coef").isNotNull(), "ok").otherwise("skipped"))


def write_results(results: DataFrame, path: str, kind: str = "parquet", by_curve: bool = True):
    """Save estimated models, in one folder per y, x and design."""
    table = to_saved(results.where("status = 'ok'"))
    writer = table.write.mode("overwrite")
    if by_curve:
        # Folder names as labels; the true names stay in the rows.
        table = table.withColumns(
            {f"{c}_dir": path_label(c) for c in ("y", "x", "spec_tag")}
        )
        writer = table.write.mode("overwrite").partitionBy("y_dir", "x_dir", "spec_tag_dir")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def read_results(spark: SparkSession, path: str, file_kind: str = "parquet") -> DataFrame:
    """Results saved by :func:`write_results` or in the same flat CSV form."""
    if file_kind == "csv":
        flat = spark.read.option("header", True).option("escape", '"').csv(path)
    else:
        flat = spark.read.parquet(path)
    flat = flat.drop("y_dir", "x_dir", "spec_tag_dir")
    for name, kind in (("bits", "long"), ("group_value", "int")):
        if name in flat.columns:
            flat = flat.withColumn(name, F.col(name).cast(kind))
    return from_saved(flat)


def read_curve(spark: SparkSession, path: str, metadata: Row) -> DataFrame:
    """One curve saved with SAVED columns alone, for the reports: its keys come
    from its metadata (y, x, spec_name and, if there, spec_tag), and models are
    numbered in the order of the file."""
    flat = spark.read.option("header", True).option("escape", '"').csv(path)
    known = metadata.asDict()
    keys = {
        "y": known["y"], "x": known["x"], "spec_name": known["spec_name"],
        "spec_tag": known.get("spec_tag") or known["spec_name"],
    }
    keyed = flat.drop(*KEYS).withColumns({name: F.lit(value) for name, value in keys.items()})
    return from_saved(keyed.withColumn("bits", F.monotonically_increasing_id()))


def saved_order(metadata: Row, override: str | None = None) -> str:
    """The order of a curve: the one asked for, else that of its metadata."""
    order = override or metadata["order"]
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}")
    return order


def write_significance(table: DataFrame, path: str) -> bool:
    """Save the significance table in its order; nothing is written, and False
    returned, when no model is significant."""
    if table.isEmpty():
        return False
    # A sorted table written by several tasks keeps its order in the file names.
    table.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_grid(spark: SparkSession, job: SpecCurveJob, path: str) -> None:
    """Save the model grid with its choices as JSON."""
    model_grid(spark, job).select(
        "bits",
        F.to_json("must").alias("chosen_must_controls"),
        F.to_json("test").alias("chosen_test_controls"),
        "is_full",
    ).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_manifest(spark: SparkSession, job: SpecCurveJob, path: str) -> None:
    """Save the effective settings of a run beside its results."""
    spark.createDataFrame([(json.dumps(dataclasses.asdict(job), sort_keys=True),)], "job string") \
        .write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def curve_metadata(spark: SparkSession, job: SpecCurveJob) -> DataFrame:
    """One row per curve: what a reader needs to draw it again."""
    rows = [
        (y, x, d.name, d.tag, job.test_names, job.must_names, job.matrix_names, job.order,
         job.order in ("p", "signed_p"), job.order == "signed_p", "spark", True, "",
         f"{y}_{x}_{d.tag}")
        for y in job.y
        for x in job.x
        for d in job.active_designs
    ]
    groups = [
        (r["kind"], r["group_start"], r["group_end"], r["group_label"],
         job.matrix_names[r["group_start"] : r["group_end"] + 1])
        for r in control_layout(spark, job).where("group_label is not null")
        .select("kind", "group_start", "group_end", "group_label").distinct()
        .orderBy("group_start").collect()
    ]
    frame = spark.createDataFrame(
        rows,
        "y string, x string, spec_name string, spec_tag string, "
        "controls_test_flat array<string>, controls_must_flat array<string>, "
        "matrix_controls array<string>, `order` string, sort_by_p_mode boolean, sort_by_signed_p boolean, engine string, "
        "show_special_markers boolean, title_suffix string, output_path string",
    )
    alternatives = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(start).alias("start"),
            F.lit(end).alias("end"),
            F.array(*map(F.lit, names)).alias("names"),
            F.lit(label).alias("label"),
        )
        for kind, start, end, label, names in groups
    ]
    kind = "array<struct<kind:string,start:int,end:int,names:array<string>,label:string>>"
    return frame.withColumn("matrix_alt_groups", F.array(*alternatives).cast(kind))


def write_metadata(spark: SparkSession, job: SpecCurveJob, path: str) -> None:
    curve_metadata(spark, job).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", False).json(path)
