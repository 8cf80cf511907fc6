"""Folders of tables: which files belong together, and whether they agree, decided on tables of paths.

A path table has ``root`` and ``path``, the path below that root. Listings are such tables, so one job checks any number of
roots, and no file is opened for it. Faults are rows; the readers turn them into errors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import exprs as X
from ..functions.ordered import first_by, row_numbers
from ..functions.storage import materialize
from .text import by_file, read_lines

#: Faults that an error message names; the rest is counted.
NAMED = 10


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(root, path) of all files below a folder whose names match; contents are not read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return listed.select(F.lit(root.rstrip("/")).alias("root"), F.substr("path", F.lit(len(whole) + 2)).alias("path"))


def raise_on(faults: DataFrame, what: str) -> None:
    """An error that names the first faults, if there are any."""
    found = faults.orderBy(*faults.columns).limit(NAMED + 1).collect()
    if found:
        named = "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in found[:NAMED])
        raise ValueError(f"{what}: {named}{'; and more' if len(found) > NAMED else ''}")


# ---- predictions ---------------------------------------------------------------------------

# Folders of a seed with uncertainties, the predictions first.
PREDICTIONS, UNCERTAINTIES = "preds", ("totvar", "aleatoric", "epistemic")
KINDS = (PREDICTIONS, *UNCERTAINTIES)


def _folders(paths: DataFrame) -> DataFrame:
    """(root, folders, file): paths without hidden folders, taken apart."""
    steps = F.filter(F.split(F.regexp_replace("path", "^/+", ""), "/"), lambda s: s != "")
    apart = paths.select("root", steps.alias("steps")).filter(F.size("steps") > 0)
    taken = apart.select("root", F.slice("steps", F.lit(1), F.size("steps") - 1).alias("folders"), F.element_at("steps", -1).alias("file"))
    return taken.filter(~F.exists("folders", lambda s: s.startswith(".")))


def _sorted(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that are sorted and merged. Path tables repeat themselves, so their files, and the tables that
    they are made from, are a small part of their rows; by such sizes Spark would gather all rows on the driver."""
    return df.hint("merge")


def _is_table(file: Column) -> Column:
    return file.endswith(".csv")


def prediction_tables(paths: DataFrame) -> DataFrame:
    """(root, layout, model, seed, kind, cell_type, path): the prediction tables below each root.

    A root may itself be a seed (``seed``: kind folders or tables in it), hold the seeds of one model (``seeds``: every folder
    has predictions in it), or hold models (``models``). A seed with any of the kind folders has its tables in these, others
    right in the seed. Folders that begin with a dot, and files that are no tables, do not count.
    """
    apart = materialize(_folders(paths))
    folder = lambda level: F.get("folders", F.lit(level))
    depth = F.size("folders")
    table = _is_table(F.col("file"))
    own = apart.groupBy("root").agg(F.bool_or((folder(0) == PREDICTIONS) | ((depth == 0) & table)).alias("is_seed"))
    tops = (apart.filter(depth > 0).groupBy("root", folder(0).alias("top"))
            .agg(F.bool_or(F.coalesce(folder(1) == PREDICTIONS, F.lit(False))).alias("preds"), F.bool_or((depth == 1) & table).alias("tables"))
            .groupBy("root").agg((F.bool_and("preds") | F.bool_and("tables")).alias("has_seeds")))
    names = F.split(F.regexp_replace("root", "/+$", ""), "/")
    layout = F.when(F.col("is_seed"), "seed").when(F.coalesce("has_seeds", F.lit(False)), "seeds").otherwise("models")
    placed = apart.join(_sorted(own), "root").join(_sorted(tops), "root", "left").withColumn("layout", layout)
    level = F.when(F.col("layout") == "seed", 0).when(F.col("layout") == "seeds", 1).otherwise(2)
    model = (F.when(F.col("layout") == "seed", F.element_at(names, F.when(F.size(names) > 1, -2).otherwise(-1)))
             .when(F.col("layout") == "seeds", F.element_at(names, -1)).otherwise(folder(0)))
    seed = F.when(F.col("layout") == "seed", F.element_at(names, -1)).when(F.col("layout") == "seeds", folder(0)).otherwise(folder(1))
    inner = F.get("folders", level)
    below = placed.filter(depth >= level).select(
        "root", "layout", model.alias("model"), seed.alias("seed"), (depth - level).alias("below"),
        F.when(inner.isin(*KINDS), inner).alias("kind"), "file", F.array_join(F.concat("folders", F.array("file")), "/").alias("path"))
    uncertain = below.groupBy("root", "model", "seed").agg(F.max(F.col("kind").isNotNull()).alias("uncertain"))
    rows = below.join(_sorted(uncertain), ["root", "model", "seed"])
    in_place = F.when(F.col("uncertain"), (F.col("below") == 1) & F.col("kind").isNotNull()).otherwise(F.col("below") == 0)
    return rows.filter(in_place & _is_table(F.col("file"))).select(
        "root", "layout", "model", "seed", F.when(F.col("uncertain"), F.col("kind")).otherwise(PREDICTIONS).alias("kind"),
        F.regexp_replace("file", r"\.csv$", "").alias("cell_type"), "uncertain", "path")


def prediction_faults(paths: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(root, model, seed, kind, cell_type, fault) of layouts that cannot be read as one.

    ``missing kind``: a seed with some kind folders lacks others. ``missing`` and ``extra``: a kind without a cell type of the
    seed's predictions, or with one more; a seed (kind is null) against the model's first in natural order. ``mixed``: a model
    of seeds with and without uncertainties. ``no predictions``: a root, model or seed without a table. ``tables`` are those
    of :func:`prediction_tables`, if they are at hand.
    """
    tables = materialize(prediction_tables(paths)) if tables is None else tables
    seed = ["root", "model", "seed"]
    none = F.lit(None).cast("string")

    def fault(rows: DataFrame, name: str, kind: Column = none, cell_type: Column = none, of: Column | None = None) -> DataFrame:
        return rows.select("root", "model", (F.col("seed") if of is None else of).alias("seed"), kind.alias("kind"),
                           cell_type.alias("cell_type"), F.lit(name).alias("fault"))

    uncertain = tables.filter("uncertain").select(*seed).distinct()
    wanted_kinds = uncertain.select(*seed, F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    kinds = tables.select(*seed, "kind").distinct()
    no_kind = fault(wanted_kinds.join(_sorted(kinds), [*seed, "kind"], "left_anti"), "missing kind", F.col("kind"))

    # Division: every kind at hand has the cell types of the predictions, and no other.
    held = tables.select(*seed, "kind", "cell_type").distinct()
    predicted = held.filter(F.col("kind") == PREDICTIONS).drop("kind")
    others = kinds.filter(F.col("kind") != PREDICTIONS)
    lacking = others.join(_sorted(predicted), seed).join(_sorted(held), [*seed, "kind", "cell_type"], "left_anti")
    more = held.filter(F.col("kind") != PREDICTIONS).join(_sorted(predicted), [*seed, "cell_type"], "left_anti").join(
        _sorted(predicted.select(*seed).distinct()), seed, "left_semi")

    model = ["root", "model"]
    seeds = materialize(predicted.select(*seed).distinct())
    first = first_by(seeds, model, [X.natural_key(F.col("seed")), F.col("seed")]).withColumnRenamed("seed", "first")
    later = seeds.join(_sorted(first), model).filter("seed <> first")
    reference = predicted.join(_sorted(first), model).filter("seed = first").select(*model, "cell_type")
    seed_lacks = later.select(*seed).join(_sorted(reference), model).join(_sorted(predicted), [*seed, "cell_type"], "left_anti")
    seed_more = predicted.join(_sorted(later.select(*seed)), seed, "left_semi").join(_sorted(reference), [*model, "cell_type"], "left_anti")
    mixed = tables.groupBy(*model).agg(F.bool_or("uncertain").alias("a"), F.bool_and("uncertain").alias("b")).filter("a and not b")
    empty = paths.select("root").distinct().join(_sorted(tables.select("root").distinct()), "root", "left_anti").select("root", none.alias("model"))
    folders = _folders(paths)
    opened = folders.join(_sorted(tables.select("root", "layout").distinct()), "root").filter("layout <> 'seed'")
    top = F.get("folders", F.lit(0))
    # A model's folders are its seeds; those of a root of seeds lie one step higher.
    is_models = F.col("layout") == "models"
    owner = F.element_at(F.split(F.regexp_replace("root", "/+$", ""), "/"), -1)
    listed = opened.filter(F.size("folders") >= F.when(is_models, 2).otherwise(1)).select(
        "root", F.when(is_models, top).otherwise(owner).alias("model"), F.get("folders", F.when(is_models, 1).otherwise(0)).alias("seed")).distinct()
    bare = listed.join(_sorted(tables.select(*seed).distinct()), seed, "left_anti")
    return (no_kind.unionByName(fault(lacking, "missing", F.col("kind"), F.col("cell_type")))
            .unionByName(fault(more, "extra", F.col("kind"), F.col("cell_type")))
            .unionByName(fault(seed_lacks, "missing", cell_type=F.col("cell_type")))
            .unionByName(fault(seed_more, "extra", cell_type=F.col("cell_type")))
            .unionByName(fault(mixed, "mixed", of=none)).unionByName(fault(empty, "no predictions", of=none))
            .unionByName(fault(bare, "no predictions")))


def discover_predictions(paths: DataFrame) -> DataFrame:
    """:func:`prediction_tables` of layouts without faults; the first faults are an error."""
    tables = materialize(prediction_tables(paths))
    raise_on(prediction_faults(paths, tables), "predictions do not form a layout")
    return tables.drop("uncertain")


# ---- result tables -------------------------------------------------------------------------

_CELL = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'


def csv_cells(line: Column) -> Column:
    """Cells of a comma-separated line; quoted cells may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(F.regexp_replace(line, "\r$", ""), F.lit(_CELL), F.lit(1))
    plain = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(cells, plain)


def reconciled(lines: DataFrame, columns: dict[str, str], *, required: Sequence[str] = ()) -> DataFrame:
    """(file, columns...) of files whose headers differ: each file's own header says where a column stands.

    ``columns`` maps names to types. A column that a file lacks, an empty cell and a value of another type are null; a file
    without a required column is an error.
    """
    lines = by_file(lines).filter(F.trim("value") != "")
    heads = lines.groupBy("file").agg(F.min("ordinal").alias("top"), csv_cells(F.min_by("value", "ordinal")).alias("header"))
    heads = heads.withColumn("header", F.transform("header", lambda c: F.trim(F.replace(c, F.lit("﻿"), F.lit("")))))
    for name in required:
        heads = heads.withColumn("header", F.when(F.array_contains("header", name), F.col("header")).otherwise(F.raise_error(
            F.concat(F.lit(f"no column {name} in "), F.col("file"))).cast("array<string>")))
    rows = lines.join(heads, "file").filter(F.col("ordinal") > F.col("top")).select("file", "header", csv_cells(F.col("value")).alias("cells"))

    def cell(name: str) -> Column:
        place = F.array_position("header", name).cast("int")
        return F.nullif(F.when(place > 0, F.get("cells", place - 1)), F.lit(""))

    return rows.select("file", *[cell(n).try_cast(t).alias(n) for n, t in columns.items()])


def select_labels(labels: DataFrame, wanted: Sequence[str], *, name: str = "cell_type") -> DataFrame:
    """Labels whose folded name is that of a wanted one. A wanted name that fits none, or more than one, is an error."""
    spark = labels.sparkSession
    asked = spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "wanted string").withColumn("key", X.label_key(F.col("wanted")))
    one = asked.groupBy("key").agg(F.min("wanted").alias("wanted"))
    having = labels.select(name).distinct().withColumn("key", X.label_key(F.col(name)))
    fits = one.join(having, "key", "left").groupBy("key", "wanted").agg(F.count(name).alias("n"), F.array_sort(F.collect_set(name)).alias("names"))
    told = F.when(F.col("n") == 1, F.get("names", F.lit(0))).otherwise(F.raise_error(F.concat(
        F.when(F.col("n") == 0, "no results for ").otherwise("ambiguous: "), F.col("wanted"), F.lit(" "), F.array_join("names", ", "))).cast("string"))
    return fits.select(told.alias(name))


def read_results(spark: SparkSession, root: str, arm: str, columns: dict[str, str], *, cell_types: Sequence[str] | None = None,
                 required: Sequence[str] = ()) -> DataFrame:
    """(cell_type, file, columns...) of ``<cell_type>/<arm>/results.csv`` below a folder, of the wanted cell types or all.

    Folders that fold to one name are an error only when names are asked for, as all are read otherwise.
    """
    paths = list_files(spark, root, "results.csv").select(F.split("path", "/").alias("p")).filter((F.size("p") == 3) & (F.get("p", F.lit(1)) == arm))
    found = paths.select(F.get("p", F.lit(0)).alias("cell_type"))
    if found.isEmpty():
        raise ValueError(f"no */{arm}/results.csv below {root}")
    lines = read_lines(spark, f"{root.rstrip('/')}/*/{arm}/results.csv")
    rows = reconciled(lines, columns, required=required)
    label = F.url_decode(F.element_at(F.split("file", "/"), -3))
    labelled = rows.select(label.alias("cell_type"), *rows.columns)
    return labelled if cell_types is None else labelled.join(select_labels(found, cell_types), "cell_type", "left_semi")


# ---- feature sets and their sidecars -------------------------------------------------------

# Sidecars of a feature set; the first two name the gene of each row, in this order of preference.
SIDECARS = ("ensids", "gene_ids", "chroms", "tss", "sample_ids")
GENE_SIDECARS = SIDECARS[:2]


def positions(lines: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(file, row, value): lines with their place in their file, from 0."""
    return row_numbers(by_file(lines), ["file"], ["ordinal"], rn="row", limit=limit).select(
        "file", (F.col("row") - 1).cast("bigint").alias("row"), "value")


def sidecar_faults(features: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(feature_set, field, n_rows, n_features) of sidecars that do not run along with their features, row by row.

    ``features(feature_set, row)`` and ``sidecars(feature_set, field, row, value)`` have rows from 0. A set without a gene
    sidecar is named with a null field.
    """
    sets = features.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n_features"))
    held = sidecars.groupBy("feature_set", "field").agg(F.count(F.lit(1)).alias("n_rows"), F.max("row").alias("last"))
    uneven = held.join(sets, "feature_set").filter("n_rows <> n_features or last <> n_features - 1").select(
        "feature_set", "field", "n_rows", "n_features")
    named = sidecars.filter(F.col("field").isin(*GENE_SIDECARS)).select("feature_set").distinct()
    nameless = sets.join(named, "feature_set", "left_anti").select(
        "feature_set", F.lit(None).cast("string").alias("field"), F.lit(None).cast("bigint").alias("n_rows"), "n_features")
    return uneven.unionByName(nameless)


def select_features(features: DataFrame, sidecars: DataFrame, genes: DataFrame) -> DataFrame:
    """Feature rows of the wanted genes with their sidecars: (feature_set, row, place, gene, features' columns, one column a field).

    ``row`` is the place in the given set, ``place`` that among the rows taken, so sidecars written from the result run along
    again. Ids are compared without version. Uneven sidecars and sets without gene ids are an error.
    """
    raise_on(sidecar_faults(features, sidecars), "feature sets are inconsistent")
    wide = sidecars.groupBy("feature_set", "row").pivot("field", list(SIDECARS)).agg(F.first("value"))
    # The choice is one of a set, not of a row: a set that has the first kind of ids does not fall back within it.
    has_first = sidecars.filter(F.col("field") == GENE_SIDECARS[0]).select("feature_set").distinct().withColumn("has_first", F.lit(True))
    named = wide.join(has_first, "feature_set", "left").withColumn(
        "gene", X.gene_key(F.when(F.col("has_first"), F.col(GENE_SIDECARS[0])).otherwise(F.col(GENE_SIDECARS[1])))).drop("has_first")
    wanted = genes.select(X.gene_key(F.col("gene").cast("string")).alias("gene")).distinct()
    taken = row_numbers(named.join(wanted, "gene", "left_semi"), ["feature_set"], ["row"], rn="place").withColumn(
        "place", (F.col("place") - 1).cast("bigint"))
    return features.join(taken, ["feature_set", "row"]).select(
        "feature_set", "row", "place", "gene", *[c for c in features.columns if c not in ("feature_set", "row")], *SIDECARS)
