"""Designs of one byte a call that neighbouring genes share, and the fits on them.

A SNP is one row: its donors' calls as bytes in the order of their slots. It is packed once and goes to the regions of the
chromosome whose genes' windows may hold it, at most two, so what is shuffled of it does not grow with the number of genes
around it. A task has the genes of a region, or a bounded part of them, and for each gene screens and fits all
cell types and targets over the same bytes; only the donors and SNPs at work are spelled out as numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import row_numbers
from ..functions.storage import reusable
from . import fits as M

#: Codes of a donor without a row of the SNP, and of one whose call is missing; calls are smaller.
ABSENT, MISSING = 254, 255
#: Genes of a region that share a task.
GENES = 64


@dataclass(frozen=True)
class Design:
    """``snps(chrom, snp, bp, codes)``, ``genes(chrom, gene, tss)``, the half window, and ``slots(donor, slot)``."""

    snps: DataFrame
    genes: DataFrame
    window: int
    slots: DataFrame

    @property
    def width(self) -> int:
        """Positions of a region: a SNP's window reaches at most two of them."""
        return max(2 * self.window + 1, 1)


def _pack(batches: Iterator[pa.RecordBatch], min_maf: float) -> Iterator[pa.RecordBatch]:
    """(chrom, snp, bp, calls) batches as (chrom, snp, bp, codes), common SNPs only."""
    for part in batches:
        calls = part.column("calls")
        ends = np.cumsum([0, *(len(c) for c in calls)])
        flat = calls.flatten()
        slot = flat.field("slot").to_numpy(zero_copy_only=False)
        known = flat.field("dosage").is_valid().to_numpy(zero_copy_only=False)
        value = flat.field("dosage").fill_null(0).to_numpy(zero_copy_only=False)
        if ((value < 0) | (value >= ABSENT)).any():
            raise ValueError(f"calls must be whole numbers from 0 to {ABSENT - 1}")
        kept, codes = [], []
        for i, (lo, hi) in enumerate(zip(ends, ends[1:])):
            live = known[lo:hi]
            half = value[lo:hi][live].mean() / 2 if live.any() else 0.0
            if min(half, 1 - half) >= min_maf:
                row = np.full(int(slot[lo:hi].max()) + 1, ABSENT, np.uint8)
                row[slot[lo:hi]] = np.where(live, value[lo:hi], MISSING)
                kept.append(i)
                codes.append(row.tobytes())
        picked = part.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in ("chrom", "snp", "bp")), pa.array(codes, pa.binary())], ["chrom", "snp", "bp", "codes"])


def design(genes: DataFrame, variants: DataFrame, genotypes: DataFrame, slots: DataFrame, *, window: int, min_maf: float = 0.0) -> Design:
    """Design of all genes: every SNP near a gene is gathered and packed once, written once.

    ``genes(gene, chrom, tss)``, ``variants(chrom, snp, bp)``, ``genotypes(snp, donor, dosage)``. Minor allele
    frequencies are those of the non-missing calls of all given donors.
    """
    made = Design(genotypes, reusable(genes.select("chrom", "gene", F.col("tss").cast("bigint").alias("tss"))), window, slots)
    near = variants.select("chrom", "snp", "bp").join(_regions(made, F.col("bp"), variants), ["chrom", "snp"], "left_semi")
    calls = genotypes.join(slots, "donor").groupBy("snp").agg(
        F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), F.col("dosage").cast("int").alias("dosage"))).alias("calls"))
    rows = near.join(calls, "snp").select("chrom", "snp", F.col("bp").cast("bigint").alias("bp"), "calls")
    kinds = dict(rows.dtypes)
    packed = rows.mapInArrow(lambda b: _pack(b, min_maf), f"chrom {kinds['chrom']}, snp {kinds['snp']}, bp bigint, codes binary")
    return Design(reusable(packed), made.genes, window, slots)


def _regions(made: Design, bp, snps: DataFrame) -> DataFrame:
    """``snps`` in each region with a gene that their position may belong to, at most two."""
    width = made.width
    reach = F.sequence(F.floor((bp - made.window) / width), F.floor((bp + made.window) / width))
    having = made.genes.select("chrom", F.floor(F.col("tss") / width).alias("region")).distinct()
    return snps.withColumn("region", F.explode(reach)).join(having, ["chrom", "region"], "left_semi")


def _parts(made: Design, targets: DataFrame, genes_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Genes with region and part, and SNPs once for each part of their regions."""
    wanted = made.genes.join(targets.select("gene").distinct(), "gene", "left_semi").withColumn("region", F.floor(F.col("tss") / made.width))
    placed = reusable(row_numbers(wanted, ["chrom", "region"], ["tss", "gene"], rn="rn").withColumn(
        "part", F.floor((F.col("rn") - 1) / genes_per_task)).drop("rn"))
    last = placed.groupBy("chrom", "region").agg(F.max("part").alias("last"))
    spread = _regions(made, F.col("bp"), made.snps).join(last, ["chrom", "region"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).drop("last")
    return placed, spread


class _Region:
    """SNPs of a region in the order of their places, and the calls of any of them as numbers."""

    def __init__(self, snps: pd.DataFrame):
        snps = snps.sort_values(["bp", "snp"], ignore_index=True)
        self.bp, self.snp, self.label = snps["bp"].to_numpy(), snps["snp"].to_numpy(), snps["snp"].astype(str).to_numpy()
        width = max(map(len, snps["codes"]), default=0)
        self.codes = np.full((len(snps), width), ABSENT, np.uint8)
        for row, packed in zip(self.codes, snps["codes"]):
            row[:len(packed)] = np.frombuffer(packed, np.uint8)
        self.mean = np.zeros(len(snps))
        for i, row in enumerate(self.codes):
            live = row[row < ABSENT]
            self.mean[i] = live.mean() if len(live) else 0.0

    def near(self, tss: int, window: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.bp, [tss - window, tss + window + 1])
        return np.arange(lo, hi)

    def dosages(self, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Calls of some SNPs and donors: a missing one at the SNP's mean, an absent one at that of these donors."""
        inside = slots < self.codes.shape[1]
        codes = np.full((len(rows), len(slots)), ABSENT, np.uint8)
        codes[:, inside] = self.codes[np.ix_(rows, slots[inside])]
        x = np.where(codes == MISSING, self.mean[rows, None], codes.astype(float))
        absent = codes == ABSENT
        if absent.any():
            held = np.where(absent, 0.0, x).sum(axis=1) / np.maximum((~absent).sum(axis=1), 1)
            x = np.where(absent, held[:, None], x)
        return x


def _best(labels: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the highest scores, ties by id, in their given order."""
    return np.sort(np.lexsort((labels, -scores))[:count])


def _region_function(names: Sequence[str], model: str, l1: float, alpha: float | None, n_alphas: int, window: int, screen_to: int):
    def fit(snps: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        rows = []
        region = _Region(snps)
        for _, source in targets.iterrows():
            near = region.near(int(source["tss"]), window)
            if not len(near):
                continue
            slots, fold = np.asarray(source["slots"], dtype=int), np.asarray(source["folds"])
            x, picked = region.dosages(near, slots), {}
            for phase, train in M._phases(fold):
                scores = np.max([M._marginal(x[:, train], np.asarray(source[f"{n}s"], float)[train]) for n in names], axis=0)
                picked[phase] = _best(region.snp[near], scores, screen_to)
            rows += M._fit_targets(source, names, lambda p: (region.label[near[picked[p]]], x[picked[p]]), model, l1, alpha, n_alphas)
        return M._fit_frame(rows)

    return fit


def fit_genes(made: Design, targets: DataFrame, names: Sequence[str] = ("y",), *, model: str = "elasticnet", l1_ratio: float = M.L1_RATIO,
              alpha: float | None = None, cv: int = M.CV_FOLDS, n_alphas: int = M.N_ALPHAS, screen_to: int = 5000, seed: int = 42,
              test_fraction: float = 0.2, min_train: int = 3, min_test: int = 2, genes_per_task: int = GENES, limit: int | None = None) -> DataFrame:
    """The fits of :func:`.fits.fit_genes`, row for row, over a shared design: screened and solved where a region's SNPs lie."""
    if model not in ("elasticnet", "ridge"):
        raise ValueError(f"unknown model {model!r}")
    names = list(names)
    folded = M.fold_targets(targets, names, cv=cv, seed=seed, test_fraction=test_fraction, min_train=min_train, min_test=min_test, limit=limit)
    values = folded.join(made.slots, "donor").select("cell_type", "gene", "slot", "fold", *[F.col(n).cast("double").alias(n) for n in names])
    wanted = reusable(values.groupBy("cell_type", "gene").agg(*M._gathered("fold", *names)))
    genes, snps = _parts(made, wanted, genes_per_task)
    task = ["chrom", "region", "part"]
    return snps.groupBy(*task).cogroup(wanted.join(genes, "gene").groupBy(*task)).applyInPandas(
        _region_function(names, model, l1_ratio, alpha, n_alphas, made.window, screen_to), M.FIT_SCHEMA)
