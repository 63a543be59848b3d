"""Nested JSON reports as flat tables. Each takes a table with a text column `json`, one report a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.stats import significant

_TEST = "struct<statistic:double,pvalue:double>"
_COMPARISON = f"struct<dataset:string,task:string,n_components:int,quantum:string,classical:string,qsvm_mean:double,classical_mean:double,delta:double,ttest:{_TEST},wilcoxon:{_TEST}>"


def significance(reports: DataFrame) -> DataFrame:
    """A row for each entry of `comparisons`: both tests and whether the t-test is significant."""
    c = reports.select(F.explode(F.from_json("json", f"struct<comparisons:array<{_COMPARISON}>>")["comparisons"]).alias("c"))
    return c.select(
        "c.dataset", "c.task", "c.n_components", "c.quantum", "c.classical", F.col("c.qsvm_mean").alias("qsvm_f1_macro_mean"), F.col("c.classical_mean").alias("classical_f1_macro_mean"),
        F.col("c.delta").alias("delta_classical_minus_qsvm"), F.col("c.ttest.statistic").alias("ttest_statistic"), F.col("c.ttest.pvalue").alias("ttest_pvalue"),
        F.col("c.wilcoxon.statistic").alias("wilcoxon_statistic"), F.col("c.wilcoxon.pvalue").alias("wilcoxon_pvalue"), significant(F.col("c.ttest.pvalue")).alias("ttest_significant_at_05"))


def skipped(reports: DataFrame) -> DataFrame:
    """A row for each line `dataset/task/nc=3/model[/encoding]: reason` of `skipped`; the reason may hold the separator again."""
    lines = reports.select(F.explode(F.from_json("json", "struct<skipped:array<string>>")["skipped"]).alias("line"))
    k = lines.select(F.split("line", ": ", 2).alias("c")).withColumn("f", F.split(F.col("c")[0], "/"))
    return k.select(
        F.col("f")[0].alias("dataset"), F.col("f")[1].alias("task"), F.regexp_extract(F.col("f")[2], r"^nc=(\d+)$", 1).cast("int").alias("n_components"),
        F.col("f")[3].alias("model"), F.coalesce(F.try_element_at("f", F.lit(5)), F.lit("")).alias("encoding"), F.col("c")[1].alias("reason"))


def mcnemar(reports: DataFrame) -> DataFrame:
    """A row for each pair of models; counts, p-value and flag are null where the pair was skipped."""
    one = "struct<group:string,pair:array<string>,shared_test_set:boolean,n:bigint,n01:bigint,n10:bigint,statistic:double,pvalue:double,skipped:string>"
    r = reports.select(F.explode(F.from_json("json", f"array<{one}>")).alias("r"))
    return r.select(
        "r.group", F.col("r.pair")[0].alias("model_a"), F.col("r.pair")[1].alias("model_b"), "r.shared_test_set", F.col("r.n").alias("n_samples"),
        F.col("r.n01").alias("n01_a_wrong_b_right"), F.col("r.n10").alias("n10_a_right_b_wrong"), "r.statistic", "r.pvalue",
        significant(F.col("r.pvalue")).alias("significant_at_05"), F.coalesce("r.skipped", F.lit("")).alias("skipped"))


_GEOMETRY = "map<string,struct<source:string,n_full_rows:bigint,n_subsample_rows:bigint,representativeness:map<string,double>,geometry:map<string,map<string,struct<mean:double,std:double>>>>>"


def representativeness(reports: DataFrame) -> DataFrame:
    """(dataset, source, n_full_rows, n_subsample_rows, name, value): a row for each measure of each dataset."""
    d = reports.select(F.explode(F.from_json("json", _GEOMETRY)).alias("dataset", "d"))
    return d.select("dataset", "d.source", "d.n_full_rows", "d.n_subsample_rows", F.explode("d.representativeness").alias("name", "value"))


def geometry(reports: DataFrame) -> DataFrame:
    """(dataset, n_components, name, mean, std): a row for each measure of each number of components."""
    d = reports.select(F.explode(F.from_json("json", _GEOMETRY)).alias("dataset", "d"))
    d = d.select("dataset", F.explode("d.geometry").alias("n_components", "m"))
    d = d.select("dataset", F.col("n_components").cast("int"), F.explode("m").alias("name", "s"))
    return d.select("dataset", "n_components", "name", "s.mean", "s.std")


def kernels(reports: DataFrame, baselines: DataFrame) -> DataFrame:
    """A row for each dataset and kernel: diagnostics, and alignment above that of a constant kernel, which the second report gives."""
    one = "struct<offdiag_std:double,alignment:double,gamma:double>"
    d = reports.select(F.explode(F.from_json("json", f"map<string,struct<n_train_rows:bigint,n_qubits:int,quantum:{one},rbf_control:{one}>>")).alias("dataset", "d"))
    b = baselines.select(F.explode(F.from_json("json", "map<string,struct<constant_kernel_alignment_baseline:double>>")).alias("dataset", "b"))
    j = d.join(b, "dataset")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("kernel"), F.col(f"d.{key}").alias("k")) for name, key in (("qsvm_fidelity", "quantum"), ("rbf_control", "rbf_control"))]))
    base = F.col("b.constant_kernel_alignment_baseline")
    return j.withColumn("e", each).select(
        "dataset", "e.kernel", "d.n_train_rows", "d.n_qubits", "e.k.offdiag_std", "e.k.alignment", base.alias("constant_kernel_baseline"),
        (F.col("e.k.alignment") - base).alias("alignment_excess_over_baseline"), F.col("e.k.gamma").alias("rbf_gamma"))
