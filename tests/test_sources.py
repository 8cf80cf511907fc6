import json

import pytest
from pyspark.sql import functions as F

from cohortspark.sources import sinks as K, text as S
from cohortspark.streaming import incremental as Z


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_variant_file_first_wins(spark, tmp_path):
    p = _write(tmp_path / "a.bim", "chr2 rs1 0 20 A G\n1\trs1\t0\t10\tC\tT\n1  rs2 0 30 A C\n")
    got = {r.snp: (r.chrom, r.bp) for r in S.parse_variants(S.read_lines(spark, p)).collect()}
    assert got == {"rs1": ("1", 10), "rs2": ("1", 30)}
    assert S.duplicate_count(S.read_lines(spark, p)).first()[0] == 1


def test_vcf_file(spark, tmp_path):
    p = _write(tmp_path / "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tI\tFMT\tdA\tdB\n"
               "1\t5\trs\ta\tg\t.\t.\t.\tGT:DP\t0|1:3\t./.:0\n1\t6\tr2\tA\tGT\t.\t.\t.\tGT\t1/1\t1/1\n")
    lines = S.read_lines(spark, p)
    got = [(r.snp, r.donor, r.n_called, r.n_alt) for r in S.parse_vcf(lines).orderBy("donor").collect()]
    assert got == [("rs", "dA", 2, 1), ("rs", "dB", 0, 0)]
    assert S.contig_style(lines).first()[0] is False


def test_block_file_numbers_by_text_chromosome(spark, tmp_path):
    p = _write(tmp_path / "b.bed", "# build\nchr start stop\nchr2 5 9\nchr10 1 4\nchr2 1 5\n")
    got = [(r.block_index, r.block) for r in S.parse_blocks(S.read_lines(spark, p)).orderBy("block_index").collect()]
    assert got == [(0, "chr10:1-4"), (1, "chr2:1-5"), (2, "chr2:5-9")]
    bad = _write(tmp_path / "bad.bed", "1 5 5\n")
    with pytest.raises(Exception, match="stop <= start"):
        S.parse_blocks(S.read_lines(spark, bad)).collect()


def test_gtf_without_gene_rows(spark, tmp_path):
    line = '1\ts\texon\t10\t20\t.\t-\t.\tgene_id "E1.2"; gene_name "{}"; gene_biotype "protein_coding";\n'
    p = _write(tmp_path / "a.gtf", line.format("First") + line.format("Second"))
    gtf = S.parse_gtf(S.read_lines(spark, p))
    assert dict(S.gene_symbols(gtf).collect()) == {"E1": "First"}
    q = _write(tmp_path / "b.gtf", line.format("X") + line.format("Y").replace("exon", "gene"))
    gtf = S.parse_gtf(S.read_lines(spark, q))
    assert dict(S.gene_symbols(gtf).collect()) == {"E1": "Y"}
    w = S.gene_windows(gtf).first()
    assert (w.tss, w.start, w.end) == (20, 20 - 98305, 20 + 98303)


def test_three_weight_layouts(spark):
    head = {"snp_ids": ["a", "b"], "coefs": [1.0, 2.0], "intercept": 0.5}
    point = {"g": {**head, "chr": "1"}, "empty": {"snp_ids": [], "coefs": [], "intercept": 1.0}}
    heads = {"h": {"mean": head, "aleatoric": head, "epistemic": head, "chr": "2"}}
    members = {"e": {**head, "metadata": {"coefficient_scale": "raw_dosage"},
                     "members": [{"member_id": "m", "bootstrap_coefs": [[3.0, 4.0], [5.0, 6.0]]}]}}
    df = spark.createDataFrame([(json.dumps(v),) for v in (point, heads, members)], "value string")
    got = {(r.gene, r.snp): (r.weight, r.standardized) for r in S.parse_weights(df).collect()}
    assert got == {("g", "a"): (1.0, True), ("g", "b"): (2.0, True), ("h", "a"): (1.0, True), ("h", "b"): (2.0, True),
                   ("e", "a"): (1.0, False), ("e", "b"): (2.0, False)}
    draws = S.parse_weights(df.limit(3).filter(F.col("value").contains("members")), draws=True)
    assert sorted((r.draw, r.snp, r.weight) for r in draws.collect()) == [("m_0", "a", 3.0), ("m_0", "b", 4.0), ("m_1", "a", 5.0), ("m_1", "b", 6.0)]


def test_weights_are_checked(spark):
    short = spark.createDataFrame([(json.dumps({"g": {"snp_ids": ["a"], "coefs": [1.0, 2.0]}}),)], "value string")
    with pytest.raises(Exception, match="coefficient count"):
        S.parse_weights(short).collect()
    scale = spark.createDataFrame([(json.dumps({"g": {"snp_ids": ["a"], "coefs": [1.0], "members": [], "metadata": {"coefficient_scale": "z"}}}),)], "value string")
    with pytest.raises(Exception, match="unsupported coefficient scale"):
        S.parse_weights(scale).collect()


def test_study_needs_an_effect():
    with pytest.raises(ValueError):
        S.StudyColumns().validate()
    with pytest.raises(ValueError):
        S.StudyColumns(beta="b").validate()


def test_study_file_and_folder(spark, tmp_path):
    for name, z in (("x1.txt", 1.5), ("y1.txt", 9.0)):
        _write(tmp_path / name, f"SNP\tA1\tA2\tZ\nrs1\ta\tg\t{z}\n")
    got = S.read_study(spark, str(tmp_path), S.StudyColumns(zscore="Z"), sep="\\t", file_pattern="^x").collect()
    assert [(r.snp, r.effect_allele, r.zscore) for r in got] == [("rs1", "A", 1.5)]


def test_skip_until_header(spark, tmp_path):
    p = _write(tmp_path / "s.txt", "notes\nmore|notes\nSNP|Z\nrs1|2\n")
    got = S.delimited(S.read_lines(spark, p), ["snp", "z"], sep="|", skip_until="SNP").collect()
    assert [tuple(r) for r in got] == [("rs1", "2")]


def test_wide_round_trip(spark, tmp_path, rows):
    long = spark.createDataFrame([("c", "g1", "1", 5, "d1", 1.0), ("c", "g1", "1", 5, "d2", 2.0), ("c", "g2", "1", 6, "d1", None)],
                                 "cell_type string, gene string, chrom string, tss long, donor string, value double")
    K.write_wide(long, f"{tmp_path}/wide", ["d1", "d2"])
    wide = spark.read.csv(f"{tmp_path}/wide/cell_type=c", header=True)
    assert rows(S.wide_to_long(wide), "gene", "donor", "value") == [("g1", "d1", 1.0), ("g1", "d2", 2.0)]
    already = spark.createDataFrame([("g", "d", 1.0)], "gene string, individual string, expression double")
    assert S.wide_to_long(already).columns == ["gene", "donor", "value"]


def test_table_sinks(spark, tmp_path):
    sums = spark.createDataFrame([("d", "c", "g", 6.0)], "donor string, cell_type string, gene string, sum_count double")
    groups = spark.createDataFrame([("d", "c", 3)], "donor string, cell_type string, n_cells long")
    K.write_population(sums, groups, f"{tmp_path}/pop")
    assert spark.read.parquet(f"{tmp_path}/pop").first().value == 2.0
    with pytest.raises(Exception, match="group without cells"):
        K.write_population(sums, groups.withColumn("n_cells", F.lit(0).cast("long")), f"{tmp_path}/bad")
    t = spark.createDataFrame([("c", "g", 1.0), ("c", "g", 3.0), ("c", "h", None)], "cell_type string, gene string, value double")
    K.write_targets(t, f"{tmp_path}/targets")
    assert [(r.gene, r.value) for r in spark.read.parquet(f"{tmp_path}/targets").collect()] == [("g", 2.0)]
    K.write_top(t, f"{tmp_path}/top", [F.col("value").desc_nulls_last()], 1)
    assert spark.read.csv(f"{tmp_path}/top", sep="\t", header=True).first().value == "3.0"
    donors = t.select(F.col("gene").alias("donor"), "value")
    missing = K.write_split(donors, spark.createDataFrame([("g",), ("zz",)], "donor string"), f"{tmp_path}/split")
    assert [r.donor for r in missing.collect()] == ["zz"]
    assert spark.read.parquet(f"{tmp_path}/split/test").count() == 2
    snps = spark.createDataFrame([("c1", "g", "s1"), ("c1", "g", "s2"), ("c2", "g", "s1")], "cell_type string, gene string, snp string")
    for c in ("c1", "c2"):
        part = snps.filter(F.col("cell_type") == c)
        K.write_covariance(part.withColumn("value", F.lit(1.0)), part, f"{tmp_path}/cov", partition="cell_type", reference="r1")
    meta = {m.cell_type: (m.n_snps, m.content_hash, m.reference) for m in K.read_covariance(spark, f"{tmp_path}/cov", "meta", partition="cell_type").collect()}
    assert {c: m[0] for c, m in meta.items()} == {"c1": 2, "c2": 1} and K.read_covariance(spark, f"{tmp_path}/cov", "pairs", partition="cell_type").count() == 3
    assert meta["c2"][1:] == (Z.ordered_hash(snps.filter("cell_type = 'c2'"), ["gene"], ["snp"], ["snp"]).first().content_hash, "r1")
    r = t.withColumn("arm", F.lit("A"))
    K.write_results(r, f"{tmp_path}/results")
    assert spark.read.parquet(f"{tmp_path}/results").filter("arm = 'A'").count() == 3


def test_a_second_cell_type_leaves_the_first_alone(spark, tmp_path):
    first = spark.createDataFrame([("c1", "A", "g", "1", 5, "d", 1.0)], "cell_type string, arm string, gene string, chrom string, tss long, donor string, value double")
    second = first.withColumn("cell_type", F.lit("c2"))
    sums = first.withColumn("sum_count", F.col("value"))
    groups = first.select("donor", "cell_type", F.lit(2).cast("long").alias("n_cells"))
    writers = {
        "wide": lambda d, p: K.write_wide(d, p, ["d"]), "targets": K.write_targets, "results": K.write_results,
        "predictions": lambda d, p: K.write_predictions(d, p, ["d"]),
        "population": lambda d, p: K.write_population(d.withColumn("sum_count", F.col("value")), groups.withColumn("cell_type", F.lit(d.first().cell_type)), p)}
    for name, write in writers.items():
        for part in (first, second, second):
            write(part, f"{tmp_path}/{name}")
        read = spark.read.option("header", True).csv if name in ("wide", "predictions") else spark.read.parquet
        assert sorted(r.cell_type for r in read(f"{tmp_path}/{name}").collect()) == ["c1", "c2"], name
    assert sums.count() == 1


def test_calls_of_several_files_keep_their_donors(spark, tmp_path):
    for name, donor, call in (("a", "dA", "0/1"), ("b", "dB", "1/1")):
        _write(tmp_path / name, f"##x\n#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tI\tFORMAT\t{donor}\n1\t5\trs\tA\tC\t.\t.\t.\tGT\t{call}\n")
    got = sorted((r.donor, r.n_alt) for r in S.parse_vcf(S.read_lines(spark, str(tmp_path))).collect())
    assert got == [("dA", 1), ("dB", 2)]
    _write(tmp_path / "c", "1\t5\trs\tA\tC\t.\t.\t.\tGT\t0/0\n")
    with pytest.raises(Exception, match="no #CHROM line"):
        S.parse_vcf(S.read_lines(spark, str(tmp_path))).collect()
    _write(tmp_path / "c", "chr1\t5\trs\n")
    with pytest.raises(Exception, match="with and without chr"):
        S.contig_style(S.read_lines(spark, str(tmp_path))).collect()


def test_each_file_has_its_own_preamble(spark, tmp_path):
    _write(tmp_path / "a", "note\nSNP\tZ\ns1\t1.5\n")
    _write(tmp_path / "b", "note1\nnote2\nSNP\tZ\ns2\t-2\n")
    lines = S.read_lines(spark, str(tmp_path))
    assert sorted(tuple(r) for r in S.delimited(lines, ["snp", "z"], skip_until="SNP").collect()) == [("s1", "1.5"), ("s2", "-2")]
    columns = S.StudyColumns(snp="SNP", effect_allele="SNP", non_effect_allele="SNP", zscore="Z")
    got = S.read_study(spark, str(tmp_path), columns, sep="\\t", skip_until="SNP").collect()
    assert sorted((r.snp, r.zscore) for r in got) == [("s1", 1.5), ("s2", -2.0)]
    _write(tmp_path / "c", "SNP\tother\ns3\t1\n")
    with pytest.raises(ValueError, match="different headers"):
        S.read_study(spark, str(tmp_path), columns, sep="\\t", skip_until="SNP")
    assert S.read_study(spark, str(tmp_path), columns, sep="\\t", skip_until="SNP", file_pattern="^[ab]$").count() == 2
    _write(tmp_path / "d", "nothing\n")
    with pytest.raises(Exception, match="no header line"):
        S.delimited(S.read_lines(spark, str(tmp_path)), ["snp", "z"], skip_until="SNP").collect()


def test_new_donors_only_once(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1.0), ("d2", 2.0)], "donor string, v double")
    K.write_new_donors(df.filter("donor = 'd1'"), f"{tmp_path}/f")
    K.write_new_donors(df, f"{tmp_path}/f")
    assert sorted(r.donor for r in K.written_donors(spark, f"{tmp_path}/f").collect()) == ["d1", "d2"]
    # rows of a lost job: written, but their batch was never finished
    half = df.filter("donor = 'd1'").select(F.lit("d3").alias("donor"), "v", F.lit("lost").alias("batch"), F.lit(0).alias("bucket"))
    half.write.mode("append").partitionBy("batch", "bucket").parquet(f"{tmp_path}/f/rows")
    again = K.write_new_donors(spark.createDataFrame([("d3", 3.0), ("d1", 9.0)], "donor string, v double"), f"{tmp_path}/f")
    assert [tuple(r) for r in again.collect()] == [("d3", 3.0)]
    assert sorted((r.donor, r.v) for r in K.written_donors(spark, f"{tmp_path}/f").collect()) == [("d1", 1.0), ("d2", 2.0), ("d3", 3.0)]


def test_content_hash_is_order_free(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "i int, s string")
    ha, hb, hc = (Z.content_hash(d, ["i", "s"]).first().content_hash for d in (a, b, c))
    assert ha == hb != hc
    with pytest.raises(Exception, match="different SNP sets"):
        Z.require_same_hash(Z.content_hash(a, ["i"]), Z.content_hash(c.withColumn("i", F.lit(9)), ["i"])).collect()


def test_unfinished_needs_marker_and_tables(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "cell_type string")
    manifest = spark.createDataFrame([("a", "summary"), ("a", "results"), ("b", "summary"), ("c", "results")], "cell_type string, item string")
    assert sorted(r[0] for r in Z.unfinished(wanted, manifest, ["results"]).collect()) == ["b", "c"]


def test_resume_after_restart(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    first.write.parquet(src)
    run = lambda: Z.resume_batches(spark, src, first.schema, lambda d: d, output=out, checkpoint=cp).awaitTermination()
    run()
    spark.createDataFrame([(3, "c")], "id long, v string").write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


@pytest.mark.parametrize("files", [1, 2, 3])
def test_every_row_survives_however_files_are_split(spark, tmp_path, files):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    rows = [(1, "a"), (1, "b"), (2, "c")]
    for i in range(files):
        spark.createDataFrame(rows[i::files], "id long, v string").coalesce(1).write.mode("append").parquet(src)
    Z.resume_batches(spark, src, "id long, v string", lambda d: d, output=out, checkpoint=cp, bytes_per_batch=1).awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == rows


def test_sums_follow_the_keys_touched(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    schema = "k string, x double, y double"
    batches = [[("a", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 0.0, 0.0), ("d", 5.0, 5.0)], [("a", 3.0, 6.0)], [("b", 2.0, None)], [("a", 1.0, 1.0), ("e", 1.0, 1.0)], [("e", 4.0, 1.0)]]
    totals = {}
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        Z.stream_sums(spark, src, schema, ["k"], "x", "y", output=out, checkpoint=cp).awaitTermination()
        for k, x, y in rows:
            n, total = totals.get(k, (0, None))
            totals[k] = (n + (y is not None), total if y is None else (total or 0.0) + x)
        assert {r.k: (r.n, r.sum_x) for r in Z.latest_sums(spark, out, ["k"]).collect()} == totals
    # the first batch became the base; four later rows made a second one, which let go of what the first had replaced
    written = {r.batch: r["count"] for r in spark.read.parquet(f"{out}/deltas").groupBy("batch").count().collect()}
    assert sorted(r.upto for r in spark.read.parquet(f"{out}/commits").collect()) == [0, 3] and written == {1: 1, 2: 1, 3: 2, 4: 1}
    # a base without its record does not count, and a batch that comes again replaces its own sums
    spark.read.parquet(f"{out}/bases/upto=3").withColumn("n", F.lit(99).cast("bigint")).write.parquet(f"{out}/bases/upto=4")
    Z.running_sums(spark.createDataFrame(batches[4], schema), ["k"], "x", "y").write.mode("overwrite").parquet(f"{out}/deltas/batch=4")
    assert {r.k: (r.n, r.sum_x) for r in Z.latest_sums(spark, out, ["k"]).collect()} == totals
    with pytest.raises(ValueError, match="no sums"):
        Z.latest_sums(spark, f"{tmp_path}/none", ["k"])



def test_lists_and_signs(spark):
    signs = spark.createDataFrame([("e1", 1), ("e1", 1)], "gene_id string, reference_sign int")
    with pytest.raises(Exception, match="listed twice"):
        S.reference_signs(signs).collect()
    with pytest.raises(ValueError):
        S.reference_list(spark.createDataFrame([("x",)], "gene string"))
    blank = spark.createDataFrame([("l", "abc", None, None, None)], "locus string, gene string, ensid string, ld_block_index string, ld_block string")
    row = S.reference_list(blank).first()
    assert (row.gene, row.block_index) == ("ABC", None)
