"""Sources, statistics, campaign tables and streaming."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import stats as T
from tessera.operators import topology as H
from tessera.plans import campaign as K
from tessera.sources import keel, results
from tessera.streaming import score

BANANA = "@relation banana\n@attribute At1 real [-3.09,2.81]\n@attribute At2 real [-2.39,3.19]\n@attribute Class {-1.0,1.0}\n@inputs At1, At2\n@outputs Class\n@data\n"


@pytest.fixture
def keel_file(tmp_path):
    def make(rows, head=BANANA, name="x.dat"):
        (tmp_path / name).write_text(head + rows)
        return str(tmp_path / name)

    return make


def test_keel_reads(spark, keel_file):
    path = keel_file("1.14,-0.114,-1.0\n-1.52,-1.15,1.0\n\n")
    got = sorted((r.raw_label, tuple(r.features)) for r in keel.read_keel(spark, path).collect())
    assert got == [("-1.0", (1.14, -0.114)), ("1.0", (-1.52, -1.15))]
    keel.KeelSource.register(spark)
    assert sorted((r.raw_label, tuple(r.features)) for r in spark.read.format("keel").load(path).collect()) == got


@pytest.mark.parametrize("row", ["1.0,2.0,3.0,4.0\n", "1.0,abc,1.0\n"])
def test_keel_refuses_rows(spark, keel_file, row):
    with pytest.raises(Exception, match="cells|numeric"):
        keel.read_keel(spark, keel_file("1.0,2.0,1.0\n" + row)).collect()


@pytest.mark.parametrize("head", ["@weird x\n@attribute a real\n@data", "@attribute a real\n@attribute b real\n@outputs a, b\n@data", "@attribute a real\n@attribute c {x}\n@inputs b\n@data", "@relation x\n@data", "@attribute a real"])
def test_keel_refuses_headers(head):
    with pytest.raises(ValueError):
        keel.parse_header(head.split("\n"))


def test_arff(spark, keel_file):
    head = "% comment\n@RELATION r\n@ATTRIBUTE 'a b' NUMERIC\n@ATTRIBUTE eyeDetection {0,1}\n@DATA\n"
    path = keel_file("1.5,0\n2.5,1\n", head, "x.arff")
    assert keel.read_arff(spark, path, ("eyedetection", "class")).count() == 2
    with pytest.raises(ValueError):
        keel.read_arff(spark, path, ("target",))


def test_partitions(spark, tmp_path):
    for f in range(1, 6):
        for part, n in (("tra", 8), ("tst", 2)):
            (tmp_path / f"d-5-{f}{part}.dat").write_text(BANANA + "".join(f"{i}.0,{f}.0,{[-1.0, 1.0][i % 2]}\n" for i in range(n)))
    got = keel.read_partitions(spark, str(tmp_path), "d")
    assert got.count() == 50 and got.where("is_test").count() == 10 and {r.label for r in got.collect()} == {0, 1}
    with pytest.raises(FileNotFoundError):
        keel.read_partitions(spark, str(tmp_path), "none")


def test_shards(spark, tmp_path):
    a = tmp_path / "a"
    a.mkdir()
    (a / "1.csv").write_text("dataset,fold,method,acc\nx,0,m,0.5\n")
    (a / "2.csv").write_text("dataset,fold,method,acc\nx,1,m,0.6\n")
    df = results.read_shards(spark, str(a))
    assert df.count() == 2
    units = spark.createDataFrame([("x", 0, 5), ("x", 1, 5), ("x", 2, 5), ("y", 0, 9)], "dataset string, fold int, n int")
    assert [(r.dataset, r.fold) for r in results.done_units(units, df).collect()] == [("y", 0), ("x", 2)]
    results.write_results(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        results.write_results(df.where("false"), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        results.refuse_foreign(df)
    (a / "3.csv").write_text("dataset,fold,method,acc\nx,1,m,0.7\n")
    with pytest.raises(ValueError, match="3.csv"):
        results.read_shards(spark, str(a))


# Accuracies of eight methods on 17 datasets as published, columns in this order.
METHODS = ("S", "RSP3", "KMeans", "Random", "LVQ3", "SPOT", "GLVQ", "GNG")
GOLDEN = """0.9032 0.8455 0.8491 0.8711 0.8808 0.8685 0.8687 0.8570
0.8658 0.8388 0.8479 0.8284 0.8509 0.8355 0.7590 0.8518
0.8860 0.8833 0.8062 0.8319 0.8719 0.8888 0.8661 0.8635
0.9555 0.9507 0.9538 0.9197 0.9483 0.9440 0.7894 0.9559
0.8446 0.7909 0.8101 0.8055 0.8292 0.8115 0.8048 0.8172
0.9841 0.9909 0.9912 0.9784 0.9922 0.9901 0.9404 0.9918
0.8910 0.8705 0.8793 0.8494 0.8834 0.8608 0.7994 0.8877
0.8574 0.8141 0.7335 0.7234 0.7878 0.8280 0.7542 0.8399
0.9038 0.9029 0.8988 0.8855 0.9110 0.8875 0.8483 0.9050
0.9455 0.9610 0.9450 0.9143 0.9515 0.9385 0.8866 0.9450
0.8931 0.8745 0.8790 0.8317 0.8843 0.8557 0.6931 0.8979
0.9143 0.8884 0.9041 0.8762 0.9126 0.8804 0.8997 0.5832
0.9785 0.9829 0.9824 0.9622 0.9811 0.9769 0.9180 0.9838
0.9758 0.9251 0.9588 0.9378 0.9634 0.9507 0.9777 0.9630
0.7810 0.7584 0.7382 0.7050 0.7608 0.7120 0.8142 0.7506
0.9525 0.9384 0.9578 0.9366 0.9666 0.9578 0.9314 0.9666
0.9552 0.9386 0.9552 0.9493 0.9497 0.9497 0.9716 0.9556"""


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(b, m, float(s)) for b, line in enumerate(GOLDEN.split("\n")) for m, s in zip(METHODS, line.split(), strict=True)]
    return spark.createDataFrame(rows, "block int, treatment string, score double")


def test_published_ranks_and_friedman(golden):
    ranks = {r.treatment: r.avg_rank for r in T.average_ranks(golden).collect()}
    want = {"S": 2.4412, "LVQ3": 2.9412, "GNG": 3.1176, "KMeans": 4.6176, "RSP3": 4.9412, "SPOT": 5.1765, "GLVQ": 5.9412, "Random": 6.8235}
    assert ranks == {m: pytest.approx(r, abs=0.04) for m, r in want.items()}  # four printed decimals make ties
    f = T.friedman(golden).first()
    assert (f.n, f.k, f.df) == (17, 8, 7) and f.chi2 == pytest.approx(47.5439, abs=0.35)
    assert T.chi2_tail(47.5439, 7) == pytest.approx(4.37e-08, rel=5e-3)
    assert T.chi2_tail(3.0, 4) == pytest.approx(math.exp(-1.5) * 2.5)


def test_published_wilcoxon_and_conover(golden):
    w = {r.treatment: r for r in T.wilcoxon(golden, "S").collect()}
    assert {m: (w[m].wins, w[m].losses) for m in ("RSP3", "Random", "LVQ3", "GNG")} == {"RSP3": (14, 3), "Random": (17, 0), "LVQ3": (12, 5), "GNG": (10, 7)}
    assert w["Random"].p_holm == pytest.approx(0.00011, abs=1e-5)
    assert w["GNG"].mean_delta == pytest.approx(0.0278, abs=1e-3)
    c = {r.treatment: r.p_holm for r in T.conover(golden, "S").collect()}
    assert c["Random"] < 1e-6 and c["LVQ3"] == pytest.approx(0.63, abs=0.05) and c["RSP3"] == pytest.approx(0.0012, rel=0.2)


@pytest.mark.parametrize("df,t,want", [(1, 1.0, 0.5), (1, 12.706, 0.05), (2, 4.303, 0.05), (3, 3.182, 0.05), (5, 2.0, 0.101939), (5, 2.571, 0.05), (21, 2.5, 0.020780), (27, 2.052, 0.05), (28, 2.048, 0.05), (7, 0.0, 1.0)])
def test_student_tail(spark, df, t, want):
    """Two-sided tails of Student's t at odd and even degrees of freedom: published critical values."""
    got = spark.range(1).select(T.student_tail(F.lit(t), F.lit(df).cast("long")).alias("p")).first().p
    assert got == pytest.approx(want, abs=5e-5)


def test_friedman_has_its_p(golden):
    f = T.friedman(golden).first()
    assert f.p == pytest.approx(T.chi2_tail(f.chi2, 7)) and f.p < 1e-6


def test_a_large_model_is_not_paired_with_every_point(spark, monkeypatch):
    """Over the bound a cross join is refused; the searches that need none answer as they do within it."""
    from tessera.operators import neighbors as N

    p = spark.range(30).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"))
    searches = (N.eccentricity, N.farthest_pair, N.facility_gains)
    within = [sorted(map(tuple, f(p).collect())) for f in searches]
    assert within[1] == [(0, 29, 841.0)] and dict(within[0])[0] == 15.0
    monkeypatch.setattr(N, "MODEL_ROWS", 20)
    monkeypatch.setattr(N, "MODEL_CELLS", 20)
    with pytest.raises(ValueError, match="over the bound"):
        N.every_with(p, p.withColumnsRenamed({"row_id": "proto_id", "x": "v"}))
    assert [sorted(map(tuple, f(p).collect())) for f in searches] == within


@pytest.mark.parametrize("p,want", [([0.01, 0.02, 0.03, 0.04], [0.04, 0.06, 0.06, 0.06]), ([0.5, 0.6, 0.7], [1.0, 1.0, 1.0]), ([0.001, 0.9], [0.002, 0.9])])
def test_holm_by_hand(spark, p, want):
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    assert [r.p_holm for r in T.holm(df, "p", ["id"]).orderBy("id").collect()] == pytest.approx(want)


def test_signed_rank_counts(spark):
    got = spark.range(1).select(T.signed_rank_counts(F.lit(4)).alias("c")).first().c
    assert got == [1, 1, 1, 2, 2, 2, 2, 2, 1, 1, 1]


def test_incomplete_scores_are_refused(golden):
    assert T.complete(golden, list(METHODS)) is golden
    for bad in (golden.where("block < 1"), golden.where("not (block = 3 and treatment = 'S')")):
        with pytest.raises(ValueError):
            T.complete(bad)
    with pytest.raises(ValueError):
        T.complete(golden, ["S"])


def test_path_components(spark):
    n = 40
    v = spark.range(n + 2).select(F.col("id").alias("vid"))
    e = spark.range(n).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert {r.comp for r in H.components(v, e).collect()} == {0, n + 1}
    assert tuple(H.betti(v, e).first()) == (2, 0)


def test_campaign_on_the_cluster(spark):
    rows = [("d", i, i % 2, [math.cos(i) + 2 * (i % 2), math.sin(i)]) for i in range(80)]
    df = spark.createDataFrame(rows, "dataset string, row_id long, label int, x array<double>")
    out = K.run_campaign(K.with_folds(df, 4), 4, methods=("RSP3", "Random", "Skeleton", "Full"), folds=[0, 2]).collect()
    assert len(out) == 2 * 5 and {r.fold for r in out} == {0, 2}
    assert all(json.loads(r.class_counts) for r in out)
    with pytest.raises(ValueError):
        K.run_campaign(K.with_folds(df, 4), 4, folds=[7])


def test_stream_scores_like_a_batch(spark, sf, tmp_path):
    from tessera.queries import frozen

    p, v, s = frozen(spark, sf)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    p.select("row_id", "x").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("row_id long, x array<double>").option("maxFilesPerTrigger", 2).parquet(src)
    score.start(stream, v, s, out, str(tmp_path / "cp")).awaitTermination()
    got = {r.row_id: r.predicted for r in spark.read.parquet(out).collect()}
    assert got == {r.row_id: r.predicted for r in score.score_batch(p.select("row_id", "x"), v, s).collect()}


def test_windowed_counts_over_a_stream(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = score.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == ev.count()


def test_battery_on_published_scores(spark, golden):
    from tessera.plans import battery

    rows = golden.select(F.concat(F.lit("d"), "block").alias("dataset"), F.lit(0).alias("fold"), F.when(F.col("treatment") == "S", "Skeleton+Graph").otherwise(F.col("treatment")).alias("method"), F.col("score").alias("acc_1nn"))
    one = rows.where("method = 'Skeleton+Graph'").withColumns({"method": F.lit("Skeleton+1NN"), "acc_1nn": F.col("acc_1nn") - 0.001 * (F.hash("dataset") % 3)})
    out = battery.battery(rows.unionByName(one), "Skeleton+Graph")
    assert out["ranks"].count() == 8 and out["comparison"].count() == 7 and out["scores"].count() == 17
    ab = battery.ablation(rows.unionByName(one)).first()
    assert ab.wins + ab.losses + ab.ties == 17
    with pytest.raises(ValueError):
        battery.ablation(rows.unionByName(rows.where("method = 'Skeleton+Graph'").withColumn("method", F.lit("Skeleton+1NN"))))


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.dat", BANANA + "1.0,2.0,1.0\n")
        z.writestr("readme.txt", "no")
    got = keel.read_zip_lines(spark, str(tmp_path / "a.zip")).orderBy("line_no").collect()
    assert {r.member for r in got} == {"x.dat"} and got[-1].value == "1.0,2.0,1.0"


def test_command_line(spark, tmp_path):
    from tessera.__main__ import main
    from tessera.sources.synthetic import moons

    moons(spark, 120).withColumn("dataset", F.lit("moons")).write.parquet(str(tmp_path / "in"))
    main(["campaign", str(tmp_path / "in"), str(tmp_path / "out"), "--folds", "4", "--only-folds", "0", "--methods", "RSP3", "Random", "Full"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
