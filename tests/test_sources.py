import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from multisvm.sources import embeddings, read_labeled_csv, read_libsvm, train_test_split, with_split
from multisvm.functions.hashing import fraction_threshold


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="multisvm-test-"), name)


def test_libsvm_tiny_honours_num_features(spark):
    path = _tmp("tiny.libsvm")
    with open(path, "w") as f:
        f.write("0 1:0.5 3:1.5\n1 2:2.0\n2 1:1.0 2:1.0 3:1.0\n1 3:-1.0\n0 1:0.25\n")
    df = read_libsvm(spark, path, num_features=6)
    rows = df.collect()
    assert len(rows) == 5
    assert all(r.features.size == 6 for r in rows)
    got = sorted((r.label, list(r.features.toArray())) for r in rows)  # ids are content hashes: no file order
    assert got == [
        (0, [0.25, 0.0, 0.0, 0.0, 0.0, 0.0]), (0, [0.5, 0.0, 1.5, 0.0, 0.0, 0.0]), (1, [0.0, 0.0, -1.0, 0.0, 0.0, 0.0]),
        (1, [0.0, 2.0, 0.0, 0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0, 0.0, 0.0, 0.0]),
    ]


def test_csv_tiny_trims_spaces_and_takes_last_field_as_label(spark):
    path = _tmp("tiny.csv")
    with open(path, "w") as f:
        for i in range(3):
            vals = [f" {i + j / 10} " for j in range(16)] + [f" {i} "]
            f.write(",".join(vals) + "\n")
    df = read_labeled_csv(spark, path, 16)
    rows = df.orderBy("label").collect()
    assert [r.label for r in rows] == [0, 1, 2]
    assert rows[2].features[:3] == [2.0, 2.1, 2.2]


def test_hash_split_is_stable_and_disjoint(spark):
    df = embeddings(spark, SF_SMALL)
    tr, te = train_test_split(df)
    a = {r.id for r in tr.select("id").collect()}
    b = {r.id for r in te.select("id").collect()}
    assert not a & b and len(a | b) == df.count()
    again = {r.id for r in with_split(df.repartition(3)).where("split = 'train'").select("id").collect()}
    assert again == a
    assert 0.35 < len(a) / (len(a) + len(b)) < 0.65


def test_fraction_threshold():
    assert fraction_threshold(0.5) == "80000000"
    assert fraction_threshold(0.25) == "40000000"
    assert fraction_threshold(1.0) is None


def test_from_columns_indexes_string_labels_scales_and_keys(spark):
    from multisvm.sources import from_columns

    df = spark.createDataFrame(
        [(1, 1, "R", 10.0, -0.5), (1, 2, "A", -20.0, 0.25), (2, 1, "N", 5.0, None), (3, 1, "A", 0.0, 0.0)],
        "k1 long, k2 int, flag string, a double, b double")
    out = {r.id: r for r in from_columns(df, ["a", "b"], "flag", ["k1", "k2"]).collect()}
    assert sorted(out) == ["1:1", "1:2", "3:1"]  # the row with a null feature is dropped
    assert out["1:1"].label == 1 and out["1:2"].label == 0  # A=0, R=1 (N only on the dropped row)
    assert out["1:1"].features == [0.5, -1.0] and out["1:2"].features == [-1.0, 0.5]


def test_lineitem_loader(spark):
    from multisvm.sources import lineitem

    df = lineitem(spark, SF_SMALL)
    row = df.agg(F.count("*").alias("n"), F.max(F.array_max("features")).alias("mx"),
                 F.countDistinct("label").alias("k")).first()
    assert row.n == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert row.mx <= 1.0 and row.k == 3


def test_what_would_be_lost_in_silence_is_an_error(spark):
    import pytest
    from multisvm.sources.tables import labelled

    ok = "id long, label double, features array<double>"
    for row in [(None, 1.0, [1.0]), (1, 0.5, [1.0]), (1, 1.0, [None]), (1, 1.0, [float("nan")])]:
        with pytest.raises(Exception):
            labelled(spark.createDataFrame([row], ok)).collect()
    assert labelled(spark.createDataFrame([(1, None, [1.0]), (2, 1.0, None), (3, 2.0, [1.0])], ok)).count() == 1


def test_csv_with_an_empty_cell_is_an_error(spark):
    import pytest

    path = _tmp("hole.csv")
    with open(path, "w") as f:
        f.write("1.0,2.0,0\n1.0,,1\n")
    with pytest.raises(Exception):
        read_labeled_csv(spark, path, 2).collect()


def test_generated_ids_do_not_depend_on_the_file_layout(spark):
    rows = [f"{i % 3} 1:{i / 7} 3:{i}" for i in range(60)]
    ids = []
    for parts in (1, 7):
        path = _tmp(f"layout{parts}")
        spark.createDataFrame([(r,) for r in rows], "value string").repartition(parts).write.text(path)
        ids.append(sorted(r.id for r in read_libsvm(spark, path, num_features=4).collect()))
    assert ids[0] == ids[1] and len(set(ids[0])) == 60


def test_split_sides_add_up(spark):
    df = embeddings(spark, SF_SMALL)
    a, b = train_test_split(df)
    assert a.count() + b.count() == df.count()


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    import types

    import pytest
    from multisvm import session

    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError):
        session.checkpoint_dir(types.SimpleNamespace(sparkContext=sc, conf=conf))


def test_scratch_tables_are_deleted(spark):
    from multisvm.session import clear_scratch, scratch_path

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    assert not os.path.exists(path.removeprefix("file:"))
