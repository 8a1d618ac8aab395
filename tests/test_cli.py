import json
import os
import tempfile

from multisvm.__main__ import main


def test_cli_runs_each_program_on_libsvm(spark, capsys):
    path = os.path.join(tempfile.mkdtemp(prefix="multisvm-cli-"), "blobs.libsvm")
    with open(path, "w") as f:
        for i in range(120):
            c = i % 3
            x, y = [(2.0, 0.0), (-2.0, 0.0), (0.0, 2.5)][c]
            f.write(f"{c} 1:{x + (i % 7) * 0.05} 2:{y - (i % 5) * 0.05} 3:1.0\n")
    for scheme in ("ova", "ovo", "tree"):
        report = main([scheme, "--input", path, "--num-features", "3", "--iterations", "30", "--step", "1.0",
                       "--batch-fraction", "1.0", "--kmeans-init", "first_last", "--json"])
        out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert out["rows"] == 120 and report["test_accuracy"] == 1.0
        assert [r["label"] for r in out["by_label"]] == [0, 1, 2]


def test_cli_separate_test_file_and_checkpoint(spark, capsys):
    d = tempfile.mkdtemp(prefix="multisvm-cli2-")
    for name, offset in (("train.csv", 0), ("test.csv", 1)):
        with open(os.path.join(d, name), "w") as f:
            for i in range(60):
                c = i % 2
                f.write(f" {(-1.0 if c else 1.0) + 0.01 * ((i + offset) % 5)} , 1.0 , {c}\n")
    report = main(["ova", "--input", os.path.join(d, "train.csv"), "--test-input", os.path.join(d, "test.csv"),
                   "--format", "csv", "--num-features", "2", "--iterations", "15", "--step", "1.0",
                   "--batch-fraction", "1.0", "--checkpoint", "yes", "--json"])
    assert report["rows"] == 120 and report["test_accuracy"] == 1.0 and report["train_accuracy"] == 1.0


def test_cli_libsvm_test_file_with_a_higher_index(spark, capsys):
    d = tempfile.mkdtemp(prefix="multisvm-cli3-")
    for name, last in (("train", 3), ("test", 6)):
        with open(os.path.join(d, name), "w") as f:
            for i in range(60):
                f.write(f"{i % 2} 1:{1.0 if i % 2 else -1.0} {last}:{0.01 * (i % 5) + 0.01}\n")
    report = main(["ova", "--input", os.path.join(d, "train"), "--test-input", os.path.join(d, "test"),
                   "--iterations", "10", "--step", "1.0", "--batch-fraction", "1.0", "--json"])
    assert report["rows"] == 120 and report["test_accuracy"] == 1.0
