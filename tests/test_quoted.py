import random

import pytest
from conftest import rows

from casewatch.sources import readers
from casewatch.sources.quoted import read_quoted


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def field(rng):
    kind = rng.randrange(6)
    body = "".join(rng.choices(["a", "b c", "é", ",", "\t", '""', "\n", "\n\n"], k=rng.randrange(1, 12)))
    return '"' + body + '"' if kind else rng.choice(["plain", "", "x y"])


@pytest.mark.parametrize("seed, sep", [(1, ","), (2, "\t")])
def test_equal_to_the_multi_line_reader(small_splits, tmp_path, seed, sep):
    spark, rng = small_splits, random.Random(seed)
    folder = tmp_path / "drugs.csv"
    folder.mkdir()
    for part in range(2):
        lines = ["id" + sep + '"name"' + sep + "text"] + [f"{part}-{i}{sep}{field(rng)}{sep}{field(rng)}" for i in range(150)]
        lines[60] = f'{part}-big{sep}"{"long\n" * 400}"{sep}"after"'  # over several splits
        lines[80] = f"{part}-short"
        (folder / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    whole = spark.read.options(header="true", multiLine="true", escape='"', sep=sep).csv(str(folder))
    got = read_quoted(spark, str(folder), sep)
    assert got.columns == whole.columns and rows(got) == rows(whole) and got.count() == 300
    assert got.rdd.getNumPartitions() > 10


def test_empty_and_single_line_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    assert rows(read_quoted(spark, str(tmp_path / "a.csv"))) == []
    (tmp_path / "b.csv").write_text('x,y\r\n1,"two\nlines"\r\n3,4')
    assert rows(read_quoted(spark, str(tmp_path / "b.csv"))) == [("1", "two\nlines"), ("3", "4")]


def test_an_unreadable_review_file_is_left_out(spark, tmp_path, caplog):
    (tmp_path / "drugsComTrain_raw.tsv").write_text("drugName\treview\nAdvil\tgood\n")
    bad = tmp_path / "drugsComTest_raw.csv"
    bad.mkdir()
    (bad / "part-0.csv.gz").write_bytes(b"not a gzip file")
    got = readers.read_reviews(spark, str(tmp_path))
    assert rows(got.select("drugname", "review")) == [("Advil", "good")]
    assert "drugsComTest_raw.csv left out" in caplog.text
