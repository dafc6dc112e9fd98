import csv
import io
import random

import pytest

from tabsift.plans.assess import load_file
from tabsift.sources import delimited, files


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, so that rows begin, go on and end anywhere in them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for k, v in old.items():
        spark.conf.set(k, v)


CELLS = ["plain", "", 'say "hi"', "a;b", "two\nlines", "\n", '"', '""', 'ends "\n', "x" * 40, "many\n\n\nlines", '";"', 'mid " quote', "é\nü", " padded ", "\r\n", "long\n" * 200]


def _file(rng, n, columns):
    rows = [[rng.choice(CELLS) for _ in range(columns)] for _ in range(n)]
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    writer.writerow([f"h{i}" for i in range(columns)])
    for i, r in enumerate(rows):
        writer.writerow([f"{i}", *r[1:]])
    return out.getvalue(), [[f"{i}", *r[1:]] for i, r in enumerate(rows)]


@pytest.mark.parametrize("size,broadcast", [(150, True), (400, True), (400, False), (1 << 20, True)])
def test_rows_are_cut_alike_wherever_splits_begin(spark, tmp_path, small_splits, size, broadcast, monkeypatch):
    rng = random.Random(size)
    text, rows = _file(rng, 30 if size < 500 else 200, 4)
    (tmp_path / "a.csv").write_text(text, newline="")
    small_splits(size)
    if not broadcast:
        monkeypatch.setattr(delimited, "BROADCAST_SPLITS", 0)
    monkeypatch.setattr(delimited, "ROW_SPLITS", 1000)
    df = files.read_delimited(spark, str(tmp_path / "a.csv"), ";")
    assert df.columns == ["h0", "h1", "h2", "h3"]
    got = sorted((int(r[0]), *(v or "" for v in r[1:])) for r in df.collect())
    assert got == sorted((int(r[0]), *r[1:]) for r in rows)
    splits = delimited.physical_lines(spark, str(tmp_path / "a.csv"), "UTF-8").select("start").distinct().count()
    assert splits > (5 if size < 1000 else 0)


def test_folders_latin1_carriage_returns_and_no_last_break(spark, tmp_path, small_splits):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "p0.csv").write_bytes("id;note\r\n1;\"µ\r\ng\"\r\n2;plain\r\n".encode("latin1"))
    (folder / "p1.csv").write_bytes('id;note\r\n3;"open"\r\n\r\n4;"la""st"'.encode("latin1"))
    small_splits(20)
    df = files.read_delimited(spark, str(folder), ";", encoding="ISO-8859-1")
    assert sorted(tuple(r) for r in df.collect()) == [("1", "µ\r\ng"), ("2", "plain"), ("3", "open"), ("4", 'la"st')]


def test_inches_in_plain_cells_open_nothing(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text('id,size\n1,5" pipe\n2,"6"" pipe"\n3,7" pipe\n')
    small_splits(5)
    assert sorted(tuple(r) for r in files.read_delimited(spark, str(tmp_path / "t.csv"), ",").collect()) == [("1", '5" pipe'), ("2", '6" pipe'), ("3", '7" pipe')]


def test_a_quote_that_never_closes_is_an_error(spark, tmp_path, small_splits, monkeypatch):
    (tmp_path / "t.csv").write_text('id,note\n1,"open\n' + "".join(f"{k},x\n" for k in range(2000)))
    small_splits(400)
    monkeypatch.setattr(delimited, "ROW_SPLITS", 8)
    with pytest.raises(Exception, match="goes on through"):
        files.read_delimited(spark, str(tmp_path / "t.csv"), ",").collect()


def test_ragged_rows_across_splits(spark, tmp_path, small_splits):
    (tmp_path / "r.csv").write_text("id,val\n" + "".join(f'{i},"a\nb"\n' for i in range(80)) + '99,2,"LO\nST"\n')
    small_splits(200)
    with pytest.raises(files.RaggedFile, match="99"):
        load_file(spark, str(tmp_path / "r.csv"))


def test_a_file_is_read_by_as_many_tasks_as_it_has_splits(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text("id,note\n" + "".join(f'{k},"line\n{k}"\n' for k in range(3000)))
    small_splits(4000)
    rows = delimited.quoted_rows(spark, str(tmp_path / "t.csv"), ",")
    assert rows.count() == 3001
    lines = delimited.physical_lines(spark, str(tmp_path / "t.csv"), "UTF-8")
    assert lines.rdd.getNumPartitions() >= 9
