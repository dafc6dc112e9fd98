from pyspark.sql import functions as F

from tabsift.config import CONFIG, with_config
from tabsift.plans.assess import assess_folder, attached_metadata, dataset_names, load_file
from tabsift.sources import files, tables

SHAPES = {
    "eu_cohort.csv": ("id;val;txt\n1;2,5;a\n2;3,5;b", ";"), "us_cohort.csv": ("id,val,txt\n1,2.5,a\n2,3.5,b", ","),
    "tabbed.tsv": ("id\tval\n1\t2", "\t"), "pipes.csv": ("id|val\n1|x,y\n2|z", "|"), "single.csv": ("id\n1", ","),
    "headers.csv": ("id,,val,val\n1,2,3,4", ","), "quoted.csv": ('id;note\n1;"a,b;c"\n2;"d"', ";"),
}


def test_separators(spark):
    df = spark.createDataFrame([(n, t) for n, (t, _) in SHAPES.items()], "name string, text string")
    got = {r["name"]: r["s"] for r in df.select("name", files.sniff_separator(F.col("text"), F.col("name")).alias("s")).collect()}
    assert got == {n: s for n, (_, s) in SHAPES.items()}


def test_latin1_semicolon_file_with_decimal_commas(spark, tmp_path):
    path = tmp_path / "labor.csv"
    path.write_bytes("id;wert;einheit\n1;2,5;µg\n2;3,75;µg\n".encode("latin1"))
    df, note = load_file(spark, str(path))
    assert note == "non_utf8_latin1_fallback"
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "2.5", "µg"), ("2", "3.75", "µg")]


def test_documentation_text_decoding(spark):
    rows = [("a.md", b"caf\xff\xc3\xa9"), ("b.csv", "µg".encode("latin1")), ("c.pdf", b"x"), ("d.txt", b"plain")]
    got = {r["name"]: r["text"] for r in files.documentation_text(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got == {"a.md": "café", "b.csv": "µg", "d.txt": "plain"}


def test_attached_metadata(spark, tmp_path):
    for name, text in {"eu_cohort_metadata.json": '{"id_fields": ["id"], "_instructions": 1}', "Codebook_eu.csv": "variable name,unit",
                       "readme.md": "privacy protected", "unrelated.txt": "conversion table", "METADATA_GUIDE.md": "ignored",
                       "us_metadata.json": "{broken"}.items():
        (tmp_path / name).write_text(text)
    two = attached_metadata(spark, ["eu_cohort", "us_cohort"], str(tmp_path))
    assert two["eu_cohort"]["id_fields"] == ["id"] and "privacy protected" in two["eu_cohort"]["documentation_text"]
    assert "variable name" in two["us_cohort"]["documentation_text"] and "conversion" not in two["us_cohort"]["documentation_text"]
    one = attached_metadata(spark, ["other"], str(tmp_path))["other"]
    assert "conversion table" in one["documentation_text"] and "ignored" not in one["documentation_text"]


def test_tables_missing_or_empty_are_absent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, " x "), ("b", 2, None)], "dataset string, n long, v string")
    tables.write_table(df, str(tmp_path), "t", "csv")
    assert sorted((r["dataset"], r["v"]) for r in tables.read_table(spark, str(tmp_path), "t", "csv").fillna("").collect()) == [("a", " x "), ("b", "")]
    tables.write_table(df.where("dataset = 'a'").withColumn("v", F.lit("new")), str(tmp_path), "t", "csv")
    assert tables.read_table(spark, str(tmp_path), "t", "csv").count() == 2
    assert tables.read_table(spark, str(tmp_path), "nothing") is None


def test_assess_folder_end_to_end(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    lines = ["patient_id;age;glucose;sex"] + [f"{i};{20 + i % 50};{4 + i % 7},{i % 10};{'m' if i % 2 else 'f'}" for i in range(60)]
    (data / "clinic.csv").write_text("\n".join(lines))
    (data / "empty.csv").write_text("")
    plain = with_config(anomaly={m: {**CONFIG["anomaly"][m], "enabled": False} for m in ("isolation_forest", "local_outlier_factor")},
                        injection={"rates": []})
    status = {r["dataset"]: r["status"] for r in assess_folder(spark, str(data), None, str(out), plain).collect()}
    assert status == {"clinic": "ok", "empty": "failed"}
    profile = tables.read_table(spark, str(out), "all_dataset_quality_profiles").first()
    assert profile["rows"] == 60 and profile["columns"] == 4
    roles = {r["column"]: r["role"] for r in tables.read_table(spark, str(out), "schema_profile").collect()}
    assert roles["patient_id"] == "identifier" and roles["glucose"] == "continuous_measurement" and roles["sex"] == "binary"
    assert all(0 <= profile[c] <= 1 for c in ("C(D)", "A(D)", "R(D)", "composite_quality_index"))


def test_quoted_cells_of_real_files(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note,val\n1,"line one\nline two",5\n2,"say ""hi"", ok",6\n3,,\n4,short\n')
    df, _ = load_file(spark, str(path))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "line one\nline two", "5"), ("2", 'say "hi", ok', "6"), ("3", None, None), ("4", "short", None)]


def test_ragged_and_unreadable_files_fail_with_a_message(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "ragged.csv").write_text("id,val\n" + "".join(f"{i},1\n" for i in range(80)) + "99,2,LOST\n")
    (data / "book.xlsx").write_bytes(b"PK\x03\x04 not a table")
    (data / "same.csv").write_text("id,val\n1,2\n2,3\n")
    (data / "same.xls").write_bytes(b"\xd0\xcf\x11")
    got = {r["dataset"]: (r["status"], r["error"]) for r in assess_folder(spark, str(data), None, str(tmp_path / "out")).collect()}
    assert set(got) == {"ragged", "book", "same.csv", "same.xls"} and got["same.csv"] == ("ok", None)
    assert got["ragged"][0] == "failed" and "ragged.csv" in got["ragged"][1] and "99" in got["ragged"][1]
    assert got["book"] == ("failed", "ValueError: book.xlsx: files of type .xlsx can't be read") and got["same.xls"][0] == "failed"
    assert dataset_names(["a.csv", "b.csv", "b.tsv"]) == {"a.csv": "a", "b.csv": "b.csv", "b.tsv": "b.tsv"}


def test_metadata_keeps_json_types(spark, tmp_path):
    (tmp_path / "clinic.json").write_text('{"versioning": "2.0", "license": "true", "standards": ["ICD-10", "LOINC"], "open": true, "title": "T"}')
    m = attached_metadata(spark, ["clinic"], str(tmp_path))["clinic"]
    assert m["versioning"] == "2.0" and m["license"] == "true" and m["standards"] == ["ICD-10", "LOINC"] and m["open"] is True


def test_the_ragged_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from tabsift.queries import files
    for part in range(3):
        spark.createDataFrame([(k, k, "5-LOW") for k in range(part * 40, part * 40 + 40)], "o_orderkey long, o_custkey long, o_orderpriority string").coalesce(1) \
             .write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([("FRANCE",)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    monkeypatch.setattr(files, "target", lambda s, name: f"{tmp_path}/{name}")
    found = {r["dataset"]: (r["status"], r["error"], r["n_rows"]) for r in files._status(spark, str(tmp_path)).collect()}
    assert found["good.csv"] == ("ok", None, 120)
    assert found["ragged.csv"] == ("failed", "RaggedFile: ragged.csv: the row that starts with '5' has more than 2 cells", None)
    texts = [p.read_text().splitlines() for p in (tmp_path / "status" / "ragged.csv").glob("part-*")]
    assert len(texts) == 3 and all(t[0] == "id,code" for t in texts) and sum(len(t) - 1 for t in texts) == 120
