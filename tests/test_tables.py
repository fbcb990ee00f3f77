import csv
import random
import time

import pytest
from pyspark.sql import functions as F

from wordloom.constants import DETECTION_ERROR, ENTER_TEXT, UNSUPPORTED_LANGUAGE
from wordloom.operators import dataset, evaluate, language, validate
from wordloom.operators.clean import process_table
from wordloom.options import CleanOptions
from wordloom.sources import csv_records, scratch, sinks, tables

LOWER = CleanOptions(convert_to_lowercase=True)


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", now\nthen'), (2, None), (3, " spaced "), (4, "back\\slash")]
    df = spark.createDataFrame(rows, "id int, text string")
    path = sinks.write_result(df, str(tmp_path), sinks.PROCESSED)
    assert "/processedCsv_" in path
    back = tables.read_table(spark, path)
    assert back.dtypes == [("id", "string"), ("text", "string")]
    assert sorted((int(r.id), r.text) for r in back.collect()) == rows


def one_task(spark, path, schema=None):
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    return (reader.schema(schema) if schema else reader).csv(path)


ODD_CELLS = ["", "a", "two\nlines", 'a "quoted" word', '"', '""', ",", "x,y\n,", "\n", " pad ", "é\n東京", "l1\nl2\nl3\n\nl5", "5 7", "end\n"]


@pytest.mark.parametrize("size", [7, 16, 40, 150, 10_000])
def test_csv_of_one_file_is_read_by_many_tasks(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(str(i), *(rng.choice(ODD_CELLS) for _ in range(3))) for i in range(80)]
    path = str(tmp_path / "one.csv")
    with open(path, "w", encoding="utf-8", newline="") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerows([("id", "a", "b\nc", "d")] + rows)
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    wanted = sorted(map(tuple, one_task(spark, path).collect()), key=repr)
    assert len(wanted) == 80
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert csv_records._lines(spark, path).rdd.getNumPartitions() > 3
        found = tables.read_table(spark, path)
        assert found.columns == one_task(spark, path).columns
        assert sorted(map(tuple, found.collect()), key=repr) == wanted
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_csv_with_quotes_in_plain_cells_and_returns(spark, tmp_path):
    (tmp_path / "t.csv").mkdir()
    body = ['id,text\r\n1,5" pipe\r\n2,"a ""b""\r\nc"\r\n\r\n3,\r\n4,""\r\n', "id,text\n5,x\n6,it's 6\" and 7\"\n7,\"open\nto the end"]
    for i, text in enumerate(body):
        (tmp_path / "t.csv" / f"part-{i}.csv").write_text(text, encoding="utf-8", newline="")
    path = str(tmp_path / "t.csv")
    found = {r.id: r.text for r in tables.read_table(spark, path, "id int, text string").collect()}
    assert found.pop(2) == 'a "b"\r\nc'
    assert found == {r.id: r.text for r in one_task(spark, path, "id int, text string").where("id <> 2").collect()}
    assert found[1] == '5" pipe' and found[3] is None and found[6] == "it's 6\" and 7\"" and len(found) == 6


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,text\n")
    found = tables.read_table(spark, str(tmp_path / "e.csv"))
    assert found.columns == ["id", "text"] and found.count() == 0


@pytest.mark.parametrize("line, state, after", [('a"b,c', 0, 0), ('"a', 0, 1), ('"a""', 0, 1), ('"a""",b', 0, 0), ('x,"', 0, 1), ('b",c', 1, 0), ('b"",c', 1, 1), ('b","', 1, 1), ('"x"y"z,w', 0, 0)])
def test_state_after_a_line(line, state, after):
    assert csv_records.state_after(line, state) == after


def test_only_csv_names_are_read(spark):
    with pytest.raises(ValueError, match="not a CSV"):
        tables.read_table(spark, "/nowhere/table.xlsx")


def test_single_file(spark, tmp_path):
    path = sinks.write_result(spark.range(100).repartition(4), str(tmp_path), "x", single_file=True)
    import glob

    assert len(glob.glob(f"{path}/part-*")) == 1


def test_load_training(spark, tmp_path, caplog):
    rows = spark.createDataFrame([(1, "a", 1, "en"), (2, "b", 2, "tr")], "id bigint, text string, category int, lang string")
    assert [r.id for r in tables.load_training(spark, "tr", rows).collect()] == [2]
    rows.drop("lang").write.parquet(f"{tmp_path}/en")
    assert tables.load_training(spark, "en", {"en": f"{tmp_path}/en"}).count() == 2
    assert tables.load_training(spark, "tr", rows.replace("en", "fr", "lang"), supported=("fr", "tr")).count() == 1
    for language_code, source in [("de", {"de": f"{tmp_path}/en"}), ("en", f"{tmp_path}/missing"), ("de", rows)]:
        empty = tables.load_training(spark, language_code, source)
        assert empty.isEmpty() and empty.columns == ["id", "text", "category"]
    assert caplog.text.count("could not load") == 3


def test_jdbc_slices():
    assert tables.jdbc_slices(1, 2_500_000) == {"lowerBound": 1, "upperBound": 2_500_001, "numPartitions": 3}
    assert tables.jdbc_slices(5, 5)["numPartitions"] == 1


def test_training_source(spark):
    a, b = spark.range(1), spark.range(2)
    assert tables.training_source(a, b) is a and tables.training_source(None, b) is b
    with pytest.raises(ValueError):
        tables.training_source(None, None)


class FakeSession:
    """A session whose settings name a checkpoint folder, or whose context was given one."""

    def __init__(self, folder, given=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.given = given

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return self.given


def test_scratch_follows_the_session(spark):
    assert scratch.scratch_folder(FakeSession("hdfs://shared/x/")) == "hdfs://shared/x"
    assert scratch.scratch_folder(FakeSession(None, "hdfs://given/y")) == "hdfs://given/y"
    assert scratch.scratch_path(FakeSession("/shared"), "t").startswith("/shared/wordloom/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_folder(FakeSession(None))
    assert scratch.materialise(spark.range(3), "t").count() == 3


def test_intermediates_go_when_nothing_reads_them(spark):
    import glob

    def folders():
        return glob.glob(f"{scratch._session_folder(spark, scratch.scratch_folder(spark))}/dropped-*".removeprefix("file:"))

    table = scratch.materialise(spark.range(5), "dropped")
    derived = table.where("id > 1").groupBy().count()
    del table
    scratch.sweep(spark, collect=True)
    assert len(folders()) == 1 and derived.first()[0] == 3
    del derived
    for _ in range(20):
        scratch.sweep(spark, collect=True)
        if not folders():
            break
        time.sleep(0.2)
    assert not folders()


def test_columns(spark):
    df = spark.createDataFrame([(1, "x")], "id int, `a b` string")
    assert tables.list_columns(df) == [(0, "id"), (1, "a b")]
    assert validate.select_columns(df, ["a b"]).columns == ["a b"]
    with pytest.raises(ValueError, match="nope"):
        validate.select_columns(df, ["nope"])
    with pytest.raises(ValueError, match="no column"):
        validate.select_columns(df, [])


def test_row_status(spark):
    df = spark.createDataFrame([(1, "   "), (2, None), (3, "ok then")], "id int, text string")
    checked = validate.validate_rows(df, "text", LOWER)
    assert {r.id: r.status for r in checked.collect()} == {1: ENTER_TEXT, 2: ENTER_TEXT, 3: "ok"}
    assert {r.id for r in validate.row_errors(checked).collect()} == {1, 2}
    with pytest.raises(ValueError):
        validate.validate_rows(df, "text", CleanOptions())


def test_marked_errors(spark):
    df = spark.createDataFrame([(1, DETECTION_ERROR), (2, "fine"), (3, None)], "id int, x string")
    assert {r.id: r.status for r in validate.mark_errors(df, "x").collect()} == {1: DETECTION_ERROR, 2: "ok", 3: "ok"}


def test_null_cells(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, n int")
    assert [r.n for r in validate.text_cells(df, ["n"]).orderBy("id").collect()] == [None, "5"]
    assert [r.n for r in validate.text_cells(df, ["n"], "nan").orderBy("id").collect()] == ["nan", "5"]


def test_detection(spark, sentences, profiles):
    out = language.detect_language(sentences, "id", "text", profiles)
    assert out.count() == 12
    assert all(r.id.startswith(r.lang) and r.status == "ok" for r in out.collect())


def test_detection_without_letters(spark, profiles):
    df = spark.createDataFrame([(1, "42 !"), (2, None), (3, ""), (4, "the weather and the rain")], "id int, text string")
    out = {r.id: (r.lang, r.status) for r in language.detect_language(df, "id", "text", profiles).collect()}
    assert out == {1: (None, DETECTION_ERROR), 2: (None, DETECTION_ERROR), 3: (None, DETECTION_ERROR), 4: ("en", "ok")}


def test_detection_of_rows_with_odd_ids(spark, sentences, profiles):
    odd = sentences.withColumn("id", F.when(F.col("id") != "en0", F.lit("same")))
    out = language.detect_language(odd, "id", "text", profiles)
    assert out.count() == 12 and out.where("lang IS NULL").count() == 0
    with pytest.raises(ValueError, match="top"):
        language.detect_language(sentences, "id", "text", profiles, top=5)
    english = odd.where("lang = 'en'")
    lower = process_table(english.withColumn("text", F.upper("text")), "id", ["text"], LOWER, profiles)
    assert lower.exceptAll(english).isEmpty() and lower.count() == english.count()


def test_detection_without_profiles(spark, sentences, profiles):
    out = language.detect_language(sentences, "id", "text", profiles.limit(0)).collect()
    assert {(r.lang, r.status) for r in out} == {(None, DETECTION_ERROR)} and len(out) == 12


def test_profile_ranks(spark):
    df = spark.createDataFrame([("ab ab c", "xx"), ("Ab!", "xx"), ("lost", None)], "text string, lang string")
    rows = language.language_profiles(df, "text", "lang").orderBy("rank").collect()
    assert [(r.gram, r.n, r.rank) for r in rows] == [("_ab", 3, 1), ("ab_", 3, 2), ("_c_", 1, 3)]
    assert language.language_profiles(df, "text", "lang", top=1).count() == 1


def test_gate(spark):
    df = spark.createDataFrame([("en",), ("tr",), ("fr",), (None,)], "lang string")
    gates = [r.gate for r in language.language_gate(df, "lang").collect()]
    assert gates == ["ok", "ok", UNSUPPORTED_LANGUAGE, UNSUPPORTED_LANGUAGE]


def test_process_table_in_place(spark, sentences, profiles):
    df = sentences.select("id", F.upper("text").alias("text"), F.lit("x").alias("a b"), "lang").unionByName(
        spark.createDataFrame([("none", "42  7", "x", "-")], "id string, text string, `a b` string, lang string")
    )
    options = CleanOptions(convert_to_lowercase=True, remove_stopwords=True)
    out = process_table(df, "id", ["text"], options, profiles)
    assert out.columns == df.columns and out.count() == 13
    rows = {r.id: r.text for r in out.collect()}
    assert rows["none"] == "42  7"
    assert "the" not in rows["en0"].split() and "weather" in rows["en0"]
    assert "dans" not in rows["fr0"].split() and "temps" in rows["fr0"]


def classes(spark, counts):
    rows = [(i * 100 + j, name) for i, (name, n) in enumerate(counts.items()) for j in range(n)]
    return spark.createDataFrame(rows, "id int, c string")


def distribution(df):
    return {r.c: r.n for r in dataset.class_distribution(df, "c").collect()}


def test_low_classes(spark):
    df = classes(spark, {"a": 5, "b": 3, "c": 1, None: 2})
    assert distribution(df) == {"a": 5, "b": 3, "c": 1}
    assert distribution(dataset.remove_low_classes(df, "c")) == {"a": 5, "b": 3}


def test_balance(spark):
    df = classes(spark, {"a": 5, "b": 3, "c": 1})
    assert distribution(dataset.balance(df, "id", "c")) == {"a": 1, "b": 1, "c": 1}


def test_balance_draws_the_lowest_hashes(spark):
    df = classes(spark, {"a": 90, "b": 37, None: 5})
    out = dataset.balance(df, "id", "c", seed=7)
    assert distribution(out) == {"a": 37, "b": 37}
    by_hash = sorted((r.h, r.id) for r in df.where("c = 'a'").select("id", F.expr("md5(concat('7:', id))").alias("h")).collect())
    assert {r.id for r in out.where("c = 'a'").collect()} == {i for _, i in by_hash[:37]}
    assert out.exceptAll(dataset.balance(df, "id", "c", seed=7)).isEmpty()
    assert not out.exceptAll(dataset.balance(df, "id", "c", seed=8)).isEmpty()


@pytest.mark.parametrize("n, size, expected", [(11, 0.2, 3), (10, 0.2, 2), (1, 0.5, 1), (997, 0.33, 330), (0, 0.2, 0)])
def test_split_sizes(spark, n, size, expected):
    out = dataset.split(spark.range(n), "id", size)
    assert out.count() == n and out.where("is_test").count() == expected


def test_split_with_text_ids(spark):
    df = spark.range(50).select(F.concat(F.lit("k"), "id").alias("id"))
    assert dataset.split(df, "id").where("is_test").count() == 10


def test_bad_split(spark):
    with pytest.raises(ValueError):
        dataset.split(spark.range(3), "id", 1.0)


def test_balance_actions(spark):
    df = classes(spark, {"a": 2})
    assert dataset.balance_action(df, "id", "c", "use_as_is") is df
    with pytest.raises(ValueError, match="shuffle"):
        dataset.balance_action(df, "id", "c", "shuffle")


def test_report_with_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "y string, p string")
    rows = {r.label: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rows["a"].precision == pytest.approx(2 / 3) and rows["a"].recall == 1 and rows["a"].f1 == pytest.approx(0.8)
    assert (rows["b"].precision, rows["b"].recall, rows["b"].f1, rows["b"].support) == (0, 0, 0, 1)
    assert rows["accuracy"].f1 == pytest.approx(2 / 3) and rows["accuracy"].support == 3
    assert rows["macro avg"].f1 == pytest.approx(0.4)
    assert rows["weighted avg"].f1 == pytest.approx(0.8 * 2 / 3)
    assert evaluate.accuracy(df, "y", "p").first().accuracy == pytest.approx(2 / 3)


def test_report_counts_labels_only_predicted(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "y string, p string")
    rows = {r.label: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rows["b"].support == 0 and rows["a"].support == 2 and rows["accuracy"].f1 == 0
