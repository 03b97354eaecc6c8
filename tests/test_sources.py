"""Sources and sinks on small files."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators.compare import valid_account_number
from letterspark.sources import messages as A
from letterspark.sources import store as S


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"two\nlines",1\nx,0\ny,?\n')
    kept, dropped = A.labelled_csv(spark, str(tmp_path), ["text", "label"], "label", {"1": "spam", "0": "ham"})
    assert sorted((r.text, r.category) for r in kept.collect()) == [("two\nlines", "spam"), ("x", "ham")]
    assert [(r.label, r.n) for r in dropped.collect()] == [("?", 1)]


def test_files_and_mailbox(spark, tmp_path):
    (tmp_path / "ham").mkdir()
    (tmp_path / "ham" / "1").write_text("Subject: a\n\nbody")
    (tmp_path / "ham" / "cmds").write_text("mv 1 2")
    assert [(r.label, r.raw) for r in A.message_files(spark, str(tmp_path)).collect()] == [("ham", "Subject: a\n\nbody")]
    (tmp_path / "box").write_text("From a\nSubject: 1\n\nx\nFrom b\nSubject: 2\n\ny\n")
    rows = A.mailbox(spark, str(tmp_path / "box")).collect()
    assert sorted((r.raw_ref[-2:], r.raw) for r in rows) == [("#1", "Subject: 1\n\nx"), ("#2", "Subject: 2\n\ny\n")]


def test_publish_replaces_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    A.publish_table(spark.createDataFrame([(1, "a"), (2, "b")], "n int, split string"), path, "split")
    A.publish_table(spark.createDataFrame([(3, "a")], "n int, split string"), path, "split")
    assert sorted((r.n, r.split) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]


def test_account_number(spark):
    df = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB82 WEST 1234 5698 7654 33",), ("",), (None,)], "v string")
    assert [r.ok for r in df.select(valid_account_number(F.col("v")).alias("ok")).collect()] == [True, False, False, False]


def test_a_mailbox_in_many_tasks_equals_one(spark, tmp_path):
    sizes = [0, 1, 700, 3, 5000, 40, 40, 40] * 12
    text = "".join(f"From a{k}@x {k}\nSubject: {k}\n\n{'é' * n}\n>From quoted\nFromage\n" for k, n in enumerate(sizes))
    (tmp_path / "big").write_text(text)
    (tmp_path / "odd").write_text("preamble\nFrom x\r\nSubject: 1\r\n\r\nbody\r\n")
    (tmp_path / "none").write_text("no message")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        got = []
        for size in ("64m", "4k"):
            spark.conf.set(key, size)
            box = A.mailbox(spark, str(tmp_path / "*"))
            got.append(sorted((r.raw_ref, r.raw) for r in box.collect()))
        assert spark.read.option("lineSep", "\nFrom ").text(str(tmp_path / "big")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1]
    want = {f"big#{k + 1}": f"Subject: {k}\n\n{'é' * n}\n>From quoted\nFromage" + ("\n" if k + 1 == len(sizes) else "") for k, n in enumerate(sizes)} | {"odd#1": "Subject: 1\n\nbody\n"}
    assert {ref.rsplit("/", 1)[1]: raw for ref, raw in got[1]} == want


def test_a_store_is_published_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *ids: spark.createDataFrame([(k,) for k in ids], "id int")
    seen = []

    def compute(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.withColumn("f", F.col("id") * 10)

    assert S.read(spark, path, "v1") is None
    assert sorted(tuple(r) for r in S.update(rows(1, 2), path, "id", "v1", compute).collect()) == [(1, 10), (2, 20)]
    held = S.read(spark, path, "v1")
    assert S.update(rows(1, 2, 3), path, "id", "v1", compute).count() == 3 and seen == [[1, 2], [3]]
    S.update(rows(1, 2, 3), path, "id", "v1", compute)
    S.update(rows(1), path, "id", "v2", compute)
    assert seen == [[1, 2], [3], [1]] and held.count() == 2  # a reader keeps what it began with
    rows(7).withColumn("f", F.lit(0)).write.parquet(f"{path}/data/died")  # a write that died before its manifest
    assert S.read(spark, path, "v1").count() == 3 and S.read(spark, path, "v2").count() == 1
    S.commit(rows(9).withColumn("f", F.lit(1)), path, "v1", replace=True)
    assert [tuple(r) for r in S.read(spark, path, "v1").collect()] == [(9, 1)] and S.read(spark, path, "v2").count() == 1


def test_records_of_tables_and_blocks_have_one_shape(spark):
    from letterspark.sources import records as A

    cells = {"<a@x> <b@y>": ["<a@x>", "<b@y>"], '["<a@x>", null, "<b@y>"]': ["<a@x>", "<b@y>"], "[broken": [], "": [], None: [], " ".join(f"<{k}@x>" for k in range(150)): [f"<{k}@x>" for k in range(100)]}
    table = spark.createDataFrame([(k, "t", x, None) for k, x in enumerate(cells)], "id int, source string, references string, body string")
    found = A.from_table(table)
    assert {r.key: r.references for r in found.collect()} == dict(enumerate(cells.values()))
    r = found.first()
    assert (r.subject, r.text, r.quoted, r.full, r.redacted, r.list_mail, r.message_id, r.facts.spf) == ("", "", "", "", "", False, None, None)
    assert found.schema["facts"].dataType.names == list(A.FACTS) and A.from_table(table.limit(0)).count() == 0
