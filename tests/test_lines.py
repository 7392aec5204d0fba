"""Line numbers and log records of files that are read in many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from veilwork.operators.cleaning import assign_record_id
from veilwork.sources.chat_log import _fragments, read_chat_log
from veilwork.sources.lines import first_numbered, numbered_lines
from veilwork.sources.tables import ranged, spread


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode())


def lines(seed, n):
    rnd = random.Random(seed)
    return ["é🙂x"[:rnd.randrange(4)] * rnd.choice([0, 1, 5, 900 if rnd.random() < 0.05 else 20]) + rnd.choice(["", "\r", "{bad"]) for _ in range(n)]


def test_numbers_by_file_and_folder(spark, tmp_path, small_blocks):
    texts = {("a", "x.txt"): lines(1, 300), ("a", "y.txt"): lines(2, 50), ("b", "x.txt"): ["one"], ("b", "w.txt"): lines(3, 120)}
    for i, ((folder, name), some) in enumerate(texts.items()):
        write(tmp_path / folder, name, "\n".join(some) + "\n" * (i % 2))
    write(tmp_path / "b", "empty.txt", "")
    path = [str(tmp_path / "a"), str(tmp_path / "b")]
    # A text without a newline at its end has its last line all the same, unless that line is empty.
    texts = {k: v if i % 2 or v[-1] else v[:-1] for i, (k, v) in enumerate(texts.items())}
    got = {}
    for r in numbered_lines(spark, path).collect():
        folder, name = r["file"].split("/")[-2:]
        got.setdefault((folder, name), {})[r["line_no"]] = r["value"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == texts
    joint = numbered_lines(spark, path, by="folder").withColumn("folder", F.element_at(F.split("file", "/"), -2))
    for folder in "ab":
        want = [x for (f, _), some in sorted(texts.items()) if f == folder for x in some]
        rows = joint.filter(F.col("folder") == folder).orderBy("line_no").collect()
        assert [(r["line_no"], r["value"]) for r in rows] == list(enumerate(want))
    assert joint.rdd.getNumPartitions() > 20
    first = first_numbered(numbered_lines(spark, path), 7).groupBy("file").count().collect()
    assert sorted(r["count"] for r in first) == [1, 7, 7, 7]
    with pytest.raises(ValueError):
        numbered_lines(spark, path, by="row")


def test_numbering_has_no_single_task(spark, tmp_path, small_blocks):
    write(tmp_path, "x.txt", "\n".join(lines(4, 200)))
    plan = numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    # Lines move nowhere: the only exchange is of the blocks' rows.
    assert plan.count("BroadcastExchange") == 1 and "SortMergeJoin" not in plan


def log(seed, n, head=""):
    rnd = random.Random(seed)
    records = [f"2024-01-{1 + i % 28:02d}T10:00:00 | user={rnd.choice(['guest', str(i)])} | {rnd.choice(['allow', 'block'])} | "
               + "\n".join(rnd.choice(["plain", "", "a | b", "2024 not a start", "é" * 30, "x" * rnd.randrange(1, 1500)]) for _ in range(rnd.choice([1, 1, 2, 40])))
               for i in range(n)]
    return ([head] if head else []) + records


def fields(record):
    parts = record.split(" | ", 3)
    if len(parts) < 4:
        return ("", "", "", "")
    return parts[0], None if parts[1] == "user=guest" else parts[1][5:], parts[2], parts[3]


@pytest.mark.parametrize("head", ["", "no record\nin these lines"])
def test_records_over_block_borders(spark, tmp_path, small_blocks, head):
    whole = {name: log(i, n, head) for i, (name, n) in enumerate([("a.log", 150), ("b.log", 3), ("c.log", 40)])}
    for name, records in whole.items():
        write(tmp_path, name, "\n".join(records) + "\n")
    rows = read_chat_log(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["file"].split("/")[-1], {})[r["record_no"]] = (r["ts"], r["user"], r["action"], r["text"])
    for name, records in whole.items():
        mine = [got[name][i] for i in range(len(got[name]))]
        assert [m[:1] + m[2:] for m in mine] == [f[:1] + f[2:] for f in map(fields, records)]
        assert [m[1] or None for m in mine] == [f[1] or None for f in map(fields, records)]
    joint = read_chat_log(spark, str(tmp_path), by="folder").select("record_no").orderBy("record_no").collect()
    assert [r[0] for r in joint] == list(range(sum(map(len, whole.values()))))


def test_one_record_over_many_batches():
    import pyarrow as pa

    def batch(values, block):
        return pa.RecordBatch.from_pydict({"file": ["f"] * len(values), "block": [block] * len(values), "value": values})

    start = "2024-01-01T00 | user=1 | allow | "
    batches = [batch(["x", start + "a"], 0), batch(["b", "c"], 0), batch(["d", start + "e", "f"], 0), batch(["g"], 7), batch([start + "h"], 7)]
    got = [tuple(r.values()) for b in _fragments(iter(batches)) for r in b.to_pylist()]
    assert got == [("f", 0, 0, False, False, "x"), ("f", 0, 1, True, False, start + "a\nb\nc\nd"), ("f", 0, 2, True, True, start + "e\nf"),
                   ("f", 7, 0, False, False, "g"), ("f", 7, 1, True, True, start + "h")]


def test_record_ids_of_rows_without_an_index(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 900_000), ("b", 1), ("a", 7)], "split string, at long")
    got = {(r["split"], r["at"]): r["id"] for r in assign_record_id(rows, "split", "at", width=10).collect()}
    assert got == {("a", 5): "a_0", ("a", 7): "a_1", ("a", 900_000): "a_2", ("b", 1): "b_0"}


def test_pieces_grow_with_the_table(spark):
    wide = ranged(spark.range(0, 600, 1, 60).select((F.lit(599) - F.col("id")).alias("id")), "id")
    assert wide.rdd.getNumPartitions() == 240
    assert [r["id"] for r in wide.collect()] == list(range(600))
    few = ranged(spark.range(0, 600, 1, 1).select((F.lit(599) - F.col("id")).alias("id")), "id")
    assert [r["id"] for r in few.collect()] == list(range(600))


def test_few_rows_per_piece(spark):
    table = spread(spark.range(0, 1000, 1, 9), rows=10)
    assert table.rdd.getNumPartitions() == 100 and table.count() == 1000
    assert max(table.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) <= 20
    assert spread(spark.range(0, 1000, 1, 9)).rdd.getNumPartitions() == 9
