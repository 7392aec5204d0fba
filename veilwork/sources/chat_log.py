"""The chat text log: `time | user=x | action | text`, where a text may span lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import Scratch
from .lines import join_blocks, physical_lines, sums_before

# Fixed value: a record begins where a line begins with an ISO time.
LINE_START = r"^\d{4}-\d\d-\d\dT"
FIELDS = r"(?s)^(\S+) \| user=(.*?) \| (.*?) \| (.*)$"


def record_fields(record: Column) -> dict[str, Column]:
    user = F.regexp_extract(record, FIELDS, 2)
    return {
        "ts": F.regexp_extract(record, FIELDS, 1),
        "user": F.nullif(user, F.lit("guest")),
        "action": F.regexp_extract(record, FIELDS, 3),
        "text": F.regexp_extract(record, FIELDS, 4),
    }


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in reading order -> records, as far as a block has them.

    (file, block, ordinal, opens, closes, text): `opens` if the text begins with a record's first
    line, `ordinal` counts those in the block, `closes` if it is the block's last text.
    """
    def rows(file, block, ordinal, opens, closes, text) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": file, "block": block, "ordinal": pa.array(ordinal, pa.int64()), "opens": pa.array(opens, pa.bool_()),
                                           "closes": pa.array(closes, pa.bool_()), "text": text.cast(pa.string())})

    held: list | None = None  # file, block, ordinal, opens, texts: what may go on in the next batch

    def told(closes: bool) -> pa.RecordBatch:
        file, block, ordinal, opens, texts = held
        return rows(pa.array([file]), pa.array([block]), [ordinal], [opens], [closes], pa.array(["\n".join(texts)]))

    for batch in batches:
        if not len(batch):
            continue
        file, block, value = (batch.column(c) for c in ("file", "block", "value"))
        codes, starts = file.dictionary_encode().indices.to_numpy(), block.to_numpy()
        opens = pc.match_substring_regex(value, LINE_START).to_numpy(zero_copy_only=False)
        fresh = np.concatenate(([True], (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])))
        fresh[0] = held is None or held[:2] != [file[0].as_py(), block[0].as_py()]
        begins = np.flatnonzero(opens | fresh)
        first = begins[0] if len(begins) else len(batch)
        if first:  # the batch begins amid a text
            held[4].extend(value.slice(0, first).to_pylist())
        if not len(begins):
            continue
        if held:
            yield told(bool(fresh[first]))
        # Numbers of opening lines, from 0 at each new block.
        count = np.cumsum(opens)
        at_block = np.maximum.accumulate(np.where(fresh, np.arange(len(batch)), -1))
        before = np.where(at_block >= 0, (count - opens)[np.maximum(at_block, 0)], -(held[2] if held else 0))
        ordinal = (count - before)[begins]
        ends = np.append(begins[1:], len(batch))
        last = int(begins[-1])
        if len(begins) > 1:
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), value.slice(0, last))
            some = pa.array(begins[:-1])
            yield rows(file.take(some), block.take(some), ordinal[:-1], opens[begins[:-1]], fresh[begins[1:]], pc.binary_join(lists, "\n"))
        held = [file[last].as_py(), block[last].as_py(), int(ordinal[-1]), bool(opens[last]), value.slice(last, ends[-1] - last).to_pylist()]
    if held:
        yield told(True)


def read_chat_log(spark: SparkSession, path: str | list[str], by: str = "file") -> DataFrame:
    """(file, record_no, ts, user, action, text) of log files; record_no counts from 0 within a file (or folder).

    Files are read in blocks of any size. Records that lie within a block are put together where
    they are read. A text at a block's beginning that opens no record belongs to the last record
    opened before; only such texts and the last ones of blocks meet, a few rows per block. Lines
    before a file's first record are a record without fields.
    """
    lines = physical_lines(spark, path)
    marked = lines.select("file", "block", F.col("value").rlike(LINE_START).alias("opens"), F.monotonically_increasing_id().alias("seq"))
    blocks = marked.groupBy("file", "block").agg(F.count_if("opens").alias("opened"), F.min_by("opens", "seq").alias("clean"))
    blocks = Scratch(spark, "log-blocks").table(blocks, "blocks")
    # A file that does not begin with a record's first line has one record more.
    first = F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1
    headless = (first & ~F.col("clean")).cast("int")
    counted = blocks.withColumn("headless", headless).withColumn("n", F.col("opened") + F.col("headless"))
    counted = sums_before(counted, "n", by).select("file", "block", "before", "headless")
    texts = lines.select("file", "block", "value").mapInArrow(_fragments, "file string, block long, ordinal long, opens boolean, closes boolean, text string")
    texts = join_blocks(texts, counted, blocks.count(), ["file", "block"])
    texts = texts.withColumn("record_no", F.col("before") + F.col("headless") + F.col("ordinal") - 1)
    whole = texts.filter("opens AND NOT closes").select("file", "record_no", "text")
    border = texts.filter("NOT opens OR closes")
    # A text that opens nothing has the number of the last record opened before it, so the number is the group.
    joined = border.groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "ordinal", "text"))).alias("parts"))
    joined = joined.select("file", "record_no", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    done = whole.unionByName(joined)
    return done.select("file", "record_no", *[c.alias(n) for n, c in record_fields(F.col("text")).items()])


def log_line(ts: Column, user: Column, action: Column, safe_text: Column) -> Column:
    return F.concat(ts, F.lit(" | user="), F.coalesce(user.cast("string"), F.lit("guest")),
                    F.lit(" | "), action, F.lit(" | "), safe_text)
