from __future__ import annotations

import json

from pyspark.sql import functions as F

from assayer.operators import logs


def test_log_lines_merge_extras(spark):
    rows = [
        ("t", "m", "tr", "sp", {"lab.k": "1", "none": None}, None),
        ("t", "m", "tr", None, {}, "E"),
        ("t", "m", None, None, {"message": "over"}, "E"),
        ("t", 'say "hi"\n', None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "ts string, msg string, tr string, sp string, extra map<string,string>, err string")
    line = logs.format_log(
        F.col("ts"), F.lit("INFO"), F.col("msg"), F.lit("l"), F.lit("svc"), F.lit("quant"), F.col("tr"), F.col("sp"),
        F.col("extra"), F.col("err"), F.when(F.col("err").isNotNull(), "text"),
    )
    got = [json.loads(r.line) for r in df.select(line.alias("line")).collect()]
    base = {"timestamp": "t", "severity": "INFO", "logger": "l", "service.name": "svc", "lab.team": "quant"}
    assert got == [
        {**base, "message": "m", "trace_id": "tr", "span_id": "sp", "lab.k": "1"},
        {**base, "message": "m", "error.type": "E", "error.message": "text"},
        {**base, "message": "over", "error.type": "E", "error.message": "text"},
        {**base, "message": 'say "hi"\n'},
    ]
