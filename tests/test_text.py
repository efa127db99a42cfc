"""Column functions on values that the tables lack."""

import datetime

from pyspark.sql import functions as F

from threadloom.functions import journal_name, landed_name, landed_seq, readable, record_uuid, short_id, stamp, truncated


def only(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_names(spark):
    time = datetime.datetime(2024, 1, 31, 23, 59, 59, 123456, tzinfo=datetime.timezone.utc)
    assert only(spark, stamp(F.col("t")), t=time) == "20240131T235959.123456000Z"
    assert only(spark, landed_name(F.lit("meta"), F.col("t"), F.col("n")), t=time, n=7) == "meta-20240131T235959.123456000Z-000007.sd"
    assert only(spark, landed_name(F.lit("meta"), F.col("t"), F.col("n")), t=time, n=12345678).endswith("-12345678.sd")
    assert [only(spark, landed_seq(F.col("s")), s=s) for s in ("a-000012.sd", "a-12.sd", "a-1234567.sd", "x", None)] == [12, None, 1234567, None, None]
    assert [only(spark, short_id(F.col("s")), s=s) for s in ("a/b/c", "plain", "x/" + "y" * 22, "x/" + "y" * 23, None)] == ["c", "plain", "y" * 22, "y" * 21 + "…", None]
    assert [only(spark, truncated(F.col("s"), 3), s=s) for s in ("abc", "abcd", "")] == ["abc", "ab…", ""]
    assert [only(spark, record_uuid(F.col("s")), s=s) for s in ('{"uuid": "a-b"}', '{"uuid":""}', "{", None)] == ["a-b", None, None, None]


def test_what_a_person_reads(spark):
    part = "array<struct<k:string,text:string,data:string>>"
    rows = [
        ([("text", "one", None), ("data", None, "{}"), ("text", "two ", None)], "one\ntwo"), ([("data", None, '{"type": "queued_command", "prompt": [{"text": "a"}, {"text": ""}, {"text": "b"}]}')], "a\nb"),
        ([("data", None, '{"type": "other", "prompt": [{"text": "a"}]}')], ""), ([("data", None, "no json")], ""), ([], ""), (None, ""),
    ]
    df = spark.createDataFrame(rows, f"parts {part}, want string")
    assert all(r.got == r.want for r in df.select("want", readable("parts").alias("got")).collect())


def test_names_from_journals(spark):
    said = ['{"type": "result", "result": {"surface": "s", "summary": "t"}}', '{"type": "result", "result": {"surface": "", "summary": "t\\nu"}}', '{"type": "result", "result": {"verdict": "v", "refuted_claims": [{"claim": "c"}]}}', '{"type": "result", "result": {"verdict": "v"}}', '{"type": "started"}', '{"type": "result", "result": "text"}', "x", None]
    assert [only(spark, journal_name(F.col("s")), s=s) for s in said] == ["s", "t u", "v · c", "v", None, None, None, None]
