"""States of files as they arrive: a stream that is stopped and started again gives what the whole table gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyspark.streaming import intake

T0 = dt.datetime(2024, 1, 1)


def rows(n=120):
    rnd = random.Random(5)
    out = []
    for i in range(n):
        f = rnd.randrange(40)
        out.append((f, f % 7, T0 + dt.timedelta(minutes=i), rnd.choice(["ok 1", "", "review 2", "paper", "broken"])))
    return out + [(None, 1, T0, "ok 1")]


def ends():
    status = F.when(F.col("text") == "ok 1", "NORMAL").when(F.col("text") == "review 2", "NEED_REVIEW").when(F.col("text") == "paper", "NEED_SUPPLEMENT")
    return status, F.when(F.col("text") == "broken", "can't be read")


def plain(data):
    last, attempt, changes = {}, {}, []
    for f, b, at, text in data:
        if f is None or last.get(f) == "NORMAL":
            continue
        status = {"ok 1": "NORMAL", "review 2": "NEED_REVIEW", "paper": "NEED_SUPPLEMENT"}.get(text, "FAILED")
        error = None if status != "FAILED" else "can't be read" if text == "broken" else "AI 처리 중 오류가 발생했습니다."
        attempt[f] = attempt.get(f, 0) + 1
        changes.append((f, b, attempt[f], last.get(f), status, error, at))
        last[f] = status
    return changes, last


def ordered(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[2]))


def test_stream_restarted_gives_what_the_batch_gives(spark, tmp_path):
    data = rows()
    want, last = plain(data)
    df = spark.createDataFrame(data, intake.SCHEMA)
    assert ordered(intake.attempts(df, *ends())) == sorted(want, key=lambda r: (r[0], r[2]))
    assert intake.attempts(df.limit(0), *ends()).count() == 0
    source, log, counts = (str(tmp_path / x) for x in ("in", "log", "counts"))
    for half in (data[:60], data[60:]):
        # in order of upload; the second start goes on from the first one's checkpoints
        spark.createDataFrame(half, intake.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = intake.attempts(intake.arriving(spark, source), *ends())
        assert stream.writeStream.format("parquet").option("path", log).option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start().awaitTermination(120)
        changes = spark.readStream.schema(intake.CHANGES).parquet(log)
        assert intake.keep_counts(changes, counts, str(tmp_path / "b")).awaitTermination(120)
    assert ordered(spark.read.schema(intake.CHANGES).parquet(log)) == sorted(want, key=lambda r: (r[0], r[2]))
    by_batch = {}
    for f, status in last.items():
        by_batch.setdefault(f % 7, []).append(status)
    expected = sorted((b, len(s), *(s.count(x) for x in ("NORMAL", "NEED_REVIEW", "NEED_SUPPLEMENT", "FAILED"))) for b, s in by_batch.items())
    assert sorted(map(tuple, intake.counts_now(spark, counts).collect())) == expected
    assert sorted(map(tuple, intake.rolled_up(intake.attempts(df, *ends())).collect())) == expected


def test_recognitions_are_put_together(spark):
    from tallyspark.operators import recognitions

    lines = [("합계글액 1,000W",), ("P0S ｜ 부 가 세 – 7",), ("​커피w",), ("1O2 합계",), (None,)]
    got = spark.createDataFrame(lines, "x string").select(recognitions.recognised_line(F.col("x"))).collect()
    assert [r[0] for r in got] == ["합계금액 1,000원", "POS | 부가세 - 7", "커피w", "102 합계", ""]
    parts = spark.createDataFrame([(1, 1, "가게\n합계 1,000"), (1, 2, "합계  1000.\n\n끝"), (2, 1, " as it is\nas it is"), (3, 1, None)], "page int, rank int, text string")
    assert {r.page: r.text for r in recognitions.page_texts(parts).collect()} == {1: "가게\n합계 1,000\n끝", 2: " as it is\nas it is", 3: ""}
