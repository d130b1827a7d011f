"""Question sets and predictions derived from the event table, in whole numbers only, and
the same derivation as SQL.

One user's events are one interval; an event is a sample.  Three models answer; the number
in props, shifted by the model, decides what they say: the truth, another letter, two
letters, or nothing at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Twelve hours: events of a user are about ten hours apart.
STEP = 43_200


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, pos, key, event_id, t (seconds since 2024), k, region, truth, group_state,
    step, anchor, and the raw event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    region = F.when(F.col("event_type").isin("click", "purchase"), "segment").when(F.col("event_type").isin("view", "error"), "gap").otherwise("other")
    e = e.select(
        F.col("user_id").alias("file"), (F.row_number().over(order) - 1).cast("long").alias("pos"), "event_id",
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("t"),
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"), "event_type", region.alias("region"),
    )
    state = F.element_at(F.array(*[F.lit(s) for s in ("NN", "PN", "NP", "PP", "XX")]), (F.expr("event_id div 4") % 5 + 1).cast("int"))
    return e.withColumns({
        "key": F.concat(F.lit("i:"), F.col("pos")), "truth": F.substr(F.lit("ABCD"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1)),
        "group_state": state, "step": (F.col("pos") % 3).cast("int"), "anchor": F.expr("pos div 3"),
        "sources": F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(F.array(*[F.lit(s) for s in ("gt", "prev", "future", "absurd")]), (F.pmod(i - F.col("event_id"), F.lit(4)) + 1).cast("int"))),
    })


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, file, pred_file, pos, key, response_text, p_cond, event_id of three models;
    a tenth of the answers is absent."""
    s = samples(spark, sf_dir).withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    s = s.withColumn("kk", (F.col("k") + F.col("m")) % 10).filter("kk <> 9")
    other = F.substr(F.lit("ABCD"), ((F.col("event_id") + 1) % 4 + 1).cast("int"), F.lit(1))
    say = F.when(F.col("kk") <= 5, F.col("truth")).otherwise(other)
    seen = (F.col("region") == "segment") == (F.col("kk") < 7)
    phrase = F.when(seen, "interaction").otherwise("no interaction")
    form = F.expr("event_id div 4") % 3
    text = (
        F.when(F.col("kk") == 8, "A or B").when(form == 0, F.concat(F.lit("<NOW><STATE> "), phrase, F.lit("</STATE><ANS>"), say, F.lit("</ANS></NOW>")))
        .when(form == 1, F.concat(F.lit("Answer: "), say)).otherwise(F.concat(say, F.lit(". "), phrase))
    )
    conf = (F.col("event_id") * 7 + F.col("m") * 13) % 101
    p = F.map_from_arrays(F.array(*[F.lit(x) for x in "ABCD"]), F.transform(F.array(*[F.lit(x) for x in "ABCD"]), lambda x: F.when(x == say, conf / 100.0).otherwise((100 - conf) / 300.0)))
    # texts are parsed row by row, which is work for the processors and not for the disk: the
    # few scalars they are made from are dealt out first, over all of the session's partitions
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return s.select(
        F.concat(F.lit("m"), F.col("m")).alias("model"), "file", F.concat(F.lit("pred/m"), F.col("m"), F.lit("/"), F.col("file"), F.lit(".json")).alias("pred_file"),
        "pos", "key", text.alias("response_text"), p.alias("p_cond"), "event_id",
    )


#: The derivation as common table expressions: s (samples), x (samples by model with what
#: the model says: kk, ans, state, conf of the answer, text).
SQL = r"""
e AS (SELECT event_id, user_id AS file, event_type, (epoch_us(ts) // 1000000 - 1704067200)::BIGINT AS t, regexp_extract(props, '\d+')::BIGINT AS k,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'segment' WHEN event_type IN ('view', 'error') THEN 'gap' ELSE 'other' END AS region FROM events),
s AS (SELECT *, 'i:' || pos AS key, substr('ABCD', (event_id % 4 + 1)::INT, 1) AS truth, ['NN', 'PN', 'NP', 'PP', 'XX'][((event_id // 4) % 5 + 1)::INT] AS group_state,
        (pos % 3)::INT AS step, pos // 3 AS anchor,
        CASE region WHEN 'segment' THEN 'INTERACTION' WHEN 'gap' THEN 'NO_INTERACTION' ELSE 'UNKNOWN' END AS true_state FROM e),
y AS (SELECT s.*, m, 'm' || m AS model, (k + m) % 10 AS kk, substr('ABCD', ((event_id + 1) % 4 + 1)::INT, 1) AS nxt, (event_id // 4) % 3 AS form, (event_id * 7 + m * 13) % 101 AS c
      FROM s, range(3) r(m)),
x AS (SELECT *, kk <> 9 AS answered, CASE WHEN kk <= 5 THEN truth WHEN kk <= 7 THEN nxt ELSE '' END AS ans,
        CASE WHEN kk >= 8 OR form = 1 THEN 'INVALID' WHEN (region = 'segment') = (kk < 7) THEN 'INTERACTION' ELSE 'NO_INTERACTION' END AS state,
        CASE WHEN kk <= 7 THEN c / 100.0 WHEN kk = 8 THEN greatest(c / 100.0, (100 - c) / 300.0) END AS conf FROM y)
"""
