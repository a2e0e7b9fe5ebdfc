"""Streams and registries (R, X)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import registry as X
from ..operators.tables import materialise, shared_dir
from ..streaming import events as E
from .base import query, table


def _replay(spark, d, name: str, make, keys: str):
    """A table as a file stream of several batches, run to its end; the last row of each key."""
    root = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    rows.repartitionByRange(4, "event_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    out = f"{root}/out"

    def keep(batch, i):
        batch.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")

    run = make(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.parquet(out).drop("b")
    cols = [c for c in done.columns if c not in (keys, "_batch")]
    last = done.groupBy(keys).agg(F.max_by(F.struct(*cols), "_batch").alias("r"))
    return last.select(keys, *(F.col(f"r.{c}").alias(c) for c in cols)), f"{root}/state"


_WIRE = """'{"ts": 1.5, "pid": 1, "req_ids": ["' || (user_id % 5) || '_' || user_id || '", "7"], "latents": [[' || value || '], []], "rank": ' || (event_id % 2) || ', "seq": ' || event_id || '}'"""


@query("SELECT user_id::VARCHAR AS parent, (user_id % 5)::INT AS sample, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS seqs FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2")
def r00_recorded_events(spark, d):
    """JSON lines of events of two ranks to an ordered list per request; empty latents are skipped."""
    lines = table(spark, d, "events").select(F.expr(_WIRE).alias("value"))
    rows = E.steps(E.parse(lines), rank=0)
    return E.appended(rows, ["parent", "sample"], "seq", "seq", "seqs").select("parent", "sample", F.array_join("seqs", ",").alias("seqs"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1", name="keyed_event_append")
def r00_keyed_event_append(spark, d):
    out = E.appended(table(spark, d, "events"), ["user_id"], "event_id", "event_id", "ids")
    return out.select("user_id", F.array_join("ids", ",").alias("ids"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1")
def r00_append_stream(spark, d):
    """Rows appended over several micro-batches make the batch form's lists."""
    root = f"{shared_dir(spark)}/stream-append-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("user_id", "event_id")
    rows.repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    run = stream.writeStream.foreachBatch(E.append_stream(stream, f"{root}/rows")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = E.appended(spark.read.parquet(f"{root}/rows"), ["user_id"], "event_id", "event_id", "items")
    return out.select("user_id", F.array_join("items", ",").alias("ids"))


@query("SELECT 'batches' AS name, 1::BIGINT AS value UNION ALL SELECT 'resumed_rows', 0")
def r01_resume(spark, d):
    """A second run from the same checkpoint has nothing left to read."""
    root = f"{shared_dir(spark)}/stream-resume-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("event_id")
    rows.repartition(4).write.parquet(f"{root}/in")
    seen = []
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        counts = []
        run = stream.writeStream.foreachBatch(lambda b, i: counts.append(b.count())).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        seen.append(sum(counts))
    batches = E.latest_checkpoint(spark, f"{root}/state")
    return spark.createDataFrame([("batches", batches), ("resumed_rows", seen[1])], "name string, value bigint")


@query("SELECT user_id, min(value) AS min_len, round(avg(value) + 1e-8, 6) AS mean_len, count(value) AS cnt, bool_or(value > 0) AS seen FROM events GROUP BY 1")
def r02_stats_stream(spark, d):
    out, _ = _replay(spark, d, "stats", lambda s: E.stats_stream(s, "user_id", "value"), "user_id")
    return out.withColumn("mean_len", F.round(F.col("mean_len") + 1e-8, 6))


@query("SELECT 1::BIGINT AS last_batch")
def r03_latest_checkpoint(spark, d):
    _, state = _replay(spark, d, "tracker", lambda s: E.stats_stream(s, "user_id", "value"), "user_id")
    return spark.createDataFrame([(E.latest_checkpoint(spark, state),)], "last_batch bigint")


@query("SELECT count(*) AS n FROM events")
def r04_until_full(spark, d):
    """Rows gather over micro-batches until the pool is full; each is consumed once."""
    root = f"{shared_dir(spark)}/stream-pool-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("event_id")
    rows.repartition(4).write.parquet(f"{root}/in")
    total = rows.count()
    taken = f"{root}/taken"
    consume = lambda df, i: df.write.mode("overwrite").parquet(f"{taken}/by={i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    run = stream.writeStream.foreachBatch(E.until_full(f"{root}/pool", total // 4, consume)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(taken).agg(F.count("event_id").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def r05_windowed_counts(spark, d):
    """Event-time windows over the table; summed, they count every event."""
    out = E.windowed(table(spark, d, "events"), "ts", "1 hour", by=("event_type",))
    return out.groupBy("event_type").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------- registries


@X.rewards.register("length_reward")
def length_reward(text, gold, scale=1.0):
    return {"score": scale * min(len(text or ""), 10) / 10, "same": float((text or "") == (gold or ""))}


@X.rewards.register("same_reward")
def same_reward(texts, golds):
    return [{"score": float((t or "") == (g or ""))} for t, g in zip(texts, golds)]


@X.judges.register("word_judge")
def word_judge(text):
    return "yes" if "1" in (text or "") else "no"


@X.tasks.register("drop_empty")
def drop_empty(df, column="answer"):
    return df.where(F.coalesce(F.trim(column), F.lit("")) != "")


@query("SELECT record_id, round(0.5 * least(length(coalesce(answer, '')), 10) / 10, 6)::DOUBLE AS score, (coalesce(answer, '') = '10')::INT::DOUBLE AS same FROM cot_records")
def x01_registered_reward(spark, d):
    score = X.scalar_reward(X.rewards.get("length_reward", scale=0.5), ["score", "same"])
    rows = table(spark, d, "cot_records").select("record_id", score(F.col("answer"), F.lit("10")).alias("s"))
    return rows.select("record_id", F.round("s.score", 6).alias("score"), "s.same")


@query("SELECT record_id, (coalesce(answer, '') = coalesce(cot, ''))::INT::DOUBLE AS score FROM cot_records")
def x02_batch_reward(spark, d):
    score = X.batch_reward(X.rewards.get("same_reward"), ["score"])
    return table(spark, d, "cot_records").select("record_id", score(F.col("answer"), F.col("cot")).alias("s")).select("record_id", "s.score")


@query("SELECT record_id, round(scale * least(length(coalesce(answer, '')), 10) / 10, 6)::DOUBLE AS score, scale::DOUBLE AS scale FROM cot_records, (SELECT unnest([1.0, 2.0]) AS scale)")
def x03_options(spark, d):
    """Options are bound by name when a function is looked up, never guessed from its signature."""
    rows = table(spark, d, "cot_records").select("record_id", "answer")
    out = None
    for scale in (1.0, 2.0):
        score = X.scalar_reward(X.rewards.get("length_reward", scale=scale), ["score", "same"])
        one = rows.select("record_id", F.round(score(F.col("answer"), F.lit(""))["score"], 6).alias("score"), F.lit(scale).alias("scale"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT record_id, CASE WHEN contains(coalesce(answer, ''), '1') THEN 'yes' ELSE 'no' END AS reply FROM cot_records")
def x04_judge_hook(spark, d):
    return X.called(table(spark, d, "cot_records"), "record_id", "answer", X.judges.get("word_judge"), enabled=True)


@query("SELECT count(*) AS n FROM cot_records WHERE coalesce(trim(answer, ' '), '') <> ''")
def x05_prepared(spark, d):
    return X.prepared(table(spark, d, "cot_records"), "drop_empty").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, user_id * 2 AS twice FROM events")
def x06_mapped_rows(spark, d):
    return X.mapped(table(spark, d, "events").select("event_id", "user_id", "value"), lambda r: {"twice": r["user_id"] * 2}, "twice bigint", remove=("value",))


@query("SELECT event_id, 7 AS shared, value > 50 AS big FROM events")
def x07_dispatch(spark, d):
    rows = X.one_to_all(table(spark, d, "events").select("event_id", "value"), 7)
    return X.by_part(rows, lambda p: p.assign(big=p["value"] > 50)[["event_id", "shared", "big"]], "event_id bigint, shared int, big boolean")


@query("SELECT count(*) AS n, 0::BIGINT AS replies FROM eval_items")
def x08_calls_are_off(spark, d):
    out = X.called(table(spark, d, "eval_items"), "item_id", "question", lambda q: "never")
    return out.agg(F.count("*").alias("n"), F.count("reply").alias("replies"))


@query("SELECT * FROM (VALUES (0, 'length_reward'), (1, 'same_reward')) t(pos, name)")
def x09_registered_names(spark, d):
    return spark.createDataFrame(list(enumerate(X.rewards.names("_reward"))), "pos int, name string")


@query("SELECT o_custkey, sum(o_totalprice)::DOUBLE AS total FROM orders GROUP BY 1")
def x10_table_written_once(spark, d):
    """A table in the shared folder cuts the lineage between two stages."""
    sums = materialise(table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")), "sums")
    return sums.select("o_custkey", "total")
