"""The list that a stream holds equals the batch list, also after a restart and with replaced messages."""

import random


from gallerylens.streaming import messages, stream


def test_lists_equal_the_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    kind = "conv_id long, id long, place long, role string, text string"
    rows = [(k % 7, k, 10 * k, rng.choice(["user", "assistant", None]), f"t{k}") for k in range(60)]
    parts = [rows[:25], [*rows[25:40], (3, 3, 394, "user", "new text"), (3, 1000, 395, "user", None), (None, 5, 5, "user", "x"), (2, None, 5, "user", "x")], [*rows[40:], (3, 1000, 2000, "user", "again")]]
    source, held, check = f"{tmp_path}/in", {}, f"{tmp_path}/checkpoint"
    like = spark.createDataFrame(rows, kind)

    def keep(df, n):
        held.update({r.conv_id: (r.n, [tuple(m) for m in r.messages]) for r in df.collect()})

    for part in parts:  # each time another run over the same checkpoint
        spark.createDataFrame(part, kind).repartition(2).write.mode("append").parquet(source)
        with messages.list_state(spark):
            stream.run(messages.accumulated(spark.readStream.schema(like.schema).parquet(source)), "update", keep, check)
    every = spark.createDataFrame([r for p in parts for r in p], kind)
    want = {r.conv_id: (r.n, [tuple(m) for m in r.messages]) for r in messages.batch_list(every).collect()}
    assert held == want and ("user", "new text") in [m[1:] for m in held[3][1]] and (1000, "user", "again") in held[3][1]
    assert messages.batch_list(every.limit(0)).count() == 0
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
