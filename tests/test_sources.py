import json

from pyspark.sql import functions as F

from gallerylens import config, models
from gallerylens.sources import readers, writers
from gallerylens.streaming import stream


def test_wiki_pages(spark, tmp_path):
    (tmp_path / "AA").mkdir()
    (tmp_path / "AA/wiki_00").write_text(json.dumps({"text": "x\ny", "title": "T", "url": "u?curid=1"}) + "\nno json\n")
    (tmp_path / "other_00").write_text(json.dumps({"text": "no"}))
    assert [r.title for r in readers.wiki_pages(spark, str(tmp_path)).collect()] == ["T"]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nline'), (2, None)], "id int, text string")
    writers.csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, readers.csv(spark, f"{tmp_path}/csv", "id int, text string").collect())) == [(1, 'a "q", b\nline'), (2, None)]
    edges = spark.createDataFrame([("a", "r", "b")], "head string, rel string, tail string")
    writers.triples(edges, f"{tmp_path}/tsv")
    assert readers.triples(spark, f"{tmp_path}/tsv").collect() == edges.collect()


def test_documents(spark, tmp_path):
    (tmp_path / "split.json").write_text(json.dumps({"relationships": {"7": {"style": [1, 2], "genre": []}}, "artwork": {"7": "x"}}, indent=1))
    assert sorted(map(tuple, readers.graph_split(spark, f"{tmp_path}/split.json").collect())) == [("7", "style", 1), ("7", "style", 2)]
    (tmp_path / "valid.json").write_text(json.dumps({"style": [3]}))
    assert list(map(tuple, readers.valid_labels(spark, f"{tmp_path}/valid.json").collect())) == [("style", 3)]
    (tmp_path / "preds.json").write_text(json.dumps([{"image_id": 4, "messages": [{"type": "ai", "content": "c", "doc_idxs": [1]}]}]))
    assert readers.predictions(spark, f"{tmp_path}/preds.json").first().messages[0].doc_idxs == [1]
    (tmp_path / "a.jpg").write_bytes(b"123")
    assert readers.images(spark, str(tmp_path)).first().length == 3


def test_paged(spark):
    class Api(readers.Paged):
        @staticmethod
        def fetch(category, token):
            n = int(token or 0)
            return [(10 * n + i, f"{category}{n}") for i in range(2)], str(n + 1) if n < 2 else None

    spark.dataSource.register(Api)
    got = spark.read.format("paged").option("categories", "a|b").load()
    assert got.count() == 12 and sorted({r.title for r in got.collect()}) == ["a0", "a1", "a2", "b0", "b1", "b2"]


def test_fetch(spark):
    def get(url):
        if url == "bad":
            raise OSError("gone")
        return url.encode()

    got = {r.url: (r.content, r.error) for r in readers.fetch(spark.createDataFrame([("ok",), ("bad",)], "url string"), get).collect()}
    assert got == {"ok": (bytearray(b"ok"), None), "bad": (None, "gone")}


def test_sharded_rewrite_and_upload(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.lit("a"))
    writers.fragments(df, f"{tmp_path}/f", 4)
    writers.fragments(df.where("id = 3").withColumn("v", F.lit("b")), f"{tmp_path}/f", 4)
    left = spark.read.parquet(f"{tmp_path}/f")
    assert left.where("v = 'b'").count() == 1 and left.select("shard").distinct().count() == 4
    out = str(tmp_path / "sent")

    def send(rows):
        with open(out, "a") as file:
            file.writelines(f"{r[0]}\n" for r in rows)

    writers.upload(df, send, batch=7)
    assert sorted(map(int, open(out).read().split())) == list(range(100))


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(i, i % 3, "x" * (i % 5), float(i)) for i in range(50)]
    for n in range(2):
        spark.createDataFrame(rows[25 * n : 25 * n + 25], "id long, k long, t string, v double").write.mode("append").parquet(f"{tmp_path}/t")
    like = spark.read.parquet(f"{tmp_path}/t")
    live = lambda: stream.files(spark, str(tmp_path), "t", like)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(stream.latest(stream.running_sums(live(), "k", "v"), "complete", "a")) == key(stream.running_sums(like, "k", "v"))
    grown = stream.latest(stream.accumulate(live(), "k", "t"), "update", "b").groupBy("k").agg(F.max("n"), F.max("chars"))
    assert key(grown) == key(like.groupBy("k").agg(F.count("*"), F.sum(F.length("t"))))
    assert key(stream.latest(stream.new_ids(live(), "k"), "append", "c")) == [(0,), (1,), (2,)]


def test_latest_checkpoint(spark, tmp_path):
    for n in ("checkpoint-9", "checkpoint-100", "checkpoint-x", "other-500"):
        (tmp_path / n).mkdir()
    assert readers.latest_checkpoint(spark, str(tmp_path)) == f"{tmp_path}/checkpoint-100"
    assert readers.latest_checkpoint(spark, f"{tmp_path}/other-500") is None


def test_upload_waits_between_attempts(spark, tmp_path):
    out = str(tmp_path / "tries")

    def send(rows):
        with open(out, "a") as file:
            file.write("x")
        if len(open(out).read()) < 3:
            raise OSError("busy")

    writers.upload(spark.range(1), send, delay=0.001)
    assert open(out).read() == "xxx"


def test_run_config(tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"sf_dir": "/x", "queries": ["a"], "models": {"judge": {"_target_": "gallerylens.models.LengthJudge", "least": 2}, "list": [{"_target_": "gallerylens.models.HashEmbedder"}]}}))
    run = config.RunConfig.load(str(tmp_path / "run.json"))
    assert run.models["judge"].accept(["a b", "c"]) == [True, False] and run.models["list"][0].dim == 64 and run.queries == ["a"]


def test_judged_aspects_and_questions(spark):
    class Echo:
        def generate(self, prompts):
            return ['ok {"Specificity": 4, "Fluency and Grammar": 9, "explanation": "e"}' if "good" in p else '{"question": "q?", "answer": "a."}' if "Document:" in p else "no idea" for p in prompts]

    pairs = spark.createDataFrame([(1, "good", ["r1", "r2"]), (2, "x", [])], "id int, hyp string, refs array<string>")
    got = {r.id: r for r in models.judge_aspects(pairs, Echo()).collect()}
    assert got[1]["Specificity"] == 4 and got[1]["Fluency and Grammar"] is None and got[1].explanation == "e" and got[1].raw_output is None
    assert got[2].raw_output == "no idea" and got[2]["Specificity"] is None
    asked = models.ask_questions(spark.createDataFrame([(1, "t"), (2, "good")], "id int, text string"), Echo()).orderBy("id").collect()
    assert [(r.question, r.answer) for r in asked] == [("q?", "a."), ("", "")]
