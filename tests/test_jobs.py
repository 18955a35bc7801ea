"""Sources, sinks, streams and composite jobs on small literal inputs."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftmill.catalog import jobs, streams
from siftmill.catalog import views as V
from siftmill.operators import sampling, turns
from siftmill.operators.filters import chunk_rows
from siftmill.plans import compile as compiling
from siftmill.plans import corpora, labels
from siftmill.session import scratch
from siftmill.sources import csv_tree, sinks, tables
from siftmill.streaming import caps, files, usage


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "one.csv").write_text(
        'id,text,lang\n1,"two\nlines, ""quoted""",en\n2,too,many,fields\n3,few\n', encoding="utf8"
    )
    (tmp_path / "a" / "deep" / "two.csv").write_text("text,id\nplain,4\n", encoding="utf8")
    (tmp_path / "a" / "emotion_words.csv").write_text("id,text\n9,skipped\n", encoding="utf8")
    (tmp_path / "other.csv").write_text("id,body\n8,no text column\n", encoding="utf8")
    rows = csv_tree.read_csv_tree(spark, str(tmp_path), required=["text"]).collect()
    got = {r["id"]: (r["text"], r["lang"]) for r in rows}
    named = csv_tree.read_csv_tree(spark, str(tmp_path), required=["text"], row_name="post_id")
    names = [r["post_id"] for r in named.collect()]
    assert sorted(names) == ["a/deep/two.csv_0", "a/one.csv_0", "a/one.csv_2"]
    assert got == {
        "1": ('two\nlines, "quoted"', "en"), "3": ("few", None), "4": ("plain", None),
    }


def test_csv_marks_and_headers(spark, tmp_path):
    (tmp_path / "mark.csv").write_text("text,id\nfirst,1\nsecond,2\n", encoding="utf-8-sig")
    (tmp_path / "plain.csv").write_text('id,text,"a\nb"\n3,third,x\n', encoding="utf8")
    rows = csv_tree.read_csv_tree(spark, str(tmp_path), required=["text", "id"], row_name="name")
    got = sorted((r["name"], r["id"], r["text"], r["a\nb"]) for r in rows.collect())
    assert got == [
        ("mark.csv_0", "1", "first", None), ("mark.csv_1", "2", "second", None),
        ("plain.csv_0", "3", "third", "x"),
    ]


def test_places_of_repeated_and_missing_turns(spark):
    rows = [("a", t, "user", f"a{i}") for i, t in enumerate([0, 0, 2])]
    rows += [("b", t, "user", f"b{i}") for i, t in enumerate([5, 5, 7])]
    rows += [("c", t, "user", f"c{i}") for i, t in enumerate([1, None])] + [(None, 0, "user", "n")]
    rows += [("d", t, "user", f"d{t}") for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = defaultdict(list)
    for r in turns.with_place(df).collect():
        got[r["conv_id"]].append((r["place"], r["turn"]))
    assert {k: sorted(p for p, _ in v) for k, v in got.items()} == {
        "a": [0, 1, 2], "b": [0, 1, 2], "c": [0, 1], "d": [0, 1, 2], None: [0]
    }
    assert sorted(got["c"], key=str) == [(0, None), (1, 1)] and (2, 7) in got["b"]


def test_missing_counts_of_a_page_are_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="missing"):
        caps._counts_before(spark, "author", str(tmp_path), 7)
    assert caps._counts_before(spark, "author", str(tmp_path), 0) is None


def test_control_posts_of_many_groups(spark):
    text = "one two three four five six seven eight nine ten eleven twelve. " * 2
    posts = spark.range(24_000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("post_id"), F.lit("unknown").alias("author"),
        F.lit(1630000000.0).alias("created_utc"), F.lit(text).alias("selftext"),
        F.concat(F.lit("g"), (F.col("id") % 12_000).cast("string")).alias("subreddit"),
    )
    wanted = corpora.quota_table(posts, "subreddit", per_group=1, low=1, high=1)
    made = corpora.control_posts(posts, wanted, order=["created_utc", "post_id"])
    assert made.select("subreddit").distinct().count() == 12_000


def test_rows_without_a_class_stay(spark):
    rows = spark.range(400).select(
        F.col("id").alias("vec_id"), F.concat(F.lit("u"), (F.col("id") % 90).cast("string")).alias("author"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("subreddit"),
        (F.col("id") % 2).cast("int").alias("binary_label"), F.lit(0.1).alias("pos_score"), F.lit(0.1).alias("neg_score"),
        F.array(F.cos("id").cast("float"), F.sin("id").cast("float")).alias("embedding"),
    )
    options = compiling.CompileOptions(neighbours=3, label_neighbours=3, risk_density=-1.0, safe_density=-1.0)
    made = compiling.compile_sets(rows, options=options)
    counts = {r["stage"]: r["rows"] for r in made.funnel.collect()}
    assert counts["all"] == 400 == counts["train"] + counts["test"]
    assert {r["subreddit"] for r in made.classes.collect()} == {"(none)", "c0", "c1", "c2"}


def test_long_conversation_is_cut_into_segments(spark):
    df = spark.range(2500).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    nested = tables.nest_conversations(df)
    assert nested.count() == 3
    back = tables.unnest_conversations(nested).orderBy("turn").collect()
    assert [r["text"] for r in back] == [str(i) for i in range(2500)]


def test_nested_input_without_turn_numbers(spark):
    df = spark.sql(
        "select 'c' id, array(named_struct('role','user','content','a'),"
        "named_struct('role','assistant','content','b')) conversation union all "
        "select 'd', null"
    )
    got = tables.unnest_conversations(df, "id").collect()
    assert [tuple(r) for r in got] == [("c", 0, "user", "a"), ("c", 1, "assistant", "b")]


def test_nested_chats_become_pairs(spark):
    df = spark.sql(
        "select 'c' id, 'English' language, 'm' model, array(named_struct('role','system','content','s'),"
        "named_struct('role','user','content',cast(null as string)),"
        "named_struct('role','assistant','content','b'),"
        "named_struct('role','user','content','q'),"
        "named_struct('role','assistant','content','r')) conversation union all "
        "select 'd', 'French', 'm', null"
    )
    long = corpora.nested_chats(df, "id", "English")
    got = sorted(tuple(r) for r in corpora.chat_pairs(long, "id").collect())
    assert got == [("c", 1, "English", "m", None, "b", 0), ("c", 2, "English", "m", "q", "r", 1)]
    chunks = corpora.chat_chunks(long, 5, conv="id").collect()
    assert [(r["turn_id"], r["chunk_id"], r["input"]) for r in chunks] == [(2, 1, "q")]


def test_pairs_with_gaps_in_the_turn_numbers(spark):
    rows = [(1, 5, "system", "s"), (1, 7, "user", "a"), (1, 20, "assistant", "b"),
            (1, 21, "user", "c"), (1, 22, "user", "d"), (1, 30, "assistant", "e")]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    got = sorted(tuple(r) for r in turns.turn_pairs(df).collect())
    assert got == [(1, 1, "a", "b"), (1, 3, "d", "e")]
    ids = sorted(r["id"] for r in turns.user_turns(df, longer=0).collect())
    assert ids == ["1_1", "1_3", "1_4"]


def test_first_user_turn_that_is_empty(spark):
    rows = [(1, 0, "user", ""), (1, 2, "user", "x"), (2, 1, "user", "y"), (3, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    assert [tuple(r) for r in turns.first_user(df).collect()] == [(2, "y")]


def test_resume_by_position(spark):
    done = sinks.after_rows(spark.range(100), "id", 60)
    assert sorted(r["id"] for r in done.collect()) == list(range(60, 100))


def write_files(df, folder, parts):
    for i in range(parts):
        df.where(F.col("doc_id") % parts == i).coalesce(1).write.mode("append").parquet(folder)


def test_stream_goes_on_where_it_stopped(spark, small):
    docs = V.table(spark, small, "documents").select("doc_id", "text")
    folder, out, progress = (scratch(spark, n) for n in ("in", "out", "progress"))
    write_files(docs.where("doc_id < 100"), folder, 3)

    def run():
        stream = files.arriving(spark, folder, docs.schema, files_per_trigger=1)
        files.stream_chunks(stream, "text", ["doc_id"], out, progress)
        return Counter(tuple(r) for r in spark.read.parquet(out).collect())

    first = run()
    assert run() == first
    write_files(docs.where("doc_id >= 100"), folder, 2)
    want = Counter(tuple(r) for r in chunk_rows(docs, "text", ["doc_id"]).collect())
    assert run() == want


def test_streams_read_tables_stored_as_folders(spark, small, tmp_path):
    """A table of several files lies in a folder that has the name of the single file."""
    for name in ("documents", "embeddings"):
        stored = spark.read.parquet(f"{small}/{name}.parquet")
        stored.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for made in (streams.x01_stream_chunks, streams.x02_foreach_batch, streams.x06_stream_score):
        got, want = (Counter(made(spark, d).collect()) for d in (str(tmp_path), small))
        assert got == want and want


def test_stream_cap_equals_batch_cap(spark):
    rows = [(i, f"u{i % 9}" if i % 3 else "unknown") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id int, author string")
    folder, out, counts, progress = (scratch(spark, n) for n in ("in", "out", "counts", "progress"))
    for low in range(0, 300, 60):
        df.where(F.col("doc_id").between(low, low + 59)).coalesce(1).write.mode("append").parquet(folder)

    def run(at):
        stream = files.arriving(spark, folder, df.schema, files_per_trigger=1)
        caps.stream_author_cap(stream, "author", ["doc_id"], out, counts, at)
        return sorted(r["doc_id"] for r in spark.read.parquet(out).collect())

    want = sorted(r["doc_id"] for r in sampling.author_cap(df, "author", ["doc_id"]).collect())
    assert run(progress) == want
    assert run(scratch(spark, "lost")) == want


def test_usage_stream_equals_batch(spark, small):
    batch = V.usage(spark, small)
    folder, out, progress = (scratch(spark, n) for n in ("in", "out", "progress"))
    batch.coalesce(1).write.parquet(folder)
    stream = files.arriving(spark, folder, batch.schema)
    files.append_available(usage.usage_windows(stream), out, progress)
    got = {r["start"]: r["requests"] for r in spark.read.parquet(out).collect()}
    want = {r["start"]: r["requests"] for r in usage.usage_windows(batch).collect()}
    # The windows behind the watermark are out; the newest one is still open.
    assert got and all(want[s] == n for s, n in got.items()) and len(want) - len(got) <= 3


def test_control_posts_against_a_sequential_model(spark, small):
    posts = V.posts(spark, small).withColumn("author", F.when(
        F.col("author") == "u3", F.lit(None)).otherwise(F.col("author")))
    wanted = [("src1", 30), ("src0", 60), ("src2", 45)]
    names = sorted(r[0] for r in posts.select("subreddit").distinct().collect())
    wanted = list(zip(names, (30, 60, 45)))
    got = corpora.control_posts(posts, wanted, order=["created_utc", "post_id"]).collect()
    from siftmill.operators import filters

    good = filters.quality_body(filters.in_period(posts), "selftext")
    sizes = defaultdict(int)
    for r in chunk_rows(good, "selftext", ["post_id"]).collect():
        sizes[r["post_id"]] += 1
    used, kept = Counter(), set()
    table = good.select("post_id", "author", "subreddit", "created_utc").collect()
    for group, quota in wanted:
        total = 0
        for r in sorted((r for r in table if r["subreddit"] == group),
                        key=lambda r: (r["created_utc"], r["post_id"])):
            if total >= quota:
                break
            if r["author"] not in (None, "unknown"):
                if used[r["author"]] >= 5:
                    continue
                used[r["author"]] += 1
            kept.add(r["post_id"])
            total += sizes[r["post_id"]]
    assert {r["post_id"] for r in got} == kept
    assert sorted(r["pos"] for r in got) == list(range(len(got)))


def test_compiled_set_is_written(spark, small):
    rows = V.vectors(spark, small)
    made = compiling.compile_sets(rows, options=jobs.OPTIONS)
    texts = rows.select("vec_id", F.concat(F.lit("t"), F.col("vec_id")).alias("input"))
    path = scratch(spark, "train")
    sinks.write_compiled(compiling.compiled_rows(made, texts, "vec_id", "train"), path)
    stored = spark.read.parquet(path)
    assert stored.columns == ["text", "label", "soft_label", "subreddit"]
    assert stored.count() == made.rows.where("side = 'train'").count() > 0
    sums = stored.select(F.aggregate("soft_label", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    sides = made.rows.join(rows.select("vec_id", "author"), "vec_id").where(
        ~F.col("author").isin("unknown", "[deleted]"))
    both = sides.groupBy("author").agg(F.count_distinct("side").alias("n")).where("n > 1")
    assert both.count() == 0


def test_compile_with_cells(spark, small):
    """Approximate search over all cells is the exact one."""
    from dataclasses import replace

    rows = V.vectors(spark, small)
    exact = compiling.compile_sets(rows, options=jobs.OPTIONS)
    cells = compiling.compile_sets(rows, options=replace(jobs.OPTIONS, cells=6, nprobe=6))

    def answer(made):
        return {tuple(r) for r in made.shares.select(
            "qid", "class_idx", F.round("p", 9)).collect()}

    assert answer(exact) == answer(cells)


def test_empty_risk_set_is_kept_whole(spark):
    from siftmill.operators.filters import drop_happy_risk

    df = spark.createDataFrame([(0.9, 0.1), (0.8, 0.2)], "pos_score double, neg_score double")
    assert drop_happy_risk(df).count() == 2


def test_materialised_is_built_once(spark):
    path, calls = scratch(spark, "kept"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sinks.materialised(spark, path, build).count() == 3
    assert sinks.materialised(spark, path, build).count() == 3
    assert len(calls) == 1 and sinks.exists(spark, path)


def test_population_goes_on_with_what_is_missing(spark):
    from siftmill.plans import populate

    chunks = spark.createDataFrame(
        [(i, 1, "bad" if i % 4 == 0 else f"text\0{i}") for i in range(40)],
        "post_id int, chunk_id int, input string",
    )
    path = populate.start_over(spark, scratch(spark, "table"))

    def load(refused):
        def embed(texts):
            if refused in texts:
                raise ValueError(refused)
            return [[len(t), 1] for t in texts]

        return lambda: embed

    keys = ["post_id", "chunk_id"]
    assert populate.populate(chunks.where("post_id < 20"), keys, load("bad"), path).count() == 15
    assert populate.populate(chunks, keys, load("bad"), path).count() == 30
    stored = populate.populate(chunks, keys, load("none"), path)
    assert stored.count() == stored.select(*keys).distinct().count() == 40
    assert stored.where(F.contains("input", F.lit("\0"))).count() == 0
    again = populate.start_over(spark, path.rsplit("/v=", 1)[0])
    assert again.endswith("v=2")


def test_snapshot_scores(spark):
    rows = [
        (1, "safe", '{"negative": 0.2, "positive": 0.9}', None), (2, "mental_health_x", None, ["negative"]),
        (3, None, "broken", []), (4, "safe", '{"positive": 0.4}', ["negative"]),
    ]
    df = spark.createDataFrame(
        rows, "id int, dataset_type string, emotion_scores string, predicted_emotions array<string>"
    )
    got = {r["id"]: (r["pos_score"], r["neg_score"], r["binary_label"])
           for r in compiling.with_scores(df).collect()}
    assert got == {1: (0.9, 0.2, 0), 2: (0.0, 1.0, 1), 3: (0.0, 0.0, 0), 4: (0.4, 0.0, 0)}
    bare = compiling.with_scores(df.select("id", "dataset_type")).first()
    assert (bare["pos_score"], bare["neg_score"]) == (0.0, 0.0)


def test_probe_is_trained_and_written_back(spark, small):
    """Stored text columns to a fitted probe to an updated table."""
    from siftmill.catalog import models
    from siftmill.operators import probe
    from siftmill.plans import labels

    stored = models.tagged(spark, small).select(
        "vec_id",
        F.when(F.col("vec_id") % 10 == 0, "broken").otherwise(F.to_json("embedding")).alias("embedding"),
        F.to_json("emotions").alias("emotions"),
    )
    rows = labels.training_labels(stored, "emotions", "embedding")
    model, _ = probe.fit_probe(rows, "vec_id", "embedding", "emotions", iterations=10)
    made = labels.enrich(stored, model, "vec_id", "embedding", scratch(spark, "t"), 1, 0.6)
    assert made.count() == stored.count()
    broken = made.where(F.col("vec_id") % 10 == 0)
    assert broken.where("emotion_scores is not null").count() == 0
    good = made.where(F.col("vec_id") % 10 != 0)
    flags = F.array_contains("predicted_emotions", "positive") == (
        F.col("emotion_scores.positive") >= 0.6)
    assert good.where(~flags).count() == 0 and good.where("emotion_scores is null").count() == 0


def test_posts_without_optional_columns(spark):
    """Missing columns and values get their defaults, and all of them are carried to the chunks."""
    body = "One plain sentence that is long enough to be kept. " * 3
    posts = spark.createDataFrame(
        [("a", body, 1630000000.0, "7", None), ("b", body, 1630000001.0, "x", "t")],
        "post_id string, selftext string, created_utc double, score string, title string",
    )
    got = {r["post_id"]: r for r in corpora.risk_posts(posts).collect()}
    assert (got["a"]["score"], got["a"]["title"], got["a"]["author"]) == (7, "", "unknown")
    assert (got["b"]["score"], got["b"]["title"], got["b"]["subreddit"]) == (0, "t", "unknown")


def test_labelled_rows_without_ids(spark):
    rows = spark.createDataFrame([("some text here", 1), ("other text", 0)], "text string, joy int")
    got = corpora.labelled_emotions(rows, names=["joy"]).collect()
    assert len({r["id"] for r in got}) == 2 and {r["subreddit"] for r in got} == {"unknown"}
    again = corpora.labelled_emotions(rows.repartition(3), names=["joy"]).collect()
    assert {r["id"] for r in got} == {r["id"] for r in again}


def test_limit_of_long_posts(spark):
    posts = spark.createDataFrame([(i, "long enough") for i in range(9)], "post_id long, selftext string")
    got = labels.long_posts(posts, limit=4).collect()
    assert sorted(r["id"] for r in got) == ["0", "1", "2", "3"]
