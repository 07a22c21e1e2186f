"""Texts and JSON lists of any content, written and read back."""

import json
import os
import random
import tempfile

from pyspark.sql import functions as F

from progcorpus.sources import json_io, sinks


def test_texts_come_back_whole(spark):
    texts = ["", "a", "a\nb\n", "\r\n\r", "nul \x00 \x00\x01 \x00\x02\n end\x00", "é☃\U0001F600", "\n" * 50, "x" * 100_000]
    rows = [(i, t, f"k{i % 3}") for i, t in enumerate(texts)] + [(99, None, "k0")]
    df = spark.createDataFrame(rows, "i int, t string, kind string")
    path = os.path.join(tempfile.mkdtemp(prefix="pc-texts-"), "out")
    sinks.sink_texts(df, path, "t", partition_by=["kind"])
    got = sorted((r.value, r.kind) for r in sinks.scan_texts(spark, path).collect())
    assert got == sorted((t, k) for _, t, k in rows if t is not None)
    assert sorted(x for x in os.listdir(path) if x.startswith("kind")) == ["kind=k0", "kind=k1", "kind=k2"]


def objects(rnd, n):
    def value(depth=0):
        kind = rnd.randrange(6 if depth < 3 else 3)
        if kind == 0:
            return "".join(rnd.choice('ab"\\{}[],:é\n') for _ in range(rnd.randrange(12)))
        if kind == 1:
            return rnd.choice([None, True, -3, 2.5])
        if kind == 2:
            return rnd.choice(["}", "{", "\\", '"', "]}", '\\"}', ""])
        if kind == 3:
            return [value(depth + 1) for _ in range(rnd.randrange(4))]
        return {rnd.choice(["x", 'q"', "}", "{"]): value(depth + 1) for _ in range(rnd.randrange(3))}

    return [{"id": i, "text": rnd.choice(["}", "a{", 'b"', "\\", "plain", ""]), "any": value()} for i in range(n)]


def test_lists_are_split_at_record_boundaries(spark):
    rnd = random.Random(5)
    folder = tempfile.mkdtemp(prefix="pc-lists-")
    want = []
    for k, (n, layout) in enumerate([(400, None), (300, 2), (0, None), (1, None), (120, "lines"), (90, "lists")]):
        rows = objects(rnd, n)
        want += rows
        with open(os.path.join(folder, f"f{k}.json"), "w") as f:
            if layout == "lines":
                f.write("\n".join(map(json.dumps, rows)))
            elif layout == "lists":
                f.write("\n".join(json.dumps(rows[i:i + 7], indent=1) for i in range(0, n, 7)) + "\n")
            else:
                f.write(json.dumps(rows, indent=layout, ensure_ascii=False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = json_io.scan_json_lists(spark, folder, "id int, text string, any string").collect()
        parts = spark.read.option("lineSep", "}").text(folder).select(
            "_metadata.file_path", "_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 50
    key = lambda x: json.dumps(x, sort_keys=True)

    def plain(r):
        if r.any is None:
            return None
        try:
            return json.loads(r.any)
        except ValueError:
            return r.any

    assert sorted(key([r.id, r.text]) for r in got) == sorted(key([x["id"], x["text"]]) for x in want)
    by = {key([x["id"], x["text"], x["any"]]) for x in want if isinstance(x["any"], (dict, list))}
    assert by <= {key([r.id, r.text, plain(r)]) for r in got}


def test_a_large_list_takes_many_tasks(spark):
    folder = tempfile.mkdtemp(prefix="pc-large-")
    with open(os.path.join(folder, "one.json"), "w") as f:
        f.write("[" + ",".join(json.dumps({"id": i, "t": "}" * (i % 7)}) for i in range(60_000)) + "]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200kb")
    try:
        df = json_io.scan_json_lists(spark, folder, "id long, t string")
        assert df.agg(F.count("*"), F.sum("id"), F.sum(F.length("t"))).first() == (
            60_000, sum(range(60_000)), sum(i % 7 for i in range(60_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
