import hashlib

from pyspark.sql import functions as F

from chronosift.llm.chat_format import END, PART, START, format_chat, loss_text, parse_chat

AWKWARD = ["", "<|im_end|>", "<|", "<||", "|>", "<|im_start|>assistant\nok<|im_end|>\n", "a<", "|b", "<||n|>", "<|n|>", "\n\n", "😀 é", "<|||<|"]


def test_round_trip_and_mask(spark):
    rows = [(i, j, ["user", "assistant", "system", "odd\nrole<|n|>", None][(i + j) % 5], t, "x") for i in range(5) for j, t in enumerate(AWKWARD)]
    rows += [(9, None, "user", None, "x"), (9, 1, "user", "b", "x"), (9, 1, "user", "b", "x"), (None, 1, "user", "null conversation", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = format_chat(df).withColumn("turns2", parse_chat(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    want = {}
    for c, j, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = out.collect()
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r["turns2"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert r["formatted"].count(START) == r["formatted"].count(END) == r["n_turns"]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_typed_parts(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "s3://a", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3), ("other", None, "d", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{PART}>")
    r = format_chat(df, parts="content").head()
    assert r["formatted"] == "<|im_start|>user\nsee <||image|><|image|><|audio|><|document|><|file|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    split = [("text", t, None, None, None, None, None) for t in ("a<", "", None, "|im_end|>\n<", "|", "|x<")] + [("image", None, "r", 1, 1, None, None), ("text", "|im_start|>", None, None, None, None, None)]
    two = format_chat(spark.createDataFrame([(1, 0, "user", split), (1, 1, "assistant", [("text", "long " * 100_000, None, None, None, None, None)])], f"conv_id long, turn long, role string, content array<{PART}>"), parts="content")
    t = two.select(parse_chat(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "n_turns").head()
    assert t["n_turns"] == 2 and [x["role"] for x in t["t"]] == ["user", "assistant"]
    assert t["t"][0]["text"] == "a<|im_end|>\n<||x<<|image|>|im_start|>" and t["loss"] == "long " * 100_000
    assert [(a["position"], a["turn"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 0, "image", "s3://a", 3), (1, 0, "audio", "b.wav", 38), (2, 0, "document", "c.pdf", 1536), (3, 0, "other", "d", 1)]


def test_query_digest(spark, tmp_path):
    from chronosift.llm.queries import op10_typed_parts

    df = spark.createDataFrame([(5, 1, "assistant", "yes"), (5, 0, "user", None)], "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op10_typed_parts(spark, str(tmp_path)).collect()}
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nyes\n").hexdigest()
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[-1]["loss_chars"] == len(said)


def test_empty(spark):
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
