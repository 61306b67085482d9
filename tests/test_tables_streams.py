import random

import pytest

from veilspark.engine import Engine, faked
from veilspark.operators import tables
from veilspark.operators.rules import Rule
from veilspark.schema import EngineError
from veilspark.streaming.redactor import Redactor, StreamOptions, StreamState, redact_replay, redact_stream, run_batch
from veilspark.classifier import local

ROWS = [(0, "1", "Alice Carter", "alice@example.com", "100"), (1, "2", "Bob Davis", "bob@example.com", "250"), (2, "3", "Carol Evans", "carol@example.com", "175"), (3, "5", "Alice Carter", "alice@example.com", "999")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "row_idx long, id string, name string, email string, amount string")


def test_classify(spark, people):
    got = tables.classify_columns(people, Engine(), headers=["i", "n", "e", "a"]).orderBy("index").collect()
    assert [(r["header"], r["label"], r["confidence"], r["samples"]) for r in got] == [("i", None, 0.0, 4), ("n", "private_person", 1.0, 4), ("e", "private_email", 1.0, 4), ("a", None, 0.0, 4)]
    sparse = spark.createDataFrame([(i, v, "  ") for i, v in enumerate(["", "alice@example.com", None, "bob@example.com", "carol@example.com"])], "row_idx long, a string, b string")
    assert [(r["samples"], r["label"]) for r in tables.classify_columns(sparse, Engine()).orderBy("index").collect()] == [(3, "private_email"), (0, None)]
    assert tables.classify_columns(people, Engine(), sample_size=2).where("samples > 2").count() == 0
    with pytest.raises(EngineError):
        tables.classify_columns(people, Engine(), headers=["x"])


def test_modes(people):
    synth = [tuple(r) for r in tables.redact_table(people, Engine(), "synth").orderBy("row_idx").collect()]
    assert synth[0][2:4] == ("Alice Anderson", "alice.anderson@example.com") == synth[3][2:4] and synth[1][2] == "Maria Rodriguez"
    assert tables.redact_table(people, Engine(), "drop_column").columns == ["row_idx", "id", "amount"]
    red = tables.redact_table(people, Engine(), markers={"private_email": "<mail>"}, classifications=[None, None, "private_email", None]).orderBy("row_idx").first()
    assert (red["name"], red["email"]) == ("Alice Carter", "<mail>")
    with pytest.raises(EngineError):
        tables.redact_table(people, Engine(), "shred")


def test_ragged_and_headers(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"]), (2, ["d", "e", "f"])], "row_idx long, cells array<string>")
    assert [tuple(r) for r in tables.rectangular(df, 2).collect()] == [(0, "a", "b"), (1, "c", ""), (2, "d", "e")]
    assert tables.resolve_headers(2, ["x", "y"], None, True) == ["x", "y"]
    assert tables.resolve_headers(2, ["x", "y"], ["p", "q"], True) == ["p", "q"]
    assert tables.resolve_headers(2, ["x", "y"], None, False) == [None, None]
    with pytest.raises(EngineError):
        tables.resolve_headers(2, None, ["p"], False)


def test_faked_column(spark):
    df = spark.createDataFrame([(0, "Bob and Alice"), (1, "Alice, bob@x.com"), (2, "nothing")], "k long, text string")
    got = {r["k"]: r["redacted_text"] for r in faked(df, Engine(), ["k"], ["k"]).collect()}
    assert got == {0: "Alice Anderson and Maria Rodriguez", 1: "Maria Rodriguez, alice.anderson@example.com", 2: "nothing"}


RULES = [Rule("KEY", r"\bAKIA[0-9A-Z]{16}\b", severity="block", marker="[KEY]")]


def long_text():
    rnd = random.Random(8)
    parts = []
    for i in range(60):
        parts.append("".join(rnd.choice("abc def ") for _ in range(rnd.randint(50, 200))))
        parts.append(f" AKIA{i:016d} " if i % 2 else f" mail{i}@example.com ")
    return "".join(parts)


@pytest.mark.parametrize("size", [1, 7, 18, 24, 100, 500, 5000])
@pytest.mark.parametrize("options", [StreamOptions(), StreamOptions(64, 16)])
def test_stream_equals_batch(size, options):
    text = long_text() if size > 1 else long_text()[:6000]
    chunks = [text[i : i + size] for i in range(0, len(text), size)]
    out = run_batch(Redactor(RULES, options), [(i, c, i == len(chunks) - 1) for i, c in enumerate(chunks)])
    spans = local.detect(text, RULES)
    assert "".join(r["text"] for r in out if r["kind"] == "text") == local.splice(text, spans)
    assert [(r["label"], r["start"], r["end"]) for r in out if r["kind"] == "span"] == [(s["label"], s["start"], s["end"]) for s in spans]
    assert out[-1]["kind"] == "result"


def test_stream_emits_early_and_stays_small():
    text, r, st = long_text(), Redactor(RULES, StreamOptions(64, 16)), StreamState()
    texts = 0
    for i, at in enumerate(range(0, len(text), 50)):
        texts += sum(x["kind"] == "text" for x in r.feed(st, i, text[at : at + 50], False))
        assert len(st.buffer) < 1000
        st = StreamState.load(st.dump())
    assert texts > 50


def test_stream_out_of_order_and_repeats():
    r = Redactor(RULES)
    rows = [(2, "c", True), (0, "a AKIA0000000000", False), (0, "again", False), (1, "000000 ", False)]
    assert "".join(x["text"] for x in run_batch(r, rows) if x["kind"] == "text") == "a [KEY] c"
    with pytest.raises(EngineError):
        StreamOptions(10, 10)


def test_structured_streaming(spark, tmp_path):
    text = long_text()
    chunks = [text[i : i + 300] for i in range(0, len(text), 300)]
    rows = [(s, i, c, i == len(chunks) - 1) for s in ("x", "y") for i, c in enumerate(chunks)]
    schema = "stream_id string, seq long, chunk string, eos boolean"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = redact_stream(stream, Redactor(RULES)).writeStream.format("memory").queryName("redacted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = local.splice(text, local.detect(text, RULES))
    for df in (spark.table("redacted"), redact_replay(spark.createDataFrame(rows, schema), Redactor(RULES))):
        for s in ("x", "y"):
            got = df.where(f"kind = 'text' and stream_id = '{s}'").orderBy("pos").collect()
            assert "".join(r["text"] for r in got) == want
