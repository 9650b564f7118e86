import pytest
from pyspark.sql import functions as F

from semproxy import session
from semproxy.config import DatasetSpec
from semproxy.functions.scoring import ProxyModel
from semproxy.sources import quoted_lines
from semproxy.sources.artifacts import score_dump_join
from semproxy.sources.candidates import (
    attach_embeddings,
    load_candidates,
    load_embeddings_only,
    read_labeled_csv,
    write_examples,
)
from semproxy.streaming.scoring import route_stream
from tests.conftest import CANDIDATES

CSV = '''reviewText,other,scoreSentiment
"plain",1,POSITIVE
"has, comma",2,NEGATIVE
"two
lines, and ""quotes""",3,POSITIVE
last,4,NEGATIVE
'''


def test_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text(CSV)
    rows = read_labeled_csv(spark, str(tmp_path / "r.csv")).orderBy("row_index").collect()
    assert [(r["row_index"], r["label"]) for r in rows] == [(0, 1), (1, 0), (2, 1), (3, 0)]
    assert rows[2]["text"] == 'two\nlines, and "quotes"'


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda size: (
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)),
        spark.conf.set("spark.sql.files.openCostInBytes", "0"),
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_position_over_files_and_blocks(spark, tmp_path, multi_line, small_blocks):
    expected = []
    for part, size in enumerate((300, 5, 900)):
        lines = [f"text {part} {i},{'POSITIVE' if i % 2 else 'NEGATIVE'}" for i in range(size)]
        expected += [line.split(",")[0] for line in lines]
        body = "\n".join(["reviewText,scoreSentiment", *lines]) + "\n"
        (tmp_path / f"p{part}.csv").write_text(body)
    small_blocks(4000)
    rows = read_labeled_csv(spark, str(tmp_path), multi_line=multi_line)
    found = [(r["row_index"], r["text"]) for r in rows.orderBy("row_index").collect()]
    assert found == list(enumerate(expected))


def quoted_files(folder, seed, files=3, rows=120, blank=("", "  ")):
    """Files with breaks, quotes, commas, blank lines and both line ends inside and around values."""
    import random

    rng = random.Random(seed)
    pieces = ["word", '""', ",", "\n", "\r\n", "\n\n", " ", "Ünï", '""\n', "x" * 40]
    expected = []
    for part in range(files):
        end = rng.choice(["\n", "\r\n"])
        lines = ["other,reviewText,scoreSentiment"]
        for i in range(rows):
            label = rng.choice(["POSITIVE", "NEGATIVE"])
            inner = "".join(rng.choices(pieces, k=rng.randint(1, 9)))
            text = f"{part}-{i} {inner}." if rng.random() < 0.7 else None
            lines.append(f'{i},"{text}",{label}' if text else f"{i},plain {i},{label}")
            expected.append((text.replace('""', '"') if text else f"plain {i}", int(label == "POSITIVE")))
            if rng.random() < 0.1:
                lines.append(rng.choice(blank))
        with open(folder / f"r-{part}.csv", "w", newline="") as file:
            file.write(end.join(lines) + (end if part else ""))
    return expected


@pytest.mark.parametrize("size", [64, 700, 10**6])
def test_values_that_span_lines_are_read_in_blocks(spark, tmp_path, size, small_blocks):
    expected = quoted_files(tmp_path, size)
    small_blocks(size)
    rows = read_labeled_csv(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [(r["text"], r["label"]) for r in rows] == expected
    assert [r["row_index"] for r in rows] == list(range(len(expected)))


def test_blocks_equal_the_multi_line_reader(spark, tmp_path, small_blocks):
    (tmp_path / "a").mkdir()
    quoted_files(tmp_path / "a", 5, blank=("",))
    whole = read_labeled_csv(spark, str(tmp_path / "a"), multi_line=True)
    small_blocks(300)
    parts = read_labeled_csv(spark, str(tmp_path / "a"))
    # Line ends inside values: blocks keep them as they are, the other reader may shorten them.
    rows = [
        sorted((r["text"].replace("\r\n", "\n"), r["label"]) for r in frame.collect()) for frame in (whole, parts)
    ]
    assert rows[0] == rows[1]


def test_one_value_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "r.csv").write_text(f'reviewText,scoreSentiment\n"{long}",POSITIVE\nlast,NEGATIVE\n')
    small_blocks(100)
    lines = quoted_lines.lines_of(spark, str(tmp_path / "r.csv"))
    assert lines.select("block").distinct().count() > 20
    rows = read_labeled_csv(spark, str(tmp_path / "r.csv")).orderBy("row_index").collect()
    assert [r["text"] for r in rows] == [long, "last"]


def test_blocks_beyond_the_broadcast_bound(spark, tmp_path, small_blocks, monkeypatch):
    expected = quoted_files(tmp_path, 9)
    small_blocks(200)
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(quoted_lines, "BROADCAST_BYTES", -1)
    rows = read_labeled_csv(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [(r["text"], r["label"]) for r in rows] == expected


def test_a_quote_that_stays_open_is_an_error(spark, tmp_path):
    (tmp_path / "r.csv").write_text('reviewText,scoreSentiment\n"a,POSITIVE\n')
    with pytest.raises(ValueError, match="does not end"):
        read_labeled_csv(spark, str(tmp_path / "r.csv"))


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("reviewText,scoreSentiment\na,POSITIVE\n")
    (tmp_path / "b.csv").write_text("scoreSentiment,reviewText\nPOSITIVE,a\n")
    with pytest.raises(ValueError, match="another header"):
        read_labeled_csv(spark, str(tmp_path))


def test_unknown_sentiment(spark, tmp_path):
    (tmp_path / "r.csv").write_text("reviewText,scoreSentiment\na,NEUTRAL\n")
    with pytest.raises(Exception, match="unknown sentiment"):
        read_labeled_csv(spark, str(tmp_path / "r.csv")).collect()


def test_attach(spark):
    labeled = spark.createDataFrame(
        [(i, f"t{i}", i % 2) for i in range(20)], "row_index long, text string, label int"
    )
    archive = spark.createDataFrame(
        [(p, 19 - p, [float(p)]) for p in range(10)],
        "position long, row_index long, embedding array<float>",
    )
    rows = attach_embeddings(archive, labeled, maximum_rows=4).orderBy("position").collect()
    assert [(r["id"], r["text"]) for r in rows] == [(f"{i}", f"t{i}") for i in (19, 18, 17, 16)]
    with pytest.raises(Exception, match="no labeled row"):
        attach_embeddings(archive, labeled.where("row_index < 15")).collect()


def test_load_and_write(spark, tmp_path, blobs):
    spec = DatasetSpec("label", "id", "embedding")
    loaded = load_candidates(blobs, spec)
    assert loaded.schema.simpleString() == (
        "struct<id:string,text:string,embedding:array<float>>"
    )
    plan = load_embeddings_only(blobs)
    assert plan.columns == ["id", "embedding"]
    written = write_examples(blobs.select("id", "text", "embedding"), str(tmp_path / "e"))
    assert written.count() == 300
    no_text = spark.createDataFrame([("a", None, [1.0])], CANDIDATES)
    with pytest.raises(ValueError, match="null_text"):
        write_examples(no_text, str(tmp_path / "f"))


def test_text_is_not_read_for_the_pool(spark, tmp_path, blobs):
    path = str(tmp_path / "t")
    blobs.write.parquet(path)
    pool = load_embeddings_only(spark.read.parquet(path))
    plan = pool._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


def test_score_dump(spark, tmp_path, blobs):
    scores = blobs.select("id", F.lit(0.5).alias("score"))
    dump = score_dump_join(scores, blobs.select("id", "label"), str(tmp_path / "s"))
    assert sorted(dump.columns) == ["id", "label", "score"] and dump.count() == 300


def test_streams_route_like_tables(spark, tmp_path, blobs):
    path = str(tmp_path / "in")
    rows = blobs.select("id", "embedding")
    rows.repartition(3).write.parquet(path)
    model = ProxyModel((3.0, 0.0), 0.0)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    routed = route_stream(stream, model)
    run = (
        routed.writeStream.format("memory")
        .queryName("routed")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination(120)
    from semproxy.operators.cascade import route, score_rows

    expected = {r["id"]: r["zone"] for r in route(score_rows(rows, model), 0.2, 0.8).collect()}
    assert {r["id"]: r["zone"] for r in spark.table("routed").collect()} == expected
    with pytest.raises(ValueError):
        route_stream(rows, model)


def test_checkpoint_folder_is_named_or_local(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
    assert session.checkpoint_dir(spark)


def test_files_count_by_the_numbers_in_their_names(spark, tmp_path):
    for number in (99999, 100000, 7):
        (tmp_path / f"part-{number}.csv").write_text(f"reviewText,scoreSentiment\nt{number},POSITIVE\n")
    rows = read_labeled_csv(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [r["text"] for r in rows] == ["t7", "t99999", "t100000"]
