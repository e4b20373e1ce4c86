"""Jobs over parts that are stopped and go on, on local and other file systems."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import scoring as S
from marlstone.sources.commits import Files, PartJob, Progress
from marlstone.sources.workspace import shared_folder


@pytest.fixture(params=["file", "viewfs"])
def folder(spark, request):
    path = shared_folder(spark, "job")
    if request.param == "file":
        return path
    conf = spark._jsc.hadoopConfiguration()
    name = f"jobs{abs(hash(path))}"  # file systems are kept by name
    conf.set(f"fs.viewfs.mounttable.{name}.link./in", path)
    Files(spark, path).make(path)
    return f"viewfs://{name}/in/here"


def texts(spark, n=200):
    return spark.range(n).select(F.col("id").alias("doc"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))


def test_stopped_job_goes_on_with_what_is_missing(spark, folder):
    rows, encoder, asked = texts(spark), S.hashing_encoder(8), []

    def encode(some):
        asked.append(sorted(r[0] for r in some.select("part").distinct().collect()))
        if len(asked) == 3:
            raise RuntimeError("lost")
        return S.embed(some, "text", encoder, 8)

    def job():
        return PartJob(spark, folder, 10, model="hash-8")

    with pytest.raises(RuntimeError, match="lost"):
        job().run(rows, "doc", encode, wave=2)
    assert job().progress() == Progress(4, 10)
    assert {r["part"] for r in job().read("doc long, part int, embedding array<float>").collect()} == {0, 1, 2, 3}
    out = job().run(rows, "doc", encode, wave=3)
    assert asked == [[0, 1], [2, 3], [4, 5], [4, 5, 6], [7, 8, 9]]
    once = PartJob(spark, folder, 10, model="again").run(rows, "doc", lambda some: S.embed(some, "text", encoder, 8), wave=10)
    assert sorted(map(tuple, out.select("doc", "part", "embedding").collect())) == sorted(map(tuple, once.select("doc", "part", "embedding").collect()))
    assert len(job().run(rows, "doc", encode).collect()) == 200 and asked[5:] == [[]]  # nothing left to do but the columns


def test_a_part_is_published_once(spark, folder):
    files = Files(spark, folder)
    for n in (1, 2):
        files.write(f"{folder}/try{n}/x", str(n))
    assert files.publish(f"{folder}/try1", f"{folder}/part") and not files.publish(f"{folder}/try2", f"{folder}/part")
    assert files.read(f"{folder}/part/x") == "1" and files.names(folder) == ["part"]


def test_texts_are_whole(spark, folder):
    files = Files(spark, folder)
    for text in ("", "ü" * 5000, "last"):
        files.write(f"{folder}/a.json", text)
        assert files.read(f"{folder}/a.json") == text
    assert files.names(folder) == ["a.json"]


def test_empty_parts_and_leftovers(spark, folder):
    job = PartJob(spark, folder, 4, model="m")
    assert job.run(texts(spark, 0), "doc", lambda x: x).collect() == []
    assert job.progress() == Progress(4, 4)
    job.files.make(f"{job.folder}/.attempt-left")
    job.clean()
    assert job.files.names(job.folder) == ["job.json", "table"]
