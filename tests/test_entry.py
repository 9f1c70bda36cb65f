"""The driver contract, the command line and the stream."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from shoal import cli, params
from shoal.sources.points import POINT
from shoal.streaming.points import running_bounds, stream_points

ROOT = Path(__file__).resolve().parents[1]


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "cluster_points" in __spark_entry__.queries()


#: An importer that doesn't find some modules, as where their files are deleted.
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in ('shoal.llm', 'corpus_pipeline'):
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Hidden())
"""


def test_entry_imports_without_the_llm_package():
    check = "import __spark_entry__ as e\nassert not [k for k in e.queries() if k.startswith('op') or k == 'pipeline'] and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", HIDE + check], cwd=ROOT, check=True)


def test_entry_does_not_hide_other_failures():
    check = "import importlib.util\nif importlib.util.find_spec('corpus_pipeline'):\n    sys.modules['shoal.llm.vectext'] = None\n    import __spark_entry__\nelse:\n    raise SystemExit(1)"
    assert subprocess.run([sys.executable, "-c", "import sys\n" + check], cwd=ROOT, capture_output=True).returncode == 1


LINES = "".join(f"{i} {i % 10 / 10} {i // 20}\n" for i in range(60))
SMALL = ["--eps", "0.15", "--min-pts", "2", "--max-partition-size", "20", "--buckets", "8"]


@pytest.fixture
def lines(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(LINES)
    return tmp_path


def result(spark, path):
    return {r["id"]: r["cluster_id"] for r in spark.read.parquet(str(path)).collect()}


def test_a_failed_stage_gives_its_number(lines):
    args = ["--input", str(lines / "in"), "--output", str(lines / "out"), *SMALL]
    assert cli.main([*args, "--stage", "5"]) == 5
    assert cli.main([*args, "--stage", "2"]) == 2
    nowhere = ["--input", str(lines / "nowhere"), *args[2:]]
    assert cli.main([*nowhere, "--stage", "all"]) == 1
    assert cli.main(nowhere) == 9
    assert cli.main([*args, "--stage", "10"]) == 2
    assert cli.main([]) == cli.main(args[:-1]) == cli.main([*args[:5], "0", *args[6:]]) == 1


JOB = """<?xml version="1.0"?><configuration>
<property><name>dbscan.epsilon</name><value> 0.15 </value></property><property><name>dbscan.minpts</name><value>2</value></property>
<property><name>dbscan.stage2.buckets</name><value>8</value></property><property><name>dbscan.stage3.size</name><value>20</value></property>
<property><name>dbscan.csv.input</name><value>{at}/in</value></property><property><name>dbscan.csv.delim</name><value> </value></property>
<property><name>dbscan.csv.header</name><value>false</value></property><property><name>dbscan.csv.id</name><value>true</value></property>
<property><name>other</name><value>1</value></property>{outputs}</configuration>"""


def test_a_job_file(spark, lines):
    outputs = "".join(f"<property><name>dbscan.stage{n}.output</name><value>{lines}/s{n}</value></property>" for n in range(1, 10))
    (lines / "job.xml").write_text(JOB.format(at=lines, outputs=outputs))
    assert cli.main([f"--jobConf={lines}/job.xml"]) == 0
    assert cli.main(["--input", str(lines / "in"), "--output", str(lines / "direct"), *SMALL]) == 0
    assert result(spark, lines / "s9") == result(spark, lines / "direct")
    # A stage can run again, by number or name, from what earlier ones saved; text is for the last.
    assert cli.main([f"--job-conf={lines}/job.xml", "--stage=9", "--output-format", "tsv"]) == 0
    assert spark.read.text(f"{lines}/s9").count() == 60
    # With a scheme the file is read by Spark, and has to be there.
    assert cli.main([f"--job-conf=file://{lines}/job.xml", "--stage=bounds"]) == 0
    assert cli.main([f"--job-conf=file://{lines}/none.xml"]) == 1
    (lines / "bad.xml").write_text("<configuration>")
    assert cli.main([f"--job-conf={lines}/bad.xml"]) == 1


def test_job_settings(tmp_path, capsys):
    found = params.parse_job(JOB.format(at="/d", outputs=""))
    assert found == {"eps": "0.15", "min_pts": "2", "buckets": "8", "max_partition_size": "20", "input": "/d/in", "delimiter": " ", "header": "false", "with_id": "true"}
    job = params.Job.from_mapping(found, "/o")
    assert job.params == params.ClusterParams(0.15, 2, 8, 20) and job.outputs[3] == "/o/stage3" and job.with_id and not job.header
    # A local path that isn't there gives the built-in settings.
    default = params.read_job(str(tmp_path / "none.xml"))
    assert params.Job.from_mapping(default).params == params.ClusterParams(30000.0, 30, 128, 3000)
    assert "built-in" in capsys.readouterr().err
    for bad in ({"header": "maybe"}, {"input": ""}, {"stage1": "/d/in"}, {"min_pts": "x"}):
        with pytest.raises(ValueError):
            params.Job.from_mapping({**found, **bad}, "/o")
    with pytest.raises(ValueError, match="stage 1"):
        params.Job.from_mapping(found)


def test_command_line_reads_parquet(spark, tmp_path):
    spark.createDataFrame([(i, [float(i)]) for i in range(5)], POINT).write.parquet(str(tmp_path / "p"))
    args = ["--input", str(tmp_path / "p"), "--output", str(tmp_path / "o"), "--eps", "1.5", "--min-pts", "1", "--format", "parquet", "--output-format", "tsv"]
    assert cli.main(args) == 0
    assert spark.read.text(str(tmp_path / "o")).count() == 5


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1 2.0 3\n\n2 -1 5\n3\n")
    found = running_bounds(stream_points(spark, str(tmp_path / "in")))
    query = found.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    rows = {r["dim"]: (r["n"], r["lower"]) for r in spark.table("running").collect()}
    assert rows == {0: (2, -1.0), 1: (2, 3.0)}
