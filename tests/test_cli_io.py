import csv
import json
import sys

import pytest

from nearnames import cli
from nearnames.sources import io
from nearnames.streaming import incremental

NAMES = ["aprinol", "aprinal", "aprinel", "dugorov", "dugorev", "sorulin", "surilin", "sorulen", "zantac", "zentac", "zantec", "lopral", "loprel", "lopril", "tamivar", "tamivor", "tamiver", "bexolin", "bexalin", "bexulin"]


@pytest.fixture
def data(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/R_us.csv").write_text("drug_name\n" + "\n".join(NAMES) + "\nNA\n")
    (tmp_path / "data/P_us.csv").write_text("x_1,x_2\naprinol,aprinal\nsorulin,surilin\n")
    return tmp_path


def run(spark, data, *argv):
    return cli.main([argv[0], "--data", str(data / "data"), "--results", str(data / "out"), *argv[1:]], spark)


def test_all_then_relabel_and_lexicon(spark, data):
    assert run(spark, data, "all", "--from-file", "--target", "6", "--random-share", "0") == 0
    d = io.read_csv(spark, str(data / "out/D.csv"))
    assert d.columns == ["x_1", "t_eng_1", "t_fil_1", "x_2", "t_eng_2", "t_fil_2", "label"]
    assert d.where("label = '1'").count() == 2 and d.where("label = '0'").count() == 6
    assert "core_aline_cangu" in io.read_csv(spark, str(data / "out/D_pho.csv")).columns
    assert "pairs: 6" in (data / "out/U_report.txt").read_text()
    (data / "ch.csv").write_text("action,x_1,x_2,new_label\nremove,aprinal,aprinol,\n")
    assert run(spark, data, "relabel", "--input", str(data / "out/D.csv"), "--changes", str(data / "ch.csv"), "--output", str(data / "out/D2.csv")) == 0
    assert io.read_csv(spark, str(data / "out/D2.csv")).count() == 7
    assert run(spark, data, "lexicon", "--input", str(data / "out/D.csv"), "--output", str(data / "out/lex.parquet")) == 0
    lex = spark.read.parquet(str(data / "out/lex.parquet"))
    assert {t for c, t in lex.dtypes if c not in ("x_1", "x_2")} == {"float"}


def test_propose_and_featurize(spark, data):
    assert run(spark, data, "propose") == 0
    assert io.proposer_run(spark, str(data / "out/lasa_run.json")).count() == 2
    assert run(spark, data, "featurize", "--input", str(data / "data/P_us.csv"), "--output", str(data / "out/F.csv")) == 0
    assert io.read_csv(spark, str(data / "out/F.csv")).count() == 2


ANSWERS = """import json, sys
for line in sys.stdin:
    asked = json.loads(line)
    names = asked["prompt"].split("Candidate Drugs:\\n")[1].split("\\n\\n")[0].split("\\n")
    print(json.dumps({"content": names[0].upper() + "\\nsomething else", "reasoning": "it said so"}), flush=True)
"""
LINES = """import sys
for line in sys.stdin:
    print(line.strip().replace("c", "k").replace("g", "ɡ"))
"""
NBEST = """import sys
words = next(a for a in sys.argv if a.startswith("--wordlist=")).split("=", 1)[1]
for w in open(words):
    print(w.strip() + "\\t0.5\\t" + " ".join(w.strip()))
    print(w.strip() + "\\t0.9\\tz z")
"""


def test_model_program_and_adapters(spark, data):
    """A local model, outside transcribers and scorers from TOML files, all by the command line; rows keep their order."""
    for name, text in (("answers", ANSWERS), ("lines", LINES), ("nbest", NBEST)):
        (data / f"{name}.py").write_text(text)
    assert run(spark, data, "propose", "--model-command", f"{sys.executable} {data}/answers.py", "--output", str(data / "other")) == 0
    rows = io.proposer_run(spark, str(data / "other/lasa_run.json")).collect()
    assert all(r["x_2"] == r["candidates"][:1] and r["reasoning"] == "it said so" for r in rows) and any(r["candidates"] for r in rows)
    (data / "toml").mkdir()
    (data / "toml/prefix.toml").write_text('algorithm = "prefix"\n')
    (data / "toml/aline.toml").write_text('algorithm = "aline"\n')
    pairs = [("zantac", "zentac"), ("aprinol", "aprinal"), ("dugorov", "dugorev"), ("sorulin", "surilin 5")]
    (data / "pairs.csv").write_text("x_1,x_2\n" + "".join(f"{a},{b}\n" for a, b in pairs))
    sound = ["--eng-command", f"{sys.executable} {data}/lines.py", "--fil-command", f"{sys.executable} {data}/nbest.py"]
    assert run(spark, data, "featurize", "--input", str(data / "pairs.csv"), "--scorers", str(data / "toml"), *sound) == 0
    got = [r for p in sorted((data / "pairs_pho.csv").glob("part-*")) for r in csv.DictReader(p.open())]
    assert [(r["x_1"], r["x_2"]) for r in got] == pairs
    assert [(r["t_eng_1"], r["t_eng_2"]) for r in got] == [(a.replace("c", "k"), b.replace("c", "k")) for a, b in pairs]
    assert [r["t_fil_2"] for r in got] == [b.replace(" ", "") for _, b in pairs]
    assert "prefix" in got[0] and "aline_g2p:eng" in got[0] and "bisim" not in got[0] and "core_bisim" in got[0]


def test_registry_is_reported_on(spark, data, capsys):
    assert run(spark, data, "propose") == 0
    said = capsys.readouterr().out
    assert "only 21 rows" in said and "21 rows, 20 clean names, 1 dropped" in said


def test_errors(spark, data, capsys):
    assert run(spark, data, "score") == 1
    assert "assemble" in capsys.readouterr().err
    assert run(spark, data, "noise", "--rejected", "x.csv", "--no-soft-labels") == 1


def test_missing_values_by_rule(spark, data):
    (data / "v.csv").write_text("x_1,x_2\nNA,nan\n,b\n")
    assert [tuple(r) for r in io.read_csv(spark, str(data / "v.csv")).collect()] == [(None, None), (None, "b")]
    assert [tuple(r) for r in io.read_csv(spark, str(data / "v.csv"), missing=False).collect()] == [("NA", "nan"), ("", "b")]


def test_combine(spark, data):
    d = data / "in"
    d.mkdir()
    (d / "a.csv").write_text("x,label\n1,0\n2,\n")
    (d / "b.csv").write_text("y,label\n3,0\n3,0\n")
    (d / "D.csv").write_text("x,label\n9,9\n")
    made = io.combine_csv(spark, str(d), str(data / "comb"), deduplicate=True)
    assert set(made) == {"D", "D_0", "D_nan"}
    assert io.read_csv(spark, made["D"]).count() == 3 and io.read_csv(spark, made["D_0"]).count() == 2
    with pytest.raises(ValueError):
        io.class_column(spark.range(1))


def test_proposer_run_json_array(spark, data):
    rows = [{"run": 1, "x_1": "a", "seed_x_2": "b", "candidates": ["C", "d"], "x_2": ["c"]}, {"run": 2, "x_1": "", "seed_x_2": "", "candidates": ["z"], "x_2": []}]
    (data / "run.json").write_text(json.dumps(rows, indent=1))
    run_ = io.proposer_run(spark, str(data / "run.json"))
    assert {tuple(r) for r in io.positives(spark, None, str(data / "run.json")).collect()} == {("a", "b"), ("a", "c")}
    assert {tuple(r) for r in io.rejections(spark, None, str(data / "run.json")).collect()} == {("a", "d")}
    assert run_.count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([("aprinol", "aprinal", 1)], incremental.PAIRS).write.parquet(str(tmp_path / "in"))
    q = incremental.featurize_stream(incremental.read_pairs(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
