import http.server
import json
import threading

import pytest

from nearnames.functions import chat, scorers
from nearnames.operators import pairs, proposer


def test_edit_parts():
    assert scorers.edit_parts("kitten", "sitting") == (2, 1, 0)
    assert scorers.edit_parts("abc", "") == (0, 0, 3) and scorers.edit_parts("", "") == (0, 0, 0)


def test_toml_scorers(spark, tmp_path):
    (tmp_path / "levenshtein.toml").write_text('algorithm = "levenshtein"\nseparate = true\n')
    (tmp_path / "aline_x.toml").write_text('algorithm = "ALINE"\nlangs = ["fil"]\n')
    (tmp_path / "prefix.toml").write_text("")
    found = scorers.load(tmp_path)
    assert [s.stem for s in found] == ["levenshtein", "prefix", "aline_x"]
    df = spark.createDataFrame([("abc", "abd", "a", "a")], "x_1 string, x_2 string, t_fil_1 string, t_fil_2 string")
    out = scorers.score(df, found, ("eng", "fil"))
    assert out.columns[4:] == ["levenshtein_substitutions", "levenshtein_indels", "levenshtein_indel_diff", "prefix", "aline_var:x_g2p:fil"]
    assert list(out.first())[4:] == pytest.approx([1, 0, 0, 2 / 3, 1])
    with pytest.raises(FileNotFoundError):
        scorers.load(tmp_path / "none")


def test_slice(spark):
    df = spark.range(50).withColumnRenamed("id", "pos")
    got = sorted(r["pos"] for r in pairs.slice_of(df, 10, 3).collect())
    assert got == list(range(got[0], got[0] + 10))
    assert pairs.slice_of(df, 100, 3).count() == 50


def test_chat_proposer_through_the_plan(spark):
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
            body = json.dumps({"choices": [{"message": {"content": "APRINEL \ninvented" if "aprinol" in asked else ""}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    seeds = spark.createDataFrame([(1, "aprinol", "aprinal")], "run long, x_1 string, x_2 string")
    registry = spark.createDataFrame([("aprinol", 0), ("aprinal", 1), ("aprinel", 2)], "drug_name string, pos long")
    run = proposer.propose(seeds, registry, chat.chat_proposer(f"http://127.0.0.1:{server.server_port}", "m"))
    assert run.first()["x_2"] == ["aprinel"]
    server.shutdown()
