import json

from larkspur import cli


def test_stages_in_order_and_their_exit_codes(spark, tmp_path, capsys):
    raw, out, emb, root = (str(tmp_path / x) for x in ("ads_raw.jsonl", "out", "emb", "root"))
    assert cli.main(["validate", "--input", raw, "--out-dir", out]) == 2
    assert cli.main(["generate", "--count", "600", "--seed", "3", "--out", raw]) == 0
    assert cli.main(["validate", "--input", raw, "--out-dir", out, "--fail-under", "0.99"]) == 1
    assert cli.main(["validate", "--input", raw, "--out-dir", out, "--fail-under", "0.5"]) == 0
    assert cli.main(["oracle", "--oracle", str(tmp_path / "expected_defects.json"), "--report", f"{out}/validation_report.json"]) == 0
    wrong = json.loads((tmp_path / "expected_defects.json").read_text()) | {"expected_accepted_total": 1}
    (tmp_path / "wrong.json").write_text(json.dumps(wrong))
    assert cli.main(["oracle", "--oracle", str(tmp_path / "wrong.json"), "--report", f"{out}/validation_report.json"]) == 1
    assert cli.main(["embed", "--input", f"{out}/ads_clean.jsonl", "--out-dir", emb]) == 0
    assert cli.main(["publish", "--clean", f"{out}/ads_clean.jsonl", "--embedded", emb, "--out-root", root]) == 0
    assert cli.main(["loadcheck", "--root", root]) == 0
    capsys.readouterr()
    assert cli.main(["probe", "--published", root, "--k", "2", "--query", "sturdy boots", "--dump-ground-truth", str(tmp_path / "truth.json")]) == 0
    assert "precision" in capsys.readouterr().out and len(json.loads((tmp_path / "truth.json").read_text())["queries"][0]["top_k"]) == 2
    assert cli.main(["loadcheck", "--root", root, "--ground-truth", str(tmp_path / "truth.json")]) == 0
    stale = json.loads((tmp_path / "truth.json").read_text()) | {"bundle_version": "other"}
    (tmp_path / "stale.json").write_text(json.dumps(stale))
    assert cli.main(["loadcheck", "--root", root, "--ground-truth", str(tmp_path / "stale.json")]) == 1
    assert cli.main(["probe", "--published", str(tmp_path / "nowhere")]) == 2
    assert cli.main(["loadcheck", "--root", str(tmp_path)]) == 2
